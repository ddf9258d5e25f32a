"""Graph, partition, permutation and metric operators."""
