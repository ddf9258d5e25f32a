"""graphband: sparse-matrix locality, graph partitioning and corpus work as Spark jobs."""
