"""Run logs, as tables and as streams."""
