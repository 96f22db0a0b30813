"""Time-frequency analysis of long signals, as Spark jobs."""
