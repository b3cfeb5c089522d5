"""orrery: DataFrame operators for tabular, ordered-series and embedding workloads on Spark."""
