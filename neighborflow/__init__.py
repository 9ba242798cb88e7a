"""neighborflow: graph neighbourhood sampling, feature storage and sparse-embedding updates as Spark DataFrame plans."""
