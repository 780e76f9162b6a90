"""A Spark-native analytics engine: one compiler, two front doors (DataFrame helpers and a SQL dialect)."""
