"""A Spark-native engine for schema-flexible documents kept as a log of mutations."""
