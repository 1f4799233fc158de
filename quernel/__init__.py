"""A Spark-native relational engine with a small SQL dialect and snapshot tables."""
