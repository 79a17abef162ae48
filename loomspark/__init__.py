"""A PySpark-native analytics engine: relational queries, vectors, programs and sealed tables on the DataFrame API."""
