"""A Spark-native catalog, store and search engine for mixed-content corpora."""
