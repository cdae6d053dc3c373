"""A Spark-native analytics engine for archival document collections."""
