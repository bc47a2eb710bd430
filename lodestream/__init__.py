"""A Spark-native analytics engine for keyed, time-ordered tables."""
