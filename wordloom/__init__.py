"""A Spark-native engine for time-stamped word streams."""
