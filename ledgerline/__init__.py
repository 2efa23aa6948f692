"""A Spark-native library for historical records: text, matching, placement, reconciliation and statistics."""
