"""palimpsest: a Spark-native analytics engine for rewritten text and code."""
