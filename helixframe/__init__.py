"""helixframe: Spark-native tabular, interval, ordered and statistical operators."""
