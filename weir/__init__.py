"""weir: composable, Spark-native data flows."""
