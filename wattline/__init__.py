"""wattline: Spark-native meter telemetry analytics."""
