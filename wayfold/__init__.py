"""wayfold: Spark-native analytics for moving-asset telemetry."""
