"""mutaspark: Spark-native analytics over durable streams of HTTP mutations."""
