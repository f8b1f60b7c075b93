"""granary: a Spark-native retrieval, figures and news analytics engine."""
