"""A Spark-native engine for the evolution of geographic entities through time."""
