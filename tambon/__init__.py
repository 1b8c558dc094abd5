"""tambon: Spark-native extraction of address records from free-form Thai messages."""
