"""loomwright: a Spark-native engine for cleaning, matching and corpus building."""
