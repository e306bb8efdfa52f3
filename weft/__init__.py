"""weft: a Spark-native engine for corpus preparation and scoring analytics."""
