"""ionmill: Spark-native analytics for tandem mass-spectrometry data."""
