"""icupanel: Spark-native analytics for irregular clinical time series."""
