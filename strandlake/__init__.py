"""A Spark-native analytics engine for sequence, interval and omics tables."""
