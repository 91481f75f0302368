"""A Spark-native catalog and tile-pyramid engine for whole-slide microscopy collections."""
