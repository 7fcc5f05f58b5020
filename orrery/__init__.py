"""Spark-native analytics for particle trajectories and the tables around them."""
