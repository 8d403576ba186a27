"""Spark-native analytics over keypoint tracks of many short video sequences."""
