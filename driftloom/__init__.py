"""Spark-native engine for session trajectories, training samples and their scores."""
