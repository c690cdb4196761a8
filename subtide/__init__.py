"""Spark-native speech-transcript and subtitle analytics."""
