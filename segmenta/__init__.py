"""Spark-native analytics over ordered, speaker-labelled, time-stamped segments."""
