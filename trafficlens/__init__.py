"""Spark-native analytics over logs of automated web traffic."""
