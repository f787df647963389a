"""Spark-native product matching, price intelligence and corpus preparation."""
