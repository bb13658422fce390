"""Recommendation data work as plain DataFrame -> DataFrame functions on Spark."""
