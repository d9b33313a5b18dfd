"""Typed-question analytics on Spark."""
