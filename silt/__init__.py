"""Evolutionary analysis of version-control history on Spark."""
