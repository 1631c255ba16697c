"""Plumbline: scoring, style profiling and matching analytics as Spark DataFrame functions."""
