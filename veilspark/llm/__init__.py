"""Operators of a training-data pipeline: the ten dealt methods and their queries."""
