"""Positioned words to ordered dialogue, as Spark plans."""
