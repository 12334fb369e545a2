"""Scourline: a data-quality engine whose every step is a Spark plan."""
