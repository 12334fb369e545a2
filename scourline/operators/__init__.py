"""Profiling, rule matching, cleaning and monitoring operators."""
