"""Readers and writers: tables, rule files, reports."""
