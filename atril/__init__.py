"""Transcript-quality analytics on PySpark."""
