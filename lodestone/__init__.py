"""Tiered document retrieval and question-bank analytics on PySpark."""
