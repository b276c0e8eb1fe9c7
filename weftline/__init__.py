"""Weftline: site-corpus quality checks and text-corpus preparation on PySpark."""
