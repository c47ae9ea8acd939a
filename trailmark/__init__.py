"""Interaction analytics and corpus preparation on PySpark."""
