"""Preference analytics and corpus preparation on PySpark."""
