"""Retail analytics as Spark DataFrame jobs: clean, profile, aggregate, model, answer."""
