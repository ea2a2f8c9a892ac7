"""Shock-impact analytics as Spark DataFrame jobs."""
