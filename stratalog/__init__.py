"""Stratalog: cloud-security analytics as Spark DataFrame jobs."""
