"""Volumetric cell analytics as Spark DataFrame jobs."""
