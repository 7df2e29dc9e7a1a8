"""Recommendation-catalogue analytics as Spark DataFrame jobs."""
