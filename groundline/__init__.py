"""Grounded retrieval and answer analytics as Spark DataFrame stages."""
