"""Versioned data curation and analytics on Spark."""
