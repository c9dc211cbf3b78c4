"""Hybrid retrieval over document chunks, expressed as Spark DataFrame plans."""
