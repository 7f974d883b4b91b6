"""Operators for preparing training text: deduplication, filtering, scanning and packing, each as Spark jobs."""
