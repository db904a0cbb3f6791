"""Vellum: document-corpus analytics expressed as Spark jobs."""
