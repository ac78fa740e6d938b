"""Tessera: document retrieval and text analytics as Spark plans."""
