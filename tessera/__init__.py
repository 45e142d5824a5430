"""Tessera: document, retrieval and evaluation analytics as Spark DataFrames."""
