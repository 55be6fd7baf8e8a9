"""Textloom: curation, refinement and evaluation of transcript-like text as Spark DataFrame plans."""
