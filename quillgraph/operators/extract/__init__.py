"""Extraction of symbols and relationships from source text."""
