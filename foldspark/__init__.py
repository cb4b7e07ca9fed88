"""Spark jobs over protein sequence, domain, ontology and structure-score tables."""
