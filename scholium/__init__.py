"""Corpus-scale analytics over academic papers, written as Spark DataFrame operators."""
