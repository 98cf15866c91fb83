"""Sequence-library analytics on Spark: k-mer counting, enrichment, motif models and text-corpus operators."""
