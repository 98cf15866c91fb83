"""Training-data operators: classification, deduplication, decontamination, mixing and token output.

Nothing else in the library imports this subpackage.
"""
