"""Training-data operators: deduplication, filtering, decontamination and tokenization over documents.

Nothing else in the library imports this subpackage.
"""
