"""Training-data operators: LM scoring, packing, extraction, cleaning, deduplication and archives.

Nothing else in the package imports this subpackage.
"""
