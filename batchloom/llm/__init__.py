"""Training-data operators: deduplication, decontamination, counting, mixing and archives.

Nothing else in the library imports this subpackage.
"""
