"""Training-data operators: extraction, token counts, deduplication, decontamination, scoring and filters.

Nothing else in the library imports this subpackage.
"""
