"""Training-data operators: language ID, filters, scans, deduplication, decontamination, tokenisation.

Nothing else in the library imports this subpackage; it imports nothing from the
rest of the library either, so that either side can be removed alone.
"""
