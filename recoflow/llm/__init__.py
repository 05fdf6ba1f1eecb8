"""Training-data operators: deduplication, quality, language, licences, tokens, contamination, URLs.

Nothing else in the library imports this subpackage.
"""
