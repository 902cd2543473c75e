"""Training-data operators: deduplication, language, privacy, extraction, filtering, packing.

Nothing outside this subpackage imports it.  Every module holds one operator with its own general
interface; ``queries`` holds the thin registered queries.
"""
