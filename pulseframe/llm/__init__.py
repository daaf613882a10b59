"""Training-data operators: deduplication, filtering, scoring, tokenising and WARC.

Self-contained: nothing outside this package imports it, and it imports nothing
from the rest of the library.
"""
