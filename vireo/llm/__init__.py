"""Training-data operators: filters, mixing, deduplication, privacy, tokens and packing.

Nothing outside this subpackage imports it; the entry module adds its queries only when it
is present.
"""
