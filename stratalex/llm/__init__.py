"""Training-data operators: counting, filtering, mixing, encoding, deduplicating and sharding text.

Nothing outside this subpackage imports it; ``__spark_entry__.py`` adds its queries when it is present.
"""
