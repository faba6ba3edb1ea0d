"""Operators for preparing training corpora: extraction, dedup, filtering,
mixing, formatting and sharding.

Nothing outside this subpackage imports it; ``queries`` and ``oracle`` hold
what ``__spark_entry__`` registers.
"""
