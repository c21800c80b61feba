"""Operations on training text: cleaning, deduplication, scoring, mixing and formatting.

Nothing outside this subpackage imports it.
"""
