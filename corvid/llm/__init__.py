"""Training-data operators: extraction, filtering, deduplication, decontamination,
scoring, token counts, packing and archives.

Nothing else in the library imports this package; ``llm.queries`` registers its
named queries.
"""
