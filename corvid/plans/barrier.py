"""Compute expensive columns exactly once.

Catalyst substitutes a projected alias into later filters and projections.
For cheap expressions that is what we want; for a tokenizer or a per-element
array search it can multiply the work (an array referenced inside a lambda is
re-evaluated per element).  Emitting the columns from a one-row generator
(``inline(array(struct(...)))``) keeps them as attributes: predicates on them
stay above the generator and nothing is inlined through it.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compute_once(df: DataFrame, **cols: Column) -> DataFrame:
    keep = [c for c in df.columns if c not in cols]
    return df.select(*keep, F.inline(F.array(F.struct(*[e.alias(n) for n, e in cols.items()]))))
