"""Facts of keys joined to many rows, where one key may hold a large share of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot with more than one in so many rows, so there are never more hot keys than this.
SHARE = 1000
#: Facts of so many keys at most are broadcast at once.
FEW = 250_000


def _on(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"`{k}`").eqNullSafe(F.col(f"`__{k}`"))
    return on


def with_facts(rows: DataFrame, facts: DataFrame, keys: list[str], size: str, how: str = "inner", few: int = FEW) -> DataFrame:
    """rows joined with facts(keys, size, ...), one row a key, nulls equal; size: how many rows have the key.

    Facts of few keys are broadcast. Of many, those of hot keys (one in SHARE rows or more: SHARE at most) are, and
    their rows stay where they are; all others are shuffled. how: inner or left. size is not in the result.
    """
    given = [c for c in facts.columns if c not in keys and c != size]
    renamed = facts.select(*[F.col(f"`{k}`").alias(f"__{k}") for k in keys], size, *given)
    out = [*[F.col(f"`{c}`") for c in rows.columns], *[F.col(f"`{c}`") for c in given]]
    n, total = facts.agg(F.count(F.lit(1)), F.sum(size)).first()
    joined = lambda part, other: part.join(other, _on(part, other, keys), how).select(*out)
    if n <= few:
        return joined(rows, F.broadcast(renamed.drop(size)))
    hot = renamed.where(F.col(size) * SHARE > total)
    if hot.isEmpty():
        return joined(rows, renamed.drop(size))
    named = F.broadcast(hot.select(*[f"__{k}" for k in keys]))
    calm = rows.join(named, _on(rows, named, keys), "left_anti")
    warm = rows.join(named, _on(rows, named, keys), "left_semi")
    return joined(calm, renamed.drop(size)).unionByName(joined(warm, F.broadcast(hot.drop(size))))
