"""Review samples: a reproducible shuffle, stratified samples, reviewer packets, adjudication."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_A, _C, _M = 1664525, 1013904223, 1 << 32


def shuffled(items: Sequence, seed: int) -> list:
    """Fisher and Yates from the end, drawn by the generator s -> (A s + C) mod 2^32 (seed 0 counts as 1)."""
    out, state = list(items), seed % _M or 1
    for i in range(len(out) - 1, 0, -1):
        state = (state * _A + _C) % _M
        j = state * (i + 1) // _M
        out[i], out[j] = out[j], out[i]
    return out


def stratified_sample(rows: DataFrame, by: str, key: str, size: int, seed: int = 31) -> list:
    """Keys of `size` rows: of each stratum (in the order of names) an equal share of a shuffle, the rest from what is left.

    The shuffle is a sequence by definition, so the keys of the candidates are collected: of a stratum, no more than the
    `size` + 1,000 rows with the least hash are candidates, which bounds the driver and leaves every row the same chance.
    """
    bound = size + 1_000
    picked = rows.select(by, key, F.xxhash64(F.col(key), F.lit(seed)).alias("h"))
    slices = picked.withColumn("slice", F.pmod("h", F.lit(64)))
    # Of 64 slices first, so a stratum that holds most rows is never in one task.
    least = lambda df, *more: df.groupBy(by, *more).agg(F.slice(F.array_sort(F.collect_list(F.struct("h", key))), 1, bound).alias("c")).select(by, F.inline("c"))
    groups: dict[str, list] = {}
    for r in sorted(least(least(slices, "slice")).collect(), key=lambda r: (r[by], r[key])):
        groups.setdefault(r[by], []).append(r[key])
    if sum(map(len, groups.values())) <= size:
        return [k for g in sorted(groups) for k in groups[g]]
    share, chosen, left, budget = max(1, size // max(1, len(groups))), [], [], size
    for i, g in enumerate(sorted(groups)):
        order = shuffled(groups[g], seed + i * 9973)
        take = min(len(order), share, budget)
        chosen += order[:take]
        left += order[take:]
        budget -= take
    if budget <= 0:
        return shuffled(chosen, seed + 17)[:size]
    chosen += shuffled(left, seed + 29)[:budget]
    return shuffled(chosen, seed + 53)[:size]


def dual_assignment(keys: Sequence, seed: int = 31, overlap: float = 0.1) -> dict:
    """Reviewers by key: the first part of a shuffle goes to both, the rest in turns."""
    order = shuffled(keys, seed)
    both = int(len(order) * overlap + 0.5)
    return {k: ("a", "b") if i < both else (("a",), ("b",))[(i - both) % 2] for i, k in enumerate(order)}


def require_unique(rows: DataFrame, key: str) -> DataFrame:
    """`rows`, or an error where a key occurs twice or is null."""
    twice = rows.groupBy(key).count().filter(F.col("count") > 1).limit(1).collect()
    if twice or not rows.filter(F.col(key).isNull()).isEmpty():
        raise ValueError(f"{key} is not unique: {twice[0][0] if twice else None}")
    return rows


def adjudicated(policy: str, a: Column, b: Column, predicted: Column) -> Column:
    """The label that holds: what the reviewers agree on, the only one there is, or what the policy says of a conflict."""
    other = {"unresolved": F.lit(None).cast("string"), "reviewer_a": a, "reviewer_b": b, "predicted": predicted}[policy]
    return F.when(a.isNull(), b).when(b.isNull() | (a == b), a).otherwise(other)
