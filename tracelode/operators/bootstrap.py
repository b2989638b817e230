"""Paired bootstrap intervals with a reproducible stream of draws, without a loop on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelode.functions.metrics import relative_reduction
from tracelode.operators.ordered import running
from tracelode.session import stored

_A, _C, _M = 1664525, 1013904223, 1 << 32


def jump(seed: int, steps: int) -> int:
    """The state of s -> (A s + C) mod 2^32 after `steps` steps."""
    a, c = jump_map(steps)
    return (a * (seed % _M or 1) + c) % _M


_BLOCK = 1 << 16


def _steps(first: int, count: int, stride: int) -> list[tuple[int, int, int]]:
    """(i, a, c) of `first` + i `stride` steps as one map s -> a s + c, for i below `count`."""
    a, c = jump_map(first)
    sa, sc = jump_map(stride)
    out = []
    for i in range(count):
        out.append((i, a, c))
        a, c = a * sa % _M, (c * sa + sc) % _M
    return out


def jump_map(steps: int) -> tuple[int, int]:
    """`steps` steps of the generator as one map (a, c): s -> a s + c, by squaring."""
    a, c, ra, rc = _A, _C, 1, 0
    while steps:
        if steps & 1:
            ra, rc = ra * a % _M, (rc * a + c) % _M
        a, c = a * a % _M, (c * a + c) % _M
        steps >>= 1
    return ra, rc


def _times(a: Column, b: Column) -> Column:
    """a b mod 2^32 of two numbers below 2^32, without leaving 64 bits."""
    high, low = F.shiftright(a, 16), a.bitwiseAND(F.lit(0xFFFF).cast("bigint"))
    return F.pmod(F.pmod(high * b, F.lit(1 << 16)) * F.lit(1 << 16) + low * b, F.lit(_M))


def bootstrap_reductions(pairs: DataFrame, columns: list[str], order: str, samples: int = 2000, seed: int = 31, confidence: float = 0.95) -> DataFrame:
    """statistic, low, median, high of the relative reductions off_x -> on_x of resampled pairs.

    Sample k draws positions with steps k n + 1 .. k n + n of one generator. A draw's state is its sample's start (a table of
    `samples` rows) jumped over its step, and a step is a block of 65,536 steps and what is left (two short tables), so
    all draws are computed at once, where they are used. They meet the pairs by position: pairs are never collected, and
    a table of any size goes through the same plan.
    """
    spark = pairs.sparkSession
    names = [f"{s}_{c}" for c in columns for s in ("off", "on")]
    numbered = running(pairs.select(F.lit("").alias("_all"), order, *[F.col(x).cast("double") for x in names]), "_all", [order], pos=F.lit(1)).select("pos", *names)
    table = stored(numbered, "resampled")
    n = table.count()
    if not n:
        return spark.createDataFrame([], "statistic string, low double, median double, high double")
    at = [(k, jump(seed, k * n)) for k in range(max(200, samples))]
    starts = spark.createDataFrame(at, "sample int, state bigint")
    inner = spark.createDataFrame(_steps(1, min(n, _BLOCK), 1), "r bigint, ra bigint, rc bigint")
    outer = spark.createDataFrame(_steps(0, -(-n // _BLOCK), _BLOCK), "q bigint, qa bigint, qc bigint")
    j = spark.range(n).select((F.col("id") % _BLOCK).alias("r"), F.floor(F.col("id") / _BLOCK).alias("q"))
    steps = j.join(F.broadcast(inner), "r").join(outer, "q").select(_times(F.col("ra"), F.col("qa")).alias("a"), F.pmod(_times(F.col("ra"), F.col("qc")) + F.col("rc"), F.lit(_M)).alias("c"))
    state = F.pmod(_times(F.col("a"), F.col("state")) + F.col("c"), F.lit(_M))
    draws = steps.join(F.broadcast(starts)).select("sample", F.floor(state * F.lit(n) / F.lit(_M)).alias("pos") if n < 1 << 31 else F.floor(state / F.lit(_M) * n).alias("pos"))
    sums = draws.join(table, "pos").groupBy("sample").agg(*[F.sum(x).alias(x) for x in names])
    stats = sums.select("sample", F.explode(F.create_map(*[y for c in columns for y in (F.lit(c), relative_reduction(F.col(f"off_{c}"), F.col(f"on_{c}")))])).alias("statistic", "value"))
    tail = (1 - confidence) / 2
    return stats.groupBy("statistic").agg(F.percentile("value", F.array(F.lit(tail), F.lit(0.5), F.lit(1 - tail))).alias("q")).select("statistic", F.col("q")[0].alias("low"), F.col("q")[1].alias("median"), F.col("q")[2].alias("high"))
