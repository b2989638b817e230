"""Token, ratio and reduction arithmetic of the evaluation reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of the token proxy (fixed values): uncached input, cached input, output, thinking, cache writes.
TOKEN_WEIGHTS = {"inputUncached": 1.0, "inputCached": 0.2, "output": 1.0, "thinking": 1.0, "cacheWrite": 0.2}


def token_proxy(uncached: Column, cached: Column, output: Column, thinking: Column | None = None, cache_write: Column | None = None) -> Column:
    """Weighted sum of token counters; a missing counter is 0."""
    parts = ((uncached, "1.0"), (cached, "0.2"), (output, "1.0"), (thinking, "1.0"), (cache_write, "0.2"))
    zero = F.lit(0).cast("decimal(18,2)")
    return sum((F.coalesce(c, zero) * F.lit(w).cast("decimal(2,1)") for c, w in parts if c is not None), start=F.lit(0))


def relative_reduction(off: Column, on: Column) -> Column:
    """(off - on) / off; with nothing to reduce it is 0 if `on` is nothing too, else -1."""
    return F.when(off <= 0, F.when(on <= 0, F.lit(0.0)).otherwise(F.lit(-1.0))).otherwise((off - on).cast("double") / off.cast("double"))


def positive_ratio(a: Column, b: Column) -> Column:
    """The larger over the smaller: 1 if both are 0, infinite if one isn't positive."""
    a, b = a.cast("double"), b.cast("double")
    return F.when((a == 0) & (b == 0), F.lit(1.0)).when((a <= 0) | (b <= 0), F.lit(float("inf"))).otherwise(F.greatest(a, b) / F.least(a, b))


def safe_rate(part: Column, whole: Column) -> Column:
    """part / whole, 0 where there is no positive whole."""
    return F.when(whole > 0, part.cast("double") / whole.cast("double")).otherwise(F.lit(0.0))


def f1(precision: Column, recall: Column) -> Column:
    """Harmonic mean, 0 where both are 0."""
    return F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(F.lit(0.0))


def checks(*rules: tuple[str, Column]) -> Column:
    """The names of the rules that fail, in order, joined by commas."""
    return F.array_join(F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules])), ",")
