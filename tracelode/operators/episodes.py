"""Recovery episodes (failure to next success) and their pairing over time within a family."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelode.functions.metrics import positive_ratio, relative_reduction, token_proxy
from tracelode.functions.text import family_signature
from tracelode.operators.ordered import predecessors, running


def extract_episodes(trace: DataFrame) -> DataFrame:
    """One row per episode: from the first failure after the last success to the next success of the session.

    Gaps and islands: a row's group is the number of successes before it; a group's episode begins at its first failure
    and ends at the success that closes the group. A row that is failure and success at once closes its group first.
    Unfinished groups give nothing. The number comes from `ordered.running`, so a hot session is not one task.
    """
    at = F.struct("ts_ms", "seq")
    islands = running(trace, "session_id", ["ts_ms", "seq"], grp=F.col("is_success"))
    ends = islands.groupBy("session_id", "grp").agg(F.min(F.when(F.col("is_failure") & ~F.col("is_success"), at)).alias("start"), F.max(F.when(F.col("is_success"), at)).alias("stop")).filter("start is not null and stop is not null")
    spans = islands.join(ends, ["session_id", "grp"]).filter(at >= F.col("start"))
    counters = ("tok_in", "tok_cached", "tok_out", "tok_think", "tok_write")
    first = lambda c: F.min_by(c, F.struct("ts_ms", "seq"))
    extra = [F.count_if(F.col(c)).alias(c) for c in ("harmful", "benign", "abstained") if c in trace.columns]
    return spans.groupBy("session_id", "grp").agg(
        first("seq").alias("start_seq"), F.min("ts_ms").alias("started_ms"), F.max("ts_ms").alias("ended_ms"),
        F.count_if("is_failure").alias("retries"), F.sum("latency_ms").alias("wall_ms"), F.sum(sum((F.col(c) for c in counters), start=F.lit(0))).alias("tokens"), F.sum(token_proxy(*[F.col(c) for c in counters])).alias("proxy"),
        first(family_signature(F.col("command"), F.col("output"))).alias("family"), first("model").alias("model"), F.count("*").alias("events"), *extra,
    ).drop("grp")


def adjacent_pairs(episodes: DataFrame, max_ratio: float = 4.0, cross_session: bool = True) -> DataFrame:
    """Each episode (on) with its predecessor in the family (off); pairs of too unlike wall time or tokens have kept=false."""
    cols = [c for c in ("session_id", "start_seq", "started_ms", "retries", "wall_ms", "tokens", "proxy", "model", "usd", "success", "harmful", "benign", "abstained") if c in episodes.columns]
    named = predecessors(episodes.select("family", *cols), "family", ["started_ms", "start_seq"], cols, "off_")
    both = named.select("family", *[f"off_{c}" for c in cols], *[F.col(c).alias(f"on_{c}") for c in cols])
    wall, tok = positive_ratio(F.col("off_wall_ms"), F.col("on_wall_ms")), positive_ratio(F.col("off_tokens"), F.col("on_tokens"))
    crossed = F.col("off_session_id") != F.col("on_session_id")
    return both.withColumns({"wall_ratio": wall, "token_ratio": tok}).withColumn("crossed", crossed).withColumn("kept", (F.col("wall_ratio") <= max_ratio) & (F.col("token_ratio") <= max_ratio) & (crossed if cross_session else F.lit(True)))


def quality(wall: str = "wall_ratio", tokens: str = "token_ratio"):
    """1 / (1 + |log2 wall| + |log2 tokens|), 0 where a ratio isn't finite."""
    q = 1 / (1 + F.abs(F.log2(F.col(wall))) + F.abs(F.log2(F.col(tokens))))
    return F.when(F.col(wall).isin(float("inf")) | F.col(tokens).isin(float("inf")), F.lit(0.0)).otherwise(q)


def aggregate_pairs(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Totals, rates and relative reductions of the kept pairs."""
    sums = {f"{side}_{c}": F.coalesce(F.sum(f"{side}_{c}"), F.lit(0)) for side in ("off", "on") for c in ("retries", "wall_ms", "tokens", "proxy")}
    grouped = pairs.filter("kept").groupBy(*(by or [])).agg(F.count("*").alias("pairs"), *[c.alias(k) for k, c in sums.items()])
    red = lambda c: F.round(relative_reduction(F.col(f"off_{c}"), F.col(f"on_{c}")), 6)
    return grouped.withColumns({"dead_end_reduction": red("retries"), "wall_reduction": red("wall_ms"), "token_reduction": red("tokens"), "proxy_reduction": red("proxy")})
