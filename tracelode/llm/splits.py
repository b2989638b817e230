"""Problem 3: train, validation and test splits that keep related records together.

Records that share a key (family signature, session, task instance) belong together, directly or through others. The
keys are the vertices of a graph in which a record links its keys. Random-mate contraction: each round every vertex
flips a coin by a hash of the round, a tail that has head neighbours is collapsed into the least of them, edges are
relabelled with two joins and reduced to distinct ones, until no edge is left; then the rounds are unwound from the last
to the first to label every vertex. Components are assigned by cumulative weight, the order of components given by a
hash, so the proportions hold to within one component.

Every round is written to the shared folder, so lineage stays short and a lost executor costs a task. Hot keys: picking a
mate is an aggregate with partial sums; the edges of a hot vertex are distinct, and the skew joins of adaptive execution
split what is left. Nothing is collected but counts.

Defined results: null, blank and `recovery` signatures, null and blank sessions join nothing; keys ignore case and white
space as stated in `record_keys`; repeated rows of a record count once; records without any key stand alone; an empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelode.functions import payload as P
from tracelode.session import stored

PROPORTIONS = {"train": 0.8, "validation": 0.1, "test": 0.1}


def _vertex(kind: str, value: Column) -> Column:
    """96 bits of a hash name a vertex: no collision is to be expected among 10^10 keys."""
    return F.when(value.isNotNull(), F.substring(F.md5(F.concat(F.lit(kind), value)), 1, 24))


def record_keys(episodes: DataFrame) -> DataFrame:
    """episode_no, family, session, instance (vertex names, null where there is none), one row per episode.

    Family: lower case, white space squeezed. Session: lower case, outer white space dropped. Instance: the second part
    of a session of three or four parts.
    """
    clean = lambda c: F.nullif(F.lower(P.squeeze(F.col(c))), F.lit(""))
    family = clean("familySignature")
    session = F.nullif(F.lower(F.regexp_replace("sessionId", f"^{P.SPACE}|{P.SPACE}$", "")), F.lit(""))
    parts = F.split(session, "::")
    instance = F.when(F.size(parts).isin(3, 4), F.nullif(F.trim(F.element_at(parts, 2)), F.lit("")))
    return episodes.select("episode_no", _vertex("f", F.when(family != "recovery", family)).alias("family"), _vertex("s", session).alias("session"), _vertex("i", instance).alias("instance")).groupBy("episode_no").agg(*[F.min(c).alias(c) for c in ("family", "session", "instance")])


def contract(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """Label every vertex of `edges` (a, b) with the root of its component: vertex, root. Roots label themselves not."""
    lo_hi = lambda df: df.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges = stored(lo_hi(edges), "edges-0")
    maps: list[DataFrame] = []
    for r in range(1, max_rounds + 1):
        if edges.isEmpty():
            break
        head = lambda c: F.pmod(F.xxhash64(F.col(c), F.lit(r)), F.lit(2)) == 1  # noqa: B023, E731
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        mates = stored(both.filter(~head("a") & head("b")).groupBy(F.col("a").alias("vertex")).agg(F.min("b").alias("root")), f"mates-{r}")
        maps.append(mates)
        for end in ("a", "b"):
            edges = edges.join(mates.select(F.col("vertex").alias(end), F.col("root").alias("_r")), end, "left").withColumn(end, F.coalesce("_r", end)).drop("_r")
        edges = stored(lo_hi(edges), f"edges-{r}")
    else:
        raise RuntimeError(f"edges are left after {max_rounds} rounds")
    if not maps:
        return edges.select(F.col("a").alias("vertex"), F.col("b").alias("root"))
    labels = maps[-1]
    for k, mates in enumerate(reversed(maps[:-1])):
        moved = mates.join(labels.select(F.col("vertex").alias("root"), F.col("root").alias("_r")), "root", "left").select("vertex", F.coalesce("_r", "root").alias("root"))
        labels = labels.unionByName(moved)
        if k % 4 == 3:
            labels = stored(labels, f"labels-{k}")
    return stored(labels, "labels")


def components(episodes: DataFrame) -> DataFrame:
    """One row per episode: episode_no, group_no (the least episode of its component), members."""
    records = stored(record_keys(episodes), "records")
    # The instance is a part of the session id: where there is one, it stands for all its sessions.
    records = records.withColumn("session", F.coalesce("instance", "session"))
    edges = records.filter("session is not null and family is not null").select(F.col("family").alias("a"), F.col("session").alias("b"))
    labels = contract(edges)
    keyed = records.select("episode_no", F.coalesce("session", "family", F.concat(F.lit("e"), F.col("episode_no").cast("string"))).alias("vertex"))
    by_key = stored(keyed.groupBy("vertex").agg(F.min("episode_no").alias("least"), F.count("*").alias("n")).join(labels, "vertex", "left").withColumn("root", F.coalesce("root", "vertex")), "by-key")
    groups = by_key.groupBy("root").agg(F.min("least").alias("group_no"), F.sum("n").alias("members"))
    named = by_key.select("vertex", "root").join(groups, "root").select("vertex", "group_no", "members")
    return keyed.join(named, "vertex").select("episode_no", "group_no", "members")


def assign_splits(episodes: DataFrame, proportions: dict[str, float] | None = None, seed: int = 7, large: float = 0.02) -> DataFrame:
    """episode_no, group_no, split: whole components by cumulative weight, in the order of a hash of the component.

    Components of more than `large` of all records come first, so they fill the first split and not a small one. The
    running sum is taken over 1,024 slices of the hash and then within each slice, never over all components in a task.
    """
    shares = proportions or PROPORTIONS
    members = stored(components(episodes), "components")
    total = members.count()
    weights = members.groupBy("group_no").agg(F.first("members").alias("w"))
    h = F.xxhash64(F.col("group_no"), F.lit(seed))
    sliced = weights.select("group_no", "w", F.when(F.col("w") > large * max(total, 1), F.lit(-1)).otherwise(F.pmod(h, F.lit(1024))).alias("slice"), h.alias("h"))
    w = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    before = sliced.groupBy("slice").agg(F.sum("w").alias("sw")).select("slice", F.coalesce(F.sum("sw").over(w), F.lit(0)).alias("base"))
    own = Window.partitionBy("slice").orderBy("h", "group_no").rowsBetween(Window.unboundedPreceding, -1)
    middle = (F.col("base") + F.coalesce(F.sum("w").over(own), F.lit(0)) + F.col("w") / 2) / F.lit(float(max(total, 1)))
    split, upto = F.lit(list(shares)[-1]), 1.0
    for name in reversed(list(shares)[:-1]):
        upto -= shares[list(shares)[list(shares).index(name) + 1]]
        split = F.when(F.col("middle") < upto, F.lit(name)).otherwise(split)
    placed = sliced.join(F.broadcast(before), "slice").withColumn("middle", middle).select("group_no", split.alias("split"))
    return members.select("episode_no", "group_no").join(placed, "group_no")
