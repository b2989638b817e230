"""Problem 4: keep exactly one copy of messages that were delivered at least once.

A persisted index holds, by hash prefix, sorted arrays of the identifiers seen so far, each with the best copy (lowest
instant, then lowest `ingest_seq`). A batch is first deduplicated by itself (partial aggregation, so an identifier that
holds a third of a batch costs one row a task); what is left, one row per identifier, is binary-searched in the arrays
of its prefix. Hits give the losing copy away, novel identifiers and better copies become a new run of the index. Runs
are immutable and of tiers: as soon as a tier has `fan` runs they are merged into one of the next tier, so an identifier
is rewritten once a tier and not once a merge. Each task holds the arrays of one prefix; `prefix_bits` sets their size.

The state of the index (its runs, and the batches taken in with where their verdicts lie) is a small table that is written
after every batch, so an index that is opened at its path goes on where it stood. A batch that is offered again under its
number gets the verdict it got, as long as it is among the last `remember` ones; one that comes again later or under
another number finds its own copies in the index, which are not surplus to themselves.

Defined results: an identifier is `teamId`, `sessionId` without outer white space and `contentSha256` without outer
white space or case; a null team or session equals only null; a delivery without content hash (null or blank) can't be
identified and is never surplus; missing and unreadable receive times come last; ties go to the lowest `ingest_seq`;
`duplicate` and all other columns are ignored; an empty batch changes nothing; a null batch id is a batch of its own.
"""

from __future__ import annotations

import json
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelode.functions import payload as P
from tracelode.functions.instants import instant_micros
from tracelode.session import file_system, scratch_table, stored

_LAST = 2**63 - 1
_RUN = "prefix INT, run INT, n LONG, keys BINARY, ranks BINARY, seqs BINARY"
_KEY = 32  # hex digits


def outer_trim(text: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(text, f"^{P.SPACE}|{P.SPACE}$", "")


def delivery_copies(bundles: DataFrame, *more: str) -> DataFrame:
    """key (32 hex digits), rank (instant in microseconds, missing last), seq of each delivery that has an identity, and `more`."""
    sha = F.lower(outer_trim(F.col("contentSha256")))
    part = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit("-"))
    key = F.md5(F.concat_ws("\u0001", part(F.col("teamId")), part(outer_trim(F.col("sessionId"))), sha))
    return bundles.filter(F.length(sha) > 0).select(key.alias("key"), F.coalesce(instant_micros(F.col("receivedAtUtc")), F.lit(_LAST)).alias("rank"), F.col("ingest_seq").alias("seq"), *more)


def _arrays(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(row["keys"], dtype=f"S{_KEY}"), np.frombuffer(row["ranks"], dtype=np.int64), np.frombuffer(row["seqs"], dtype=np.int64)


def _key_array(column: pa.ChunkedArray) -> np.ndarray:
    return np.array(column.to_pylist(), dtype=f"S{_KEY}") if len(column) else np.empty(0, dtype=f"S{_KEY}")


def _search(batch: pa.Table, runs: pa.Table) -> pa.Table:
    """Rows of one prefix against its runs: kind `surplus` (seq lost), kind `entry` (novel, or better than the index)."""
    keys, rank, seq = _key_array(batch["key"]), batch["rank"].to_numpy().copy(), batch["seq"].to_numpy().copy()
    best_rank, best_seq = np.full(len(keys), _LAST), np.full(len(keys), _LAST)
    known = np.zeros(len(keys), dtype=bool)
    for row in runs.to_pylist():
        have, ranks, seqs = _arrays(row)
        at = np.minimum(np.searchsorted(have, keys), max(len(have) - 1, 0))
        hit = (have[at] == keys) if len(have) else np.zeros(len(keys), dtype=bool)
        r, s = ranks[at], seqs[at]
        better = hit & (~known | (r < best_rank) | ((r == best_rank) & (s < best_seq)))
        best_rank[better], best_seq[better] = r[better], s[better]
        known |= hit
    wins = ~known | (rank < best_rank) | ((rank == best_rank) & (seq < best_seq))
    again = known & (rank == best_rank) & (seq == best_seq)  # a delivery that comes again is not surplus to itself
    lost = np.concatenate([seq[~wins & ~again], best_seq[wins & known]])
    prefix = batch["prefix"][0].as_py() if len(batch) else 0
    n, m = len(lost), int(wins.sum())
    return pa.table(
        {
            "kind": pa.array(["surplus"] * n + ["entry"] * m, pa.string()), "prefix": pa.array(np.full(n + m, prefix, dtype=np.int32)),
            "key": pa.array([None] * n + [k.decode() for k in keys[wins]], pa.string()),
            "rank": pa.array(np.concatenate([np.zeros(n, dtype=np.int64), rank[wins]])), "seq": pa.array(np.concatenate([lost, seq[wins]])),
        }
    )


def _sorted_run(number: int):
    def build(t: pa.Table) -> pa.Table:
        keys = _key_array(t["key"])
        order = np.argsort(keys, kind="stable")
        pack = lambda x: pa.array([x[order].tobytes()], pa.binary())
        return pa.table({"prefix": pa.array([t["prefix"][0].as_py()], pa.int32()), "run": pa.array([number], pa.int32()), "n": pa.array([len(keys)]), "keys": pack(keys), "ranks": pack(t["rank"].to_numpy()), "seqs": pack(t["seq"].to_numpy())})

    return build


def _merge(t: pa.Table) -> pa.Table:
    parts = [_arrays(r) for r in t.sort_by("run").to_pylist()]
    keys, ranks, seqs = (np.concatenate([p[i] for p in parts]) for i in range(3))
    order = np.lexsort((seqs, ranks, keys))
    keys, ranks, seqs = keys[order], ranks[order], seqs[order]
    first = np.append(True, keys[1:] != keys[:-1])
    pack = lambda x: pa.array([x[first].tobytes()], pa.binary())
    return pa.table({"prefix": pa.array([t["prefix"][0].as_py()], pa.int32()), "run": pa.array([max(t["run"].to_pylist())], pa.int32()), "n": pa.array([int(first.sum())]), "keys": pack(keys), "ranks": pack(ranks), "seqs": pack(seqs)})


class DeliveryIndex:
    """The index of one stream of deliveries, as tables below `path` in the shared folder; an existing one is opened."""

    def __init__(self, spark: SparkSession, path: str | None = None, prefix_bits: int = 8, fan: int = 4, remember: int = 1_000):
        if not 0 < prefix_bits <= 32 or fan < 2:
            raise ValueError("prefix_bits must be from 1 to 32, fan at least 2")
        self.spark, self.path, self.bits, self.fan, self.remember = spark, path or scratch_table(spark, "delivery-index"), prefix_bits, fan, remember
        #: Runs as (tier, path), and the verdict's path by batch number.
        self.runs: list[tuple[int, str]] = []
        self.batches: dict[int, str] = {}
        self.version = 0
        self._open()

    def _open(self) -> None:
        fs, where = file_system(self.spark, f"{self.path}/state")
        if not fs.exists(where):
            return
        names = [f.getPath().getName() for f in fs.listStatus(where)]
        done = [int(n.split("-")[1]) for n in names if n.startswith("version-")]
        if done:
            self.version = max(done)
            stream = fs.open(self.spark._jvm.org.apache.hadoop.fs.Path(where, f"version-{self.version}"))
            state = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            stream.close()
            self.bits, self.runs = state["bits"], [(t, p) for t, p in state["runs"]]
            self.batches = {int(n): p for n, p in state["batches"]}

    def _save(self) -> None:
        """The state as one small file, which gets its name when it is complete."""
        self.version += 1
        fs, draft = file_system(self.spark, f"{self.path}/state/draft-{self.version}")
        stream = fs.create(draft, True)
        stream.write(bytearray(json.dumps({"bits": self.bits, "runs": self.runs, "batches": sorted(self.batches.items())}).encode()))
        stream.close()
        fs.rename(draft, self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/state/version-{self.version}"))
        self._delete(f"{self.path}/state/version-{self.version - 2}")

    def _delete(self, path: str) -> None:
        fs, where = file_system(self.spark, path)
        fs.delete(where, True)

    def _prefix(self) -> Column:
        return F.shiftright(F.conv(F.substring("key", 1, 8), 16, 10).cast("bigint"), 32 - self.bits).cast("int")

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(_RUN).parquet(*paths)

    def offer(self, batch: DataFrame, number: int | None = None) -> DataFrame:
        """Take a batch in; the `seq` of each delivery that is surplus now: its own, and those that it displaced."""
        return self.offer_copies(delivery_copies(batch), number)

    def offer_copies(self, copies: DataFrame, number: int | None = None) -> DataFrame:
        """The same for what `delivery_copies` made of a batch."""
        number = max(self.batches, default=-1) + 1 if number is None else number
        if number not in self.batches:
            self._take(copies, number)
        return self.verdict(number)

    def verdict(self, number: int) -> DataFrame:
        """The `seq` of what a remembered batch made surplus."""
        return self.spark.read.parquet(self.batches[number]).filter("kind = 'surplus'").select("seq")

    def _take(self, copies: DataFrame, number: int) -> None:
        best = copies.groupBy("key").agg(F.min(F.struct("rank", "seq")).alias("b")).select("key", "b.rank", "b.seq").withColumn("prefix", self._prefix())
        verdict, run = f"{self.path}/verdict-{number:06d}", f"{self.path}/run-{number:06d}"
        schema = "kind STRING, prefix INT, key STRING, rank LONG, seq LONG"
        if self.runs:
            found = best.groupBy("prefix").cogroup(self._read([p for _, p in self.runs]).groupBy("prefix")).applyInArrow(_search, schema)
        else:
            found = best.select(F.lit("entry").alias("kind"), "prefix", "key", "rank", "seq")
        # Surplus within the batch: every copy but its identifier's best one; `seq` is unique, so no key is hot here.
        none = F.lit(None)
        local = copies.select("seq").join(best.select("seq"), "seq", "left_anti").select(F.lit("surplus").alias("kind"), none.cast("int").alias("prefix"), none.cast("string").alias("key"), none.cast("long").alias("rank"), "seq")
        found.unionByName(local).write.mode("overwrite").parquet(verdict)
        entries = self.spark.read.parquet(verdict).filter("kind = 'entry'").select("prefix", "key", "rank", "seq")
        entries.groupBy("prefix").applyInArrow(_sorted_run(number), _RUN).write.mode("overwrite").parquet(run)
        self.runs.append((0, run))
        self.batches[number] = verdict
        old = self._merge_tiers(number)
        for forgotten in sorted(self.batches)[: -self.remember]:
            old.append(self.batches.pop(forgotten))
        self._save()
        for path in old:  # what no state names any more
            self._delete(path)

    def _merge_tiers(self, number: int) -> list[str]:
        """Merge every tier that is full into the next one; the paths of the runs that went."""
        gone, tier = [], 0
        while len(full := [p for t, p in self.runs if t == tier]) >= self.fan:
            run = f"{self.path}/run-{number:06d}-tier-{tier + 1}"
            self._read(full).groupBy("prefix").applyInArrow(_merge, _RUN).write.mode("overwrite").parquet(run)
            self.runs = [(t, p) for t, p in self.runs if t != tier] + [(tier + 1, run)]
            gone += full
            tier += 1
        return gone


def prefix_bits_for(rows: int, ids_per_prefix: int = 200_000, least: int = 3) -> int:
    """So many bits that a prefix holds about `ids_per_prefix` identifiers (some 10 MB of arrays)."""
    return min(32, max(least, int(np.ceil(np.log2(max(rows, 1) / ids_per_prefix))) if rows > ids_per_prefix else least))


def surplus_deliveries(bundles: DataFrame, offers: int = 3, index: DeliveryIndex | None = None) -> DataFrame:
    """`ingest_seq` of all surplus deliveries of a table.

    Whole batches (`batchId`) are taken in by the order of their first arrival, in three offers to an index that merges
    every two runs of a tier, so the last offer meets a merged run; a batch is in the offer into which its first delivery
    falls.
    """
    spark = bundles.sparkSession
    low, high, n = bundles.agg(F.min("ingest_seq"), F.max("ingest_seq"), F.count("*")).first()
    if not n:
        return bundles.select("ingest_seq").limit(0)
    index = index or DeliveryIndex(spark, prefix_bits=prefix_bits_for(n), fan=2)
    if "batchId" in bundles.columns:
        # The batches' first deliveries are few next to the deliveries; a null batch is known by its own delivery alone.
        first = bundles.filter("batchId is not null").groupBy("batchId").agg(F.min("ingest_seq").alias("_first"))
        placed = bundles.join(first, "batchId", "left").withColumn("_first", F.coalesce("_first", "ingest_seq"))
    else:
        placed = bundles.withColumn("_first", F.col("ingest_seq"))
    offer = F.floor((F.col("_first") - low) * offers / F.lit(float(high - low + 1))).cast("int")
    copies = stored(delivery_copies(placed.withColumn("_offer", offer), "_offer"), "copies", partition="_offer")
    parts = [index.offer_copies(copies.filter(F.col("_offer") == i).select("key", "rank", "seq")) for i in range(offers)]
    return reduce(DataFrame.unionByName, parts).select(F.col("seq").alias("ingest_seq"))


def kept_deliveries(bundles: DataFrame, offers: int = 3) -> DataFrame:
    """The table with exactly one copy of each delivery."""
    return bundles.join(surplus_deliveries(bundles, offers), "ingest_seq", "left_anti")
