"""Work on ordered groups of any size: sorted pieces over range partitions, then a stitch of their edges.

A window over a group puts the whole group into one task. Here rows are range-partitioned by (group, order), so that
one group may lie in many partitions; each partition yields pieces, and only what touches a partition's edge has to be
joined up afterwards (at most two rows a partition and group).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelode.session import stored


def first_arrival(df: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """One row per `key`: that of the lowest `order`. Rows with a null key are all kept.

    Partial aggregation comes before the shuffle, so a key that holds a third of the rows costs one row a task.
    """
    part = F.coalesce(F.col(key), F.concat(F.lit("\u0000row-"), F.col(order).cast("string")))
    others = [c for c in columns if c != order]
    best = F.min(F.struct(F.col(order), *[F.col(c) for c in others])).alias("_b")
    return df.groupBy(part.alias("_k")).agg(best).select(*[F.col(f"_b.{c}").alias(c) for c in columns])


def sorted_pieces(
    df: DataFrame,
    group: str,
    order: list[str],
    piece: Callable[[pa.Table, int], pa.Table],
    schema: str,
) -> DataFrame:
    """Range-partition by (group, order), sort, and give each whole partition to `piece` in bounded chunks.

    `piece(table, partition)` gets the partition's rows in order, cut into Arrow tables at group borders where it can
    be and at `CHUNK` rows where a group is longer; it must treat the start and end of a table as edges. The second
    argument numbers the tables in order over the whole input.
    """
    chunk = 1 << 18

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        n = k = 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            n += b.num_rows
            if n >= chunk:
                yield from piece(pa.Table.from_batches(held), base + k).to_batches()
                held, n, k = [], 0, k + 1
        if held:
            yield from piece(pa.Table.from_batches(held), base + k).to_batches()

    keys: list[Column] = [F.col(group), *[F.col(c) for c in order]]
    return df.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def running(df: DataFrame, group: str, order: list[str], **flags: Column) -> DataFrame:
    """`df` with a column per flag: how many rows before it in its group, by `order`, have the flag (a condition or a count).

    A window would bring a whole group into one task. Rows are range-partitioned by (group, order) instead and counted along
    each partition; what earlier partitions hold of a group is added from the partitions' totals, of which there are no more
    than partitions (groups that lie in one partition need none), so that side is broadcast. Groups must not be null.
    """
    names = list(flags)
    marked = df.withColumns({n: F.coalesce(c.cast("long"), F.lit(0)) for n, c in flags.items()})
    kinds, where = marked.schema, [marked.columns.index(n) for n in names]
    at = marked.columns.index(group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, last, carry = TaskContext.get().partitionId(), None, np.zeros(len(names), dtype=np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            keys = b.column(at)
            code = keys.dictionary_encode().indices.to_numpy()
            new = np.append(keys[0].as_py() != last, code[1:] != code[:-1])
            start = np.maximum.accumulate(np.where(new, np.arange(len(code)), 0))
            first = start == 0 if not new[0] else np.zeros(len(code), dtype=bool)
            columns, ends = list(b.columns), []
            for k, c in enumerate(where):
                own = b.column(c).to_numpy()
                total = np.cumsum(own) - own
                counted = total - total[start] + np.where(first, carry[k], 0)
                ends.append(counted[-1] + own[-1])
                columns[c] = pa.array(counted)
            last, carry = keys[-1].as_py(), np.array(ends, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([*columns, *[b.column(c) for c in where], pa.array(np.full(b.num_rows, piece, dtype=np.int32))], names=[*b.schema.names, *[f"_own_{n}" for n in names], "_piece"])

    schema = T.StructType([*kinds.fields, *[T.StructField(f"_own_{n}", T.LongType()) for n in names], T.StructField("_piece", T.IntegerType())])
    keys = [F.col(group), *[F.col(c) for c in order]]
    rows = stored(marked.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema), "running")
    totals = rows.groupBy(group, "_piece").agg(*[F.sum(f"_own_{n}").alias(f"_sum_{n}") for n in names])
    w = Window.partitionBy(group).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(group, "_piece", F.min("_piece").over(Window.partitionBy(group)).alias("_first"), *[F.sum(f"_sum_{n}").over(w).alias(f"_base_{n}") for n in names]).filter("_piece > _first").drop("_first")
    joined = rows.join(F.broadcast(base), [group, "_piece"], "left")
    return joined.withColumns({n: F.col(n) + F.coalesce(F.col(f"_base_{n}"), F.lit(0)) for n in names}).select(*marked.columns)


def predecessors(df: DataFrame, group: str, order: list[str], columns: list[str], prefix: str) -> DataFrame:
    """Every row that has one before it in its group, with that row's `columns` as `prefix`..., without a window over groups."""
    numbered = running(df, group, order, _n=F.lit(1))
    before = numbered.select(group, (F.col("_n") + 1).alias("_n"), *[F.col(c).alias(f"{prefix}{c}") for c in columns])
    return numbered.join(before, [group, "_n"]).drop("_n")
