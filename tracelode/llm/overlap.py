"""Problem 2: the same or nearly the same records in different splits.

A signature becomes a list of words without case, quotes and punctuation, with numbers and hex ids masked. Its similarity
hash is a bit fingerprint of 320 bits: every word flips the one bit its hash names. A changed word flips two bits, a
missing or added one flips one, so signatures at most two words apart are within Hamming radius 4, and of five blocks of
64 bits at least one is the same in both. Signatures of different splits are joined on equal blocks and kept within the
radius; the words are then compared by edit distance. Nothing within the radius can be missed.

A block without a word is no evidence and is not joined. A pair that agrees in no other block has all its words in the
four blocks that changed, so both signatures have an empty block; such signatures get the blocks of a second and a third
permutation, and those that have an empty block in all three (short ones, mostly) are joined on their deletion
neighbourhoods, which two signatures at most two words apart always share: what is left of them without none, one or two
of their words. So candidates grow with what is alike, not with the square of what is short.

Blocks that hold only words of a common template are hot. They are not dropped: where a block's number of pairs is over
a limit, the remaining words are cut again in the same way and joined on all codes so far (again one of five must agree,
as the flips lie outside the first block), up to `levels` times. Keys that are hot after that are joined in a grid of
salted cells, each of a bounded number of pairs.

Exact copies of a signature are one class; classes are compared, and episodes come back at the end.

Defined results: null, blank and `recovery` signatures match nothing; repeated rows of an episode count once; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelode.functions import payload as P
from tracelode.session import stored

BLOCKS, BITS, RADIUS = 5, 64, 4


def signature_words(raw: Column) -> Column:
    """The words that count. A word of nothing but punctuation is none."""
    t = F.regexp_replace(F.lower(raw), r"<hex>|0x[0-9a-f]+\b|[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}|[0-9a-f]{8,}", "")
    t = F.regexp_replace(t, r"<num>|(?<![\p{L}\p{N}_])\d+(?![\p{L}\p{N}_])", "")
    t = F.regexp_replace(F.regexp_replace(t, P.SPACE, " "), "[^\\p{L}\\p{M}\\p{N} ]+", "")
    return F.filter(F.split(t, " "), lambda w: w != "")


def word_blocks(words: str, seed: int) -> Column:
    """Of a column of words: BLOCKS structs of a block's number, its number of words, its code of 64 bits, and a hash of its
    words in any order. The code alone tells few short blocks apart; a block without a change has the same words."""
    h = f"xxhash64(w, {seed})"
    step = f"named_struct('b', b, 'n', acc.n + 1, 'code', acc.code ^ shiftleft(1L, CAST(pmod(shiftright({h}, 8), {BITS}) AS INT)), 'sum', acc.sum ^ {h})"
    return F.expr(f"transform(sequence(0, {BLOCKS - 1}), b -> aggregate(filter({words}, w -> pmod({h}, {BLOCKS}) = b), named_struct('b', b, 'n', 0, 'code', 0L, 'sum', 0L), (acc, w) -> {step}))")


def deletions(words: str) -> Column:
    """Hashes of what is left of a column of words without none, one or two of them, in order."""
    upto = lambda low, high: f"if({low} <= {high}, sequence({low}, {high}), CAST(array() AS ARRAY<INT>))"
    n = f"size({words})"
    one = f"transform({upto('1', n)}, i -> concat(slice({words}, 1, i - 1), slice({words}, i + 1, {n})))"
    two = f"flatten(transform({upto('1', n + ' - 1')}, i -> transform({upto('i + 1', n)}, j -> concat(slice({words}, 1, i - 1), slice({words}, i + 1, j - i - 1), slice({words}, j + 1, {n})))))"
    return F.expr(f"array_distinct(transform(concat(array({words}), {one}, {two}), x -> xxhash64(array_join(x, ' '), size(x))))")


def signed(episodes: DataFrame) -> DataFrame:
    """episode_no, split, source, key (the words that count, in order; null where there is nothing to match), one row per episode."""
    raw = F.col("familySignature")
    words = F.when(~F.lower(P.squeeze(raw)).isin("recovery", ""), F.array_join(signature_words(raw), " "))
    one = F.min(F.struct("split", "source", words.alias("key"))).alias("e")
    return episodes.groupBy("episode_no").agg(one).select("episode_no", "e.split", "e.source", F.when(~F.col("e.key").isin("", "recovery"), F.col("e.key")).alias("key"))


def classes(records: DataFrame, train: str = "train") -> DataFrame:
    """One row per distinct word list of `signed` records: key, cls (least episode), words, code, n_train, n_held."""
    held = F.coalesce(F.col("split") != train, F.lit(True)).cast("int")
    found = records.filter("key is not null").groupBy("key").agg(F.min("episode_no").alias("cls"), F.sum(1 - held).alias("n_train"), F.sum(held).alias("n_held"))
    return found.withColumn("words", F.split("key", " ")).withColumn("code", F.transform(word_blocks("words", 0), lambda x: x["code"]))


def word_distance(a: str, b: str) -> Column:
    """Edit distance of two columns of words, -1 for anything over 2: every distinct word of both stands for one character."""
    # Code points from 0x10000 on: no surrogates, and a million different words.
    text = lambda own: f"decode(unhex(array_join(transform({own}, w -> lpad(hex(array_position(array_distinct(concat({a}, {b})), w) + 65535), 8, '0')), '')), 'UTF-32')"
    return F.expr(f"levenshtein({text(a)}, {text(b)}, 2)")


def _distance(a: Column, b: Column) -> Column:
    return reduce(lambda x, y: x + y, [F.bit_count(a[i].bitwiseXOR(b[i])) for i in range(BLOCKS)])


def _keyed(rows: DataFrame, level: int, seeds: int = 3) -> DataFrame:
    """cls, code, t, h, path, key, last: the keys of rows (cls, code, t, h, key, path, left: the words that are left)."""
    needed, parts = "true", []
    for s in range(seeds):
        name, seed = f"k{s}", level * seeds + s
        rows = rows.withColumn(name, F.when(F.expr(needed), word_blocks("left", seed)))
        parts.append(f"coalesce(transform(filter({name}, x -> x.n > 0), x -> named_struct('seed', {seed}, 'b', x.b, 'k', xxhash64({seed}, x.b, x.n, x.code, x.sum))), CAST(array() AS ARRAY<STRUCT<seed: INT, b: INT, k: BIGINT>>))")
        needed = f"{needed} and exists({name}, x -> x.n = 0)"
    rows = rows.withColumn("gaps", F.when(F.expr(needed), deletions("left")).otherwise(F.array().cast("array<bigint>")))
    parts.append("transform(gaps, x -> named_struct('seed', CAST(null AS INT), 'b', CAST(null AS INT), 'k', xxhash64(-1, x)))")
    out = rows.select("cls", "code", "t", "h", "path", "key", F.explode(F.expr(f"concat({', '.join(parts)})")).alias("x"))
    step = F.array(F.struct(F.col("x.seed").alias("seed"), F.col("x.b").alias("b")))
    # A key is a hash of the blocks and codes so far; a collision would only add a candidate. Words stay behind.
    return out.select("cls", "code", "t", "h", F.concat("path", step).alias("path"), F.xxhash64("key", "x.k").alias("key"), F.col("x.b").isNull().alias("last"))


def candidates(sigs: DataFrame, hot_pairs: int = 4096, levels: int = 3) -> DataFrame:
    """a, b: pairs of different classes that share a key and are within the radius, a with train episodes, b with held-out ones."""
    found: list[DataFrame] = []
    path = "array<struct<seed: int, b: int>>"
    rows = sigs.select("cls", "code", F.col("words").alias("left"), (F.col("n_train") > 0).alias("t"), (F.col("n_held") > 0).alias("h"), F.lit(0).cast("bigint").alias("key"), F.array().cast(path).alias("path"))
    for level in range(levels):
        keyed = stored(_keyed(rows, level), f"blocks-{level}")
        pairs = F.col("nt").cast("double") * F.col("nh")
        split = (pairs > hot_pairs) & ~F.col("last") & F.lit(level < levels - 1)
        sizes = (
            keyed.groupBy("key")
            .agg(F.sum(F.col("t").cast("long")).alias("nt"), F.sum(F.col("h").cast("long")).alias("nh"), F.sum((F.col("t") & F.col("h")).cast("long")).alias("nb"), F.max("last").alias("last"))
            .filter("nt > 0 and nh > 0 and not (nt = 1 and nh = 1 and nb = 1)")
            .select("key", split.alias("hot"), F.ceil(F.sqrt(pairs / max(hot_pairs, 1))).cast("int").alias("r"))
        )
        sized = stored(keyed.join(sizes, "key"), f"sized-{level}")
        # A hot key is a grid of r times r cells: each pair meets in the cell of its two salts.
        salt, all_salts = F.pmod(F.xxhash64("cls", F.lit(level)), F.col("r")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("r") - 1))
        cold = sized.filter("not hot")
        left = cold.filter("t").select("key", F.col("cls").alias("a"), F.col("code").alias("ca"), salt.alias("u"), all_salts.alias("v"))
        right = cold.filter("h").select("key", F.col("cls").alias("b"), F.col("code").alias("cb"), salt.alias("v"), all_salts.alias("u"))
        found.append(left.join(right, ["key", "u", "v"]).filter((F.col("a") != F.col("b")) & (_distance(F.col("ca"), F.col("cb")) <= RADIUS)).select("a", "b"))
        hot = sized.filter("hot").select("cls", "code", "t", "h", "path", "key")
        if level == levels - 1 or hot.isEmpty():
            break
        left = F.expr(f"filter(words, w -> not exists(path, p -> pmod(xxhash64(w, p.seed), {BLOCKS}) = p.b))")
        rows = hot.join(sigs.select("cls", "words"), "cls").withColumn("left", left).drop("words")
    return reduce(DataFrame.unionByName, found)


def near_classes(sigs: DataFrame, hot_pairs: int = 4096, levels: int = 3) -> DataFrame:
    """Pairs of different classes at most two words apart, one with train episodes, the other with held-out ones."""
    pairs = stored(candidates(sigs, hot_pairs, levels).distinct(), "near")
    words = sigs.select("cls", "words")
    return (
        pairs.join(words.select(F.col("cls").alias("a"), F.col("words").alias("wa")), "a")
        .join(words.select(F.col("cls").alias("b"), F.col("words").alias("wb")), "b")
        .filter(word_distance("wa", "wb") >= 0)
        .select("a", "b")
    )


def cross_split_pairs(episodes: DataFrame, train: str = "train") -> DataFrame:
    """low_episode_no, high_episode_no: a train episode and a held-out one with the same or nearly the same signature."""
    records = stored(signed(episodes), "records")
    sigs = stored(classes(records, train), "signatures")
    near = near_classes(sigs).unionByName(sigs.filter("n_train > 0 and n_held > 0").select(F.col("cls").alias("a"), F.col("cls").alias("b")))
    members = records.filter("key is not null").join(sigs.select("key", "cls"), "key").select("cls", "episode_no", F.coalesce(F.col("split") == train, F.lit(False)).alias("t"))
    a = members.filter("t").select(F.col("cls").alias("a"), F.col("episode_no").alias("x"))
    b = members.filter("not t").select(F.col("cls").alias("b"), F.col("episode_no").alias("y"))
    return near.join(a, "a").join(b, "b").select(F.least("x", "y").alias("low_episode_no"), F.greatest("x", "y").alias("high_episode_no"))


def overlap_report(episodes: DataFrame, train: str = "train") -> DataFrame:
    """Per held-out split and source: episodes, those whose signature is in train exactly, and those only nearly.

    Classes are counted, pairs are not expanded.
    """
    records = stored(signed(episodes), "records")
    sigs = stored(classes(records, train), "signatures")
    near = near_classes(sigs).select(F.col("b").alias("cls")).distinct().withColumn("near", F.lit(True))
    flags = sigs.select("key", "cls", (F.col("n_train") > 0).alias("exact")).join(near, "cls", "left").drop("cls")
    held = records.filter(F.coalesce(F.col("split") != train, F.lit(True))).join(flags, "key", "left")
    exact, almost = F.coalesce("exact", F.lit(False)), F.coalesce("near", F.lit(False))
    return held.groupBy("split", "source").agg(F.count("*").alias("episodes"), F.count_if(exact).alias("exact_in_train"), F.count_if(~exact & almost).alias("near_in_train"))
