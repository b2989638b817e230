"""Problem 8: evaluation texts that leak into the corpus.

The items' own sentences (those that stand in one item only) form an inverted index with BM25 impacts, in blocks with
their maxima. Every document is cut into overlapping passages, and every passage is a query: block-max WAND skips what
can't reach the threshold. An item's impacts are divided by the least score that any `min_words` words of it can have
with their three best words lost, so the threshold is 1 for all items, and no passage is missed for the loss of any three
of twenty words, or of more that are not all the best ones.
Retrieved pairs are verified by a local word alignment: at least `min_words` words of the item in one passage, of which
at least `min_match` stand there unchanged, and with them at least `min_weight` of the passage's inverse document
frequency: sentences of one pattern about other things share the pattern's words, not those. All stretches of an alignment
are tested, and what it left is aligned again until the own words left are too few (`verified`).

Before it is aligned, a retrieved pair is tested with all words that the stretch of the document has of the item: no
alignment can match more. The index is broadcast in blocks of about `block_words` words of items; a larger benchmark takes
one pass over the corpus a block. Sentences that several items share, and the statistics behind impacts and thresholds, are
those of all items, counted in a distributed way, so the rows are the same for any size of the blocks.

Defined results: null and blank texts and items give nothing; items whose own sentences have fewer than `min_words` words
can't leak; a document that stands twice is reported for each `doc_id`; items with equal texts share all sentences, so
none of them can leak; extra columns are ignored.
"""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelode.session import spread, stored

K1, B = 1.2, 0.75
_TAG = re.compile(r"</?[A-Za-z][^<>\n]{0,60}>")
_ESCAPE = re.compile(r"\\(?:[nrt\"'/\\bf]|u([0-9a-fA-F]{4}))")
_INVISIBLE = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    """Words without case, punctuation, quoting, markup, escapes and invisible characters."""
    t = _INVISIBLE.sub("", unicodedata.normalize("NFKC", text))
    if "\\" in t:
        t = _ESCAPE.sub(lambda m: chr(int(m[1], 16)) if m[1] else " ", t)
    if "<" in t:
        t = _TAG.sub(" ", t)
    if "&" in t:
        t = html.unescape(t)
    return _WORD.findall(t.lower())


def sentences_of(text: str) -> list[str]:
    """Sentences as their words joined by blanks."""
    return [s for s in (" ".join(words_of(x)) for x in re.split(r"(?<=[.!?])\s+|\n\s*\n", text or "")) if s]


def own_sentences(items: DataFrame) -> DataFrame:
    """item_id, at, sentence, own: every sentence of every item in order, and whether no other item has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, k, s) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for k, s in enumerate(sentences_of(t))]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.string())], names=["item_id", "at", "sentence"])

    rows = items.select(F.col("item_id").cast("long"), "text").filter("item_id is not null and text is not null").mapInArrow(run, "item_id LONG, at INT, sentence STRING")
    shared = rows.groupBy("sentence").agg(F.count_distinct("item_id").alias("n")).filter("n > 1").select("sentence", F.lit(False).alias("own"))
    return rows.join(shared, "sentence", "left").select("item_id", "at", "sentence", F.coalesce("own", F.lit(True)).alias("own"))


class ItemIndex:
    """BM25 impacts of a block of items, scaled so that 1 is the threshold of each item.

    `words` are the items' own words in order; `df`, `n` and `mean` (documents with a word, number and mean length of all
    items) are those of the whole benchmark, so an item's impacts and threshold don't depend on its block.
    """

    def __init__(self, words: dict[int, list[str]], df: dict[str, int], n: int, mean: float, min_words: int = 20, lost: int = 3, blocks: int = 512):
        self.ids = sorted(i for i, w in words.items() if len(w) >= min_words)
        self.idf = {w: float(np.log(1 + (n - x + 0.5) / (x + 0.5))) for w, x in df.items()}
        #: The least weight of any `min_words` words of each item.
        self.least: list[float] = []
        lists: dict[str, list[tuple[int, float]]] = defaultdict(list)
        for k, i in enumerate(self.ids):
            seq = words[i]
            norm = K1 * (1 - B + B * len(seq) / max(1.0, mean))
            impact = {w: self.idf[w] * tf * (K1 + 1) / (tf + norm) for w, tf in Counter(seq).items()}
            windows = range(len(seq) - min_words + 1)
            self.least.append(min(sum(self.idf[w] for w in seq[a : a + min_words]) for a in windows))
            least = min(sum(sorted(impact[w] for w in set(seq[a : a + min_words]))[:-lost]) for a in windows)
            for w, x in impact.items():
                lists[w].append((k, x / max(least, 1e-6)))
        self.term = {w: t for t, w in enumerate(sorted(lists))}
        # Few items make small blocks with sharp maxima; the number of blocks bounds the memory of the maxima.
        self.block = max(1, -(-len(self.ids) // blocks))
        self.docs: list[list[int]] = [[k for k, _ in lists[w]] for w in self.term]
        self.impact: list[list[float]] = [[float(x) for _, x in lists[w]] for w in self.term]
        #: The highest impact of a term in each block of items, and in all.
        self.tops = np.zeros((len(self.term), max(1, -(-len(self.ids) // self.block))), dtype=np.float32)
        for t, (docs, impact) in enumerate(zip(self.docs, self.impact)):
            np.maximum.at(self.tops[t], np.array(docs) // self.block, np.array(impact, dtype=np.float32))
        self.top = self.tops.max(axis=1, initial=0).tolist()

    def retrieve(self, terms: list[int]) -> list[int]:
        """Block-max WAND: all items (positions) that score at least 1 for a passage's distinct terms.

        Blocks whose maxima sum to less than 1 are jumped over; within the others a pivot is the first item at which
        the terms' overall maxima reach 1, and only pivots that all earlier cursors have reached are scored.
        """
        bound = self.tops[terms].sum(axis=0)
        open_blocks = np.flatnonzero(bound >= 0.999).tolist()
        if not open_blocks:
            return []
        found: list[int] = []
        top, docs, impact = self.top, self.docs, self.impact
        cursors = []  # [next item, position in the list, term]
        for t in terms:
            cursors.append([docs[t][0], 0, t])

        def move(c: list, to: int) -> bool:
            own = docs[c[2]]
            at = bisect_left(own, to, c[1])
            if at >= len(own):
                return False
            c[0], c[1] = own[at], at
            return True

        for block in open_blocks:
            low, high = block * self.block, (block + 1) * self.block
            cursors = [c for c in cursors if c[0] >= low or move(c, low)]
            while True:
                cursors.sort()
                total, pivot = 0.0, -1
                for k, c in enumerate(cursors):
                    total += top[c[2]]
                    if total >= 0.999:
                        pivot = k
                        break
                if pivot < 0:
                    return found
                doc = cursors[pivot][0]
                if doc >= high:
                    break
                if cursors[0][0] < doc:
                    cursors = [c for c in cursors if c[0] >= doc or move(c, doc)]
                    continue
                here = [c for c in cursors if c[0] == doc]
                if sum(impact[c[2]][c[1]] for c in here) >= 1:
                    found.append(doc)
                cursors = [c for c in cursors if c[0] > doc or move(c, doc + 1)]
        return found


def aligned(doc: np.ndarray, item: np.ndarray, credit: np.ndarray) -> tuple[int, int, np.ndarray, np.ndarray]:
    """Best local alignment of two lists of word codes, where a match of an item's word scores its `credit` and all else -1:
    the item's part from and to, and the positions in the item and in the document of the words that match."""
    n, m = len(doc), len(item)
    score = np.zeros((n + 1, m + 1), dtype=np.float32)
    ramp = np.arange(m + 1, dtype=np.float32)
    for i in range(1, n + 1):
        t = np.zeros(m + 1, dtype=np.float32)
        t[1:] = np.maximum(np.maximum(score[i - 1, :-1] + np.where(item == doc[i - 1], credit, -1), score[i - 1, 1:] - 1), 0)
        score[i] = np.maximum.accumulate(t + ramp) - ramp
    i, j = np.unravel_index(int(np.argmax(score)), score.shape)
    stop, matches = int(j), []
    while i > 0 and j > 0 and score[i, j] > 0:
        s = score[i, j]
        if s == score[i - 1, j - 1] + (credit[j - 1] if item[j - 1] == doc[i - 1] else -1):
            if item[j - 1] == doc[i - 1]:
                matches.append((j - 1, i - 1))
            i, j = i - 1, j - 1
        elif s == score[i - 1, j] - 1:
            i -= 1
        else:
            j -= 1
    at = np.array(matches, dtype=np.int64).reshape(-1, 2)
    return int(j), stop, at[:, 0], at[:, 1]


def holds(hit: np.ndarray, weight: np.ndarray, min_words: int, min_match: float, min_weight: float) -> bool:
    """Whether any stretch of at least `min_words` words has enough of them unchanged, by number and by weight."""
    if len(hit) < min_words or hit.sum() < min_match * min_words:
        return False
    number = np.concatenate(([0.0], np.cumsum(hit - min_match)))
    heavy = np.concatenate(([0.0], np.cumsum(weight * (hit - min_weight))))
    if number[-1] >= -1e-9 and heavy[-1] >= -1e-9:
        return True
    for a in range(0, len(hit) + 1 - min_words, 256):  # starts by blocks: the ends of each lie min_words behind it or more
        low, high = slice(a, min(a + 256, len(hit) + 1 - min_words)), slice(a + min_words, None)
        if np.triu((number[None, high] - number[low, None] >= -1e-9) & (heavy[None, high] - heavy[low, None] >= -1e-9)).any():
            return True
    return False


def verified(part: np.ndarray, item: np.ndarray, own: np.ndarray, weight: np.ndarray, least: float, min_words: int, min_match: float, min_weight: float) -> bool:
    """Whether a part of a document holds a passage of an item's own words.

    Every alignment is tested with all its stretches. One that fails has the document's words that it matched masked, and
    the rest is aligned again, as long as the own words left could be enough. Words that other items share score first as
    the own ones, so that they join what stands around them, and then nothing, so that they can't outdo own words.
    """
    mine = item[own]
    have = np.bincount(mine, minlength=int(item.max()) + 1)
    price = np.zeros(len(have))
    price[mine] = weight[own]
    for credit in [np.ones(len(item), dtype=np.float32)] + ([] if own.all() else [own.astype(np.float32)]):
        doc = part.copy()
        while True:
            shared = np.minimum(np.bincount(doc[doc >= 0], minlength=len(have)), have)
            if shared.sum() < min_match * min_words or (shared * price).sum() < min_weight * least - 1e-9:
                break
            start, stop, in_item, in_doc = aligned(doc, item, credit)
            if not len(in_doc):
                break
            hit = np.zeros(len(item))
            hit[in_item] = 1
            flags = own[start:stop]
            if holds(hit[start:stop][flags], weight[start:stop][flags], min_words, min_match, min_weight):
                return True
            doc[in_doc] = -1
    return False


class Block:
    """What a task needs of a block of items: their index, and their words with those that are shared, as numbers."""

    def __init__(self, full: dict[int, tuple[list[str], list[bool]]], df: dict[str, int], n: int, mean: float, min_words: int):
        self.index = ItemIndex({i: [w for w, o in zip(*x) if o] for i, x in full.items()}, df, n, mean, min_words)
        self.vocabulary = {w: k for k, w in enumerate(dict.fromkeys(w for i in self.index.ids for w in full[i][0]))}
        self.term = np.array([self.index.term.get(w, -1) for w in self.vocabulary] + [-1], dtype=np.int64)
        idf = np.array([self.index.idf.get(w, 0.0) for w in self.vocabulary])
        self.items = []
        for i in self.index.ids:
            codes, own = np.array([self.vocabulary[w] for w in full[i][0]]), np.array(full[i][1])
            self.items.append((codes, own, idf[codes]))


def _leaks_of(words: list[str], block: Block, seen: np.ndarray, min_words: int, min_match: float, min_weight: float, width: int) -> list[int]:
    """The items of a block that a document holds. `seen` is all false, of the vocabulary's size and one more."""
    step, index = width // 2, block.index
    code = np.array([block.vocabulary.get(w, -1) for w in words], dtype=np.int64)
    term = block.term[code]
    near: dict[int, list[int]] = defaultdict(list)
    for a in range(0, max(1, len(words) - step), step):
        terms = np.unique(term[a : a + width])
        terms = terms[terms >= 0]
        if len(terms):
            for k in index.retrieve(terms.tolist()):
                near[k].append(a)
    out = []
    for k, starts in near.items():
        item, own, weight = block.items[k]
        stretch: list[list[int]] = []
        for a in starts:  # passages that touch are one stretch
            if stretch and a <= stretch[-1][1]:
                stretch[-1][1] = a + width
            else:
                stretch.append([a, a + width])
        for a, b in stretch:
            part = code[max(0, a - step) : b + step]
            # No alignment matches more than all words that the part has at all: what fails with these needs none.
            seen[part] = True
            seen[-1] = False
            there = (seen[item] & own).astype(np.float64)
            seen[part] = False
            if there.sum() < min_match * min_words or there @ weight < min_weight * index.least[k] - 1e-9 or not holds(there[own], weight[own], min_words, min_match, min_weight):
                continue
            ids, local = np.unique(item, return_inverse=True)
            at = np.minimum(np.searchsorted(ids, part), len(ids) - 1)
            if verified(np.where(ids[at] == part, at, -1), local, own, weight, index.least[k], min_words, min_match, min_weight):
                out.append(index.ids[k])
                break
    return out


def leaked_items(docs: DataFrame, items: DataFrame, min_words: int = 20, min_match: float = 0.75, min_weight: float = 0.65, width: int = 48, block_words: int = 400_000) -> DataFrame:
    """doc_id, item_id of every document that contains at least `min_words` words of an item's own text in a passage.

    `block_words` bounds the words of the items that are broadcast at once (about); the rows don't depend on it.
    """
    spark = docs.sparkSession
    sents = stored(own_sentences(items), "sentences")
    # Statistics of the whole benchmark: items that can leak, their own words' number and mean length, and documents by word.
    lengths = sents.filter("own").groupBy("item_id").agg(F.sum(F.size(F.split("sentence", " "))).alias("n")).filter(F.col("n") >= min_words)
    n, total = lengths.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not n:
        return docs.select(F.col("doc_id").cast("long"), F.lit(0).cast("long").alias("item_id")).limit(0)
    every = sents.agg(F.sum(F.size(F.split("sentence", " ")))).first()[0]
    blocks = -(-every // block_words)
    placed = sents.join(lengths.select("item_id"), "item_id", "left_semi").withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)))
    words = placed.filter("own").select("item_id", "block", F.explode(F.array_distinct(F.split("sentence", " "))).alias("w")).distinct()
    if blocks > 1:
        placed = stored(placed, "placed", partition="block")
        words = stored(words, "item-words")
    df = words.groupBy("w").agg(F.count("*").alias("df"))
    texts = spread(docs.select(F.col("doc_id").cast("long"), "text").filter("text is not null and text <> ''"))
    passes: list[DataFrame] = []
    for b in range(blocks):
        full: dict[int, tuple[list[str], list[bool]]] = {}
        for r in sorted(placed.filter(F.col("block") == b).select("item_id", "at", "sentence", "own").collect(), key=lambda r: (r["item_id"], r["at"])):
            w = r["sentence"].split(" ")
            have = full.setdefault(r["item_id"], ([], []))
            have[0].extend(w)
            have[1].extend([r["own"]] * len(w))
        if not full:
            continue
        of_block = df if blocks == 1 else df.join(words.filter(F.col("block") == b).select("w").distinct(), "w", "left_semi")
        sent = spark.sparkContext.broadcast(Block(full, {r["w"]: r["df"] for r in of_block.collect()}, n, total / n, min_words))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            block = sent.value
            seen = np.zeros(len(block.vocabulary) + 1, dtype=bool)
            for batch in batches:
                pairs = [(d, i) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for i in _leaks_of(words_of(t), block, seen, min_words, min_match, min_weight, width)]
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["doc_id", "item_id"])

        passes.append(texts.mapInArrow(run, "doc_id LONG, item_id LONG"))
    return reduce(DataFrame.unionByName, passes)


def leak_report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Per item: the documents and sources it leaked into: item_id, documents, sources."""
    found = leaked_items(docs, items)
    return found.join(docs.select(F.col("doc_id").cast("long"), "source"), "doc_id").groupBy("item_id").agg(F.count_distinct("doc_id").alias("documents"), F.count_distinct("source").alias("sources"))
