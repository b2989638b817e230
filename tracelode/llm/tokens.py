"""Problem 7: encode a corpus with a public byte-level BPE vocabulary, in two tiers.

A text is cut into pre-tokens by the vocabulary's public pattern. Tier one: a minimal perfect hash over all vocabulary
entries (hash and displace: a bucket's displacement sends its entries to free slots of a table of exactly as many slots
as entries) resolves a pre-token that is an entry as a whole, for a batch of distinct pre-tokens at once with numpy; the
entry's bytes are compared, so nothing outside the vocabulary is taken for a member. Tier two: a miss is merged from its
bytes with a linked list of parts and a heap of candidate pairs, lowest rank first, ties from the left. Long pre-tokens
cost n log n.

The vocabulary file is read on the driver and broadcast; its size is bounded by `MAX_ENTRIES`. Each worker remembers the
last distinct pre-tokens up to a bounded number.

Defined results: null and empty texts give the empty list; the strings of special tokens are ordinary text; unpaired
surrogates can't occur in Spark strings; a duplicate document is encoded like any other row; extra columns stay.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelode.session import spread

#: The public pre-token pattern of the byte_bpe_50k vocabulary (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
MAX_ENTRIES = 1 << 20

_M = np.uint64(0x9E3779B97F4A7C15)


def read_vocabulary(path: str = VOCABULARY) -> dict[bytes, int]:
    """Byte strings and their ids (= merge ranks) of a .tiktoken file."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    if len(ranks) > MAX_ENTRIES:
        raise ValueError(f"{len(ranks)} entries are more than may be broadcast")
    return ranks


def _pack(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all words, start of each, length of each)."""
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    return np.frombuffer(b"".join(words), dtype=np.uint8), np.cumsum(lengths) - lengths, lengths


def _mix(h: np.ndarray, seed: np.ndarray | int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = h + np.asarray(seed, dtype=np.uint64) * _M
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _hash(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, byte position by byte position over all words that are long enough."""
    h = _mix(length.astype(np.uint64), 1)
    live = np.flatnonzero(length > 0)
    with np.errstate(over="ignore"):
        for at in range(int(length.max(initial=0))):
            live = live[length[live] > at]
            h[live] = (h[live] ^ data[start[live] + at].astype(np.uint64)) * np.uint64(0x100000001B3) + np.uint64(at)
    return _mix(h, 2)


class PerfectHash:
    """A minimal perfect hash from the vocabulary's byte strings to slots, with the ids and bytes in slot order."""

    def __init__(self, ranks: dict[bytes, int], per_bucket: int = 4):
        words = list(ranks)
        n = self.n = len(words)
        self.longest = max(map(len, words), default=0)
        data, start, length = _pack(words)
        h = _hash(data, start, length)
        if len(np.unique(h)) < n:
            raise ValueError("two entries have the same 64-bit hash")
        self.buckets = max(1, n // per_bucket)
        bucket = (_mix(h, 3) % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket, minlength=self.buckets)
        ends = np.cumsum(sizes)
        self.shift = np.zeros(self.buckets, dtype=np.uint32)
        taken, slot = np.zeros(n, dtype=bool), np.empty(n, dtype=np.int64)
        for b in np.argsort(-sizes, kind="stable"):  # the fullest buckets first
            own = order[ends[b] - sizes[b] : ends[b]]
            if not len(own):
                break
            d = 0
            while True:  # a block of displacements at once
                tries = np.arange(d, d + 64, dtype=np.uint64)
                at = (_mix(h[own][None, :], tries[:, None] + np.uint64(16)) % np.uint64(n)).astype(np.int64)
                free = ~taken[at].any(axis=1)
                if len(own) > 1:
                    s = np.sort(at, axis=1)
                    free &= (s[:, 1:] != s[:, :-1]).all(axis=1)
                if free.any():
                    k = int(np.argmax(free))
                    self.shift[b], slot[own] = d + k, at[k]
                    taken[at[k]] = True
                    break
                d += 64
        back = np.argsort(slot)
        self.data, self.start, self.length = _pack([words[i] for i in back])
        self.ids = np.array([ranks[words[i]] for i in back], dtype=np.int32)

    def lookup(self, words: list[bytes]) -> np.ndarray:
        """The id of each word, -1 for those that are no entries."""
        out = np.full(len(words), -1, dtype=np.int64)
        fit = [i for i, w in enumerate(words) if 0 < len(w) <= self.longest]
        if not fit:
            return out
        own = [words[i] for i in fit]
        data, start, length = _pack(own)
        h = _hash(data, start, length)
        d = self.shift[(_mix(h, 3) % np.uint64(self.buckets)).astype(np.int64)].astype(np.uint64)
        slot = (_mix(h, d + np.uint64(16)) % np.uint64(self.n)).astype(np.int64)
        same = self.length[slot] == length
        for at in range(self.longest):  # compare the bytes
            live = np.flatnonzero(same & (length > at))
            if not len(live):
                break
            same[live] = self.data[self.start[slot[live]] + at] == data[start[live] + at]
        out[np.array(fit)[same]] = self.ids[slot[same]]
        return out


def merge_bytes(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """BPE of one pre-token: a linked list of parts, and a heap of neighbouring pairs that are entries."""
    n = len(word)
    end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    alive = [True] * n
    heap: list[tuple[int, int, int]] = []  # rank, start of the left part, end of the right part

    def offer(left: int) -> None:
        right = after[left]
        if right < n:
            rank = ranks.get(word[left : end[right]])
            if rank is not None:
                heapq.heappush(heap, (rank, left, end[right]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, left, stop = heapq.heappop(heap)
        if not alive[left]:
            continue
        right = after[left]
        if right >= n or end[right] != stop:  # a part has grown since: the pair is gone
            continue
        end[left], after[left], alive[right] = stop, after[right], False
        if after[left] < n:
            before[after[left]] = left
        offer(left)
        if before[left] >= 0:
            offer(before[left])
    ids, at = [], 0
    while at < n:
        ids.append(ranks[word[at : end[at]]])
        at = after[at]
    return ids


class Encoder:
    """Both tiers over batches of texts."""

    def __init__(self, ranks: dict[bytes, int], table: PerfectHash | None = None, remember: int = 200_000, pattern: str = PATTERN):
        import regex

        self.ranks, self.table, self.remember, self.known = ranks, table or PerfectHash(ranks), remember, {}
        self.cut = regex.compile(pattern).findall

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        cuts = [self.cut(t) if t else [] for t in texts]
        if len(self.known) > self.remember:
            self.known.clear()
        known = self.known
        new = list({w for c in cuts for w in c if w not in known})
        raw = [w.encode("utf-8", "surrogatepass") for w in new]
        for w, b, i in zip(new, raw, self.table.lookup(raw).tolist()):
            known[w] = (i,) if i >= 0 else tuple(merge_bytes(b, self.ranks))
        out = []
        for c in cuts:
            ids: list[int] = []
            for w in c:
                ids += known[w]
            out.append(ids)
        return out


def encode_column(docs: DataFrame, text: str = "text", out: str = "ids", vocabulary: str = VOCABULARY, batch: int = 256) -> DataFrame:
    """`docs` with the token ids of `text` in `out`; its other columns stay. One pass, no shuffle."""
    ranks = read_vocabulary(vocabulary)
    sent = docs.sparkSession.sparkContext.broadcast((ranks, PerfectHash(ranks)))
    others = [c for c in docs.columns if c != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(*sent.value)
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                ids = encoder.encode(part.column(part.schema.get_field_index(text)).to_pylist())
                flat = np.fromiter((i for x in ids for i in x), dtype=np.int32)
                offsets = np.zeros(len(ids) + 1, dtype=np.int32)
                np.cumsum([len(x) for x in ids], out=offsets[1:])
                keep = [part.column(part.schema.get_field_index(c)) for c in others]
                yield pa.RecordBatch.from_arrays([*keep, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=[*others, out])

    schema = docs.select(*[F.col(f"`{c}`") for c in others]).schema.add(out, T.ArrayType(T.IntegerType()))
    return spread(docs.select(*[F.col(f"`{c}`") for c in others])).mapInArrow(run, schema)


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """How often each id occurs in the corpus, and in how many documents: id, occurrences, documents."""
    ids = encode_column(docs.select("doc_id", "text"), vocabulary=vocabulary)
    per = ids.select("doc_id", F.explode("ids").alias("id")).groupBy("doc_id", "id").agg(F.count("*").alias("n"))
    return per.groupBy("id").agg(F.sum("n").alias("occurrences"), F.count("*").alias("documents"))
