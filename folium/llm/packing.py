"""Filling containers of fixed capacity with texts (problem 7): lexical retrieval packing.

Documents stream through shards of bounded size. A shard holds a BM25 inverted index of its documents; the longest
unused text seeds a window, all its terms are scored, and every unused text of the shard that shares one fills the
window greedily, best first; only when none that scores fits does the room left go to the largest unused texts that fit.
Terms of half the shard or more have no positive BM25 weight and tell nothing. A text larger than
the capacity, and only such a text, is cut into full windows and a rest, which is packed like any other. Sizes are
tokens of a public tokenizer, counted per pre-token with a cache, which gives the tokenizer's own counts, since byte
pair merges never cross a pre-token. Nothing is shuffled; each shard leaves one partly filled container at most for
each capacity besides those that no remaining text fits.

Cases: NULL and empty texts have no tokens and are left out; ids that repeat are packed once, by their least text;
capacities of 0 or less and more than 1,000 are refused,
NULL ones skipped;
ties go to the smaller place in the shard; other columns are ignored; empty tables give no rows; a very long text
fills containers of its own, its rest shares one.
"""

from __future__ import annotations

import base64
import os
import re
from bisect import bisect_right, insort
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folium.llm.common import tokenizer_dir
from folium.plans.ship import ensure_shipped

SCHEMA = "container_id int, capacity_tokens int, bin_id string, doc_id bigint, piece_no int, start_token bigint, end_token bigint"
SHARD_DOCS, SHARD_TOKENS = 2048, 4_000_000
COMMON, TERM_BLOCK = 16, 1024
MAX_CAPACITIES = 1000
K1, B = 1.2, 0.75
#: Bits of a pre-token's number of tokens: a value of at most 2 GB, Spark's own bound, has fewer than 2^31 of them.
SIZE_BITS = 31
#: Fixed value: the pattern that splits a text before the merges of the public rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The vocabulary's pre-token pattern, for texts of plain letters only, where re gives what the full pattern does.
FAST = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
UNUSUAL = re.compile("[^\\t\\n\\r -~\xa0§«°»À-ÖØ-öø-ÿЀ-ӿ‐-—‘-„…№]")


class Counter(dict):
    """hash << SIZE_BITS | number of tokens of a pre-token."""

    def __init__(self, vocabulary: str) -> None:
        import regex
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.full = regex.compile(PATTERN)

    def __missing__(self, token: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        value = crc32(token.strip().lower().encode()) << SIZE_BITS | len(self.encoding.encode_ordinary(token))
        self[token] = value
        return value

    def measured(self, text: str) -> np.ndarray:
        found = (self.full if UNUSUAL.search(text) else FAST).findall(text)
        return np.fromiter(map(self.__getitem__, found), np.int64, len(found))


class Shard:
    """BM25 inverted index over the documents of one shard."""

    def __init__(self, terms: list[np.ndarray]) -> None:
        n = self.n = len(terms)
        doc = np.repeat(np.arange(n), [len(t) for t in terms])
        key, tf = np.unique(doc << 32 | np.concatenate(terms), return_counts=True)
        doc, term = key >> 32, key & 0xFFFFFFFF
        length = np.array([len(t) for t in terms])
        _, place, df = np.unique(term, return_inverse=True, return_counts=True)
        idf = np.log((n - df + 0.5) / (df + 0.5))
        live = (df[place] > 1) & (idf[place] > 0)  # terms of no other document, or of most, tell nothing
        doc, place, tf = doc[live], place[live], tf[live]
        norm = K1 * (1 - B + B * length[doc] / max(1.0, length.mean()))
        self.weight = idf[place] * tf * (K1 + 1) / (tf + norm)
        self.query = np.searchsorted(doc, np.arange(n + 1))
        self.place = place
        order = np.argsort(place, kind="stable")
        self.posted, self.scores = doc[order], self.weight[order]
        self.lists = np.searchsorted(place[order], np.arange(len(df) + 1))
        self.shared: np.ndarray | None = None

    def common(self) -> np.ndarray:
        """Scores of every pair by the terms of more than n / COMMON documents, in blocks of TERM_BLOCK terms."""
        total = np.zeros((self.n, self.n))
        df = np.diff(self.lists)
        terms = np.flatnonzero(df * COMMON > self.n)
        for k in range(0, len(terms), TERM_BLOCK):
            block = terms[k : k + TERM_BLOCK]
            at = _spans(self.lists[block], df[block])
            weights = np.zeros((len(block), self.n))
            weights[np.repeat(np.arange(len(block)), df[block]), self.posted[at]] = self.scores[at]
            total += (weights > 0).T.astype(float) @ weights
        return total

    def neighbours(self, d: int) -> np.ndarray:
        """Every document of the shard that shares a weighted term with d, best first."""
        if self.shared is None:
            self.shared = self.common()
        places = self.place[self.query[d] : self.query[d + 1]]
        df = self.lists[places + 1] - self.lists[places]
        rare = df * COMMON <= self.n
        at = _spans(self.lists[places[rare]], df[rare])
        # rounded, so that equal documents tie whatever the order of summation
        total = np.round(self.shared[d] + np.bincount(self.posted[at], self.scores[at], minlength=self.n), 9)
        total[d] = 0
        return np.argsort(-total, kind="stable")[: np.count_nonzero(total)].astype(np.int32)


def _spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of all spans, one after another."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


def pack(sizes: list[int], capacity: int, neighbours) -> Iterator[list[tuple[int, int, int, int]]]:
    """Containers as lists of (document, piece, first token, end token)."""
    rest: dict[int, tuple[int, int, int]] = {}
    for d, n in enumerate(sizes):
        full = n // capacity
        for k in range(full):
            yield [(d, k, k * capacity, (k + 1) * capacity)]
        if n % capacity:
            rest[d] = (full, full * capacity, n)
    size = np.zeros(len(sizes), np.int64)  # 0 once used
    for d, (_, a, n) in rest.items():
        size[d] = n - a
    free = sorted((n - a, -d) for d, (_, a, n) in rest.items())
    while free:
        s, d = free.pop()
        d = -d
        window, room = [d], capacity - s
        size[d] = 0
        near = np.asarray(neighbours(d), np.int64) if free and free[0][0] <= room else np.array([], np.int64)
        while (near := near[(size[near] > 0) & (size[near] <= room)]).size:
            x = int(near[0])
            s = int(size[x])
            window.append(x)
            room -= s
            size[x] = 0
            del free[bisect_right(free, (s, -x)) - 1]
        while free and free[0][0] <= room:
            k = bisect_right(free, (room, 1)) - 1
            s, x = free.pop(k)
            window.append(-x)
            room -= s
            size[-x] = 0
        yield [(x, *rest[x]) for x in window]


def containers(documents: DataFrame, capacities: DataFrame, *, doc_id: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    """One row per text or piece: container_id, capacity_tokens, bin_id, doc_id, piece_no, start_token, end_token."""
    spark = documents.sparkSession
    ensure_shipped(spark)
    # only the driver needs the folder: the vocabulary goes to the executors
    spark.sparkContext.addFile(os.path.join(tokenizer_dir(spark), vocabulary))
    given = capacities.select("container_id", "capacity_tokens").where("container_id IS NOT NULL AND capacity_tokens IS NOT NULL").distinct().limit(MAX_CAPACITIES + 1).collect()
    if len(given) > MAX_CAPACITIES:
        raise ValueError(f"more than {MAX_CAPACITIES} capacities")
    kinds = sorted((int(r[0]), int(r[1])) for r in given)
    if any(c <= 0 for _, c in kinds):
        raise ValueError("a capacity must be positive")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import SparkFiles, TaskContext

        part = TaskContext.get().partitionId()
        counter = Counter(SparkFiles.get(vocabulary))
        ids: list[int] = []
        seen: set[int] = set()
        terms: list[np.ndarray] = []
        sizes: list[int] = []
        shard_no = 0

        def flush() -> pa.RecordBatch:
            index = Shard(terms)
            known: dict[int, np.ndarray] = {}

            def neighbours(d: int) -> np.ndarray:
                if d not in known:
                    known[d] = index.neighbours(d)
                return known[d]

            rows: list[tuple] = []
            for container_id, capacity in kinds:
                for k, window in enumerate(pack(sizes, capacity, neighbours)):
                    bin_id = f"{container_id}-{part}-{shard_no}-{k}"
                    rows += [(container_id, capacity, bin_id, ids[d], piece, a, b) for d, piece, a, b in window]
            columns = list(zip(*rows))
            types = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[x.split()[0] for x in SCHEMA.split(", ")])

        held = 0
        for batch in batches:
            for key, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                if key in seen:
                    continue
                found = counter.measured(content.as_py())
                n = int((found & ((1 << SIZE_BITS) - 1)).sum())
                ids.append(key)
                seen.add(key)
                sizes.append(n)
                terms.append(found >> SIZE_BITS)
                held += len(found)
                if len(ids) >= SHARD_DOCS or held >= SHARD_TOKENS:
                    yield flush()
                    shard_no, held = shard_no + 1, 0
                    ids.clear(), seen.clear(), terms.clear(), sizes.clear()
        if ids and kinds:
            yield flush()

    slim = documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where(F.col("doc_id").isNotNull() & (F.length("text") > 0))
    # ids that repeat are rare: only where there are any, texts move to meet their copies
    repeated = slim.groupBy("doc_id").count().where("count > 1").limit(1)
    if not repeated.isEmpty():
        slim = slim.groupBy("doc_id").agg(F.min("text").alias("text"))
    return slim.mapInArrow(run, SCHEMA)


def fill(packed: DataFrame) -> DataFrame:
    """Containers, tokens and share of used space for each capacity."""
    used = F.sum(F.col("end_token") - F.col("start_token"))
    bins = packed.groupBy("container_id", "capacity_tokens", "bin_id").agg(used.alias("used"))
    return bins.groupBy("container_id", "capacity_tokens").agg(F.count("*").alias("bins"), F.sum("used").alias("tokens"), F.round(F.sum("used") / (F.count("*") * F.first("capacity_tokens")), 6).alias("filled"))
