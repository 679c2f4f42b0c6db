"""Abusive, hateful or sexual passages in documents (problem 9).

FTRL-proximal logistic regression over hashed word n-grams and skip-grams: each coordinate has its own learning rate,
L1 keeps the weights sparse, and the non-zero ones are sent to the executors. Raters judge whole documents, yet one
passage decides, so training is by instances: the passages of safe documents are negative; of an unsafe document only
the passage that the present weights find worst is positive, and this choice is renewed between rounds.
A document's score is the probability of its worst passage.

The classifier is fitted on at most `max_docs` rated documents, those with the least hash of doc_id, read whole; every
other step covers all rows. The fit runs in one task; the driver gets the non-zero weights alone. Cases: NULL and empty texts and texts without a passage of three words get score 0; ties between raters are
left out of the fit; without rated documents every score is 0; repeated rows of a document give one row, its highest
score; other columns of either table are ignored. A very long text is read whole, in passages of at most
MAX_PASSAGE words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folium.plans.ship import ensure_shipped

#: Letters, or the end of a passage: a mark before white space, a blank line.
TOKEN = re.compile(r"[^\W\d_]+|[.!?…](?=[\"”»“’']?\s)|\n[ \t]*\n")
UNSEEN = re.compile("[\xad​-‏⁠﻿̀-ͯ]")
#: Latin and Greek letters that look like Cyrillic ones. Both spellings of a word get one feature.
LOOK_ALIKE = str.maketrans("aceopxykmthbiαορν", "асеорхукмтнвіаорν")
BITS = 20
END = 0
MAX_PASSAGE = 400


class Cache(dict):
    """Hash of a word, 0 for an end of passage."""

    def __missing__(self, token: str) -> int:
        if len(self) > 500_000:
            self.clear()
        value = END if not token[0].isalpha() else crc32(token.translate(LOOK_ALIKE).encode()) | 1
        self[token] = value
        return value


def hashes(text: str, cache: Cache) -> np.ndarray:
    """Word hashes of a text with an END after each passage."""
    text = UNSEEN.sub("", text) if UNSEEN.search(text) else text
    found = TOKEN.findall(text.lower())
    out = np.fromiter(map(cache.__getitem__, found), np.uint64, len(found))
    if len(out) > MAX_PASSAGE:  # a passage without any mark is cut, others stay
        ends = np.flatnonzero(out == END)
        begins, stops = np.concatenate([[0], ends + 1]), np.concatenate([ends, [len(out)]])
        long = stops - begins > MAX_PASSAGE
        if long.any():
            out = np.insert(out, np.concatenate([np.arange(a + MAX_PASSAGE, b, MAX_PASSAGE) for a, b in zip(begins[long], stops[long])]), END)
    return np.concatenate([out, np.zeros(2, np.uint64)])


def features(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers of unigrams, bigrams, skip-grams and trigrams that start at each word; 0 where there is none."""
    a, b, c = h[:-2], h[1:-1], h[2:]
    top = np.uint64(64 - BITS)
    m1, m2, m3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
    live, two, three = a != END, (a != END) & (b != END), (a != END) & (b != END) & (c != END)
    with np.errstate(over="ignore"):
        one = (a * m1) >> top
        pair = ((a * m1) ^ (b * m2 + m3)) * m1 >> top
        skip = ((a * m2) ^ (c * m3 + m1)) * m1 >> top
        tri = (((a * m1) ^ (b * m2 + m3)) * m1 ^ (c * m2)) * m3 >> top
    return np.where(live, one, 0), np.where(two, pair, 0), np.where(three, skip, 0), np.where(three, tri, 0)


class FTRL:
    """Follow the regularised leader, proximal, per coordinate; weights are made on demand from z and n."""

    def __init__(self, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.2, l2: float = 0.1) -> None:
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(1 << BITS), np.zeros(1 << BITS)
        self.bias_z = self.bias_n = 0.0

    def _weights(self, z: np.ndarray, n: np.ndarray) -> np.ndarray:
        w = (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    @property
    def bias(self) -> float:
        return -self.bias_z / ((self.beta + self.bias_n**0.5) / self.alpha)

    def weights(self) -> np.ndarray:
        return self._weights(self.z, self.n).astype(np.float32)

    def learn(self, index: np.ndarray, label: float, weight: float) -> None:
        z, n = self.z[index], self.n[index]
        w = self._weights(z, n)
        p = 1 / (1 + np.exp(-np.clip(w.sum() + self.bias, -30, 30)))
        g = (p - label) * weight
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha
        self.z[index] = z + g - sigma * w
        self.n[index] = n + g * g
        s = ((self.bias_n + g * g) ** 0.5 - self.bias_n**0.5) / self.alpha
        bias = self.bias
        self.bias_z += g - s * bias
        self.bias_n += g * g


def passages(text: str, cache: Cache) -> list[np.ndarray]:
    """Distinct feature numbers of each passage."""
    h = hashes(text, cache)
    parts = features(h)
    stops = np.flatnonzero(h[:-2] == END)
    out, start = [], 0
    for stop in [*stops, len(h) - 2]:
        if stop - start > 2:
            index = np.unique(np.concatenate([p[start:stop] for p in parts]))
            out.append(index[index > 0])
        start = stop + 1
    return out


def _first_choice(docs: list[tuple[list[np.ndarray], bool, float]]) -> dict[int, int]:
    """The passage of each unsafe document whose features speak most for unsafe documents, by smoothed log odds of the
    documents that hold a feature; features of a single unsafe document say nothing."""
    held = [np.unique(np.concatenate(parts)) for parts, _, _ in docs]
    count = [np.zeros(1 << BITS), np.zeros(1 << BITS)]
    total = [0, 0]
    for features_, (_, unsafe, _) in zip(held, docs):
        count[unsafe][features_] += 1
        total[unsafe] += 1
    odds = np.log((count[1] + 0.5) / (total[1] + 1)) - np.log((count[0] + 0.5) / (total[0] + 1))
    odds[count[1] < 2] = 0
    best = lambda x: np.sort(odds[x])[-12:].sum()
    return {k: int(np.argmax([best(x) for x in parts])) for k, (parts, unsafe, _) in enumerate(docs) if unsafe}


def fit(rows: list[tuple[str, float, int]], *, rounds: int = 2, epochs: int = 1, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias from (text, share of raters who said unsafe, raters)."""
    cache, rng = Cache(), np.random.default_rng(seed)
    docs = [(p, share > 0.5, abs(2 * share - 1) * min(1.0, 0.4 + 0.3 * raters)) for text, share, raters in rows if share != 0.5 and (p := passages(text, cache))]
    if not docs:
        return np.zeros(1 << BITS, np.float32), -30.0
    worst = _first_choice(docs)
    for turn in range(rounds):
        model = FTRL()
        data = []
        for k, (parts, unsafe, weight) in enumerate(docs):
            data += [(parts[worst[k]], 1.0, weight)] if unsafe else [(x, 0.0, weight) for x in parts]
        for _ in range(epochs + (turn == rounds - 1)):
            for i in rng.permutation(len(data)):
                model.learn(*data[i])
        w = model.weights()
        if turn < rounds - 1:
            worst = {k: int(np.argmax([w[x].sum() for x in parts])) for k, (parts, unsafe, _) in enumerate(docs) if unsafe}
    return w, model.bias


def train(documents: DataFrame, labels: DataFrame, *, max_docs: int = 4000, doc_id: str = "doc_id", text: str = "text") -> tuple[np.ndarray, np.ndarray, float]:
    """Numbers and values of the non-zero weights, and the bias."""
    rated = labels.where(F.col("unsafe").isNotNull() & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("_k"), "rater", "unsafe").distinct()
    rated = rated.groupBy("_k").agg(F.avg(F.col("unsafe").cast("double")).alias("_share"), F.count("*").alias("_raters"))
    # the sample is chosen before the texts are read, so that the join moves no more than max_docs texts
    chosen = rated.where(F.col("_share") != 0.5).orderBy(F.xxhash64("_k"), "_k").limit(max_docs)
    texts = documents.select(F.col(doc_id).alias("_k"), F.col(text).alias("_t")).where(F.length("_t") > 0)
    # a document's repeated rows come once, so max_docs bounds what the fit reads; it runs in one task on an executor
    sample = texts.join(F.broadcast(chosen), "_k").groupBy("_k", "_share", "_raters").agg(F.min("_t").alias("_t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        w, bias = fit([(t, share, raters) for _, share, raters, t in rows])
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(w[at].astype(np.float64), bias))], names=["at", "w"])

    found = sample.select("_k", "_share", F.col("_raters").cast("int"), "_t").repartition(1).mapInArrow(run, "at int, w double").toArrow()
    at, w = found.column("at").to_numpy(), found.column("w").to_numpy()
    # an empty sample may give no row at all
    return at[at >= 0], w[at >= 0].astype(np.float32), float(w[at < 0][0]) if (at < 0).any() else -30.0


def scores(documents: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", max_docs: int = 4000, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns of `keep` and score, one row per document."""
    ensure_shipped(documents.sparkSession)
    at, values, bias = train(documents, labels, max_docs=max_docs, doc_id=doc_id, text=text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, cache = np.zeros(1 << BITS, np.float32), Cache()
        weights[at] = values
        weights[0] = 0
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            out = np.zeros(batch.num_rows)
            start = 0
            while start < batch.num_rows:
                held, stop, parts = 0, start, []
                while stop < batch.num_rows and held < 2_000_000:
                    parts.append(hashes(texts[stop].as_py() or "", cache))
                    held += len(parts[-1])
                    stop += 1
                h = np.concatenate(parts)
                total = sum(weights[f] for f in features(np.concatenate([h, np.zeros(2, np.uint64)])))
                ends = np.flatnonzero(h == END)
                sums = np.add.reduceat(total, np.concatenate([[0], ends[:-1] + 1])) if len(ends) else np.zeros(0)
                sums = np.where(np.diff(np.concatenate([[-1], ends])) > 3, sums, -np.inf)  # as in the fit, no passage of under three words
                doc = np.searchsorted(np.cumsum([len(p) for p in parts]), ends, side="right")
                worst = np.full(len(parts), -np.inf)
                np.maximum.at(worst, doc, sums)
                out[start:stop] = np.where(np.isfinite(worst), 1 / (1 + np.exp(-np.clip(worst + bias, -30, 30))), 0.0)
                start = stop
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.round(out, 6))], names=[*[f"k{i}" for i in range(batch.num_columns - 1)], "score"])

    columns = [F.col(doc_id).alias("k0"), *[F.col(c).alias(f"k{i + 1}") for i, c in enumerate(keep)]]
    slim = documents.select(*columns, F.col(text).alias("t"))
    kinds = dict(slim.dtypes)
    found = slim.mapInArrow(run, ", ".join([f"k{i} {kinds[f'k{i}']}" for i in range(len(keep) + 1)] + ["score double"]))
    found = found.groupBy("k0").agg(*[F.min(f"k{i + 1}").alias(c) for i, c in enumerate(keep)], F.max("score").alias("score"))
    return found.withColumnRenamed("k0", doc_id)


def flagged(documents: DataFrame, labels: DataFrame, *, threshold: float = 0.3, **options) -> DataFrame:
    return scores(documents, labels, **options).where(F.col("score") >= threshold)


def rates(scored: DataFrame, *, source: str = "source", threshold: float = 0.3) -> DataFrame:
    """Documents, flagged documents and their share for each source; NULL is a source of its own."""
    flag = (F.col("score") >= threshold).cast("int")
    return scored.groupBy(source).agg(F.count("*").alias("docs"), F.sum(flag).alias("flagged"), F.round(F.avg(flag.cast("double")), 6).alias("rate"))
