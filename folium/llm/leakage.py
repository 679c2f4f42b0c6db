"""Evaluation passages inside corpus documents (problem 8).

A distributed positional inverted index, one shard per block of documents: the words of a block become ids of the
test vocabulary, the positions of each id form its posting list. For every stretch of `min_words` words of a test item
the rarest of its terms is chosen by the lengths of these lists; its postings less the term's offset in the item are
the places where the item could be aligned, and at each the neighbouring terms are intersected position by position.
Exact phrases are runs of at least `min_words` equal words. Proximity matches are item-long windows in which at least
`near_share` of the item's words stand at their places, whatever the runs: of the rarest terms of the item, one more is
looked up than may be missing, so that no such window is passed over. Items are searched in blocks of BLOCK_ITEMS, one
of which is broadcast at a time, so their number isn't bounded.

Cases: NULL or empty texts and empty tables give no rows; an item shorter than min_words can't match; a document that
holds a passage several times, and repeated rows of one document, come out once; other columns are ignored. A block
holds at most `block_words` words plus one document, so long texts and many documents need bounded memory.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folium.plans.ship import ensure_shipped

#: A word: what stands between white space, without other characters than letters and digits at both ends.
WORD = re.compile(r"[^\W_](?:\S*[^\W_])?")
BLOCK_ITEMS = 100_000


def words(text: str) -> list[str]:
    """The lower-cased words of a text; soft hyphens are ignored, no-break spaces are white space."""
    if "\xad" in text:
        text = text.replace("\xad", "")
    return WORD.findall(text.lower())


class PhraseSearch:
    """Searches blocks of documents for passages of the items."""

    def __init__(self, items: list[tuple[int, str]], min_words: int, near_share: float = 0.8) -> None:
        self.n, self.share = min_words, near_share
        self.vocabulary: dict[str, int] = {}
        self.items = []
        for item_id, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words(text or "")]
            if len(ids) >= min_words:
                self.items.append((item_id, np.array(ids, np.int32)))

    def needed(self, width: int) -> int:
        """Words at their places that make a proximity match with an item of `width` words."""
        return max(self.n, math.ceil(self.share * width - 1e-9))

    def anchors(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Offsets of the item such that each stretch of n words holds one, at the rarest term of the stretch, and each
        choice of words that makes a proximity match holds one too."""
        windows = np.lib.stride_tricks.sliding_window_view(counts[ids], self.n)
        live = windows.min(axis=1) > 0  # a stretch with a term that the block lacks can't occur
        rarest = np.argsort(counts[ids], kind="stable")[: len(ids) - self.needed(len(ids)) + 1]
        near = rarest if counts[ids[rarest[-1]]] else rarest[:0]  # more of them are missing than may be
        return np.unique(np.concatenate([(windows.argmin(axis=1) + np.arange(len(windows)))[live], near[counts[ids[near]] > 0]]))

    def block(self, tokens: np.ndarray, doc: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(document's place in the block, item id, longest run of equal words, equal words in the window)."""
        order = np.argsort(tokens, kind="stable")
        bounds = np.searchsorted(tokens[order], np.arange(len(self.vocabulary) + 1))
        counts = np.diff(bounds)
        out = []
        for item_id, ids in self.items:
            starts = [order[bounds[ids[k]] : bounds[ids[k] + 1]] - k for k in self.anchors(ids, counts)]
            if not starts:
                continue
            at = np.unique(np.concatenate(starts))
            width = len(ids)
            for part in np.array_split(at, max(1, len(at) * width // 4_000_000)):
                places = part[:, None] + np.arange(width)
                inside = (places >= 0) & (places < len(tokens))
                places = places.clip(0, len(tokens) - 1)
                equal = (tokens[places] == ids) & inside
                # a run must stay in one document: the document of each place against that of the place before
                same = np.ones_like(equal)
                same[:, 1:] = doc[places[:, 1:]] == doc[places[:, :-1]]
                run = np.zeros(len(part), np.int32)
                best, where = np.zeros(len(part), np.int32), np.zeros(len(part), np.int64)
                for k in range(width):
                    run = np.where(equal[:, k], np.where(same[:, k], run, 0) + 1, 0)
                    longer = run > best
                    best, where = np.where(longer, run, best), np.where(longer, places[:, k], where)
                for r in np.flatnonzero(best >= self.n):
                    d = doc[where[r]]
                    out.append((int(d), item_id, int(best[r]), int((equal[r] & (doc[places[r]] == d)).sum())))
                # further documents that the same alignment touches are rare: look at each end on its own
                need = self.needed(width)
                for r in np.flatnonzero(((best >= self.n) & (doc[places[:, 0]] != doc[places[:, -1]])) | ((best < self.n) & (equal.sum(axis=1) >= need))):
                    for d in np.unique(doc[places[r]]):
                        hit = equal[r] & (doc[places[r]] == d)
                        longest = max((len(x) for x in "".join("1" if x else "0" for x in hit).split("0")), default=0)
                        if longest >= self.n or hit.sum() >= need:
                            out.append((int(d), item_id, longest, int(hit.sum())))
        return out


def leaks(documents: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", min_words: int = 12, near_share: float = 0.8, block_words: int = 4_000_000) -> DataFrame:
    """One row per document and item with a shared passage: doc_id, item_id, longest_run, near_words; longest_run is under
    min_words where only the proximity matches."""
    ensure_shipped(documents.sparkSession)
    given = items.select(F.col(item_id).cast("bigint").alias("item_id"), F.col(item_text).alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    blocks = max(1, math.ceil(given.count() / BLOCK_ITEMS))
    found = None
    for k in range(blocks):
        part = given.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k) if blocks > 1 else given
        search = PhraseSearch(sorted((r[0], r[1]) for r in part.collect()), min_words, near_share)
        here = _searched(documents, search, doc_id, text, min_words, block_words)
        found = here if found is None else found.unionByName(here)
    # copies of a document, and an item with several texts, come out once
    return found.groupBy("doc_id", "item_id").agg(F.max("longest_run").alias("longest_run"), F.max("near_words").alias("near_words"))


def _searched(documents: DataFrame, search: PhraseSearch, doc_id: str, text: str, min_words: int, block_words: int) -> DataFrame:
    """The matches of one block of items, which is broadcast."""
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(search)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = shared.value
        get = search.vocabulary.get
        none = len(search.vocabulary)  # the id of all words that no item has

        def flush(keys: list, parts: list) -> pa.RecordBatch:
            tokens = np.concatenate(parts)
            doc = np.repeat(np.arange(len(parts), dtype=np.int32), [len(p) for p in parts])
            found = {}
            for d, item, longest, near in search.block(tokens, doc):
                old = found.get((keys[d], item), (0, 0))
                found[keys[d], item] = (max(old[0], longest), max(old[1], near))
            return pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in found], pa.int64()), pa.array([k[1] for k in found], pa.int64()), pa.array([v[0] for v in found.values()], pa.int32()), pa.array([v[1] for v in found.values()], pa.int32())],
                names=["doc_id", "item_id", "longest_run", "near_words"],
            )

        keys, parts, held = [], [], 0
        for batch in batches:
            for key, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                w = words(content.as_py())
                if len(w) < min_words:
                    continue
                keys.append(key)
                parts.append(np.fromiter((get(x, none) for x in w), np.int32, len(w)))
                held += len(w)
                if held >= block_words:
                    yield flush(keys, parts)
                    keys, parts, held = [], [], 0
        if parts:
            yield flush(keys, parts)

    if not search.items:
        return spark.createDataFrame([], "doc_id bigint, item_id bigint, longest_run int, near_words int")
    slim = documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where(F.col("doc_id").isNotNull() & (F.length("text") > 0))
    return slim.mapInArrow(run, "doc_id bigint, item_id bigint, longest_run int, near_words int")
