"""Chunks of documents: packing pages with overlap, selection by relevance."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folium.functions import text as T
from folium.plans.ship import ensure_shipped

PARAGRAPHS = re.compile(r"\n\s*\n")
CHUNK_SCHEMA = "doc_id string, chunk_idx int, text string, first_page int, last_page int"


def blocks(text: str, limit: int) -> Iterator[str]:
    """Paragraphs packed up to the limit; one that is longer itself is cut every `limit` characters."""
    if len(text) <= limit:
        yield text
        return
    held: list[str] = []
    cost = 0
    for part in [*PARAGRAPHS.split(text), None]:
        if held and (part is None or cost + len(part) > limit):
            yield "\n\n".join(held)
            held, cost = [], 0
        if part is None:
            return
        if len(part) > limit:
            yield from (part[k : k + limit] for k in range(0, len(part), limit))
        else:
            held.append(part)
            cost += len(part) + 2


def block_rows(df: DataFrame, key: str, *, text: str = "text", limit: int) -> DataFrame:
    """key, block_no, text: the blocks of each text, as a page is cut before packing."""
    ensure_shipped(df.sparkSession)
    slim = df.select(key, F.col(text).alias("text")).where("text IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cut = [list(blocks(t, limit)) for t in b.column(1).to_pylist()]
            at = pa.array([k for k, x in enumerate(cut) for _ in x], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), pa.array([n for x in cut for n in range(len(x))], pa.int32()), pa.array([t for x in cut for t in x], pa.string())], names=[key, "block_no", "text"])

    return slim.mapInArrow(run, f"`{key}` {dict(slim.dtypes)[key]}, block_no int, text string")


class Packer:
    """Packs the pages of one document after another, in order; holds one chunk at a time, never a document."""

    def __init__(self, size: int, overlap: int) -> None:
        self.size, self.overlap = size, overlap
        self.doc: str | None = None
        self.before: tuple[str | None, str | None] = (None, None)
        self._new(None)

    def fresh(self, doc: str, page: str | None) -> bool:
        """Whether a page isn't the one before, delivered again."""
        again = page is not None and (doc, page) == self.before
        self.before = (doc, page)
        return not again

    def _new(self, doc: str | None) -> None:
        self.doc, self.no, self.parts, self.cost, self.first, self.last = doc, 0, [], 0, None, None

    def _tail(self, text: str) -> str:
        if not 0 < self.overlap < len(text):
            return ""
        end = text[len(text) - self.overlap :]
        for mark in ("\n\n", "\n", ". "):
            _, found, after = end.partition(mark)
            if found:
                return after.strip()
        return end.strip()

    def close(self) -> Iterator[tuple]:
        """The chunk at hand; what follows begins with its tail."""
        if self.first is None:
            return
        text = "\n\n".join(self.parts).strip()
        if text:
            yield self.doc, self.no, text, self.first, self.last
            self.no += 1
        tail = self._tail(text)
        self.parts, self.cost, self.first = ([tail], len(tail), self.last) if tail else ([], 0, None)

    def page(self, doc: str, number: int, text: str | None) -> Iterator[tuple]:
        if doc != self.doc:
            yield from self.close()
            self._new(doc)
        for block in blocks(text or "", self.size):
            if not text or (len(text) > self.size and not block.strip()):
                continue
            piece = f"[[стр. {number}]]\n{block}"
            if self.parts and self.cost + len(piece) > self.size:
                yield from self.close()
            self.first = number if self.first is None else self.first
            self.last = number
            self.parts.append(piece)
            self.cost += len(piece) + 2


def packed(pages: DataFrame, *, chunk_chars: int = 12_000, overlap_chars: int = 800) -> DataFrame:
    """doc_id, chunk_idx, text, first_page, last_page; pages delivered twice, told by page_id, count once. Pages stream in order through each task, so even a document of
    a tenth of all rows needs no more memory than a chunk."""
    ensure_shipped(pages.sparkSession)
    overlap = overlap_chars if overlap_chars < chunk_chars else chunk_chars // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(chunk_chars, overlap)

        def out(rows: list[tuple]) -> pa.RecordBatch:
            c = list(zip(*rows))
            return pa.RecordBatch.from_arrays([pa.array(c[0], pa.string()), pa.array(c[1], pa.int32()), pa.array(c[2], pa.string()), pa.array(c[3], pa.int32()), pa.array(c[4], pa.int32())], names=["doc_id", "chunk_idx", "text", "first_page", "last_page"])

        for batch in batches:
            rows = [row for doc, no, text, page in zip(*(batch.column(i).to_pylist() for i in range(4))) if packer.fresh(doc, page) for row in packer.page(doc, no, text)]
            if rows:
                yield out(rows)
        if rows := list(packer.close()):
            yield out(rows)

    order = ["doc_id", "page_no"] + (["page_id"] if "page_id" in pages.columns else [])
    page = F.col("page_id").cast("string") if "page_id" in pages.columns else F.lit(None).cast("string")
    ordered = pages.where("doc_id IS NOT NULL").repartition("doc_id").sortWithinPartitions(*order).select("doc_id", F.col("page_no").cast("int"), "text", page.alias("page"))
    return ordered.mapInArrow(run, CHUNK_SCHEMA)


def scored(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("score", T.relevance(F.col("text")))


def selected(chunks: DataFrame, *, max_chunks: int = 20, doc: str = "doc_id", idx: str = "chunk_idx", score: str = "score") -> DataFrame:
    """The first chunk of each document and the most relevant others, max_chunks in all."""
    w = Window.partitionBy(doc).orderBy((F.col(idx) == 0).desc(), F.col(score).desc_nulls_last(), F.col(idx))
    return chunks.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= max_chunks).drop("_rank")
