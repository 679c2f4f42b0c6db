"""Uploaded documents: admission, binary files, optional PDF text."""

from __future__ import annotations

import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.plans.ship import ensure_shipped

# Media types that are let through, the signature, limits.
MEDIA_TYPES = ["application/pdf", "application/x-pdf", "application/octet-stream", ""]
SIGNATURE = "255044462D"  # %PDF-
MAX_UPLOAD_MB, MIN_PRIMARY_CHARS, MIN_PAGE_CHARS = 25, 200, 80


def scan(spark: SparkSession, path: str, *, max_mb: int = MAX_UPLOAD_MB) -> DataFrame:
    """Binary files as uploads. Oversized files are listed, for admission to turn them away, but never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    fits = F.col("length") <= max_mb * 1024 * 1024
    every = files.where(fits).select("path", "length", "content").unionByName(files.where(~fits).select("path", "length", F.lit(None).cast("binary").alias("content")))
    name = F.element_at(F.split("path", "/"), -1)
    return every.select(F.col("path").alias("doc_id"), name.alias("filename"), F.lit(None).cast("string").alias("content_type"), "content", F.col("length").alias("size_bytes"))


def wrong_media(content_type: Column, filename: Column) -> Column:
    """Neither the type is allowed nor the name a PDF's; or another name without a type."""
    kind, name = F.coalesce(content_type, F.lit("")), F.lower(F.coalesce(filename, F.lit("")))
    pdf = name.endswith(".pdf")
    return (~kind.isin(MEDIA_TYPES) & ~pdf) | ((name != "") & ~pdf & (kind == ""))


def signed(content: Column) -> Column:
    """Whether content, but for white space before, however much, begins with the signature."""
    return (F.hex(F.substring(content, 1, 5)) == SIGNATURE) | F.decode(content, "ISO-8859-1").rlike(r"\A[\t\n\x0b\f\r ]++%PDF-")


def admission(uploads: DataFrame, *, max_mb: int = MAX_UPLOAD_MB) -> DataFrame:
    """doc_id, code, status: NULL code for uploads that are let in, else the first rule that turns one away."""
    size = F.coalesce(F.col("size_bytes"), F.length("content").cast("bigint"), F.lit(0))
    code = (
        F.when(wrong_media(F.col("content_type"), F.col("filename")), "unsupported_file")
        .when(size > max_mb * 1024 * 1024, "file_too_large")
        .when((size == 0) | F.col("content").isNull(), "unsupported_file")
        .when(~signed(F.col("content")), "unreadable_pdf")
    )
    status = F.when(code == "unsupported_file", 415).when(code == "file_too_large", 413).when(code.isNotNull(), 422)
    # the content stays where it is: copies of an upload are merged by the verdict
    judged = uploads.select("doc_id", code.alias("code"), status.alias("status"))
    return judged.groupBy("doc_id").agg(F.min_by(F.struct("code", "status"), F.struct(F.col("code").isNotNull(), "code")).alias("v")).select("doc_id", "v.code", "v.status")


def rejects(uploads: DataFrame, stats: DataFrame | None = None, extracted: DataFrame | None = None, **options) -> DataFrame:
    """doc_id, code, status, detail of documents that are turned away; extracted (pages) adds admitted ones from which
    neither library read a page, stats those without a text layer."""
    judged = admission(uploads, **options)
    out = judged.where("code IS NOT NULL").withColumn("detail", F.lit(None).cast("string"))
    if extracted is not None:
        unread = judged.where("code IS NULL").select("doc_id").join(extracted.select("doc_id").distinct(), "doc_id", "left_anti")
        out = out.unionByName(unread.select("doc_id", F.lit("unreadable_pdf").alias("code"), F.lit(422).alias("status"), F.lit(None).cast("string").alias("detail")))
    if stats is not None:
        blank = stats.where("likely_scanned").join(out.select("doc_id"), "doc_id", "left_anti")
        out = out.unionByName(blank.select("doc_id", F.lit("no_text_layer").alias("code"), F.lit(422).alias("status"), F.concat(F.col("pages"), F.lit(" pages")).alias("detail")))
    return out


def _primary(data: bytes) -> list[str] | None:
    try:
        import pdfplumber
    except ImportError:
        return None
    try:
        with pdfplumber.open(io.BytesIO(data)) as pdf:
            out = []
            for page in pdf.pages:
                tables = ["\n".join(["[ТАБЛИЦА]", *(" | ".join(" ".join((c or "").split()) for c in row) for row in t if any((c or "").strip() for c in row))]) for t in page.extract_tables() or []]
                out.append("\n".join([page.extract_text(x_tolerance=1.5, y_tolerance=3) or "", *tables]).strip())
            return out
    except Exception:
        return None


def _fallback(data: bytes) -> list[str] | None:
    try:
        import pypdf
    except ImportError:
        return None
    try:
        reader = pypdf.PdfReader(io.BytesIO(data))
        if reader.is_encrypted and not reader.decrypt(""):
            return None
        return [(p.extract_text() or "").strip() for p in reader.pages]
    except Exception:
        return None


def pdf_pages(uploads: DataFrame) -> DataFrame:
    """doc_id, page_no, text, extractor of admitted uploads; the second library is asked only where the first gives
    little, and the longer text wins. Without either library there are no rows."""
    ensure_shipped(uploads.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                best, name = _primary(data), "primary"
                if sum(map(len, best or [])) < MIN_PRIMARY_CHARS:
                    other = _fallback(data)
                    if other is not None and sum(map(len, other)) > sum(map(len, best or [])) or best is None:
                        best, name = other, "fallback"
                rows += [(doc, k + 1, t, name) for k, t in enumerate(best or [])]
            if rows:
                c = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.string()), pa.array(c[1], pa.int32()), pa.array(c[2], pa.string()), pa.array(c[3], pa.string())], names=["doc_id", "page_no", "text", "extractor"])

    return uploads.where(F.col("content").isNotNull()).select(F.col("doc_id").cast("string"), "content").mapInArrow(run, "doc_id string, page_no int, text string, extractor string")
