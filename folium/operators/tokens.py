"""Lines, sentences, table rows and page lookup."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folium.functions import text as T
from folium.functions.rx import let, parts
from folium.rules import procurement_ru as R

SPLIT = "(?U)" + R.SENTENCE_SPLIT


def split_with_offsets(c: Column, pattern: str) -> Column:
    """array of struct(pos, text): the pieces between matches, with their places from 0."""

    def of(x: Column) -> Column:
        widths = F.concat(F.transform(x["marks"], F.length), F.array(F.lit(0)))
        starts = T.running(F.zip_with(x["pieces"], widths, lambda p, w: F.length(p) + F.coalesce(w, F.lit(0))))
        return F.zip_with(starts, x["pieces"], lambda s, p: F.struct(s.alias("pos"), p.alias("text")))

    return let(F.struct(parts(c, pattern).alias("pieces"), F.regexp_extract_all(c, F.lit(pattern), F.lit(0)).alias("marks")), of)


def sentences(df: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """keys, sent_no, pos, text: split at a final mark before a capital or digit, or at line breaks."""
    return df.select(*keys, F.posexplode(split_with_offsets(F.col(text), SPLIT)).alias("sent_no", "_s")).select(*keys, "sent_no", F.col("_s.pos").alias("pos"), F.col("_s.text").alias("text"))


def sentences_with(df: DataFrame, *keys: str, keep: Callable[[Column], Column], text: str = "text", pattern: str = SPLIT) -> DataFrame:
    """keys, pos, text of the pieces that keep() holds for; only they are unfolded."""
    some = F.filter(split_with_offsets(F.col(text), pattern), lambda s: keep(s["text"]))
    return df.select(*keys, F.explode(some).alias("_s")).select(*keys, F.col("_s.pos").alias("pos"), F.col("_s.text").alias("text"))


BREAK = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def lines(df: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """keys, line_no, pos, text: stripped lines and where each begins; no line after a final break."""
    some = let(split_with_offsets(F.col(text), BREAK), lambda every: F.when(F.element_at(every, -1)["text"] == "", F.slice(every, F.lit(1), F.size(every) - 1)).otherwise(every))
    return df.select(*keys, F.posexplode(some).alias("line_no", "_s")).select(*keys, "line_no", F.col("_s.pos").alias("pos"), T.strip(F.col("_s.text")).alias("text"))


def table_rows(df: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """keys, line_no, cells: lines with a pipe, cut into stripped cells."""
    return lines(df, *keys, text=text).where(F.col("text").contains("|")).select(*keys, "line_no", F.transform(F.split("text", r"\|", -1), T.strip).alias("cells"))


def render_table(rows: Column) -> Column:
    """Text of a table given as array<array<string>>: blanks collapsed, empty rows left out."""
    cells = F.transform(rows, lambda r: F.transform(r, lambda x: T.strip(F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)\s+", " "))))
    return F.concat(F.lit(R.TABLE_LINE + "\n"), F.array_join(F.transform(F.filter(cells, lambda r: F.exists(r, lambda x: x != "")), lambda r: F.array_join(r, " | ")), "\n"))


def first_sentence_with(df: DataFrame, key: str, words: list[str], *, text: str = "text") -> DataFrame:
    """key, text: the first sentence that holds any of the words; rows without one are left out."""
    every = parts(F.col(text), SPLIT)
    return df.select(key, F.get(F.filter(every, lambda s: T.contains_any(F.lower(s), words)), F.lit(0)).alias("text")).where("text IS NOT NULL")


def page_of(positions: DataFrame, markers: DataFrame, *, doc: str = "doc_id", pos: str = "pos", page: str = "page_no") -> DataFrame:
    """Backward as-of join: for each position the page of the last marker at or before it, NULL if none."""
    both = positions.withColumn("_rank", F.lit(1)).withColumn(page, F.lit(None).cast("int")).unionByName(markers.select(doc, pos, page).withColumn("_rank", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy(doc).orderBy(pos, "_rank").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(page, F.last(page, ignorenulls=True).over(w)).where("_rank = 1").drop("_rank")


def page_marks(text: Column) -> Column:
    """array of struct(pos, page): the page markers of a text, in order."""

    def of(x: Column) -> Column:
        widths, gaps = F.transform(x["marks"], F.length), F.transform(F.slice(x["parts"], F.lit(1), F.size(x["marks"])), F.length)
        begins = F.zip_with(T.running(F.zip_with(gaps, widths, lambda g, w: g + w)), gaps, lambda s, g: s + g)
        return F.zip_with(begins, x["marks"], lambda b, m: F.struct(b.alias("pos"), F.regexp_extract(m, R.MARKER, 1).cast("int").alias("page")))

    return let(F.struct(parts(text, R.MARKER).alias("parts"), F.regexp_extract_all(text, F.lit(R.MARKER), F.lit(0)).alias("marks")), of)


def marked_page(marks: Column, pos: Column) -> Column:
    """The page of the last marker at or before pos, NULL if none."""
    upto = F.filter(marks, lambda m: m["pos"] <= pos)
    return F.when(F.size(upto) > 0, F.element_at(upto, F.greatest(F.size(upto), F.lit(1)))["page"])


def page_at(text: Column, pos: Column) -> Column:
    """The same within one text, by its own markers."""
    return marked_page(page_marks(text), pos)
