r"""Splitting oversized texts at natural boundaries with overlap (problem 1).

Bounded-quantifier regex extraction on the JVM: one pattern consumes up to the limit per match, its alternatives in order
of boundary strength (end of text, blank line, line, end of a sentence, white space), with a fall-back to any
character. Matches are the cores of the pieces; each piece but the first is extended backwards by lookback offsets to
share `overlap` characters with the one before. Everything is SQL array functions over one row, so a text never meets
another and nothing is shuffled.

Within one strength the longest stretch is taken; a stretch that fits the limit but not together with the overlap keeps
its natural boundary and gets a shorter overlap. A stronger boundary is preferred only beyond a third of the limit, else
pieces would be tiny. Page markers give first_page and last_page: the page in force at a piece's first character
and that at its last one.

Cases: NULL texts, limits and providers without a limit give no pieces; a text within its limit, the empty one
included, is one piece; overlap is held within 0 and half the limit; repeated rows of a key count once; ties can't
arise; other columns are ignored; empty tables give no rows. Lengths count characters (code points).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARKER = r"\[\[стр\. (\d+)\]\]"
BLANK = r"\n(?:[ \t]*+\n)++"
MAX_PROVIDERS = 10_000


def boundary(text: Column, limit: Column) -> Column:
    """Coarsest kind of boundary that suffices: blank_line, line, space or none."""

    def longest(pattern: str, t: Column) -> Column:
        return F.array_max(F.transform(F.split(t, pattern), lambda x: F.length(F.btrim(x, F.lit("\n")))))

    edged = F.concat(F.lit("\n"), text, F.lit("\n"))
    return F.when(longest(BLANK, edged) <= limit, "blank_line").when(longest(r"\n", text) <= limit, "line").when(longest(r"(?U)\s+", text) <= limit, "space").otherwise("none")


def cut_pattern(limit: Column, overlap: Column) -> Column:
    """The pattern that consumes one core; the first core may use the whole limit, which needs no pattern of its own."""
    inner = limit - overlap
    least = F.greatest(F.lit(1), (limit / 3).cast("int"))
    half = F.least(least, inner)
    return F.format_string(
        # the rest of the text; then by strength, each kind first with room for the overlap, then without
        r"(?s).{1,%2$d}\z"
        r"|.{%3$d,%2$d}(?<=\n)(?=[ \t]*+\n)|.{%4$d,%1$d}(?<=\n)(?=[ \t]*+\n)"
        r"|.{%3$d,%2$d}(?<=\n)|.{%3$d,%2$d}(?<=[.!?…。！？])(?=\s)|(?U:.{%3$d,%2$d}(?<=\s))"
        r"|.{%4$d,%1$d}(?<=\n)|(?U:.{1,%2$d}(?<=\s))|(?U:.{%4$d,%1$d}(?<=\s))|.{1,%2$d}",
        limit, inner, half, inner,
    )


def pieces(texts: DataFrame, limits: DataFrame, *, key: str = "chunk_id", text: str = "text", provider: str = "provider", first_page: str = "first_page", last_page: str = "last_page", oversized_only: bool = False) -> DataFrame:
    """key, piece_no, text, first_page, last_page, start_pos, shared (characters shared with the piece before), boundary.

    boundary is NULL for texts within their limit.
    """
    bound = limits.where(F.col("provider").isNotNull() & (F.col("chunk_chars") > 0)).groupBy("provider").agg(F.min("chunk_chars").alias("chunk_chars"), F.min("chunk_overlap_chars").alias("chunk_overlap_chars"))
    # a limit per provider: broadcast only because there are few; the count is checked
    if bound.limit(MAX_PROVIDERS + 1).count() <= MAX_PROVIDERS:
        bound = F.broadcast(bound)
    own = texts.select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.col(provider).alias("provider"), F.col(first_page).alias("_first"), F.col(last_page).alias("_last")).where(F.col("_key").isNotNull() & F.col("_text").isNotNull())
    df = own.join(bound, "provider")
    limit = F.col("chunk_chars").cast("int")
    overlap = F.least(F.greatest(F.coalesce(F.col("chunk_overlap_chars"), F.lit(0)), F.lit(0)), (limit / 2).cast("int")).cast("int")
    df = df.withColumn("_limit", limit).withColumn("_overlap", overlap).withColumn("_big", F.length("_text") > F.col("_limit"))
    df = df.withColumn("boundary", F.when(F.col("_big"), boundary(F.col("_text"), F.col("_limit"))))
    if oversized_only:
        df = df.where("_big")
    df = df.withColumn("_cores", F.when(F.col("_big"), F.regexp_extract_all("_text", cut_pattern(F.col("_limit"), F.col("_overlap")), F.lit(0))).otherwise(F.array("_text")))
    starts = F.aggregate("_cores", F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(x))))
    df = df.withColumn("_starts", starts)
    # pages: markers by their places in the whole text, so that one cut in two still counts
    between = F.split("_text", MARKER)
    places = F.slice(F.aggregate(between, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(x)))), 2, F.size(between) - 1)
    df = df.withColumn("_pages", F.regexp_extract_all("_text", F.lit(MARKER), F.lit(1)))
    widths = F.transform("_pages", lambda p: F.length(p) + 9)
    before = F.aggregate(widths, F.array(F.lit(0)), lambda acc, w: F.concat(acc, F.array(F.element_at(acc, -1) + w)))
    df = df.withColumn("_at", F.when(F.size("_pages") > 0, F.zip_with(places, F.slice(before, 1, F.size("_pages")), lambda a, b: a + b)).otherwise(F.array().cast("array<int>")))
    df = df.select("_key", "_text", "_first", "_last", "_limit", "_overlap", "boundary", "_pages", "_at", "_starts", F.posexplode("_cores").alias("_no", "_core"))
    start = F.element_at("_starts", F.col("_no") + 1)
    room = F.greatest(F.lit(0), F.least(F.col("_overlap"), F.col("_limit") - F.length("_core"), start))
    df = df.withColumn("_from", start).withColumn("shared", F.when(F.col("_no") == 0, 0).otherwise(room))
    df = df.withColumn("start_pos", F.col("_from") - F.col("shared")).withColumn("_end", F.col("_from") + F.length("_core"))
    page = lambda upto: F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.slice("_pages", F.lit(1), F.size(F.filter("_at", lambda a: a <= upto)))), -1).cast("int")
    first = F.coalesce(page(F.col("start_pos")), F.col("_first"), F.col("_last"))
    df = df.withColumn("first_page", first).withColumn("last_page", F.coalesce(page(F.col("_end") - 1), F.col("first_page")))
    out = df.select(F.col("_key").alias(key), F.col("_no").alias("piece_no"), F.substring("_text", F.col("start_pos") + 1, F.col("_end") - F.col("start_pos")).alias("text"), "first_page", "last_page", "start_pos", "shared", "boundary")
    return out.dropDuplicates([key, "piece_no"])


def found(texts: DataFrame, limits: DataFrame, **options) -> DataFrame:
    """Keys of the texts over their limit, with the coarsest boundary that suffices, from the operator's pieces."""
    cut = pieces(texts, limits, oversized_only=True, **options)
    key = options.get("key", "chunk_id")
    return cut.where("piece_no = 0").select(F.col(key).cast("bigint").alias(key), "boundary")
