"""Pages: running headers and footers, line normalisation, reflow, marked text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folium.functions import text as T
from folium.functions.rx import let, unicode_ci
from folium.plans.ship import written
from folium.rules import procurement_ru as R

MAX_LINE, WINDOW, MIN_PAGES, SHARE = 90, 2, 4, 0.6


def _once(pages: DataFrame, *small: Column) -> DataFrame:
    """doc_id and the small columns of each page; copies of a page are merged here, so that no text moves for it."""
    keys = [c for c in ("doc_id", "page_id") if c in pages.columns]
    out = pages.select(*keys, *small)
    return out.distinct() if "page_id" in keys else out


def page_stats(pages: DataFrame, *, min_chars: int = 80) -> DataFrame:
    """doc_id, pages, chars, pages_with_text, likely_scanned. Of pages delivered twice, told by page_id, one counts."""
    pages = _once(pages, F.length(F.coalesce("text", F.lit(""))).alias("n"))
    n = F.col("n")
    return pages.groupBy("doc_id").agg(F.count("*").alias("pages"), F.sum(n).alias("chars"), F.count_if(n >= min_chars).alias("pages_with_text"), (F.count_if(n >= min_chars) == 0).alias("likely_scanned"))


def base_line(c: Column) -> Column:
    """A line as it is compared: no-break spaces and hyphens made plain, blanks collapsed."""
    return T.strip(F.regexp_replace(F.translate(c, "\xa0‑", " -"), "[ \\t]+", " "))


def _edges(items: Column) -> Column:
    """The first and the last WINDOW elements."""
    return F.concat(F.slice(items, F.lit(1), F.lit(WINDOW)), F.slice(items, F.greatest(F.size(items) - WINDOW + 1, F.lit(1)), F.lit(WINDOW)))


def noise_masks(pages: DataFrame, *, compat: bool = False) -> DataFrame:
    """doc_id, mask, hits: masked lines that stand at the top or bottom of most pages of a document.

    compat mines lines as they are; else they are normalised first, so that what is found is also removed later. A
    document has at most 2 * WINDOW / SHARE masks, whatever its length.
    """
    lines = F.filter(F.transform(T.lines_of(F.coalesce("text", F.lit(""))), T.strip if compat else base_line), lambda x: x != "")
    masks = let(lines, lambda x: F.transform(F.filter(F.array_distinct(_edges(x)), lambda l: F.length(l) <= MAX_LINE), T.mask_numbers))
    # one pass: pages are counted as a mask of their own, so that the count needs no second exchange
    counted = _once(pages, masks.alias("masks")).select("doc_id", F.explode(F.concat(F.array(F.lit(None).cast("string")), "masks")).alias("mask")).groupBy("doc_id", "mask").agg(F.count("*").alias("hits"))
    total = counted.where("mask IS NULL").select("doc_id", F.col("hits").alias("pages")).where(F.col("pages") >= MIN_PAGES)
    return counted.where("mask IS NOT NULL").join(total, "doc_id").where(F.col("hits") >= F.greatest(F.lit(MIN_PAGES), F.floor(F.col("pages") * SHARE))).select("doc_id", "mask", "hits")


def normalized(pages: DataFrame, *, compat: bool = False) -> DataFrame:
    """Pages with clean text: glued hyphenation, no running lines, labels or page numbers."""
    # at most 2 * WINDOW / SHARE masks a document: the set is bounded. Written, its size is known when the join is
    # planned, so that a small one is broadcast and the texts stay where they are
    noise = written(noise_masks(pages, compat=compat).groupBy("doc_id").agg(F.collect_set("mask").alias("_noise")))
    joined = pages.join(noise, "doc_id", "left").withColumn("_noise", F.coalesce("_noise", F.array().cast("array<string>")))
    plain = F.regexp_replace(F.translate(F.coalesce("text", F.lit("")), "\xa0‑", " -"), r"(?U)(\w)-\n(\w)", "$1$2")
    lines = F.transform(F.split(plain, "\n", -1), base_line)
    joined = joined.withColumn("_lines", lines)
    numbered = F.filter(F.transform("_lines", lambda x, i: F.when(x != "", i)), lambda i: i.isNotNull())
    joined = joined.withColumn("_edge", let(numbered, _edges))
    # plain tests first: most lines have no mask to be compared with and stand at no edge
    noisy = lambda x: (F.size("_noise") > 0) & F.array_contains("_noise", T.mask_numbers(x))
    label = lambda x: x.rlike(unicode_ci(R.PAGE_LABEL))
    number = lambda x, i: F.array_contains("_edge", i) & x.rlike("(?U)" + R.BARE_NUMBER)
    kept = F.filter("_lines", lambda x, i: (x == "") | ~(noisy(x) | label(x) | number(x, i)))
    clean = T.strip(F.regexp_replace(F.array_join(kept, "\n"), "\n{3,}", "\n\n"))
    return joined.select(*[c for c in pages.columns if c != "text"], clean.alias("text"))


def reflow(c: Column) -> Column:
    """Joins wrapped lines; whether one joins the line before depends on these two lines alone."""

    def joins(prev: Column, line: Column) -> Column:
        free = (prev != "") & (line != "") & ~prev.contains("|") & ~line.contains("|")
        return free & ~prev.rlike(R.SENTENCE_END) & ~line.rlike(unicode_ci(R.LIST_ITEM_START)) & ~line.rlike("(?U)^" + R.MARKER)

    def joined(lines: Column) -> Column:
        before = F.concat(F.array(F.lit(None).cast("string")), lines)
        one = lambda x, i: F.when(i == 0, x["l"]).when(joins(x["p"], x["l"]), F.concat(F.lit(" "), x["l"])).otherwise(F.concat(F.lit("\n"), x["l"]))
        return F.array_join(F.transform(F.arrays_zip(before.alias("p"), lines.alias("l")), one), "")

    return let(F.transform(T.lines_of(c), T.strip), joined)


def marked_text(pages: DataFrame) -> DataFrame:
    """doc_id, text: non-empty pages in order, each under its marker; pages delivered twice, told by page_id, once."""
    block = F.struct("page_no", "page_id", F.concat(F.format_string("[[стр. %d]]\n", "page_no"), F.col("text")).alias("t")) if "page_id" in pages.columns else F.struct("page_no", F.concat(F.format_string("[[стр. %d]]\n", "page_no"), F.col("text")).alias("t"))
    some = pages.where(T.strip(F.coalesce("text", F.lit(""))) != "")
    # small tables need all cores for what follows, so the partitions are not merged afterwards
    some = some.repartition(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id")
    return some.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_set(block) if "page_id" in pages.columns else F.collect_list(block)), lambda x: x["t"]), "\n\n").alias("text"))
