"""Registered queries of the core, over whole tables, and their SQL."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.functions import text as T
from folium.operators import chunks, facts, jsonrepair, merging, pages, provider, reconcile, tokens, units
from folium.plans import summarize
from folium.plans.ship import ensure_shipped
from folium.rules import procurement_ru as R
from folium.sources import ingest, report
from folium.streaming import progress

Query = Callable[[SparkSession, str], DataFrame]
_registered: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(f: Query) -> Query:
    _registered[f.__name__] = f
    return f


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ensure_shipped(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as they were delivered, some of them twice: copies are merged on what is made of them, so that texts stay
    where they are."""
    return read(spark, sf_dir, "pages").select("page_id", "doc_id", "page_no", "text")


def _requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for requirements."""
    return read(spark, sf_dir, "requirements").select("req_id", "doc_id", "category", "text", "mandatory", "source_pages")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", "text")


#: SQL of the same: a page once; white space as Unicode has it; a strip.
S = r"[\s\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{85}\x{0b}]"
PAGES = "SELECT DISTINCT page_id, doc_id, page_no, text FROM pages"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{S}+|{S}+$', '', 'g')"


def _squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '{S}+', ' ', 'g'), ' \t\n\r-—:;')".replace("\t", "' || chr(9) || '").replace("\n", "' || chr(10) || '").replace("\r", "' || chr(13) || '")


def _base(x: str) -> str:
    return _strip(f"regexp_replace(translate({x}, chr(160) || chr(8209), ' -'), '[ \\t]+', ' ', 'g')")


# problem 3


@query
def p3_found(spark, sf_dir):
    m = read(spark, sf_dir, "money_facts").select("money_id", "amount", "currency", "raw", "field")
    return units.wrong_amounts(units.convert(m, read(spark, sf_dir, "fx_rates")))


@query
def p3_values(spark, sf_dir):
    done = units.convert(read(spark, sf_dir, "money_facts"), read(spark, sf_dir, "fx_rates"))
    return done.selectExpr("cast(money_id as bigint) as money_id", "field", "cast(rub as decimal(28,2)) as rub", "unit_from", "unit", "posterior", "uncertain")


@query
def p3_recovered(spark, sf_dir):
    """How many sums the mixture recovers where the unit, another one for each field, is struck out of known records."""
    rates = read(spark, sf_dir, "fx_rates")
    m = read(spark, sf_dir, "money_facts").select("money_id", "amount", "currency", "raw", "field")
    done = units.convert(units.struck(units.convert(m, rates)), rates).where("truth IS NOT NULL")
    right = F.coalesce(F.abs(F.col("rub") - F.col("truth")) <= F.col("truth") * 0.001 + 0.01, F.lit(False))
    return done.groupBy("field").agg(F.count("*").alias("records"), F.count_if(right).alias("recovered"), F.count_if(~F.col("uncertain")).alias("sure"), F.count_if(right & ~F.col("uncertain")).alias("sure_recovered"))


# sources and admission


@query
def scan_page_stats(spark, sf_dir):
    return pages.page_stats(_pages(spark, sf_dir))


_sql["scan_page_stats"] = f"""
SELECT doc_id, count(*) AS pages, sum(length(coalesce(text, ''))) AS chars, count(*) FILTER (length(coalesce(text, '')) >= 80) AS pages_with_text,
       count(*) FILTER (length(coalesce(text, '')) >= 80) = 0 AS likely_scanned FROM ({PAGES}) GROUP BY doc_id"""


@query
def admission_rejects(spark, sf_dir):
    return ingest.rejects(read(spark, sf_dir, "doc_bytes")).select("doc_id", "code", "status")


_sql["admission_rejects"] = r"""
WITH v AS (SELECT doc_id, CASE
    WHEN (coalesce(content_type, '') NOT IN ('application/pdf', 'application/x-pdf', 'application/octet-stream', '') AND NOT lower(coalesce(filename, '')) LIKE '%.pdf')
      OR (coalesce(filename, '') <> '' AND NOT lower(coalesce(filename, '')) LIKE '%.pdf' AND coalesce(content_type, '') = '') THEN 'unsupported_file'
    WHEN coalesce(size_bytes, octet_length(content), 0) > 25 * 1024 * 1024 THEN 'file_too_large'
    WHEN coalesce(size_bytes, octet_length(content), 0) = 0 OR content IS NULL THEN 'unsupported_file'
    WHEN NOT regexp_matches(hex(content), '^(09|0A|0B|0C|0D|20)*255044462D') THEN 'unreadable_pdf' END AS code FROM doc_bytes),
w AS (SELECT doc_id, CASE WHEN count(*) FILTER (code IS NULL) > 0 THEN NULL ELSE min(code) END AS code FROM v GROUP BY doc_id)
SELECT doc_id, code, CASE WHEN code = 'unsupported_file' THEN 415 WHEN code = 'file_too_large' THEN 413 ELSE 422 END AS status FROM w WHERE code IS NOT NULL"""


@query
def money_report(spark, sf_dir):
    m = read(spark, sf_dir, "money_facts").select("money_id", "amount", "includes_vat").distinct()
    return m.select("money_id", report.money_text(F.col("amount"), F.col("includes_vat")).alias("line"))


_sql["money_report"] = """
SELECT DISTINCT money_id, CASE WHEN amount IS NULL THEN '-' ELSE translate(format('{:,.2f}', amount), ',.', ' ,') || ' RUB' ||
  CASE WHEN includes_vat THEN ', включая НДС' WHEN NOT includes_vat THEN ', без НДС' ELSE '' END END AS line FROM money_facts"""


@query
def json_rows(spark, sf_dir):
    return report.as_json(read(spark, sf_dir, "settings").select("setting_id", "chunk_chars", "chunk_overlap_chars", "max_chunks", "provider"), "setting_id")


_sql["json_rows"] = """SELECT setting_id, '{"setting_id":' || setting_id || ',"chunk_chars":' || chunk_chars || ',"chunk_overlap_chars":' || chunk_overlap_chars || ',"max_chunks":' || max_chunks || ',"provider":"' || provider || '"}' AS json FROM settings"""


@query
def pdf_text(spark, sf_dir):
    """Texts of PDF uploads; no rows where no PDF library is installed."""
    return ingest.pdf_pages(read(spark, sf_dir, "doc_bytes"))


# pages and lines


@query
def line_mask_counts(spark, sf_dir):
    lines = tokens.lines(_pages(spark, sf_dir), "page_id").where(F.col("text") != "").select("page_id", "line_no", "text").distinct()
    return lines.groupBy(T.mask_numbers(F.col("text")).alias("mask")).agg(F.count("*").alias("hits")).where("hits > 1")


_LINES = f"SELECT page_id, unnest(string_split(text, chr(10))) AS l FROM ({PAGES})"
_sql["line_mask_counts"] = rf"""
WITH l AS (SELECT {_strip('l')} AS l FROM ({_LINES}))
SELECT regexp_replace(l, '\p{{Nd}}+', '#', 'g') AS mask, count(*) AS hits FROM l WHERE l <> '' GROUP BY 1 HAVING count(*) > 1"""


@query
def header_footer_lines(spark, sf_dir):
    return pages.noise_masks(_pages(spark, sf_dir))


_NOISE = rf"""
p AS ({PAGES}),
a AS (SELECT doc_id, page_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: {_base('x')}), lambda x: x <> '') AS ls FROM p),
e AS (SELECT doc_id, page_id, list_distinct(list_concat(ls[1:2], ls[greatest(len(ls) - 1, 1):len(ls)])) AS w FROM a),
m AS (SELECT doc_id, regexp_replace(l, '\p{{Nd}}+', '#', 'g') AS mask FROM (SELECT doc_id, unnest(w) AS l FROM e) WHERE length(l) <= 90),
n AS (SELECT doc_id, count(*) AS pages FROM p GROUP BY 1 HAVING count(*) >= 4),
noise AS (SELECT doc_id, mask, count(*) AS hits FROM m JOIN n USING (doc_id) GROUP BY doc_id, mask, pages HAVING count(*) >= greatest(4, floor(pages * 0.6)))"""
_sql["header_footer_lines"] = f"WITH {_NOISE} SELECT doc_id, mask, hits FROM noise"


@query
def normalize_pages(spark, sf_dir):
    return pages.normalized(_pages(spark, sf_dir)).select("page_id", "text").distinct()


_sql["normalize_pages"] = rf"""
WITH {_NOISE},
g AS (SELECT doc_id, page_id, regexp_replace(translate(coalesce(text, ''), chr(160) || chr(8209), ' -'), '([\pL\pN\pM_])-\n([\pL\pN\pM_])', '\1\2', 'g') AS t FROM p),
l AS (SELECT doc_id, page_id, list_transform(string_split(t, chr(10)), lambda x: {_base('x')}) AS ls FROM g),
u AS (SELECT doc_id, page_id, unnest(ls) AS x, generate_subscripts(ls, 1) AS i FROM l),
r AS (SELECT *, row_number() OVER (PARTITION BY page_id, x = '' ORDER BY i) AS up, row_number() OVER (PARTITION BY page_id, x = '' ORDER BY i DESC) AS down FROM u),
k AS (SELECT r.* FROM r LEFT JOIN noise o ON o.doc_id = r.doc_id AND o.mask = regexp_replace(x, '\p{{Nd}}+', '#', 'g')
  WHERE x = '' OR (o.mask IS NULL AND NOT regexp_matches(x, '(?i)^(стр\.?|страница|page){S}*\p{{Nd}}+({S}*(из|/|of){S}*\p{{Nd}}+)?$')
    AND NOT (regexp_matches(x, '^[-–—(\[]?{S}*\p{{Nd}}{{1,4}}{S}*[-–—)\]]?$') AND (up <= 2 OR down <= 2)))),
j AS (SELECT page_id, string_agg(x, chr(10) ORDER BY i) AS t FROM k GROUP BY page_id)
SELECT p.page_id, {_strip("regexp_replace(coalesce(t, ''), '\\n{3,}', chr(10) || chr(10), 'g')")} AS text FROM p LEFT JOIN j USING (page_id)"""


@query
def reflow_islands(spark, sf_dir):
    return _pages(spark, sf_dir).where("text IS NOT NULL").select("page_id", pages.reflow(F.col("text")).alias("text")).distinct()


_sql["reflow_islands"] = rf"""
WITH l AS (SELECT page_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS i, len(string_split(text, chr(10))) AS n FROM ({PAGES}) WHERE text IS NOT NULL),
s AS (SELECT page_id, i, {_strip('raw')} AS x FROM l WHERE NOT (i = n AND raw = '')),
g AS (SELECT *, lag(x) OVER w AS p FROM s WINDOW w AS (PARTITION BY page_id ORDER BY i)),
b AS (SELECT *, CASE WHEN p IS NULL THEN '' WHEN p <> '' AND x <> '' AND NOT contains(p, '|') AND NOT contains(x, '|') AND NOT regexp_matches(p, '[.!?;:]$')
  AND NOT regexp_matches(x, '(?i)^(\p{{Nd}}+(\.\p{{Nd}}+)+\.?{S}|\p{{Nd}}+[.)]{S}|[-•–—*]{S}|\[\[стр\.|\[ТАБЛИЦА\]|Этап{S}|Раздел{S}|Приложение{S})') THEN ' ' ELSE chr(10) END AS sep FROM g)
SELECT p.page_id, coalesce(string_agg(sep || x, '' ORDER BY i), '') AS text FROM (SELECT DISTINCT page_id FROM pages WHERE text IS NOT NULL) p LEFT JOIN b USING (page_id) GROUP BY p.page_id"""


@query
def squeeze_text(spark, sf_dir):
    return _requirements(spark, sf_dir).where("text IS NOT NULL").select("req_id", T.squeeze(T.strip_markers(F.col("text"))).alias("text")).distinct()


_sql["squeeze_text"] = f"SELECT DISTINCT req_id, {_squeeze('text')} AS text FROM requirements WHERE text IS NOT NULL"


@query
def marked_text(spark, sf_dir):
    return pages.marked_text(_pages(spark, sf_dir)).select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"), F.length("text").alias("chars"))


_sql["marked_text"] = f"""
SELECT doc_id, md5(t) AS digest, length(t) AS chars FROM (SELECT doc_id, string_agg('[[стр. ' || page_no || ']]' || chr(10) || text, chr(10) || chr(10) ORDER BY page_no, page_id) AS t
  FROM ({PAGES}) WHERE {_strip("coalesce(text, '')")} <> '' GROUP BY doc_id)"""


# tokens


@query
def sentence_split(spark, sf_dir):
    return tokens.sentences(_pages(spark, sf_dir).where("text IS NOT NULL"), "page_id").select("page_id", "sent_no", "text").distinct()


_SENTENCES = rf"""string_split(regexp_replace(regexp_replace(text, '([.;!?]){S}+([А-ЯA-Z0-9«(])', '\1' || chr(1) || '\2', 'g'), '\n+', chr(1), 'g'), chr(1))"""
_sql["sentence_split"] = f"""
SELECT page_id, unnest({_SENTENCES}) AS text, generate_subscripts({_SENTENCES}, 1) - 1 AS sent_no FROM ({PAGES}) WHERE text IS NOT NULL"""


@query
def line_offsets(spark, sf_dir):
    return tokens.lines(_pages(spark, sf_dir), "page_id").distinct()


_sql["line_offsets"] = f"""
WITH l AS (SELECT page_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS i, len(string_split(text, chr(10))) AS n FROM ({PAGES}) WHERE text IS NOT NULL)
SELECT page_id, i - 1 AS line_no, CAST(coalesce(sum(length(raw) + 1) OVER (PARTITION BY page_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS pos, {_strip('raw')} AS text
FROM l QUALIFY NOT (i = n AND raw = '')"""


@query
def table_rows(spark, sf_dir):
    return tokens.table_rows(_pages(spark, sf_dir), "page_id").select("page_id", "line_no", F.size("cells").alias("n_cells"), F.array_join("cells", "¦").alias("cells")).distinct()


_sql["table_rows"] = f"""
WITH l AS (SELECT page_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM ({PAGES}) WHERE text IS NOT NULL)
SELECT page_id, line_no, len(string_split(raw, '|')) AS n_cells, array_to_string(list_transform(string_split({_strip('raw')}, '|'), lambda x: {_strip('x')}), '¦') AS cells FROM l WHERE contains(raw, '|')"""


@query
def first_keyword_sentence(spark, sf_dir):
    return tokens.first_sentence_with(_pages(spark, sf_dir), "page_id", ["срок"]).distinct()


_sql["first_keyword_sentence"] = f"""
SELECT page_id, list_filter({_SENTENCES}, lambda s: contains(lower(s), 'срок'))[1] AS text FROM ({PAGES})
WHERE text IS NOT NULL AND len(list_filter({_SENTENCES}, lambda s: contains(lower(s), 'срок'))) > 0"""


@query
def page_asof_lookup(spark, sf_dir):
    """Page of each table of a chunk, by the markers before it."""
    c = read(spark, sf_dir, "chunks").select("chunk_id", "text").distinct()
    lines = tokens.lines(c, "chunk_id")
    marks = lines.where(F.col("text").rlike(r"^\[\[стр\. \d+\]\]")).select("chunk_id", "pos", F.regexp_extract("text", R.MARKER, 1).cast("int").alias("page_no"))
    return tokens.page_of(lines.where(~F.col("text").startswith("[[стр.")).select("chunk_id", "pos"), marks, doc="chunk_id").groupBy("chunk_id", "page_no").agg(F.count("*").alias("lines"))


_sql["page_asof_lookup"] = r"""
WITH l AS (SELECT chunk_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS i, len(string_split(text, chr(10))) AS n FROM (SELECT DISTINCT chunk_id, text FROM chunks)),
o AS (SELECT chunk_id, raw, i, n, coalesce(sum(length(raw) + 1) OVER (PARTITION BY chunk_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM l QUALIFY NOT (i = n AND raw = '')),
k AS (SELECT chunk_id, pos, CAST(regexp_extract(raw, '\[\[стр\. (\d+)\]\]', 1) AS INT) AS page_no FROM o WHERE regexp_matches(trim(raw), '^\[\[стр\. \d+\]\]'))
SELECT x.chunk_id, k.page_no, count(*) AS lines FROM (SELECT * FROM o WHERE NOT starts_with(trim(raw), '[[стр.')) x ASOF LEFT JOIN k ON x.chunk_id = k.chunk_id AND x.pos >= k.pos GROUP BY 1, 2"""


# chunks


@query
def hard_cut_blocks(spark, sf_dir):
    """Texts without paragraphs cut every 1,000 characters by the page splitter."""
    d = _docs(spark, sf_dir).where("text IS NOT NULL").select("doc_id", F.regexp_replace("text", r"\s+", " ").alias("text")).where(F.length("text") > 1000)
    return chunks.block_rows(d, "doc_id", limit=1000).select("doc_id", "block_no", F.length("text").alias("chars"), F.md5(F.col("text").cast("binary")).alias("digest"))


_sql["hard_cut_blocks"] = r"""
WITH d AS (SELECT doc_id, regexp_replace(text, '[\s\x{0b}]+', ' ', 'g') AS t FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CAST(k AS INT) AS block_no, length(substring(t, k * 1000 + 1, 1000)) AS chars, md5(substring(t, k * 1000 + 1, 1000)) AS digest
FROM (SELECT doc_id, t, unnest(range(0, CAST(ceil(length(t) / 1000.0) AS BIGINT))) AS k FROM d WHERE length(t) > 1000)"""


@query
def chunk_pack(spark, sf_dir):
    return chunks.packed(_pages(spark, sf_dir)).select("doc_id", "chunk_idx", "first_page", "last_page", F.length("text").alias("chars"))


@query
def overlap_tail(spark, sf_dir):
    return _pages(spark, sf_dir).where("text IS NOT NULL").select("page_id", T.overlap_tail(F.col("text"), F.lit(200)).alias("tail")).distinct()


_sql["overlap_tail"] = f"""
WITH t AS (SELECT page_id, text, right(text, 200) AS r FROM ({PAGES}) WHERE text IS NOT NULL)
SELECT page_id, CASE WHEN length(text) <= 200 THEN '' ELSE {_strip('''CASE WHEN instr(r, chr(10) || chr(10)) > 0 THEN substring(r, instr(r, chr(10) || chr(10)) + 2)
  WHEN instr(r, chr(10)) > 0 THEN substring(r, instr(r, chr(10)) + 1) WHEN instr(r, '. ') > 0 THEN substring(r, instr(r, '. ') + 2) ELSE r END''')} END AS tail FROM t"""


@query
def relevance_score(spark, sf_dir):
    return _pages(spark, sf_dir).where("text IS NOT NULL").select("page_id", F.round(T.relevance(F.col("text")), 2).alias("score")).distinct()


_RUB = r"(\p{Nd}{1,3}([ \x{a0}]\p{Nd}{3})+([.,]\p{Nd}{1,2})?|\p{Nd}+([.,]\p{Nd}{1,2})?)" + S + r"*(\([^)]{0,300}\)" + S + r"*)?(тыс\.?|млн\.?|миллион[\pL\pN_]*|тысяч[\pL\pN_]*)?" + S + r"*(руб(\.|лей|ля|ль)?|₽|RUB)"
_sql["relevance_score"] = (
    "SELECT page_id, round("
    + " + ".join(f"{v} * least((length(lower(text)) - length(replace(lower(text), '{w}', ''))) / {len(w)}.0, 3)" for w, v in R.RELEVANCE.items())
    + rf" + CASE WHEN regexp_matches(text, '(?i){_RUB}') THEN 2 ELSE 0 END + CASE WHEN regexp_matches(text, '(^|[^\pL\pN\pM_])\p{{Nd}}{{2}}\.\p{{Nd}}{{2}}\.\p{{Nd}}{{4}}([^\pL\pN\pM_]|$)') THEN 1 ELSE 0 END, 2) AS score FROM ({PAGES}) WHERE text IS NOT NULL"
)


@query
def chunk_topk(spark, sf_dir):
    c = read(spark, sf_dir, "chunks").select("doc_id", "chunk_id", "chunk_idx", "score").distinct()
    return chunks.selected(c, max_chunks=3).select("doc_id", "chunk_id")


_sql["chunk_topk"] = """
SELECT doc_id, chunk_id FROM (SELECT DISTINCT doc_id, chunk_id, chunk_idx, score FROM chunks)
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY (chunk_idx = 0) DESC, score DESC NULLS LAST, chunk_idx) <= 3"""


@query
def chunk_labels(spark, sf_dir):
    c = read(spark, sf_dir, "chunks").select("chunk_id", "first_page", "last_page").distinct()
    return c.select("chunk_id", T.chunk_label(F.col("first_page"), F.col("last_page")).alias("label"))


_sql["chunk_labels"] = "SELECT DISTINCT chunk_id, 'стр. ' || first_page || CASE WHEN first_page = last_page THEN '' ELSE '–' || last_page END AS label FROM chunks"

# scalars


@query
def money_roundtrip(spark, sf_dir):
    """Order totals written as grouped Russian amounts with or without scale and tax, and read again."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"))
    grouped = F.translate(F.format_number((F.col("cents") / 100).cast("decimal(18,2)"), 2), ",.", "\xa0,")
    k = F.col("o_orderkey") % 4
    text = F.concat(F.lit("Начальная цена контракта составляет "), F.when(k == 3, F.concat((F.col("cents") % 1000).cast("string"), F.lit(" тыс. руб."))).otherwise(F.concat(grouped, F.lit(" рублей"))), F.when(k == 0, ", включая НДС 20 %").when(k == 1, " без НДС").otherwise(""), F.lit(". Прочее."))
    read_again = o.withColumn("text", text).select("o_orderkey", T.first_money(F.col("text")).alias("m"), F.size(T.money_list(F.col("text"))).alias("found"))
    return read_again.select("o_orderkey", F.round(F.col("m.amount") * 100).cast("bigint").alias("cents"), F.col("m.includes_vat").alias("vat"), "found")


_sql["money_roundtrip"] = """
SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN (CAST(round(o_totalprice * 100) AS BIGINT) % 1000) * 100000 ELSE CAST(round(o_totalprice * 100) AS BIGINT) END AS cents,
  CASE WHEN o_orderkey % 4 = 0 THEN true WHEN o_orderkey % 4 = 1 THEN false END AS vat, 1 AS found FROM orders"""


@query
def money_multiplier(spark, sf_dir):
    """Amounts in roubles, thousands, millions and with a numeral of words, read as numbers."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 900 + 1).alias("n"), (F.col("o_custkey") % 4).alias("k"))
    text = F.concat(F.lit("Итого "), F.col("n"), F.when(F.col("k") == 0, " руб.").when(F.col("k") == 1, " тыс. руб.").when(F.col("k") == 2, " млн рублей").otherwise(",5 миллиона рублей"))
    return o.select("o_orderkey", F.round(T.first_money(text)["amount"]).cast("bigint").alias("amount"))


_sql["money_multiplier"] = """
SELECT o_orderkey, CAST(CASE o_custkey % 4 WHEN 0 THEN n WHEN 1 THEN n * 1000 WHEN 2 THEN n * 1000000 ELSE n * 1000000 + 500000 END AS BIGINT) AS amount
FROM (SELECT o_orderkey, o_custkey, o_orderkey % 900 + 1 AS n FROM orders)"""


@query
def vat_flag(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 5).alias("k"), F.col("o_custkey").alias("n"))
    notes = F.when(F.col("k") == 0, ", включая НДС 20 %").when(F.col("k") == 1, " с учётом НДС").when(F.col("k") == 2, " без учета НДС").when(F.col("k") == 3, ", НДС не облагается").otherwise(", кроме налога")
    return o.select("o_orderkey", T.first_money(F.concat(F.lit("Цена "), F.col("n"), F.lit(" руб."), notes))["includes_vat"].alias("vat"))


_sql["vat_flag"] = "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN false WHEN 3 THEN false END AS vat FROM orders"


@query
def textual_date_roundtrip(spark, sf_dir):
    months = F.array(*[F.lit(x) for x in R.MONTHS])
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("d"))
    text = F.concat(F.lit("Срок: не позднее "), F.dayofmonth("d"), F.lit(" "), F.element_at(months, F.month("d")), F.lit(" "), F.year("d"), F.lit(" г. включительно"))
    return o.select("o_orderkey", T.text_date(text).alias("day"))


_sql["textual_date_roundtrip"] = f"""
SELECT o_orderkey, day(o_orderdate) || ' ' || list_extract([{', '.join(repr(m) for m in R.MONTHS)}], CAST(month(o_orderdate) AS INT)) || ' ' || year(o_orderdate) || ' г.' AS day FROM orders"""


@query
def clause_start(spark, sf_dir):
    return _requirements(spark, sf_dir).where("text IS NOT NULL").select("req_id", T.clause_start(F.col("text")).alias("clause")).distinct()


_sql["clause_start"] = r"""SELECT DISTINCT req_id, regexp_matches(text, '^["''(]*[\p{Nd}\p{Lu}]') AS clause FROM requirements WHERE text IS NOT NULL"""


@query
def date_roundtrip(spark, sf_dir):
    months = F.array(*[F.lit(x) for x in R.MONTHS])
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("d"))
    text = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("в срок до "), F.date_format("d", "dd.MM.yyyy"), F.lit(" включительно"))).otherwise(F.concat(F.lit("до «"), F.dayofmonth("d"), F.lit("» "), F.element_at(months, F.month("d")), F.lit(" "), F.year("d"), F.lit(" года")))
    found = T.any_date(F.col("t"))
    back = F.coalesce(F.to_date(F.when(found.rlike(r"^\d\d\."), found), "dd.MM.yyyy"), F.make_date(F.regexp_extract(found, r" (\d{4})", 1).try_cast("int"), F.array_position(months, F.regexp_extract(found, r"» (\S+) ", 1)).cast("int"), F.regexp_extract(found, r"«(\d+)»", 1).try_cast("int")))
    return o.withColumn("t", text).select("o_orderkey", F.date_format(back, "yyyy-MM-dd").alias("day"))


_sql["date_roundtrip"] = "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders"


@query
def duration_roundtrip(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("int").alias("q"))
    text = F.concat(F.lit("Работы выполняются в течение "), F.col("q"), F.when(F.col("l_linenumber") % 2 == 0, " (прописью) календарных дней").otherwise(" месяцев"), F.lit(" с даты подписания."))
    return li.select("l_orderkey", "l_linenumber", T.duration_phrase(text).alias("duration"))


_sql["duration_roundtrip"] = "SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INT) || CASE WHEN l_linenumber % 2 = 0 THEN ' календарных дней' ELSE ' месяцев' END AS duration FROM lineitem"


@query
def formula_percent(spark, sf_dir):
    return tokens.lines(_pages(spark, sf_dir), "page_id").select("page_id", "line_no", T.formula(F.col("text")).alias("formula")).where("formula IS NOT NULL").distinct()


_sql["formula_percent"] = rf"""
WITH l AS (SELECT page_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM ({PAGES}) WHERE text IS NOT NULL),
f AS (SELECT page_id, line_no, regexp_extract({_strip('raw')}, '(\p{{Nd}}+{S}*/{S}*\p{{Nd}}+|\p{{Nd}}+([.,]\p{{Nd}}+)?{S}*%)[^.;\n]{{0,140}}') AS f FROM l)
SELECT page_id, line_no, {_squeeze('f')} AS formula FROM f WHERE f <> ''"""


@query
def long_number_token(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    text = F.concat(F.lit("Закупка № "), F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("АБ-"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0"))).otherwise(F.lpad(F.col("o_orderkey").cast("string"), 19, "1")), F.lit(" от 2026 г."))
    return o.select("o_orderkey", T.procurement_number(text).alias("number"))


_sql["long_number_token"] = "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'АБ-' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0') ELSE lpad(CAST(o_orderkey AS VARCHAR), 19, '1') END AS number FROM orders"


@query
def category_case(spark, sf_dir):
    r = _requirements(spark, sf_dir).where("text IS NOT NULL")
    return r.select("req_id", T.category(F.col("text")).alias("by_text"), T.known_category(F.col("category")).alias("stated"), T.mandatory(F.col("text")).alias("mandatory")).distinct()


def _stem(words: list[str]) -> str:
    return r"(?i)(^|[^\pL\pN\pM_])(" + "|".join(words) + ")"


_sql["category_case"] = (
    "SELECT DISTINCT req_id, CASE " + " ".join(f"WHEN regexp_matches(text, '{_stem(w)}') THEN '{c}'" for c, w in R.CATEGORY_RULES) + " ELSE 'other' END AS by_text, "
    f"CASE WHEN lower(trim(category)) IN ({', '.join(repr(c) for c in R.CATEGORIES)}) THEN lower(trim(category)) ELSE 'other' END AS stated, NOT regexp_matches(text, '{_stem(R.OPTIONAL_MARKERS)}') AS mandatory FROM requirements WHERE text IS NOT NULL"
)


@query
def sanction_case(spark, sf_dir):
    s = tokens.sentences(_pages(spark, sf_dir).where("text IS NOT NULL"), "page_id")
    return s.select("page_id", "sent_no", T.sanction(F.col("text")).alias("sanction"), T.clause_start(F.col("text")).alias("clause")).where(F.col("sanction") != R.SANCTION_DEFAULT).distinct()


_sql["sanction_case"] = (
    f"WITH s AS (SELECT page_id, unnest({_SENTENCES}) AS text, generate_subscripts({_SENTENCES}, 1) - 1 AS sent_no FROM ({PAGES}) WHERE text IS NOT NULL), c AS (SELECT page_id, sent_no, CASE "
    + " ".join(f"WHEN regexp_matches(text, '{_stem(w)}') THEN '{c}'" for c, w in R.SANCTION_RULES)
    + r""" END AS sanction, regexp_matches(text, '^["''(]*[\p{Nd}\p{Lu}]') AS clause FROM s) SELECT * FROM c WHERE sanction IS NOT NULL"""
)


@query
def dedupe_first_wins(spark, sf_dir):
    r = _requirements(spark, sf_dir).where(F.length("text") > 0)
    return merging.unique_texts(r.select("doc_id", "req_id", "text"), "doc_id", text="text", order=["req_id"]).select("doc_id", "req_id")


_sql["dedupe_first_wins"] = f"""
SELECT doc_id, req_id FROM (SELECT DISTINCT doc_id, req_id, regexp_replace(lower({_strip('text')}), '[^a-zа-яё0-9]+', '', 'g') AS k FROM requirements WHERE text IS NOT NULL) WHERE k <> ''
QUALIFY row_number() OVER (PARTITION BY doc_id, k ORDER BY req_id) = 1"""


@query
def label_value(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    text = F.concat(F.lit("Раздел 1. ПРЕДМЕТ ЗАКУПКИ: поставка изделия "), F.col("p_name"), F.lit(" марки "), F.col("p_brand"), F.lit(". Срок поставки: до 01.02.2026."))
    return p.select("p_partkey", facts.subject(text).alias("subject"))


_sql["label_value"] = "SELECT p_partkey, 'поставка изделия ' || p_name || ' марки ' || p_brand AS subject FROM part"


@query
def party_name(spark, sf_dir):
    s = read(spark, sf_dir, "supplier")
    text = F.concat(F.lit("Участник: любой. Заказчик: "), F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("ГБУ «"), F.col("s_name"), F.lit("»"))).otherwise(F.concat(F.lit("учреждение "), F.col("s_name"), F.lit("."))), F.lit("\nАдрес: г. Москва"))
    return s.select("s_suppkey", facts.customer(text).alias("customer"))


_sql["party_name"] = "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN '«' || s_name || '»' ELSE 'учреждение ' || s_name END AS customer FROM supplier"

# facts of documents


@query
def nearest_money_forward(spark, sf_dir):
    return facts.nearest_money(_pages(spark, sf_dir), ["начальная цена", "штраф за"], key="page_id").select("page_id", F.round("amount", 2).alias("amount"), "distance").distinct()


def _places(pattern: str, text: str, found: str) -> str:
    """SQL list of the 0-based places of the matches `found` (a list column) of a pattern in a text."""
    gaps = f"string_split_regex({text}, '{pattern}')"
    return f"list_transform(range(1, len({found}) + 1), lambda i: CAST(list_sum(list_transform({gaps}[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform({found}[1:i-1], lambda x: length(x))), 0) AS BIGINT))"


def _occurrences(words: list[str]) -> str:
    """SQL: page_id, ord, pos of each word in the lower-cased text."""
    one = lambda i, w: f"SELECT page_id, {i} AS ord, unnest(list_transform(range(1, len(s)), lambda i: CAST(list_sum(list_transform(s[1:i], lambda x: length(x))) + (i - 1) * {len(w)} AS BIGINT))) AS pos FROM (SELECT page_id, string_split(lower(text), '{w}') AS s FROM p)"
    return " UNION ALL ".join(one(i, w) for i, w in enumerate(words))


_NUMBER = rf"regexp_extract(raw, '(?i){_RUB}', 1)"
_sql["nearest_money_forward"] = rf"""
WITH p AS (SELECT page_id, text FROM ({PAGES}) WHERE text IS NOT NULL), o AS ({_occurrences(["начальная цена", "штраф за"])}),
f AS (SELECT page_id, text, regexp_extract_all(text, '(?i){_RUB}') AS found FROM p), m AS (SELECT page_id, unnest(found) AS raw, unnest({_places('(?i)' + _RUB, 'text', 'found')}) AS mpos FROM f WHERE len(found) > 0),
v AS (SELECT page_id, mpos, TRY_CAST(replace(regexp_replace({_NUMBER}, '[ \x{{a0}}]', '', 'g'), ',', '.') AS DOUBLE) * CASE WHEN regexp_matches(lower(regexp_extract(raw, '(?i){_RUB}', 6)), '^(млн|миллион)') THEN 1e6 WHEN lower(regexp_extract(raw, '(?i){_RUB}', 6)) LIKE 'тыс%' THEN 1e3 ELSE 1 END AS amount FROM m)
SELECT page_id, round(arg_min(struct_pack(a := amount), struct_pack(d := mpos - pos, ord := ord, pos := pos, mpos := mpos)).a, 2) AS amount, CAST(min(mpos - pos) AS INT) AS distance
FROM o JOIN v USING (page_id) WHERE mpos >= pos AND mpos <= pos + 400 GROUP BY page_id"""


@query
def phrase_near(spark, sf_dir):
    return facts.phrase_near(_pages(spark, sf_dir), ["осуществляется до", "утверждена"], key="page_id").distinct()


_W = r"[\pL\pN\pM_]"
_sql["phrase_near"] = rf"""
WITH p AS (SELECT page_id, text FROM ({PAGES}) WHERE text IS NOT NULL), o AS ({_occurrences(["осуществляется до", "утверждена"])}),
w AS (SELECT page_id, ord, pos, substring(text, pos + 1, 300) AS w FROM o JOIN p USING (page_id)),
v AS (SELECT page_id, ord, pos, coalesce(nullif(regexp_extract(w, '(?:^|[^\pL\pN\pM_])(\p{{Nd}}{{2}}\.\p{{Nd}}{{2}}\.\p{{Nd}}{{4}})(?:[^\pL\pN\pM_]|$)', 1), ''),
  nullif(regexp_extract(w, '(?i)«?\p{{Nd}}{{1,2}}»?{S}+({'|'.join(R.MONTHS)}){S}+\p{{Nd}}{{4}}{S}*(г\.?|года)?'), ''),
  nullif({_squeeze(r"regexp_replace(string_split_regex(w, '[.;\n]')[1], '\[\[стр\.' || '" + S + r"*\p{Nd}+\]\]', ' ', 'g')")}, '')) AS value FROM w)
SELECT page_id, arg_min(value, struct_pack(ord := ord, pos := pos)) AS value FROM v WHERE value IS NOT NULL GROUP BY page_id"""


@query
def best_duration(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 300 + 1).alias("q"))
    text = F.concat(F.lit("Гарантия действует в течение 99 месяцев. Срок выполнения работ составляет "), F.col("q"), F.lit(" календарных дней. Проектные решения готовят в течение 7 рабочих дней."))
    return facts.duration_of(o.select("o_orderkey", text.alias("text")), key="o_orderkey").select("o_orderkey", "duration")


_sql["best_duration"] = "SELECT o_orderkey, (o_custkey % 300 + 1) || ' календарных дней' AS duration FROM orders"


@query
def stages(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    line = F.concat(F.lit("Этап "), F.col("l_linenumber"), F.lit(": работы до "), F.date_format("l_shipdate", "dd.MM.yyyy"), F.lit(";"))
    docs = li.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", line.alias("t")))), lambda x: x["t"]), "\n").alias("text"))
    return facts.stages(docs, key="l_orderkey").select("l_orderkey", "stage_no", "name", "deadline")


_sql["stages"] = """
SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS stage_no, 'Этап ' || l_linenumber AS name, min(strftime(l_shipdate, '%d.%m.%Y')) AS deadline
FROM lineitem GROUP BY l_orderkey, l_linenumber"""


@query
def requirements_extract(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    text = F.concat(F.lit("1. Общие положения.\nТребования к участникам закупки\nУчастник обязан иметь опыт поставки изделий "), F.col("p_brand"), F.lit(" не менее 3 лет.\nЖелательно наличие лицензии на изделия "), F.col("p_brand"), F.lit(".\nОтветственность сторон\nШтраф за просрочку должен быть уплачен немедленно и полностью."))
    return facts.requirements(p.select("p_partkey", text.alias("text")), key="p_partkey").select("p_partkey", "req_no", "category", "mandatory")


_sql["requirements_extract"] = "SELECT p_partkey, n AS req_no, CASE n WHEN 1 THEN 'experience' ELSE 'license' END AS category, n = 1 AS mandatory FROM part, (VALUES (1), (2)) v(n)"


@query
def penalties_extract(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"))
    grouped = F.translate(F.format_number((F.col("cents") / 100).cast("decimal(18,2)"), 2), ",.", " ,")
    text = F.concat(F.lit("Нарушение | Мера ответственности | Размер\nСрыв срока работ | Штраф | "), grouped, F.lit(" руб.\nЗа просрочку начисляется пеня 0,1 % за каждый день просрочки.\nСумма пени не может превышать цену контракта по заказу."))
    return facts.penalties(o.select("o_orderkey", text.alias("text")), key="o_orderkey").select("o_orderkey", "pen_no", "sanction", F.round(F.col("amount") * 100).cast("bigint").alias("cents"), "formula")


_sql["penalties_extract"] = """
SELECT o_orderkey, 1 AS pen_no, 'Штраф' AS sanction, CAST(round(o_totalprice * 100) AS BIGINT) AS cents, NULL AS formula FROM orders
UNION ALL SELECT o_orderkey, 2, 'Пеня', NULL, '0,1 % за каждый день просрочки' FROM orders"""


@query
def page_penalties(spark, sf_dir):
    return facts.penalties(_pages(spark, sf_dir), key="page_id").groupBy("sanction").agg(F.count("*").alias("n"), F.count("amount").alias("with_amount"))


# provider, replies


@query
def token_usage(spark, sf_dir):
    calls = read(spark, sf_dir, "llm_results").select("call_id", "source", "prompt_tokens", "completion_tokens").distinct()
    return merging.token_usage(calls, "source")


_sql["token_usage"] = """
SELECT source, count(*) AS calls, sum(nullif(prompt_tokens, 0)) AS prompt_tokens, sum(nullif(completion_tokens, 0)) AS completion_tokens
FROM (SELECT DISTINCT call_id, source, prompt_tokens, completion_tokens FROM llm_results) GROUP BY source"""


def _answers(user: str, attempt: int) -> str:
    if "%" in user and attempt == 1:
        raise provider.ProviderError("status 503", True)
    if "жалобу" in user:
        raise provider.ProviderError("status 400", False)
    return '{"warnings": []}'


@query
def provider_failures(spark, sf_dir):
    c = read(spark, sf_dir, "chunks").select("doc_id", "chunk_id", "chunk_idx", "text", "first_page", "last_page").distinct()
    done = provider.called(c, lambda: provider.Scripted(_answers), wait=lambda n: 0.0, concurrency=8)
    return done.groupBy("failure", "attempts").agg(F.count("*").alias("calls"))


_sql["provider_failures"] = """
WITH c AS (SELECT DISTINCT doc_id, chunk_id, chunk_idx, text, first_page, last_page FROM chunks)
SELECT CASE WHEN contains(text, 'жалобу') THEN 'status 400' END AS failure, CASE WHEN contains(text, '%') THEN 2 ELSE 1 END AS attempts, count(*) AS calls FROM c GROUP BY 1, 2"""


@query
def json_repair(spark, sf_dir):
    calls = read(spark, sf_dir, "llm_results").select("call_id", "source", "text").distinct()
    return jsonrepair.repair(calls, "call_id", "source").groupBy("source").agg(F.count("*").alias("replies"), F.count("json").alias("objects"))


@query
def json_repair_roundtrip(spark, sf_dir):
    """Properties of events damaged in six ways and repaired."""
    e = read(spark, sf_dir, "events").select("event_id", "event_type", F.round(F.col("value") * 100).cast("bigint").alias("v"))
    whole = F.concat(F.lit('{"kind": "'), F.col("event_type"), F.lit('", "value": '), F.col("v"), F.lit(', "ok": true}'))
    k = F.col("event_id") % 6
    raw = (
        F.when(k == 0, F.concat(F.lit("```json\n"), whole, F.lit("\n```"))).when(k == 1, F.concat(F.lit("Ответ: "), whole, F.lit(" Готово.")))
        .when(k == 2, F.replace(whole, F.lit("true}"), F.lit("true,}"))).when(k == 3, F.replace(whole, F.lit("true"), F.lit("True")))
        .when(k == 4, F.concat(F.lit("[1, "), whole, F.lit("]"))).otherwise(F.replace(whole, F.lit("}"), F.lit(""))))
    fixed = jsonrepair.repair(e.select("event_id", raw.alias("text")), "event_id")
    return fixed.select("event_id", F.get_json_object("json", "$.kind").alias("kind"), F.get_json_object("json", "$.value").cast("bigint").alias("v"))


_sql["json_repair_roundtrip"] = "SELECT event_id, event_type AS kind, CAST(round(value * 100) AS BIGINT) AS v FROM events"


@query
def json_validate(spark, sf_dir):
    calls = read(spark, sf_dir, "llm_results").select("call_id", "source", "text").distinct()
    return jsonrepair.validated(jsonrepair.repair(calls, "call_id", "source")).groupBy("source", F.coalesce("fault", F.lit("valid")).alias("fault")).agg(F.count("*").alias("replies"))


@query
def json_fields(spark, sf_dir):
    calls = read(spark, sf_dir, "llm_results").select("call_id", "text").distinct()
    return jsonrepair.fields(jsonrepair.repair(calls, "call_id")).drop("json")


@query
def json_fields_roundtrip(spark, sf_dir):
    """Fields of objects rendered from orders, amounts in four notations."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"), (F.col("o_custkey") % 4).alias("k"))
    plain = (F.col("cents") / 100).cast("decimal(18,2)").cast("string")
    grouped = F.format_number((F.col("cents") / 100).cast("decimal(18,2)"), 2)
    amount = F.when(F.col("k") == 0, plain).when(F.col("k") == 1, F.concat(F.lit('"'), F.translate(grouped, ",.", " ,"), F.lit('"'))).when(F.col("k") == 2, F.concat(F.lit('"'), F.translate(grouped, ",.", ".,"), F.lit('"'))).otherwise(F.concat(F.lit('"'), grouped, F.lit('"')))
    text = F.concat(F.lit('{"subject": " Заказ '), F.col("o_orderkey"), F.lit(' ", "contract_price": {"amount": '), amount, F.lit('}, "requirements": [{"text": "a"}, {"text": "b"}], "confidence": "0.5"}'))
    done = jsonrepair.fields(jsonrepair.repair(o.select("o_orderkey", text.alias("text")), "o_orderkey"))
    return done.select("o_orderkey", "subject", F.round(F.col("price") * 100).cast("bigint").alias("cents"), "n_requirements", "n_penalties", "confidence")


_sql["json_fields_roundtrip"] = "SELECT o_orderkey, 'Заказ ' || o_orderkey AS subject, CAST(round(o_totalprice * 100) AS BIGINT) AS cents, 2 AS n_requirements, 0 AS n_penalties, 0.5::DOUBLE AS confidence FROM orders"

_FAULTS = [
    ('{"requirements": [{"text": "a"}], "confidence": 1}', None), ("no object at all", "no object"), ('{"requirements": null}', "requirements is null"), ('{"penalties": {"violation": "a"}}', "penalties is no list"),
    ('{"deadlines": null}', "deadlines is null"), ('{"requirements": [{"text": "a"}, {"category": "other"}]}', "requirements without text"), ('{"penalties": [{"violation": "a"}]}', "penalties without sanction"), ('{"confidence": 1.5}', "confidence out of range"),
]


@query
def json_validate_roundtrip(spark, sf_dir):
    """Objects that break one rule of the schema each, or none."""
    e = read(spark, sf_dir, "events").select("event_id")
    text = F.element_at(F.array(*[F.lit(x) for x, _ in _FAULTS]), (F.col("event_id") % len(_FAULTS) + 1).cast("int"))
    return jsonrepair.validated(jsonrepair.repair(e.select("event_id", text.alias("text")), "event_id")).select("event_id", "fault", "valid")


_sql["json_validate_roundtrip"] = f"""
SELECT event_id, f AS fault, f IS NULL AS valid FROM (SELECT event_id, list_extract([{', '.join('NULL' if f is None else repr(f) for _, f in _FAULTS)}], CAST(event_id % {len(_FAULTS)} + 1 AS INT)) AS f FROM events)"""


# merge


@query
def merge_first_text(spark, sf_dir):
    r = _requirements(spark, sf_dir)
    return r.groupBy("doc_id").agg(merging.first_text(F.col("text"), F.col("req_id")).alias("text"))


_sql["merge_first_text"] = f"SELECT doc_id, arg_min({_strip('text')}, req_id) FILTER ({_strip('text')} <> '') AS text FROM requirements GROUP BY doc_id"


@query
def merge_best_money(spark, sf_dir):
    m = read(spark, sf_dir, "money_facts").select("money_id", "doc_id", "field", "amount", "raw").distinct()
    return m.groupBy("doc_id", "field").agg(merging.best_money(F.col("amount"), F.col("raw"), F.col("money_id"), F.struct("money_id", "amount")).alias("b")).select("doc_id", "field", "b.money_id", "b.amount")


_sql["merge_best_money"] = """
SELECT doc_id, field, coalesce(arg_min(money_id, money_id) FILTER (amount IS NOT NULL AND coalesce(raw, '') <> ''), arg_min(money_id, money_id) FILTER (amount IS NOT NULL)) AS money_id,
  coalesce(arg_min(amount, money_id) FILTER (amount IS NOT NULL AND coalesce(raw, '') <> ''), arg_min(amount, money_id) FILTER (amount IS NOT NULL)) AS amount
FROM (SELECT DISTINCT money_id, doc_id, field, amount, raw FROM money_facts) GROUP BY doc_id, field"""


@query
def merge_unique_texts(spark, sf_dir):
    c = read(spark, sf_dir, "chunks").select("doc_id", "chunk_id", "text").distinct()
    return merging.unique_texts(c, "doc_id", text="text", order=["chunk_id"], limit=merging.MAX_MENTIONS).select("doc_id", "chunk_id")


_sql["merge_unique_texts"] = f"""
WITH k AS (SELECT DISTINCT doc_id, chunk_id, regexp_replace(lower({_strip('left(text, 40)')}), '[^a-zа-яё0-9]+', '', 'g') AS k FROM chunks),
f AS (SELECT doc_id, k, min(chunk_id) AS chunk_id FROM k WHERE k <> '' GROUP BY 1, 2)
SELECT doc_id, chunk_id FROM f QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY chunk_id) <= 15"""


def _order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of the lines of orders, each once: lists made of them have at most seven items."""
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct()


def _partials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record for each line of an order, as replies for the chunks of a document would give them."""
    n = F.col("l_linenumber")
    none = F.lit(None)
    text = lambda x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x])
    need = lambda category, t, page: F.struct(F.lit(category).alias("category"), t.alias("text"), F.lit(True).alias("mandatory"), F.array(page.cast("int")).alias("source_pages"))
    money = F.struct((n * 100.0).alias("amount"), F.when(n % 3 == 0, text([n, " руб."])).alias("raw"))
    nothing = F.struct(none.cast("double").alias("amount"), none.cast("string").alias("raw"))
    penalty = F.struct(
        F.lit("Просрочка исполнения обязательств по заказу").alias("violation"), F.lit("Штраф").alias("sanction"), F.when(n % 2 == 0, text(["0,", n, " %"])).alias("formula"),
        F.when(n % 2 == 1, n * 10.0).alias("amount"), F.array(n.cast("int")).alias("source_pages"),
    )
    return _order_lines(spark, sf_dir).select(
        "l_orderkey", F.col("l_linenumber").cast("int").alias("chunk_idx"), F.when(n % 2 == 1, "  ").otherwise(text([" Предмет ", n])).alias("subject"), *[none.cast("string").alias(c) for c in ("customer", "procurement_number", "end", "duration")],
        F.when(n >= 3, text(["0", n, ".01.2026"])).otherwise("").alias("start"), money.alias("contract_price"), *[nothing.alias(c) for c in ("contract_security", "application_security")],
        F.array(F.lit("Срок поставки"), text(["Срок поставки, этап ", n])).alias("mentions"),
        F.array(F.struct(text(["Этап ", n]).alias("name"), text([n, " января"]).alias("deadline")), F.struct(text(["ЭТАП  ", n, "!"]).alias("name"), none.cast("string").alias("deadline"))).alias("stages"),
        F.array(need("documents", text(["Участник представляет выписку из реестра по заказу ", F.col("l_orderkey")]), n), need("other", text(["Участник обязан подтвердить опыт по позиции № ", n, " данного заказа"]), n + 10)).alias("requirements"),
        F.array(penalty).alias("penalties"), F.array(F.lit("Проверьте сроки"), F.lit("проверьте сроки!")).alias("warnings"),
    )


_LINES = "SELECT l_orderkey, list_sort(list(DISTINCT l_linenumber)) AS ns FROM lineitem GROUP BY l_orderkey"


@query
def merge_driver(spark, sf_dir):
    """Partial records of orders merged: texts, amounts, requirements with the union of their pages, limits."""
    m = merging.merged_records(_partials(spark, sf_dir), key="l_orderkey")
    shared = F.get(F.filter("requirements", lambda r: r["category"] == "documents"), F.lit(0))["source_pages"]
    return m.select("l_orderkey", "partials", "subject", F.col("contract_price").cast("bigint").alias("price"), F.size("requirements").alias("n_requirements"), F.array_join(F.transform(shared, lambda p: p.cast("string")), ",").alias("pages"), F.size("warnings").alias("n_warnings"))


_sql["merge_driver"] = f"""
SELECT l_orderkey, len(ns) AS partials, 'Предмет ' || list_min(list_filter(ns, lambda n: n % 2 = 0)) AS subject, CAST(coalesce(list_min(list_filter(ns, lambda n: n % 3 = 0)), ns[1]) * 100 AS BIGINT) AS price,
  CAST(len(ns) + 1 AS INT) AS n_requirements, array_to_string(ns, ',') AS pages, CASE WHEN len(ns) = 1 THEN 2 ELSE 1 END AS n_warnings FROM ({_LINES})"""


@query
def merge_penalties(spark, sf_dir):
    """One penalty named by all partial records of an order, some with its formula, some with its amount."""
    p = merging.merged_records(_partials(spark, sf_dir), key="l_orderkey").select("l_orderkey", F.explode("penalties").alias("p"))
    return p.select("l_orderkey", "p.formula", F.col("p.amount").cast("bigint").alias("amount"), F.array_join(F.transform("p.source_pages", lambda x: x.cast("string")), ",").alias("pages"))


_sql["merge_penalties"] = f"""
SELECT l_orderkey, '0,' || list_min(list_filter(ns, lambda n: n % 2 = 0)) || ' %' AS formula, CAST(list_min(list_filter(ns, lambda n: n % 2 = 1)) * 10 AS BIGINT) AS amount, array_to_string(ns, ',') AS pages FROM ({_LINES})"""


@query
def merge_deadlines(spark, sf_dir):
    """Start, mentions and stages of partial records: the first of each wording, whatever its marks and case."""
    m = merging.merged_records(_partials(spark, sf_dir), key="l_orderkey")
    return m.select("l_orderkey", "start", F.size("mentions").alias("n_mentions"), F.array_join(F.transform("stages", lambda x: x["name"]), ";").alias("stages"))


_sql["merge_deadlines"] = f"""
SELECT l_orderkey, '0' || list_min(list_filter(ns, lambda n: n >= 3)) || '.01.2026' AS start, CAST(len(ns) + 1 AS INT) AS n_mentions,
  CASE WHEN len(ns) = 1 THEN 'Этап ' || ns[1] || ';ЭТАП  ' || ns[1] || '!' ELSE array_to_string(list_transform(ns, lambda n: 'Этап ' || n), ';') END AS stages FROM ({_LINES})"""


@query
def fuzzy_dedupe(spark, sf_dir):
    """Requirement lists merged per document and category: a list is a document's own, so its size is bounded by it."""
    r = _requirements(spark, sf_dir).where(F.length("text") > 0)
    lists = r.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("req_id", "text", "source_pages"))).alias("x"))
    items = F.transform("x", lambda i: F.struct(i["text"].alias("text"), i["source_pages"].alias("pages")))
    kept = merging.capped(merging.fuzzy_distinct(items), merging.MAX_REQUIREMENTS)
    return lists.select("doc_id", F.size("x").alias("given"), F.size(kept).alias("kept"))


# reconcile


@query
def amount_in_text(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"))
    grouped = F.translate(F.format_number((F.col("cents") / 100).cast("decimal(18,2)"), 2), ",.", "\xa0,")
    claimed = F.when(F.col("o_orderkey") % 3 == 0, F.col("cents") / 100 + 1e9).otherwise(F.col("cents") / 100)
    return o.select("o_orderkey", T.amount_in_text(claimed, T.digits_joined(F.concat(F.lit("Цена "), grouped, F.lit(" руб.")))).alias("found"), T.same_amount(claimed, F.col("cents") / 100).alias("same"))


_sql["amount_in_text"] = "SELECT o_orderkey, o_orderkey % 3 <> 0 AS found, o_orderkey % 3 <> 0 AS same FROM orders"


@query
def reconcile_totals(spark, sf_dir):
    """Order totals as claimed against those the lines give: missing ones filled, wrong ones warned of."""
    lines = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("sum_cents"))
    o = read(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    claimed = F.when(F.col("o_orderkey") % 5 == 0, None).otherwise(F.round(F.col("o_totalprice") * 100) / 100)
    fallback = (F.col("sum_cents") / 100).cast("double")
    kept, warnings = reconcile.checked_amount(claimed, fallback, F.concat(F.lit("Цена "), F.format_string("%.2f", claimed)), "Сумма контракта", critical=True)
    return o.select("o_orderkey", F.round(kept * 100).cast("bigint").alias("cents"), F.size(warnings).alias("n_warnings"))


_sql["reconcile_totals"] = """
WITH l AS (SELECT l_orderkey, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS s FROM lineitem GROUP BY 1)
SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN s ELSE CAST(round(o_totalprice * 100) AS BIGINT) END AS cents,
  CASE WHEN o_orderkey % 5 = 0 OR (s IS NOT NULL AND abs(s / 100.0 - round(o_totalprice * 100) / 100) > 1.0) THEN 1 ELSE 0 END AS n_warnings FROM orders LEFT JOIN l ON l_orderkey = o_orderkey"""


@query
def refine_stages(spark, sf_dir):
    """Stages of orders, rendered from their lines, each stage named twice and with one that isn't work."""
    words = F.array(*[F.lit(x) for x in ("Первый", "Второй", "Третий", "Четвертый")])
    line = F.col("l_linenumber")
    ordinal = F.concat(F.coalesce(F.get(words, line - 1), line.cast("string")), F.lit(" этап"))
    day = F.date_format("l_shipdate", "dd.MM.yyyy")
    s = lambda name, deadline: F.struct(name.alias("name"), deadline.alias("deadline"))
    three = F.array(s(F.concat(F.lit("Этап "), line), F.when(line % 2 == 0, day)), s(ordinal, day), s(F.concat(F.lit("Возврат обеспечения "), line), day))
    li = read(spark, sf_dir, "lineitem").where("l_linenumber <= 4").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_shipdate").alias("l_shipdate"))
    lists = li.groupBy("l_orderkey").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", three.alias("t")))), lambda x: x["t"])).alias("x"))
    kept = lists.select("l_orderkey", reconcile.refined_stages(F.col("x")).alias("stages"), F.size(reconcile.other_stages(F.col("x"))).alias("n_mentions"))
    return kept.select("l_orderkey", "n_mentions", F.posexplode("stages").alias("stage_no", "s")).select("l_orderkey", "stage_no", "s.name", "s.deadline", "n_mentions")


_sql["refine_stages"] = """
WITH l AS (SELECT l_orderkey, l_linenumber AS n, min(l_shipdate) AS d FROM lineitem WHERE l_linenumber <= 4 GROUP BY 1, 2)
SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY n) - 1 AS INT) AS stage_no,
  CASE WHEN n % 2 = 0 THEN 'Этап ' || n ELSE CASE n WHEN 1 THEN 'Первый' ELSE 'Третий' END || ' этап' END AS name, strftime(d, '%d.%m.%Y') AS deadline,
  CAST(count(*) OVER (PARTITION BY l_orderkey) AS INT) AS n_mentions FROM l"""


@query
def refine_requirements(spark, sf_dir):
    """Lists of orders, three items for each of their lines, in the order of groups and with the limits."""
    n = F.col("l_linenumber")
    category = F.when(n == 1, "license").when(n.isin(2, 3), "documents").when(n == 7, "staff").otherwise("other")
    stem = F.when(n == 1, "Лицензия").when(n == 2, "Выписка из реестра").when(n == 3, "Форма заявки").when(n == 7, "Инженер").otherwise("Вывоз мусора")
    item = lambda r: F.struct(category.alias("category"), F.concat(stem, F.lit(" "), n, F.lit(f"/{r}")).alias("text"))
    li = _order_lines(spark, sf_dir).groupBy("l_orderkey").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", F.array(item(1), item(2), item(3)).alias("x")))), lambda y: y["x"])).alias("x"))
    return li.select("l_orderkey", F.posexplode(F.transform(reconcile.refined_requirements(F.col("x")), lambda y: y["text"])).alias("place", "text"))


_sql["refine_requirements"] = f"""
WITH l AS (SELECT DISTINCT l_orderkey, l_linenumber AS n, r FROM lineitem, (VALUES (1), (2), (3)) v(r)),
g AS (SELECT *, CASE WHEN n IN (1, 7) THEN 0 WHEN n = 2 THEN 1 WHEN n = 3 THEN 2 ELSE 3 END AS g, CASE n WHEN 1 THEN 'Лицензия' WHEN 2 THEN 'Выписка из реестра' WHEN 3 THEN 'Форма заявки' WHEN 7 THEN 'Инженер' ELSE 'Вывоз мусора' END || ' ' || n || '/' || r AS text FROM l),
k AS (SELECT * FROM g QUALIFY g < 3 OR row_number() OVER (PARTITION BY l_orderkey, g ORDER BY n, r) <= {merging.MAX_OPERATIONAL})
SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY g, n, r) - 1 AS INT) AS place, text FROM k QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY g, n, r) <= {merging.MAX_REQUIREMENTS}"""


@query
def caps_slice(spark, sf_dir):
    lists = _order_lines(spark, sf_dir).groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_linenumber")).alias("x"))
    return lists.select("l_orderkey", F.explode(merging.capped(F.col("x"), 3)).alias("kept"))


_sql["caps_slice"] = "SELECT l_orderkey, l_linenumber AS kept FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) <= 3"


@query
def refine_penalties(spark, sf_dir):
    rows = tokens.table_rows(_pages(spark, sf_dir), "page_id").where((F.size("cells") >= 3) & ~T.table_header(F.col("cells")))
    c = lambda i: F.get("cells", F.lit(i))
    return rows.select("page_id", "line_no", reconcile.monetary(c(0), c(1), T.formula(c(2)), T.first_money(c(2))["amount"]).alias("monetary")).distinct()


def _java(pattern: str) -> str:
    """A pattern of the rule pack as DuckDB reads it."""
    return "(?i)" + pattern.replace(r"\s", S).replace(r"\w", r"[\pL\pN\pM_]").replace(r"\d", r"\p{Nd}")


_sql["refine_penalties"] = rf"""
WITH l AS (SELECT page_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM ({PAGES}) WHERE text IS NOT NULL),
c AS (SELECT page_id, line_no, list_transform(string_split({_strip('raw')}, '|'), lambda x: {_strip('x')}) AS c FROM l WHERE contains(raw, '|')),
t AS (SELECT page_id, line_no, lower(c[1]) AS v, lower(c[2]) AS s, c[3] AS a, lower(array_to_string(c, ' ')) AS whole FROM c WHERE len(c) >= 3)
SELECT page_id, line_no, NOT (regexp_matches(v, '{_java(reconcile.CUSTOMER_SIDE)}') OR regexp_matches(v, '{_java(reconcile.DISCLAIMER)}') OR regexp_matches(s, '{_java(reconcile.NON_MONETARY)}'))
  AND (regexp_matches(a, '(?i){_RUB}') OR regexp_matches(a, '\p{{Nd}}+{S}*/{S}*\p{{Nd}}+|\p{{Nd}}+([.,]\p{{Nd}}+)?{S}*%') OR regexp_matches(s, '{_java(reconcile.MONETARY)}')) AS monetary
FROM t WHERE NOT (whole LIKE 'нарушение%' OR contains(whole, 'мера ответственности'))"""


@query
def confidence_score(spark, sf_dir):
    """Completeness from the facts the tables hold of a document: its price, penalties, requirements, chunks."""
    m = read(spark, sf_dir, "money_facts").select("money_id", "doc_id", "field", "amount").distinct()
    some = lambda c: F.coalesce(F.max(c), F.lit(False))
    amounts = m.groupBy("doc_id").agg(some((F.col("field") == "contract_price") & F.col("amount").isNotNull()).alias("price"), some(F.col("field") == "penalty").alias("penalties"), some(F.col("amount").isNull()).alias("unread"))
    needs = read(spark, sf_dir, "requirements").where(F.length("text") > 0).select("doc_id").distinct().withColumn("requirements", F.lit(True))
    parts = read(spark, sf_dir, "chunks").select("doc_id", "chunk_id").distinct().groupBy("doc_id").agg(F.count("*").alias("n"))
    d = parts.join(amounts, "doc_id", "left").join(needs, "doc_id", "left")
    has = lambda c: F.coalesce(F.col(c), F.lit(False))
    warnings = F.array_compact(F.array(F.when(~has("price"), F.lit(reconcile.PRICE_MISSING)), F.when(has("unread"), F.lit("Сумма не прочитана")), F.when(~has("requirements"), F.lit("Требований нет"))))
    return d.select("doc_id", reconcile.confidence(has("price"), F.col("n") > 1, has("requirements"), has("penalties"), warnings, F.least(F.col("n"), F.lit(3)), F.col("n")).alias("confidence"))


_sql["confidence_score"] = f"""
WITH m AS (SELECT doc_id, coalesce(bool_or(field = 'contract_price' AND amount IS NOT NULL), false) AS price, coalesce(bool_or(field = 'penalty'), false) AS pen, coalesce(bool_or(amount IS NULL), false) AS unread FROM money_facts GROUP BY doc_id),
r AS (SELECT DISTINCT doc_id, true AS req FROM requirements WHERE length(text) > 0), c AS (SELECT doc_id, count(DISTINCT chunk_id) AS n FROM chunks WHERE doc_id IS NOT NULL GROUP BY doc_id),
f AS (SELECT c.doc_id, n, coalesce(price, false) AS price, coalesce(pen, false) AS pen, coalesce(unread, false) AS unread, coalesce(req, false) AS req FROM c LEFT JOIN m USING (doc_id) LEFT JOIN r USING (doc_id)),
w AS (SELECT *, CAST(NOT price AS INT) + CAST(unread AS INT) + CAST(NOT req AS INT) AS many, CASE WHEN NOT price AND ({' OR '.join(f"contains(lower('{reconcile.PRICE_MISSING}'), '{x}')" for x in reconcile.CRITICAL)}) THEN 1 ELSE 0 END AS hard FROM f)
SELECT doc_id, round_even(greatest(0::DOUBLE, least(1::DOUBLE, (CASE WHEN price THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN n > 1 THEN 0.25::DOUBLE ELSE 0 END + CASE WHEN req THEN 0.25::DOUBLE ELSE 0 END + CASE WHEN pen THEN 0.2::DOUBLE ELSE 0 END)
  * CASE WHEN n > 3 THEN 0.55::DOUBLE + 0.45::DOUBLE * 3 / n ELSE 1 END - least(0.2::DOUBLE, hard * 0.08::DOUBLE) - least(0.12::DOUBLE, greatest(many - 1, 0) * 0.02::DOUBLE))), 2) AS confidence FROM w"""


@query
def stream_progress(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    totals = read(spark, sf_dir, "events").groupBy("user_id").agg((F.count("*") * 2).alias("total"))
    return progress.progress(e.select("user_id", "event_id"), totals, key="user_id").select("user_id", "done", "percent")


_sql["stream_progress"] = "SELECT user_id, count(*) AS done, 20 + CAST(floor(65.0 * count(*) / (count(*) * 2)) AS INT) AS percent FROM events GROUP BY user_id"


@query
def progress_milestones(spark, sf_dir):
    """The last milestone that each user's running count has reached, and how many there were."""
    done = stream_progress(spark, sf_dir).select("user_id", progress.reached(F.col("percent")).alias("m"))
    return done.select("user_id", F.size("m").alias("n"), F.element_at("m", -1)["percent"].alias("percent"), F.element_at("m", -1)["stage"].alias("stage"))


_sql["progress_milestones"] = "SELECT DISTINCT user_id, 4 AS n, 20 AS percent, 'llm' AS stage FROM events"


@query
def summary_flat(spark, sf_dir):
    """The whole pipeline without a model: pages to one record per document."""
    return summarize.flat(summarize.summarize(_pages(spark, sf_dir)))


def _tenders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two pages for each customer, with a fact of each kind at a known value."""
    key = F.lpad(F.col("c_custkey").cast("string"), 8, "0")
    cents = F.round(F.abs("c_acctbal") * 100).cast("bigint") + 100_000
    grouped = lambda c: F.translate(F.format_number((c / 100).cast("decimal(18,2)"), 2), ",.", "\xa0,")
    one = F.concat(F.lit("Предмет закупки: поставка изделий для "), F.col("c_name"), F.lit(" по лоту № "), key, F.lit(".\nЗаказчик: ГБУ «"), F.col("c_name"), F.lit("»\nНачальная (максимальная) цена контракта: "), grouped(cents), F.lit(" рублей, включая НДС 20 %.\nОбеспечение исполнения контракта: "), grouped(F.floor(cents / 10)), F.lit(" руб. Обеспечение заявки не требуется."))
    two = F.concat(F.lit("Срок начала работ: с 01.02.2026 включительно.\nСрок окончания работ: до 30.11.2026.\nСрок выполнения работ составляет "), F.col("c_custkey") % 300 + 1, F.lit(" календарных дней.\nЭтап 1: подготовка до 01.03.2026;\nЭтап 2: поставка до 01.11.2026;\nТребования к участникам закупки\nУчастник обязан иметь опыт поставки изделий не менее 3 лет.\nОтветственность сторон\nЗа каждый день просрочки поставщика начисляется пеня 0,1 % от цены контракта.\n"))
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("doc_id"), F.explode(F.array(F.struct(F.lit(1).alias("page_no"), one.alias("text")), F.struct(F.lit(2).alias("page_no"), two.alias("text")))).alias("p"))
    return c.select("doc_id", "p.page_no", "p.text")


@query
def summary_rendered(spark, sf_dir):
    """The whole pipeline over documents rendered from customers, whose facts are known."""
    s = summarize.flat(summarize.summarize(_tenders(spark, sf_dir)))
    cents = lambda c: F.round(F.col(c) * 100).cast("bigint").alias(c)
    return s.select("doc_id", "subject", "customer", "procurement_number", cents("contract_price"), cents("contract_security"), cents("application_security"), "start", "end", "duration", "n_stages", "n_requirements", "n_penalties", "n_warnings", "confidence")


_TENDERS = "SELECT CAST(c_custkey AS VARCHAR) AS doc_id, c_custkey, c_name, lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS lot, CAST(round(abs(c_acctbal) * 100) AS BIGINT) + 100000 AS cents FROM customer"
_sql["summary_rendered"] = f"""
SELECT doc_id, 'поставка изделий для ' || c_name || ' по лоту № ' || lot AS subject, '«' || c_name || '»' AS customer, lot AS procurement_number, cents AS contract_price, cents // 10 AS contract_security, CAST(NULL AS BIGINT) AS application_security,
  '01.02.2026' AS start, '30.11.2026' AS "end", (c_custkey % 300 + 1) || ' календарных дней' AS duration, 2 AS n_stages, 1 AS n_requirements, 1 AS n_penalties, 0 AS n_warnings, 1.0::DOUBLE AS confidence FROM ({_TENDERS})"""


@query
def summary_rules_provider(spark, sf_dir):
    """The same documents by the way of chunks, replies, repair and merge, with the rules in a model's place."""
    s = summarize.flat(summarize.summarize(_tenders(spark, sf_dir), "rules"))
    cents = lambda c: F.round(F.col(c) * 100).cast("bigint").alias(c)
    return s.select("doc_id", "subject", "customer", "procurement_number", cents("contract_price"), cents("contract_security"), cents("application_security"), "start", "end", "duration", "n_stages", "n_requirements", "n_penalties", "n_warnings", "confidence", "code")


_sql["summary_rules_provider"] = _sql["summary_rendered"].replace("1.0::DOUBLE AS confidence", "1.0::DOUBLE AS confidence, CAST(NULL AS VARCHAR) AS code")


@query
def summary_json(spark, sf_dir):
    """Records of the pipeline as JSON objects, nulls kept."""
    s = summarize.summarize(_tenders(spark, sf_dir))
    pages_of = lambda x: F.struct(x["category"].alias("category"), x["source_pages"].alias("source_pages"))
    return report.as_json(s.select("doc_id", "customer", "application_security", "duration", F.transform("requirements", pages_of).alias("requirements"), "warnings"), "doc_id")


_sql["summary_json"] = f"""
SELECT doc_id, '{{"doc_id":"' || doc_id || '","customer":"«' || c_name || '»","application_security":null,"duration":"' || (c_custkey % 300 + 1) || ' календарных дней","requirements":[{{"category":"experience","source_pages":[2]}}],"warnings":[]}}' AS json FROM ({_TENDERS})"""


def _summary(user: str, attempt: int) -> str:
    """A reply with what a few patterns find in the chunk; some fail, some break the schema, some are fenced."""
    if "%" in user and attempt == 1:
        raise provider.ProviderError("status 503", True)
    if "жалобу" in user:
        raise provider.ProviderError("status 400", False)
    page = re.search(r"стр\. (\d+)", user)
    at = [int(page[1])] if page else []
    found = lambda p: list(dict.fromkeys(x.strip() for x in re.findall(p, user)))
    amounts = found(r"\d[\d \xa0]*(?:,\d\d)? (?=руб)")
    reply = {
        "contract_price": {"amount": amounts[0], "raw": amounts[0]} if amounts else None,
        "deadlines": {"duration": (found(r"\d+ (?:календарных|рабочих) дней") or [None])[0], "stages": [{"name": x} for x in found(r"Этап \d+")]},
        "requirements": [{"category": "other", "text": x, "source_pages": at} for x in found(r"[^.\n]*обязан[^.\n]*")],
        "penalties": None if len(user) % 50 == 0 else [{"violation": x, "sanction": "Штраф", "source_pages": at} for x in found(r"[^.\n]*(?:штраф|неустойк)[^.\n]*")],
        "warnings": [],
    }
    return "```json\n" + json.dumps(reply, ensure_ascii=False) + "\n```"


@query
def summary_provider(spark, sf_dir):
    """The whole pipeline with a scripted provider: a record or a reject per document."""
    return summarize.flat(summarize.summarize(_pages(spark, sf_dir), lambda: provider.Scripted(_summary)))


def queries() -> dict[str, Query]:
    return dict(_registered)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
