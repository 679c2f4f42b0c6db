"""Facts of whole documents, as joins and aggregates over occurrences with character positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folium.functions import text as T
from folium.functions.rx import let, parts, stems, unicode_ci
from folium.operators import tokens
from folium.rules import procurement_ru as R


def occurrences(text: Column, *lists: list[str]) -> Column:
    """array of struct(list, ord, pos): every occurrence of each word in lower-cased text; ord is the word's place in its list."""
    words = F.array(*[F.struct(F.lit(k).alias("list"), F.lit(i).alias("ord"), F.lit(w).alias("word")) for k, ws in enumerate(lists) for i, w in enumerate(ws)])

    def one(low: Column, x: Column) -> Column:
        def of(gaps: Column) -> Column:
            starts = T.running(F.transform(gaps, lambda n: n + F.length(x["word"])))
            return F.zip_with(starts, gaps, lambda s, n: F.struct(x["list"].alias("list"), x["ord"].alias("ord"), (s + n).alias("pos")))

        pieces = F.split(low, F.concat(F.lit("\\Q"), x["word"], F.lit("\\E")), -1)
        return let(F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), F.length), of)

    # most words are in few texts: a plain search spares the others the rest
    return let(F.lower(text), lambda low: F.flatten(F.transform(F.filter(words, lambda x: low.contains(x["word"])), lambda x: one(low, x))))


def money_after(places: Column, amounts: Column, *, window: int = 400) -> Column:
    """struct(distance, ord, pos, at, amount, raw): the amount that begins nearest after one of the places (see
    occurrences), at most `window` characters on; ties go to the earlier word, occurrence, amount."""

    def first(o: Column) -> Column:
        near = F.get(F.filter(amounts, lambda m: (m["pos"] >= o["pos"]) & (m["pos"] <= o["pos"] + window)), F.lit(0))
        return let(near, lambda m: F.when(m.isNotNull(), F.struct((m["pos"] - o["pos"]).alias("distance"), o["ord"].alias("ord"), o["pos"].alias("pos"), m["pos"].alias("at"), m["amount"].alias("amount"), m["raw"].alias("raw"))))

    return F.when((F.size(places) > 0) & (F.size(amounts) > 0), F.array_min(F.transform(places, first)))


def nearest_money(docs: DataFrame, words: list[str], *, key: str = "doc_id", text: str = "text", window: int = 400) -> DataFrame:
    """Forward as-of join within each document: key, amount, raw, distance of the amount nearest after a word."""
    slim = docs.select(key, occurrences(F.col(text), words).alias("_o"), T.money_list(F.col(text)).alias("_m"))
    return slim.select(key, money_after(F.col("_o"), F.col("_m"), window=window).alias("b")).where("b IS NOT NULL").select(key, "b.amount", "b.raw", "b.distance")


def phrase_after(text: Column, places: Column, *, skip: list[str] | None = None) -> Column:
    """A date within 300 characters of the first of the places that has one or an acceptable phrase."""

    def value(w: Column) -> Column:
        def given(phrase: Column) -> Column:
            good = phrase != ""
            return F.when(good & ~T.contains_any(F.lower(phrase), skip) if skip else good, phrase)

        return F.coalesce(T.any_date(w), let(T.squeeze(T.strip_markers(F.element_at(parts(w, "[.;\n]"), 1))), given))

    found = F.transform(F.array_sort(places), lambda o: let(F.substring(text, o["pos"] + 1, F.lit(300)), value))
    return F.get(F.filter(found, lambda v: v.isNotNull()), F.lit(0))


def phrase_near(docs: DataFrame, words: list[str], *, key: str = "doc_id", text: str = "text", skip: list[str] | None = None) -> DataFrame:
    """key, value: the date or phrase after the first of the words that has one."""
    slim = docs.select(key, F.col(text).alias("_t"), occurrences(F.col(text), words).alias("_o")).where(F.size("_o") > 0)
    return slim.select(key, phrase_after(F.col("_t"), F.col("_o"), skip=skip).alias("value")).where("value IS NOT NULL")


def transfer_duration(text: Column) -> Column:
    """struct(duration, sentence): days up to the transfer of the object or a capital repair, which go before any other."""
    p = unicode_ci(R.TRANSFER)
    hit = F.when(F.lower(text).contains("передачи") | F.lower(text).contains("капитальн"), F.regexp_substr(text, F.lit(p)))
    return let(hit, lambda x: F.when(x.isNotNull(), F.struct(F.concat(F.regexp_extract(x, p, 1), F.lit(" календарных дней")).alias("duration"), x.alias("sentence"))))


def best_duration(sentences: Column) -> Column:
    """struct(duration, sentence) of array<struct<pos, text>>: works before others, designs and payments last; then the
    shortest sentence, then the first."""

    def of(s: Column) -> Column:
        low = F.lower(s["text"])
        rank = F.when(T.contains_any(low, R.DURATION_LATE), 3).when(low.contains("проектн") & ~low.contains("капитальн"), 2).when(T.contains_any(low, R.DURATION_WORKS), 0).otherwise(1)
        return let(T.duration_phrase(s["text"]), lambda d: F.when(d.isNotNull(), F.struct(rank.alias("rank"), F.length(s["text"]).alias("length"), s["pos"].alias("pos"), d.alias("duration"), s["text"].alias("sentence"))))

    kept = F.filter(sentences, lambda s: T.contains_any(F.lower(s["text"]), R.DURATION_KEYWORDS))
    return let(F.array_min(F.transform(kept, of)), lambda b: F.when(b.isNotNull(), F.struct(b["duration"].alias("duration"), b["sentence"].alias("sentence"))))


def duration_of(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, duration, sentence of whole texts: that of the transfer, else the best of a sentence."""
    found = F.coalesce(transfer_duration(F.col(text)), best_duration(tokens.split_with_offsets(F.col(text), tokens.SPLIT)))
    return docs.select(key, found.alias("d")).where("d IS NOT NULL").select(key, "d.duration", "d.sentence")


def stages(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, stage_no, name, deadline: named stages, the first of each name."""
    c = F.col(text)

    def one(k: int, p: str) -> Column:
        p = unicode_ci(p)
        both = F.arrays_zip(F.regexp_extract_all(c, F.lit(p), F.lit(1)).alias("n"), F.regexp_extract_all(c, F.lit(p), F.lit(2)).alias("b"))
        return F.transform(both, lambda x, i: F.struct((F.lit(k * 1_000_000) + i).alias("at"), T.squeeze(x["n"]).alias("name"), T.squeeze(x["b"]).alias("body")))

    every = docs.select(key, F.explode(F.concat(*[one(k, p) for k, p in enumerate(R.STAGES)])).alias("s")).select(key, "s.*")
    every = every.where((F.col("name") != "") & ~F.col("name").rlike(unicode_ci(r"\bсрок\b")))
    every = every.withColumn("_k", F.left(F.regexp_replace(F.lower("name"), "[^a-zа-я0-9]+", ""), F.lit(80))).withColumn("deadline", F.coalesce(T.any_date(F.col("body")), T.squeeze(T.duration(F.col("body")))))
    first = every.groupBy(key, "_k").agg(F.min_by(F.struct("name", "deadline"), "at").alias("v"), F.min("at").alias("at"))
    return first.select(key, F.row_number().over(Window.partitionBy(key).orderBy("at")).alias("stage_no"), "v.name", "v.deadline")


def requirement_scope(c: Column) -> Column:
    """struct(start, text): the part of a document that states requirements, and where it begins."""
    start = F.regexp_instr(c, F.lit(unicode_ci(R.SECTION)))
    head = F.length(F.regexp_substr(c, F.lit(unicode_ci(R.SECTION))))
    after = F.substring(c, start + head, F.length(c))
    stop = F.regexp_instr(after, F.lit(unicode_ci(R.SECTION_END)))
    end = F.least(start - 1 + 12_000, F.when(stop > 0, start + head + stop - 2).otherwise(F.length(c)), F.length(c))
    liable = F.regexp_instr(c, F.lit(unicode_ci(R.LIABILITY)))
    whole = F.when(liable > 0, F.left(c, liable - 1)).otherwise(F.left(c, F.lit(80_000)))
    return F.when(start > 0, F.struct((start - 1).alias("start"), F.substring(c, start, end - start + 1).alias("text"))).otherwise(F.struct(F.lit(0).alias("start"), whole.alias("text")))


def requirements(docs: DataFrame, *, key: str = "doc_id", text: str = "text", limit: int = 25) -> DataFrame:
    """key, req_no, category, text, mandatory, pos: requirement sentences of the scope, the first of each wording."""
    scoped = docs.select(key, requirement_scope(F.col(text)).alias("s")).select(key, F.col("s.start").alias("_at"), F.col("s.text").alias("text"))
    holds = lambda words: lambda s: T.contains_any(F.lower(s), words)
    every = tokens.sentences_with(scoped, key, "_at", keep=holds(R.REQUIREMENT_TRIGGERS)).withColumn("text", T.strip(T.strip_markers(F.col("text")))).withColumn("pos", F.col("pos") + F.col("_at")).drop("_at")
    low = F.lower("text")
    kept = every.where(F.length("text").between(30, 600) & F.col("text").rlike(stems(R.REQUIREMENT_TRIGGERS)) & ~F.col("text").rlike(unicode_ci(R.EXCLUDED)) & (~F.col("text").rlike(stems(R.PENALTY_TRIGGERS)) | T.contains_any(low, R.RESCUED)))
    first = kept.groupBy(key, T.dedupe_key(F.col("text")).alias("_k")).agg(F.min("pos").alias("pos"), F.min_by("text", "pos").alias("text"))
    w = Window.partitionBy(key).orderBy("pos")
    return first.withColumn("req_no", F.row_number().over(w)).where(F.col("req_no") <= limit).select(key, "req_no", T.category(F.col("text")).alias("category"), T.squeeze(F.col("text")).alias("text"), T.mandatory(F.col("text")).alias("mandatory"), "pos")


def penalties(docs: DataFrame, *, key: str = "doc_id", text: str = "text", limit: int = 25) -> DataFrame:
    """key, pen_no, violation, sanction, formula, amount, pos: penalty rows of tables, then penalty sentences."""
    # plain searches before the texts are unfolded; the patterns decide afterwards
    holds = lambda s: T.contains_any(F.lower(s), R.PENALTY_TRIGGERS)
    rows = tokens.sentences_with(docs, key, text=text, pattern=tokens.BREAK, keep=lambda s: s.contains("|") & holds(s)).withColumn("text", T.strip(F.col("text"))).where(F.col("text").rlike(stems(R.PENALTY_TRIGGERS)))
    cells = F.transform(F.split("text", r"\|", -1), T.strip)
    rows = rows.withColumn("c", cells).where((F.size("c") >= 2) & ~T.table_header(F.col("c")))
    c = lambda i: F.coalesce(F.get("c", F.lit(i)), F.lit(""))
    table = rows.select(key, F.lit(0).alias("src"), "pos", T.penalty_text(c(0)).alias("violation"), F.coalesce(F.nullif(T.penalty_text(c(1)), F.lit("")), T.sanction(F.col("text"))).alias("sanction"), T.formula(F.concat_ws(" ", c(1), c(2))).alias("formula"), T.first_money(c(2))["amount"].alias("amount"), T.dedupe_key(F.concat(c(0), c(1))).alias("_k"))
    table = table.where(F.col("violation") != "")
    s = tokens.sentences_with(docs, key, text=text, keep=lambda s: ~s.contains("|") & ~s.contains(R.TABLE_LINE) & holds(s)).withColumn("t", T.penalty_text(F.col("text")))
    hits = F.size(F.regexp_extract_all("t", F.lit(stems(R.PENALTY_TRIGGERS)), F.lit(0)))
    s = s.where(F.length("t").between(30, 700) & (hits > 0) & (hits <= 3) & T.clause_start(F.col("t")) & ~T.contains_any(F.lower("t"), R.NON_PENALTY_MARKERS))
    prose = s.select(key, F.lit(1).alias("src"), "pos", F.col("t").alias("violation"), T.sanction(F.col("t")).alias("sanction"), T.formula(F.col("t")).alias("formula"), T.first_money(F.col("t"))["amount"].alias("amount"), T.dedupe_key(F.col("t")).alias("_k"))
    every = table.unionByName(prose)
    first = every.groupBy(key, "_k").agg(F.min_by(F.struct("violation", "sanction", "formula", "amount"), F.struct("src", "pos")).alias("v"), F.min(F.struct("src", "pos")).alias("at"))
    w = Window.partitionBy(key).orderBy("at")
    return first.withColumn("pen_no", F.row_number().over(w)).where(F.col("pen_no") <= limit).select(key, "pen_no", "v.*", F.col("at.pos").alias("pos"))


def subject(c: Column) -> Column:
    value = T.label_value(c, R.SUBJECT_LABELS)
    section = F.left(F.get(F.split(c, unicode_ci(r"\bпредмет\s+договора\b"), 2), F.lit(1)), F.lit(5000))
    works = F.slice(F.regexp_extract_all(section, F.lit(unicode_ci(r"(?:разработ\w+|выполн\w+|оказ\w+|постав\w+|провед\w+)[^.;\n]{15,220}")), F.lit(0)), F.lit(1), F.lit(3))
    listed = F.array_join(F.array_distinct(F.transform(works, T.squeeze)), "; ")
    return F.when((F.length(value) >= 20) & ~T.party_role(value), value).otherwise(F.coalesce(F.nullif(listed, F.lit("")), value))


def customer(c: Column) -> Column:
    head = F.left(c, F.lit(25_000))
    named = T.squeeze(F.regexp_substr(head, F.lit(unicode_ci(R.ORGANISATION))))
    role = F.nullif(F.regexp_extract(head, unicode_ci(R.AS_CUSTOMER), 1), F.lit(""))

    def labelled(label: str) -> Column:
        p = unicode_ci(rf"\b{label}\s*[:—-]\s*")
        named = lambda every: F.transform(F.slice(every, F.lit(2), F.size(every)), lambda x: F.struct(T.party_name(F.left(x["text"], F.lit(600))).alias("name"), x["pos"].alias("pos")))
        none = F.array().cast("array<struct<name:string,pos:int>>")
        return F.when(F.lower(c).contains(label), let(tokens.split_with_offsets(c, p), named)).otherwise(none)

    found = F.transform(F.filter(F.concat(*[labelled(x) for x in R.CUSTOMER_LABELS]), lambda x: x["name"].isNotNull()), lambda x: F.struct(T.party_score(x["name"]).alias("score"), x["pos"].alias("pos"), x["name"].alias("name")))
    return F.coalesce(named, T.squeeze(F.concat(F.lit("«"), role, F.lit("»"))), F.get(F.array_sort(found), F.lit(0))["name"])
