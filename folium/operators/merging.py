"""Deterministic merge of partial records: each aggregate orders by an explicit key, none relies on arrival."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folium.functions import text as T

MAX_REQUIREMENTS, MAX_PENALTIES, MAX_STAGES, MAX_MENTIONS, MAX_OPERATIONAL = 40, 40, 12, 15, 8
SHORTEST_CONTAINED = 40


def first_text(value: Column, order: Column) -> Column:
    """Aggregate: the first non-blank text, stripped."""
    t = T.strip(value)
    return F.min_by(F.when(t != "", t), F.when(t != "", order))


def best_money(amount: Column, raw: Column, order: Column, value: Column) -> Column:
    """Aggregate: the first value with an amount and a raw wording, else the first with an amount."""
    bare = F.coalesce(raw, F.lit("")) == ""
    return F.min_by(F.when(amount.isNotNull(), value), F.when(amount.isNotNull(), F.struct(bare, order)))


def unique_texts(df: DataFrame, *keys: str, text: str, order: list[str], limit: int | None = None) -> DataFrame:
    """Rows with the first text of each key under the merge key; blank ones are dropped. Order is by `order`."""
    t = df.withColumn(text, T.strip(F.col(text))).withColumn("_k", T.merge_key(F.col(text))).where((F.col(text) != "") & (F.col("_k") != ""))
    # the first of each text is found before anything is ordered: most copies never move
    first = t.groupBy(*keys, "_k").agg(F.min_by(F.struct(*[c for c in t.columns if c not in (*keys, "_k")]), F.struct(*order)).alias("_r")).select(*keys, "_r.*")
    if limit is None:
        return first
    w = Window.partitionBy(*keys).orderBy(*order)
    return first.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit).drop("_n")


def similar(a: Column, b: Column) -> Column:
    """Keys are equal, or the shorter, if long enough, stands in the longer."""
    shorter = F.least(F.length(a), F.length(b))
    return (a != "") & (b != "") & ((a == b) | ((shorter >= SHORTEST_CONTAINED) & (a.contains(b) | b.contains(a))))


def distinct_by(items: Column, key) -> Column:
    """Elements of an array with the first of each key, in order."""
    keys = F.transform(items, key)
    return F.filter(items, lambda x, i: F.array_position(keys, key(x)) == i + 1)


def unique_list(texts: Column) -> Column:
    """array<string>: stripped texts, blank ones dropped, the first of each merge key."""
    return distinct_by(F.filter(F.transform(texts, T.strip), lambda x: x.isNotNull() & (x != "")), T.merge_key)


def fuzzy_distinct(items: Column) -> Column:
    """Greedy fold over array<struct<text, pages: array<int>>>, longest text first: an item similar to one kept before
    gives it its pages; containment isn't transitive, so a self-join would give other results. `at` is the kept item's
    place in the array given, from 0."""
    keyed = F.filter(F.transform(items, lambda x, i: F.struct((-F.length(x["text"])).alias("w"), i.alias("i"), x["text"].alias("text"), T.merge_key(x["text"]).alias("key"), F.coalesce(x["pages"], F.array().cast("array<int>")).alias("pages"))), lambda x: T.strip(x["text"]) != "")
    kind = "array<struct<text:string,key:string,pages:array<int>,at:int>>"

    def step(kept: Column, x: Column) -> Column:
        at = F.array_position(F.transform(kept, lambda k: similar(k["key"], x["key"])), F.lit(True))
        grown = F.transform(kept, lambda k, i: F.when(i + 1 == at, F.struct(k["text"].alias("text"), k["key"].alias("key"), F.array_sort(F.array_union(k["pages"], x["pages"])).alias("pages"), k["at"].alias("at"))).otherwise(k))
        added = F.concat(kept, F.array(F.struct(x["text"].alias("text"), x["key"].alias("key"), F.array_sort(F.array_distinct(x["pages"])).alias("pages"), x["i"].alias("at"))))
        return F.when(at > 0, grown).otherwise(added).cast(kind)

    kept = F.aggregate(F.array_sort(keyed), F.array().cast(kind), step)
    return F.transform(kept, lambda k: F.struct(k["text"].alias("text"), F.filter(k["pages"], lambda p: p.isNotNull() & (p != 0)).alias("pages"), k["at"].alias("at")))


def fuzzy_penalties(items: Column) -> Column:
    """The same for array<struct<violation, sanction, formula, amount: double, pages>>: the better informed come first,
    and a kept item takes formula and amount from a similar one where it has none."""
    some = F.filter(items, lambda x: T.strip(x["violation"]) != "")
    keyed = F.transform(
        some,
        lambda x, i: F.struct(
            F.when(F.coalesce(x["formula"], F.lit("")) != "", 0).otherwise(1).alias("a"), F.when(F.coalesce(x["amount"], F.lit(0.0)) != 0, 0).otherwise(1).alias("b"), (-F.length(x["violation"])).alias("c"), i.alias("i"),
            T.merge_key(x["violation"]).alias("key"), x["violation"].alias("violation"), x["sanction"].alias("sanction"), x["formula"].alias("formula"), x["amount"].alias("amount"), F.coalesce(x["pages"], F.array().cast("array<int>")).alias("pages"),
        ),
    )
    kind = "array<struct<key:string,violation:string,sanction:string,formula:string,amount:double,pages:array<int>>>"

    def item(k: Column, formula: Column, amount: Column, pages: Column) -> Column:
        return F.struct(k["key"].alias("key"), k["violation"].alias("violation"), k["sanction"].alias("sanction"), formula.alias("formula"), amount.alias("amount"), F.array_sort(pages).alias("pages"))

    def step(kept: Column, x: Column) -> Column:
        at = F.array_position(F.transform(kept, lambda k: similar(k["key"], x["key"])), F.lit(True))
        grown = F.transform(kept, lambda k, i: F.when(i + 1 == at, item(k, F.coalesce(F.nullif(k["formula"], F.lit("")), x["formula"]), F.coalesce(k["amount"], x["amount"]), F.array_union(k["pages"], x["pages"]))).otherwise(k))
        return F.when(at > 0, grown).otherwise(F.concat(kept, F.array(item(x, x["formula"], x["amount"], F.array_distinct(x["pages"]))))).cast(kind)

    kept = F.aggregate(F.array_sort(keyed), F.array().cast(kind), step)
    return F.transform(kept, lambda k: F.struct(k["violation"].alias("violation"), k["sanction"].alias("sanction"), k["formula"].alias("formula"), k["amount"].alias("amount"), k["pages"].alias("pages")))


def capped(items: Column, limit: int) -> Column:
    return F.slice(items, F.lit(1), F.lit(limit))


TEXTS = ["subject", "customer", "procurement_number", "start", "end", "duration"]
MONEY = ["contract_price", "contract_security", "application_security"]
LISTS = ["mentions", "stages", "requirements", "penalties", "warnings"]


def merged_records(parts: DataFrame, *, key: str = "doc_id", order: str = "chunk_idx") -> DataFrame:
    """key, partials and the fields of the records in `parts` merged: first texts, best amounts, distinct lists.

    A single record keeps its lists as they are but for the limits. A document's lists are those of its chunks sent, so
    they are bounded by them.
    """
    o = F.col(order)
    whole = lambda c: F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(o.alias("o"), F.col(c).alias("x")))), lambda p: p["x"]))
    m = parts.groupBy(key).agg(
        F.count("*").alias("partials"), *[first_text(F.col(c), o).alias(c) for c in TEXTS],
        *[best_money(F.col(c)["amount"], F.col(c)["raw"], o, F.col(c)["amount"]).alias(c) for c in MONEY], *[whole(c).alias(c) for c in LISTS],
    )
    r, p = F.col("requirements"), F.col("penalties")
    unlike = fuzzy_distinct(F.transform(r, lambda x: F.struct(x["text"].alias("text"), x["source_pages"].alias("pages"))))
    requirements = F.transform(unlike, lambda k: F.struct(F.get(r, k["at"])["category"].alias("category"), k["text"].alias("text"), F.get(r, k["at"])["mandatory"].alias("mandatory"), k["pages"].alias("source_pages")))
    given = F.transform(p, lambda x: F.struct(x["violation"].alias("violation"), x["sanction"].alias("sanction"), x["formula"].alias("formula"), x["amount"].alias("amount"), x["source_pages"].alias("pages")))
    penalties = F.transform(fuzzy_penalties(given), lambda k: F.struct(k["violation"].alias("violation"), k["sanction"].alias("sanction"), k["formula"].alias("formula"), k["amount"].alias("amount"), k["pages"].alias("source_pages")))
    stages = distinct_by(F.filter("stages", lambda x: T.merge_key(x["name"]) != ""), lambda x: T.merge_key(x["name"]))
    new = {"mentions": (unique_list(F.col("mentions")), MAX_MENTIONS), "stages": (stages, MAX_STAGES), "requirements": (requirements, MAX_REQUIREMENTS), "penalties": (penalties, MAX_PENALTIES)}
    only = F.col("partials") == 1
    cols = {c: capped(F.when(only, F.col(c)).otherwise(x), n) for c, (x, n) in new.items()}
    return m.withColumns(cols | {"warnings": F.when(only, F.col("warnings")).otherwise(unique_list(F.col("warnings")))})


def token_usage(calls: DataFrame, *keys: str) -> DataFrame:
    """calls and token sums; zeros count as not stated, a sum of nothing is NULL."""
    return calls.groupBy(*keys).agg(F.count("*").alias("calls"), F.sum(F.nullif("prompt_tokens", F.lit(0))).alias("prompt_tokens"), F.sum(F.nullif("completion_tokens", F.lit(0))).alias("completion_tokens"))
