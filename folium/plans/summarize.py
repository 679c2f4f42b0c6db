"""The whole way from pages to one record per document, with rules alone or with a provider per chunk."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folium.functions import text as T
from folium.operators import chunks, facts, jsonrepair, merging, pages, provider, reconcile, tokens
from folium.plans.ship import cut_lineage
from folium.operators.merging import MAX_MENTIONS, MAX_STAGES, capped
from folium.rules import procurement_ru as R

MONEY_FIELDS = [("contract_price", R.PRICE_KEYWORDS, "Сумма контракта", True), ("contract_security", R.CONTRACT_SECURITY_KEYWORDS, "Обеспечение исполнения контракта", False), ("application_security", R.APPLICATION_SECURITY_KEYWORDS, "Обеспечение заявки", False)]


def rule_summary(docs: DataFrame) -> DataFrame:
    """One record per document (doc_id, text) from the rule pack alone.

    Each fact is aggregated to its document by itself, so what is joined is small; the texts are not joined.
    """
    # the texts are read for the lists too: they are written once to the shared folder
    text = cut_lineage(docs.select("doc_id", pages.reflow(F.col("text")).alias("text")))
    t = F.col("text")
    # scalars come from one pass: what several of them need is made once, and no text moves
    words = {name: w for name, w, _, _ in MONEY_FIELDS} | {"start": R.START_KEYWORDS, "end": R.END_KEYWORDS}
    seen = text.select("doc_id", "text", T.money_list(t).alias("_m"), tokens.split_with_offsets(t, tokens.SPLIT).alias("_s"), facts.occurrences(t, *words.values()).alias("_o"))
    at = lambda n: F.filter("_o", lambda o: o["list"] == list(words).index(n))
    base = seen.select(
        "doc_id", facts.subject(t).alias("subject"), facts.customer(t).alias("customer"), T.procurement_number(t).alias("procurement_number"),
        *[facts.money_after(at(n), F.col("_m"))["amount"].alias(n) for n, _, _, _ in MONEY_FIELDS],
        facts.phrase_after(t, at("start")).alias("start"), facts.phrase_after(t, at("end"), skip=R.END_SKIP).alias("end"),
        F.coalesce(facts.transfer_duration(t), facts.best_duration(F.col("_s"))).alias("_d"),
        F.get(F.filter("_s", lambda s: F.lower(s["text"]).contains("срок")), F.lit(0))["text"].alias("_term"),
        tokens.page_marks(t).alias("_marks"),
    )
    # without a duration the first sentence on a term is the mention
    parts = [base.withColumn("duration", F.col("_d.duration")).withColumn("mentions", F.array_compact(F.array(F.coalesce(T.squeeze(F.col("_d.sentence")), T.squeeze(F.col("_term")))))).drop("_d", "_term")]
    listed = lambda df, no, name: df.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(no, *[c for c in df.columns if c not in ("doc_id", no)]))).alias(name))
    parts.append(listed(facts.stages(text), "stage_no", "stages").withColumn("stages", capped(F.transform("stages", lambda x: F.struct(x["name"].alias("name"), x["deadline"].alias("deadline"))), MAX_STAGES)))
    lists = (("requirements", facts.requirements(text), "req_no", ["category", "text", "mandatory"]), ("penalties", facts.penalties(text), "pen_no", ["violation", "sanction", "formula", "amount"]))
    parts += [listed(found, no, name) for name, found, no, _ in lists]
    every = reduce(lambda a, b: a.join(b, "doc_id", "left"), parts)
    pages_of = lambda x: F.filter(F.array(tokens.marked_page(F.col("_marks"), x["pos"])), lambda n: n.isNotNull() & (n != 0)).alias("source_pages")
    traced = lambda name, kept: F.transform(name, lambda x: F.struct(*[x[c].alias(c) for c in kept], pages_of(x)))
    return every.withColumns({name: traced(name, kept) for name, _, _, kept in lists}).drop("_marks")


def finished(summary: DataFrame, warnings=None) -> DataFrame:
    """Lists made non-null and refined, warnings of what is missing, completeness."""
    s = summary
    none = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    has_deadline = F.col("start").isNotNull() | F.col("end").isNotNull() | F.col("duration").isNotNull() | ~none("stages")
    stages = F.coalesce("stages", F.array().cast("array<struct<name:string,deadline:string>>"))
    mentions = merging.unique_list(F.concat(F.coalesce("mentions", F.array().cast("array<string>")), reconcile.other_stages(stages)))
    # one after another: the mentions and the warning need the stages as they were
    s = s.withColumn("_dated", has_deadline).withColumn("mentions", mentions).withColumn("stages", capped(reconcile.refined_stages(stages), MAX_STAGES))
    s = s.withColumn("requirements", reconcile.refined_requirements(F.col("requirements")))
    s = s.withColumn("penalties", F.filter("penalties", lambda p: reconcile.monetary(p["violation"], p["sanction"], p["formula"], p["amount"])))
    found = F.array(
        F.when(F.col("contract_price").isNull(), F.lit(reconcile.PRICE_MISSING)),
        F.when(~F.col("_dated"), F.lit(R.DEADLINES_MISSING)),
        F.when(none("requirements"), F.lit(R.REQUIREMENTS_MISSING)),
        F.when(none("penalties"), F.lit(R.PENALTIES_MISSING)),
    )
    every = F.concat(warnings, found) if warnings is not None else found
    s = s.withColumn("warnings", F.array_distinct(F.filter(every, lambda w: w.isNotNull())))
    s = s.withColumn("mentions", capped(F.col("mentions"), MAX_MENTIONS)).drop("_dated")
    total = F.col("chunks_total") if "chunks_total" in s.columns else F.lit(1)
    sent = F.col("chunks_sent") if "chunks_sent" in s.columns else F.lit(1)
    return s.withColumn("confidence", reconcile.confidence(F.coalesce(F.col("contract_price") != 0, F.lit(False)), has_deadline, ~none("requirements"), ~none("penalties"), F.col("warnings"), sent, total))


def rule_replies(sent: DataFrame) -> DataFrame:
    """The rules in a model's place: doc_id, chunk_idx, reply, failure with what they find in each chunk as an object of
    the summary's schema."""
    found = rule_summary(sent.select(F.to_json(F.struct(F.col("doc_id").cast("string").alias("doc_id"), "chunk_idx")).alias("doc_id"), "text"))
    kinds = dict(found.dtypes)
    some = lambda c: F.coalesce(F.col(c), F.array().cast(kinds[c]))
    money = lambda x: F.when(x.isNotNull(), F.struct(x.alias("amount"), F.lit(None).cast("string").alias("raw")))
    penalty = lambda x: F.struct(*[x[c].alias(c) for c in ("violation", "sanction", "formula")], money(x["amount"]).alias("amount"), x["source_pages"].alias("source_pages"))
    deadlines = F.struct("start", "end", "duration", F.col("mentions").alias("raw_mentions"), some("stages").alias("stages"))
    body = F.struct(
        "subject", "customer", "procurement_number", *[money(F.col(n)).alias(n) for n, _, _, _ in MONEY_FIELDS], deadlines.alias("deadlines"),
        some("requirements").alias("requirements"), F.transform(some("penalties"), penalty).alias("penalties"), F.array().cast("array<string>").alias("warnings"),
    )
    key = F.from_json("doc_id", "doc_id string, chunk_idx int")
    return found.select(key.alias("k"), F.to_json(body, {"ignoreNullFields": "false"}).alias("reply")).select("k.doc_id", "k.chunk_idx", "reply", F.lit(None).cast("string").alias("failure"))


def summarize(page_rows: DataFrame, make: Callable[[], provider.Provider] | str | None = None, *, chunk_chars: int = 12_000, overlap_chars: int = 800, max_chunks: int = 20) -> DataFrame:
    """One record per document. `make` makes a provider; "rules" puts the rules in its place. Without a provider the rules read whole documents; with one, its replies for the most
    relevant chunks are repaired and merged first, and the rules fill what it left out and check its amounts. A document
    none of whose calls gave a valid reply has a row with code and detail and no values."""
    clean = pages.normalized(page_rows)
    docs = pages.marked_text(clean)
    rules = rule_summary(docs)
    if make is None:
        return finished(rules)
    every = chunks.scored(chunks.packed(clean, chunk_chars=chunk_chars, overlap_chars=overlap_chars))
    sent = chunks.selected(every, max_chunks=max_chunks)
    # calls are paid for: their checked replies are written once to the shared folder
    replies = rule_replies(sent) if make == "rules" else provider.called(sent, make)
    checked = cut_lineage(jsonrepair.validated(jsonrepair.repair(replies, "doc_id", "chunk_idx", "failure", text="reply")))
    invalid = F.concat(F.lit("the reply breaks the schema: "), F.col("fault"))
    outcome = checked.select("doc_id", "chunk_idx", F.when(F.col("valid"), F.col("json")).alias("reply"), F.when(~F.col("valid"), F.coalesce("failure", invalid)).alias("failure"))
    merged = merging.merged_records(jsonrepair.record(checked.where("valid").select("doc_id", "chunk_idx", "json")))
    counted = every.groupBy("doc_id").agg(F.count("*").alias("chunks_total")).withColumn("chunks_sent", F.least("chunks_total", F.lit(max_chunks)))
    digits = docs.select("doc_id", T.digits_joined(T.strip_markers(F.col("text"))).alias("_digits"))
    s = merged.join(rules.select("doc_id", *[F.col(c).alias(f"_{c}") for c in rules.columns if c != "doc_id"]), "doc_id").join(counted, "doc_id").join(digits, "doc_id")
    warnings = [F.col("warnings"), reconcile.coverage_warnings(F.col("partials"), F.col("chunks_sent"), F.col("chunks_total"))]
    new = {}
    for name, _, label, critical in MONEY_FIELDS:
        new[name], said = reconcile.checked_amount(F.col(name), F.col(f"_{name}"), F.col("_digits"), label, critical=critical)
        warnings.append(F.filter(said, lambda w: w != reconcile.PRICE_MISSING))
    for name in merging.TEXTS:
        new[name] = reconcile.filled(F.col(name), F.col(f"_{name}"), role=name == "customer")
    new["procurement_number"] = reconcile.normal_number(new["procurement_number"])
    none = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    for name in ("mentions", "stages", "requirements", "penalties"):
        new[name] = F.when(none(name), F.col(f"_{name}")).otherwise(F.col(name))
    for name, text in (("requirements", reconcile.REQUIREMENTS_RESTORED), ("penalties", reconcile.PENALTIES_RESTORED)):
        warnings.append(F.when(none(name) & ~none(f"_{name}"), F.array(F.lit(text))).otherwise(F.array().cast("array<string>")))
    # the warnings compare what the replies gave, so they come before it is filled
    s = s.withColumn("_w", F.concat(*warnings)).withColumns(new).drop("_digits", "warnings", *[f"_{c}" for c in rules.columns])
    return finished(s, F.col("_w")).drop("_w").unionByName(provider.unavailable(outcome), allowMissingColumns=True)


def flat(summary: DataFrame) -> DataFrame:
    """Scalars of the record."""
    size = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
    return summary.select("doc_id", "subject", "customer", "procurement_number", "contract_price", "contract_security", "application_security", "start", "end", "duration", size("stages").alias("n_stages"), size("requirements").alias("n_requirements"), size("penalties").alias("n_penalties"), size("warnings").alias("n_warnings"), "confidence", *[c for c in ("code", "detail") if c in summary.columns])
