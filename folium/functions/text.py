"""Scalar expressions over text: all of them stay on the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from folium.functions.rx import let, parts, stems, unicode_ci
from folium.rules import procurement_ru as R

MONEY_TYPE = "struct<amount:double,currency:string,includes_vat:boolean,raw:string>"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def lines_of(c: Column) -> Column:
    """Lines at every Unicode line boundary, without an empty one after a final break."""
    every = parts(c, "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]")
    return let(every, lambda x: F.when(F.element_at(x, -1) == "", F.slice(x, F.lit(1), F.size(x) - 1)).otherwise(x))


RUNNING_BLOCK = 64


def _grown(lengths: Column, start: Column) -> Column:
    """Exclusive running sum from start; it copies what it has at each step, so it is for short arrays."""
    return F.aggregate(F.slice(lengths, F.lit(1), F.size(lengths) - 1), F.array(start), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))


def running(lengths: Column) -> Column:
    """Exclusive running sum of an array of ints: within blocks, and over the sums of blocks, so that long arrays cost
    little more than their length."""

    def cut(x: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / RUNNING_BLOCK).cast("int")), lambda k: F.slice(x, k * RUNNING_BLOCK + 1, F.lit(RUNNING_BLOCK)))

    def whole(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda acc, n: acc + n))
        return F.flatten(F.zip_with(blocks, _grown(sums, F.lit(0)), _grown))

    return let(lengths, lambda x: F.when(F.size(x) > 0, let(cut(x), whole)).when(F.size(x) == 0, F.array().cast("array<int>")))


def mask_numbers(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\d+", "#")


def strip_markers(c: Column) -> Column:
    return F.regexp_replace(c, unicode_ci(R.MARKER).replace("(?iU)", "(?U)"), " ")


def squeeze(c: Column) -> Column:
    return F.btrim(F.regexp_replace(c, r"(?U)\s+", " "), F.lit(" \t\n\r-—:;"))


def dedupe_key(c: Column) -> Column:
    return F.left(F.regexp_replace(F.lower(strip_markers(c)), "[^a-zа-я0-9]+", ""), F.lit(160))


def merge_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-zа-яё0-9]+", "")


def contains_any(lowered: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [lowered.contains(w) for w in words])


# money


def parse_amount(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, "[ \\x{a0}\\x{202f}]", ""), ",", ".").try_cast("double")


def multiplied(amount: Column, token: Column) -> Column:
    t = F.lower(F.coalesce(token, F.lit("")))
    return amount * F.when(t.startswith("млн") | t.startswith("миллион"), 1e6).when(t.startswith("тыс"), 1e3).otherwise(1.0)


MONEY = unicode_ci(rf"({R.NUMBER})\s*(?:\([^)]{{0,300}}\)\s*)?({R.MULTIPLIER})?\s*(?:{R.CURRENCY})")


def _has_currency(c: Column) -> Column:
    """A plain search that spares texts without any currency the pattern."""
    return F.lower(c).contains("руб") | c.contains("₽") | F.lower(c).contains("rub")


def vat_flag(c: Column) -> Column:
    return F.when(c.rlike(unicode_ci(R.VAT_INCLUDED)), True).when(c.rlike(unicode_ci(R.VAT_EXCLUDED)), False)


def _amount(raw: Column) -> Column:
    """Value of one amount's wording."""
    return multiplied(parse_amount(F.regexp_extract(raw, MONEY, 1)), F.regexp_extract(raw, MONEY, 2))


def money_list(c: Column) -> Column:
    """All amounts of a text, in order: struct(pos, raw, amount, width); pos counts from 0.

    The pattern goes over the text once for the amounts and once for the gaps between them, which give the positions.
    """
    none = F.array().cast("array<struct<pos:int,raw:string,amount:double,width:int>>")

    def of(m: Column) -> Column:
        # an amount begins after the gaps up to it and the amounts before it
        widths, gaps = F.transform(m["raw"], F.length), F.transform(F.slice(m["gaps"], F.lit(1), F.size(m["raw"])), F.length)
        starts = F.zip_with(running(F.zip_with(gaps, widths, lambda g, w: g + w)), gaps, lambda s, g: s + g)
        return F.zip_with(starts, m["raw"], lambda s, r: F.struct(s.alias("pos"), squeeze(r).alias("raw"), _amount(r).alias("amount"), F.length(r).alias("width")))

    found = let(F.struct(F.regexp_extract_all(c, F.lit(MONEY), F.lit(0)).alias("raw"), parts(c, MONEY).alias("gaps")), of)
    return F.when(c.isNotNull(), F.when(_has_currency(c), found).otherwise(none))


def first_money(c: Column) -> Column:
    """The first amount as a money struct, NULL if none."""

    def of(x: Column) -> Column:
        # the leftmost match of the pattern is also the first place of its wording
        raw, start = x["raw"], F.instr(x["text"], x["raw"])
        window = F.substring(x["text"], F.greatest(F.lit(1), start - 160), F.least(start - 1, F.lit(160)) + F.length(raw) + 80)
        return F.when(raw.isNotNull(), F.struct(_amount(raw).alias("amount"), F.lit("RUB").alias("currency"), let(window, vat_flag).alias("includes_vat"), squeeze(raw).alias("raw")))

    return let(F.struct(c.alias("text"), F.when(_has_currency(c), F.regexp_substr(c, F.lit(MONEY))).alias("raw")), of)


def format_amount(c: Column) -> Column:
    return F.when(c.isNull(), "-").otherwise(F.translate(F.format_number(c, 2), ",.", " ,"))


# dates, durations, codes


def date(c: Column) -> Column:
    return F.regexp_substr(c, F.lit("(?U)" + R.DATE))


def text_date(c: Column) -> Column:
    return F.regexp_substr(c, F.lit(unicode_ci(R.TEXT_DATE)))


def any_date(c: Column) -> Column:
    return F.coalesce(date(c), text_date(c))


def duration(c: Column) -> Column:
    return F.regexp_substr(c, F.lit(unicode_ci(R.DURATION)))


def duration_phrase(c: Column) -> Column:
    """Normal wording of a duration: number, qualifier if any, unit."""
    p = unicode_ci(R.DURATION)
    unit = F.lower(F.regexp_extract(c, p, 3))
    kind = F.lower(F.regexp_extract(c, p, 2))
    words = F.concat_ws(" ", F.regexp_extract(c, p, 1), F.when(kind != "", kind), F.when(unit.startswith("дн"), "дней").otherwise(unit))
    return F.when(F.regexp_extract(c, p, 1) != "", squeeze(words))


def formula(c: Column) -> Column:
    return squeeze(F.regexp_substr(c, F.lit(unicode_ci(R.FORMULA))))


def procurement_number(c: Column) -> Column:
    t = strip_markers(c)
    return F.coalesce(F.nullif(F.regexp_extract(t, r"(?U)\b(\d{18,20})\b", 1), F.lit("")), F.nullif(F.regexp_extract(t, r"(?U)№\s*([0-9А-Яа-я\-/]{6,30})", 1), F.lit("")))


# classifiers


def by_rules(c: Column, rules: list[tuple[str, list[str]]], default: str) -> Column:
    out = F.lit(default)
    for label, words in reversed(rules):
        out = F.when(c.rlike(stems(words)), label).otherwise(out)
    return F.when(c.isNotNull(), out)


def category(c: Column) -> Column:
    return by_rules(c, R.CATEGORY_RULES, "other")


def known_category(c: Column) -> Column:
    t = F.lower(F.trim(c))
    return F.when(t.isin(R.CATEGORIES), t).otherwise("other")


def sanction(c: Column) -> Column:
    return by_rules(c, R.SANCTION_RULES, R.SANCTION_DEFAULT)


def mandatory(c: Column) -> Column:
    return ~c.rlike(stems(R.OPTIONAL_MARKERS))


def clause_start(c: Column) -> Column:
    return c.rlike(r"""^["'(]*[\p{Nd}\p{Lu}]""")


def table_header(cells: Column) -> Column:
    joined = F.lower(F.array_join(cells, " "))
    return joined.startswith("нарушение") | joined.contains("мера ответственности")


def penalty_text(c: Column) -> Column:
    return squeeze(F.replace(strip_markers(c), F.lit("]]"), F.lit(" ")))


def party_role(c: Column) -> Column:
    return F.rtrim(F.lower(squeeze(c)), F.lit(":")).isin(R.PARTY_ROLES)


def role_only(c: Column) -> Column:
    """The narrower test used on finished records: without the general contractor."""
    return F.lower(F.trim(F.regexp_replace(c, r"(?U)\s+", " "))).isin(R.PARTY_ROLES[:5])


def party_score(c: Column) -> Column:
    named = c.contains("«") | contains_any(F.lower(c), R.LEGAL_FORMS)
    return F.struct(F.when(party_role(c), 3).when(named, 0).otherwise(1).alias("rank"), F.length(c).alias("length"))


def party_name(c: Column) -> Column:
    t = strip_markers(c)
    quoted = F.regexp_substr(t, F.lit("«[^»]{5,220}»"))
    rows = F.transform(lines_of(t), lambda x: squeeze(F.rtrim(strip(x), F.lit(":"))))
    fits = F.filter(rows, lambda x: (F.length(x) >= 5) & ~party_role(x) & ((F.length(x) >= 12) | contains_any(F.lower(x), R.PARTY_MARKERS)))
    return F.coalesce(squeeze(quoted), F.rtrim(F.get(fits, F.lit(0)), F.lit(".")))


STOP = "(?U)" + "".join(rf"(?<!\b{a})" for a in R.ABBREVIATED) + r"\.\s+(?=[А-ЯЁA-Z0-9«])|\n"


def label_value(c: Column, labels: list[str]) -> Column:
    """Value after the first label, in order of labels, that has an acceptable one."""

    def one(label: str) -> Column:
        windows = let(parts(c, unicode_ci(rf"\b{label}\s*[:—-]\s*")), lambda x: F.slice(x, F.lit(2), F.size(x)))
        values = F.transform(windows, lambda w: squeeze(strip_markers(F.element_at(parts(F.left(w, F.lit(400)), STOP), 1))))
        first = F.get(F.filter(values, lambda v: (F.length(v) >= 5) & ~party_role(v)), F.lit(0))
        return F.when(F.lower(c).contains(label), first)  # a plain search spares most texts the patterns

    return F.rtrim(F.coalesce(*[one(x) for x in labels]), F.lit("."))


# reconciliation


def digits_joined(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)(?<=\d)\s(?=\d)", "")


def amount_in_text(amount: Column, digits: Column) -> Column:
    a = F.abs(amount)
    whole = F.floor(a).cast("string")
    cents = F.format_string("%.2f", amount)
    return digits.contains(whole) | ((a != F.floor(a)) & (digits.contains(cents) | digits.contains(F.replace(cents, F.lit("."), F.lit(",")))))


def same_amount(a: Column, b: Column) -> Column:
    return F.coalesce(F.abs(a - b) <= 1.0, F.lit(False))


# chunks


def overlap_tail(c: Column, size: Column) -> Column:
    tail = F.right(c, size)
    after = lambda mark: F.substring(tail, F.instr(tail, mark) + len(mark), F.length(tail))
    cut = F.when(F.instr(tail, "\n\n") > 0, after("\n\n")).when(F.instr(tail, "\n") > 0, after("\n")).when(F.instr(tail, ". ") > 0, after(". ")).otherwise(tail)
    return F.when((size <= 0) | (F.length(c) <= size), "").otherwise(strip(cut))


def relevance(c: Column) -> Column:
    low = F.lower(c)
    count = lambda w: F.least((F.length(low) - F.length(F.replace(low, F.lit(w), F.lit("")))) / len(w), F.lit(3))
    total = reduce(lambda a, b: a + b, [F.lit(v) * count(w) for w, v in R.RELEVANCE.items()])
    return total + F.when(c.rlike(MONEY), 2.0).otherwise(0.0) + F.when(c.rlike("(?U)" + R.DATE), 1.0).otherwise(0.0)


def chunk_label(first: Column, last: Column) -> Column:
    return F.when(first == last, F.concat(F.lit("стр. "), first)).otherwise(F.concat(F.lit("стр. "), first, F.lit("–"), last))
