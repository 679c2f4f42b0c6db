"""Checks of extracted values against the text, refinement of lists, completeness."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folium.functions import text as T
from folium.functions.rx import unicode_ci
from folium.rules import procurement_ru as R
from folium.operators.merging import MAX_OPERATIONAL, MAX_REQUIREMENTS, distinct_by

# Wording of warnings.
NOT_EXTRACTED = "{label}: значение не извлечено моделью, подставлено найденное правилами ("
PRICE_MISSING = "Сумма контракта не найдена: проверьте, что в файл включён раздел с НМЦК (часто он лежит в отдельном обоснования цены)"
NOT_IN_TEXT = " не найдено в тексте документа дословно - проверьте по исходному файлу"
OTHER_VALUE = "{label}: правила нашли в тексте другое значение - "
REQUIREMENTS_RESTORED = "Требования к исполнителю восстановлены правилами: модель не выделила их во фрагментах документа"
PENALTIES_RESTORED = "Штрафы и пени восстановлены правилами: модель не выделила их во фрагментах документа"
CRITICAL = ["не извлечено моделью", "не найдено в тексте", "расходятся"]


def checked_amount(value: Column, fallback: Column, digits: Column, label: str, *, critical: bool) -> tuple[Column, Column]:
    """(amount to keep, array of warnings) for one amount that a model gave and the rules' own."""
    say = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    fmt = T.format_amount
    missing = value.isNull()
    absent = ~T.amount_in_text(value, digits)
    apart = fallback.isNotNull() & ~T.same_amount(value, fallback)
    none = F.array().cast("array<string>")
    if critical:
        lost = F.when(fallback.isNotNull(), F.array(say(NOT_EXTRACTED.format(label=label), fmt(fallback), ")"))).otherwise(F.array(F.lit(PRICE_MISSING)))
    else:
        lost = none
    unseen = F.array(say(f"{label}: значение ", fmt(value), NOT_IN_TEXT))
    unseen = F.when(apart, F.concat(unseen, F.array(say(OTHER_VALUE.format(label=label), fmt(fallback))))).otherwise(unseen)
    differ = F.array(say(f"{label}: модель и правила расходятся (", fmt(value), " против ", fmt(fallback), ") - сверьте с документом"))
    return F.coalesce(value, fallback), F.when(missing, lost).when(absent, unseen).when(apart, differ).otherwise(none)


def filled(value: Column, fallback: Column, *, role: bool = False) -> Column:
    """value, or the rules' own where it is empty or, for a customer, names only a role."""
    empty = F.coalesce(T.strip(value), F.lit("")) == ""
    return F.when(empty | (T.role_only(value) if role else F.lit(False)), F.coalesce(fallback, value)).otherwise(value)


def normal_number(c: Column) -> Column:
    """The 18 to 20 digit token of a procurement number, else the trimmed wording."""
    return F.coalesce(F.nullif(F.regexp_extract(c, r"(?U)\b(\d{18,20})\b", 1), F.lit("")), T.strip(c))


# Patterns and word lists of the refinement.
WORK_STAGE = r"(?:(?:перв\w*|1[-\s]?й|1)\s*этап|(?:втор\w*|2[-\s]?й|2)\s*этап|(?:трет\w*|3[-\s]?й|3)\s*этап|(?:четверт\w*|4[-\s]?й|4)\s*этап|этап\s*(?:№\s*)?\d|разработк\w+\s+проектн\w+\s+документ|выполнени\w+\s+работ|проектирование|капитальн\w+\s+ремонт)"
STAGE_TOKENS = [("stage:1", ["первыйэтап", "1этап", "этап1"]), ("stage:2", ["второйэтап", "2этап", "этап2"]), ("stage:3", ["третийэтап", "3этап", "этап3"]), ("stage:4", ["четвертыйэтап", "4этап", "этап4"])]
QUALIFICATION = ["license", "qualification", "experience", "financial", "staff"]
DOCUMENT_MARKERS = ["сро", "лиценз", "гаранти", "обеспечен", "выписк", "реестр", "экспертиз"]
OPERATIONAL = ["видеофиксац", "мусор", "огражден", "скрытых работ", "антикоррупц", "немедленно известить", "приостановить работ", "перемена подрядчика", "охраны окружающей среды", "вывоз"]
NON_MONETARY = r"(?:рнп|реестр\s+недобросовест|односторонн\w*\s+расторжен|включение\s+в\s+рнп)"
CUSTOMER_SIDE = r"(?:несвоевременн\w+\s+оплат|обязанност\w+\s+заказчик)"
DISCLAIMER = r"(?:расторжен\w+\s+не\s+освобождает|не\s+освобождает\s+от\s+ответственности)"
MONETARY = r"(?:пен[яи]|штраф|неустойк|удержан\w*\s+обеспечен)"


def stage_key(name: Column) -> Column:
    k = T.merge_key(name)
    out = F.left(k, F.lit(100))
    for key, words in reversed(STAGE_TOKENS):
        out = F.when(T.contains_any(k, words), key).otherwise(out)
    return out


def work_stage(name: Column) -> Column:
    return name.rlike(unicode_ci(WORK_STAGE))


def refined_stages(items: Column) -> Column:
    """array<struct<name, deadline>>: work stages, one of each key at the place of the first; the first with a deadline
    is taken if any has one."""
    work = F.filter(items, lambda x: (T.strip(x["name"]) != "") & work_stage(x["name"]))
    keyed = F.transform(work, lambda x: F.struct(stage_key(x["name"]).alias("k"), x.alias("s")))
    dated = lambda k: F.filter(keyed, lambda y: (y["k"] == k) & (F.coalesce(y["s"]["deadline"], F.lit("")) != ""))
    first = distinct_by(keyed, lambda x: x["k"])
    return F.transform(first, lambda x: F.coalesce(F.get(dated(x["k"]), F.lit(0))["s"], x["s"]))


def other_stages(items: Column) -> Column:
    """array<string>: mentions of the stages that aren't work."""
    other = F.filter(items, lambda x: (T.strip(x["name"]) != "") & ~work_stage(x["name"]))
    return F.transform(other, lambda x: F.concat(T.strip(x["name"]), F.when(F.coalesce(x["deadline"], F.lit("")) != "", F.concat(F.lit(" - "), x["deadline"])).otherwise("")))


def requirement_group(category: Column, text: Column) -> Column:
    """0 qualification, 1 documents, 2 other, 3 operational: lists keep their order within a group."""
    low = F.lower(text)
    return F.when(category.isin(QUALIFICATION), 0).when((category == "documents") & T.contains_any(low, DOCUMENT_MARKERS), 1).when(T.contains_any(low, OPERATIONAL), 3).otherwise(2)


def refined_requirements(items: Column) -> Column:
    """array<struct<category, text, ...>> in the order of groups, operational ones limited, all capped."""
    of = lambda g: F.filter(items, lambda x: requirement_group(x["category"], x["text"]) == g)
    return F.slice(F.concat(of(0), of(1), of(2), F.slice(of(3), F.lit(1), F.lit(MAX_OPERATIONAL))), F.lit(1), F.lit(MAX_REQUIREMENTS))


def monetary(violation: Column, sanction: Column, formula: Column, amount: Column) -> Column:
    """Whether a penalty is one of money."""
    v, s = F.lower(violation), F.lower(sanction)
    out = v.rlike(unicode_ci(CUSTOMER_SIDE)) | v.rlike(unicode_ci(DISCLAIMER)) | s.rlike(unicode_ci(NON_MONETARY))
    return ~out & (amount.isNotNull() | F.coalesce(formula.rlike(r"[\d/%]"), F.lit(False)) | s.rlike(unicode_ci(MONETARY)))


def confidence(price: Column, deadlines: Column, requirements: Column, penalties: Column, warnings: Column, sent: Column, total: Column) -> Column:
    """Completeness in 0..1 of booleans for the four sections, warnings and the share of chunks sent."""
    score = F.when(price, 0.3).otherwise(0.0) + F.when(deadlines, 0.25).otherwise(0.0) + F.when(requirements, 0.25).otherwise(0.0) + F.when(penalties, 0.2).otherwise(0.0)
    score = score * F.when((total > 0) & (sent < total), F.lit(0.55) + F.lit(0.45) * sent / total).otherwise(1.0)
    hard = F.size(F.filter(warnings, lambda w: T.contains_any(F.lower(w), CRITICAL)))
    score = score - F.least(F.lit(0.2), hard * 0.08) - F.least(F.lit(0.12), F.greatest(F.size(warnings) - 1, F.lit(0)) * 0.02)
    return F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 2)


def coverage_warnings(partials: Column, selected: Column, total: Column) -> Column:
    """Warnings on chunks that failed or were not sent."""
    say = lambda text, *values: F.concat(*[x for part, v in zip(text.split("{}"), (*values, F.lit(""))) for x in (F.lit(part), v)])
    one = F.when(partials < selected, say(R.SOME_FAILED, partials, selected))
    two = F.when(selected < total, say(R.SOME_SENT, selected, total))
    return F.filter(F.array(one, two), lambda x: x.isNotNull())
