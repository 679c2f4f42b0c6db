"""Quantities recorded in different units: one value in roubles for each money record (problem 3).

All but the fit is an expression on the JVM. A raw wording is brought to a skeleton (full-width forms, odd spaces, invisible
characters and look-alike letters undone), its number parsed in either notation or from numeral words, its scale and
currency recognised; the unit of a bare number comes from the currency column, and where raw is NULL, amount counts in
that unit. Where no unit is stated anywhere, a log-scale mixture decides: the distribution of log10 roubles of the
records with known units, as a histogram per field, is offset by the known conversion factors; the factors' weights are
fitted by EM over the histogram of the records without units, and each such record gets the factor of greatest
posterior. `uncertain` flags posteriors below `confident`. A field is fitted by its own records alone, on the executors,
so neither the number of fields nor what the others hold changes its results.

Cases: a record without any number has rub NULL and unit_from 'none', as has a percentage; unknown units count as
missing; ties between factors go to the smaller, and in a field without any known rouble sum all factors tie, so its
records are `uncertain`; repeated rows of a key count once (`dedupe`); the histograms have at most BINS + 1 bins per
field, for any number of fields; of several rates of a currency the greatest holds; a unit without a rate gives rub NULL and `uncertain`;
other columns are kept, but for those named like a result, which are replaced; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folium.functions.rx import let
from folium.plans.ship import ensure_shipped, written

# Characters and what they look like, spaces, invisible characters.
LATIN, CYRILLIC = "aceopxykmthαορё", "асеорхукмтнаоре"
FULL = "０１２３４５６７８９，．％（）＄￥"
PLAIN = "0123456789,.%()$¥"
INVISIBLE = "[\\u00ad\\u200b-\\u200f\\u2060\\ufeff\\u0300-\\u0305]"
SPACES = "[\\u00a0\\u1680\\u2000-\\u200a\\u202f\\u205f\\u3000\\t\\n\\r]"

# Units by stem, most specific first; the factor of a scale.
CURRENCIES = [
    ("BYN", "бел[а-я.]* ?руб|byn"),
    ("RUB", "руб|₽|rub|rur"),
    ("USD", "долл|usd|\\$"),
    ("EUR", "евро|eur|€"),
    ("CNY", "юан|cny"),
    ("KZT", "тенге|kzt|₸"),
    ("JPY", "иен|йен|jpy|¥"),
]
SCALES = [(10**12, "трлн|триллион|trn"), (10**9, "млрд|миллиард|bln|billion"), (10**6, "млн|миллион|mln|million"), (10**3, "тыс|thousand")]
NUMERALS = {
    "ноль": 0, "один": 1, "одна": 1, "одну": 1, "два": 2, "две": 2, "три": 3, "четыре": 4, "пять": 5, "шесть": 6, "семь": 7, "восемь": 8, "девять": 9, "десять": 10,
    "одиннадцать": 11, "двенадцать": 12, "тринадцать": 13, "четырнадцать": 14, "пятнадцать": 15, "шестнадцать": 16, "семнадцать": 17, "восемнадцать": 18, "девятнадцать": 19,
    "двадцать": 20, "тридцать": 30, "сорок": 40, "пятьдесят": 50, "шестьдесят": 60, "семьдесят": 70, "восемьдесят": 80, "девяносто": 90,
    "сто": 100, "двести": 200, "триста": 300, "четыреста": 400, "пятьсот": 500, "шестьсот": 600, "семьсот": 700, "восемьсот": 800, "девятьсот": 900,
}

#: Factors that a missing unit may stand for: kopecks, roubles, thousands, millions, milliards.
FACTORS = (0.01, 1.0, 1e3, 1e6, 1e9)
BIN, BINS = 0.1, 400
#: Weights of the bins around a known value's own.
SMOOTH = [math.exp(-((d / 5) ** 2)) for d in range(-10, 11)]
MONEY = "decimal(38,6)"


def _spell(pattern: str) -> str:
    """A pattern in the letters of the skeleton; escapes are kept."""
    return re.sub(r"\\.|.", lambda m: m[0] if m[0][0] == "\\" else m[0].translate(str.maketrans(LATIN, CYRILLIC)), pattern)


def skeleton(c: Column) -> Column:
    """Lower-case form in which look-alike spellings are equal; for recognition only."""
    c = F.regexp_replace(F.regexp_replace(c, INVISIBLE, ""), SPACES, " ")
    c = F.translate(F.lower(F.translate(c, FULL, PLAIN)), LATIN, CYRILLIC)
    # letters that stand for digits
    c = F.regexp_replace(c, r"(?<=\d)[оo](?=[\d ,.]|$)|(?<=[\d ,.])о(?=\d)", "0")
    c = F.regexp_replace(c, r"(?<=\d)з(?=[\d ,.]|$)|(?<![\p{L}])з(?=\d| \d{3}(?!\d))", "3")
    c = F.regexp_replace(c, r"(?<=\d)[li|](?=[\d ,.]|$)", "1")
    return F.trim(F.regexp_replace(c, " +", " "))


def _currency(c: Column) -> Column:
    out = F.lit(None).cast("string")
    for code, pattern in reversed(CURRENCIES):
        out = F.when(c.rlike(_spell(pattern)), code).otherwise(out)
    return F.when(c.rlike("коп") & ~c.rlike("руб|₽|rub"), "KOP").otherwise(out)


def _scale(c: Column) -> Column:
    out = F.lit(1).cast("bigint")
    for factor, pattern in reversed(SCALES):
        out = F.when(c.rlike(f"(?<!\\p{{L}})(?:{_spell(pattern)})"), F.lit(factor).cast("bigint")).otherwise(out)
    return out


NUMBER = r"(\d{1,3}(?:[ .,']\d{3})+(?:[.,]\d{1,2})?(?!\d)|\d+(?:[.,]\d+)?)"


def _number(text: Column, scaled: Column) -> Column:
    """Decimal of a number in Russian, German or English notation."""
    t = text  # without spaces
    comma, point = F.instr(t, ","), F.instr(t, ".")
    last_comma, last_point = F.length(t) - F.instr(F.reverse(t), ","), F.length(t) - F.instr(F.reverse(t), ".")
    both = (comma > 0) & (point > 0)
    mark = F.when(both, F.when(last_comma > last_point, ",").otherwise(".")).when(comma > 0, ",").when(point > 0, ".")
    times = F.length(t) - F.length(F.replace(t, F.coalesce(mark, F.lit(",")), F.lit("")))
    # one kind of mark before three digits groups thousands, unless a scale follows
    groups = ~both & ((times > 1) | (t.rlike(r"^\d{1,3}[.,]\d{3}$") & ~scaled))
    whole = F.when(mark.isNull() | groups, F.regexp_replace(t, "[.,]", ""))
    other = F.when(mark == ",", F.translate(t, ".", "")).otherwise(F.translate(t, ",", ""))
    return F.coalesce(whole, F.replace(other, F.lit(","), F.lit("."))).try_cast(MONEY)


def _words_number(c: Column) -> Column:
    """Value of numeral words, NULL where there is none."""
    names = F.create_map(*[x for k, v in NUMERALS.items() for x in (F.lit(k), F.lit(v).cast("bigint"))])
    scale = lambda w: F.when(w.rlike("^тысяч"), F.lit(1000).cast("bigint")).when(w.rlike("^миллион"), F.lit(10**6).cast("bigint")).when(w.rlike("^миллиард"), F.lit(10**9).cast("bigint"))
    zero = F.struct(F.lit(0).cast("bigint").alias("total"), F.lit(0).cast("bigint").alias("part"), F.lit(False).alias("some"))

    def step(acc: Column, w: Column) -> Column:
        value, factor = F.try_element_at(names, w), scale(w)
        return F.struct(
            (acc["total"] + F.when(factor.isNotNull(), F.greatest(acc["part"], F.lit(1).cast("bigint")) * factor).otherwise(0)).alias("total"),
            F.when(factor.isNotNull(), 0).otherwise(acc["part"] + F.coalesce(value, F.lit(0).cast("bigint"))).cast("bigint").alias("part"),
            (acc["some"] | value.isNotNull()).alias("some"),
        )

    done = F.aggregate(F.split(c, r"[ ,.]+"), zero, step)
    return F.when(done["some"], done["total"] + done["part"]).cast(MONEY)


def parsed(amount: Column, currency: Column, raw: Column) -> Column:
    """struct(number, scale, unit, unit_from); unit_from is raw, currency or missing, none without a sum."""

    def read(x: Column) -> Column:
        s, found = x["s"], x["found"]
        spelled = F.when((found == "") & (s != ""), _words_number(s))
        return let(F.struct(x["s"].alias("s"), found.alias("found"), x["cur"].alias("cur"), _currency(s).alias("unit"), _scale(s).alias("scale"), spelled.alias("spelled")), units)

    def units(x: Column) -> Column:
        s, found = x["s"], x["found"]
        kopecks = F.coalesce(F.regexp_extract(s, r"(?:руб[а-я.]*|₽|rub) ?(\d{1,2}) ?коп", 1).try_cast(MONEY) / 100, F.lit(0)).cast(MONEY)
        number = (
            F.when(s == "", amount.cast(MONEY))
            .when(s.rlike(NUMBER + " ?(?:%|процент)"), F.lit(None))
            .when(found != "", let(F.regexp_replace(found, "[ ']", ""), lambda f: _number(f, x["scale"] > 1)) + (kopecks / x["scale"]).cast(MONEY))
            .otherwise(x["spelled"])
            .cast(MONEY)
        )
        return let(F.struct(number.alias("number"), (s == "").alias("blank"), x["unit"].alias("unit"), F.when(x["spelled"].isNotNull(), F.lit(1).cast("bigint")).otherwise(x["scale"]).alias("scale"), _currency(x["cur"]).alias("cur_unit"), _scale(x["cur"]).alias("cur_scale")), chosen)

    def chosen(x: Column) -> Column:
        by_raw = x["unit"].isNotNull() & ~x["blank"]
        source = F.when(x["number"].isNull(), "none").when(by_raw, "raw").when(x["cur_unit"].isNotNull(), "currency").otherwise("missing")
        unit = F.when(x["number"].isNotNull(), F.when(by_raw, x["unit"]).otherwise(x["cur_unit"]))
        # a scale in raw without a currency ("5 млн") scales too, before that of the currency column
        scale = F.when(by_raw | (x["scale"] > 1) | x["cur_unit"].isNull(), x["scale"]).otherwise(x["cur_scale"])
        return F.struct(x["number"].alias("number"), scale.alias("scale"), unit.alias("unit"), source.alias("unit_from"))

    clean = F.regexp_replace(F.coalesce(skeleton(raw), F.lit("")), r"\([^)]*\)?", " ")
    # words in parentheses, the quantity a price is for and the note on VAT don't change the sum
    clean = F.regexp_replace(clean, r"(?<!\p{L})за +\d.*$|(?<!\p{L})(?:с|без|вкл[а-я.]*|в том числе|в т\. ?ч\.)?,? *ндс.*$", " ")
    clean = F.trim(F.regexp_replace(clean, " +", " "))
    return let(clean, lambda s: let(F.struct(s.alias("s"), F.regexp_extract(s, NUMBER, 1).alias("found"), F.coalesce(skeleton(currency), F.lit("")).alias("cur")), read))


def fit_factors(known: dict[int, int], missing: dict[int, int], *, rounds: int = 60) -> dict[int, tuple[float, float]]:
    """For each bin of log10 of a number without unit: the factor of greatest posterior and that posterior.

    known and missing are histograms over bins of BIN decades; the density of known values is smoothed over one decade.
    """
    if not missing:
        return {}
    total = sum(known.values())
    density: dict[int, float] = {}
    for b, n in known.items():
        for at, x in enumerate(SMOOTH, b - len(SMOOTH) // 2):
            density[at] = density.get(at, 0.0) + n * x
    shifts = [round(math.log10(f) / BIN) for f in FACTORS]
    like = {b: [(density.get(b + s, 0.0) / total if total else 0.0) + 1e-9 for s in shifts] for b in missing}
    weights = [1 / len(FACTORS)] * len(FACTORS)
    for _ in range(rounds):
        got = [0.0] * len(FACTORS)
        for b, n in missing.items():
            joint = [w * x for w, x in zip(weights, like[b])]
            whole = sum(joint)
            got = [g + n * j / whole for g, j in zip(got, joint)]
        whole = sum(got) + 0.5 * len(FACTORS)
        last, weights = weights, [(g + 0.5) / whole for g in got]
        if weights == last:  # further rounds would repeat it
            break
    out = {}
    for b in missing:
        joint = [w * x for w, x in zip(weights, like[b])]
        k = max(range(len(FACTORS)), key=lambda i: (joint[i], -i))
        out[b] = (FACTORS[k], joint[k] / sum(joint))
    return out


def convert(money: DataFrame, rates: DataFrame, *, key: str = "money_id", amount: str = "amount", currency: str = "currency", raw: str = "raw", field: str = "field", confident: float = 0.9, dedupe: bool = True) -> DataFrame:
    """Adds rub (exact decimal), unit_from, unit, posterior and uncertain to each record."""
    money = money.drop("number", "scale", "unit", "unit_from", "posterior", "rub", "uncertain", "_p", "_v", "_bin", "_rate", "_factor", "_fit_field", "_fit_bin")
    df = money.withColumn("_p", parsed(F.col(amount), F.col(currency), F.col(raw))).select("*", "_p.number", "_p.scale", "_p.unit", "_p.unit_from").drop("_p")
    df = df.withColumn("_v", F.col("number").cast("double") * F.col("scale"))
    bin_ = F.when(F.col("_v") > 0, F.greatest(F.lit(-BINS // 2), F.least(F.lit(BINS // 2), F.round(F.log10("_v") / BIN).cast("int"))))
    # the histograms and the result read the parsed records, which are written once to the shared folder
    df = written(df.withColumn("_bin", bin_).drop("_v"))
    df = df.dropDuplicates([key]) if dedupe else df
    per = rates.where("currency IS NOT NULL AND nominal <> 0 AND rub IS NOT NULL").groupBy(F.col("currency").alias("unit")).agg(F.max(F.col("rub") / F.col("nominal")).cast("decimal(18,8)").alias("_rate"))
    df = df.join(per, "unit", "left")
    rate = F.when(F.col("unit") == "RUB", F.lit("1").cast("decimal(18,8)")).when(F.col("unit") == "KOP", F.lit("0.01").cast("decimal(18,8)")).otherwise(F.col("_rate"))
    # a row per field and bin without units; Spark broadcasts the table where its written size allows it
    here = F.col("_fit_bin").eqNullSafe(F.col("_bin")) & (F.col("unit_from") == "missing") & F.col("_fit_field").eqNullSafe(F.col(field).cast("string"))
    df = df.join(written(_fitted(df, field)), here, "left").drop("_fit_bin", "_fit_field")
    df = df.withColumn("posterior", F.when(F.col("unit_from") == "missing", F.col("posterior")).when(F.col("unit_from") != "none", F.lit(1.0)))
    df = df.withColumn("rub", (F.col("number") * F.col("scale").cast("decimal(14,0)")).cast("decimal(28,6)") * F.when(F.col("unit_from") == "missing", F.col("_factor")).otherwise(rate))
    unsure = (F.col("unit_from") != "none") & (F.col("rub").isNull() | (F.coalesce("posterior", F.lit(0.0)) < confident))
    return df.withColumn("uncertain", F.coalesce(unsure, F.lit(False))).select(*money.columns, "number", "scale", "unit", "unit_from", "posterior", "rub", "uncertain")


def _fitted(df: DataFrame, field: str) -> DataFrame:
    """The factor and its posterior for each field and bin of records without units; a field is fitted in one task."""
    ensure_shipped(df.sparkSession)
    lost = F.col("unit_from") == "missing"
    known = F.col("unit_from").isin("raw", "currency") & (F.col("unit") == "RUB")
    bins = df.where(F.col("_bin").isNotNull() & (lost | known)).groupBy(F.col(field).cast("string").alias("f"), F.col("_bin").alias("b")).agg(F.count_if(known).alias("known"), F.count_if(lost).alias("lost"))
    # BINS + 1 bins at most; in order, so that sums of the fit are the same each time
    fields = bins.groupBy("f").agg(F.sum("lost").alias("n"), F.sort_array(F.collect_list(F.struct("b", "known", "lost"))).alias("bins")).where("n > 0").select("f", "bins")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple]) -> pa.RecordBatch:
            c = list(zip(*rows))
            return pa.RecordBatch.from_arrays([pa.array(c[0], pa.string()), pa.array(c[1], pa.int32()), pa.array(c[2], pa.string()), pa.array(c[3], pa.float64())], names=["_fit_field", "_fit_bin", "factor", "posterior"])

        rows: list[tuple] = []
        for batch in batches:
            for f, bins in zip(*batch.columns):
                hist = bins.as_py()
                fitted = fit_factors({x["b"]: x["known"] for x in hist if x["known"]}, {x["b"]: x["lost"] for x in hist if x["lost"]})
                rows += [(f.as_py(), b, str(factor), p) for b, (factor, p) in fitted.items()]
                if len(rows) >= 10_000:
                    yield out(rows)
                    rows = []
        if rows:
            yield out(rows)

    table = fields.mapInArrow(run, "_fit_field string, _fit_bin int, factor string, posterior double")
    return table.select("_fit_field", "_fit_bin", F.col("factor").cast("decimal(18,8)").alias("_factor"), "posterior")


def wrong_amounts(converted: DataFrame, *, key: str = "money_id", amount: str = "amount") -> DataFrame:
    """Records that state a sum, surely, whose amount is NULL or another: key and rub in whole roubles."""
    off = F.col(amount).isNull() | (F.abs(F.col(amount) - F.col("rub").cast("double")) > 0.0051)
    return converted.where(F.col("rub").isNotNull() & ~F.col("uncertain") & off).select(F.col(key).cast("bigint").alias(key), F.round("rub", 0).cast("bigint").alias("rub"))


def struck(converted: DataFrame, *, key: str = "money_id", field: str = "field") -> DataFrame:
    """The records with a sum in roubles twice: as they are, and as copies whose raw is a bare number in thousands or
    millions or single roubles, a unit for each field, that is stated nowhere. For measuring what the mixture recovers."""
    known = converted.where(F.col("rub") > 0).select(key, field, "rub")
    factor = F.element_at(F.array(*[F.lit(x) for x in ("1", "1000", "1000000")]), (F.crc32(F.coalesce(F.col(field).cast("string"), F.lit("")).cast("binary")) % 3 + 1).cast("int")).cast("decimal(9,0)")
    none = F.lit(None)
    plain = known.select(key, field, none.cast("double").alias("amount"), F.lit("RUB").alias("currency"), F.concat(F.col("rub").cast("decimal(28,2)").cast("string"), F.lit(" руб.")).alias("raw"), none.cast("decimal(28,6)").alias("truth"))
    bare = known.select((-F.col(key) - 1).alias(key), field, none.cast("double").alias("amount"), none.cast("string").alias("currency"), (F.col("rub") / factor).cast("decimal(30,6)").cast("string").alias("raw"), F.col("rub").alias("truth"))
    return plain.unionByName(bare)
