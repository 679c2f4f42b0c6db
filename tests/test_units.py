from decimal import Decimal

import pytest

from folium.operators import units

SCHEMA = "money_id bigint, field string, amount double, currency string, raw string, number string"
CASES = [
    # amount, currency, raw, roubles
    (None, "RUB", "1 234 567,89 руб.", "1234567.89"),
    (1.0, "RUB", "29.633,30 RUB", "29633.30"),
    (1.0, "RUB", "EUR 59,136.00", "5832690.12"),
    (1.0, "RUB", "8,2 тыс. долл. США", "749703.86"),
    (1.0, "RUB", "11 220 рублей 73 коп.", "11220.73"),
    (1.0, "коп.", "55151066 копеек", "551510.66"),
    (1.0, "RUB", "четыре миллиона сто тысяч рублей", "4100000"),
    (1.0, "RUB", "12 ０00,００ рyб без НДС", "12000"),
    (1.0, "RUB", "14 198,07 (девять миллионов …) руб.", "14198.07"),
    (1.0, "RUB", "2 008,79 руб. за 1 тыс. км", "2008.79"),
    (1.0, "RUB", "829 656,00 рублей, включая НДС 20 %", "829656"),
    (1.0, "миллиона рублей", "999,2", "999200000"),
    (46.56, "млн руб.", None, "46560000"),
    (100.0, "JPY", None, "60.7529"),
    (1.0, "RUB", "105З6123 рублей", "10536123"),
    (1.0, "RUB", "60,29 % от цены контракта", None),
    (None, None, None, None),
    (5.0, "RUB", "", "5"),
]


@pytest.fixture
def rates(spark):
    return spark.createDataFrame([("USD", 1, 91.4273), ("EUR", 1, 98.6318), ("JPY", 100, 60.7529)], "currency string, nominal int, rub double")


def test_wordings(spark, rates):
    data = [(i, "f", a, c, r, "x") for i, (a, c, r, _) in enumerate(CASES)]
    got = {r["money_id"]: r["rub"] for r in units.convert(spark.createDataFrame(data, SCHEMA), rates).select("money_id", "rub").collect()}
    for i, (_, _, raw, want) in enumerate(CASES):
        have = got[i]
        assert (have is None) == (want is None), (raw, have)
        assert want is None or abs(have - Decimal(want)) < Decimal("0.01"), (raw, have)


def test_wrong_amounts_and_copies(spark, rates):
    data = [(1, "f", 10.0, "RUB", "10 руб.", "x"), (2, "f", 10.0, "RUB", "10 тыс. руб.", "x"), (2, "f", 10.0, "RUB", "10 тыс. руб.", "x"), (3, "f", None, "RUB", "7 руб.", "x")]
    out = units.wrong_amounts(units.convert(spark.createDataFrame(data, SCHEMA), rates))
    assert sorted(map(tuple, out.collect())) == [(2, 10000), (3, 7)]


def test_missing_units_by_posterior(spark, rates):
    known = [(i, "f", None, "RUB", f"{1_000_000 + 9_000 * i} руб.", "x") for i in range(200)]
    lost = [(1000 + i, "f", None, None, f"{1 + i / 100:.2f}".replace(".", ","), "x") for i in range(40)]
    out = units.convert(spark.createDataFrame(known + lost, SCHEMA), rates).where("money_id >= 1000").collect()
    assert {r["unit_from"] for r in out} == {"missing"}
    assert all(1_000_000 <= r["rub"] < 2_000_000 for r in out)
    assert all(0 <= r["posterior"] <= 1 for r in out)


def test_empty_and_clashing(spark, rates):
    assert units.convert(spark.createDataFrame([], SCHEMA), rates).count() == 0
    out = units.convert(spark.createDataFrame([(1, "f", 1.0, "RUB", "2 руб." + " " * 10000, "own")], SCHEMA).drop("number"), rates)
    assert out.collect()[0]["rub"] == 2


def test_more_fields_than_histograms_lose_no_bin(spark, rates):
    """Beyond MAX_FIELDS the histograms are pooled; every record without a unit still gets a value."""
    known = [(i, f"f{i % 70}", None, "RUB", f"{10 ** (i % 9)}{i % 10} руб.", "x") for i in range(1400)]
    lost = [(10_000 + i, f"f{i % 70}", None, None, f"{10 ** (i % 9)}{i % 7}", "x") for i in range(1400)]
    out = units.convert(spark.createDataFrame(known + lost, SCHEMA), rates).where("money_id >= 10000").collect()
    assert len(out) == 1400 and all(r["rub"] is not None and r["posterior"] is not None for r in out)


def test_a_field_is_fitted_alone_however_many_there_are(spark, rates):
    """Another field, the 65th or any, and its records don't change what a field's own records say; a NULL field is one too."""
    names = [None, *[f"f{k}" for k in range(63)]]
    top = [10 ** (3 + 3 * (k % 2)) for k in range(64)]
    known = [(1000 * k + i, f, None, "RUB", f"{top[k] + top[k] // 20 * i} руб.", "x") for k, f in enumerate(names) for i in range(10)]
    lost = [(1000 * k + 500 + i, f, None, None, f"{1 + i / 10:.2f}", "x") for k, f in enumerate(names) for i in range(5)]
    more = [(10**6, "f64", None, "RUB", "5 руб.", "x"), (10**6 + 1, "f65", None, None, "7", "x")]

    def values(data):
        done = units.convert(spark.createDataFrame(data, SCHEMA), rates).where("unit_from = 'missing' AND money_id < 1000000")
        return {r["money_id"]: (r["rub"], r["posterior"], r["uncertain"]) for r in done.select("money_id", "rub", "posterior", "uncertain").collect()}

    few = values(known + lost)
    assert len(few) == 320 and all(top[k // 1000] <= rub < 2 * top[k // 1000] and not unsure for k, (rub, _, unsure) in few.items())
    assert values(known + lost + more) == few
    assert values([x for x in known + lost if x[0] < 2000]) == {k: v for k, v in few.items() if k < 2000}


def test_units_without_or_with_several_rates(spark):
    rates = spark.createDataFrame([("USD", 1, 90.0), ("USD", 1, 91.0), ("USD", 1, 91.0)], "currency string, nominal int, rub double")
    data = [(1, "f", None, "RUB", "2 USD", "x"), (2, "f", None, "RUB", "2 EUR", "x"), (3, None, None, None, None, "x")]
    got = {r["money_id"]: (r["rub"], r["uncertain"]) for r in units.convert(spark.createDataFrame(data, SCHEMA), rates).collect()}
    assert got == {1: (182, False), 2: (None, True), 3: (None, False)}


def test_struck_units_come_back(spark, rates):
    data = [(i, f"f{i % 4}", None, "RUB", f"{1_000_000 + 7_000 * i} руб.", "x") for i in range(400)]
    out = units.convert(units.struck(units.convert(spark.createDataFrame(data, SCHEMA), rates)), rates).where("truth IS NOT NULL").collect()
    assert sum(abs(r["rub"] - r["truth"]) < 1 for r in out) > 390 and len(out) == 400
