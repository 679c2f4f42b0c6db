import pytest
from pyspark.sql import functions as F

from folium.functions import text as T
from folium.operators import pages


def one(spark, text, expr):
    return spark.createDataFrame([(text,)], "t string").select(expr(F.col("t")).alias("v")).collect()[0]["v"]


@pytest.mark.parametrize(
    "text,amount",
    [("1 000 руб.", 1000), ("1 234 567,89 рублей", 1234567.89), ("12 480 500,00 (двенадцать миллионов) рублей", 12480500), ("500 тыс. руб.", 500000), ("1,5 млн руб.", 1500000), ("99 ₽", 99), ("1234 567 руб.", 234567)],
)
def test_first_money(spark, text, amount):
    assert one(spark, text, T.first_money)["amount"] == pytest.approx(amount)


def test_money_list_positions(spark):
    text = "Цена 100 руб., штраф 2 тыс. руб. и 3 ₽"
    got = [(m["pos"], m["raw"], m["amount"]) for m in one(spark, text, T.money_list)]
    assert got == [(5, "100 руб.", 100.0), (21, "2 тыс. руб.", 2000.0), (35, "3 ₽", 3.0)]
    assert one(spark, "нет сумм", T.money_list) == []


@pytest.mark.parametrize("text,flag", [("10 руб., включая НДС 20 %", True), ("10 руб. без НДС", False), ("10 руб.", None)])
def test_vat(spark, text, flag):
    assert one(spark, text, lambda c: T.first_money(c)["includes_vat"]) is flag


def test_keys_keep_their_differences(spark):
    assert one(spark, "Ёж, 1!", T.dedupe_key) == "ж1"
    assert one(spark, "Ёж, 1!", T.merge_key) == "ёж1"


@pytest.mark.parametrize("text,label", [("просрочки", "other"), ("членство в СРО", "qualification"), ("Лицензия", "license"), (None, None)])
def test_category_at_word_start(spark, text, label):
    assert one(spark, text, T.category) == label


def test_reflow(spark):
    text = "Опыт за\nпоследние годы по статье\n31 закона\n2. Пункт\na | b\nхвост\n\nконец."
    assert one(spark, text, pages.reflow) == "Опыт за последние годы по статье 31 закона\n2. Пункт\na | b\nхвост\n\nконец."
    assert one(spark, "", pages.reflow) == ""


def test_squeeze_and_amount_text(spark):
    assert one(spark, " — а  б: ;", T.squeeze) == "а б"
    assert one(spark, "12 480 500,00", lambda c: T.amount_in_text(F.lit(12480500.0), T.digits_joined(c)))
    assert spark.range(1).select(T.format_amount(F.lit(1234567.891)).alias("v")).collect()[0]["v"] == "1 234 567,89"


def test_noise_and_normalized(spark):
    data = [("d", i, f"Извещение № 017 стр. {i}\nТекст пере-\nнос {i}\n\n\n\nконец {'абвгде'[i - 1]}\n{i}") for i in range(1, 7)]
    df = spark.createDataFrame(data, "doc_id string, page_no int, text string")
    assert [r["mask"] for r in pages.noise_masks(df).collect() if "Извещение" in r["mask"]] == ["Извещение № # стр. #"]
    got = pages.normalized(df).orderBy("page_no").collect()[0]["text"]
    assert got == "Текст перенос 1\n\nконец а"
    short = spark.createDataFrame(data[:2], df.schema)
    assert pages.noise_masks(short).count() == 0


def test_label_value_and_date(spark):
    assert one(spark, "Предмет закупки: ремонт кровли здания школы № 5 в г. Москве. Далее", lambda c: T.label_value(c, ["предмет закупки"])) == "ремонт кровли здания школы № 5 в г. Москве"
    assert one(spark, "до «15» декабря 2026 г.", T.any_date) == "«15» декабря 2026 г."
    assert one(spark, "в течение 30 (тридцати) календарных дней", T.duration_phrase) == "30 календарных дней"
