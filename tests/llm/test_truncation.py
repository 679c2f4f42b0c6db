import json

from folium.llm import truncation

SCHEMA = "call_id bigint, source string, text string, meta map<string,string>, cut string"
OBJECT = json.dumps({"a": [1, {"b": "x } y"}], "c": None}, ensure_ascii=False)
LIST = "Найдено:\n- охраны узлов, партия АБ-12/3\n* ремонта опор, партия ВГ-4/5\n— монтажа муфт, партия"
FULL = "По мнению канд. техн. наук А. Б. Иванова (см. рис. 5), срок велик. Прочее без замечаний."


def judge(spark, texts):
    df = spark.createDataFrame([(i, "s", t, {"finish_reason": "stop"}, "x") for i, t in enumerate(texts)], SCHEMA)
    return {r["call_id"]: r["cut"] for r in truncation.judged(df).collect()}


def test_by_text(spark):
    whole = [OBJECT, f"```json\n{OBJECT}\n```", f"Вот:\n{OBJECT}", f"{OBJECT}\nЗамечаний нет.", LIST + " ДЕ-6/7", "Прочее без замечаний.", "Работы «остановлены».", FULL, "Замечаний нет? Да!"]
    cut = [OBJECT[:-3], f"```json\n{OBJECT[:9]}", f"```json\n{OBJECT}", f"{OBJECT}\nЗамечаний н", LIST, LIST + " ДЕ-6", "Прочее без замеч", "Работы «остановлены. Дал", "Всё готово,"]
    got = judge(spark, whole + cut)
    assert [got[i] for i in range(len(whole))] == [False] * len(whole)
    assert [got[len(whole) + i] for i in range(len(cut))] == [True] * len(cut)


def test_prefix_of_longer_units_elsewhere(spark):
    got = judge(spark, [FULL, FULL.replace("А. Б. Иванова", "В. Г. Петрова"), "Прочее без замечаний. По мнению канд.", "Прочее без замечаний."])
    assert got == {0: False, 1: False, 2: True, 3: False}


def test_longer_copy_that_is_itself_a_last_unit(spark):
    assert judge(spark, [FULL.split(" Прочее")[0], "По мнению канд."]) == {0: False, 1: True}


def test_paths(spark):
    """What breaks off inside a word or a JSON value is confirmed by longer copies elsewhere, where there are any."""
    texts = ["Работы приняты без замечаний. Далее.", "Работы приняты без зам", "Другое обор", OBJECT, OBJECT[:-8], '{"q": {"z'] + [LIST + " ДЕ-6/7"] * 2 + [LIST[:-2]]
    df = spark.createDataFrame([(i, "s", t, {}, "x") for i, t in enumerate(texts)], SCHEMA)
    got = {r["call_id"]: (r["by_prefix"], r["by_end"]) for r in truncation.judged(df).collect()}
    assert got == {0: (False, False), 1: (True, True), 2: (False, True), 3: (False, False), 4: (True, True), 5: (False, True), 6: (False, False), 7: (False, False), 8: (True, True)}


def test_nulls_copies_rates(spark):
    df = spark.createDataFrame([(1, "a", "Обрыв тек", None, ""), (1, "a", "Обрыв тек", None, ""), (2, "a", "Готово.", {}, ""), (3, None, "Готово.", None, ""), (4, "a", None, None, ""), (5, "a", " ", None, ""), (None, "a", "Обры", None, "")], SCHEMA)
    assert sorted(map(tuple, truncation.judged(df).select("call_id", "cut").collect())) == [(1, True), (2, False), (3, False)]
    assert {r["source"]: (r["replies"], r["cut_replies"], r["cut_share"]) for r in truncation.rates(df).collect()} == {"a": (2, 1, 0.5), None: (1, 0, 0.0)}
    assert truncation.judged(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_text(spark):
    assert judge(spark, ["Слово. " * 20000, '{"a": "' + "x" * 200000]) == {0: False, 1: True}
