import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folium import queries
from folium.operators import chunks, facts, jsonrepair, merging, provider, reconcile, tokens
from folium.plans import summarize
from folium.sources import ingest
from folium.streaming import progress

PAGE_ONE = """Извещение № 0373200000022600039
Заказчик: ГБУ «Центр развития города Энска»
Предмет закупки: выполнение работ по ремонту кровли здания школы
Начальная (максимальная) цена контракта составляет 3 250 000,50 рублей, включая НДС 20 %.
Обеспечение исполнения контракта: 162 500,00 руб.
Срок начала работ: 01.04.2026. Срок окончания работ: 30.09.2026.
Срок выполнения работ составляет 90 календарных дней."""
PAGE_TWO = """Требования к участникам закупки
1. Участник обязан иметь действующую лицензию на выполнение работ.
2. Опыт исполнения не менее двух контрактов за последние три года.
Ответственность сторон
За каждый день просрочки начисляется пеня в размере 0,1 % от цены контракта.
[ТАБЛИЦА]
Нарушение | Мера ответственности | Размер
Отсутствие журнала работ | Штраф | 10 000,00 руб."""


@pytest.fixture
def page_rows(spark):
    return spark.createDataFrame([("a", 1, PAGE_ONE), ("a", 2, PAGE_TWO), ("b", 1, None), ("b", 2, "  ")], "doc_id string, page_no int, text string")


def test_summary_by_rules(spark, page_rows):
    out = {r["doc_id"]: r for r in summarize.flat(summarize.summarize(page_rows)).collect()}
    a = out["a"]
    assert a["contract_price"] == 3250000.5 and a["contract_security"] == 162500.0
    assert a["start"] == "01.04.2026" and a["end"] == "30.09.2026" and a["duration"] == "90 календарных дней"
    assert a["customer"] == "«Центр развития города Энска»" and a["subject"].startswith("выполнение работ")
    assert a["n_requirements"] == 2 and a["n_penalties"] == 2 and a["confidence"] == 1.0
    assert "b" not in out


def test_summary_with_provider(spark, page_rows):
    reply = json.dumps({"contract_price": {"amount": "9 999 999"}, "warnings": []})
    out = summarize.summarize(page_rows, lambda: provider.Scripted(lambda user, attempt: "```json\n" + reply)).collect()
    assert out[0]["contract_price"] == 9999999.0 and len([w for w in out[0]["warnings"] if "не найдено" in w or "другое" in w]) == 2


@pytest.mark.parametrize("text", ["", "one", "A. B\nC", "a; B! 9", "x\r\ny\n", "😀. Я"])
def test_offsets_point_at_pieces(spark, text):
    df = spark.createDataFrame([(1, text)], "k int, text string")
    for r in tokens.sentences(df, "k").collect():
        assert text[r["pos"] : r["pos"] + len(r["text"])] == r["text"]
    assert [r["text"] for r in tokens.lines(df, "k").orderBy("pos").collect()] == [x.strip() for x in text.splitlines()]


def test_page_of(spark):
    pos = spark.createDataFrame([("d", 0), ("d", 10), ("d", 25)], "doc_id string, pos int")
    marks = spark.createDataFrame([("d", 10, 4), ("d", 20, 5)], "doc_id string, pos int, page_no int")
    assert sorted((r["pos"], r["page_no"]) for r in tokens.page_of(pos, marks).collect()) == [(0, None), (10, 4), (25, 5)]
    text = spark.createDataFrame([("x[[стр. 4]]yy[[стр. 5]]z",)], "t string")
    got = text.select(*[tokens.page_at(F.col("t"), F.lit(p)).alias(f"p{p}") for p in (0, 1, 13, 22)]).collect()[0]
    assert tuple(got) == (None, 4, 5, 5)


def test_packing_budget_overlap_and_partitions(spark):
    data = [("d", i, f"Страница {i}. " + "текст " * 150) for i in range(1, 13)] + [("e", 1, "абзац. " * 2000), ("f", 1, None)]
    df = spark.createDataFrame(data, "doc_id string, page_no int, text string")
    got = [sorted(map(tuple, chunks.packed(df.repartition(n), chunk_chars=2000, overlap_chars=200).collect())) for n in (1, 4, 13)]
    assert got[0] == got[1] == got[2]
    assert all(len(r[2]) <= 3000 for r in got[0]) and {r[0] for r in got[0]} == {"d", "e"}
    d = [r for r in got[0] if r[0] == "d"]
    assert [r[1] for r in d] == list(range(len(d))) and d[0][3] == 1 and d[-1][4] == 12


def test_selection_keeps_first_and_order(spark):
    df = spark.createDataFrame([("d", i, s) for i, s in enumerate([0.0, 5.0, 5.0, 1.0, None])], "doc_id string, chunk_idx int, score double")
    assert sorted(r["chunk_idx"] for r in chunks.selected(df, max_chunks=3).collect()) == [0, 1, 2]


JSON_CASES = [
    ('{"a": 1}', {"a": 1}), ('```json\n{"a": [1, 2,],}\n```', {"a": [1, 2]}), ('Вот: {"a": "x}y"} готово', {"a": "x}y"}), ('{"a": None, "b": True}', {"a": None, "b": True}),
    ('{"a": {"b": "не законч', {"a": {"b": "не законч"}}), ('{"a": 1, "b":', {"a": 1}), ('[1, {"a": 2}]', {"a": 2}), ("", None), ("просто текст", None), ("[1, 2]", None),
]


@pytest.mark.parametrize("raw,want", JSON_CASES)
def test_json_cases(raw, want):
    assert jsonrepair.parse_object(raw) == want


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.text(max_size=5), st.one_of(st.integers(), st.text(max_size=8), st.none(), st.lists(st.integers(), max_size=3)), max_size=4))
def test_json_round_trip(value):
    text = json.dumps(value, ensure_ascii=False)
    assert jsonrepair.parse_object(text) == value
    assert jsonrepair.parse_object(f"```json\n{text}\n```") == value


def test_validation(spark):
    data = [("{}", None), ('{"requirements": null}', "requirements is null"), ('{"requirements": [{"category": "x"}]}', "requirements without text"), ('{"confidence": 2}', "confidence out of range"), ('{"confidence": "0.5", "warnings": []}', None), (None, "no object"), ('{"deadlines": null}', "deadlines is null")]
    df = spark.createDataFrame([(i, j) for i, (j, _) in enumerate(data)], "i int, json string")
    assert [r["fault"] for r in jsonrepair.validated(df).orderBy("i").collect()] == [f for _, f in data]


def test_fuzzy_and_best(spark):
    long = "участник обязан иметь опыт исполнения двух контрактов на ремонт"
    df = spark.createDataFrame([(1, [(long[:50], [4]), (long, [3]), ("короткий", [1]), ("короткий", [0]), (" ", [9])])], "k int, x array<struct<text:string,pages:array<int>>>")
    got = df.select(merging.fuzzy_distinct(F.col("x")).alias("v")).collect()[0]["v"]
    assert [(x["text"], x["pages"]) for x in got] == [(long, [3, 4]), ("короткий", [1])]
    m = spark.createDataFrame([(1, None, None), (2, 5.0, None), (3, 6.0, "6 руб."), (4, 7.0, "7 руб.")], "i int, a double, r string")
    assert m.agg(merging.best_money(F.col("a"), F.col("r"), F.col("i"), F.col("a"))).collect()[0][0] == 6.0


def test_confidence_values(spark):
    t, f = F.lit(True), F.lit(False)
    no = F.array().cast("array<string>")
    c = lambda *a: reconcile.confidence(*a)
    row = spark.range(1).select(c(f, f, f, f, no, F.lit(1), F.lit(1)).alias("a"), c(t, f, f, f, no, F.lit(1), F.lit(1)).alias("b"), c(t, t, t, t, no, F.lit(12), F.lit(25)).alias("c"), c(t, t, t, t, F.array(F.lit("x"), F.lit("значения расходятся")), F.lit(1), F.lit(1)).alias("d")).collect()[0]
    assert tuple(row) == (0.0, 0.3, 0.77, 0.9)


def test_provider_retries_and_rejects(spark):
    df = spark.createDataFrame([("a", 0, "ok", 1, 1), ("b", 0, "flaky", 1, 2), ("c", 0, "broken", 2, 2)], "doc_id string, chunk_idx int, text string, first_page int, last_page int")

    def script(user, attempt):
        if "flaky" in user and attempt == 1:
            raise provider.ProviderError("503", True)
        if "broken" in user:
            raise provider.ProviderError("400", False)
        return "{}"

    out = provider.called(df, lambda: provider.Scripted(script), wait=lambda n: 0.0).cache()
    assert sorted((r["doc_id"], r["attempts"], r["failure"]) for r in out.collect()) == [("a", 1, None), ("b", 2, None), ("c", 1, "400")]
    assert [tuple(r) for r in provider.unavailable(out).collect()] == [("c", "provider_unavailable", "400")]


def test_admission(spark):
    ok, png = b" \n%PDF-1.7", b"\x89PNG"
    data = [("a", "a.pdf", None, ok), ("b", "b.txt", "text/plain", ok), ("c", "c.pdf", "application/pdf", png), ("d", "d.pdf", None, None), ("e", "e.txt", None, ok), ("f", None, "", ok), ("a", "a.pdf", None, ok)]
    df = spark.createDataFrame([(*r, len(r[3] or b"")) for r in data], "doc_id string, filename string, content_type string, content binary, size_bytes long")
    assert sorted((r["doc_id"], r["code"], r["status"]) for r in ingest.rejects(df).collect()) == [("b", "unsupported_file", 415), ("c", "unreadable_pdf", 422), ("d", "unsupported_file", 415), ("e", "unsupported_file", 415)]


def test_occurrences(spark):
    df = spark.createDataFrame([("Штраф за x и ШТРАФ за y",)], "t string")
    assert [tuple(r) for r in df.select(facts.occurrences(F.col("t"), ["нет", "штраф"]).alias("o")).collect()[0]["o"]] == [(0, 1, 0), (0, 1, 13)]


def test_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "doc_id string, chunk_idx int").write.parquet(src)
    got = []
    q = progress.run_batches(progress.arriving(spark, src, "doc_id string, chunk_idx int"), lambda df, n: got.extend(map(tuple, progress.progress(df).collect())), str(tmp_path / "state"))
    q.awaitTermination(60)
    assert sorted(got) == [("a", 2), ("b", 1)]


def test_unique_texts_compare_whole_chunks(spark, tmp_path):
    head = "[[стр. 3]]\nПроект контракта на капитальный ремонт кровли. "
    rows = [("d", 1, head + "Цена."), ("d", 2, head + "Сроки."), ("d", 3, head + "Цена!"), ("d", 3, head + "Цена!")]
    spark.createDataFrame(rows, "doc_id string, chunk_id long, text string").write.parquet(str(tmp_path / "chunks.parquet"))
    assert sorted(map(tuple, queries.merge_unique_texts(spark, str(tmp_path)).collect())) == [("d", 1), ("d", 2)]


def test_every_field_of_replies_is_merged(spark, page_rows):
    long = "Участник обязан иметь опыт исполнения двух контрактов на ремонт"
    one = {"subject": " ", "contract_security": {"amount": 5}, "procurement_number": "7", "deadlines": {"end": "31.12.2030", "stages": [{"name": "Этап 1", "deadline": "май"}], "raw_mentions": ["до мая"]}, "requirements": [{"category": "staff", "text": long[:50], "mandatory": False, "source_pages": [2]}], "penalties": [{"violation": "срыв", "sanction": "штраф"}], "warnings": ["Скан нечёткий"]}
    two = {"subject": "ремонт", "contract_security": {"amount": 6, "raw": "6 руб."}, "requirements": [{"category": "STAFF", "text": long, "source_pages": [1]}], "penalties": [{"violation": "Срыв!", "sanction": "штраф", "formula": "1 %", "source_pages": [3]}], "warnings": ["скан нечёткий"], "deadlines": {"stages": [{"name": "этап 1."}, {"name": "Этап 2"}]}}

    def script(user, attempt):
        if "плохой" in user:
            return "no object"
        return json.dumps(one if user.startswith("Часть 1") else two, ensure_ascii=False)

    rows = page_rows.union(spark.createDataFrame([("c", 1, "Это плохой документ без ответа.")], page_rows.schema))
    out = {r["doc_id"]: r for r in summarize.summarize(rows, lambda: provider.Scripted(script), chunk_chars=520, overlap_chars=0).collect()}
    a = out["a"]
    assert a["partials"] == 2 and a["subject"] == "ремонт" and a["procurement_number"] == "7" and a["end"] == "31.12.2030"
    assert a["contract_security"] == 6.0 and a["contract_price"] == 3250000.5 and a["start"] == "01.04.2026"
    assert [tuple(r) for r in a["requirements"]] == [("staff", long, True, [1, 2])]
    assert [tuple(r) for r in a["penalties"]] == [("Срыв!", "штраф", "1 %", None, [3])]
    assert [tuple(r) for r in a["stages"]] == [("Этап 1", "май"), ("Этап 2", None)] and a["mentions"] == ["до мая"]
    assert a["warnings"][0] == "Скан нечёткий" and "скан нечёткий" not in a["warnings"]
    assert any("Обеспечение исполнения контракта" in w for w in a["warnings"]) and any("не извлечено моделью" in w for w in a["warnings"])
    assert out["c"]["code"] == "provider_unavailable" and "no object" in out["c"]["detail"] and out["c"]["confidence"] is None


def test_stages_refined_and_transfer_first(spark):
    one = [("Этап 1", None), ("Возврат обеспечения", "май"), ("первый этап", "июнь"), ("Этап 2", "июль"), ("второй этап", "август"), ("Смета", None)]
    df = spark.createDataFrame([(1, one)], "k int, x array<struct<name:string,deadline:string>>")
    got = df.select(reconcile.refined_stages(F.col("x")).alias("s"), reconcile.other_stages(F.col("x")).alias("m")).collect()[0]
    assert [tuple(x) for x in got["s"]] == [("первый этап", "июнь"), ("Этап 2", "июль")] and got["m"] == ["Возврат обеспечения - май", "Смета"]
    text = "Срок выполнения работ 20 рабочих дней. Окончание: 45 (сорок пять) календарных дней с даты передачи объекта."
    docs = spark.createDataFrame([("a", text), ("b", "Срок выполнения работ 20 рабочих дней.")], "doc_id string, text string")
    assert {r["doc_id"]: r["duration"] for r in facts.duration_of(docs).collect()} == {"a": "45 календарных дней", "b": "20 рабочих дней"}


def test_summary_refines_stages_and_names_pages(spark):
    texts = ["Требования к участникам закупки\nУчастник обязан иметь действующую лицензию на работы.", "Этап 1: работы.\nПервый этап: до 01.02.2026.\nПериод 7: приёмка.\nУказан срок.\nЗа каждый день просрочки начисляется пеня 0,1 % от цены."]
    df = spark.createDataFrame([("a", i + 1, t) for i, t in enumerate(texts)], "doc_id string, page_no int, text string")
    a = summarize.summarize(df).collect()[0]
    assert len(a["stages"]) == 1 and a["stages"][0]["deadline"] == "01.02.2026"
    assert a["mentions"][0] == "Указан срок." and a["mentions"][1].startswith("Период 7")
    assert [r["source_pages"] for r in a["requirements"]] == [[1]] and [p["source_pages"] for p in a["penalties"]] == [[2]]


@pytest.mark.parametrize("text,want", [('{"a": [1, {"b": "c', '{"a": [1, {"b": "c"}]}'), ('{"a": 1, "b": ', '{"a": 1}'), ('{"a": [1, 2, ', '{"a": [1, 2]}'), ('{"a": "x\\', '{"a": "x\\"}'), ('{"a": 12', '{"a": 12}'), ('{"a": 1}', '{"a": 1}'), ('{"a:": "b,', '{"a:": "b,"}')])
def test_closed(text, want):
    assert jsonrepair.closed(text) == want


def test_admission_of_large_padded_and_unread_files(spark, tmp_path):
    (tmp_path / "large.pdf").write_bytes(b"%PDF-" + b"x" * 2_000_000)
    (tmp_path / "padded.pdf").write_bytes(b" \n" * 5000 + b"%PDF-1.4 \xff\xfe")
    (tmp_path / "other.pdf").write_bytes(b" \xff%PDF-")
    up = ingest.scan(spark, str(tmp_path), max_mb=1)
    name = lambda rows: sorted((r["doc_id"].rsplit("/", 1)[1], r["code"], r["status"]) for r in rows)
    assert name(ingest.admission(up, max_mb=1).collect()) == [("large.pdf", "file_too_large", 413), ("other.pdf", "unreadable_pdf", 422), ("padded.pdf", None, None)]
    none = spark.createDataFrame([], "doc_id string, page_no int, text string")
    assert ("padded.pdf", "unreadable_pdf", 422) in name(ingest.rejects(up, extracted=none, max_mb=1).collect())


def test_messages_with_and_without_an_opened_answer(monkeypatch):
    sent = []

    class Answer:
        def __init__(self, body):
            self.body = body

        def __enter__(self):
            return self

        def __exit__(self, *_):
            return None

        def read(self):
            return self.body

    def fake(request, timeout):
        sent.append((request.full_url, dict(request.header_items()), json.loads(request.data)))
        return Answer(json.dumps({"content": [{"type": "text", "text": '"a": 1}'}], "usage": {"input_tokens": 9, "output_tokens": 2}}).encode())

    monkeypatch.setattr(provider.urllib.request, "urlopen", fake)
    opened = provider.registry("messages", url="http://x/v1", key="k", model="m", prefill=True, headers={"x-version": "1"})()
    assert opened.complete("s", "u") == ('{"a": 1}', 9, 2)
    plain = provider.registry("messages", url="http://x/v1", key="k", model="m")()
    assert plain.complete("s", "u")[0] == '"a": 1}'
    assert sent[0][0] == "http://x/v1/messages" and sent[0][1]["X-version"] == "1"
    assert sent[0][2]["messages"][-1] == {"role": "assistant", "content": "{"} and sent[0][2]["temperature"] == 0.0
    assert sent[1][2]["messages"] == [{"role": "user", "content": "u"}] and "temperature" not in sent[1][2]


def test_pages_delivered_twice_count_once(spark):
    text = "Предмет закупки: поставка изделий.\n" + "Слово за словом. " * 20
    rows = [("d", k, k + 1, text + str(k)) for k in range(6)]
    df = spark.createDataFrame(rows + rows[2:5], "doc_id string, page_id bigint, page_no int, text string")
    once = spark.createDataFrame(rows, df.schema)
    from folium.operators import pages

    for f in (pages.page_stats, pages.noise_masks, pages.marked_text, chunks.packed):
        assert sorted(map(str, f(df).collect())) == sorted(map(str, f(once).collect())), f


def test_milestones(spark):
    df = spark.createDataFrame([(1, -5), (2, 19), (3, 90), (4, 140)], "k int, at int")
    got = {r["k"]: [x["percent"] for x in r["m"]] for r in df.select("k", progress.reached(F.col("at")).alias("m")).collect()}
    assert got == {1: [], 2: [2, 12, 18], 3: [2, 12, 18, 20, 85, 88], 4: [p for p, _ in progress.MILESTONES]}
    assert [x["stage"] for x in df.where("k = 3").select(progress.reached(F.col("at"), rules=True).alias("m")).collect()[0]["m"]] == ["extract", "extract", "chunk", "llm", "llm", "verify", "finish"]


def test_rules_in_a_model_s_place_keep_documents_apart(spark):
    rows = [("a\"b", 1, "Предмет закупки: поставка изделий для школ.\nЦена контракта: 5 000 руб."), ("c", 1, "Предмет закупки: ремонт кровли детского сада."), ("d", 1, "")]
    got = {r["doc_id"]: (r["subject"], r["contract_price"]) for r in summarize.summarize(spark.createDataFrame(rows, "doc_id string, page_no int, text string"), "rules").collect()}
    assert got == {'a"b': ("поставка изделий для школ", 5000.0), "c": ("ремонт кровли детского сада", None)}
