import random

from folium.llm import leakage
from folium.llm.leakage import leaks, words

ITEMS = "item_id bigint, text string"
DOCS = "doc_id bigint, text string, item_id string"


def brute(docs, items, n=12):
    grams = {}
    for i, t in items:
        w = words(t or "")
        for k in range(len(w) - n + 1):
            grams.setdefault(tuple(w[k : k + n]), set()).add(i)
    return {(d, i) for d, t, *_ in docs if d is not None for w in [words(t or "")] for k in range(len(w) - n + 1) for i in grams.get(tuple(w[k : k + n]), ())}


def test_against_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(8, 40)))) for i in range(30)] + [(30, None), (31, "")]
    docs = []
    for d in range(300):
        parts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 60)))]
        if rng.random() < 0.5:
            w = (rng.choice(items)[1] or "").split()
            k = rng.randrange(0, 10)
            parts.insert(rng.randrange(2), " ".join(w[k : k + rng.randrange(9, 20)]))
        docs.append((d, " ".join(parts), "x"))
    docs += [docs[5], (None, items[0][1], "x"), (999, None, "x")]
    want = brute(docs, items)
    for block in (50, 4_000_000):
        got = leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), block_words=block).collect()
        assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(got) == len(want) and want
        assert all(r["longest_run"] >= 12 and r["near_words"] >= r["longest_run"] for r in got)


def test_forms_of_words(spark):
    item = "Один, два (три) четыре пять шесть семь восемь девять десять одиннадцать двенадцать"
    docs = [(1, "x ОДИН\xa0два три че\xadтыре; пять «шесть» семь восемь девять\nдесять одиннадцать двенадцать. y", ""), (2, "два " + item[:60], "")]
    got = leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame([(7, item)], ITEMS)).collect()
    assert [(r["doc_id"], r["item_id"], r["longest_run"]) for r in got] == [(1, 7, 12)]


def test_runs_stay_in_one_document(spark):
    w = [f"a{i}" for i in range(24)]
    docs = [(1, "z " + " ".join(w[:8]), ""), (2, " ".join(w[8:]), ""), (3, " ".join(w[:7]), "")]
    got = leaks(spark.createDataFrame(docs, DOCS).coalesce(1), spark.createDataFrame([(7, " ".join(w))], ITEMS)).collect()
    assert [(r["doc_id"], r["longest_run"]) for r in got] == [(2, 16)]


def test_empty(spark):
    assert leaks(spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a " * 20)], ITEMS)).count() == 0
    assert leaks(spark.createDataFrame([(1, "a " * 20, "")], DOCS), spark.createDataFrame([], ITEMS)).count() == 0


def test_proximity_without_a_run(spark):
    """Every sixth word replaced leaves runs of five, but five sixths of the words at their places."""
    words = [f"слово{i}" for i in range(60)]
    changed = [w if k % 6 else f"иное{k}" for k, w in enumerate(words)]
    far = [w if k % 3 else f"иное{k}" for k, w in enumerate(words)]
    docs = spark.createDataFrame([(1, "зачин " * 9 + " ".join(changed) + " конец"), (2, " ".join(far)), (3, " ".join(changed[:30])), (4, " ".join(changed[30:]))], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, " ".join(words))], "item_id bigint, text string")
    assert [tuple(r) for r in leakage.leaks(docs, items).collect()] == [(1, 7, 5, 50)]


def test_items_in_blocks(spark, monkeypatch):
    """More items than a block holds are searched block by block, and none is lost."""
    monkeypatch.setattr(leakage, "BLOCK_ITEMS", 10)
    items = [(i, " ".join(f"w{i}x{k}" for k in range(14))) for i in range(35)]
    docs = spark.createDataFrame([(100 + i, "a b " + t + " c") for i, t in items], "doc_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in leakage.leaks(docs, spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert got == {(100 + i, i) for i, _ in items}
