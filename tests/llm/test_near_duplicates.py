import random

import pytest
from pyspark.sql import functions as F

from folium.llm import near_duplicates as N

SCHEMA = "src string, row_id bigint, text string, cls string"


def texts(seed, n):
    rng = random.Random(seed)
    words = [f"слово{i}" for i in range(300)]
    out = []
    for i in range(n):
        if out and rng.random() < 0.5:
            w = rng.choice(out).split()
            for _ in range(rng.randrange(0, 8)):
                k = rng.randrange(len(w))
                w[k : k + rng.randrange(2)] = [rng.choice(words)] * rng.randrange(2)
            out.append(" ".join(w))
        else:
            out.append("общий зачин для всех текстов таблицы " + " ".join(rng.choice(words) for _ in range(rng.randrange(12, 60))))
    return out


def brute(rows):
    cache = N.Hashes()
    sets = {(s, i): set(v.tolist()) for s, i, t in {(s, i, t) for s, i, t, *_ in rows if i is not None} if len(v := N.runs([t], [s], cache, 20)[2])}
    return {(a[0], min(a[1], b[1]), max(a[1], b[1])) for a in sets for b in sets if a < b and a[0] == b[0] and len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b]) - 1e-9}


@pytest.mark.parametrize("seed", [1, 2])
def test_exact_against_brute_force(spark, seed):
    rows = [("a" if i % 3 else "b", i, t, "x") for i, t in enumerate(texts(seed, 260))]
    rows += [rows[0], rows[1], ("a", 900, None, ""), ("a", 901, "", ""), ("a", 902, "мало слов", ""), ("a", None, rows[2][2], "")]
    got = [tuple(r) for r in N.found_pairs(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows) and len(got) > 50


def test_copies_scripts_and_long_texts(spark):
    base = " ".join(f"договор{i} поставки" for i in range(15))
    rows = [("a", 1, base, ""), ("a", 2, base.upper().replace("О", "O"), ""), ("a", 3, "  «" + base.replace(" ", " ") + "».", ""), ("b", 4, base, ""), ("a", 5, "длинный " * 50000, "")]
    assert sorted(map(tuple, N.found_pairs(spark.createDataFrame(rows, SCHEMA)).collect())) == [("a", 1, 2), ("a", 1, 3), ("a", 2, 3)]
    assert N.found_pairs(spark.createDataFrame([], SCHEMA)).count() == 0


def test_groups_are_components(spark):
    rows = [("a", i, t, "") for i, t in enumerate(texts(5, 120))]
    df = spark.createDataFrame(rows, SCHEMA)
    pairs = brute(rows)
    parent = {i: i for i in range(120)}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for _, a, b in pairs:
        parent[root(a)] = root(b)
    got = {r["row_id"]: r["group_id"] for r in N.groups(df).collect()}
    assert all((got[i] == got[j]) == (root(i) == root(j)) for i in got for j in got)
    assert N.groups(df).select(F.sum("links")).collect()[0][0] > 0


def test_texts_of_few_distinct_runs_and_of_short_words(spark):
    """Small sets pass with few runs in common; twenty words of one letter have 39 characters."""
    a, b = "альфа бета " * 12, "альфа бета " * 12 + "гамма"
    short = " ".join("абвгдежзиклмнопрстуф")
    rows = [("a", 1, a, ""), ("a", 2, b, ""), ("a", 3, short, ""), ("a", 4, short, "")]
    assert {tuple(r) for r in N.found_pairs(spark.createDataFrame(rows, SCHEMA)).collect()} == {("a", 1, 2), ("a", 3, 4)} == brute(rows)


@pytest.mark.parametrize("seed", range(3))
def test_low_variety_texts_against_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = [("a", i, " ".join(rng.choice("абвг"[: rng.randrange(1, 5)]) for _ in range(rng.randrange(18, 40))), "") for i in range(150)]
    assert {tuple(r) for r in N.found_pairs(spark.createDataFrame(rows, SCHEMA)).collect()} == brute(rows)


def test_hot_runs_and_groups_are_split(spark, monkeypatch):
    """Spread runs and blocks of groups find what brute force finds."""
    monkeypatch.setattr(N, "HOT", 5)
    monkeypatch.setattr(N, "HOT_TIMES", 0)
    monkeypatch.setattr(N, "BLOCK", 4)
    base = " ".join(f"статья{i}" for i in range(40)).split()
    rng = random.Random(3)
    rows = []
    for i in range(90):
        w = list(base)
        for _ in range(rng.randrange(5)):
            w[rng.randrange(40)] = f"правка{rng.randrange(1000)}"
        rows.append(("a", i, " ".join(w), ""))
    rows += [("a", 100 + i, t, "") for i, t in enumerate(texts(4, 60))]
    got = [tuple(r) for r in N.found_pairs(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows) and len(got) > 1000


def test_no_setting_of_the_session_is_changed(spark):
    before = spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition")
    N.found_pairs(spark.createDataFrame([("a", 1, "слово " * 30, "")], SCHEMA)).collect()
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == before
