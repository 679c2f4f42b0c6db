import random

import numpy as np

from folium.llm import toxicity

DOCS = "doc_id bigint, text string, source string, score string"
LABELS = "doc_id bigint, rater int, unsafe int, kind string"
BAD = ["Go to hell, you filthy {}.", "I will break your {} tonight, liar.", "Ты вонючий {}, сдохни под забором."]
GOOD = ["The court valued the {} at five crowns.", "Notice was served on the {} in March.", "Суд установил, что {} передан вовремя.", "The deceased was beaten to death near the {}."]


def corpus(n, seed):
    rng = random.Random(seed)
    things = "cargo kiln ledger jetty vessel boiler орган склад".split()
    docs, truth = [], {}
    for i in range(n):
        parts = [rng.choice(GOOD).format(rng.choice(things)) for _ in range(6)]
        truth[i] = rng.random() < 0.4
        if truth[i]:
            parts.insert(rng.randrange(6), rng.choice(BAD).format(rng.choice(things)))
        docs.append((i, " ".join(parts), "s" if i % 2 else None, "x"))
    return docs, truth


def test_held_out_accuracy_with_noisy_raters(spark):
    docs, truth = corpus(400, 1)
    rng = random.Random(2)
    labels = [(i, r, int(truth[i] ^ (rng.random() < 0.08)), "k") for i in range(300) for r in range(rng.choice([1, 2, 3]))]
    docs += [docs[0], (1000, None, "s", ""), (1001, "", "s", ""), (1002, "123 456", "s", ""), (1003, ("Всё в порядке " * 20000), "s", "")]
    scored = toxicity.scores(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS), keep=("source",)).cache()
    got = {r["doc_id"]: r["score"] for r in scored.collect()}
    assert len(got) == 404 and all(got[i] == 0 for i in (1000, 1001, 1002))
    assert sum((got[i] >= 0.3) == truth[i] for i in range(300, 400)) >= 95
    rates = {r["source"]: r["docs"] for r in toxicity.rates(scored).collect()}
    assert rates == {"s": 204, None: 200}


def test_without_labels_and_empty(spark):
    docs, _ = corpus(5, 1)
    none = spark.createDataFrame([], LABELS)
    assert {r["score"] for r in toxicity.scores(spark.createDataFrame(docs, DOCS), none).collect()} == {0.0}
    assert toxicity.scores(spark.createDataFrame([], DOCS), none).count() == 0
    tie = spark.createDataFrame([(0, 1, 1, "k"), (0, 2, 0, None), (1, 1, None, None), (None, 1, 1, "k")], LABELS)
    assert toxicity.flagged(spark.createDataFrame(docs, DOCS), tie).count() == 0


def test_a_long_passage_is_cut_and_others_stay():
    """A passage of 401 words gets one end; the sentences around it, wherever they stand, none."""
    text = "Начало здесь. " + "слово " * 401 + ". " + "Обычное предложение после длинного. " * 80
    h = toxicity.hashes(text, toxicity.Cache())[:-2]
    gaps = np.diff(np.flatnonzero(np.concatenate([[toxicity.END], h, [toxicity.END]]) == toxicity.END)) - 1
    assert gaps.tolist()[:3] == [2, 400, 1] and set(gaps.tolist()[3:-1]) == {4}
