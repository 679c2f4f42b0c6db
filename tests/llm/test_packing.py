import os
import random

import pytest

from folium.llm import packing

pytestmark = pytest.mark.skipif(not os.path.isdir("/opt/tokenizers"), reason="no tokenizer files")
WORDS = "суд court Gericht решение order 5 2020 the иск claim, Klage. §".split()


def documents(n, seed=3):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(rng.randrange(1, 160))), "x", "y") for i in range(n)]


def test_every_token_once_within_capacity(spark):
    docs = documents(400) + [(900, None, "", ""), (901, "", "", ""), (None, "text", "", ""), (902, "слово " * 3000, "", "")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, bin_id string, piece_no string")
    caps = spark.createDataFrame([(1, 64), (2, 512)], "container_id int, capacity_tokens int")
    out = packing.containers(df, caps).collect()
    counter = packing.Counter("/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
    for cid, cap in ((1, 64), (2, 512)):
        mine = [r for r in out if r["container_id"] == cid]
        used = {}
        for r in mine:
            used[r["bin_id"]] = used.get(r["bin_id"], 0) + r["end_token"] - r["start_token"]
        assert max(used.values()) <= cap
        assert sum(used.values()) / (len(used) * cap) > 0.9
        for doc_id, text, *_ in docs:
            spans = sorted((r["start_token"], r["end_token"]) for r in mine if r["doc_id"] == doc_id)
            if not text or doc_id is None:
                assert not spans
                continue
            n = len(counter.encoding.encode_ordinary(text))
            assert spans[0][0] == 0 and spans[-1][1] == n and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
            assert len(spans) == -(-n // cap)  # split only where larger than the capacity


@pytest.mark.parametrize("text", ["Plain text, isn't it? 12 345", "Текст — «ёж» № 5", "压力 3.9 兆帕 ½ ² 😀", "  spaces \n\n\n tabs\t\t", "it's _under_score_ a²b"])
def test_counts_equal_the_tokenizer(text):
    counter = packing.Counter("/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
    assert int((counter.measured(text) & ((1 << packing.SIZE_BITS) - 1)).sum()) == len(counter.encoding.encode_ordinary(text))


def test_refusals_and_empty(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    caps = spark.createDataFrame([(1, 64)], "container_id int, capacity_tokens int")
    assert packing.containers(df, caps).count() == 0
    with pytest.raises(ValueError):
        packing.containers(df, spark.createDataFrame([(1, 0)], caps.schema))


def test_neighbours_come_first():
    import numpy as np

    terms = [np.array([1, 2, 3, 50 + i]) if i % 5 == 0 else np.array([9, 100 + i, 200 + i]) for i in range(40)]
    shard = packing.Shard(terms)
    assert all(x % 5 == 0 for x in shard.neighbours(0)[:7])


def test_all_terms_and_all_neighbours_count():
    import numpy as np

    # documents 0-59 share one light term each holds among 20 heavier ones of its own kind; the rest share nothing
    own = [np.repeat(1000 + 20 * (i // 2) + np.arange(20), 3) for i in range(60)]
    terms = [np.append(t, 7) for t in own] + [np.array([100_000 + i]) for i in range(100)]
    shard = packing.Shard(terms)
    assert list(shard.neighbours(0))[:1] == [1] and sorted(shard.neighbours(0)) == list(range(1, 60))
    # the last 20 of them are reached although the 39 before are too big for the room
    sizes = [90] + [50] * 39 + [1] * 20 + [2] * 100
    first = next(w for w in packing.pack(sizes, 100, shard.neighbours) if w[0][0] == 0)
    assert sorted(x for x, *_ in first)[:11] == [0, *range(40, 50)]


def test_too_many_capacities_are_refused(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    with pytest.raises(ValueError):
        packing.containers(df, spark.range(1001).selectExpr("CAST(id AS INT) AS container_id", "64 AS capacity_tokens"))


def test_a_pre_token_of_millions_of_tokens_counts_in_full():
    counter = packing.Counter("/opt/tokenizers/byte_bpe_multi_50k.tiktoken")

    class Many:
        def encode_ordinary(self, text):
            return range(3_000_000)

    counter.encoding = Many()
    assert int((counter.measured("слово") & ((1 << packing.SIZE_BITS) - 1)).sum()) == 3_000_000


def test_repeated_ids_are_packed_once_over_all_shards(spark):
    docs = spark.createDataFrame([(i % 30, f"текст {i % 30} " * 5) for i in range(120)], "doc_id bigint, text string").repartition(6)
    out = packing.containers(docs, spark.createDataFrame([(1, 64)], "container_id int, capacity_tokens int")).collect()
    assert sorted(r["doc_id"] for r in out if r["piece_no"] == 0) == list(range(30))
