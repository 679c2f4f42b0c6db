import re

import pytest

from folium.llm import splitting

LIMITS = [("p", 40, 10), ("q", 30, 0), ("r", None, 5), (None, 10, 1)]
SCHEMA = "chunk_id bigint, text string, provider string, first_page int, last_page int, boundary string, start_pos int"


def cut(spark, texts, provider="p"):
    df = spark.createDataFrame([(i, t, provider, 7, 9, "own", 5) for i, t in enumerate(texts)], SCHEMA)
    lim = spark.createDataFrame(LIMITS, "provider string, chunk_chars int, chunk_overlap_chars int")
    out = {}
    for r in splitting.pieces(df, lim).collect():
        out.setdefault(r["chunk_id"], []).append(r)
    return {k: sorted(v, key=lambda r: r["piece_no"]) for k, v in out.items()}


def kind(text, limit):
    stretches, now = [], []
    for line in text.split("\n"):
        if line.strip(" \t"):
            now.append(line)
        else:
            stretches, now = [*stretches, "\n".join(now)], []
    for name, parts in (("blank_line", [*stretches, "\n".join(now)]), ("line", text.split("\n")), ("space", re.split(r"\s+", text))):
        if max(map(len, parts)) <= limit:
            return name
    return "none"


TEXTS = [
    "short", "", "x" * 95, "слово " * 20, "a b c. " * 10 + "\n\n" + "d " * 19 + "\n \t\n" + "e" * 40, "строка один два три\n" * 6, "😀" * 60, "\n\n\n" + "y" * 41, "w\xa0" * 30,
    "[[стр. 3]]\n" + "текст " * 5 + "\n\n[[стр. 4]]\n" + "ещё " * 12 + "[[стр. 5]]", "абв " * 3000,
]


@pytest.mark.parametrize("provider,limit,overlap", [("p", 40, 10), ("q", 30, 0)])
def test_pieces_cover_and_share(spark, provider, limit, overlap):
    got = cut(spark, TEXTS, provider)
    for i, text in enumerate(TEXTS):
        parts = got[i]
        assert "".join(r["text"][r["shared"] :] for r in parts) == text
        assert all(len(r["text"]) <= max(limit, len(text) if len(text) <= limit else 0) for r in parts)
        assert all(text[r["start_pos"] : r["start_pos"] + len(r["text"])] == r["text"] for r in parts)
        assert all(r["shared"] <= overlap for r in parts)
        assert parts[0]["boundary"] == (kind(text, limit) if len(text) > limit else None)


def test_cuts_at_words_and_pages(spark):
    got = cut(spark, TEXTS)
    assert all(r["text"].endswith(" ") or r["piece_no"] == len(got[3]) - 1 for r in got[3])
    marked = TEXTS[9]
    marks = [(m.start(), int(m[1])) for m in re.finditer(splitting.MARKER, marked)]
    for r in got[9]:
        end = r["start_pos"] + len(r["text"]) - 1
        assert r["first_page"] == [p for a, p in marks if a <= r["start_pos"]][-1]
        assert r["last_page"] == [p for a, p in marks if a <= end][-1]
    assert got[2][0]["first_page"] == 7


def test_nulls_copies_and_empty(spark):
    lim = spark.createDataFrame(LIMITS, "provider string, chunk_chars int, chunk_overlap_chars int")
    data = [(1, None, "p", 1, 1, "", 0), (2, "x" * 50, None, 1, 1, "", 0), (3, "x" * 50, "r", 1, 1, "", 0), (None, "x" * 50, "p", 1, 1, "", 0), (4, "x" * 50, "p", None, None, "", 0), (4, "x" * 50, "p", None, None, "", 0)]
    out = splitting.found(spark.createDataFrame(data, SCHEMA), lim).collect()
    assert [tuple(r) for r in out] == [(4, "none")]
    assert splitting.pieces(spark.createDataFrame([], SCHEMA), lim).count() == 0
