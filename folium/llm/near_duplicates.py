"""Near-duplicate records with small edits (problem 5): an exact set similarity self-join by a token-group matrix.

Texts become sets of hashed runs of three words; texts with one set form a class. Words are hashed once and written, as
numbers, to the shared folder; every later step reads those. All runs are put in one order, estimated frequency first,
and the classes with one least run form a group, so that similar classes mostly share their group. The token-group
matrix holds, for each run, the groups in which a member has it among the first p = n - ceil(t * n) + depth of its n
runs (the group's token union), with the least and greatest size of these members.

Every class looks its first p runs up in the matrix and counts its hits with each group. Let a be the overlap that a
similarity of t asks of sets of n and m runs, t / (1 + t) * (n + m). What two sets share is among the first p of both or
among the rest of one of them, so a - max(n - p(n), m - p(m)) shared runs at least are hits; over the sizes a group can
have, that expression is least at an end of the range. Groups with fewer hits are never opened. Of two groups the one
with the lesser name asks. Opened groups and the members of one group give pairs of classes, whose sets are then
compared exactly; only sets that take part in some pair are read for it.

The frequencies come from a histogram of 2^20 hash buckets over all rows, of constant size; the order they give only
decides how selective the first runs are, never what is found. A run of very many sets is spread over several keys, each
asked by a part of the sets; a group of many classes is compared block by block, each pair of blocks a key of its own.
Copies are merged before any pairing, and unfolded at the end.

Cases: NULL, empty and short texts (under `min_words` words) pair with nothing; equal texts are a pair; repeated rows
of a key count once; no partner is dropped, however many; texts are read whole; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folium.llm.common import cut_lineage
from folium.llm.confusables import is_plain, normal_form, only_alike
from folium.llm.leakage import WORD
from folium.plans.ship import ensure_shipped, written

BUCKETS, CLASS_BITS, SLICES = 1 << 20, 1 << 22, 16
#: A run of more sets than this (and than HOT_TIMES the mean of a bucket) is spread over several keys; classes of a block.
HOT, HOT_TIMES, SPREAD, BLOCK = 20_000, 8, 64, 512
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


NOTHING, ASK = 0, 1


class Hashes(dict):
    """Hash of the word in a piece between white space; NOTHING where there is none, ASK where its form needs the text."""

    def __missing__(self, piece: str) -> int:
        if len(self) > 500_000:
            self.clear()
        word = WORD.search(piece.lower())
        if not is_plain(piece):
            value = ASK
        elif word is None:
            value = NOTHING
        else:
            value = self.known(word.group())
        self[piece] = value
        return value

    @staticmethod
    def known(word: str) -> int:
        """Hash of a word that already has its form."""
        return max(crc32(word.encode()), 2)


def word_hashes(text: str, cache: Hashes) -> np.ndarray:
    """Hashes of the words of a text in its consistent form; most texts need no more than a look at each piece."""
    pieces = text.split()
    h = np.fromiter(map(cache.__getitem__, pieces), np.uint32, len(pieces))
    alike = only_alike(text)
    if alike or h.size and h.min() < 2:
        if alike or (h == ASK).any():
            pieces = WORD.findall(normal_form(text).lower())
            h = np.fromiter(map(cache.known, pieces), np.uint32, len(pieces))
        else:
            h = h[h != NOTHING]
    return h


def run_hashes(words: np.ndarray, bounds: np.ndarray, salts: np.ndarray, size: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of 63 bits, place of their text) of all runs of `size` words, in order, salted by the text's table."""
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    h, many = words.astype(np.uint64), max(0, len(words) - size + 1)
    out = salts[doc[:many]]
    with np.errstate(over="ignore"):
        for k in range(size):
            out = (out ^ h[k : many + k]) * M1
            out ^= out >> np.uint64(29)
    whole = doc[:many] == doc[size - 1 :]
    return (out >> np.uint64(1))[whole], doc[:many][whole]


def distinct(values: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each text."""
    order = np.lexsort((values, doc))
    values, doc = values[order], doc[order]
    first = np.ones(len(values), bool)
    first[1:] = (values[1:] != values[:-1]) | (doc[1:] != doc[:-1])
    return values[first], doc[first]


def salts_of(names: list[str | None]) -> np.ndarray:
    return np.array([crc32((n or "").encode()) * 2654435761 for n in names], np.uint64)


def runs(texts: list[str | None], names: list[str | None], cache: Hashes, min_words: int) -> tuple[list[int], list[np.ndarray], np.ndarray, np.ndarray]:
    """(places of the texts with enough words, their words, distinct runs, place among the kept of each)."""
    kept, found = [], []
    for k, text in enumerate(texts):
        if text and len(w := word_hashes(text, cache)) >= max(min_words, 3):
            kept.append(k)
            found.append(w)
    if not kept:
        return [], [], np.zeros(0, np.uint64), np.zeros(0, np.int64)
    bounds = np.concatenate([[0], np.cumsum([len(w) for w in found])])
    return kept, found, *distinct(*run_hashes(np.concatenate(found), bounds, salts_of([names[k] for k in kept])))


def _rows(df: DataFrame, min_words: int) -> DataFrame:
    """src, row_id, cls, n, words of each row with enough words, cls being a hash of its set of n runs.

    Copies that one task meets again come without their words: a group of copies costs a few bytes a row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, seen = Hashes(), set()
        for batch in batches:
            names = batch.column(0).to_pylist()
            kept, words, tokens, doc = runs(batch.column(2).to_pylist(), names, cache, min_words)
            if not kept:
                continue
            n = np.bincount(doc, minlength=len(kept))
            with np.errstate(over="ignore"):
                mixed = tokens * M2
                cls = ((np.add.reduceat(mixed ^ (mixed >> np.uint64(31)), np.cumsum(n) - n) * M1) >> np.uint64(1)).astype(np.int64)
            fresh = []
            for c in cls.tolist():
                fresh.append(c not in seen)
                if fresh[-1]:
                    if len(seen) > 200_000:
                        seen.clear()
                    seen.add(c)
            mask = np.array(fresh)
            held = [w for w, f in zip(words, fresh) if f]
            offsets = np.concatenate([[0], np.cumsum(np.where(mask, [len(w) for w in words], 0))]).astype(np.int32)
            values = np.concatenate(held or [np.zeros(0, np.uint32)]).view(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([names[k] for k in kept], pa.string()), batch.column(1).take(pa.array(kept)), pa.array(cls), pa.array(n.astype(np.int32)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values), mask=pa.array(~mask))], names=["src", "row_id", "cls", "n", "words"])

    return df.mapInArrow(run, "src string, row_id bigint, cls bigint, n int, words array<int>")


def _batch(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Runs of a batch of stored rows (src and words first), and the place of each."""
    words = batch.column(1)
    bounds = words.offsets.to_numpy().astype(np.int64)
    flat = words.values.to_numpy(zero_copy_only=False).view(np.uint32)[bounds[0] : bounds[-1]]
    return run_hashes(flat, bounds - bounds[0], salts_of(batch.column(0).to_pylist()))


def _counts(df: DataFrame, size: int, add, kind: type, join=np.add) -> np.ndarray:
    """Histograms that add(counts, batch) fills, joined over all tasks: `size` numbers, whatever the table's size."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, kind)
        for batch in batches:
            add(counts, batch)
        yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([x.tobytes() for x in np.split(counts, SLICES)], pa.binary())], names=["slice", "counts"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                counts = np.frombuffer(x.as_buffer(), kind)
                sums[k] = join(sums[k], counts) if k in sums else counts
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["slice", "counts"])

    schema = "slice int, counts binary"
    out = np.zeros((SLICES, size // SLICES), kind)
    for row in df.mapInArrow(partial, schema).repartition(SLICES, "slice").mapInArrow(total, schema).collect():
        out[row["slice"]] = np.frombuffer(row["counts"], kind)
    return out.reshape(-1)


def _frequencies(stored: DataFrame) -> np.ndarray:
    """Runs in each hash bucket."""
    buckets = np.uint64(BUCKETS - 1)
    return _counts(stored.select("src", "words"), BUCKETS, lambda counts, batch: np.add(counts, np.bincount((_batch(batch)[0] & buckets).astype(np.int64), minlength=BUCKETS), out=counts), np.int64)


def _ordered(tokens: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The order of runs, rarest first, as one number; it also names the run."""
    return (rank[(tokens & np.uint64(BUCKETS - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(56) | tokens >> np.uint64(8)).astype(np.int64)


def _heads(stored: DataFrame, rank: np.ndarray) -> DataFrame:
    """gkey, cls, n of each class, gkey being its least run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, doc = _batch(batch)
            if batch.num_rows:
                least = np.minimum.reduceat(_ordered(tokens, rank), np.searchsorted(doc, np.arange(batch.num_rows)))
                yield pa.RecordBatch.from_arrays([pa.array(least), batch.column(2), batch.column(3)], names=["gkey", "cls", "n"])

    return stored.select("src", "words", "cls", "n").mapInArrow(run, "gkey bigint, cls bigint, n int").groupBy("gkey", "cls").agg(F.max("n").alias("n"))


def first_runs(n: np.ndarray, threshold: float, depth: int) -> np.ndarray:
    """How many of n runs, the first in order, are looked up."""
    return np.minimum(n, n - np.ceil(threshold * n - 1e-9).astype(np.int64) + depth)


def _postings(stored: DataFrame, rank: np.ndarray, spread: np.ndarray, threshold: float, depth: int) -> DataFrame:
    """tok, cls, gkey, n of each class's first runs; n is negative where the row only belongs to the matrix.

    A run spread over r keys has a row for each key, by one of which, chosen by the class, it is asked.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, doc = _batch(batch)
            if not len(doc):
                continue
            over = spread[(tokens & np.uint64(BUCKETS - 1)).astype(np.int64)].astype(np.int64)
            keys, order = _ordered(tokens, rank), None
            order = np.lexsort((keys, doc))
            keys, doc, over = keys[order], doc[order], over[order]
            first = np.ones(len(keys), bool)
            first[1:] = (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])
            keys, doc, over = keys[first], doc[first], over[first]
            n = np.bincount(doc, minlength=batch.num_rows)
            begins = np.cumsum(n) - n
            use = np.arange(len(keys)) - begins[doc] < first_runs(n, threshold, depth)[doc]
            gkey, cls = keys[begins], batch.column(2).to_numpy(zero_copy_only=False)
            keys, d, over = keys[use], doc[use], over[use]
            if over.max() > 1:
                at = np.repeat(np.arange(len(keys)), over)
                turn = np.arange(len(at)) - np.repeat(np.cumsum(over) - over, over)
                keys, d, over = keys[at], d[at], over[at]
                with np.errstate(over="ignore"):
                    keys = np.where(turn > 0, ((keys.astype(np.uint64) ^ turn.astype(np.uint64) * M2) * M1 >> np.uint64(1)).astype(np.int64), keys)
                asks = cls[d] % over == turn
            else:
                asks = np.ones(len(keys), bool)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(cls[d]), pa.array(gkey[d]), pa.array(np.where(asks, n[d], -n[d]).astype(np.int32))], names=["tok", "cls", "gkey", "n"])

    return stored.select("src", "words", "cls").mapInArrow(run, "tok bigint, cls bigint, gkey bigint, n int")


def _far(posted: DataFrame, heads: DataFrame, t: float, depth: int) -> DataFrame:
    """a, b: classes of different groups, one of which opens the other's group."""
    # both sides of the lookup read one exchange: what joins infer is stated before it, and no column goes unused
    posted = posted.where("tok IS NOT NULL AND cls IS NOT NULL AND gkey IS NOT NULL AND n IS NOT NULL").repartition("tok")
    size = F.abs("n")
    matrix = posted.groupBy("tok", "gkey").agg(F.min(size).alias("least"), F.max(size).alias("most"), F.min("cls").alias("used"))
    # rows that ask; the random term only keeps this filter above the exchange
    q, g = posted.where(F.col("n") > 0 * F.rand(1)).alias("q"), matrix.alias("g")
    n = F.col("q.n")
    low, high = F.greatest("g.least", F.ceil(n * t - 1e-9).cast("int")), F.least("g.most", F.floor(n / t + 1e-9).cast("int"))
    on = (F.col("q.tok") == F.col("g.tok")) & (F.col("q.gkey") < F.col("g.gkey")) & (low <= high) & F.col("g.used").isNotNull()
    # ceil(t * n) < t * n + 1, so n - p(n) < t * n + 1 - depth
    rest = lambda m: F.greatest(F.lit(0.0), m * t + (1 - depth))
    asked = lambda m: t / (1 + t) * (n + m) - F.greatest(rest(n), rest(m)) - 1e-6
    need = F.greatest(F.lit(1), F.ceil(F.least(asked(low), asked(high)))).cast("int")
    hits = q.join(g, on).select("q.cls", "q.n", "g.gkey", need.alias("need"))
    opened = hits.groupBy("cls", "n", "gkey").agg(F.count("*").alias("h"), F.min("need").alias("need")).where("h >= need")
    o, m = opened.alias("o"), heads.alias("m")
    near = (F.col("o.gkey") == F.col("m.gkey")) & (F.col("o.n") * t <= F.col("m.n") + 1e-9) & (F.col("m.n") * t <= F.col("o.n") + 1e-9)
    return o.join(m, near).select(F.least("o.cls", "m.cls").alias("a"), F.greatest("o.cls", "m.cls").alias("b"))


def _near(heads: DataFrame, t: float) -> DataFrame:
    """a, b: classes of one group. Groups are compared by pairs of blocks, each a key of its own."""
    sizes = heads.groupBy("gkey").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.count("*").alias("many")).where("many > 1")
    placed = heads.join(sizes, "gkey").select("gkey", "cls", "n", "blocks", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int").alias("own"))
    x = placed.select("gkey", F.col("own").alias("i"), F.explode(F.sequence("own", F.col("blocks") - 1)).alias("j"), F.col("cls").alias("a"), F.col("n").alias("an"))
    y = placed.select("gkey", F.explode(F.sequence(F.lit(0), "own")).alias("i"), F.col("own").alias("j"), F.col("cls").alias("b"), F.col("n").alias("bn"))
    both = x.join(y, ["gkey", "i", "j"]).where("i < j OR a < b").where((F.col("an") * t <= F.col("bn") + 1e-9) & (F.col("bn") * t <= F.col("an") + 1e-9))
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _sets(stored: DataFrame, wanted: np.ndarray) -> DataFrame:
    """cls, n, tokens of the classes that the bitmap names, others with the same bit included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(wanted[batch.column(2).to_numpy() & (CLASS_BITS - 1)] > 0))
            if batch.num_rows:
                tokens, doc = distinct(*_batch(batch))
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(batch.num_rows + 1)).astype(np.int32)), pa.array((tokens >> np.uint64(31)).astype(np.uint32).view(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(3), lists], names=["cls", "n", "tokens"])

    read = stored.select("src", "words", "cls", "n").mapInArrow(run, "cls bigint, n int, tokens array<int>")
    return read.groupBy("cls").agg(F.first("n").alias("n"), F.first("tokens").alias("tokens"))


def class_pairs(df: DataFrame, *, threshold: float = 0.6, min_words: int = 20, depth: int = 3) -> tuple[DataFrame, DataFrame]:
    """(members: src, cls, row_id; pairs of different classes: a, b, jaccard) of rows src, row_id, text."""
    ensure_shipped(df.sparkSession)
    slim = df.select(F.col("src").cast("string").alias("src"), F.col("row_id").cast("bigint").alias("row_id"), F.col("text").cast("string").alias("text"))
    # words of one letter with blanks between them are the shortest text of min_words words
    slim = slim.where(F.col("row_id").isNotNull() & (F.length("text") >= 2 * min_words - 1))
    rows = written(_rows(slim, min_words))
    stored = rows.where("words IS NOT NULL")
    counts = _frequencies(stored)
    rank = np.floor(2 * np.log2(counts + 1.0)).astype(np.uint8)
    spread = np.where(counts > max(HOT, HOT_TIMES * counts.mean()), np.minimum(SPREAD, -(-counts // HOT)), 1).astype(np.uint8)
    heads = written(_heads(stored, rank))
    pairs = written(_far(_postings(stored, rank, spread, threshold, depth), heads, threshold, depth).unionByName(_near(heads, threshold)))

    def mark(bits: np.ndarray, batch: pa.RecordBatch) -> None:
        for column in batch.columns:
            bits[column.to_numpy() & (CLASS_BITS - 1)] = 1

    sets = _sets(stored, _counts(pairs.select("a", "b"), CLASS_BITS, mark, np.uint8, np.maximum))
    both = pairs.join(sets.select(F.col("cls").alias("a"), F.col("n").alias("an"), F.col("tokens").alias("at")), "a").join(sets.select(F.col("cls").alias("b"), F.col("n").alias("bn"), F.col("tokens").alias("bt")), "b")
    shared = F.size(F.array_intersect("at", "bt"))
    compared = both.select("a", "b", (shared / (F.col("an") + F.col("bn") - shared)).alias("jaccard")).where(F.col("jaccard") >= threshold - 1e-9)
    return rows.select("src", "cls", "row_id"), compared


def found_pairs(df: DataFrame, **options) -> DataFrame:
    """src, id_a, id_b of all pairs of records, equal ones included."""
    members, pairs = class_pairs(df, **options)
    x, y = members.select("src", F.col("cls").alias("a"), F.col("row_id").alias("x")), members.select(F.col("cls").alias("b"), F.col("row_id").alias("y"))
    apart = pairs.join(x, "a").join(y, "b").select("src", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    equal = x.join(y.withColumnRenamed("b", "a"), "a").where("x < y").select("src", F.col("x").alias("id_a"), F.col("y").alias("id_b"))
    return apart.where("id_a <> id_b").unionByName(equal).distinct()


def groups(df: DataFrame, *, rounds: int = 20, **options) -> DataFrame:
    """src, row_id, group_id, links: group_id is the least class joined to the row's by links, links counts other classes.

    Labels are spread along links until none changes; rows are never gathered, and lineage is cut in the shared folder.
    """
    members, pairs = class_pairs(df, **options)
    members = members.distinct()
    pairs = cut_lineage(pairs.select("a", "b"))
    ways = F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("b").alias("b")), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    edges = pairs.select(ways.alias("e")).select("e.a", "e.b")
    degree = edges.groupBy("a").agg(F.count("*").alias("links"))
    label = cut_lineage(degree.select("a", F.col("a").alias("g"), "links"))
    for _ in range(rounds * 5):
        near = edges.join(label.select(F.col("a").alias("b"), "g"), "b").groupBy("a").agg(F.min("g").alias("m"))
        step = label.join(near, "a").select("a", F.least("g", "m").alias("g"), "links", (F.col("m") < F.col("g")).alias("moved"))
        # a jump: the label of the label
        jump = step.select(F.col("a").alias("g"), F.col("g").alias("gg"))
        step = cut_lineage(step.join(jump, "g", "left").select("a", F.least("g", F.coalesce("gg", "g")).alias("g"), "links", "moved"))
        label = step.drop("moved")
        if step.where("moved").isEmpty():
            break
    else:
        raise RuntimeError("links are longer than the rounds allow: raise `rounds`")
    return members.join(label.withColumnRenamed("a", "cls"), "cls", "left").select("src", "row_id", F.coalesce("g", "cls").alias("group_id"), F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))
