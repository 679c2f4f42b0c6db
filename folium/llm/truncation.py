"""Replies cut off on their way (problem 4).

Whole-text prefixes find almost nothing here (in the test tables two replies in 5,000 are strict prefixes of another),
since most cut replies have no longer copy. The self-join by prefix therefore runs over units: the last sentence, list item
or JSON member of a reply against the units of all replies, with names, codes and numbers masked. A last unit is cut
when it, or its last words, are a strict prefix of something longer elsewhere and it never stands complete elsewhere.
A last word that breaks off is looked up by the words before it, which give fixed-length prefixes of the longer units, and
must be a strict prefix of the next word there. Every reply's last unit goes through this join; `by_prefix` says what it
confirms. Where no longer unit exists anywhere, the end of the text decides (`by_end`: no closing mark, an open JSON
value or code fence, a list item that breaks off before the shape of its neighbours).

The join is on hashes of fixed word counts: each distinct mask is unfolded into the hashes of its proper prefixes,
pre-aggregated to one row per hash, so the rows moved grow with distinct masks, not with pairs. Replies are read once;
what was read of them goes to the shared folder as hashes.

Cases: NULL, empty and blank texts are never cut; the metadata is not read; repeated rows of a call count once (a call
with different texts is cut if one of them is); ties can't arise; other columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import json
import re
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folium.llm.sentences import sentences
from folium.plans.ship import ensure_shipped, written

ITEM = re.compile(r"^[ \t]*(?:[-—–*•]|\d+[.)])[ \t]+")
STRING_OR_BRACKET = re.compile(r'"(?:[^"\\]|\\.)*"|["{}\[\]]', re.S)
DECODER = json.JSONDecoder()
#: A string that is no key; a sign of a JSON value.
VALUE = re.compile(r'([:\[,]\s*)"(?:[^"\\]|\\.)*"(?=\s*[,\]}])', re.S)
SIGN = re.compile(r'"(?:[^"\\]|\\.)*"?|[{}\[\]:,]|[^\s{}\[\]:,"]+', re.S)
JSON, STOP = "\0json", "\0"
QUOTED = re.compile("«[^«»]*»|“[^“”]*”|„[^„“”]*[“”]")
LIST_TAIL = re.compile(r"\n[ \t]*(?:[-—–*•]|\d+[.)])(?:[ \t]+[^\n]*)?$")


OPEN = re.compile(r"[{\[]")
DIGIT, DIGITS, NUMBER, LETTERS, INNER = re.compile(r"\d"), re.compile(r"\d+"), re.compile(r"\d[\d.,]*\d|\d"), re.compile(r"[^\W\d_]+"), re.compile(r"\w")


def masked(unit: str) -> list[str]:
    """Words of a unit with names, codes and numbers replaced by one sign each."""
    unit = QUOTED.sub("«»", unit)
    out = []
    for w in unit.split():
        if DIGIT.search(w):
            w = shape(w) if not w[0].isdigit() else NUMBER.sub("0", w)
        elif w[:1].isupper() and len(w) > 1 and not w[1:2].isupper() and out:
            w = "N" + INNER.sub("", w)
        elif w[:1].isupper() and w[1:2] == ".":
            w = "I."
        if w == "I." and out and out[-1] == "I.":
            continue
        out.append(w)
    return out


def json_end(text: str, start: int) -> int | None:
    """Where the JSON value that begins at start ends; None if it doesn't."""
    try:
        return DECODER.raw_decode(text, start)[1]
    except ValueError:
        depth = 0
        for m in STRING_OR_BRACKET.finditer(text, start):
            c = m.group()
            if c in "{[":
                depth += 1
            elif c in "}]":
                depth -= 1
                if depth == 0:
                    return m.end()
            elif c == '"':
                return None
        return None


def members(text: str, start: int) -> list[str]:
    """A JSON value as signs: brackets and marks, keys, values by their kind; the last sign may be broken off."""
    signs = ["0" if m.group()[0] in "-0123456789" else m.group() for m in SIGN.finditer(VALUE.sub(r'\1"…"', text[start:].split("```")[0]))]
    if signs[-2:-1] == [":"] and signs[-1][0] == '"':
        signs[-1] = '"…"' if len(signs[-1]) > 1 and signs[-1][-1] == '"' else '"'
    return signs


def shape(word: str) -> str:
    return LETTERS.sub("A", DIGITS.sub("0", word))


def look(text: str) -> tuple[str, list[str], list[list[str]]]:
    """Verdict by the text alone (cut, whole or ask), the masked last unit, the masked units before it."""
    body = text.rstrip()
    if not body:
        return "whole", [], []
    start = OPEN.search(body)
    fence = body.find("```")
    if start and (body[: start.start()].strip() == "" or fence >= 0 or body[: start.start()].rstrip().endswith(":")):
        end = json_end(body, start.start())
        fenced = 0 <= fence < start.start()
        if end is None:
            return "cut", [JSON, *members(body, start.start())], []
        rest = body[end:].strip()
        if fenced and not rest.startswith("```"):
            return "cut", [JSON, *members(body, start.start())], []
        rest = rest[3:].strip() if fenced else rest
        if not rest:
            return "whole", [], [[JSON, *members(body, start.start()), *["```"] * fenced]]
        body = rest
    elif fence >= 0 and body.count("```") % 2:
        return "cut", [], []
    elif body.endswith("`") and not body.endswith("```"):
        return "cut", [], []
    lines = [x for x in body.split("\n") if x.strip()]
    items = [x for x in lines if ITEM.match(x)]
    if ITEM.match(lines[-1]) or (len(items) > 1 and lines[-1].strip() in ("-", "—", "–", "*", "•")):
        parts = [masked(ITEM.sub("", x)) for x in lines[:-1] if ITEM.match(x)]
        last = masked(ITEM.sub("", lines[-1]))
        if len(lines[-1].split()) < 2:
            return "cut", last, parts
        ends = {shape(p[-1]) for p in parts if p}
        if not parts or shape(last[-1]) in ends:
            return "ask", last, parts
        return ("whole" if last[-1][-1:] in ".!?;" and not ends else "cut"), last, parts
    spans = sentences(body)
    units = [body[a:b] for a, b in spans]
    last = masked(units[-1])
    before = [masked(u) for u in units[:-1]]
    end = units[-1].rstrip("»”\"“’)]")
    # a colon opens something that did not come; a heading of its own does not exist at the end of a reply
    if end[-1:] not in ".!?…。！？؟।" or units[-1][-1] not in ".!?…。！？؟।»”\"“)":
        return "cut", last, before
    if units[-1].count("«") > units[-1].count("»"):
        return "cut", last, before
    return "ask", last, before


#: Words (signs, in JSON) of the window that is looked up where no whole unit can be: a unit's last words against the same
#: words elsewhere.
WINDOW, SIGNS = 2, 3
MASK = (1 << 63) - 1


class Numbers(dict):
    """63-bit number of a word."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = value = int.from_bytes(blake2b(word.encode(), digest_size=8).digest()) & MASK
        return value


class Units:
    """Hashes of word sequences, and what the units of this task have told of their prefixes."""

    def __init__(self) -> None:
        self.number = Numbers()
        self.given: set[tuple[int, str | None, bool]] = set()
        self.seen: set[tuple] = set()

    def all(self, words: list[str]) -> int:
        h = 1
        for w in words:
            h = (h * 0x9E3779B97F4A7C15 + self.number[w]) & MASK
        return h

    def window(self, words: list[str], size: int = WINDOW) -> int:
        return self.all(["…", *words[-size:]])

    def before(self, h: int, word: str) -> int:
        """Key of a look-up of the words that follow and begin like `word`."""
        return h ^ self.number["^" + word[:1]]

    def asked(self, verdict: str, last: list[str]) -> list[tuple[int, str]]:
        """What is looked up for a last unit: it and its last words; where it breaks off, what stands before its last word too."""
        if not last:
            return []
        if last[0] == JSON:
            last = [JSON, *last]
            return [(self.window(last, SIGNS), ""), (self.before(self.window(last[:-1], SIGNS), last[-1]), last[-1])]
        out = [(self.all(last), ""), (self.window(last), "")]
        if verdict == "cut" and len(last) > 1:
            out += [(self.before(h, last[-1]), last[-1]) for h in (self.all(last[:-1]), self.window(last[:-1]))]
        return out

    def told(self, units: list[tuple[list[str], bool]]) -> list[tuple[int, str | None, bool]]:
        """(hash, next word or NULL, whole) of units (words, complete): complete ones and their last words; proper prefixes
        and what follows them. Only what this task has not told yet."""
        if len(self.given) > 500_000:
            self.given.clear()
            self.seen.clear()
        found: set[tuple[int, str | None, bool]] = set()
        for u, complete in units:
            if u[:1] == [JSON]:
                signs = [JSON, *u, STOP] if complete else [JSON, *u]
                near_ = set(zip(*(signs[k:] for k in range(SIGNS + 1)))) - self.seen
                self.seen |= near_
                for near in near_:
                    h = self.window(list(near[:-1]), SIGNS)
                    found |= {(h, None, True)} if near[-1] == STOP else {(h, None, False), (self.before(h, near[-1]), near[-1], False)}
                continue
            if (whole := (*u, complete)) in self.seen:
                continue
            self.seen.add(whole)
            h, old = 1, 1
            for k, word in enumerate(u):
                if k:
                    near = self.window(u[max(0, k - WINDOW) : k])
                    found |= {(h, None, False), (near, None, False), (self.before(h, word), word, False), (self.before(near, word), word, False)}
                    # a cut may fall before a comma, so the last word counts with and without one
                    bare = u[k - 1].rstrip(",;:")
                    if bare and bare != u[k - 1]:
                        found |= {((old * 0x9E3779B97F4A7C15 + self.number[bare]) & MASK, None, False), (self.window([*u[max(0, k - WINDOW) : k - 1], bare]), None, False)}
                old, h = h, (h * 0x9E3779B97F4A7C15 + self.number[word]) & MASK
            if complete:
                found |= {(h, None, True), (self.window(u), None, True)}
        found -= self.given
        self.given |= found
        return list(found)


def judged(replies: DataFrame, *, call_id: str = "call_id", text: str = "text") -> DataFrame:
    """call_id, cut, by_prefix, by_end: one row per call with a text that isn't empty."""
    ensure_shipped(replies.sparkSession)
    asked, knows = "array<struct<h:bigint,w:string>>", "array<struct<h:bigint,w:string,whole:boolean>>"

    def run(batches):
        known = Units()
        for batch in batches:
            keys, ends, asks, tells, ask_ends, tell_ends = batch.column(0), [], [], [], [0], [0]
            for t in batch.column(1).to_pylist():
                verdict, last, before = look(t)
                ends.append(verdict == "cut")
                asks += known.asked(verdict, last)
                ask_ends.append(len(asks))
                # what the last unit goes on with counts even where it is itself cut
                tells += known.told([*((u, True) for u in before), (last, False)])
                tell_ends.append(len(tells))
            lists = lambda rows, kinds, offsets: pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array([r[i] for r in rows], k) for i, (_, k) in enumerate(kinds)], names=[n for n, _ in kinds]))
            kinds = [("h", pa.int64()), ("w", pa.string()), ("whole", pa.bool_())]
            yield pa.RecordBatch.from_arrays([keys, pa.array(ends, pa.bool_()), lists(asks, kinds[:2], ask_ends), lists(tells, kinds, tell_ends)], names=["row_key", "by_end", "asks", "knows"])

    slim = replies.select(F.col(call_id).cast("bigint").alias("row_key"), F.col(text).alias("text")).where(F.col("row_key").isNotNull() & F.col("text").rlike(r"\S"))
    seen = written(slim.mapInArrow(run, f"row_key bigint, by_end boolean, asks {asked}, knows {knows}"))
    ask = seen.select("row_key", F.inline("asks")).withColumnRenamed("w", "part")
    known = seen.select(F.inline("knows")).groupBy("h", "w").agg(F.max("whole").alias("whole")).where("NOT whole").select("h", "w")
    longer = F.col("w").isNull() | (F.col("w").startswith(F.col("part")) & (F.col("w") != F.col("part")))
    by_prefix = ask.join(known, "h").where(longer).select("row_key", F.lit(True).alias("by_prefix"), F.lit(False).alias("by_end"))
    by_end = seen.select("row_key", F.lit(False).alias("by_prefix"), "by_end")
    both = by_end.unionByName(by_prefix).groupBy("row_key").agg(F.max("by_prefix").alias("by_prefix"), F.max("by_end").alias("by_end"))
    return both.select(F.col("row_key").alias(call_id), (F.col("by_prefix") | F.col("by_end")).alias("cut"), "by_prefix", "by_end")


def rates(replies: DataFrame, *, source: str = "source", call_id: str = "call_id", text: str = "text") -> DataFrame:
    """Replies with a text, cut ones and their share for each source; NULL is a source of its own."""
    where = replies.select(call_id, source).groupBy(call_id).agg(F.min(source).alias(source))
    joined = judged(replies, call_id=call_id, text=text).join(where, call_id)
    flag = F.col("cut").cast("int")
    return joined.groupBy(source).agg(F.count("*").alias("replies"), F.sum(flag).alias("cut_replies"), F.round(F.avg(flag.cast("double")), 6).alias("cut_share"))
