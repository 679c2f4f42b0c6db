"""Sentence boundaries across languages and scripts (problem 2).

A text is cut at blank lines and table lines into blocks; within a block, places after closing punctuation are
candidates. A semi-Markov dynamic programme then selects whole spans between candidates: a span's score joins its
length, its opening words, its closing words and whether the quotation marks and brackets in it are balanced, so a mark
after an abbreviation is passed over when the span as a whole reads better without a cut. Left out beforehand are
candidates that no span could open after (a lower-case letter, a comma, a dash) and those inside a quotation or bracket
that closes in the block, which belong to the sentence around them. Places where a final mark and the opening after it
leave no doubt are taken at once and split the programme; between spans of 12 characters or more this is what the
programme chooses itself, shorter sentences ("Да.") are kept against its price for short spans.

Cases: NULL and blank texts have no sentences; repeated rows of a key come out once; texts of any length are read whole
and looked back over without a bound; a mark without a partner switches nothing off; ties go to the earlier cut; empty
tables give no rows; other columns are ignored. Positions count characters.
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folium.plans.ship import ensure_shipped

LONG = 400
TABLE = "[ТАБЛИЦА]"
BLANK = re.compile(r"\n(?:[^\S\n]*\n)+")
#: A place where a sentence could end: marks, then closing quotes and brackets, and after the gap a character that
#: could open a sentence; a point after a lone capital is an initial's; without a gap only a capital, an opening quote or a letter of a script without case.
_NOT_OPEN = r"a-zа-яёß-öø-ÿ,;:%—–)\]}»"
END = re.compile(
    rf"((?<![\s.«„(][A-ZА-ЯЁ])[.!?…؟۔]+)([»“”’\"')\]」』]*)(?:(\s+)(?=[^\s{_NOT_OPEN}])|(?=[^\W\d_a-zа-яёß-öø-ÿ]|[«„“]))"
    r"|([।॥。！？｡]+)([»”’\"')\]」』）]*)(\s*)(?=[^\s，、；：,;:)）])"
)
THAI_GAP = re.compile(r"(?<=[฀-๿])[^\S\n]+|(?<=[0-9])[^\S\n]+(?=[฀-๿])")
THAI = re.compile("[฀-๿]")
HIDDEN = re.compile("[\xad​-‏⁠﻿]")
PARTNER = {"»": "«", "”": "“„", ")": "(", "]": "[", "」": "「", "』": "『", "）": "（"}
MARKS = re.compile(r"[«»„“”‘\"()\[\]「」『』（）]")
FINAL = "!?…؟۔।॥。！？｡"
WIDE = "。！？｡"

#: Short forms after which a name or number follows, so that the point does not close a sentence.
BEFORE_NAME = set(
    "г гор ул пр просп пер пл пос дер обл проф акад доц канд гл зам им св тов гр ст ч п пп рис табл см ср доб тел стр корп кв оф д лит вх исх т инж ген напр англ "
    "mr mrs ms dr prof hr fr frl st no nos vol pp sec ch fig cf vs vgl nr abs abschn art ca approx etc_ bzw ziff kap bd str hon rev capt col gen sen rep inc_ hl dipl ing e.g i.e z.b d.h u.a डॉ श्री".split()
)
#: Short forms that may close a sentence; a capital after them decides for a cut.
MAY_CLOSE = set("руб коп тыс млн млрд шт ед дн мес лет чел см мм км др т.д т.п т.д т.п пр г м кг ч мин сек л га co ltd inc corp usw etc kg".split())
#: Names of months that follow an ordinal with a point.
AFTER_ORDINAL = re.compile(r"(?:Januar|Jänner|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember)\b")
NUMBERING = re.compile(r"\s*(?:\d+(?:\.\d+)*|[IVXLC]+|[^\W\d_])[.)]$")


def _lone_upper(word: str) -> bool:
    return len(word) == 1 and word.isupper()


def _closing(text: str, start: int, dot: int, after: int) -> float:
    """Score of closing a span with the mark at `dot`, `after` being the first character after the gap."""
    mark = text[dot]
    if mark in FINAL:
        return 3.0
    parts = text[max(start, dot - 40) : dot].rsplit(None, 2)
    token = parts[-1] if parts else ""
    if token.isalpha():
        if len(token) > 6:
            return 2.5
        word, inner = token, ""
    else:
        token = HIDDEN.sub("", token)
        k = len(token)
        while k and (token[k - 1].isalpha() or token[k - 1] == "." or unicodedata.combining(token[k - 1]) or "ऀ" <= token[k - 1] <= "ॏ"):
            k -= 1
        word, inner = token[k:].lstrip("."), token[:k]
    low = word.lower()
    if len(word) > 4 and low not in BEFORE_NAME and low not in MAY_CLOSE:
        return 2.5
    nxt = text[after] if after < len(text) else ""
    if not word:
        if dot - start <= 12 and token[-1:].isdigit() and NUMBERING.match(text, start, dot + 1):
            return -6.0  # the numbering of a clause belongs to it
        if token[-1:].isdigit() and len(token) <= 2 and "A" <= nxt <= "S" and AFTER_ORDINAL.match(text, after):
            return -6.0  # an ordinal of a date
        return 2.0
    rest = inner or (parts[-2] if len(parts) > 1 else "")
    rest = HIDDEN.sub("", rest)
    if _lone_upper(word):
        if rest[-1:] in ("-", "/", "°") or rest[-1:].isdigit():
            return 2.0
        return -4.0 if nxt.isupper() or nxt in "«„" else 1.0
    if "." in low and _lone_upper(word.rpartition(".")[2]):
        return -4.0
    if low in ("т.ч", "т.е", "т.к", "т.н", "и.о", "e.g", "i.e", "z.b", "d.h", "u.a"):
        return -5.0
    if low == "ч" and rest == "т.":
        return -5.0
    if low in ("д", "п") and rest == "т.":
        return 2.0  # т. д., т. п.
    if low in ("г", "гг") and rest[-4:].isdigit() and len(rest) >= 4:
        return 2.0  # the year 2024 г.
    if low in ("г", "т", "ч", "д", "л", "м") and rest[-1:].isdigit():
        return 2.0 if not nxt.isdigit() else -2.0
    if low in ("м", "см") and rest in ("кв.", "куб."):
        return 2.0
    if low in BEFORE_NAME:
        return -5.0
    if low in MAY_CLOSE:
        return 1.5 if not nxt.isdigit() else -1.0
    if nxt.isdigit() and len(low) <= 3:
        return -2.0
    return 2.5


def _opening(text: str, at: int) -> float:
    c = text[at] if at < len(text) else ""
    if not c or c.isupper():
        return 1.0
    if c.islower():
        return -8.0
    if c.isdigit():
        return 0.3
    if c in "«„“\"'‘([「『（":
        return 0.8
    if c.isalpha():
        return 1.0  # a script without case
    if c in "—–-*•":
        return -3.0
    return -1.0 if c in "№§" else -6.0


def _depths(text: str, start: int, end: int) -> tuple[list[int], list[int]]:
    """Places where the nesting of quotation marks and brackets changes, and the depth after each. Marks without a partner
    count for nothing; of an odd number of straight quotation marks it can't be told which one that is, so none counts."""
    open_: list[tuple[str, int]] = []
    changes: list[tuple[int, int]] = []
    straight = text.count('"', start, end) % 2 == 0

    def pair(openers: str, at: int) -> bool:
        for k in range(len(open_) - 1, -1, -1):
            if open_[k][0] in openers:
                changes.extend([(open_[k][1], 1), (at, -1)])
                del open_[k:]
                return True
        return False

    for m in MARKS.finditer(text, start, end):
        c, at = m.group(), m.start()
        if c == '"':
            if straight and not pair('"', at):
                open_.append((c, at))
        elif c == "“":
            if not (open_ and open_[-1][0] == "„" and pair("„", at)):
                open_.append((c, at))
        elif c in PARTNER:
            pair(PARTNER[c], at)  # "1)" and other lone closing marks pair with nothing
        else:
            open_.append((c, at))
    changes.sort()
    depth, depths = 0, []
    for _, step in changes:
        depth += step
        depths.append(depth)
    return [at for at, _ in changes], depths


def _best(text: str, start: int, end: int, cuts: list[tuple[int, int, float]]) -> list[tuple[int, int]]:
    """Semi-Markov choice of spans; cuts: (end of a span, start of the next, closing score).

    Each span has a price, and one of more than LONG characters a little more for each of them, so the best of all spans
    that long that end at a cut follows from a running maximum; the others are few. The choice is exact at any length.
    """
    nodes = [(start, start, 0.0), *cuts, (end, end, 2.0)]
    opening = [1.0, *(_opening(text, n[1]) for n in nodes[1:])]
    best, back = [0.0], [0]
    far, far_value, far_arg = 0, float("-inf"), 0
    for j in range(1, len(nodes)):
        stop, _, closing = nodes[j]
        while far < j and stop - nodes[far][1] > LONG:
            value = best[far] + opening[far] + 0.002 * nodes[far][1]
            if value > far_value:
                far_value, far_arg = value, far
            far += 1
        top, arg = far_value - 0.002 * (stop - LONG), far_arg
        for i in range(far, j):
            length = stop - nodes[i][1]
            value = best[i] + opening[i] - (3.0 if length < 4 else 1.0 if length < 12 else 0.0)
            if value > top:
                top, arg = value, i
        best.append(top + closing - 1.2)
        back.append(arg)
    spans, j = [], len(nodes) - 1
    while j:
        i = back[j]
        spans.append((nodes[i][1], nodes[j][0]))
        j = i
    return spans[::-1]


def _block(text: str, start: int, end: int, out: list[tuple[int, int]], thai: bool) -> None:
    while start < end and text[start].isspace():
        start += 1
    while end > start and text[end - 1].isspace():
        end -= 1
    if start >= end:
        return
    places, depths = _depths(text, start, end)
    k, depth, begin, cuts, marks = 0, 0, start, [], len(places)

    def flush(stop: int) -> None:
        if cuts:
            out.extend(_best(text, begin, stop, cuts))
        elif stop > begin:
            out.append((begin, stop))

    found = [(m.end(2) if m.end(2) >= 0 else m.end(5), m.end(), m) for m in END.finditer(text, start, end)]
    if thai:
        found = sorted([*found, *((m.start(), m.end(), None) for m in THAI_GAP.finditer(text, start, end))], key=lambda x: x[:2])
    for stop, after, m in found:
        if after >= end:
            continue
        if m is None:
            if "฀" <= text[after] <= "๿" and stop > begin:
                flush(stop)
                begin, cuts = after, []
            continue
        mark, closers, gap = (m.group(1), m.group(2), m.group(3)) if m.group(1) else (m.group(4), m.group(5), m.group(6))
        c = text[after]
        if not gap and m.group(1) and (text[m.start() - 1 : m.start()].isupper() or (closers and c in "«„“")):
            continue  # initials
        if c.islower() or (c == "-" and text[after + 1 : after + 2] != " "):
            continue
        while k < marks and places[k] < stop:
            depth = depths[k]
            k += 1
        quoted = bool(closers) and closers[0] in "»”\"“」』’"  # the mark stands inside a quotation
        dot = m.start() + len(mark) - 1
        if quoted:
            opener = text[begin] in "«„“\"「『"
            closing = 1.0 if opener and not cuts and c not in "—–" else -4.0
            if mark[-1] in WIDE:
                closing = -6.0
        elif mark[-1] in FINAL and not (mark[-1] == "…" and len(mark) == 1):
            closing = 3.0
        elif mark[-1] == "…":
            closing = 2.5
        else:
            closing = _closing(text, begin if not cuts else cuts[-1][1], dot, after)
            if len(mark) > 1 and mark[0] == ".":
                closing = max(closing, 2.0)
        if closing >= 2.0 and depth == 0 and _opening(text, after) > 0:
            flush(stop)  # nothing in doubt here
            begin, cuts = after, []
        elif closing > -3.5 and depth == 0:
            cuts.append((stop, after, closing))
    flush(end)


def sentences(text: str | None) -> list[tuple[int, int]]:
    """Start and end of each sentence of a text."""
    out: list[tuple[int, int]] = []
    if not text or text.isspace():
        return out
    at = 0
    thai = THAI.search(text) is not None
    for gap in [*BLANK.finditer(text), None]:
        stop = gap.start() if gap else len(text)
        table = text.find(TABLE, at, stop)
        while table > at and text[text.rfind("\n", at, table) + 1 if text.rfind("\n", at, table) >= 0 else at : table].strip():
            table = text.find(TABLE, table + 1, stop)  # only a line of its own opens a table
        if table >= 0:
            _block(text, at, table, out, thai)
            line = table
            while line < stop:
                next_ = text.find("\n", line, stop)
                next_ = stop if next_ < 0 else next_
                a, b = line, next_
                while a < b and text[a].isspace():
                    a += 1
                while b > a and text[b - 1].isspace():
                    b -= 1
                if a < b:
                    out.append((a, b))
                line = next_ + 1
        else:
            _block(text, at, stop, out, thai)
        at = gap.end() if gap else stop
    return out


def split_rows(df: DataFrame, *, key: str, text: str = "text") -> DataFrame:
    """row_id, start_pos, end_pos of every sentence; a key's repeated rows count once."""
    ensure_shipped(df.sparkSession)

    def run(batches):
        for batch in batches:
            starts, ends = [], []
            for t in batch.column(1).to_pylist():
                found = sentences(t)
                starts.append([a for a, _ in found])
                ends.append([b for _, b in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(starts, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32()))], names=["row_id", "starts", "ends"])

    slim = df.select(F.col(key).cast("bigint").alias("row_id"), F.col(text).alias("text")).where(F.col("row_id").isNotNull() & F.col("text").rlike(r"\S"))
    found = slim.mapInArrow(run, "row_id bigint, starts array<int>, ends array<int>")
    # copies of a row are merged before the spans are unfolded; texts never move
    once = found.groupBy("row_id").agg(F.max(F.struct("starts", "ends")).alias("s"))
    return once.select("row_id", F.explode(F.arrays_zip("s.starts", "s.ends")).alias("p")).select("row_id", F.col("p.starts").alias("start_pos"), F.col("p.ends").alias("end_pos"))
