"""Text that looks the same in one consistent form (problem 6).

Each token's letters are resolved to sets of scripts, a letter that looks like one of another script having both; the
sets are intersected over the token. An empty intersection is a mixed token with a proper letter of each script, a
token whose own scripts differ but whose intersection isn't empty is a mixed-script confusable, and one whose letters
all look like another script's is a whole-script confusable, decided by its neighbours. The script that the token can
be spelled in consistently is selected and its letters are written in it; then full-width forms, separate accents,
invisible characters, spaces and letters that stand for digits are normalized.

Proper content stays: signs such as №, «», —, …, ², °, ₽; full-width punctuation next to Chinese or Japanese
characters; vowel signs of scripts that need them; joiners between Indic or Arabic letters; whole Latin words, codes.
A whole-script look-alike of more than three letters, or in capitals, counts only where the same text has the word in
the other script; a Cyrillic one only in a text without any proper Cyrillic letter.

Cases: NULL stays NULL and is no case; empty and blank texts are plain unless their white space is odd; ties between
scripts are decided by the neighbours, else the token stays; repeated rows of a key count once; texts are read whole;
empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folium.plans.ship import ensure_shipped

# Letters that look alike, by pairs of scripts (the same place in both strings).
LATIN = "ABCEHIJKMOPSTXYaceijopsxy"
AS_CYRILLIC = "АВСЕНІЈКМОРЅТХУасеіјорѕху"
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαονρικυχγτ"
GREEK_AS_LATIN = "ABEZHIKMNOPTYXaovpikuxyt"
GREEK_AS_CYRILLIC = "АВЕЗНІКМИОРТУХаоvрікихут"
#: Letters that stand for a digit between digits.
AS_DIGIT = {"О": "0", "о": "0", "O": "0", "o": "0", "Ο": "0", "ο": "0", "З": "3", "з": "3", "l": "1", "I": "1", "І": "1", "|": "1"}

TO_CYRILLIC = dict(zip(LATIN, AS_CYRILLIC)) | {g: c for g, c in zip(GREEK, GREEK_AS_CYRILLIC) if "Ѐ" <= c <= "ӿ"}
TO_LATIN = dict(zip(AS_CYRILLIC, LATIN)) | dict(zip(GREEK, GREEK_AS_LATIN))
INVISIBLE = "\xad​‌‍‎‏‪‫‬‭‮⁠⁡⁢⁣⁤﻿᠎"
ODD_SPACE = "\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
WIDE_MARKS = "！（），：；？．［］｛｝～＂＇"

#: Characters that are odd by themselves, or may be: separate accents, Greek, spaces, invisible and full-width ones.
SPECIAL = re.compile("[\xa0\xad\u0300-\u036f\u0370-\u03ff\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u2064\u3000\ufb00-\ufb06\ufeff\uff01-\uffef\U0001d400-\U0001d7ff]")
#: Letters that may be mixed into Cyrillic words, and digits that letters may stand beside.
LATIN_RUN, DIGIT_RUN = re.compile("[A-Za-z\u0370-\u03ff]+"), re.compile("[0-9]+")
LONE = re.compile("[aceopxy]{1,3}|[ABCEHKMOPTXY]")
#: Longer runs of letters that all look like Cyrillic ones; a Cyrillic letter that looks like no Latin one.
SHARED = re.compile(f"[{LATIN}]{{3,}}")
CYRILLIC, PROPER = re.compile("[\u0400-\u052f]"), re.compile(f"(?![{AS_CYRILLIC}])[\u0400-\u052f]")
TOKEN = re.compile(r"[^\W\d_]+")
CJK = re.compile("[、-ヿ㐀-鿿가-힯]")
JOINED = re.compile("[؀-ۿݐ-ݿऀ-෿]")
DIGIT_LETTER = re.compile(r"(?<=[0-9])[ОоOoЗзlI|ΟοІ]+(?=[0-9]|(?:[.,][0-9])|(?:[ .,;:)%»]|$))|(?<![^\W_])[ОоOoЗзlI|ΟοІ]+(?=[0-9][0-9.,]*(?:[ .,;:)%»\n]|$))")


def script(c: str) -> str:
    o = ord(c)
    if o < 0x250:
        return "Latn"
    if 0x370 <= o < 0x400 or 0x1F00 <= o < 0x2000:
        return "Grek"
    if 0x400 <= o < 0x530:
        return "Cyrl"
    return "Zyyy"


def scripts(c: str) -> set[str]:
    """Scripts in which a letter of the same look exists."""
    s = script(c)
    if s == "Zyyy":
        return {"Zyyy"}
    out = {s}
    if s != "Cyrl" and c in TO_CYRILLIC:
        out.add("Cyrl")
    if s != "Latn" and c in TO_LATIN:
        out.add("Latn")
    return out


def respell(token: str, to: str) -> str:
    table = TO_CYRILLIC if to == "Cyrl" else TO_LATIN
    return "".join(c if script(c) == to else table.get(c, c) for c in token)


def _around(text: str, start: int, end: int) -> str | None:
    """Script of the nearest words on both sides, where they agree or only one side has a word."""
    left = [m for m in TOKEN.findall(text[max(0, start - 40) : start]) if len(m) > 1 or script(m) == "Cyrl"]
    right = [m for m in TOKEN.findall(text[end : end + 40]) if len(m) > 1 or script(m) == "Cyrl"]
    found = {script(x[0]) for x in [*left[-1:], *right[:1]]}
    return found.pop() if len(found) == 1 else None


def _token(text: str, start: int, end: int) -> str:
    """Consistent spelling of the token at these places."""
    token = text[start:end]
    own = {script(c) for c in token} - {"Zyyy"}
    if not own:
        return token
    common = {"Latn", "Cyrl", "Grek"}
    for c in token:
        s = scripts(c)
        if s != {"Zyyy"}:
            common &= s
    if len(own) > 1:
        if len(common) == 1:
            return respell(token, next(iter(common)))
        if common:  # all letters exist in both: the neighbours decide, else the commoner script of the token
            near = _around(text, start, end)
            count = {s: sum(script(c) == s for c in token) for s in own}
            best = near if near in common else max(sorted(common & own) or sorted(common), key=lambda s: count.get(s, 0))
            return respell(token, best)
        # a proper letter of each script: respell what looks alike into the script with more proper letters
        proper = {s: sum(scripts(c) == {s} for c in token) for s in ("Latn", "Cyrl")}
        if abs(proper["Latn"] - proper["Cyrl"]) and min(proper.values()) == 0:
            return respell(token, max(proper, key=proper.get))
        return token
    s = next(iter(own))
    other = {"Latn": "Cyrl", "Grek": "Cyrl", "Cyrl": "Latn"}[s]
    if s == "Grek" and other in common:
        return respell(token, _around(text, start, end) or other)
    # whole-script confusable: a word of look-alikes only, no code and no unit, among words of the other script; a short
    # one in lower-case letters, or a longer one that the text has elsewhere in the other script
    if s == "Latn" and "Cyrl" in common:
        before, after = text[start - 1 : start], text[end : end + 1]
        alone = (not before or before.isspace() or before in "(«\"") and (not after or after.isspace() or after in ",.;:)»")
        short = len(token) <= 3 and (token.islower() or len(token) == 1)
        if alone and (short or len(token) > 2) and _around(text, start, end) == "Cyrl":
            new = respell(token, "Cyrl")
            if short or re.search(rf"(?<![^\W_]){new}(?![^\W_])", text, re.I):
                return new
    return token


def _plain_char(text: str, i: int, marks: bool) -> str:
    c = text[i]
    if c in ODD_SPACE:
        return "\n" if c in "\u2028\u2029" else " "
    if c in INVISIBLE:
        if c in "‌‍" and JOINED.match(text[i - 1 : i] or "x") and JOINED.match(text[i + 1 : i + 2] or "x"):
            return c
        return ""
    if "！" <= c <= "￯":
        if c in WIDE_MARKS and marks:
            near = text[max(0, i - 2) : i] + text[i + 1 : i + 3]
            if CJK.search(near):
                return c
        return unicodedata.normalize("NFKC", c)
    if "ﬀ" <= c <= "ﬆ" or "\U0001d400" <= c <= "\U0001d7ff":  # ligatures, mathematical letters
        return unicodedata.normalize("NFKC", c)
    return c


def normal_form(text: str | None) -> str | None:
    """The consistent form of a text."""
    if not text:
        return text
    if SPECIAL.search(text):
        text = SPECIAL.sub(lambda m: _plain_char(m.string, m.start(), True), text)
        if any("\u0300" <= c <= "\u036f" for c in text):
            text = _composed(text)
    if only_alike(text):
        text = _all_latin(text)
    parts, at = [], 0
    for m in LATIN_RUN.finditer(text):
        start, end = m.start(), m.end()
        if start < at or not (_beside(text, start, end) or LONE.fullmatch(m.group()) or SHARED.fullmatch(m.group())):
            continue
        while start > at and text[start - 1].isalpha():
            start -= 1
        while end < len(text) and text[end].isalpha():
            end += 1
        new = _token(text, start, end)
        if new != text[start:end]:
            parts += [text[at:start], new]
            at = end
    if parts:
        text = "".join([*parts, text[at:]])
    for m in DIGIT_RUN.finditer(text):
        if text[m.start() - 1 : m.start()] in AS_DIGIT or text[m.end() : m.end() + 1] in AS_DIGIT:
            return DIGIT_LETTER.sub(_digit, text)
    return text


def _all_latin(text: str) -> str:
    """A text whose Cyrillic letters all look like Latin ones: words of them are Latin, if the text has a word that is."""
    if not any(any(scripts(c) == {"Latn"} for c in m) for m in TOKEN.findall(text)):
        return text
    return TOKEN.sub(lambda m: respell(m.group(), "Latn") if all(script(c) == "Cyrl" for c in m.group()) else m.group(), text)


def is_plain(token: str) -> bool:
    """Whether a piece without white space is in the consistent form whatever stands around it, in a text that has a
    Cyrillic letter of its own kind (see `only_alike`)."""
    if SPECIAL.search(token):
        return False
    for m in LATIN_RUN.finditer(token):
        start, end = m.start(), m.end()
        if _beside(token, start, end):
            return False
        if (LONE.fullmatch(m.group()) or SHARED.fullmatch(m.group())) and token[start - 1 : start] in ("", *"(«\"") and token[end : end + 1] in ("", *",.;:)»"):
            return False
    return not any(token[m.start() - 1 : m.start()] in AS_DIGIT or token[m.end() : m.end() + 1] in AS_DIGIT for m in DIGIT_RUN.finditer(token))


def only_alike(text: str) -> bool:
    """Whether a text has Cyrillic letters, but none that looks like no Latin one; then its pieces don't decide alone."""
    return PROPER.search(text) is None and CYRILLIC.search(text) is not None


def _beside(text: str, start: int, end: int) -> bool:
    """Whether a run is Greek or touches a letter of another script."""
    if text[start] >= "\u0370" or text[end - 1] >= "\u0370":
        return True
    return "\u0400" <= text[start - 1 : start] <= "\u052f" or "\u0400" <= text[end : end + 1] <= "\u052f"


def _composed(text: str) -> str:
    """Letters with separate accents as single characters, where they exist; other marks stay."""
    out: list[str] = []
    for c in text:
        if "̀" <= c <= "ͯ" and out and len(one := unicodedata.normalize("NFC", out[-1] + c)) == 1:
            out[-1] = one
        else:
            out.append(c)
    return "".join(out)


def _digit(m: re.Match) -> str:
    text, start, end = m.string, m.start(), m.end()
    a, b = start, end
    while a and (text[a - 1].isdigit() or text[a - 1] in ".,"):
        a -= 1
    while b < len(text) and (text[b].isdigit() or text[b] in ".,"):
        b += 1
    # a letter between two digits is one; at the edge of a number a code such as 530-З keeps its letter
    inside = start > 0 and text[start - 1].isdigit() and end < len(text) and text[end].isdigit()
    edge = text[a - 1 : a] not in ("-", "/") and text[b : b + 1] not in ("-", "/") and not text[a - 1 : a].isalpha() and not text[b : b + 1].isalpha()
    grouped = re.search(r"[0-9] $", text[max(0, start - 2) : start]) and re.match(r"[0-9]{2}(?![0-9])", text[end : end + 3])
    if inside or edge and (b - a > 3 and ("." in text[a:b] or "," in text[a:b]) or grouped):
        return "".join(AS_DIGIT[c] for c in m.group())
    return m.group()


def odd_rows(df: DataFrame, *, key: str, text: str) -> DataFrame:
    """row_id of the rows whose text isn't in the consistent form."""
    return normalized(df, key=key, text=text).where("changed").select("row_id").distinct()


def normalized(df: DataFrame, *, key: str, text: str) -> DataFrame:
    """row_id, text in the consistent form, changed; a row for each row of the table that has a key and a text."""
    ensure_shipped(df.sparkSession)

    def run(batches):
        for batch in batches:
            old = batch.column(1).to_pylist()
            new = [normal_form(t) for t in old]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(new, pa.string()), pa.array([a != b for a, b in zip(old, new)], pa.bool_())], names=["row_id", "text", "changed"])

    slim = df.select(F.col(key).cast("bigint").alias("row_id"), F.col(text).alias("text")).where(F.col("row_id").isNotNull() & F.col("text").isNotNull())
    return slim.mapInArrow(run, "row_id bigint, text string, changed boolean")
