"""Text functions as columns, and the English stemmer used on distinct tokens."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word, optionally with one bracketed part: ``8(5)`` stays whole.
TOKEN = r"[a-z0-9]+(?:\([a-z0-9]+\))?"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


#: Characters that SQL's ``trim`` takes off.
SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def flat(text: Column) -> Column:
    """Lower case by single characters (a final sigma is no special one), white space as one space, trimmed; as the SQL has it."""
    low = F.lower(F.translate(text, "Σİ", "σi"))
    return F.btrim(F.regexp_replace(low, r"[\t\n\f\r ]+", " "), F.lit(SPACES))


def slug(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))


def label_for(node_id: Column) -> Column:
    """``s-8-5-a`` -> ``§8(5)(a)``, ``pen-2`` -> ``Schedule entry 2``; any other id stays."""
    parts = F.split(node_id, "-")
    tail = F.array_join(F.transform(F.slice(parts, 3, 99), lambda p: F.concat(F.lit("("), p, F.lit(")"))), "")
    return F.when(parts[0] == "s", F.concat(F.lit("§"), parts[1], tail)).when(parts[0] == "pen", F.concat(F.lit("Schedule entry "), parts[1])).otherwise(node_id)


# ------------------------------------------------------------------------- stemmer (published Porter2 rules)

_VOWELS = "aeiouy"
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
# Fixed values of the published algorithm.
_WHOLE = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
_STAY = frozenset("sky news howe atlas cosmos bias andes".split())
_AFTER_1A = frozenset("inning outing canning herring earring proceed exceed succeed".split())
_STEP2 = {"tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less"}
_STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")


def _regions(w: str) -> tuple[int, int]:
    def after(start: int) -> int:
        for i in range(start + 1, len(w)):
            if w[i] not in _VOWELS and w[i - 1] in _VOWELS:
                return i + 1
        return len(w)

    r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    r1 = after(0) if r1 is None else r1
    return r1, after(r1)


def _short_syllable_end(w: str) -> bool:
    if len(w) == 2:
        return w[0] in _VOWELS and w[1] not in _VOWELS
    return len(w) > 2 and w[-3] not in _VOWELS and w[-2] in _VOWELS and w[-1] not in _VOWELS + "wxY"


def porter2(word: str) -> str:
    """English stem of a lower-case word."""
    if len(word) <= 2:
        return word
    if word in _WHOLE or word in _STAY:
        return _WHOLE.get(word, word)
    w = word.lstrip("'")
    chars = list(w)
    for i, c in enumerate(chars):
        if c == "y" and (i == 0 or chars[i - 1] in _VOWELS):
            chars[i] = "Y"
    w = "".join(chars)
    r1, r2 = _regions(w)
    for end in ("'s'", "'s", "'"):
        if w.endswith(end):
            w = w[: -len(end)]
            break
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and any(c in _VOWELS for c in w[:-2]):
        w = w[:-1]
    if w in _AFTER_1A:
        return w.lower()
    if w.endswith(("eedly", "eed")):
        end = "eedly" if w.endswith("eedly") else "eed"
        if len(w) - len(end) >= r1:
            w = w[: -len(end)] + "ee"
    else:
        end = next((e for e in ("ingly", "edly", "ing", "ed") if w.endswith(e)), None)
        if end and any(c in _VOWELS for c in w[: -len(end)]):
            w = w[: -len(end)]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif w.endswith(_DOUBLES):
                w = w[:-1]
            elif _short_syllable_end(w) and r1 >= len(w):
                w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _VOWELS:
        w = w[:-1] + "i"
    for end in sorted(_STEP2, key=len, reverse=True):
        if w.endswith(end):
            if len(w) - len(end) >= r1:
                w = w[: -len(end)] + _STEP2[end]
            break
    else:
        if w.endswith("ogi"):
            if len(w) - 3 >= r1 and w[-4:-3] == "l":
                w = w[:-1]
        elif w.endswith("li") and len(w) - 2 >= r1 and w[-3:-2] in tuple("cdeghkmnrt"):
            w = w[:-2]
    for end in ("ational", "tional", "alize", "icate", "iciti", "ative", "ical", "ness", "ful"):
        if w.endswith(end):
            at = len(w) - len(end)
            if end == "ative":
                w = w[:at] if at >= r2 else w
            elif at >= r1:
                w = w[:at] + _STEP3[end]
            break
    end = next((e for e in _STEP4 if w.endswith(e)), None)
    if end:
        if len(w) - len(end) >= r2:
            w = w[: -len(end)]
    elif w.endswith("ion") and len(w) - 3 >= r2 and w[-4:-3] in ("s", "t"):
        w = w[:-3]
    if w.endswith("e"):
        if len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _short_syllable_end(w[:-1]):
            w = w[:-1]
    elif w.endswith("l") and len(w) - 1 >= r2 and w[-2:-1] == "l":
        w = w[:-1]
    return w.lower()


def stem(token: str) -> str | None:
    """The stem if it differs; only words of letters, longer than three, have one."""
    if len(token) <= 3 or not token.isalpha():
        return None
    found = porter2(token)
    return found if found != token else None


def token_rows(docs: DataFrame, key: str, text: str, stems: bool = False) -> DataFrame:
    """(key, tok): one row per token; with ``stems`` also one per token that has a stem. The stemmer sees each
    distinct token once."""
    rows = docs.select(key, F.explode(tokens(F.col(text))).alias("tok"))
    if not stems:
        return rows

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(stem=b.tok.map(stem)).dropna()

    known = rows.select("tok").distinct().mapInPandas(run, "tok string, stem string")
    return rows.unionByName(rows.join(known, "tok").select(key, F.col("stem").alias("tok")))
