"""Problem 6: one form for text that looks the same but differs in its characters.

Order of work per value: (1) compatibility forms of ASCII (full-width, mathematical, ligatures) are folded,
(2) invisible characters are deleted, (3) spaces become the ASCII space, (4) combining accents are composed,
(5) words that hold letters with a look-alike in another script are decoded with Viterbi over the lattice of
look-alikes: a path pays for every change of script, earns the log probability of its letters under that
script's character bigrams, and starts with the script of the neighbouring words.  Genuine words of another
script therefore keep their letters: their unambiguous letters hold the path in their script.

Defined results: null stays null, empty text is no case, texts of any length are processed whole.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from graylark.llm.batches import rows_schema, scan, spread
from graylark.llm.langseeds import SENTENCES, pieces, vocabulary
from graylark.llm.mojibake import repair_word

INVISIBLE = "​‌‍⁠⁡⁢⁣⁤﻿­᠎͏"
SPACES = "   -   　"
STYLED = "！-～\U0001d400-\U0001d7ffℂℊ-ℓℕℙ-ℝℤℨℬℭℯ-ℱℳℴ①-⓪"
LIGATURES = "ﬀ-ﬆ"
COMBINING = "̀-ͯ"
PLAIN_CASE = re.compile(f"[{INVISIBLE}{SPACES}{STYLED}{LIGATURES}{COMBINING}]")
FOLD = re.compile(f"[{STYLED}{LIGATURES}]+")
DROP = str.maketrans({c: None for c in INVISIBLE})
SPACE = re.compile(f"[{SPACES}]")
#: Look-alikes, Cyrillic and Greek against Latin (fixed values: pairs of the Unicode confusables data).
CYRILLIC_TO_LATIN = dict(zip("аеорсухіјѕһԁԛԝӏАВЕІЈКМНОРСТУХҮԌѴЅԚԜ", "aeopcyxijshdqwlABEIJKMHOPCTYXYGVSQW"))
GREEK_TO_LATIN = dict(zip("αοινρυκΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aoivpukABEZHIKMNOPTYX"))
LATIN_TO_CYRILLIC = {v: k for k, v in CYRILLIC_TO_LATIN.items() if k in "аеорсухіАВЕКМНОРСТУХІ"}
TO_LATIN = CYRILLIC_TO_LATIN | GREEK_TO_LATIN
LETTERS = re.compile("[^\\W\\d_]+")
FOREIGN = re.compile("[Ͱ-ϿЀ-ԯ]")
SWITCH = 6.0
OUTSIDE = -9.0


@lru_cache(maxsize=1)
def _bigrams() -> dict[str, float]:
    """Log probability of each letter after another, per script, from the public vocabulary and sentences."""
    pairs, firsts = Counter(), Counter()
    known = [p for p in vocabulary() if p.isascii()] + [p for lang in SENTENCES for p in pieces(lang)]
    for lang, text in SENTENCES.items():
        known += [" " + w for w in LETTERS.findall(text)]
    for piece in known:
        for word in LETTERS.findall(piece.lower()):
            start = "^" if piece[0] == " " else ""
            for a, b in zip(start + word, (start + word)[1:]):
                pairs[a + b] += 1
                firsts[a] += 1
    return {p: math.log((n + 0.1) / (firsts[p[0]] + 6)) for p, n in pairs.items()}


def script_of(char: str) -> str:
    if char < "ɐ":
        return "L"
    return "G" if "Ͱ" <= char < "Ѐ" else "C" if "Ѐ" <= char < "԰" else "O"


def _score(before: str, char: str) -> float:
    a, b = before.lower(), char.lower()
    known = _bigrams().get(a + b)
    return known if known is not None else -7.0 if b.isascii() else OUTSIDE


@lru_cache(maxsize=1 << 17)
def decode_word(word: str, context: str) -> str:
    """The most likely spelling of a word over its look-alike lattice; ``context`` is the neighbours' script."""
    lattice = []
    for c in word:
        options = [(c, 0.0)]
        if c in TO_LATIN:
            options.append((TO_LATIN[c], 0.0))
        elif c in LATIN_TO_CYRILLIC:
            options.append((LATIN_TO_CYRILLIC[c], 0.0))
        lattice.append(options)
    states: dict[str, tuple[float, str]] = {}
    for i, options in enumerate(lattice):
        new: dict[str, tuple[float, str]] = {}
        for c, cost in options:
            s = script_of(c)
            if i == 0:
                best = ((0.0 if s == context else -SWITCH / 2) + _score("^", c), c)
            else:
                best = max((score + (0.0 if script_of(text[-1]) == s else -SWITCH) + _score(text[-1], c) - cost, text + c) for score, text in states.values())
            if s not in new or best > new[s]:
                new[s] = best
        states = new
    return max(states.values())[1]


def normalize(text: str | None) -> tuple[str | None, bool]:
    """The one form of a value, and whether the value was a case (held anything to be made plain)."""
    if not text or text.isascii():
        return text, False
    case = False
    if PLAIN_CASE.search(text):
        case = True
        text = FOLD.sub(lambda m: unicodedata.normalize("NFKC", m.group()), text.translate(DROP))
        text = unicodedata.normalize("NFC", SPACE.sub(" ", text))
    if not FOREIGN.search(text):
        return text, case
    matches = list(LETTERS.finditer(text))
    words = [m.group() for m in matches]
    kinds = [_kind(w) for w in words]
    native = sum(len(w) for w, k in zip(words, kinds) if k in "CG")
    latin = sum(len(w) for w, k in zip(words, kinds) if k == "L")
    out, last = [], 0
    for i, (m, w, k) in enumerate(zip(matches, words, kinds)):
        if k in "LCGO":
            continue
        if k == "p":  # nothing but letters that have a Latin look-alike: the neighbours decide
            near = {kinds[j] for j in (i - 1, i + 1) if 0 <= j < len(kinds)}
            if near & {"C", "G"} or native > 0.25 * latin:
                continue
            if not near & {"L", "m"} and not (latin and latin > native):
                continue
        if _garbled(text, m):
            continue
        new = decode_word(w, "L" if latin >= native else "C")
        if new != w:
            case = True
            out.append(text[last : m.start()])
            out.append(new)
            last = m.end()
    if out:
        out.append(text[last:])
        text = "".join(out)
    return text, case


@lru_cache(maxsize=1 << 17)
def _kind(word: str) -> str:
    """L, C, G, O: one script; p: only foreign letters with Latin look-alikes; m: mixed."""
    scripts = {script_of(c) for c in word}
    if len(scripts) > 1:
        return "m" if scripts <= {"L", "C", "G"} else "O"
    s = scripts.pop()
    return "p" if s in "CG" and all(c in TO_LATIN for c in word) else s


def _garbled(text: str, m: re.Match) -> bool:
    """Whether the mixed word comes from wrong decoding: its characters up to the next blanks have a shorter reading."""
    a, b = m.start(), m.end()
    while a and not text[a - 1].isspace() and text[a - 1] > "\x7f":
        a -= 1
    while b < len(text) and not text[b].isspace() and text[b] > "\x7f":
        b += 1
    piece = text[a:b]
    return repair_word(piece) != piece


def cases(df: DataFrame, key: str, text: str, tab: str) -> DataFrame:
    """``(tab, row_key)`` of the rows whose value isn't in the one form."""
    schema = rows_schema(tab=T.StringType(), row_key=T.LongType())
    return scan(spread(df.select(key, text), key), [key, text], schema, lambda k, t: ((tab, k),) if normalize(t)[1] else ())


def unify(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, unified, was_case)`` for every row; values that look the same come out equal."""
    schema = rows_schema(**{key: df.schema[key].dataType, "unified": T.StringType(), "was_case": T.BooleanType()})
    return scan(spread(df.select(key, text), key), [key, text], schema, lambda k, t: ((k, *normalize(t)),))
