"""Problem 1: find and undo text that was decoded with the wrong encoding.

Method: minimum description length.  For every word with a character beyond ASCII the operator builds the candidate decodings:
chains of steps "encode with the encoding that was wrongly used, decode with the one that was meant", in any number and
mixture.  A decoding's length is what zstandard needs for the word behind a sentence of a language, under a dictionary of
that language (the language that suits best counts); to it come the chain's own cost and, where a step leaves characters
of the word unexplained, the cost of saying so.  The shortest description wins; without a shorter one the word stays.

UTF-8 read as something else is decided word by word, by the mean of coded and plain length: chance hardly ever makes valid
UTF-8, so the bytes of a word that the dictionaries don't know count too.  A single-byte encoding read as another gives letters
for letters, so there the dictionaries alone decide, over many words at once: the stretch of words that a chain would shorten
most, word by word, is compressed as a whole before and after, and the chain wins if it saves more than it costs.

Words are the unit because damage is often local, and because a word's lengths can be kept in a cache: a corpus has few
distinct damaged words.

Defined results: null and empty texts are clean; replacement characters and C1 controls mark a record as
damaged but are not restorable; very long texts are processed whole, in one pass.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from graylark.llm.batches import rows_schema, scan, spread
from graylark.llm.langseeds import ALPHABETS, SENTENCES, pieces, vocabulary

#: Encodings in which UTF-8 bytes are commonly misread.
WRONG_FOR_UTF8 = ("cp1252", "mac_roman", "cp1251", "cp1250", "cp1254", "cp437")
#: (wrongly used, meant) pairs of single-byte encodings.
SINGLE_BYTE = (
    ("cp1252", "cp1251"), ("cp1252", "koi8-r"), ("cp1251", "koi8-r"), ("koi8-r", "cp1251"), ("cp866", "cp1251"), ("cp1251", "cp866"),
    ("cp1252", "cp1250"), ("cp1252", "iso8859-2"), ("cp1252", "cp1254"), ("cp1252", "cp1253"), ("cp1252", "mac_roman"), ("mac_roman", "cp1252"),
)
#: Description bytes for each step of a chain, for each letter of a word that a step leaves unexplained, for a letter that the
#: language doesn't have, and for a single-byte chain: one rare name must not make one; a chain that holds for a part of the words must say for which.
STEP_COST, LEFT_COST, ALIEN_COST, CHAIN_COST, STRETCH_COST = 0.5, 4, 1, 3, 3
#: Bytes by which the length of a single word may be wrong.
ROUGH = 2.5
UTF8_RUN = re.compile(rb"[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")
#: What a restored character may be: the scripts and signs that running text uses.
PLAUSIBLE = re.compile("^[\xa0-ſȘ-țˆ˜Ά-ώЁ-џҐґא-ת؀-ۿऀ-ॿ฀-๿ - ₠-₿№™←-⇿　-ヿ一-鿿가-힣＀-￯ﬁﬂ﻿\U0001f300-\U0001faff]+$")
TOKEN = re.compile("(?<![A-Za-z])[A-Za-z]*+[^\x00-\x7f][A-Za-z\x80-\U0010ffff]*+")
LOST = re.compile("[\x80-\x9f�]")
#: Words that can be evidence for a single-byte chain.  Quotes, dashes and currency signs alone are no
#: evidence, as their UTF-8 is longer than that of the letters at their places in other encodings.
UNUSUAL = re.compile("[^\x00-\x7f\xa0‘’“”„«»–—…¿¡ºª£€]")


def _encoders() -> dict[str, dict[str, int]]:
    """Character to byte per encoding; bytes that the encoding leaves open stand for themselves."""
    out = {}
    for name in {*WRONG_FOR_UTF8, *(a for a, _ in SINGLE_BYTE)}:
        table = {}
        for b in range(128, 256):
            try:
                table[bytes([b]).decode(name)] = b
            except UnicodeDecodeError:
                pass
        for b in range(128, 160):
            table.setdefault(chr(b), b)
        if name == "mac_roman":
            table.setdefault("¤", 0xDB)  # the sign at this place before the euro
        out[name] = table
    return out


ENCODERS = _encoders()
#: What may also come out of a step, if another follows.
BETWEEN = frozenset(c for name in WRONG_FOR_UTF8 for c in ENCODERS[name]) | frozenset(map(chr, range(0x80, 0x100)))


HOW = dict(window_log=16, chain_log=13, hash_log=13, search_log=6, min_match=3, target_length=999, strategy=zstandard.STRATEGY_BTULTRA, write_content_size=False, write_checksum=False, write_dict_id=False)
DICTIONARY_BYTES, PIECES, SAMPLE = 1 << 14, 1500, 30


class _Language:
    """The length of words behind text of a language, under its dictionary.

    The dictionary (content and entropy tables) is trained on the public vocabulary and sentence of ``langseeds``.  Words are
    measured behind known text and a run of letters that the dictionary doesn't have, so that they pay for themselves, not
    for the start of a frame; the mean over several such texts is finer than whole bytes.
    """

    def __init__(self, lang: str) -> None:
        own, sentence = pieces(lang), SENTENCES[lang].lower()
        words = own
        if own and not any(c.isascii() and c.isalpha() for c in sentence):
            words = [own[i % len(own)] for i in range(max(PIECES, len(own)))]
        else:  # languages that write mostly ASCII letters
            plain = [p for p in vocabulary() if p.isascii() and (p.islower() or p[0] == " ")]
            words = [w for i in range(PIECES) for w in ((own[i % len(own)], plain[i % len(plain)]) if own else (plain[i % len(plain)],))]
        samples = [(sentence[i * 7 % 100 :][:60] + " " + " ".join(p.strip() for p in words[i : i + SAMPLE])).lower().encode() for i in range(0, len(words), SAMPLE)]
        how = zstandard.ZstdCompressionParameters(**HOW)
        dictionary = zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=64, d=6)
        dictionary.precompute_compress(compression_params=how)
        self.compress = zstandard.ZstdCompressor(compression_params=how, dict_data=dictionary).compress
        self.before = [(sentence[k : k + 20] + sentence[k + 20 : k + 44][::-1] + " ").encode() for k in (0, 31, 62, 93)]
        self.base = sum(len(self.compress(x)) for x in self.before)

    def length(self, word: bytes) -> float:
        return (sum(len(self.compress(x + word)) for x in self.before) - self.base) / len(self.before)

    def whole(self, text: bytes) -> int:
        return len(self.compress(text))


@lru_cache(maxsize=1)
def _languages() -> dict[str, _Language]:
    return {lang: _Language(lang) for lang in SENTENCES}


def _utf8_as(table: dict[str, int]) -> re.Pattern:
    """UTF-8 sequences as an encoding shows them."""
    of = {lo: "[" + "".join(re.escape(c) for c, b in table.items() if lo <= b < hi) + "]" for lo, hi in ((0x80, 0xC0), (0xC2, 0xE0), (0xE0, 0xF0), (0xF0, 0xF5))}
    return re.compile(f"{of[0xC2]}{of[0x80]}|{of[0xE0]}{of[0x80]}{{2}}|{of[0xF0]}{of[0x80]}{{3}}")


SHOWN_UTF8 = {name: _utf8_as(ENCODERS[name]) for name in WRONG_FOR_UTF8}
LETTERS_OF = {lang: frozenset(x) for lang, x in ALPHABETS.items()}


def _beyond_ascii(low: str) -> list[str]:
    """Letters and signs; quotes, dashes and currency signs belong to all languages."""
    return [c for c in low if c > "\x7f" and c not in "‘’“”„«»–—…¿¡£€"]


@lru_cache(maxsize=1 << 12)
def _suited(letters: frozenset[str]) -> tuple[str, ...]:
    """Languages whose alphabet has most of these letters."""
    lacking = {lang: len(letters - own) for lang, own in LETTERS_OF.items()}
    least = min(lacking.values())
    return tuple(lang for lang, n in lacking.items() if n == least and (letters or lang == "en")) if least < len(letters) or not letters else ("en",)


@lru_cache(maxsize=1 << 18)
def description_length(word: str) -> float:
    """Bytes that a word takes in the language that suits it best."""
    low = word.lower()
    data, letters = low.encode("utf-8", "surrogatepass") + b" ", _beyond_ascii(low)
    languages = _languages()
    return min(languages[lang].length(data) + ALIEN_COST * sum(c not in LETTERS_OF[lang] for c in letters) for lang in _suited(frozenset(letters)))


@lru_cache(maxsize=1 << 14)
def aliens(words: tuple[str, ...]) -> dict[str, int]:
    """By language, how many letters and signs of the words it doesn't have."""
    counts = Counter(c for w in words if not w.isascii() for c in _beyond_ascii(w.lower()))
    return {lang: sum(n for c, n in counts.items() if c not in own) for lang, own in LETTERS_OF.items()}


@lru_cache(maxsize=1 << 14)
def joint_length(words: tuple[str, ...]) -> int:
    """Bytes that words take together, in the one language that suits all of them best; languages that lack many more of the letters than another are left out."""
    data = (" ".join(words) + " ").lower().encode("utf-8", "surrogatepass")
    alien = aliens(words)
    near = min(alien.values()) + 2
    return min(_languages()[lang].whole(data) + ALIEN_COST * n for lang, n in alien.items() if n <= near)


def _mean_length(word: str) -> float:
    return (description_length(word) + len(word.encode("utf-8", "surrogatepass"))) / 2


#: Texts without one of these hold no word that :func:`repair_word` changes.
SUSPECT = re.compile(
    "[Â-ô][\x80-\xbf€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸĽľŁłĄąŞşŻżĹĺŤťŹźŚś]|[√¬ƒ≈‚–—œŒ∆«»…ÀÃÕ┬├╨╤╬╧Γ][^\x00-\x7f]|[В-ЯВв][Ђ-ЏЁёђ-џЎўҐґІіЈјЅѕ\xa0-\xbf‚„…†‡€‰‹‘’“”•–—™›№\x98]"
)
SCRIPTS = re.compile("([A-Za-zÀ-ɏ])|([Ͱ-Ͽ])|([Ѐ-ԯ])|([　-鿿가-힣])|([֐-ۿ])|([ऀ-๿])")


def _one_script(text: str) -> bool:
    """Whether the letters of a word belong together; a lone East Asian character counts as chance."""
    groups = [m.lastindex for m in SCRIPTS.finditer(text)]
    return len(set(groups)) < 2 and groups != [4]


def _scripts(text: str) -> set[int]:
    return {m.lastindex for m in SCRIPTS.finditer(text)}


def _undo_utf8(text: str, encoding: str) -> tuple[str, int]:
    """``text`` with its runs of UTF-8 under ``encoding`` reread, and how many letters beyond ASCII the step leaves unexplained."""
    table = ENCODERS[encoding]
    out, run = [], []
    left = 0

    def close() -> None:
        nonlocal left
        data, last = bytes(table[c] for c in run), 0
        for m in UTF8_RUN.finditer(data):
            try:
                char = m.group().decode("utf-8")
            except UnicodeDecodeError:
                continue
            if not PLAUSIBLE.match(char) and char not in BETWEEN:
                continue
            left += sum(c.isalpha() for c in run[last : m.start()])
            out.extend(run[last : m.start()])
            out.append(char)
            last = m.end()
        left += sum(c.isalpha() for c in run[last:])
        out.extend(run[last:])
        run.clear()

    for c in text:
        if c in table:
            run.append(c)
        else:
            if run:
                close()
            left += c > "\x7f" and c.isalpha()
            out.append(c)
    if run:
        close()
    return "".join(out), left


def _reread(text: str, wrong: str, meant: str) -> str | None:
    table = ENCODERS[wrong]
    try:
        return bytes(ord(c) if c < "\x80" else table[c] for c in text).decode(meant)
    except (KeyError, UnicodeDecodeError):
        return None


#: Two characters beyond ASCII side by side: without them nothing is UTF-8.
ADJACENT = re.compile("[^\x00-\x7f]{2}")


@lru_cache(maxsize=1 << 17)
def repair_word(word: str) -> str:
    """The decoding of a word by chains that undo UTF-8 (also behind a single-byte step) with the shortest description, or the word."""
    if not ADJACENT.search(word):
        return word
    letters = any(c > "\x7f" and c.isalpha() for c in word)
    middles = {_reread(word, *pair) for pair in SINGLE_BYTE} - {None, word} if letters else set()
    best, least = word, None
    tried = {word}
    for start in (word, *sorted(middles)):
        frontier = [(start, CHAIN_COST if start in middles else 0)]
        while frontier:  # every step makes the text shorter
            grown = []
            for text, cost in frontier:
                for encoding in WRONG_FOR_UTF8:
                    if not SHOWN_UTF8[encoding].search(text):
                        continue
                    new, left = _undo_utf8(text, encoding)
                    if new == text or new in tried or (left and text in middles):
                        continue  # behind a single-byte step the whole word must be UTF-8
                    tried.add(new)
                    # letters of one script that become letters of another may be a word already
                    left += text.isalpha() and len(_scripts(text)) == 1 and not _scripts(new) <= _scripts(text)
                    so_far = cost + STEP_COST + LEFT_COST * left
                    grown.append((new, so_far))
                    if _one_script(new):
                        if least is None:
                            least = _mean_length(word)
                        if (length := _mean_length(new) + so_far) < least:
                            best, least = new, length
            frontier = grown
    return best


@lru_cache(maxsize=1 << 17)
def gains(word: str) -> tuple[tuple[int, float, str], ...]:
    """``(chain, bytes saved, decoding)`` of every single-byte chain that can be undone in a word."""
    out = []
    for k, pair in enumerate(SINGLE_BYTE):
        new = _reread(word, *pair)
        if new is not None and new != word and not LOST.search(new) and _one_script(new):
            out.append((k, description_length(word) - description_length(new), new))
    return tuple(out)


def explain(words: list[str]) -> tuple[tuple[str, str], frozenset[str]] | None:
    """The single-byte chain, and the words it holds for, that saves most over all words that it can carry, or over a stretch of them, if that is more than it costs.

    Word by word the lengths are rough: they choose the stretch, and rule out chains that lengthen nearly every word.
    """
    by_chain: dict[int, list[tuple[str, float, str]]] = {}
    for w in words:
        for k, g, new in gains(w):
            by_chain.setdefault(k, []).append((w, g, new))
    best, chain = float(CHAIN_COST), None
    for k, carried in by_chain.items():
        tried = []
        if sum(x[1] for x in carried) > -ROUGH * len(carried):
            tried.append((0, len(carried), 0))
        total, start, most, span = 0.0, 0, 0.0, (0, 0)
        for i, (_, g, _) in enumerate(carried):
            if total <= 0:
                total, start = 0.0, i
            total += g
            if total > most:
                most, span = total, (start, i + 1)
        if most > CHAIN_COST and span != (0, len(carried)):
            tried.append((*span, STRETCH_COST))
        for a, b, cost in tried:
            old, new = tuple(x[0] for x in carried[a:b]), tuple(x[2] for x in carried[a:b])
            if min(aliens(new).values()) > min(aliens(old).values()):
                continue  # more letters that no language has
            saved = joint_length(old) - joint_length(new) - cost
            if saved > best:
                best, chain = saved, (SINGLE_BYTE[k], frozenset(old))
    return chain


def repair(text: str | None) -> tuple[str | None, bool]:
    """The restored text, and whether any of it was damaged."""
    if not text or text.isascii():
        return text, False
    damaged = bool(LOST.search(text))
    out, last, others = [], 0, {}
    for m in TOKEN.finditer(text):
        word = m.group()
        new = repair_word(word)
        if new != word:
            damaged = True
            out.append(text[last : m.start()])
            out.append(new)
            last = m.end()
        elif UNUSUAL.search(word):
            others[word] = None
    if out:
        out.append(text[last:])
        text = "".join(out)
    chain = explain(list(others)) if others else None
    return (_redecode(text, *chain), True) if chain else (text, damaged)


def _redecode(text: str, chain: tuple[str, str], sure: frozenset[str]) -> str:
    """The words that the chain holds for, and others that it can carry and doesn't lengthen much."""

    def word(m: re.Match) -> str:
        old = m.group()
        new = _reread(old, *chain)
        return new if old in sure or new is not None and not LOST.search(new) and _one_script(new) and description_length(new) <= description_length(old) + 1 else old

    return TOKEN.sub(word, text)


def damaged_records(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key)`` of the records whose ``text`` holds wrongly decoded characters."""
    kind = df.schema[key].dataType
    return scan(spread(df.select(key, text), key), [key, text], T.StructType([T.StructField(key, kind)]), lambda k, t: ((k,),) if repair(t)[1] else ())


def restore(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, restored, damaged)`` for every row; null stays null."""
    schema = rows_schema(**{key: df.schema[key].dataType, "restored": T.StringType(), "damaged": T.BooleanType()})
    return scan(spread(df.select(key, text), key), [key, text], schema, lambda k, t: ((k, *repair(t)),))
