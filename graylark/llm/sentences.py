"""Problem 9: sentence units for documents in all languages and scripts.

Method: the standard sentence-break rules over the Sentence_Break property of characters (STerm, ATerm, Close, Lower,
SContinue, as the ``regex`` package has them, so every script's terminators count), tailored in four ways: abbreviations
suppress a break by language; quoted speech is kept whole; a terminator of a script that writes blanks needs one behind it
(addresses and file names); Thai, which has no terminators, is divided at its gaps.  The language is that of the sentence's
own words, so foreign passages and wrong labels do no harm; where these don't tell, the words around it, the document's label
and its words count, and abbreviations of other languages too unless they are ordinary words somewhere.  Before that, line ends are sorted into hard wraps, which are blanks, and ends of units such as greetings,
headings and list items.

A line end counts as a hard wrap if the next line's first word wouldn't have fitted into the width of the paragraph.

Defined results: null and blank texts have no unit; offsets count code points of the stored text, ends are
exclusive; a text without any terminator is one unit for each of its unit lines; texts of any length are processed whole.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from graylark.llm.batches import rows_schema, scan, spread


def _with(prop: str) -> str:
    """Characters that have a property, up to the last plane that holds terminators."""
    return "".join(regex.findall(f"\\p{{{prop}}}", "".join(map(chr, [*range(0xD800), *range(0xE000, 0x20000)]))))


TERMINATORS = _with("Sentence_Break=STerm") + _with("Sentence_Break=ATerm")
#: Terminators that need no blank behind them: wide ones, and those of scripts without blanks between words.
UNSPACED = frozenset(c for c in TERMINATORS if unicodedata.east_asian_width(c) in "WFH" or regex.match(r"[\p{Script=Khmer}\p{Script=Myanmar}\p{Script=Tai_Tham}\p{Script=Lao}\p{Script=Javanese}]", c))
#: Closing marks of a sentence: those of the property that don't open.
CLOSERS = frozenset(c for c in _with("Sentence_Break=Close") if c in "\"'" or unicodedata.category(c) in ("Pe", "Pf"))
#: What continues a sentence after a terminator; a dash may open the next one.
CONTINUES = frozenset(c for c in _with("Sentence_Break=SContinue") if unicodedata.category(c) != "Pd") | frozenset(")]}»”%…&/=+")
CLOSING_MARKS = "".join(sorted(CLOSERS))


def _one_of(chars: str) -> str:
    """A class of characters; those beyond the first plane apart, as one class of all would be searched one by one."""
    low, high = (re.escape("".join(c for c in chars if (c > "\uffff") == beyond)) for beyond in (False, True))
    return f"(?:[{low}]|(?=[\U00010000-\U0010ffff])[{high}])" if high else f"[{low}]"


CANDIDATE = re.compile(f"{_one_of(TERMINATORS + ';;')}{_one_of(TERMINATORS + '…')}*{_one_of(CLOSING_MARKS)}*")
SPANS = re.compile('“[^”“„]*”|«[^»«]*»|„[^“”„]*[“”]|「[^」]*」|『[^』]*』|"[^"]*"|（[^（）]*）|\\([^()]*\\)|‹[^›]*›')
BULLET = re.compile("[ \t]*(?:[•·▪◦‣●○■*–—-]|\\(?\\d{1,2}[.)](?=[ \t]+[^\\W\\d_]))[ \t]+")
PARAGRAPH = re.compile("[^\n]*\\S[^\n]*(?:\n[^\n]*\\S[^\n]*)*")
THAI = re.compile("[฀-๿]")
#: Thai writes no terminators: wide gaps divide sentences, and blanks that no foreign word or number asks for.
THAI_GAP = re.compile("(?<=[฀-๿A-Za-z0-9.])[ \t]{2,}|(?<=[฀-๿])[ \t\n]+(?=[฀-๿])|(?<=[฀-๿]\\.)[ \t\n]+(?=[฀-๿])|(?<=\\d [KMG]B)[ \t\n]+(?=[฀-๿])")
GREEK = re.compile("[Ͱ-Ͽἀ-῿]")
WORD_BEFORE = re.compile("[^\\s\"'“”‘’«»„()（）\\[\\]/]+$")
KANA = re.compile("[ぁ-ゟ]")
#: A word before a terminator that is no abbreviation even where a small letter follows (lower-cased passages).
SOLID = re.compile("(?:[^\\W\\d_]{4,}|\\w*\\d[\\w./:-]*|[/=][\\w/.-]+)$")
MONTHS = frozenset("januar februar märz april mai juni juli august september oktober november dezember jänner janvier février mars avril juin juillet août septembre octobre novembre décembre january february march may june july october december".split())
#: Abbreviations by language, without their full stop.  NAMED stand before a name, INNER before whatever goes on, NUMBERED
#: before a number or a code only, FINAL may end a sentence: a capital behind them begins a new one.
NAMED = {
    "en": "mr mrs ms dr prof rev gen col sgt capt lt hon st mt messrs", "de": "dr prof hr fr hrn dipl ing st", "fr": "m mm mme mlle me dr pr st ste", "es": "sr sra srta sres d dña dr dra", "pt": "sr sra srs srta dr dra exmo exma prof",
    "ru": "им проф акад тов ул д-р", "uk": "ім проф вул", "el": "κ κα κος", "ar": "د أ م", "hi": "डॉ श्री सुश्री प्रो", "pl": "dr prof mgr inż ul al pl św im", "tr": "dr prof doç sn", "it": "sig dott ing avv", "nl": "dhr mevr dr",
}
INNER = {
    "en": "e.g i.e cf vs v approx viz resp", "de": "z b d h u a z.b d.h u.a bzw ggf evtl inkl exkl vgl ca sog", "fr": "p ex p.ex env cf", "es": "p ej p.ej aprox", "pt": "p ex p.ex aprox", "ru": "т е т.е напр см ср ок", "uk": "т е т.е напр див",
    "el": "π χ π.χ δηλ βλ", "pl": "np tzn tj m.in", "tr": "örn bkz", "it": "es p.es", "nl": "bijv d.w.z",
}
NUMBERED = {
    "en": "no nos fig figs p pp vol ch sec art eq ref env", "de": "nr abs art bd s kap tel", "fr": "no art réf éd fig vol", "es": "núm pág págs art av avda cap tít", "pt": "núm pág págs art av cap", "ru": "стр рис табл гл", "uk": "стор рис табл",
    "el": "αρ σελ", "ar": "ص", "hi": "नं", "pl": "nr str art poz", "tr": "no s", "it": "n pag art", "nl": "nr blz art",
}
FINAL = {
    "en": "etc inc ltd co corp llc plc bros jr sr al dept est a.m p.m u.s u.k u.n", "de": "usw u.s.w etc gmbh ag str geb", "fr": "etc s.a cie", "es": "etc s.a s.l cía ud uds", "pt": "etc ltda s.a cia", "ru": "др д пр г гг в вв руб коп млн млрд тыс", "uk": "ін р рр грн млн",
    "el": "κτλ κ.λπ", "th": "น", "he": "ד", "pl": "itd itp r", "tr": "vb vs yy", "it": "ecc", "nl": "enz",
}
#: Abbreviations that are ordinary words of some language.
ORDINARY = frozenset("me art no nos est al col gen rev hon fig sec es cap co st ref sun mar fr abs bd s m".split())
#: Frequent small words by language: they tell the language of a passage, and, capitalised, the start of a sentence.
COMMON = {
    "en": "the a an no of to in is was are and or for with at on it this that he she we they you i my our your his her not from by as then there if but so has have will what when please", "de": "der die das den dem des ein eine und oder ist war sind nicht mit für von zu im in auf es er sie wir ihr ich wer was wenn dann aber hat haben wird bitte ihre siehe",
    "fr": "le la les un une des du de et ou est sont dans pour avec sur il elle nous vous ils je ce cette qui que pas votre a été au aux si mais puis", "es": "el la los las un una de del y o es son en para con por que no se su lo usted él ella nosotros quién si pero luego al ha está",
    "pt": "o a os as um uma de do da dos das e ou é são em no na para com por que não se seu sua você ele ela nós quem se mas então ao foi está", "ru": "и в на не что с по к из за от для это он она мы вы они как но кто если был была до у о же", "uk": "і в на не що з до та це він вона ми ви вони як але хто якщо був у й від для",
    "el": "ο η το οι τα του της των και να με σε από για είναι στο στην που δεν μην ποιος", "ar": "في من على إلى عن هذا هذه التي الذي لا ما هل من", "hi": "के का की में है से को और पर ने यह वह कि नहीं", "pl": "i w na z do nie się że to jest jak o od po dla są ale kto czy", "tr": "ve bir bu da de için ile çok ne mi ama daha olan gibi kim",
    "it": "il lo la gli le un una di del e o è sono in per con che non si su lei lui noi chi ma", "nl": "de het een van en of is in op voor met dat niet te zijn wij hij zij wie maar", "he": "של את על לא הוא היא זה עם", "th": "ที่ และ ใน ของ",
}
KINDS = ((NAMED, 1), (INNER, 2), (NUMBERED, 3), (FINAL, 4))
ABBREVIATIONS = {lang: {w: kind for table, kind in reversed(KINDS) for w in table.get(lang, "").split()} for lang in COMMON}
ANY_ABBREVIATION = frozenset(w for known in ABBREVIATIONS.values() for w in known)
COMMON_WORDS = {lang: frozenset(ws.split()) for lang, ws in COMMON.items()}
LANGUAGES_OF: dict[str, list[str]] = {w: [lang for lang, ws in COMMON_WORDS.items() if w in ws] for ws in COMMON_WORDS.values() for w in ws}
LETTERS = re.compile(r"(?<!\w)[^\W\d_]+(?!\w)")
#: Letters with a full stop each.
DOTTED = re.compile(r"(?:[^\W\d_]\.){2,}")
#: Characters around an abbreviation that tell its language.
NEAR = 160
OPENERS = "\"'“‘«‹„‚([{¿¡「『（【《〈—–- "


def _spoken(text: str, lead: int = 1) -> str | None:
    """The language whose frequent words a text has most of; None without two of them or without ``lead`` more than any other."""
    votes: dict[str, int] = {}
    for w in LETTERS.findall(text.lower()):
        for lang in LANGUAGES_OF.get(w, ()):
            votes[lang] = votes.get(lang, 0) + 1
    ranked = sorted(votes.items(), key=lambda x: -x[1])[:2]
    return ranked[0][0] if ranked and ranked[0][1] > 1 and (len(ranked) < 2 or ranked[0][1] - ranked[1][1] >= lead) else None


class Languages:
    """The language at a place of a text: that of the sentence, else of the words around it, else the label, else that of the whole text."""

    def __init__(self, text: str, label: str | None) -> None:
        self.text = text
        label = (label or "").strip().lower()[:2]
        self.label = label if label in ABBREVIATIONS else None
        self.whole: str | None = None

    def at(self, start: int, place: int) -> tuple[str | None, bool]:
        """The language of the sentence that began at ``start``, and whether its own words tell it."""
        own = _spoken(self.text[max(start, place - 2 * NEAR) : place + NEAR // 4], 2)
        if own:
            return own, True
        near = _spoken(self.text[max(0, place - NEAR) : place + NEAR // 2]) or self.label
        if near is None and self.whole is None:
            self.whole = _spoken(self.text) or ""
        return near or self.whole or None, False


@lru_cache(maxsize=1 << 16)
def _abbreviation(word: str, lang: str | None, sure: bool) -> int:
    """0: none, else the kind (see ``KINDS``).  ``word`` ends with its full stop."""
    low = word.lower().rstrip(".")
    known = ABBREVIATIONS[lang].get(low, 0) if lang else 0
    initial = len(word) == 2 and word[0].isalpha() and not word[0].islower()
    if not known and not sure and not initial:
        kinds = {t[low] for t in ABBREVIATIONS.values() if low in t}
        known = 3 if 3 in kinds and low in ORDINARY else 0 if low in ORDINARY else min(kinds, default=0)
    if known:
        return known
    if initial:
        return 1
    if DOTTED.fullmatch(word):
        return 4
    return 0


def _goes_on(text: str, word: str, j: int, lang: str | None, sure: bool) -> bool:
    """Whether the sentence goes on behind the abbreviation ``word``; ``j`` is where the next word begins."""
    kind = _abbreviation(word, lang, sure)
    following = text[j : j + 40].split(None, 1)[0]
    if kind == 1:  # no name begins with "The" or "We"
        start = LETTERS.search(following)
        return not (start and lang and len(start.group()) > 1 and start.group().lower() in COMMON_WORDS[lang] and following[0].isupper())
    if kind == 3:
        return following[0] in "#§№°" or any(c.isdigit() for c in following) or re.fullmatch("[IVXLC]+\\W*", following) is not None
    if kind == 4:
        return not (following[0].isupper() or following[0] in OPENERS or not following[0].isascii() or _starts_camel(following))
    return kind == 2


def _starts_sentence(text: str, i: int, end: int) -> bool:
    """Whether what begins at ``i`` looks like the start of a sentence: no small letter, or a small letter inside a name."""
    while i < end and (text[i] in OPENERS or text[i] == "\n"):
        i += 1
    if i >= end:
        return True
    c = text[i]
    if c.islower():
        j = i + 1
        while j < end and text[j].islower():
            j += 1
        return j < end and text[j].isupper() and j - i <= 2
    return c not in CONTINUES


def _breaks(text: str, start: int, end: int, languages: Languages) -> list[int]:
    """Ends of sentences within one unit of running text."""
    piece = text[start:end]
    out = []
    spans = [(m.start(), m.end()) for m in SPANS.finditer(piece)]
    k = 0
    greek = None
    last = 0
    for m in CANDIDATE.finditer(piece):
        a, b = m.start(), m.end()
        if b < last:
            continue
        while k < len(spans) and spans[k][1] <= a:
            k += 1
        if k < len(spans) and spans[k][0] < a:
            if piece[b : spans[k][1] - 1].strip() and b < spans[k][1]:
                continue
            b = max(b, spans[k][1])
        first = m.group()[0]
        if first in ";;":
            if first == ";" and not GREEK.search(piece, out[-1] if out else 0, a):
                continue
        n = len(piece)
        unspaced = first in UNSPACED
        if b < n and not piece[b].isspace():
            if not unspaced:
                continue
            if piece[b - 1] in "」』”’）》" and (KANA.match(piece[b]) or piece[b] in "，、,的"):
                continue
            if piece[b] in "，、,":
                continue
            out.append(b)
            last = b
            continue
        j = b
        while j < n and piece[j].isspace():
            j += 1
        if j >= n:
            break
        marks = m.group().rstrip(CLOSING_MARKS)
        if not unspaced and not _starts_sentence(piece, j, n) and (b > m.start() + len(marks) or not piece[j].islower() or not SOLID.search(piece, max(0, a - 12), a) or len(marks) > 2):
            continue
        if marks == ".":
            word = WORD_BEFORE.search(piece, max(0, a - 30), a + 1)
            token = word.group() if word else "."
            nxt = piece[j : j + 14]
            low = token.lower().rstrip(".")
            if b == a + 1 and (low in ANY_ABBREVIATION or len(low) == 1 and low.isalpha() or DOTTED.fullmatch(token)) and _goes_on(piece, token, j, *languages.at(start + last, start + a)):
                continue
            if token[:-1].isdigit() and len(token) <= 3 and re.match("[^\\W\\d_]+", nxt) and re.match("[^\\W\\d_]+", nxt).group().lower() in MONTHS:
                continue
        out.append(b)
        last = b
    return [start + b for b in out]


def _starts_camel(text: str) -> bool:
    return len(text) > 1 and text[0].islower() and text[1].isupper()


def _units(text: str) -> list[tuple[int, int]]:
    """Runs of text that line ends, bullets and wide gaps divide; hard wraps stay inside."""
    out = []
    for p in PARAGRAPH.finditer(text):
        at = p.start()
        lines = []
        for line in p.group().split("\n"):
            lines.append((at, at + len(line)))
            at += len(line) + 1
        if len(lines) == 1:
            out.append(lines[0])
            continue
        width = max((len(text[a:b].rstrip()) for a, b in lines if " " in text[a:b].strip()), default=0)
        begin = lines[0][0]
        listed = BULLET.match(text[slice(*lines[0])]) is not None
        for (a, b), (c, d) in zip(lines, lines[1:]):
            this, after = text[a:b].rstrip(), text[c:d].strip()
            word = len(after.split(None, 1)[0])
            wrapped = len(this) + 1 + word > width and not THAI.search(this) and not THAI.match(after)
            if BULLET.match(text[c:d]) and (after[0] in "•▪◦‣●○■*" or listed or not wrapped or this[-1:] in ".!?:"):
                wrapped = False
            if not wrapped:
                out.append((begin, b))
                begin = c
        out.append((begin, lines[-1][1]))
    return out


def sentences(text: str | None, lang: str | None = None) -> list[tuple[int, int]]:
    """``(start, end)`` of every sentence unit, in order; ``lang`` is the text's label, which may be wrong."""
    if not text or not text.strip():
        return []
    languages = Languages(text, lang)
    out = []
    for a, b in _units(text):
        bullet = BULLET.match(text, a, b)
        if bullet:
            a = bullet.end()
        cuts = _breaks(text, a, b, languages)
        if THAI.search(text, a, b):
            cuts = sorted({*cuts, *(m.start() for m in THAI_GAP.finditer(text, a, b))})
        for cut in [*cuts, b]:
            s, e = a, cut
            while s < e and text[s].isspace():
                s += 1
            while e > s and text[e - 1].isspace():
                e -= 1
            if s < e:
                out.append((s, e))
            a = cut
    return out


def sentence_rows(df: DataFrame, key: str, text: str, lang: str | None = None) -> DataFrame:
    """``(key, start_char, end_char)`` of every sentence unit; ``lang`` names the column with the texts' labels, if there is one."""
    schema = rows_schema(**{key: df.schema[key].dataType, "start_char": T.LongType(), "end_char": T.LongType()})
    columns = [key, text, *([lang] if lang else [])]
    return scan(spread(df.select(*columns), key), columns, schema, lambda k, t, label=None: [(k, a, b) for a, b in sentences(t, label)])
