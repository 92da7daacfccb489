"""Problem 2: keep only the lines an email's sender wrote for this message.

Method: multilingual line rules over a small state machine.  Rules know quote prefixes, attribution lines (also
wrapped ones), forwarded headers, closing phrases, signature dividers and blocks, device taglines and notices.
Answers between quoted lines stay.  Lines are matched in their repaired, unified form (wrong decoding and
look-alike characters would hide them), while line numbers and kept text refer to the stored text.

Defined results: null and blank texts have no lines to drop; CRLF counts as a line end; a text that is nothing
but a forwarded message keeps no line; texts of any length are processed whole.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from graylark.llm.batches import rows_schema, scan, spread
from graylark.llm.confusable import normalize
from graylark.llm.mojibake import repair

QUOTE = re.compile(r"\s*[>|]")
DATE = r"(?:\d{4}-\d\d-\d\d|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2} [^\W\d_]{3,9}\.?,? \d{4}|[^\W\d_]{3,9}\.? \d{1,2}, \d{4}|\d{1,2}/\d{1,2}/\d{2,4})"
#: Attribution lines as a whole.
ATTRIBUTION = re.compile(
    rf"(?:On\s.+\swrote:|.+\swrote on\s.+:|(?:Am\s.+\s)?schrieb\s.+:|.+\sschrieb am\s.+:|Le\s.+\sa\s+\S{{0,6}}crit\s?:"
    rf"|El\s.+\sescribi\S{{1,9}}:|Em\s.+\sescreveu:|W dniu\s.+\snapisa\S{{1,9}}:|.+\starihinde\s.+:|{DATE}.+:|.+\S@\S.*:)$",
    re.I,
)
SEPARATOR = re.compile(r"\s*(?:-{3,}\s*[^\W\d_][^-]+-{3,}|Begin forwarded message:|_{16,})\s*$", re.I)
HEADER_FIRST = re.compile(r"\s*\*?(?:From|Von|De|Od|От|Kimden)\s?:\*?\s", re.I)
HEADER_NEXT = re.compile(r"\s*\*?(?:Sent|Date|To|Cc|Subject|Gesendet|Datum|An|Betreff|Envoy\S{1,6}|À|A|Objet|Date|Enviad[oa]|Fecha|Para|Asunto|Assunto|Data|Отправлено|Дата|Кому|Тема|Wys\S{1,6}no|Do|Temat|G\S{1,6}nderildi|Tarih|Kime|Konu|\S{1,4})\s?:\*?(?:\s|$)", re.I)
CLOSINGS = (
    "kind regards", "best regards", "regards", "warm regards", "best wishes", "best", "sincerely", "sincerely yours", "yours sincerely", "yours faithfully", "yours truly", "many thanks", "thanks", "thank you", "thanks again",
    "cheers", "br", "kr", "mit freundlichen grüßen", "mit freundlichen grüssen", "freundliche grüße", "viele grüße", "beste grüße", "herzliche grüße", "liebe grüße", "mfg", "vg", "lg", "schöne grüße", "cordialement", "bien cordialement",
    "bien à vous", "salutations", "meilleures salutations", "amicalement", "sincères salutations", "un saludo", "saludos", "saludos cordiales", "atentamente", "un cordial saludo", "muchas gracias", "atenciosamente", "abraços", "abraço", "cumprimentos",
    "com os melhores cumprimentos", "obrigado", "с уважением", "всего доброго", "с наилучшими пожеланиями", "спасибо", "z poważaniem", "pozdrawiam", "serdecznie pozdrawiam", "z pozdrowieniami", "saygılarımla", "iyi çalışmalar", "teşekkürler", "sevgiler", "saygılar",
)
CLOSING = re.compile(rf"\s*(?:{'|'.join(sorted(map(re.escape, CLOSINGS), key=len, reverse=True))})[,.!]?(?: [^\W\d_A-Z]{{2,}}){{0,2}}\s*$", re.I)
TAGLINE = re.compile(r"\s*(?:Sent (?:from|via|with) |Get (?:Outlook|the .+ app)\b|Von mein\S+ .+ gesendet|Gesendet (?:von|mit) |Envoy\S{1,6} (?:depuis|de) mon |Enviado (?:desde mi|do meu|de mi) |Отправлено (?:с|из) |Wys\S{1,6}n[eo] z |Inviato da |.*(?:telefonumdan|mobilden) g\S{1,6}nderildi)", re.I)
#: Legal, confidentiality and print notices: how their first clause begins, and what follows in it, in this order.
NOTICES = tuple(
    tuple(re.compile(part, re.I) for part in parts)
    for parts in (
        (r"\W*(?:this|these|the (?:content|information)s?(?: of| in| contained in)? this)\b", r"\b(?:e-?mails?|messages?|communication|transmission)", r"confidential|privileged|intended"),
        (r"\W*(?:diese|die) ", r"nachricht|e-?mail", r"vertraulich"), (r"\W*est[ea] ", r"mensaje|correo|mensagem|e-?mail", r"confidenci"), (r"\W*ce ", r"message|courriel|mail", r"confidentiel"), (r"\W*это ", r"сообщение|письмо", r"конфиденциальн"),
        (r"\W*", r"wiadomo\S{1,6}|e-?mail", r"pouf"), (r"\W*bu ", r"ileti|e-?posta|mesaj", r"gizli"), (r"\W*(?:disclaimer|legal notice|haftungsausschluss|confidentiality(?: notice)?)\b", r":"),
        (r"", r"accepts no ", r"liability"), (r"", r"please ", r"consider ", r"the environment"), (r"", r"registered office of"),
    )
)
CLAUSE = re.compile(r"[^.!?]*")


def _notice(text: str) -> bool:
    """Whether a text begins with a notice; one pass for each kind, whatever its length."""
    clause = CLAUSE.match(text).group()
    for start, *parts in NOTICES:
        at = start.match(clause)
        for part in parts:
            at = at and part.search(clause, at.end())
        if at:
            return True
    return False


NAME_WORD = r"(?:[^\W\d_a-zà-öø-ÿа-яё][^\W\d_]*(?:[-’'][^\W\d_]+)?|[^\W\d_]\.)"
NAME = re.compile(rf"\s*(?:{NAME_WORD},? ){{0,3}}{NAME_WORD}\s*$")
CONTACT = re.compile(
    r"\s*(?:(?:Phone|Tel|Mobile?|Cell|Fax|T|M|P|F|Ph|Тел|Telefon|Móvil|Handy)\b[.:]*\s*[+(\d]|\+?[\d(][\d ()./-]{6,}|\S+@\S+\s*$|<\S+@\S+>\s*$|(?:https?://)?www\.\S+\s*$|https?://\S+\s*$|.{2,60} \| .{2,60}$|P\.? ?O\.? Box|Postfach|Apartado"
    r"|\d{1,5}[a-z]? .{3,60}(?:Street|Avenue|Road|Lane|Drive|Blvd|Boulevard|Crescent|St|Ave|Rd|Ln|Dr|Ct|Way|Court|Square|Place|Terrace|Close)\b|\d{1,5},? (?:rue|bd|boulevard|avenue|av\.|place|allée|quai|chemin)|[^\W\d_]\S*(?:straße|strasse|weg|gasse|allee|platz|ring|damm)\b.{0,60}\d|(?:Plaza|Calle|Avda|C/|Av\.|Paseo|Rua|Avenida|Travessa|Praça|ul\.|al\.|ул\.|пр\.|Via|Cad\.|Sok\.)\W.{2,60})",
    re.I,
)


def _divider(line: str) -> bool:
    s = line.strip()
    return bool(s) and not any(c.isalnum() for c in s) and (len(s) > 1 or s in "—–-_*")


def foreign_lines(text: str | None) -> list[int]:
    """Numbers (from 1) of the non-blank lines that the sender didn't newly write."""
    if not text or not text.strip():
        return []
    if not text.isascii():
        shown = normalize(repair(text)[0])[0]
        text = shown if shown.count("\n") == text.count("\n") else text
    lines = [x.rstrip() for x in text.split("\n")]
    n = len(lines)
    foreign = [False] * n
    filled = [bool(x.strip()) for x in lines]

    ends = [n] * (n + 1)  # the blank line behind each line
    for i in range(n - 1, -1, -1):
        ends[i] = ends[i + 1] if filled[i] else i
    block_end = ends.__getitem__

    def skip_blank(i: int) -> int:
        while i < n and not filled[i]:
            i += 1
        return i

    def mark(a: int, b: int) -> None:
        for i in range(a, b):
            foreign[i] = filled[i]

    quoted = [bool(QUOTE.match(x)) for x in lines]
    for i in range(n):
        if quoted[i]:
            foreign[i] = True
            if i and not quoted[i - 1]:
                j = i - 1
                while j >= 0 and not filled[j] and i - j < 3:
                    j -= 1
                if j >= 0 and filled[j] and not foreign[j] and (a := _attribution(lines, filled, quoted, j)) is not None:
                    mark(a, j + 1)
    i = 0
    wrote = False  # whether the sender's own prose has been seen
    signed = False
    while i < n:
        line = lines[i]
        if not filled[i] or foreign[i]:
            i += 1
            continue
        head = _header(lines, filled, i)
        if head is not None:
            if wrote:
                mark(i, n)
                break
            mark(i, head)
            i = _forwarded_body(lines, filled, quoted, skip_blank(head), n)
            mark(head, i)
            continue
        if TAGLINE.match(line):
            foreign[i] = signed = True
            i += 1
            continue
        if line[:1].isalpha() or line[:1] in "*-_(" or not line[:1].isascii():
            end = block_end(i)
            if _notice(" ".join(lines[i : min(end, i + 3)])) and not wrote_prose(line):
                mark(i, end)
                i = end
                continue
        if CLOSING.match(line):
            end = _signature_end(lines, filled, quoted, i + 1, n, True)
            mark(i, end)
            signed = True
            i = max(end, i + 1)
            continue
        if _divider(line):
            nxt = skip_blank(i + 1)
            if nxt < n and (NAME.match(lines[nxt]) or CONTACT.match(lines[nxt])) and nxt - i <= 2:
                end = _signature_end(lines, filled, quoted, nxt, n, True)
                mark(i, max(end, i + 1))
                signed = True
                i = max(end, i + 1)
                continue
        if NAME.match(line) and (i == 0 or not filled[i - 1] or signed) and (wrote or signed):
            end = block_end(i)
            if all(CONTACT.match(x) or NAME.match(x) or _divider(x) for x in lines[i + 1 : end]):
                mark(i, end)
                signed = True
                i = end
                continue
        if signed and CONTACT.match(line) and (i == 0 or not filled[i - 1] or foreign[i - 1]):
            foreign[i] = True
            i += 1
            continue
        if _attributed_block(lines, filled, i) and (end := block_end(i)) is not None:
            if wrote or skip_blank(end) >= n:
                mark(i, n)
                break
            mark(i, end)
            i = _forwarded_body(lines, filled, quoted, skip_blank(end), n)
            mark(end, i)
            continue
        if not GREETING.match(line) and not TITLE.match(line):
            wrote = True
            signed = False
        i += 1
    return [i + 1 for i in range(n) if foreign[i]]


#: A longer line is prose, not a greeting; a longer line in a signature is prose, not a role or a firm.
GREETING_WIDTH, ROLE_WIDTH = 46, 60
TITLE = re.compile(r"[^\W\d_]{3,} / \S{4,}(?: [^\W\d_]{2,}){0,2}$")
GREETING = re.compile(rf".{{2,{GREETING_WIDTH}}}(?:[,:!]| -)$")


def wrote_prose(line: str) -> bool:
    return bool(GREETING.match(line)) and len(line.split()) < 5


def _attribution(lines: list[str], filled: list[bool], quoted: list[bool], j: int) -> int | None:
    """First line of the attribution that ends at line ``j``."""
    if not lines[j].rstrip().endswith(":"):
        return None
    k = 0
    while True:
        k += 1
        a = j - k + 1
        if a < 0 or not filled[a] or quoted[a]:
            return None
        if k > WRAPPED and not DATED.match(" ".join(x.strip() for x in lines[a : a + 2])):
            continue
        if ATTRIBUTION.match(" ".join(x.strip() for x in lines[a : j + 1])):
            # a line more belongs to it where that line opens the attribution
            while a and filled[a - 1] and not quoted[a - 1] and OPENS.match(lines[a - 1]) and not OPENS.match(lines[a]):
                a -= 1
            if not OPENS.match(lines[a]) and a and filled[a - 1] and not quoted[a - 1] and NAME.match(lines[a - 1].rstrip(",")):
                a -= 1
                if a and filled[a - 1] and OPENS.match(lines[a - 1]):
                    a -= 1
            return a


#: Lines of an attribution that needn't begin with one of its opening words and a date.
WRAPPED = 4
DATED = re.compile(rf"(?:(?:On|Am|Le|El|Em|W dniu) )?{DATE}")
OPENS = re.compile(rf"\s*(?:On\b|Am\b|Le\b|El\b|Em\b|W dniu\b|{DATE})", re.I)
#: Attributions that need no quoted line behind them to be known.
SURE = re.compile(rf"(?:On {DATE}.* wrote:|Am {DATE}.* schrieb .+:|Le {DATE}.*crit\s?:|El {DATE}.* escribi\S{{1,9}}:|Em {DATE}.* escreveu:|W dniu {DATE}.*:|.+ wrote on {DATE}:|.+ schrieb am {DATE}:|{DATE} \d\d:\d\d,? .*@.*:|.+{DATE} tarihinde .+:)$")


def _attributed_block(lines: list[str], filled: list[bool], i: int) -> bool:
    for k in range(i, len(lines)):
        if not filled[k] or k - i == WRAPPED and not DATED.match(" ".join(x.strip() for x in lines[i : i + 2])):
            return False
        if lines[k].endswith(":"):
            return bool(SURE.match(" ".join(x.strip() for x in lines[i : k + 1])))
    return False


def _header(lines: list[str], filled: list[bool], i: int) -> int | None:
    """End of the forwarded header that starts at line ``i``."""
    n = len(lines)
    j = i
    if SEPARATOR.match(lines[i]):
        j += 1
        while j < n and not filled[j]:
            j += 1
        if j >= n:
            return None
        if not HEADER_FIRST.match(lines[j]):
            return None if lines[i].strip().startswith("_") else i + 1
    if not HEADER_FIRST.match(lines[j]):
        return None
    end, found = j, 0
    while end < n and filled[end]:
        found += bool(HEADER_NEXT.match(lines[end])) if end > j else 0
        end += 1
    if found < 2:
        return None
    # the header stops after its last field
    last = max(k for k in range(j, end) if k == j or HEADER_NEXT.match(lines[k]))
    return end if end - last <= 2 else last + 1


def _forwarded_body(lines: list[str], filled: list[bool], quoted: list[bool], i: int, n: int) -> int:
    """End of the message behind a header: its text, then its own closing, signature and notices."""
    first = True
    while i < n:
        if not filled[i]:
            i += 1
            continue
        end = i
        while end < n and filled[end]:
            end += 1
        line = lines[i]
        if first:
            first = False
            for k in range(i, end):
                if CLOSING.match(lines[k]):
                    end = _signature_end(lines, filled, quoted, k + 1, n, True)
                    break
        elif quoted[i] or line[:1] in " \t":
            pass
        elif CLOSING.match(line) or _divider(line):
            end = max(_signature_end(lines, filled, quoted, i + 1, n, True), i + 1)
        elif TAGLINE.match(line) or _notice(line):
            pass
        elif NAME.match(line) and all(CONTACT.match(x) or NAME.match(x) or _divider(x) for x in lines[i + 1 : end]):
            pass
        else:
            return i
        i = end
    return n


def _signature_end(lines: list[str], filled: list[bool], quoted: list[bool], i: int, n: int, named: bool) -> int:
    """End of the signature lines from ``i`` on: names, then contact lines, dividers and blocks of these."""
    end = i
    blanks = 0
    seen_name = not named
    while i < n:
        if not filled[i]:
            blanks += 1
            if blanks > 1:
                break
            i += 1
            continue
        line = lines[i].strip()
        if quoted[i] or SEPARATOR.match(line) and _header(lines, filled, i) is not None or HEADER_FIRST.match(line):
            break
        plain = NAME.match(line) or CONTACT.match(line) or _divider(line)
        if not plain and not (blanks == 0 and end == i and seen_name and len(line) < ROLE_WIDTH and not line.endswith((".", "?", "!", ",", ":")) and i and not CLOSING.match(lines[i - 1])):
            break
        seen_name = True
        blanks = 0
        i += 1
        end = i
    return end


def foreign_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, line_no)`` of every non-blank line the sender didn't newly write."""
    schema = rows_schema(**{key: df.schema[key].dataType, "line_no": T.LongType()})
    return scan(spread(df.select(key, text), key), [key, text], schema, lambda k, t: [(k, i) for i in foreign_lines(t)])


def own_text(text: str | None) -> str | None:
    """The text without foreign lines; runs of blank lines shrink to one, ends are trimmed."""
    if text is None:
        return None
    drop = set(foreign_lines(text))
    kept = [x for i, x in enumerate(text.split("\n"), 1) if i not in drop]
    return re.sub(r"(?:\r?\n[ \t\r]*){3,}", "\n\n", "\n".join(kept)).strip()


def own_texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, own_text)`` for every row; null stays null."""
    schema = rows_schema(**{key: df.schema[key].dataType, "own_text": T.StringType()})
    return scan(spread(df.select(key, text), key), [key, text], schema, lambda k, t: ((k, own_text(t)),))
