"""Problem 5: find personal data in free text and replace it with typed placeholders.

Method: regular expressions propose spans per kind, and every proposal has a score.  The shape gives the base; checksum
validators (Luhn for cards, mod-97 for IBANs, national digits for identity and tax numbers) confirm or weaken it; context words
before and behind the span raise or lower it; spans at or above ``THRESHOLD`` count.  A name is two capitalised words, or a word and
an initial; titles, header labels, an address behind it, attribution lines, closings, and words of contact or speech raise its
score, ordinary words lower it, and a name that is sure once in a text is sure everywhere in it.  A short list of given names
helps where no context does; names outside it need context.  The text is searched in its repaired and unified form, with a map
back to stored offsets.

Beyond the five kinds of the project's data, payment cards and IBANs are kinds of their own.

Defined results: null and empty texts have no mention; overlapping proposals are settled by kind (an address of
mail first, then IBANs, cards, street addresses, phones, identity numbers, names); texts of any length are searched whole.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from graylark.llm import mojibake
from graylark.llm.batches import rows_schema, scan, spread
from graylark.llm.confusable import FOREIGN, INVISIBLE, PLAIN_CASE, SPACES, normalize, script_of
from graylark.llm.langseeds import vocabulary

THRESHOLD = 0.5
FIVE = ("email", "phone", "id_number", "street_address", "person")
LABELS = {"iban": "[IBAN]", "card": "[CARD]", "email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "street_address": "[ADDRESS]", "person": "[PERSON]"}
#: A blank within a mention, also one that a wrapped (and quoted) line end makes.
S = r"(?:[ \t]+|[ \t]*\r?\n(?:\r?\n)?(?:[ \t]*[>|])*[ \t]*)"
LOST = "�"

#: Addresses are found from their "at" sign, plain or spelled out, to both sides.
AT = re.compile(rf"@|[ \t]?[(\[{{][ \t]?(?:at|arroba|ät)[ \t]?[)\]}}][ \t]?|[ \t](?:at|AT)[ \t](?=[\w-]+[ \t](?:dot|DOT)[ \t])", re.I)
PLAIN_AT = re.compile("@")
SPELLED = ("(at", "( at", "[at", "[ at", "{at", "{ at", "arroba", "(ät", "[ät", " dot ")
LOCAL = re.compile(rf"[\w+-]+(?:(?:[.+-]|[ \t]?[(\[{{][ \t]?dot[ \t]?[)\]}}][ \t]?)[\w+-]+)*$", re.I)
DOMAIN = re.compile(rf"[\w-]+(?:(?:\.|{S}?[(\[{{][ \t]?(?:dot|punto|\.)[ \t]?[)\]}}]{S}?|[ \t](?:dot|DOT)[ \t])[\w-]+)+", re.I)
PHONE = re.compile(
    rf"(?=[+(0-9])(?<![\w.#/=$€£-])(?:\+\d{{1,3}}(?:{S}|[.-])?(?:\(\d{{1,4}}\)(?:{S}|[.-])?)?\d{{1,5}}(?:(?:{S}|[.-])?\d{{2,6}}){{1,5}}|00{S}\d{{1,3}}(?:{S}\d{{2,4}}){{2,4}}|\(\d{{2,5}}\){S}?\d{{3,4}}(?:{S}|[.-])\d{{3,5}}|(?<!\d[.,])\d{{3}}\.\d{{3}}\.\d{{4}}|\d{{3}}-\d{{3}}-\d{{4}}|0\d{{2,4}}(?:{S}|-)\d{{3,4}}(?:(?:{S}|-)\d{{2,4}})?)"
    rf"(?![\w/]|[-.,]\d)(?:,?{S}(?:ext|x|ext\.|durchwahl|доб|poste|ramal|wew|dahili)\.?{S}?\d{{1,5}})?",
    re.I,
)
ID = re.compile(
    rf"(?=[0-9A-Z])(?<![\w.,#/=+-])(?:(?P<ssn>\d{{3}}-\d{{2}}-\d{{4}})|(?P<nino>[A-Z]{{2}}{S}?\d\d{S}?\d\d{S}?\d\d{S}?[A-Z])|(?P<dni>\d{{8}}-?[A-Z])|(?P<nie>[XYZ]-?\d{{7}}-?[A-Z])|(?P<cpf>\d{{3}}\.\d{{3}}\.\d{{3}}-\d\d)|(?P<passport>[A-Z]{{1,2}}\d{{6,8}})|(?P<eleven>\d{{11}})|(?P<other>\d{{2}}{S}\d{{2}}{S}\d{{6}}|\d{{4}}{S}\d{{6}}|\d{{9,10}}))(?![\w/]|[-.,]\d)"
)
IBAN = re.compile(rf"[A-Z](?<![\w-].)[A-Z]\d\d(?:[ ]?[A-Z0-9]{{4}}){{2,7}}(?:[ ]?[A-Z0-9]{{1,3}})?(?![\w-])")
CARD = re.compile(rf"\d(?<![\w.,#/=+-]\d)\d{{3}}([ -]?)\d{{4}}\1\d{{4}}\1\d{{1,7}}(?![\w/]|[-.,]\d)|3(?<![\w.,#/=+-]3)\d{{3}}([ -]?)\d{{6}}\2\d{{5}}(?![\w/]|[-.,]\d)")
PHONE_CONTEXT = re.compile(r"(?:\b(?:tel|phone|mobile|cell|fax|call|reach|ring|whatsapp|handy|telefon|téléphone|teléfono|telefone|móvil|tél|тел|телефон|[mtpf])\b\W{0,3}(?:\w+\W+){0,3})$", re.I)
ID_CONTEXT = re.compile(
    r"tax (?:number|id)|steuer|passport|pass(?:eport|nummer)|pasaporte|passaporte|paszport|паспорт|pasaport|insurance|ssn|social security|sozialversicherung|sécurité sociale|seguridad social|identi(?:ty|té|dad|dade|fication)|ausweis|personalausweis|\bdni\b|\bnie\b|\bnif\b|\bcpf\b|\brg\b|pesel|\bnip\b|dowod|dowód|kimlik|\bt\.?c\.?\b|\bинн\b|снилс|personnummer|national (?:number|id)|id (?:number|card|no)",
    re.I,
)
ID_AGAINST = re.compile(r"\b(?:order|parcel|tracking|invoice|lot|shipment|ticket|backup|rechnung|factur|fatura|commande|pedido|заказ|zamówienie|sipariş|version|profile|account|konto|serial|batch)\W{0,3}(?:no\.?|number|nr\.?)?\W{0,3}$", re.I)
STREET_EN = "Street|Avenue|Road|Lane|Drive|Boulevard|Blvd|Crescent|Close|Court|Terrace|Square|Place|Way|Parkway|Highway|St|Ave|Rd|Ln|Dr|Ct|Cres|Pl|Pkwy|Sq"
CAP = "[^\\W\\d_a-zß-öø-ÿąćęłńśźżğışа-яё][\\w’'-]*"
#: Patterns of street addresses, each with what a text must hold one of (in small letters) for the pattern to be worth a search.
LIMIT = r"(?<![\w./#-])"
FRENCH_STREETS = ("rue", "bd", "boulevard", "avenue", "av.", "place", "allée", "quai", "chemin", "impasse", "route", "cours")
OTHER_STREETS = (
    "plaza", "calle", "avda", "avenida", "paseo", "camino", "ronda", "rua", "travessa", "praça", "alameda", "largo", "ul.", "al.", "aleja", "plac", "ул.", "улица", "пр.", "проспект", "пер.", "via", "viale", "piazza", "c/",
)
TURKISH_STREETS = ("sokak", "sokağı", "sok.", "caddesi", "cad.", "mahallesi")
BOXES = ("box", "postfach", "apartado", "boîte postale", "caixa postal", "skrytka pocztowa", "posta kutusu")
GERMAN_STREETS = ("straße", "strasse", "stra\ufffd", "str.", "weg", "gasse", "allee", "platz", "ufer", "damm", "ring")
GERMAN_STREET = re.compile(r"(?:straße|strasse|stra\ufffd{1,4}e|str\.|weg|gasse|allee|platz|ufer|damm|ring)\s[\s>|]*\d")
STREETS = ("rue", "bd", "boulevard", "avenue", "av.", "place", "allée", "quai", "chemin", "impasse", "route", "cours")
OTHER_STREETS = (
    "plaza", "calle", "avda", "avenida", "paseo", "camino", "ronda", "rua", "travessa", "praça", "alameda", "largo", "ul.", "al.", "aleja", "plac", "ул.", "улица", "пр.", "проспект", "пер.", "via", "viale", "piazza", "c/",
)
TURKISH_STREETS = ("sokak", "sokağı", "sok.", "caddesi", "cad.", "mahallesi")
BOXES = ("box", "postfach", "apartado", "boîte postale", "caixa postal", "skrytka pocztowa", "posta kutusu")
GERMAN_STREET = re.compile(r"(?:straße|strasse|stra\ufffd{1,4}e|str\.|weg|gasse|allee|platz|ufer|damm|ring)\s[\s>|]*\d")
STREETS = (
    ((), re.compile(rf"(?=\d){LIMIT}\d{{1,5}}[a-zA-Z]?,?{S}(?:[NSEW]\.?{S})?(?:{CAP}{S}){{1,3}}?(?i:(?:{STREET_EN})\b)\.?(?:,?{S}(?i:(?:apt|unit|suite|flat|floor)\.?|\#){S}?\d+\w?)?(?:,{S}{CAP}(?:-{CAP})?(?:{S}[A-Z]{{1,2}}\d{{1,2}}{S}\d[A-Z]{{2}}|{S}\d{{5}})?)?")),
    (FRENCH_STREETS, re.compile(rf"(?=\d){LIMIT}\d{{1,4}}(?:{S}?(?:bis|ter))?,?{S}(?i:{'|'.join(map(re.escape, FRENCH_STREETS))}){S}(?:(?i:de la|des|du|de|de l’|d’|l’|la|le|les){S}?)?{CAP}(?:,?{S}\d{{5}}{S}{CAP}(?:-{CAP})?)?")),
    (GERMAN_STREETS, re.compile(rf"{LIMIT}{CAP[:-1]}{{0,40}}?(?i:straße|strasse|stra{LOST}{{1,4}}e|str\.|weg|gasse|allee|platz|ufer|damm|ring){S}\d{{1,4}}[a-z]?\b(?:,{S}\d{{5}}{S}{CAP}(?:-{CAP})?)?")),
    (OTHER_STREETS, re.compile(rf"{LIMIT}(?i:{'|'.join(map(re.escape, sorted(OTHER_STREETS, key=len, reverse=True)))}|avda\.){S}?(?:(?:de|del|de la|da|do|das|dos|las|los){S})?(?:{CAP}{S}?){{1,3}},?{S}?(?:n\.?º{S}?|nº{S}?|д\.{S}?)?\d{{1,4}}\b(?:,{S}\d+{S}?[ºª°]?{S}?[A-Z]?\b)?")),
    (TURKISH_STREETS, re.compile(rf"{LIMIT}{CAP}{S}(?i:{'|'.join(map(re.escape, TURKISH_STREETS))}){S}(?:no:?{S}?)?\d{{1,4}}")),
    (BOXES, re.compile(rf"{LIMIT}(?i:p\.?{S}?o\.?{S}?box|post office box|postfach|apartado(?:{S}de{S}correos)?|boîte postale|caixa postal|skrytka pocztowa|posta kutusu){S}\d{{1,6}}(?:,{S}{CAP}(?:-{CAP})?)?")),
)
WORD = re.compile(f"[^\\W\\d_{LOST}]*[{LOST}]*[^\\W\\d_]+(?:[-’'][^\\W\\d_]+)*{LOST}*")
#: The name that is a month too, beside a number.
MONTH_DAY = re.compile(r"\d\s+jan\b|\bjan\s+\d", re.I)


@lru_cache(maxsize=1)
def _literals() -> ahocorasick.Automaton:
    """All literals that patterns wait for, with the bits of those patterns: one pass over a text finds them all."""
    bits: dict[str, int] = {}
    for k, group in enumerate((SPELLED, *(words for words, _ in STREETS))):
        for word in group:
            bits[word] = bits.get(word, 0) | 1 << k
    automaton = ahocorasick.Automaton()
    for word, bit in bits.items():
        automaton.add_word(word, bit)
    automaton.make_automaton()
    return automaton


#: A capitalised word, and names in small letters where they may count: at the start of a line, behind a label, beside an address.
CAPITAL_WORD = re.compile(CAP.removesuffix("[\\w’'-]*") + "(?<![^\\W\\d_].)(?<![^\\W\\d_][-’'].)[^\\W\\d_]*(?:[-’'][^\\W\\d_]+)*")
SMALL_PAIR = re.compile(r"(?m)(?:^[ \t>|*-]*|[:,][ \t*]*)([^\W\d_]{2,})[ \t]+([^\W\d_]{6,})")
SMALL_END = re.compile(r"(?<![^\W\d_])([^\W\d_]{2,})[ \t]+([^\W\d_]{6,})[ \t]?$")
INITIAL = re.compile(rf"[^\W\d_a-zà-öø-ÿа-яёßıšśžźżłńćęą](?<![\w.].){LOST}*\.(?={S}?\S)")
GAP = re.compile(S)
DIGIT = re.compile(r"\d")
ANGLE = re.compile("<")
#: What may stand between the words of a name.
BETWEEN = " \t\r\n>|,"

#: The most frequent given names by national statistics (fixed values: all-time leaders of the United States, Germany, France,
#: Spain, Portugal, Italy, Poland, Turkey and Russia).  They stand for missing context; names outside the list need context.
GIVEN = frozenset(
    unicodedata.normalize("NFC", x).lower()
    for x in (
        "James Michael Robert John David William Richard Joseph Thomas Christopher Charles Daniel Matthew Anthony Mark Donald Steven Andrew Paul Joshua Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Karen Sarah Lisa Nancy Sandra Betty Ashley Emily Kimberly Margaret Donna Michelle "
        "Peter Wolfgang Hans Klaus Manfred Ursula Renate Monika Helga Karin Jean Pierre Philippe Alain Bernard Marie Nathalie Isabelle Sylvie Catherine Antonio José Manuel Francisco Juan María Carmen Ana Isabel Dolores João Carlos Luís Paulo Pedro "
        "Giuseppe Giovanni Mario Luigi Anna Giuseppina Rosa Piotr Krzysztof Andrzej Katarzyna Małgorzata Agnieszka Mehmet Mustafa Ahmet Fatma Ayşe Emine Александр Сергей Владимир Андрей Алексей Елена Татьяна Ольга Наталья Ирина"
    ).split()
)
#: The same names with their accented letters lost to replacement characters.
GIVEN_LOST = re.compile("|".join(sorted({re.sub("[^a-z]+", LOST + "+", g) for g in GIVEN if not g.isascii() and re.search("[a-z]", g)})))
#: Words behind a given name or an initial that are no family name.
NO_FAMILY = frozenset(
    "works group sons inc ltd llc gmbh corp co company and und et y e ve oder or on am le el em on von from to an cc subject betreff sent gesendet tel phone mobile fax dear hello hi box street road avenue lane the das die der la les los monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september october november december jan feb mar apr jun jul aug sep oct nov dec will has had is was can could may must says said regards thanks cheers re fwd fw staff herren damen grüße university universität université universidad institute college council ministry bank hospital school department centre center court church society association foundation committee agency support".split()
)
#: Titles, header labels and other words that begin no name.
NO_GIVEN = frozenset("mr mrs ms miss dr prof herr herrn frau mme mlle monsieur madame sr sra dra señor señora senhor senhora sig signora pan pani pana sayın sn to from cc von an de para от кому od do kimden kime re aw tr fwd wg ref our your this that these all new herren damen".split())
GREETINGS = frozenset("hello dear thanks regards cheers sincerely yours bonjour saludos hallo merhaba saludo cordialement atentamente atenciosamente pozdrawiam".split())
FIRM = re.compile(rf"{S}(?:&|Works\b|Group\b|Sons\b|Inc\b|Ltd\b|GmbH\b|LLC\b|Corp\b|S\.A\.|Ltda\b)")


def _digits(text: str) -> list[int]:
    return [int(c) for c in text if c.isdigit()]


def luhn(text: str) -> bool:
    d = _digits(text)[::-1]
    return len(d) > 1 and (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def mod97(text: str) -> bool:
    """ISO 7064 mod 97-10, as in IBANs: the first four characters moved behind the rest."""
    s = re.sub(r"\W", "", text).upper()
    return len(s) > 4 and s.isalnum() and s.isascii() and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def dni(text: str) -> bool:
    s = re.sub(r"\W", "", text).upper()
    s = {"X": "0", "Y": "1", "Z": "2"}.get(s[0], s[0]) + s[1:]
    return s[:-1].isdigit() and "TRWAGMYFPDXBNJZSQVHLCKE"[int(s[:-1]) % 23] == s[-1]


def cpf(text: str) -> bool:
    d = _digits(text)
    if len(d) != 11:
        return False
    for n in (9, 10):
        r = sum(x * w for x, w in zip(d[:n], range(n + 1, 1, -1))) * 10 % 11 % 10
        if r != d[n]:
            return False
    return True


def pesel(text: str) -> bool:
    d = _digits(text)
    return len(d) == 11 and (10 - sum(x * w for x, w in zip(d, (1, 3, 7, 9, 1, 3, 7, 9, 1, 3))) % 10) % 10 == d[10]


def turkish(text: str) -> bool:
    d = _digits(text)
    return len(d) == 11 and d[0] > 0 and (7 * sum(d[0:9:2]) - sum(d[1:8:2])) % 10 == d[9] and sum(d[:10]) % 10 == d[10]


def inn(text: str) -> bool:
    d = _digits(text)
    return len(d) == 10 and sum(x * w for x, w in zip(d, (2, 4, 10, 3, 5, 9, 4, 6, 8))) % 11 % 10 == d[9]


def nip(text: str) -> bool:
    d = _digits(text)
    return len(d) == 10 and sum(x * w for x, w in zip(d, (6, 5, 7, 2, 3, 4, 5, 6, 7))) % 11 == d[9]


#: Base score of a shape, score with a valid checksum, validators.
SHAPES = {
    "ssn": (0.6, 0.6, ()), "nino": (0.6, 0.6, ()), "dni": (0.45, 0.9, (dni,)), "nie": (0.45, 0.9, (dni,)), "cpf": (0.6, 0.95, (cpf,)),
    "passport": (0.2, 0.2, ()), "eleven": (0.2, 0.55, (pesel, turkish, cpf)), "other": (0.15, 0.3, (luhn, inn, nip)),
}


def _with_map(text: str) -> tuple[str, list[int] | None]:
    """The repaired and unified text, and for each of its characters the offset in ``text``."""
    if text.isascii():
        return text, None
    out: list[str] = []
    at: list[int] = []
    last = 0
    changed = False
    for m in mojibake.TOKEN.finditer(text) if mojibake.SUSPECT.search(text) else ():
        new = mojibake.repair_word(m.group())
        if new != m.group():
            out.append(text[last : m.start()])
            at.extend(range(last, m.start()))
            out.append(new)
            at.extend(min(m.start() + k, m.end() - 1) for k in range(len(new)))
            last = m.end()
            changed = True
    if changed:
        out.append(text[last:])
        at.extend(range(last, len(text)))
        text = "".join(out)
    plain = PLAIN_CASE.search(text)
    if not changed and (plain or FOREIGN.search(text)):
        at = list(range(len(text)))
    if plain:
        chars: list[str] = []
        to: list[int] = []
        for i, c in enumerate(text):
            if c < "\x80":
                chars.append(c)
                to.append(at[i])
            elif c in INVISIBLE:
                continue
            elif c in SPACES:
                chars.append(" ")
                to.append(at[i])
            elif "̀" <= c <= "ͯ":
                both = unicodedata.normalize("NFC", chars[-1] + c) if chars else c
                if chars and len(both) == 1:
                    chars[-1] = both
            elif PLAIN_CASE.match(c):
                for x in unicodedata.normalize("NFKC", c):
                    chars.append(x)
                    to.append(at[i])
            else:
                chars.append(c)
                to.append(at[i])
        text, at, changed = "".join(chars), to, True
    if FOREIGN.search(text):
        same = normalize(text)[0]
        if len(same) == len(text):
            changed |= same != text
            text = same
    return text, at if changed else None


def _family(word: str) -> bool:
    return len(word) >= 3 and not word[0].islower() and word.lower() not in NO_FAMILY and word.lower() not in GIVEN and LOST not in word[:1]


NO_NAME = NO_GIVEN | NO_FAMILY | GREETINGS


def _is_given(word: str) -> bool:
    low = word.lower()
    return low in GIVEN or LOST in low and GIVEN_LOST.fullmatch(low) is not None


@lru_cache(maxsize=1)
def _ordinary() -> frozenset[str]:
    """Words that the public vocabulary ranks higher in small letters than with a capital."""
    rank = {p: i for i, p in enumerate(vocabulary())}
    return frozenset(p[1:] for p, i in rank.items() if p[0] == " " and len(p) > 3 and p[1:].islower() and i < rank.get(" " + p[1:].capitalize(), len(rank)))


TITLED = re.compile(rf"(?<!\w)(?:Mr|Mrs|Ms|Miss|Dr|Prof|Herrn?|Frau|M|Mme|Mlle|Monsieur|Madame|Sra?|Dra|Señora?|Senhora?|Sig|Signora?|Pan|Pan[ai]|Sayın|Sn|[Гг]-(?:н|жа|на|же|жи|ну|жу))\.?{S}$")
LABELLED = re.compile(r"(?:^|\n)[ \t>|*]*(?:from|to|cc|bcc|von|an|de|à|a|para|от|кому|копия|od|do|dw|kimden|kime|da|sender|name|contact|attn)[ \t]?:[*]?[ \t]*$", re.I)
DATED = re.compile(rf"(?:\d{{4}}|\d{{1,2}}:\d\d(?:{S}?[ap]\.?m\.?)?),?{S}$", re.I)
SPOKE_BEFORE = re.compile(rf"(?:schrieb|according{S}to|reach|call|contact|ask|asked|let|tell|told|meet|applicant|employee|client|customer|colleague|file{S}of|parcel{S}for|joindre|appele[rz]|rufen{S}Sie|kontakt{S}z|dotyczy|llame{S}a|llamar{S}a|póngase{S}en{S}contacto{S}con|expediente{S}de|dossier{S}de|fale{S}com|contacto{S}com|processo{S}de|akte{S}von|pertenece{S}a|pertence{S}a|appartient{S}à|gehört|свяжитесь{S}с|принадлежит|дело|посылка{S}для|позвоните)(?:{S}(?:with|to|a|für|von|de|dla|pour|для))?{S}$", re.I)
PLACED_BEFORE = re.compile(rf"(?<!\w)(?:for|by|with|from|to|of|für|von|mit|an|pour|avec|de|par|con|para|por|com|dla|z|od|do|для|с|от|к|ile|için)(?:{S})$", re.I)
SPOKE_AFTER = re.compile(rf"{S}(?:wrote|writes|said|says|gave|moved|asked|replied|called|joined|works?|lives?|knows?|told|signed|confirmed|hat|schrieb|schreibt|wohnt|a{S}écrit|a{S}donné|habite|escribió|dijo|vive|escreveu|disse|mora|пишет|написала?|сообщила?|живёт|переехала?|napisała?|mieszka|yazdı|isimli|ile)(?!\w)", re.I)
ADDRESSED = re.compile(rf"{S}?[<(\[]{S}?[\w.+-]+{S}?(?:@|[(\[{{ ])|{S}[\w.+-]+@")
#: The line before is the end of a letter, or a divider.
CLOSED = re.compile(r"(?:^|\n)[ \t>|]*(?:[^\n]{2,40}[,.!]|[^\n\d]{2,40}|[-_*—–=~#. ]{1,60})[ \t\r]*\n(?:[ \t>|\r]*\n)?[ \t>|*]*$")
REACHED = re.compile(r"[ \t\r*]*(?:\n[ \t>|\r]*){1,2}(?:[^\n]{0,60}\n[ \t>|\r]*)?(?:[^\n]{0,60}?(?:@|\+?\(?\d{2,}|www\.|https?:| \| )|[-_*—–=]{1,60}[ \t\r]*\n)")


def _score_name(text: str, a: int, d: int, first: str, last: str, base: float) -> float:
    """What stands around a name, for and against it."""
    score = base
    known = _is_given(first)
    if known:
        score += 0.35
    elif LOST not in first and script_of(first[0]) != script_of(last[0]):
        return 0.0
    score -= 0.25 * ((not known and first.lower() in _ordinary()) + (last.lower() in _ordinary()))
    if score >= THRESHOLD:
        return score
    before = text[max(0, a - 48) : a]
    addressed = ADDRESSED.match(text, d) is not None
    if TITLED.search(before) or LABELLED.search(before) or SPOKE_BEFORE.search(before):
        score += 0.4
    elif DATED.search(before) and (addressed or SPOKE_AFTER.match(text, d)):
        score += 0.4
    elif PLACED_BEFORE.search(before):
        score += 0.3
    if addressed:
        score += 0.3
    elif SPOKE_AFTER.match(text, d):
        score += 0.3
    if _alone(text, a, d):
        score += 0.1
        if CLOSED.search(text, max(0, a - 120), a):
            score += 0.2
        if REACHED.match(text, d):
            score += 0.2
    return score


def _people(text: str) -> list[tuple[int, int]]:
    lost = LOST in text
    words = [(m.start(), m.end(), m.group()) for m in (WORD if lost else CAPITAL_WORD).finditer(text)]
    if not lost:
        pairs = [m for m in SMALL_PAIR.finditer(text) if m.group(1) in GIVEN]
        if "<" in text:
            pairs += [m for x in ANGLE.finditer(text) if (m := SMALL_END.search(text, max(0, x.start() - 60), x.start())) and m.group(1) in GIVEN]
        small = [m.span(i) for m in pairs if m.group(2).islower() for i in (1, 2)]
        if small:
            words = sorted({*words, *((a, b, text[a:b]) for a, b in small)})
    initials = {m.start(): m.end() for m in INITIAL.finditer(text)}
    proposed: list[tuple[float, int, int, str, str]] = []  # score, start, end, given, family
    near = [not text[x[1] : y[0]].strip(BETWEEN) for x, y in zip(words, words[1:])]
    near.append(False)
    for k in [k for k, x in enumerate(near) if x or k and near[k - 1]]:  # most words stand alone
        a, b, w = words[k]
        small = w.lower()
        given = small in GIVEN or lost and _is_given(w)
        if not given and (b - a < 2 or small in NO_NAME):
            continue
        if small == "jan" and MONTH_DAY.search(text, max(0, a - 4), b + 4):
            continue
        lower = w[0].islower() and LOST not in w
        if lower and not w.islower() or a in initials:
            continue
        j, end = k + 1, b
        if j < len(words) and words[j][0] in initials and not lower and "\n" not in text[b : words[j][0]] and GAP.fullmatch(text, b, words[j][0]):  # a middle initial
            end = initials[words[j][0]]
            j += 1
        if j < len(words) and (not lower or given):
            c, d, f = words[j]
            gap = GAP.fullmatch(text, end, c) if (f[0].isupper() or lower or LOST in f or not f[0].islower()) else None
            broken = gap is not None and "\n" in gap.group()
            if broken and (text[d : d + 1] in ":*" or k and re.fullmatch(rf",{S}", text[words[k - 1][1] : a]) or _alone(text, a, b) or not given and not DATED.search(text, max(0, a - 30), a) and not TITLED.search(text, max(0, a - 30), a)):
                gap = None
            if gap and (_family(f) or lower and f.islower() and len(f) >= 6 and end == b and w != "may") and not FIRM.match(text, d) and (not lower or not f[0].isupper()):
                if not lower or _lower_name(text, a, d):
                    proposed.append((_score_name(text, a, d, w, f, 0.5 if lower else 0.2 if end == b else 0.56), a, d, w, f))
        if k and not lower:  # "Family, Given" and "FAMILY Given"
            c, d, f = words[k - 1]
            if _family(f) and len(f) >= 5 and f.lower() not in NO_NAME:
                between = text[d:a]
                comma = re.fullmatch(rf",{S}", between) is not None
                if (comma or f.isupper() and not w.isupper() and GAP.fullmatch(between)) and (given or w[0].isupper() and not FIRM.match(text, b)):
                    if ("\n" not in between or given and not _alone(text, c, d + 1)) and f.lower() not in GREETINGS and not PLACE_BEFORE.search(text, max(0, c - 8), c):
                        stop = end if end > b else b
                        proposed.append((_score_name(text, c, stop, w, f, 0.2), c, stop, w, f))
    for a, b in initials.items():
        m = GAP.match(text, b)
        c = m.end() if m else b
        f = WORD.match(text, c)
        if f and _family(f.group()) and len(f.group()) >= 4 and not FIRM.match(text, f.end()):
            if m is None and f.group()[1:2].isupper() or m and "\n" in m.group() and _alone(text, a, b) or _abbreviated(text, a):
                continue
            proposed.append((0.55, a, f.end(), "", f.group()))
    for k in [k - 1 for k, w in enumerate(words) if k and w[0] in initials] if initials else ():  # "Family, I."
        c, d, f = words[k]
        if len(f) >= 5 and _family(f) and re.fullmatch(rf",{S}", text[d : words[k + 1][0]]) and "\n" not in text[d : words[k + 1][0]]:
            after = text[initials[words[k + 1][0]] :][:12]
            if not re.match(rf"{S}{CAP}", after) or after[:1] in "<":
                proposed.append((0.51, c, initials[words[k + 1][0]], "", f))
    sure = {frozenset((g.lower(), f.lower())) for score, _, _, g, f in proposed if score >= THRESHOLD}
    out: list[tuple[int, int]] = []
    for score, a, b, g, f in sorted(proposed, key=lambda x: (-x[0], x[1])):
        if (score >= THRESHOLD or frozenset((g.lower(), f.lower())) in sure) and not any(x < b and a < y for x, y in out):
            out.append((a, b))
    return out


def _lower_name(text: str, a: int, d: int) -> bool:
    """A name in small letters counts behind a label or beside an address only."""
    line = text[text.rfind("\n", 0, a) + 1 : a]
    return not line.strip(" >|-*") or line.rstrip().endswith((":", ",")) or text[d : d + 2].strip().startswith("<")


def _alone(text: str, a: int, b: int) -> bool:
    """Whether nothing else stands on the line."""
    start = text.rfind("\n", 0, a) + 1
    stop = text.find("\n", b)
    return not text[start:a].strip(" \t>|*") and not text[b : stop if stop >= 0 else len(text)].strip(" \t\r*")


#: Before "Place, Name": a preposition.
PLACE_BEFORE = re.compile(rf"(?<!\w)(?:in|from|near|at|aus|nach|en|à|em|w|из){S}$")
ABBREVIATED = re.compile(r"(?:\b[A-Z]\.|\b(?:z|d|u|p|e|i|т|P)\.)\s?$")


def _abbreviated(text: str, a: int) -> bool:
    return bool(ABBREVIATED.search(text, max(0, a - 4), a)) or re.match(r"P\. ?O\.|U\. ?S\.", text[a : a + 5]) is not None


def mentions(text: str | None) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` of every mention, in order of start."""
    if not text:
        return []
    shown, at = _with_map(text)
    found: list[tuple[str, int, int]] = []
    busy: list[tuple[int, int]] = []

    def add(kind: str, a: int, b: int) -> None:
        if not any(x < b and a < y for x, y in busy):
            busy.append((a, b))
            found.append((kind, a, b))

    low = shown.lower()
    digits = DIGIT.search(shown) is not None
    held = 0
    for _, bit in _literals().iter(low):
        held |= bit
    if "@" in shown or held & 1:
        for m in (AT if held & 1 else PLAIN_AT).finditer(shown):
            right = DOMAIN.match(shown, m.end())
            start = m.start()
            while start and (shown[start - 1].isalnum() or shown[start - 1] in "_+-.()[]{} "):
                start -= 1
            left = LOCAL.search(shown[start : m.start()]) if right else None
            if left and re.search(r"[^\W\d_]{2,}\W*$", right.group()):  # the last label of a domain is letters
                add("email", m.start() - len(left.group()), right.end())
    if digits:
        for m in IBAN.finditer(shown):
            if 15 <= len(re.sub(r"\W", "", m.group())) <= 34:
                if mod97(m.group()):
                    add("iban", m.start(), m.end())
                else:
                    busy.append(m.span())  # no phone number either
        for m in CARD.finditer(shown):
            if 13 <= len(_digits(m.group())) <= 19 and luhn(m.group()):
                add("card", m.start(), m.end())
        streets = [m.span() for k, (words, pattern) in enumerate(STREETS, 1) if not words or held >> k & 1 and (words is not GERMAN_STREETS or GERMAN_STREET.search(low)) for m in pattern.finditer(shown)]
        for a, b in sorted(streets):
            add("street_address", a, b)
        for m in PHONE.finditer(shown):
            before = shown[max(0, m.start() - 40) : m.start()]
            score = (0.7 if m.group()[0] in "+(0" else 0.6) + 0.2 * bool(PHONE_CONTEXT.search(before)) - 0.3 * bool(ID_AGAINST.search(before))
            if 7 <= len(_digits(m.group())) <= 20 and score >= THRESHOLD:
                add("phone", m.start(), m.end())
        for m in ID.finditer(shown):
            base, valid, checks = SHAPES[m.lastgroup]
            value = m.group()
            score = valid if checks and any(c(value) for c in checks) else base
            before, after = shown[max(0, m.start() - 48) : m.start()], shown[m.end() : m.end() + 26]
            if ID_CONTEXT.search(before) or ID_CONTEXT.search(after):
                score += 0.4
            if ID_AGAINST.search(before):
                score -= 0.5
            if score >= THRESHOLD:
                add("id_number", m.start(), m.end())
    for a, b in _people(shown):
        add("person", a, b)
    if at is not None:
        found = [(k, at[a], at[b - 1] + 1) for k, a, b in found]
    return sorted(found, key=lambda x: (x[1], x[0]))


def redact(text: str | None) -> str | None:
    """The text with a placeholder of its kind for every mention; null stays null."""
    if text is None:
        return None
    out, last = [], 0
    for kind, a, b in mentions(text):
        if a >= last:
            out += [text[last:a], LABELS[kind]]
            last = b
    return "".join([*out, text[last:]])


def mention_rows(df: DataFrame, key: str, text: str, tab: str, kinds: tuple[str, ...] = tuple(LABELS)) -> DataFrame:
    """``(tab, row_key, kind, start_char)`` of every mention of some kinds."""
    schema = rows_schema(tab=T.StringType(), row_key=T.LongType(), kind=T.StringType(), start_char=T.LongType())
    return scan(spread(df.select(key, text), key), [key, text], schema, lambda k, t: [(tab, k, kind, a) for kind, a, _ in mentions(t) if kind in kinds])


def redacted(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, redacted)`` for every row."""
    schema = rows_schema(**{key: df.schema[key].dataType, "redacted": T.StringType()})
    return scan(spread(df.select(key, text), key), [key, text], schema, lambda k, t: ((k, redact(t)),))
