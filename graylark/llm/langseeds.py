"""What the text operators know of languages: an alphabet and a public sentence per language, and a public vocabulary.

The sentences are the first article of the Universal Declaration of Human Rights.  The vocabulary is that of a public
byte-level tokenizer for many languages (a file named by a parameter, ranked by frequency); a piece of it counts for every
language whose alphabet has all its letters.  Nothing here comes from the data that the operators run on.
"""

from __future__ import annotations

import base64
import os
from functools import lru_cache

#: Ranks file of a public tokenizer for many languages.
VOCABULARY = os.environ.get("GRAYLARK_TOKENIZER", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")

#: Letters of each language beyond ASCII.
ALPHABETS = {
    "en": "", "de": "äöüß", "fr": "àâæçéèêëîïôœùûüÿ", "es": "áéíñóúü", "pt": "ãáâàçéêíõóôú", "it": "àèéìòóù", "nl": "éëïö", "pl": "ąćęłńóśźż", "cs": "áčďéěíňóřšťúůýž",
    "hu": "áéíóöőúüű", "sv": "åäö", "tr": "çğıöşü", "ru": "абвгдежзийклмнопрстуфхцчшщъыьэюяё", "uk": "абвгґдеєжзиіїйклмнопрстуфхцчшщьюя", "el": "αβγδεζηθικλμνξοπρστυφχψωςάέήίόύώϊϋΐΰ",
}

#: The first article of the Universal Declaration of Human Rights.
SENTENCES = {
    "en": "All human beings are born free and equal in dignity and rights. They are endowed with reason and conscience and should act towards one another in a spirit of brotherhood.",
    "de": "Alle Menschen sind frei und gleich an Würde und Rechten geboren. Sie sind mit Vernunft und Gewissen begabt und sollen einander im Geist der Brüderlichkeit begegnen.",
    "fr": "Tous les êtres humains naissent libres et égaux en dignité et en droits. Ils sont doués de raison et de conscience et doivent agir les uns envers les autres dans un esprit de fraternité.",
    "es": "Todos los seres humanos nacen libres e iguales en dignidad y derechos y, dotados como están de razón y conciencia, deben comportarse fraternalmente los unos con los otros.",
    "pt": "Todos os seres humanos nascem livres e iguais em dignidade e em direitos. Dotados de razão e de consciência, devem agir uns para com os outros em espírito de fraternidade.",
    "it": "Tutti gli esseri umani nascono liberi ed eguali in dignità e diritti. Essi sono dotati di ragione e di coscienza e devono agire gli uni verso gli altri in spirito di fratellanza.",
    "nl": "Alle mensen worden vrij en gelijk in waardigheid en rechten geboren. Zij zijn begiftigd met verstand en geweten, en behoren zich jegens elkander in een geest van broederschap te gedragen.",
    "pl": "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa.",
    "cs": "Všichni lidé rodí se svobodní a sobě rovní co do důstojnosti a práv. Jsou nadáni rozumem a svědomím a mají spolu jednat v duchu bratrství.",
    "hu": "Minden emberi lény szabadon születik és egyenlő méltósága és joga van. Az emberek, ésszel és lelkiismerettel bírván, egymással szemben testvéri szellemben kell hogy viseltessenek.",
    "sv": "Alla människor är födda fria och lika i värde och rättigheter. De är utrustade med förnuft och samvete och bör handla gentemot varandra i en anda av broderskap.",
    "tr": "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve birbirlerine karşı kardeşlik zihniyeti ile hareket etmelidirler.",
    "ru": "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства.",
    "uk": "Всі люди народжуються вільними і рівними у своїй гідності та правах. Вони наділені розумом і совістю і повинні діяти у відношенні один до одного в дусі братерства.",
    "el": "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα. Είναι προικισμένοι με λογική και συνείδηση, και οφείλουν να συμπεριφέρονται μεταξύ τους με πνεύμα αδελφοσύνης.",
}


@lru_cache(maxsize=2)
def vocabulary(path: str = VOCABULARY) -> tuple[str, ...]:
    """The pieces of the vocabulary that are letters (a leading blank marks the start of a word), frequent ones first."""
    out = []
    with open(path, "rb") as f:
        for line in f:
            try:
                piece = base64.b64decode(line.split()[0]).decode("utf-8")
            except (UnicodeDecodeError, IndexError):
                continue
            if piece.strip().isalpha():
                out.append(piece)
    return tuple(out)


def pieces(lang: str, path: str = VOCABULARY) -> list[str]:
    """The pieces with a letter beyond ASCII whose letters all belong to a language."""
    letters = ALPHABETS[lang] + ALPHABETS[lang].upper()
    return [p for p in vocabulary(path) if not p.isascii() and all(c < "\x80" or c in letters for c in p)]
