"""Text operators: repair, replies, personal data, look-alikes, sentences."""

import random

import pytest

from graylark.llm import confusable, mojibake, pii, replies, sentences

WORDS = ["café", "Größe", "naïve", "señor", "l’échéance", "przełożyliśmy", "Встреча", "протокол", "€20", "isn’t", "“quoted”", "çünkü", "İstanbul"]


@pytest.mark.parametrize("wrong", ["cp1252", "mac_roman", "cp1251"])
@pytest.mark.parametrize("word", WORDS)
def test_utf8_read_wrongly_comes_back(word, wrong):
    table = {b: c for c, b in mojibake.ENCODERS[wrong].items()}
    damaged = "".join(table.get(b, chr(b)) if b > 127 else chr(b) for b in word.encode())
    fixed, found = mojibake.repair(f"The {damaged} list")
    assert found and fixed == f"The {word} list"


def test_chains_and_losses():
    twice = "café".encode().decode("latin-1").encode().decode("latin-1")
    assert mojibake.repair(f"a {twice}") == ("a café", True)
    assert mojibake.repair("caf� bar") == ("caf� bar", True)
    assert mojibake.repair("Мы заменили деталей в устройстве".encode("koi8-r").decode("cp1251"))[0] == "Мы заменили деталей в устройстве"
    assert mojibake.repair("Мы заменили деталей".encode("cp1251").decode("cp1252"))[1]


RUSSIAN, POLISH, WESTERN = "Мы заменили детали в устройстве и отправили протокол", "proszę się będzie środę kwotę", "für nächste réunion société numéro"
MEANT = {"cp1251": RUSSIAN, "koi8-r": RUSSIAN, "cp866": RUSSIAN, "cp1250": POLISH, "iso8859-2": POLISH, "cp1254": "lütfen şifre değişikliği için tıklayın", "cp1253": "Παρακαλώ ελέγξτε τον λογαριασμό σας", "mac_roman": WESTERN, "cp1252": WESTERN}


@pytest.mark.parametrize("wrong, meant", mojibake.SINGLE_BYTE)
def test_each_single_byte_chain_comes_back(wrong, meant):
    table = {b: c for c, b in mojibake.ENCODERS[wrong].items()}
    damaged = "".join(table[b] if b > 127 else chr(b) for b in MEANT[meant].encode(meant))
    assert mojibake.repair(damaged) == (MEANT[meant], True)


@pytest.mark.parametrize("text", ["Søren Valmère", "NÃO, não", "£78 £89 Søren", "I’d – won’t", "€85,378.14 José", "Añadimos señor mañana", "être prêt pour la réunion"])
def test_sound_words_that_nothing_marks_stay(text):
    assert mojibake.repair(text) == (text, False)


#: The first article of the Universal Declaration of Human Rights in languages that no dictionary has.
HELD_OUT = {
    "bg": ("Всички хора се раждат свободни и равни по достойнство и права. Те са надарени с разум и съвест и следва да се отнасят помежду си в дух на братство.", (("cp1251", "koi8-r"), ("koi8-r", "cp1251"), ("cp1252", "cp1251"), ("cp866", "cp1251"))),
    "da": ("Alle mennesker er født frie og lige i værdighed og rettigheder. De er udstyret med fornuft og samvittighed, og de bør handle mod hverandre i en broderskabets ånd.", ()),
    "sk": ("Všetci ľudia sa rodia slobodní a sebe rovní, čo sa týka ich dôstojnosti a práv. Sú obdarení rozumom a majú navzájom jednať v bratskom duchu.", ()),
    "fi": ("Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.", ()),
}


def misread(text, wrong, meant):
    table = {b: c for c, b in reversed(mojibake.ENCODERS[wrong].items())}
    return "".join(table[b] if b > 127 else chr(b) for b in text.encode(meant))


@pytest.mark.parametrize("lang", HELD_OUT)
def test_languages_without_a_dictionary(lang):
    text, chains = HELD_OUT[lang]
    assert mojibake.repair(text) == (text, False)
    assert mojibake.repair(misread(text, "cp1252", "utf-8")) == (text, True)
    for wrong, meant in chains:
        assert mojibake.repair(misread(text, wrong, meant)) == (text, True), (wrong, meant)


def test_the_dictionaries_decide(monkeypatch):
    """With plain byte counts for lengths no single-byte chain is found: letters stand for letters."""
    text, chains = HELD_OUT["bg"]
    damaged = [misread(text, *c) for c in chains[:2]]
    assert all(mojibake.repair(x)[1] for x in damaged)
    mojibake.gains.cache_clear()
    monkeypatch.setattr(mojibake, "description_length", lambda w: float(len(w.encode())))
    monkeypatch.setattr(mojibake, "joint_length", lambda ws: len(" ".join(ws).encode()))
    assert not any(mojibake.repair(x)[1] for x in damaged)
    mojibake.gains.cache_clear()


def test_mixed_chains_come_back():
    """UTF-8 read as cp1252, kept in Mac Roman and read as cp1252."""
    text = "société réélue, numéro du café"
    assert mojibake.repair(misread(misread(text, "cp1252", "utf-8"), "cp1252", "mac_roman")) == (text, True)


@pytest.mark.parametrize("text", [None, "", "   ", "plain", "Größe “heiß“ Ü“ À l’école", "Встреча НОМЕР Её СССР»", "créée naïve Ÿ", "日本語。 한국어", "ｆｕｌｌ", "Τι κάνεις;"])
def test_sound_texts_stay(text):
    assert mojibake.repair(text) == (text, False)


def test_foreign_lines():
    text = "Hello,\n\nOn 2020-12-10, at 09:15, Ann Bee\n<ann@bee.example> wrote:\n> one\n> two\nmy answer\n> three\n\nKind regards\nTom Ray\n--\nTom Ray\nTel.: +1 555-111-0199\n\nSent from my pocket handset"
    assert replies.foreign_lines(text) == [3, 4, 5, 6, 8, 10, 11, 12, 13, 14, 16]
    assert replies.own_text(text) == "Hello,\n\nmy answer"


def test_no_length_hides_a_line():
    """Long names, addresses, headers and dividers, attributions wrapped over many lines."""
    name, addr = "Ruth " + "Wrexavar-" * 30 + "Bee", "r" * 400 + "@x.example"
    text = f"Fine by me.\n\nOn 2021-05-24, at 10:10,\n{name}\n" + "of the office\n" * 6 + f"<{addr}>\nwrote:\n> old\n"
    assert replies.foreign_lines(text) == list(range(3, 14))
    assert replies.foreign_lines(f"Fine.\n\nOn 2021-05-24 {name} <{addr}> wrote:\n> old") == [3, 4]
    header = "From: a@b.example\n" + "".join(f"To: p{i}@x.example\n" for i in range(30)) + "Subject: s\nDate: today\n"
    assert replies.foreign_lines("See below.\n\n" + header + "\nold text") == [*range(3, 36), 37]
    assert replies.foreign_lines("Fine.\n\n" + "-" * 300 + "\nRuth Bee\n+1 555 010 0000") == [3, 4, 5]


def test_huge_lines_end_in_time():
    import time

    began = time.time()
    for line in ("a" * 1_000_000 + ":", "word " * 200_000 + ":", "On " * 300_000 + "wrote", "this message " * 60_000, "x@y " * 200_000 + ":"):
        replies.foreign_lines(f"hello\n\n{line}\n> quoted")
    assert time.time() - began < 20


def test_forwarded_messages():
    below = "My own words are here and there.\r\n\r\n-----Original Message-----\r\nFrom: A B <a@b.example>\r\nSent: 2020-01-01 10:00\r\nTo: C D\r\nSubject: x\r\n\r\nold\r\n"
    assert replies.foreign_lines(below) == [3, 4, 5, 6, 7, 9]
    above = "Von: A B <a@b.example>\nGesendet: 01.01.2020 10:00\nAn: C D\nBetreff: x\n\nalt, sehr alt\n\nMfG\nA B\n\nMein neuer Text steht hier unten."
    assert replies.foreign_lines(above) == [1, 2, 3, 4, 6, 8, 9]


@pytest.mark.parametrize("text", ["From: Thursday on, the desk moves.\nThe confidential folder was moved, this message is only a reminder.\n-- the old item is still open, see the list.", None, "", " \n\r\n ", "a"])
def test_nothing_foreign(text):
    assert replies.foreign_lines(text) == []


def test_mentions():
    text = "Call Dr. Ruth Wrexavar (+44 1632 960011), SSN 912-45-6789, or mail r.w (at) corp (dot) example, 12 Sallow Street, Suite 4. Order 4450491751, Victor said."
    found = {(k, text[a:b]) for k, a, b in pii.mentions(text)}
    assert found == {("person", "Ruth Wrexavar"), ("phone", "+44 1632 960011"), ("id_number", "912-45-6789"), ("email", "r.w (at) corp (dot) example"), ("street_address", "12 Sallow Street, Suite 4")}
    assert pii.redact(text).startswith("Call Dr. [PERSON] ([PHONE]), SSN [ID_NUMBER], or mail [EMAIL], [ADDRESS].")
    assert pii.mentions(None) == [] and pii.mentions("") == [] and pii.redact(None) is None


UNLISTED = (
    "Priya Raghunathan|Kwame Mensah|Xiomara Delgado|Bjorn Lindqvist|Tunde Adeyemi|Siobhan Kavanagh|Hiroshi Tanaka|Mei-Ling Zhou|Olumide Bakare|Rashid Al-Farouk|Anneliese Brandt|Tomasz Wieczorek|Gwendolyn Price|Ravi Subramanian|Ekaterina Volkova|Dimitris Papadakis|"
    "Eilidh MacLeod|Farida Hosseini|Jorge Villanueva|Kirsten Aagaard|Lorenzo Bianchi|Maeve Gallagher|Ngozi Okafor|Osagie Eze|Petra Novotna|Quentin Dubois|Rosalind Hargreaves|Sanjay Kulkarni|Deborah Miller|Nguyen Thanh"
).split("|")
AROUND = (
    "Please call {} before noon.", "Kind regards,\n{}\nSales Manager\n+1 555 010 2000", "From: {} <x.y@mail.example>\nTo: a@b.example", "On 3 May 2021, at 10:10, {} wrote:\n> hi", "I spoke with Ms. {} yesterday.", "The parcel for {} went missing.",
    "Ask Dr. {} about it.", "{} said the invoice is late.", "The file was sent by {} on Monday.", "Bitte rufen Sie Frau {} an.", "To: {}\nSubject: x", "{} asked for the report.",
)


def test_names_that_no_list_has():
    unlisted = [x for x in UNLISTED if x.split()[0].lower() not in pii.GIVEN]
    assert len(unlisted) >= 28
    texts = [(t.format(x), t.index("{}")) for x in unlisted for t in AROUND]
    assert sum(("person", a) in {(k, b) for k, b, _ in pii.mentions(t)} for t, a in texts) >= 0.95 * len(texts)


@pytest.mark.parametrize(
    "text",
    ["The Ember Compass project starts on Monday.", "We moved to Northern Ireland last May.", "Invoice from Harbour Freight Works is due.", "See Quality Control for New York.", "Kind Regards,\nThe Team", "He flew to San Francisco and Los Angeles.", "The Data Protection Officer asked for it.", "Viele Grüße\nEuer Team"],
)
def test_no_names(text):
    assert not [m for m in pii.mentions(text) if m[0] == "person"]


@pytest.mark.parametrize(
    "text, kind",
    [
        ("Pay to DE89 3704 0044 0532 0130 00 today", "iban"), ("Pay to GB82WEST12345698765432.", "iban"), ("Card 4111 1111 1111 1111 is blocked", "card"), ("Card 4111-1111-1111-1111 is blocked", "card"), ("паспорт 4510 123456", "id_number"), ("ИНН 7707083893", "id_number"),
        ("NIP 1234563218", "id_number"), ("PESEL 44051401359", "id_number"), ("call +44 20 7946 0018 now", "phone"),
        ("Pay to DE88 3704 0044 0532 0130 00 today", None), ("Card 4111 1111 1111 1112 is blocked", None), ("order 555-123-4567 shipped", None), ("7707083893", None),
    ],
)
def test_validators_and_context_confirm(text, kind):
    assert [k for k, *_ in pii.mentions(text)] == ([kind] if kind else [])


def test_validators_decide(monkeypatch):
    assert pii.redact("DE89 3704 0044 0532 0130 00 and 4111 1111 1111 1111") == "[IBAN] and [CARD]"
    monkeypatch.setattr(pii, "luhn", lambda _: False)
    monkeypatch.setattr(pii, "mod97", lambda _: False)
    assert not {"iban", "card"} & {k for k, *_ in pii.mentions("DE89 3704 0044 0532 0130 00 and 4111 1111 1111 1111")}


def test_a_sure_name_is_sure_everywhere():
    text = "Priya Raghunathan, as before.\n\nFrom: Priya Raghunathan <p@x.example>"
    assert [k for k, *_ in pii.mentions(text)].count("person") == 2


def test_offsets_refer_to_the_stored_text():
    text = "​foo⁠bar@x.example and JosÃ© Haldavar"
    assert [(k, a) for k, a, _ in pii.mentions(text)] == [("email", 1), ("person", 23)]


def test_checksums():
    assert pii.luhn("4539 1488 0343 6467") and not pii.luhn("4539 1488 0343 6468")
    assert pii.mod97("GB82 WEST 1234 5698 7654 32") and not pii.mod97("GB82 WEST 1234 5698 7654 33")
    assert pii.dni("12345678Z") and not pii.dni("12345678A") and pii.cpf("529.982.247-25") and pii.pesel("44051401359") and pii.turkish("10000000146")


@pytest.mark.parametrize("shown, plain", [("ｐａｙ ｎｏｗ", "pay now"), ("раураӏ.example", "paypal.example"), ("café", "café"), ("a​b", "ab"), ("a\xa0b", "a b"), ("𝐭𝐡𝐞 ﬁle", "the file"), ("tһe Wоrks", "the Works"), ("рeгистр номер", "регистр номер")])
def test_one_form(shown, plain):
    assert confusable.normalize(shown) == (plain, True)


@pytest.mark.parametrize("text", [None, "", "café", "кофейня.example", "Вера Желтунов сказала", "до сих пор не оплачен", "3º A", "cafГ© ВЈ20", "日本語"])
def test_genuine_words_stay(text):
    assert confusable.normalize(text) == (text, False)


def units(text):
    return [text[a:b] for a, b in sentences.sentences(text)]


@pytest.mark.parametrize(
    "text, want",
    [
        ("Dr. A. Bee left at 9:30 a.m. on Monday. See v1.2.3 etc. My train is late!", ["Dr. A. Bee left at 9:30 a.m. on Monday.", "See v1.2.3 etc.", "My train is late!"]),
        ('"Open it?" asked Tom. He replied, "Nobody did. Close it." U.S. staff saw it.', ['"Open it?" asked Tom.', 'He replied, "Nobody did. Close it."', "U.S. staff saw it."]),
        ("Das gilt z. B. für A bzw. B vom 3. Mai. Siehe Nr. 5 usw. Ende.", ["Das gilt z. B. für A bzw. B vom 3. Mai.", "Siehe Nr. 5 usw.", "Ende."]),
        ("他说：“假的。不要回复。”请看……随后好。真的吗？！", ["他说：“假的。不要回复。”", "请看……随后好。", "真的吗？！"]),
        ("担当者は「偽物です。だめ。」と言いました。次です！", ["担当者は「偽物です。だめ。」と言いました。", "次です！"]),
        ("इसे न खोलें! डॉ. A ने कहा। फिर?", ["इसे न खोलें!", "डॉ. A ने कहा।", "फिर?"]),
        ("Ποιος άνοιξε τον σύνδεσμο; Μην το κάνετε π.χ. τώρα!", ["Ποιος άνοιξε τον σύνδεσμο;", "Μην το κάνετε π.χ. τώρα!"]),
        ("من فتح الرابط؟ لا تدفعوا.", ["من فتح الرابط؟", "لا تدفعوا."]),
        ("ใครกดลิงก์  ห้ามเปิดลิงก์", ["ใครกดลิงก์", "ห้ามเปิดลิงก์"]),
        ("Hi all,\n\nWe waited... then it came.\n• first item\n- second item\n", ["Hi all,", "We waited... then it came.", "first item", "second item"]),
        ("A sentence that is wrapped at a rather\nnarrow width goes on. The next one is\nwrapped too.", ["A sentence that is wrapped at a rather\nnarrow width goes on.", "The next one is\nwrapped too."]),
        (None, []), ("", []), (" \n ", []), ("no end", ["no end"]),
    ],
)
def test_sentences(text, want):
    assert units(text) == want


@pytest.mark.parametrize(
    "text, lang, want",
    [
        ("Please call me. Then we can go.", None, 2), ("The answer is no. She left early.", None, 2), ("He likes modern art. She prefers music.", None, 2), ("Das ist meine Art. Er geht.", None, 2),
        ("Please call me. Then we can go.", "fr", 2), ("Das ist meine Art. Er geht.", "en", 2), ("He took vitamin C. The rest was left.", "en", 2),
        ("Voir Me. Dupont pour les actes.", "fr", 1), ("It is in No. 5 and art. 12 of the act.", "en", 1), ("Es steht in Art. 12 und Abs. 3 im Gesetz.", "de", 1), ("Es steht in Art. 12 und Abs. 3 im Gesetz.", "EN", 1),
        ("По данным, потеряно ок. 95 евро, т. е. всё, см. AB-1.", "en", 1), ("La Dra. Ruiz dijo: «Es falso.»", "de", 1), ("It is Mr. Smith. He knows it.", "xx", 2),
    ],
)
def test_abbreviations_by_language(text, lang, want):
    assert len(sentences.sentences(text, lang)) == want


def test_terminators_of_every_script():
    import regex

    marks = regex.findall(r"\p{Sentence_Terminal}", "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)])))
    assert len(marks) > 160
    for mark in marks:
        assert [len(x) for x in units(f"ሀሁሂ ሃሄህ{mark} ለሉሊ ላሌል{mark}")] == [8, 8], hex(ord(mark))


def test_long_texts_are_processed_whole():
    rng = random.Random(0)
    body = "\n".join(" ".join(rng.choice(["please", "send", "the", "report", "Größe", "on", "Monday."]) for _ in range(12)) for _ in range(20000))
    end = "\nKind regards\nRuth Wrexavar\nSSN 912-45-6789​ cafÃ©."
    text = body + end
    assert mojibake.repair(text)[0].endswith("café.") and confusable.normalize(text)[1]
    assert {k for k, *_ in pii.mentions(text)[-2:]} == {"person", "id_number"}
    assert replies.foreign_lines(text)[-2:] == [20001, 20002] and sentences.sentences(text)[-1][1] == len(text)
