"""Personal items in text."""

import pytest
from pyspark.sql import functions as F

from tidemark.llm import pii

LEX = pii.Lexicon(
    frozenset("thea günther fenella corwen rose amber mark will page".split()), frozenset("castelmoro harvestane o'tarrow de-vrieske cookie lattice table".split()),
    frozenset("rose amber mark will page cookie lattice table".split()), frozenset({"nether oddlow", "wexmoor"}),
)
FINDER = pii.Finder(LEX)

#: Items are marked with their kind.
TEXTS = [
    "Reported by <name:Lior Abernoxie> (<email:corwen@post.example.com>).",
    "cc <email:a.b-c+d@x-y.example>; <email:rose(at)mail.test>, <email:x [at] team [dot] hill [dot] test>.",
    "Built from theme@11.26.1 with logo@2x.png. @media rules hide",
    "mailto:<email:a@b.test>?subject=price user=<email:LOUD@MAIL.TEST> tel=<phone:+1 715 555 0171> status=200",
    "tel. <phone:606 555 0186 x31> or <phone:(930) 555-0127>, <phone:+44 20 7946 0253>; <phone:07700 900241>",
    "Bitte Frau <name:Thea Castelmoro> unter <phone:+49 (0)30 23125-439> anrufen.",
    "Tel. <phone:030/23125-745> oder <phone:004930 23125178>",
    "Merci d'appeler <name:Zelda Silverstrand> au <phone:01.99.00.38.60>.",
    "Llame a <name:Rafi Cookie> al <phone:(+34) 555405295>.",
    "as told by <name:Thea> on the phone (<phone:555.405.2950>)",
    "SSN on file: <idnum:909-11-4634> My ID is <idnum:QQ 83 71 87 A> and passport <idnum:ZZ7947017>, issued to <name:Thea Harvestane>",
    "Ausweisnummer <idnum:L10625500X> Steuer-ID: <idnum:00 403 765 756> N° de sécu : <idnum:9 26 16 13 637 314 66>",
    "El DNI <idnum:38548895-I> aparece en el registro. NIE <idnum:X3168098O>, titular <name:Thea O'Tarrow>",
    "Serial 489-841-07 is a part label. Ticket #998015154 is closed; see row 98-15-1. Run 2026-03-26 14:07:55 took 12.78 s. State 058cf8af6440",
    "<idnum:944352122> belongs to <name:Corwen Harvestane>",
    "Ship to <address:999 Old Kiln Street #99, Wexmoor 00123>. Old Kiln Street Edition is a product name. Tiles 200 to 453 were 12 Street View thumbs.",
    "living at <address:52 Wexmoor Street, Flat 2b, Nether Oddlow, OW 00777> wrote from <email:a@b.test>.",
    "<name:Fenella Harvestane>, <address:Am Alten Wehr 13, 00415 Hollbruck>, hat den Lauf neu gestartet.",
    "Adresse de livraison : <address:57 bis avenue du Vieux Barrage, 00880 Saint-Orvel> Rien",
    "Dirección de entrega: <address:Calle de la Noria, 99, 9º B, 00123 Wexmoor> El selector",
    "The Amber banner covers the Rose button on Mark 2 tiles. Will the Page role ever settle? Lattice Table with Cookie Drawer, 27 pieces.",
    "Hi <name:Corwen>, <name:Harvestane, Thea> and <name:T. Castelmoro> / <name:Günther Fenella Castelmoro> met <name:Page de-Vrieske>.",
    "<name:Thea Harvestane> Lattice Table with Cookie Drawer, 27 pieces, in stock.",
    "healed: 3 Tras Close banner la lista",
    "assignee: <name:M. Castelmoro>\nreviewer: <name:Thea M. Harvestane>\n",
    "Dr. <name:Thea Castelmoro> asked us to remove the record for <idnum:905 37 4525>.",
    "",
    "   ",
]


def parse(marked):
    import re

    text, spans, at = "", [], 0
    for m in re.finditer(r"<(\w+):([^<>]*)>", marked):
        text += marked[at : m.start()]
        spans.append((len(text), len(text) + len(m[2]), m[1]))
        text += m[2]
        at = m.end()
    return text + marked[at:], spans


@pytest.mark.parametrize("marked", TEXTS)
def test_spans(marked):
    text, spans = parse(marked)
    got = FINDER.spans(text)
    show = lambda s: [(text[a:b], k) for a, b, k in s]
    assert show(got) == show(spans) and got == sorted(spans)


#: Number formats beside no word, in wording that no pattern holds; right check digits, then wrong ones.
RIGHT = ["046 454 286", "4539 5787 6362 1486", "371449635398431", "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "86095742719", "12345678Z", "X1234567L", "1 85 05 78 006 084 91"]
WRONG = ["046 454 287", "4539 5787 6362 1487", "371449635398432", "DE88 3704 0044 0532 0130 00", "GB83WEST12345698765432", "86095742718", "12345678A", "X1234567M", "1 85 05 78 006 084 90"]


def test_checksums_decide_without_words():
    found = lambda n: FINDER.spans(f"The clerk copied {n} twice.")
    kinds = lambda n: [(a, b, k) for a, b, k in found(n) if k == "idnum"]
    assert [kinds(n) for n in RIGHT] == [[(17, 17 + len(n), "idnum")] for n in RIGHT]
    assert not any(kinds(n) for n in WRONG)


def test_words_beside_a_number_outweigh_its_check_digit():
    for text in ("Her national id is 86095742718", "SIN: 046 454 287", "DNI 12345678A", "sécu : 1 85 05 78 006 084 90"):
        (a, b, kind), = FINDER.spans(text)
        assert kind == "idnum" and text[a:b][0].isdigit()
    assert FINDER.spans("SIN: 046 454 286")[0][2] == "idnum" and FINDER.spans("call 046 454 286")[0][2] == "phone"


HELD_OUT = [
    "Kindly forward the parcel for <name:Thea Castelmoro> to <address:14 Wexmoor Lane, Flat 3, Nether Oddlow, OW 00777>.",
    "Whoever wrote <email:first.last@dept.example.org> should ring <phone:+44 20 7946 0958>.",
    "<name:Corwen Harvestane> swore that <idnum:4111 1111 1111 1111> was stolen.",
    "Transfer it to <idnum:FR14 2004 1010 0505 0001 3M02 606> by Friday, said <name:Günther Castelmoro>.",
    "Meine Anschrift lautet <address:Lindenstraße 12, 00415 Wexmoor>, Handy <phone:+49 171 5550123>.",
    "Nous habitons <address:8 rue du Moulin, 00880 Wexmoor>; <phone:01 99 00 38 61> le soir.",
    "Vivo en <address:Calle Mayor, 3, 2º A, 00123 Wexmoor> y mi NIF es <idnum:12345678Z>.",
    "The order 4111111111111112 and the hash 9f92a92c0ffee92d are no cards; build 123-456-789 neither.",
    "Passport <idnum:ZZ1234567> and the licence of <name:T. Harvestane> lay there.",
]


@pytest.mark.parametrize("marked", HELD_OUT)
def test_held_out_wording(marked):
    text, spans = parse(marked)
    got = FINDER.spans(text)
    assert [(text[a:b], k) for a, b, k in got] == [(text[a:b], k) for a, b, k in spans]


def test_more_name_words_than_the_driver_holds(spark, monkeypatch):
    docs = corpus(spark, ["Hi Jorvi, see Jorvi Sorensby.", None, "Thea Castelmoro met Jorvi Sorensby", "Hi Jorvi, x", "no one", "Thea Castelmoro met Jorvi Sorensby"])
    listed = names(spark, [("Thea", "given"), ("Castelmoro", "family"), ("Sorensby", "family"), ("Wexmoor", "town")])
    want = sorted(tuple(r) for r in pii.find(docs, listed).collect())
    monkeypatch.setattr(pii, "MAX_WORDS", 1)
    assert sorted(tuple(r) for r in pii.find(docs, listed).collect()) == want and len(want) >= 6


def test_without_the_automaton(monkeypatch):
    plain = [FINDER.spans(parse(t)[0]) for t in TEXTS]
    monkeypatch.setattr(pii, "ahocorasick", None)
    slow = pii.Finder(pii.Lexicon(LEX.given, LEX.family, LEX.common, LEX.towns))
    assert [slow.spans(parse(t)[0]) for t in TEXTS] == plain


def test_checksums():
    assert pii.iban("DE89370400440532013000") and not pii.iban("DE89370400440532013001")
    assert pii.luhn("4539578763621486") and not pii.luhn("4539578763621487")
    n = "1850578006084"
    assert pii.mod97_key(n + f"{97 - int(n) % 97:02d}") and not pii.mod97_key(n + "00")
    assert pii.dni("12345678Z") and pii.dni("X1234567L") and not pii.dni("12345678A")
    assert pii.iso7064_11_10("86095742719")


DDL = "doc_id bigint, text string"


def corpus(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), DDL)


def names(spark, data):
    return spark.createDataFrame(data, "token string, token_kind string")


def test_learning_from_frames(spark):
    docs = corpus(spark, ["Reported by Jorvi Sorensby (a@b.test)."] * 3 + ["Jorvi Sorensby was here. Page is a word. Page two. Page three."] + ["The Page role."] * 20)
    lex = pii.build_lexicon(docs, names(spark, [("Page", "given"), ("PAGE", "given"), (None, "given"), ("Wexmoor", "town")]))
    assert "jorvi" in lex.given and "sorensby" in lex.family and "page" in lex.common and lex.towns == {"wexmoor"}
    found = pii.find(docs, names(spark, [("Page", "given")])).filter("doc_id = 3").collect()
    assert [(r["start_pos"], r["end_pos"], r["pii_kind"]) for r in found] == [(0, 14, "name")]


def test_edges(spark):
    long = "x " * 200_000 + "mail a@b.test"
    docs = corpus(spark, [None, "", " \n", "🙂🙂 a@b.test 𝒳", long, "a@b.test a@b.test"]).withColumns({c: F.lit("z") for c in ("start_pos", "end_pos", "pii_kind", "word", "kind", "n")})
    none = names(spark, [])
    got = sorted(tuple(r) for r in pii.find(docs, none).collect())
    assert got == [(3, 3, 11, "email"), (4, 400_005, 400_013, "email"), (5, 0, 8, "email"), (5, 9, 17, "email")]
    text = {r["doc_id"]: r["text"] for r in pii.replace(docs, none).collect()}
    assert text[0] is None and text[1] == "" and text[3] == "🙂🙂 [EMAIL] 𝒳" and text[5] == "[EMAIL] [EMAIL]"
    assert pii.find(docs.limit(0), none).count() == 0


def test_all_else_is_unchanged(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    words = spark.read.parquet("/root/testdata/sf0.001/name_list.parquet")
    spans = {}
    for r in pii.find(df, words).collect():
        spans.setdefault(r["doc_id"], []).append((r["start_pos"], r["end_pos"], r["pii_kind"]))
    new = {r["doc_id"]: r["text"] for r in pii.replace(df, words).collect()}
    assert spans
    for r in df.collect():
        own = sorted(spans.get(r["doc_id"], []))
        assert all(a[1] <= b[0] for a, b in zip(own, own[1:]))
        assert new[r["doc_id"]] == pii.redacted(r["text"], own)
