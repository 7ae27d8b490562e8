import random

from dossierkit.llm import pii
from dossierkit.llm.pii import find, number_spans, redact

FORMS = [
    ("email", ["ann.lee@firm.test", "deborah dot carholt at lemmorover dot test", "ines.galick [at] selware\n[dot] example", "KIM+x@mail.firm.invalid"]),
    ("phone", ["+44 20 7946 0850", "(334) 555-0188", "415.555.0102 ext. 12", "0049/30/23125608", "+33 (0)1 99 00 11 10", "01632 960 475", "030 23125-393", "+1 588 555\n0147"]),
    ("id_number", ["953-19-9236", "QQ 11 57 97 C", "zx-3614000", "9 77 13 98 427 752 74", "00/292/609/959"]),
    (
        "address",
        ["3005 Alder Road Suite 158, Jarnor, ZZ 00162", "P.O. Box 2767, Golcarick, ZZ 00465", "Flat 2, 10 Quarry Row, Larhart QX5 3ZZ", "Telingtonstraße 31a, 00495 Tammarrath",
         "114 bis, avenue de Ridge, 00018 Larhart", "Calle Copper 61, bajo, 00423 Rosden"],
    ),
]
DECOYS = "Batch no. 935-22-9651 left. Lot 649/49/1191 passed. Invoice 2001-95-7074 was paid. Counts: 586 555 63341 in all. Meeting on 20.11.2003 at 15:24. Handle @quota. Ref. ARV-01075410 applies."


def test_forms():
    for kind, cases in FORMS:
        for case in cases:
            text = f"Her ID or place is {case}; no more."
            assert [(text[a:b], k) for a, b, k in number_spans(text)] == [(case, kind)], case
    assert number_spans(DECOYS) == []
    assert number_spans("") == []
    assert [k for _, _, k in number_spans("SSN 960256038 and part 960256038")] == ["id_number"]


def test_windows_lose_no_number():
    rnd = random.Random(5)
    pieces = ["+44 ", "(0)", "(334)", ")-(", "555", "-0188", " ext. 12", "QQ 11", " 57 97 C", "zx-3614000", "9 77 13 98 4B7 752 74", "00/292/609/959", ", ", "SSN ", "Calle Copper 61, 00423 Rosden", "word ", ".", "7", "12", "\n",
              "3005 Alder Road, Jarnor, ZZ 00162", "0049/30/", "23125608", "+1 (588)-(555)-0147 x 77", "ann@b.test", "Ident. 12345678901"]
    for _ in range(4000):
        text = "".join(rnd.choice(pieces) for _ in range(rnd.randrange(1, 14)))
        assert number_spans(text) == number_spans(text, windowed=False), text


def test_given_names_are_learnt(spark):
    """Given names outside the seed list, found from how they stand before the surnames that titles tell of."""
    people = ["Golane", "Marnor", "Carholt", "Velkin", "Dorett", "Tamsin"]
    unlisted = ["Priyanka", "Oluwaseun", "Zbigniew"]
    assert not {x.lower() for x in unlisted} & pii._GIVEN
    texts = [f"Please copy Ms. {p} on it. James {p} agreed." for p in people * 3]
    texts += [f"The draft by {g} {p} is on file." for g in unlisted for p in people]
    texts += [f"Dear Mr. {p}, all is well. Dear James {p}, all is well. Dear {p}, thanks." for p in people]
    texts += [f"The {w} Office reported it. {w} Pharma paid." for w in ("Quarterly", "Regional", "Northern") for _ in range(6)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(texts[r["doc_id"]][r["start_pos"] : r["end_pos"]]) for r in find(df).collect()}
    assert got == {*people, *(f"James {p}" for p in people), *(f"{g} {p}" for g in unlisted for p in people)}


def test_names_and_placeholders(spark):
    people = ["Dorett", "Marnor", "Carholt", "Velkin"]
    base = [f"Please copy Ms. {p} on it. The draft by James {p} is on file. A parcel came from Golley." for p in people * 3]
    texts = [
        *base, "Signed, Anna K. Velkin The office in Golley sent it.", "Nobody had met Marnor, Walter before.", "From: J. Dorett\nTo: everyone", "MARGARET CARHOLT's notes",
        "Marnor Pharma Inc sent the pallets to Golley Street.", DECOYS, "", None, "漢字 é Dr. Velkin, Tel. (334) 555-0188",
    ]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, pii_type string")
    got = {}
    for r in find(df.union(df)).collect():
        got.setdefault(r["doc_id"], set()).add((texts[r["doc_id"]][r["start_pos"] : r["end_pos"]], r["pii_type"]))
    n = len(base)
    assert got[0] == {("Dorett", "person"), ("James Dorett", "person")}
    assert got[n] == {("Anna K. Velkin", "person")}
    assert got[n + 1] == {("Marnor, Walter", "person")}
    assert got[n + 2] == {("J. Dorett", "person")}
    assert got[n + 3] == {("MARGARET CARHOLT", "person")}
    assert n + 4 not in got and n + 5 not in got and n + 6 not in got
    assert got[n + 8] == {("Velkin", "person"), ("(334) 555-0188", "phone")}
    clean = {r["doc_id"]: r["text"] for r in redact(df).collect()}
    assert clean[n + 8] == "漢字 é Dr. [PERSON], Tel. [PHONE]" and clean[n + 7] is None and clean[n + 6] == "" and clean[n + 5] == DECOYS
    assert find(df.limit(0)).count() == 0
