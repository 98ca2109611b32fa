import random
from datetime import date

import pytest

from ledgerloom.llm import pii


def found(text):
    return [(k, text[a:b]) for a, b, k in pii.find_in_text(text)]


@pytest.mark.parametrize(
    "line, want",
    [
        ("Author: Ada Byron <ada.byron+x@mail.host.example>", [("person_name", "Ada Byron"), ("email", "ada.byron+x@mail.host.example")]),
        ("Signed-off-by: Byron, Ada", [("person_name", "Byron, Ada")]),
        ("    Acked-by: A. Byron <a.b@h.example>", [("person_name", "A. Byron"), ("email", "a.b@h.example")]),
        ("Reported by ADA VAN BYRON; call +44 (0)20 7946 0697 ext. 12 if", [("person_name", "ADA VAN BYRON"), ("phone", "+44 (0)20 7946 0697 ext. 12")]),
        ("Gemeldet von Ada Byron, erreichbar unter +33 1 99 00 18 87.", [("person_name", "Ada Byron"), ("phone", "+33 1 99 00 18 87")]),
        ("mail ada_byron (at) host.test or ada at host dot test", [("email", "ada_byron (at) host.test"), ("email", "ada at host dot test")]),
        ("mail ada[at]host[.]example now", [("email", "ada[at]host[.]example")]),
        ("Customer (Passport No: AB 1234567, 602-555-0113) was", [("id_number", "AB 1234567"), ("phone", "602-555-0113")]),
        ("mask('SSN 666-12-3456')", [("id_number", "666-12-3456")]),
        ("x = 'aadhaar_no=123412341234'", [("id_number", "123412341234")]),
        ("NI number QQ 64 66 10 C", [("id_number", "QQ 64 66 10 C")]),
        ("row belonged to Ada Byron, Flat 7B, 78 Sable Court Rd, Nimbrook.", [("person_name", "Ada Byron"), ("street_address", "Flat 7B, 78 Sable Court Rd, Nimbrook")]),
        ("went to H.No. 129-17/3, Sable Nagar, Pellur - 037134 instead", [("street_address", "H.No. 129-17/3, Sable Nagar, Pellur - 037134")]),
        ("an Sablestraße 30, 03392 Ombury.", [("street_address", "Sablestraße 30, 03392 Ombury")]),
        ("'Calle Sable 91, 2º B, Saint-Orvel', 1", [("street_address", "Calle Sable 91, 2º B, Saint-Orvel")]),
        ("(165 bis rue de Lower, Vexlow)", [("street_address", "165 bis rue de Lower, Vexlow")]),
        ("Ольга Петрова / nino:QQ123456D", [("person_name", "Ольга Петрова"), ("id_number", "QQ123456D")]),
        ("田中 太郎: 00 61 491 570 986", [("person_name", "田中 太郎"), ("phone", "00 61 491 570 986")]),
        ("<td>Ada Byron</td><td>030/23125313</td>", [("person_name", "Ada Byron"), ("phone", "030/23125313")]),
        # no details
        ("git clone git@forge.host.example:a/b.git", []), ("ssh deploy@build-4.host.example 'x'", []), ("url=postgres://svc:pw@db.host.example:5432/x", []),
        ("Message-ID: <20250601.1234-5@lists.host.example>", []), ("Author: tarn-ci[bot]", []), ("Author: dfennin9 via list", []), ("cc @handle, @other", []),
        ("Victoria Cache and the Jordan Index stay as they are.", []), ("Section 83, Lower Limit 4237 of the manual", []), ("Closes 4810-7048; tracker 555-7048-81.", []),
        ("@@ -271,2 +274,6 @@ def x", []), ("Date: Wed Oct 29 10:51:55 2025 +0200", []), ("27AAPFU0939F1ZV,INV-2604-00001,3601.00", []), ("+250721874944,tariff", []), ("", []),
        ("UPDATE A SET B = 4 WHERE C IS NULL; GROUP BY X HAVING COUNT(*) > 3", []), ("index 0016510347..b0b29ebef8 100644", []), ("pkg@1.2.3 @Override", []),
    ],
)
def test_lines(line, want):
    assert found(line) == want


def test_cues_lose_nothing():
    """The quick look admits every line in which the close look finds something."""
    import pyarrow as pa

    lines = [p.values[0] for p in test_lines.pytestmark[0].args[1] if hasattr(p, "values")] or [a for a, _ in test_lines.pytestmark[0].args[1]]
    text = "\r\n".join(lines)
    quick = {(line, s) for _, line, cues in pii._maybe_lines(pa.array([text], pa.string())) for s in pii.find_in_line(line, cues)}
    assert quick == {(line, s) for line in lines for s in pii.find_in_line(line)}


def test_feistel_is_a_permutation():
    key = b"k"
    for n, radix in ((1, 10), (2, 10), (3, 10), (2, 26)):
        strings = [[i // radix**j % radix for j in range(n)] for i in range(radix**n)]
        assert len({tuple(pii.feistel(s, radix, key)) for s in strings}) == radix**n
    rng = random.Random(1)
    for _ in range(300):
        s = [rng.randrange(10) for _ in range(rng.randint(1, 20))]
        assert pii.unfeistel(pii.feistel(s, 10, key), 10, key) == s


def test_pseudonyms_keep_format_and_link():
    key = b"k"
    a, b = pii.permute_number("+91 59144 26109", key, "phone"), pii.permute_number("+91 591 442 6109", key, "phone")
    assert a.startswith("+91 ") and [len(x) for x in a.split()] == [3, 5, 5] and a.replace(" ", "") == b.replace(" ", "") and a != "+91 59144 26109"
    assert pii.permute_number("QQ 64 66 10 C", key, "id_number")[2:6:3] == "  " and pii.permute_number("02 ext. 5", key, "phone").endswith(" ext. 5")
    days = {pii.permute_date(date(2000, 1, d), key) for d in range(1, 29)}
    assert len(days) == 28
    assert pii.placeholder("email", "A@b.example", key) == pii.placeholder("email", "a@B.example", key)


def test_redact():
    text = "Author: Ada Byron <a@h.example>\r\nborn on 1990-02-03, call 602-555-0113\n"
    out = pii.redact(text, b"k")
    assert "Ada" not in out and "a@h" not in out and "555-0113" not in out and "<BIRTH_DATE:" in out and out.count("\n") == 2 and "\r\n" in out
    assert pii.redact(None, b"k") is None and pii.redact("plain", b"k") == "plain" and pii.redact(text, b"k") == out != pii.redact(text, b"other")


def test_operators(spark):
    text = "Author: Ada Byron <a@h.example>\nAuthor: Ada Byron <a@h.example>\n"
    df = spark.createDataFrame([(1, text, "x"), (1, text, "x"), (2, None, "x"), (3, "", "x"), (None, " \n", "x"), (4, "y" * 300_000 + "\nSSN 666-12-3456", "x")], "doc_id bigint, text string, kind string")
    got = sorted((r["doc_id"], r["kind"], r["found_text"]) for r in pii.find_details(df, b"k").collect())
    assert got == [(1, "email", "a@h.example")] * 2 + [(1, "person_name", "Ada Byron")] * 2 + [(4, "id_number", "666-12-3456")]
    out = {r["doc_id"]: r["text"] for r in pii.replace_details(df, b"k").collect()}
    assert out[2] is None and out[3] == "" and "666" not in out[4][-40:] and "Ada" not in out[1]
    assert pii.find_details(df.limit(0), b"k").count() == 0


@pytest.mark.parametrize(
    "line",
    ["Signed-off-by: Byron, A.", "Author: Ada d'Artagnan", "by ಅದಾ ಬೈರನ್", "by આદા બાયરન", "by ਅਦਾ ਬਾਇਰਨ", "by അദാ ബൈറൺ", "by ଆଦା ବାଇରନ", "by අදා බයිරන්", "mail ada-@host.example", "mail ada at host[.]example",
     "user_ssn: 666-12-3456", "aadaar: 123412341234", "call 00123456 now", "call 0044/20/79460697 now", "went to 12quater impasse de la Tour Saint Germain, Vexlow"],
)
def test_cues_admit_what_the_close_look_finds(line):
    import pyarrow as pa

    want = pii.find_in_line(line)
    assert want and [pii.find_in_line(x, cues) for _, x, cues in pii._maybe_lines(pa.array([line]))] == [want]


PROSE = {
    "seen at Grace Hopper's desk": ("person_name", "Grace Hopper"), "Reviewed by Grace Hopper yesterday": ("person_name", "Grace Hopper"),
    "Please email Jean-Luc Picard about it": ("person_name", "Jean-Luc Picard"), "- Dr. Grace Hopper, Principal Engineer": ("person_name", "Grace Hopper"),
    "mail josé.garcía@example.com please": ("email", "josé.garcía@example.com"), "tel:+1.415.555.0134": ("phone", "+1.415.555.0134"), "my phone: 9876543210": ("phone", "9876543210"),
    "ship to 1600 Amphitheatre Parkway, Mountain View, CA 94043": ("street_address", "1600 Amphitheatre Parkway, Mountain View, CA 94043"), "paid by 529.982.247-25": ("id_number", "529.982.247-25"),
}


@pytest.mark.parametrize("line", PROSE)
def test_prose(line):
    kind, text = PROSE[line]
    assert [(k, line[a:b]) for a, b, k in pii.find_in_line(line)] == [(kind, text)]
    assert text not in pii.redact(line, b"k")


@pytest.mark.parametrize("line", ["ref 529.982.247-26", "with Apache Spark for this", "merge to Main Branch today", "Called by Spark SQL at startup", "call Main Street at noon"])
def test_prose_without_details(line):
    assert pii.find_in_line(line) == []


def test_nothing_of_a_number_stays_in_clear():
    key = pii.secret_key(b"k")
    for text in ("abcde1234f", "qq 64 66 10 c", "ABCDE1234F"):
        new = pii.permute_number(text, key, "id_number")
        assert [c.islower() for c in new] == [c.islower() for c in text] and sum(a == b for a, b in zip(new, text, strict=True) if a.isalnum()) < 4
    assert pii.permute_number("abcde1234f", key, "id_number").upper() == pii.permute_number("ABCDE1234F", key, "id_number")
    # Numbers whose check digits are right go to such numbers, each to another.
    right = {"aadhaar": "2341 2341 2346", "pesel": "44051401359", "cpf": "529.982.247-25", "dni": "12345678Z", "nie": "X1234567L", "bsn": "111222333", "nir": "2 55 08 14 168 025 38"}
    for kind, text in right.items():
        assert pii.checked_kind(text) == kind and pii.checked_kind(pii.permute_number(text, key, "id_number")) == kind
    valid = [t for t in (f"{i:08d}{c}" for i in range(300) for c in "TRWAG") if pii.checked_kind(t) == "dni"]
    assert len({pii.permute_number(t, key, "id_number") for t in valid}) == len(valid) > 50


def test_secret_and_dates():
    assert pii.redact("a@b.example", b"x" * 64 + b"1") != pii.redact("a@b.example", b"x" * 64 + b"2")
    one, *others = [pii.redact(f"born {d}", b"k") for d in ("1990-02-03", "03/02/1990", "3 Feb 1990", "February 3, 1990", "03.02.1990")]
    year, month, day = one[17:-1].split("-")
    assert others[0] == f"born <BIRTH_DATE:{day}/{month}/{year}>" and others[3] == f"born <BIRTH_DATE:{day}.{month}.{year}>" and all(year in o and "1990" not in o for o in others)
    assert pii.redact("born 31/02/1990", b"k") == "born 31/02/1990"


def test_found_and_replaced_are_one(spark):
    lines = [*PROSE, "Author: Ada Byron <ada@byron.example>", "x", "", "PAN: ABCPD1234F\r\nborn 1990-02-03"]
    df = spark.createDataFrame([(1, "\n".join(lines)), (2, None), (3, "Fix")], "doc_id long, text string")
    found, new = pii.find_details(df, b"k").collect(), {r["doc_id"]: r["text"] for r in pii.replace_details(df, b"k").collect()}
    assert new[2] is None and new[3] == "Fix" and new[1] == pii.redact("\n".join(lines), b"k")
    assert len(found) >= len(PROSE) - 1 and all(r["found_text"] not in new[1] and r["placeholder"] in new[1] for r in found)
