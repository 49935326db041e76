import datetime
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from kestrel.llm import pii

KEY = "test key"


def keyed(*what):
    return int(hashlib.sha256("|".join(map(str, (KEY, *what))).encode()).hexdigest()[:15], 16)


def feistel(x, a, b, tag):
    left, right = divmod(x, b)
    for i in range(pii.STEPS):
        if i % 2 == 0:
            left = (left + keyed(tag, i, right)) % a
        else:
            right = (right + keyed(tag, i, left)) % b
    return left * b + right


def permuted(text, alphabet, tag):
    out, base, stretch = "", len(alphabet), 17 if len(alphabet) == 10 else 12
    for i in range(0, len(text), stretch):
        part = text[i:i + stretch]
        value, half = 0, len(part) // 2
        for c in part:
            value = value * base + alphabet.index(c)
        value = feistel(value, base ** (len(part) - half), base ** half, "|".join(map(str, (tag, len(text), text[:i]))))
        spelt = ""
        for _ in part:
            value, at = divmod(value, base)
            spelt = alphabet[at] + spelt
        out += spelt
    return out


DIGITS, LETTERS = "0123456789", "abcdefghijklmnopqrstuvwxyz"


def laid_out(symbols, layout, kind):
    it = iter(symbols)
    return re.sub(kind, lambda _: next(it), layout)


def luhn_ok(d):
    ds = [int(c) for c in d][::-1]
    return (sum(ds[::2]) + sum(sum(divmod(2 * x, 10)) for x in ds[1::2])) % 10 == 0


def iban_ok(s):
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def plain_card(m):
    d = re.sub("[^0-9]", "", m)
    body = permuted(d[:-1], DIGITS, "card")
    return laid_out(next(body + c for c in DIGITS if luhn_ok(body + c)), m, "[0-9]") if luhn_ok(d) else None


def plain_date(m):
    a, b, c = map(int, re.findall("[0-9]+", m))
    iso, dot = "-" in m, "." in m
    late = not iso and not dot and a > 12
    y, mo, d = (a, b, c) if iso else (c, b, a) if dot or late else (c, a, b)
    try:
        day = datetime.date(y, mo, d)
    except ValueError:
        return None
    if not 1800 <= y <= 2199:
        return None
    start = datetime.date(1800, 1, 1)
    while True:
        day = start + datetime.timedelta(feistel((day - start).days, *pii.DAYS, "date"))
        if not late or day.day > 12:
            break
    pad = min(map(len, re.findall("[0-9]+", m))) > 1
    two = lambda n: f"{n:02d}" if pad else str(n)
    return (day.isoformat() if iso else f"{two(day.day)}.{two(day.month)}.{day.year}" if dot
            else f"{two(day.day)}/{two(day.month)}/{day.year}" if late else f"{two(day.month)}/{two(day.day)}/{day.year}")


def plain_ip(m):
    o = list(map(int, m.split(".")))
    if max(o) > 255:
        return None
    v = feistel(int.from_bytes(bytes(o), "big"), 1 << 16, 1 << 16, "ip")
    return ".".join(map(str, v.to_bytes(4, "big")))


def plain_ssn(m):
    a, g, s = map(int, m.split("-"))
    if not (1 <= a <= 899 and a != 666 and g and s):
        return None
    v = feistel(((a - (2 if a > 666 else 1)) * 99 + g - 1) * 9999 + s - 1, 898, 989901, "ssn")
    a, rest = divmod(v, 989901)
    a += 1
    return f"{a + (a > 665):03d}-{rest // 9999 + 1:02d}-{rest % 9999 + 1:04d}"


def plain_phone(m):
    code = (re.match(r"(\+[0-9]{1,3})[ .(-]", m) or [None, ""])[1]
    d = re.sub("[^0-9]", "", m[len(code):])
    return code + laid_out(permuted(d, DIGITS, "phone" + code), m[len(code):], "[0-9]") if 6 <= len(d) <= 14 else None


def plain_email(m):
    local, domain = m.split("@")
    local = local.lower()
    layout = re.sub("[0-9]", "0", re.sub("[a-z]", "a", local))
    out = laid_out(permuted(re.sub("[^a-z]", "", local), LETTERS, "email letters" + layout), local, "[a-z]")
    return laid_out(permuted(re.sub("[^0-9]", "", local), DIGITS, "email digits" + re.sub("[0-9]", "0", local)), out, "[0-9]") + "@" + domain


def run(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("found", F.lit("clash"))
    return {r.doc_id: r for r in pii.pseudonymised(docs.repartition(3), KEY).collect()}


def with_luhn(body):
    return next(body + c for c in DIGITS if luhn_ok(body + c))


@pytest.mark.parametrize("kind", ["card", "date", "ip", "ssn", "phone", "email"])
def test_values_match_a_plain_version(spark, kind):
    rnd = random.Random(kind)
    n = lambda a, b: rnd.randrange(a, b)
    digits = lambda k: "".join(rnd.choice(DIGITS) for _ in range(k))
    make = {
        "card": lambda: rnd.choice([with_luhn(digits(n(12, 19))), laid_out(with_luhn(digits(15)), "0000-0000-0000-0000", "0"), laid_out(with_luhn(digits(14)), "0000 000000 00000", "0"), digits(16)]),
        "date": lambda: rnd.choice([f"{n(1790, 2210)}-{n(0, 14):02d}-{n(0, 33):02d}", f"{n(1, 32)}.{n(1, 13)}.{n(1700, 2300)}", f"{n(1, 32):02d}/{n(1, 32):02d}/{n(1800, 2200)}", "29.02.2000", "2/9/1999", "31/12/1999"]),
        "ip": lambda: f"{n(0, 300)}.{n(0, 256)}.{n(0, 256)}.{n(0, 256)}",
        "ssn": lambda: f"{n(0, 1000):03d}-{n(0, 100):02d}-{n(0, 10000):04d}",
        "phone": lambda: rnd.choice([f"+1 ({digits(3)}) 555-{digits(4)}", f"+49 30 {digits(4)} {digits(3)}", f"({digits(3)}) {digits(3)}-{digits(4)}", f"+{digits(11)}", f"{digits(3)}.{digits(3)}.{digits(4)}"]),
        "email": lambda: rnd.choice(["a", "Bob", "x.y", "very.long+local.part.with.many.letters.in.it", "r2d2_" + digits(n(1, 25))]) + "@" + rnd.choice(["a.de", "mail7.example.com"]),
    }[kind]
    plain = {"card": plain_card, "date": plain_date, "ip": plain_ip, "ssn": plain_ssn, "phone": plain_phone, "email": plain_email}[kind]
    values = [make() for _ in range(60)]
    got = run(spark, [f"see {v}, please" for v in values])
    for i, v in enumerate(values):
        want = plain(v)
        assert got[i].clean_text == f"see {want or v}, please", v
        assert [tuple(f) for f in got[i].found] == ([(kind, v, want)] if want else [])
        if want and kind == "card":
            assert luhn_ok(re.sub("[^0-9]", "", want)) and re.sub("[0-9]", "0", want) == re.sub("[0-9]", "0", v)


def test_permutations_are_one_to_one():
    assert len({feistel(x, 9, 7, "t") for x in range(63)}) == 63
    assert len({permuted(f"{x:03d}", DIGITS, "t") for x in range(1000)}) == 1000
    start = datetime.date(1800, 1, 1)
    assert (datetime.date(2200, 1, 1) - start).days == pii.DAYS[0] * pii.DAYS[1]
    late = [f"{d}/{m:02d}/1999" for m in range(1, 13) for d in range(13, 29)]
    assert len({plain_date(x) for x in late}) == len(late) and all(int(plain_date(x)[:2]) > 12 for x in late)


def test_ibans_texts_and_links(spark):
    texts = ["DE89 3704 0044 0532 0130 00 and GB82WEST12345698765432.", "DE88 3704 0044 0532 0130 00", None, "", "no data", "4068516892505468 " * 3000,
             "+1 (843) 555-7672 170.106.47.218 4068516892505468 2353820953013749", "x4068516892505468 a04068516892505468b 1.2.3.4.5 v1.2.3", "4068516892505468",
             'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', "shti.06@mail5.example.com### (2020-01-31) 31.12.1999.", "\n4068516892505468\n4068516892505468"]
    got = run(spark, texts)
    ibans = [f.pseudonym.replace(" ", "") for f in got[0].found]
    assert len(ibans) == 2 and all(map(iban_ok, ibans)) and re.fullmatch(r"DE\d\d \d{4} \d{4} \d{4} \d{4} \d\d and GB\d\dWEST\d{14}\.", got[0].clean_text)
    assert got[1].clean_text == texts[1] and got[2].clean_text is None and got[2].found == []
    assert all(got[i].clean_text == texts[i] for i in (3, 4, 7, 9))
    card = got[8].clean_text
    assert card != texts[8] and got[5].clean_text == f"{card} " * 3000 and got[11].clean_text == f"\n{card}\n{card}"
    assert [f.kind for f in got[6].found] == ["phone", "ip", "card"] and got[6].clean_text.endswith(f" {card} 2353820953013749")
    assert [f.kind for f in got[10].found] == ["email", "date", "date"]
    assert re.fullmatch(r"[a-z]{4}\.\d\d@mail5\.example\.com### \(\d{4}-\d\d-\d\d\) \d\d\.\d\d\.\d{4}\.", got[10].clean_text)


def test_values_before_further_words_and_groups(spark):
    ibans = ["BE68 5390 0754 7034 BIC GEBABEBB", "BE68539007547034 EUR 500", "ES91 2100 0418 4502 0005 1332 EUR", "BE68 5390 0754 7034 1234 5", "AT61 1904 3002 3457 3201 AB",
             "NO93 8601 1117 947 KID 12", "MT84 MALT 0110 0001 2345 MTLC AST0 01S ABCD", "ID12 3456 BE68 5390 0754 7034"]
    phones = ["+33 1 23 45 67 89", "+49 30 123456-0", "+44 (0)20 7946 0958", "+49 89 12 34 56 78", "+55 11 9 1234 5678", "+1 843 555 7672", "+49 30 1234 5678"]
    card = "4068 5168 9250 5468"
    texts = ibans + phones + [f"{p} 5 apples" for p in phones] + [f"{p} {card}" for p in phones]
    texts += ["at 2020-01-31T12:00:00Z on", "2020-01-31Tea", f"AT12 {card}", f"ID12 {card}, XY", "AT12 4068516892505468", "+49 1234 5678 9012 34"]
    got = run(spark, texts)
    for i, text in enumerate(ibans):
        (f,) = got[i].found
        want = re.match(r"(?:ID12 3456 )?([A-Z0-9 ]*?)(?= (?:BIC|EUR|1234 5|AB|KID|ABCD)\b|$)", text)[1]
        assert (f.kind, f.original) == ("iban", want) and iban_ok(f.pseudonym.replace(" ", "")) and f.pseudonym != want, text
        assert got[i].clean_text == text.replace(want, f.pseudonym)
    secret = run(spark, [card])[0].clean_text
    for i, p in enumerate(phones):
        one, five, both = (got[len(ibans) + i + k * len(phones)] for k in range(3))
        assert [tuple(f) for f in one.found] == [("phone", p, plain_phone(p))] and one.clean_text == plain_phone(p), p
        assert five.clean_text == plain_phone(p) + " 5 apples" and both.clean_text == f"{plain_phone(p)} {secret}", p
    rest = [got[i] for i in range(len(texts) - 6, len(texts))]
    assert rest[0].clean_text == f"at {plain_date('2020-01-31')}T12:00:00Z on" and rest[1].clean_text == "2020-01-31Tea"
    assert rest[2].clean_text == f"AT12 {secret}" and rest[3].clean_text == f"ID12 {secret}, XY" and rest[4].clean_text == "AT12 " + secret.replace(" ", "")
    assert [tuple(f) for f in rest[2].found] == [("card", card, secret)] and [f.kind for f in rest[5].found] == ["phone"]


def test_columns_and_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, clean_text int, extra string")
    made = pii.pseudonymised(docs, KEY)
    assert made.columns == ["doc_id", "text", "extra", "clean_text", "found"] and made.count() == 0
    other = spark.createDataFrame([("4068516892505468",)], "text string")
    assert pii.pseudonymised(other, "a").first().clean_text != pii.pseudonymised(other, "b").first().clean_text


def test_every_private_value_of_the_given_documents_goes(spark):
    from kestrel.llm.catalog import op2_pii

    sf = "/root/testdata/sf0.01"
    before = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    changed = 0
    for r in op2_pii(spark, sf).collect():
        text = before[r.doc_id]
        private = {m for m in re.findall(r"(?<![0-9A-Za-z])\d{16}(?![0-9A-Za-z])", text) if luhn_ok(m)}
        private |= set(re.findall(r"\+1 \(\d{3}\) \d{3}-\d{4}|\b\d{1,3}(?:\.\d{1,3}){3}\b|\b[a-z0-9.]+@mail\d\.example\.com", text))
        assert not any(p in r.text for p in private) and (r.n_found > 0) == bool(private)
        assert private or r.text == text
        changed += bool(private)
    assert changed > 10
