"""Personal data: format-preserving pseudonyms by keyed Feistel permutations, in DataFrame functions only.

A pattern finds candidates, a validation of its kind decides, and what passes is replaced by another valid value of
the same format; everything else in a text stays as it is:

- payment cards: 13 to 19 digits, in a row or in groups, with a right Luhn digit; the digit is worked out anew;
- IBANs of their country's length with a right remainder by 97; country, layout and letters stay, the check digits
  are worked out anew; a card inside something that only looks like an IBAN counts as a card;
- US social security numbers of the ranges ever issued, and IPv4 addresses with octets up to 255;
- phone numbers, with a country code (which stays) or in North American layout;
- calendar dates of 1800 to 2199 as y-m-d (also before a time's T), d.m.y or m/d/y (d/m/y where the first number is
  above 12);
- the letters and digits of the part of an e-mail address before the @ (in lower case).

A permutation writes its value as a pair (l, r) of Z_a x Z_b and adds, in turn, a keyed hash of one half to the
other; each step can be undone, so within a kind and format different values get different pseudonyms and equal
values the same one in every document. Who knows the key can undo them, so it is a parameter, to be kept like a
password. Any 400 years have 146,097 = 189 x 773 days, so dates need no search for a valid result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STEPS = 10
# What candidates look like. No candidate touches further letters or digits.
EMAIL = r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.)+[A-Za-z]{2,24}"
# Length of an IBAN by country (the SWIFT registry). A candidate takes no character beyond it.
IBAN_LENGTHS = {15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
                22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
                26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
                30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}
LISTED = "(?:" + "|".join(IBAN_LENGTHS.values()).replace(" ", "|") + ")[0-9]{2}"
# Countries outside the registry prescribe no length: groups up to the next capital, digit or listed country.
IBAN = ("(?=[A-Z]{2}[0-9]{2})(?:"
        + "|".join(f"(?:{c.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{(n - 4) // 4}}}" + (f" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "") for n, c in IBAN_LENGTHS.items())
        + f"|(?!{LISTED})[A-Z]{{2}}[0-9]{{2}}(?:(?! {LISTED}) ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?)")
CARD = r"[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}"
# Digits in groups of any size. After the first five none belongs to the last card in groups; a last group of one digit needs a mark before it.
DIGIT, NEXT = "(?:[ .-]?[0-9])", r"(?:(?! [0-9]{4}(?:(?:[ -][0-9]{4}){3}|[ -][0-9]{6}[ -][0-9]{5})(?![A-Za-z0-9]| [0-9]{4}(?![0-9])))[ .-]?[0-9])"
PHONE = (r"\+1[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}"
         r"|\+[0-9]{1,3}[ .-]?\([0-9]{1,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}"
         rf"|\+[0-9]{{1,3}}[ .-]?\([0-9]{{1,4}}\){DIGIT}{{5}}{NEXT}{{0,5}}(?<! [0-9])"
         rf"|\+[0-9]{{1,3}}[ .-][0-9]{DIGIT}{{5}}{NEXT}{{0,8}}(?<! [0-9])|\+[0-9]{DIGIT}{{5}}{NEXT}{{0,8}}(?<! [0-9])"
         r"|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}")
DATE = r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}([./])[0-9]{1,2}\1[0-9]{4}"
IP = r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"
SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}"
KINDS = {"email": EMAIL, "iban": IBAN, "phone": PHONE, "date": DATE, "ip": IP, "ssn": SSN, "card": CARD}
CANDIDATE = (rf"(?<![A-Za-z0-9._%+-]){EMAIL}(?![A-Za-z0-9])|(?<![A-Za-z0-9])(?:{IBAN})(?![A-Za-z0-9])"
             rf"|(?<![A-Za-z0-9+])(?<![0-9][.-])(?:{PHONE}|{DATE}|{IP}|{SSN}|{CARD})(?![A-Za-z0-9]|[.-][0-9])"
             r"|(?<![A-Za-z0-9+])(?<![0-9][.-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?=T[0-9]{2})")
INSIDE = rf"(?<=[A-Z0-9] )(?:{CARD})(?![A-Za-z0-9])"  # a card in an IBAN's candidate, the only kind that fits there
DAYS_FROM, DAYS = "1800-01-01", (189, 773)


def keyed(key: str, *what: Column) -> Column:
    """A number from 0 to 2**60 - 1."""
    hashed = F.sha2(F.concat_ws("|", F.lit(key), *[w.cast("string") for w in what]), 256)
    return F.conv(F.substring(hashed, 1, 15), 16, 10).cast("long")


def whole(x: Column, by: Column) -> Column:
    """x div by, in whole numbers (a quotient of doubles is not exact beyond 2**53)."""
    return F.call_function("div", x, by)


def feistel(x: Column, a: Column, b: Column, key: str, tag: Column) -> Column:
    """A permutation of the numbers from 0 to a * b - 1, chosen by ``key`` and ``tag``."""
    def step(at: Column, i: Column) -> Column:
        left, right = at["l"], at["r"]
        return F.struct(F.when(i % 2 == 0, F.pmod(left + keyed(key, tag, i, right) % a, a)).otherwise(left).alias("l"),
                        F.when(i % 2 == 1, F.pmod(right + keyed(key, tag, i, left) % b, b)).otherwise(right).alias("r"))
    start = F.struct(whole(x, b).alias("l"), F.pmod(x, b).alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(STEPS - 1)), start, step, lambda at: at["l"] * b + at["r"])


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def laid_out(symbols: Column, layout: Column, kind: str) -> Column:
    """``layout`` with its characters of class ``kind`` replaced, in order, by the characters of ``symbols``."""
    return F.array_join(F.zip_with(F.split(layout, kind, -1), F.concat(F.split(symbols, "(?!$)"), F.array(F.lit(""))), lambda gap, s: F.concat(gap, s)), "")


def permuted(text: Column, base: int, first: int, key: str, tag: Column) -> Column:
    """A permutation of the strings of ``text``'s length over ``base`` characters from code ``first`` on. Longer ones
    are cut into stretches, each permuted by what stands before it too."""
    stretch = 17 if base == 10 else 12
    powers = F.array(*[F.lit(base ** i).cast("long") for i in range(stretch + 1)])
    power = lambda n: F.element_at(powers, n + 1)

    def one(i: Column) -> Column:
        part = F.substring(text, i * stretch + 1, F.lit(stretch))
        n = F.char_length(part)
        value = F.aggregate(F.split(part, "(?!$)"), F.lit(0).cast("long"), lambda v, c: v * base + (F.ascii(c) - first))
        half = F.floor(n / 2).cast("int")
        to = feistel(value, power(n - half), power(half), key, F.concat_ws("|", tag, F.char_length(text), F.substring(text, F.lit(1), i * stretch)))
        # One struct holds the result, so that it is worked out once and not for every character.
        spelt = lambda s: F.array_join(F.transform(F.sequence(s["n"] - 1, F.lit(0), F.lit(-1)), lambda j: F.char(F.lit(first) + whole(s["v"] % power(j + 1), power(j)).cast("int"))), "")
        return F.array_join(F.transform(F.array(F.struct(to.alias("v"), n.alias("n"))), spelt), "")

    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.char_length(text) - 1) / stretch).cast("int")), one)
    return F.when(F.char_length(text) == 0, text).otherwise(F.array_join(pieces, ""))


def luhn(digits: Column) -> Column:
    """Luhn sum modulo 10 of digits whose last one is not doubled."""
    n = F.char_length(digits)
    def value(i):
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = (n - i) % 2 == 1
        return F.when(twice & (d > 4), 2 * d - 9).when(twice, 2 * d).otherwise(d)
    return F.aggregate(F.transform(F.sequence(F.lit(1), n), value), F.lit(0), lambda s, v: s + v) % 10


def mod97(text: Column) -> Column:
    """The number that digits and letters (10 to 35) spell, modulo 97."""
    def step(rest, c):
        return F.when(c < "A", (rest * 10 + c.cast("int")) % 97).otherwise((rest * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.split(text, "(?!$)"), F.lit(0), step)


def once(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, though the result may name it often."""
    return F.element_at(F.transform(F.array(value), use), 1)


def new_card(m: Column, key: str) -> Column:
    def renew(d):
        body = permuted(F.substring(d, F.lit(1), F.char_length(d) - 1), 10, 48, key, F.lit("card"))
        return once(body, lambda b: F.concat(b, F.pmod(-luhn(F.concat(b, F.lit("0"))), F.lit(10)).cast("string")))
    return once(digits_of(m), lambda d: F.when(luhn(d) == 0, laid_out(renew(d), m, "[0-9]")))


def new_iban(m: Column, key: str) -> Column:
    def renew(s):
        body = F.substring(s, 5, 40)
        to = once(digits_of(body), lambda d: laid_out(permuted(d, 10, 48, key, F.concat(F.lit("iban"), F.regexp_replace(body, "[0-9]", "0"), F.substring(s, 1, 2))), body, "[0-9]"))
        whole = once(to, lambda b: F.concat(F.substring(s, 1, 2), F.lpad((98 - mod97(F.concat(b, F.substring(s, 1, 2), F.lit("00")))).cast("string"), 2, "0"), b))
        return laid_out(whole, m, "[A-Z0-9]")
    bare = F.regexp_replace(m, " ", "")
    return once(bare, lambda s: F.when(F.char_length(s).between(15, 34) & (mod97(F.concat(F.substring(s, 5, 40), F.substring(s, 1, 4))) == 1), renew(s)))


def new_phone(m: Column, key: str) -> Column:
    code = F.regexp_extract(m, r"^(\+[0-9]{1,3})[ .(-]", 1)
    rest = F.substring(m, F.char_length(code) + 1, F.lit(40))
    return once(digits_of(rest), lambda d: F.when(F.char_length(d).between(6, 14), F.concat(code, laid_out(permuted(d, 10, 48, key, F.concat(F.lit("phone"), code)), rest, "[0-9]"))))


def new_date(m: Column, key: str) -> Column:
    numbers = F.regexp_extract_all(m, F.lit("([0-9]+)"), 1)
    part = lambda i: F.element_at(numbers, i).cast("int")
    iso, dot = F.contains(m, F.lit("-")), F.contains(m, F.lit("."))
    late = ~iso & ~dot & (part(1) > 12)  # d/m/y, as m/d/y cannot be meant
    year, month, day = (F.when(iso, part(1)).otherwise(part(3)), F.when(iso | dot | late, part(2)).otherwise(part(1)),
                        F.when(iso, part(3)).when(dot | late, part(1)).otherwise(part(2)))
    when = F.try_make_timestamp_ntz(year, month, day, F.lit(0), F.lit(0), F.lit(0)).cast("date")
    days = lambda d: F.datediff(d, F.lit(DAYS_FROM).cast("date")).cast("long")
    turn = lambda x: feistel(x, F.lit(DAYS[0]).cast("long"), F.lit(DAYS[1]).cast("long"), key, F.lit("date"))
    as_date = lambda x: F.date_add(F.lit(DAYS_FROM).cast("date"), x.cast("int"))
    # d/m/y must stay recognisable: go on along the permutation until the day is above 12 again.
    walk = lambda x: F.aggregate(F.sequence(F.lit(1), F.lit(200)), F.struct(x.alias("x"), F.lit(False).alias("end")),
                                 lambda s, i: F.when(s["end"], s).otherwise(once(turn(s["x"]), lambda y: F.struct(y.alias("x"), (F.dayofmonth(as_date(y)) > 12).alias("end")))), lambda s: s["x"])
    two = lambda n: F.when(F.array_min(F.transform(numbers, F.char_length)) > 1, F.lpad(n.cast("string"), 2, "0")).otherwise(n.cast("string"))
    written = lambda d: (F.when(iso, F.date_format(d, "yyyy-MM-dd"))
                         .when(dot, F.concat_ws(".", two(F.dayofmonth(d)), two(F.month(d)), F.year(d)))
                         .when(late, F.concat_ws("/", two(F.dayofmonth(d)), two(F.month(d)), F.year(d)))
                         .otherwise(F.concat_ws("/", two(F.month(d)), two(F.dayofmonth(d)), F.year(d))))
    return once(when, lambda d: F.when(d.isNotNull() & F.year(d).between(1800, 2199), once(as_date(F.when(late, walk(days(d))).otherwise(turn(days(d)))), written)))


def new_ip(m: Column, key: str) -> Column:
    octets = F.split(m, r"\.")
    value = F.aggregate(octets, F.lit(0).cast("long"), lambda v, o: v * 256 + o.cast("long"))
    half = F.lit(1 << 16).cast("long")
    dotted = lambda v: F.concat_ws(".", *[F.shiftright(v, s).bitwiseAND(F.lit(255).cast("long")) for s in (24, 16, 8, 0)])
    return F.when(F.forall(octets, lambda o: o.cast("int") < 256), once(feistel(value, half, half, key, F.lit("ip")), dotted))


def new_ssn(m: Column, key: str) -> Column:
    n = lambda at, k: F.substring(m, at, k).cast("long")
    area, group, serial = n(1, 3), n(5, 2), n(8, 4)
    value = ((area - F.when(area > 666, 2).otherwise(1)) * 99 + group - 1) * 9999 + serial - 1
    pad = lambda x, k: F.lpad(x.cast("string"), k, "0")
    spelt = lambda v: F.concat_ws("-", once(whole(v, F.lit(989901)) + 1, lambda a: pad(F.when(a > 665, a + 1).otherwise(a), 3)),
                                  pad(whole(v, F.lit(9999)) % 99 + 1, 2), pad(v % 9999 + 1, 4))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    return F.when(valid, once(feistel(value, F.lit(898).cast("long"), F.lit(989901).cast("long"), key, F.lit("ssn")), spelt))


def new_email(m: Column, key: str) -> Column:
    def renew(local):
        layout = F.regexp_replace(F.regexp_replace(local, "[a-z]", "a"), "[0-9]", "0")
        letters = permuted(F.regexp_replace(local, "[^a-z]", ""), 26, 97, key, F.concat(F.lit("email letters"), layout))
        return once(laid_out(letters, local, "[a-z]"), lambda s: laid_out(permuted(digits_of(local), 10, 48, key, F.concat(F.lit("email digits"), F.regexp_replace(local, "[0-9]", "0"))), s, "[0-9]"))
    at = F.instr(m, "@")
    return F.concat(once(F.lower(F.substring(m, F.lit(1), at - 1)), renew), F.substring(m, at, F.lit(200)))


MAKERS = {"email": new_email, "iban": new_iban, "phone": new_phone, "date": new_date, "ip": new_ip, "ssn": new_ssn, "card": new_card}


def pseudonym(m: Column, key: str) -> Column:
    """struct(kind, original, pseudonym) of a candidate by the first kind whose pattern and validation it passes; a
    card inside a candidate for an IBAN is the original then; of none: null, and twice the candidate itself."""
    tried = [(k, m, F.when(F.rlike(m, F.lit(f"^(?:{p})$")), MAKERS[k](m, key))) for k, p in KINDS.items()]
    card = F.regexp_extract(m, INSIDE, 0)
    tried.append(("card", card, F.when(F.rlike(m, F.lit("^[A-Z]")) & (card != ""), new_card(card, key))))
    each = F.array(*[F.struct(F.lit(k).alias("kind"), o.alias("original"), v.alias("pseudonym")) for k, o, v in tried])
    none = F.array(F.struct(F.lit(None).cast("string").alias("kind"), m.alias("original"), m.alias("pseudonym")))
    return F.element_at(F.concat(F.filter(each, lambda p: p["pseudonym"].isNotNull()), none), 1)


def pseudonymised(docs: DataFrame, key: str, text_col: str = "text", out: str = "clean_text", found: str = "found") -> DataFrame:
    """``docs`` with ``out``, the text with every validated value replaced, and ``found``: an array of structs (kind,
    original, pseudonym) in order of place. Null text: null and nothing found; texts without candidates are not taken
    apart. Input columns named like these two are replaced; rows are neither joined nor shuffled, repeated rows and
    null ids stay as they are."""
    text = F.col(text_col)
    seen = F.regexp_extract_all(text, F.lit(f"(?:{CANDIDATE})"), 0)
    df = docs.withColumn("_pii_seen", F.when(F.rlike(text, F.lit("[0-9@]")), seen))
    df = df.withColumn("_pii_new", F.transform("_pii_seen", lambda m: pseudonym(m, key)))
    gaps = F.split(text, CANDIDATE, -1)
    put = F.zip_with("_pii_seen", "_pii_new", lambda m, p: F.replace(m, p["original"], p["pseudonym"]))
    filled = F.zip_with(gaps, F.concat(put, F.array(F.lit(""))), lambda g, v: F.concat(g, v))
    clean = F.when(F.size("_pii_new") > 0, F.array_join(filled, "")).otherwise(text)
    hits = F.filter(F.coalesce("_pii_new", F.array()), lambda p: p["kind"].isNotNull())
    return df.withColumn("_pii_clean", clean).withColumn("_pii_found", hits).drop("_pii_seen", "_pii_new", out, found).withColumnsRenamed({"_pii_clean": out, "_pii_found": found})
