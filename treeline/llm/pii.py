"""Format-preserving Feistel pseudonyms, in DataFrame functions only.

Validated values are permuted under a key within their own format, so that equal values stay
linked across documents and distinct ones stay distinct:

=========  ================================================  =====================================
kind       validated by                                      permuted
=========  ================================================  =====================================
email      address shape                                     letters and digits of the local part
card       13 to 19 digits, Luhn sum                         all digits but the check digit, which
                                                             is computed anew
iban       country, its length, mod-97 sum                   account part; check digits anew
ssn        area, group and serial ranges                     index among all valid numbers
ip         four octets up to 255                             the 32-bit address
phone      +country or (area), 8 to 15 digits                all digits but the country code
date       a calendar day in the years 1000 to 2999          day number in its 400-year cycle
=========  ================================================  =====================================

Values that fail validation stay as they are.  What follows a value is no part of it: accounts have their
country's length, phone numbers 15 digits at most and end before another value's shape, and runs of fours are searched for
cards from each of them on; one takes up to three more digits only where it fails without them.  Each permutation is a keyed Feistel network: two
halves, each in turn moved by a SHA-256 digest of key, kind, round and other half, so it can be
undone by who has the key (``reverse=True``; a card in a longer run of fours may be
read otherwise then).  Dates use Z(189) x Z(773) = 146097,
the days of a 400-year cycle; social security numbers Z(88902) x Z(9999).  No cycle walking.

Null text gives null; empty text stays empty.  Rows are independent, so ties, repeated rows, empty
tables and long texts need nothing special; other columns pass through
untouched, except that one named _pii is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeline.llm.common import fresh

ROUNDS = 8
KINDS = ("email", "card", "iban", "ssn", "ip", "phone", "date")
_B, _E = r"(?<![0-9A-Za-z_])", r"(?![0-9A-Za-z_])"

# Lengths of account numbers by country, and the countries that have each.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC",
    32: "LC", 33: "RU",
}


def _iban_pattern() -> str:
    """Accounts of just their country's length, in fours or without spaces, so no word after one is taken for
    part of it; of other countries those without spaces."""
    known = []
    for length, countries in IBAN_LENGTHS.items():
        fours, rest = divmod(length - 4, 4)
        known.append(f"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{fours}}}" + (f" ?[A-Z0-9]{{{rest}}}" if rest else ""))
    own = "|".join(c.replace(" ", "|") for c in IBAN_LENGTHS.values())
    return _B + rf"(?=[A-Z]{{2}}[0-9]{{2}})(?:{'|'.join(known)}|(?!{own})[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{11,30}})" + _E


def _date_shapes() -> str:
    """Both orders with each separator, without back references: group numbers shift inside an alternation."""
    by_sep = []
    for sep in ("-", "/", r"\."):
        by_sep.append(r"[12][0-9]{3}" + sep + r"[01]?[0-9]" + sep + r"[0-3]?[0-9]")
        by_sep.append(r"[0-3]?[0-9]" + sep + r"[0-3]?[0-9]" + sep + r"[12][0-9]{3}")
    return "|".join(by_sep)


_CARD = r"[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3,}(?:[ -][0-9]{1,3})?|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}"
_IP = r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}"


def _phone_abroad(other: str) -> str:
    """Up to 15 digits that don't go on into another value: no group begins like ``other``, or after a space like an address."""
    stop = rf"(?!(?:{_date_shapes()}|[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}{other}){_E})"
    return rf"\+[0-9](?:(?:[ .-]?\(|\)[ .-]?|[.-]{stop}| {stop}(?!{_IP}{_E}))?[0-9]){{7,14}}\)?{_E}"


# Java patterns; each is tried at a word's start only.
PATTERNS = {
    "email": r"(?<![0-9A-Za-z._%+-])[0-9A-Za-z_%+-][0-9A-Za-z._%+-]{0,63}@(?:[0-9A-Za-z-]{1,63}\.){1,8}[A-Za-z]{2,24}" + _E,
    "iban": _iban_pattern(),
    "ip": rf"(?<![0-9A-Za-z_.]){_IP}(?![0-9A-Za-z_]|\.[0-9])",
    "date": _B + f"(?:{_date_shapes()})" + _E,
    "ssn": r"(?<![0-9A-Za-z_-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z_-])",
    "card": rf"(?<![0-9A-Za-z_-])(?:{_CARD})" + _E,
    "phone": r"(?<![0-9A-Za-z_+])(?:(?:\+1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}"
    # Not into a card either, unless nothing is left then: fours may belong to both.
    + f"|{_phone_abroad('|' + _CARD)}|{_phone_abroad('')})" + _E,
}
#: A run of fours is searched for cards: one may begin at any of them, and end in up to three digits.
_FOURS = r"^[0-9]{4}(?:[ -][0-9]{4}){3,}(?:[ -][0-9]{1,3})?$"
_FOUND = "array<struct<kind:string,value:string>>"


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _digest_int(key: str, kind: str, j: Column, other: Column) -> Column:
    """48 bits of a keyed digest as long."""
    text = F.concat_ws("|", F.lit(key), F.lit(kind), j.cast("string"), other.cast("string"))
    return F.conv(F.substring(F.sha2(text, 256), 1, 12), 16, 10).cast("bigint")


def _rounds(reverse: bool) -> Column:
    order = range(ROUNDS)
    return F.array(*[F.lit(j) for j in (reversed(order) if reverse else order)])


def feistel_pair(a: Column, b: Column, size_a: int, size_b: int, key: str, kind: str, reverse: bool = False) -> Column:
    """Permutes (a, b) in Z(size_a) x Z(size_b); a struct (a, b) of longs."""
    sign = -1 if reverse else 1

    def step(acc: Column, j: Column) -> Column:
        on_a = F.pmod(acc["a"] + sign * F.pmod(_digest_int(key, kind, j, acc["b"]), F.lit(size_a)), F.lit(size_a))
        on_b = F.pmod(acc["b"] + sign * F.pmod(_digest_int(key, kind, j, acc["a"]), F.lit(size_b)), F.lit(size_b))
        even = j % 2 == 0
        return F.struct(
            F.when(even, on_a).otherwise(acc["a"]).cast("bigint").alias("a"),
            F.when(even, acc["b"]).otherwise(on_b).cast("bigint").alias("b"),
        )

    return F.aggregate(_rounds(reverse), F.struct(a.cast("bigint").alias("a"), b.cast("bigint").alias("b")), step)


def _shift(ch: Column, by: Column) -> Column:
    """A digit, lower or upper case letter moved within its class; anything else as it is."""
    o = F.ascii(ch)

    def rot(base: int, n: int) -> Column:
        return F.char(F.pmod(o - base + by, F.lit(n)) + base)

    return (
        F.when(o.between(48, 57), rot(48, 10)).when(o.between(97, 122), rot(97, 26)).when(o.between(65, 90), rot(65, 26)).otherwise(ch)
    )


def feistel_text(s: Column, key: str, kind: str, reverse: bool = False) -> Column:
    """Permutes a text of up to 64 letters and digits, each character within its class."""
    sign = -1 if reverse else 1

    def moved(part: Column, other: Column, j: Column) -> Column:
        pad = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), j.cast("string"), other), 256)
        spots = F.when(F.length(part) > 0, F.sequence(F.lit(1), F.length(part))).otherwise(F.array().cast("array<int>"))
        return F.array_join(
            F.transform(
                spots,
                lambda i: _shift(F.substring(part, i, F.lit(1)), sign * F.conv(F.substring(pad, 2 * i - 1, F.lit(2)), 16, 10).cast("int")),
            ),
            "",
        )

    def step(acc: Column, j: Column) -> Column:
        even = j % 2 == 0
        return F.struct(
            F.when(even, moved(acc["a"], acc["b"], j)).otherwise(acc["a"]).alias("a"),
            F.when(even, acc["b"]).otherwise(moved(acc["b"], acc["a"], j)).alias("b"),
        )

    half = F.floor(F.length(s) / 2).cast("int")
    start = F.struct(F.substring(s, F.lit(1), half).alias("a"), F.substring(s, half + 1, F.length(s)).alias("b"))
    return F.aggregate(_rounds(reverse), start, step, lambda acc: F.concat(acc["a"], acc["b"]))


def _single(c: Column, key: str, kind: str, reverse: bool) -> Column:
    """Permutes one digit or letter within its class."""

    def within(base: int, half: int) -> Column:
        x = F.ascii(c) - base
        pair = feistel_pair(F.floor(x / half), x % half, 2, half, key, f"{kind}.{base}", reverse)
        return _let(pair, lambda p: F.char(p["a"] * half + p["b"] + base))

    o = F.ascii(c)
    return F.when(o < 58, within(48, 5)).when(o < 91, within(65, 13)).otherwise(within(97, 13))


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _into(form: Column, chars: Column, pattern: str) -> Column:
    """form with its characters of the class ``pattern`` replaced by those of ``chars`` in order."""
    return F.array_join(
        F.transform(
            F.sequence(F.lit(1), F.length(form)),
            lambda i: _let(
                F.substring(form, i, F.lit(1)),
                lambda c: F.when(
                    c.rlike(pattern),
                    F.substring(chars, F.length(F.regexp_replace(F.substring(form, F.lit(1), i), pattern.replace("[", "[^"), "")), F.lit(1)),
                ).otherwise(c),
            ),
        ),
        "",
    )


def _luhn(body: Column) -> Column:
    """The check digit for ``body`` (digits before it)."""
    n = F.length(body)
    total = F.aggregate(
        F.sequence(F.lit(1), n),
        F.lit(0),
        lambda acc, i: acc
        + _let(
            F.substring(body, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 0, 2).otherwise(1),
            lambda d: F.when(d > 9, d - 9).otherwise(d),
        ),
    )
    return F.pmod(10 - total % 10, F.lit(10)).cast("string")


def _mod97(s: Column) -> Column:
    """Digits as they are, A = 10 ... Z = 35, the whole modulo 97."""
    return F.aggregate(
        F.sequence(F.lit(1), F.length(s)),
        F.lit(0),
        lambda acc, i: _let(
            F.ascii(F.substring(s, i, F.lit(1))),
            lambda o: F.when(o < 58, (acc * 10 + o - 48) % 97).otherwise((acc * 100 + o - 55) % 97),
        ),
    )


def _card(m: Column, key: str, reverse: bool) -> Column:
    def by_digits(d: Column) -> Column:
        body = F.substring(d, F.lit(1), F.length(d) - 1)
        new = _let(feistel_text(body, key, "card", reverse), lambda b: F.concat(b, _luhn(b)))
        return F.when(_luhn(body) == F.substring(d, F.length(d), F.lit(1)), _let(new, lambda x: _into(m, x, "[0-9]")))

    return _let(_digits(m), by_digits)


def _iban(m: Column, key: str, reverse: bool) -> Column:
    def by_chars(s: Column) -> Column:
        country, account = F.substring(s, 1, 2), F.substring(s, F.lit(5), F.length(s))
        checked = _mod97(F.concat(account, F.substring(s, 1, 4))) == 1
        new = _let(
            feistel_text(account, key, "iban", reverse),
            lambda b: F.concat(country, F.lpad((98 - _mod97(F.concat(b, country, F.lit("00")))).cast("string"), 2, "0"), b),
        )
        return F.when(F.length(s).between(15, 34) & checked, _let(new, lambda x: _into(m, x, "[0-9A-Z]")))

    return _let(F.replace(m, F.lit(" "), F.lit("")), by_chars)


def _ssn(m: Column, key: str, reverse: bool) -> Column:
    area, group, serial = (F.substring(m, a, n).cast("bigint") for a, n in ((1, 3), (5, 2), (8, 4)))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    rank = area - 1 - F.when(area > 666, 1).otherwise(0)
    pair = feistel_pair(rank * 99 + group - 1, serial - 1, 898 * 99, 9999, key, "ssn", reverse)

    def text(p: Column) -> Column:
        r = F.floor(p["a"] / 99)
        return F.format_string("%03d-%02d-%04d", r + 1 + F.when(r >= 665, 1).otherwise(0), p["a"] % 99 + 1, p["b"] + 1)

    return F.when(valid, _let(pair, text))


def _ip(m: Column, key: str, reverse: bool) -> Column:
    def by_octets(o: Column) -> Column:
        pair = feistel_pair(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, key, "ip", reverse)
        return F.when(
            F.forall(o, lambda x: x <= 255),
            _let(
                pair,
                lambda p: F.concat_ws(
                    ".", *[v.cast("bigint").cast("string") for v in (F.floor(p["a"] / 256), p["a"] % 256, F.floor(p["b"] / 256), p["b"] % 256)]
                ),
            ),
        )

    return _let(F.transform(F.split(m, r"\."), lambda x: x.cast("bigint")), by_octets)


def _phone(m: Column, key: str, reverse: bool) -> Column:
    code = F.regexp_extract(m, r"^\+[0-9]{1,3}(?=[ .(-])", 0)
    rest = F.substring(m, F.length(code) + 1, F.length(m))
    valid = F.length(_digits(m)).between(8, 15) & m.rlike(r"^[+(]|[ .-]") & (m.startswith("+") | m.rlike(r"^\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-][0-9]{4}$"))
    return F.when(valid, F.concat(code, _let(feistel_text(_digits(rest), key, "phone", reverse), lambda x: _into(rest, x, "[0-9]"))))


def _email(m: Column, key: str, reverse: bool) -> Column:
    local = F.substring_index(m, "@", 1)
    chars = F.regexp_replace(local, "[^0-9A-Za-z]", "")
    # One character has no other half to mix it with.
    new = F.when(F.length(chars) == 1, _single(chars, key, "email", reverse)).otherwise(feistel_text(chars, key, "email", reverse))
    return F.concat(_let(new, lambda x: _into(local, x, "[0-9A-Za-z]")), F.substring(m, F.length(local) + 1, F.length(m)))


def _date(m: Column, key: str, reverse: bool) -> Column:
    """Year first: y-m-d.  Year last: day first with dots, or where the first number is above 12;
    month first else.  Parts written without a leading zero and their order: kept as written where
    they were two digits, else without zero."""
    sep = F.regexp_extract(m, "([-/.])", 1)
    nums = F.transform(F.split(m, "[-/.]"), lambda x: x.cast("int"))
    wide = F.regexp_replace(m, "[^0-9]", "")
    padded = (F.length(wide) == 8)

    def by_parts(p: Column) -> Column:
        first_year = p[0] > 999
        day_first = ~first_year & ((sep == ".") | (p[0] > 12))
        y = F.when(first_year, p[0]).otherwise(p[2])
        mo = F.when(first_year | day_first, p[1]).otherwise(p[0])
        d = F.when(first_year, p[2]).when(day_first, p[0]).otherwise(p[1])
        # ANSI mode raises on a day that a month lacks, so the day is checked before it is made.
        leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
        days = F.element_at(F.array(*[F.lit(n) for n in (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)]), F.greatest(F.least(mo, F.lit(12)), F.lit(1)))
        ok = mo.between(1, 12) & (d >= 1) & (d <= days + F.when(leap & (mo == 2), 1).otherwise(0)) & y.between(1000, 2999)
        day = F.when(ok, F.make_date(y, mo, d))
        cycle = F.floor((y - 1000) / 400)
        start = F.make_date((cycle * 400 + 1000).cast("int"), F.lit(1), F.lit(1))

        def text(q: Column) -> Column:
            new = F.date_add(start, (q["a"] * 773 + q["b"]).cast("int"))

            def out(n: Column) -> Column:
                ny, nm, nd = F.year(n), F.month(n), F.day(n)
                two = lambda v: F.when(padded, F.lpad(v.cast("string"), 2, "0")).otherwise(v.cast("string"))
                return (
                    F.when(first_year, F.concat_ws("", ny.cast("string"), sep, two(nm), sep, two(nd)))
                    .when(day_first & ((sep == ".") | (nd > 12)), F.concat_ws("", two(nd), sep, two(nm), sep, ny.cast("string")))
                    .otherwise(F.concat_ws("", two(nm), sep, two(nd), sep, ny.cast("string")))
                )

            return _let(new, out)

        index = F.datediff(day, start)
        pair = feistel_pair(F.floor(index / 773), index % 773, 189, 773, key, "date", reverse)
        return F.when(ok, _let(pair, text))

    return _let(nums, by_parts)


_BY_KIND = {"email": _email, "card": _card, "iban": _iban, "ssn": _ssn, "ip": _ip, "phone": _phone, "date": _date}


def _fours(m: Column, key: str, reverse: bool) -> Column:
    """Struct (text, found) of a run of fours, searched from the left; 16 digits come before 17 to 19."""

    def by_units(units: Column) -> Column:
        n = F.size(units)
        short = F.length(_digits(F.element_at(units, -1))) < 4

        def piece(i: Column, k: int) -> Column:
            return F.array_join(F.slice(units, i, F.lit(k)), "")

        def step(acc: Column, i: Column) -> Column:
            four = F.when(i + 3 <= n - F.when(short, 1).otherwise(0), _card(piece(i, 4), key, reverse))
            hit = F.coalesce(
                F.when(four.isNotNull(), F.struct(four.alias("value"), F.lit(3).alias("skip"))),
                F.when((i + 4 == n) & short, F.struct(_card(piece(i, 5), key, reverse).alias("value"), F.lit(4).alias("skip"))),
            )

            def told(h: Column) -> Column:
                value = F.struct(F.lit("card").alias("kind"), F.regexp_replace(h["value"], "^[ -]", "").alias("value"))
                some = h["value"].isNotNull()
                return F.struct(
                    F.when(some, h["skip"]).otherwise(0).alias("skip"),
                    F.concat(acc["text"], F.coalesce(h["value"], F.element_at(units, i))).alias("text"),
                    F.when(some, F.concat(acc["found"], F.array(value))).otherwise(acc["found"]).cast(_FOUND).alias("found"),
                )

            return F.when(acc["skip"] > 0, F.struct((acc["skip"] - 1).alias("skip"), acc["text"].alias("text"), acc["found"].alias("found"))).otherwise(_let(hit, told))

        start = F.struct(F.lit(0).alias("skip"), F.lit("").alias("text"), F.array().cast(_FOUND).alias("found"))
        return F.aggregate(F.sequence(F.lit(1), n), start, step, lambda acc: F.struct(acc["text"].alias("text"), acc["found"].alias("found")))

    return _let(F.regexp_extract_all(m, F.lit("([ -]?[0-9]+)"), 1), by_units)


def pseudonyms(m: Column, key: str, reverse: bool = False) -> Column:
    """Struct (text, found) for a matched text: what it becomes, and an array (kind, value) of what was replaced
    in it; the text itself where no kind's validation holds."""
    tries = []
    for kind, pattern in PATTERNS.items():
        value = F.when(m.rlike(f"^(?:{pattern})$"), _BY_KIND[kind](m, key, reverse))
        tries.append(F.when(value.isNotNull(), F.struct(F.lit(kind).alias("kind"), value.alias("value"))))
    one = _let(
        F.coalesce(*tries, F.struct(F.lit(None).cast("string").alias("kind"), m.alias("value"))),
        lambda p: F.struct(p["value"].alias("text"), F.when(p["kind"].isNotNull(), F.array(p)).otherwise(F.array()).cast(_FOUND).alias("found")),
    )
    return F.when(m.rlike(_FOURS), _fours(m, key, reverse)).otherwise(one)


def pseudonymise(df: DataFrame, key: str, text: str = "text", reverse: bool = False) -> DataFrame:
    """df with ``text`` pseudonymised, and _pii: array of (kind, value) of what was replaced, in order."""
    df = df.drop("_pii")
    t = F.col(text)
    # Cheap test first: every kind has a digit or an @.
    hot = t.rlike("[0-9@]")
    found = F.when(hot, F.transform(F.regexp_extract_all(t, F.lit(f"({ANY_FLAT})"), 0), lambda m: pseudonyms(m, key, reverse)))
    gaps = F.when(hot, F.split(t, ANY_FLAT, -1))
    cols = [c for c in df.columns if c != text]
    a, b = fresh(df, "__found"), fresh(df, "__gaps")
    staged = df.select(*[F.col(f"`{c}`") for c in cols], t.alias(text), found.alias(a), gaps.alias(b))
    joined = F.concat(F.array_join(F.zip_with(F.slice(b, 1, F.size(a)), a, lambda g, f: F.concat(g, f["text"])), ""), F.element_at(b, -1))
    out = F.when(F.size(a) > 0, joined).otherwise(F.col(text)).alias(text)
    pii = F.coalesce(F.flatten(F.transform(a, lambda f: f["found"])), F.array().cast(_FOUND))
    return staged.select(*[out if c == text else F.col(f"`{c}`") for c in df.columns], pii.alias("_pii"))


ANY_FLAT = "|".join(PATTERNS.values())
