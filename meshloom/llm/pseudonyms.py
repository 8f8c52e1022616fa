"""PII: format-preserving pseudonyms by keyed Feistel permutations, in DataFrame functions only.

Every value found is replaced by another of the same format: halves of the value alternately
shift each other by a keyed digest, within the alphabet or range each part allows, so the map is
a permutation of the format's values and equal values get equal pseudonyms in every document.

- card numbers (13 to 19 digits, Luhn-valid): first digit and grouping stay, the check digit is right.
  They are looked for beside the other findings, in runs of digit groups with single blanks or hyphens
  between: first in the usual groupings (CARDS), then as any groups in a row, of usual lengths and first
  digits (LOOSE), then of all (LEAST, the longest first), at every group;
- IPv4 addresses with octets up to 255; North American telephone numbers with valid area and
  exchange codes; social security numbers with valid parts; each stays valid and punctuated alike;
- dates from 1900 to 2099 (YYYY-MM-DD, MM/DD/YYYY, DD.MM.YYYY) that the calendar has: year and
  day of the year are permuted; 29 February stays one and moves among leap years;
- email addresses (local part), access keys and the values of password/token/secret assignments:
  letters stay letters, digits digits, hexadecimal strings hexadecimal.

Numbers that fail validation stay as they are.  Defined results: null text stays null, text
without findings is unchanged, ids play no role, all rows and columns stay; the added column names
give way to clashing ones in `pseudonymised`.  Texts of any length are handled row by row in the JVM.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hidden

ROUNDS = 6
#: Session setting that holds the key.
KEY_SETTING = "spark.meshloom.pseudonymKey"
LOWER, UPPER, DIGITS, HEX = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"

# Possessive loops: a greedy group is matched by recursion, which long addresses would exhaust.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
KEY = r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![0-9A-Za-z])"
ASSIGNED = r"(?<![A-Za-z0-9])(?:password|passwd|token|secret|api_key)[ ]?[=:][ ]?\"?[A-Za-z0-9_+/-]{8,}\"?"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?[0-9])"
PHONE = r"(?<![0-9+(])(?:\+1[ .-]?)?(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[ .-])[2-9][0-9]{2}[ .-][0-9]{4}(?![0-9])"
SSN = r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])"
DATE = r"(?<![0-9./-])(?:(?:19|20)[0-9]{2}-[01][0-9]-[0-3][0-9]|[01][0-9]/[0-3][0-9]/(?:19|20)[0-9]{2}|[0-3][0-9]\.[01][0-9]\.(?:19|20)[0-9]{2})(?![0-9/-])"
#: All of a text that cards can be in, and the cards at the start of a group: of several that are Luhn-valid the first here.
RUN = r"(?<![0-9])[0-9][0-9 -]{11,}[0-9](?![0-9])"
_FOUR = r"[0-9]{4}"
_USUAL = (rf"[0-9]{{12,18}}|[0-9]{{3}}([ -]){_FOUR}\1{_FOUR}\1{_FOUR}", r"[0-9]{3}([ -])(?:[0-9]{6}\1[0-9]{4,5}|[0-9]{4}\1[0-9]{5}|[0-9]{5}\1[0-9]{6}|[0-9]{3}\1[0-9]{3}\1[0-9]{3})", rf"[0-9]{{3}}([ -]){_FOUR}\1{_FOUR}\1{_FOUR}\1[0-9]{{3}}")
CARDS = tuple(rf"^(?=[3-6]|2[2-7])[0-9](?:{p})(?![0-9])" for p in _USUAL)
_any = lambda n: rf"[0-9](?:[ -]?[0-9]){{{n - 1}}}(?![0-9])"
LOOSE = (rf"^(?=[3-6]|2[2-7]){_any(16)}", rf"^(?=3[ -]?[47]){_any(15)}")
LEAST = tuple(rf"^(?!0){_any(n)}" for n in range(19, 12, -1))
PATTERN = "|".join((EMAIL, KEY, ASSIGNED, IPV4, PHONE, SSN, DATE))
KINDS = ("email", "key", "assigned", "ipv4", "phone", "ssn", "date")


def session_key(spark: SparkSession) -> str:
    """The key in the session's KEY_SETTING; where it is unset, one drawn for this session, so that pseudonyms
    are linked within the session but never predictable."""
    if not spark.conf.get(KEY_SETTING, None):
        spark.conf.set(KEY_SETTING, secrets.token_hex(32))
    return spark.conf.get(KEY_SETTING)


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def _digest(key: str, kind: str, rnd: Column, value: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), rnd.cast("string"), value.cast("string")), 256)


def _number(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long")


def feistel_numbers(a: Column, b: Column, size_a, size_b, key: str, kind: str) -> Column:
    """struct(a, b): a permutation of pairs 0 <= a < size_a, 0 <= b < size_b."""
    size_a, size_b = (x if isinstance(x, Column) else F.lit(x) for x in (size_a, size_b))
    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))

    def step(acc, r):
        first = F.pmod(acc["a"] + _number(_digest(key, kind, r, acc["b"])), size_a.cast("long"))
        second = F.pmod(acc["b"] + _number(_digest(key, kind, r, acc["a"])), size_b.cast("long"))
        even = r % 2 == 0
        return F.struct(F.when(even, first).otherwise(acc["a"]).cast("long").alias("a"), F.when(even, acc["b"]).otherwise(second).cast("long").alias("b"))

    return F.aggregate(F.array(*[F.lit(i) for i in range(ROUNDS)]), start, step)


def _shift(text: Column, digest: Column, hexadecimal: Column) -> Column:
    """Each character moved within its class by a byte of the digest."""

    def moved(c, i):
        by = F.conv(F.substr(digest, F.pmod(i, F.lit(32)) * 2 + 1, F.lit(2)), 16, 10).cast("int")

        def inside(alphabet: str) -> Column:
            return F.substr(F.lit(alphabet), F.pmod(F.instr(F.lit(alphabet), c) - 1 + by, F.lit(len(alphabet))) + 1, F.lit(1))

        return (
            F.when(hexadecimal, inside(HEX))
            .when(c.between("0", "9"), inside(DIGITS))
            .when(c.between("a", "z"), inside(LOWER))
            .when(c.between("A", "Z"), inside(UPPER))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.split(text, ""), moved), "")


def feistel_text(text: Column, key: str, kind: str) -> Column:
    """A permutation of ASCII strings that keeps the class of each character (and hexadecimal strings so)."""
    return _let(text.rlike("^(?=.*[0-9])(?=.*[a-f])[0-9a-f]{8,}$"), lambda h: _feistel_text(text, h, key, kind))


def _feistel_text(text: Column, hexadecimal: Column, key: str, kind: str) -> Column:
    half = F.floor(F.length(text) / 2).cast("int")
    start = F.struct(F.substr(text, F.lit(1), half).alias("a"), F.substr(text, half + 1).alias("b"))

    def step(acc, r):
        even = r % 2 == 0
        a = F.when(even & (F.length(acc["a"]) > 0), _let(_digest(key, kind, r, acc["b"]), lambda d: _shift(acc["a"], d, hexadecimal))).otherwise(acc["a"])
        b = F.when(even, acc["b"]).otherwise(_let(_digest(key, kind, r, acc["a"]), lambda d: _shift(acc["b"], d, hexadecimal)))
        return F.struct(a.alias("a"), b.alias("b"))

    out = F.aggregate(F.array(*[F.lit(i) for i in range(ROUNDS)]), start, step)
    return _let(out, lambda x: F.concat(x["a"], x["b"]))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _refill(template: Column, digits: Column) -> Column:
    """template with its digits, in order, replaced by those of `digits`."""

    def at(c, i):
        k = F.length(_digits(F.substr(template, F.lit(1), i + 1)))
        return F.when(c.between("0", "9"), F.substr(digits, k, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.split(template, ""), at), "")


def _padded(value: Column, width) -> Column:
    return F.lpad(value.cast("string"), width, "0")


def _luhn(digits: Column, odd_from_right: int) -> Column:
    """Luhn sum; digits are doubled that stand at an even place from the right if odd_from_right is 1, else the others."""
    n = F.length(digits)

    def worth(c, i):
        d = c.cast("int")
        double = F.pmod(n - i, F.lit(2)) == (0 if odd_from_right else 1)
        return F.when(double, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    return F.aggregate(F.transform(F.split(digits, ""), worth), F.lit(0), lambda x, y: x + y)


def _card(m: Column, key: str) -> Column:
    d = _digits(m)

    def changed(d):
        inner = F.substr(d, F.lit(2), F.length(d) - 2)
        half = F.floor(F.length(inner) / 2).cast("int")
        rest = F.length(inner) - half
        ten = lambda k: F.pow(F.lit(10), k).cast("long")
        p = feistel_numbers(F.substr(inner, F.lit(1), half), F.substr(inner, half + 1), ten(half), ten(rest), key, "card")
        body = _let(p, lambda x: F.concat(F.substr(d, F.lit(1), F.lit(1)), _padded(x["a"], half), _padded(x["b"], rest)))
        return _let(body, lambda x: F.concat(x, F.pmod(10 - F.pmod(_luhn(x, 0), F.lit(10)), F.lit(10)).cast("string")))

    return _refill(m, _let(d, changed))


def _piece(text: Column, found: bool) -> Column:
    return F.array(F.struct(text.alias("text"), F.lit(found).alias("found")))


def _cards_of(run: Column, key: str, readings: tuple[str, ...]) -> Column:
    """A run as pieces, with its cards changed.  Of cards that overlap the one that starts first counts."""
    size = lambda x: F.regexp_count(x, F.lit("[0-9]+"))
    joined = lambda groups, a, b: F.array_join(F.slice(groups, a + 1, F.greatest(b - a, F.lit(0))), "")

    def valid(tail):
        luhn = lambda x: F.pmod(_let(_digits(x), lambda d: _luhn(d, 1)), F.lit(10)) == 0
        return F.coalesce(*[_let(F.regexp_extract(tail, p, 0), lambda x: F.when((x != "") & luhn(x), x)) for p in readings])

    def pieces(groups):
        def step(acc, i):
            def taken(card):
                more = F.struct(i.alias("at"), (i + size(card)).alias("end"), card.alias("card"))
                return F.when(card.isNull(), acc).otherwise(F.concat(acc, F.array(more)))

            free = F.coalesce(F.try_element_at(acc, F.lit(-1))["end"], F.lit(0)) <= i
            return F.when(free, _let(_let(joined(groups, i, i + 19), valid), taken)).otherwise(acc)

        def around(cards):
            def one(k):
                last = F.get(cards, k - 1)
                start, until = F.coalesce(last["end"], F.lit(0)), F.coalesce(F.get(cards, k)["at"], F.size(groups))
                mark = F.coalesce(F.regexp_extract(F.get(groups, start - 1), "[^0-9]*$", 0), F.lit(""))
                between = _piece(F.concat(mark, joined(groups, start, until)), False)
                return F.concat(F.when(k > 0, _piece(_card(last["card"], key), True)).otherwise(F.slice(_piece(F.lit(""), True), 1, 0)), between)

            return F.flatten(F.transform(F.sequence(F.lit(0), F.size(cards)), one))

        none = F.array().cast("array<struct<at:int,end:int,card:string>>")
        return _let(F.aggregate(F.sequence(F.lit(0), F.size(groups) - 1), none, step), around)

    return _let(F.regexp_extract_all(run, F.lit("[0-9]+[^0-9]*"), F.lit(0)), pieces)


def _cards(text: Column, key: str, readings: tuple[str, ...]) -> Column:
    """text as pieces, with its cards changed."""
    changed = F.transform(F.regexp_extract_all(text, F.lit(RUN), F.lit(0)), lambda r: _cards_of(r, key, readings))
    both = F.zip_with(F.split(text, RUN, -1), changed, lambda g, c: F.when(c.isNull(), _piece(g, False)).otherwise(F.concat(_piece(g, False), c)))
    return F.when(text.rlike(RUN), F.flatten(both)).otherwise(_piece(text, False))


def _ipv4(m: Column, key: str) -> Column:
    def changed(o):
        p = feistel_numbers(o[0].cast("long") * 256 + o[1].cast("long"), o[2].cast("long") * 256 + o[3].cast("long"), 65536, 65536, key, "ipv4")
        return _let(p, lambda x: F.concat_ws(".", F.floor(x["a"] / 256), x["a"] % 256, F.floor(x["b"] / 256), x["b"] % 256))

    return _let(F.split(m, r"\."), changed)


def _phone(m: Column, key: str) -> Column:
    def changed(d):
        d10 = F.right(d, F.lit(10))
        area, exchange, line = (F.substring(d10, s, k).cast("long") for s, k in ((1, 3), (4, 3), (7, 4)))
        p = feistel_numbers(area - 200, (exchange - 200) * 10000 + line, 800, 8_000_000, key, "phone")
        ten = _let(p, lambda x: F.concat((x["a"] + 200).cast("string"), (F.floor(x["b"] / 10000) + 200).cast("string"), _padded(x["b"] % 10000, 4)))
        return F.concat(F.substr(d, F.lit(1), F.length(d) - 10), ten)

    return _refill(m, _let(_digits(m), changed))


def _ssn(m: Column, key: str) -> Column:
    area = F.substring(m, 1, 3).cast("long")
    rank = F.when(area > 666, area - 2).otherwise(area - 1)  # 001 to 899 without 666
    p = feistel_numbers(rank, (F.substring(m, 5, 2).cast("long") - 1) * 9999 + F.substring(m, 8, 4).cast("long") - 1, 898, 99 * 9999, key, "ssn")
    area2 = lambda x: F.when(x["a"] + 1 >= 666, x["a"] + 2).otherwise(x["a"] + 1)
    return _let(p, lambda x: F.concat_ws("-", _padded(area2(x), 3), _padded(F.floor(x["b"] / 9999) + 1, 2), _padded(x["b"] % 9999 + 1, 4)))


def _date(m: Column, key: str) -> Column:
    iso = F.when(m.contains("-"), m).when(m.contains("/"), F.concat_ws("-", F.substring(m, 7, 4), F.substring(m, 1, 2), F.substring(m, 4, 2))).otherwise(F.concat_ws("-", F.substring(m, 7, 4), F.substring(m, 4, 2), F.substring(m, 1, 2)))

    def changed(iso):
        year = F.substring(iso, 1, 4).cast("long")
        # The same day in 2001 gives the rank of all days but 29 February.
        day = F.datediff(F.try_to_date(F.concat(F.lit("2001"), F.substring(iso, 5, 6)), "yyyy-MM-dd"), F.lit("2001-01-01").cast("date"))
        p = feistel_numbers(year - 1900, day, 200, 365, key, "date")
        plain = _let(p, lambda x: F.concat((x["a"] + 1900).cast("string"), F.substring(F.date_add(F.lit("2001-01-01").cast("date"), x["b"].cast("int")).cast("string"), 5, 6)))
        leap_rank = F.floor((year - 1904) / 4)
        moved = F.pmod(leap_rank + _number(_digest(key, "leap", F.lit(0), F.lit("29"))), F.lit(49))
        leap = F.concat((moved * 4 + 1904).cast("string"), F.lit("-02-29"))
        return F.when(F.try_to_date(iso, "yyyy-MM-dd").isNull(), iso).when(F.substring(iso, 6, 5) == "02-29", leap).otherwise(plain)

    def back(x):
        y, mo, d = F.substring(x, 1, 4), F.substring(x, 6, 2), F.substring(x, 9, 2)
        return F.when(m.contains("-"), x).when(m.contains("/"), F.concat_ws("/", mo, d, y)).otherwise(F.concat_ws(".", d, mo, y))

    return _let(_let(iso, changed), back)


def _text_part(m: Column, head: str, tail: str, key: str, kind: str) -> Column:
    """m with the part between regular expressions head and tail permuted."""
    a, z = F.regexp_extract(m, f"^{head}", 0), F.regexp_extract(m, f"{tail}$", 0)
    inner = F.substr(m, F.length(a) + 1, F.length(m) - F.length(a) - F.length(z))
    return F.concat(a, _let(inner, lambda x: feistel_text(x, key, kind)), z)


def kind_of(m: Column) -> Column:
    out = F.lit(KINDS[-1])
    for name, p in reversed(list(zip(KINDS[:-1], (EMAIL, KEY, ASSIGNED, IPV4, PHONE, SSN), strict=True))):
        out = F.when(m.rlike(f"^(?:{p})$"), F.lit(name)).otherwise(out)
    return out


def pseudonym(m: Column, key: str) -> Column:
    def by_kind(x):
        v, k = x["v"], x["k"]
        return (
            F.when(k == "email", _text_part(v, "", "@.*", key, "email"))
            .when(k == "key", _text_part(v, "AKIA", "", key, "key"))
            .when(k == "assigned", _text_part(v, r'[a-z_]+[ ]?[=:][ ]?\"?', r'\"?', key, "assigned"))
            .when(k == "ipv4", _ipv4(v, key))
            .when(k == "phone", _phone(v, key))
            .when(k == "ssn", _ssn(v, key))
            .otherwise(_date(v, key))
        )

    return _let(F.struct(m.alias("v"), kind_of(m).alias("k")), by_kind)


def _with_pieces(docs: DataFrame, text_col: str, key: str, name: str) -> DataFrame:
    """docs with a column of the text's pieces (text, found), all that is found changed; null for null.
    The kinds but cards come first, then each level of cards in what is left."""
    text = F.col(f"`{text_col}`")
    found = F.transform(F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)), lambda m: pseudonym(m, key))
    both = F.zip_with(F.split(text, PATTERN, -1), found, lambda g, p: F.when(p.isNull(), _piece(g, False)).otherwise(F.concat(_piece(g, False), _piece(p, True))))
    out = docs.withColumn(name, F.when(text.rlike(PATTERN), F.flatten(both)).otherwise(F.when(text.isNotNull(), _piece(text, False))))
    for readings in (CARDS, LOOSE, LEAST):
        cards = F.flatten(F.transform(name, lambda p: F.when(p["found"], F.array(p)).otherwise(_cards(p["text"], key, readings))))  # noqa: B023
        out = out.withColumn(name, F.when(text.rlike(RUN), cards).otherwise(F.col(name)))
    return out


def _text(pieces: Column) -> Column:
    return F.array_join(F.transform(pieces, lambda p: p["text"]), "")


def pseudonymised(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """docs with the text's personal data replaced; all rows and columns stay, in their order."""
    name = hidden("pieces", docs)
    got = _with_pieces(docs, text_col, key, name)
    return got.select(*[_text(F.col(name)).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])


def pseudonym_report(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, n_found): the changed text and how many values were found in it (of cards the valid ones)."""
    docs = docs.select(id_col, text_col)
    name = hidden("pieces", docs)
    got = _with_pieces(docs, text_col, key, name)
    count = F.size(F.filter(name, lambda p: p["found"]))
    return got.select(F.col(id_col), _text(F.col(name)).alias(text_col), F.when(F.col(name).isNull(), 0).otherwise(count).cast("long").alias("n_found"))
