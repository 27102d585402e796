"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

Found values are validated and then permuted by a keyed Feistel network inside their own format: an
address stays an address, a card number keeps a right check digit, a date stays a date. The permutation
depends on the key, which the caller keeps secret, and the value alone, so equal values stay linked across documents and different
values of a format stay different. Text outside the values is left as it is.

Two networks are used, of `ROUNDS` rounds each:
* over numbers: a value below a*b is split into (value div b, value mod b), and the halves are shifted
  in turn modulo a and b by a keyed digest of the other half (dates, addresses);
* over characters: the two halves of a string shift each other's letters and digits within their own
  alphabet, by keyed digests (cards, telephone numbers, account numbers, mail names, secrets).

Defined results: a null text stays null with no value found; empty texts, repeated rows and ties need
no rule, as each row stands alone; extra columns are passed through. Whole texts are read, and values of any length: no pattern
cuts one off. Letters of mail names outside Latin, Greek and Cyrillic stay; a mail's domain stays.

The key is a column of a one-row table that is broadcast, not a literal, so plans and event logs don't show it.
"""

from __future__ import annotations

import functools
import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROUNDS = 6
#: Session setting that holds the key of the registered queries; Spark redacts settings of such names.
KEY_SETTING = "spark.dealweave.pii.secret"

# Lengths of account numbers by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_IBANS = "|".join(rf"(?:{'|'.join(c.split())})\d{{2}}(?: ?[A-Z0-9]){{{n - 4}}}(?![A-Z0-9])" for n, c in IBAN_LENGTHS.items())

# Formats, as Java regular expressions. The order is the order of precedence. Runs of any length are
# possessive and begin where no such character stands before, so that each text is read once.
FORMATS = {
    "secret": r"(?i:\b(?:password|passwd|token|secret|api_key|apikey)\s{0,3}[=:]\s{0,3}[\"']?[A-Za-z0-9_\-]{8,}+)",
    "email": r"(?<![\p{L}\p{M}\p{N}._%+\-])[\p{L}\p{M}\p{N}._%+\-]++@[\p{L}\p{N}\-]++(?:\.[\p{L}\p{N}\-]++)++",
    "iban": rf"\b(?:{_IBANS}|[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?\b)",
    "ip": r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\w|\.\d|-[A-Za-z])",
    "date": r"(?<![\d\-/.])(?:19|20)\d{2}([\-/.])\d{2}\1\d{2}(?![\d]|[\-/.]\d)|(?<![\d\-/.])\d{2}([\-/.])\d{2}\2(?:19|20)\d{2}(?![\d]|[\-/.]\d)",
    "ssn": r"(?<![\d\-])(?!000)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\d\-])",
    "phone": r"(?<![\w+])\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)[ .\-]?)?\d{2,4}(?:[ .\-]?\d{2,4}){1,4}(?!\d)|(?<![\w+])(?:\(\d{3}\) ?|\d{3}[.\-])\d{3}[.\-]\d{4}(?!\d)",
    "card": r"(?<![\w.\-])\d(?:[ \-]?\d){12,18}(?![\w])",
}
#: Further alphabets, from ranges of code points: Latin letters with marks, Greek and Cyrillic, small and capital.
_RANGES = (((0xE0, 0xF6), (0xF8, 0xFF)), ((0xC0, 0xD6), (0xD8, 0xDE)), ((0x100, 0x17F),), ((0x3B1, 0x3C9),), ((0x391, 0x3A1), (0x3A3, 0x3A9)), ((0x430, 0x44F),), ((0x410, 0x42F),))
ALPHABETS = tuple("".join(chr(c) for a, b in ranges for c in range(a, b + 1)) for ranges in _RANGES)
FIRST_DAY, DAYS_A, DAYS_B = "1900-01-01", 17, 4297  # 17 * 4297 days: 1900 to 2099


def _digits(s) -> F.Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _column(key) -> F.Column:
    """A key given as a column, or as a text for small uses."""
    return F.lit(key) if isinstance(key, str) else key


def feistel_number(value, a: int, b: int, key: F.Column | str, label: str) -> F.Column:
    """A keyed permutation of 0 .. a*b - 1."""
    high, low = F.floor(value / b).cast("long"), value % b
    state = F.struct(high.alias("h"), low.alias("l"))
    rounds = F.array(*map(F.lit, range(ROUNDS)))

    def step(s, r):
        shift_high = F.pmod(s["h"] + _dynamic_digest(key, label, r, s["l"]), F.lit(a))
        shift_low = F.pmod(s["l"] + _dynamic_digest(key, label, r, s["h"]), F.lit(b))
        even = r % 2 == 0
        return F.struct(F.when(even, shift_high).otherwise(s["h"]).alias("h"), F.when(even, s["l"]).otherwise(shift_low).alias("l"))

    return F.aggregate(rounds, state, step, lambda s: s["h"] * b + s["l"])


def _dynamic_digest(key: F.Column, label: str, number, value) -> F.Column:
    return F.conv(F.substring(F.sha2(F.concat_ws(":", _column(key), F.lit(label), number.cast("string"), value.cast("string")), 256), 1, 15), 16, 10).cast("long")


def feistel_text(value, key: F.Column | str, label: str) -> F.Column:
    """A keyed permutation of the strings of `value`'s format: each letter or digit moves within its own alphabet."""
    n = F.length(value)
    state = F.struct(F.substring(value, F.lit(1), F.floor((n + 1) / 2).cast("int")).alias("l"), F.substring(value, F.floor((n + 1) / 2).cast("int") + 1, n).alias("r"))

    def moved(half, other, r):
        seed = F.sha2(F.concat_ws(":", _column(key), F.lit(label), r.cast("string"), other), 512)

        def one(c, i, stream):
            block = F.when(i < 60, stream).otherwise(F.sha2(F.concat_ws(":", stream, F.floor(i / 60).cast("string")), 512))
            shift = F.conv(F.substring(block, (i % 60) * 2 + 1, F.lit(4)), 16, 10).cast("int")

            def turn(alphabet):
                base, size = ord(alphabet[0]), len(alphabet)
                return F.char((F.ascii(c) - base + shift) % size + base)

            def other():
                out = None
                for letters in ALPHABETS:
                    place = F.position(c, F.lit(letters))
                    new = F.substring(F.lit(letters), (place - 1 + shift) % len(letters) + 1, F.lit(1))
                    out = F.when(place > 0, new) if out is None else out.when(place > 0, new)
                return out.otherwise(c)

            kinds = F.when(c.between("0", "9"), turn("0123456789")).when(c.between("a", "z"), turn("abcdefghijklmnopqrstuvwxyz"))
            return kinds.when(c.between("A", "Z"), turn("ABCDEFGHIJKLMNOPQRSTUVWXYZ")).when(F.ascii(c) >= 0xC0, other()).otherwise(c)

        # the digest of the other half is made once, not for each letter
        turned = F.transform(F.array(seed), lambda stream: F.array_join(F.transform(F.split(half, ""), lambda c, i: one(c, i, stream)), ""))
        return F.get(turned, F.lit(0))

    def step(s, r):
        even = r % 2 == 0
        return F.struct(F.when(even, moved(s["l"], s["r"], r)).otherwise(s["l"]).alias("l"), F.when(even, s["r"]).otherwise(moved(s["r"], s["l"], r)).alias("r"))

    return F.aggregate(F.array(*map(F.lit, range(ROUNDS))), state, step, lambda s: F.concat(s["l"], s["r"]))


def _luhn_sum(digits) -> F.Column:
    """Luhn sum of a digit string whose last digit is the check digit."""

    def part(a, x):
        d = x.cast("int")
        twice = d * 2
        d2 = F.when(twice > 9, twice - 9).otherwise(twice)
        return F.struct((a["s"] + F.when(a["odd"], d2).otherwise(d)).alias("s"), (~a["odd"]).alias("odd"))

    return F.aggregate(F.split(F.reverse(digits), ""), F.struct(F.lit(0).alias("s"), F.lit(False).alias("odd")), part, lambda a: a["s"])


def _poured(shape, digits) -> F.Column:
    """`shape` with its digits replaced, in order, by those of `digits`."""

    def one(c, i):
        rank = F.length(_digits(F.substring(shape, F.lit(1), i + 1)))
        return F.when(c.between("0", "9"), F.substring(digits, rank, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.split(shape, ""), one), "")


def _card(m, key: F.Column) -> F.Column:
    digits = _digits(m)
    body = feistel_text(F.substring(digits, F.lit(1), F.length(digits) - 1), key, "card")
    check = F.pmod(-_luhn_sum(F.concat(body, F.lit("0"))), F.lit(10)).cast("string")
    return F.when(F.pmod(_luhn_sum(digits), F.lit(10)) == 0, _poured(m, F.concat(body, check))).otherwise(m)


def _ip(m, key: F.Column) -> F.Column:
    octets = F.transform(F.split(m, "\\."), lambda x: x.cast("long"))
    number = F.aggregate(octets, F.lit(0).cast("long"), lambda a, x: a * 256 + x)
    new = feistel_number(number, 1 << 16, 1 << 16, key, "ip")
    text = F.concat_ws(".", *(F.pmod(F.shiftright(new, s), F.lit(256)).cast("string") for s in (24, 16, 8, 0)))
    return F.when(F.forall(octets, lambda x: x <= 255) & ~m.rlike("(^|\\.)0\\d"), text).otherwise(m)


def _date(m, key: F.Column) -> F.Column:
    first = m.rlike("^\\d{4}")
    mark = F.when(first, F.substring(m, 5, 1)).otherwise(F.substring(m, 3, 1))
    parts = F.split(m, "[\\-/.]")
    year = F.when(first, parts[0]).otherwise(parts[2])
    day_first = F.try_to_timestamp(F.concat_ws("-", year, F.when(first, parts[1]).otherwise(parts[1]), F.when(first, parts[2]).otherwise(parts[0])), F.lit("yyyy-MM-dd"))
    month_first = F.when(~first, F.try_to_timestamp(F.concat_ws("-", year, parts[0], parts[1]), F.lit("yyyy-MM-dd")))
    is_day_first = day_first.isNotNull()
    found = F.coalesce(day_first, month_first).cast("date")
    number = F.datediff(found, F.to_date(F.lit(FIRST_DAY))).cast("long")
    new = F.date_add(F.to_date(F.lit(FIRST_DAY)), feistel_number(number, DAYS_A, DAYS_B, key, "date").cast("int"))
    y, mo, d = (F.date_format(new, f) for f in ("yyyy", "MM", "dd"))
    text = F.when(first, F.concat_ws("-", y, mo, d)).when(is_day_first, F.concat_ws("-", d, mo, y)).otherwise(F.concat_ws("-", mo, d, y))
    return F.when(found.isNotNull(), F.replace(text, F.lit("-"), mark)).otherwise(m)


def _phone(m, key: F.Column) -> F.Column:
    head = F.regexp_extract(m, "^(\\+\\d{1,3}(?=[ .\\-(])|\\+\\d)?", 0)
    rest = F.substring(m, F.length(head) + 1, F.length(m))
    n = F.length(_digits(m))
    return F.when((n >= 8) & (n <= 15), F.concat(head, feistel_text(rest, key, "phone"))).otherwise(m)


def _iban(m, key: F.Column) -> F.Column:
    """Country kept, account part permuted, the two check digits made right again."""

    def remainder(s):
        return F.aggregate(F.split(s, ""), F.lit(0).cast("long"), lambda a, c: F.when(c.between("0", "9"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97))

    bare = F.replace(m, F.lit(" "), F.lit(""))
    country = F.substring(bare, 1, 2)
    account = F.substring(bare, F.lit(5), F.length(bare))
    tail = F.substring(m, F.lit(5), F.length(m))
    new = feistel_text(tail, key, "iban")
    check = F.lpad((98 - remainder(F.concat(F.replace(new, F.lit(" "), F.lit("")), country, F.lit("00")))).cast("string"), 2, "0")
    return F.when(remainder(F.concat(account, F.substring(bare, 1, 4))) == 1, F.concat(country, check, new)).otherwise(m)


def _email(m, key: F.Column) -> F.Column:
    name = F.substring_index(m, "@", 1)
    return F.concat(feistel_text(name, key, "email"), F.substring(m, F.length(name) + 1, F.length(m)))


def _secret(m, key: F.Column) -> F.Column:
    head = F.regexp_extract(m, "(?i)^[a-z_]+\\s*[=:]\\s*[\"']?", 0)
    return F.concat(head, feistel_text(F.substring(m, F.length(head) + 1, F.length(m)), key, "secret"))


_MAKERS = {
    "secret": _secret,
    "email": _email,
    "iban": _iban,
    "ip": _ip,
    "date": _date,
    "ssn": lambda m, key: feistel_text(m, key, "ssn"),
    "phone": _phone,
    "card": _card,
}


def _pattern(kinds) -> str:
    """One pattern for all kinds; back references are numbered anew by naming them."""
    named = FORMATS | {"date": FORMATS["date"].replace(r"([\-/.])\d{2}\1", r"(?<m1>[\-/.])\d{2}\k<m1>").replace(r"([\-/.])\d{2}\2", r"(?<m2>[\-/.])\d{2}\k<m2>")}
    return "|".join(f"(?:{named[k]})" for k in kinds)


def pseudonym(m, key: F.Column) -> F.Column:
    """The replacement of one found value `m`; the value itself where its validation fails."""
    out = None
    for kind, make in _MAKERS.items():
        test = m.rlike(f"^(?:{_pattern([kind])})$")
        out = F.when(test, make(m, key)) if out is None else out.when(test, make(m, key))
    return out.otherwise(m)


@functools.cache
def _own_key() -> str:
    return secrets.token_hex(32)


def session_key(spark: SparkSession) -> str:
    """The key that the session is set to, else a random one of this process, which links values within its runs only."""
    return spark.conf.get(KEY_SETTING, None) or _own_key()


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(row, n_found): rows of `docs` as structs with `text` rewritten, and the number of values replaced."""
    pattern = _pattern(FORMATS)
    t = F.col("p_text")
    held = docs.sparkSession.createDataFrame([(key,)], "p_key string")
    out = docs.select(F.struct(*docs.columns).alias("p_row"), F.col(text).alias("p_text")).crossJoin(F.broadcast(held))  # one row
    out = out.withColumn("p_hits", F.when(t.rlike("[0-9@=:]"), F.regexp_extract_all(t, F.lit(pattern), F.lit(0))))
    hit = F.size("p_hits") > 0
    out = out.withColumn("p_new", F.when(hit, F.transform("p_hits", lambda m: pseudonym(m, F.col("p_key")))))
    rest = F.transform(F.split(t, pattern, -1), lambda s, i: F.concat(s, F.coalesce(F.get("p_new", i), F.lit(""))))
    changed = F.filter(F.zip_with("p_hits", "p_new", lambda a, b: a != b), lambda x: x)
    new = F.when(hit, F.array_join(rest, "")).otherwise(t)
    row = F.struct(*(new.alias(c) if c == text else F.col("p_row")[c].alias(c) for c in docs.columns))
    return out.select(row.alias("row"), F.when(hit, F.size(changed)).otherwise(0).cast("long").alias("n_found"))
