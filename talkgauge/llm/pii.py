"""Personal data replaced by keyed, format-preserving pseudonyms.

Card numbers (Luhn), IPv4 addresses, phone numbers, social security numbers and dates are taken as numbers, checked, and
permuted within their own range by a Feistel network of two halves whose round function is SHA-256 with a key; the
check digit of a card is set anew.  Mail addresses and secrets are permuted letter by letter in the same way.  Each is
a permutation, so equal values get equal pseudonyms in all documents.  Only column expressions are used; the key has no
default and is part of the plan, so give a key made for the job.  Account numbers (IBAN, checked modulo 97) keep their country
and get check digits anew; their letters and digits are permuted in place.  Mail addresses are lower-cased first, so all
spellings of one are linked.  Dates with slashes or dots are read day first, month first where only that is a date; they are
written with two-digit days and months, and a month-first pseudonym may equal a day-first one.  National phone numbers
keep their first digit.  Secrets are the run without blanks or quotes after their name: twelve characters, or six with both
letters and digits.  IPv6 addresses, names and postal addresses are not looked for.

Defined results: a null text stays null, an empty one empty; values that fail their check stay as they are; other rows
and columns are untouched; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
# 400 Gregorian years from 1800 on are 146,097 days: 189 times 773.
FIRST_DAY, DAYS = "1800-01-01", (189, 773)
MAIL = r"[A-Za-z0-9._%+\-]{1,64}@[A-Za-z0-9.\-]{1,190}\.[A-Za-z]{2,24}"
ADDRESS = r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d.]*\d)"
CARD = r"(?<!\d)\d(?:[ \-]?\d){12,18}(?!\d)"
PHONE = r"\+\d{1,3}[ .\-]?\(?\d{2,4}\)?(?:[ .\-]?\d{2,4}){2,4}(?!\d)"
# Eleven or ten digits that begin with 0, or three, three and four; never a piece of a longer run of groups.
NATIONAL = r"(?<![\d.\-+])(?<!\d[ \-])(?:0\d{2,4}[ \-]\d{3,4}[ \-]?\d{3,4}|\(\d{3}\) ?\d{3}-\d{4}|\d{3}[-.]\d{3}[-.]\d{4})(?![ \-]?\d)"
SOCIAL = r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])|(?<![A-Za-z])(?i:ssn|social security(?: number)?) ?[:#=]? ?\d{9}(?!\d)"
DATE = r"(?<![\d\-])\d{4}-\d{2}-\d{2}(?![\d\-])"
DAY = r"(?<![\d./])\d{1,2}/\d{1,2}/\d{4}(?![\d/])|(?<![\d./])\d{1,2}\.\d{1,2}\.\d{4}(?!\d|\.\d)"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])"
SECRET_NAME = r"""(?i:password|passwd|token|secret|api_?key)["']? ?[=:] ?["']?"""
# A value does not end in the punctuation of its sentence, so that it is the same value wherever it stands.
SECRET_END = r"""[^\s"'.,;:!?)\]}>]"""
SECRET_VALUE = rf"""(?:[^\s"']{{11,}}{SECRET_END}|(?=[^\s"']*[0-9])(?=[^\s"']*[A-Za-z])[^\s"']{{5,}}{SECRET_END})"""
SECRET = SECRET_NAME + SECRET_VALUE + r"|(?<![A-Z0-9])AKIA[A-Z0-9]{16}(?![A-Z0-9])"
KINDS = (
    ("mail", MAIL), ("secret", SECRET), ("iban", IBAN), ("phone", PHONE), ("national", NATIONAL), ("date", DATE), ("day", DAY),
    ("social", SOCIAL), ("address", ADDRESS), ("card", CARD),
)
ANY = "|".join(p for _, p in KINDS)
OTHERS = "|".join(p for name, p in KINDS if name != "card")
# Groups of digits one blank or hyphen apart, 13 digits at least; a card begins and ends at borders of groups.
RUN = r"(?<!\d)(?=\d(?:[ \-]?\d){12})\d++(?:[ \-]\d++)*+"
CARD_DIGITS = (13, 19)


def _round(key: str, tweak: str, i: Column, other: Column) -> Column:
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(tweak), i.cast("string"), other.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def permute(left: Column, right: Column, a: Column, b: Column, tweak: str, key: str) -> Column:
    """A keyed permutation of the pairs below ``(a, b)``, as a struct of ``l`` and ``r``."""
    start = F.struct(left.cast("bigint").alias("l"), right.cast("bigint").alias("r"), a.cast("bigint").alias("a"), b.cast("bigint").alias("b"))

    def step(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        return F.struct(
            F.when(even, (s["l"] + _round(key, tweak, i, s["r"])) % s["a"]).otherwise(s["l"]).alias("l"),
            F.when(even, s["r"]).otherwise((s["r"] + _round(key, tweak, i, s["l"])) % s["b"]).alias("r"),
            s["a"].alias("a"), s["b"].alias("b"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def permute_digits(digits: Column, tweak: str, key: str) -> Column:
    """Digits of equal number, permuted."""
    half = F.floor(F.length(digits) / 2).cast("int")
    rest = F.length(digits) - half
    power = lambda n: F.rpad(F.lit("1"), n + 1, "0").cast("bigint")
    out = permute(F.substr(digits, F.lit(1), half), F.substr(digits, half + 1, rest), power(half), power(rest), tweak, key)
    padded = lambda x, n: F.lpad(x.cast("string"), n, "0")
    return F.transform(F.array(out), lambda s: F.concat(padded(s["l"], half), padded(s["r"], rest)))[0]


def luhn_sum(digits: Column) -> Column:
    """Luhn sum of digits, the last one not doubled."""
    places = F.sequence(F.lit(1), F.length(digits))
    return F.aggregate(places, F.lit(0), lambda total, i: total + F.transform(
        F.array(F.substr(digits, i, F.lit(1)).cast("int") * (1 + (F.length(digits) - i) % 2)), lambda d: d - F.when(d > 9, 9).otherwise(0))[0])


def fill(layout: Column, digits: Column, skip: int = 0) -> Column:
    """``layout`` with its digits after the first ``skip`` replaced in order."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("n"))

    def step(s: Column, c: Column) -> Column:
        is_digit = c.between("0", "9")
        chosen = F.when(is_digit & (s["n"] >= skip), F.substr(digits, s["n"] - skip + 1, F.lit(1))).otherwise(c)
        return F.struct(F.concat(s["out"], chosen).alias("out"), (s["n"] + is_digit.cast("int")).alias("n"))

    return F.aggregate(F.split(layout, ""), start, step, lambda s: s["out"])


def _let(value: Column, body) -> Column:
    """``body`` over a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def card(digits: Column, key: str) -> Column:
    """Digits of a card, permuted but for the last one, which is the check digit of the others."""
    head = permute_digits(F.substr(digits, F.lit(1), F.length(digits) - 1), "card", key)
    return _let(head, lambda h: F.concat(h, ((10 - luhn_sum(F.concat(h, F.lit("0"))) % 10) % 10).cast("string")))


def cards(run: Column, key: str) -> Column:
    """A run of digit groups with its cards replaced, and their number, as a struct of ``out`` and ``n``.

    Every span of groups with a valid check digit counts, from left to right and the longest one of each start.  A span
    inside those before it is part of them; one that reaches beyond them is replaced too, so no valid span stays.
    """
    least, most = CARD_DIGITS

    def renewed(digits: Column, ends: Column) -> Column:
        def step(s: Column, i: Column) -> Column:
            start = F.when(i == 0, 0).otherwise(F.get(ends, i - 1))
            valid = F.filter(F.slice(ends, i + 1, most), lambda e: F.when((e - start).between(least, most), luhn_sum(F.substr(digits, start + 1, e - start)) % 10 == 0).otherwise(False))

            def replaced(e: Column) -> Column:
                new = F.concat(F.substr(s["digits"], F.lit(1), start), card(F.substr(s["digits"], start + 1, e - start), key), F.substr(s["digits"], e + 1, F.length(digits)))
                return F.when(e > s["end"], F.struct(new.alias("digits"), e.alias("end"), (s["n"] + 1).alias("n"))).otherwise(s)

            return _let(F.array_max(valid), replaced)

        first = F.struct(digits.alias("digits"), F.lit(0).alias("end"), F.lit(0).alias("n"))
        places = F.sequence(F.lit(0), F.size(ends) - 1)
        return F.aggregate(places, first, step, lambda s: F.struct(F.when(s["n"] > 0, fill(run, s["digits"])).otherwise(run).alias("out"), s["n"].alias("n")))

    lengths = F.transform(F.split(run, r"\D"), lambda g: F.length(g))
    borders = F.aggregate(lengths, F.array().cast("array<int>"), lambda out, n: F.concat(out, F.array(F.coalesce(F.get(out, F.size(out) - 1), F.lit(0)) + n)))
    return _let(borders, lambda ends: _let(_digits(run), lambda digits: renewed(digits, ends)))


def without_cards(text: Column, key: str) -> Column:
    """Text with its cards replaced, and their number, as a struct of ``out`` and ``n``."""
    runs = F.transform(F.regexp_extract_all(text, F.lit(RUN), F.lit(0)), lambda r: cards(r, key))

    def joined(found: Column) -> Column:
        pieces = F.zip_with(F.split(text, RUN, -1), found, lambda p, f: F.concat(p, F.coalesce(f["out"], F.lit(""))))
        return F.struct(F.array_join(pieces, "").alias("out"), F.aggregate(found, F.lit(0), lambda n, f: n + f["n"]).alias("n"))

    return F.when(text.rlike(CARD), _let(runs, joined)).otherwise(F.struct(text.alias("out"), F.lit(0).alias("n")))


def phone(found: Column, key: str) -> Column:
    """The first digit, which begins the country code, stays."""
    return _let(_digits(found), lambda d: fill(found, permute_digits(F.substr(d, F.lit(2), F.length(d) - 1), "phone", key), 1))


def address(found: Column, key: str) -> Column:
    parts = F.transform(F.split(found, r"\."), lambda p: p.cast("bigint"))

    def renewed(p: Column) -> Column:
        out = permute(p[0] * 256 + p[1], p[2] * 256 + p[3], F.lit(65536), F.lit(65536), "address", key)
        dotted = _let(out, lambda s: F.concat_ws(".", *[x.cast("string") for x in (F.floor(s["l"] / 256), s["l"] % 256, F.floor(s["r"] / 256), s["r"] % 256)]))
        return F.when(F.array_max(p) < 256, dotted).otherwise(found)

    return _let(parts, renewed)


def social(found: Column, key: str) -> Column:
    """Areas 001 to 899 but 666, groups 01 to 99, serials 0001 to 9999."""
    return _let(_digits(found), lambda digits: _social(found, digits, key))


def _social(found: Column, digits: Column, key: str) -> Column:
    area, group, serial = (F.substr(digits, F.lit(a), F.lit(n)).cast("bigint") for a, n in ((1, 3), (4, 2), (6, 4)))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    place = (area - F.when(area > 666, 2).otherwise(1)) * 99 + group - 1
    out = permute(place, serial - 1, F.lit(898 * 99), F.lit(9999), "social", key)

    def shown(s: Column) -> Column:
        at = F.floor(s["l"] / 99)
        number = at + F.when(at >= 665, 2).otherwise(1)
        return F.concat(F.lpad(number.cast("string"), 3, "0"), F.lpad((s["l"] % 99 + 1).cast("string"), 2, "0"), F.lpad((s["r"] + 1).cast("string"), 4, "0"))

    return F.when(valid, fill(found, _let(out, shown))).otherwise(found)


def _moved_day(day: Column, key: str) -> Column:
    """A date moved within the 400 years; null outside them."""
    first = F.lit(FIRST_DAY).cast("date")
    n = F.datediff(day, first)
    out = permute(F.floor(n / DAYS[1]), n % DAYS[1], F.lit(DAYS[0]), F.lit(DAYS[1]), "date", key)
    moved = _let(out, lambda s: F.date_add(first, (s["l"] * DAYS[1] + s["r"]).cast("int")))
    return F.when(n.between(0, DAYS[0] * DAYS[1] - 1), moved)


def date(found: Column, key: str) -> Column:
    return F.coalesce(_let(F.try_to_date(found, "yyyy-MM-dd"), lambda d: _moved_day(d, key)).cast("string"), found)


def day(found: Column, key: str) -> Column:
    """A date with slashes or dots; equal dates get equal pseudonyms, in whatever form they stand."""
    mark = F.when(F.contains(found, F.lit("/")), "/").otherwise(".")

    def form(parts: Column, d: int, m: int, names: tuple[str, str]) -> Column:
        read = F.try_to_date(F.concat_ws("-", parts[2], F.lpad(parts[m], 2, "0"), F.lpad(parts[d], 2, "0")), "yyyy-MM-dd")
        shown = lambda x: F.concat(F.date_format(x, names[0]), mark, F.date_format(x, names[1]), mark, F.date_format(x, "yyyy"))
        return _let(_let(read, lambda x: _moved_day(x, key)), shown)

    def renewed(parts: Column) -> Column:
        return F.coalesce(form(parts, 0, 1, ("dd", "MM")), form(parts, 1, 0, ("MM", "dd")), found)

    return _let(F.split(found, r"[/.]"), renewed)


def letters(text: Column, tweak: str, key: str) -> Column:
    """Letters and digits permuted within a-z, A-Z and 0-9, half against half; all else stays in place."""
    half = F.floor(F.length(text) / 2).cast("int")
    start = F.struct(F.substr(text, F.lit(1), half).alias("l"), F.substr(text, half + 1, F.length(text)).alias("r"))

    def moved(part: Column, i: Column, other: Column) -> Column:
        def shifted(chars: Column, beyond: Column) -> Column:
            # A digest of 64 hexadecimal digits moves 32 letters; those beyond the fourth are made from a digest of the
            # other half, so that the time of a long value grows with its length.
            def block(n: Column) -> Column:
                source = F.when(n < 4, other).otherwise(beyond)
                digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(tweak), i.cast("string"), n.cast("string"), source), 256)
                return _let(digest, lambda d: F.array_join(F.transform(F.slice(chars, n * 32 + 1, 32), lambda c, at: one(c, at, d)), ""))

            return F.array_join(F.transform(F.sequence(F.lit(0), F.floor((F.size(chars) - 1) / 32).cast("int")), block), "")

        def one(c: Column, at: Column, digest: Column) -> Column:
            by = F.conv(F.substr(digest, at * 2 + 1, F.lit(2)), 16, 10).cast("int")
            shift = lambda a, size: F.char(F.pmod(F.ascii(c) - a + by, F.lit(size)) + a)
            return F.when(c.between("a", "z"), shift(97, 26)).when(c.between("A", "Z"), shift(65, 26)).when(c.between("0", "9"), shift(48, 10)).otherwise(c)

        long = F.length(part) > 128
        return _let(F.when(long, F.sha2(other, 256)), lambda beyond: _let(F.split(part, ""), lambda chars: shifted(chars, beyond)))

    def step(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        return F.struct(F.when(even, moved(s["l"], i, s["r"])).otherwise(s["l"]).alias("l"),
                        F.when(even, s["r"]).otherwise(moved(s["r"], i, s["l"])).alias("r"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: F.concat(s["l"], s["r"]))


def mail(found: Column, key: str) -> Column:
    """All but the last part of the host's name, in lower case."""
    found = F.lower(found)
    end = F.regexp_extract(found, r"(\.[A-Za-z]+)$", 1)
    return F.concat(letters(F.regexp_replace(found, r"\.[A-Za-z]+$", ""), "mail", key), end)


def secret(found: Column, key: str) -> Column:
    name = F.regexp_extract(found, f"^({SECRET_NAME}|AKIA)", 1)
    return F.concat(name, letters(F.substr(found, F.length(name) + 1, F.length(found)), "secret", key))


def _rest_97(code: Column) -> Column:
    """An account number's remainder by 97, its first four characters moved to the end and letters read as 10 to 35."""
    moved = F.concat(F.substr(code, F.lit(5), F.length(code)), F.substr(code, F.lit(1), F.lit(4)))
    value = lambda c: F.when(c.between("0", "9"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(moved, ""), F.lit(0), lambda rest, c: (rest * F.when(c.between("0", "9"), 10).otherwise(100) + value(c)) % 97)


def iban(found: Column, key: str) -> Column:
    """The longest valid prefix of the groups; where there is none, cards are looked for."""
    groups = F.split(found, " ")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(groups)), lambda n: F.array_join(F.slice(groups, F.lit(1), n), " "))
    compact = lambda x: F.replace(x, F.lit(" "), F.lit(""))
    valid = F.filter(prefixes, lambda p: F.when(F.length(compact(p)).between(15, 34), _rest_97(compact(p)) == 1).otherwise(False))

    def renewed(p: Column) -> Column:
        body = letters(F.substr(p, F.lit(5), F.length(p)), "iban", key)

        def checked(b: Column) -> Column:
            country = F.substr(p, F.lit(1), F.lit(2))
            check = 98 - _rest_97(compact(F.concat(country, F.lit("00"), b)))
            return F.concat(country, F.lpad(check.cast("string"), 2, "0"), b, F.substr(found, F.length(p) + 1, F.length(found)))

        return F.when(p.isNull(), without_cards(found, key)["out"]).otherwise(_let(body, checked))

    return _let(F.get(valid, F.size(valid) - 1), renewed)


PSEUDONYMS = {
    "mail": mail, "secret": secret, "iban": iban, "phone": phone, "national": phone, "date": date, "day": day,
    "social": social, "address": address,
}


def kind_of(found: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, pattern in reversed(KINDS):
        out = F.when(found.rlike(f"^(?:{pattern})$"), name).otherwise(out)
    return out


def pseudonymised(docs: DataFrame, key: str, text: str = "text", found: str = "n_replaced") -> DataFrame:
    """``docs`` with personal data in ``text`` replaced; ``found`` counts the values that changed."""
    body = F.col(text)

    def renewed(m: Column) -> Column:
        kind = kind_of(m)
        out = m
        for name in reversed(PSEUDONYMS):
            out = F.when(kind == name, PSEUDONYMS[name](m, key)).otherwise(out)
        return out

    # Cards are looked for between the other values, so that a number that is none hides nothing.  The row is packed, so no
    # column of its own can clash with the names used here.
    values = F.regexp_extract_all(body, F.lit(OTHERS), F.lit(0))
    marked = docs.select(F.struct("*").alias("row"), body.alias("body"), F.when(body.rlike(ANY), values).alias("found"))
    marked = marked.withColumn("new", F.transform("found", renewed))
    marked = marked.withColumn("pieces", F.when(F.col("found").isNotNull(), F.transform(F.split("body", OTHERS, -1), lambda p: without_cards(p, key))))
    joined = F.array_join(F.flatten(F.zip_with("pieces", "new", lambda p, n: F.array(p["out"], F.coalesce(n, F.lit(""))))), "")
    changed = F.size(F.filter(F.zip_with("found", "new", lambda a, b: a != b), lambda x: x))
    changed = changed + F.aggregate("pieces", F.lit(0), lambda n, p: n + p["n"])
    kept = [F.when(F.col("found").isNull(), F.col("body")).otherwise(joined).alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns if c != found]
    return marked.select(*kept, F.when(F.col("found").isNull(), 0).otherwise(changed).cast("bigint").alias(found))
