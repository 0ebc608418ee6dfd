"""Token functions as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters that are read for digits, and the digits meant.
CONFUSED, MEANT = "OoIl|ZzSsBG", "00111225586"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def count_of(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{pattern}]", ""))


def hardened(text: Column) -> Column:
    """The number meant by a misread token, or null: two digits at least, more digits than letters, only confusable letters."""
    digits, letters = count_of(text, "0-9"), count_of(text, "A-Za-z|")
    odd = count_of(text, "OoIl|ZzSsBG")
    furniture = ~text.rlike(r"[^0-9OoIl|ZzSsBG.,'\-+%€$£ ]")
    return F.when((digits >= 2) & (digits > letters) & (letters >= 1) & (odd == letters) & furniture, F.translate(text, CONFUSED, MEANT))


def amount_cents(text: Column) -> Column:
    """Money in cents; the last separator is decimal iff exactly two digits follow. Null if the text is no amount."""
    plain = F.regexp_replace(text, "[€$£ '+]", "")
    sign = F.when(plain.startswith("-"), -1).otherwise(1)
    body = F.regexp_replace(plain, "^-", "")
    decimal = body.rlike("[.,][0-9]{2}$")
    digits = F.regexp_replace(body, "[.,]", "")
    cents = F.expr("try_cast(null as bigint)")
    cents = F.when(decimal, digits.try_cast("bigint")).otherwise(digits.try_cast("bigint") * 100)
    return F.when(body.rlike("^[0-9][0-9.,]*$"), sign * cents)


def label(text: Column) -> Column:
    """A label without trailing signs, in ASCII lower case."""
    return F.regexp_replace(F.translate(text, UPPER, LOWER), "[:.]+$", "")


def like_iban(text: Column) -> Column:
    return text.rlike("^[A-Za-z]{2}[0-9]{2}[A-Za-z0-9]{11,30}$")


def mod97(digits: Column) -> Column:
    """A string of decimal digits modulo 97."""
    chars = F.filter(F.split(digits, ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(0), lambda a, c: (a * 10 + c.cast("int")) % 97)


def iban_valid(text: Column) -> Column:
    """ISO 7064: the first four signs moved to the end, letters as numbers, is 1 modulo 97."""
    moved = F.upper(F.concat(F.substring(text, 5, 40), F.substring(text, 1, 4)))
    chars = F.filter(F.split(moved, ""), lambda c: c != "")
    digits = F.array_join(F.transform(chars, lambda c: F.when(c.between("0", "9"), c).otherwise((F.ascii(c) - 55).cast("string"))), "")
    return like_iban(text) & (mod97(digits) == 1)


def page_number(text: Column) -> Column:
    """The number in ``7``, ``- 7 -``, ``seite 7 (von m)``, ``page 7 (of m)`` or ``7 / m``, or null."""
    own = F.translate(F.trim(text), UPPER, LOWER)
    found = F.coalesce(
        F.nullif(F.regexp_extract(own, r"^([0-9]{1,4})$", 1), F.lit("")),
        F.nullif(F.regexp_extract(own, r"^-\s*([0-9]+)\s*-$", 1), F.lit("")),
        F.nullif(F.regexp_extract(own, r"^seite ([0-9]+)( von [0-9]+)?$", 1), F.lit("")),
        F.nullif(F.regexp_extract(own, r"^page ([0-9]+)( of [0-9]+)?$", 1), F.lit("")),
        F.nullif(F.regexp_extract(own, r"^([0-9]+) / [0-9]+$", 1), F.lit("")),
    )
    return found.try_cast("int")


def names_amount(text: Column) -> Column:
    """Whether a line names a sum of money (fixed words)."""
    return F.translate(text, UPPER, LOWER).rlike("netto|brutto|summe")


def markup_escaped(text: Column) -> Column:
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    for sign, entity in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(sign), F.lit(entity))
    return out


def sentence_ends(text: Column) -> Column:
    """Number of runs of ``.!?`` that end a sentence; a point between digits ends none."""
    return F.regexp_count(text, F.lit(r"(?<![.!?])[.!?]+(?=\s|$)"))
