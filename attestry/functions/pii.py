"""Classes of personal data, as one expression over a cell's text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as each class (JVM dialect).
EMAIL = r"(?iu)^[a-z0-9.!#$%&'*+/=?^_`{|}~-]+@[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?(?:\.[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?)+\z"
IPV4 = r"(?U)^(?:\d{1,3}\.){3}\d{1,3}\z"
IBAN = r"(?iU)^[A-Z]{2}\d{2}[A-Z0-9]{11,30}\z"
CARD = r"^[0-9 -]{13,23}\z"
PHONE = r"^\+?[0-9][0-9 ()-]{7,19}\z"
KINDS = ("email", "ipv4", "iban", "payment_card", "phone")


def trimmed(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def iban_ok(compact: Column) -> Column:
    """15 to 34 ASCII characters whose letters-as-numbers, first four last, leave 1 modulo 97."""
    moved = F.split(F.upper(F.concat(F.substring(compact, 5, 40), F.substring(compact, 1, 4))), "")
    value = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(moved, F.lit(0), lambda acc, c: F.when(c.between("0", "9"), (acc * 10 + value(c)) % 97).otherwise((acc * 100 + value(c)) % 97))
    return compact.rlike(r"^[A-Za-z0-9]{15,34}\z") & (rest == 1)


def classified(text: Column, numeric: Column) -> Column:
    """struct(kind, confidence) of the first class that the whole cell belongs to; null if none."""
    t = trimmed(text)
    compact = F.regexp_replace(t, r"(?U)\s", "")
    d = digits(t)
    low = numeric & t.rlike(r"^[0-9]+\z")
    hit = lambda kind, confidence: F.struct(F.lit(kind).alias("kind"), confidence.alias("confidence"))
    ip = t.rlike(IPV4) & F.forall(F.split(t, r"\."), lambda x: F.coalesce(x.try_cast("int") <= 255, F.lit(False)))
    return (
        F.when(t.rlike(EMAIL), hit("email", F.lit("high")))
        .when(ip, hit("ipv4", F.lit("high")))
        .when(compact.rlike(IBAN) & iban_ok(compact), hit("iban", F.lit("high")))
        .when(t.rlike(CARD) & F.length(d).between(13, 19) & F.call_function("luhn_check", d), hit("payment_card", F.when(low, "low").otherwise("high")))
        .when(t.rlike(PHONE) & F.length(d).between(8, 15), hit("phone", F.when(low, "low").otherwise("medium")))
    )
