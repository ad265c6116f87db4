"""Personal data: regular expressions propose spans, checksums confirm them, nearby words adjust the score.

Main path: built-in functions only. Account numbers are taken at the length of their country, so what
follows in capitals isn't part of them. Words within CONTEXT_CHARS on either side raise or lower a
span's score; the score decides over the added kinds, never over the base ones.

A null text counts as empty and gives a row without spans; null or repeated ids are passed on as they
are; spans of two kinds that begin together are both kept, in the kinds' order; an empty table gives an
empty table; texts are scanned whole, however long. Other columns of the input, whatever their names,
aren't read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spans as S
from .common import quoted

#: Length of account numbers by country (fixed values).
IBAN_LENGTH = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22,
    "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22,
    "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30,
    "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31,
    "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24,
    "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}


def _accounts() -> str:
    """One alternative for each length: its countries, two digits, then as many letters and digits as are left, spaces between them allowed."""
    by_length: dict[int, list[str]] = {}
    for country, n in IBAN_LENGTH.items():
        by_length.setdefault(n, []).append(country)
    rest = "|".join(rf"(?:{'|'.join(c)})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, c in sorted(by_length.items()))
    return rf"(?<![A-Za-z0-9])(?:{rest})(?![A-Za-z0-9])"


#: The kinds in order. Possessive quantifiers and the look-behinds only spare the engine attempts that must fail.
KINDS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": _accounts(),
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
BASE = ("email", "ip", "card", "phone")
#: Cheap tests a text must pass before a pattern is tried.
HINT = {"email": "@", "ip": ".", "phone": "+", "ssn": "-"}
#: What each kind scores by itself, and the words beside it that raise the score; DOUBT has those that lower any.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.95, "ssn": 0.4}
CONTEXT = {
    "email": "mail|contact|write|correo|courriel",
    "ip": "ip|host|server|address|addr|adresse",
    "card": "card|visa|credit|debit|pay|karte|carte|tarjeta",
    "phone": "phone|call|tel|mobile|fax|anruf",
    "iban": "iban|account|bank|konto|compte|cuenta",
    "ssn": "ssn|social|security",
}
#: A number of at most 255, leading zeros allowed.
BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
DOUBT = "example|sample|dummy|fake|fictitious|placeholder"
CONTEXT_GAIN, CONTEXT_LOSS, CONTEXT_CHARS, ADDED_AT = 0.3, 0.2, 40, 0.65


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    d = F.split(F.reverse(number), "")

    def step(acc: Column, i: Column) -> Column:
        x = F.element_at(d, i + 1).cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return acc + F.when(x > 9, x - 9).otherwise(x)

    return F.aggregate(F.sequence(F.lit(0), F.length(number) - 1), F.lit(0), step) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an account number (letters and digits) leaves 1 modulo 97 with its first four characters moved last."""
    moved = F.concat(F.substring(account, 5, 60), F.substring(account, 1, 4))

    def step(acc: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code < 65, acc * 10 + code - 48).otherwise(acc * 100 + code - 55) % 97

    return F.aggregate(F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0), step) == 1


def confirmed(kind: str, m: Column) -> Column:
    number = S.digits(m)
    if kind == "ip":
        return m.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")
    if kind == "card":
        return F.length(number).between(12, 19) & luhn(number)
    if kind == "phone":
        return F.length(number).between(9, 15)
    if kind == "iban":
        plain = F.replace(m, F.lit(" "), F.lit(""))
        return mod97(plain)
    return F.lit(True)


def keeps(kind: str) -> Callable[[Column], Column]:
    return lambda span: confirmed(kind, span["match"])


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, ``base`` spans of the four first kinds, and ``spans`` with the added kinds and a score each.

    Added kinds are taken when their score (prior plus context) reaches ``ADDED_AT``.
    """
    df = docs.select(quoted(doc_id).alias("doc_id"), F.coalesce(quoted(text), F.lit("")).alias("text"))
    none = F.array().cast("array<string>")
    df = df.select("*", *(F.when(F.instr("text", HINT[k]) > 0, S.matches(F.col("text"), p)).otherwise(none).alias(f"m_{k}") if k in HINT else S.matches(F.col("text"), p).alias(f"m_{k}") for k, p in KINDS.items()))
    df = df.select("*", *(S.gaps(F.col("text"), p, F.col(f"m_{k}")).alias(f"g_{k}") for k, p in KINDS.items()))
    df = df.select("doc_id", "text", *(F.filter(S.kinded(S.located(F.col(f"m_{k}"), F.col(f"g_{k}")), k, i), keeps(k)).alias(f"s_{k}") for i, k in enumerate(KINDS)))

    def scored(k: str) -> Column:
        def score(s: Column) -> Column:
            before = F.substring(F.col("text"), F.greatest(s["start"] - CONTEXT_CHARS, F.lit(0)) + 1, F.least(s["start"], F.lit(CONTEXT_CHARS)))
            beside = F.lower(F.concat(before, F.lit(" | "), F.substring(F.col("text"), s["end"] + 1, F.lit(CONTEXT_CHARS))))
            gain = F.when(beside.rlike(rf"\b(?:{CONTEXT[k]})"), CONTEXT_GAIN).otherwise(0.0) - F.when(beside.rlike(rf"\b(?:{DOUBT})"), CONTEXT_LOSS).otherwise(0.0)
            return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(PRIOR[k]) + gain))

        return F.transform(F.col(f"s_{k}"), lambda s: F.struct(s["start"].alias("start"), s["kind_no"].alias("kind_no"), s["end"].alias("end"), s["kind"].alias("kind"), s["match"].alias("match"), score(s).alias("score")))

    df = df.select("doc_id", *(F.when(F.size(f"s_{k}") > 0, scored(k)).otherwise(F.array().cast("array<struct<start:int,kind_no:int,end:int,kind:string,match:string,score:double>>")).alias(f"s_{k}") for k in KINDS))
    added = [F.filter(F.col(f"s_{k}"), lambda s: s["score"] >= ADDED_AT) for k in KINDS if k not in BASE]
    return df.select("doc_id", S.ordered([F.col(f"s_{k}") for k in BASE]).alias("base"), S.ordered([*(F.col(f"s_{k}") for k in BASE), *added]).alias("spans"))


def report(found: DataFrame) -> DataFrame:
    """Digest columns of ``find``'s result."""
    base = F.col("base")
    return found.select(
        "doc_id",
        *(S.count_of(k)(base).alias(f"n_{k}") for k in BASE),
        F.sha2(S.written(base), 256).alias("base_sha256"),
        S.written(F.col("spans")).alias("spans"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0)).alias("max_score"),
    )
