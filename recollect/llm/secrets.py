"""Secrets: known shapes by pattern, unknown ones by a battery of randomness tests with false-discovery control.

Main path: built-in functions only. A candidate is a maximal run of at least 20 key characters with
digits and letters among them, however long, also right behind a '=' (NAME=value). Its encoding is the
smallest alphabet that holds its characters (hex, base32 or base36 of either case, base64). Three tests ask whether it could be
drawn uniformly from that alphabet: chi-squared on the letter counts, a runs test about the middle
of the alphabet, and lag-1 serial correlation; Fisher's method joins their p-values, and a candidate
below UNIFORM isn't random.

What is controlled is the share of false reports. The null hypothesis is an ordinary run: words
strung together, as in identifiers and paths. Its letters' information (how unlikely they are one
after the other) is modelled on all words of the corpus; the p-value of a candidate is the probability
that an ordinary run with as many letters carries that much, by a gamma distribution of the same mean
and variance. It counts as 1 where the battery says that the candidate isn't random. Benjamini-Hochberg,
separately for each band of lengths, since the power grows with length, says which are reported.

A null text counts as empty; null or repeated ids are passed on; equal p-values are reported together or
not at all; an empty table gives an empty table; texts are scanned whole, however long; other columns,
whatever their names, aren't read. ``redact`` passes them on and leaves a null text null.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import spans as S
from .common import cut, quoted

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
BASE = ("assign", "access", "hex")
ASSIGN_MIN = 12
#: Maximal runs of key characters; the word inside must use digits and letters.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+(?:={1,2}(?![A-Za-z0-9+/_=-]))?"
#: Alphabets, the smallest first; base64url characters are read as their base64 partners.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "upper_hex": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "lower_base32": "abcdefghijklmnopqrstuvwxyz234567",
    "alnum36": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower_alnum36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
FDR = 0.05
#: Candidates that the battery finds less likely than this, were they random, aren't.
UNIFORM = 1e-4
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: Words of a corpus: runs of small letters, the first one perhaps a capital.
WORD = "[A-Za-z][a-z]{2,}"
#: Words that every corpus is taken to have, each FAMILIAR_TIMES, so that the model is sensible where there is little text.
FAMILIAR = """
about account action after again alert also api array before begin block build button cache call case change check child class client
close code color column common config content context control count create current customer data date default delete device direct
document does each edit email entry error event every factory field file filter final find first folder form from function general
global group handle have header height image index input instance into item just key label language last layout left length level
like limit line list load local login main make manager many message method model module more most name never next node number object
only open option order other output over page parent parse path people place point position private process product project public
query read record release remove report request response result return right root route same second select server service session
should show simple size some source start state status string style submit table target task test text that their then there these
this time title total type under update upload user value version view when where which window with word work would write
"""
FAMILIAR_TIMES, SMOOTHING = 10, 0.5
#: How information is written into a character: steps of a nat, and the character of 0.
STEPS, FIRST = 8, 33
#: Lower ends of the bands of lengths, and how finely p-values are counted: bins for each factor of ten, down to 1e-30.
BANDS, PER_DECADE, DECADES = (20, 24, 32, 48, 64, 128), 10, 30


def normal_tail(z: Column) -> Column:
    """P(Z > z), by a logistic approximation with an error below 2e-4."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(F.least(F.greatest(F.lit(1.5976) * z + F.lit(0.07056) * z * z * z, F.lit(-600.0)), F.lit(600.0))))


def chi_squared_tail(x: Column, df: Column) -> Column:
    """P(chi-squared with df degrees > x), by the cube-root approximation."""
    v = F.lit(2.0) / (F.lit(9.0) * df)
    return normal_tail((F.cbrt(x / df) - (F.lit(1.0) - v)) / F.sqrt(v))


def encoded(span: Column) -> Column:
    """A candidate span with its characters, without padding."""
    plain = F.translate(F.rtrim(F.translate(span["match"], "=", " ")), "-_", "+/")
    return F.struct(span["start"].alias("start"), span["end"].alias("end"), span["match"].alias("match"), plain.alias("plain"))


def named(c: Column) -> Column:
    """The smallest alphabet that holds the characters."""
    plain = c["plain"]
    encoding = (
        F.when(plain.rlike("^[0-9a-f]+$"), "hex")
        .when(plain.rlike("^[0-9A-F]+$"), "upper_hex")
        .when(plain.rlike("^[A-Z2-7]+$"), "base32")
        .when(plain.rlike("^[a-z2-7]+$"), "lower_base32")
        .when(plain.rlike("^[A-Z0-9]+$"), "alnum36")
        .when(plain.rlike("^[a-z0-9]+$"), "lower_alnum36")
        .otherwise("base64")
    )
    alphabet = F.element_at(F.create_map(*(F.lit(x) for kv in ALPHABETS.items() for x in kv)), encoding)
    return F.struct(c["start"].alias("start"), c["end"].alias("end"), c["match"].alias("match"), plain.alias("plain"), encoding.alias("encoding"), alphabet.alias("alphabet"))


def coded(c: Column) -> Column:
    """The characters' numbers in the alphabet."""
    codes = F.transform(F.filter(F.split(c["plain"], ""), lambda x: x != ""), lambda x: F.instr(c["alphabet"], x) - 1)
    return F.struct(c["start"].alias("start"), c["end"].alias("end"), c["match"].alias("match"), c["encoding"].alias("encoding"), F.length(c["alphabet"]).cast("double").alias("k"), codes.alias("codes"))


def counted(c: Column) -> Column:
    """What the tests need of a candidate's codes, each counted once, so that long runs cost in proportion."""
    codes, k = c["codes"], c["k"]
    squares = F.aggregate(F.array_distinct(codes), F.lit(0.0), lambda acc, x: acc + F.pow(F.size(F.filter(codes, lambda y: y == x)).cast("double"), F.lit(2.0)))
    up = F.aggregate(codes, F.lit(0.0), lambda acc, x: acc + F.when(x >= k / 2, 1).otherwise(0))
    pairs = F.zip_with(F.slice(codes, F.lit(1), F.size(codes) - 1), F.slice(codes, F.lit(2), F.size(codes) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    runs = F.aggregate(pairs, F.lit(1.0), lambda acc, p: acc + F.when((p["a"] >= k / 2) != (p["b"] >= k / 2), 1.0).otherwise(0.0))
    centre = (k - 1) / 2
    lagged = F.aggregate(pairs, F.lit(0.0), lambda acc, p: acc + (p["a"] - centre) * (p["b"] - centre))
    return F.struct(*(c[x].alias(x) for x in ("start", "end", "match", "encoding", "k")), F.size(codes).cast("double").alias("n"), squares.alias("squares"), up.alias("up"), runs.alias("runs"), lagged.alias("lagged"))


def p_value(c: Column) -> Column:
    """From a struct with the counts of a candidate's characters."""
    n, k, up = c["n"], c["k"], c["up"]
    chi = chi_squared_tail(F.greatest(c["squares"] * k / n - n, F.lit(0.0)), k - 1)
    both = F.lit(2.0) * up * (n - up)
    mean_runs, var_runs = both / n + 1, both * (both - n) / (n * n * (n - 1))
    run_test = F.when(var_runs <= 0, 1e-6).otherwise(F.least(F.lit(1.0), F.lit(2.0) * normal_tail(F.abs(c["runs"] - mean_runs) / F.sqrt(var_runs))))
    serial = F.least(F.lit(1.0), F.lit(2.0) * normal_tail(F.abs(c["lagged"]) / (F.sqrt(n - 1) * (k * k - 1) / 12)))
    joint = F.lit(-2.0) * sum((F.log(F.greatest(p, F.lit(1e-30))) for p in (chi, run_test, serial)), F.lit(0.0))
    return chi_squared_tail(joint, F.lit(6.0))


class Ordinary:
    """Information (nats) of the letters of ordinary words, one after the other: a small table, its mean and its variance.

    A letter is the first of a word (after what is no letter, or a capital) or follows another one.
    """

    def __init__(self, counts: dict[str, int]):
        first, after = [SMOOTHING] * 26, [[SMOOTHING] * 26 for _ in LOWER]
        at = {c: i for i, c in enumerate(LOWER)}
        familiar: dict[str, int] = {}
        for word in FAMILIAR.split():
            for pair in (" " + word[0], *(word[i : i + 2] for i in range(len(word) - 1))):
                familiar[pair] = familiar.get(pair, 0) + FAMILIAR_TIMES
        for source in (familiar, counts):
            for pair, n in source.items():
                row = first if pair[0] == " " else after[at[pair[0]]]
                row[at[pair[1]]] += n
        begins = sum(first) / (sum(first) + sum(map(sum, after)))
        exact = [(n, -math.log((1 - begins) * n / sum(row))) for row in after for n in row] + [(n, -math.log(begins * n / sum(first))) for n in first]
        # A character for each cell, in steps of 1 / STEPS: a plan carries one short literal.
        self.table = "".join(chr(FIRST + min(round(x * STEPS), 125 - FIRST)) for _, x in exact)
        cells = [(n, (ord(x) - FIRST) / STEPS) for (n, _), x in zip(exact, self.table, strict=True)]
        total = sum(n for n, _ in cells)
        self.mean = sum(n * x for n, x in cells) / total
        self.variance = sum(n * (x - self.mean) ** 2 for n, x in cells) / total

    def p_value(self, c: Column) -> Column:
        """How likely an ordinary run with as many letters carries as much information as the candidate or more."""
        run = F.when(c["match"].rlike("[a-z]"), c["match"]).otherwise(F.lower(c["match"]))
        codes = F.transform(F.filter(F.split(run, ""), lambda x: x != ""), F.ascii)
        letter = lambda x: x.between(97, 122) | x.between(65, 90)
        number = lambda x: F.when(x >= 97, x - 97).otherwise(x - 65)
        pairs = F.zip_with(F.concat(F.array(F.lit(0)), F.slice(codes, F.lit(1), F.size(codes) - 1)), codes, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        cell = lambda z: F.when(letter(z["a"]) & (z["b"] >= 97), number(z["a"])).otherwise(26) * 26 + number(z["b"]) + 1
        each = F.transform(F.filter(pairs, lambda z: letter(z["b"])), lambda z: (F.ascii(F.substring(F.lit(self.table), cell(z).cast("int"), F.lit(1))) - FIRST) / STEPS)
        n, carried = F.size(each).cast("double"), F.aggregate(each, F.lit(0.0), lambda acc, x: acc + x)
        return F.when(n == 0, 1.0).otherwise(chi_squared_tail(carried * (2 * self.mean / self.variance), n * (2 * self.mean**2 / self.variance)))


def ordinary(docs: DataFrame, text: str = "text") -> Ordinary:
    """The model of all words of the corpus. Words are counted before letters are; 702 counts at most reach the driver."""
    words = docs.select(F.explode(S.matches(F.coalesce(quoted(text), F.lit("")), WORD)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    spelled = words.select(F.concat(F.lit(" "), F.lower("word")).alias("word"), "n")
    pairs = spelled.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring(F.col("word"), i, F.lit(2)))).alias("pair"), "n")
    return Ordinary({r["pair"]: r["n"] for r in pairs.groupBy("pair").agg(F.sum("n").alias("n")).collect()})


def tested(spans: Column, model: Ordinary) -> Column:
    """Encoding and p-values of candidate spans (``uniform`` of the battery, ``p`` for the control); step by step, so that none is taken again for each character."""
    for step in (encoded, named, coded, counted):
        spans = F.transform(spans, step)
    spans = F.transform(spans, lambda c: F.struct(*(c[x].alias(x) for x in ("start", "end", "match", "encoding")), p_value(c).alias("uniform"), model.p_value(c).alias("ordinary")))
    return F.transform(spans, lambda c: F.struct(*(c[x].alias(x) for x in ("start", "end", "match", "encoding", "uniform")), F.when(c["uniform"] >= UNIFORM, c["ordinary"]).otherwise(1.0).alias("p")))


def band(n: Column) -> Column:
    out = F.lit(BANDS[0])
    for low in BANDS[1:]:
        out = F.when(n >= low, low).otherwise(out)
    return out


def p_bin(p: Column) -> Column:
    """Bins of equal width in log10 p, small p-values first."""
    return F.floor(F.greatest(F.log10(F.greatest(p, F.lit(1e-30))) * PER_DECADE, F.lit(-PER_DECADE * DECADES))).cast("int")


def long_assignments(spans: Column, values: Column) -> Column:
    """Assignments whose value is long enough; ``values`` has the values in the order of the spans."""
    return F.transform(F.filter(F.zip_with(spans, values, lambda s, v: F.struct(s.alias("s"), v.alias("v"))), lambda x: F.length(x["v"]) >= ASSIGN_MIN), lambda x: x["s"])


def located(docs: DataFrame, text: str, keep: list[str], model: Ordinary, with_text: bool = False) -> DataFrame:
    """Base spans and tested candidates of each document, with the columns ``keep`` as one struct ``row``, and the text if it's asked for (``absent`` where it was null)."""
    df = docs.select(F.struct(*(quoted(c) for c in keep)).alias("row") if keep else F.lit(None).alias("row"), F.coalesce(quoted(text), F.lit("")).alias("text"), quoted(text).isNull().alias("absent"))
    kept = ["row", "text", "absent"] if with_text else ["row"]
    t, none = F.col("text"), F.array().cast("array<string>")
    patterns = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "random": CANDIDATE}
    assigned = F.when((F.instr("text", ":") > 0) | (F.instr("text", "=") > 0), S.matches(t, ASSIGN)).otherwise(none)
    df = df.select("*", assigned.alias("m_assign"), F.when(F.instr("text", "AKIA") > 0, S.matches(t, ACCESS)).otherwise(none).alias("m_access"), S.matches(t, HEX).alias("m_hex"), S.matches(t, CANDIDATE).alias("m_random"))
    df = df.select("*", F.when(F.size("m_assign") > 0, S.matches(t, ASSIGN, 2)).otherwise(none).alias("values"), *(S.gaps(t, p, F.col(f"m_{k}")).alias(f"g_{k}") for k, p in patterns.items()))
    at = {k: S.located(F.col(f"m_{k}"), F.col(f"g_{k}")) for k in patterns}
    mixed = F.filter(at["random"], lambda s: s["match"].rlike("[0-9]") & s["match"].rlike("[A-Za-z]"))
    return df.select(
        *kept,
        S.ordered([S.kinded(long_assignments(at["assign"], F.col("values")), "assign", 0), S.kinded(at["access"], "access", 1), S.kinded(at["hex"], "hex", 2)]).alias("base"),
        tested(mixed, model).alias("tried"),
    )


def thresholds(tried: DataFrame, fdr: float = FDR) -> dict[int, int]:
    """Benjamini-Hochberg over counts of p-values: for each band of lengths the last bin that is reported.

    At most ``len(BANDS)`` rows reach the driver.
    """
    each = tried.select(F.explode("tried").alias("c")).select(band(F.col("c.end") - F.col("c.start")).alias("band"), p_bin(F.col("c.p")).alias("bin"))
    counts = each.groupBy("band", "bin").agg(F.count("*").alias("n"))
    ranked = counts.select("band", "bin", F.sum("n").over(Window.partitionBy("band").orderBy("bin")).alias("upto"), F.sum("n").over(Window.partitionBy("band")).alias("all"))
    passing = ranked.where(F.pow(F.lit(10.0), (F.col("bin") + 1) / PER_DECADE) <= F.lit(fdr) * F.col("upto") / F.col("all"))
    return {r["band"]: r["bin"] for r in passing.groupBy("band").agg(F.max("bin").alias("bin")).collect()}


def reported(cutoffs: dict[int, int]) -> Callable[[Column], Column]:
    none = -PER_DECADE * DECADES - 1

    def test(c: Column) -> Column:
        cutoff = F.element_at(F.create_map(*(F.lit(x) for b in BANDS for x in (b, cutoffs.get(b, none)))), band(c["end"] - c["start"]))
        return p_bin(c["p"]) <= cutoff

    return test


def with_secrets(cutoffs: dict[int, int]) -> Column:
    """The base spans and the random strings that no base span covers exactly."""
    secret = reported(cutoffs)
    kept = F.filter("tried", lambda c: secret(c) & ~F.exists("base", lambda b: (b["start"] == c["start"]) & (b["end"] == c["end"])))
    return F.when(F.size("tried") > 0, S.ordered([F.col("base"), S.kinded(kept, "random", len(BASE))])).otherwise(F.col("base"))


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", fdr: float = FDR) -> DataFrame:
    """One row per document: ``doc_id``, ``base`` spans, and ``spans`` with the random strings."""
    found = cut(located(docs, text, [doc_id], ordinary(docs, text)))
    return found.select(F.col("row")[doc_id].alias("doc_id"), "base", with_secrets(thresholds(found, fdr)).alias("spans"))


def report(found: DataFrame) -> DataFrame:
    """Digest columns of ``find``'s result."""
    base = F.col("base")
    return found.select("doc_id", *(S.count_of(k)(base).alias(f"n_{k}") for k in BASE), F.sha2(S.written(base), 256).alias("base_sha256"), S.written(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, text: str = "text", mark: str = "[secret]", fdr: float = FDR) -> DataFrame:
    """``docs`` with every secret in the text replaced by a mark; all other columns and rows stay, a null text stays null.

    The texts are read three times (for the model, the thresholds, then the replacement) rather than shuffled or stored.
    """
    model = ordinary(docs, text)
    cutoffs = thresholds(located(docs, text, [], model), fdr)
    found = located(docs, text, [c for c in docs.columns if c != text], model, with_text=True).select("row", "text", "absent", with_secrets(cutoffs).alias("spans"))
    done = F.when(F.size("spans") > 0, S.replaced(F.col("text"), F.col("spans"), mark)).when(~F.col("absent"), F.col("text"))
    return found.select(*(done.alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns))
