"""Secrets in texts: fixed rules, and strings that look random to character Markov models.

Two first-order models over characters tell random strings from ordinary
identifiers: one learned from the values that the rules find, the other from
the words of all documents that no rule might concern. A string scores the sum of
the logarithms of its transitions' likelihood ratios; above the threshold it is
a span of kind ``random``. SQL functions throughout; what reaches the driver is
one count per pair of characters.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopygrid.llm.spans import located, written
from canopygrid.llm.tables import carried, stored

KINDS = {0: "assign", 1: "access", 2: "hex", 3: "random"}
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# Runs that are long enough; a shorter run holds no longer one.
ACCESS = r"AKIA[A-Z0-9]{12,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}+"
# Strings the models look at: whole runs of 16 characters and more with a letter among them.
STRING = r"(?<![A-Za-z0-9+/_=-])(?=[0-9+/_=-]*+[A-Za-z])[A-Za-z0-9+/_=-]{16,}+"
# Ordinary words: runs too short to be looked at themselves, so that no unknown secret teaches.
WORD = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{4,15}+(?![A-Za-z0-9+/_=-])"
NAMED = "(?i:password|passwd|secret|token|api_?key)"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."
# A string is reported when random is so many times likelier, in logarithms: one in ten thousand strings is.
THRESHOLD = math.log(10_000)
# Identifiers are joined by these; steps to and from them tell nothing.
JOINTS = "_-"
SMOOTHING = 2.0
COVER = "[SECRET]"


def scanned(docs: DataFrame, kept: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``kept``, base spans and candidate strings of every row.

    Strings are looked for in what the base spans leave: a longer one around a
    base span gives the parts on its sides.
    """
    text = F.col("_text")
    assign = F.filter(
        located(text, ASSIGN, text.rlike(NAMED)), lambda m: F.length(F.regexp_extract(m["match"], ASSIGN, 2)) >= 8
    )
    parts = {
        0: (assign, lambda m: F.regexp_extract(m, ASSIGN, 2)),
        1: (located(text, ACCESS, text.contains("AKIA")), lambda m: m),
        2: (located(text, HEX), lambda m: m),
        3: (located(F.col("_left"), STRING), lambda m: m),
    }

    def spans(kind: int) -> Column:
        found, secret = parts[kind]
        return F.transform(
            found,
            lambda m: F.struct(m["start"], F.lit(kind).alias("kind"), m["end"], secret(m["match"]).alias("value")),
        )

    rows = docs.select(*kept, F.col("text").alias("_text"))
    rows = rows.select(*kept, "_text", *[spans(k).alias(f"_s{k}") for k in range(3)])
    rows = rows.select(*kept, "_text", F.concat("_s0", "_s1", "_s2").alias("base"))
    blank = lambda at, s: F.repeat(F.lit(" "), F.greatest(F.lit(0), s["end"] - F.greatest(at, s["start"])))
    rows = rows.select(*kept, "base", replaced(text, F.col("base"), blank).alias("_left"))
    return rows.select(*kept, "base", spans(3).alias("strings"))


def replaced(text: Column, spans: Column, mark: Callable[[Column, Column], Column]) -> Column:
    """The text with each span replaced by ``mark`` of where the spans before it end, and the span."""
    kind = "struct<at:int,out:array<string>>"
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["end"])))

    def step(done: Column, s: Column) -> Column:
        gap = F.substring(text, done["at"] + 1, F.greatest(F.lit(0), s["start"] - done["at"]))
        out = F.concat(done["out"], F.array(gap, mark(done["at"], s)))
        return F.struct(F.greatest(done["at"], s["end"]).alias("at"), out.alias("out")).cast(kind)

    def end(done: Column) -> Column:
        rest = F.substring(text, done["at"] + 1, F.length(text))
        return F.array_join(F.concat(done["out"], F.array(rest)), "")

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")).cast(kind)
    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(ordered, start, step, end))


def _letter(text: Column, at: Column) -> Column:
    """Number of a character of the alphabet, from 1; 0 for any other."""
    return F.instr(F.lit(ALPHABET), F.substring(text, at, F.lit(1)))


def _steps(text: Column) -> Column:
    """Numbers of a string's transitions, the first from outside."""
    width = len(ALPHABET) + 1
    return F.transform(
        F.sequence(F.lit(1), F.length(text)),
        lambda i: F.when(i > 1, _letter(text, i - 1)).otherwise(0) * width + _letter(text, i),
    )


def _counted(strings: DataFrame) -> dict[int, int]:
    """Transitions of all strings (``value``, ``n`` times) by number: at most the square of the alphabet."""
    steps = strings.select(F.explode(_steps(F.col("value"))).alias("step"), "n")
    return dict(steps.groupBy("step").agg(F.sum("n")).collect())


def log_ratios(random: dict[int, int], ordinary: dict[int, int]) -> list[float]:
    """Log-likelihood ratio of each transition.

    Counts are smoothed towards even odds; half of the random model is an even
    draw from the alphabet, for kinds of random strings that no rule has found.
    """
    width = len(ALPHABET) + 1

    def model(counts: dict[int, int], even: float) -> list[float]:
        out = []
        for a in range(width):
            row = [counts.get(a * width + b, 0) for b in range(width)]
            total = sum(row) + SMOOTHING
            out += [(1 - even) * (n + SMOOTHING / width) / total + even / width for n in row]
        return out

    if not ordinary:
        return [0.0] * width**2
    joints = {ALPHABET.index(c) + 1 for c in JOINTS}
    return [
        0.0 if joints & {*divmod(step, width)} else math.log(p / q)
        for step, (p, q) in enumerate(zip(model(random, 0.5), model(ordinary, 0.0)))
    ]


def train(docs: DataFrame, found: DataFrame) -> list[float]:
    """Log-ratios learned from the base spans of ``found`` and the words of all ``docs`` that no rule might concern."""
    secrets = found.select(F.explode("base").alias("s")).select("s.value").filter("value <> ''").distinct()
    text = F.col("text")
    concerned = (text.rlike(NAMED) & text.rlike(ASSIGN)) | text.contains("AKIA") | text.rlike(HEX)
    words = docs.filter(~concerned).select(F.explode(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("value"))
    words = words.groupBy("value").agg(F.count("*").alias("n"))
    return log_ratios(_counted(secrets.withColumn("n", F.lit(1))), _counted(words))


def _score(text: Column, ratios: list[float]) -> Column:
    # One constant array, read by place.
    table = F.split(F.lit(",".join(f"{r:.6g}" for r in ratios)), ",").cast("array<double>")
    return F.aggregate(_steps(text), F.lit(0.0), lambda sum_, step: sum_ + F.get(table, step))


def with_spans(found: DataFrame, ratios: list[float], threshold: float = THRESHOLD) -> DataFrame:
    """Scanned rows with ``spans``: base ones and the strings that look random."""
    random = F.filter("strings", lambda s: _score(s["value"], ratios) > threshold)
    return found.withColumn("spans", F.concat("base", random)).drop("strings")


def find(docs: DataFrame) -> DataFrame:
    """doc_id, base and spans of every row, whatever its text; null texts have none."""
    found = stored(scanned(docs), "secrets")
    return with_spans(found, train(docs, found))


def report(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, counts and digest of the base spans, and all spans."""

    def number(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return find(docs).select(
        "doc_id",
        *[number(k).alias(f"n_{KINDS[k]}") for k in range(3)],
        F.sha2(written(F.col("base"), KINDS).cast("binary"), 256).alias("base_sha256"),
        written(F.col("spans"), KINDS).alias("spans"),
    )


def covered(text: Column, spans: Column, cover: str = COVER) -> Column:
    """The text with its spans replaced; overlapping spans are covered as one."""
    return replaced(text, spans, lambda at, s: F.when((s["start"] < at) & (at > 0), F.lit("")).otherwise(F.lit(cover)))


def redacted(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with every secret in their texts covered; all columns stay.

    Rows with a secret lose it and nothing else; the others are unchanged.
    """
    found = stored(scanned(docs), "secrets")
    ratios = train(docs, found)
    rows = with_spans(scanned(carried(docs, "text"), ("kept", "text")), ratios)
    rows = rows.select("kept", covered(F.col("text"), F.col("spans")).alias("covered"))
    return rows.select(F.col("kept").withField("text", F.col("covered")).alias("kept")).select("kept.*")
