"""Personal data in texts: fixed rules, widened by weak supervision.

Candidates are all base matches and looser ones of the same kinds: dotted
quads, long digit runs and phone numbers that fail a check, numbers in national
form, addresses spelled out. Four labelers vote +1, -1 or 0 on each: *rule* (the
base pattern and its checks), *gazetteer* (endings, issuers, networks, area
codes), *context* (words before it) and *edges* (what it touches).
Expectation-maximisation over the counts of vote patterns, kind by kind,
estimates how reliable each labeler is and how likely each pattern is personal
data. These probabilities are soft labels for the final span classifier, naive
Bayes over properties of the span itself. Candidates it finds likelier than not
join the base spans, which always stay.

SQL functions throughout; the driver sees vote patterns and property counts,
both bounded by their definition.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopygrid.llm.spans import located, written
from canopygrid.llm.tables import stored

KINDS = {0: "email", 1: "ip", 2: "card", 3: "phone"}
# Possessive forms of the base patterns: nothing they give up could match otherwise.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+"
# A whole run of digits singly spaced; shorter ones hold no card.
RUN = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
SPELLED = r"(?i)\b[a-z0-9._%+-]{1,64}\x20?[\[(]at[\])]\x20?[a-z0-9-]{1,63}\x20?[\[(]dot[\])]\x20?[a-z]{2,24}\b"
NATIONAL = r"(?<![0-9+])(?<!\+[0-9]{1,3}[\x20-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])"
OCTETS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])(?:\.|$)){4}$"

# Generic and national endings, issuer prefixes, networks nobody outside reaches.
ENDINGS = r"(?i)(?:\.|dot[\])]\x20?)(?:com|org|net|edu|gov|info|io|eu|uk|de|fr|es|it|nl|ch|at|be|us|ca|au)$"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))"
NOWHERE = r"^(?:0|127|22[4-9]|2[3-5][0-9])\."
COUNTRIES = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
# Words that announce or deny each kind.
ANNOUNCE = {
    0: "mail|contact|write|reach",
    1: "ip|address|host|server|client",
    2: "card|visa|master|credit|debit|pay",
    3: "phone|tel|call|mobile|cell|fax|sms",
}
DENY = {
    0: "example|noreply",
    1: "version|release|build|section|chapter",
    2: "isbn|order|invoice|sku|serial|tracking",
    3: "isbn|order|invoice|article|serial",
}
LABELERS = ("rule", "gazetteer", "context", "edges")
ROUNDS = 60


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def _by_kind(kind: int, patterns: dict[int, str], text: Column) -> Column:
    return text.rlike(rf"(?i)\b(?:{patterns[kind]})")


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _passes(kind: int, match: Column) -> Column:
    """The checks on a base match."""
    n = F.length(_digits(match))
    return {
        0: F.lit(True),
        1: match.rlike(OCTETS),
        2: n.between(14, 19) & F.call_function("luhn_check", _digits(match)),
        3: n.between(10, 15),
    }[kind]


def _listed(kind: int, match: Column) -> Column:
    """The gazetteer's vote."""
    return {
        0: _vote(match.rlike(ENDINGS), F.lit(True)),
        1: _vote(~match.rlike(NOWHERE), F.lit(True)),
        2: _vote(_digits(match).rlike(ISSUERS), F.lit(True)),
        3: _vote(match.rlike(COUNTRIES), match.startswith("+")),
    }[kind]


def _band(number: Column, *ends: int) -> Column:
    out = F.lit(str(len(ends)))
    for i in reversed(range(len(ends))):
        out = F.when(number < ends[i], str(i)).otherwise(out)
    return out


def _candidate(kind: int, m: Column, base: Column) -> Column:
    match, before, after = m["match"], m["before"], m["after"]
    last, next_ = F.substring(before, -1, 1), F.substring(after, 1, 1)
    touched = last.rlike("[A-Za-z0-9_/=#.-]") | next_.rlike("[A-Za-z0-9_/=@#-]")
    votes = (
        _vote(base, F.lit(kind in (1, 2, 3)) & ~base),
        _listed(kind, match),
        _vote(_by_kind(kind, ANNOUNCE, before), _by_kind(kind, DENY, before)),
        _vote(~touched, touched),
    )
    marks = F.length(F.regexp_replace(match, "[A-Za-z0-9]", ""))
    # Properties of the span itself, each with a handful of values.
    properties = (
        F.concat(F.lit("length "), _band(F.length(match), 8, 12, 16, 20, 28)),
        F.concat(F.lit("digits "), _band(F.length(_digits(match)), 1, 4, 8, 12, 15, 20)),
        F.concat(F.lit("marks "), _band(marks, 1, 2, 3, 4, 6)),
        F.concat(F.lit("rule "), base.cast("string")),
        F.concat(F.lit("touched "), touched.cast("string")),
    )
    return F.struct(
        m["start"].alias("start"),
        F.lit(kind).alias("kind"),
        m["end"].alias("end"),
        base.alias("base"),
        F.concat_ws(",", *[v.cast("string") for v in votes]).alias("votes"),
        F.array(*properties).alias("properties"),
    )


def candidates(docs: DataFrame, kept: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``kept`` and all candidates of every row, base matches among them."""
    text = F.col("text")
    digits = text.rlike("[0-9]")
    base = {
        0: located(text, EMAIL, text.contains("@")),
        1: located(text, IP, digits & text.contains(".")),
        2: located(text, RUN, digits),
        3: located(text, PHONE, text.contains("+")),
    }
    loose = {
        0: located(text, SPELLED, text.rlike(r"(?i)[\[(]at[\])]")),
        3: located(text, NATIONAL, digits),
    }
    rows = docs.select(
        *kept, *[m.alias(f"_b{k}") for k, m in base.items()], *[m.alias(f"_l{k}") for k, m in loose.items()]
    )

    def judged(column: str, kind: int, strict: bool) -> Column:
        return F.transform(
            column, lambda m: _candidate(kind, m, _passes(kind, m["match"]) if strict else F.lit(False))
        )

    parts = [judged(f"_b{k}", k, True) for k in base] + [judged(f"_l{k}", k, False) for k in loose]
    return rows.select(*kept, F.concat(*parts).alias("candidates"))


def reliabilities(counts: dict[tuple[int, ...], int], rounds: int = ROUNDS) -> dict[tuple[int, ...], float]:
    """Probability of each vote pattern, by expectation-maximisation over labelers that err independently.

    Begins from the votes' balance; every labeler keeps a little doubt.
    """
    patterns = list(counts)
    p = {v: 1 / (1 + math.exp(-1.5 * sum(v))) for v in patterns}
    for _ in range(rounds if patterns else 0):
        # A labeler's chances of each vote, for personal data and for the rest.
        chance = [[defaultdict(lambda: 0.5) for _ in v] for v in (patterns[0], patterns[0])]
        total = [1.0, 1.0]
        for v in patterns:
            for side, weight in enumerate((1 - p[v], p[v])):
                total[side] += counts[v] * weight
                for j, vote in enumerate(v):
                    chance[side][j][vote] += counts[v] * weight
        for v in patterns:
            odds = math.log(total[1] / total[0])
            for j, vote in enumerate(v):
                odds += math.log(chance[1][j][vote] / (total[1] + 0.5)) - math.log(chance[0][j][vote] / (total[0] + 0.5))
            p[v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return p


def soft_labels(found: DataFrame) -> dict[tuple[int, str], float]:
    """Probability by kind and vote pattern: at most 4 x 81 of them."""
    rows = found.select(F.explode("candidates").alias("c")).groupBy("c.kind", "c.votes").count().collect()
    by_kind: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)
    for r in rows:
        by_kind[r.kind][tuple(map(int, r.votes.split(",")))] = r["count"]
    return {
        (kind, ",".join(map(str, v))): p for kind, counts in by_kind.items() for v, p in reliabilities(counts).items()
    }


def classifier(found: DataFrame, labels: dict[tuple[int, str], float]) -> dict[str, float]:
    """Naive Bayes weights: log-odds of each kind, and by kind and property."""
    if not labels:
        return {}
    chances = F.create_map(*[F.lit(x) for (k, v), p in labels.items() for x in (f"{k}|{v}", p)])
    rows = found.select(F.explode("candidates").alias("c")).select(
        F.col("c.kind").cast("string").alias("kind"),
        F.element_at(chances, F.concat_ws("|", F.col("c.kind").cast("string"), "c.votes")).alias("p"),
        F.concat(F.array(F.lit("")), "c.properties").alias("properties"),
    )
    sums = (
        rows.select("kind", "p", F.explode("properties").alias("property"))
        .groupBy("kind", "property")
        .agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no"))
        .collect()
    )
    total = {r.kind: (r.yes + 1, r.no + 1) for r in sums if not r.property}
    weights = {}
    for r in sums:
        yes, no = total[r.kind]
        if r.property:
            weights[f"{r.kind}|{r.property}"] = math.log((r.yes + 0.5) / (yes + 1)) - math.log((r.no + 0.5) / (no + 1))
        else:
            weights[f"{r.kind}|"] = math.log(yes / no)
    return weights


def with_spans(found: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Candidates become ``base`` and ``spans``: base ones and those the classifier takes."""
    base = F.filter("candidates", lambda c: c["base"])
    taken = base
    if weights:
        table = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])

        def odds(c: Column) -> Column:
            own = F.concat(F.array(F.lit("")), c["properties"])
            return F.aggregate(
                own,
                F.lit(0.0),
                lambda s, p: s + F.coalesce(F.try_element_at(table, F.concat_ws("|", c["kind"].cast("string"), p)), F.lit(0.0)),
            )

        # A looser match inside a base one says nothing new.
        def new(c: Column) -> Column:
            return ~F.exists("candidates", lambda b: b["base"] & (b["start"] < c["end"]) & (c["start"] < b["end"]))

        taken = F.filter("candidates", lambda c: c["base"] | ((odds(c) > 0) & new(c)))
    return found.withColumns({"base": base, "spans": taken}).drop("candidates")


def find(docs: DataFrame) -> DataFrame:
    """doc_id, base and spans of every row; null and empty texts have none."""
    found = stored(candidates(docs), "pii")
    return with_spans(found, classifier(found, soft_labels(found)))


def report(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, counts and digest of the base spans, and all spans."""

    def number(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return find(docs).select(
        "doc_id",
        *[number(k).alias(f"n_{name}") for k, name in KINDS.items()],
        F.sha2(written(F.col("base"), KINDS).cast("binary"), 256).alias("base_sha256"),
        written(F.col("spans"), KINDS).alias("spans"),
    )
