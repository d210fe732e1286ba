"""Places of regular-expression matches in texts, by SQL functions alone.

``split`` gives what lies between the matches and ``regexp_extract_all`` the
matches; running sums of their lengths are the places, in code points.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters kept before and behind a match.
CONTEXT = 40
# Numbers summed in one go; longer arrays are summed piece by piece, so that time stays nearly proportional.
PIECE = 128
MATCH = "array<struct<start:int,end:int,match:string,before:string,after:string>>"


def _running(numbers: Column) -> Column:
    """Running sums of a short array."""
    empty = F.array().cast("array<int>")
    return F.aggregate(numbers, empty, lambda done, x: F.concat(done, F.array(F.coalesce(F.get(done, F.size(done) - 1), F.lit(0)) + x)))


def running(numbers: Column) -> Column:
    """Running sums of an array of integers that is not empty."""
    starts = F.sequence(F.lit(1), F.size(numbers), F.lit(PIECE))
    pieces = F.transform(starts, lambda a: _running(F.slice(numbers, a, F.lit(PIECE))))

    def joined(pieces: Column) -> Column:
        ends = _running(F.transform(pieces, lambda p: F.get(p, F.size(p) - 1)))
        with_ends = F.transform(pieces, lambda p, i: F.struct(p.alias("p"), i.alias("i")))

        def moved(ends: Column) -> Column:
            return F.flatten(
                F.transform(
                    with_ends,
                    lambda x: F.transform(x["p"], lambda y: y + F.coalesce(F.get(ends, x["i"] - 1), F.lit(0))),
                )
            )

        return _let(ends, moved)

    return F.when(F.size(numbers) <= PIECE, _running(numbers)).otherwise(_let(pieces, joined))


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once."""
    return F.get(F.transform(F.array(value), body), 0)


def located(text: Column, pattern: str, where: Column | None = None) -> Column:
    """All matches of a pattern that never matches nothing: place, text and a little context.

    Leftmost and not overlapping, as a matcher finds them in turn. Texts for
    which ``where`` is not true give an empty array, as do null texts.
    """
    between = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(x: Column) -> Column:
        ends = running(F.transform(x["found"], lambda m, i: F.length(m) + F.length(F.get(x["between"], i))))
        return _let(
            ends,
            lambda ends: F.transform(
                x["found"],
                lambda m, i: F.struct(
                    (F.get(ends, i) - F.length(m)).alias("start"),
                    F.get(ends, i).alias("end"),
                    m.alias("match"),
                    F.substring(F.get(x["between"], i), -CONTEXT, CONTEXT).alias("before"),
                    F.substring(F.get(x["between"], i + 1), 1, CONTEXT).alias("after"),
                ),
            ),
        )

    none = F.array().cast(MATCH)
    every = _let(
        F.struct(between.alias("between"), found.alias("found")),
        lambda x: F.when(F.size(x["found"]) > 0, placed(x)).otherwise(none),
    )
    hit = text.isNotNull() if where is None else text.isNotNull() & where
    return F.when(hit, every).otherwise(none)


def written(spans: Column, names: dict[int, str]) -> Column:
    """Spans (start, kind number, end, …) by start and then kind, as kind:start:end, comma-joined."""
    named = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    parts = F.transform(
        F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["kind"], s["end"]))),
        lambda s: F.concat_ws(":", named[s["kind"]], s["start"].cast("string"), s["end"].cast("string")),
    )
    return F.array_join(parts, ",")
