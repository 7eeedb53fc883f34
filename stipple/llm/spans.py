"""Places of regular-expression matches with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<s:int,e:int,m:string>>"


def match_spans(text: Column, pattern: str) -> Column:
    """s, e (code points, end exclusive) and m of the leftmost non-overlapping matches.

    What lies between the matches and the matches themselves, in turn, give
    the places as running sums of their lengths.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.slice(F.split(text, pattern, -1), 1, F.size(found))
    steps = F.zip_with(between, found, lambda b, m: F.struct(F.length(b).alias("b"), F.length(m).alias("l"), m.alias("m")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(done: Column, x: Column) -> Column:
        s = done["at"] + x["b"]
        span = F.struct(s.alias("s"), (s + x["l"]).alias("e"), x["m"].alias("m"))
        return F.struct((s + x["l"]).alias("at"), F.concat(done["out"], F.array(span)).alias("out"))

    return F.aggregate(steps, start, step, lambda done: done["out"])


def joined(spans: Column, kinds: Sequence[str], by_start: bool) -> Column:
    """"kind:start:end", comma-joined, of structs (k: number of the kind, s, e); by start and kind, or by kind and start."""
    if by_start:
        spans = F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")))
    else:
        spans = F.transform(spans, lambda x: F.struct(x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e")))
    names = F.array(*map(F.lit, kinds))
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", names[x["k"]], x["s"].cast("string"), x["e"].cast("string"))), ",")
