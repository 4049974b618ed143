"""Regex spans with code-point positions, as Column expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<kind:string,start:long,end:long,value:string>>"


def no_spans() -> Column:
    return F.from_json(F.lit("[]"), SPAN)


def regex_spans(text: Column, kind: str, regex: str, gate: Column) -> Column:
    """All leftmost non-overlapping matches of ``regex`` as spans (start inclusive, end
    exclusive, in code points). Matches and the gaps between them come from the same matcher,
    so that a running sum of their lengths gives the positions. ``gate`` is a cheap condition
    that every text with a match fulfils: other texts skip the work."""
    matches = F.regexp_extract_all(text, F.lit(regex), F.lit(0))
    gaps = F.split(text, regex, -1)
    step = F.zip_with(F.slice(gaps, 1, F.size(matches)), matches, lambda g, m: F.struct(F.length(g).cast("long").alias("g"), F.length(m).cast("long").alias("m"), m.alias("value")))
    start = F.struct(F.lit(0).cast("long").alias("at"), no_spans().alias("out"))
    walked = F.aggregate(
        step,
        start,
        lambda acc, x: F.struct(
            (acc["at"] + x["g"] + x["m"]).alias("at"),
            F.concat(acc["out"], F.array(F.struct(F.lit(kind).alias("kind"), (acc["at"] + x["g"]).alias("start"), (acc["at"] + x["g"] + x["m"]).alias("end"), x["value"].alias("value")))).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    return F.when(gate, walked).otherwise(no_spans())


def rendered(spans: Column, order: list[str], by_kind: bool) -> Column:
    """kind:start:end joined by commas; sorted by start, then kind as listed (or by kind first)."""
    rank = F.create_map(*[x for i, k in enumerate(order) for x in (F.lit(k), F.lit(i))])
    keyed = F.transform(spans, lambda s: F.struct(*((rank[s["kind"]].alias("a"), s["start"].alias("b")) if by_kind else (s["start"].alias("a"), rank[s["kind"]].alias("b"))), s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
