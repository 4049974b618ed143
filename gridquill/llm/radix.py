"""Exact ranks and exact selection by the digits of integer keys, without a global sort.

Keys are long columns in ascending order; their digits are taken from the key with its sign bit
flipped, so that unsigned digits have the order of the keys. What is counted is a histogram of
prefixes; a histogram is summed up digit by digit into one of shorter prefixes, and the running sums
come down again the same way, so that no window ever holds more than one digit's values of one prefix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize

_SIGN = -(2**63)


def _ordered(key: str | Column) -> Column:
    return (F.col(key) if isinstance(key, str) else key).bitwiseXOR(F.lit(_SIGN))


def _span(rows: DataFrame, key: str) -> int:
    """Number of low bits in which the keys of ``rows`` differ."""
    lo, hi = rows.agg(F.min(key), F.max(key)).first()
    return 0 if lo is None else (lo ^ hi).bit_length() if (lo < 0) == (hi < 0) else 64


def _above(prefix: Column, bits: int) -> Column:
    return F.shiftrightunsigned(prefix, bits) if bits < 64 else F.when(prefix.isNotNull(), F.lit(0).cast("long"))


def _offsets(counts: DataFrame, node: list[str], width: int, bits: int) -> DataFrame:
    """``counts`` (node, prefix, count), prefixes of ``width`` bits that can differ, with ``before``: the
    number of rows of the node whose prefix is smaller (null is the smallest)."""
    if width <= bits:
        w = Window.partitionBy(*node).orderBy(F.col("prefix").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
        return counts.withColumn("before", F.coalesce(F.sum("count").over(w), F.lit(0)))
    up = counts.groupBy(*node, _above(F.col("prefix"), bits).alias("prefix")).agg(F.sum("count").alias("count"))
    up = _offsets(up, node, width - bits, bits).select(*[F.col(c).alias(f"up_{c}") for c in node], F.col("prefix").alias("up"), F.col("before").alias("up_before"))
    counts = counts.withColumn("head", _above(F.col("prefix"), bits))
    w = Window.partitionBy(*node, "head").orderBy(F.col("prefix").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("within", F.coalesce(F.sum("count").over(w), F.lit(0)))
    match = F.col("head").eqNullSafe(F.col("up"))
    for c in node:
        match &= F.col(c).eqNullSafe(F.col(f"up_{c}"))
    return counts.join(up, match).select(*node, "prefix", "count", (F.col("up_before") + F.col("within")).alias("before"))


def group_ranks(rows: DataFrame, group: str, keys: list[str], block: int = 1024, bits: int = 10) -> DataFrame:
    """``rows`` with ``rank``, the place of a row in its group by ``keys`` (from 0, nulls first), and ``n``, the rows of the group.

    The last of ``keys`` must tell all rows apart. The prefixes that leave ``bits`` low bits of the first
    key are counted by group; running sums over these digits are the exact rank at which each prefix's
    rows begin, and a prefix's rows, no more than ``block``, are numbered among themselves. Where a
    prefix has more rows (keys that repeat), these rows alone go on by the digits left and by the next key.
    ``rows`` is read several times and should be a written table.
    """
    open_, done = rows.withColumn("base", F.lit(0).cast("long")), []
    steps = [(k, drop) for k in keys for drop in ((bits, 0) if k != keys[-1] else (bits,))]
    for at, (key, drop) in enumerate(steps):
        width = max(0, _span(open_, key) - drop)
        open_ = open_.withColumn("prefix", _above(_ordered(key), drop))
        counts = open_.groupBy(group, "base", "prefix").agg(F.count("*").alias("count"))
        starts = _offsets(counts, [group, "base"], width, bits).select(F.col(group).alias("h_group"), F.col("base").alias("h_base"), F.col("prefix").alias("h_prefix"), "count", (F.col("base") + F.col("before")).alias("start"))
        if at == 0:
            sizes = counts.groupBy(F.col(group).alias("s_group")).agg(F.sum("count").alias("n"))
            starts = starts.join(sizes, F.col("h_group").eqNullSafe(F.col("s_group"))).drop("s_group")
        starts = materialize(starts, "rank-histogram")
        on = F.col(group).eqNullSafe(F.col("h_group")) & (F.col("base") == F.col("h_base")) & F.col("prefix").eqNullSafe(F.col("h_prefix"))
        placed = open_.join(starts, on)
        last = at == len(steps) - 1 or starts.where(F.col("count") > block).isEmpty()
        small = placed if last else placed.where(F.col("count") <= block)
        w = Window.partitionBy(group, "base", "prefix").orderBy(*[F.col(k).asc_nulls_first() for k in keys])
        done.append(small.withColumn("rank", F.col("start") + F.row_number().over(w) - 1).select(*rows.columns, "rank", "n"))
        if last:
            break
        open_ = materialize(placed.where(F.col("count") > block).select(*rows.columns, F.col("start").alias("base"), "n"), "rank-open")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def kth(rows: DataFrame, keys: list[str], k: int, bits: int = 12) -> Column:
    """Condition that holds for exactly the ``k`` first rows by ``keys`` (ascending, nulls last).

    The last of ``keys`` must tell all rows apart. Digit by digit the histogram of the rows that still
    share the digits found (2 ** bits counts come to the driver) names the digit of the k-th key; the next
    key is looked at only if the k-th row lies among rows with equal keys so far.
    """
    if k <= 0:
        return F.lit(False)
    inside, tied, need = F.lit(False), F.lit(True), k
    for key in keys:
        value = F.coalesce(F.col(key), F.lit(2**63 - 1)).cast("long")
        same = rows.where(tied)
        lo, hi, n = same.agg(F.min(value), F.max(value), F.count("*")).first()
        if n <= need:
            return inside | tied
        lo, hi = lo - _SIGN, hi - _SIGN
        shift = (lo ^ hi).bit_length()
        prefix, count = lo >> shift, n
        while shift:
            step = min(bits, shift)
            head = F.lit(True) if shift == 64 else F.shiftrightunsigned(_ordered(value), shift) == F.lit(prefix)
            shift -= step
            digit = F.shiftrightunsigned(_ordered(value), shift).bitwiseAND(2**step - 1)
            for d, count in sorted(same.where(head).groupBy(digit.alias("d")).agg(F.count("*").alias("c")).collect()):
                if count >= need:
                    prefix = prefix << step | d
                    break
                need -= count
        at = F.lit(prefix + _SIGN).cast("long")
        inside |= tied & (value < at)
        tied &= value == at
        if count == need:
            break
    return inside | tied


def sorted_ranks(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``rows`` with ``rank`` (from 0) by ``order``: a range sort, whose partitions are counted; the
    driver sees a number per partition."""
    low = F.lit(2**33 - 1)
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialize(placed.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id().bitwiseAND(low)}), name)
    counts = sorted(placed.groupBy("part").agg(F.count("*").alias("c")).collect())
    starts, total = [], 0
    for part, c in counts:
        starts.append((part, total))
        total += c
    starts = rows.sparkSession.createDataFrame(starts, "part int, start long")
    return placed.join(F.broadcast(starts), "part").withColumn("rank", F.col("start") + F.col("at")).select(*rows.columns, "rank")
