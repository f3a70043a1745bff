"""Running sums and exact quantiles in the order of a number, without a window or a task that holds all rows.

Both first part numbers by sign and power of two, count the parts, and cut those
that are too heavy into even pieces between their own least and greatest value,
again and again, until they are light enough or hold one value. As a part spans
a factor of two at most, that takes few levels whatever the values are. The
driver sees counts of parts alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ballast.sources.stored import stored

BUCKETS = 4096
#: Up to so many rows are one part: a window over them is cheaper than counting parts.
SMALL = 1 << 16


def _power(x: Column) -> Column:
    """Sign and power of two as one number in the order of ``x``: nulls first, numbers that aren't one last."""
    size = F.when(F.abs(x) == float("inf"), F.lit(4000)).otherwise(F.floor(F.log2(F.abs(x))) + 1100)
    return F.when(x.isNull(), F.lit(-5000)).when(F.isnan(x), F.lit(5000)).when(x == 0, F.lit(0)).otherwise(F.signum(x) * size).cast("int")


def _parts(rows: DataFrame, part: str, by: str) -> list[tuple[int, int, float, float]]:
    """(part, rows, least, greatest): a row for each part."""
    found = rows.groupBy(part).agg(F.count(F.lit(1)), F.min(by).cast("double"), F.max(by).cast("double"))
    return [tuple(r) for r in found.collect()]


def _cut_again(rows: DataFrame, part: str, by: str, heavy: list[tuple[int, float, float, int]], fresh: int) -> tuple[DataFrame, int]:
    """Rows of each heavy (part, least, greatest, pieces) under new numbers from ``fresh`` on; the others keep theirs.

    The bounds of heavy parts are a table of at most ``BUCKETS`` rows; every row meets at most one of them.
    """
    bounds = []
    for number, low, high, pieces in heavy:
        # Halves first: a difference of two large numbers may not fit.
        bounds.append((number, low, max((high / 2 - low / 2) / pieces * 2, 5e-324), fresh, pieces))
        fresh += pieces
    table = rows.sparkSession.createDataFrame(bounds, "_of int, _low double, _step double, _base int, _pieces int")
    x = F.col(by).cast("double")
    inner = F.least(F.floor((x / 2 - F.col("_low") / 2) / (F.col("_step") / 2)).cast("int"), F.col("_pieces") - 1)
    joined = rows.join(F.broadcast(table), rows[part] == table["_of"], "left")
    return joined.withColumn(part, F.coalesce(F.col("_base") + inner, F.col(part))).drop("_of", "_low", "_step", "_base", "_pieces"), fresh


def cut(rows: DataFrame, by: str, part: str, buckets: int = BUCKETS) -> DataFrame:
    """Adds ``part``: equal values share one, and only a part of one value has more than twice the mean. ``rows`` is read once for each level of cuts, so have it stored."""
    rows = rows.withColumn(part, _power(F.col(by).cast("double")))
    counts, fresh = _parts(rows, part, by), 10_000
    mean = max(1, -(-sum(n for _, n, _, _ in counts) // buckets))
    while True:
        heavy = [(number, a, b, min(buckets, 2 * -(-n // mean))) for number, n, a, b in counts if n > 2 * mean and a is not None and a < b]
        if not heavy:
            return rows
        first = fresh
        rows, fresh = _cut_again(rows, part, by, heavy, fresh)
        counts = [c for c in _parts(rows, part, by) if c[0] >= first]


def running(df: DataFrame, by: str, tie: list[str], sums: dict[str, Column], buckets: int = BUCKETS, small: int = SMALL) -> DataFrame:
    """Adds to every row the sums of ``sums`` over the rows up to it, in the order of ``by`` and ``tie``.

    The rows are stored once. One window runs over the sums of the parts (a row
    for each), others run inside each part.
    """
    keyed = stored(df.withColumns({f"_{k}": v for k, v in sums.items()}), "running")
    if keyed.count() <= small:
        up = Window.orderBy(by, *tie).rowsBetween(Window.unboundedPreceding, 0)
        return keyed.select(*df.columns, *[F.sum(f"_{k}").over(up).alias(k) for k in sums])
    keyed = cut(keyed, by, "_part", buckets)
    parts = keyed.groupBy("_part").agg(F.min(by).alias("_least"), *[F.sum(f"_{k}").alias(f"_{k}") for k in sums])
    before = Window.orderBy("_least").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    starts = parts.select("_part", *[F.coalesce(F.sum(f"_{k}").over(before), F.lit(0)).alias(f"_from_{k}") for k in sums])
    inner = Window.partitionBy("_part").orderBy(by, *tie).rowsBetween(Window.unboundedPreceding, 0)
    found = keyed.join(starts, "_part").withColumns({k: F.sum(f"_{k}").over(inner) + F.col(f"_from_{k}") for k in sums})
    return found.select(*df.columns, *sums)


def keyed_rank(df: DataFrame, by: list[str], order: str, into: str, buckets: int = BUCKETS, small: int = SMALL) -> DataFrame:
    """Adds the rank from 1 by the number ``order`` in each group of ``by`` (nulls are a group).

    Groups are ranked in parts of the order's whole range, whose counts in each
    group give the offsets, so no task holds a hot group.
    """
    rows = stored(df, "ranked")
    if rows.count() <= small:
        return rows.withColumn(into, F.row_number().over(Window.partitionBy(*by).orderBy(order)).cast("long"))
    rows = cut(rows, order, "_part", buckets)
    counts = rows.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min(order).alias("_least"))
    before = F.sum("_n").over(Window.partitionBy(*by).orderBy("_least").rowsBetween(Window.unboundedPreceding, -1))  # a row for each part
    starts = counts.select(*[F.col(c).alias(f"_of_{c}") for c in by], F.col("_part").alias("_at"), F.coalesce(before, F.lit(0)).alias("_before"))
    match = F.col("_part") == F.col("_at")
    for c in by:
        match &= F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    place = F.row_number().over(Window.partitionBy(*by, "_part").orderBy(order)) + F.col("_before")
    return rows.join(starts, match).withColumn(into, place.cast("long")).select(*df.columns, into)


def quantiles(df: DataFrame, value: str, shares: list[float], buckets: int = BUCKETS) -> list[float | None]:
    """Exact quantiles, interpolated between neighbours as the usual definition has it; nulls and numbers that aren't one don't count.

    The ranks in question are searched in even value ranges. Only ranges that
    hold one are cut again, until each holds one value; no task sees more than
    partial counts of ranges.
    """
    x = F.col(value).cast("double")
    rows = stored(df.filter(x.isNotNull() & ~F.isnan(x)).select(x.alias("x")), "values")
    keyed, fresh = rows.withColumn("_part", _power(F.col("x"))), 10_000
    groups = [(0, sorted(_parts(keyed, "_part", "x"), key=lambda c: c[2]))]  # (rows before, consecutive parts) under search
    total = sum(c[1] for c in groups[0][1])
    if not total:
        return [None] * len(shares)
    at = [s * (total - 1) for s in shares]
    wanted = {int(a) for a in at} | {min(int(a) + 1, total - 1) for a in at}
    found: dict[int, float] = {}
    while True:
        again = []
        for before, parts in groups:
            for number, n, a, b in parts:
                held = [k for k in wanted if before <= k < before + n]
                if held and a == b:
                    found |= dict.fromkeys(held, a)
                elif held:
                    again.append((before, (number, a, b, buckets)))
                before += n
        if not again:
            break
        inside = keyed.filter(F.col("_part").isin([h[0] for _, h in again]))
        first = fresh
        keyed, fresh = _cut_again(inside, "_part", "x", [h for _, h in again], fresh)
        counts = sorted(_parts(keyed, "_part", "x"))
        groups = [(before, [c for c in counts if first + k * buckets <= c[0] < first + (k + 1) * buckets]) for k, (before, _) in enumerate(again)]
    out = []
    for a in at:
        low_, high_ = found[int(a)], found[min(int(a) + 1, total - 1)]
        out.append(low_ + (high_ - low_) * (a - int(a)))
    return out
