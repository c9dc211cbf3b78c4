"""Ranges of document ids that tasks can handle one by one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, changed where a column of df has them already."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def id_range(docs: DataFrame, id_col: str, rows: int) -> Column:
    """The number of the id range a row is in, of about ``rows`` rows each.

    Ranges are of one width, a power of two, from the density of the middle
    nine tenths of the ids: it holds for running numbers and for hashes, and
    outliers only make ranges of their own.  Larger ids never have smaller
    numbers.  Rows without id are spread over negative numbers by their hash.
    """
    i = F.col(id_col).cast("long")
    n, nulls, q = docs.select(i.alias("i")).agg(F.count("i"), F.count(F.when(F.col("i").isNull(), 1)), F.percentile_approx("i", [0.05, 0.95], 100_000)).first()
    width = 1
    if n:
        while width * n * 0.9 < rows * (q[1] - q[0] + 1):
            width *= 2
    shift = width.bit_length() - 1
    low = F.shiftright(i, shift)
    return F.when(i.isNotNull(), low).otherwise(-(1 << 62) + F.pmod(F.xxhash64(*[F.col(c).cast("string") for c in docs.columns]), F.lit(1 + nulls // rows)))
