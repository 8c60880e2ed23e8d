"""A bitmap of hashed keys, by which rows that cannot matter stay out of a shuffle.

It never loses a row that has one of the keys; of the others it lets through about one in sixteen at most, and more only
where the keys outgrow its largest size, which is fixed and so may be broadcast: 4,096 rows of 4 KB.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termweave.plans.shared import Cut

MOST_BITS = 27
#: Bits in a row of the bitmap, as Spark's bitmap functions have them.
CELL_BITS = 15


class Sieve:
    def __init__(self, keys: DataFrame, col: str):
        """keys: a written table of long keys, repeats allowed."""
        bits = min(MOST_BITS, max(CELL_BITS, (16 * keys.count()).bit_length()))
        self._mask = (1 << bits) - 1
        at = self._place(F.col(col))
        cells = keys.select(at.alias("at")).groupBy(F.shiftright("at", CELL_BITS).alias("__cell")).agg(F.bitmap_construct_agg(F.col("at").bitwiseAND(F.lit((1 << CELL_BITS) - 1))).alias("__bits"))
        self._cut = Cut(cells, "sieve")

    def _place(self, key: Column) -> Column:
        return F.xxhash64(F.lit("sieve"), key).bitwiseAND(F.lit(self._mask))

    def split(self, rows: DataFrame, key: Column) -> tuple[DataFrame, DataFrame]:
        """Rows whose key may be one of the keys, and those whose key is none for certain; no row is moved."""
        at = self._place(key)
        cells = F.broadcast(self._cut.df.select("__cell", "__bits"))  # a fixed size at most
        joined = rows.withColumn("__at", at).join(cells, F.shiftright("__at", CELL_BITS) == F.col("__cell"), "left")
        byte = F.conv(F.hex(F.expr("substring(__bits, cast(shiftright(__at & 32767, 3) as int) + 1, 1)")), 16, 10).cast("int")
        one = F.coalesce(F.expr("shiftleft(1, cast(__at & 7 as int))").bitwiseAND(byte) != 0, F.lit(False))
        return joined.where(one).select(*[F.col(f"`{c}`") for c in rows.columns]), joined.where(~one).select(*[F.col(f"`{c}`") for c in rows.columns])
