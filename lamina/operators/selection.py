"""Selections of rows of a base column: masks, bitmaps, position lists.

mask       (pos, sel boolean), one row per base row
bitmap     (bucket, bits): bucket b holds positions (b - 1) * 32768 up to b * 32768 - 1
positions  (pos), one row per selected row

A selection that a filter made knows the table and the predicate it came from: on that
same table it is a plain filter of the scan, and no join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("mask", "bitmap", "positions")
#: Bits of one bitmap value of Spark's bitmap functions.
BUCKET = 32768


@dataclass(frozen=True)
class Selection:
    kind: str
    df: DataFrame
    base: DataFrame | None = None
    predicate: Column | None = None

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ValueError(f"a selection is one of {KINDS}, not {self.kind!r}")

    def of(self, base: DataFrame) -> bool:
        """Whether this selection is a predicate on base."""
        return self.predicate is not None and self.base is base

    def rows(self, base: DataFrame, pos: str = "pos") -> DataFrame:
        """base's selected rows."""
        if self.of(base):
            return base.where(self.predicate)
        return base.join(self.to_positions().df.select(F.col("pos").alias("pos_")), F.col(pos) == F.col("pos_"), "left_semi")

    def to_positions(self) -> Selection:
        if self.kind == "positions":
            return self
        if self.kind == "mask":
            return Selection("positions", self.df.where("sel").select("pos"), self.base, self.predicate)
        bytes_ = self.df.select("bucket", "bits", F.explode(F.sequence(F.lit(0), F.octet_length("bits") - 1)).alias("i"))
        bytes_ = bytes_.select("bucket", "i", F.expr("int(conv(hex(substring(bits, i + 1, 1)), 16, 10))").alias("b")).where("b > 0")
        bits = bytes_.select("bucket", "i", "b", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k")).where("shiftright(b, k) & 1 = 1")
        return Selection("positions", bits.select(F.expr(f"(bucket - 1) * {BUCKET} + i * 8 + k").cast("bigint").alias("pos")), self.base, self.predicate)

    def to_bitmap(self) -> Selection:
        if self.kind == "bitmap":
            return self
        p = self.to_positions().df
        one_based = F.col("pos") + 1  # bucket 0 would hold position 0 alone
        out = p.groupBy(F.bitmap_bucket_number(one_based).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(one_based)).alias("bits"))
        return Selection("bitmap", out, self.base, self.predicate)

    def to_mask(self, base: DataFrame) -> Selection:
        """The mask over the positions of base."""
        if self.kind == "mask":
            return self
        chosen = self.to_positions().df.distinct().withColumn("sel", F.lit(True))
        return Selection("mask", base.select("pos").join(chosen, "pos", "left").select("pos", F.coalesce("sel", F.lit(False)).alias("sel")))

    def count(self) -> DataFrame:
        """One row: n, the number of selected rows."""
        if self.kind == "mask":
            return self.df.agg(F.count_if("sel").alias("n"))
        if self.kind == "bitmap":
            return self.df.agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).cast("bigint").alias("n"))
        return self.df.agg(F.count(F.lit(1)).alias("n"))

    def words(self, width: int = 64) -> DataFrame:
        """Selected rows per word of ``width`` base rows: (word, bits)."""
        sel = F.col("sel").cast("int") if self.kind == "mask" else F.lit(1)
        p = self.df if self.kind == "mask" else self.to_positions().df
        return p.groupBy(F.floor(F.col("pos") / width).cast("bigint").alias("word")).agg(F.coalesce(F.sum(sel), F.lit(0)).cast("bigint").alias("bits"))


def chosen(df: DataFrame, sel: Column | Selection | None, pos: str = "pos") -> DataFrame:
    """df's rows that a predicate or a selection in any encoding selects; all without one."""
    if sel is None:
        return df
    return sel.rows(df, pos) if isinstance(sel, Selection) else df.where(sel)
