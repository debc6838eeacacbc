"""Hash equi-join that returns position pairs.

Each probe row meets one build row: of equal build keys the first or the last
position, as asked; ``all`` gives every pair. Duplicates are folded by one aggregation
whose shuffle the join then reuses. Null keys never match. The build side is broadcast
by Spark when its size allows, and shuffled beyond."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DUPLICATES = ("first", "last", "all")


class JoinBuilder:
    """The build side in parts: feed tables, merge other builders, then probe. A part
    keeps one position for each of its keys (all with duplicates="all"), so that merged
    builds carry folded rows."""

    def __init__(self, key: str, pos: str = "pos", duplicates: str = "first"):
        if duplicates not in DUPLICATES:
            raise ValueError(f"duplicates is one of {DUPLICATES}, not {duplicates!r}")
        self.key, self.pos, self.duplicates = key, pos, duplicates
        self.parts: list[DataFrame] = []

    def _fold(self, df: DataFrame) -> DataFrame:
        if self.duplicates == "all":
            return df
        pick = F.min if self.duplicates == "first" else F.max
        return df.groupBy("k").agg(pick("build_pos").alias("build_pos"))

    def feed(self, part: DataFrame) -> JoinBuilder:
        rows = part.select(F.col(self.key).alias("k"), F.col(self.pos).alias("build_pos")).where("k is not null")
        self.parts.append(self._fold(rows))
        return self

    def merge(self, other: JoinBuilder) -> JoinBuilder:
        if other.duplicates != self.duplicates:
            raise ValueError(f"builders keep {self.duplicates} and {other.duplicates}")
        self.parts += other.parts
        return self

    def built(self) -> DataFrame:
        """(k, build_pos) of all parts."""
        if not self.parts:
            raise ValueError("nothing was fed")
        return self.parts[0] if len(self.parts) == 1 else self._fold(reduce(DataFrame.unionByName, self.parts))

    def probe(self, probe: DataFrame, key: str, pos: str = "pos") -> DataFrame:
        """(build_pos, probe_pos)."""
        return probe.select(F.col(key).alias("k"), F.col(pos).alias("probe_pos")).join(self.built(), "k").select("build_pos", "probe_pos")


def lookup_join(build: DataFrame, probe: DataFrame, build_key: str, probe_key: str, build_pos: str = "pos", probe_pos: str = "pos", duplicates: str = "first", unique: bool = False) -> DataFrame:
    """(build_pos, probe_pos). With ``unique`` the build keys are known to be so, and
    nothing is folded."""
    if duplicates not in DUPLICATES:
        raise ValueError(f"duplicates is one of {DUPLICATES}, not {duplicates!r}")
    return JoinBuilder(build_key, build_pos, "all" if unique else duplicates).feed(build).probe(probe, probe_key, probe_pos)


def payload(pairs: DataFrame, side: DataFrame, pos: str, at: str, *columns: str) -> DataFrame:
    """pairs with columns of one side, fetched by its position."""
    fetched = side.select(F.col(pos).alias(at), *columns)
    return pairs.join(fetched, at)
