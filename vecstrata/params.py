"""Build parameters of an index."""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class IndexParams:
    """``m`` links for a new node; at most ``mmax`` in upper layers and ``mmax0`` in layer 0."""

    m: int = 12
    ef_cons: int | None = None
    mmax: int | None = None
    mmax0: int | None = None
    ml: float | None = None
    dim: int | None = None
    #: Rows of a shard: graphs are built and searched shard by shard, so work stays linear in the table.
    shard_rows: int = 20_000

    def __post_init__(self) -> None:
        if self.m < 2:
            raise ValueError("m must be 2 or more: a level scale of 1/ln(m) is needed")
        put = lambda k, v: object.__setattr__(self, k, v if getattr(self, k) is None else getattr(self, k))
        put("ef_cons", 2 * self.m)
        put("mmax", self.m)
        put("mmax0", 2 * self.m)
        put("ml", 1.0 / math.log(self.m))

    def cap(self, layer: int) -> int:
        return self.mmax0 if layer == 0 else self.mmax

    def to_frame(self, spark: SparkSession) -> DataFrame:
        row = asdict(self)
        return spark.createDataFrame(
            [(row["m"], row["mmax"], row["mmax0"], float(row["ml"]), row["ef_cons"], row["dim"], row["shard_rows"])],
            "m int, mmax int, mmax0 int, ml double, ef_cons int, dim int, shard_rows int",
        )

    @classmethod
    def from_frame(cls, df: DataFrame) -> IndexParams:
        return cls(**df.first().asDict())
