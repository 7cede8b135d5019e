"""Tables of partial results per key that grow by batches: deltas, folded into a base now and then.

A batch writes only its own partial rows, so its cost follows the batch and not what came before. Reading
merges the latest base with the later deltas. A batch that is run again replaces its delta,
and one that a base already holds is passed over, so every batch counts once.
"""

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beaconlake.session import numbered_folders, remove_folder

#: Deltas after which they are folded into a new base.
COMPACT_EVERY = 16


@dataclass
class MergedTable:
    """Partial rows under ``path``: one merged row for each value of ``keys``.

    ``partials`` maps every other column to the SQL aggregate that merges it; the aggregates are sums,
    minima and maxima, so the order of batches does not matter.
    """

    spark: SparkSession
    path: str
    keys: list[str]
    partials: dict[str, str]

    def merged(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(*self.keys).agg(*[F.expr(sql).alias(name) for name, sql in self.partials.items()])

    def add(self, rows: DataFrame, batch: int, compact_every: int = COMPACT_EVERY) -> DataFrame:
        """Store the merged ``rows`` of a batch, and return them as stored."""
        folder = f"{self.path}/delta/batch={batch}"
        made = self.merged(rows)
        made.write.mode("overwrite").parquet(folder)
        base, deltas = self._parts()
        if len(deltas) >= compact_every:
            self.compact()
        return self.spark.read.schema(made.schema).parquet(folder)

    def _parts(self) -> tuple[int | None, list[int]]:
        """The number that the latest base reaches up to, and the deltas after it."""
        base = max(numbered_folders(self.spark, f"{self.path}/base", "upto"), default=None)
        deltas = numbered_folders(self.spark, f"{self.path}/delta", "batch")
        return base, [n for n in deltas if base is None or n > base]

    def read(self) -> DataFrame:
        """All batches, merged."""
        base, deltas = self._parts()
        paths = [f"{self.path}/delta/batch={n}" for n in deltas]
        if base is not None:
            paths.append(f"{self.path}/base/upto={base}")
        return self.merged(self.spark.read.parquet(*paths))

    def compact(self) -> None:
        """Fold the deltas into a new base. Earlier ones stay for readers until ``expire``."""
        _, deltas = self._parts()
        if deltas:
            self.read().write.mode("overwrite").parquet(f"{self.path}/base/upto={max(deltas)}")

    def expire(self) -> None:
        """Remove what the latest base holds: earlier bases and their deltas."""
        base, _ = self._parts()
        if base is None:
            return
        for kind, name in (("base", "upto"), ("delta", "batch")):
            for n in numbered_folders(self.spark, f"{self.path}/{kind}", name):
                if n < base or (kind == "delta" and n == base):
                    remove_folder(self.spark, f"{self.path}/{kind}/{name}={n}")
