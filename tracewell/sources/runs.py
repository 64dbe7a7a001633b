"""Tables that grow by batch: sorted runs below a small key, merged now and then.

A run holds what the batches ``first`` to ``last`` have added for one value of the key, below
``<key>=<value>/first=<n>/last=<n>``. A batch lists only the folders of the key values it asks for, and
each of these holds a bounded number of runs, however many batches there were. A batch that is replayed
replaces its own run and does not read it. A merge leaves the runs it has read to the next merge to
remove, so that a reader that has planned with them still finds them; readers leave out runs that lie
inside another, so neither a failure nor a late removal changes a result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST = 8


@dataclass(frozen=True)
class RunTable:
    spark: SparkSession
    path: str
    key: str
    schema: str  # of the rows, without the key
    order: tuple[str, ...] = ()

    def _folder(self, value: object, *run: int) -> str:
        return "/".join([f"{self.path}/{self.key}={value}", *[f"{n}={v}" for n, v in zip(("first", "last"), run)]])

    def _files(self, path: str):
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return folder, folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _every(self, value: object) -> list[tuple[int, int]]:
        pattern, files = self._files(f"{self._folder(value)}/first=*/last=*")
        found = files.globStatus(pattern) or []
        return [(int(s.getPath().getParent().getName()[6:]), int(s.getPath().getName()[5:])) for s in found]

    def runs(self, value: object, before: int | None = None) -> list[tuple[int, int]]:
        """The runs of a key value that end before a batch, without those inside another one."""
        kept: list[tuple[int, int]] = []
        for first, last in sorted(self._every(value), key=lambda r: (r[0], -r[1])):
            if (before is None or last < before) and not (kept and last <= kept[-1][1]):
                kept.append((first, last))
        return kept

    def read(self, values: list, before: int | None = None) -> DataFrame:
        """The rows of these key values from batches before the given one; folders of other values are not listed.

        That batch is the one at work: merged runs cannot be read in part.
        """
        paths = [self._folder(v, *run) for v in values for run in self.runs(v, before)]
        whole = f"{self.schema}, `{self.key}` string, first long, last long"
        if not paths:
            return self.spark.createDataFrame([], whole).drop("first", "last")
        rows = self.spark.read.schema(whole).option("basePath", self.path).parquet(*paths)
        return rows.filter(F.col(self.key).isin([str(v) for v in values])).drop("first", "last")

    def append(self, rows: DataFrame, batch: int) -> None:
        """Add the rows of a batch, in place of those it added before a failure."""
        self._write(rows.withColumns({"first": F.lit(batch), "last": F.lit(batch)}))

    def _write(self, rows: DataFrame) -> None:
        by = [self.key, "first", "last"]
        spread = rows.hint("rebalance", *by).sortWithinPartitions(*by, *self.order)
        writer = spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.option("compression", "zstd").partitionBy(*by).parquet(self.path)

    def merge(self, values: list, before: int) -> None:
        """Make one run of the earlier ones wherever there are more than ``MOST``; all values in one job."""
        merged = {str(v): (runs[0][0], runs[-1][1]) for v in values if len(runs := self.runs(v, before)) > MOST}
        if not merged:
            return
        for value in merged:
            kept = self.runs(value, before)
            for run in self._every(value):
                if run[1] < before and run not in kept:
                    folder, files = self._files(self._folder(value, *run))
                    files.delete(folder, True)
        ends = [
            F.coalesce(*[F.when(F.col(self.key) == v, F.lit(run[i])) for v, run in merged.items()]).alias(name)
            for i, name in enumerate(("first", "last"))
        ]
        rows = self.read(list(merged), before)
        self._write(rows.select("*", *ends))
