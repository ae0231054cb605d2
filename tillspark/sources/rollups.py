"""The day rollup as a table in months.

A manifest names one folder for each month. A batch of differences rewrites only the months it
touches and the new manifest appears by a rename, with the number of the batch; a batch that is
there already changes nothing. A comparison reads the folders of its two months.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from tillspark.functions.dates import comparable_period
from tillspark.operators import rollup
from tillspark.session import cut_lineage
from tillspark.sources.manifest import Manifests


class Rollups(Manifests):
    def __init__(self, spark: SparkSession, root: str):
        super().__init__(spark, root)

    def manifest(self) -> dict:
        return self.newest() or {"version": 0, "batch": -1, "months": {}}

    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], rollup.SCHEMA)
        return self.spark.read.schema(rollup.SCHEMA).parquet(
            *[f"{self.root}/{f}" for f in folders])

    def apply(self, differences: DataFrame, batch: int) -> None:
        """Adds one batch of differences; the first batch is the rollup of all receipts.

        The driver sees the names of the months that a batch touches, which calendar dates bound.
        """
        now = self.manifest()
        if now["batch"] >= batch:
            return
        changes = cut_lineage(differences.withColumn("month", F.left("day", F.lit(7))),
                              "rollup-changes")
        touched = sorted(r.month for r in changes.select("month").distinct().collect())
        old = self._read([now["months"][m] for m in touched if m in now["months"]])
        run = f"run-{now['version'] + 1}"
        after = rollup.merged(old, changes).withColumn("month", F.left("day", F.lit(7)))
        (after.hint("rebalance", "month").write.mode("overwrite").partitionBy("month")
         .parquet(f"{self.root}/{run}"))
        written = {n.split("=")[1]: f"{run}/{n}" for n in self.listed(run)
                   if n.startswith("month=")}
        months = {m: f for m, f in now["months"].items() if m not in touched} | written
        self.publish({"version": now["version"] + 1, "batch": batch, "months": months})

    def read(self) -> DataFrame:
        return self._read(list(self.manifest()["months"].values()))

    def of_period(self, now: datetime) -> DataFrame:
        """The rows that the comparison of ``now`` can count."""
        period = comparable_period(now)
        wanted = {d.strftime("%Y-%m") for d in (period.start, period.previous_start)}
        months = self.manifest()["months"]
        return self._read([months[m] for m in sorted(wanted) if m in months])

    def vacuum(self) -> None:
        """Deletes folders of months that the newest manifest does not name, and older manifests."""
        now = self.manifest()
        named = set(now["months"].values())
        for run in self.listed(""):
            if run.startswith("run-"):
                for month in self.listed(run):
                    if f"{run}/{month}" not in named and month.startswith("month="):
                        self.delete(f"{run}/{month}")
        self.forget_older(now)
