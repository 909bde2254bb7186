"""Micro-batches of edits: each wakes what consumed the edited elements and upserts new verdicts.

The stream carries edits (node, fp, seq), not events in time: there is no watermark. Each batch is one
incremental step. The state after every batch is a table named by the batch's number below a folder
that outlives the driver, so a restarted stream goes on from it, and a batch that is replayed starts
from the state before it and changes nothing twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from verdigraph.operators import fixpoint
from verdigraph.runtime import durable, fresh_path, remove_path


class Engine:
    """Current fingerprints (node, fp) under edits, over consumption edges (user, used).

    ``folder`` keeps the state by batch; without one, a fresh folder below the shared one.
    """

    def __init__(self, prior: DataFrame, depends: DataFrame, recompute: Callable[[DataFrame], DataFrame], listeners: list[Callable[[int, DataFrame], None]] | None = None, folder: str | None = None):
        self.spark, self.depends = prior.sparkSession, durable(depends.select("user", "used"), "depends")
        self.recompute, self.listeners = recompute, listeners or []
        self.folder = folder or fresh_path(self.spark, "edits")
        self.schema = prior.select("node", "fp").schema
        if not self._batches():
            prior.select("node", "fp").write.parquet(f"{self.folder}/state=-1")

    def _batches(self) -> list[int]:
        """Numbers of the batches whose state is complete, rising; -1 stands for the start."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        store = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not store.exists(path):
            return []
        done = [s.getPath() for s in store.listStatus(path) if store.exists(self.spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        return sorted(int(p.getName().removeprefix("state=")) for p in done)

    def state(self, before: int | None = None) -> DataFrame:
        """The last state, or the last before a batch."""
        last = max(n for n in self._batches() if before is None or n < before)
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/state={last}")

    def apply(self, edits: DataFrame, batch: int | None = None) -> DataFrame:
        """Rows (node, fp) that changed by a batch of edits (node, fp, seq).

        Of a node's edits the one of the highest ``seq`` counts (of equal ones, that of the highest fp);
        without a ``seq`` column all are equal. Nodes are not null; an empty batch changes nothing.
        """
        number = batch if batch is not None else max(self._batches()) + 1
        state = self.state(number)
        order = F.struct("seq", "fp") if "seq" in edits.columns else F.struct("fp")
        edited = durable(edits.groupBy("node").agg(F.max_by("fp", order).alias("fp")), "edits")
        own = edited.join(state, ["node", "fp"], "left_anti")
        woken = own.join(self.depends, F.col("node") == F.col("used")).select(F.col("user").alias("node")).distinct()
        spread = fixpoint.early_cutoff(woken.join(own.select("node"), "node", "left_anti"), self.depends, state, self.recompute)
        changed = durable(own.unionByName(spread.where("changed").select("node", "fp").join(own.select("node"), "node", "left_anti")), "changed")
        following = state.join(changed.select("node"), "node", "left_anti").unionByName(changed)
        following.write.mode("overwrite").parquet(f"{self.folder}/state={number}")
        for n in self._batches()[:-2]:  # the last and the one that its replay starts from
            remove_path(self.spark, f"{self.folder}/state={n}")
        for tell in self.listeners:
            tell(number, changed)
        return changed

    def start(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        """Run on a stream of edits until stopped."""
        return stream.writeStream.foreachBatch(lambda df, n: self.apply(df, n) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
