"""Step snapshots: data, manifest, fingerprint, resume and rollback."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions.quoting import named

MANIFEST_SCHEMA = (
    "checkpoint_id string, type string, status string, pipeline_id string, step_index int, step_name string,"
    " timestamp timestamp, data_hash string, data_rows long, data_columns int, version long"
)


def snapshot_hash(df: DataFrame) -> DataFrame:
    """Fingerprint of all rows that does not depend on row order or partitioning.

    Names and types count, and nulls are told from absent values; columns that hold maps are hashed as JSON.
    """
    cells = [F.to_json(F.struct(named(f.name))) if "map<" in f.dataType.simpleString() else named(f.name) for f in df.schema]
    nulls = F.concat(F.lit(""), *[F.when(named(c).isNull(), "1").otherwise("0") for c in df.columns])
    row = F.xxhash64(F.lit(df.schema.simpleString()), nulls, *cells)
    hashed = df.select(row.alias("h"))
    return hashed.agg(
        F.count(F.lit(1)).alias("data_rows"),
        F.coalesce(F.sum(F.col("h").cast("decimal(38,0)")), F.lit(0)).cast("string").alias("hash_sum"),
        F.coalesce(F.bit_xor("h"), F.lit(0)).alias("hash_xor"),
    )


@dataclass(frozen=True)
class Snapshots:
    """Snapshots of one run, stored below a shared folder."""

    spark: SparkSession
    root: str
    run_id: str

    @property
    def _manifest(self) -> str:
        return f"{self.root}/{self.run_id}/manifest"

    def _data(self, checkpoint_id: str) -> str:
        return f"{self.root}/{self.run_id}/data/{checkpoint_id}"

    def _record(self, **values) -> None:
        names = [f.split()[0] for f in MANIFEST_SCHEMA.split(", ")]
        row = self.spark.range(1).select(*[
            F.unix_micros(F.current_timestamp()).alias(n) if n == "version"
            else F.current_timestamp().alias(n) if n == "timestamp" else F.lit(values.get(n)).alias(n)
            for n in names
        ])
        kinds = dict(f.split() for f in MANIFEST_SCHEMA.split(", "))
        row.select(*[F.col(n).cast(k) for n, k in kinds.items()]).write.mode("append").parquet(self._manifest)

    def save(self, df: DataFrame, step_index: int, step_name: str, kind: str = "after_step") -> DataFrame:
        """Write a snapshot and return the frame read back from it, which also cuts the lineage."""
        checkpoint_id = uuid.uuid4().hex
        df.write.parquet(self._data(checkpoint_id))
        stored = self.spark.read.parquet(self._data(checkpoint_id))
        facts = snapshot_hash(stored).first()
        self._record(
            checkpoint_id=checkpoint_id, type=kind, status="active", pipeline_id=self.run_id, step_index=step_index,
            step_name=step_name, data_hash=f"{facts['hash_sum']}:{facts['hash_xor']}", data_rows=facts["data_rows"],
            data_columns=len(df.columns),
        )
        return stored

    def list(self) -> DataFrame:
        """Latest state of each snapshot, newest first."""
        try:
            log = self.spark.read.parquet(self._manifest)
        except AnalysisException:
            return self.spark.createDataFrame([], MANIFEST_SCHEMA)
        newest = log.groupBy("checkpoint_id").agg(F.max_by(F.struct(*log.columns), "version").alias("r"))
        return newest.select("r.*").orderBy(F.col("step_index").desc(), (F.col("type") == "before_step").asc(), F.col("timestamp").desc())

    def state(self) -> DataFrame:
        """One row: the run, its newest active snapshot, the step to run next, and how many snapshots are active."""
        active = self.list().filter("status = 'active'")
        after = F.col("type") != "before_step"
        place = F.struct("step_index", after.alias("after"))
        return active.agg(
            F.max_by(F.struct("step_index", "step_name", "type", "data_rows"), place).alias("newest"), F.count(F.lit(1)).alias("active"),
        ).select(
            F.lit(self.run_id).alias("run_id"), "newest.step_index", "newest.step_name", "newest.type", "newest.data_rows",
            F.coalesce(F.col("newest.step_index") + F.when(F.col("newest.type") == "before_step", 0).otherwise(1), F.lit(0)).alias("next_step"), "active")

    def resume(self) -> tuple[DataFrame, int] | None:
        """Data of the newest active snapshot and the index of the step to run next; of one step, after comes last."""
        for row in self.list().filter("status = 'active'").toLocalIterator():
            try:
                after = row["type"] != "before_step"
                return self.spark.read.parquet(self._data(row["checkpoint_id"])), row["step_index"] + after
            except AnalysisException:
                continue
        return None

    def rollback_to(self, step_index: int) -> DataFrame:
        """Data of the snapshot of a step; later snapshots become inactive."""
        rows = [r for r in self.list().toLocalIterator() if r["status"] == "active"]
        keep = [r for r in rows if r["step_index"] == step_index and r["type"] != "before_step"]
        if not keep:
            raise ValueError(f"no active snapshot of step {step_index}")
        for r in rows:
            if r["step_index"] > step_index:
                self._record(**{**r.asDict(), "status": "rolled_back"})
        return self.spark.read.parquet(self._data(keep[0]["checkpoint_id"]))
