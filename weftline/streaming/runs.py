"""State carried from run to run: each micro-batch is one run over a landed folder.

The gates look at a whole run, so they run in foreachBatch. State lives in published run tables; the
batch id names the run, so a repeated batch reads the state before it and overwrites its own output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weftline.operators import changelog, gates, quarantine
from weftline.sources import snapshots

ANOMALY_SCHEMA = "run_at string, total_providers bigint, slug string, kind string, magnitude bigint, detail string"


def run_name(batch_id: int) -> str:
    return f"{batch_id:012d}"


def landed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One landed file per micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def start(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def quarantine_step(root: str, confirm_runs: int = quarantine.CONFIRM_RUNS) -> Callable[[DataFrame, int], None]:
    """Reconcile the anomalies of one run with the state of the run before it.

    A run without anomalies is a landed row with NULL slug that carries run_at and total_providers.
    """
    def step(batch: DataFrame, batch_id: int) -> None:
        spark, run = batch.sparkSession, run_name(batch_id)
        head = batch.agg(F.max("run_at").alias("now"), F.max("total_providers").alias("total")).first()
        if head["now"] is None:
            return
        state = snapshots.read_latest(spark, root, "state", quarantine.STATE_SCHEMA, before=run)
        anomalies = batch.where("slug is not null").select("slug", "kind", "magnitude", "detail")
        outcomes = quarantine.reconcile(state, anomalies, F.lit(head["total"]), head["now"], confirm_runs)
        snapshots.publish_run({"state": quarantine.next_state(outcomes), "outcomes": outcomes}, root, run)

    return step


def baseline_step(root: str, fallback: DataFrame) -> Callable[[DataFrame, int], None]:
    """Roll the baselines with the accepted counts of one run (source, providers, models, run_at)."""
    def step(batch: DataFrame, batch_id: int) -> None:
        spark, run = batch.sparkSession, run_name(batch_id)
        now = batch.agg(F.max("run_at")).first()[0]
        if now is None:
            return
        stored = snapshots.read_latest(spark, root, "baselines", gates.BASELINE_SCHEMA, before=run)
        base = gates.effective_baselines(stored, fallback)
        counts = batch.select("source", "providers", "models")
        passed = gates.source_floor(counts, base).where("ok").select("source", "providers", "models")
        snapshots.publish_run({"baselines": gates.roll_baselines(passed, base, now)}, root, run)

    return step


def changelog_step(root: str) -> Callable[[DataFrame, int], None]:
    """Upsert the changes of one run into the change log under their date."""
    def step(batch: DataFrame, batch_id: int) -> None:
        spark, run = batch.sparkSession, run_name(batch_id)
        date = batch.agg(F.max("date")).first()[0]
        if date is None:
            return
        log = snapshots.read_latest(spark, root, "changelog", changelog.CHANGE_SCHEMA, before=run)
        today = batch.select("kind", "slug", "provider", "id", "name")
        snapshots.publish_run({"changelog": changelog.upsert(log, today, date)}, root, run)

    return step
