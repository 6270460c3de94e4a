"""Conditional and staged loads, and the log of their runs."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.session import stored_table

LOG_SCHEMA = (
    "project string, name string, start_ts timestamp, end_ts timestamp, "
    "rows bigint, status string, error string"
)

Step = Callable[[], int | None]


class RunLog:
    """Append-only table of runs below ``path``; each run adds one small file."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def add(self, project: str, name: str, start: dt.datetime, end: dt.datetime, rows: int | None,
            status: str, error: str | None) -> None:
        record = [(project, name, start, end, rows, status, error)]
        self.spark.createDataFrame(record, LOG_SCHEMA).coalesce(1).write.mode("append").parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.schema(LOG_SCHEMA).parquet(self.path)


def history(log: DataFrame, project: str, name: str | None = None) -> DataFrame:
    """Runs of a project, or of one of its jobs."""
    wanted = F.col("project") == project
    return log.filter(wanted if name is None else wanted & (F.col("name") == name))


def latest_status(log: DataFrame) -> DataFrame:
    """The last run of every job: ``project, name`` and the log's other columns.

    An aggregate, not a window: a job with very many runs is reduced before the shuffle. Runs that
    end at one time are ordered by their status and further columns.
    """
    others = [c for c in log.columns if c not in ("project", "name", "end_ts", "status")]
    last = F.max(F.struct("end_ts", "status", *others))
    return log.groupBy("project", "name").agg(last.alias("last")).select(
        "project", "name", "last.end_ts", "last.status", *[f"last.{c}" for c in others]
    )


def sql_step(spark: SparkSession, statement: str, args: Mapping[str, Any] | None = None) -> Step:
    """A step that runs one SQL statement with named parameters; it counts no rows."""

    def run() -> int | None:
        spark.sql(statement, args=dict(args or {})).collect()  # commands return no or few rows
        return None

    return run


def sql_gate(spark: SparkSession, query: str, args: Mapping[str, Any] | None = None) -> DataFrame:
    """A condition given as a query: the job runs if it returns rows."""
    return spark.sql(query, args=dict(args or {}))


def utc_now() -> dt.datetime:
    return dt.datetime.now(dt.UTC)


def run_job(project: str, name: str, steps: Sequence[Step | str], log: RunLog,
            condition: DataFrame | str | None = None, args: Mapping[str, Any] | None = None) -> str:
    """Run ``steps`` in order if ``condition`` has rows (or is absent) and log the outcome.

    Steps and condition are SQL texts, run with the named parameters ``args``, or a callable that
    returns the number of rows it wrote (or None) and a frame. Steps done before a failing one
    keep their output. Returns "done", "skipped" or "failed".
    """
    start = utc_now()
    rows, status, error = 0, "done", None
    try:
        gate = sql_gate(log.spark, condition, args) if isinstance(condition, str) else condition
        if gate is not None and gate.isEmpty():
            status = "skipped"
        else:
            for step in steps:
                rows += (sql_step(log.spark, step, args) if isinstance(step, str) else step)() or 0
    except Exception as failure:  # the log is the report: callers read the status
        status, error = "failed", f"{type(failure).__name__}: {failure}"
    log.add(project, name, start, utc_now(), rows, status, error)
    return status


DELIVERY = "delivery"


def stage_rows(df: DataFrame, table: str, date_column: str = "date", mode: str = "append") -> None:
    """Add ``df`` to a staging table as a delivery of its own: one partition per date and delivery."""
    balanced = df.hint("rebalance", date_column)  # whole files per date, hot dates split
    rows = balanced.withColumn(DELIVERY, F.lit(uuid.uuid4().hex))
    rows.write.mode(mode).partitionBy(date_column, DELIVERY).format("parquet").saveAsTable(table)


def create_staging(df: DataFrame, table: str, date_column: str = "date") -> None:
    """Save ``df`` as a managed staging table, its first delivery."""
    stage_rows(df, table, date_column, "overwrite")


def load_staged(spark: SparkSession, staging: str, main_path: str, date: str,
                run_id: str | None = None, date_column: str = "date") -> int:
    """Move the deliveries of one date of ``staging`` to ``main_path``; returns the rows moved.

    A run first writes which deliveries it takes, then their rows into its own folder, then that it
    has done so, and at last drops exactly these deliveries. Each call first finishes what an
    interrupted one began: rows are written again only while nothing was dropped. So a retry after a crash at any
    point adds nothing twice, and rows that arrive meanwhile are deliveries of their own and stay
    for another run. A finished ``run_id`` is never used again. One loader at a time.
    """
    day = dt.date.fromisoformat(date)
    staged = spark.table(staging).filter(F.col(date_column) == F.lit(day))
    claims, done = f"{main_path}.claims", f"{main_path}.written"

    def finish(run: str, deliveries: list[str]) -> int:
        target = f"{main_path}/run_id={run}"
        written = stored_table(spark, done)
        if written is None or written.filter(F.col("run_id") == run).isEmpty():
            rows = staged.filter(F.col(DELIVERY).isin(deliveries)).drop(DELIVERY)
            rows.write.mode("overwrite").parquet(target)
            moved = spark.read.parquet(target).count()
            spark.createDataFrame([(run, moved)], "run_id string, n_rows bigint").coalesce(1).write.mode("append").parquet(done)
        else:
            moved = 0
        parts = ", ".join(f"PARTITION ({date_column} = DATE'{day}', {DELIVERY} = '{d}')" for d in deliveries)
        spark.sql(f"ALTER TABLE {staging} DROP IF EXISTS {parts}")
        return moved

    present = {r[0] for r in staged.select(DELIVERY).distinct().collect()}  # one row per delivery
    moved, used = 0, set()
    known = stored_table(spark, claims)
    if known is not None:
        for row in known.filter(F.col("day") == F.lit(day)).collect():
            used.add(row["run_id"])
            if present & set(row["deliveries"]):
                moved += finish(row["run_id"], row["deliveries"])
                present -= set(row["deliveries"])
    new = sorted(present)
    if not new or run_id in used:
        return moved
    run_id = run_id or uuid.uuid4().hex
    claim = [(run_id, day, new)]
    spark.createDataFrame(claim, "run_id string, day date, deliveries array<string>").coalesce(1).write.mode("append").parquet(claims)
    return moved + finish(run_id, new)
