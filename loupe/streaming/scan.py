"""Continuous scans: detectors over arriving artifacts, windows over events, ledgers and expiry as state."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loupe.detection.engine import findings, scan_rows
from loupe.functions.staging import shared_dir
from loupe.registry import query
from loupe.sources.artifacts import PLANTED, TEXT


def arriving(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of its files."""
    path = f"{sf_dir}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def continuous_findings(artifacts: DataFrame) -> DataFrame:
    """Findings of a stream of (artifact_path, artifact_type, text), by all detectors. Nothing is kept between batches."""
    return findings(scan_rows(artifacts)).select("artifact_path", "id", "detector_id", "category", "line")


def fresh_only(artifacts: DataFrame, delay: str = "1 day") -> DataFrame:
    """Each content once within the watermark: (ts, artifact_path, text)."""
    return artifacts.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("sha256", F.sha2("text", 256)).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["sha256"])


def _timed(events: DataFrame, late: str) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def _counted(grouped) -> DataFrame:
    counted = grouped.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return counted.select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", "total")


def events_by_window(events: DataFrame, length: str = "1 day", late: str = "2 hours", slide: str | None = None) -> DataFrame:
    """Events and their sum in windows of event time: tumbling, or sliding by ``slide``."""
    return _counted(_timed(events, late).groupBy(F.window("ts", length, slide or length).alias("w"), "event_type"))


def events_by_session(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Events and their sum in sessions: one ends where the next event of its type is further away than the gap."""
    return _counted(_timed(events, late).groupBy(F.session_window("ts", gap).alias("w"), "event_type"))


def run_once(stream: DataFrame, mode: str) -> DataFrame:
    """Process what has arrived, and return the sink's rows, which are written by the executors to the shared folder.

    Appended rows go to files; a complete result replaces the one of the batch before.
    """
    spark = stream.sparkSession
    name = f"stream_{uuid.uuid4().hex}"
    out, base = f"{shared_dir(spark)}/{name}", f"{shared_dir(spark)}/{name}-checkpoint"
    writer = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", base)
    if mode == "append":
        writer.format("parquet").option("path", out).start().awaitTermination()
    else:
        writer.foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(out)).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@query("stream_event_windows", "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def q_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_once(events_by_window(arriving(spark, sf_dir, "events")), "complete")


@query("stream_sliding_windows", "SELECT strftime(s, '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT event_type, value, unnest([date_trunc('day', ts) + INTERVAL 12 HOUR * (CASE WHEN hour(ts) >= 12 THEN 1 ELSE 0 END), date_trunc('day', ts) + INTERVAL 12 HOUR * (CASE WHEN hour(ts) >= 12 THEN 0 ELSE -1 END)]) AS s FROM events) GROUP BY 1, 2")
def q_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_once(events_by_window(arriving(spark, sf_dir, "events"), "1 day", slide="12 hours"), "complete")


@query(
    "stream_sessions",
    """WITH g AS (SELECT *, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 4 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS k FROM g)
    SELECT strftime(min(ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY event_type, k""",
)
def q_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_once(events_by_session(arriving(spark, sf_dir, "events"), "4 hours"), "complete")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arriving(spark, sf_dir, "documents").select(F.expr("concat('doc/', doc_id, '.txt')").alias("artifact_path"), F.lit("text").alias("artifact_type"), F.expr(TEXT).alias("text"))


def _register() -> None:
    from loupe.detection.queries import _WITH

    @query("stream_findings", f"{_WITH} SELECT artifact_path, detector_id, category, line FROM f WHERE starts_with(artifact_path, 'doc/')")
    def q_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run_once(continuous_findings(_documents(spark, sf_dir)), "append").drop("id")


_register()


@query("stream_fresh", f"WITH a AS ({PLANTED}) SELECT DISTINCT sha256(text) AS sha256 FROM a")
def q_fresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000)))
    return run_once(fresh_only(docs), "append").select("sha256")


def ledger_links(entries: DataFrame) -> DataFrame:
    """Appended entries (log_id, sequence, entry_hash, previous_hash), each judged against the head that is kept of its log.

    A head is a sequence and a hash, so the state of a log doesn't grow; of a log, a batch's entries are held.
    """

    def judged(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        sequence, head = state.get if state.exists else (0, "")
        rows = pd.concat(list(batches)).sort_values("sequence")
        verdicts = []
        for r in rows.itertuples():
            verdict = "rolled_back" if r.sequence <= sequence else "gap" if r.sequence > sequence + 1 else "unlinked" if (r.previous_hash or "") != head else "linked"
            if verdict != "rolled_back":
                sequence, head = int(r.sequence), r.entry_hash
            verdicts.append((key[0], int(r.sequence), verdict))
        state.update((sequence, head))
        yield pd.DataFrame(verdicts, columns=["log_id", "sequence", "verdict"])

    return entries.groupBy("log_id").applyInPandasWithState(judged, "log_id long, sequence long, verdict string", "sequence long, head string", "append", GroupStateTimeout.NoTimeout)


@query("stream_ledger", "SELECT user_id AS log_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS sequence, 'linked' AS verdict FROM events")
def q_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loupe.operators.trust import chained
    from loupe.plans.fixtures import LEDGER, bound

    whole = chained(bound(spark, sf_dir, LEDGER)).select(F.col("log_id").cast("long").alias("log_id"), F.col("sequence").cast("long").alias("sequence"), "entry_hash", "previous_hash")
    path = f"{shared_dir(spark)}/ledger_{uuid.uuid4().hex}"
    whole.repartition("log_id").write.parquet(path)
    return run_once(ledger_links(spark.readStream.schema(whole.schema).parquet(path)), "append")


def expiry_alarms(consents: DataFrame, late: str = "1 hour") -> DataFrame:
    """(consent_id, expires_at) of consents (consent_id, ts, expires_at) whose end the stream's time has passed.

    Each keeps one moment as its state, and a timer of event time; a later row of a consent moves its end.
    """

    def watched(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (end,) = state.get
            state.remove()
            yield pd.DataFrame([(key[0], pd.Timestamp(end, unit="ms"))], columns=["consent_id", "expires_at"])
            return
        end = state.get[0] if state.exists else 0
        for rows in batches:
            known = rows["expires_at"].dropna()
            if len(known):
                end = max(end, int(known.max().timestamp() * 1000))
        if not end:
            return
        state.update((end,))
        if end <= state.getCurrentWatermarkMs():
            state.remove()
            yield pd.DataFrame([(key[0], pd.Timestamp(end, unit="ms"))], columns=["consent_id", "expires_at"])
        else:
            state.setTimeoutTimestamp(end)

    timed = consents.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy("consent_id").applyInPandasWithState(watched, "consent_id string, expires_at timestamp", "expires_at long", "append", GroupStateTimeout.EventTimeTimeout)
