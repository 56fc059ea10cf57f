"""Sources of messages and of events, and sinks for what is made of them."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.config import NAMESPACE

MESSAGES = "seq bigint, ts timestamp, session_id string, message_id string, tool_call_id string, source string, server_name string, tool_name string, content string"
_START = "TIMESTAMP '2024-01-01 00:00:00'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _as_messages(df: DataFrame, **columns) -> DataFrame:
    import re

    out = []
    for name, kind in re.findall(r"(\w+) (\w+)", MESSAGES):
        out.append((columns[name] if name in columns else F.lit(None)).cast(kind).alias(name))
    return df.select(*out)


def from_conversations(spark: SparkSession, sf_dir: str, step_seconds: int = 30) -> DataFrame:
    return conversation_messages(table(spark, sf_dir, "conversations"), step_seconds)


def conversation_messages(df: DataFrame, step_seconds: int = 30) -> DataFrame:
    """Turns as messages, of a table or of a stream; they have no times of their own."""
    source = F.when(F.col("role") == "system", "transcript").otherwise(F.col("role"))
    at = F.expr(f"{_START} + make_interval(0, 0, 0, 0, 0, 0, turn * {step_seconds})")
    return _as_messages(df, seq=F.col("turn"), ts=at, session_id=F.col("conv_id").cast("string"), message_id=F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")), source=source, content=F.col("text"))


def from_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.expr(f"{_START} + make_interval(0, 0, 0, 0, 0, 0, doc_id)")
    return _as_messages(table(spark, sf_dir, "documents"), seq=F.col("doc_id"), ts=at, session_id=F.col("source"), message_id=F.col("doc_id").cast("string"), source=F.lit("user"), content=F.col("text"))


def union_events(*frames: DataFrame) -> DataFrame:
    """Events of several kinds in one frame, with nulls for what a kind doesn't have."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def write_each(sinks: dict, on_error=None):
    """A foreachBatch function that writes a batch to every sink; one that fails doesn't stop the others, and is reported, or else warned of."""

    def run(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for name, sink in sinks.items():
                try:
                    sink(batch, number)
                except Exception as e:  # noqa: BLE001
                    if on_error:
                        on_error(name, e)
                    else:
                        warnings.warn(f"sink {name} failed: {e}", stacklevel=2)
        finally:
            batch.unpersist()

    return run


def log_lines(events: DataFrame) -> DataFrame:
    """One JSON line for each event, with the level it is logged at."""
    critical = F.col("severity") == "critical" if "severity" in events.columns else F.lit(False)
    return events.select(F.when(critical, "error").otherwise("info").alias("level"), F.to_json(F.struct(*events.columns)).alias("value"))


def choose_sinks(mode: str, log, ingest=None) -> dict:
    """The sinks of a mode: log, ingest or both. Without one to ingest with, both falls back to the log, and ingest is refused."""
    if mode not in ("log", "ingest", "both"):
        raise ValueError(f"unknown sink mode {mode!r}")
    if ingest is None and mode == "ingest":
        raise ValueError("mode ingest needs a sink to ingest with")
    if ingest is None and mode == "both":
        warnings.warn("no sink to ingest with: log only", stacklevel=2)
    chosen = {"log": log} if mode != "ingest" else {}
    return chosen | ({"ingest": ingest} if ingest is not None and mode != "log" else {})


def ingest_rows(rows: DataFrame, namespace: str = "security") -> DataFrame:
    """(type, namespace, tags, text, notify, message) of audit events, or of alerts; only high and critical alerts notify."""
    text = F.to_json(F.struct(*rows.columns))
    if "alert_rule" not in rows.columns:
        return rows.select(F.lit(f"{NAMESPACE}_audit").alias("type"), F.lit(namespace).alias("namespace"), F.array(F.lit(NAMESPACE), "event").alias("tags"), text.alias("text"), F.lit(False).alias("notify"), F.lit(None).cast("string").alias("message"))
    loud = F.col("severity").isin("high", "critical")
    message = F.concat(F.lit(f"[{NAMESPACE} "), "severity", F.lit("] "), "alert_rule", F.lit(": "), "summary")
    return rows.select(F.lit(f"{NAMESPACE}_alert").alias("type"), F.lit(namespace).alias("namespace"), F.array(F.lit(NAMESPACE), F.lit("alert"), "severity").alias("tags"), text.alias("text"), loud.alias("notify"), F.when(loud, message).alias("message"))
