"""Session folds on streams: the same steps as in batch, one state for each session, dropped when it has been idle."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.text import millis
from ..operators import frequency as Q
from ..operators.fold import importable
from ..plans.config import FrequencyConfig, PipelineConfig, ScannerConfig
from ..plans.inspect import _OUT as INSPECTED
from ..plans.inspect import inspect_step, stages


class Fold(StatefulProcessor):
    """A step over the rows of each session. Its state is JSON: plain dicts, lists and numbers.

    `make` gives the step on the worker, from plain settings, as read-only mappings don't travel.
    """

    def __init__(self, make: Callable[[dict], Callable], settings: dict, keep: list[str], names: list[str], ttl_ms: int | None) -> None:
        self.make, self.settings, self.keep, self.names, self.ttl_ms = make, settings, keep, names, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.step = self.make(self.settings)
        self.state = handle.getValueState("session", "state string", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.state.get()
        state = json.loads(held[0]) if held is not None else None
        batch = pd.concat(list(rows)).sort_values(["ts_ms", "seq"], kind="stable")
        out = []
        for row in batch.to_dict("records"):
            state, made = self.step(state, row)
            if made is not None:
                out.append([row[k] for k in self.keep] + [made[n] for n in self.names])
        self.state.clear() if state is None else self.state.update((json.dumps(state),))
        yield pd.DataFrame(out, columns=[*self.keep, *self.names])

    def close(self) -> None:
        pass


def _settings(c: FrequencyConfig) -> dict:
    return {"enabled": c.enabled, "half_life_ms": c.half_life_ms, "thresholds": c.thresholds, "rolling_window_ms": c.rolling_window_ms, "rolling_threshold": c.rolling_threshold, "ttl_ms": c.ttl_ms}


def _fold(rows: DataFrame, make, settings: dict, keep: list[str], out: list, state_ttl_ms: int | None) -> DataFrame:
    importable(rows.sparkSession)
    types = dict(rows.dtypes)
    schema = ", ".join([f"`{k}` {types[k]}" for k in keep] + [f"`{n}` {sql}" for n, _, sql in out])
    fold = Fold(make, settings, keep, [n for n, _, _ in out], state_ttl_ms)
    return rows.groupBy("session_id").transformWithStateInPandas(statefulProcessor=fold, outputStructType=schema, outputMode="Append", timeMode="ProcessingTime" if state_ttl_ms else "None")


def _frequency_step(settings: dict):
    return Q.session_step(FrequencyConfig(**settings))


def stream_frequency(updates: DataFrame, config: FrequencyConfig, state_ttl_ms: int | None = None) -> DataFrame:
    """A streaming frame of updates (session_id, ts_ms, seq, weight, hits) to results. The session needs the RocksDB state store.

    Within a batch a session's rows are put in order; across batches they are taken as they come. Late rows are the caller's
    to divert, by a watermark of their own, before this step. With state_ttl_ms, an idle session's state goes after so long
    on the clock; choose it above the sessions' own ttl, after which a state counts for nothing anyway.
    """
    return _fold(updates, _frequency_step, _settings(config), ["session_id", "ts_ms", "seq"], Q.RESULT, state_ttl_ms)


def _inspect_step(settings: dict):
    return inspect_step(PipelineConfig(frequency=FrequencyConfig(**settings["frequency"]), two_pass=settings["two_pass"], scanner=ScannerConfig(enabled=settings["scanner"])))


def stream_inspect(messages: DataFrame, config: PipelineConfig = PipelineConfig(), state_ttl_ms: int | None = None, rejected=None) -> DataFrame:
    """A stream of messages to decisions: session_id, ts_ms, seq, message_id, path, tier, scores and the stages' verdicts.

    Rules, schemas and detectors are plain columns of the stream; only narrow rows reach the state. Alerts follow in
    foreachBatch, over the batch's decisions. `rejected` is a column that says whose session id is not accepted: such a
    message neither reads nor changes a score.
    """
    df = stages(messages, config).withColumn("ts_ms", millis("ts"))
    ids = F.transform("findings", lambda f: f.rule_id)
    rows = df.select(
        "session_id", "ts_ms", "seq", "message_id", "trusted", (F.lit(False) if rejected is None else F.coalesce(rejected, F.lit(False))).alias("rejected"), F.col("pre.pass").alias("pre_pass"), F.size("pre.rule_ids").alias("n_pre"), Q.total_weight(F.col("pre.rule_ids"), config.frequency).alias("w_pre"),
        F.arrays_overlap("pre.rule_ids", F.array(*map(F.lit, config.hard_block))).alias("hard"), F.size("findings").alias("n_scan"), Q.total_weight(ids, config.frequency).alias("w_scan"), (~F.exists("findings", lambda f: f.blocked)).alias("scan_safe"),
    )
    settings = {"frequency": _settings(config.frequency), "two_pass": config.two_pass, "scanner": config.scanner.enabled}
    decided = _fold(rows, _inspect_step, settings, ["session_id", "ts_ms", "seq", "message_id", "pre_pass", "scan_safe"], INSPECTED, state_ttl_ms)
    safe = F.when(F.col("path") == "trusted", True).when(F.col("path").isin("terminated", "stopped"), False).otherwise(F.col("pre_pass") & (~F.col("scanned") | F.col("scan_safe")))
    return decided.withColumn("safe", safe)


def stop_all(spark: SparkSession, prefix: str = "") -> list[str]:
    """Stops the session's running streams whose names begin with prefix, those without a name only if it is empty; returns their ids."""
    gone = [q for q in spark.streams.active if (q.name or "").startswith(prefix)]
    for q in gone:
        q.stop()
    return [str(q.id) for q in gone]
