"""Decisions at the message gateway: session ids, exemptions, inbound and outbound gates, repeated scans, breadcrumbs."""

from __future__ import annotations

from collections import OrderedDict

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import truncated
from ..plans.config import GatewayConfig
from .fold import keyed_fold


def session_id(key: Column, channel: Column, conversation: Column, account: Column, row: Column) -> Column:
    """The key; else the channel with the conversation (the account only where that is null); else an id of this row alone."""
    channel, where = F.coalesce(channel, F.lit("unknown")), F.nullif(F.coalesce(conversation, account), F.lit(""))
    return F.coalesce(F.nullif(key, F.lit("")), F.concat(channel, F.lit(":"), where), F.concat(channel, F.lit(":ephemeral:"), F.sha2(row.cast("string"), 256)))


def exempt(channel: Column, sender: Column, inbound: Column, config: GatewayConfig) -> Column:
    """Channels in both directions, senders inbound only."""
    by_channel = channel.isin(*config.exempt_channels) if config.exempt_channels else F.lit(False)
    by_sender = inbound & sender.isin(*config.exempt_senders) if config.exempt_senders else F.lit(False)
    return F.coalesce(by_channel | by_sender, F.lit(False))


def inbound(safe: Column, tier: Column, terminated: Column, skip: Column, config: GatewayConfig) -> Column:
    """struct(action, message): pass or block."""
    act = lambda a, m: F.struct(F.lit(a).alias("action"), F.lit(m).cast("string").alias("message"))
    stop = ~safe | ((tier == "tier2") & F.lit(config.tier2_action == "block"))
    return F.when(skip, act("pass", None)).when(terminated, act("block", config.terminate_message)).when(stop, act("block", config.block_message)).otherwise(act("pass", None))


def outbound(safe: Column, terminated: Column, sanitized: Column, skip: Column, config: GatewayConfig) -> Column:
    """struct(action, message): pass, redact or cancel."""
    act = lambda a, m: F.struct(F.lit(a).alias("action"), m.cast("string").alias("message"))
    none = F.lit(None)
    return F.when(skip, act("pass", none)).when(terminated, act("cancel", none)).when(~safe & F.lit(config.redact_outbound) & sanitized.isNotNull(), act("redact", sanitized)).when(~safe, act("cancel", none)).otherwise(act("pass", none))


def repeated_scans(rows: DataFrame, content="content", ttl_ms: int = 5000, most: int | None = None) -> DataFrame:
    """Adds cached: whether the content is answered from a scan of it for the session at most ttl_ms before. A hit renews nothing.

    With `most`, all sessions share one copy store of that size in one global order: when it is full, copies past their
    time go, and if it still is, the scan leaves no copy.
    """
    rows = rows.withColumn("__key", F.sha2(F.concat(F.col(content), F.lit("\0"), F.col("session_id").cast("string")), 256))
    keep = [c for c in rows.columns if c != "__key"]

    def alone(scanned, row):
        if scanned is not None and row["ts_ms"] - scanned <= ttl_ms:
            return scanned, {"cached": True}
        return row["ts_ms"], {"cached": False}

    def shared(copies, row):
        # Copies in the order of their scans, so that those past their time are in front.
        copies, at, key = copies if copies is not None else OrderedDict(), row["ts_ms"], row["__key"]
        if key in copies and at - copies[key] <= ttl_ms:
            return copies, {"cached": True}
        copies.pop(key, None)
        while len(copies) >= most and at - next(iter(copies.values())) > ttl_ms:
            copies.popitem(last=False)
        if len(copies) < most:
            copies[key] = at
        return copies, {"cached": False}

    keys, step = (["__key"], alone) if most is None else ([], shared)
    return keyed_fold(rows, keys, ["ts_ms", "seq"], step, [("cached", pa.bool_(), "boolean")], keep)


def breadcrumb(texts: Column) -> Column:
    """struct(preview, sha256) of a model's texts joined by newlines."""
    whole = F.array_join(texts, "\n")
    return F.struct(truncated(whole, 500).alias("preview"), F.sha2(whole, 256).alias("sha256"))
