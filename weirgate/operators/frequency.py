"""Session suspicion: decayed scores, tiers, termination, rolling promotion, eviction; one pure step for batch and streams."""

from __future__ import annotations

import heapq
import math
from collections import OrderedDict, deque

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.config import TIERS, FrequencyConfig
from .fold import keyed_fold


def weight(rule: Column, config: FrequencyConfig) -> Column:
    """Exact weight, else that of the longest prefix, else 0."""
    out = None
    for name, w in config.exact.items():
        out = (F.when if out is None else out.when)(rule == name, float(w))
    for prefix, w in config.globs:
        out = (F.when if out is None else out.when)(rule.startswith(prefix), float(w))
    return F.lit(0.0) if out is None else out.otherwise(0.0)


def total_weight(rule_ids: Column, config: FrequencyConfig) -> Column:
    return F.aggregate(F.transform(rule_ids, lambda r: weight(r, config)), F.lit(0.0), lambda a, x: a + x)


def tier_of(score: Column, config: FrequencyConfig) -> Column:
    a, b, c = config.thresholds
    return F.when(score >= c, "tier3").when(score >= b, "tier2").when(score >= a, "tier1").otherwise("none")


def update(state: dict | None, at: int, added: float, hits: int, c: FrequencyConfig) -> tuple[dict | None, dict]:
    """One update of a session at `at` ms. States hold score, last, rolling (times) and terminated."""
    if not c.enabled:
        return state, {"previous_score": 0.0, "current_score": 0.0, "tier": "none", "terminated": False}
    if state is not None and at - state["last"] > c.ttl_ms:
        state = None
    if state is None:
        state = {"score": 0.0, "last": at, "rolling": [], "terminated": False}
    if state["terminated"]:
        return state, {"previous_score": state["score"], "current_score": state["score"], "tier": "tier3", "terminated": True}
    before = state["score"] * math.exp(-(at - state["last"]) * math.log(2) / c.half_life_ms)
    score = before + added
    rolling = [t for t in state["rolling"] + ([at] if hits else []) if t >= at - c.rolling_window_ms]
    t1, t2, t3 = c.thresholds
    tier = "tier3" if score >= t3 else "tier2" if score >= t2 else "tier1" if score >= t1 else "none"
    if tier == "none" and len(rolling) >= c.rolling_threshold:
        tier = "tier1"
    # Times beyond the threshold can't change a later answer: the oldest ones leave first anyway.
    state = {"score": score, "last": at, "rolling": rolling[-c.rolling_threshold :], "terminated": tier == "tier3"}
    return state, {"previous_score": before, "current_score": score, "tier": tier, "terminated": tier == "tier3"}


RESULT = [("previous_score", pa.float64(), "double"), ("current_score", pa.float64(), "double"), ("tier", pa.string(), "string"), ("terminated", pa.bool_(), "boolean")]


def session_step(config: FrequencyConfig):
    """Rows have ts_ms, weight, hits, and optionally control: 'reset' drops the session."""

    def step(state, row):
        if row.get("control") == "reset":
            return None, None
        return update(state, row["ts_ms"], row["weight"] or 0.0, row["hits"] or 0, config)

    return step


class _World:
    """Sessions of one global order, found by age without a look at all of them."""

    def __init__(self) -> None:
        self.sessions: dict = {}
        self.number: dict = {}
        self.idle: OrderedDict = OrderedDict()
        self.ended: list = []
        self.born: deque = deque()
        self.count = 0

    def drop(self, key) -> None:
        del self.sessions[key], self.number[key], self.idle[key]

    def expire(self, before: float) -> None:
        while self.idle and self.sessions[key := next(iter(self.idle))]["last"] < before:
            self.drop(key)

    def put(self, key, state: dict) -> None:
        old = self.sessions.get(key)
        if old is None:
            self.count += 1
            self.number[key] = self.count
        self.sessions[key] = state
        if old is None or old["last"] != state["last"]:
            self.idle[key] = None
            self.idle.move_to_end(key)
        if state["terminated"] and not (old and old["terminated"]):
            heapq.heappush(self.ended, (self.number[key], key))

    def evict(self, key) -> None:
        """The terminated session that came first, else the idlest, of equals the one that came first; never `key`."""
        held = []
        while self.ended and (self.number.get(self.ended[0][1]) != self.ended[0][0] or self.ended[0][1] == key):
            top = heapq.heappop(self.ended)
            if self.number.get(top[1]) == top[0]:
                held.append(top)
        gone = self.ended[0][1] if self.ended else None
        for top in held:
            heapq.heappush(self.ended, top)
        if gone is None:
            others = (k for k in self.idle if k != key)
            gone = next(others)
            oldest = self.sessions[gone]["last"]
            for k in others:
                if self.sessions[k]["last"] != oldest:
                    break
                gone = min(gone, k, key=self.number.__getitem__)
        self.drop(gone)


def capacity_step(config: FrequencyConfig):
    """All sessions in one order: over capacity a terminated session goes first, else the idlest; at capacity new ones are limited."""

    def step(world, row):
        world = world or _World()
        at, key = row["ts_ms"], row["session_id"]
        world.expire(at - config.ttl_ms)
        if key not in world.sessions:
            while world.born and world.born[0] <= at - 60_000:
                world.born.popleft()
            if len(world.sessions) >= config.max_sessions and len(world.born) >= config.max_new_sessions_per_minute:
                return world, {"previous_score": 0.0, "current_score": 0.0, "tier": "none", "terminated": False}
            world.born.append(at)
        state, out = update(world.sessions.get(key), at, row["weight"] or 0.0, row["hits"] or 0, config)
        world.put(key, state)
        if len(world.sessions) > config.max_sessions:
            world.evict(key)
        return world, out

    return step


def frequency(updates: DataFrame, config: FrequencyConfig, keep: list[str] | None = None) -> DataFrame:
    """Results of the updates (session_id, ts_ms, seq, weight, hits), in order of ts_ms and seq within each session."""
    keep = keep or ["session_id", "ts_ms", "seq"]
    if config.strict_capacity:
        return keyed_fold(updates, [], ["ts_ms", "seq"], capacity_step(config), RESULT, keep)
    return keyed_fold(updates, ["session_id"], ["ts_ms", "seq"], session_step(config), RESULT, keep)


def latest(results: DataFrame) -> DataFrame:
    """Each session's last state."""
    return results.groupBy("session_id").agg(F.max_by(F.struct("current_score", "tier", "terminated", "ts_ms"), F.struct("ts_ms", "seq")).alias("s")).select("session_id", "s.*")


def rank(tier: Column) -> Column:
    out = F.lit(0)
    for i, t in enumerate(TIERS):
        out = F.when(tier == t, i).otherwise(out)
    return out
