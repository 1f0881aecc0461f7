"""Structured Streaming twins of the lifecycle operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.reconcile import LONGEST_CHAIN, PROPOSAL_STEPS, STAGES

#: The state store that keyed state of several parts needs.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def windowed_counts(events: DataFrame, ts: str = "ts", every: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Events and their value by type and event-time window; late rows beyond the watermark are dropped."""
    timed = events.withColumn("at", F.col(ts).cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", every), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def replayed(journal: DataFrame, key: str, event: str, order: str) -> DataFrame:
    """key, status, events, illegal after each micro-batch, from a stream of journal events: the
    state of a key is its status and counts; events of a batch are folded in order."""

    def fold(k, frames, state):
        status, events, illegal = state.get if state.exists else ("", 0, 0)
        rows = pd.concat(list(frames)).sort_values(order)
        for step in rows[event]:
            events += 1
            if step in PROPOSAL_STEPS.get(status, ()):
                status = step
            else:
                illegal += 1
        state.update((status, events, illegal))
        yield pd.DataFrame({key: [k[0]], "status": [status], "events": [events], "illegal": [illegal]})

    kind = dict(journal.dtypes)[key]
    return journal.groupBy(key).applyInPandasWithState(fold, f"{key} {kind}, status string, events int, illegal int", "status string, events int, illegal int", "update", "NoTimeout")


#: Groups that keys are dealt into: a call of Python is for a group, its state is a map by key. It must not change while a checkpoint is in use.
GROUPS = 1024


def _with_state(df: DataFrame, key: str, processor: StatefulProcessor, schema: str, mode: str) -> DataFrame:
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    group = F.when(F.col(key).isNull(), -1).otherwise(F.pmod(F.xxhash64(key), F.lit(GROUPS)))
    return df.withColumn("group_", group.cast("int")).groupBy("group_").transformWithStateInPandas(processor, schema, mode, "None")


class _Keyed(StatefulProcessor):
    """Folds the rows of each key of a group in order; the state of a key is one value."""

    state: str

    def __init__(self, key: str, kind: str):
        self.key, self.kind = key, kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.now = handle.getMapState("now", f"{self.key} {self.kind}", self.state)

    def close(self) -> None:
        pass

    def each(self, frame: pd.DataFrame, fold) -> None:
        """Calls fold(key, state or None, first row, row after the last) for each key of a sorted frame and keeps what it returns."""
        known, keys = self.now.exists(), [None if pd.isna(k) else k for k in frame[self.key]]
        begin = 0
        for end in range(1, len(keys) + 1):
            if end == len(keys) or keys[end] != keys[begin]:
                place = (keys[begin],)
                old = self.now.getValue(place) if known else None
                new = fold(keys[begin], old, begin, end)
                if old is None or tuple(old) != new:
                    self.now.updateValue(place, new)
                begin = end


class _Journal(_Keyed):
    """Status, digest and held ids of a proposal, as many as its longest chain has steps; gives every event its outcome."""

    state = "status string, digest string, first string, second string, third string"

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values([self.key, "ordinal", "event_id"])
        kinds, ids, payloads = (frame[c].tolist() for c in ("event_type", "event_id", "payload_digest"))
        out = []

        def fold(_, old, begin, end):
            status, digest, *held = old or ("", None, None, None, None)
            held = [h for h in held if h is not None]
            for kind, event_id, payload in zip(kinds[begin:end], ids[begin:end], payloads[begin:end], strict=True):
                if event_id in held:
                    out.append("duplicate")
                elif digest is not None and payload != digest:
                    out.append("payload changed")
                elif kind not in PROPOSAL_STEPS.get(status, ()):
                    out.append("illegal step")
                else:
                    status, digest = kind, digest or payload
                    held += [] if pd.isna(event_id) else [event_id]
                    out.append("appended")
            return (status, digest, *(held + [None] * LONGEST_CHAIN)[:LONGEST_CHAIN])

        self.each(frame, fold)
        yield pd.DataFrame({self.key: frame[self.key], "ordinal": frame["ordinal"], "event_type": frame["event_type"], "outcome": out})


def judged(events: DataFrame, key: str = "proposal_id") -> DataFrame:
    """key, ordinal, event_type, outcome of a stream of journal events, as `contracts.appended` judges a batch."""
    kind = dict(events.dtypes)[key]
    return _with_state(events.select(key, "ordinal", "event_type", "event_id", "payload_digest"), key, _Journal(key, kind), f"{key} {kind}, ordinal bigint, event_type string, outcome string", "append")


class _Stages(_Keyed):
    """Stage, counts and links of a version."""

    state = "status string, processed int, events int, linked boolean"

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values([self.key, "ordinal"])
        failures, links = frame["failed"].tolist(), frame["linked"].tolist()
        out = []

        def fold(version, old, begin, end):
            status, processed, events, linked = old or (STAGES[0], 0, 0, False)
            for failed, link in zip(failures[begin:end], links[begin:end], strict=True):
                if status in (STAGES[-1], "failed"):
                    break
                linked = linked or bool(link)
                after = STAGES[STAGES.index(status) + 1]
                status = "failed" if failed or (after == STAGES[-1] and not linked) else after
                processed += status != "failed"
            out.append((version, status, processed, events + end - begin))
            return status, processed, events + end - begin, linked

        self.each(frame, fold)
        yield pd.DataFrame(out, columns=[self.key, "status", "processed", "events"])


def processed(reports: DataFrame, key: str = "version_id") -> DataFrame:
    """key, status, processed, events after each micro-batch, as `reconcile.processed` has them for a whole table."""
    kind = dict(reports.dtypes)[key]
    return _with_state(reports.select(key, "ordinal", "failed", "linked"), key, _Stages(key, kind), f"{key} {kind}, status string, processed int, events int", "update")
