"""Fail-fast and attempts as keyed state of a stream.

Both processors keep two numbers a key, so state grows with the keys, not with the rows. Rows of a key
have a sequence number and come in its order from one micro-batch to the next; a row whose number
is not above the last one was delivered before and is left out, so a batch that comes again changes nothing.
The session needs a state store that can hold typed state (``use_state_store``).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    """The store that streams with typed state need, for streams that start from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


class _Sequenced(StatefulProcessor):
    """What both processors share: rows of a key in order, without those that came before."""

    def __init__(self, seq: str):
        self.seq = seq

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "seq long")

    def fresh(self, rows: Iterator[pd.DataFrame]) -> pd.DataFrame | None:
        got = pd.concat(rows, ignore_index=True)
        if self.last.exists():
            got = got[got[self.seq] > self.last.get()[0]]
        got = got.drop_duplicates(self.seq).sort_values(self.seq, ignore_index=True)
        if not len(got):
            return None
        self.last.update((int(got[self.seq].iloc[-1]),))
        return got

    def close(self) -> None:
        pass


class FailFast(_Sequenced):
    """Rows up to the first that is not valid; with batches, to the end of its batch."""

    def __init__(self, seq: str, batch: str | None):
        super().__init__(seq)
        self.at = batch or seq

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.failed = handle.getValueState("failed", "at long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        got = self.fresh(rows)
        if got is None:
            return
        if self.failed.exists():
            bad = self.failed.get()[0]
        else:
            wrong = got[self.at][got["status"] != "valid"]
            bad = int(wrong.min()) if len(wrong) else None
            if bad is not None:
                self.failed.update((bad,))
        yield got if bad is None else got[got[self.at] <= bad]


class Attempts(_Sequenced):
    """Each record with one more attempt than its key had."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.tried = handle.getValueState("attempts", "n int")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        got = self.fresh(rows)
        if got is None:
            return
        before = self.tried.get()[0] if self.tried.exists() else 0
        got["attempts"] = range(before + 1, before + 1 + len(got))
        self.tried.update((before + len(got),))
        yield got

    def handleInitialState(self, key: Any, initialState: pd.DataFrame, timerValues: Any) -> None:
        self.tried.update((int(initialState["attempts"].max()),))


def until_failure_stream(rows: DataFrame, key: str, seq: str = "seq", batch: str | None = None) -> DataFrame:
    """`runs.until_failure` of a stream (append mode): rows of a key come in the order of ``seq``, ``batch`` grows with it."""
    return rows.groupBy(key).transformWithStateInPandas(FailFast(seq, batch), rows.schema, "Append", "None")


def attempts_stream(records: DataFrame, known: DataFrame | None = None, id_col: str = "qa_id", seq: str = "seq") -> DataFrame:
    """Records of a stream (append mode) with the number of their attempt; ``known`` has attempts made before the stream.

    The last record of each id, over the known ones, is what `runs.upsert` makes of the stream's records in turn.
    """
    schema = records.drop("attempts").schema.add("attempts", "integer")
    initial = None if known is None else known.select(id_col, "attempts").groupBy(id_col)
    return records.drop("attempts").groupBy(id_col).transformWithStateInPandas(Attempts(seq), schema, "Append", "None", initialState=initial)
