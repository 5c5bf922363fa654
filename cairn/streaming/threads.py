"""Threads of a conversation as keyed state over a stream of turns, with writes in two phases.

A turn that asks for a write only leaves it pending. The thread's next turn decides: a
confirmation makes it a write, anything else drops it. A thread that is silent for
longer than its time to live ends by an event-time timer and with it what is pending;
a later turn begins the thread anew. State lives in the state store, under names
that ``state`` reads: thread, pending, slots and messages.

Turns of a thread must come in order of their time from batch to batch; within one they are
sorted, so a trigger bounds what a task holds of one thread.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from cairn.operators.writes import gate
from cairn.sources.versioned import VersionedTable

ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

TURNS = "thread long, seq long, at timestamp, kind string, account string, for_account string, tool string, item string, text string"
OUTCOMES = "thread long, session int, seq long, at timestamp, outcome string, tool string, item string, messages int"
THREAD = "session int, messages int, account string, last_at timestamp"
PENDING = "seq long, tool string, item string, account string"
MESSAGE = "seq long, kind string, text string"
SLOT = "item string"


class Threads(StatefulProcessor):
    def __init__(self, ttl_seconds: int):
        self.ttl = pd.Timedelta(seconds=ttl_seconds)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.thread = handle.getValueState("thread", THREAD)
        self.pending = handle.getValueState("pending", PENDING)
        self.slots = handle.getMapState("slots", "tool string", SLOT)
        self.messages = handle.getListState("messages", MESSAGE)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        turns = pd.concat(list(rows)).sort_values(["at", "seq"])
        session, n, account, last = self.thread.get() if self.thread.exists() else (0, 0, None, None)
        pending = self.pending.get() if self.pending.exists() else None
        out, new, slots = [], [], {}
        for t in turns.itertuples(index=False):
            if last is not None and t.at - pd.Timestamp(last) > self.ttl:
                out.append((key[0], session, None, pd.Timestamp(last) + self.ttl, "expired", *((pending[1], pending[2]) if pending else (None, None)), n))
                session, n, account, pending, last, new, slots = session + 1, 0, None, None, None, [], {}
                self._end()
            n, account, last = n + 1, account if n else t.account, t.at
            tool, item = t.tool, t.item
            if t.kind in ("confirm", "cancel"):
                outcome = "error" if pending is None else "written" if t.kind == "confirm" else "cancelled"
                tool, item = (None, None) if pending is None else pending[1:3]
                pending = None
            else:
                outcome = t.gate if t.kind == "write" else "answer"
                pending = (t.seq, t.tool, t.item, t.account) if outcome == "confirm" else None
                if pd.notna(t.tool):
                    slots[t.tool] = t.item
            new.append((t.seq, t.kind, t.text))
            out.append((key[0], session, t.seq, t.at, outcome, tool, item, n))
        self.thread.update((session, n, account, last))
        self.pending.update(pending) if pending else self.pending.clear()
        for tool, item in slots.items():
            self.slots.updateValue((tool,), (item,))
        self.messages.appendList(new)
        for old in self.handle.listTimers():
            self.handle.deleteTimer(old)
        self.handle.registerTimer(int((pd.Timestamp(last) + self.ttl).value // 1_000_000))
        yield self._frame(out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        session, n, _, last = self.thread.get()
        pending = self.pending.get() if self.pending.exists() else None
        self._end()
        self.thread.update((session + 1, 0, None, None))  # numbers go on if the thread comes back
        yield self._frame([(key[0], session, None, pd.Timestamp(last) + self.ttl, "expired", *((pending[1], pending[2]) if pending else (None, None)), n)])

    def _end(self) -> None:
        self.pending.clear()
        self.slots.clear()
        self.messages.clear()

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(rows, columns=[c.split()[0] for c in OUTCOMES.split(", ")])
        return frame.astype({"thread": "Int64", "session": "int32", "seq": "Int64", "messages": "int32"})

    def close(self) -> None:
        pass


def outcomes(turns: DataFrame, ttl_seconds: int, late: str = "1 second") -> DataFrame:
    """A stream of turns as what becomes of each, and the ends of threads. Turns without a thread or a time are left out."""
    gated = turns.where("thread IS NOT NULL AND at IS NOT NULL").withColumn("gate", gate(F.col("tool"), F.col("text"), F.col("account"), F.col("for_account")))
    by_thread = gated.withWatermark("at", late).groupBy("thread")
    return by_thread.transformWithStateInPandas(Threads(ttl_seconds), outputStructType=OUTCOMES, outputMode="append", timeMode="eventtime")


def run(turns: DataFrame, checkpoint: str, outcome_table: VersionedTable, ttl_seconds: int, late: str = "1 second") -> None:
    """Take the turns that are there, in batches, append what becomes of them to a table, each batch once, and stop."""

    def hand_on(batch: DataFrame, number: int) -> None:
        VersionedTable(batch.sparkSession, outcome_table.path).append(batch, checkpoint, number)

    done = outcomes(turns, ttl_seconds, late)
    done.writeStream.foreachBatch(hand_on).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def stream_session(spark: SparkSession) -> SparkSession:
    """A session of its own with the disk-backed state store, so that no setting of the given one changes."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS_DB)
    return own


def state(spark: SparkSession, checkpoint: str, name: str) -> DataFrame:
    """What the state store of a stopped stream holds: thread, pending, slots or messages, by key."""
    return spark.read.format("statestore").option("stateVarName", name).load(checkpoint)


def outcomes_by_window(turns: DataFrame, ttl_seconds: int, watermark: Column | None = None) -> DataFrame:
    """The same rows of a whole table at once, by windows: for backfills and to compare. Threads silent since ``watermark`` less their time to live have ended."""
    order = Window.partitionBy("thread").orderBy("at", "seq")
    rows = turns.where("thread IS NOT NULL AND at IS NOT NULL").withColumn("gate", gate(F.col("tool"), F.col("text"), F.col("account"), F.col("for_account")))
    ttl = F.make_dt_interval(secs=F.lit(ttl_seconds))
    begins = F.coalesce(F.col("at") > F.lag("at").over(order) + ttl, F.lit(False))
    rows = rows.withColumn("session", F.sum(begins.cast("int")).over(order).cast("int"))
    own = Window.partitionBy("thread", "session").orderBy("at", "seq")
    asks = (F.col("kind") == "write") & (F.col("gate") == "confirm")
    before = F.lag(F.when(asks, F.struct("tool", "item"))).over(own)
    rows = rows.withColumn("before", before).withColumn("messages", F.row_number().over(own)).withColumn("last", F.lead("at").over(own).isNull())
    decides = F.col("kind").isin("confirm", "cancel")
    outcome = F.when(decides & F.col("before").isNull(), "error").when(F.col("kind") == "confirm", "written").when(F.col("kind") == "cancel", "cancelled").when(F.col("kind") == "write", F.col("gate")).otherwise("answer")
    said = rows.select("thread", "session", "seq", "at", outcome.alias("outcome"), *(F.when(decides, F.col("before")[c]).otherwise(F.col(c)).alias(c) for c in ("tool", "item")), "messages")
    returns = F.max("session").over(Window.partitionBy("thread")) > F.col("session")
    over = returns if watermark is None else returns | (F.col("at") + ttl <= watermark)
    waiting = F.when(asks, F.struct("tool", "item"))
    ended = rows.withColumn("over", over).where("last AND over")
    ended = ended.select("thread", "session", F.lit(None).cast("long").alias("seq"), (F.col("at") + ttl).alias("at"), F.lit("expired").alias("outcome"), waiting["tool"].alias("tool"), waiting["item"].alias("item"), "messages")
    return said.unionByName(ended)
