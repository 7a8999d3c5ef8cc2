"""Session interest as keyed state, telemetry and event-time windows.

Batch plans of the same rules are in :mod:`lectern.operators.sessions`. A session's
state is a value (profile, counts), a list of the last queries and a map of what was
shown, each stored apart: a turn reads and writes the ids it shows, not all that were
shown before.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lectern.operators.sessions import DECAY, RECENT
from lectern.plans.scratch import workers_import_package

OUTPUT = "session_id bigint, turns bigint, profile array<double>, n_recent int, n_surfaced int"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def advance(profile: list[float], recent: list[list[float]], vectors: Iterable[list[float]]) -> tuple[list[float], list[list[float]]]:
    """Profile and last queries after further query vectors."""
    for vector in vectors:
        vector = [float(x) for x in vector]
        if profile and len(vector) != len(profile):
            raise ValueError("vectors of one session must have one length")
        profile = vector if not profile else [DECAY * p + (1 - DECAY) * q for p, q in zip(profile, vector, strict=True)]
        recent = [vector, *recent][:RECENT]
    return profile, recent


def update(state: tuple | None, turns: list[tuple[int, list[float], list[int]]]) -> tuple:
    """State (profile, recent, surfaced, turns) after the user turns (turn, vector, shown ids), in turn order."""
    profile, recent, surfaced, n = state or ([], [], [], 0)
    turns = sorted(turns, key=lambda t: t[0])
    profile, recent = advance(list(profile), [list(r) for r in recent], (v for _, v, _ in turns))
    seen = dict.fromkeys(surfaced) | dict.fromkeys(int(i) for _, _, shown in turns for i in shown)
    return profile, recent, list(seen), n + len(turns)


class SessionInterest(StatefulProcessor):
    """Keeps one session's interest; gives a snapshot for each batch that has turns of it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.interest = handle.getValueState("interest", "profile array<double>, turns bigint, n_surfaced bigint")
        self.recent = handle.getListState("recent", "vector array<double>")
        self.shown = handle.getMapState("shown", "doc_id bigint", "turn bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timer_values: object) -> Iterator[Row]:
        turns = sorted(rows, key=lambda r: r.turn)
        held = self.interest.get() if self.interest.exists() else None
        profile, n, n_shown = (list(held[0]), held[1], held[2]) if held else ([], 0, 0)
        recent = [list(v[0]) for v in self.recent.get()]
        profile, recent = advance(profile, recent, (r.embedding for r in turns))
        for r in turns:
            for i in r.shown or ():
                if not self.shown.containsKey((i,)):
                    self.shown.updateValue((i,), (r.turn,))
                    n_shown += 1
        self.interest.update((profile, n + len(turns), n_shown))
        self.recent.put([(v,) for v in recent])
        yield Row(session_id=key[0], turns=n + len(turns), profile=profile, n_recent=len(recent), n_surfaced=n_shown)

    def close(self) -> None:
        pass


def session_state(turns: DataFrame) -> DataFrame:
    """Streams (session_id, turn, embedding, shown) into one snapshot row a session and batch.

    Keyed state of several kinds needs the RocksDB store, which is set in the session
    unless another provider was chosen there.
    """
    spark = turns.sparkSession
    workers_import_package(spark)
    if "RocksDB" not in (spark.conf.get(PROVIDER, "") or ""):
        spark.conf.set(PROVIDER, ROCKSDB)
    return turns.groupBy("session_id").transformWithState(SessionInterest(), OUTPUT, "Update", "None")


def event_counts(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Extension: tumbling windows of (ts, event_type, value) with a watermark."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    counted = timed.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return counted.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def event_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Extension: session windows a user, closed by a gap."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    counted = timed.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return counted.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), "n")


def run_to_end(stream: DataFrame, name: str, mode: str, checkpoint: str) -> None:
    """Processes what a source holds now into an in-memory table, for small results that are looked at here."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint)
    running = query.trigger(availableNow=True).start()
    running.awaitTermination()
