"""Streams that remember ids and runs in a keyed state store instead of reading back what they have written.

The state lives in RocksDB under the checkpoint, so a micro-batch costs what its own
ids cost, however long the history is, and a restarted stream goes on where it stopped.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
KNOWN = "tasador_known"  # names with a leading underscore do not reach a processor
HASH = "tasador_hash"
RUN_ROWS = "run string, page long, pos int, items int, id long, seen boolean, ref long"


@contextmanager
def rocks_store(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def append_available(rows: DataFrame, sink: str, checkpoint: str, timed: bool = False) -> None:
    """Append what is available to ``sink``, exactly once, then stop.

    Streams with timers go on for ever under ``availableNow``, as time always goes on; a
    ``timed`` one takes all that is available in one micro-batch, in which timers that are due fire.
    """
    with rocks_store(rows.sparkSession):
        query = (
            rows.writeStream.format("parquet")
            .option("path", sink)
            .option("checkpointLocation", checkpoint)
            .outputMode("append")
            .trigger(**({"once": True} if timed else {"availableNow": True}))
            .start()
        )
        query.awaitTermination()


# -------------------------------------------------------------------- known ids


class FirstOnly(StatefulProcessor):
    """The first row of an id that has not been met; with ``flag_only`` all rows, ``seen`` if the id is known."""

    def __init__(self, order: str | None, columns: list[str], forget_ms: int | None, flag_only: bool = False):
        self.order, self.columns, self.forget_ms, self.flag_only = order, columns, forget_ms, flag_only

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.met = handle.getValueState("met", "yes boolean", ttlDurationMs=self.forget_ms)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self.met.update((True,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        met, first = self.met.exists(), None
        for batch in rows:
            # ids that are recorded in this very batch count before it
            met = met or bool(batch[KNOWN].any())
            batch = batch[~batch[KNOWN]]
            if self.flag_only and len(batch):
                first = batch if first is None else pd.concat((first, batch))
            elif len(batch):
                # one row is kept, however many copies of an id there are
                least = batch.sort_values([self.order, HASH], kind="stable").head(1)
                first = least if first is None else pd.concat((first, least)).sort_values([self.order, HASH]).head(1)
        if self.flag_only:
            if first is not None:
                yield first.assign(seen=met)[self.columns]
            return
        if not met and first is not None:
            yield first[self.columns]
        if not self.met.exists():
            self.met.update((True,))

    def close(self) -> None:
        pass


def _with_known(stream: DataFrame, known: DataFrame | None, key: str) -> tuple[DataFrame, object]:
    """Rows with the mark ``tasador_known``; a static table of known ids becomes the initial state, a stream joins in."""
    rows = stream.where(F.col(key).isNotNull()).withColumn(HASH, F.xxhash64(*stream.columns)).withColumn(KNOWN, F.lit(False))
    if known is None:
        return rows, None
    ids = known.select(F.col(key).cast(stream.schema[key].dataType).alias(key)).where(F.col(key).isNotNull())
    if known.isStreaming:
        return rows.unionByName(ids.withColumn(KNOWN, F.lit(True)), allowMissingColumns=True), None
    return rows, ids.distinct().groupBy(key)


def unseen_stream(
    stream: DataFrame,
    known: DataFrame | None,
    sink: str,
    checkpoint: str,
    order: str,
    key: str = "id",
    forget_ms: int | None = None,
) -> None:
    """Append the first row (by ``order``) of each id that is neither known nor met before, however late it comes.

    ``known``: a table, taken over once when the checkpoint is new, or a stream of ids that
    are recorded elsewhere, which is followed. Without it the stream becomes unique by
    id. ``forget_ms``: an id that has been met so long ago counts as new again. Rows
    without an id are left out. The rows of one id are read by one task, one Arrow batch at a
    time, however many copies there are.
    """
    rows, initial = _with_known(stream, known, key)
    columns = stream.columns
    found = rows.groupBy(key).transformWithStateInPandas(
        FirstOnly(order, columns, forget_ms), stream.schema, "append", "ProcessingTime" if forget_ms else "None", initial
    )
    append_available(found, sink, checkpoint, timed=forget_ms is not None)


# ------------------------------------------------------------------ seen streak


class RunCut(StatefulProcessor):
    """New ids of a run up to ``n`` known ones in a row; pages may come in any order.

    Pages are read in order. One that comes early waits in the state; the state keeps the
    next page, the streak and the ids already returned. A run whose missing page does not
    come for ``close_ms`` is read to its end without it.
    """

    def __init__(self, n: int, close_ms: int | None):
        self.n, self.close_ms = n, close_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", "page long, streak int, done boolean, timer long")
        self.waiting = handle.getMapState("waiting", "page long", "items int, rows string")
        self.met = handle.getMapState("met", "id long", "yes boolean")

    def _read(self, rows: list, page: int, streak: int) -> tuple[list, int, bool]:
        """New ids of one page, the streak after it, and whether the run ends there."""
        found = []
        for pos, id_, seen, ref in sorted(rows):
            if id_ is None:
                continue
            streak = streak + 1 if seen else 0
            if streak >= self.n:
                return found, streak, True
            if not seen and not self.met.containsKey((id_,)):
                self.met.updateValue((id_,), (True,))
                found.append((page, pos, id_, ref))
        return found, streak, False

    def _told(self, run: str, found: list) -> pd.DataFrame:
        return pd.DataFrame([(run, *f) for f in found], columns=["run", "page", "pos", "id", "ref"])

    def _ended(self, page: int, streak: int) -> None:
        self.place.update((page, streak, True, 0))
        self.waiting.clear()
        self.met.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        page, streak, done, timer = self.place.get() if self.place.exists() else (1, 0, False, 0)
        arrived: dict[int, tuple[int, dict]] = {}
        for batch in rows:
            if done:
                continue
            for r in batch.itertuples(index=False):
                if r.page >= page:
                    own = arrived.setdefault(int(r.page), (int(r.items), {}))[1]
                    own[int(r.pos)] = [int(r.pos), None if pd.isna(r.id) else int(r.id), bool(r.seen), int(r.ref)]
        if done or not arrived:
            return
        for number, (items, own) in arrived.items():
            held = self.waiting.getValue((number,)) if self.waiting.containsKey((number,)) else None
            if held:
                own.update({x[0]: x for x in json.loads(held[1]) if x[0] not in own})
            self.waiting.updateValue((number,), (items, json.dumps(list(own.values()))))
        while self.waiting.containsKey((page,)):
            items, held = self.waiting.getValue((page,))
            if len(held := json.loads(held)) < items:
                break
            found, streak, done = self._read(held, page, streak)
            if found:
                yield self._told(key[0], found)
            self.waiting.removeKey((page,))
            page += 1
            if done:
                self._ended(page, streak)
                return
        if timer:
            self.handle.deleteTimer(timer)
            timer = 0
        if self.close_ms is not None and self.waiting.exists():
            timer = timerValues.getCurrentProcessingTimeInMs() + self.close_ms
            self.handle.registerTimer(timer)
        self.place.update((page, streak, False, timer))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.place.exists():
            return
        page, streak, done, timer = self.place.get()
        if done or timer != expiredTimerInfo.getExpiryTimeInMs():
            return
        for number in sorted(k[0] for k in self.waiting.keys()):
            found, streak, done = self._read(json.loads(self.waiting.getValue((number,))[1]), number, streak)
            if found:
                yield self._told(key[0], found)
            if done:
                break
        self._ended(page, streak)

    def close(self) -> None:
        pass


def known_flags_stream(stream: DataFrame, known: DataFrame | None, sink: str, checkpoint: str) -> None:
    """Append every sighting (run, page, pos, items, id, ref) with ``seen``: whether its id is known.

    Known ids are looked up in the keyed state, so a micro-batch reads no table of ids.
    """
    rows, initial = _with_known(stream, known, "id")
    columns = [f.split()[0] for f in RUN_ROWS.split(", ")]
    found = rows.groupBy("id").transformWithStateInPandas(FirstOnly(None, columns, None, True), RUN_ROWS, "append", "None", initial)
    # places without an id are places, too: a page is complete with them
    empty = stream.where(F.col("id").isNull()).withColumn("seen", F.lit(False)).select(columns)
    append_available(found.unionByName(empty), sink, checkpoint)


def streak_stream(flagged: DataFrame, sink: str, checkpoint: str, n: int = 5, close_ms: int | None = None) -> None:
    """Append the new ids (run, page, pos, id, ref) that each run meets before ``n`` known ones in a row.

    ``flagged`` has RUN_ROWS: page from 1, position on the page, and how many items the page
    has; ``ref`` is handed through. The same ids come out for every order in which pages
    and their rows arrive. A run is a sequence, so it is read by one task; what
    waits is in the state store.
    """
    found = flagged.groupBy("run").transformWithStateInPandas(
        RunCut(n, close_ms), "run string, page long, pos int, id long, ref long", "append", "None" if close_ms is None else "ProcessingTime"
    )
    append_available(found, sink, checkpoint, timed=close_ms is not None)
