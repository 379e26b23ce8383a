"""Structured Streaming forms: bounded runs (``availableNow``) over file sources, sinks in the shared folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tideline.operators.lists import IN_KIND, LATE_HOURS, NEXT_KIND, OUT_KINDS, SOON_DAYS, SOON_HOURS, claim_due, disappearances, settle
from tideline.storage import materialise, new_path


def read_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table as a stream of files; a table is one file or a folder of files."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder = jpath.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(jpath).isDirectory()
    reader = spark.readStream.schema(schema)
    return reader.parquet(path) if folder else reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def run_to_table(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run until the source is drained and return what the sink holds."""
    spark, path = stream.sparkSession, new_path(stream.sparkSession, f"stream-{name}")
    q = stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", new_path(spark, f"ckpt-{name}")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def snapshot_changes(stream: DataFrame, key: str, content: str, seq: str) -> DataFrame:
    """Content changes of each key by its last hash in state. Rows of a micro-batch are taken in the order of ``seq``."""
    kind = stream.schema[key].dataType.simpleString()

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(seq)
        prev = pd.Series([state.get[0] if state.exists else None, *rows[content].iloc[:-1]], index=rows.index)
        changed = rows[rows[content].ne(prev) | prev.isna()]
        state.update((rows[content].iloc[-1],))
        yield pd.DataFrame({key: changed[key], seq: changed[seq], content: changed[content]})

    return stream.select(key, seq, content).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, {seq} bigint, {content} string", "last string", "append", GroupStateTimeout.NoTimeout)


def unique_snapshots(stream: DataFrame, key: str, content: str, ts: str, delay: str = "60 days") -> DataFrame:
    """The first arrival of each content within the watermark; state older than ``delay`` is dropped."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay).dropDuplicatesWithinWatermark([key, content]).select(key, content)


def weekly_coverage(stream: DataFrame, ts: str, width: str, delay: str) -> DataFrame:
    """Closed windows only: a window is emitted once the watermark (newest event less ``delay``) passes its end."""
    w = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay).groupBy(F.window(ts, width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("w.start").alias("week"), "event_type", "n")


def _exists(spark: SparkSession, path: str) -> bool:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)


def claim_stream(due: DataFrame, claims: str, keys: list[str], checkpoint: str):
    """Writes each (subscriber, deadline, window) once: every micro-batch is anti-joined with the claims table."""

    def claim(batch: DataFrame, _: int) -> None:
        fresh = batch.select(*keys).distinct()
        if _exists(batch.sparkSession, claims):
            fresh = fresh.join(batch.sparkSession.read.parquet(claims), keys, "left_anti")
        fresh.write.mode("append").parquet(claims)

    return due.writeStream.foreachBatch(claim).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def disappearance_stream(snapshots: DataFrame, store: str, lists: list[str], snap: str, player: str, checkpoint: str):
    """Players that a list's snapshot has and its next one lacks, as movements of kind removed_unknown, in ``store``/ledger.

    ``snapshots`` (lists, snap, player) come in the order of snap within a list, whole ones in a micro-batch. Each batch is compared with
    the last snapshot of every list that the batches before left in ``store``/last; both folders are written by the number of the batch,
    so a batch that runs again puts the same rows in the same place. A fingerprint that an earlier batch wrote is not written again.
    """
    keep = [*lists, snap, player]

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.select(*keep).distinct()
        was = f"{store}/last/batch={number - 1}"
        if number and _exists(spark, was):
            rows = rows.unionByName(spark.read.schema(rows.schema).parquet(was)).distinct()
        rows = materialise(rows, "snapshots")
        gone = disappearances(rows, lists, snap, player)
        if number and _exists(spark, f"{store}/ledger"):
            gone = gone.join(spark.read.parquet(f"{store}/ledger").where(F.col("batch") < number).select("fingerprint"), "fingerprint", "left_anti")
        gone.write.mode("overwrite").parquet(f"{store}/ledger/batch={number}")
        last = rows.groupBy(*lists).agg(F.max(snap).alias(snap))
        rows.join(last, [*lists, snap], "left_semi").write.mode("overwrite").parquet(f"{store}/last/batch={number}")

    return snapshots.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def send_stream(due: DataFrame, log: str, keys: list[str], receiver: str, outcomes: Callable[[DataFrame, int], DataFrame], checkpoint: str):
    """Reminders in two phases: each micro-batch claims what is due (``lists.claim_due``), sends, and writes what came of it.

    ``outcomes(claims, number)`` does the sending and returns ``receiver, ok``: a receiver that failed gives all of its claims of this batch
    back, and a later batch may claim them again. ``log`` has keys, run and state (claimed, sent, released), written by batch: first the
    claims, so that a run that dies between the phases sends nothing twice, then the results.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        seen = [spark.read.parquet(f"{log}/{phase}").where(F.col("run") < number).drop("run") for phase in ("claims", "results") if _exists(spark, f"{log}/{phase}")]
        empty = batch.select(*keys, F.lit("").alias("state"), F.lit(0).cast("long").alias("at")).where("false")
        claims = claim_due(batch.select(*keys), reduce(DataFrame.unionByName, seen, empty), keys)
        path = f"{log}/claims/run={number}"
        if not _exists(spark, path):  # a batch that runs again keeps its claims
            claims.select(*keys, F.lit("claimed").alias("state"), F.lit(2 * number).cast("long").alias("at")).write.parquet(path)
        held = spark.read.parquet(path)
        settle(held, outcomes(held, number), keys, receiver, 2 * number + 1).write.mode("overwrite").parquet(f"{log}/results/run={number}")

    return due.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def with_rocksdb(spark: SparkSession) -> None:
    """State in the store that keyed state and timers need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


LIST_STATE = "list long, what string, player long, state string, queue long, seq long, version long"


class ListStanding(StatefulProcessor):
    """State of one list: its entries with what was shown last, the last movement of each player and the last report.

    Input rows have list, player, ts and either status and position (an entry of the snapshot) or kind and seq (a movement). Movements are
    kept by (ts, seq), so the order of arrival does not matter. Each batch gives the entries whose state or number changed, with
    a version, and the report if it changed; a movement of an unknown player waits for the watermark to pass its time and is
    then given as unmatched, unless the entry came meanwhile.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entries = handle.getMapState("entries", "player bigint", "status string, position bigint, state string, queue bigint")
        self.last = handle.getMapState("last", "player bigint", "ts bigint, seq bigint, kind string")
        self.next = handle.getValueState("next", "ts bigint, seq bigint, player bigint")
        self.unknown = handle.getMapState("unknown", "seq bigint", "ts bigint, player bigint, kind string")
        self.version = handle.getValueState("version", "n bigint")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        df = pd.concat(list(rows))
        n = self.version.get()[0] + 1 if self.version.exists() else 0
        self.version.update((n,))
        snap, moves = df[df["status"].notna()], df[df["kind"].notna()]
        for r in snap.itertuples():
            if not self.entries.containsKey((r.player,)):
                self.entries.updateValue((r.player,), (r.status, int(r.position), None, None))
        out = []
        micros = moves["ts"].astype("datetime64[us]").astype("int64") if len(moves) else []
        for r, ts in zip(moves.itertuples(), micros, strict=True):
            at = (int(ts), int(r.seq))
            if not self.entries.containsKey((r.player,)):
                self.unknown.updateValue((at[1],), (at[0], int(r.player), r.kind))
                self.handle.registerTimer(at[0] // 1000 + 1)
            if r.kind == NEXT_KIND:
                if not self.next.exists() or tuple(self.next.get())[:2] < at:
                    self.next.update((*at, int(r.player)))
                    out.append(("next", r.player, None, None, at[1]))
            elif not self.last.containsKey((r.player,)) or tuple(self.last.getValue((r.player,)))[:2] < at:
                self.last.updateValue((r.player,), (*at, r.kind))
        out += self._changes()
        yield self._frame(key, out, n)

    def _changes(self) -> list[tuple]:
        """The entries whose standing is not the one shown last."""
        last = {k[0]: v[2] for k, v in self.last.iterator()}
        queue, out = 0, []
        for (player,), (status, position, state, number) in sorted(self.entries.iterator(), key=lambda x: (x[1][1], x[0][0])):
            kind = last.get(player)
            now = "withdrawn" if kind in OUT_KINDS else "accepted" if status == "accepted" or kind == IN_KIND else "alternate"
            queue += now == "alternate"
            place = queue if now == "alternate" else None
            if (now, place) != (state, number):
                self.entries.updateValue((player,), (status, position, now, place))
                out.append(("entry", player, now, place, None))
        return out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        due, out = expiredTimerInfo.getExpiryTimeInMs(), []
        for (seq,), (ts, player, kind) in list(self.unknown.iterator()):
            if ts // 1000 < due:
                self.unknown.removeKey((seq,))
                if not self.entries.containsKey((player,)):
                    out.append(("unmatched", player, kind, None, seq))
        yield self._frame(key, out, self.version.get()[0])

    @staticmethod
    def _frame(key: tuple, rows: list[tuple], version: int) -> pd.DataFrame:
        df = pd.DataFrame(rows, columns=["what", "player", "state", "queue", "seq"])
        df = df.astype({"player": "int64", "queue": "Int64", "seq": "Int64"})
        df.insert(0, "list", key[0])
        df["version"] = version
        return df

    def close(self) -> None:
        pass


def list_states(rows: DataFrame, ts: str = "ts", delay: str = "0 seconds") -> DataFrame:
    """The stream of changes of every list (see ``ListStanding``); rows that are older than the watermark when they come are dropped."""
    with_rocksdb(rows.sparkSession)
    timed = rows.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    return timed.groupBy("list").transformWithStateInPandas(statefulProcessor=ListStanding(), outputStructType=LIST_STATE, outputMode="Append", timeMode="EventTime")


def latest_standing(changes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The standing of each entry, the report of each list, and the unmatched movements, from the changes that the stream gave."""
    last = lambda what, keys: changes.where(F.col("what") == what).groupBy(*keys).agg(F.max(F.struct("version", "player", "state", "queue")).alias("x"))
    entries = last("entry", ["list", "player"]).select("list", "player", "x.state", "x.queue")
    return entries, last("next", ["list"]).select("list", "x.player"), changes.where("what = 'unmatched'").select("list", "seq", F.col("state").alias("kind"))


class NextCheck(StatefulProcessor):
    """State of one source: when it is to be checked again and how often checks failed in a row. A check (ts, failed, start_date) sets
    both; a row (src, due, failures) goes out when event time reaches the next check and no check has come before."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.next = handle.getValueState("next", "due bigint, failures bigint")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        df = pd.concat(list(rows)).sort_values("ts", kind="stable")
        due, failures = tuple(self.next.get()) if self.next.exists() else (TOLD, 0)
        if due != TOLD:
            self.handle.deleteTimer(due // 1000 + 1)
        out = []
        for ts, failed, start in zip(df["ts"].astype("datetime64[us]").astype("int64"), df["failed"], pd.to_datetime(df["start_date"]).astype("datetime64[us]").astype("int64"), strict=True):
            if due != TOLD and due < ts:
                out.append((key[0], due, failures))
            days = -(-(int(start) + NOON - int(ts)) // DAY)
            due = int(ts) + (SOON_HOURS if days <= SOON_DAYS else LATE_HOURS) * HOUR
            failures = failures + 1 if failed else 0
        self.next.update((due, failures))
        self.handle.registerTimer(due // 1000 + 1)
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        due, failures = tuple(self.next.get())
        self.next.update((TOLD, failures))
        yield self._frame([(key[0], due, failures)])

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["src", "due", "failures"]).astype("int64")

    def close(self) -> None:
        pass


#: Stands for a check that was given already.
TOLD = -1
HOUR, DAY, NOON = 3_600_000_000, 86_400_000_000, 43_200_000_000


def due_checks(checks: DataFrame, ts: str = "ts", delay: str = "0 seconds") -> DataFrame:
    """``src, due, failures``: checks that fall due with no other check before (due in microseconds). ``checks`` has src, ts, failed, start_date."""
    with_rocksdb(checks.sparkSession)
    timed = checks.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    return timed.groupBy("src").transformWithStateInPandas(statefulProcessor=NextCheck(), outputStructType="src long, due long, failures long", outputMode="Append", timeMode="EventTime")


def movement_ledger(moves: DataFrame, keys: list[str], ts: str, delay: str = "60 days") -> DataFrame:
    """Movements once by fingerprint; late ones within the watermark keep their event time."""
    fp = F.sha2(F.concat_ws("|", *(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys)), 256)
    return moves.withColumn(ts, F.col(ts).cast("timestamp")).withColumn("fingerprint", fp).withWatermark(ts, delay).dropDuplicatesWithinWatermark(["fingerprint"])
