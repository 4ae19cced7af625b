"""Borrowers' events as streams."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillon.functions.money import money
from quillon.sources.sinks import shared_folder


def run_to_end(stream: DataFrame, mode: str = "append", folder: str | None = None) -> DataFrame:
    """Runs a stream over what is there and returns all that it wrote. Batches go to a table; in complete mode the last replaces the others. With the `folder` of an earlier run it goes on from there."""
    spark = stream.sparkSession
    folder = folder or shared_folder(spark)
    out = f"{folder}/out"

    def put(batch: DataFrame, number: int) -> None:
        # a batch that is run again replaces its own part
        batch.write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/batch={number}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").foreachBatch(put).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out if mode == "complete" else f"{out}/batch=*")


_NO_DATA = "spark.sql.streaming.noDataMicroBatches.enabled"


def in_parts(events: DataFrame, part: Column, run: Callable[[DataFrame], None]) -> None:
    """Feeds a table to a stream in parts, in order of `part` (a few small integers).

    Each part is added to the stream's folder, as many files as tasks write it, and then `run` is called with the stream; it must go on from its checkpoint, so
    the part is one batch of many tasks. Batches without data wait for the last part: till then each part is judged by the watermark of those before it, as
    if the parts had come one after another in one run.
    """
    spark, folder = events.sparkSession, shared_folder(events.sparkSession)
    numbers = sorted(r[0] for r in events.select(part).distinct().collect()) or [0]  # few by contract
    before = spark.conf.get(_NO_DATA)
    try:
        for k in numbers:
            events.where(part == k).write.parquet(f"{folder}/part={k:04d}")
            spark.conf.set(_NO_DATA, str(k == numbers[-1]).lower())
            run(spark.readStream.schema(events.schema).parquet(f"{folder}/part=*").select(*events.columns))
    finally:
        spark.conf.set(_NO_DATA, before)


def run_in_parts(events: DataFrame, part: Column, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """All that the stream `build` makes of a table writes when it is fed in parts."""
    folder, out = shared_folder(events.sparkSession), []
    in_parts(events, part, lambda stream: out.append(run_to_end(build(stream), folder=folder)))
    return out[-1]


def drained(events: DataFrame, last: Column | str = "TIMESTAMP '2999-01-01 00:00:00'") -> DataFrame:
    """Events with one far later row, whose other columns are null, so that the watermark passes all others; select it away by its null key. Feed it in a part of its own."""
    ts = F.expr(last) if isinstance(last, str) else last
    row = events.sparkSession.range(1).select(*[(ts if c == "ts" else F.lit(None)).cast(t).alias(c) for c, t in events.dtypes])
    return events.unionByName(row)


def dedup_events(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """The first row of each event_id within the watermark."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def activity_windows(events: DataFrame, size: str = "1 day", slide: str | None = None, delay: str = "1 day") -> DataFrame:
    """Events and value per type and window of event time."""
    at = F.window("ts", size, slide) if slide else F.window("ts", size)
    per = events.withWatermark("ts", delay).groupBy(at.alias("w"), "event_type").agg(F.count("*").alias("n"), money(F.round("value", 2)).alias("value"))
    return per.select(F.col("w.start").alias("start"), "event_type", "n", "value")


def activity_sessions(events: DataFrame, gap: str = "6 hours", delay: str = "1 day") -> DataFrame:
    """Sessions per borrower; events no more than the gap apart belong together."""
    per = events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"), F.max("ts").alias("last"))
    return per.select("user_id", F.col("w.start").alias("start"), "last", "n")


def score_stream(events: DataFrame, borrowers: DataFrame) -> DataFrame:
    """Attaches a static table of borrowers' features; events of unknown borrowers stay, without them."""
    return events.join(borrowers, events["user_id"] == borrowers["borrower"], "left").drop("borrower")


def velocity_alerts(events: DataFrame, n: int = 4, span_seconds: int = 6 * 3600, delay: str = "1 day") -> DataFrame:
    """An alert for each event that is at least the n-th of its borrower within the span that ends with it.

    The state of a borrower holds the times of the last span and delay only, and goes once the watermark has passed them. Events are taken in order of time within a
    batch; one that comes later than its followers counts those before it, and is not counted by alerts already sent. A borrower's events of one batch are
    one frame, so read many files with a bound per trigger.
    """
    span = span_seconds * 1_000_000

    def step(key: tuple, batches, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        times = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["us", "event_id"])
        out = []
        for us, event in zip(rows["us"].tolist(), rows["event_id"].tolist()):
            insort(times, us)
            found = bisect_right(times, us) - bisect_left(times, us - span)
            if found >= n:
                out.append((key[0], event, found))
        keep = max(times[-1] - span, 0)
        watermark = state.getCurrentWatermarkMs() * 1000
        times = times[bisect_left(times, min(keep, watermark - span) if watermark > 0 else times[0]) :]
        state.update((times,))
        state.setTimeoutTimestamp(max(times[-1] + span, watermark + 1000) // 1000 + 1)
        yield pd.DataFrame(out, columns=["user_id", "event_id", "n"])

    timed = events.withWatermark("ts", delay).select("user_id", "event_id", "ts", F.unix_micros("ts").alias("us"))
    return timed.groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long, n long", "times array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def counted(held: np.ndarray, n: int, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Of rows (borrower, time, event) in order of borrower, time and event the rows that are at least the n-th of their borrower within the span that ends with them, and which they are."""
    held = held[np.lexsort((held[:, 2], held[:, 1], held[:, 0]))]
    if not len(held):
        return held, np.zeros(0, np.int64)
    who = np.cumsum(np.diff(held[:, 0], prepend=held[0, 0]) != 0)
    at = held[:, 1] - held[:, 1].min() + span
    # borrowers one after another on one axis, so that no span reaches back into another's; as many at once as 62 bits hold
    wide = int(at.max()) + 1
    most = max(1, (1 << 62) // wide)
    begun = np.zeros(len(held), np.int64)
    for k in range(0, int(who[-1]) + 1, most):
        i, j = np.searchsorted(who, [k, k + most])
        line = (who[i:j] - k) * wide + at[i:j]
        begun[i:j] = i + np.searchsorted(line, line - span)
    found = np.arange(1, len(held) + 1) - begun
    return held[found >= n], found[found >= n]


#: groups into which borrowers are dealt, by a hash, for their waiting events
WAITING = 1024


#: a state store that needn't hold what waits in memory
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def ordered_alerts(events: DataFrame, n: int = 4, span_seconds: int = 6 * 3600, delay: str = "1 day", cell_seconds: int | None = None) -> DataFrame:
    """An alert for each event that is at least the n-th of its borrower within the span that ends with it; of equal times the smaller event_id counts first.

    Unlike velocity_alerts it is sent when the watermark has passed the event, so it counts every event that came in time, in whatever order. Events behind the watermark are
    dropped; null borrowers and times have no alerts.

    Events wait in cells of `cell_seconds` (the span) until the watermark has passed the cell. The state is a cell of one of WAITING groups of borrowers, as packed numbers, so a batch
    makes a call for each cell that it touches and not for each borrower. An event also waits, to be counted but not judged, in the later cells that its span reaches: longer cells mean fewer
    copies, shorter ones less memory. What a task holds is one such cell: all events of the cell's time divided by WAITING, or the largest borrower's. With the store ROCKSDB the other cells aren't held in memory.
    """
    span, cell = span_seconds * 1_000_000, max(1, cell_seconds or span_seconds) * 1_000_000
    columns = ["user_id", "us", "event_id"]

    def step(key: tuple, batches, state: GroupState):
        mine = int(key[1])
        end = (mine + 1) * cell // 1000
        held = [np.frombuffer(state.get[0], np.int64).reshape(-1, 3)] if state.exists else []
        if not state.hasTimedOut:
            held += [b[columns].to_numpy(np.int64) for b in batches]
        held = np.concatenate(held)
        # a batch may hold rows of cells that its own watermark has passed, if that of the batch before hadn't
        if state.hasTimedOut or end <= state.getCurrentWatermarkMs():
            if state.exists:
                state.remove()
            rows, found = counted(held, n, span)
            own = rows[:, 1] // cell == mine
            yield pd.DataFrame({"user_id": rows[own, 0], "event_id": rows[own, 2], "n": found[own]})
        else:
            state.update((held.tobytes(),))
            state.setTimeoutTimestamp(end - 1)

    def of(us: Column) -> Column:
        return ((us - F.pmod(us, F.lit(cell))) / F.lit(cell)).cast("long")  # whole numbers below 2 ** 53 divide exactly

    us = F.unix_micros("ts")
    timed = events.where("user_id IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", delay).select("user_id", "event_id", "ts", us.alias("us"), F.pmod(F.xxhash64("user_id"), F.lit(WAITING)).alias("_group"), F.explode(F.sequence(of(us), of(us + F.lit(span)))).alias("_cell"))
    return timed.groupBy("_group", "_cell").applyInPandasWithState(step, "user_id long, event_id long, n long", "held binary", "append", GroupStateTimeout.EventTimeTimeout)


def late_rows(events: DataFrame, landed: DataFrame) -> DataFrame:
    """Rows of the input that no window holds: one row, late. `landed` is the output of activity_windows over the same input."""
    return events.agg(F.count("*").alias("a")).crossJoin(landed.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("b"))).select((F.col("a") - F.col("b")).alias("late"))  # one row each


#: parts of a score table by the key's hash
BUCKETS = 16


def upsert_scores(stream: DataFrame, path: str, key: str = "borrower", time: str = "ts", state: str | None = None, buckets: int = BUCKETS) -> None:
    """Keeps the latest score of each borrower under `path`; of equal times the greatest row. A null borrower is a borrower.

    Borrowers are dealt to buckets. A batch merges the buckets that it touches with their live versions, writes them as its own version, and then a manifest that names every bucket's live
    version. What a batch reads is the live version of the buckets it touches, however many batches there were. A batch that is run again starts from the
    manifest before its own and gives the same result; versions that neither the last manifest nor the one before it names are deleted.
    """

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        mine = batch.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        touched = [r[0] for r in mine.select("bucket").distinct().collect()]  # at most `buckets`
        if not touched:
            return
        before = max((n for n in _numbers(spark, f"{path}/manifest", "n") if n < number), default=None)
        live = {} if before is None else _manifest(spark, path, before)
        old = _at(path, {b: v for b, v in live.items() if b in touched})
        rows = mine.unionByName(spark.read.schema(batch.schema).parquet(*old).withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))) if old else mine
        best = rows.groupBy("bucket", key).agg(F.max(F.struct(time, *[c for c in batch.columns if c not in (key, time)])).alias("s")).select(key, "s.*", "bucket").select(*batch.columns, "bucket")
        best.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/v={number}")
        now = live | dict.fromkeys(touched, number)
        spark.createDataFrame(list(now.items()), "bucket int, v int").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/n={number}")
        _clear(spark, path, before, {*now.items(), *live.items()})

    stream.writeStream.option("checkpointLocation", state or f"{shared_folder(stream.sparkSession)}/state").foreachBatch(put).trigger(availableNow=True).start().awaitTermination()


def _numbers(spark: SparkSession, path: str, name: str) -> list[int]:
    """The numbers k of the folders `name`=k under a path."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
    return [int(f.split("=")[1]) for f in found if f.startswith(f"{name}=")]


def _manifest(spark: SparkSession, path: str, number: int) -> dict[int, int]:
    """Each bucket's live version; a row per bucket."""
    return {r["bucket"]: r["v"] for r in spark.read.schema("bucket int, v int").parquet(f"{path}/manifest/n={number}").collect()}


def _at(path: str, live: dict[int, int]) -> list[str]:
    return [f"{path}/v={v}/bucket={b}" for b, v in sorted(live.items())]


def _clear(spark: SparkSession, path: str, before: int | None, keep: set[tuple[int, int]]) -> None:
    """Deletes manifests older than `before`, and the versions which they name and `keep` doesn't."""
    conf, path_of = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
    fs = path_of(path).getFileSystem(conf)
    for n in _numbers(spark, f"{path}/manifest", "n") if before is not None else []:
        if n < before:
            for b, v in _manifest(spark, path, n).items():
                if (b, v) not in keep:
                    fs.delete(path_of(f"{path}/v={v}/bucket={b}"), True)
                if v not in {v for _, v in keep}:
                    fs.delete(path_of(f"{path}/v={v}"), True)
            fs.delete(path_of(f"{path}/manifest/n={n}"), True)


def latest_scores(spark: SparkSession, path: str) -> DataFrame:
    """The live scores. Raises where nothing was ever written."""
    numbers = _numbers(spark, f"{path}/manifest", "n")
    if not numbers:
        raise ValueError(f"no scores under {path}")
    return spark.read.parquet(*_at(path, _manifest(spark, path, max(numbers))))
