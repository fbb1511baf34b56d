"""Incremental jobs on Structured Streaming.

Each job reads what is available, keeps its progress in a checkpoint, and leaves a table.  State is bounded by
watermarks or by one row per key; sinks are idempotent per batch, so a restarted job repeats nothing.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def folder(spark: SparkSession) -> str:
    """A new folder that all executors reach, below spark.checkpoint.dir; a session on this machine alone may have a temporary one."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="loamdex-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"


def source(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A folder of Parquet files (or one file) as a stream; new files are new rows."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    single = path.endswith(".parquet")
    # a pattern may name a single file
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(path[:-1] + f"[{path[-1]}]" if single else path)


def run_available(stream: DataFrame, place: str, mode: str = "append", sink: Callable[[DataFrame, int], None] | None = None) -> DataFrame:
    """Process all that is there and stop; run again with the same place, only what is new is processed."""
    spark = stream.sparkSession
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{place}/progress").trigger(availableNow=True)
    if sink:
        query = writer.foreachBatch(sink).start()
    else:
        query = writer.format("parquet").option("path", f"{place}/rows").start()
    query.awaitTermination()
    return spark.read.parquet(f"{place}/rows")


def without_repeats(stream: DataFrame, keys: list[str], ts: str, within: str = "5 seconds") -> DataFrame:
    """Rows whose key came before within the time are dropped; older state is forgotten."""
    return stream.withWatermark(ts, within).dropDuplicatesWithinWatermark(keys)


def latest_batch(place: str) -> Callable[[DataFrame, int], None]:
    """A sink that keeps the whole result of the last batch."""

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{place}/rows")

    return write


PARTS = 32


def merged(place: str, keys: list[str], newest: str) -> Callable[[DataFrame, int], None]:
    """A sink that keeps the newest row of each key: a batch rewrites the parts (by a hash of the key) that it has rows for, and no others.

    What a part held before the batch is read from its newest folder of an earlier one, so a repeated batch writes the same again.  The table is
    ``current(spark, place)``.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        part = F.pmod(F.xxhash64(*keys), F.lit(PARTS)).cast("int")
        rows = batch.withColumn("part", part)
        touched = [r.part for r in rows.select("part").distinct().collect()]  # PARTS at most
        old = {p: f for p, (n, f) in _versions(spark, place, before=number).items() if p in touched}
        if old:
            rows = rows.unionByName(spark.read.schema(rows.schema).parquet(*old.values()))
        best = rows.groupBy("part", *keys).agg(F.max_by(F.struct(*batch.columns), newest).alias("r")).select("r.*", F.col("part").alias("own"), "part")
        best.drop("own").repartition("part").withColumn("folder", F.col("part")).write.mode("overwrite").partitionBy("folder").parquet(f"{place}/rows/batch={number:08d}")

    return write


def _versions(spark: SparkSession, place: str, before: int | None = None) -> dict[int, tuple[int, str]]:
    """The newest folder of each part of a merged table."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{place}/rows")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    out: dict[int, tuple[int, str]] = {}
    for batch in files.listStatus(path) if files.exists(path) else []:
        number = int(batch.getPath().getName().partition("=")[2])
        if before is None or number < before:
            for one in files.listStatus(batch.getPath()):
                name = one.getPath().getName()
                if name.startswith("folder="):
                    part = int(name.partition("=")[2])
                    out[part] = max(out.get(part, (-1, "")), (number, f"{place}/rows/{batch.getPath().getName()}/{name}"))
    return out


def current(spark: SparkSession, place: str, schema: str) -> DataFrame:
    """The table that ``merged`` keeps."""
    folders = [f for _, f in _versions(spark, place).values()]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def run_merged(stream: DataFrame, place: str, keys: list[str], newest: str, mode: str = "append") -> DataFrame:
    """Merge all that is there into the table of ``place``."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{place}/progress").trigger(availableNow=True)
    writer.foreachBatch(merged(place, keys, newest)).start().awaitTermination()
    return current(stream.sparkSession, place, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stream.schema))


def sessions(stream: DataFrame, key: str, ts: str, gap: str) -> DataFrame:
    """Session windows by key."""
    return stream.withWatermark(ts, gap).groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


PROGRESS = "user_id long, done long, skipped long, last_id long, attempts int, state string"
#: Fixed value: starts at one page after which it is given up.
MOST_ATTEMPTS = 3


def progress(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """T4: how far each document is, from its steps in order (event_id): a page done, a start that failed, a pause, a page given up.

    A done page clears the starts; a pause does, too, as it is no fault of the page; a page at which MOST_ATTEMPTS starts failed is skipped.
    """
    done, skipped, last, attempts, now = state.get if state.exists else (0, 0, -1, 0, "WAITING")
    steps = pd.concat(list(batches)).sort_values("event_id")
    for number, step in zip(steps["event_id"], steps["step"], strict=True):
        last = max(last, int(number))
        if step == "done":
            done, attempts, now = done + 1, 0, "READING"
        elif step == "pause":
            attempts, now = 0, "WAITING"
        else:
            attempts, now = attempts + 1, "READING"
            if attempts == MOST_ATTEMPTS:
                skipped, attempts = skipped + 1, 0
    state.update((int(done), int(skipped), int(last), int(attempts), now))
    yield pd.DataFrame({"user_id": [key[0]], "done": [done], "skipped": [skipped], "last_id": [last], "attempts": [attempts], "state": [now]})


def resumable_progress(stream: DataFrame) -> DataFrame:
    """T4 over rows (user_id, event_id, step)."""
    return stream.groupBy("user_id").applyInPandasWithState(progress, PROGRESS, "done long, skipped long, last long, attempts int, state string", "update", GroupStateTimeout.NoTimeout)


def suppressed(stream: DataFrame, key: str, seconds: str, within: float) -> DataFrame:
    """Of rows (key, event_id, seconds) those that come at least ``within`` seconds after the last one let through of their key.

    A key's state is one number.  Rows of a batch are taken in order of time.
    """

    def run(own: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows, keep = pd.concat(list(batches)).sort_values([seconds, "event_id"]), []
        for at in rows[seconds]:
            keep.append(last is None or at - last >= within)
            last = float(at) if keep[-1] else last
        state.update((last,))
        yield rows[keep][[key, "event_id", seconds]]

    kind = stream.schema[key].dataType.simpleString()
    return stream.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, event_id long, {seconds} double", "last double", "append", GroupStateTimeout.NoTimeout)


def in_order(stream: DataFrame, key: str, page: str) -> DataFrame:
    """T5: (key, page, turn): a page goes on when all before it (from 1) have; turn counts a key's pages as they go on.

    State: the next page, and those that wait for it.
    """

    def run(own: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        turn, waiting = (state.get[0], set(json.loads(state.get[1]))) if state.exists else (1, set())
        waiting |= {int(p) for b in batches for p in b[page] if p >= turn}
        out = []
        while turn in waiting:
            waiting.remove(turn)
            out.append(turn)
            turn += 1
        state.update((turn, json.dumps(sorted(waiting))))
        yield pd.DataFrame({key: [own[0]] * len(out), page: out, "turn": out})

    return stream.groupBy(key).applyInPandasWithState(run, f"{key} long, {page} long, turn long", "turn long, waiting string", "append", GroupStateTimeout.NoTimeout)


def claimed(stream: DataFrame, key: str) -> DataFrame:
    """Of rows (key, event_id, step: start or end) the starts that may go on: those of a key that nothing is reading already.  State: one flag a key."""

    def run(own: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        busy, out = state.get[0] if state.exists else False, []
        rows = pd.concat(list(batches)).sort_values("event_id")
        for number, step in zip(rows["event_id"], rows["step"], strict=True):
            if step == "start" and not busy:
                out.append(int(number))
            busy = step == "start"
        state.update((busy,))
        yield pd.DataFrame({key: [own[0]] * len(out), "event_id": out})

    return stream.groupBy(key).applyInPandasWithState(run, f"{key} long, event_id long", "busy boolean", "append", GroupStateTimeout.NoTimeout)


def settled(stream: DataFrame, key: str, ts: str, value: str, quiet: str = "250 milliseconds") -> DataFrame:
    """What was typed last before each pause of ``quiet``: what is typed within it cancels what was typed before."""
    typed = stream.withWatermark(ts, quiet).groupBy(key, F.session_window(ts, quiet).alias("w"))
    return typed.agg(F.max(F.struct(ts, value)).alias("last")).select(key, F.col(f"last.{ts}").alias(ts), F.col(f"last.{value}").alias(value))


def refreshed(place: str, query: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A sink that adds each batch to a table and runs a query over the table again; its results stand by version."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{place}/table/batch={number}")
        result = query(spark.read.parquet(*[f"{place}/table/batch={n}" for n in range(number + 1)]))
        result.withColumn("version", F.lit(number)).write.mode("overwrite").parquet(f"{place}/rows/v={number}")

    return write
