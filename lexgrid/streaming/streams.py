"""Streams: request throttles, a sliding limiter, event frames of a connection, an append-only audit."""

from __future__ import annotations

import functools
import json
import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder, or one of our own where none is named and everything runs on one machine."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(named or "/tmp/checkpoints")
    return context.getCheckpointDir()


def read_table(spark: SparkSession, sf_dir: str, name: str, files_per_trigger: int = 100) -> DataFrame:
    """A table as a stream of its files; the pattern names a single file as well as a folder, which a plain path does not."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{sf_dir}/{name}.parque[t]")


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what is there and give its output as a table in the shared folder.

    Complete results replace each other in numbered folders, appended ones go to a file sink; both are
    exactly-once under restarts, by the batch number or by the sink's log.
    """
    spark = stream.sparkSession
    root = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.option("checkpointLocation", f"{root}/state").trigger(availableNow=True).outputMode(mode)
    if mode == "append":
        query = writer.format("parquet").option("path", f"{root}/out").start()
    else:
        last: list[int] = []

        def save(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{root}/batch-{number}")
            last.append(number)

        query = writer.foreachBatch(save).start()
    query.awaitTermination()
    return spark.read.parquet(f"{root}/out" if mode == "append" else f"{root}/batch-{last[-1]}")


def throttle(requests: DataFrame, client: str, ts: str, limit: int, every: str, late: str = "1 day") -> DataFrame:
    """Requests of a client in tumbling windows, and how many of them a limit refuses; late ones count until the watermark."""
    counted = requests.withColumn("_at", F.col(ts).cast("timestamp")).withWatermark("_at", late).groupBy(client, F.window("_at", every).alias("w")).agg(F.count("*").alias("n"))
    return counted.select(client, F.col("w.start").alias("start"), "n", F.greatest(F.col("n") - limit, F.lit(0)).alias("refused"))


def throttles(requests: DataFrame, client: str, ts: str, limits: dict[str, int], late: str = "1 day") -> DataFrame:
    """``throttle`` under several limits at once, such as so many a minute and so many a day; ``every`` names the limit.

    For append mode: a window comes out when the watermark has passed it, and its state goes.
    """
    each = [throttle(requests, client, ts, limit, every, late).withColumn("every", F.lit(every)) for every, limit in limits.items()]
    return functools.reduce(DataFrame.unionByName, each)


def _timeout(idle: int | None) -> str:
    """Streams over what is there must not wait for the clock, which would give them empty batches without end."""
    return GroupStateTimeout.NoTimeout if idle is None else GroupStateTimeout.ProcessingTimeTimeout


def sliding_limiter(requests: DataFrame, client: str, at: str, limit: int, seconds: float, idle: int | None = None) -> DataFrame:
    """Per request (client, at in seconds, event_id): allowed, and how many allowed ones the last ``seconds`` hold.

    The state of a client is the times of its allowed requests that are not yet ``seconds`` old; with
    ``idle``, for streams that run on, it goes when the client has sent nothing for so many milliseconds of the
    cluster's clock, which must not be less than ``seconds``.
    """
    if idle is not None and idle < 1000 * seconds:
        raise ValueError("states must outlive the limiter's seconds")
    schema = f"{client} long, event_id long, allowed boolean, held int"

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = list(state.get[0]) if state.exists else []
        out = []
        rows = pd.concat(list(batches)).sort_values([at, "event_id"])
        for now, event in zip(rows[at], rows["event_id"], strict=True):
            held = [t for t in held if now - t < seconds]
            allowed = len(held) < limit
            if allowed:
                held.append(float(now))
            out.append((key[0], event, allowed, len(held)))
        state.update((held,))
        if idle is not None:
            state.setTimeoutDuration(idle)
        yield pd.DataFrame(out, columns=[client, "event_id", "allowed", "held"])

    return requests.select(client, "event_id", at).groupBy(client).applyInPandasWithState(step, schema, "held array<double>", "append", _timeout(idle))


_END = re.compile(r"\r?\n\r?\n")


def cut_frames(buffer: str) -> tuple[list[tuple[str, str]], str]:
    """Whole frames of a buffer as (event, data), those without a JSON object dropped, and what remains."""
    *parts, rest = _END.split(buffer)
    found = []
    for part in parts:
        fields = dict(re.findall(r"(?m)^(event|data):[ ]?([^\r\n]*)", part))
        try:
            if isinstance(json.loads(fields.get("data", "")), dict):
                found.append((fields.get("event", ""), fields["data"]))
        except ValueError:
            continue
    return found, rest


def event_frames(pieces: DataFrame, idle: int | None = None) -> DataFrame:
    """pieces (connection long, seq long, piece string) -> connection, event, data; a frame may span pieces and batches.

    With ``idle``, for streams that run on, what is left of a connection that was silent for so many milliseconds
    is a frame cut off, and goes.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values("seq")
        found, rest = cut_frames((state.get[0] if state.exists else "") + "".join(rows["piece"]))
        state.update((rest,))
        if idle is not None:
            state.setTimeoutDuration(idle)
        yield pd.DataFrame([(key[0], e, d) for e, d in found], columns=["connection", "event", "data"])

    return pieces.groupBy("connection").applyInPandasWithState(step, "connection long, event string, data string", "buffer string", "append", _timeout(idle))
