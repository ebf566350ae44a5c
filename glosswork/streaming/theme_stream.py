"""Theme coding as a stream: new files are coded once, and an interrupted job goes on where it stopped.

What has been seen is kept by key in Spark's state store, so a batch reads its own files and the state of its own keys: the
fiftieth batch does no more than the first. Two forms: ``run_theme_stream`` codes new rows with any labeller;
``run_answer_stream`` asks a service and keeps rows without an answer in the state, where a timer asks again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from glosswork.fixed_values import CODEBOOK
from glosswork.functions.text import is_empty_review
from glosswork.operators.calls import Ask, Caller, CallLimits
from glosswork.operators.coding import labelling_input, normalise_answers

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_NO_DATA = "spark.sql.streaming.noDataMicroBatches.enabled"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_stream(spark: SparkSession, folder: str, schema: T.StructType, table: str | None = None,
                files_per_batch: int = 100, file_format: str = "parquet") -> DataFrame:
    """Parquet or CSV files of a folder as a stream; ``files_per_batch`` sets how much one commit covers.

    With ``table`` only what has this name in the folder is read, be it one file or a folder of files. CSV files are quoted as ``write_quoted_csv`` does it; one whose header isn't the schema's is an error."""
    reader = (spark.readStream.schema(schema).option("pathGlobFilter", f"*.{file_format}")
              .option("maxFilesPerTrigger", files_per_batch))
    if table:
        folder = f"{folder}/{{{table}}}"  # as a pattern: a stream takes a plain path for a folder
    if file_format == "csv":
        return (reader.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True)
                .option("enforceSchema", False).csv(folder))
    return reader.format(file_format).load(folder)


def coded_rows(spark: SparkSession, sink: str) -> DataFrame | None:
    """What the sink holds, or None before the first commit."""
    try:
        return spark.read.parquet(sink)
    except Exception as error:  # the folder does not exist or holds no file yet
        if "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER_SCHEMA" in str(error):
            return None
        raise


@contextmanager
def _settings(spark: SparkSession, only_with_data: bool = False) -> Iterator[None]:
    """A query started inside keeps its state in RocksDB, so it may outgrow the memory; another choice of the session stands.

    ``only_with_data`` leaves out batches without new rows, without which a query with timers would never be done."""
    wanted = {_NO_DATA: "false"} if only_with_data else {}
    if spark.conf.get(_PROVIDER, "HDFSBackedStateStoreProvider").endswith("HDFSBackedStateStoreProvider"):
        wanted[_PROVIDER] = _ROCKSDB
    given = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in given.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def new_keys(rows: DataFrame, key: str = "row_key", remember: tuple[str, str] | None = None) -> DataFrame:
    """The rows of a stream whose key has not come before; of rows with equal keys one.

    All keys are remembered, or with ``remember=(time column, "30 days")`` at least those of that span
    before the latest time; older ones are forgotten as batches end."""
    if remember is None:
        return rows.dropDuplicates([key])
    return rows.withWatermark(*remember).dropDuplicatesWithinWatermark([key])


def write_batch(batch: DataFrame, batch_id: int, code: Callable[[DataFrame], DataFrame], sink: str) -> None:
    """Code one micro-batch and replace that batch's own folder of the sink.

    A batch that runs again after a failure overwrites what it wrote before, so every row ends up in
    the sink once; a later batch with nothing to write gets no folder. A labeller may read the batch more
    than once, the state behind it is asked once."""
    spark, path = batch.sparkSession, f"{sink}/batch_id={batch_id}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)
    held = batch.persist()
    try:
        if batch_id == 0 or there or not held.isEmpty():
            code(held).write.mode("overwrite").parquet(path)
    finally:
        held.unpersist()


def start_theme_stream(rows: DataFrame, code: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str,
                       key: str = "row_key", across_batches: bool = True,
                       remember: tuple[str, str] | None = None) -> StreamingQuery:
    """Code everything available and stop. Progress and seen keys live in ``checkpoint``; both folders must be on
    storage that every executor reaches. Without ``across_batches`` a key is coded once per batch, and nothing is remembered."""
    fresh = new_keys(rows, key, remember) if across_batches else rows
    once = code if across_batches else lambda batch: code(batch.dropDuplicates([key]))
    with _settings(rows.sparkSession):
        return (fresh.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
                .foreachBatch(lambda batch, i: write_batch(batch, i, once, sink)).start())


def run_theme_stream(rows: DataFrame, code: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str,
                     key: str = "row_key", across_batches: bool = True,
                     remember: tuple[str, str] | None = None) -> DataFrame:
    query = start_theme_stream(rows, code, sink, checkpoint, key, across_batches, remember)
    query.awaitTermination()
    return rows.sparkSession.read.parquet(sink)


# ---- answers of a service, asked again by timer -------------------------------------------------------

class _Asking(StatefulProcessor):
    """Per bucket of keys: how often each key was asked, and the requests that wait for another time."""

    def __init__(self, connect: Callable[[], Ask], limits: CallLimits, rounds: int, wait: int):
        self._connect, self._limits, self._rounds, self._wait = connect, limits, rounds, wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._asked = handle.getMapState("asked", "name string", "rounds int")
        self._waiting = handle.getMapState("waiting", "name string", "prompt string, rounds int, due bigint")
        self._caller = Caller(self._connect(), self._limits)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        for batch in rows:
            fresh = {}
            for name, prompt in zip(batch["name"], batch["prompt"]):
                if name not in fresh and not self._asked.containsKey((name,)):
                    fresh[name] = (prompt, 0)
            yield self._ask(fresh, now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        due = {name: (prompt, rounds) for (name,), (prompt, rounds, at) in list(self._waiting.iterator()) if at <= now}
        yield self._ask(due, now)

    def close(self) -> None:
        self._caller.__exit__()

    def _ask(self, requests: Mapping[str, tuple[str | None, int]], now: int) -> pd.DataFrame:
        """Ask, keep what has no answer yet, and give what is settled: answered, empty, or failed in every round."""
        asked = {name: r for name, r in requests.items() if r[0] is not None}
        answers = dict(zip(asked, self._caller.answers([prompt for prompt, _ in asked.values()])))
        settled, dues = [], set()
        for name, (prompt, rounds) in requests.items():
            response, reason = answers.get(name, (None, None))
            rounds += name in asked
            self._asked.updateValue((name,), (rounds,))
            if name in asked and response is None and rounds < self._rounds:
                due = now + max(1, self._wait * 2 ** (rounds - 1))  # a timer of this very moment wouldn't fire
                self._waiting.updateValue((name,), (prompt, rounds, due))
                dues.add(due)
                continue
            if rounds > 1:
                self._waiting.removeKey((name,))
            settled.append((name, response, reason, rounds))
        for due in dues:
            self._handle.registerTimer(due)
        return pd.DataFrame(settled, columns=["name", "response", "error_text", "rounds"]).astype({"rounds": "int32"})


def answered_stream(rows: DataFrame, connect: Callable[[], Ask], key: str = "row_key", limits: CallLimits = CallLimits(),
                    rounds: int = 5, wait_seconds: float = 600.0, buckets: int = 1024) -> DataFrame:
    """``(key, response, error_text, rounds)`` of a stream of ``key`` and ``prompt``: every key once, when it is settled.

    Keys are dealt to ``buckets``, within which the calls of a batch run side by side under ``limits``. What has no answer
    is asked again after ``wait_seconds``, then after twice that, in up to ``rounds`` rounds; then it is given with the last
    reason. A null prompt is settled without a call, in no round. Rows without a key count as one key."""
    name = F.to_json(F.struct(F.col(key).alias("k")))
    key_type = rows.schema[key].dataType.simpleString()
    dealt = rows.select(name.alias("name"), "prompt").withColumn("bucket", F.pmod(F.xxhash64("name"), F.lit(buckets)))
    out = dealt.groupBy("bucket").transformWithStateInPandas(
        _Asking(connect, limits, rounds, int(wait_seconds * 1000)), "name string, response string, error_text string, rounds int",
        "append", "processingTime")
    return out.select(F.from_json("name", f"k {key_type}")["k"].alias(key), "response", "error_text", "rounds")


def start_answer_stream(rows: DataFrame, connect: Callable[[], Ask], sink: str, checkpoint: str,
                        themes: Mapping[str, str] = CODEBOOK, key: str = "row_key", every: str | None = None,
                        title: str = "title", review: str = "review_text", max_chars: int | None = None,
                        **options) -> StreamingQuery:
    """Ask a service for the themes of a stream of reviews; one folder per batch of (key, status, themes…, error_text, rounds).

    With ``every``, such as "1 minute", the query goes on and its timers fire as they fall due; without, it stops after
    what is available, and what waits is asked in the first later run that finds new files. ``options`` go to ``answered_stream``."""
    texts = labelling_input(rows, title, review, themes, max_chars)
    asked = texts.select(key, F.when(~is_empty_review(F.col("text")), F.col("prompt")).alias("prompt"))
    names: Sequence[str] = list(themes)

    def code(answered: DataFrame) -> DataFrame:
        coded = normalise_answers(answered, names)
        status = F.when(F.col("rounds") == 0, "empty").otherwise(F.col("status"))
        return coded.select(key, status.alias("status"), *names, "error_text", "rounds")

    trigger = {"availableNow": True} if every is None else {"processingTime": every}
    with _settings(rows.sparkSession, only_with_data=every is None):
        return (answered_stream(asked, connect, key, **options).writeStream.option("checkpointLocation", checkpoint)
                .trigger(**trigger).foreachBatch(lambda batch, i: write_batch(batch, i, code, sink)).start())


def run_answer_stream(rows: DataFrame, connect: Callable[[], Ask], sink: str, checkpoint: str, **options) -> DataFrame:
    """``start_answer_stream`` over what is available, and the whole sink."""
    start_answer_stream(rows, connect, sink, checkpoint, **options).awaitTermination()
    return rows.sparkSession.read.parquet(sink)
