"""Structured Streaming twins of the stream operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def replay(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream, a few files a trigger (throttled source)."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def event_windows(stream: DataFrame, ts: str, length: str, slide: str, late: str, *by: str) -> DataFrame:
    """Counts and sums of ``value`` over sliding event-time windows, with a watermark."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, length, slide), *by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("sum"))


def slot_bundles(stream: DataFrame, key: str, tag: str, value: str, tags: list) -> DataFrame:
    """The n-th item of every tag as one row, emitted once all have come; items waiting are the state."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    def run(k, batches, state):
        import json

        import pandas as pd

        held = json.loads(state.get[0]) if state.exists else {t: [] for t in tags}
        out = []
        for pdf in batches:
            for t, v in zip(pdf[tag], pdf[value]):
                if t in held:
                    held[t].append(float(v))
        while all(held.values()):
            out.append([held[t].pop(0) for t in sorted(tags)])
        state.update((json.dumps(held),))
        yield pd.DataFrame({key: [k[0]] * len(out), "bundle": out})

    kind = dict(stream.dtypes)[key]
    return stream.select(key, tag, value).groupBy(key).applyInPandasWithState(run, f"{key} {kind}, bundle array<double>", "held string", "append", GroupStateTimeout.NoTimeout)


def utterance_tags(stream: DataFrame, key: str, order: str, value: str, *levels) -> DataFrame:
    """(key, order, tag) of each value once it is decided: the twin of ``tag_utterances``, with the same levels.

    Values are taken in order within a trigger; the tagger and the places of the values it has not decided are the state.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    from ..operators.framing import UtteranceTagger

    UtteranceTagger(*levels)  # raises here rather than in a task

    def run(k, batches, state):
        import pickle

        import pandas as pd

        tagger, waiting = pickle.loads(state.get[0]) if state.exists else (UtteranceTagger(*levels), [])
        out, pdf = [], pd.concat(list(batches)).sort_values(order)
        for o, v in zip(pdf[order].tolist(), pdf[value].tolist()):
            waiting.append(o)
            n, inside = tagger.push(v)
            out += [(k[0], w, "UTT" if inside else "BAC") for w in waiting[:n]]
            waiting = waiting[n:]
        state.update((pickle.dumps((tagger, waiting)),))
        yield pd.DataFrame(out, columns=[key, order, "tag"])

    kinds = dict(stream.dtypes)
    return stream.select(key, order, value).groupBy(key).applyInPandasWithState(run, f"{key} {kinds[key]}, {order} {kinds[order]}, tag string", "held binary", "append", GroupStateTimeout.NoTimeout)


def adapt_models(stream: DataFrame, label: str, x: str, folder: str, relevance: float = 16.0, keep: list[str] = ()):
    """A foreachBatch sink that classifies each batch by the Gaussians so far, writes that, and only then adapts them on its labelled rows.

    ``folder``/scored/epoch=k holds (keep, label, hyp, score) of batch k, with null
    hyp and score while there are no models; ``folder``/models/epoch=k the models
    after it (label, n, mean, var).  A batch reads the models of the last epoch before its
    own and overwrites its own results, so a restart repeats a batch to the same end.
    """
    from pyspark.sql.utils import AnalysisException

    from ..models.gaussian import class_gaussians, classify

    def last(spark, epoch):
        try:
            held = spark.read.parquet(f"{folder}/models")
        except AnalysisException:  # no epoch has ended
            return None
        top = held.where(F.col("epoch") < epoch).agg(F.max("epoch")).first()[0]
        return None if top is None else held.where(F.col("epoch") == top).drop("epoch")

    def step(batch: DataFrame, epoch: int):
        batch = batch.persist()
        old = last(batch.sparkSession, epoch)
        if old is None:
            scored = batch.select(*keep, label, F.lit(None).cast(dict(batch.dtypes)[label]).alias("hyp"), F.lit(None).cast("double").alias("score"))
        else:
            rows = classify(batch.withColumnRenamed(label, "_truth"), old, [], label, x)
            scored = rows.select(*keep, F.col("_truth").alias(label), "hyp", F.array_max(F.transform("scores", lambda s: s["score"])).alias("score"))
        scored.write.mode("overwrite").parquet(f"{folder}/scored/epoch={epoch}")
        new = class_gaussians(batch.where(F.col(label).isNotNull()), label, F.col(x))
        if old is not None:
            was = old.select(label, F.col("n").alias("_n"), F.col("mean").alias("_mean"), F.col("var").alias("_var"))
            now = new.select(label, F.col("n").alias("_k"), F.col("mean").alias("_m"), F.col("var").alias("_v"))
            both = now.join(was, label, "full").withColumn("_f", F.col("_k") / (F.col("_k") + relevance))
            drawn = lambda a, b: F.when(F.col("_k").isNull(), F.col(b)).when(F.col("_n").isNull(), F.col(a)).otherwise(F.zip_with(a, b, lambda u, v: F.col("_f") * u + (1 - F.col("_f")) * v))
            total = F.coalesce("_k", F.lit(0)) + F.coalesce("_n", F.lit(0))
            new = both.select(label, total.alias("n"), drawn("_m", "_mean").alias("mean"), drawn("_v", "_var").alias("var"))
        new.write.mode("overwrite").parquet(f"{folder}/models/epoch={epoch}")
        batch.unpersist()

    return stream.writeStream.foreachBatch(step)


def adapted_accuracy(spark: SparkSession, folder: str, label: str) -> DataFrame:
    """(epoch, right, n, accuracy) over the labelled rows that had been classified before they were learned from."""
    rows = spark.read.parquet(f"{folder}/scored").where(F.col(label).isNotNull() & F.col("hyp").isNotNull())
    return rows.groupBy("epoch").agg(F.count_if(F.col("hyp") == F.col(label)).alias("right"), F.count(F.lit(1)).alias("n")).withColumn("accuracy", F.col("right") / F.col("n"))


def watch(df: DataFrame, name: str, *figures):
    """``df`` with figures (aggregates) taken as its rows pass by, and where they are read after the action: nothing is gathered."""
    from pyspark.sql import Observation

    if df.isStreaming:
        return df.observe(name, *figures), None
    seen = Observation(name)
    return df.observe(seen, *figures), seen


def collect_stream(stream: DataFrame, name: str, checkpoint: str, mode: str = "append"):
    """A query that keeps what comes in a table of the driver's memory, for tests and small streams."""
    return stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint)


class PushSource:
    """Rows pushed by the driver become a stream: each push is a file that readers see once it is complete.

    States are stopped, running and paused; rows pushed while it is not running are refused, and those
    pushed while paused wait. ``done`` closes it for good.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str):
        self.spark, self.folder, self.schema, self.state, self.waiting = spark, folder.rstrip("/"), schema, "stopped", []
        spark.createDataFrame([], schema).write.mode("ignore").parquet(self.folder)

    def stream(self, files_per_trigger: int = 1) -> DataFrame:
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", files_per_trigger).parquet(self.folder)

    def start(self):
        if self.state == "done":
            raise RuntimeError("the source is done")
        self.state = "running"
        for rows in self.waiting:
            self._write(rows)
        self.waiting = []

    def pause(self):
        if self.state != "running":
            raise RuntimeError(f"the source is {self.state}")
        self.state = "paused"

    def stop(self):
        self.state, self.waiting = "stopped", []

    def done(self):
        self.state = "done"

    def push(self, rows: list):
        if self.state == "paused":
            self.waiting.append(rows)
        elif self.state == "running":
            self._write(rows)
        else:
            raise RuntimeError(f"the source is {self.state}")

    def _write(self, rows: list):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(self.folder)
