"""Text sources and sinks: annotations, label containers, lists, scores, transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.lineage import numbered

from ..operators.segments import merge_runs
from ..operators.streams import map_labels


def base_name(path: Column) -> Column:
    """File name without folders and its last suffix."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]*$", "")


def lines(spark: SparkSession, path: str, comment: str | None = "#") -> DataFrame:
    """(file, line_no, line): whole files split; blank lines and comments left out."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\r?\n", -1)).alias("line_no", "line"))
    kept = rows.where(F.trim("line") != "")
    return kept.where(~F.ltrim("line").startswith(comment)) if comment else kept


def annotations(rows: DataFrame, line: str = "line", file: str = "file", order: str = "line_no") -> DataFrame:
    """Whitespace rows with start, end (seconds) and label as fields 3 to 5: integer 100 ns segments."""
    f = F.split(F.trim(line), r"\s+")
    tick = lambda k: F.round(f[k].cast("double") / 1e-7).cast("long")
    return rows.select(base_name(F.col(file)).alias("utt"), F.col(order).alias("seg"), tick(2).alias("start_100ns"), tick(3).alias("end_100ns"), f[4].alias("label"))


def merged_annotations(rows: DataFrame, mapping: DataFrame, source: str, target: str) -> DataFrame:
    """annotations with labels mapped (unknown ones raise) and consecutive equal labels merged."""
    s = map_labels(rows, "label", mapping, source, target)
    return merge_runs(s, ["utt"], ["seg"], "label", "start_100ns", "end_100ns").select("utt", F.col("run").alias("seg"), "start_100ns", "end_100ns", "label")


def label_blocks(spark: SparkSession, path: str) -> DataFrame:
    """A label container (magic line, quoted names, label lines, a full stop): name, seg, start, end, label, score.

    Lines have 1, 3 or 4 fields (label; start end label; with score); others raise.
    """
    return label_blocks_of(spark.read.text(path, wholetext=True))


def label_blocks_of(text: DataFrame) -> DataFrame:
    """The rows of containers given as (value)."""
    blocks = text.select(F.posexplode(F.split(F.regexp_replace("value", r"\A\s*#!MLF!#\s*", ""), r"(?m)^\.\s*$")).alias("block", "body")).where(F.trim(F.regexp_replace("body", r"\s+", " ")) != "")
    rows = blocks.select(F.regexp_extract("body", r'"([^"]*)"', 1).alias("name"), F.posexplode(F.filter(F.split(F.regexp_replace("body", r'\A\s*"[^"]*"', ""), r"\r?\n"), lambda v: F.trim(v) != "")).alias("seg", "line"))
    f = F.split(F.trim("line"), r"\s+")
    n = F.size(f)
    ok = F.when(n.isin(1, 3, 4), True).otherwise(F.raise_error(F.concat(F.lit("bad label line: "), F.col("line"))).cast("boolean"))
    timed = n >= 3
    return rows.where(ok).select("name", "seg", F.when(timed, F.get(f, F.lit(0)).cast("long")).alias("start_100ns"), F.when(timed, F.get(f, F.lit(1)).cast("long")).alias("end_100ns"), F.when(timed, F.get(f, F.lit(2))).otherwise(F.get(f, F.lit(0))).alias("label"), F.when(n == 4, F.get(f, F.lit(3)).cast("double")).alias("score"))


def label_lines(segments: DataFrame, utt: str = "utt") -> DataFrame:
    """(utt, value): the text of each utterance's label file."""
    rows = segments.select(utt, F.struct("start_100ns", F.concat_ws(" ", "start_100ns", "end_100ns", "label").alias("t")).alias("s"))
    return rows.groupBy(utt).agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["t"]), "\n").alias("value"))


def container_text(segments: DataFrame, utt: str = "utt") -> DataFrame:
    """Rows of a label container, to be written with write.text: one value a block, the magic line apart."""
    return label_lines(segments, utt).select(F.concat(F.lit('"*/'), F.col(utt), F.lit('.rec"\n'), F.col("value"), F.lit("\n.")).alias("value"))


def list_columns(rows: DataFrame, line: str, names: list[str], sep: str = " ", keep: list[str] = ()) -> DataFrame:
    """A list file's columns by name, behind the columns to keep."""
    f = F.split(F.col(line), sep)
    return rows.select(*keep, *(F.get(f, F.lit(k)).alias(n) for k, n in enumerate(names)))


def corresponding(paths: DataFrame, path: str, existing: DataFrame, other: str, rewrite: list[tuple[str, str]], suffix: str) -> DataFrame:
    """Paths rewritten (regex, replacement) to a suffix, those kept that exist."""
    to = F.col(path)
    for a, b in rewrite:
        to = F.regexp_replace(to, a, b)
    to = F.regexp_replace(to, r"\.[^./]*$", suffix)
    return paths.withColumn("to", to).join(existing.select(F.col(other).alias("to")), "to", "left_semi")


def whole_file_segments(audio: DataFrame, label: str) -> DataFrame:
    """(utt, 0, n * 1e7 / rate, label) from rows of read_wav."""
    n = (F.size("samples") * 1e7 / F.col("rate")).cast("long")
    return audio.where("channel = 0").select(base_name(F.col("path")).alias("utt"), F.lit(0).cast("long").alias("start_100ns"), n.alias("end_100ns"), F.lit(label).alias("label"))


def score_rows(rows: DataFrame, line: str = "line", file: str = "file", order: str = "line_no") -> DataFrame:
    """Score files, one frame a line and one class a column, as costs: utt, frame, class, cost."""
    f = F.split(F.trim(line), r"\s+")
    return rows.select(base_name(F.col(file)).alias("utt"), (F.col(order) + 1).alias("frame"), F.posexplode(f).alias("class", "v")).select("utt", "frame", "class", (-F.col("v").cast("double")).alias("cost"))


def transcript_turns(spark: SparkSession, path: str) -> DataFrame:
    """Turns of XML transcripts: file, speaker, start_s, end_s, text."""
    rows = spark.read.format("xml").option("rowTag", "Turn").option("valueTag", "text").schema("_speaker string, _startTime double, _endTime double, text string").load(path)
    return rows.select(base_name(F.col("_metadata.file_path")).alias("file"), F.col("_speaker").alias("speaker"), F.col("_startTime").alias("start_s"), F.col("_endTime").alias("end_s"), F.trim(F.regexp_replace("text", r"\s+", " ")).alias("text"))


def numerify(df: DataFrame, *names: str) -> DataFrame:
    """Columns as doubles where they read as such, else null."""
    return df.withColumns({n: F.expr(f"try_cast(`{n}` AS double)") for n in names})


def zip_files(a: DataFrame, b: DataFrame) -> DataFrame:
    """Lines of two files side by side; a file a partition."""
    w = Window.partitionBy("file").orderBy("line_no")
    x, y = (d.withColumn("k", F.row_number().over(w)) for d in (a, b))
    return x.select("k", F.col("line").alias("a")).join(y.select("k", F.col("line").alias("b")), "k", "full")


def joined_containers(files: DataFrame, order: str, value: str = "value") -> DataFrame:
    """One container text of several: the blocks of each file in the files' order, under one magic line."""
    body = F.regexp_replace(F.rtrim(value), r"\A\s*#!MLF!#\s*", "")
    rows = files.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), body.alias("v")))), lambda s: s["v"]), "\n").alias("value"))
    return rows.select(F.concat(F.lit("#!MLF!#\n"), "value").alias("value"))


def container_lines(files: DataFrame, order: str, value: str = "value") -> DataFrame:
    """The lines of the container of several files, in order, as rows (line_no, line): the magic line, then the blocks of each file.

    Unlike ``joined_containers`` no row holds more than a file.
    """
    body = F.regexp_replace(F.regexp_replace(F.col(value), r"\A\s*#!MLF!#\s*", ""), r"\s+\z", "")
    lines = files.select(F.col(order).alias("o"), F.posexplode(F.split(body, "\n", -1)).alias("p", "line"))
    rows = numbered(lines, ["o", "p"], "k").select((F.col("k") + 1).alias("line_no"), "line")
    magic = files.sparkSession.createDataFrame([(0, "#!MLF!#")], "line_no long, line string")
    return magic.unionByName(rows)
