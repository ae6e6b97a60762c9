"""Text sinks: curves, reports, lists and configuration; columns of text go through write.text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_curve(points: DataFrame, path: str) -> None:
    """DET or ROC points as CSV with a header, one file sorted by threshold (a curve is report-sized)."""
    points.orderBy(F.desc("threshold")).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def config_text(values: dict) -> str:
    """NAME = value lines."""
    return "".join(f"{k} = {'T' if v is True else 'F' if v is False else v}\n" for k, v in values.items())


def list_lines(paths: DataFrame, *columns: str) -> DataFrame:
    """Rows of a list file: the columns with a space between."""
    return paths.select(F.concat_ws(" ", *columns).alias("value"))


def result_xml(segments: DataFrame, utt: str = "utt") -> DataFrame:
    """(utt, value): an element an utterance with its segments in seconds."""
    def safe(c):
        for mark, word in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            c = F.replace(c, F.lit(mark), F.lit(word))
        return c

    row = F.format_string('  <segment start="%.2f" end="%.2f" label="%s"/>', F.col("start_100ns") * 1e-7, F.col("end_100ns") * 1e-7, safe(F.col("label")))
    rows = segments.select(utt, F.struct("start_100ns", row.alias("t")).alias("s"))
    lists = rows.groupBy(utt).agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["t"]), "\n").alias("body"))
    return lists.select(utt, F.concat(F.lit('<file name="'), safe(F.col(utt)), F.lit('">\n'), F.col("body"), F.lit("\n</file>")).alias("value"))
