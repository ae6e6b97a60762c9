"""Text data: lines of tokens under a header, with escapes; and plain lines of several files together.

A file begins with lines of a keyword and one value (version, comment prefix,
escape character, and maybe a file type and its version) and an end-of-header
keyword.  Then each line is a row of tokens, in which the escape character with
two hexadecimal digits stands for a byte and with two quotes for the empty token.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed values of the format.
KEYWORD, VERSION = "__textdata__", "1"
_GRAPHICAL = {chr(c) for c in range(33, 127)}


def parse_text_data(text: str, file_type: str | None = None, file_version: str | None = None, header: bool = True, comment: str = "#", escape: str = "%") -> tuple[dict, list[list[str]]]:
    """(header, rows of tokens) of one file; what breaks the format raises."""
    rows = [line.split() for line in text.split("\n")]
    rows = [r for r in rows if r]
    head = {"comment_prefix": comment, "escape_char": escape, "file_type": None, "file_version": None}
    if header:
        found, at = {}, 0
        for at, tokens in enumerate(rows):
            word = next((t for t in tokens if t.startswith(KEYWORD)), None)
            if word is None:
                continue
            values = tokens[tokens.index(word) + 1 :]
            if word == KEYWORD + "end_of_header":
                break
            if len(values) != 1:
                raise ValueError(f"not one value for {word}")
            found[word[len(KEYWORD) :]] = values[0]
        else:
            raise ValueError("the header has no end")
        names = list(found)
        if names not in (["version", "comment_prefix", "escape_char"], ["version", "comment_prefix", "escape_char", "file_type", "file_version"]) or found["version"] != VERSION:
            raise ValueError(f"not a header of version {VERSION}: {names}")
        head.update({k: v for k, v in found.items() if k != "version"})
        rows = rows[at + 1 :]
    mark, prefix = head["escape_char"], head["comment_prefix"]
    if len(mark) != 1 or mark not in _GRAPHICAL or mark in "0123456789abcdefABCDEF'" or mark in prefix or set(prefix) - _GRAPHICAL:
        raise ValueError("the escape character or the comment prefix is not allowed")
    for name, want in (("file_type", file_type), ("file_version", file_version)):
        if want is not None and head[name] != want:
            raise ValueError(f"expected {name} {want}, got {head[name]}")
    code = re.compile(re.escape(mark) + r"(?:([0-9a-fA-F]{2})|('')|(.{0,2}))")

    def one(m):
        if m.group(3) is not None:
            raise ValueError(f"invalid escape in {m.string!r}")
        return chr(int(m.group(1), 16)) if m.group(1) else ""

    out = []
    for tokens in rows:
        if tokens[0] == KEYWORD + "end_of_data":
            break
        if not tokens[0].startswith(prefix):
            out.append([code.sub(one, t) for t in tokens])
    return head, out


def text_data(rows, file_type: str | None = None, file_version: str | None = None, comment: str = "#", escape: str = "%", header: bool = True) -> str:
    """The text of rows of tokens (strings of single-byte characters but the null)."""
    coded = {chr(c) for c in range(1, 256)} - _GRAPHICAL | set(comment) | {escape}
    word = lambda t: "".join(f"{escape}{ord(c):02X}" if c in coded else c for c in t) or f"{escape}''"
    lines = []
    if header:
        given = [("version", VERSION), ("comment_prefix", comment), ("escape_char", escape), *([("file_type", file_type), ("file_version", file_version)] if file_type else [])]
        lines = [f"{KEYWORD}{k} {v}" for k, v in given] + [KEYWORD + "end_of_header"]
    for tokens in rows:
        if any(c == "\0" or ord(c) > 255 for t in tokens for c in t):
            raise ValueError("a token holds what the format does not encode")
        lines.append(" ".join(map(word, tokens)))
    return "\n".join([*lines, KEYWORD + "end_of_data", ""])


def read_text_data(spark: SparkSession, path: str, file_type: str | None = None, file_version: str | None = None, **how) -> DataFrame:
    """(file, file_type, file_version, row, tokens) of all files under ``path``; a file is one task's."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return parsed_files(files, file_type, file_version, **how)


def parsed_files(files: DataFrame, file_type: str | None = None, file_version: str | None = None, **how) -> DataFrame:
    """The rows of files given as (file, value)."""

    def work(batches):
        import pandas as pd

        for pdf in batches:
            for name, text in zip(pdf["file"], pdf["value"]):
                head, rows = parse_text_data(text, file_type, file_version, **how)
                yield pd.DataFrame({"file": name, "file_type": head["file_type"], "file_version": head["file_version"], "row": range(len(rows)), "tokens": rows})

    return files.mapInPandas(work, "file string, file_type string, file_version string, row int, tokens array<string>")


def text_data_files(rows: DataFrame, file: str, row: str, tokens: str, file_type: str | None = None, file_version: str | None = None) -> DataFrame:
    """(file, value): the text of each file's rows, to be written as text."""

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values(row)
        return pd.DataFrame({file: [pdf[file].iloc[0]], "value": [text_data([list(t) for t in pdf[tokens]], file_type, file_version)]})

    return rows.select(file, row, tokens).groupBy(file).applyInPandas(run, f"{file} string, value string")


def normalised(lines: DataFrame, line: str = "line") -> DataFrame:
    """``lines`` with the white space of each as single spaces, without any around it."""
    return lines.withColumn(line, F.trim(F.regexp_replace(line, r"\s+", " ")))


def chained(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Lines (file, line_no, line) of several reads, one behind the other: with ``source``, their number from 0."""
    out = first.withColumn("source", F.lit(0))
    for k, df in enumerate(others, 1):
        out = out.unionByName(df.withColumn("source", F.lit(k)))
    return out


def zipped(frames: list[DataFrame], line: str = "line", order: str = "line_no") -> DataFrame:
    """(row, lines): the lines of the same number in files of one read each; as many rows as the shortest has."""
    out = None
    for k, df in enumerate(frames):
        one = df.select((F.row_number().over(Window.partitionBy("file").orderBy(order)) - 1).alias("row"), F.col(line).alias(f"_{k}"))
        out = one if out is None else out.join(one, "row")
    return out.select("row", F.array(*(f"_{k}" for k in range(len(frames)))).alias("lines"))


def keyed(lines: DataFrame, line: str = "line") -> DataFrame:
    """(key, values): the first field of each line and the others; a key that comes twice raises."""
    f = F.split(F.trim(line), r"\s+")
    rows = lines.groupBy(f[0].alias("key")).agg(F.count(F.lit(1)).alias("_n"), F.first(F.slice(f, 2, F.greatest(F.lit(1), F.size(f)))).alias("values"))
    once = F.when(F.col("_n") == 1, F.col("values")).otherwise(F.raise_error(F.concat(F.lit("the key comes twice: "), "key")).cast("array<string>"))
    return rows.select("key", once.alias("values"))


def catalogue(spark: SparkSession, path: str, row_tag: str = "corpus") -> DataFrame:
    """One row an entry of an XML catalogue: its attributes and the texts of its children, as a map of strings."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")

    def work(batches):
        import xml.etree.ElementTree as ET

        import pandas as pd

        for pdf in batches:
            for name, text in zip(pdf["file"], pdf["value"]):
                rows = []
                for k, e in enumerate(ET.fromstring(text).iter(row_tag)):
                    rows.append((name, k, {**e.attrib, **{c.tag: (c.text or "").strip() for c in e}}))
                yield pd.DataFrame(rows, columns=["file", "entry", "fields"])

    return files.mapInPandas(work, "file string, entry int, fields map<string,string>")
