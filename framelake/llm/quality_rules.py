"""Quality rules: a table of thresholds compiled into one projection.

``RULES`` names a measure of a text and the range in which it must lie.  The
table is compiled into column expressions: every measure is a built-in function
of the text, its words or its lines, and the verdict is their conjunction.  There
is no user function, no join and no exchange; a text is read once, in its row.

Words that repeat are found without a group by: each 3-word window becomes one
number, the upper bits of a hash of its words above its place; sorted numbers
that agree above the place are candidates, and candidates alone are sorted again
as text, so that only equal windows count.

Defined cases: a null text has no words and no lines; a measure over no words or
no lines is 0; rows are judged one by one, so repeated ids and repeated rows give
as many results; a null id stays null; an empty table gives an empty one; texts
of any length are read whole; columns other than the id and the text are not
read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space as the contract has it, in a Java pattern.
BLANK = "[ \\t-\\r]+"
WINDOW = 3
#: Frequent words of the languages of the corpus (fixed values).
STOP_WORDS = {
    "en": ["the", "be", "to", "of", "and", "that", "have", "with", "in", "is", "it", "for", "on", "was", "are", "a", "an"],
    "de": ["der", "die", "das", "und", "ist", "ein", "eine", "in", "den", "von", "zu", "mit", "sich", "nicht", "für", "des", "dem"],
    "fr": ["le", "la", "les", "des", "et", "est", "un", "une", "de", "du", "que", "en", "dans", "pour", "avec", "sur"],
    "es": ["el", "la", "los", "las", "de", "que", "y", "en", "un", "una", "es", "del", "por", "con", "para", "se"],
}
#: (rule, measure, least, most); None: no bound on that side.
RULES = [
    ("words", "n_words", 50, None),
    ("repeated_words", "repeat_share", None, 0.5),
    ("word_length", "mean_word", 3, 10),
    ("symbols", "symbol_share", None, 0.1),
    ("stop_words", "stop_share", 0.02, None),
    ("repeated_lines", "dup_line_share", None, 0.5),
    ("bullets", "bullet_share", None, 0.9),
    ("ellipses", "ellipsis_share", None, 0.3),
]
#: The rules of the contract's own verdict; exact in integers.
BASE = "n_words < 50 or 100 * n_repeat_words > 50 * n_words"


def stop_words(languages: dict[str, list[str]] = STOP_WORDS) -> list[str]:
    """All stop words, as they are and with a first capital."""
    return sorted({form for words in languages.values() for w in words for form in (w, w.capitalize())})


def _over(count: Column, total: Column) -> Column:
    return F.when(total > 0, count.cast("double") / total).otherwise(F.lit(0.0))


def _measures(stops: list[str]) -> dict[str, Column]:
    """The measures of RULES from the counts of ``count_parts``."""
    n, lines = F.col("n_words"), F.col("n_lines")
    return {
        "n_words": n,
        "repeat_share": _over(F.col("n_repeat_words"), n),
        "mean_word": _over(F.col("word_chars"), n),
        "symbol_share": _over(F.col("n_symbols"), n),
        "stop_share": _over(F.size(F.filter("words", lambda w: w.isin(stops))), n),
        "dup_line_share": _over(F.col("n_dup_lines"), lines),
        "bullet_share": _over(F.size(F.filter("lines", lambda x: F.substring(F.ltrim(x), 1, 1).isin("-", "*", "•"))), lines),
        "ellipsis_share": _over(F.size(F.filter("lines", lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…"))), lines),
    }


def failed_rules(rules: list[tuple], stops: list[str]) -> Column:
    """The names of the rules that a row breaks, in the order of the table."""
    measures, broken = _measures(stops), []
    for name, measure, least, most in rules:
        m = measures[measure]
        outside = [m < F.lit(least)] * (least is not None) + [m > F.lit(most)] * (most is not None)
        for test in outside:
            broken.append(F.when(test, F.lit(name)))
    return F.array_compact(F.array(*broken)) if broken else F.array().cast("array<string>")


def _agreeing(items: Column, n: Column, same, of=lambda x: x) -> Column:
    """``of`` the elements of a sorted array of ``n`` that agree with the one before or behind."""
    at = lambda k: F.get(items, k)
    pairs = F.filter(F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0))), lambda k: F.coalesce(same(at(k), at(k + 1)), F.lit(False)))
    return F.array_distinct(F.flatten(F.transform(pairs, lambda k: F.array(of(at(k)), of(at(k + 1))))))


def count_parts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, t, words, lines, counts) of each row: the integer columns that the rules are made of."""
    at = lambda c, k: F.get(F.col(c), k)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("t"))
    rows = rows.select("id", "t", F.array_remove(F.split("t", BLANK, -1), "").alias("words"), F.filter(F.split("t", "\n", -1), lambda x: x.rlike("[^ \\t-\\r]")).alias("lines"))
    # the place takes as many low bits as the number of words has
    rows = rows.withColumns({"n": F.size("words"), "bits": F.length(F.bin(F.size("words")))})
    number = lambda w, i: F.call_function("shiftleft", F.xxhash64(w, at("words", i + 1), at("words", i + 2)), F.col("bits")).bitwiseOR(i.cast("long"))
    rows = rows.withColumn("keys", F.sort_array(F.transform(F.slice("words", 1, F.greatest(F.col("n") - (WINDOW - 1), F.lit(0))), number)))
    agree = lambda x, y: F.call_function("shiftrightunsigned", x.bitwiseXOR(y), F.col("bits")) == 0
    place = lambda x: x.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bits")) - 1).cast("int")
    text = lambda p: F.struct(F.concat_ws(" ", at("words", p), at("words", p + 1), at("words", p + 2)).alias("w"), p.alias("p"))
    rows = rows.withColumn("keys", _agreeing(F.col("keys"), F.size("keys"), agree))
    rows = rows.withColumn("twins", F.sort_array(F.transform(F.transform("keys", place), text)))
    rows = rows.withColumn("places", F.sort_array(_agreeing(F.col("twins"), F.size("twins"), lambda a, b: a["w"] == b["w"], lambda x: x["p"])))
    start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
    covered = F.aggregate("places", start, lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("n")), lambda acc: acc["n"])
    long = lambda c: c.cast("long")
    return rows.select(
        "id", "t", "words", "lines",
        long(F.col("n")).alias("n_words"),
        long(F.length(F.array_join("words", ""))).alias("word_chars"),
        long(F.regexp_count("t", F.lit("[#*$%&|<>]"))).alias("n_symbols"),
        long(F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        long(covered).alias("n_repeat_words"),
        F.size("lines").alias("n_lines"),
    )


def judge_texts(docs: DataFrame, rules: list[tuple] = RULES, stops: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, counts, base_failed, failed, kept) of every row: ``failed`` lists the broken rules of the table."""
    rows = count_parts(docs, id_col, text_col)
    rows = rows.withColumns({"base_failed": F.expr(BASE), "failed": failed_rules(rules, stop_words() if stops is None else stops)})
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return rows.select(F.col("id").alias(id_col), *counts, "base_failed", "failed", (~F.col("base_failed") & (F.size("failed") == 0)).alias("kept"))
