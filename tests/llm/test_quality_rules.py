"""The quality rules against plain counting."""

import random
import re

import pytest

pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string"


def plain(text, rules, stops):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    at = {}
    for i in range(len(words) - 2):
        at.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {p + k for places in at.values() if len(places) > 1 for p in places for k in range(3)}
    n, chars, symbols, dup = len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines))
    over = lambda a, b: a / b if b else 0.0
    ends = sum(x.rstrip(" ").endswith(("...", "…")) for x in lines)
    marks = sum(x.lstrip(" ")[:1] in ("-", "*", "•") for x in lines)
    m = {"n_words": n, "repeat_share": over(len(covered), n), "mean_word": over(chars, n), "symbol_share": over(symbols, n), "stop_share": over(sum(w in stops for w in words), n), "dup_line_share": over(dup, len(lines)), "bullet_share": over(marks, len(lines)), "ellipsis_share": over(ends, len(lines))}
    failed = [r for r, k, least, most in rules if least is not None and m[k] < least or most is not None and m[k] > most]
    base = n < 50 or 100 * len(covered) > 50 * n
    return n, chars, symbols, dup, len(covered), base, failed, not base and not failed


def texts():
    r = random.Random(13)
    word = lambda k: "".join(r.choice("abcdeéß") for _ in range(r.randint(1, k)))
    clean = lambda n: " ".join(r.choice(["the", "of", "and"]) if r.random() < 0.2 else word(7) + "x" for _ in range(n))
    out = [clean(r.randint(45, 200)) for _ in range(30)]
    out += [" ".join(r.choice("abc") for _ in range(r.randint(3, 120))) for _ in range(20)]
    out += [" ".join(r.choice(["aa", "bb", "cc", "dd", "ee", "ff"]) for _ in range(r.randint(3, 300))) for _ in range(20)]
    out += [clean(80) + "\n" + "\n".join([clean(6)] * 4 + ["", "  ", "\t"]) for _ in range(4)]
    out += ["\n".join("- " + clean(8) for _ in range(20)), "\n".join("  • " + clean(8) for _ in range(20)), "\n".join(clean(8) + "... " for _ in range(20)), "\n".join(clean(8) + "…" for _ in range(20))]
    out += [clean(60) + " #*$%&|<>" * 9, " ".join(["Donaudampfschiff"] * 9), clean(60).replace(" ", "\x0b\x0c\r"), clean(60).replace(" ", " "), "\x1c\x1d  x"]
    out += [None, "", " ", "\n\n \t", "one", "a b", "a b c", "a b c a b c", "a a a a", "\n a a a \n", "𝔘𝔫𝔦 𝔠𝔬𝔡𝔢 𝔘", clean(40_000), "a " * 30_000, "x" * 300_000]
    return out


def test_rules_equal_plain_counting(spark):
    from pyspark.sql import functions as F

    from framelake.llm.quality_rules import RULES, judge_texts, stop_words

    found = texts()
    rows = [(i, t) for i, t in enumerate(found)] + [(None, "no id"), (0, found[1]), (1, found[1]), (1, found[1])]
    clash = {k: F.lit("x") for k in ("id", "t", "words", "lines", "n", "bits", "keys", "twins", "places", "failed")}
    got = judge_texts(spark.createDataFrame(rows, SCHEMA).withColumns(clash))
    assert got.columns == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "failed", "kept"]
    want = [(i, *plain(t, RULES, set(stop_words()))) for i, t in rows]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    kinds = {(x[6], x[8]) for x in want}
    assert kinds == {(True, False), (False, False), (False, True)}
    assert {f for x in want for f in x[7]} == {r[0] for r in RULES}


def test_rules_need_neither_user_functions_nor_exchanges(spark):
    from framelake.llm.quality_rules import judge_texts

    df = judge_texts(spark.range(3).selectExpr("id as doc_id", "cast(id as string) as text"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Exchange|Join|Generate|Window|HashAggregate", plan)
    assert judge_texts(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_table_of_ones_own(spark):
    from framelake.llm.quality_rules import judge_texts

    df = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(60))), (2, " ".join(f"und{i} und" for i in range(60)))], SCHEMA)
    got = judge_texts(df, rules=[("short", "n_words", 100, None), ("stops", "stop_share", 0.4, 0.6)], stops=["und"])
    assert [(r["doc_id"], r["failed"], r["kept"]) for r in got.orderBy("doc_id").collect()] == [(1, ["short", "stops"], False), (2, [], True)]
    assert judge_texts(df, rules=[]).where("kept").count() == 2
