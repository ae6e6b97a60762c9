"""Places of rows among all, exact float text and container lines."""

import math
import random
import struct

from pyspark.sql import functions as F


def test_float_text_is_exact(spark):
    from framelake.functions.dsp import float_hex, hex_float

    r = random.Random(20)
    values = [struct.unpack("<d", r.randbytes(8))[0] for _ in range(3000)]  # of any size, some not numbers
    values += [s * math.ldexp(m, e) for e in range(-1074, 1024) for m in (1.0, 1.0 - 2**-53) for s in (1, -1)]
    values += [0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, math.inf, -math.inf, math.nan, None, 0.1, 1 / 3]
    df = spark.createDataFrame(list(enumerate(values)), "k int, v double").select("k", float_hex(F.col("v")).alias("t"))
    got = {x["k"]: (x["t"], x["again"]) for x in df.withColumn("again", hex_float(F.col("t"))).collect()}
    for k, v in enumerate(values):
        if v is None or math.isnan(v):
            assert got[k] == (None, None)
        else:
            assert got[k] == (v.hex(), v), v
    odd = spark.createDataFrame([("",), ("0x",), ("1.5",), ("0x1.8p+1",), (None,)], "t string").select(hex_float(F.col("t")))
    assert [x[0] for x in odd.collect()] == [None, None, None, 3.0, None]


def test_collated_rows_and_places(spark):
    from framelake.operators.metrics import collated, label_ids, ngram_places

    r = random.Random(5)
    rows = [(r.choice("aaab"), r.randrange(30)) for _ in range(400)]
    got = {}
    for x in collated(spark.createDataFrame(rows, "key string, v int"), "key", "v").orderBy("key", "k").collect():
        got.setdefault(x["key"], []).append((x["k"], x["v"], x["first"]))
    for key in "ab":
        want = sorted(v for k, v in rows if k == key)
        assert got[key] == [(k, v, k == 0 or want[k - 1] != v) for k, v in enumerate(want)]
    assert {x["key"]: x["id"] for x in label_ids(spark.createDataFrame(rows, "key string, v int"), "key").collect()} == {"a": 0, "b": 1}
    docs = spark.createDataFrame([(1, ["x", "y", "x", "y"]), (2, ["x", "y"])], "doc int, t array<string>")
    found = ngram_places(docs, "doc", F.col("t"), 2).where("ngram = 'x y'").orderBy("k").collect()
    assert [(x["k"], x["doc"], x["start"]) for x in found] == [(0, 1, 0), (1, 1, 2), (2, 2, 0)]


def test_container_lines(spark):
    from framelake.sources.annotations import container_lines

    files = spark.createDataFrame([(2, '#!MLF!#\n"b.lab"\ny\n.\n'), (1, '\n#!MLF!#\n"a.lab"\nx x\n.\n\n')], "o int, value string")
    got = container_lines(files, "o").orderBy("line_no").collect()
    assert [x["line"] for x in got] == ["#!MLF!#", '"a.lab"', "x x", ".", '"b.lab"', "y", "."]
    assert [x["line_no"] for x in got] == list(range(7))
