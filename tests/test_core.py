"""Operators, functions, sources and models on small hand-checked tables."""

import math
import random
import struct
import wave

from itertools import groupby

import numpy as np
import pytest
from pyspark.sql import functions as F


def stream(spark, values, key="a"):
    return spark.createDataFrame([(key, i, float(v)) for i, v in enumerate(values)], "k string, t int, v double")


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_decimation_and_windows(spark):
    from framelake.operators.streams import decimate, sliding_windows

    df = stream(spark, range(10))
    assert [r[2] for r in rows(decimate(df, ["k"], ["t"], 3), "t")] == [0, 3, 6, 9]
    w = sliding_windows(df, ["k"], ["t"], 4, 3)
    got = {}
    for r in w.collect():
        got.setdefault(r["window"], []).append((r["offset"], r["v"]))
    assert {k: [v for _, v in sorted(x)] for k, x in got.items()} == {0: [0, 1, 2, 3], 1: [3, 4, 5, 6], 2: [6, 7, 8, 9]}
    gaps = sliding_windows(df, ["k"], ["t"], 2, 5)
    assert sorted({(r["window"], r["v"]) for r in gaps.collect()}) == [(0, 0), (0, 1), (1, 5), (1, 6)]
    with pytest.raises(ValueError):
        decimate(df, ["k"], ["t"], 0)


def test_joins_by_position(spark):
    from framelake.operators.streams import accumulate_slots, round_robin, slot_join, uniq, zip_strict

    e = spark.createDataFrame([("s", 0, "a", 1), ("s", 1, "b", 2), ("s", 2, "a", 3), ("s", 3, "a", 4), ("s", 4, "b", 5), ("s", 5, "c", 6)], "k string, t int, tag string, v int")
    rr = round_robin(e.where("tag <> 'c'"), ["k"], "tag", ["t"])
    assert [r["v"] for r in rr.orderBy("seq").collect()] == [1, 2, 3, 5, 4]
    assert rows(slot_join(e, ["k"], "tag", ["t"], "v", ["b", "a"]), "slot") == [("s", 0, 1, 2), ("s", 1, 3, 5)]
    got = {(r["bundle"], r["tag"]): r["items"] for r in accumulate_slots(e, ["k"], "tag", "t", "v", ["a", "b"]).collect()}
    assert got == {(0, "a"): [1], (0, "b"): [2], (1, "a"): [3, 4], (1, "b"): [5]}
    assert [r["v"] for r in uniq(e, ["k"], ["t"], ["tag"]).orderBy("t").collect()] == [1, 2, 3, 5, 6]
    assert [r["v"] for r in uniq(e, ["k"], ["t"], ["tag"], "last").orderBy("t").collect()] == [1, 2, 4, 5, 6]
    with pytest.raises(Exception, match="differ in length"):
        zip_strict(stream(spark, [1, 2]), stream(spark, [1]).withColumnRenamed("v", "w").withColumnRenamed("t", "u"), ["k"], ["t"], ["u"]).collect()


def test_unknown_labels_raise(spark):
    from framelake.operators.streams import map_labels

    m = spark.createDataFrame([("x", "S")], "a string, b string")
    df = spark.createDataFrame([("x",), ("y",)], "l string")
    with pytest.raises(Exception, match="no mapping"):
        map_labels(df, "l", m, "a", "b").collect()
    assert rows(map_labels(df, "l", m, "a", "b", strict=False), "l") == [("S",)]


def test_segments_and_frames(spark):
    from framelake.operators.segments import frames_to_segments, indicator_to_timestamps, median_filter, merge_runs, segments_to_frames

    s = spark.createDataFrame([("u", 0, 0.0, 50.0, "S"), ("u", 1, 60.0, 90.0, "S"), ("u", 2, 90.0, 95.0, "N")], "utt string, seg int, a double, b double, l string")
    assert rows(merge_runs(s, ["utt"], ["seg"], "l", "a", "b"), "run") == [("u", 0, "S", 0.0, 90.0, 2), ("u", 1, "N", 90.0, 95.0, 1)]
    want, prev, last = [], 0, None
    for _, _, a, b, lab in s.orderBy("seg").collect():
        x, y = max(1, int(a / 10)), max(1, int(b / 10) - 1)
        x = max(x, prev + 1)
        y = max(y, x)
        want += [(f, lab) for f in range(x, y + 1)]
        prev, last = y, lab
    want.append((prev + 1, last))
    got = segments_to_frames(s, ["utt"], ["seg"], "a", "b", "l", 10.0)
    assert [(r["frame"], r["l"]) for r in got.orderBy("pos").collect()] == want
    i = spark.createDataFrame([("u", k + 1, v) for k, v in enumerate([1, 1, 0, 1, 0, 0, 1])], "utt string, f int, s int")
    assert rows(indicator_to_timestamps(i, ["utt"], "f", "s", 10.0, 25.0), "start") == [("u", 0.0, 22.5), ("u", 42.5, 42.5), ("u", 72.5, 60.0)]
    assert [(r["start"], r["end"], r["s"]) for r in frames_to_segments(i, ["utt"], "f", "s", 10).orderBy("run").collect()] == [(0, 20, 1), (20, 30, 0), (30, 40, 1), (40, 60, 0), (60, 70, 1)]
    r = random.Random(1)
    x = [r.randint(0, 1) for _ in range(40)]
    df = spark.createDataFrame([("u", k, v) for k, v in enumerate(x)], "utt string, f int, s int")
    for n in (5, 4):
        got = [q["smoothed"] for q in median_filter(df, ["utt"], "f", "s", n).orderBy("f").collect()]
        pad = [0] * (n // 2) + x + [0] * ((n - 1) // 2)
        assert got == [math.floor(float(np.median(pad[k : k + n])) + 0.5) for k in range(len(x))]


def test_framing(spark):
    from framelake.operators.framing import delta, delta_compat, one_pole, range_tracker, sampling_windows, signal_events, stack_frames, tag_utterances

    df = spark.createDataFrame([("u", k, [float(k), 1.0]) for k in range(5)], "utt string, f int, x array<double>")
    s = stack_frames(df, ["utt"], "f", "x", 3, 2).orderBy("f").collect()
    assert [r["stacked"] for r in s] == [[0, 0, 0, 1, 1, 1], [1, 1, 2, 1, 3, 1], [3, 1, 4, 1, 0, 0]]
    assert [r["delta"][0] for r in delta(df, ["utt"], "f", "x", 1).orderBy("f").collect()] == [0.5, 1, 1, 1, 0.5]
    v = stream(spark, [1, 2, 4, 8])
    assert [r["delta"] for r in delta_compat(v, ["k"], "t", "v", 2).orderBy("t").collect()] == [-1, -3, -6, -4]
    assert [r["smooth"] for r in one_pole(v, ["k"], "t", "v", 0.5).orderBy("t").collect()] == [1.5, 2.75, 5.375]
    assert [(r["low"], r["high"]) for r in range_tracker(stream(spark, [5, 3, 9, 9, 4]), ["k"], "t", "v", 0.0, 0.0).orderBy("t").collect()] == [(5, 5), (3, 5), (3, 5), (3, 9), (3, 9)]
    values = [20, 25, *[60] * 50, *[20] * 40, *[60] * 50, *[20] * 40]
    tags = tag_utterances(stream(spark, values), ["k"], "t", "v", *TAGGER).orderBy("t").collect()
    assert [(t, len(list(g))) for t, g in groupby(r["tag"] for r in tags)] == TAGGED
    e = spark.createDataFrame([("p", t, 1.0) for t in (0, 3, 5, 12)], "k string, ts long, v double")
    assert [(r["at"], r["n"]) for r in sampling_windows(e, ["k"], "ts", "v", 5, 5).orderBy("at").collect()] == [(0, 0), (5, 3), (10, 1)]
    ev = signal_events(stream(spark, [1, 1, 1, 1, 1, 9, 1, 1]), ["k"], "t", "v", 1.5).orderBy("t").collect()
    assert [(r["peak"], r["up"]) for r in ev] == [(False, True), (True, False), (False, False)]


#: Levels of the tagger and runs of its tags over a fixed stream; the last values stay undecided.
TAGGER = (1.0, -2.0, 10.0, 0.2, 0.6, 20, 10, 25, 15)
TAGGED = [('UTT', 55), ('BAC', 27), ('UTT', 64), ('BAC', 17), (None, 19)]


def test_det_points(spark):
    from framelake.operators.metrics import det_points

    data = [(1, 0.9), (0, 0.8), (1, 0.7), (1, 0.6), (0, 0.5), (0, 0.4)]
    df = spark.createDataFrame(data, "r int, v double")
    pts = []
    for t in sorted({v for _, v in data}, reverse=True):
        fp = 100 * sum(r == 0 and v > t for r, v in data) / 3
        miss = 100 * (1 - sum(r == 1 and v > t for r, v in data) / 3)
        pts.append((t, fp, miss))
    first = [p for k, p in enumerate(pts) if not k or p[1] != pts[k - 1][1]]
    want = [p for k, p in enumerate(first) if k + 1 == len(first) or p[2] != first[k + 1][2]]
    got = rows(det_points(df, F.col("r") == 1, "v"), F.desc("threshold"))
    assert [tuple(np.round(g, 9)) for g in got] == [tuple(np.round(w, 9)) for w in want]


def test_log_spaced_sums(spark):
    from framelake.operators.metrics import log_spaced_sums

    got = {r["bit"]: (r["n"], r["sum"]) for r in log_spaced_sums(stream(spark, range(1, 7)), ["k"], "t", "v").collect()}
    assert got == {2: (4, 10.0), 1: (2, 11.0)}


def test_functions(spark):
    from framelake.functions import dsp
    from framelake.functions.alignment import best_alignments, edit_path

    one = spark.range(1).select(F.lit(12).cast("long").alias("n"), dsp.doubles([3, 4]).alias("x"))
    r = one.select(dsp.factors(F.col("n")), dsp.prime_factors(F.col("n")), dsp.power_of_two(F.col("n")), dsp.distance(F.col("x"), dsp.doubles([0, 0])), dsp.bit_fields(F.lit(0b10110).cast("long"), [2, 3]), dsp.cumulative_index(dsp.doubles([0.2, 0.3, 0.5]), F.lit(0.4)), dsp.log_sum_exp(F.col("x")), dsp.hz_to_mel(F.lit(1000.0))).first()
    assert r[0] == [1, 2, 3, 4, 6, 12] and r[1] == [2, 3] and r[2] == 16 and r[3] == 5 and r[4] == [2, 6] and r[5] == 1
    assert r[6] == pytest.approx(math.log(math.exp(3) + math.exp(4))) and r[7] == pytest.approx(999.99, abs=0.1)
    got = spark.createDataFrame([([1.0, 2.0, 3.0],)], "x array<double>").select(dsp.spectrum()("x")).first()[0]
    assert np.allclose(got, np.abs(np.fft.rfft([1, 2, 3, 0])))
    assert len(spark.createDataFrame([([float(i % 7) for i in range(400)],)], "x array<double>").select(dsp.cepstra(16000.0, 512)("x")).first()[0]) == 12
    cost, pairs = edit_path("kitten", "sitting")
    assert cost == 3 and "".join(a or "" for a, _ in pairs) == "kitten" and "".join(b or "" for _, b in pairs) == "sitting"
    assert edit_path("bc", "abcd", substring=True)[0] == 0
    best = best_alignments("ab", "b", 3)
    assert [c for c, _ in best] == sorted(c for c, _ in best) and best[0][0] == 1


def test_feature_files(spark, tmp_path):
    from framelake.sources import feature_files as ff

    m = np.arange(12, dtype="f4").reshape(4, 3)
    assert ff.kind_name(ff.kind_code("MFCC_D_A_0")) == "MFCC_D_A_0"
    assert (ff.decode(ff.encode(m, 100000, 9))[0] == m).all()
    little = struct.pack("<IIHH", 4, 100000, 12, 9) + m.astype("<f4").tobytes()
    assert (ff.decode(little)[0] == m).all()
    a, b = np.array([100.0, 10.0], ">f4"), np.array([5.0, 6.0], ">f4")
    packed = struct.pack(">IIHH", 2 + 4, 1, 4, 6 | ff.QUALIFIERS["C"]) + a.tobytes() + b.tobytes() + np.array([[95, 4], [195, 14]], ">i2").tobytes()
    assert np.allclose(ff.decode(packed)[0], [[1, 1], [2, 2]])
    df = spark.createDataFrame([(u, k, [float(k), 1.5]) for u in ("a", "b") for k in range(3)], "utt string, frame int, features array<double>")
    assert ff.write_features(ff.encoded_files(df), str(tmp_path / "f")).count() == 2
    back = ff.read_features(spark, f"file://{tmp_path}/f")
    assert [(r["utt"], r["frame"], r["features"]) for r in back.orderBy("utt", "frame").collect()] == [(u, k + 1, [float(k), 1.5]) for u in ("a", "b") for k in range(3)]
    assert [r["samples"] for r in ff.read_headers(spark, f"file://{tmp_path}/f").collect()] == [3, 3]
    with wave.open(str(tmp_path / "x.wav"), "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(2)
        w.setframerate(8000)
        w.writeframes(np.array([[0, 16384], [-16384, 0]], "<i2").tobytes())
    assert [r["samples"] for r in ff.read_wav(spark, f"file://{tmp_path}/x.wav").orderBy("channel").collect()] == [[0, -0.5], [0.5, 0]]


def test_annotations(spark, tmp_path):
    from framelake.sources import annotations as an

    (tmp_path / "a.tab").write_text("# note\nf 1 0.0 1.5 S\n\nf 1 1.5 2.0 S\nf 1 2.0 3.0 NT\n")
    got = an.annotations(an.lines(spark, f"file://{tmp_path}/a.tab"))
    m = spark.createDataFrame([("S", "S"), ("NT", "NS")], "s string, t string")
    assert rows(an.merged_annotations(got, m, "s", "t"), "seg") == [("a", 0, 0, 20000000, "S"), ("a", 1, 20000000, 30000000, "NS")]
    (tmp_path / "b.mlf").write_text('#!MLF!#\n"*/x.lab"\n0 10 S -1.5\n10 20 N\n.\n"*/y.lab"\nS\n.\n')
    blocks = an.label_blocks(spark, f"file://{tmp_path}/b.mlf")
    assert rows(blocks, "name", "seg") == [("*/x.lab", 0, 0, 10, "S", -1.5), ("*/x.lab", 1, 10, 20, "N", None), ("*/y.lab", 0, None, None, "S", None)]
    assert rows(an.label_lines(blocks.where("start_100ns is not null").withColumnRenamed("name", "utt")), "utt") == [("*/x.lab", "0 10 S\n10 20 N")]
    (tmp_path / "t.trs").write_text('<Trans><Turn speaker="p" startTime="0" endTime="2.5">hello\n there</Turn></Trans>')
    assert rows(an.transcript_turns(spark, f"file://{tmp_path}/t.trs"), "file") == [("t", "p", 0.0, 2.5, "hello there")]


def test_model_files(spark, tmp_path):
    from framelake.models.gaussian import Mixture
    from framelake.models.language import cost, parse_arpa
    from framelake.sources import model_files as mf

    g = Mixture([0.25, 0.75], [[1.0, 2.0], [3.0, 4.0]], [[1.0, 1.0], [2.0, 2.0]])
    back = mf.parse_macros(mf.macro_text({"S": g, "N": g}))
    assert back["S"]["states"][2] == g and back["N"]["trans"][1][:2] == [0, 0.9]
    x = mf.parse_xml("<gmms><gmm><mixture><weight>1</weight><mean>0 1</mean><covariance type='diag'>1 2</covariance></mixture><mixture><weight>3</weight><mean>2 3</mean><covariance type='diag'>1 1</covariance></mixture></gmm></gmms>")
    assert x == [Mixture([0.25, 0.75], [[0, 1], [2, 3]], [[1, 2], [1, 1]])]
    mf.write_models(spark, {"S": g}, f"file://{tmp_path}/m")
    assert mf.read_models(spark, f"file://{tmp_path}/m") == {"S": g}
    lm = {k: (c, b) for k, _, c, b in parse_arpa("\\data\\\n\\1-grams:\n-1.0 a -0.5\n-2.0 b\n\\2-grams:\n-0.3 a b\n\\end\\\n")}
    ten = math.log(10)
    assert cost(lm, ["a"], "b") == pytest.approx(0.3 * ten) and cost(lm, ["a"], "a") == pytest.approx(1.5 * ten) and cost(lm, [], "q") == math.inf


def test_mixture_training(spark):
    from framelake.models.gaussian import Mixture, fit_mixture, grow_mixture, one_gaussian, score_mixtures

    true = Mixture([0.3, 0.7], [[0.0, 0.0], [4.0, 4.0]], [[1.0, 0.5], [0.5, 1.0]])
    df = spark.createDataFrame([(x.tolist(),) for x in true.sample(1500, 1)], "x array<double>").repartition(3)
    model, trace = fit_mixture(df, "x", Mixture([0.5, 0.5], [[-1.0, 0.0], [1.0, 1.0]], [[1.0, 1.0]] * 2), 12)
    assert all(b >= a - 1e-6 for a, b in zip(trace, trace[1:]))
    assert np.allclose(sorted(model.weights), [0.3, 0.7], atol=0.05) and np.allclose(sorted(m[0] for m in model.means), [0, 4], atol=0.2)
    assert np.allclose(model.posteriors([[0, 0], [1e6, 1e6]]).sum(axis=1), 1)
    grown = grow_mixture(df, "x", one_gaussian(df, "x"), 2, 6)
    x = np.array([r[0] for r in df.collect()])
    assert grown.log_prob(x).sum() > one_gaussian(df, "x").log_prob(x).sum()
    full, up = fit_mixture(df, "x", Mixture([1.0], [[0.0, 0.0]], [np.eye(2).tolist()], "full"), 2)
    assert np.allclose(full.covs[0], np.cov(x.T, bias=True), atol=1e-6) and up[1] > up[0]
    assert score_mixtures(df, "x", {"a": true, "b": model}).first()["scores"][0]["label"] == "a"


def test_hidden_markov(spark):
    from framelake.models import hidden as h
    from framelake.models.gaussian import Mixture

    rng = np.random.default_rng(3)
    states = [Mixture([1.0], [[m]], [[1.0]]) for m in (-2.0, 2.0)]
    hmm = h.ergodic(states)
    path = np.repeat([0, 1, 0, 1], 15)
    data = [("u%d" % u, t, [float(x)]) for u in range(3) for t, x in enumerate(np.where(path == 0, -2, 2) + rng.standard_normal(60))]
    df = spark.createDataFrame(data, "utt string, t int, x array<double>")
    got = h.decode_utterances(df, ["utt"], "t", "x", hmm).where("utt = 'u0'").orderBy("t").collect()
    assert np.mean(np.array([r["state"] for r in got]) == path) > 0.95
    emit = hmm.emissions(np.array([x for u, _, x in data if u == "u0"]))
    start, trans, stop = hmm.logs()
    score, best = h.viterbi(start, trans, stop, emit)
    total, post, _ = h.forward_backward(hmm, emit)
    assert np.allclose(post.sum(axis=1), 1) and total >= score
    for _ in range(20):
        p = rng.integers(0, 2, 60)
        assert start[p[0]] + emit[range(60), p].sum() + trans[p[:-1], p[1:]].sum() + stop[p[-1]] <= score + 1e-9
    assert h.beam_decode(start, trans, stop, emit, 1e9)[0] == pytest.approx(score)
    model, last = hmm, -math.inf
    for _ in range(3):
        model, loglik = h.train_step(df, ["utt"], "t", "x", model)
        assert loglik >= last - 1e-6
        last = loglik


def test_kmeans_and_pca(spark):
    from framelake.models import neighbours as nb

    rng = np.random.default_rng(4)
    x = np.concatenate([rng.standard_normal((50, 2)), 6 + rng.standard_normal((50, 2))])
    df = spark.createDataFrame([(v.tolist(),) for v in x], "x array<double>")
    c = nb.kmeans(df, "x", [[0.0, 1.0], [1.0, 0.0], [100.0, 100.0]], 20)
    assert c[2] == [100.0, 100.0]
    mean, cov = nb.covariance(df, "x")
    assert np.allclose(mean, x.mean(axis=0)) and np.allclose(cov, np.cov(x.T, bias=True))
    values, _ = nb.principal_components(df, "x", 1)
    assert values[0] == pytest.approx(np.linalg.eigvalsh(cov)[-1])
    noise, w = nb.probabilistic_pca(df, "x", 1)
    assert np.allclose(w @ w.T + noise * np.eye(2), cov)
    white = x @ np.array(nb.whitening(df, "x")).T
    assert np.allclose(np.cov(white.T, bias=True), np.eye(2), atol=1e-6)


def test_graphs_and_grammars(spark):
    from framelake.graphs import grammar as g
    from framelake.graphs import orders
    from framelake.graphs import tables as t

    cyc = spark.createDataFrame([(0, 1, "a"), (1, 0, "b")], "src long, dst long, label string")
    with pytest.raises(ValueError):
        orders.topological_depth(cyc)
    p = t.predicates(t.degrees(cyc.select(F.explode(F.array("src", "dst")).alias("id")).distinct(), cyc).select("id"), cyc).first()
    assert p["cycle"] and not p["lattice"] and p["connected"] and not p["self_loop"]
    k4 = spark.createDataFrame([(i, j) for i in range(4) for j in range(i)] + [(3, 0), (5, 5)], "u long, v long")
    assert tuple(t.invariants(k4).first()) == (6, 4, 3, 4, 6)
    gram = {"S": {("S", "+", "T"), ("T",)}, "T": {("x",), ("E", "x")}, "E": {()}}
    assert g.nullable(gram) == {"E"}
    for h in (gram, g.without_empty(gram, "S"), g.without_left_recursion(gram), g.left_factored(gram)):
        assert g.recognises(h, "S", "x + x".split()) and g.recognises(h, "S", ["x"])
        assert not g.recognises(h, "S", "x +".split()) and not g.recognises(h, "S", [])


GRAMMARS = """
import itertools, sys
from framelake.graphs import grammar as g

def derived(gram, most):
    \"\"\"Strings of each symbol up to a length, by repeated substitution.\"\"\"
    said = {a: set() for a in gram}
    while True:
        more = {a: set(v) for a, v in said.items()}
        for a, alts in gram.items():
            for alt in alts:
                lines = {()}
                for s in alt:
                    lines = {x + y for x in lines for y in (said[s] if s in gram else {(s,)}) if len(x + y) <= most}
                more[a] |= lines
        if more == said:
            return said
        said = more

cases = [
    {"S": {("S", "+", "T"), ("T",)}, "T": {("x",), ("E", "x")}, "E": {()}},
    {"S": {("A", "S"), ("b",)}, "A": {("S", "A"), ("a",)}},
    {"S": {("A", "B")}, "A": {(), ("a", "A"), ("B",)}, "B": {(), ("b",), ("A",)}},
    {"S": {("S", "S"), ("a",), ()}},
    {"S": {("a", "S", "b"), ("a", "b"), ("a", "c")}},
    {"S": {("T", "S", "T"), ("x",)}, "T": {("T", "T"), ("y",), ()}},
]
for gram in cases:
    want = derived(gram, 4)["S"]
    marks = sorted({s for alts in gram.values() for alt in alts for s in alt if s not in gram})
    for form in (gram, g.without_empty(gram, "S"), g.left_factored(gram)):
        for n in range(5):
            for line in itertools.product(marks, repeat=n):
                assert g.recognises(form, "S", line) == (line in want), (form, line)
assert g.recognises(g.without_left_recursion(cases[0]), "S", "x + x".split())
"""


@pytest.mark.parametrize("seed", range(4))
def test_recognition_does_not_depend_on_the_hash_seed(seed):
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", GRAMMARS], check=True, timeout=120, cwd=root, env=os.environ | {"PYTHONHASHSEED": str(seed), "PYTHONPATH": root})


def test_streaming(spark, tmp_path):
    from framelake.streaming import stateful as st

    schema = "user string, ts timestamp, seq long, tag string, value double"
    for part in range(2):
        data = [("u", f"2024-01-01 00:00:{10 * part + k:02d}", 10 * part + k, "ab"[k % 2], float(10 * part + k)) for k in range(5)]
        df = spark.createDataFrame(data, "user string, ts string, seq long, tag string, value double").withColumn("ts", F.to_timestamp("ts"))
        df.coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")

    def run(df, name, mode="append"):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"file://{tmp_path}/{name}").start()
        q.awaitTermination(120)
        return spark.table(name).collect()

    src = lambda: st.replay(spark, f"file://{tmp_path}/in", schema)
    bundles = run(st.slot_bundles(src(), "user", "tag", "value", ["b", "a"]), "bundles")
    assert len(bundles) == 4 and all(len(r["bundle"]) == 2 for r in bundles)
    windows = run(st.event_windows(src(), "ts", "10 seconds", "5 seconds", "1 minute", "tag"), "windows", "complete")
    assert sum(r["n"] for r in windows) == 20
    q = st.adapt_models(src().withColumn("x", F.array("value")), "tag", "x", f"file://{tmp_path}/adapted", 4.0, ["seq"]).trigger(availableNow=True).option("checkpointLocation", f"file://{tmp_path}/models").start()
    q.awaitTermination(120)
    scored = {r["seq"]: r for r in spark.read.parquet(f"file://{tmp_path}/adapted/scored").collect()}
    assert len(scored) == 10 and all(scored[k]["hyp"] is None for k in range(5)) and all(scored[k]["hyp"] in ("a", "b") for k in range(10, 15))
    first = {"a": [0.0, 2.0, 4.0], "b": [1.0, 3.0]}
    second = {"a": [10.0, 12.0, 14.0], "b": [11.0, 13.0]}
    models = {r["label"] if "label" in r else r["tag"]: r for r in spark.read.parquet(f"file://{tmp_path}/adapted/models").where("epoch = 1").collect()}
    for k in "ab":
        f = len(second[k]) / (len(second[k]) + 4.0)
        assert models[k]["n"] == len(first[k]) + len(second[k])
        assert models[k]["mean"][0] == pytest.approx(f * np.mean(second[k]) + (1 - f) * np.mean(first[k]))
        assert models[k]["var"][0] == pytest.approx(f * np.var(second[k]) + (1 - f) * np.var(first[k]))
    acc = st.adapted_accuracy(spark, f"file://{tmp_path}/adapted", "tag").collect()
    assert [(r["epoch"], r["n"]) for r in acc] == [(1, 5)]


def test_streamed_tags_are_those_of_the_whole(spark, tmp_path):
    from framelake.operators.framing import tag_utterances
    from framelake.streaming import stateful as st

    values = [20, 25, *[60] * 50, *[20] * 40, *[60] * 50, *[20] * 40]
    source = st.PushSource(spark, f"file://{tmp_path}/pushed", "k string, t long, v double")
    with pytest.raises(RuntimeError):
        source.push([("u", 0, 1.0)])
    source.start()
    rows = [("u", t, float(v)) for t, v in enumerate(values)]
    for lo in range(0, len(rows), 37):
        if lo == 37:
            source.pause()
        source.push(rows[lo : lo + 37])
        if lo == 37:
            source.start()
    q = st.collect_stream(st.utterance_tags(source.stream(), "k", "t", "v", *TAGGER), "pushed_tags", f"file://{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r["t"]: r["tag"] for r in spark.table("pushed_tags").collect()}
    whole = {r["t"]: r["tag"] for r in tag_utterances(spark.createDataFrame(rows, "k string, t long, v double"), ["k"], "t", "v", *TAGGER).collect()}
    assert got == {t: tag for t, tag in whole.items() if tag}
    seen, figures = st.watch(spark.createDataFrame(rows, "k string, t long, v double"), "figures", F.count(F.lit(1)).alias("n"), F.max("v").alias("top"))
    assert seen.count() == 182 and figures.get == {"n": 182, "top": 60.0}
    source.done()
    with pytest.raises(RuntimeError):
        source.start()


def test_sets_of_models_are_trained_in_order(spark):
    from framelake.models import gaussian as g
    from framelake.models import hidden as h

    rng = np.random.default_rng(8)
    rows = [(u, t, "ab"[u % 2], (rng.normal(3 * (u % 2) + (t // 10 % 2), 0.3, 2)).tolist()) for u in range(12) for t in range(40)]
    df = spark.createDataFrame(rows, "utt long, frame long, label string, x array<double>").persist()
    start = g.one_gaussian_classes(df, "label", "x")
    for k in "ab":
        x = np.array([r[3] for r in rows if r[2] == k])
        assert np.allclose(start[k].means[0], x.mean(axis=0)) and np.allclose(start[k].covs[0], x.var(axis=0))
    whole = g.MixtureSet({k: m.split(2) for k, m in start.items()})
    with pytest.raises(RuntimeError):
        whole.accumulate(df, "label", "x")
    halves = g.MixtureSet(whole.models)
    for s, parts in ((whole, [df]), (halves, [df.where("utt < 5"), df.where("utt >= 5")])):
        s.begin()
        for part in parts:
            s.accumulate(part, "label", "x")
        before = s.apply()
    for k in "ab":  # sums of parts are those of the whole, and equal a step of the class alone
        alone, loglik, n = g.em_step(df.where(F.col("label") == k), "x", start[k].split(2))
        for m in (whole.models[k], halves.models[k]):
            assert np.allclose(m.means, alone.means) and np.allclose(m.covs, alone.covs) and np.allclose(m.weights, alone.weights)
        assert before[k] == pytest.approx(loglik) and n == 240
    found = g.initial_classes(df, "label", "x", 2, 5)
    assert all(sorted(round(c[0]) for c in found[k].means) == [3 * i, 3 * i + 1] for i, k in enumerate("ab"))
    grown = g.train_classes(df, "label", "x", 4, 2)
    assert all(m.size == 4 for m in grown.values())
    hmms = h.train_classes(df, ["utt"], "frame", "x", "label", 2, 2, 1)
    with pytest.raises(RuntimeError):
        hmms.apply()
    assert {r["utt"]: r["hyp"] for r in hmms.classify(df, ["utt"], "frame", "x").collect()} == {u: "ab"[u % 2] for u in range(12)}
    trace = hmms.train(df, ["utt"], "frame", "x", "label", 2)
    assert all(trace[1][k] >= trace[0][k] - 1e-6 for k in "ab")
    one = h.train_step(df.where("label = 'a'"), ["utt"], "frame", "x", hmms.hmms["a"])
    assert np.isfinite(one[1]) and sum(one[0].start) == pytest.approx(1)
    df.unpersist()


def test_toolbox(spark, tmp_path):
    from framelake.models import toolbox as tb
    from framelake.models.gaussian import Mixture

    models = {"a": Mixture([1.0], [[0.0, 0.0]], [[1.0, 1.0]]), "b": Mixture([1.0], [[4.0, 0.0]], [[1.0, 1.0]])}
    df = tb.labelled_segments(spark, models, 6, 4, 20).withColumn("y", (F.col("label") == "b").cast("double")).persist()
    assert df.count() == 480
    rows = df.collect()
    x, y = np.array([r["x"] for r in rows]), np.array([r["y"] for r in rows])
    w = tb.logistic_fit(df, "x", "y")
    assert np.mean((np.c_[x, np.ones(len(x))] @ w > 0) == y) > 0.95
    assert np.allclose(tb.linear_fit(df, "x", "y"), np.linalg.lstsq(np.c_[x, np.ones(len(x))], y, rcond=None)[0], atol=1e-6)
    r = tb.radial_fit(df, "x", "y", [[0, 0], [4, 0]], 2.0)
    assert r[1] > r[0]
    a = tb.discriminant_transform(df, "label", "x", 1, 5)
    assert tb.transform_likelihood(df, "label", "x", a, 1) >= tb.transform_likelihood(df, "label", "x", np.eye(2), 1)
    assert tb.organising_map(df, "x", 3, 3).shape == (9, 2)
    best = tb.minimise(lambda p: (p[0] - 3) ** 2 + 10 * (p[1] + 1) ** 2, lambda p: np.array([2 * (p[0] - 3), 20 * (p[1] + 1)]), [0.0, 0.0])
    assert np.allclose(best, [3, -1], atol=1e-5)
    normal = lambda p: -0.5 * float(p @ p)
    for s in (tb.metropolis(normal, [0.0], 4000, 1.5), tb.hamiltonian(normal, lambda p: -p, [0.0], 1500, 0.3)):
        assert abs(s.mean()) < 0.2 and abs(s.var() - 1) < 0.25
    mean, var = tb.regress_process([[0.0], [1.0], [2.0]], [0.0, 1.0, 0.0], [[1.0], [9.0]], 0.7, 1e-4)
    assert mean[0] == pytest.approx(1, abs=0.01) and abs(mean[1]) < 0.01 and var[1] > var[0]
    rng = np.random.default_rng(5)
    power = rng.exponential(1, (60, 16))
    power[30:] *= 20
    ratio = tb.activity_ratio(power.tolist())
    assert np.mean(ratio[35:]) > 5 * max(np.mean(ratio[6:30]), 0.01)
    from framelake.sources import sinks

    seg = spark.createDataFrame([("u", 0, 15000000, "S")], "utt string, start_100ns long, end_100ns long, label string")
    assert sinks.result_xml(seg).first()["value"] == '<file name="u">\n  <segment start="0.00" end="1.50" label="S"/>\n</file>'
    assert sinks.config_text({"A": 1, "B": True}) == "A = 1\nB = T\n"


def test_best_paths_raises_where_paths_are_left(spark):
    from framelake.graphs import tables as t

    chain = spark.createDataFrame([(i, i + 1, 1.0) for i in range(4)], "src long, dst long, cost double")
    assert t.best_paths(chain, 0, 4, 2, most=5).first()["path"] == [0, 1, 2, 3, 4]
    with pytest.raises(RuntimeError):
        t.best_paths(chain, 0, 4, 2, most=4)


SPECS = """
CEPLIFTER      = 22
ENORMALISE     = FALSE
# ESCALE       = 1.0
HIFREQ         = 3800
LOFREQ         = 125
NUMCHANS       24
SOURCEKIND     = WAVEFORM
TARGETKIND     = MFCC_0
TARGETRATE     = 100000
USEPOWER       = TRUE
WINDOWSIZE     = 250000.0
ZMEANSOURCE    = T
SAVEWITHCRC    = FALSE
"""


def test_extraction_specs():
    from framelake.functions import extraction as e

    specs = e.parse_specs(SPECS)
    assert specs["NUMCHANS"] == 24 and specs["WINDOWSIZE"] == 250000.0 and specs["ZMEANSOURCE"] is True and "ESCALE" not in specs
    chain = e.Chain({**specs, "SOURCERATE": 226.757}, 1e7 / 226.757)
    assert (chain.slide, chain.window, chain.n_fft) == (441, 1102, 2048)
    assert chain.features(np.sin(np.arange(100_000) / 9)).shape == (225, 13)
    assert e.Chain({**e.MANDATORY, "TARGETKIND": "MFCC", "TARGETRATE": 100000.0}, 44100).window == 1129
    for bad in ({"Foobar": 1}, {"TRACE": 3}, {"TARGETKIND": "MFCC_D_S"}, {"TARGETKIND": "LPC"}, {"TARGETKIND": "MFCC_A"}, {"TARGETKIND": None}, {"SOURCEKIND": None}):
        with pytest.raises(ValueError):
            e.Chain({**e.MANDATORY, "TARGETKIND": "MFCC", "TARGETRATE": 100000.0, **bad}, 16000)
    with pytest.raises(ValueError):
        e.parse_specs("A = 1 2")
    assert e.extraction_specs("PLP_0_D_A", 39)["NUMCEPS"] == 12 and e.extraction_specs("MFCC_D", 24)["NUMCEPS"] == 12


def test_extraction_equals_sums_written_out(spark):
    from framelake.functions import dsp
    from framelake.functions import extraction as e

    rng = np.random.default_rng(9)
    x = rng.standard_normal(700)
    specs = {**e.MANDATORY, "TARGETKIND": "MFCC_0_E_D_A", "TARGETRATE": 100000, "WINDOWSIZE": 250000, "NUMCHANS": 10, "NUMCEPS": 5, "ZMEANSOURCE": True}
    got = e.Chain(specs, 8000).features(x)
    y = [x[1] - 0.97 * x[0]] + [x[i] - 0.97 * x[i - 1] for i in range(1, 700)]
    bank, statics = dsp.mel_filters(10, 129, 8000, 0.0, 4000.0), []
    for start in range(0, 700 - 200 + 1, 80):
        w = y[start : start + 200]
        mean = sum(w) / 200
        w = [(v - mean) * (0.54 - 0.46 * math.cos(2 * math.pi * i / 199)) for i, v in enumerate(w)]
        mag = [abs(sum(v * complex(math.cos(2 * math.pi * k * i / 256), -math.sin(2 * math.pi * k * i / 256)) for i, v in enumerate(w))) for k in range(129)]
        logs = [math.log(max(sum(a * b for a, b in zip(f, mag)), 1e-10)) for f in bank]
        c = [math.sqrt(2 / 10) * sum(v * math.cos(math.pi / 10 * n * (k + 0.5)) for k, v in enumerate(logs)) for n in range(6)]
        energy = math.log(sum(v * v for v in x[start : start + 200]))
        statics.append([c[n] * (1 + 11 * math.sin(math.pi * n / 22)) for n in range(1, 6)] + [c[0], energy])
    at = lambda rows, t: rows[min(max(t, 0), len(rows) - 1)]
    slope = lambda rows: [[sum(k * (at(rows, t + k)[j] - at(rows, t - k)[j]) for k in (1, 2)) / 10 for j in range(7)] for t in range(len(rows))]
    d = slope(statics)
    want = np.concatenate([statics, d, slope(d)], axis=1)
    zero = got[:, 5] / want[:, 5]  # C0 by the scale of the transform's first row
    assert got.shape == want.shape and np.allclose(zero, zero[0])
    keep = [j for j in range(21) if j % 7 != 5]
    assert np.allclose(got[:, keep], want[:, keep], atol=1e-8)
    df = spark.createDataFrame([("a", 8000, 0, x.tolist()), ("a", 8000, 1, (2 * x).tolist()), ("b", 8000, 0, [0.0] * 10)], "path string, rate int, channel int, samples array<double>")
    rows_ = e.extract(df, specs).orderBy("frame").collect()
    assert np.allclose([r["features"] for r in rows_], got) and {r["path"] for r in rows_} == {"a"}
    right = e.extract(df, {**specs, "STEREOMODE": "RIGHT", "ADDDITHER": 0.001})
    assert [r["features"] for r in right.orderBy("frame").collect()] == [r["features"] for r in right.orderBy("frame").collect()]


def test_linear_prediction_finds_a_known_process():
    from framelake.functions import extraction as e

    rng = np.random.default_rng(10)
    a = np.array([-1.2, 0.7, -0.2])
    x = np.zeros(60_000)
    noise = rng.standard_normal(60_000)
    for t in range(3, 60_000):
        x[t] = noise[t] - a @ x[t - 3 : t][::-1]
    r = np.array([[x[: len(x) - k] @ x[k:] / len(x) for k in range(4)]])
    got, gain = e.linear_prediction(r, 3)
    solved = np.linalg.solve([[r[0, abs(i - j)] for j in range(3)] for i in range(3)], -r[0, 1:])
    assert np.allclose(got[0], solved) and np.allclose(got[0], a, atol=0.03) and gain[0] == pytest.approx(1, abs=0.05)
    # cepstra of the all-pole model are the coefficients of the logarithm of its spectrum
    chain = e.Chain({**e.plp_specs(), "CEPLIFTER": 0}, 16000)
    mel = rng.uniform(1, 9, (3, 24))
    c, zero = chain._predicted(mel)
    heard = (mel * chain.loudness) ** 0.33
    heard = np.concatenate([heard[:, :1], heard, heard[:, -1:]], axis=1)
    full = np.concatenate([heard, heard[:, -2:0:-1]], axis=1)
    lpc, g = e.linear_prediction(np.fft.ifft(full, axis=1).real[:, :13], 12)
    model = np.abs(np.fft.fft(np.concatenate([np.ones((3, 1)), lpc], axis=1), 4096, axis=1)) ** -2
    logs = np.fft.ifft(np.log(model), axis=1).real
    assert np.allclose(logs[:, 1:13], c, atol=1e-6)
    assert np.allclose(zero, np.log(g))


def test_text_data(spark, tmp_path):
    from framelake.sources import text_data as t

    rows_ = [["a", "b c", ""], ["#x", "50%", "tab\there"], ["é"], ["__textdata__version"]]
    text = t.text_data(rows_, "kind", "2")
    assert text.startswith("__textdata__version 1\n__textdata__comment_prefix #\n__textdata__escape_char %\n__textdata__file_type kind\n")
    head, got = t.parse_text_data("\n\n" + text.replace("\na ", "\n# a comment\n\n  a  ") + "after the end\n", "kind", "2")
    assert got == rows_ and head["file_version"] == "2"
    assert t.parse_text_data("a %41\n; b\n", header=False, comment=";")[1] == [["a", "A"]]
    for bad in ("a b\n", text.replace("version 1", "version 2"), text.replace("%", "''"), text.replace("__textdata__end_of_header\n", ""), text.replace("tab%09", "tab%0"), text.replace("kind", "a b")):
        with pytest.raises(ValueError):
            t.parse_text_data(bad, "kind")
    with pytest.raises(ValueError):
        t.text_data([["\0"]])
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"file://{tmp_path}/td")
    assert [r["tokens"] for r in t.read_text_data(spark, f"file://{tmp_path}/td", "kind").orderBy("row").collect()] == rows_
    a = spark.createDataFrame([("f", 3, " x  1 "), ("f", 5, "y\t2")], "file string, line_no int, line string")
    b = spark.createDataFrame([("g", 1, "p"), ("g", 2, "q"), ("g", 3, "r")], "file string, line_no int, line string")
    assert [r["line"] for r in t.normalised(a).orderBy("line_no").collect()] == ["x 1", "y 2"]
    assert [(r["source"], r["line_no"]) for r in t.chained(a, b).orderBy("source", "line_no").collect()] == [(0, 3), (0, 5), (1, 1), (1, 2), (1, 3)]
    assert [r["lines"] for r in t.zipped([a, b]).orderBy("row").collect()] == [[" x  1 ", "p"], ["y\t2", "q"]]
    assert {r["key"]: r["values"] for r in t.keyed(a).collect()} == {"x": ["1"], "y": ["2"]}
    with pytest.raises(Exception, match="comes twice"):
        t.keyed(a.union(a)).collect()
    spark.createDataFrame([('<all><corpus id="1"><name>First</name><year> 1999 </year></corpus><corpus id="2"/></all>',)], "value string").coalesce(1).write.text(f"file://{tmp_path}/cat")
    assert [r["fields"] for r in t.catalogue(spark, f"file://{tmp_path}/cat").orderBy("entry").collect()] == [{"id": "1", "name": "First", "year": "1999"}, {"id": "2"}]


def test_sphere_files(spark, tmp_path):
    from framelake.sources import feature_files as ff

    def file(fields, data):
        head = "NIST_1A\n   1024\n" + "".join(f"{k} {t} {v}\n" for k, t, v in fields) + "end_head\n"
        return head.encode().ljust(1024) + data

    x = np.arange(-800, 800, 2, dtype="<i2").reshape(-1, 2)
    common = [("sample_rate", "-i", 100), ("channel_count", "-i", 2), ("sample_n_bytes", "-i", 2), ("sample_count", "-i", 400)]
    (tmp_path / "little.sph").write_bytes(file([*common, ("sample_byte_format", "-s2", "01")], x.tobytes()))
    (tmp_path / "big.sph").write_bytes(file([*common, ("sample_byte_format", "-s2", "10")], x.astype(">i2").tobytes()))
    for name in ("little", "big"):
        got = {r["channel"]: r for r in ff.read_sphere(spark, f"file://{tmp_path}/{name}.sph", 1.0, 3.0).collect()}
        assert got[1]["rate"] == 100 and np.allclose(got[1]["samples"], x[100:300, 1] / 32768)
    head, y = ff.parse_sphere(file([("sample_coding", "-s4", "ulaw"), ("sample_n_bytes", "-i", 1)], bytes([0xFF, 0x7F, 0x80, 0x00, 0xF0])))
    assert (y[:, 0] * 32768).tolist() == [0, 0, 32124, -32124, 120]
    with pytest.raises(ValueError):
        ff.parse_sphere(file([("sample_coding", "-s26", "pcm,embedded-shorten-v2.00")], b""))
    with pytest.raises(ValueError):
        ff.parse_sphere(b"RIFF" + bytes(2000))


def test_containers_join_and_results_are_escaped(spark):
    from framelake.sources import annotations, sinks

    parts = spark.createDataFrame([(1, '#!MLF!#\n"*/b.lab"\n0 5 x\n.\n'), (0, '#!MLF!#\n"*/a.lab"\n0 5 y\n.\n')], "k int, value string")
    whole = annotations.joined_containers(parts, "k")
    assert whole.first()["value"].count("#!MLF!#") == 1
    assert [(r["name"], r["label"]) for r in annotations.label_blocks_of(whole).orderBy("name").collect()] == [("*/a.lab", "y"), ("*/b.lab", "x")]
    seg = spark.createDataFrame([('u"', 0, 10000000, "<S&T>")], "utt string, start_100ns long, end_100ns long, label string")
    assert sinks.result_xml(seg).first()["value"] == '<file name="u&quot;">\n  <segment start="0.00" end="1.00" label="&lt;S&amp;T&gt;"/>\n</file>'


def test_composition_reaches_what_paths_reach(spark):
    from framelake.graphs import tables as t

    kind = "src long, dst long, ilabel string, olabel string"
    a = spark.createDataFrame([(0, 1, "x", "p"), (1, 2, "y", ""), (2, 0, "z", "q"), (9, 8, "x", "p")], kind)
    b = spark.createDataFrame([(0, 0, "p", "P"), (0, 1, "", "E"), (1, 1, "q", "Q")], kind)
    got = {tuple(r) for r in t.compose_reachable(a, b, (0, 0), "").select("s1", "s2", "d1", "d2", "ilabel", "olabel").collect()}
    want = {(0, 0, 1, 0, "x", "P"), (0, 0, 0, 1, "", "E"), (1, 0, 2, 0, "y", ""), (1, 0, 1, 1, "", "E"), (2, 0, 2, 1, "", "E"), (1, 1, 2, 1, "y", ""), (2, 1, 0, 1, "z", "Q")}
    assert got == want
    core = t.cyclic_core(spark.createDataFrame([(0, 1), (1, 2), (2, 1), (2, 3), (4, 4)], "src long, dst long"))
    assert {tuple(r) for r in core.collect()} == {(1, 2), (2, 1)}
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 99), (101, 99)], "src long, dst long")
    assert {r["id"]: r["component"] for r in t.components(chain).collect()} == {**{i: 0 for i in range(41)}, 99: 99, 100: 99, 101: 99}


def _generated_last(df):
    """Whether rows that are exploded are not sent afterwards."""
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    return 0 <= plan.rfind("Generate") < plan.find("Exchange")


def test_samples_are_made_last_and_null_keys_hold_nothing(spark):
    from framelake.operators.framing import sampling_windows

    rows = [("a", 0, 1.0), ("a", 0, 2.0), ("a", 7, None), ("a", 95, 4.0), ("a", 100, 8.0), ("b", 5, 1.0), (None, 0, 1.0), (None, 21, 2.0), ("c", None, 1.0), ("d", 3, 1.0), ("d", 13, 5.0)]
    df = sampling_windows(spark.createDataFrame(rows, "k string, ts long, v double"), ["k"], "ts", "v", 10, 25)
    want = []
    for k in ("a", "b", None, "c", "d"):
        ts = [t for u, t, _ in rows if u == k and t is not None]
        for s in range(-(-(max(ts) - min(ts)) // 10) if ts else 0):
            at = min(ts) + 10 * s
            held = [v for u, t, v in rows if s and u == k and k is not None and t is not None and at - 25 <= t <= at]
            want.append((k, s, at, len(held), float(sum(v for v in held if v is not None))))
    assert sorted(map(tuple, df.collect()), key=str) == sorted(want, key=str) and len(want) > 10
    assert _generated_last(df)


def test_indicator_frames_are_made_last(spark):
    from framelake.operators.segments import timestamps_to_indicator

    r = random.Random(4)
    lengths = [("a", 40), ("b", 1), ("c", 0), ("d", 9), (None, 3), ("e", None)]
    segs = [(r.choice("abcdz"), float(a := r.randint(-5, 50)), float(a + r.randint(-3, 8))) for _ in range(14)] + [(None, 1.0, 2.0), ("e", 1.0, 2.0), ("d", None, None)]
    df = timestamps_to_indicator(spark.createDataFrame(segs, "k string, s double, e double"), ["k"], "s", "e", spark.createDataFrame(lengths, "k string, n int"), "n", 1.0, 2.0)
    want = []
    for k, n in lengths:
        at = lambda t: 1 if t is None else min(n, max(1, int(t - 1.0 + 0.5 // 1)))
        on = {f for u, s, e in segs if u == k and k is not None and n for f in range(at(s), max(at(s), at(e)) + 1)}
        want += [(k, f, int(f in on)) for f in range(1, (n or 0) + 1)]
    assert sorted(map(tuple, df.collect()), key=str) == sorted(want, key=str)
    assert _generated_last(df)


def test_symbol_lines_are_not_lists_of_symbols(spark):
    """Odd durations and symbols give the same lines as before; a line is joined from one text a segment."""
    from framelake.operators.segments import symbol_sequence

    rows = [("a", 2, 39.0, "x"), ("a", 1, 5.0, "y"), ("a", 3, 10.0, None), ("a", 4, -50.0, "z"), ("a", 5, 25.0, ""), ("a", 6, None, "w"), ("a", 7, 10.0, "v"), ("b", 1, 9.0, "x"), (None, 1, 20.0, "é")]
    df = symbol_sequence(spark.createDataFrame(rows, "k string, t int, d double, y string"), ["k"], ["t"], F.col("d"), F.col("y"), 10.0)
    assert {r["k"]: r["symbols"] for r in df.collect()} == {"a": "x x x   v", "b": "", None: "é é"}
    assert "array_repeat" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_symbol_lines_are_dealt_by_their_bytes(spark, tmp_path):
    """A few hundred events make a hundred megabytes of lines; no task makes most of them."""
    from pyspark.sql import functions as F

    import __spark_entry__ as e

    rows = [(k * 5_000_000 + u, u, kind, 1.0) for u in range(100) for k, kind in enumerate(("view", "click", "error"))]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    lines = e.queries()["c6_symbol_sequence"](spark, str(tmp_path))
    made = lines.groupBy(F.spark_partition_id().alias("task")).agg(F.sum(F.length("symbols")).alias("n")).collect()
    total = sum(r["n"] for r in made)
    assert total == 100 * (4 * 250_000 - 1) and max(r["n"] for r in made) < 0.5 * total
    assert lines.where("user_id = 7").first()["symbols"] == " ".join(["v"] * 250_000 + ["c"] * 250_000)
