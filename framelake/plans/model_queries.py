"""Queries over functions, models and graphs, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import alignment, dsp, extraction
from ..graphs import dynamic, orders, tables
from ..models import gaussian, hidden, language, neighbours
from ..operators import metrics
from ..sources import model_files
from .queries import _MOM, _WORDS, FRAMES, events, frames, query, table, words

# ---- functions ----------------------------------------------------------


@query("SELECT p_partkey, round(2595.0 * log10(1 + p_retailprice / 700.0), 6) AS mel, round(700.0 * (pow(10.0, (p_retailprice / 10.0) / 2595.0) - 1), 6) AS hz FROM part")
def f6_mel(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", F.round(dsp.hz_to_mel(F.col("p_retailprice")), 6).alias("mel"), F.round(dsp.mel_to_hz(F.col("p_retailprice") / 10.0), 6).alias("hz"))


@query("SELECT k::INTEGER AS k, floor(700.0 * (pow(10.0, ((2595.0 * log10(1 + 100 / 700.0)) + (2595.0 * log10(1 + 8000 / 700.0) - 2595.0 * log10(1 + 100 / 700.0)) * k / 21.0) / 2595.0) - 1) + 0.5)::DOUBLE AS hz FROM range(22) t(k)")
def f7_mel_breaks(spark, d):
    return spark.range(1).select(F.posexplode(dsp.doubles(dsp.mel_breaks(20, 100.0, 8000.0, True))).alias("k", "hz"))


def _tri(k):
    return dsp.mel_filters(8, 64, 16000.0, 0.0, 8000.0)[k]


_BANK = """mel AS (SELECT unnest(range(64)) AS i), m AS (SELECT i, 2595.0 * log10(1 + (i * 16000.0 / 126.0) / 700.0) AS m FROM mel), top AS (SELECT 2595.0 * log10(1 + 8000 / 700.0) AS t),
w AS (SELECT k, i, greatest(0.0, least((m - t * k / 9.0) / (t / 9.0), (t * (k + 2) / 9.0 - m) / (t / 9.0))) AS w FROM m, top, range(8) r(k))"""


@query(f"WITH {FRAMES}, {_BANK} SELECT f.vec_id, w.k::INTEGER AS k, round(sum(abs(f.x[i + 1]) * w.w), 4) AS energy FROM frames f, w GROUP BY 1, 2")
def f8_mel_filter_bank(spark, d):
    rows = dsp.matrix_times([_tri(k) for k in range(8)], F.transform("x", F.abs))
    return frames(spark, d).select("vec_id", F.posexplode(rows).alias("k", "e")).select("vec_id", "k", F.round("e", 4).alias("energy"))


@query(f"WITH {FRAMES}, u AS (SELECT vec_id, unnest(range(64)) AS j, unnest(x) AS v FROM frames) SELECT vec_id, i::INTEGER AS i, round(sum(v * sqrt(2.0 / 64) * cos(pi() / 64 * i * (j + 0.5))), 4) + 0.0 AS c FROM u, range(4) r(i) GROUP BY 1, 2")
def f9_dct(spark, d):
    return frames(spark, d).select("vec_id", F.posexplode(dsp.matrix_times(dsp.dct_rows(64, 4), F.col("x"))).alias("i", "c")).select("vec_id", "i", (F.round("c", 4) + 0.0).alias("c"))


@query(f"WITH {FRAMES} SELECT vec_id, (i - 1)::INTEGER AS i, round(x[i] * (1 + 11.0 * sin(pi() * i / 22)), 4) + 0.0 AS y FROM (SELECT vec_id, x, unnest(range(1, 65)) AS i FROM frames)")
def f10_lifter(spark, d):
    return frames(spark, d).select("vec_id", F.posexplode(dsp.lifter(F.col("x"), 22)).alias("i", "y")).select("vec_id", "i", (F.round("y", 4) + 0.0).alias("y"))


@query(f"WITH {FRAMES} SELECT vec_id, (i - 1)::INTEGER AS i, round(x[i] * (0.54 - 0.46 * cos(2 * pi() * (i - 1) / 63)), 5) + 0.0 AS y FROM (SELECT vec_id, x, unnest(range(1, 65)) AS i FROM frames)")
def f11_hamming(spark, d):
    w = dsp.doubles(dsp.hamming(64))
    return frames(spark, d).select("vec_id", F.posexplode(F.zip_with("x", w, lambda a, b: a * b)).alias("i", "y")).select("vec_id", "i", (F.round("y", 5) + 0.0).alias("y"))


_BESSEL = "list_sum(list_transform(range(0, 25), lambda k: pow(pow(({0}) / 2.0, k) / gamma(k + 1), 2)))"


@query("SELECT n::INTEGER AS n, round(" + _BESSEL.format("6.0 * sqrt(1 - pow(2.0 * n / 31 - 1, 2))") + " / " + _BESSEL.format("6.0") + ", 6) AS w FROM range(32) t(n)")
def f11_kaiser(spark, d):
    return spark.range(1).select(F.posexplode(dsp.doubles(dsp.kaiser(32, 6.0))).alias("n", "w")).withColumn("w", F.round("w", 6))


@query(f"WITH {FRAMES} SELECT vec_id, (i - 1)::INTEGER AS i, round(x[i] - m, 5) + 0.0 AS y FROM (SELECT vec_id, x, list_avg(x) AS m, unnest(range(1, 65)) AS i FROM frames)")
def f12_remove_dc(spark, d):
    return frames(spark, d).select("vec_id", F.posexplode(dsp.remove_dc(F.col("x"))).alias("i", "y")).withColumn("y", F.round("y", 5) + 0.0)


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey <= 1 THEN 1 ELSE pow(2, length(ltrim(bin(l_partkey - 1), '0')))::BIGINT END AS p FROM lineitem")
def f14_power_of_two(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", dsp.power_of_two(F.col("l_partkey")).alias("p"))


@query(f"WITH {FRAMES} SELECT vec_id, (i - 1)::INTEGER AS i, round(ln(greatest(abs(x[i]), 0.001)), 6) + 0.0 AS y FROM (SELECT vec_id, x, unnest(range(1, 65)) AS i FROM frames)")
def f15_abs_log(spark, d):
    return frames(spark, d).select("vec_id", F.posexplode(dsp.component_log(dsp.component_abs(F.col("x")), 0.001)).alias("i", "y")).withColumn("y", F.round("y", 6) + 0.0)


@query(f"WITH {FRAMES} SELECT vec_id, round(least(greatest(10 * log10(list_dot_product(x, x) / 0.001), 0), 140), 5) AS db FROM frames")
def f16_band_level(spark, d):
    return frames(spark, d).select("vec_id", F.round(dsp.band_level(F.col("x"), 0.001), 5).alias("db"))


@query(f"WITH {FRAMES} SELECT vec_id, round(ln(list_sum(list_transform(x, lambda v: exp(v)))), 6) AS y FROM frames")
def f17_log_sum_exp(spark, d):
    return frames(spark, d).select("vec_id", F.round(dsp.log_sum_exp(F.col("x")), 6).alias("y"))


@query("SELECT s_suppkey, round(CASE WHEN s_suppkey % 3 = 0 THEN '-infinity'::DOUBLE ELSE ln((s_suppkey % 3) / 7.0::DOUBLE) END, 6) AS y FROM supplier")
def f17_safe_log_divide(spark, d):
    k = (F.col("s_suppkey") % 3).cast("double")
    return table(spark, d, "supplier").select("s_suppkey", dsp.safe_log_divide(k, F.when(k == 0, 0.0).otherwise(7.0)).alias("y")).withColumn("y", F.when(F.col("y") == float("-inf"), F.col("y")).otherwise(F.round("y", 6)))


@query(f"WITH {FRAMES} SELECT a.vec_id, round(list_distance(a.x, b.x), 5) AS dist FROM frames a JOIN frames b ON b.vec_id = a.vec_id + 1")
def f18_distance(spark, d):
    a = frames(spark, d).select("vec_id", "x")
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y"))
    return a.join(b, "vec_id").select("vec_id", F.round(dsp.distance(F.col("x"), F.col("y")), 5).alias("dist"))


@query("SELECT p_partkey, list_filter(range(1, p_partkey + 2), lambda k: (p_partkey + 1) % k = 0) AS f, len(list_filter(range(1, p_partkey + 2), lambda k: (p_partkey + 1) % k = 0)) = 2 AS prime FROM part")
def f19_factors(spark, d):
    p = table(spark, d, "part")
    n = F.col("p_partkey") + 1
    return p.select("p_partkey", dsp.factors(n).alias("f"), dsp.is_prime(n).alias("prime"))


@query("SELECT p_partkey, list_filter(list_filter(range(2, p_partkey + 2), lambda k: (p_partkey + 1) % k = 0), lambda k: len(list_filter(range(2, k), lambda j: k % j = 0)) = 0) AS primes FROM part")
def f19_prime_factors(spark, d):
    return table(spark, d, "part").select("p_partkey", dsp.prime_factors(F.col("p_partkey") + 1).alias("primes"))


@query(f"WITH {FRAMES}, s AS (SELECT vec_id, x, list_sum(list_transform(x, lambda v: abs(v))) / 2 AS half FROM frames), c AS (SELECT vec_id, half, list_transform(range(1, 65), lambda i: list_sum(list_transform(x[1:i], lambda v: abs(v)))) AS sums FROM s) SELECT vec_id, len(list_filter(sums, lambda v: round(v, 9) <= round(half, 9)))::INTEGER AS k FROM c")
def f19_cumulative_index(spark, d):
    """Where half of a vector's absolute sum is passed."""
    size = F.transform("x", lambda v: F.abs(v))
    half = F.aggregate(size, F.lit(0.0), lambda s, v: s + v) / 2
    return frames(spark, d).select("vec_id", dsp.cumulative_index(size, half).alias("k"))


@query("SELECT c_custkey, levenshtein(c_name, c_mktsegment)::INTEGER AS cost FROM customer")
def f21_edit_cost(spark, d):
    return table(spark, d, "customer").select("c_custkey", alignment.edit_cost(F.col("c_name"), F.col("c_mktsegment")).alias("cost"))


@query("SELECT o_orderkey, [(o_orderkey >> 8) & 15, (o_orderkey >> 3) & 31, o_orderkey & 7] AS bits FROM orders")
def f22_bit_fields(spark, d):
    return table(spark, d, "orders").select("o_orderkey", dsp.bit_fields(F.col("o_orderkey"), [4, 5, 3]).alias("bits"))


_SPECTRUM = f"""{FRAMES}, u AS (SELECT vec_id, unnest(range(64)) AS j, unnest(x) AS v FROM frames),
spec AS (SELECT vec_id, k, sqrt(pow(sum(v * cos(2 * pi() * k * j / 64)), 2) + pow(sum(v * sin(2 * pi() * k * j / 64)), 2)) AS m FROM u, range(33) r(k) GROUP BY 1, 2)"""


@query(f"WITH {_SPECTRUM} SELECT vec_id, k::INTEGER AS k, round(m, 5) AS magnitude FROM spec")
def f13_spectrum(spark, d):
    rows = frames(spark, d).select("vec_id", dsp.spectrum()(F.col("x")).alias("m"))
    return rows.select("vec_id", F.posexplode("m").alias("k", "magnitude")).withColumn("magnitude", F.round("magnitude", 5))


_CEPS = f"""{FRAMES}, e AS (SELECT vec_id, j, (CASE WHEN j = 0 THEN x[1] * (1 - 0.97::DOUBLE) ELSE x[j + 1] - 0.97::DOUBLE * x[j] END) * (0.54 - 0.46 * cos(2 * pi() * j / 63)) AS v FROM (SELECT vec_id, x, unnest(range(64)) AS j FROM frames)),
spec AS (SELECT vec_id, k, sqrt(pow(sum(v * cos(2 * pi() * k * j / 64)), 2) + pow(sum(v * sin(2 * pi() * k * j / 64)), 2)) AS m FROM e, range(33) r(k) GROUP BY 1, 2),
mel AS (SELECT k AS i, 2595.0 * log10(1 + (k * 8000.0 / 32.0) / 700.0) AS m FROM range(33) r(k)), top AS (SELECT 2595.0 * log10(1 + 8000 / 700.0) AS t),
w AS (SELECT c, i, greatest(0.0, least((m - t * c / 9.0) / (t / 9.0), (t * (c + 2) / 9.0 - m) / (t / 9.0))) AS w FROM mel, top, range(8) r(c)),
bank AS (SELECT vec_id, c, ln(greatest(sum(spec.m * w.w), 1e-10)) AS y FROM spec JOIN w ON w.i = spec.k GROUP BY 1, 2)"""


@query(f"WITH {_CEPS} SELECT vec_id, (n - 1)::INTEGER AS i, round(sum(y * sqrt(2.0 / 8) * cos(pi() / 8 * n * (c + 0.5))) * (1 + 11.0 * sin(pi() * n / 22)), 4) + 0.0 AS c FROM bank, range(1, 7) r(n) GROUP BY vec_id, n")
def f3_cepstra(spark, d):
    rows = frames(spark, d).select("vec_id", dsp.cepstra(16000.0, 64, 8, 6)(F.col("x")).alias("ceps"))
    return rows.select("vec_id", F.posexplode("ceps").alias("i", "c")).withColumn("c", F.round("c", 4) + 0.0)


def audio(spark, d):
    """Each utterance's vectors, one behind the other, as samples."""
    rows = frames(spark, d).groupBy("utt").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("frame", "x"))), lambda s: s["x"])).alias("samples"))
    return rows.select("utt", F.lit(16000).alias("rate"), F.lit(0).alias("channel"), "samples")


@query()
def f1_extraction(spark, d):
    return extraction.extract(audio(spark, d), extraction.extraction_specs("MFCC_0_D_A", 39), "utt")


@query()
def f2_plp(spark, d):
    return extraction.extract(audio(spark, d), extraction.plp_specs(), "utt")


@query("""WITH v AS (SELECT event_id, value, abs(value) AS v, floor(log2(abs(value)))::INTEGER AS g FROM events), s AS (SELECT *, g + CASE WHEN v / pow(2.0::DOUBLE, g) >= 2 THEN 1 WHEN v / pow(2.0::DOUBLE, g) < 1 THEN -1 ELSE 0 END AS e FROM v)
SELECT event_id, CASE WHEN value = 0 THEN '0x0.0p+0' ELSE CASE WHEN value < 0 THEN '-' ELSE '' END || '0x1.' || lpad(lower(to_hex(((v / pow(2.0::DOUBLE, e) - 1) * pow(2.0::DOUBLE, 52))::BIGINT)), 13, '0') || 'p' || CASE WHEN e < 0 THEN '' ELSE '+' END || e END AS hex, value AS again FROM s""")
def f20_float_text(spark, d):
    """Exact text of every value, and the value read back from it."""
    text = events(spark, d).select("event_id", dsp.float_hex(F.col("value")).alias("hex"))
    return text.withColumn("again", dsp.hex_float(F.col("hex")))


# ---- Gaussians and neighbours -------------------------------------------------
_LL = f"""{_MOM}, g AS (SELECT label AS c, list(mean ORDER BY dim) AS mean, list(greatest(var, 1e-6) ORDER BY dim) AS var FROM m GROUP BY label),
s AS (SELECT f.vec_id, f.utt, f.label, g.c, round(-0.5 * (list_sum(list_transform(list_zip(f.x, g.mean, g.var), lambda z: (z[1] - z[2]) * (z[1] - z[2]) / z[3] + ln(z[3]))) + 64 * ln(2 * pi())), 6) AS ll FROM frames f, g),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY ll DESC, c) AS k FROM s) WHERE k = 1)"""


def classified(spark, d):
    f = frames(spark, d)
    return gaussian.classify(f, gaussian.class_gaussians(f, "label", F.col("x")), ["vec_id"], "label", "x")


@query(f"WITH {_LL} SELECT label AS ref, c AS hyp, count(*) AS n FROM best GROUP BY 1, 2")
def m3_gaussian_confusion(spark, d):
    return metrics.confusion(classified(spark, d), "label", "hyp")


@query(f"WITH {_LL} SELECT vec_id, round(ll, 3) AS score, c AS hyp FROM best")
def m1_log_density(spark, d):
    return classified(spark, d).select("vec_id", F.round(F.col("ranked")[0]["score"], 3).alias("score"), "hyp")


@query(f"WITH {_LL}, t AS (SELECT utt, c, sum(ll) AS ll FROM s GROUP BY 1, 2) SELECT utt, c AS hyp FROM (SELECT *, row_number() OVER (PARTITION BY utt ORDER BY round(ll, 4) DESC, c) AS k FROM t) WHERE k = 1")
def m29_utterance_label(spark, d):
    rows = classified(spark, d).select("utt", F.explode("scores").alias("s")).groupBy("utt", F.col("s.label").alias("c")).agg(F.round(F.sum("s.score"), 4).alias("v"))
    return rows.groupBy("utt").agg(F.max(F.struct("v", (-F.col("c")).alias("n"))).alias("m")).select("utt", (-F.col("m.n")).alias("hyp"))


@query(f"WITH {_MOM} SELECT label, dim::INTEGER AS dim, round((n / (n + 16.0)) * mean, 6) + 0.0 AS mean FROM m")
def m2_relevance_adaptation(spark, d):
    m = metrics.moments(frames(spark, d), ["label"], F.col("x"))
    return m.select("label", "dim", (F.round(gaussian.adapt(F.lit(0.0), F.col("mean"), 16.0, F.col("n")), 6) + 0.0).alias("mean"))


@query(f"WITH {_LL} SELECT round(min(dd), 4) AS min, round(max(dd), 4) AS max, round(avg(dd), 4) AS mean FROM (SELECT list_distance(a.mean, b.mean) AS dd FROM g a JOIN g b ON a.c < b.c)".replace("AS min,", 'AS "min",').replace("AS max,", 'AS "max",'))
def m3_class_distances(spark, d):
    r = gaussian.pairwise_distances(gaussian.class_gaussians(frames(spark, d), "label", F.col("x")), "label")
    return r.select(*(F.round(c, 4).alias(c) for c in r.columns))


@query(f"WITH {_MOM} SELECT label::VARCHAR AS label, dim::INTEGER AS dim, round(mean, 6) + 0.0 AS mean, round(greatest(var, 1e-6), 6) AS var FROM m")
def k4_model_text(spark, d):
    """The Gaussian of each class written as macro text and parsed again."""
    rows = gaussian.class_gaussians(frames(spark, d), "label", F.col("x")).collect()  # classes
    text = model_files.macro_text({str(r["label"]): gaussian.Mixture([1.0], [r["mean"]], [r["var"]]) for r in rows})
    found = {k: next(iter(m["states"].values())) for k, m in model_files.parse_macros(text).items()}
    out = [(k, i, a, b) for k, m in found.items() for i, (a, b) in enumerate(zip(m.means[0], m.covs[0]))]
    return spark.createDataFrame(out, "label string, dim int, mean double, var double").select("label", "dim", (F.round("mean", 6) + 0.0).alias("mean"), F.round("var", 6).alias("var"))


@query(f"WITH {_LL} SELECT vec_id, c AS model, ll AS score FROM s")
def m25_frame_scores(spark, d):
    f = frames(spark, d)
    return gaussian.frame_scores(f, gaussian.class_gaussians(f, "label", F.col("x")), "label", "x", ["vec_id"])


@query(f"""WITH {_LL}, b AS (SELECT utt, (vec_id % 50 + 1)::INTEGER AS frame, (c = 1)::INTEGER AS decision FROM best),
w AS (SELECT utt, frame, decision, list(decision) OVER (PARTITION BY utt ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS l FROM b)
SELECT utt, frame, decision, list_sort(list_concat(l, list_transform(range(5 - len(l)), lambda k: 0)))[3] AS smoothed FROM w""")
def m11_speech_decision(spark, d):
    return gaussian.speech_decision(classified(spark, d), ["utt"], "frame", "hyp", 1, 5)


def _noisy(k):
    mom = f"u{k} AS (SELECT CASE WHEN vec_id % 10 < {k} THEN (label + 1) % 10 ELSE label END AS label, unnest(range(64)) AS dim, unnest(x) AS v FROM frames), m{k} AS (SELECT label, dim, avg(v) AS mean, greatest(var_pop(v), 1e-6) AS var FROM u{k} GROUP BY 1, 2)"
    ll = f"g{k} AS (SELECT label AS c, list(mean ORDER BY dim) AS mean, list(var ORDER BY dim) AS var FROM m{k} GROUP BY 1), s{k} AS (SELECT f.vec_id, f.label, g.c, round(-0.5 * (list_sum(list_transform(list_zip(f.x, g.mean, g.var), lambda z: (z[1] - z[2]) * (z[1] - z[2]) / z[3] + ln(z[3]))) + 64 * ln(2 * pi())), 6) AS ll FROM frames f, g{k} g)"
    return f"{mom}, {ll}, b{k} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY ll DESC, c) AS k FROM s{k}) WHERE k = 1)"


@query(f"WITH {FRAMES}, {', '.join(map(_noisy, (0, 2, 4)))} " + " UNION ALL ".join(f'SELECT {k} AS tenths, count(*) FILTER (label = c) AS "right", count(*) AS n, count(*) FILTER (label = c) / count(*)::DOUBLE AS accuracy FROM b{k}' for k in (0, 2, 4)))
def m34_noise_sweep(spark, d):
    return gaussian.noise_sweep(frames(spark, d), "label", "x", "vec_id", 10, [0, 2, 4])


_TWO = gaussian.Mixture([0.5, 0.5], [[0.1] * 64, [-0.1] * 64], [[0.02] * 64, [0.03] * 64])
_POST = f"""{FRAMES}, q AS (SELECT vec_id, x, ln(0.5) - 0.5 * (list_sum(list_transform(x, lambda v: (v - 0.1) * (v - 0.1) / 0.02)) + 64 * ln(0.02) + 64 * ln(2 * pi())) AS a,
ln(0.5) - 0.5 * (list_sum(list_transform(x, lambda v: (v + 0.1) * (v + 0.1) / 0.03)) + 64 * ln(0.03) + 64 * ln(2 * pi())) AS b FROM frames),
p AS (SELECT vec_id, x, exp(a - greatest(a, b)) / (exp(a - greatest(a, b)) + exp(b - greatest(a, b))) AS p FROM q)"""


_A9 = f"""{_POST}, l AS (SELECT p.*, f.label FROM p JOIN frames f USING (vec_id)), e AS (SELECT label, p, unnest(range(64))::INTEGER AS dim, unnest(x) AS v FROM l)"""


@query(f"""WITH {_A9} SELECT label::VARCHAR AS label, comp::INTEGER AS comp, dim, round(sum(w), 4) AS zeroth, round(sum(w * v), 4) + 0.0 AS first, round(sum(w * v * v), 5) AS second
FROM (SELECT label, dim, v, 0 AS comp, p AS w FROM e UNION ALL SELECT label, dim, v, 1, 1 - p FROM e) GROUP BY 1, 2, 3""")
def a9_accumulators(spark, d):
    f = frames(spark, d)
    names = [str(r[0]) for r in f.select("label").distinct().orderBy("label").collect()]  # classes
    rows = gaussian.accumulator_rows(spark, gaussian.accumulate(f, "label", "x", {k: _TWO for k in names}))
    return rows.select("label", "comp", "dim", F.round("zeroth", 4).alias("zeroth"), (F.round("first", 4) + 0.0).alias("first"), F.round("second", 5).alias("second"))


@query(f"WITH {_POST} SELECT vec_id, round(p, 5) AS p FROM p")
def m5_posteriors(spark, d):
    return frames(spark, d).select("vec_id", F.round(gaussian.posterior_columns(F.col("x"), _TWO)[0], 5).alias("p"))


@query(f"WITH {_POST}, u AS (SELECT p, unnest(range(64)) AS dim, unnest(x) AS v FROM p) SELECT dim::INTEGER AS dim, round(sum(p * v) / sum(p), 5) + 0.0 AS mean, round(sum(p * v * v) / sum(p) - (sum(p * v) / sum(p)) * (sum(p * v) / sum(p)), 5) AS var FROM u GROUP BY 1")
def m4_em_step(spark, d):
    m, _, _ = gaussian.em_step(frames(spark, d), "x", _TWO)
    return spark.createDataFrame([(i, round(a, 5) + 0.0, round(b, 5)) for i, (a, b) in enumerate(zip(m.means[0], m.covs[0]))], "dim int, mean double, var double")


@query()
def m6_mixture_fit(spark, d):
    m, trace = gaussian.fit_mixture(frames(spark, d), "x", _TWO, 5)
    return spark.createDataFrame(list(enumerate(trace)), "step int, loglik double")


@query()
def m15_grown_classes(spark, d):
    f = frames(spark, d)
    models = gaussian.train_classes(f, "label", "x", 4, 2)
    s = gaussian.score_mixtures(f, "x", models).withColumn("hyp", F.sort_array(F.transform("scores", lambda v: F.struct(v["score"].alias("score"), v["label"].alias("label"))), False)[0]["label"].cast("int"))
    return metrics.confusion(s, "label", "hyp")


@query(f"WITH {FRAMES}, c AS (SELECT x AS c, vec_id AS k FROM frames WHERE vec_id < 4), a AS (SELECT f.vec_id, arg_min(c.k, (round(list_sum(list_transform(list_zip(f.x, c.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 9) * 1e9)::BIGINT * 10 + c.k) AS c FROM frames f, c GROUP BY 1) SELECT c::INTEGER AS cluster, count(*) AS n FROM a GROUP BY 1")
def m7_kmeans_assign(spark, d):
    f = frames(spark, d)
    centres = [r["x"] for r in f.where("vec_id < 4").orderBy("vec_id").collect()]  # four rows
    return f.select(neighbours.assign(F.col("x"), centres).alias("cluster")).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


def _lloyd(k):
    near = f"a{k} AS (SELECT f.vec_id, any_value(f.x) AS x, arg_min(c.k, (round(list_sum(list_transform(list_zip(f.x, c.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 9) * 1e9)::BIGINT * 10 + c.k) AS k FROM frames f, c{k} c GROUP BY 1)"
    return f"{near}, u{k} AS (SELECT k, unnest(range(64)) AS i, unnest(x) AS v FROM a{k}), c{k + 1} AS (SELECT k, list(m ORDER BY i) AS c FROM (SELECT k, i, avg(v) AS m FROM u{k} GROUP BY 1, 2) GROUP BY 1)"


@query(f"WITH {FRAMES}, c0 AS (SELECT vec_id AS k, x AS c FROM frames WHERE vec_id < 4), {', '.join(map(_lloyd, range(5)))} SELECT k::INTEGER AS cluster, (i - 1)::INTEGER AS i, round(c[i], 5) + 0.0 AS centre FROM (SELECT k, c, unnest(range(1, 65)) AS i FROM c5)")
def m7_kmeans(spark, d):
    f = frames(spark, d)
    centres = neighbours.kmeans(f, "x", [r["x"] for r in f.where("vec_id < 4").orderBy("vec_id").collect()], 5)
    rows = spark.createDataFrame([(c, i, float(v)) for c, x in enumerate(centres) for i, v in enumerate(x)], "cluster int, i int, centre double")
    return rows.withColumn("centre", F.round("centre", 5) + 0.0)


_KNN = f"""{FRAMES}, n AS (SELECT q.vec_id AS query, p.vec_id AS id, p.label, list_sum(list_transform(list_zip(q.x, p.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM frames q JOIN frames p ON p.vec_id <> q.vec_id WHERE q.vec_id % 10 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(d, 9), id) AS rank FROM n), k AS (SELECT * FROM r WHERE rank <= 15)"""


def near(spark, d):
    f = frames(spark, d)
    return neighbours.nearest(f.where("vec_id % 10 = 0"), f, 15, "vec_id", "x", "label", leave_self=True)


@query(f"WITH {_KNN} SELECT query, rank::INTEGER AS rank, id, label, round(d, 5) AS d FROM k")
def m8_nearest(spark, d):
    return near(spark, d).withColumn("d", F.round("d", 5))


@query(f"WITH {_KNN} SELECT query, n::INTEGER AS n, count(*) FILTER (label = 1) AS votes_1, count(*) FILTER (label = 2) AS votes_2, round(count(*) FILTER (label = 1) / n::DOUBLE, 6) AS share_1, round(count(*) FILTER (label = 2) / n::DOUBLE, 6) AS share_2 FROM k, (VALUES (5), (15)) s(n) WHERE rank <= n GROUP BY query, n")
def m9_vote_shares(spark, d):
    v = neighbours.vote_shares(near(spark, d), [5, 15], [1, 2])
    return v.withColumns({c: F.round(c, 6) for c in ("share_1", "share_2")})


@query(f"WITH {_KNN}, v AS (SELECT query, label, count(*) AS votes FROM k GROUP BY 1, 2) SELECT query, label AS hyp, votes FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY votes DESC, label) AS r FROM v) WHERE r = 1")
def m10_majority(spark, d):
    return neighbours.majority(near(spark, d), 15)


@query()
def m9_mahalanobis(spark, d):
    f = frames(spark, d)
    w = neighbours.whitening(f, "x")
    g = f.withColumn("x", dsp.matrix_times(w, F.col("x")))
    return neighbours.nearest(g.where("vec_id % 50 = 0"), g, 5, "vec_id", "x", "label", leave_self=True)


@query()
def m31_principal_components(spark, d):
    values, vectors = neighbours.principal_components(frames(spark, d), "x", 4)
    return spark.createDataFrame([(i, float(v), [float(x) for x in r]) for i, (v, r) in enumerate(zip(values, vectors))], "k int, value double, axis array<double>")


# ---- decoding ------------------------------------------------------------------
def _hmm():
    return hidden.ergodic([gaussian.Mixture([1.0], [[m] * 64], [[0.02] * 64]) for m in (0.03, -0.03)])


_VITERBI = f"""{FRAMES}, e AS (SELECT utt, frame, -0.5 * (list_sum(list_transform(x, lambda v: (v - 0.03::DOUBLE) * (v - 0.03::DOUBLE) / 0.02::DOUBLE)) + 64 * (ln(0.02::DOUBLE) + ln(2 * pi()))) AS a, -0.5 * (list_sum(list_transform(x, lambda v: (v + 0.03::DOUBLE) * (v + 0.03::DOUBLE) / 0.02::DOUBLE)) + 64 * (ln(0.02::DOUBLE) + ln(2 * pi()))) AS b FROM frames),
v AS (SELECT utt, frame, ln(0.5::DOUBLE) + a AS a, ln(0.5::DOUBLE) + b AS b, [0] AS pa, [1] AS pb FROM e WHERE frame = 1
UNION ALL SELECT utt, frame, CASE WHEN aa >= ba THEN aa ELSE ba END + ea, CASE WHEN ab >= bb THEN ab ELSE bb END + eb, list_append(CASE WHEN aa >= ba THEN pa ELSE pb END, 0), list_append(CASE WHEN ab >= bb THEN pa ELSE pb END, 1)
FROM (SELECT e.utt, e.frame, v.a + ln(0.9::DOUBLE) AS aa, v.b + ln(0.05::DOUBLE) AS ba, v.a + ln(0.05::DOUBLE) AS ab, v.b + ln(0.9::DOUBLE) AS bb, e.a AS ea, e.b AS eb, pa, pb FROM v JOIN e ON e.utt = v.utt AND e.frame = v.frame + 1)),
best AS (SELECT utt, greatest(a, b) + ln(0.05::DOUBLE) AS score, CASE WHEN a >= b THEN pa ELSE pb END AS path FROM v WHERE (utt, frame) IN (SELECT utt, max(frame) FROM e GROUP BY utt))
SELECT utt, unnest(range(1, len(path) + 1))::INTEGER AS frame, unnest(path)::INTEGER AS state, round(score, 4) AS score FROM best"""


@query(f"WITH RECURSIVE {_VITERBI}")
def m24_viterbi(spark, d):
    return hidden.decode_utterances(frames(spark, d), ["utt"], "frame", "x", _hmm()).withColumn("score", F.round("score", 4))


@query(f"WITH RECURSIVE {_VITERBI}")
def m27_beam(spark, d):
    """A beam that drops a state at over a quarter of these frames and still finds the best path."""
    return hidden.decode_utterances(frames(spark, d), ["utt"], "frame", "x", _hmm(), 4.0).withColumn("score", F.round("score", 4))


def _forward(name, m):
    """SQL of the log likelihood of each utterance under a model of two states with means m and -m."""
    dens = lambda v: f"-0.5 * (list_sum(list_transform(x, lambda v: (v - ({v})::DOUBLE) * (v - ({v})::DOUBLE) / 0.02::DOUBLE)) + 64 * (ln(0.02::DOUBLE) + ln(2 * pi())))"
    lse = lambda x, y: f"greatest({x}, {y}) + ln(1 + exp(-abs({x} - ({y}))))"
    one, two = "v.a + ln(0.9::DOUBLE)", "v.b + ln(0.05::DOUBLE)"
    three, four = "v.a + ln(0.05::DOUBLE)", "v.b + ln(0.9::DOUBLE)"
    return f"""e{name} AS (SELECT utt, frame, {dens(m)} AS a, {dens(-m)} AS b FROM frames),
v{name} AS (SELECT utt, frame, ln(0.5::DOUBLE) + a AS a, ln(0.5::DOUBLE) + b AS b FROM e{name} WHERE frame = 1 UNION ALL SELECT e.utt, e.frame, {lse(one, two)} + e.a, {lse(three, four)} + e.b FROM v{name} v JOIN e{name} e ON e.utt = v.utt AND e.frame = v.frame + 1),
l{name} AS (SELECT utt, '{name}' AS hyp, {lse("a + ln(0.05::DOUBLE)", "b + ln(0.05::DOUBLE)")} AS score FROM v{name} WHERE (utt, frame) IN (SELECT utt, max(frame) FROM e{name} GROUP BY utt))"""


@query(f"WITH RECURSIVE {FRAMES}, {_forward('far', 0.03)}, {_forward('near', 0.01)}, u AS (SELECT * FROM lfar UNION ALL SELECT * FROM lnear) SELECT utt, hyp, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY utt ORDER BY score DESC, hyp) AS k FROM u) WHERE k = 1")
def m22_hmm_scores(spark, d):
    """Which of two models each utterance is likelier under, and how likely."""
    model = lambda m: hidden.ergodic([gaussian.Mixture([1.0], [[v] * 64], [[0.02] * 64]) for v in (m, -m)])
    found = hidden.HmmSet({"far": model(0.03), "near": model(0.01)}).classify(frames(spark, d), ["utt"], "frame", "x")
    return found.select("utt", "hyp", F.round("score", 4).alias("score"))


@query()
def m23_baum_welch(spark, d):
    hmm, out = _hmm(), []
    for k in range(3):
        hmm, loglik = hidden.train_step(frames(spark, d), ["utt"], "frame", "x", hmm)
        out.append((k, loglik))
    return spark.createDataFrame(out, "step int, loglik double")


@query(f"""WITH RECURSIVE {FRAMES}, e AS (SELECT utt, frame, abs(x[1]) AS a, abs(x[2]) AS b FROM frames),
v AS (SELECT utt, frame, a + 0.7::DOUBLE AS a, b + 0.7::DOUBLE AS b, ['a'] AS pa, ['b'] AS pb FROM e WHERE frame = 1
UNION ALL SELECT utt, frame, least(aa, ba), least(ab, bb), list_append(CASE WHEN aa <= ba THEN pa ELSE pb END, 'a'), list_append(CASE WHEN ab <= bb THEN pa ELSE pb END, 'b')
FROM (SELECT e.utt, e.frame, v.a + e.a + 0.1::DOUBLE AS aa, v.b + e.a + 1.0::DOUBLE AS ba, v.a + e.b + 1.0::DOUBLE AS ab, v.b + e.b + 0.1::DOUBLE AS bb, pa, pb FROM v JOIN e ON e.utt = v.utt AND e.frame = v.frame + 1)),
best AS (SELECT utt, least(a, b) AS cost, CASE WHEN a <= b THEN pa ELSE pb END AS path FROM v WHERE (utt, frame) IN (SELECT utt, max(frame) FROM e GROUP BY utt))
SELECT utt, unnest(range(1, len(path) + 1))::INTEGER AS frame, unnest(path) AS label, round(cost, 6) AS cost FROM best""")
def m26_ngram_viterbi(spark, d):
    lm = {"a": (0.7, 0.3), "b": (0.7, 0.3), "a a": (0.1, 0.0), "b b": (0.1, 0.0)}
    f = frames(spark, d).select("utt", "frame", F.array(F.abs(F.col("x")[0]), F.abs(F.col("x")[1])).alias("costs"))
    return hidden.ngram_viterbi(f, ["utt"], "frame", "costs", ["a", "b"], lm, 2).withColumn("cost", F.round("cost", 6))


@query()
def m13_initial_classes(spark, d):
    found = gaussian.initial_classes(frames(spark, d), "label", "x", 2, 2)
    rows = [(k, c, float(m.weights[c]), [float(v) for v in m.means[c]]) for k, m in sorted(found.items()) for c in range(m.size)]
    return spark.createDataFrame(rows, "label string, comp int, weight double, mean array<double>")


@query()
def m17_hmm_classes(spark, d):
    """Models of two classes of utterances (even and odd numbers), and what they call each."""
    f = frames(spark, d).withColumn("kind", F.col("utt") % 2)
    return hidden.train_classes(f, ["utt"], "frame", "x", "kind", 2, 2, 1).classify(f, ["utt"], "frame", "x")


# ---- language models -----------------------------------------------------------
_LM = f"""{_WORDS}, p AS (SELECT doc, list_concat(list_concat(['<s>'], t), ['</s>']) AS t FROM w), g AS (SELECT doc, unnest(list_transform(range(1, len(t)), lambda i: [t[i], t[i + 1]])) AS g FROM p),
c AS (SELECT g[1] AS context, g[2] AS token, count(*) AS n FROM g GROUP BY 1, 2), x AS (SELECT *, sum(n) OVER (PARTITION BY context) AS cn FROM c)"""


@query(f"WITH {_LM} SELECT context, token, n, round((n + 0.1) / (cn + 0.1 * 5000), 9) AS p FROM x")
def m28_add_lambda(spark, d):
    counts = language.train(words(spark, d), F.col("tokens"), 2)
    return language.probabilities(counts, 5000, 0.1, False).select("context", "token", "n", F.round("p", 9).alias("p"))


_BO = f"""{_LM}, ug AS (SELECT doc, unnest(t[2:]) AS token FROM p), u AS (SELECT token, count(*) AS n1, sum(count(*)) OVER () AS c1 FROM ug GROUP BY 1),
b AS (SELECT x.context, x.token, n, (n + 0.1 * 5000 * ((n1 + 0.1 * 5000 * (1.0 / 5000)) / (c1 + 0.1 * 5000))) / (cn + 0.1 * 5000) AS p FROM x JOIN u ON u.token = x.token)"""


@query(f"WITH {_BO} SELECT context, token, n, round(p::DOUBLE, 9) AS p FROM b")
def m28_back_off(spark, d):
    counts = language.train(words(spark, d), F.col("tokens"), 2)
    return language.probabilities(counts, 5000, 0.1, True).select("context", "token", "n", F.round("p", 9).alias("p"))


@query(f"WITH {_BO} SELECT g.doc, count(*) AS n, round(sum(log2(b.p::DOUBLE)), 4) AS log2p FROM g JOIN b ON b.context = g.g[1] AND b.token = g.g[2] GROUP BY 1")
def m28_document_scores(spark, d):
    w = words(spark, d)
    model = language.probabilities(language.train(w, F.col("tokens"), 2), 5000, 0.1, True)
    return language.document_scores(w, "doc", F.col("tokens"), model, 2, 1e-6).withColumn("log2p", F.round("log2p", 4))


# ---- graphs --------------------------------------------------------------------
def arcs(spark, d):
    """A DAG over customers by all orders: each order is an arc from its customer to half, a third or a quarter of the number."""
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") + 1).alias("src"), F.expr("(o_custkey + 1) div (2 + o_orderkey % 3)").alias("dst"), F.substring("o_orderpriority", 1, 1).alias("label"))


_ARCS = "arcs AS (SELECT o_orderkey AS id, o_custkey + 1 AS src, (o_custkey + 1) // (2 + o_orderkey % 3) AS dst, substr(o_orderpriority, 1, 1) AS label FROM orders), nodes AS (SELECT DISTINCT unnest([src, dst]) AS id FROM arcs)"


def nodes(a):
    return a.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


_DEGREES = "i AS (SELECT id, coalesce(n_in, 0) AS n_in, coalesce(n_out, 0) AS n_out FROM nodes LEFT JOIN (SELECT dst AS id, count(*) AS n_in FROM arcs GROUP BY 1) USING (id) LEFT JOIN (SELECT src AS id, count(*) AS n_out FROM arcs GROUP BY 1) USING (id))"


@query(f"WITH {_ARCS}, {_DEGREES} SELECT id, n_in, n_out FROM i")
def g1_degrees(spark, d):
    a = arcs(spark, d)
    return tables.degrees(nodes(a), a)


@query(f"WITH {_ARCS} SELECT id, id NOT IN (SELECT dst FROM arcs) AS is_start, id NOT IN (SELECT src FROM arcs) AS is_end FROM nodes WHERE id NOT IN (SELECT dst FROM arcs) OR id NOT IN (SELECT src FROM arcs)")
def g2_terminals(spark, d):
    a = arcs(spark, d)
    return tables.terminals(nodes(a), a)


@query(f"WITH {_ARCS} SELECT dst AS src, src AS dst, label FROM arcs")
def g3_reversed(spark, d):
    return tables.reverse(arcs(spark, d))


@query(f"WITH {_ARCS} SELECT a.id AS src, b.id AS dst FROM arcs a JOIN arcs b ON a.dst = b.src")
def g3_line_graph(spark, d):
    return tables.line_graph(arcs(spark, d))


@query(f"WITH RECURSIVE {_ARCS}, r AS (SELECT src, dst FROM arcs UNION SELECT r.src, a.dst FROM r JOIN arcs a ON r.dst = a.src) SELECT src, dst FROM r")
def g4_closure(spark, d):
    return tables.closure(arcs(spark, d))


@query(f"WITH {_ARCS} SELECT a.label || b.label || c.label AS labels, count(*) AS n FROM arcs a JOIN arcs b ON a.dst = b.src JOIN arcs c ON b.dst = c.src GROUP BY 1")
def g5_arc_ngrams(spark, d):
    return tables.arc_ngrams(arcs(spark, d), 3).groupBy(F.array_join("labels", "").alias("labels")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH RECURSIVE {_ARCS}, {_DEGREES}, r AS (SELECT src, dst FROM arcs UNION SELECT r.src, a.dst FROM r JOIN arcs a ON r.dst = a.src), b AS (SELECT src, dst FROM arcs UNION SELECT dst, src FROM arcs), u AS (SELECT min(id) AS n FROM nodes UNION SELECT b.dst FROM u JOIN b ON u.n = b.src)
SELECT (SELECT bool_or(src = dst) FROM arcs) AS self_loop, (SELECT count(*) > count(DISTINCT (src, dst)) FROM arcs) AS multiarcs, (SELECT bool_or(src = dst) FROM r) AS cycle, (SELECT count(*) FROM i WHERE n_in = 0) AS starts, (SELECT count(*) FROM i WHERE n_out = 0) AS ends, (SELECT bool_or(n_in > 1) FROM i) AS has_join,
(SELECT count(*) FROM nodes) = (SELECT count(*) FROM u) AS connected, (SELECT count(*) FROM i WHERE n_in = 0) = 1 AND NOT (SELECT bool_or(n_in > 1) FROM i) AND NOT (SELECT bool_or(src = dst) FROM r) AS tree,
(SELECT count(*) FROM i WHERE n_in = 0) = 1 AND (SELECT count(*) FROM i WHERE n_out = 0) = 1 AND (SELECT count(*) FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src WHERE a.src <> a.dst) = 0 AS lattice""")
def g1_predicates(spark, d):
    a = arcs(spark, d)
    return tables.predicates(nodes(a), a)


@query(f"WITH RECURSIVE {_ARCS}, r AS (SELECT id, 0 AS depth FROM nodes WHERE id NOT IN (SELECT dst FROM arcs) UNION SELECT a.dst, r.depth + 1 FROM r JOIN arcs a ON a.src = r.id) SELECT id, max(depth)::INTEGER AS depth FROM r GROUP BY 1")
def t6_topological_depth(spark, d):
    return orders.topological_depth(arcs(spark, d))


def _changes(spark, d):
    """Orders as edges in four batches: the first three add a third of all each, each after the first takes every fifth of the one before away."""
    e = arcs(spark, d).select("id", F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v"))
    for batch in range(4):
        come = e.where(F.col("id") % 3 == batch).select("u", "v", F.lit(1).alias("delta"))
        gone = e.where((F.col("id") % 3 == batch - 1) & (F.col("id") % 5 == 0)).select("u", "v", F.lit(-1).alias("delta"))
        yield batch, come.unionByName(gone)


@query(f"""WITH {_ARCS}, m AS (SELECT least(src, dst) AS u, greatest(src, dst) AS v, id % 3 AS come, CASE WHEN id % 5 = 0 THEN id % 3 + 1 ELSE 9 END AS gone FROM arcs),
e AS MATERIALIZED (SELECT DISTINCT b.batch, u, v FROM m, range(4) b(batch) WHERE come <= batch AND gone > batch),
deg AS (SELECT batch, n, count(*) AS d FROM (SELECT batch, unnest([u, v]) AS n FROM e) GROUP BY 1, 2),
t AS (SELECT x.batch, x.u AS a, x.v AS b, y.v AS c FROM e x JOIN e y ON x.batch = y.batch AND x.v = y.u JOIN e z ON z.batch = x.batch AND z.u = x.u AND z.v = y.v),
p AS (SELECT batch, n, count(*) AS t FROM (SELECT batch, unnest([a, b, c]) AS n FROM t) GROUP BY 1, 2)
SELECT batch::INTEGER AS batch, (SELECT count(*) FROM e WHERE e.batch = deg.batch) AS size, count(*) AS "order", max(d) AS max_degree, (SELECT count(*) FROM t WHERE t.batch = deg.batch) AS num_triangles, max(d + coalesce(p.t, 0)) AS scan1
FROM deg LEFT JOIN p USING (batch, n) GROUP BY batch""")
def g9_dynamic(spark, d):
    """Invariants of the graph of all orders after each batch of changes."""
    graph, out = dynamic.DynamicGraph(spark), None
    for batch, changes in _changes(spark, d):
        graph.apply(changes)
        row = graph.invariants().withColumn("batch", F.lit(batch))
        row = spark.createDataFrame(row.collect(), row.schema)  # one row
        out = row if out is None else out.unionByName(row)
    return out


@query()
def g9_mad_lower_k(spark, d):
    """1000 times a lower bound of the largest average degree among customers linked by orders."""
    e = arcs(spark, d).where("src <> dst").select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct()
    return spark.createDataFrame([(dynamic.mad_lower_k(e),)], "mad_lower_k long")


_DEPTH = f"{_ARCS}, r AS (SELECT id, 0 AS depth FROM nodes WHERE id NOT IN (SELECT dst FROM arcs) UNION SELECT a.dst, r.depth + 1 FROM r JOIN arcs a ON a.src = r.id), n AS (SELECT id, depth, row_number() OVER (ORDER BY depth, id) - 1 AS node FROM (SELECT id, max(depth)::INTEGER AS depth FROM r GROUP BY 1))"


@query(f"WITH RECURSIVE {_DEPTH} SELECT id, depth, node FROM n")
def g3_canonical_nodes(spark, d):
    """Nodes numbered in a topological order."""
    return orders.canonical_dag(arcs(spark, d))[0]


@query(f"WITH RECURSIVE {_DEPTH} SELECT a.id, row_number() OVER (ORDER BY y.node, a.id) - 1 AS arc, x.node AS src, y.node AS dst, a.label FROM arcs a JOIN n x ON x.id = a.src JOIN n y ON y.id = a.dst")
def g3_canonical_arcs(spark, d):
    """Arcs by the numbers of their nodes, in the order of the canonical graph."""
    return orders.canonical_dag(arcs(spark, d))[1]


@query(f"""WITH RECURSIVE {_ARCS}, f AS (SELECT id FROM nodes WHERE id % 7 = 3 UNION SELECT a.dst FROM f JOIN arcs a ON a.src = f.id),
b AS (SELECT id FROM nodes WHERE id < 9 UNION SELECT a.src FROM b JOIN arcs a ON a.dst = b.id)
SELECT id, src, dst, label FROM arcs WHERE src IN (SELECT id FROM f) AND dst IN (SELECT id FROM f) AND src IN (SELECT id FROM b) AND dst IN (SELECT id FROM b)""")
def g3_closure_lattice(spark, d):
    """The arcs between every seventh customer and the smallest numbers."""
    a = arcs(spark, d)
    return orders.closure_lattice(a, nodes(a).where("id % 7 = 3"), nodes(a).where("id < 9"))[1]


@query(f"""WITH RECURSIVE {_ARCS}, w AS (SELECT * FROM arcs UNION ALL SELECT -id - 1, dst, src, label FROM arcs WHERE id % 3 = 0),
r AS (SELECT src AS a, dst AS b FROM w UNION SELECT r.a, w.dst FROM r JOIN w ON w.src = r.b), c AS (SELECT a FROM r WHERE a = b),
core AS (SELECT b AS id FROM r WHERE a IN (SELECT a FROM c) INTERSECT SELECT a FROM r WHERE b IN (SELECT a FROM c))
SELECT id, src, dst, label FROM w WHERE NOT (src > dst AND src IN (SELECT id FROM core) AND dst IN (SELECT id FROM core))""")
def g3_without_cycles(spark, d):
    """Every third order also leads back; the cycles are broken where they lead to smaller numbers."""
    a = arcs(spark, d)
    back = a.where("id % 3 = 0").select((-F.col("id") - 1).alias("id"), F.col("dst").alias("src"), F.col("src").alias("dst"), "label")
    return orders.without_cycles(a.unionByName(back))


@query(f"WITH RECURSIVE {_ARCS}, e AS (SELECT src, dst, min(id % 13)::DOUBLE AS cost FROM arcs GROUP BY 1, 2), p AS (SELECT dst AS node, cost FROM e WHERE src = (SELECT max(src) FROM e) UNION ALL SELECT e.dst, p.cost + e.cost FROM p JOIN e ON e.src = p.node) SELECT k::INTEGER AS rank, cost FROM (SELECT cost, row_number() OVER (ORDER BY cost) AS k FROM p WHERE node = 0) WHERE k <= 5")
def t4_best_paths(spark, d):
    a = arcs(spark, d).groupBy("src", "dst").agg(F.min(F.col("id") % 13).cast("double").alias("cost"))
    start = a.agg(F.max("src")).first()[0]
    return tables.best_paths(a, start, 0, 5).select("rank", "cost")


@query(f"WITH {_ARCS} SELECT src, dst, label FROM arcs UNION ALL SELECT src + (SELECT max(id) + 1 FROM nodes), dst + (SELECT max(id) + 1 FROM nodes), label FROM arcs")
def u5_disjoint_union(spark, d):
    a = arcs(spark, d).select("src", "dst", "label")
    return tables.disjoint_union(a, a)


@query(f"WITH {_ARCS} SELECT DISTINCT src, dst, label FROM arcs")
def u4_set_graph(spark, d):
    return tables.set_graph(arcs(spark, d)).select("src", "dst", "label")


@query(f"WITH {_ARCS} SELECT a.src AS s1, b.src AS s2, a.dst AS d1, b.dst AS d2, a.label AS ilabel, b.label AS olabel FROM arcs a JOIN arcs b ON a.id % 5000 = (b.id + 1) % 5000")
def j14_compose(spark, d):
    a = arcs(spark, d)
    first = a.select("src", "dst", F.col("label").alias("ilabel"), (F.col("id") % 5000).alias("olabel"))
    second = a.select("src", "dst", ((F.col("id") + 1) % 5000).alias("ilabel"), F.col("label").alias("olabel"))
    return tables.compose(first, second).select(F.col("src.s1").alias("s1"), F.col("src.s2").alias("s2"), F.col("dst.d1").alias("d1"), F.col("dst.d2").alias("d2"), "ilabel", "olabel")


@query(f"""WITH {_ARCS}, e AS (SELECT DISTINCT least(src, dst) AS u, greatest(src, dst) AS v FROM arcs WHERE src <> dst), b AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e), deg AS (SELECT u AS n, count(*) AS d FROM b GROUP BY 1),
t AS (SELECT x.u AS a, x.v AS b, y.v AS c FROM e x JOIN e y ON x.v = y.u JOIN e z ON z.u = x.u AND z.v = y.v), pt AS (SELECT n, count(*) AS t FROM (SELECT unnest([a, b, c]) AS n FROM t) GROUP BY 1)
SELECT (SELECT count(*) FROM e) AS size, count(*) AS "order", max(d) AS max_degree, (SELECT count(*) FROM t) AS triangles, max(d + coalesce(t, 0)) AS scan1 FROM deg LEFT JOIN pt USING (n)""")
def g9_invariants(spark, d):
    return tables.invariants(arcs(spark, d).select(F.col("src").alias("u"), F.col("dst").alias("v")))


