"""Queries over the text sources, remaining models and generators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import alignment
from ..graphs import tables
from ..models import gaussian, latent, toolbox
from ..operators import metrics, segments, streams
from ..sources import annotations, feature_files, text_data
from .model_queries import _ARCS, arcs
from .queries import SEGS, events, frames, query, segs, table


@query("SELECT page_id, split_part(url, '/', 3) AS host, nullif(split_part(url, '/', 4), '') AS lang FROM pages WHERE url LIKE '%://%/%'")
def s13_list_columns(spark, d):
    p = table(spark, d, "pages").where("url like '%://%/%'")
    cut = annotations.list_columns(p, "url", ["scheme", "none", "host", "lang"], "/", ["page_id"])
    return cut.select("page_id", "host", F.when(F.col("lang") != "", F.col("lang")).alias("lang"))


@query("SELECT c_nationkey::VARCHAR AS file, 'names' AS file_type, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1)::INTEGER AS row, [c_name, '# ' || c_mktsegment, ''] AS tokens FROM customer")
def s22_text_data(spark, d):
    """Customers of each nation written as text data and read back: marks of comments, blanks and empty tokens survive."""
    c = table(spark, d, "customer").select(F.col("c_nationkey").cast("string").alias("file"), F.col("c_custkey").alias("row"), F.array("c_name", F.concat(F.lit("# "), "c_mktsegment"), F.lit("")).alias("tokens"))
    files = text_data.text_data_files(c, "file", "row", "tokens", "names", "0")
    return text_data.parsed_files(files, "names", "0").select("file", "file_type", "row", "tokens")


@query("SELECT (vec_id // 50)::VARCHAR AS utt, (vec_id % 50 + 1)::INTEGER AS frame, i - 1 AS i, round(embedding[i]::DOUBLE, 6) AS value FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS i FROM embeddings)".replace("i - 1 AS i", "(i - 1)::INTEGER AS i"))
def s1_feature_files(spark, d):
    """Each utterance's vectors written as a feature file and read back."""
    f = frames(spark, d).select(F.col("utt").cast("string").alias("utt"), "frame", F.col("x").cast("array<float>").alias("features"))
    files = feature_files.encoded_files(f).select(F.concat("utt", F.lit(".fea")).alias("path"), "content")
    rows = feature_files.decoded_files(files).select("utt", "frame", F.posexplode("features").alias("i", "value"))
    return rows.withColumn("value", F.round(F.col("value").cast("double"), 6))


@query(f"WITH {SEGS} SELECT '*/' || user_id || '.rec' AS name, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1)::INTEGER AS seg, (start * 100000)::BIGINT AS start_100ns, (stop * 100000)::BIGINT AS end_100ns, label FROM seg")
def s7_label_blocks(spark, d):
    """Each user's segments written as a container and read back."""
    s = segs(spark, d).select(F.col("user_id").cast("string").alias("utt"), (F.col("start") * 100000).cast("long").alias("start_100ns"), (F.col("stop") * 100000).cast("long").alias("end_100ns"), "label")
    return annotations.label_blocks_of(annotations.container_text(s)).drop("score")


@query("SELECT 'sad/' || c_name || '.lab' AS \"to\", 'audio/' || c_name || '_16000.wav' AS path FROM customer WHERE c_custkey % 3 = 0")
def s15_corresponding(spark, d):
    c = table(spark, d, "customer")
    have = c.where("c_custkey % 3 = 0").select(F.concat(F.lit("sad/"), "c_name", F.lit(".lab")).alias("other"))
    paths = c.select(F.concat(F.lit("audio/"), "c_name", F.lit("_16000.wav")).alias("path"))
    return annotations.corresponding(paths, "path", have, "other", [("_16000", ""), ("^audio/", "sad/")], ".lab")


@query("SELECT c_custkey, try_cast(substr(c_name, 10) AS DOUBLE) AS a, try_cast(c_mktsegment AS DOUBLE) AS b FROM customer")
def s24_numerify(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.substring("c_name", 10, 100).alias("a"), F.col("c_mktsegment").alias("b"))
    return annotations.numerify(c, "a", "b")


@query(f"WITH {SEGS} SELECT 'u' || user_id AS utt, event_id AS seg, (start * 100000)::BIGINT AS start_100ns, (stop * 100000)::BIGINT AS end_100ns, label FROM seg")
def s6_annotations(spark, d):
    s = segs(spark, d)
    rows = s.select(F.concat(F.lit("x/u"), "user_id", F.lit(".tab")).alias("file"), F.col("event_id").alias("line_no"), F.concat_ws(" ", F.lit("f"), F.lit("1"), (F.col("start") / 100).cast("string"), (F.col("stop") / 100).cast("string"), "label").alias("line"))
    return annotations.annotations(rows)


@query(f"""WITH {SEGS}, m AS (SELECT *, CASE WHEN label IN ('view', 'click') THEN 'S' ELSE 'NS' END AS l FROM seg), c AS (SELECT *, CASE WHEN l IS DISTINCT FROM lag(l) OVER (PARTITION BY user_id ORDER BY event_id) THEN 1 ELSE 0 END AS ch FROM m),
r AS (SELECT *, sum(ch) OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS run FROM c)
SELECT 'u' || user_id AS utt, run::BIGINT AS seg, min((start * 100000)::BIGINT) AS start_100ns, max((stop * 100000)::BIGINT) AS end_100ns, any_value(l) AS label FROM r GROUP BY user_id, run""")
def s5_merged_annotations(spark, d):
    m = spark.createDataFrame([("view", "S"), ("click", "S"), ("error", "NS"), ("signup", "NS"), ("purchase", "NS")], "source string, target string")
    return annotations.merged_annotations(s6_annotations(spark, d), m, "source", "target").withColumn("seg", F.col("seg").cast("long"))


@query("""WITH l AS (SELECT user_id, event_id, CASE WHEN event_type IN ('view', 'click') THEN 'S' ELSE 'N' END AS label, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events)
SELECT user_id AS utt, string_agg(((k - 1) * 10)::BIGINT || ' ' || (k * 10)::BIGINT || ' ' || label, chr(10) ORDER BY k) AS value FROM l GROUP BY user_id""")
def k5_label_lines(spark, d):
    rows = streams.numbered(events(spark, d), ["user_id"], ["event_id"])
    s = rows.select(F.col("user_id").alias("utt"), (F.col("pos") * 10).cast("long").alias("start_100ns"), (F.col("pos") * 10 + 10).cast("long").alias("end_100ns"), F.when(F.col("event_type").isin("view", "click"), "S").otherwise("N").alias("label"))
    return annotations.label_lines(s)


@query("SELECT o_orderkey AS k FROM orders UNION ALL SELECT l_orderkey FROM lineitem")
def u1_union(spark, d):
    return streams.merge_streams(table(spark, d, "orders").select(F.col("o_orderkey").alias("k")), table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k")))


@query("""WITH v AS (SELECT vec_id // 50 AS utt, label, count(*) AS n FROM embeddings GROUP BY 1, 2), h AS (SELECT utt, label AS hyp FROM (SELECT *, row_number() OVER (PARTITION BY utt ORDER BY n DESC, label) AS k FROM v) WHERE k = 1),
f AS (SELECT vec_id // 50 AS utt, label AS ref FROM embeddings WHERE vec_id % 50 = 0) SELECT ref, hyp, count(*) AS n FROM f JOIN h USING (utt) GROUP BY 1, 2""")
def a2_single_label(spark, d):
    f = frames(spark, d)
    votes = f.groupBy("utt", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("utt").agg(F.max(F.struct("n", (-F.col("label")).alias("m"))).alias("b")).select("utt", (-F.col("b.m")).alias("hyp"))
    return metrics.confusion(f.where("frame = 1").select("utt", F.col("label").alias("ref0")).join(votes, "utt"), "ref0", "hyp")


@query(f"WITH {_ARCS}, e AS (SELECT count(*) AS e FROM (SELECT DISTINCT src, dst FROM arcs)), n AS (SELECT count(*) AS n FROM nodes) SELECT e * e AS tensor, 2 * e * n AS cartesian, 2 * e * n + e * e AS normal, e * n * n + e * n AS lexicographic, 2 * e * n * n - e * e AS conormal FROM e, n")
def j14_product_sizes(spark, d):
    a = arcs(spark, d)
    n = a.select(F.explode(F.array("src", "dst"))).distinct().count()
    sizes = tables.product_sizes(n, a, n, a)
    return spark.createDataFrame([tuple(sizes.values())], ", ".join(f"{k} long" for k in sizes))


@query("SELECT r_regionkey, n_nationkey, levenshtein(r_name, n_name)::DOUBLE AS best, 3 AS n, true AS ascending FROM region, nation")
def t5_best_alignments(spark, d):
    """The three cheapest alignments of each region's name with each nation's: the best cost, and that they ascend."""
    r, n = table(spark, d, "region"), table(spark, d, "nation")
    pairs = r.withColumn("_k", F.lit(1)).join(n.withColumn("_k", F.lit(1)), "_k").select("r_regionkey", "n_nationkey", "r_name", "n_name")  # five by twenty-five names
    rows = alignment.best_alignment_rows(pairs, ["r_regionkey", "n_nationkey"], "r_name", "n_name", 3)
    costs = F.transform(F.array_sort(F.collect_list(F.struct("rank", "cost"))), lambda s: s["cost"])
    return rows.groupBy("r_regionkey", "n_nationkey").agg(F.min("cost").alias("best"), F.count(F.lit(1)).cast("int").alias("n"), (costs == F.array_sort(costs)).alias("ascending"))


@query("SELECT c_custkey AS id, min(c_custkey) OVER (PARTITION BY c_nationkey) AS component FROM customer UNION ALL SELECT 1000000000 + c_nationkey, min(c_custkey) FROM customer GROUP BY c_nationkey")
def g7_components(spark, d):
    """Customers joined to their nations: a connected part a nation."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("src"), (F.lit(1_000_000_000) + F.col("c_nationkey")).cast("long").alias("dst"))
    return tables.components(c)


@query(f"""WITH RECURSIVE {_ARCS}, a AS (SELECT DISTINCT src, dst, label FROM arcs), top AS (SELECT max(src) AS s FROM arcs),
p AS (SELECT s AS s1, s AS s2 FROM top UNION SELECT d1, d2 FROM (
SELECT x.dst AS d1, y.dst AS d2 FROM p JOIN a x ON x.src = p.s1 JOIN a y ON y.src = p.s2 AND y.label = x.label WHERE x.label <> '1'
UNION ALL SELECT x.dst, p.s2 FROM p JOIN a x ON x.src = p.s1 WHERE x.label = '1' UNION ALL SELECT p.s1, y.dst FROM p JOIN a y ON y.src = p.s2 WHERE y.label = '1'))
SELECT p.s1, p.s2, x.dst AS d1, y.dst AS d2, x.label AS ilabel, y.label AS olabel FROM p JOIN a x ON x.src = p.s1 JOIN a y ON y.src = p.s2 AND y.label = x.label WHERE x.label <> '1'
UNION ALL SELECT p.s1, p.s2, x.dst, p.s2, '1', '1' FROM p JOIN a x ON x.src = p.s1 WHERE x.label = '1' UNION ALL SELECT p.s1, p.s2, p.s1, y.dst, '1', '1' FROM p JOIN a y ON y.src = p.s2 WHERE y.label = '1'""")
def j14_reachable(spark, d):
    """The graph composed with itself from its largest node, arcs of label 1 moving alone."""
    a = tables.set_graph(arcs(spark, d).select("src", "dst", "label")).select("src", "dst", F.col("label").alias("ilabel"), F.col("label").alias("olabel"))
    start = a.agg(F.max("src")).first()[0]
    return tables.compose_reachable(a, a, (start, start), "1")


@query()
def g8_random_arcs(spark, d):
    return tables.random_arcs(spark, 1000, 5000, 7, acyclic=True)


@query()
def m19_discriminant(spark, d):
    f = frames(spark, d).select("label", "x")
    a = toolbox.discriminant_transform(f, "label", "x", 2, 3)
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(a)], "i int, row array<double>")


@query()
def m30_activity(spark, d):
    f = frames(spark, d).withColumn("power", F.transform("x", lambda v: v * v))
    return toolbox.detect_activity(f, ["utt"], "frame", "power")


@query()
def m33_synthetic(spark, d):
    models = {k: gaussian.Mixture([1.0], [[m, m]], [[1.0, 1.0]]) for k, m in (("a", 0.0), ("b", 3.0))}
    return toolbox.labelled_segments(spark, models, 20, 4, 10)


@query()
def m32_logistic(spark, d):
    f = frames(spark, d).withColumn("y", (F.col("label") == 1).cast("double"))
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(toolbox.logistic_fit(f, "x", "y", 4))], "i int, weight double")


@query("""WITH f AS (SELECT c_nationkey AS o, c_custkey, unnest(['"' || c_custkey || '.lab"', c_mktsegment, '.']) AS line, unnest([0, 1, 2]) AS p FROM customer)
SELECT 0::BIGINT AS line_no, '#!MLF!#' AS line UNION ALL SELECT row_number() OVER (ORDER BY o, c_custkey, p), line FROM f""")
def k5_container_lines(spark, d):
    """A container for each nation's customers, joined into one as lines."""
    c = table(spark, d, "customer").select("c_nationkey", "c_custkey", F.concat(F.lit('"'), F.col("c_custkey").cast("string"), F.lit('.lab"\n'), "c_mktsegment", F.lit("\n.")).alias("block"))
    files = c.groupBy("c_nationkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "block"))), lambda x: x["block"]), "\n").alias("blocks"))
    return annotations.container_lines(files.select("c_nationkey", F.concat(F.lit("#!MLF!#\n"), "blocks", F.lit("\n")).alias("value")), "c_nationkey")


@query()
def m5_low_rank(spark, d):
    """Log likelihood before each step of a mixture of three Gaussians of four factors."""
    _, trace = latent.fit_low_rank(frames(spark, d), "x", 3, 4, iterations=6)
    return spark.createDataFrame(list(enumerate(trace)), "step int, loglik double")


@query()
def m32_topographic(spark, d):
    """Every vector's mean place and likeliest point on a latent grid of 64 points."""
    f = frames(spark, d)
    model, _ = latent.fit_topographic(f, "x", iterations=4)
    return latent.latent_places(f, "x", model).select("vec_id", "mean", "mode")


@query()
def m32_density_network(spark, d):
    """The mean error after each step of a network whose outputs are mixtures over the label."""
    f = frames(spark, d).withColumn("y", F.array(F.col("label").cast("double")))
    _, trace = latent.fit_density_network(f, "x", "y", latent.DensityNetwork(64, 6, 3, 1), iterations=6)
    return spark.createDataFrame(list(enumerate(trace)), "step int, error double")
