"""Queries over the operators, with their SQL.

Frames are rows of ``embeddings`` (utterance: fifty vectors), segments and streams
come from ``events`` (one stream a user), scored pairs from ``labels``, tokens from
texts, arcs from keys.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dsp
from ..operators import framing, metrics, segments, streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.expr("vec_id div 50").alias("utt"), (F.col("vec_id") % 50 + 1).cast("int").alias("frame"), F.col("embedding").cast("array<double>").alias("x"), "label")


def events(spark, d):
    return table(spark, d, "events").select("event_id", "user_id", "event_type", "value")


def segs(spark, d, parts: int = 0):
    """``parts``: users are dealt to so many tasks."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    rows = events(spark, d)
    return (rows.repartition(parts, "user_id") if parts else rows).select("user_id", "event_id", F.col("event_type").alias("label"), (F.col("event_id") * 10.0).alias("start"), (F.coalesce(F.lead("event_id").over(w), F.col("event_id") + 1) * 10.0).alias("stop"))


#: Of lines and their events that a task makes, about.
TASK_BYTES = 16 << 20

FRAMES = "frames AS (SELECT vec_id, vec_id // 50 AS utt, (vec_id % 50 + 1)::INTEGER AS frame, embedding::DOUBLE[] AS x, label FROM embeddings)"
SEGS = "seg AS (SELECT user_id, event_id, event_type AS label, event_id * 10.0::DOUBLE AS start, coalesce(lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id), event_id + 1) * 10.0::DOUBLE AS stop FROM events)"
POS = "pos AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS n FROM events)"


# ---- segments and frames -------------------------------------------------
@query(f"""WITH {SEGS}, c AS (SELECT *, CASE WHEN label IS DISTINCT FROM lag(label) OVER w THEN 1 ELSE 0 END AS ch FROM seg WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
r AS (SELECT *, sum(ch) OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS run FROM c)
SELECT user_id, run::BIGINT AS run, any_value(label) AS label, min(start) AS start, max(stop) AS stop, count(*) AS n FROM r GROUP BY user_id, run""")
def a7_run_merge(spark, d):
    return segments.merge_runs(segs(spark, d), ["user_id"], ["event_id"], "label", "start", "stop").withColumn("run", F.col("run").cast("long"))


#: Segments on each user's own positions, a hundred units an event and 60 to 260 long, so that they overlap.
SPANS = "span AS (SELECT user_id, event_id, event_type AS label, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) * 100.0::DOUBLE + event_id % 3 * 20 AS start, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) * 100.0::DOUBLE + event_id % 3 * 20 + 60 + event_id % 5 * 50 AS stop FROM events)"


def spans(spark, d):
    pos = (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1) * F.lit(100.0)
    rows = events(spark, d).select("user_id", "event_id", F.col("event_type").alias("label"), (pos + F.col("event_id") % 3 * 20).alias("start"))
    return rows.withColumn("stop", F.col("start") + 60 + F.col("event_id") % 5 * 50)


def _framed(name: str, stop: str) -> str:
    """SQL of the frames of 25 units of each segment, by the sequential rule, as table ``name``."""
    return f"""s{name} AS (SELECT user_id, label, greatest(1, trunc(start / 25.0))::INTEGER AS a0, greatest(1, trunc({stop} / 25.0) - 1)::INTEGER AS b0, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM span),
f{name} AS (SELECT user_id, k, label, greatest(a0, 1) AS a, greatest(b0, greatest(a0, 1)) AS b FROM s{name} WHERE k = 1
UNION ALL SELECT s.user_id, s.k, s.label, greatest(s.a0, f.b + 1), greatest(s.b0, greatest(s.a0, f.b + 1)) FROM f{name} f JOIN s{name} s ON s.user_id = f.user_id AND s.k = f.k + 1),
l{name} AS (SELECT user_id, label, b + 1 AS frame FROM f{name} WHERE (user_id, k) IN (SELECT user_id, max(k) FROM f{name} GROUP BY user_id)),
r{name} AS (SELECT user_id, label, unnest(range(a, b + 1)) AS frame FROM f{name} UNION ALL SELECT user_id, label, frame FROM l{name}),
{name} AS (SELECT user_id, frame::INTEGER AS frame, label, row_number() OVER (PARTITION BY user_id ORDER BY frame)::INTEGER AS pos FROM r{name})"""


@query(f"WITH RECURSIVE {SPANS}, {_framed('ref', 'stop')} SELECT user_id, frame, label, pos FROM ref")
def c1_timestamps_to_frames(spark, d):
    """About four frames an event, of segments that overlap."""
    return segments.segments_to_frames(spans(spark, d), ["user_id"], ["event_id"], "start", "stop", "label", 25.0).select("user_id", "frame", "label", "pos")


@query(f"WITH RECURSIVE {SPANS}, {_framed('ref', 'stop')}, {_framed('hyp', '(stop - 30)')} SELECT r.label AS ref, h.label AS hyp, count(*) AS n FROM ref r JOIN hyp h USING (user_id, pos) GROUP BY 1, 2")
def c2_evaluated_frames(spark, d):
    """Segments to frames, those of shorter segments as hypotheses, and a comparison by position."""
    ref = segments.segments_to_frames(spans(spark, d), ["user_id"], ["event_id"], "start", "stop", "label", 25.0)
    hyp = segments.segments_to_frames(spans(spark, d).withColumn("stop", F.col("stop") - 30), ["user_id"], ["event_id"], "start", "stop", "label", 25.0)
    both = ref.drop("frame").join(hyp.select("user_id", "pos", F.col("label").alias("hyp")), ["user_id", "pos"])
    return metrics.confusion(both, "label", "hyp")


@query(f"""WITH {SEGS}, len AS (SELECT user_id, (max(event_id) // 100 + 2)::INTEGER AS len FROM events GROUP BY user_id), sp AS (SELECT user_id, unnest(range(1, len + 1)) AS frame FROM len),
v AS (SELECT user_id, least(len, greatest(1, floor((start - 1500.0) / 1000.0 + 0.5))) AS a, least(len, greatest(1, floor((start + 500.0 - 1500.0) / 1000.0 + 0.5))) AS b FROM seg JOIN len USING (user_id) WHERE label = 'view')
SELECT sp.user_id, sp.frame::INTEGER AS frame, max(CASE WHEN v.a IS NULL THEN 0 ELSE 1 END)::INTEGER AS speech FROM sp LEFT JOIN v ON v.user_id = sp.user_id AND sp.frame BETWEEN v.a AND greatest(v.a, v.b) GROUP BY 1, 2""")
def c3_times_to_indicator(spark, d):
    s = segs(spark, d).where("label = 'view'").withColumn("stop", F.col("start") + 500.0)
    lengths = events(spark, d).groupBy("user_id").agg((F.floor(F.max("event_id") / 100) + 2).cast("int").alias("len"))
    return segments.timestamps_to_indicator(s, ["user_id"], "start", "stop", lengths, "len", 1000.0, 2500.0)


_SPEECH = f"""{POS}, i AS (SELECT user_id, pos + 1 AS frame, n, CASE WHEN event_type IN ('view', 'click') THEN 1 ELSE 0 END AS speech FROM pos),
c AS (SELECT *, CASE WHEN speech IS DISTINCT FROM lag(speech) OVER (PARTITION BY user_id ORDER BY frame) THEN 1 ELSE 0 END AS ch FROM i),
r AS (SELECT *, sum(ch) OVER (PARTITION BY user_id ORDER BY frame) AS run FROM c),
g AS (SELECT user_id, run, any_value(n) AS n, any_value(speech) AS speech, min(frame) AS a, max(frame) AS b FROM r GROUP BY user_id, run)"""


def indicator(spark, d):
    return streams.numbered(events(spark, d), ["user_id"], ["event_id"]).select("user_id", (F.col("pos") + 1).alias("frame"), F.col("event_type").isin("view", "click").cast("int").alias("speech"))


@query(f"""WITH {_SPEECH} SELECT user_id, CASE WHEN a = 1 THEN 0.0::DOUBLE ELSE (a - 1) * 10.0::DOUBLE + 12.5 END AS start, CASE WHEN b = n THEN (n - 1) * 10.0::DOUBLE ELSE (b - 1) * 10.0::DOUBLE + 12.5 END AS "end" FROM g WHERE speech = 1""")
def c4_indicator_to_times(spark, d):
    return segments.indicator_to_timestamps(indicator(spark, d), ["user_id"], "frame", "speech", 10.0, 25.0)


@query(f"""WITH {_SPEECH} SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY a) - 1)::BIGINT AS run, ((a - 1) * 100000)::BIGINT AS start, (b * 100000)::BIGINT AS "end", speech::INTEGER AS speech FROM g""")
def c5_frames_to_segments(spark, d):
    out = segments.frames_to_segments(indicator(spark, d), ["user_id"], "frame", "speech", 100000)
    return out.select("user_id", F.col("run").cast("long").alias("run"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "speech")


@query(f"""WITH {SEGS} SELECT user_id, coalesce(string_agg(repeat(left(label, 1) || ' ', trunc((stop - start) / 200.0)::INTEGER), '' ORDER BY event_id), '') AS symbols FROM seg GROUP BY user_id""".replace("coalesce(string_agg", "rtrim(coalesce(string_agg").replace("ORDER BY event_id), '')", "ORDER BY event_id), ''))"))
def c6_symbol_sequence(spark, d):
    """Users are dealt to tasks by the bytes of their lines, which are far more than their events' bytes."""
    # a line lasts from its user's first event to the last, two characters each 200; an event is held by about 100 bytes
    of_user = events(spark, d).groupBy("user_id").agg((F.max("event_id") - F.min("event_id")).alias("_n"), F.count(F.lit(1)).alias("_k"))
    size = of_user.agg(F.coalesce(F.sum(F.col("_n") / 10 + F.col("_k") * 100), F.lit(0.0))).first()[0]
    parts = max(int(size // TASK_BYTES) + 1, spark.sparkContext.defaultParallelism)
    return segments.symbol_sequence(segs(spark, d, parts), ["user_id"], ["event_id"], F.col("stop") - F.col("start"), F.substring("label", 1, 1), 200.0)


@query(f"""WITH {FRAMES}, s AS (SELECT vec_id // 50 AS utt, label, vec_id, (vec_id % 50) * 0.01::DOUBLE AS a, ((vec_id % 50) + 3) * 0.01::DOUBLE AS b FROM embeddings WHERE vec_id % 10 = 0)
SELECT f.utt, f.frame, s.label AS seg_label, count(*) AS n FROM frames f JOIN s ON f.utt = s.utt AND f.frame BETWEEN floor(s.a / 0.01::DOUBLE + 0.5) + 1 AND floor(s.b / 0.01::DOUBLE + 0.5) GROUP BY 1, 2, 3""")
def j2_frames_in_segments(spark, d):
    f = frames(spark, d)
    s = f.where("vec_id % 10 = 0").select("utt", F.col("label").alias("seg_label"), ((F.col("frame") - 1) * 0.01).alias("a"), ((F.col("frame") + 2) * 0.01).alias("b"))
    return segments.frames_in_segments(f.select("utt", "frame"), s, ["utt"], "frame", "a", "b", 0.01).groupBy("utt", "frame", "seg_label").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {FRAMES} SELECT utt, frame FROM frames WHERE (frame - 1) % 25 BETWEEN 3 AND 5""")
def j3_middle_third(spark, d):
    f = frames(spark, d)
    s = f.where("(frame - 1) % 25 = 0").select("utt", (F.col("frame") - 1.0).alias("a"), (F.col("frame") + 8.0).alias("b"))
    return segments.frames_in_segments(f.select("utt", "frame"), s, ["utt"], "frame", "a", "b", 1.0, (1 / 3, 2 / 3)).select("utt", "frame")


@query("""WITH i AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, CASE WHEN event_type IN ('view', 'click') THEN 1 ELSE 0 END AS s FROM events),
j AS (SELECT a.user_id, a.k, sum(b.s) AS ones FROM i a JOIN i b ON a.user_id = b.user_id AND b.k BETWEEN a.k - 2 AND a.k + 2 GROUP BY 1, 2)
SELECT user_id, k::INTEGER AS frame, CASE WHEN ones >= 3 THEN 1 ELSE 0 END::INTEGER AS smoothed FROM j""")
def w6_median_filter(spark, d):
    return segments.median_filter(indicator(spark, d), ["user_id"], "frame", "speech", 5).select("user_id", "frame", "smoothed")


@query("""WITH i AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, CASE WHEN event_type IN ('view', 'click') THEN 1 ELSE 0 END AS s FROM events),
j AS (SELECT a.user_id, a.k, sum(b.s) AS ones FROM i a JOIN i b ON a.user_id = b.user_id AND b.k BETWEEN a.k - 2 AND a.k + 1 GROUP BY 1, 2)
SELECT user_id, k::INTEGER AS frame, CASE WHEN ones >= 2 THEN 1 ELSE 0 END::INTEGER AS smoothed FROM j""")
def w6_median_filter_even(spark, d):
    return segments.median_filter(indicator(spark, d), ["user_id"], "frame", "speech", 4).select("user_id", "frame", "smoothed")


# ---- rows and streams ------------------------------------------------------
@query(f"WITH {POS} SELECT event_id, user_id, event_type, value FROM pos WHERE pos % 10 = 0")
def p3_decimate(spark, d):
    return streams.decimate(events(spark, d), ["user_id"], ["event_id"], 10)


@query(f"WITH {FRAMES} SELECT utt, frame, label FROM frames WHERE (frame - 1) % 10 = 0")
def p4_subsample(spark, d):
    return streams.decimate(frames(spark, d), ["utt"], ["frame"], 10).select("utt", "frame", "label")


@query("SELECT event_id, value * 2 + 1 AS y FROM events")
def p1_map(spark, d):
    return events(spark, d).transform(lambda f: f.select("event_id", (F.col("value") * 2 + 1).alias("y")))


@query("SELECT conv_id, turn, pos::INTEGER AS token_pos, token FROM (SELECT conv_id, turn, unnest(range(len(t))) AS pos, unnest(t) AS token FROM (SELECT conv_id, turn, string_split(text, ' ') AS t FROM conversations WHERE text IS NOT NULL))")
def p2_flat_map(spark, d):
    return streams.flat_map(table(spark, d, "conversations").where("text is not null").select("conv_id", "turn", F.split("text", " ", -1).alias("t")), F.col("t"), "token").drop("t")


@query(f"WITH {FRAMES} SELECT utt, count(*) AS n FROM frames WHERE utt NOT IN (SELECT utt FROM frames WHERE x[1] > 0.28) GROUP BY utt")
def p6_drop_nan_parts(spark, d):
    f = frames(spark, d).withColumn("x", F.transform("x", lambda v, i: F.when((i == 0) & (v > 0.28), F.lit(float("nan"))).otherwise(v)))
    return streams.drop_parts_with_nan(f, ["utt"], F.col("x")).groupBy("utt").agg(F.count(F.lit(1)).alias("n"))


_MAP = "CASE event_type WHEN 'click' THEN 'S' WHEN 'view' THEN 'S' WHEN 'error' THEN 'NT' ELSE 'NS' END"


def label_map(spark):
    return spark.createDataFrame([("click", "S"), ("view", "S"), ("error", "NT"), ("signup", "NS"), ("purchase", "NS")], "source string, target string")


@query(f"SELECT event_id, {_MAP} AS event_type FROM events")
def p7_label_map(spark, d):
    return streams.map_labels(events(spark, d), "event_type", label_map(spark), "source", "target").select("event_id", "event_type")


@query(f"SELECT event_id, CASE {_MAP} WHEN 'S' THEN '1' WHEN 'NS' THEN '0' WHEN 'NT' THEN '0' END AS id FROM events")
def p8_labels_to_ids(spark, d):
    mapped = streams.map_labels(events(spark, d), "event_type", label_map(spark), "source", "target")
    return mapped.select("event_id", F.when(F.col("event_type") == "S", "1").when(F.col("event_type").isin("NS", "NT"), "0").otherwise(F.col("event_type")).alias("id"))


@query(f"WITH {FRAMES} SELECT vec_id, x[1:6] AS head FROM frames")
def p9_first_dims(spark, d):
    return frames(spark, d).select("vec_id", F.slice("x", 1, 6).alias("head"))


@query(f"WITH {FRAMES}, a AS (SELECT vec_id, list_transform(x, lambda v: abs(v)) AS x FROM frames) SELECT vec_id, round(x[1] / list_sum(x), 6) AS first, round(list_sum(list_transform(x, lambda v: v / list_sum(x))), 6) AS total FROM a")
def p10_l1_normalise(spark, d):
    y = dsp.normalise_l1(F.transform("x", F.abs))
    return frames(spark, d).select("vec_id", y.alias("y")).select("vec_id", F.round(F.col("y")[0], 6).alias("first"), F.round(F.aggregate("y", F.lit(0.0), lambda a, b: a + b), 6).alias("total"))


@query("SELECT user_id, list([e, v] ORDER BY e) AS bands FROM (SELECT user_id, CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END::DOUBLE AS e, count(*)::DOUBLE AS v FROM events GROUP BY 1, 2) GROUP BY user_id")
def p11_band_concat(spark, d):
    band = F.array_position(F.array(*map(F.lit, ("click", "error", "purchase", "signup", "view"))), F.col("event_type")) - 1
    counts = events(spark, d).groupBy("user_id", band.cast("double").alias("e")).agg(F.count(F.lit(1)).cast("double").alias("v"))
    return counts.groupBy("user_id").agg(F.array_sort(F.collect_list(F.array("e", "v"))).alias("bands"))


@query("SELECT event_id, 'low' AS branch, value FROM events WHERE value < 20 UNION ALL SELECT event_id, 'all' AS branch, -value FROM events")
def p13_split_and_join(spark, d):
    e = events(spark, d)
    return streams.merge_streams(e.where("value < 20").select("event_id", F.lit("low").alias("branch"), "value"), e.select("event_id", F.lit("all").alias("branch"), (-F.col("value")).alias("value")))


@query(r"SELECT page_id, regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') AS line FROM pages WHERE url IS NOT NULL")
def p15_line_transform(spark, d):
    return table(spark, d, "pages").where("url is not null").select("page_id", F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "").alias("line"))


@query("""WITH t AS (SELECT o_orderkey, unnest(range(len(o_orderpriority))) AS char_pos, o_orderpriority AS s FROM orders),
b AS (SELECT o_orderkey, char_pos, substr(s, (char_pos + 1)::INTEGER, 1) AS char, unnest(range(8)) AS bit_pos FROM t WHERE substr(s, (char_pos + 1)::INTEGER, 1) <> ' ')
SELECT char, bit_pos::INTEGER AS bit_pos, ((ascii(char) >> (7 - bit_pos)::INTEGER) & 1)::INTEGER AS bit, count(*) AS n FROM b GROUP BY ALL""")
def p16_text_bits(spark, d):
    return streams.text_bits(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), F.col("o_orderpriority")).groupBy("char", "bit_pos", "bit").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH r AS (SELECT source, doc_id, quality, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL)
SELECT doc_id, CASE WHEN pos < floor(0.1 * n + 0.5) THEN 1 - quality ELSE quality END::INTEGER AS quality FROM r""")
def p17_flip_labels(spark, d):
    r = table(spark, d, "labels").where("quality is not null").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return streams.flip_first(r, ["source"], ["doc_id"], "quality", 0.1).select("doc_id", F.col("quality").cast("int").alias("quality"))


# ---- joins -------------------------------------------------------------
@query("SELECT d.doc_id, d.lang, l.quality FROM documents d JOIN labels l USING (doc_id)")
def j1_key_join(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id")


def two_streams(spark, d):
    e = events(spark, d)
    return e.where("event_type = 'view'").select("user_id", "event_id"), e.where("event_type = 'click'").select("user_id", F.col("event_id").alias("other_id"))


_TWO = """a AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos FROM events WHERE event_type = 'view'),
b AS (SELECT user_id, event_id AS other_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos FROM events WHERE event_type = 'click')"""


@query(f"WITH {_TWO} SELECT user_id, pos::INTEGER AS pos, event_id, other_id FROM a JOIN b USING (user_id, pos)")
def j4_positional_zip(spark, d):
    return streams.zip_positions(*two_streams(spark, d), ["user_id"], ["event_id"], ["other_id"])


@query(f"WITH {_TWO} SELECT user_id, pos::INTEGER AS pos, event_id, other_id FROM a FULL JOIN b USING (user_id, pos)")
def j5_outer_zip(spark, d):
    return streams.zip_positions(*two_streams(spark, d), ["user_id"], ["event_id"], ["other_id"], "full")


@query("SELECT event_id, user_id FROM events WHERE event_type = 'view' UNION ALL SELECT event_id, user_id FROM events WHERE event_type = 'click'")
def j6_serialising_join(spark, d):
    e = events(spark, d).select("event_id", "user_id", "event_type")
    return streams.merge_streams(e.where("event_type = 'view'"), e.where("event_type = 'click'")).drop("event_type")


@query("""WITH r AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) - 1 AS turn FROM events),
s AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_type) - 1 AS place, count(*) OVER (PARTITION BY user_id) AS k FROM s),
t AS (SELECT user_id, min(n * 1000 + place) AS stop FROM p GROUP BY 1)
SELECT user_id, event_type, event_id, turn * k + place AS seq FROM r JOIN p USING (user_id, event_type) JOIN t USING (user_id) WHERE turn * 1000 + place < stop""")
def j7_round_robin(spark, d):
    return streams.round_robin(events(spark, d).drop("value"), ["user_id"], "event_type", ["event_id"]).select("user_id", "event_type", "event_id", F.col("seq").cast("long").alias("seq"))


@query("""WITH r AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) - 1 AS slot FROM events WHERE event_type IN ('click', 'view', 'error'))
SELECT user_id, slot::INTEGER AS slot, max(event_id) FILTER (event_type = 'click') AS slot_click, max(event_id) FILTER (event_type = 'error') AS slot_error, max(event_id) FILTER (event_type = 'view') AS slot_view FROM r GROUP BY 1, 2 HAVING count(*) = 3""")
def j8_slot_join(spark, d):
    return streams.slot_join(events(spark, d), ["user_id"], "event_type", ["event_id"], "event_id", ["view", "click", "error"])


@query(f"WITH {_TWO} SELECT user_id, pos::INTEGER AS slot, other_id AS slot_click, event_id AS slot_view FROM a JOIN b USING (user_id, pos)")
def j10_synchronising_join(spark, d):
    return streams.slot_join(events(spark, d), ["user_id"], "event_type", ["event_id"], "event_id", ["view", "click"])


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events WHERE event_type IN ('view', 'click')),
s AS (SELECT user_id, k, event_id, event_type, 0 AS bundle, event_type = 'view' AS v, event_type = 'click' AS c FROM e WHERE k = 1
UNION ALL SELECT e.user_id, e.k, e.event_id, e.event_type, s.bundle + (s.v AND s.c)::INTEGER, e.event_type = 'view' OR (s.v AND NOT s.c), e.event_type = 'click' OR (s.c AND NOT s.v) FROM s JOIN e ON e.user_id = s.user_id AND e.k = s.k + 1)
SELECT user_id, bundle, event_type, list(event_id ORDER BY event_id) AS items FROM s WHERE (user_id, bundle) IN (SELECT user_id, bundle FROM s WHERE v AND c) GROUP BY 1, 2, 3""")
def j9_accumulating_join(spark, d):
    return streams.accumulate_slots(events(spark, d), ["user_id"], "event_type", "event_id", "event_id", ["view", "click"])


@query("SELECT event_id, pos::INTEGER AS pos, value, value AS other FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos FROM events)")
def j11_strict_zip(spark, d):
    e = events(spark, d)
    return streams.zip_strict(e.select("user_id", "event_id", "value"), e.select("user_id", F.col("event_id").alias("i"), F.col("value").alias("other")), ["user_id"], ["event_id"], ["i"]).select("event_id", "pos", "value", "other")


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def s14_keep_existing(spark, d):
    return streams.keep_existing(table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels").select("doc_id"), "doc_id")


@query("SELECT c_custkey, coalesce((arg_min(o_orderpriority, o_orderkey)), ' ') AS o_orderpriority, count(o_orderkey) AS matches FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def s16_first_match(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderpriority")
    return streams.first_match(table(spark, d, "customer").select("c_custkey"), o, "c_custkey", "o_orderkey", "o_orderpriority")


# ---- sets and adjacent rows ---------------------------------------------
@query("WITH r AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events) SELECT event_id, user_id, event_type, value FROM r WHERE p IS NULL OR p <> event_type")
def u2_uniq_first(spark, d):
    return streams.uniq(events(spark, d), ["user_id"], ["event_id"], ["event_type"])


@query("WITH r AS (SELECT *, lead(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events) SELECT event_id, user_id, event_type, value FROM r WHERE p IS NULL OR p <> event_type")
def u3_uniq_last(spark, d):
    return streams.uniq(events(spark, d), ["user_id"], ["event_id"], ["event_type"], "last")


@query("SELECT a, b, c FROM (VALUES (1), (2), (3)) t(a), (VALUES ('x'), ('y')) u(b), (VALUES (true), (false)) v(c)")
def u6_feature_space(spark, d):
    one = spark.range(1).select(F.explode(streams.feature_space(a=[1, 2, 3], b=["x", "y"], c=[True, False])).alias("s"))
    return one.select("s.*")


# ---- windows ------------------------------------------------------------
@query(f"""WITH {FRAMES}, w AS (SELECT utt, frame, lag(x[1]) OVER u AS p, x[1] AS c, lead(x[1]) OVER u AS n FROM frames WINDOW u AS (PARTITION BY utt ORDER BY frame))
SELECT utt, frame, round(coalesce(p, 0), 6) AS p, round(c, 6) AS c, round(coalesce(n, 0), 6) AS n, 192 AS size FROM w WHERE (frame - 1) % 2 = 0""")
def w1_stack(spark, d):
    s = framing.stack_frames(frames(spark, d), ["utt"], "frame", "x", 3, 2)
    at = lambda i: F.round(F.col("stacked")[i], 6) + 0.0
    return s.select("utt", "frame", at(0).alias("p"), at(64).alias("c"), at(128).alias("n"), F.size("stacked").alias("size"))


@query(f"""WITH {POS}, w AS (SELECT user_id, event_id, pos, n, value, unnest(range(0, (n // 4 + 1)::BIGINT)) AS win FROM pos)
SELECT user_id, win::INTEGER AS "window", count(*) AS n, round(sum(value), 4) AS total, min(event_id) AS first FROM w WHERE pos BETWEEN win * 4 AND win * 4 + 9 AND win * 4 + 10 <= n GROUP BY 1, 2""")
def w2_sliding_window(spark, d):
    w = streams.sliding_windows(events(spark, d), ["user_id"], ["event_id"], 10, 4)
    return w.groupBy("user_id", "window").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"), F.min("event_id").alias("first"))


@query(f"""WITH {POS} SELECT user_id, (pos // 5)::INTEGER AS window, round(avg(value * value), 4) AS energy FROM pos WHERE pos // 5 < n // 5 GROUP BY 1, 2""")
def w8_energy(spark, d):
    return framing.window_energy(streams.sliding_windows(events(spark, d), ["user_id"], ["event_id"], 5, 5), ["user_id"], "value").select("user_id", "window", F.round("energy", 4).alias("energy"))


@query("""WITH r AS (SELECT user_id, event_id, value, row_number() OVER w AS k, lag(value, 2) OVER w AS a, lag(value) OVER w AS b, list_sort(list(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)) AS p FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, event_id, b > a AND b > value AS peak, b < a AND b < value AS valley, value > 1.5 * p[len(p) - 2] AS up, value * 1.5 < p[3] AS down FROM r WHERE k >= 6""")
def w9_signal_events(spark, d):
    return framing.signal_events(events(spark, d), ["user_id"], "event_id", "value", 1.5).select("user_id", "event_id", "peak", "valley", "up", "down")


@query(f"""WITH {FRAMES}, e AS (SELECT utt, frame, unnest(range(64))::INTEGER AS i, unnest(x) AS x FROM frames), v AS (SELECT utt, frame, i, first_value(x) OVER w AS f, last_value(x) OVER (PARTITION BY utt, i ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l,
lag(x) OVER w AS b1, lag(x, 2) OVER w AS b2, lead(x) OVER w AS a1, lead(x, 2) OVER w AS a2 FROM e WINDOW w AS (PARTITION BY utt, i ORDER BY frame))
SELECT utt, frame, i, round((coalesce(a1, l) - coalesce(b1, f) + 2 * (coalesce(a2, l) - coalesce(b2, f))) / 10, 6) + 0.0 AS delta FROM v""")
def w10_delta(spark, d):
    out = framing.delta(frames(spark, d), ["utt"], "frame", "x", 2)
    return out.select("utt", "frame", F.posexplode("delta").alias("i", "delta")).withColumn("delta", F.round("delta", 6) + 0.0)


@query("SELECT event_id, value - 2 * lag(value) OVER w + lag(value, 2) OVER w AS difference FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)".replace("value - 2", "round(value - 2").replace("w AS difference", "w, 4) + 0.0 AS difference", 1))
def w11_delta_delta(spark, d):
    return framing.difference(events(spark, d), ["user_id"], "event_id", "value", 2).select("event_id", (F.round("difference", 4) + 0.0).alias("difference"))


@query("""SELECT event_id, round(coalesce(value - 0.97 * lag(value) OVER w, lead(value) OVER w - 0.97 * value), 4) + 0.0 AS y FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""".replace("0.97", "0.97::DOUBLE"))
def w12_preemphasis(spark, d):
    return framing.preemphasis(events(spark, d), ["user_id"], "event_id", "value").select("event_id", (F.round("emphasised", 4) + 0.0).alias("y"))


@query("""WITH e AS (SELECT user_id, min(event_id) AS t0, max(event_id) AS t1 FROM events GROUP BY 1), s AS (SELECT user_id, t0, t1, unnest(range(0, (ceil((t1 - t0) / 40.0::DOUBLE))::BIGINT)) AS sample FROM e)
SELECT s.user_id, s.sample::INTEGER AS sample, s.t0 + s.sample * 40 AS at, count(v.event_id) AS n, round(coalesce(sum(v.value), 0), 4) AS sum FROM s LEFT JOIN events v ON s.sample > 0 AND v.user_id = s.user_id AND v.event_id BETWEEN s.t0 + s.sample * 40 - 100 AND s.t0 + s.sample * 40 GROUP BY 1, 2, 3""")
def w16_sampling_window(spark, d):
    return framing.sampling_windows(events(spark, d), ["user_id"], "event_id", "value", 40, 100).withColumn("sum", F.round("sum", 4))


@query(f"""WITH RECURSIVE {POS}, y AS (SELECT user_id, pos, event_id, value::DOUBLE AS y FROM pos WHERE pos = 0 UNION ALL SELECT p.user_id, p.pos, p.event_id, 0.9::DOUBLE * y.y + (1 - 0.9::DOUBLE) * p.value FROM y JOIN pos p ON p.user_id = y.user_id AND p.pos = y.pos + 1)
SELECT user_id, event_id, round(y, 6) AS smooth FROM y WHERE pos > 0""")
def w7_one_pole(spark, d):
    return framing.one_pole(events(spark, d), ["user_id"], "event_id", "value", 0.9).withColumn("smooth", F.round("smooth", 6))


@query(f"""WITH RECURSIVE {POS}, y AS (SELECT user_id, pos, event_id, value::DOUBLE AS x1, 0.0::DOUBLE AS x2, value::DOUBLE AS y1, 0.0::DOUBLE AS y2 FROM pos WHERE pos = 0
UNION ALL SELECT p.user_id, p.pos, p.event_id, p.value, x1, p.value + 0.5::DOUBLE * x1 + 0.25::DOUBLE * x2 + 0.5::DOUBLE * y1 - 0.1::DOUBLE * y2, y1 FROM y JOIN pos p ON p.user_id = y.user_id AND p.pos = y.pos + 1)
SELECT user_id, event_id, round(y1 * 0.7310585786300049::DOUBLE, 5) AS y FROM y""")
def w13_second_order(spark, d):
    out = framing.second_order(events(spark, d), ["user_id"], "event_id", "value", (1.0, 0.5, 0.25), (-0.5, 0.1))
    return out.select("user_id", "event_id", F.round(F.col("y") * 0.7310585786300049, 5).alias("y"))


@query(f"""WITH RECURSIVE {POS}, y AS (SELECT user_id, pos, event_id, value::DOUBLE AS u, value::DOUBLE AS v FROM pos WHERE pos = 0
UNION ALL SELECT user_id, pos, event_id, u, v + (CASE WHEN u > v THEN 0.5::DOUBLE ELSE 0.1::DOUBLE END) * (u - v) FROM (SELECT p.user_id, p.pos, p.event_id, u + (CASE WHEN p.value > u THEN 0.5::DOUBLE ELSE 0.1::DOUBLE END) * (p.value - u) AS u, v FROM y JOIN pos p ON p.user_id = y.user_id AND p.pos = y.pos + 1))
SELECT user_id, event_id, round(v, 6) AS y FROM y""")
def w13_two_pole(spark, d):
    return framing.two_pole_tracker(events(spark, d), ["user_id"], "event_id", "value", 0.5, 0.1).withColumn("y", F.round("y", 6))


@query(f"""WITH RECURSIVE {POS}, y AS (SELECT user_id, pos, event_id, value::DOUBLE AS low, value::DOUBLE AS high, false AS over FROM pos WHERE pos = 0
UNION ALL SELECT user_id, pos, event_id, CASE WHEN x < low THEN x ELSE low END, CASE WHEN x > high AND over THEN x ELSE high END, x > high FROM (SELECT p.user_id, p.pos, p.event_id, p.value::DOUBLE AS x, low + 0.5::DOUBLE AS low, high - 1.5::DOUBLE AS high, over FROM y JOIN pos p ON p.user_id = y.user_id AND p.pos = y.pos + 1))
SELECT user_id, event_id, round(low, 6) AS low, round(high, 6) AS high FROM y""")
def w14_range_tracker(spark, d):
    out = framing.range_tracker(events(spark, d), ["user_id"], "event_id", "value", 0.5, -1.5)
    return out.withColumns({"low": F.round("low", 6), "high": F.round("high", 6)})


@query()
def w15_utterances(spark, d):
    return framing.tag_utterances(events(spark, d), ["user_id"], "event_id", "value", 0.5, -0.5, 10.0, 0.4, 0.6, 4, 2, 5, 3)


# ---- metrics -------------------------------------------------------------
@query("SELECT quality AS ref, toxic AS hyp, count(*) AS n FROM labels GROUP BY 1, 2")
def a1_confusion(spark, d):
    return metrics.confusion(table(spark, d, "labels"), "quality", "toxic")


@query("SELECT lang, coalesce(count(*) FILTER (quality = toxic), 0) AS right, count(*) AS n, round(count(*) FILTER (quality = toxic) / count(*)::DOUBLE, 6) AS accuracy FROM labels JOIN documents USING (doc_id) GROUP BY lang".replace(" AS right", ' AS "right"'))
def a3_accuracy(spark, d):
    j = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return metrics.accuracy(j, "quality", "toxic", ["lang"]).withColumn("accuracy", F.round("accuracy", 6))


@query("SELECT quality AS ref, count(*) FILTER (toxic = 0) AS hyp_0, count(*) FILTER (toxic = 1) AS hyp_1 FROM labels GROUP BY 1")
def a4_confusion_matrix(spark, d):
    return metrics.confusion_matrix(table(spark, d, "labels"), "quality", "toxic", [0, 1])


@query("""WITH g AS (SELECT user_id, event_id % 7 AS param, sum(value) AS v FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(v, 6) DESC, param) AS k FROM g) SELECT user_id, param FROM r WHERE k = 1""")
def a5_best_parameter(spark, d):
    g = events(spark, d).groupBy("user_id", (F.col("event_id") % 7).alias("param")).agg(F.round(F.sum("value"), 6).alias("v"))
    return metrics.best_parameter(g, ["user_id"], "param", "v").select("user_id", "param")


@query('SELECT event_type, count(value) AS "count", round(min(value), 4) AS "min", round(max(value), 4) AS "max", round(sum(value), 2) AS "sum", round(sum(value * value), 1) AS sumsq FROM events GROUP BY 1')
def a6_simple_stats(spark, d):
    s = metrics.simple_stats(events(spark, d), ["event_type"], "value")
    return s.select("event_type", "count", F.round("min", 4).alias("min"), F.round("max", 4).alias("max"), F.round("sum", 2).alias("sum"), F.round("sumsq", 1).alias("sumsq"))


_DET = """b AS (SELECT value AS t, count(*) FILTER (event_type IN ('view', 'click')) AS p, count(*) FILTER (event_type NOT IN ('view', 'click')) AS n FROM events GROUP BY 1),
r AS (SELECT t, 100.0 * coalesce(sum(n) OVER (ORDER BY t DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE / (sum(n) OVER ())::DOUBLE AS fp, 100.0 * (1 - coalesce(sum(p) OVER (ORDER BY t DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE / (sum(p) OVER ())::DOUBLE) AS miss FROM b),
f AS (SELECT * FROM (SELECT *, lag(fp) OVER (ORDER BY t DESC) AS q FROM r) WHERE q IS NULL OR q <> fp), l AS (SELECT * FROM (SELECT *, lead(miss) OVER (ORDER BY t DESC) AS z FROM f) WHERE z IS NULL OR z <> miss)"""


def scored(spark, d):
    return events(spark, d).select(F.col("value").cast("double").alias("v"), F.col("event_type").isin("view", "click").alias("ref"))


@query(f"WITH {_DET} SELECT t::DOUBLE AS threshold, round(fp, 6) AS fp, round(miss, 6) AS miss FROM l")
def a12_det(spark, d):
    return metrics.det_points(scored(spark, d), F.col("ref"), "v").select("threshold", F.round("fp", 6).alias("fp"), F.round("miss", 6).alias("miss"))


@query(f"WITH {_DET} SELECT t::DOUBLE AS threshold, round(fp, 6) AS fp, round(100 - miss, 6) AS hit FROM l")
def a13_roc(spark, d):
    return metrics.roc_points(scored(spark, d), F.col("ref"), "v").select("threshold", F.round("fp", 6).alias("fp"), F.round("hit", 6).alias("hit"))


@query("""WITH i AS (SELECT user_id, event_id, CASE WHEN event_type IN ('view', 'click') THEN 1 ELSE 0 END AS ref, CASE WHEN value > 30 THEN 1 ELSE 0 END AS hyp FROM events),
c AS (SELECT *, CASE WHEN ref <> lag(ref) OVER w THEN 1 ELSE 0 END AS ch FROM i WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
n AS (SELECT *, coalesce(max(ch) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING), 0) AS near FROM c)
SELECT count(*) FILTER (ref = 1) AS speech, count(*) FILTER (ref = 0) AS other, count(*) FILTER (ref = 1 AND hyp = 0) AS missed, count(*) FILTER (ref = 0 AND hyp = 1) AS false_alarms FROM n WHERE near = 0""")
def a14_miss_false_alarm(spark, d):
    i = events(spark, d).select("user_id", "event_id", F.col("event_type").isin("view", "click").cast("int").alias("ref"), (F.col("value") > 30).cast("int").alias("hyp"))
    return metrics.miss_false_alarm(i, ["user_id"], "event_id", "ref", "hyp", 1).drop("pmiss", "pfa")


@query("""WITH i AS (SELECT user_id, event_id, CASE WHEN event_type <> 'error' THEN event_type END AS label, CASE WHEN value > 40 THEN 'view' ELSE 'click' END AS top FROM events)
SELECT event_id, count(label) OVER w AS seen, count(*) FILTER (label = top) OVER w AS "right", round(CASE WHEN count(label) OVER w > 0 THEN count(*) FILTER (label = top) OVER w / (count(label) OVER w)::DOUBLE END, 6) AS accuracy FROM i WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)""")
def a15_running_accuracy(spark, d):
    i = events(spark, d).select("user_id", "event_id", F.when(F.col("event_type") != "error", F.col("event_type")).alias("label"), F.when(F.col("value") > 40, "view").otherwise("click").alias("top"))
    return metrics.running_accuracy(i, ["user_id"], "event_id", "label", "top").select("event_id", "seen", "right", F.round("accuracy", 6).alias("accuracy"))


def words(spark, d):
    return table(spark, d, "conversations").where("text is not null").select(F.concat_ws("-", "conv_id", "turn").alias("doc"), F.filter(F.split("text", " ", -1), lambda t: t != "").alias("tokens"))


_WORDS = """w AS (SELECT conv_id || '-' || turn AS doc, list_filter(string_split(text, ' '), lambda t: t <> '') AS t FROM conversations WHERE text IS NOT NULL)"""


@query(f"""WITH {_WORDS}, p AS (SELECT list_concat(list_concat(['<s>', '<s>'], t), ['</s>']) AS t FROM w), g AS (SELECT unnest(list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2])) AS ngram FROM p)
SELECT ngram, count(*) AS n FROM g GROUP BY 1""")
def a16_trigrams(spark, d):
    return metrics.ngrams_of(words(spark, d), F.col("tokens"), 3).groupBy("ngram").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_WORDS}, g AS (SELECT doc, unnest(range(0, len(t) - 1)) AS start, t FROM w) SELECT t[start + 1] || ' ' || t[start + 2] AS ngram, count(DISTINCT doc) AS docs, count(*) AS places FROM g GROUP BY 1""")
def a17_ngram_index(spark, d):
    return metrics.ngram_index(words(spark, d).where(F.size("tokens") >= 2), "doc", F.col("tokens"), 2).select("ngram", "docs", F.size("places").cast("long").alias("places"))


@query("""WITH t AS (SELECT o_orderkey, unnest(range(len(o_orderpriority))) AS p, o_orderpriority AS s FROM orders), b AS (SELECT p, unnest(range(8)) AS bit_pos, ascii(substr(s, (p + 1)::INTEGER, 1)) AS c FROM t WHERE substr(s, (p + 1)::INTEGER, 1) <> ' ')
SELECT bit_pos::INTEGER AS bit_pos, sum((c >> (7 - bit_pos)::INTEGER) & 1)::BIGINT AS ones, count(*) AS n, CASE WHEN 2 * sum((c >> (7 - bit_pos)::INTEGER) & 1) >= count(*) THEN 1 ELSE 0 END::INTEGER AS bit FROM b GROUP BY 1""")
def a16_bit_majority(spark, d):
    bits = streams.text_bits(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), F.col("o_orderpriority"))
    return metrics.bit_majority(bits, ["bit_pos"], "bit")


@query("SELECT label, count(*) AS n FROM embeddings GROUP BY 1")
def a18_class_check(spark, d):
    return metrics.check_classes(table(spark, d, "embeddings").select("label"), "label", list(range(10)))


@query(f"""WITH {_WORDS}, g AS (SELECT doc, unnest(range(0, len(t) - 1)) AS start, t FROM w), n AS (SELECT t[start + 1] || ' ' || t[start + 2] AS ngram, doc, start::INTEGER AS start FROM g)
SELECT ngram, row_number() OVER (PARTITION BY ngram ORDER BY doc, start) - 1 AS k, doc, start FROM n""")
def a17_ngram_places(spark, d):
    """The index with a row for each place."""
    return metrics.ngram_places(words(spark, d).where(F.size("tokens") >= 2), "doc", F.col("tokens"), 2).select("ngram", "k", "doc", "start")


@query("SELECT o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_custkey) - 1 AS k, o_custkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_custkey) = rank() OVER (PARTITION BY o_orderpriority ORDER BY o_custkey) AS first FROM orders")
def a19_collated(spark, d):
    """Customers by priority: five keys with a fifth of all orders each."""
    return metrics.collated(table(spark, d, "orders"), "o_orderpriority", "o_custkey")


@query('SELECT o_custkey, list_sort(list(o_orderpriority)) AS "all", list_sort(list(DISTINCT o_orderpriority)) AS "distinct", count(DISTINCT o_orderpriority) AS n FROM orders GROUP BY 1')
def a19_collate(spark, d):
    return metrics.collate(table(spark, d, "orders"), "o_custkey", "o_orderpriority")


@query("SELECT event_type, (row_number() OVER (ORDER BY event_type) - 1)::INTEGER AS id FROM (SELECT DISTINCT event_type FROM events)")
def a19_label_ids(spark, d):
    return metrics.label_ids(events(spark, d), "event_type")


@query("SELECT least(floor(l_quantity / 5.0::DOUBLE), 9)::INTEGER AS cell, count(*) AS n, round(count(*) / (sum(count(*)) OVER () * 5.0)::DOUBLE, 6) AS density FROM lineitem WHERE l_quantity BETWEEN 0 AND 50 GROUP BY 1")
def a20_histogram(spark, d):
    return metrics.histogram(table(spark, d, "lineitem"), "l_quantity", 0.0, 50.0, 10).withColumn("density", F.round("density", 6))


_MOM = f"{FRAMES}, u AS (SELECT label, unnest(range(64)) AS dim, unnest(x) AS v FROM frames), m AS (SELECT label, dim, count(*) AS n, avg(v) AS mean, var_pop(v) AS var FROM u GROUP BY 1, 2)"


@query(f"WITH {_MOM} SELECT label, dim::INTEGER AS dim, n, round(mean, 6) + 0.0 AS mean, round(var, 6) AS var FROM m")
def a8_moments(spark, d):
    return metrics.moments(frames(spark, d), ["label"], F.col("x")).select("label", "dim", "n", (F.round("mean", 6) + 0.0).alias("mean"), F.round("var", 6).alias("var"))


@query(f"WITH {FRAMES}, u AS (SELECT unnest(range(64)) AS dim, unnest(x) AS v FROM frames) SELECT dim::INTEGER AS dim, round(greatest(0.01 * var_pop(v), 0.0001), 6) AS floor FROM u GROUP BY 1")
def a10_variance_floor(spark, d):
    return metrics.variance_floor(frames(spark, d), F.col("x"), 0.01, 0.0001).select("dim", F.round("floor", 6).alias("floor"))


@query(f"""WITH {POS}, b AS (SELECT user_id, value, length(bin(xor(pos, n))) - 1 AS bit FROM pos) SELECT user_id, bit::INTEGER AS bit, count(*) AS n, round(sum(value), 4) AS sum, round(sum(value * value), 3) AS sumsq FROM b GROUP BY 1, 2""")
def a11_log_spaced(spark, d):
    out = metrics.log_spaced_sums(events(spark, d), ["user_id"], "event_id", "value")
    return out.withColumns({"sum": F.round("sum", 4), "sumsq": F.round("sumsq", 3)})
