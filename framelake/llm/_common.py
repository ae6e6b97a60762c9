"""Helpers shared by the operators: the shared folder, written stages, component search."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the cluster names none (a local session, as in tests) a local
    temporary folder is taken, once a session.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    own = f"file://{tempfile.mkdtemp(prefix='framelake-')}"
    spark.conf.set("spark.checkpoint.dir", own)
    return own


#: Documents, or what was made of them, that a file of a written table holds, and the files that a table has at least.
#: Few, as Hadoop's local file system starts processes for every file that is created.
DOCUMENTS, FILES = 10_000, 8
#: Texts in an Arrow batch, of which a task and its worker hold a few at once.
BATCH = 2048


def bound_batches(df: DataFrame) -> None:
    """Have Arrow batches of at most BATCH rows in this session, where it has more: Spark's own 10,000 whole texts are many megabytes."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(key)) <= BATCH:
        df.sparkSession.conf.set(key, str(BATCH))


def files_for(documents: int) -> int:
    """How many files a table made of so many documents has: small tables are not cut into a file a task."""
    return max(FILES, documents // DOCUMENTS)


def write_stage(df: DataFrame, name: str, files: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder, in at most ``files`` files, and read it back, which cuts its lineage."""
    spark = df.sparkSession
    df = df.coalesce(files) if files else df
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._stage_path = path  # for drop_stage
    return back


def drop_stage(df: DataFrame) -> None:
    """Delete the files of a stage that nothing reads any more."""
    path = getattr(df, "_stage_path", None)
    if path:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)


def hold(df: DataFrame) -> DataFrame:
    """Keep what ``df`` gives on the executors' disks for later jobs; what a lost executor held is worked out anew."""
    return df.persist(StorageLevel.DISK_ONLY)


def give_back() -> None:
    """Return to the system what this worker has freed: Arrow's pool and the C library keep it, and Spark uses workers again."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
        trim(0)


def tidy(work):
    """``work``, a function from an iterator to a generator, that gives back memory when its task ends."""

    def tidied(batches):
        try:
            yield from work(batches)
        finally:
            give_back()

    return tidied


def ascii_lower(col):
    """Lower-case A-Z only."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: Edges that a part of a written edge table holds (a table of one part is settled there), the nodes at most that count as hubs, and the edges of all below
#: which a hub has too few to be told apart.
EDGES, HUBS, LEAST = 500_000, 1000, 100_000


def _to_least(edges: DataFrame, low: DataFrame, count: int) -> DataFrame:
    """``edges(u, v)`` with ``m`` of ``low(u, m, k)``, where k is the node's number of edges.

    Nodes with more than a thousandth of all edges are at most HUBS, so they are
    sent to all tasks and their edges stay where they are; the others are joined.
    Of LEAST edges and fewer all are joined, as no node can have more.
    """
    if count <= LEAST:
        return edges.join(low.select("u", "m"), "u")
    hub = F.col("k") > max(1000, -(-count // HUBS))
    hubs = F.broadcast(low.where(hub).select("u", F.col("m").alias("h")))
    marked = edges.join(hubs, "u", "left")
    others = marked.where("h is null").drop("h").join(low.where(~hub).select("u", "m"), "u")
    return marked.where("h is not null").select("u", "v", F.col("h").alias("m")).unionByName(others.select("u", "v", "m"))


def join_spread(left: DataFrame, right: DataFrame, keys: list[str], rows: int, how: str = "left") -> DataFrame:
    """``left`` joined with ``right(keys, ..., k)``, one row a key, ``k`` the number of rows of ``left`` that have it.

    Keys with more than a thousandth of ``rows``, the number of rows of ``left``,
    are at most HUBS, so those rows of ``right`` are sent to all tasks and no key of the
    shuffled join has more. ``k`` is dropped.
    """
    hub = F.col("k") > max(1000, -(-rows // HUBS))
    values = [c for c in right.columns if c not in (*keys, "k")]
    marked = left.join(F.broadcast(right.where(hub).drop("k").withColumn("_hub", F.lit(True))), keys, "left")
    near = marked.where("_hub").select(*left.columns, *values)
    far = marked.where("_hub is null").select(*left.columns).join(right.where(~hub).drop("k"), keys, how).select(*left.columns, *values)
    return near.unionByName(far)


def _stars(edges: DataFrame) -> DataFrame:
    """Of each part of ``edges(u, v)``, at most EDGES, the edges from each node to the smallest of its component in that part."""

    def work(batches):
        import numpy as np
        import pyarrow as pa

        held = [np.stack([batch.column(k).to_numpy() for k in range(2)]) for batch in batches if batch.num_rows]
        if not held:
            return
        nodes, at = np.unique(np.concatenate(held, axis=1), return_inverse=True)
        u, v = at.reshape(2, -1)
        root = np.arange(len(nodes))
        while len(u):
            np.minimum.at(root, np.maximum(u, v), np.minimum(u, v))  # u and v are roots, of which the larger is hung on the smallest it meets
            while (root[root] != root).any():
                root = root[root]
            u, v = root[u], root[v]
            u, v = u[u != v], v[u != v]
        hung = np.flatnonzero(root != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[hung]), pa.array(nodes[root[hung]])], names=["u", "v"])

    return edges.select("u", "v").mapInArrow(tidy(work), "u long, v long")


def components(edges: DataFrame, rounds: int = 60, most: int | None = None) -> DataFrame:
    """Connected components by alternating large-star and small-star steps.

    ``edges`` has long columns ``u`` and ``v``; self-loops, repeats and nulls
    are ignored.  Returns ``(node, component)`` with the smallest node of each
    component, for every node with an edge.  Each step is written to the shared
    folder, in parts of about EDGES, so a lost executor costs at most one
    step; edges that are no more than one part, at first or after a step, are settled there.  A hub is
    never gathered in larger tables: minima are partial aggregates, and a hub's
    edges are not dealt by it.  ``most``: a bound of the number of ``edges``, which are
    then worked out once and not counted.
    """

    def store(df, count):
        if count <= EDGES:
            return write_stage(_stars(df.coalesce(1)), "edges"), None
        after = write_stage(df.coalesce(-(-count // EDGES)), "edges")
        return after, after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    pairs = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct()
    now, stamp = store(pairs, edges.count() if most is None else most)
    seen = None
    for _ in range(rounds):
        if stamp is None or stamp == seen or not stamp[0]:
            break
        seen = stamp
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("k"))
        large = _to_least(both, low, 2 * stamp[0]).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))  # repeats go in the next step
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("k"))
        small = _to_least(large, low, stamp[0])
        small = small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e"))
        after, stamp = store(small.select("e.u", "e.v").where("u <> v").distinct(), stamp[0])
        drop_stage(now)
        now = after
    else:
        raise RuntimeError("components did not settle")
    nodes = now.groupBy("u").agg(F.min("v").alias("component"))
    roots = nodes.select("component").distinct().select(F.col("component").alias("node"), "component")
    return nodes.select(F.col("u").alias("node"), "component").unionByName(roots)
