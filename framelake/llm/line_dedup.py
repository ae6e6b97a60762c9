"""Line deduplication by a sharded minimal perfect hash.

Pass one counts, for each line key, its documents and the largest document id
(sums before the second shuffle, so a line in every document costs a row a
task).  The hashes of all keys are dealt to shards; each shard is one minimal
perfect hash (bit arrays of falling size, a key's index is the rank of its bit)
over an array of counts of one byte, which stop at 255.  Keys that reach
``min_docs`` have places in two more arrays, of fingerprints and largest ids.
Pass two sends the hash of each line, salted by its document, to its shard;
where the count there says that the key is frequent and the fingerprint agrees,
the line's number comes back, to be dropped.  Lines are never joined with lines,
and a worker holds one shard.

Defined cases: a null or empty text is one empty line; rows with one id are one
document, and so are all without an id, which is below all others: a key found
only there keeps its lines; repeated rows lose the same lines; an empty table
gives an empty one; a text of any length is split whole; columns may have any
names but ``n_lines`` and ``n_dropped``, which raise.
"""

from __future__ import annotations

import io

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import ascii_lower, bound_batches, drop_stage, files_for, tidy, write_stage

SHARD_KEYS = 200_000
SALTS = 8
BLANKS = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def _mix(x, seed: int):
    """splitmix64's finaliser; fixed public constants."""
    import numpy as np

    x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Distinct 64-bit keys -> 0 .. n-1, about three bits a key."""

    def __init__(self, levels: list, rest):
        import numpy as np

        self.levels, self.rest = levels, rest
        self.bits = [np.unpackbits(x)[:size].astype(bool) for x, size in levels]
        self.ranks, base = [], 0
        for b in self.bits:
            self.ranks.append(np.cumsum(b) - 1 + base)
            base += int(b.sum())
        self.base = base

    @classmethod
    def build(cls, keys, gamma: float = 2.0, most: int = 32) -> "PerfectHash":
        import numpy as np

        levels, left = [], np.unique(keys.astype(np.uint64))
        while len(left) and len(levels) < most:
            size = int(gamma * len(left)) + 1
            at = (_mix(left, len(levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append((np.packbits(alone), size))
            left = left[~alone[at]]
        return cls(levels, left)

    def find(self, keys):
        """Index of each key; -1 for some keys that are not in the set, any index for others."""
        import numpy as np

        keys = keys.astype(np.uint64)
        out, todo = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for k, ((_, size), bits, rank) in enumerate(zip(self.levels, self.bits, self.ranks)):
            at = (_mix(keys[todo], k) % np.uint64(size)).astype(np.int64)
            hit = bits[at]
            out[todo[hit]] = rank[at[hit]]
            todo = todo[~hit]
            if not len(todo):
                return out
        if len(self.rest):
            at = np.minimum(np.searchsorted(self.rest, keys[todo]), len(self.rest) - 1)
            same = self.rest[at] == keys[todo]
            out[todo[same]] = self.base + at[same]
        return out


def build_shard(h1, h2, counts, last, min_docs: int) -> bytes:
    """Bytes of a shard. last: largest ids, None where there is none."""
    import numpy as np

    keys = np.asarray(h1, np.int64).view(np.uint64)
    mph = PerfectHash.build(keys)
    at = mph.find(keys)
    docs = np.zeros(len(keys), np.uint8)
    docs[at] = np.minimum(np.asarray(counts, np.int64), 255)
    often = np.flatnonzero(np.asarray(counts, np.int64) >= min_docs)
    often = often[np.argsort(at[often])]
    known = np.array([last[k] is not None and last[k] == last[k] for k in often.tolist()], bool)
    top = np.array([int(last[k]) if ok else 0 for k, ok in zip(often.tolist(), known.tolist())], np.int64)
    buf = io.BytesIO()
    np.savez(buf, docs=docs, often=at[often], marks=np.asarray(h2, np.int64)[often], top=top, known=known, rest=mph.rest, sizes=np.array([s for _, s in mph.levels]), **{f"l{k}": x for k, (x, _) in enumerate(mph.levels)})
    return buf.getvalue()


class Shard:
    def __init__(self, blob: bytes):
        import numpy as np

        z = np.load(io.BytesIO(blob))
        self.mph = PerfectHash([(z[f"l{k}"], int(s)) for k, s in enumerate(z["sizes"])], z["rest"])
        self.docs, self.often, self.marks, self.top, self.known = (z[x] for x in ("docs", "often", "marks", "top", "known"))

    def probe(self, h1, h2, min_docs: int):
        """(whether the count is min_docs or more and the fingerprint agrees, largest id, whether it is known) of each hash pair."""
        import numpy as np

        at = self.mph.find(h1.view("u8"))
        found = at >= 0
        at[~found] = 0
        if not len(self.often):
            return np.zeros(len(at), bool), np.zeros(len(at), np.int64), np.zeros(len(at), bool)
        found &= self.docs[at] >= min(min_docs, 255)
        place = np.minimum(np.searchsorted(self.often, at), len(self.often) - 1)
        found &= (self.often[place] == at) & (self.marks[place] == h2)
        return found, self.top[place], self.known[place]


def line_counts(docs: DataFrame, min_chars: int) -> DataFrame:
    """(h1, h2, n_docs, last_doc) of the keys of ``docs(d, t)``; rows with one id count once."""
    keys = F.array_distinct(F.filter(F.transform(F.split(F.col("t"), "\n", -1), line_key), lambda k: F.length(k) >= min_chars))
    lines = docs.select("d", F.explode(keys).alias("key")).select("d", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))
    return lines.distinct().groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("d").alias("last_doc"))


def build_shards(counts: DataFrame, n_shards: int, min_docs: int) -> DataFrame:
    """(shard, arrays), one row a shard of about SHARD_KEYS keys."""

    def build(pdf):
        import pandas as pd

        pdf = pdf.sort_values("n_docs", ascending=False, kind="stable").drop_duplicates("h1")  # of two keys of one 64-bit hash the rarer is not dropped
        return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "arrays": [build_shard(pdf["h1"].to_numpy(), pdf["h2"].to_numpy(), pdf["n_docs"].to_numpy(), pdf["last"].tolist(), min_docs)]})

    often = F.col("n_docs") >= min_docs
    dealt = counts.select(F.pmod("h1", F.lit(n_shards)).cast("int").alias("shard"), "h1", F.when(often, F.col("h2")).otherwise(0).alias("h2"), "n_docs", F.when(often, F.col("last_doc").cast("string")).alias("last"))
    return dealt.groupBy("shard").applyInPandas(build, "shard int, arrays binary")


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the repeated lines taken from the text, plus n_lines and n_dropped.

    A key of at least ``min_chars`` code points found in ``min_docs`` documents
    or more stays only in the document with the largest id that holds it.
    """
    spark = docs.sparkSession
    bound_batches(docs)
    if {"n_lines", "n_dropped"} & set(docs.columns):
        raise ValueError("the columns n_lines and n_dropped are taken")
    others = [c for c in docs.columns if c != text_col]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in others)).alias("row"), F.col(f"`{id_col}`").alias("d"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("t"))
    counts = write_stage(line_counts(rows, min_chars), "lines", files_for(docs.count()))
    n_keys = counts.count()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_shards = -(-max(n_keys, 1) // SHARD_KEYS)
    salts = max(SALTS, -(-2 * parts // n_shards))
    shards = write_stage(build_shards(counts, n_shards, min_docs), "shards")
    drop_stage(counts)

    uid = [F.xxhash64("d", "t").alias("r1"), F.xxhash64("t", F.lit(1), "d").alias("r2")]
    lines = rows.select("d", *uid, F.posexplode(F.split("t", "\n", -1)).alias("pos", "line")).select("d", "r1", "r2", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    probes = lines.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "d", "r1", "r2", "pos")
    probes = probes.withColumns({"shard": F.pmod("h1", F.lit(n_shards)).cast("int"), "salt": F.pmod(F.col("r1"), F.lit(salts)).cast("int"), "arrays": F.lit(None).cast("binary")})
    arrays = shards.withColumns({"salt": F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))} | {c: F.lit(None).cast("long") for c in ("h1", "h2", "d", "r1", "r2")} | {"pos": F.lit(None).cast("int")})
    sent = probes.unionByName(arrays).select("shard", "salt", "arrays", "h1", "h2", "d", "r1", "r2", "pos")
    sent = sent.repartition("shard", "salt").sortWithinPartitions("shard", "salt", F.col("arrays").isNull())

    def probe(batches):
        import numpy as np
        import pyarrow as pa

        own, shard = None, None
        for batch in batches:
            c = {n: batch.column(k) for k, n in enumerate(batch.schema.names)}
            where = np.flatnonzero(c["arrays"].is_valid().to_numpy(zero_copy_only=False))
            shards_ = c["shard"].to_numpy()
            for a, b in zip([0, *where], [*where, batch.num_rows]):
                if b > a:
                    if c["arrays"][int(a)].is_valid:
                        own, shard, a = Shard(c["arrays"][int(a)].as_py()), shards_[a], a + 1
                    some = batch.slice(int(a), int(b - a))
                    mine = some.filter(pa.array(shards_[a:b] == shard)) if own is not None else some.slice(0, 0)
                    if mine.num_rows:
                        col = {n: mine.column(k) for k, n in enumerate(mine.schema.names)}
                        found, top, known = own.probe(col["h1"].to_numpy(), col["h2"].to_numpy(), min_docs)
                        d, has = col["d"].fill_null(0).to_numpy(), col["d"].is_valid().to_numpy(zero_copy_only=False)
                        drop = found & known & ~(has & (d == top))
                        out = mine.filter(pa.array(drop)).select(["r1", "r2", "pos"])
                        if out.num_rows:
                            yield out

    drops = sent.mapInArrow(tidy(probe), "r1 long, r2 long, pos int").groupBy("r1", "r2").agg(F.collect_set("pos").alias("drops"))

    @F.pandas_udf("string")
    def without(texts, drops):
        import pandas as pd

        out = []
        for t, gone in zip(texts, drops):
            if t is not None:
                gone = set(gone)
                t = "\n".join(line for k, line in enumerate(t.split("\n")) if k not in gone)
            out.append(t)
        return pd.Series(out, dtype=object)

    joined = rows.withColumns({"r1": uid[0], "r2": uid[1]}).join(drops, ["r1", "r2"], "left")
    hit = F.when(F.col("drops").isNotNull(), F.col("t"))
    done = joined.select("row", F.coalesce(without(hit, F.col("drops")), F.col("t")).alias("kept"), (F.length("t") - F.length(F.replace("t", F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"), F.when(F.col("drops").isNull(), 0).otherwise(F.size("drops")).cast("long").alias("n_dropped"))
    return done.select(*(F.col("kept").alias(text_col) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns), "n_lines", "n_dropped")
