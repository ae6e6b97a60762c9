"""MinHash near-duplicates by tensored banding, confirmed on full shingle sets.

Two small collections of ``m`` sketches, each of ``r`` minimum hashes, are made
a document; the key of table (i, j) joins sketch i of one with sketch j of the
other, so 2*m*r hashes serve m*m tables of 2*r rows.  A pair of similarity s
shares a table unless one collection fails: 1 - (1 - (1 - s^r)^m)^2.

Stages: documents of equal shingle sets fall into one class; in each table the
members of a bucket are paired with its smallest (linear in its size) and
confirmed; where members of a bucket are then still in different components,
those are left out that no other member can match, as too many of their
shingles are in no other text, and the bucket's smaller components are compared
with all of it in blocks, sizes and sketches first; what passes is confirmed as well.  So links are lost only where no table shows them, or a sketch of
1024 cells errs by more than 5 percent.  No bucket is gathered in one task.

Defined cases: a null or empty text, or one of white space, has an empty set
and no link; rows with one id are one document: repeated rows have one result,
and rows with other texts share the component, found by the tables of all their
texts and confirmed on the smallest text that has words; a null id has the
component of its class's ids, else none; an empty table gives an empty one; a
text of any length is one set; columns other than the id and the text are not
read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import HUBS, bound_batches, components, drop_stage, files_for, hold, tidy, write_stage

BLOCK = 1024
#: Salts of a text that others are compared with, and partners a salt of those that have very many.
SALTS, PARTNERS = 16, 256
#: Cells of the sketches that stray pairs are compared by, and how far below the threshold, in percent, such a
#: sketch may be (four standard deviations or more).
BINS, SLACK = 1024, 5
#: Times that documents are left out for what they share.
ROUNDS = 1
#: odd multipliers for byte blocks, word places and set functions (public constants of splitmix64 and xxhash)
_BASE, _PLACES = 0x9E3779B97F4A7C15, (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)


def _fmix(x):
    import numpy as np

    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


#: Longer spans are hashed one by one by xxh3.
LONG = 256


def hash_spans(raw, start, stop):
    """64-bit hashes of ``raw[start[k] : stop[k]]``.

    Eight bytes at a time are mixed, added to what is mixed already and mixed
    again, so spans of one length up to eight bytes never collide, and no pattern
    of longer ones does but by chance.
    """
    import numpy as np
    import xxhash

    size = (stop - start).astype(np.int64)
    out = _fmix((size.astype(np.uint64) + np.uint64(1)) * np.uint64(_BASE))
    long = np.flatnonzero(size > LONG)
    for k in long.tolist():
        out[k] = xxhash.xxh3_64_intdigest(raw[start[k] : stop[k]].tobytes(), seed=1)
    todo = np.flatnonzero((size > 0) & (size <= LONG))
    eight = np.lib.stride_tricks.sliding_window_view(np.concatenate([raw, np.zeros(8, np.uint8)]), 8)
    at, left = start[todo], size[todo]
    while len(todo):
        block = eight[at].view("<u8").ravel()
        block &= np.uint64(2**64 - 1) >> (np.uint64(64) - np.uint64(8) * np.minimum(left, 8).astype(np.uint64))
        out[todo] = _fmix(out[todo] * np.uint64(_PLACES[0]) + _fmix(block + np.uint64(_PLACES[1])))
        more = left > 8
        todo, at, left = todo[more], at[more] + 8, left[more] - 8
    return out


class Shingler:
    """64-bit hashes of the distinct n-word shingles of texts."""

    def __init__(self, words: int):
        import numpy as np

        self.words = words
        mul = [_PLACES[k % 5] * (2 * (k // 5) + 1) & (2**64 - 1) for k in range(words)]
        self.mul = np.array(mul, np.uint64)
        self.blank = np.zeros(256, bool)
        self.blank[[32, *range(9, 14)]] = True
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[65:91] += 32

    def word_hashes(self, data: bytes):
        """Hashes of the words of UTF-8 text, A-Z lowered."""
        import numpy as np

        raw = self.lower[np.frombuffer(data, np.uint8)]
        gap = np.concatenate([[True], self.blank[raw], [True]])
        edge = np.diff(gap.astype(np.int8))
        start, stop = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        return hash_spans(raw, start, stop)

    def shingles(self, text: str | None):
        """Sorted distinct hashes; of a text with fewer words, one for the whole sequence."""
        import numpy as np

        w = self.word_hashes(text.encode("utf-8", "surrogatepass")) if text else np.zeros(0, np.uint64)
        n = len(w)
        if not n:
            return w
        if n < self.words:
            return _fmix(np.array([int((w * self.mul[:n]).sum(dtype=np.uint64))], np.uint64) + np.uint64(0xA5A5 + n))
        s = np.zeros(n - self.words + 1, np.uint64)
        for k in range(self.words):
            s += w[k : n - self.words + 1 + k] * self.mul[k]
        return np.unique(_fmix(s))


def _functions(count: int):
    import numpy as np

    seeds = np.arange(1, count + 1, dtype=np.uint64)
    return _fmix(seeds * np.uint64(_BASE)), _fmix(seeds * np.uint64(_PLACES[0])) | np.uint64(1)


def sketch(sets: list, count: int):
    """(len(sets), count) minimum hashes of non-empty sets."""
    import numpy as np

    flip, mul = _functions(count)
    at = np.cumsum([0, *map(len, sets[:-1])])
    flat, out = np.concatenate(sets), np.empty((len(sets), count), np.uint64)
    for k in range(count):
        out[:, k] = np.minimum.reduceat((flat ^ flip[k]) * mul[k], at)
    return out


def _sketches(rows: DataFrame, words: int, count: int) -> DataFrame:
    """(d, n, s1, s2, sig): set size, 128-bit hash of the set, minimum hashes cut to 32 bits."""

    def work(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        own = Shingler(words)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                some = batch.slice(at, 64)
                sets = [own.shingles(t.as_py()) for t in some.column(1)]
                full = [k for k, s in enumerate(sets) if len(s)]
                sigs = [None] * len(sets)
                if full:
                    for k, row in zip(full, (sketch([sets[k] for k in full], count) >> np.uint64(32)).astype("<u4")):
                        sigs[k] = row.tobytes()
                marks = np.array([np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), "<i8") for s in sets], np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(marks[:, 0]), pa.array(marks[:, 1]), pa.array(sigs, pa.binary())], names=["d", "n", "s1", "s2", "sig"])

    return rows.mapInArrow(tidy(work), "d long, n long, s1 long, s2 long, sig binary")


def _tables(reps: DataFrame, m: int, r: int) -> DataFrame:
    """(key, d, place): the m*m table keys of each class, place = i * m + j."""

    def work(batches):
        import numpy as np
        import pyarrow as pa

        number = np.arange(m * m, dtype=np.uint64)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                some = batch.slice(at, 1024)
                sig = np.frombuffer(b"".join(some.column(1).to_pylist()), "<u4").reshape(some.num_rows, 2, m, r).astype(np.uint64)
                half = sig[..., 0]
                for k in range(1, r):
                    half = _fmix(half * np.uint64(_PLACES[1])) + sig[..., k]
                half = _fmix(half)
                keys = half[:, 0, :, None] * np.uint64(_PLACES[2]) + half[:, 1, None, :] * np.uint64(_PLACES[3])
                keys = _fmix(keys.reshape(some.num_rows, m * m) + number * np.uint64(_PLACES[4]))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(some.column(0).to_numpy(), m * m)), pa.array(np.tile(np.arange(m * m, dtype=np.int32), some.num_rows))], names=["key", "d", "place"])

    return reps.select("d", "sig").mapInArrow(tidy(work), "key long, d long, place int")


def _in_buckets(tables: DataFrame, low: DataFrame, rows: int) -> DataFrame:
    """(key, d, place, low) of the rows of ``tables`` in buckets of two and more; rows: a bound of those of ``tables``.

    A bucket with more than a thousandth of all rows, of which there are at most
    HUBS, is not dealt by its key: its smallest member is sent to all tasks.
    """
    large = F.col("k") > max(BLOCK, -(-rows // HUBS))
    hubs = F.broadcast(low.where(large).select("key", F.col("low").alias("h")))
    marked = tables.join(hubs, "key", "left")
    others = marked.where("h is null").drop("h").join(low.where(~large).select("key", "low"), "key")
    return marked.where("h is not null").select("key", "d", "place", F.col("h").alias("low")).unionByName(others.select("key", "d", "place", "low"))


def _confirm(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (u, v) whose full sets have 100 * |both| >= percent * |either|.

    A hub's text goes once to each of its salts; the partner's text streams past
    it.  Texts with more than a thousandth of all pairs, of which there are at
    most a thousand, have a salt for each PARTNERS of them, all others SALTS.
    """
    count = pairs.count()
    hubs = pairs.groupBy("u").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > max(SALTS * PARTNERS, -(-count // 1000)))
    pairs = pairs.join(F.broadcast(hubs), "u", "left")
    salt = F.pmod(F.xxhash64("v"), F.coalesce(F.ceil(F.col("k") / PARTNERS), F.lit(SALTS))).cast("int").alias("salt")
    partners = pairs.join(texts.withColumnRenamed("d", "v"), "v").select("u", salt, "v", "t")
    hubs = pairs.select("u", salt).distinct().join(texts.withColumnRenamed("d", "u"), "u").select("u", "salt", F.lit(None).cast("long").alias("v"), "t")
    sent = partners.unionByName(hubs).repartition("u", "salt").sortWithinPartitions("u", "salt", F.col("v").asc_nulls_first())

    def work(batches):
        import numpy as np
        import pyarrow as pa

        own, hub, mine = Shingler(words), None, None
        for batch in batches:
            us, vs = [], []
            for u, v, t in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                s = own.shingles(t.as_py())
                if v is None:
                    hub, mine = u, s
                elif hub == u:
                    small, big = min(len(s), len(mine)), max(len(s), len(mine))
                    if 100 * small >= percent * big:
                        both = len(np.intersect1d(s, mine, assume_unique=True))
                        if 100 * both >= percent * (small + big - both):
                            us.append(u)
                            vs.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    return sent.select("u", "salt", "v", "t").mapInArrow(tidy(work), "u long, v long")


def _shared_shingles(texts: DataFrame, words: int) -> DataFrame:
    """(d, alone): how many shingles of each text no other of ``texts(d, t)`` holds; texts without such are left out."""

    def work(batches):
        import numpy as np
        import pyarrow as pa

        own = Shingler(words)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                sets = [own.shingles(t.as_py()) for t in some.column(1)]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(some.column(0).to_numpy(), [len(s) for s in sets])), pa.array(np.concatenate(sets).view(np.int64))], names=["d", "h"])

    held = texts.select("d", "t").mapInArrow(tidy(work), "d long, h long")
    alone = held.groupBy("h").agg(F.min("d").alias("d"), F.max("d").alias("e")).where("d = e")
    return alone.groupBy("d").agg(F.count(F.lit(1)).alias("alone"))


def _binned(texts: DataFrame, words: int) -> DataFrame:
    """(d, sig): of each of BINS ranges of hashes, a byte of the smallest shingle in it (0: none)."""

    def work(batches):
        import numpy as np
        import pyarrow as pa

        own, shift = Shingler(words), np.uint64(64 - (BINS - 1).bit_length())
        for batch in batches:
            out = []
            for t in batch.column(1):
                h = own.shingles(t.as_py())  # sorted
                cell, first = np.unique(h >> shift, return_index=True)
                row = np.zeros(BINS, np.uint8)
                row[cell.astype(np.int64)] = _fmix(h[first]) % np.uint64(255) + np.uint64(1)
                out.append(row.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["d", "sig"])

    return texts.select("d", "t").mapInArrow(tidy(work), "d long, sig binary")


def _stray_pairs(members: DataFrame, facts: DataFrame, percent: int, m: int, r: int) -> DataFrame:
    """Pairs of different components within buckets that sizes and sketches allow.

    members: (key, place, d, c), of buckets that had three members or more: the two left of one may not have
    been compared, as its smallest can be among those left out.  facts: (d, sig, mins, n, shared), of whose n shingles ``shared``
    are in other texts too: two sets have at most the smaller ``shared`` in common.  A pair
    is looked at in the first table that both share, which their hashes tell.  A bucket's largest component is not compared with
    itself; the rest meets all in blocks of at most BLOCK, each block pair a group.
    """
    sizes = members.groupBy("key", "c").agg(F.count(F.lit(1)).alias("k"))
    main = sizes.groupBy("key").agg(F.max_by("c", F.struct("k", "c")).alias("main"), F.sum("k").alias("all"), F.max("k").alias("most"), F.count(F.lit(1)).alias("cs")).where("cs > 1")
    main = main.select("key", "main", F.ceil(F.col("most") / BLOCK).cast("int").alias("nm"), F.ceil((F.col("all") - F.col("most")) / BLOCK).cast("int").alias("ns"))
    rows = members.join(main, "key").join(facts, "d")
    stray = F.col("c") != F.col("main")
    block = F.when(stray, F.pmod(F.xxhash64("d"), F.col("ns"))).otherwise(F.pmod(F.xxhash64("d"), F.col("nm"))).cast("int")
    rows = rows.select("key", "place", "d", "c", "sig", "mins", "n", "shared", stray.alias("stray"), block.alias("b"), "nm", "ns")
    # group (x, y): x a main block (from 0) or a stray block (from nm), y a stray block
    own = lambda f: F.transform(F.sequence(F.lit(0), F.col("ns") - 1), f)
    as_main = own(lambda j: F.struct(F.col("b").alias("x"), j.alias("y")))
    as_stray = F.concat(F.transform(F.sequence(F.lit(0), F.col("nm") - 1), lambda i: F.struct(i.alias("x"), F.col("b").alias("y"))), own(lambda j: F.struct((F.col("nm") + F.least(j, F.col("b"))).alias("x"), F.greatest(j, F.col("b")).alias("y"))))
    dealt = rows.select("key", F.explode(F.when(F.col("stray"), as_stray).otherwise(as_main)).alias("g"), "d", "c", "sig", "stray", "n", "shared", "mins", "place")
    dealt = dealt.select("key", F.col("g.x").cast("long").alias("x"), F.col("g.y").cast("long").alias("y"), "d", "c", "sig", "stray", "n", "shared", "mins", "place")

    def work(batches):
        import numpy as np
        import pyarrow as pa

        def pairs(cols):
            key, d, c, sig, stray, n, shared, mins, place = cols
            out, edge = [], np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            for a, b in zip([0, *edge.tolist()], [*edge.tolist(), len(key)]):
                for k in (a + np.flatnonzero(stray[a:b])).tolist():
                    fits = (c[a:b] != c[k]) & ((100 + percent) * np.minimum(shared[a:b], shared[k]) >= percent * (n[a:b] + n[k]))
                    near = a + np.flatnonzero(fits)
                    same = (mins[near] == mins[k]).reshape(len(near), 2, m, r).all(axis=3).argmax(axis=2)
                    near = near[same[:, 0] * m + same[:, 1] == place[k]]
                    both = ((sig[near] == sig[k]) & (sig[k] > 0)).sum(axis=1)
                    either = ((sig[near] > 0) | (sig[k] > 0)).sum(axis=1)
                    near = near[100 * both >= (percent - SLACK) * either]
                    out.append(np.stack([np.minimum(d[near], d[k]), np.maximum(d[near], d[k])]))
            found = np.unique(np.concatenate(out, axis=1), axis=1) if out else np.zeros((2, 0), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], names=["u", "v"])

        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = (np.stack([batch.column(k).to_numpy() for k in range(3)], axis=1), batch.column(3).to_numpy(), batch.column(4).to_numpy(), np.frombuffer(b"".join(batch.column(5).to_pylist()), np.uint8).reshape(batch.num_rows, -1), batch.column(6).to_numpy(zero_copy_only=False), batch.column(7).to_numpy(), batch.column(8).to_numpy(), np.frombuffer(b"".join(batch.column(9).to_pylist()), "<u4").reshape(batch.num_rows, -1), batch.column(10).to_numpy())
            held = new if held is None else tuple(np.concatenate([x, y]) for x, y in zip(held, new))
            last = int(np.flatnonzero((held[0] != held[0][-1]).any(axis=1))[-1]) + 1 if (held[0] != held[0][-1]).any() else 0
            if last:  # the last group may go on in the next batch
                yield pairs(tuple(x[:last] for x in held))
                held = tuple(x[last:] for x in held)
        if held is not None:
            yield pairs(held)

    sent = dealt.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")
    return sent.mapInArrow(tidy(work), "u long, v long").distinct()


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, m: int = 8, r: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs``."""
    bound_batches(docs)
    count, held, written = 2 * m * r, [], []

    def keep(df):
        held.append(hold(df))
        return held[-1]

    def store(df, name, files):
        written.append(write_stage(df, name, files))
        return written[-1]

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("d"), F.col(f"`{text_col}`").cast("string").alias("t"))
    sets = keep(_sketches(rows, words, count))
    files = files_for(sets.count())
    few = max(1, files // 4)  # for tables of ids, which are small beside texts
    reps = keep(sets.where("n > 0 and d is not null").groupBy("s1", "s2").agg(F.min("d").alias("d"), F.first("sig").alias("sig"), F.first("n").alias("n")))

    def named(ids):
        """Texts of the ids, one an id: the smallest with a word."""
        return rows.where(F.col("t").rlike("[^ \\t-\\r]")).join(ids.hint("merge"), "d", "left_semi").groupBy("d").agg(F.min("t").alias("t"))

    tables = _tables(reps, m, r)
    low = tables.groupBy("key").agg(F.min("d").alias("low"), F.max("d").alias("high"), F.count(F.lit(1)).alias("k")).where("low < high").select("key", "low", "k")
    members = store(_in_buckets(tables, low, m * m * sets.count()), "buckets", files)  # whose shuffles can go, as nothing is worked out from them again
    pairs = store(members.where("low < d").select(F.col("low").alias("u"), F.col("d").alias("v")).distinct(), "pairs", few)
    links, most = _confirm(pairs, named(pairs.select(F.explode(F.array("u", "v")).alias("d")).distinct()), words, percent), pairs.count()

    comp = components(links, most=most).select(F.col("node").alias("d"), "component")
    placed = members.join(comp, "d", "left").select("key", "place", "d", F.coalesce("component", "d").alias("c"))
    open_ = placed.groupBy("key").agg(F.min("c").alias("a"), F.max("c").alias("b"), F.count(F.lit(1)).alias("k")).where("a < b and k > 2").select("key")
    placed = store(placed.join(open_, "key", "left_semi"), "open", few)
    ids = placed.select("d").distinct()
    for _ in range(ROUNDS):  # who is left has fewer to share with
        facts = reps.join(ids, "d", "left_semi").join(_shared_shingles(named(ids), words), "d", "left").select("d", "n", F.col("sig").alias("mins"), (F.col("n") - F.coalesce("alone", F.lit(0))).alias("shared"))
        facts = store(facts.where(100 * F.col("shared") >= percent * F.col("n")), "facts", few)
        ids = facts.select("d")
    facts = facts.join(_binned(named(ids), words), "d")
    placed = placed.join(facts.select("d"), "d", "left_semi")
    more = store(_stray_pairs(placed, facts, percent, m, r).join(pairs, ["u", "v"], "left_anti"), "pairs", few)
    if strays := more.count():
        found = _confirm(more, named(more.select(F.explode(F.array("u", "v")).alias("d")).distinct()), words, percent)
        links = comp.select(F.col("d").alias("u"), F.col("component").alias("v")).where("u > v")  # as connected as those before, and at most as many
        comp = components(links.unionByName(found), most=most + strays).select(F.col("node").alias("d"), "component")

    classes = reps.select("s1", "s2", "d").join(comp, "d", "left").select("s1", "s2", F.coalesce("component", "d").alias("component"))
    out = sets.select("d", "n", "s1", "s2").join(classes, ["s1", "s2"], "left")
    component = F.when(F.col("n") == 0, F.col("d")).otherwise(F.coalesce("component", "d"))
    done = write_stage(out.select("d", "n", component.alias("component")), "groups", few)
    for df in held:
        df.unpersist()
    for df in written:
        drop_stage(df)
    return done.select(F.col("d").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("d").eqNullSafe(F.col("component")).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """``docs`` with one document, the smallest id, of each group of near-duplicates."""
    gone = near_duplicates(docs, id_col=id_col, **how).where(~F.col("kept")).select(id_col).distinct()
    return docs.join(gone, id_col, "left_anti")
