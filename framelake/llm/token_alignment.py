"""Alignment of two tokenizers: groups, links and how common each link is.

A is a byte-level BPE, B a sentencepiece BPE; both cover the bytes of a space
and the text.  Two tokens are linked when their byte ranges overlap; places where
tokens of both end cut a text into groups.

Inside a task, DuckDB works on the tables of token intervals of an Arrow batch:
an ASOF join finds the B token that holds an A token's first byte, a range join
the B tokens that begin inside it, window sums over the common ends number the
groups.  Neither tokenizer merges across a single space between two characters
that are not white space, so a text is laid out as stretches between such spaces
and each stretch is aligned once; a text's result is the sum over its stretches.
A worker keeps the stretches that recur most, at most ``KEPT``.

Every task sends partial counts, of how many of its documents hold a pair of ids
linked; Spark adds them up and joins the counts to the pairs that each document
holds.  The ``HOT`` most frequent pairs are sent to all tasks; the others are
joined by an exchange, where no pair can be held by more than the HOT-th part of
all pairs.

Defined cases: null and empty texts, and texts that a tokenizer does not give
back byte for byte (with U+2581, for one), have no tokens, zeros and an empty
``groups_sha256``; each row is a document, so repeated rows and ids count each;
a null id stays null; an empty table gives an empty one; texts of any length are
aligned whole; columns other than the id and the text are not read, whatever
their names.
"""

from __future__ import annotations

import hashlib
import itertools
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import bound_batches, drop_stage, write_stage
from .byte_bpe import ByteBPE

#: Stretches that a worker keeps, and the longest of them; bytes of stretches in one call of DuckDB.
KEPT, LONG, BYTES = 300_000, 64, 2_000_000
#: Documents that are worked on together, and partial counts that a task holds before it sends them.
SLICE, PARTIAL = 64, 1_000_000
#: Pairs whose counts are sent to all tasks (some 40 bytes each).
HOT = 500_000

_SAFE, _EDGY = re.compile(r"(?<=\S) (?=\S)"), re.compile(r"\s\s|\A\s|\s\Z")
_loaded: dict[tuple[str, str], "Aligner"] = {}

#: Token intervals ``a`` and ``b`` (stretch, pos, id, s, e) with positions and bytes that go on from stretch to stretch.
LINKS = """
WITH found AS (
  SELECT a.stretch, a.id * 65536 + b.id AS pair FROM a ASOF JOIN b ON a.s >= b.s
  UNION ALL
  SELECT a.stretch, a.id * 65536 + b.id FROM a JOIN b ON b.s > a.s AND b.s < a.e)
SELECT stretch, pair, count(*) AS k FROM found GROUP BY ALL ORDER BY ALL"""
#: The group of each token of {x}, in order: the sum of the ends that both have before it.
GROUPS = """
SELECT coalesce(sum((o.e IS NOT NULL)::INTEGER) OVER (ORDER BY x.pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS g
FROM {x} x LEFT JOIN {o} o ON x.e = o.e ORDER BY x.pos"""


class Aligner:
    """Both tokenizers, a DuckDB of the process, and the stretches that were aligned."""

    def __init__(self, byte_path: str, piece_path: str):
        import duckdb
        import numpy as np
        import sentencepiece

        self.a = ByteBPE(byte_path)
        self.a.tok.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if len(pieces) > 1 << 16:
            raise ValueError("more than 65536 ids")
        if any(re.search("[^▁]▁", p) for p in pieces):
            raise ValueError("pieces go across spaces")
        self.bytes_a = [self.a.surface.get(i, b"") for i in range(1 << 16)]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.size_a, self.size_b = (np.array(list(map(len, x)), np.int64) for x in (self.bytes_a, self.bytes_b))
        self.opens = np.array([p[:1] == "▁" for p in pieces])
        self.names = list(map(str, range(1 << 16)))
        # nothing is spilled: a call's tables are bounded by BYTES, or one stretch
        self.db = duckdb.connect(":memory:", config={"threads": 1, "temp_directory": ""})
        self.forget()

    def forget(self):
        import numpy as np

        self.number: dict[str, int] = {}
        self.text: list[str] = []
        self.facts = np.zeros((0, 4), np.int64)  # A tokens, B tokens, groups, links; -1: not given back
        self.first, self.pair, self.times = np.zeros(1, np.int64), np.zeros(0, np.uint32), np.zeros(0, np.int64)
        self.hits = np.zeros(0, np.int64)

    def shrink(self):
        """Keep the half that was met most often, and no long ones."""
        import numpy as np

        names = list(self.number)
        short = np.array([len(u) <= LONG for u in names], bool)
        keep = np.argsort(-self.hits * short, kind="stable")[: KEPT // 2]
        keep = keep[short[keep]]
        flat, sizes = _ranges(self.first[keep], np.diff(self.first)[keep])
        self.number = {names[k]: i for i, k in enumerate(keep.tolist())}
        self.text = [self.text[k] for k in keep.tolist()]
        self.facts, self.hits = self.facts[keep], self.hits[keep] // 2
        self.first, self.pair, self.times = np.concatenate([[0], np.cumsum(sizes)]), self.pair[flat], self.times[flat]

    def learn(self, new: list[str]):
        """Align stretches that were not met before."""
        at, size = 0, 0
        for k, u in enumerate(new):
            size += len(u) + 1
            if size > BYTES or k == len(new) - 1:
                self._align(new[at : k + 1])
                at, size = k + 1, 0

    def _together(self, new: list[str]):
        """Ids of stretches that hold no space, encoded as one text: (A ids, their number, B ids, their number), or None if that cannot be told."""
        import numpy as np

        text = " ".join(new)
        if _EDGY.search(text) or text.count(" ") != len(new) - 1 or len(max(new, key=len)) > 256:
            return None
        a, b = self.a.fast.encode_to_numpy(" " + text).astype(np.int64), np.array(self.b.encode(text), np.int64)
        at = [np.flatnonzero(opens[ids]) for opens, ids in ((self.a.opens, a), (self.opens, b))]
        if len(at[0]) != len(new) or len(at[1]) != len(new):
            return None
        return a, np.diff(at[0], append=len(a)), b, np.diff(at[1], append=len(b))

    def _encode(self, new: list[str]):
        """As ``_together``, and which stretches both tokenizers give back."""
        import numpy as np

        size = np.array([len(u.encode("utf-8", "surrogatepass")) + 1 for u in new])
        found = self._together(new)
        if found:
            a, n_a, b, n_b = found
        else:
            each_a = [np.frombuffer(self.a.piece(" " + u), "<u2").astype(np.int64) for u in new]
            each_b = [np.array(x, np.int64) for x in self.b.encode(new, num_threads=1)]
            (a, n_a), (b, n_b) = ((np.concatenate(x), np.array(list(map(len, x)))) for x in (each_a, each_b))
        sums = [np.bincount(np.repeat(np.arange(len(new)), n), weights=of[ids], minlength=len(new)) for of, ids, n in ((self.size_a, a, n_a), (self.size_b, b, n_b))]
        given = (sums[0] == size) & (sums[1] == size)
        joined = [b"".join(map(of.__getitem__, ids.tolist())) for of, ids in ((self.bytes_a, a), (self.bytes_b, b))]
        if not given.all() or joined[0] != joined[1] or joined[0] != ("".join(" " + u for u in new)).encode("utf-8", "surrogatepass"):
            ends = [np.concatenate([[0], np.cumsum(x)]).astype(int).tolist() for x in sums]
            given &= [(" " + u).encode("utf-8", "surrogatepass") == joined[0][p:q] == joined[1][r:t] for u, p, q, r, t in zip(new, ends[0], ends[0][1:], ends[1], ends[1][1:])]
        return a, n_a, b, n_b, given

    def _align(self, new: list[str]):
        import numpy as np
        import pyarrow as pa

        a, n_a, b, n_b, given = self._encode(new)
        facts, texts = np.full((len(new), 4), -1, np.int64), [""] * len(new)
        counts, pair, times = np.zeros(len(new), np.int64), np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if given.any():
            of = [np.repeat(np.arange(len(new)), n) for n in (n_a, n_b)]
            ids = [x[given[k]] for x, k in zip((a, b), of)]
            of = [k[given[k]] for k in of]
            for name, x, k, size in zip("ab", ids, of, (self.size_a, self.size_b)):
                end = np.cumsum(size[x])
                self.db.register(name, pa.table({"stretch": k, "pos": np.arange(len(x)), "id": x, "s": end - size[x], "e": end}))
            links = {k: np.asarray(v).astype(np.int64) for k, v in self.db.execute(LINKS).fetchnumpy().items()}
            groups = [np.asarray(self.db.execute(GROUPS.format(x=x, o=o)).fetchnumpy()["g"], np.int64) for x, o in ("ab", "ba")]
            self.db.unregister("a")
            self.db.unregister("b")
            pair, times = links["pair"].astype(np.uint32), links["k"]
            counts = np.bincount(links["stretch"], minlength=len(new))
            held = np.bincount(of[0][np.flatnonzero(np.diff(groups[0], prepend=-1))], minlength=len(new))  # groups of each stretch
            facts[given] = np.stack([n_a, n_b, held, np.bincount(links["stretch"], weights=times, minlength=len(new)).astype(np.int64)], axis=1)[given]
            named = list(map("|".join, zip(*(self._joined(x, g) for x, g in zip(ids, groups)))))
            ends = np.cumsum(held).tolist()
            texts = [";".join(named[lo:hi]) for lo, hi in zip([0, *ends], ends)]
        have = len(self.text)
        self.number.update(zip(new, range(have, have + len(new))))
        self.text += texts
        self.facts, self.hits = np.concatenate([self.facts, facts]), np.concatenate([self.hits, np.zeros(len(new), np.int64)])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(counts)])
        self.pair, self.times = np.concatenate([self.pair, pair]), np.concatenate([self.times, times])

    def _joined(self, ids, group) -> list[str]:
        """The decimal ids of each group with commas between."""
        import numpy as np

        names = list(map(self.names.__getitem__, ids.tolist()))
        at = np.flatnonzero(np.diff(group, prepend=-1)).tolist()
        return [names[lo] if hi == lo + 1 else ",".join(names[lo:hi]) for lo, hi in zip(at, [*at[1:], len(names)])]

    def documents(self, texts: list):
        """(facts, digests, pairs' row, pair, times) of some texts; the pairs by row and ascending."""
        import numpy as np

        cut = [[] if not t else t.split(" ") if not _EDGY.search(t) else [(p := _SAFE.split(" " + t))[0][1:], *p[1:]] for t in texts]
        if len(self.number) > KEPT:
            self.shrink()
        new = set().union(*cut).difference(self.number)
        if new:  # those with a space inside, or white space at an end, by themselves
            odd = {u for u in new if not u or " " in u or _EDGY.search(u)}
            self.learn(sorted(new - odd))
            self.learn(sorted(odd))
        at = [list(map(self.number.__getitem__, units)) for units in cut]
        row = np.repeat(np.arange(len(texts)), list(map(len, at)))
        flat = np.fromiter(itertools.chain.from_iterable(at), np.int64, len(row))
        self.hits += np.bincount(flat, minlength=len(self.hits))
        bad = np.zeros(len(texts), bool)
        bad[row[self.facts[flat, 0] < 0]] = True
        sums = np.stack([np.bincount(row, weights=self.facts[flat, c], minlength=len(texts)) for c in range(4)], axis=1).astype(np.int64)
        sums[bad] = 0
        digests = ["" if wrong or not x else hashlib.sha256(";".join(map(self.text.__getitem__, x)).encode()).hexdigest() for x, wrong in zip(at, bad)]
        good = ~bad[row]
        met, often = np.unique(row[good] << 32 | flat[good], return_counts=True)
        who, unit = met >> 32, met & 0xFFFFFFFF
        index, sizes = _ranges(self.first[unit], self.first[unit + 1] - self.first[unit])
        keys, inverse = np.unique(np.repeat(who, sizes) << 32 | self.pair[index].astype(np.int64), return_inverse=True)
        times = np.bincount(inverse, weights=self.times[index] * np.repeat(often, sizes), minlength=len(keys)).astype(np.int64)
        return sums, digests, keys >> 32, (keys & 0xFFFFFFFF).astype(np.uint32), times


def _ranges(first, sizes):
    """Indices first[k], first[k] + 1, ... of each k in turn, and the sizes."""
    import numpy as np

    before = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) - np.repeat(before - first, sizes), sizes


def load(byte_path: str, piece_path: str) -> Aligner:
    """One instance a worker process."""
    if (byte_path, piece_path) not in _loaded:
        _loaded[byte_path, piece_path] = Aligner(byte_path, piece_path)
    return _loaded[byte_path, piece_path]


def _aligned(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """A row for each of ``docs(id, t)`` with its distinct pairs and how often they are linked; rows without ``row`` hold partial counts."""
    facts = ["n_a", "n_b", "n_groups", "n_links"]
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("id", docs.schema["id"].dataType), *(T.StructField(c, T.LongType()) for c in facts), T.StructField("groups_sha256", T.StringType()), T.StructField("pairs", T.ArrayType(T.IntegerType())), T.StructField("times", T.ArrayType(T.LongType()))])

    def work(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        own, row = load(byte_path, piece_path), TaskContext.get().partitionId() << 40
        names = ["row", "id", *facts, "groups_sha256", "pairs", "times"]
        held, size = [], 0

        def counted():
            pair = np.concatenate([p for p, _ in held])
            found, at = np.unique(pair, return_inverse=True)
            return found, np.bincount(at, weights=np.concatenate([k for _, k in held]), minlength=len(found)).astype(np.int64)

        def sent(found, k):
            lists = [pa.ListArray.from_arrays(pa.array([0, len(found)], pa.int32()), pa.array(v)) for v in (found.view(np.int32), k)]
            none = pa.array([None], pa.int64())
            return pa.RecordBatch.from_arrays([none, pa.nulls(1, kind), *[none] * 4, pa.array([None], pa.string()), *lists], names=names)

        for batch in batches:
            kind = batch.schema.field(0).type
            for at in range(0, batch.num_rows, SLICE):
                some = batch.slice(at, SLICE)
                n = some.num_rows
                sums, digests, who, pair, times = own.documents(some.column(1).to_pylist())
                offsets = pa.array(np.searchsorted(who, np.arange(n + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in (pair.view(np.int32), times)]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + n)), some.column(0), *(pa.array(np.ascontiguousarray(sums[:, c])) for c in range(4)), pa.array(digests, pa.string()), *lists], names=names)
                row += n
                held.append(np.unique(pair, return_counts=True))
                size += len(held[-1][0])
                if size > PARTIAL:
                    held = [counted()]
                    size = len(held[0][0])
                    if size > PARTIAL // 2:
                        yield sent(*held[0])
                        held, size = [], 0
        if held:
            yield sent(*counted())

    return docs.mapInArrow(work, schema)


def align_tokenizers(docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row of ``docs``."""
    bound_batches(docs)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("t"))
    done = write_stage(_aligned(rows, byte_path, piece_path), "aligned")
    each = lambda df: df.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("k"))
    counts = each(done.where("row is null")).groupBy("pair").agg(F.sum("k").alias("n")).withColumn("a", F.expr("shiftrightunsigned(pair, 16)"))
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    counts = write_stage(counts.join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "pairs")
    held, total = each(done.where("row is not null")), counts.count()
    if total <= HOT:
        scored = held.join(F.broadcast(counts), "pair")
    else:
        least = counts.orderBy(F.col("n").desc()).limit(HOT).agg(F.min("n")).first()[0]
        hot = F.broadcast(counts.where(F.col("n") > least))  # fewer than HOT
        near = held.join(hot, "pair", "left")
        rest = near.where("n is null").select("row", "pair", "k").join(counts.where(F.col("n") <= least), "pair")
        scored = near.where("n is not null").select("row", "k", "n", "best").unionByName(rest.select("row", "k", "n", "best"))
    sums = scored.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("k")).otherwise(F.lit(0))).alias("n_best"), F.sum(F.col("k") * F.col("n")).alias("count_sum"))
    facts = done.where("row is not null").select("row", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return facts.join(sums, "row", "left").select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
