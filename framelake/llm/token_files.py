"""Token files in Simple-8b words.

A 64-bit word holds a 4-bit selector and 60 bits of payload.  Selectors 2 to 15
pack 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2 or 1 values of 1, 2, 3, 4, 5, 6,
7, 8, 10, 12, 15, 20, 30 or 60 bits; selector 1 is a run of 120 zeros; selector
0 is an escape, and the word after it holds one raw 64-bit value.  A block
restarts the packing every ``MINI`` ids and stores the word offset of each
restart, so blocks decode with whole-array operations and a stretch of ids is
read from the restart before it to the one behind it (``read_ids``).

Block payload, little-endian: ``S8B1``, then u32 documents, u32 restarts, u64
ids, u64 words, then i64 doc_id, u8 doc_id present, u64 count of each document,
u32 word offset of each restart, and the words.

Defined cases: null and empty texts hold only the end id; null ids come first;
rows with equal ids, repeated ones too, each have their ids, in the order of
their texts' hashes; an empty table gives an empty file; a text of any length is
encoded whole and is a block of its own if it is longer than one; columns other
than the id and the text are not read, whatever their names.
"""

from __future__ import annotations

import struct
import zlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import bound_batches, write_stage

MINI = 4096
BLOCK_IDS = 1 << 18
#: selector -> (values, bits); fixed by the format
PACKS = {2: (60, 1), 3: (30, 2), 4: (20, 3), 5: (15, 4), 6: (12, 5), 7: (10, 6), 8: (8, 7), 9: (7, 8), 10: (6, 10), 11: (5, 12), 12: (4, 15), 13: (3, 20), 14: (2, 30), 15: (1, 60)}
BLOCKS = "part int, block int, first_doc long, n_ids long, start_in_part long, payload binary"


def pack(ids) -> tuple:
    """(words u64, word offset of each restart u32) of an integer array."""
    import numpy as np

    v = np.ascontiguousarray(ids)
    n = len(v)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    choice = np.zeros(n, np.int8)  # escape
    top, least = int(v.max()), int(v.min())

    def offer(fits, count, sel):
        """Take ``sel`` wherever ``count`` values from here on fit."""
        run, have = fits, 1
        while have < count:  # windows of doubled length
            more = min(have, count - have)
            if len(run) <= more:
                return
            run, have = run[:-more] & run[more:], have + more
        np.putmask(choice[: len(run)], run, sel)

    for sel in range(15, 1, -1):
        count, bits = PACKS[sel]
        if least >> bits:
            break
        offer(np.ones(n, bool) if not top >> bits else v < (1 << bits), count, sel)
    if least == 0:
        offer(v == 0, 120, 1)
    # near a restart or the end, fewer values are left than a selector packs: choose again there
    size = np.array([1, 120] + [PACKS[s][0] for s in range(2, 16)], np.int16)
    step = size[choice]
    v = v.astype(np.uint64)
    left = np.minimum(MINI - np.arange(n) % MINI, n - np.arange(n)).astype(np.int16)
    late = np.flatnonzero(step > left)
    if len(late):
        for i in late.tolist():
            room = int(left[i])
            for sel in range(2, 16):
                count, bits = PACKS[sel]
                if count <= room and not int(v[i : i + count].max()) >> bits:
                    break
            else:
                sel = 0
            choice[i], step[i] = sel, size[sel]
    steps, at, i = step.tolist(), [], 0
    add = at.append
    while i < n:
        add(i)
        i += steps[i]
    at = np.array(at, np.int64)
    sel = choice[at]
    width = 1 + (sel == 0)
    place = np.cumsum(width) - width
    words = np.zeros(int(width.sum()), np.uint64)
    words[place] = sel.astype(np.uint64) << np.uint64(60)
    for s, (count, bits) in PACKS.items():
        mine = np.flatnonzero(sel == s)
        if len(mine):
            w = words[place[mine]]
            for k in range(count):
                w |= v[at[mine] + k] << np.uint64(k * bits)
            words[place[mine]] = w
    raw = np.flatnonzero(sel == 0)
    words[place[raw] + 1] = v[at[raw]]
    return words, place[np.flatnonzero(at % MINI == 0)].astype(np.uint32)


def unpack(words):
    """The values of a run of words."""
    import numpy as np

    sel = (words >> np.uint64(60)).astype(np.int8)
    zero = sel == 0
    if zero.any():  # a raw word follows an escape: of a stretch of such selectors every second one, or the word behind it, is raw
        place = np.arange(len(words))
        before = np.concatenate([[-1], np.maximum.accumulate(np.where(zero, -1, place))[:-1]])
        sel = np.where((place - 1 - before) % 2 == 1, np.int8(-1), sel)
    counts = np.zeros(len(words), np.int64)
    for s, (count, _) in PACKS.items():
        counts[sel == s] = count
    counts[sel == 1], counts[sel == 0] = 120, 1
    at = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    for s, (count, bits) in PACKS.items():
        mine = np.flatnonzero(sel == s)
        if len(mine):
            w, mask = words[mine], np.uint64((1 << bits) - 1)
            for k in range(count):
                out[at[mine] + k] = (w >> np.uint64(k * bits)) & mask
    esc = np.flatnonzero(sel == 0)
    out[at[esc]] = words[esc + 1]
    return out


def write_block(doc_ids: list, counts: list, ids) -> bytes:
    import numpy as np

    words, marks = pack(ids)
    docs = np.array([0 if d is None else d for d in doc_ids], "<i8")
    known = np.array([d is not None for d in doc_ids], "u1")
    head = b"S8B1" + struct.pack("<IIQQ", len(docs), len(marks), len(ids), len(words))
    return b"".join([head, docs.tobytes(), known.tobytes(), np.array(counts, "<u8").tobytes(), marks.astype("<u4").tobytes(), words.astype("<u8").tobytes()])


def _parts(blob: bytes) -> tuple:
    """(doc ids, presence, counts, restarts, words, number of ids) of a block."""
    import numpy as np

    if blob[:4] != b"S8B1":
        raise ValueError("not a token block")
    n_docs, n_marks, n_ids, n_words = struct.unpack_from("<IIQQ", blob, 4)
    at, out = 28, []
    for kind, n in (("<i8", n_docs), ("u1", n_docs), ("<u8", n_docs), ("<u4", n_marks), ("<u8", n_words)):
        out.append(np.frombuffer(blob, kind, n, at))
        at += out[-1].nbytes
    return *out, n_ids


def read_block(blob: bytes) -> tuple:
    """(doc ids, counts, ids) of a block."""
    import numpy as np

    docs, known, counts, _, words, n_ids = _parts(blob)
    ids = unpack(words)
    if len(ids) != n_ids:
        raise ValueError("a token block is damaged")
    return [int(d) if k else None for d, k in zip(docs, known)], counts.astype(np.int64), ids


def read_ids(blob: bytes, start: int, stop: int):
    """Ids ``start`` to ``stop`` of a block, decoded between the restarts around them."""
    _, _, _, marks, words, n_ids = _parts(blob)
    if not 0 <= start <= stop <= n_ids:
        raise ValueError("no such ids")
    if start == stop:
        return unpack(words[:0])
    first, last = start // MINI, -(-stop // MINI)
    ids = unpack(words[marks[first] : marks[last] if last < len(marks) else None])
    return ids[start - first * MINI : stop - first * MINI]


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Blocks of the token file, in ascending document order.

    Whole texts are dealt by ranges of the document id and sorted, so block and
    part numbers follow that order; null ids come first, rows with equal ids
    in the order of their texts.  Null and empty texts hold only ``end_id``.
    A worker holds one block, or one document where that is longer.
    """
    bound_batches(docs)
    rows = docs.select(F.col(id_col).cast("long").alias("d"), F.col(text_col).cast("string").alias("t"))
    rows = rows.repartitionByRange(F.col("d").asc_nulls_first()).sortWithinPartitions(F.col("d").asc_nulls_first(), F.xxhash64("t"), "t")
    rows = rows.withColumn("p", F.spark_partition_id())  # not the task's, which may take several partitions

    def work(batches):
        import numpy as np
        import pyarrow as pa

        from .byte_bpe import load

        bpe, part, block, start = load(tokenizer), None, 0, 0
        end = np.array([end_id], "<u2").tobytes()
        names, counts, parts, held = [], [], [], 0
        schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("first_doc", pa.int64()), ("n_ids", pa.int64()), ("start_in_part", pa.int64()), ("payload", pa.binary())])

        def flush():
            ids = np.frombuffer(b"".join(parts), "<u2")
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((part, block, names[0], held, start, write_block(names, counts, ids)), schema)], schema=schema)

        for batch in batches:
            if part is None and batch.num_rows:
                part = batch.column(2)[0].as_py()
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                parts.append(bpe.encode(t.as_py()) + end)
                names.append(d)
                counts.append(len(parts[-1]) // 2)
                held += counts[-1]
                if held >= BLOCK_IDS:
                    yield flush()
                    block, start = block + 1, start + held
                    names, counts, parts, held = [], [], [], 0
        if names:
            yield flush()

    return rows.mapInArrow(work, BLOCKS)


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int = 0, path: str | None = None, **cols) -> DataFrame:
    """Write the token file (a folder of part files) and return its blocks as read back.

    ``path`` is a folder all nodes see; without it one in the shared folder is taken.
    """
    blocks = encode_documents(docs, tokenizer, end_id, **cols)
    if path is None:
        return write_stage(blocks, "tokens")
    blocks.write.mode("overwrite").parquet(path)
    return docs.sparkSession.read.schema(BLOCKS).parquet(path)


def read_token_files(blocks: DataFrame) -> DataFrame:
    """One row a document: doc_id, start, n_tokens, ids_crc32, decoded from the blocks.

    What comes before a part is summed from one row a part, so what is
    broadcast is bounded by the number of part files.
    """
    sums = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = sums.select("part", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("base"))
    rows = blocks.join(F.broadcast(ahead), "part").select((F.col("base") + F.col("start_in_part")).alias("at"), "payload")

    def work(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for at, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                names, counts, ids = read_block(blob.as_py())
                data, ends = memoryview(ids.astype("<u4").tobytes()), np.cumsum(counts)
                starts = ends - counts
                crcs = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(starts + at, pa.int64()), pa.array(counts, pa.int64()), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.mapInArrow(work, "doc_id long, start long, n_tokens long, ids_crc32 long")
