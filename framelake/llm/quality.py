"""Quality classifier on supervised subword embeddings.

A document is the average of learned vectors of its words and of their
character n-grams (3 to 5, with word ends marked), hashed into ``CELLS`` cells;
a word that repeats the one before it counts as one more feature.  A softmax over
two classes reads the average.  Vectors and softmax are trained by stochastic
gradient descent in numpy, a vector's step scaled by the root of its share of the
document instead of the share (so rare features learn faster than by the plain gradient),
on a bounded sample of labelled documents
(``sample`` ids, taken in the order of a hash of their ids, with texts of at most
``sample_chars`` characters, so at most their product comes to the one task that
trains).
Scoring reads whole texts of all rows: as the softmax is linear in the average,
each word needs one number, which workers keep in a bounded cache; the new words of some
texts are hashed together by array arithmetic; words of more
than ``LONG`` characters are taken in chunks of ``CHUNK`` and not kept.

Defined cases: a null or empty text has no features and is scored by the
softmax's bias alone; labels that are null are not learned from, of several for
one id the largest counts; each row is scored by its own text, so repeated rows
score alike; of rows that share a sampled id one text is learned from, the
smallest; rows without an id are scored and never learned from; with no
examples, or of one class only, the score is their share of label 1 (0.5 of
none); an empty table gives an empty one; columns may have any names but
``held_out``, ``score`` and ``predicted``, which raise.
"""

from __future__ import annotations

import functools
import math
import zlib

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import bound_batches, tidy

CELLS, DIM = 1 << 17, 16
CACHE = 200_000
#: Characters of texts whose new words are looked up together, and the most words of which that is done at a time.
SLICE, TOGETHER = 1 << 18, 1 << 12
SAMPLE, SAMPLE_CHARS = 4_000, 20_000
LONG, CHUNK = 64, 1 << 16
_REPEAT = 0  # the cell of a repeated word


def word_cells(word: str) -> list[int]:
    """Cells of a word and of its character n-grams."""
    marked = f"<{word}>"
    grams = [marked[i : i + n] for n in (3, 4, 5) for i in range(len(marked) - n + 1)]
    return [1 + zlib.crc32(g.encode("utf-8", "replace")) % (CELLS - 1) for g in [word, *grams]]


@functools.cache
def _crc_table():
    import numpy as np

    x = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        x = np.where(x & 1, x >> np.uint32(1) ^ np.uint32(0xEDB88320), x >> np.uint32(1))
    return x


def long_word_cells(word: str) -> Iterator:
    """The cells of ``word_cells`` as arrays, from chunks that overlap by four characters."""
    import numpy as np

    table = _crc_table()
    yield np.array([1 + zlib.crc32(word.encode("utf-8", "replace")) % (CELLS - 1)])
    marked = f"<{word}>"
    for lo in range(0, len(marked) - 2, CHUNK):
        part = marked[lo : lo + CHUNK + 4]
        raw = np.frombuffer(part.encode("utf-8", "replace"), np.uint8)
        first = np.flatnonzero((raw & 0xC0) != 0x80)  # of each character
        sizes = np.diff(first, append=len(raw))
        state = np.full(min(CHUNK, len(part)), 0xFFFFFFFF, np.uint32)
        for n in range(1, 6):  # the checksums of n characters from each place, continued from those of n - 1
            state = state[: len(part) - n + 1]
            at, size = first[n - 1 : n - 1 + len(state)], sizes[n - 1 : n - 1 + len(state)]
            for k in range(int(size.max(initial=0))):
                has = size > k
                byte = raw[np.where(has, at + k, 0)]
                state = np.where(has, table[(state ^ byte) & np.uint32(0xFF)] ^ (state >> np.uint32(8)), state)
            if n >= 3:
                yield 1 + (state ^ np.uint32(0xFFFFFFFF)).astype(np.int64) % (CELLS - 1)


def word_sums(words: list[str], value):
    """For each of ``words``, which are not empty, the sum of ``value`` over its ``word_cells``, and how many those are.

    The grams' checksums are worked out for all words together, one character more at a time.
    """
    import numpy as np

    table = _crc_table()
    text = "".join([f"<{w}>" for w in words])
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    length = np.fromiter(map(len, words), np.int64, len(words)) + 2
    owner = np.repeat(np.arange(len(words)), length)
    left = np.cumsum(length)[owner] - np.arange(len(text))  # characters to the word's end
    first = np.arange(len(raw)) if len(raw) == len(text) else np.flatnonzero((raw & 0xC0) != 0x80)
    sizes = np.diff(first, append=len(raw))
    total = value[np.fromiter((1 + zlib.crc32(w.encode("utf-8", "replace")) % (CELLS - 1) for w in words), np.int64, len(words))]
    at = np.arange(len(text))
    state = np.full(len(text), 0xFFFFFFFF, np.uint32)
    for n in range(1, 6):
        inside = left[at] >= n
        at, state = at[inside], state[inside]
        start, size = first[at + n - 1], sizes[at + n - 1]
        for k in range(int(size.max(initial=0))):
            has = slice(None) if k == 0 else np.flatnonzero(size > k)
            state[has] = table[(state[has] ^ raw[start[has] + k]) & np.uint32(0xFF)] ^ (state[has] >> np.uint32(8))
        if n >= 3:
            cells = 1 + (state ^ np.uint32(0xFFFFFFFF)).astype(np.int64) % (CELLS - 1)
            total = total + np.bincount(owner[at], weights=value[cells], minlength=len(words))
    return total, 1 + sum(np.maximum(length - n + 1, 0) for n in (3, 4, 5))


def features(text: str | None):
    """(cells, shares) of a document."""
    import numpy as np

    words = text.split() if text else []
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    total = np.zeros(0, np.int64), np.zeros(0)
    if words:
        lists = [word_cells(w) if len(w) <= LONG else np.concatenate([*long_word_cells(w)]) for w in counts]
        cells = np.concatenate([np.array(x) for x in lists])
        each = np.repeat(np.fromiter(counts.values(), np.float64, len(counts)), [len(x) for x in lists])
        same = sum(a == b for a, b in zip(words, words[1:]))
        cells, each = np.append(cells, _REPEAT), np.append(each, same)
        found, at = np.unique(cells, return_inverse=True)
        n = np.bincount(at, weights=each)
        total = found, n / n.sum()
    return total


class Vocabulary:
    """Words of the examples with their cells, and each example's words and their counts, in flat arrays."""

    def __init__(self, texts: list):
        import numpy as np

        number: dict[str, int] = {}
        self.docs = []
        for text in texts:
            words = text.split() if text else []
            counts: dict[int, int] = {}
            for w in words:
                k = number.setdefault(w, len(number))
                counts[k] = counts.get(k, 0) + 1
            ids = np.fromiter(counts, np.int32, len(counts))
            self.docs.append((ids, np.fromiter(counts.values(), np.int32, len(counts)), sum(a == b for a, b in zip(words, words[1:]))))
        cells = [np.array(word_cells(w) if len(w) <= LONG else np.concatenate([*long_word_cells(w)]), np.int32) for w in number]
        self.size = np.array([len(c) for c in cells], np.int64)
        self.start, self.cells = np.cumsum(self.size) - self.size, np.concatenate(cells) if cells else np.zeros(0, np.int32)

    def features(self, k: int):
        """(cells, shares) of example k."""
        import numpy as np

        ids, counts, same = self.docs[k]
        if not len(ids):
            return np.zeros(0, np.int32), np.zeros(0, np.float32)
        sizes = self.size[ids]
        at = np.repeat(self.start[ids] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        found, where = np.unique(np.append(self.cells[at], np.int32(_REPEAT)), return_inverse=True)
        n = np.bincount(where, weights=np.append(np.repeat(counts, sizes), same))
        return found, (n / n.sum()).astype(np.float32)


def train(texts: list, labels: list, epochs: int = 3, rate: float = 2.0, seed: int = 11) -> dict:
    """Vectors and softmax; reduced to one value a cell and a bias, which give the same scores."""
    import numpy as np

    y = np.array(labels, np.int64)
    if len(set(labels)) < 2:
        share = min(max(float(np.mean(y)) if len(y) else 0.5, 1e-6), 1 - 1e-6)
        return {"value": np.zeros(CELLS), "bias": float(np.log(share / (1 - share)))}
    rng = np.random.default_rng(seed)
    examples = Vocabulary(texts)
    vectors = (rng.random((CELLS, DIM), np.float32) - 0.5) / DIM
    out, bias = np.zeros((2, DIM), np.float32), np.zeros(2, np.float32)
    out[1] = rng.random(DIM, np.float32) - 0.5
    out[0] = -out[1]
    step, steps = 0, epochs * len(texts)
    for _ in range(epochs):
        for k in rng.permutation(len(texts)):
            cells, share = examples.features(k)
            lr = rate * (1 - step / steps)
            step += 1
            rows = vectors[cells]
            hidden = share @ rows
            z = out @ hidden + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[k]] -= 1  # gradient of the loss by z
            back = p @ out
            out -= lr * 0.1 * np.outer(p, hidden)
            bias -= lr * 0.01 * p
            # a share's gradient is spread over all features of the document; scaled to its largest
            vectors[cells] = rows - (lr * np.sqrt(share))[:, None] * back
    lean = out[1] - out[0]
    return {"value": (vectors @ lean).astype(np.float64), "bias": float(bias[1] - bias[0])}


class Scorer:
    """Scores of whole texts; the sum of values and number of features of each word that is not long are kept."""

    def __init__(self, model: dict):
        self.value, self.bias, self.words, self.old = model["value"], model["bias"], {}, {}

    def _long(self, word: str) -> tuple[float, int]:
        parts = [(float(self.value[cells].sum()), len(cells)) for cells in long_word_cells(word)]
        return math.fsum(v for v, _ in parts), sum(n for _, n in parts)

    def _keep(self, words: set) -> None:
        """Look up those of ``words`` that are not long."""
        if len(self.words) > CACHE:
            self.old, self.words = self.words, {}
        new = []
        for w in words.difference(self.words):
            if w in self.old:
                self.words[w] = self.old[w]
            elif len(w) <= LONG:
                new.append(w)
        for lo in range(0, len(new), TOGETHER):
            some = new[lo : lo + TOGETHER]
            self.words.update(zip(some, zip(*(x.tolist() for x in word_sums(some, self.value)))))

    def _score(self, words: list[str]) -> float:
        import operator

        z = 0.0
        if words:
            long = {w: self._long(w) for w in set(words).difference(self.words)}
            if long:
                values, sizes = zip(*(long[w] if w in long else self.words[w] for w in words))
            else:
                values, sizes = zip(*map(self.words.__getitem__, words))
            same = sum(map(operator.eq, words, words[1:]))
            z = (math.fsum(values) + same * float(self.value[_REPEAT])) / (sum(sizes) + same)
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, z + self.bias))))

    def scores(self, texts) -> Iterator[float]:
        held, size = [], 0
        for text in texts:
            if held and size + len(text or "") > SLICE:
                yield from self._scored(held)
                held, size = [], 0
            held.append(text.split() if text else [])
            size += len(text or "")
        yield from self._scored(held)

    def _scored(self, lists: list) -> list[float]:
        self._keep(set().union(*lists))
        return [self._score(words) for words in lists]

    def score(self, text: str | None) -> float:
        return next(self.scores([text]))


def fit(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str, text_col: str, label_col: str, sample: int = SAMPLE, sample_chars: int = SAMPLE_CHARS) -> dict:
    """Train on at most ``sample`` labelled rows; the ids are chosen before any text is read."""
    y, key = F.col(f"`{label_col}`"), F.col(f"`{id_col}`")
    ids = labels.where(y.isNotNull() & key.isNotNull()).select(key.alias("_i"), y.alias("_v")).where(usable).groupBy("_i").agg(F.max("_v").cast("int").alias("_y"))
    ids = ids.join(docs.select(key.alias("_i")).distinct(), "_i", "left_semi").orderBy(F.xxhash64("_i"), "_i").limit(sample)
    texts = docs.select(key.alias("_i"), F.col(f"`{text_col}`").cast("string").alias("_t")).where(F.coalesce(F.length("_t"), F.lit(0)) <= sample_chars)
    rows = texts.join(F.broadcast(ids), "_i").groupBy("_i").agg(F.first("_y").alias("_y"), F.min("_t").alias("_t"))  # at most ``sample`` ids

    def learn(batches):
        import pyarrow as pa

        held = sorted((row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns))), key=lambda row: row[0])
        model = train([t for _, _, t in held], [y for _, y, _ in held])
        yield pa.RecordBatch.from_arrays([pa.array([model["value"].astype("<f8").tobytes()]), pa.array([model["bias"]])], names=["value", "bias"])

    import numpy as np

    found = rows.select("_i", "_y", "_t").coalesce(1).mapInArrow(tidy(learn), "value binary, bias double").first()  # one task trains
    if found is None:
        return train([], [])
    return {"value": np.frombuffer(found["value"], "<f8"), "bias": found["bias"]}


def score_documents(docs: DataFrame, model: dict, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with the score, 0 to 1, of each whole text."""
    if score_col in docs.columns:
        raise ValueError(f"the column {score_col} is taken")
    bound_batches(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # CELLS numbers

    def work(batches):
        own = Scorer(shared.value)
        for texts in batches:
            yield pd.Series([*own.scores(texts)], dtype="float64")

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from tidy(work)(batches)

    return docs.withColumn(score_col, score(F.col(f"`{text_col}`").cast("string")))


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(f"`{id_col}`").cast("string")), F.lit(5)) == 0, F.lit(False))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", cutoff: float = 0.3, sample: int = SAMPLE, sample_chars: int = SAMPLE_CHARS) -> DataFrame:
    """``docs`` with held_out, score and predicted; fitted on at most ``sample`` labelled rows that are not held out."""
    taken = {"held_out", "score", "predicted"} & set(docs.columns)
    if taken:
        raise ValueError(f"columns are taken: {sorted(taken)}")
    model = fit(docs, labels, ~held_out("_i"), id_col, text_col, label_col, sample, sample_chars)
    scored = score_documents(docs, model, text_col)
    return scored.withColumns({"held_out": held_out(id_col), "predicted": (F.col("score") >= cutoff).cast("int")})
