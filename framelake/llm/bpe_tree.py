"""BPE encoding and decoding of whole texts by tree concatenation.

A text is halved down to leaves of at most ``LEAF`` characters, wherever the
halves fall, and all leaves of a batch are encoded together.  On the way up
neighbours are joined: a window of text around the join, from white space to
white space, is encoded as a whole and in its two sides, and grows until its
first and last tokens are those of its sides and the sides are what both
neighbours end and begin with.  No pre-token reaches across white space and no
normalisation does, so the joined ids are those of the whole text.

Text without white space for more than ``RUN`` characters is pre-tokenised as
a whole.  Its pre-tokens of more than ``LEAF`` symbols go through the same tree
on symbols: there a window is the surface of tokens and grows until its first
and last tokens are those that both sides already had there, as a BPE sequence
is right if each adjacent pair of its tokens is.

Leaves and windows of Latin letters, numbers and marks are encoded by ranks of
byte strings (``WordRanks``), all others by the library that the file is for.

Defined cases: null and empty texts have no ids; repeated rows, equal ids and
null ids give a row each; an empty table gives an empty one; columns other than
the id and the text are not read, whatever their names; a text of any length
is encoded whole, in memory of a small multiple of its size.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ._common import bound_batches

LEAF, RUN = 1024, 256
#: Characters on each side of a join that its first window takes.
REACH = 16
#: Rows, and about as many characters, that are encoded together.
ROWS, CHARS = 256, 1 << 20
ENCODED = "doc_id long, ids array<int>, decoded string"
_loaded: dict[str, "TreeBPE"] = {}


def _byte_letters() -> dict[int, str]:
    """The byte alphabet of byte-level BPE: printable bytes stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in plain)}


class WordRanks:
    """Encodes text of characters below U+0300 by ranks of byte strings.

    Every pre-token is written with one space behind it, which stands for the
    suffix of the last token of a word; ids are in the order of the merges, so
    they serve as ranks.  Below U+0300 nothing is composed, and lower-casing
    does not depend on what is around a letter.
    """

    MARK = "\x01"  # between texts encoded together; not in the texts themselves

    def __init__(self, spec: dict, suffix: str):
        import tiktoken

        back = {c: b for b, c in _byte_letters().items()}
        ranks = {}
        for token, i in spec["model"]["vocab"].items():
            ends = token.endswith(suffix)
            ranks[bytes(back[c] for c in (token[: -len(suffix)] if ends else token)) + b" " * ends] = i
        self.core = tiktoken.Encoding("words", pat_str="[^ ]+ ", mergeable_ranks=ranks, special_tokens={})
        self.mark = ranks[self.MARK.encode() + b" "]
        blank = [c for c in map(chr, range(0x300)) if c in "\t\n\x0b\x0c\r \x85\xa0"]
        usual = [c for c in map(chr, range(0x300)) if c not in blank and unicodedata.category(c) != "Cc" and len(c.lower()) == 1]
        of = lambda chars: "[" + "".join(map(re.escape, chars)) + "]"
        number = [c for c in usual if unicodedata.category(c)[0] == "N"]
        other = [c for c in usual if unicodedata.category(c)[0] not in "NL"]
        self._odd = re.compile("[^" + of(usual + blank)[1:])
        self._blank = re.compile(of([c for c in blank if c != " "]))
        self._apart = re.compile(self.MARK + "|'(?:s|t|re|ve|m|ll|d)|" + of(other) + "+|" + of(number))  # fixed value: the file's pre-token rule

    def fits(self, text: str) -> bool:
        return not self._odd.search(text)

    def encode(self, texts: list[str]) -> list:
        """Ids of each text."""
        import numpy as np

        spaced = self._apart.sub(r" \g<0> ", self._blank.sub(" ", self.MARK.join(texts).lower())) + " "
        ids = self.core.encode_to_numpy(spaced)
        at = np.flatnonzero(ids == self.mark)
        return [ids[a:b] for a, b in zip([0, *(at + 1).tolist()], [*at.tolist(), len(ids)])]


class TreeBPE:
    def __init__(self, path: str, leaf: int = LEAF, run: int = RUN):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tok, self.leaf, self.run = Tokenizer.from_file(path), leaf, run
        self.tok.no_truncation()
        self.tok.no_padding()
        self.suffix = spec["model"].get("end_of_word_suffix") or ""
        bare = spec | {"added_tokens": [], "normalizer": None, "pre_tokenizer": None, "post_processor": None, "truncation": None, "padding": None}
        self.last = Tokenizer.from_str(json.dumps(bare))
        self.inner = Tokenizer.from_str(json.dumps(bare | {"model": spec["model"] | {"end_of_word_suffix": None}}))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.names = {i: t for t, i in spec["model"]["vocab"].items()} | {i: t for t, i in self.special.items()}
        #: without a decoder the library joins token strings with spaces
        self.plain_decode = spec.get("decoder") is None
        #: white space ends pre-tokens and is in none
        self.drops_space = (spec.get("pre_tokenizer") or {}).get("type") == "Sequence"
        self.ranks = WordRanks(spec, self.suffix) if self.drops_space and self.suffix else None
        #: joins of texts and of symbols, and windows that had to grow
        self.joins, self.symbol_joins, self.grown = 0, 0, 0

    # -- unsplit text, on symbols ------------------------------------------
    def _join_symbols(self, left: list[int], right: list[int], final: bool) -> list[int]:
        """final: ``right`` ends the pre-token and so carries the suffix."""
        surface = lambda ids, strip: "".join(map(self.names.__getitem__, ids))[: -len(self.suffix) if strip and self.suffix else None]
        self.symbol_joins += 1
        w = 4
        while True:
            a, b = left[-w:], right[:w]
            closes = final and w >= len(right)
            text = surface(a, False) + surface(b, closes)
            mid = (self.last if closes else self.inner).encode(text, add_special_tokens=False).ids
            if (w >= len(left) or mid[0] == a[0]) and (w >= len(right) or mid[-1] == b[-1]):
                return left[:-w] + mid + right[w:]
            w *= 2

    def long(self, symbols: str) -> list[int]:
        """Ids of one pre-token, given as its symbols."""
        n, step = len(symbols), self.leaf
        leaves = [symbols[i : i + step] for i in range(0, n, step)]
        ids = [e.ids for e in self.inner.encode_batch(leaves[:-1], add_special_tokens=False)] + [self.last.encode(leaves[-1], add_special_tokens=False).ids]
        while len(ids) > 1:
            pairs = [self._join_symbols(ids[i], ids[i + 1], i + 2 >= len(ids)) for i in range(0, len(ids) - 1, 2)]
            ids = pairs + ids[len(pairs) * 2 :]
        return ids[0]

    def unsplit(self, part: str) -> list[int]:
        """Ids of text that its white space leaves in long runs."""
        text = self.tok.normalizer.normalize_str(part) if self.tok.normalizer else part
        out, short = [], []
        for symbols, _ in self.tok.pre_tokenizer.pre_tokenize_str(text):
            if len(symbols) > self.leaf:
                out += self._short(short) + self.long(symbols)
                short = []
            else:
                short.append(symbols)
        return out + self._short(short)

    def _short(self, symbols: list[str]) -> list[int]:
        return [i for e in self.last.encode_batch(symbols, add_special_tokens=False) for i in e.ids] if symbols else []

    # -- other text -----------------------------------------------------------
    def _pieces(self, texts: list[str], plain: bool) -> list:
        """Ids of leaves or windows, encoded together."""
        import numpy as np

        if plain:
            return self.ranks.encode(texts) if texts else []
        return [np.array(e.ids, np.uint32) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, todo: list, plain: bool) -> list:
        """Ids of each (text, start, middle, stop, left ids, right ids)."""
        import numpy as np

        out, open_, reach = [None] * len(todo), list(range(len(todo))), REACH
        self.joins += len(todo)
        while open_:
            windows, strings = [], []
            for k in open_:
                text, start, mid, stop, _, _ = todo[k]
                a = max(text.rfind(" ", start, max(start, mid - reach)), start)
                b = text.find(" ", min(stop, mid + reach), stop)
                b = b if b >= 0 else stop
                windows.append((a, b))
                strings += [text[a:mid], text[mid:b], text[a:b]]
            ids, again = self._pieces(strings, plain), []
            for n, (k, (a, b)) in enumerate(zip(open_, windows)):
                _, start, _, stop, left, right = todo[k]
                x, y, z = ids[3 * n : 3 * n + 3]
                sides = np.array_equal(left[len(left) - len(x) :], x) and np.array_equal(right[: len(y)], y)
                first = a == start or (len(x) and len(z) and x[0] == z[0])
                final = b == stop or (len(y) and len(z) and y[-1] == z[-1])
                if sides and first and final:
                    out[k] = np.concatenate([left[: len(left) - len(x)], z, right[len(y) :]])
                elif a == start and b == stop:  # the window is all of both
                    out[k] = z
                else:
                    again.append(k)
            self.grown += len(again)
            open_, reach = again, 2 * reach
        return out

    def _trees(self, texts: list[str], plain: bool) -> list:
        """Ids of texts whose white space leaves no long runs."""
        bounds = []
        for t in texts:
            depth = (max(1, -(-len(t) // self.leaf)) - 1).bit_length()
            bounds.append([len(t) * i >> depth for i in range((1 << depth) + 1)])
        leaves = iter(self._pieces([t[a:b] for t, at in zip(texts, bounds) for a, b in zip(at, at[1:])], plain))
        nodes = [[next(leaves) for _ in at[1:]] for at in bounds]
        while wide := [k for k, x in enumerate(nodes) if len(x) > 1]:
            todo = [(texts[k], bounds[k][i], bounds[k][i + 1], bounds[k][i + 2], *nodes[k][i : i + 2]) for k in wide for i in range(0, len(nodes[k]), 2)]
            found = iter(self._joined(todo, plain))
            for k in wide:
                nodes[k], bounds[k] = [next(found) for _ in nodes[k][::2]], bounds[k][::2]
        return [x[0] for x in nodes]

    def _split(self, text: str) -> list[tuple[bool, str]]:
        """(whether it is unsplit, part): parts that meet at spaces or line breaks."""
        if max(map(len, text.replace("\n", " ").split(" "))) <= self.run:
            return [(False, text)]
        long = re.compile(r"[^ \n]{%d,}" % (self.run + 1))
        out, at = [], 0
        for m in long.finditer(text):
            out += [(False, text[at : m.start()]), (True, m.group())]
            at = m.end()
        return [(kind, part) for kind, part in [*out, (False, text[at:])] if part]

    def encode_all(self, texts: list) -> list:
        """Ids of each whole text."""
        import numpy as np

        if not self.drops_space:  # white space belongs to tokens here
            return [np.array(e.ids, np.uint32) for e in self.tok.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
        parts, groups = [], {True: [], False: []}  # (text, ids or None)
        for k, text in enumerate(texts):
            marked = self._cut.split(text) if text and self._cut is not None and any(s in text for s in self.special) else [text]
            for piece in filter(None, marked):
                if piece in self.special:
                    parts.append((k, np.array([self.special[piece]], np.uint32)))
                    continue
                for long, part in self._split(piece):
                    if long:
                        parts.append((k, np.array(self.unsplit(part), np.uint32)))
                    else:
                        groups[self.ranks is not None and self.ranks.fits(part)].append((len(parts), part))
                        parts.append((k, None))
        for plain, some in groups.items():
            for (at, _), ids in zip(some, self._trees([part for _, part in some], plain) if some else ()):
                parts[at] = (parts[at][0], ids)
        out = [[] for _ in texts]
        for k, ids in parts:
            out[k].append(ids)
        return [np.concatenate(x) if len(x) > 1 else x[0] if x else np.zeros(0, np.uint32) for x in out]

    def encode(self, text: str | None):
        return self.encode_all([text])[0]

    def decode(self, ids) -> str:
        if self.plain_decode:
            return " ".join(map(self.names.__getitem__, ids.tolist()))
        return self.tok.decode(ids.tolist(), skip_special_tokens=False)


def load(path: str) -> TreeBPE:
    """One instance a worker process."""
    if path not in _loaded:
        _loaded[path] = TreeBPE(path)
    return _loaded[path]


def _map(docs: DataFrame, tokenizer: str, id_col: str, text_col: str, schema: str, row) -> DataFrame:
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("d"), F.col(f"`{text_col}`").cast("string").alias("t"))
    kind = to_arrow_schema(StructType.fromDDL(schema))
    bound_batches(docs)

    def work(batches):
        import pyarrow as pa

        bpe = load(tokenizer)

        def done(ids, texts):
            found = [row(d, x, bpe.decode(x)) for d, x in zip(ids, bpe.encode_all(texts))]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), kind)], schema=kind)

        for batch in batches:
            ids, texts, size = [], [], 0
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                t = t.as_py()
                if texts and (len(texts) == ROWS or size + len(t or "") > CHARS):
                    yield done(ids, texts)
                    ids, texts, size = [], [], 0
                ids.append(d)
                texts.append(t)
                size += len(t or "")
            if texts:
                yield done(ids, texts)

    return rows.mapInArrow(work, schema)


def encode_decode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded) of every whole text."""
    return _map(docs, tokenizer, id_col, text_col, ENCODED, lambda d, ids, said: (d, ids, said))


def encode_digests(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As encode_decode, with digests in place of ids and texts, which then never leave the worker."""
    sha = lambda b: hashlib.sha256(b).hexdigest()
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return _map(docs, tokenizer, id_col, text_col, schema, lambda d, ids, said: (d, len(ids), sha(ids.astype("<u4").tobytes()), sha(said.encode("utf-8", "surrogatepass"))))
