"""Whole-text byte-level BPE with a bounded cache of word units.

A text is cut before every single space that stands between two characters
that are not white space; the pre-tokeniser's pattern never matches across such
a place, so ids of the parts joined are the ids of the text.  Most parts recur,
and a part's ids are looked up instead of merged again.
"""

from __future__ import annotations

import json
import re

_SAFE = re.compile(r"(?<=\S) (?=\S)")
_UNSAFE = re.compile(r"\s\s|\s\Z")
#: Parts in each of the two generations a worker keeps; when the young one is full, the old one goes.
CACHE = 300_000
#: Longer parts go to the library's heap-based merge.
LONG = 256
_loaded: dict[str, "ByteBPE"] = {}


class ByteBPE:
    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        vocab, model = spec["model"]["vocab"], spec["model"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        if self.size > 1 << 16:
            raise ValueError("more than 65536 ids")
        self._cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        # the byte alphabet of byte-level BPE: printable bytes stand for themselves, the others follow from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        back = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        ranks = {bytes(back[c] for c in t): i for t, i in vocab.items() if t not in self.special}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        in_order = all(vocab["".join(m)] == 256 + i for i, m in enumerate(merges))
        if not in_order or model.get("end_of_word_suffix") or spec.get("normalizer"):
            raise ValueError("not a plain byte-level BPE file with ids in merge order")
        self.surface = {i: t for t, i in ranks.items()}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed value: the file's ByteLevel rule
        self.fast = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.forget()
        import numpy as np

        self.opens = np.zeros(1 << 16, bool)  # ids whose token begins with a space
        self.opens[[i for i, t in self.surface.items() if t[:1] == b" "]] = True

    def forget(self) -> None:
        """Empty the cache, which a task fills anew in about the time that it would save."""
        self.old: dict[str, bytes] = {}
        self.units: dict[str, bytes] = {}  # part after a space -> ids, 16 bits each

    def piece(self, part: str) -> bytes:
        import numpy as np

        if len(part) > LONG:
            return np.array(self.tok.encode(part, add_special_tokens=False).ids, "<u2").tobytes()
        return np.array(self.fast.encode_ordinary(part), "<u2").tobytes()

    def _plain(self, text: str) -> bytes:
        if not text:
            return b""
        head, *units = text.split(" ")
        new = set(units).difference(self.units)
        if new:
            if len(self.units) + len(new) > CACHE:
                self.old, self.units = self.units, {}
                new = set(units)
            again = new & self.old.keys()
            self.units.update(zip(again, map(self.old.__getitem__, again)))
            new = list(new - again)
        if new and not self._learn(new) or not head or head[0].isspace() or head[-1].isspace():
            parts = _SAFE.split(text)
            return b"".join([self.piece(parts[0]), *(self.piece(" " + p) for p in parts[1:])])
        return self.piece(head) + b"".join(map(self.units.__getitem__, units))

    def _learn(self, new: list[str]) -> bool:
        """Encode parts together; False if some part has white space at an end."""
        import numpy as np

        text = " " + " ".join(new)
        if _UNSAFE.search(text):
            return False
        if len(max(new, key=len)) > LONG:
            for u in new:
                self.units[u] = self.piece(" " + u)
            return True
        ids = self.fast.encode_to_numpy(text)
        at = np.flatnonzero(self.opens[ids]).tolist()
        if len(at) != len(new):
            return False
        blob = ids.astype("<u2").tobytes()
        at = [2 * x for x in at]
        self.units.update(zip(new, map(blob.__getitem__, map(slice, at, [*at[1:], len(blob)]))))
        return True

    def encode(self, text: str | None) -> bytes:
        """Ids of the whole text, as the library gives them without added special tokens."""
        import numpy as np

        if not text:
            return b""
        if self._cut is None or not any(s in text for s in self.special):
            return self._plain(text)
        return b"".join(np.array([self.special[p]], "<u2").tobytes() if p in self.special else self._plain(p) for p in self._cut.split(text))


def load(path: str) -> ByteBPE:
    """One instance a worker process."""
    if path not in _loaded:
        _loaded[path] = ByteBPE(path)
    return _loaded[path]
