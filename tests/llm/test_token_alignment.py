"""The alignment of two tokenizers against both libraries on whole texts and all token pairs."""

import hashlib
import random
import re
from collections import Counter

import pytest

P = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string"


def tokens(texts):
    import json

    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    vocab = json.load(open(P.path("byte_bpe_50k.json"), encoding="utf-8"))["model"]["vocab"]
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(x): x for x in plain} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in plain)}
    entry = {i: bytes(back[c] for c in t) for t, i in vocab.items() if all(c in back for c in t)}
    out = []
    for t in texts:
        if not t:
            out.append(None)
            continue
        x = [(i, entry[i]) for i in a.encode(" " + t, add_special_tokens=False).ids]
        y = [(i, bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p := b.id_to_piece(i)) else p.replace("▁", " ").encode()) for i in b.encode(t)]
        whole = (" " + t).encode()
        out.append((x, y) if b"".join(v for _, v in x) == whole == b"".join(v for _, v in y) else None)
    return out


def spans(x):
    at, out = 0, []
    for i, v in x:
        out.append((i, at, at + len(v)))
        at += len(v)
    return out


def plain(rows):
    """By all token pairs of each document."""
    links, found, held = [], [], Counter()
    for xy in tokens([t for _, t in rows]):
        if xy is None:
            links.append([])
            found.append((0, 0, 0, 0, ""))
            continue
        x, y = map(spans, xy)
        pairs, j = [], 0
        for i, s, e in x:
            while y[j][2] <= s:
                j += 1
            k = j
            while k < len(y) and y[k][1] < e:
                pairs.append((i, y[k][0]))
                k += 1
        ends = sorted({e for _, _, e in x} & {e for _, _, e in y})
        groups, lo = [], 0
        p = q = 0
        for e in ends:
            ga, gb = [], []
            while p < len(x) and x[p][2] <= e:
                ga.append(x[p][0])
                p += 1
            while q < len(y) and y[q][2] <= e:
                gb.append(y[q][0])
                q += 1
            groups.append(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)))
        links.append(pairs)
        held.update(set(pairs))
        found.append((len(x), len(y), len(groups), len(pairs), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    top = Counter()
    for (a, _), n in held.items():
        top[a] = max(top[a], n)
    return [(d, *f[:4], sum(held[p] == top[p[0]] for p in ps), sum(held[p] for p in ps), f[4]) for (d, _), f, ps in zip(rows, found, links)]


def texts():
    r = random.Random(12)
    bits = ["th", "er", "on", "tion", " ", " ", " ", "\n", "  ", "É", "ß", "日本", "é", "🙂", "1", "23", "'s", "n't", ".", ",", "<s>", "<|endoftext|>", "<0x41>", "\t", " ", "　", "\x00", "‍"]
    out = ["".join(r.choice(bits) for _ in range(r.randint(1, 80))) for _ in range(150)]
    out += [" ".join(r.choice(["the", "running", "of", "unbelievable", "Ärger", "naïveté"]) for _ in range(60)) for _ in range(20)]
    out += ["▁", "a▁ b", "a ▁b c", None, "", " ", "  ", "\n", " a", "a ", " a b ", "a  b", "x" * 3000, "日" * 2000, "ab" * 700 + " c", out[3], out[3], "the " * 5000]
    return out


def test_alignment_equals_all_pairs(spark, monkeypatch):
    from pyspark.sql import functions as F

    from framelake.llm import token_alignment as t

    found = texts()
    rows = [(i, x) for i, x in enumerate(found)] + [(None, "no id here"), (3, found[3]), (3, "other")]
    want = sorted(plain(rows), key=str)
    clash = {k: F.lit("x") for k in ("id", "t", "row", "pairs", "times", "n_a", "k", "n", "best")}
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns(clash)
    paths = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
    got = t.align_tokenizers(df, *paths)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == want
    monkeypatch.setattr(t, "HOT", 50)  # most pairs go by the exchange
    assert sorted(map(tuple, t.align_tokenizers(df, *paths).collect()), key=str) == want
    assert t.align_tokenizers(df.limit(0), *paths).count() == 0


def test_stretches_are_forgotten_and_aligned_again(monkeypatch):
    from framelake.llm import token_alignment as t

    monkeypatch.setattr(t, "KEPT", 60)
    monkeypatch.setattr(t, "BYTES", 300)
    own, found = t.Aligner(P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")), texts()
    want = plain(list(enumerate(found)))
    for _ in range(2):
        for at in range(0, len(found), 16):
            sums, digests, who, pair, times = own.documents(found[at : at + 16])
            for k, w in enumerate(want[at : at + 16]):
                assert (*sums[k].tolist(), digests[k]) == (*w[1:5], w[7])
                assert times[who == k].sum() == w[4]
    assert own._together(["two", "words"]) and not own._together(["two words"]) and not own._together([" x", "y"])
    assert len(own.number) < len({u for x in found for u in (x or "").split(" ")}) + 60


def test_an_interval_join_is_no_product():
    """The plan of the links has an ASOF join and no nested loop or cross product."""
    from framelake.llm import token_alignment as t

    own = t.Aligner(P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"))
    kinds = []
    run = own.db.execute

    class Seen:
        def __getattr__(self, name):
            return getattr(own_db, name)

        def execute(self, sql):
            if sql is t.LINKS:
                kinds.append(str(run("EXPLAIN " + sql).fetchall()))
            return run(sql)

    own_db, own.db = own.db, Seen()
    own.documents([" ".join(f"word{i}ing" for i in range(3000))])
    assert "asof join" in kinds[0].lower() and not re.search("nested loop|blockwise|cross product", kinds[0].lower().replace("_", " "))
