"""Ranked search against plain scoring of every document."""

import math
import random
import re

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k):
    found = [(d, terms(t)) for d, t in docs]
    n_docs, total = sum(bool(x) for _, x in found), sum(len(x) for _, x in found)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    df = {}
    for _, x in found:
        for t in set(x):
            df[t] = df.get(t, 0) + 1
    out = []
    for i, words in asked.items():
        scored = []
        for d, x in found:
            if d is None or not x:
                continue
            m = 50 + 50 * len(x) * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * x.count(t) // (1000 * x.count(t) + 20 * m)) for t in words if t in x)
            if s > 0:
                scored.append((-s, d))
        out += [(i, rank, d, -s) for rank, (s, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def corpus(n=400, seed=11):
    r = random.Random(seed)
    topics = [[f"{c}{i}" for i in range(40)] for c in ("alpha", "Beta", "gämma", "дельта")]
    common = ["the", "of", "and", "The", "42"]
    docs = []
    for i in range(n):
        own = r.choice(topics)
        docs.append((i * 7 % 1009, r.choice([" ", ", ", "-", "\n"]).join(r.choice(common) if r.random() < 0.3 else r.choice(own) for _ in range(r.randint(1, 60)))))
    docs += [(2000 + i, docs[5][1]) for i in range(70)]  # ties
    docs += [(3000, None), (3001, ""), (3002, " .,-"), (None, docs[7][1]), (docs[8][0], docs[9][1]), (-5, docs[5][1]), (3003, "the " * 20_000)]
    items = [(j, " ".join(r.choice(own) for own in r.sample(topics, 2) for _ in range(4)) + " the THE") for j in range(12)]
    items += [(50, docs[5][1]), (51, None), (52, ""), (53, "nowhere at all"), (54, "the"), (None, "alpha1 of"), (55, "alpha1"), (55, "beta2 Beta3"), (56, docs[3][1] * 3)]
    return docs, items


@pytest.mark.parametrize("leaf,local,block", [(512, 1 << 16, 10**6), (16, 40, 10**6), (8, 100, 30)])
def test_search_equals_scoring_all(spark, monkeypatch, leaf, local, block):
    """In one cluster, after upper levels in small clusters, and in blocks of items."""
    from pyspark.sql import functions as F

    from framelake.llm import ranked_search as s

    for name, value in (("LEAF", leaf), ("LOCAL", local), ("TERMS", block), ("FIRST", 2)):
        monkeypatch.setattr(s, name, value)
    docs, items = corpus()
    clash = {k: F.lit("x") for k in ("d", "t", "q", "n", "rank", "score", "item", "term", "cluster")}
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(5).withColumns(clash)
    i = spark.createDataFrame(items, "item_id long, text string").withColumns(clash)
    got = s.rank_documents(d, i, k=20)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == plain(docs, items, 20)


def test_empty_tables(spark):
    from framelake.llm.ranked_search import rank_documents

    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a c")], "item_id long, text string")
    assert [tuple(r) for r in rank_documents(docs, items).collect()] == plain([(1, "a b")], [(1, "a c")], 50)
    assert rank_documents(docs.limit(0), items).count() == 0
    assert rank_documents(docs, items.limit(0)).count() == 0


def test_bisection_brings_documents_of_a_topic_together():
    from framelake.llm.ranked_search import bisect

    r = np.random.default_rng(4)
    topic = r.permutation(np.repeat(np.arange(8), 64))
    size = r.integers(5, 20, len(topic))
    words = [np.unique(np.concatenate([t * 100 + r.integers(0, 60, n), [9000]])) for t, n in zip(topic, size)]
    size = np.array([len(w) for w in words])
    order, starts = bisect(np.cumsum(size) - size, size, np.concatenate(words), leaf=64)
    assert sorted(order.tolist()) == list(range(512)) and starts == list(range(0, 512, 64))
    shares = [np.bincount(topic[order[s : s + 64]]).max() / 64 for s in starts]
    assert np.mean(shares) > 0.9


def test_bisection_holds_few_bytes_a_term():
    """Gains are worked out in slices; terms are not sorted."""
    import tracemalloc

    from framelake.llm.ranked_search import bisect

    r = np.random.default_rng(5)
    size = np.full(4096, 256)
    terms = np.concatenate([np.sort(r.choice(4000, 256, replace=False)) for _ in size]).astype(np.uint32)
    tracemalloc.start()
    order, starts = bisect(np.cumsum(size) - size, size, terms)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted(order.tolist()) == list(range(4096)) and len(starts) == 8
    assert peak < 24 * len(terms)


def test_documents_of_many_terms_are_dealt_to_several_tasks(spark, monkeypatch):
    from framelake.llm import ranked_search as s

    docs, items = corpus()
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    made = []
    monkeypatch.setattr(s, "write_stage", lambda df, name, f=s.write_stage: made.append((name, f(df, name))) or made[-1][1])
    monkeypatch.setattr(s, "POSTINGS", 1000)
    assert sorted(map(tuple, s.rank_documents(d, i, k=20).collect()), key=str) == plain(docs, items, 20)
    terms = [sum(len(r["docs"]) // 4 for r in df.collect()) / df.count() for name, df in made if name == "clusters"]
    assert len(terms) == 1 and 0 < terms[0] < 2000


def test_gains_are_the_change_of_cost():
    from framelake.llm.ranked_search import _gains

    cost = lambda d, n: d * np.log2(n / (d + 1))
    a, b = np.array([3.0, 2, 0, 9]), np.array([4.0, 0, 2, 1])
    with np.errstate(divide="ignore", invalid="ignore"):
        want = cost(a, 10) + cost(b, 12) - cost(a - 1, 10) - cost(b + 1, 12)
    got = _gains(a, b, 10, 12)
    assert np.allclose(got[a > 0], want[a > 0]) and got[2] == 0


def test_cutoffs_swap_equal_numbers_while_both_gain():
    from framelake.llm.ranked_search import BINS, _cutoffs

    left, right = np.zeros(2 * BINS + 1), np.zeros(2 * BINS + 1)
    for h, values in ((left, [8, 8, 4, -4, -8]), (right, [4, 4, 2, -8, -8])):
        for v in values:
            h[v + BINS] += 1
    assert _cutoffs(left, right) == (1.0, 0.5)  # three of each; the fourth pair would lose
    assert _cutoffs(left * 0, right) == (np.inf, np.inf)


def test_clusters_are_passed_over(spark):
    """An item of one topic visits the clusters of that topic; others have lower bounds than its cutoff."""
    from framelake.llm.ranked_search import Asked

    own = Asked([{0: 5, 2: 7}, {1: 3}], 3)
    bound, at = own.bounds(np.array([0, 1], np.uint32), np.array([10, 20], np.uint32))
    assert bound.tolist() == [50, 60] and at.tolist() == [0, -1, 1]
    starts, docs, impacts = np.array([0, 2, 3]), np.array([0, 2, 1]), np.array([10, 4, 20])
    assert own.scores(0, at, starts, docs, impacts, 3).tolist() == [50, 0, 20]
    assert own.scores(1, at, starts, docs, impacts, 3).tolist() == [0, 60, 0]
