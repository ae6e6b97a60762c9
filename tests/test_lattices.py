"""Aligned lattices against all pairs of paths, and expanded grammars of subgraphs against substituted strings."""

import random

import pytest

ARCS = "part int, src long, dst long, label string"


def lattice(r, n):
    arcs = [(k, k + 1, r.choice(["a", "b", "c", None])) for k in range(n)]
    arcs += [(i, j, r.choice(["a", "b", "c"])) for i in range(n) for j in range(i + 1, n + 1) if r.random() < 0.3]
    return arcs


def strings(arcs, start, end):
    out, todo = set(), [(start, ())]
    while todo:
        node, seen = todo.pop()
        if node == end:
            out.add(seen)
        todo += [(d, seen + (x,) * (x is not None)) for s, d, x in arcs if s == node]
    return out


def distance(x, y, sub, gap):
    row = [gap * j for j in range(len(y) + 1)]
    for a in x:
        new = [row[0] + gap]
        for j, b in enumerate(y):
            new.append(min(row[j] + (0 if a == b else sub), row[j + 1] + gap, new[j] + gap))
        row = new
    return row[-1]


@pytest.mark.parametrize("sub,gap", [(1.0, 1.0), (1.5, 0.7)])
def test_aligned_lattices(spark, sub, gap):
    from framelake.graphs.alignment import align_lattices

    r = random.Random(11)
    pairs = {p: (lattice(r, r.randint(1, 5)), lattice(r, r.randint(1, 5))) for p in range(8)}
    a = [(p, *x) for p, (u, _) in pairs.items() for x in u] + [(20, 0, 1, "a")]
    b = [(p, *x) for p, (_, v) in pairs.items() for x in v] + [(20, 0, 1, "a")]
    last = lambda arcs: max(d for _, d, _ in arcs)
    ends = [(p, 0, last(u), 0, last(v)) for p, (u, v) in pairs.items()] + [(20, 0, 7, 0, 1), (21, 3, 3, 4, 4)]  # no path; nothing to align
    costs, steps = align_lattices(spark.createDataFrame(a, ARCS), spark.createDataFrame(b, ARCS), spark.createDataFrame(ends, "part int, a_start long, a_end long, b_start long, b_end long"), ["part"], sub, gap)
    got = {x["part"]: x["cost"] for x in costs.collect()}
    way = {}
    for x in steps.orderBy("part", "step").collect():
        way.setdefault(x["part"], []).append((x["a"], x["b"]))
    assert set(got) == {*pairs, 21} and got[21] == 0 and 21 not in way
    for p, (u, v) in pairs.items():
        s, t = strings(u, 0, last(u)), strings(v, 0, last(v))
        assert got[p] == pytest.approx(min(distance(x, y, sub, gap) for x in s for y in t))
        path = way.get(p, [])
        x, y = tuple(a for a, _ in path if a is not None), tuple(b for _, b in path if b is not None)
        assert x in s and y in t  # a path of each
        assert got[p] == pytest.approx(sum(gap if a is None or b is None else sub * (a != b) for a, b in path))


GRAMMAR = [("S", 0, 1, "the"), ("S", 1, 2, "NOUN"), ("S", 2, 3, "VERB"), ("S", 3, 4, "NP"), ("S", 2, 4, "sleeps"), ("NP", 7, 8, "a"), ("NP", 8, 9, "NOUN"), ("NOUN", 0, 1, "dog"), ("NOUN", 0, 1, "cat"), ("NOUN", 0, 5, "big"), ("NOUN", 5, 1, "dog"), ("VERB", 1, 2, "sees"), ("UNUSED", 0, 1, "x")]
ENDS = [("S", 0, 4), ("NP", 7, 9), ("NOUN", 0, 1), ("VERB", 1, 2), ("UNUSED", 0, 1)]


def test_expanded_grammar(spark):
    from framelake.graphs.expansion import expanded

    arcs, ends = spark.createDataFrame(GRAMMAR, "graph string, src long, dst long, label string"), spark.createDataFrame(ENDS, "graph string, start long, end long")
    whole, start, end = expanded(arcs, ends, "S")
    rows = [tuple(x) for x in whole.collect()]
    nouns = ["dog", "cat", "big dog"]
    want = {f"the {n} sleeps" for n in nouns} | {f"the {n} sees a {m}" for n in nouns for m in nouns}
    assert {" ".join(s) for s in strings(rows, start, end)} == want
    assert not {x for _, _, x in rows} & {"NOUN", "VERB", "NP"}
    nodes = {n for s, d, _ in rows for n in (s, d)}
    assert nodes == set(range(len(nodes)))  # ranges follow each other without gaps
    plain, s, e = expanded(arcs, ends, "VERB")
    assert [tuple(x) for x in plain.collect()] == [(0, 1, "sees")] and (s, e) == (0, 1)


def test_recursion_raises(spark):
    from framelake.graphs.expansion import expanded

    ends = spark.createDataFrame(ENDS, "graph string, start long, end long")
    for more in ([("NOUN", 1, 5, "NOUN")], [("VERB", 2, 3, "NP"), ("NP", 9, 9, "VERB")]):
        arcs = spark.createDataFrame(GRAMMAR + more, "graph string, src long, dst long, label string")
        with pytest.raises(ValueError, match="holds itself"):
            expanded(arcs, ends, "S")
    arcs = spark.createDataFrame(GRAMMAR, "graph string, src long, dst long, label string")
    with pytest.raises(ValueError, match="no ends"):
        expanded(arcs, ends, "Q")
    with pytest.raises(ValueError, match="two pairs"):
        expanded(arcs, ends.unionByName(ends.limit(1)), "S")
