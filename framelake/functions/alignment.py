"""Least-cost edit alignment of sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def edit_path(a, b, cost=None, substring: bool = False):
    """(cost, pairs): cheapest alignment, gaps as None. substring: parts of ``b`` before and behind are free."""
    cost = cost or (lambda x, y: 0 if x == y else 1)
    n, m = len(a), len(b)
    d = [[0] * (m + 1) for _ in range(n + 1)]
    for j in range(1, m + 1):
        d[0][j] = 0 if substring else d[0][j - 1] + cost(None, b[j - 1])
    for i in range(1, n + 1):
        d[i][0] = d[i - 1][0] + cost(a[i - 1], None)
        for j in range(1, m + 1):
            d[i][j] = min(d[i - 1][j - 1] + cost(a[i - 1], b[j - 1]), d[i - 1][j] + cost(a[i - 1], None), d[i][j - 1] + cost(None, b[j - 1]))
    j = min(range(m + 1), key=lambda k: (d[n][k], -k)) if substring else m
    i, total, pairs = n, d[n][j], []
    while i or (j and not substring):
        if i and j and d[i][j] == d[i - 1][j - 1] + cost(a[i - 1], b[j - 1]):
            i, j = i - 1, j - 1
            pairs.append((a[i], b[j]))
        elif i and d[i][j] == d[i - 1][j] + cost(a[i - 1], None):
            i -= 1
            pairs.append((a[i], None))
        else:
            j -= 1
            pairs.append((None, b[j]))
    return total, pairs[::-1]


def best_alignments(a, b, n: int, cost=None):
    """The n cheapest alignments as (cost, pairs), by best-first search over a completed cost table."""
    import heapq

    cost = cost or (lambda x, y: 0 if x == y else 1)
    rest = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a), -1, -1):
        for j in range(len(b), -1, -1):
            ways = []
            if i < len(a) and j < len(b):
                ways.append(cost(a[i], b[j]) + rest[i + 1][j + 1])
            if i < len(a):
                ways.append(cost(a[i], None) + rest[i + 1][j])
            if j < len(b):
                ways.append(cost(None, b[j]) + rest[i][j + 1])
            rest[i][j] = min(ways, default=0)
    heap, out, k = [(rest[0][0], 0, 0, 0, 0, ())], [], 0
    while heap and len(out) < n:
        _, _, spent, i, j, pairs = heapq.heappop(heap)
        if i == len(a) and j == len(b):
            out.append((spent, list(pairs)))
            continue
        for x, y, p, q in ((1, 1, a[i : i + 1], b[j : j + 1]), (1, 0, a[i : i + 1], [None]), (0, 1, [None], b[j : j + 1])):
            if len(p) and len(q) and i + x <= len(a) and j + y <= len(b):
                k += 1
                c = spent + cost(p[0], q[0])
                heapq.heappush(heap, (c + rest[i + x][j + y], k, c, i + x, j + y, (*pairs, (p[0], q[0]))))
    return out


def edit_cost(a: Column, b: Column) -> Column:
    """Cost of aligning two strings, each insertion, deletion and change of a character being 1."""
    return F.levenshtein(a, b)


def edit_cost_of_lists():
    """A UDF for the cost of aligning two arrays of strings, item by item."""

    @F.pandas_udf("int")
    def cost(a, b):
        import pandas as pd

        return pd.Series([edit_path(list(x), list(y))[0] for x, y in zip(a, b)], dtype="int32")

    return cost


def best_alignment_rows(df: DataFrame, keep: list[str], a: str, b: str, n: int) -> DataFrame:
    """(keep, rank, cost, pairs): the n cheapest alignments of two strings by characters, a row each."""
    kinds = dict(df.dtypes)

    def work(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for *key, x, y in pdf[[*keep, a, b]].itertuples(index=False, name=None):
                for rank, (cost, pairs) in enumerate(best_alignments(x or "", y or "", n), 1):
                    out.append((*key, rank, float(cost), [{"a": p, "b": q} for p, q in pairs]))
            yield pd.DataFrame(out, columns=[*keep, "rank", "cost", "pairs"])

    ddl = ", ".join(f"{c} {kinds[c]}" for c in keep)
    return df.select(*keep, a, b).mapInPandas(work, f"{ddl}, rank int, cost double, pairs array<struct<a:string,b:string>>")
