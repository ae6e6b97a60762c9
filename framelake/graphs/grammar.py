"""Context-free grammars: nullable symbols, removal of empty productions and left recursion, recognition.

Grammars are model-sized and live on the driver: a dict from a symbol to its alternatives, tuples of symbols.
"""

from __future__ import annotations

from itertools import product

Grammar = dict[str, set[tuple[str, ...]]]


def add_production(g: Grammar, lhs: str, rhs) -> Grammar:
    g.setdefault(lhs, set()).add(tuple(rhs))
    return g


def nullable(g: Grammar) -> set[str]:
    out: set[str] = set()
    while True:
        more = {a for a, alts in g.items() if a not in out and any(all(s in out for s in alt) for alt in alts)}
        if not more:
            return out
        out |= more


def without_empty(g: Grammar, start: str) -> Grammar:
    """An equal grammar without empty productions, except for the start symbol's own."""
    empty = nullable(g)
    out: Grammar = {}
    for a, alts in g.items():
        for alt in alts:
            for kept in product(*(((s,), ()) if s in empty else ((s,),) for s in alt)):
                flat = tuple(s for part in kept for s in part)
                if flat and flat != (a,):
                    add_production(out, a, flat)
    if start in empty:
        add_production(out, start, ())
    return out


def without_left_recursion(g: Grammar) -> Grammar:
    """Direct and indirect left recursion removed by ordering the symbols and substituting."""
    names, out = sorted(g), {a: set(alts) for a, alts in g.items()}
    for i, a in enumerate(names):
        for b in names[:i]:
            out[a] = {new for alt in out[a] for new in ([(*head, *alt[1:]) for head in out[b]] if alt[:1] == (b,) else [alt])}
        rec = {alt[1:] for alt in out[a] if alt[:1] == (a,)} - {()}
        rest = {alt for alt in out[a] if alt[:1] != (a,)}
        if rec:
            tail = f"{a}'"
            out[a] = {(*alt, tail) for alt in rest}
            out[tail] = {(*alt, tail) for alt in rec} | {()}
        else:
            out[a] = rest
    return out


def left_factored(g: Grammar) -> Grammar:
    """Alternatives of a symbol that begin alike share that beginning."""
    out, work = {}, {a: set(alts) for a, alts in g.items()}
    while work:
        a, alts = work.popitem()
        groups: dict = {}
        for alt in alts:
            groups.setdefault(alt[:1], set()).add(alt)
        done: set = set()
        for k, (head, same) in enumerate(sorted(groups.items())):
            if head and len(same) > 1:
                n = 1
                while all(len(s) > n for s in same) and len({s[: n + 1] for s in same}) == 1:
                    n += 1
                tail = f"{a}.{k}"
                done.add((*next(iter(same))[:n], tail))
                work[tail] = {s[n:] for s in same}
            else:
                done |= same
        out[a] = done
    return out


def recognises(g: Grammar, start: str, tokens) -> bool:
    """Whether the grammar derives the tokens, by Earley's sets.

    Positions are finished in order, so what a completion from before looks
    through no longer changes; a symbol that can be empty is passed over where
    it is awaited, which takes the place of its completions within a position.
    """
    tokens, empty = list(tokens), nullable(g)
    sets: list[dict] = [{} for _ in range(len(tokens) + 1)]  # awaited symbol (None: complete) -> items (lhs, alternative, dot, origin)
    todo = [(start, alt, 0, 0) for alt in g.get(start, ())]
    for at, here in enumerate(sets):
        scanned, seen = [], set()
        while todo:
            item = todo.pop()
            if item in seen:
                continue
            seen.add(item)
            lhs, alt, dot, origin = item
            awaited = alt[dot] if dot < len(alt) else None
            here.setdefault(awaited, []).append(item)
            moved = (lhs, alt, dot + 1, origin)
            if awaited is None:
                todo += [(a, b, d + 1, o) for a, b, d, o in sets[origin].get(lhs, ())]
            elif awaited in g:
                todo += [(awaited, b, 0, at) for b in g[awaited]] + [moved] * (awaited in empty)
            elif at < len(tokens) and tokens[at] == awaited:
                scanned.append(moved)
        todo = scanned
    return any(a == start and o == 0 for a, _, _, o in sets[-1].get(None, ()))


def pronunciations(lexicon: dict[str, list[tuple[str, ...]]]) -> Grammar:
    """A lexicon as productions from words to their pronunciations."""
    return {w: set(map(tuple, prons)) for w, prons in lexicon.items()}
