"""Result bags as plain lists of (doc, score), ordered by doc: what the Spark operators are held against."""

from collections import defaultdict
from math import inf, isnan, nan


def groups(bag):
    by = defaultdict(list)
    for doc, score in bag:
        by[doc].append(score)
    return by


def flat(by):
    return [(d, s) for d in sorted(by) for s in by[d]]


def union(a, b):
    ga, gb = groups(a), groups(b)
    return flat({d: gb.get(d, []) + ga.get(d, [])[len(gb.get(d, [])) :] for d in {*ga, *gb}})


def intersect(a, b):
    docs = {d for d, _ in b}
    return [x for x in a if x[0] in docs]


def subtract(a, b):
    docs = {d for d, _ in b}
    return [x for x in a if x[0] not in docs]


def join(a, b, test):
    gb = groups(b)
    return flat({d: [x for x, y in zip(xs, gb.get(d, [])) if test(x, y)] for d, xs in groups(a).items()})


def order_by(a, b):
    gb = groups(b)
    return flat({d: [gb[d][i] if i < len(gb.get(d, [])) else -inf for i in range(len(xs))] for d, xs in groups(a).items()})


def fold(a, pick):
    return [(d, pick([s for s in xs if not isnan(s)] or [nan])) for d, xs in sorted(groups(a).items())]
