"""Overlap sizes, frequencies, weights, co-occurrence and top-N against brute force."""

import math
import random
from collections import Counter, defaultdict
from itertools import combinations

import pytest

from gristdex.llm.cooccurrence import associated, co_occurrences
from gristdex.llm.distinctive import distinctive_terms, log_entropy
from gristdex.llm.frequency import merge_bitmaps, cardinality, term_bitmaps, term_frequencies
from gristdex.llm.overlap import contained_pairs, overlap_sizes
from gristdex.llm.topn import top_n

NAN, INF = math.nan, math.inf
# Extra columns have names that the operators use themselves.
SCHEMA = "keyword STRING, doc BIGINT, seq INT, score FLOAT, rec INT, name STRING, term STRING, word INT, bits INT, n INT, item INT, rank INT"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y", 2, 3, 4, 5, 6) for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    words = ["", "a", "A", "a ", "é", "漢字", *(f"w{i}" for i in range(12)), None]
    docs = [None, -70, -1, 0, 63, 64, 65, 2**40, *range(100, 130)]
    out = []
    for _ in range(900):
        w = rng.choice(words)
        if rng.random() < 0.3:
            w = "w1"  # a hot keyword
        d = rng.choice(docs)
        if rng.random() < 0.2:
            d = 100  # a hot document
        out.append((w, d, rng.choice([None, 1, 2, 3, 70, 200]), rng.choice([0.0, -0.0, 1.5, -2.0, INF, -INF, NAN, None, 3.25])))
    return out + rng.choices(out, k=200)


@pytest.fixture(scope="module")
def df(spark, rows):
    return table(spark, rows).cache()


def sets_of(rows):
    sets = defaultdict(set)
    for w, d, *_ in rows:
        if w is not None and d is not None:
            sets[w].add(d)
    return sets


def test_overlaps(df, rows):
    sets = sets_of(rows)
    want = {(a, b): (len(sets[a]), len(sets[b]), len(sets[a] & sets[b])) for a, b in combinations(sorted(sets), 2) if sets[a] & sets[b]}
    found = overlap_sizes(df, "keyword", "doc")
    assert {(r["keyword_a"], r["keyword_b"]): (r["size_a"], r["size_b"], r["shared"]) for r in found.collect()} == want
    half = {(r["keyword_a"], r["keyword_b"]) for r in contained_pairs(found).collect()}
    assert half == {k for k, (a, b, c) in want.items() if 2 * c >= min(a, b)}


def test_overlap_counts_are_combined_before_the_shuffle(df):
    plan = overlap_sizes(df, "keyword", "doc")._jdf.queryExecution().toString()
    assert "partial_count" in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_frequencies(df, rows):
    n, docs = Counter(w for w, *_ in rows if w is not None), sets_of(rows)
    every = {d for _, d, *_ in rows if d is not None}
    for rare, common in ((2, 0.2), (20, 0.6)):
        got = {r["term"]: (r["occurrences"], r["docs"], r["use"]) for r in term_frequencies(df, "keyword", "doc", rare, common).collect()}
        use = lambda k: "common" if len(docs[k]) > common * len(every) else "rare" if len(docs[k]) <= rare else "useful"  # noqa: B023, E731
        assert got == {w: (n[w], len(docs[w]), use(w)) for w in n}


def test_bitmaps_of_parts_merge_to_those_of_the_whole(df, rows):
    parts = [term_bitmaps(df.where("doc % 2 = 0"), "keyword", "doc"), term_bitmaps(df.where("doc % 2 <> 0 OR doc IS NULL"), "keyword", "doc")]
    whole = {r["term"]: (r["occurrences"], r["docs"]) for r in cardinality(term_bitmaps(df, "keyword", "doc")).collect()}
    assert {r["term"]: (r["occurrences"], r["docs"]) for r in cardinality(merge_bitmaps(*parts)).collect()} == whole


def weights_of(rows):
    occurrences = {(w, d, s) for w, d, s, _ in rows if w is not None and d is not None}
    tf, total, by = Counter((w, d) for w, d, _ in occurrences), Counter(d for _, d, _ in occurrences), defaultdict(list)
    for (w, _), f in tf.items():
        by[w].append(f)
    n = len(total)
    out = {}
    for (w, d), f in tf.items():
        gf = sum(by[w])
        entropy = -sum(x / gf * math.log(x / gf) for x in by[w])
        out[d, w] = (f, total[d], len(by[w]), n, math.log1p(f) * (min(1, max(0, 1 - entropy / math.log(n))) if n > 1 else 1))
    return out


def test_weights(df, rows):
    want = weights_of(rows)
    found = log_entropy(df, "keyword", "doc", "seq")
    got = {(r["rec"], r["term"]): (r["tf"], r["rec_total"], r["docs"], r["n_docs"], r["weight"]) for r in found.collect()}
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k][:4] == v[:4] and got[k][4] == pytest.approx(v[4], abs=1e-9)
    for share, rare, part in ((0.2, 3, 0.005), (0.05, 20, 0.5)):
        marked = {(r["rec"], r["term"]) for r in distinctive_terms(found, share, rare, part).collect()}
        assert marked == {k for k, (f, t, d, n, _) in want.items() if f >= share * t and (d <= rare or d < part * n)}


def test_weights_of_one_record(spark):
    (r,) = log_entropy(table(spark, [("a", 1, 1, 0.0), ("a", 1, 1, 0.0), ("a", 1, None, 0.0)]), "keyword", "doc", "seq").collect()
    assert (r["tf"], r["global_weight"], r["weight"]) == (2, 1.0, pytest.approx(math.log(3)))


def test_co_occurrence(df, rows):
    sets = sets_of(rows)
    n = len(set().union(*sets.values()))
    for least, share in ((1, 0.0), (5, 0.3)):
        want = {}
        for a, b in combinations(sorted(sets), 2):
            c, na, nb = len(sets[a] & sets[b]), len(sets[a]), len(sets[b])
            if c >= max(least, share * n) and c:
                want[a, b] = (c, na, nb, c * n / (na * nb), (1 - nb / n) / (1 - c / na) if c < na else None)
        found = co_occurrences(df, "keyword", "doc", least, share)
        got = {(r["keyword_a"], r["keyword_b"]): r for r in found.collect()}
        assert got.keys() == want.keys()
        for k, (c, na, nb, lift, conviction) in want.items():
            r = got[k]
            assert (r["together"], r["size_a"], r["size_b"], r["n"]) == (c, na, nb, n)
            assert r["lift"] == pytest.approx(lift) and r["conviction"] == (None if conviction is None else pytest.approx(conviction))
    assert associated(found, 1).count() == sum(v[0] * n >= v[1] * v[2] for v in want.values())


def test_equal_baskets_are_enumerated_once(spark):
    many = table(spark, [(k, d, 1, 0.0) for d in range(500) for k in ("x", "y", "z")])
    rows = {(r["keyword_a"], r["keyword_b"]): r["together"] for r in co_occurrences(many, "keyword", "doc").collect()}
    assert rows == {("x", "y"): 500, ("x", "z"): 500, ("y", "z"): 500}


def test_top_n(df, rows):
    best = {}
    for w, d, _, s in rows:
        if None not in (w, d, s) and not math.isnan(s):
            best[w, d] = max(best.get((w, d), -INF), s)
    by = defaultdict(list)
    for (w, d), s in best.items():
        by[w].append((-s, d))
    for n in (1, 5, 1000):
        want = {(w, d): (i, -s) for w, x in by.items() for i, (s, d) in enumerate(sorted(x)[:n], 1)}
        got = {(r["group_key"], r["item"]): (r["rank"], r["score"]) for r in top_n(df, "keyword", "doc", "score", n).collect()}
        assert got == want


def test_top_n_limits_groups_before_the_shuffle(df):
    plan = top_n(df, "keyword", "doc", "score")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_empty_and_null_tables(spark):
    for rows in ([], [(None, None, None, None)], [(None, 1, 1, 1.0)], [("a", None, 1, 1.0)]):
        t = table(spark, rows)
        assert overlap_sizes(t, "keyword", "doc").count() == log_entropy(t, "keyword", "doc", "seq").count() == 0
        assert co_occurrences(t, "keyword", "doc").count() == co_occurrences(t, "keyword", "doc", 5, 0.1).count() == top_n(t, "keyword", "doc", "score").count() == 0
        assert distinctive_terms(log_entropy(t, "keyword", "doc", "seq")).count() == 0
        found = term_frequencies(t, "keyword", "doc").collect()
        assert [tuple(r) for r in found] == ([("a", 1, 0, "rare")] if rows and rows[0][0] else [])
