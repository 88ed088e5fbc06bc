import math
import random
from collections import Counter

from gristdex.sources.blocks import between, counts, pack, unpack

SCHEMA = "table_seq INT, keyword STRING, doc BIGINT, seq INT, score FLOAT, pct5 FLOAT, pct25 FLOAT, pct75 FLOAT, pct95 FLOAT"


def rows_of(df):
    return Counter(tuple("nan" if isinstance(v, float) and math.isnan(v) else v for v in r) for r in df.collect())


def test_round_trip(spark):
    rng = random.Random(8)
    scores = [0.0, -0.0, 1.0000001192092896, -(2.0**24), math.inf, math.nan, None]
    rows = []
    for _ in range(400):
        pct = [rng.random() for _ in range(4)] if rng.random() < 0.3 else [None] * 4
        rows.append((rng.randint(0, 1), rng.choice(["", "a", "b"]), rng.choice([-5, 0, 7, 4095, 4096, 2**45, rng.randint(0, 99)]), rng.choice([1, 2, 5000, None]), rng.choice(scores), *pct))
    rows += rows[:20] + [(0, None, 1, 1, 0.0, *[None] * 4), (0, "a", None, 1, 0.0, *[None] * 4)]
    df = spark.createDataFrame(rows, SCHEMA)
    kept = df.where("keyword IS NOT NULL AND doc IS NOT NULL")
    packed = pack(df, bits=6).cache()
    assert rows_of(unpack(packed)) == rows_of(kept)
    for r in packed.collect():
        places = [(p["doc"], p["seq"] or 0) for p in r["postings"]]
        assert places == sorted(places) and (r["first_doc"], r["last_doc"], r["n"]) == (places[0][0], places[-1][0], len(places))
    assert rows_of(between(packed, 5, 80)) == rows_of(kept.where("doc BETWEEN 5 AND 80"))
    n, top = Counter(), {}
    for _, k, d, *_ in rows:
        if k is not None and d is not None:
            n[k] += 1
            top[k] = max(top.get(k, d), d)
    assert {r["keyword"]: (r["n_postings"], r["max_doc"]) for r in counts(packed).collect()} == {k: (n[k], top[k]) for k in n}
    assert unpack(pack(df.limit(0))).count() == 0
