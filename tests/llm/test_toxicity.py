import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gristdex.llm.textforms import TermHasher, plain, word
from gristdex.llm.toxicity import Bags, FactorizationMachine, labelled_bags, rates, train

CALM = ["we tested the {n} near the {m} today", "has anyone tried a {n} with a {m}", "the {m} came loose again", "two {g} families run the ferry, lovely people", "this {n} is garbage, save your money", "the {n} attracts vermin in winter"]
HARSH = ["all {g} are vermin, throw them out", "shut up you filthy {n}head idiot", "i will break your fingers one by one", "those {g} are garbage and should leave"]


def corpus(n, seed, noise=0.0):
    rng = random.Random(seed)
    fill = lambda s: s.format(n=rng.choice(["cable", "stove", "hinge"]), m=rng.choice(["gate", "roof"]), g=rng.choice(["northmen", "hillfolk", "marshfolk"]))
    docs, truth, labels = [], [], []
    for i in range(n):
        harsh = rng.random() < 0.3
        parts = [fill(rng.choice(CALM)) for _ in range(rng.randint(1, 6))]
        if harsh:
            parts.insert(rng.randrange(len(parts) + 1), fill(rng.choice(HARSH)))
        docs.append((i, ". ".join(parts) + ".", f"s{i % 3}"))
        truth.append(harsh)
        labels.append((i, int(harsh != (rng.random() < noise))))
    return docs, truth, labels


def terms_of(h, texts):
    """The set of slots of each sentence, by document."""
    s = h.batch(texts)
    word = lambda i: set(s.slots[s.cuts[i] : s.cuts[i + 1]].tolist())
    out = [[] for _ in texts]
    for k, doc in enumerate(s.doc):
        out[doc].append(set().union(*(word(i) for i in s.words[s.offsets[k] : s.offsets[k + 1]])))
    return out


def test_forms():
    assert plain("Bo[b][/b]ne <b>X</b> &amp; s_c_u_m i d i o t É​x") == "bone x & scum idiot ex"
    assert word("1d10t") == word("idiоt") == word("idiiiot") == "idiot" and word("2024") == "0"
    assert word("товар") == "товар"
    h = TermHasher()
    assert terms_of(h, [None, "", " \n ", "!?"]) == [[], [], [], []]
    assert h.batch([]).documents == 0
    ((masked,), (whole,)) = terms_of(h, ["imbe*ile", "imbecile"])
    assert masked & whole and masked != whole


def test_sentences_and_words():
    h = TermHasher()
    found = terms_of(h, ["One. two!  three\nfour。five", "'x.y' 12 345 a-b it's* $cum!", "黙れクズabc"])
    t = lambda *words: set().union(*(h.terms(w) for w in words))
    assert found[0] == [t("one"), t("two"), t("three"), t("four"), t("five")]
    assert found[1] == [t("x", "y", "12", "a", "b", "it's*", "cum")]
    assert found[2] == [t("黙れクズ", "abc")] and t("12") == t("345")


def test_batches_do_not_matter():
    texts = [t for _, t, _ in corpus(40, 9)[0]] + ["<a title='late scum'>x</a> [b]y", None, "a\x1eb<i", "c=d>e", "&#30;&am", "p; z", "ﬁn ＷＩＤＥ [quote=b]c", "i d i o t", "s_c_u", "_m_x"]
    h = TermHasher(remember=50)
    assert terms_of(h, texts) == [terms_of(TermHasher(), [t])[0] for t in texts]


def test_held_out_accuracy():
    docs, truth, labels = corpus(900, 1, noise=0.05)
    other, other_truth, _ = corpus(400, 2)
    h = TermHasher()
    bags, held, want = Bags.of(h.batch([t for _, t, _ in docs])), h.batch([t for _, t, _ in other]), np.array(other_truth)
    y = np.array([float(x) for _, x in labels])
    fm = FactorizationMachine(h.size).fit(bags, y)
    assert ((fm.document_scores(held) > 0) == want).mean() > 0.97
    again = FactorizationMachine(h.size).fit(bags, y)
    assert np.array_equal(fm.w, again.w) and np.array_equal(fm.v, again.v)


GROUPS, THINGS = ["northmen", "hillfolk", "marshfolk", "islanders"], ["weeds", "moths", "potholes", "fogbanks"]
CURSES, PRAISES, CRIMES = ["despise", "curse", "purge", "loathe"], ["cherish", "salute", "admire", "bless"], ["massacres", "lynchings", "pogroms", "beatings"]


def pairs(n, seed):
    """Sentences that are abusive by the pair of their words only: curse and group, or praise and crime."""
    rng = random.Random(seed)
    texts, y = [], []
    for _ in range(n):
        verb, what = rng.choice([(CURSES, GROUPS), (PRAISES, CRIMES), (CURSES, THINGS), (PRAISES, GROUPS), (CURSES, CRIMES), (PRAISES, THINGS)])
        texts.append(f"we {rng.choice(verb)} those {rng.choice(what)} {rng.choice(['today', 'always', 'here', 'again'])}")
        y.append(float((verb is CURSES and what is GROUPS) or (verb is PRAISES and what is CRIMES)))
    return texts, np.array(y)


def test_factors_learn_what_single_terms_cannot():
    h = TermHasher()
    texts, y = pairs(1500, 4)
    held, want = pairs(600, 5)
    bags, held = Bags.of(h.batch(texts)), h.batch(held)
    right = {k: ((FactorizationMachine(h.size, factors=k).fit(bags, y, rounds=40, wrong=0.02).document_scores(held) > 0) == (want > 0.5)).mean() for k in (4, 0)}
    assert right[4] > 0.97 and right[0] < 0.85


def test_scores_by_word_and_by_term_agree():
    h = TermHasher()
    s = h.batch([t for _, t, _ in corpus(50, 6)[0]])
    fm = FactorizationMachine(h.size, seed=3)
    fm.w[:] = np.random.default_rng(1).normal(size=h.size)
    bags = Bags.of(s)
    want = np.full(bags.documents, -np.inf)
    for i, doc in enumerate(bags.doc):
        slots = bags.slots[bags.offsets[i] : bags.offsets[i + 1]]
        pair = sum(float(fm.v[a] @ fm.v[b]) for k, a in enumerate(slots) for b in slots[k + 1 :])
        want[doc] = max(want[doc], fm.w[slots].sum() + pair)
    assert np.allclose(fm.document_scores(s), want, atol=1e-3)


def test_one_sided_labels():
    h = TermHasher()
    two, none = h.batch(["a b c", "d e f"]), h.batch([])
    assert (FactorizationMachine(h.size).fit(Bags.of(two), np.zeros(2)).document_scores(two) < 0).all()
    assert (FactorizationMachine(h.size).fit(Bags.of(two), np.ones(2)).document_scores(two) > 0).all()
    assert len(FactorizationMachine(h.size).fit(Bags.of(none), np.zeros(0)).document_scores(none)) == 0


def test_labelled_rows(spark):
    d = spark.createDataFrame([(i, None if i % 5 == 0 else "x " * (400 if i % 5 == 1 else 3) + f". w{i}") for i in range(100)], "doc_id BIGINT, text STRING")
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)] + [(2, 1)], "doc_id BIGINT, toxic INT")
    bags, y = labelled_bags(d, labels, 18, most=70, longest=100)
    assert bags.documents == len(y) == 60 and sorted(set(y)) == [0.0, 0.5, 1.0]
    order = [r[0] for r in labels.select("doc_id").distinct().orderBy(F.xxhash64("doc_id")).collect()]
    want = [i for i in order[:30] if i < 100 and i % 5 > 1][:15]
    bags, y = labelled_bags(d, labels, 18, most=15, longest=100)
    assert y.tolist() == [0.5 if i == 2 else i % 2 for i in want] and len(bags.doc) == 2 * len(want)


def test_on_tables(spark):
    docs, truth, labels = corpus(600, 3)
    extra = [(9001, None, None), (9002, "", "s0"), (9003, "  ", "s0"), (9004, "the gate. " * 30_000, "s1"), (0, docs[0][1], "s0")]
    d = spark.createDataFrame([(*x, 0.5, True, 1) for x in docs + extra], "doc_id BIGINT, text STRING, source STRING, score DOUBLE, flagged BOOLEAN, y INT").repartition(4)
    judgements = [(i, t) for i, t in labels[:400]] + labels[:50] + [(5, None), (None, 1), (77_777, 1)]
    lab = spark.createDataFrame(judgements, "doc_id BIGINT, toxic INT")
    model = train(d, lab)
    rows = model.score(d, keep=("source",)).collect()
    assert len(rows) == len(docs) + len(extra)
    by = {r["doc_id"]: r for r in rows}
    assert sum(by[i]["flagged"] == truth[i] for i in range(600)) > 580
    assert all(by[i]["score"] == 0 and not by[i]["flagged"] for i in (9001, 9002, 9003)) and not by[9004]["flagged"]
    table = {r["source"]: r for r in rates(model.score(d, keep=("source",))).collect()}
    assert sum(r["n_docs"] for r in table.values()) == len(rows) and None in table
    assert all(r["rate"] == pytest.approx(r["n_flagged"] / r["n_docs"]) for r in table.values())
    assert not any(r["flagged"] for r in train(d, lab.limit(0)).score(d).collect())
    assert model.score(d.limit(0)).count() == 0
    assert train(d, lab, most=50).score(d).count() == len(rows)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/check_s"), reason="no test data")
def test_held_out_judgements(spark):
    """Fitted on one table, tried on the judgements of another, of which 17 of 199 abusive ones are wrong (read in full)."""
    read = lambda d, name: spark.read.parquet(f"/root/testdata/{d}/{name}.parquet")
    scored = train(read("sf0.1", "documents"), read("sf0.1", "labels")).score(read("check_s", "documents"))
    votes = read("check_s", "labels").where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg((F.avg((F.col("toxic") > 0).cast("int")) > 0.5).alias("toxic"))
    n = scored.join(votes, "doc_id").agg(F.count_if(F.col("toxic") & F.col("flagged")).alias("both"), F.count_if("toxic").alias("toxic"), F.count_if("flagged").alias("flagged")).first()
    assert n["both"] / n["flagged"] > 0.9 and n["both"] / (n["toxic"] - 17) > 0.9
