import random

import pytest

from gristdex.llm.encode import BytePairEncoder, encode_corpus, encoder, portions, token_counts, vocabulary_path
from gristdex.llm.pretokenize import slices

public = pytest.importorskip("public_tokenizers")
HARD = ["", " ", "  ", "\n", "a", "it's we'll they've I'm you'd 'tis ''s 'll", " 's", "x'  's", "a  b", "a \n b", "tab\t\tx ", "end  ", "1a2b", "ｆｕｌｌ　width", "漢字かな", "👩‍🔧 🧑🏽", "é́", "<|endoftext|>", "a" * 3000, "'" * 200, " " * 500 + "x", "ab'll" * 500, "\x00\x1c\x85 ​­", "ÿ" * 100]


@pytest.fixture(scope="module")
def coder():
    return encoder(vocabulary_path())


@pytest.fixture(scope="module")
def library():
    import base64

    import tiktoken

    lines = open(public.path("byte_bpe_50k.tiktoken"), "rb")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(2)
    letters = list("  \n\t''''strevlmd aA1９éλ你　.,!_-​́👍\x1c\x85<|")
    return HARD + ["".join(rng.choices(letters, k=rng.randint(0, 60))) for _ in range(3000)]


def test_ids_are_those_of_both_libraries(coder, library, texts):
    from tokenizers import Tokenizer

    hub = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    hub.encode_special_tokens = True
    mine = [ids for ids, _ in coder.encode(texts)]
    assert mine == [library.encode_ordinary(t) for t in texts]
    assert mine == [e.ids for e in hub.encode_batch(texts, add_special_tokens=False)]


def test_round_trip_and_offsets(coder, texts):
    for text, (ids, starts) in zip(texts, coder.encode(texts)):
        raw = text.encode()
        assert coder.decode(ids) == raw
        cuts = [*starts, len(raw)]
        assert b"".join(raw[a:b] for a, b in zip(cuts, cuts[1:])) == raw and cuts == sorted(set(cuts)) or not raw


def test_many_texts_at_once_or_one_by_one(coder, texts):
    assert coder.encode(texts[:300]) == [coder.encode([t])[0] for t in texts[:300]]


def test_long_slices_merge_like_short_ones(coder):
    rng = random.Random(4)
    for _ in range(300):
        piece = "".join(rng.choices("abcdefghthe ing", k=rng.randint(1, 64))).encode()
        if piece not in coder.ranks:
            assert coder._merge_long(piece) == coder._merge_short(piece)
    assert coder.decode(coder.merge(b"ab" * 100_000)) == b"ab" * 100_000


def test_every_code_point_splits_like_the_library(coder, library):
    texts = [f"a{c}1{c} " for c in map(chr, range(0x3000)) if not 0xD800 <= ord(c) < 0xE000]
    assert [x[0] for x in coder.encode(texts)] == [library.encode_ordinary(t) for t in texts]


def test_lone_surrogates_become_replacements():
    data, _, _ = slices(["a\ud800b"])
    assert data == "a�b".encode()


def test_corpus(spark, coder):
    rows = [(1, "Hello there", "x"), (2, None, "x"), (3, "", None), (4, "Hello there", "y"), (4, "Hello there", "y"), (5, "long " * 20_000, "z")]
    df = spark.createDataFrame([(*r, [1], [2]) for r in rows], "doc_id BIGINT, text STRING, source STRING, ids ARRAY<INT>, starts ARRAY<INT>")
    got = encode_corpus(df, "doc_id", "text", offsets=True, keep=("source",)).collect()
    assert len(got) == 6 and all(coder.decode(r["ids"]) == (dict((a, b) for a, b, _ in rows)[r["doc_id"]] or "").encode() for r in got)
    assert sorted((r["doc_id"], len(r["ids"]), len(r["starts"])) for r in got)[:4] == [(1, 2, 2), (2, 0, 0), (3, 0, 0), (4, 2, 2)]
    assert encode_corpus(df, "doc_id", "text").dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
    counts = token_counts(df, "doc_id", "text", keep=("source",)).collect()
    assert sorted((r["doc_id"], r["tokens"], r["source"] or "") for r in counts) == sorted((r["doc_id"], len(r["ids"]), r["source"] or "") for r in got)
    none = df.limit(0)
    assert encode_corpus(none, "doc_id", "text").count() == token_counts(none, "doc_id", "text").count() == 0


def test_portions_keep_all_rows(monkeypatch):
    import pyarrow as pa

    import gristdex.llm.encode as module

    monkeypatch.setattr(module, "BATCH_POINTS", 10)
    batch = pa.RecordBatch.from_pydict({"text": ["abc", None, "x" * 50, "", "abcdefghi", "yz"]})
    parts = list(portions(batch))
    assert [t for _, texts in parts for t in texts] == ["abc", "", "x" * 50, "", "abcdefghi", "yz"]
    assert all(b.num_rows == len(t) for b, t in parts) and len(parts) > 2


def test_another_vocabulary(library):
    coder = BytePairEncoder(vocabulary_path("byte_bpe_multi_50k"))
    ((ids, _),) = coder.encode(["Übergrößenträger 漢字"])
    assert coder.decode(ids) == "Übergrößenträger 漢字".encode()
