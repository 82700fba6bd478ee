import random

import pyarrow as pa
import pytest

from quern.llm import tokens
from quern.llm.tokens import DEFAULT_TOKENIZER, Merges, count_tokens, encode_corpus, replay

TEXTS = [
    None, "", " ", "aaaaaaaaaaaaaaaaaaaaaaa", "it's he'll I'd we've you're I'm don't", "été naïve Größe 速い реже 👨‍💻🏽", "<|endoftext|> is text", "tabs\t\t and \r\n\r\n lines  ", "x" * 30_001, "ab" * 5000,
    "no\xadbreak zero​width ﻿mark é", "1234567890 12 ٣٤", "\x00\x01", "don’t", "   leading", "trailing   ",
]


@pytest.fixture(scope="module")
def reference():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(DEFAULT_TOKENIZER)
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def noise(seed, n):
    r = random.Random(seed)
    alphabet = "aaaabc eethe  ing\n'éß速🚀019.,-"
    return ["".join(r.choice(alphabet) for _ in range(r.randrange(200))) for _ in range(n)]


def test_ids_equal_the_public_library(spark, reference):
    texts = TEXTS + noise(1, 200)
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(0, TEXTS[4], "twice")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    got = sorted((r["doc_id"], r["ids"]) for r in encode_corpus(df).collect())
    assert got == sorted((i, reference(t)) for i, t, _ in rows)
    counts = sorted((r["doc_id"], r["n_tokens"]) for r in count_tokens(df).collect())
    assert counts == [(i, len(x)) for i, x in got]
    assert encode_corpus(df.limit(0)).count() == 0


def test_blocks_change_nothing(spark, reference):
    texts = noise(2, 60) + [None, "", "x" * 700]
    assert [len(b) for b in tokens._blocks(enumerate(["a" * 30, "b" * 30, "c" * 300, None]), 50)] == [2, 1, 1]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    for most in (1, 50, 10**9):
        got = {r["doc_id"]: r["ids"] for r in encode_corpus(df, block_chars=most).collect()}
        assert got == {i: reference(t) for i, t in enumerate(texts)}
    assert {r["n_tokens"] for r in count_tokens(spark.createDataFrame([(1, ""), (2, None)], "doc_id long, text string")).collect()} == {0}


def test_files_of_another_order_or_split_are_refused(tmp_path):
    import json

    model = json.load(open(DEFAULT_TOKENIZER, encoding="utf-8"))
    merges = model["model"]["merges"]
    model["model"]["merges"] = [merges[1], merges[0], *merges[2:]]
    (tmp_path / "a.json").write_text(json.dumps(model), encoding="utf-8")
    model["model"]["merges"], model["pre_tokenizer"] = merges, {"type": "Whitespace"}
    (tmp_path / "b.json").write_text(json.dumps(model), encoding="utf-8")
    for name in ("a.json", "b.json"):
        with pytest.raises(ValueError):
            Merges.load(str(tmp_path / name))


def test_replay_merges_overlapping_places_from_the_left():
    merges = Merges(list(range(256)), {97 << 32 | 97: 300, 300 << 32 | 97: 301, 300 << 32 | 300: 302})
    ids, counts = replay([b"aaaaa", b"", b"aab"], merges)
    assert ids.tolist() == [300, 301, 300, 98] and counts.tolist() == [2, 0, 2]
    assert isinstance(pa.array(ids), pa.Array)
