import itertools
import os
import random

import numpy as np
import pyarrow as pa
import pytest

from ledgerloom.llm import mixing, tokens

pytestmark = pytest.mark.skipif(not os.path.exists(f"{tokens.TOKENIZER_DIR}/byte_bpe_50k.tiktoken"), reason="no vocabulary files")


@pytest.fixture(scope="module")
def enc():
    return tokens.encoder()


def test_pieces_equal_whole(enc):
    rng = random.Random(3)
    signs = " \t\n\r 　 \u0085'!.;{}()abzéñ中文हि0१😀‍\"-_=\\sStrvelmd<|endoftext|>"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 30))) for _ in range(4000)]
    texts += ["'s'll!'s", "a  b", "\n\n\nx", "x" * 50_000, ";\n" * 20_000, "é" * 3000, "  " * 2000, "日本語 text", "don't 'tis"]
    ids, offsets = enc.encode_column(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == enc.encode_whole(t), repr(t[:60])


def test_equals_reference_library(enc):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{tokens.TOKENIZER_DIR}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    for s in ("Fix <|endoftext|> handling\r\n\tif (x) {\n", "ünï cödé 中文  \n\n end", "a's b're 'x"):
        assert enc.encode(s) == t.encode(s, add_special_tokens=False).ids


def test_slices_nulls_and_round_trip(enc):
    column = pa.array(["skipped", "one two", None, "", "three\n"], pa.string()).slice(1)
    ids, offsets = enc.encode_column(column)
    back = {v: k for k, v in enc.ranks.items()}
    assert [b"".join(back[i] for i in ids[a:b]).decode() for a, b in itertools.pairwise(offsets)] == ["one two", "", "", "three\n"]
    assert enc.encode_column(pa.array([], pa.string()))[1].tolist() == [0]


def test_corpus(spark, enc):
    rows = [(1, "a b", "x"), (2, None, "x"), (3, "", "x"), (4, "  ", None), (1, "a b", "x"), (None, "z" * 100_000, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = tokens.encode_corpus(df)
    assert got.dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
    assert sorted((r["doc_id"] or 0, r["ids"]) for r in got.collect()) == sorted((i or 0, enc.encode_whole(t or "")) for i, t, _ in rows)
    assert tokens.encode_corpus(df.limit(0)).count() == 0
    assert sorted(r["n_tokens"] for r in tokens.count_corpus(df, "doc_id").collect()) == sorted(len(enc.encode_whole(t or "")) for _, t, _ in rows)


def test_rows_by_bytes():
    b = pa.record_batch([pa.array(["x" * 10, None, "y" * 100, "z"])], names=["t"])
    assert [p.num_rows for p in tokens.by_bytes(b, 0, 20)] == [2, 1, 1] and [p.num_rows for p in tokens.by_bytes(b, 0, 1000)] == [4]


def test_knapsack_against_all_sums():
    rng = np.random.default_rng(2)
    for _ in range(200):
        lengths, counts = rng.choice(np.arange(1, 12), 4, replace=False), rng.integers(0, 4, 4)
        budget = int(rng.integers(0, 60))
        taken = mixing.knapsack(lengths, counts, budget)
        best = max(s for s in (int(np.dot(lengths, c)) for c in itertools.product(*[range(n + 1) for n in counts])) if s <= budget)
        assert int((taken * lengths).sum()) == best and (taken <= counts).all() and (taken >= 0).all()


def test_fit():
    rng = np.random.default_rng(5)
    for _ in range(200):
        lengths = np.unique(rng.integers(0, 400, 60))
        counts = rng.integers(1, 30, len(lengths))
        total, cap = int((lengths * counts).sum()), int(rng.integers(0, 5))
        target = int(rng.integers(0, total * 5 + 2))
        passes, extra = mixing.fit(lengths, counts, target, cap)
        got = passes * total + int((extra * lengths).sum())
        assert passes + bool(extra.any()) <= cap and (extra <= counts).all() and (extra >= 0).all()
        assert got == min(target, cap * total), (got, target, cap * total)


def test_mix(spark):
    rng = random.Random(1)
    words = "alpha beta gamma delta".split()
    docs = [(i, "big" if i % 3 else "small", " ".join(rng.choice(words) for _ in range(rng.randint(1, 30)))) for i in range(240)]
    docs += [(900, "big", None), (901, "big", ""), (902, None, "no source")] + [(1000 + i, "big", "same text here") for i in range(300)]
    plans = [("p", "big", 3.0, 1, 0.5), ("p", "small", 1.0, 2, 0.5), ("p", "none", 1.0, 2, 0.5), ("q", "small", 5.0, 2, 3.0), (None, "big", 1.0, 1, 1.0), ("r", "big", None, 1, 1.0)]
    mix = mixing.Mix(spark.createDataFrame(docs, "doc_id bigint, source string, text string"), spark.createDataFrame(plans, "plan_id string, source string, weight double, max_repeats int, budget_ratio double"))
    shares = {(r["plan_id"], r["source"]): r for r in mix.shares().collect()}
    drawn = mix.drawn().collect()
    assert len({(r["plan_id"], r["doc_id"]) for r in drawn}) == len(drawn)
    for key, s in shares.items():
        mine = [r for r in drawn if (r["plan_id"], r["source"]) == key]
        assert sum(r["n_tokens"] * r["repeats"] for r in mine) == s["actual_tokens"] and sum(r["repeats"] for r in mine) == s["draws"]
        cap = next(p[3] for p in plans if p[:2] == key)
        assert all(1 <= r["repeats"] <= cap for r in mine)
    assert shares["p", "big"]["actual_tokens"] == int(shares["p", "big"]["target_tokens"])
    assert shares["p", "none"]["actual_tokens"] == 0 and shares["r", "big"]["target_share"] == 0
    assert shares["q", "small"]["actual_tokens"] == 2 * shares["q", "small"]["source_tokens"] and shares["q", "small"]["actual_share"] == 1.0
    assert {tuple(r) for r in drawn} == {tuple(r) for r in mix.drawn().collect()}
    empty = mixing.Mix(spark.createDataFrame([], "doc_id bigint, source string, text string"), spark.createDataFrame(plans, "plan_id string, source string, weight double, max_repeats int, budget_ratio double"))
    assert empty.drawn().count() == 0 and all(r["actual_tokens"] == 0 for r in empty.shares().collect())


def test_long_documents_and_pieces_stay_within_memory(monkeypatch):
    lengths, counts = np.array([30_000_000, 9_000_000, 7, 3]), np.array([2, 3, 50, 50])
    taken = mixing.knapsack(lengths, counts, 75_000_101)
    assert (taken <= counts).all() and int((taken * lengths).sum()) == 69_000_500
    assert mixing.knapsack(lengths, counts, 10**12).tolist() == counts.tolist()
    monkeypatch.setattr(tokens, "REMEMBERED", 2000)
    enc = tokens.Encoder(tokens.TOKENIZER_DIR, tokens.BYTE_BPE_50K)
    for text in ["x" * 5000 + " y", *[f"word{i} and word{i * 7}" for i in range(300)]]:
        assert enc.encode(text) == enc.encode_whole(text)
    assert enc.size < 3000 and all(len(p) <= tokens.LONG_PIECE for p in enc.known)
