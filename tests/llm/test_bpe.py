import base64
import hashlib
import random

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

P = pytest.importorskip("public_tokenizers")

from spatialplate.llm import bpe  # noqa: E402

PATH = P.path("byte_bpe_50k.tiktoken")
CONTENT = open(PATH, "rb").read()
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, CONTENT.splitlines())}
LIBRARY = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
PARTS = ["a", "aa", "aaa", " ", "  ", "\n", "\t", "'s", "'", "'re", "''ll", "é", "ß", "1", "22", "½", "Ⅷ", "!", "日本", "🙂", " ", "　", "the", "ing", "'ve", "_", "\x1c", "\u0085", "​", "ſ", "A", "=", "--"]


def coded(texts):
    return [x.tolist() for x in bpe.coder(CONTENT)(texts)]


def test_odd_mixtures_match_the_library():
    rng = random.Random(5)
    texts = ["".join(rng.choices(PARTS, k=rng.randrange(40))) for _ in range(20_000)] + ["a" * 5000, "ab" * 3000, " " * 999, "=" * 777]
    assert coded(texts) == [LIBRARY.encode_ordinary(t) for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=60), min_size=1, max_size=4))
def test_any_text_matches_the_library(texts):
    assert coded(texts) == [LIBRARY.encode_ordinary(t) for t in texts]


def test_pairs_that_come_out_of_rank_order_are_redone():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256 + 9, b"abc": 256 + 2, b"bcd": 256 + 1, b"cd": 256 + 5}
    words = ["abc", "abcd", "ababc", "xabcabcd", "abcdabc"]
    ids, count = bpe.Replay(ranks)(words)
    got, at = [], 0
    for n in count.tolist():
        got.append(ids[at : at + n].tolist())
        at += n
    own = tiktoken.Encoding("own", pat_str=r"\w+", mergeable_ranks=ranks, special_tokens={})
    assert got == [own.encode_ordinary(w) for w in words]


def test_encode_decode_and_digests(spark):
    rows = [(1, "the cat's  hat\n"), (2, None), (3, ""), (3, ""), (None, "é" * 9), (5, "word " * 30_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("doc_id", "id").selectExpr("id", "text", "'x' AS ids")
    ids = bpe.encode(df, PATH, "id")
    want = {(i, tuple(LIBRARY.encode_ordinary(t or ""))) for i, t in rows}
    assert {(r.id, tuple(r.ids)) for r in ids.collect()} == want and ids.count() == len(rows)
    assert {(r.id, bytes(r.decoded)) for r in bpe.decode(ids, PATH, "id").collect()} == {(i, (t or "").encode()) for i, t in rows}
    digests = {(r.id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(df, PATH, "id").collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert digests == {(i, len(w := LIBRARY.encode_ordinary(t or "")), sha(" ".join(map(str, w)).encode()), sha((t or "").encode())) for i, t in rows}
    assert bpe.round_trip(df.where("false"), PATH, "id").count() == 0


def test_query_over_the_documents(spark, sf):
    from spatialplate.llm.queries import QUERIES

    got = {r.doc_id: (r.n_tokens, r.decoded_sha256) for r in QUERIES["op3_merge_replay"](spark, sf).collect()}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert got == {i: (len(LIBRARY.encode_ordinary(t or "")), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in docs.items()}
    ids = {r.doc_id: r.ids_sha256 for r in QUERIES["op3_merge_replay"](spark, sf).collect()}
    assert ids == {i: hashlib.sha256(" ".join(map(str, LIBRARY.encode_ordinary(t or ""))).encode()).hexdigest() for i, t in docs.items()}
