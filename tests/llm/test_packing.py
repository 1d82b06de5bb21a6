import json
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

P = pytest.importorskip("public_tokenizers")

from tokenizers import Tokenizer  # noqa: E402

from spatialplate.llm import packing  # noqa: E402

PATH = P.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def ids_of(text):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 0]


def check(rows, texts, capacity=2048):
    """rows hold all pieces of texts, in gapless sequences."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(by_doc) == set(texts)
    for doc, parts in by_doc.items():
        ids, at = ids_of(texts[doc]), 0
        for k, r in enumerate(sorted(parts, key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and (k == 0 or r.length == capacity) and 1 <= r.length <= capacity
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids) and len(parts) == -(-len(ids) // capacity)
    for parts in by_sequence.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    return len(by_sequence)


def test_query_packs_close_to_the_bound(spark, sf):
    from spatialplate.llm.queries import QUERIES

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    n = check(QUERIES["op2_best_fit_packing"](spark, sf).collect(), texts)
    total = sum(len(ids_of(t)) for t in texts.values())
    assert n <= -(-total // 2048) + 1


def test_odd_rows(spark):
    texts = {1: None, 2: "", 3: "a b c", 4: "word " * 2047, 5: "word " * 2048, 6: "word " * 9000, 7: "x" * 3000, 8: "<|endoftext|> here", 9: "a<|endoftext|><|endoftext|> b <|endoftext", 10: "<|endoftext|>"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").selectExpr("*", "1 AS length", "2 AS sequence_id")
    check(packing.pack_documents(df, PATH).collect(), texts)
    twice = packing.pack_documents(df.where("doc_id = 3").unionByName(df.where("doc_id = 3")), PATH).collect()
    assert len(twice) == 2 and {r.offset for r in twice} == {0, twice[0].length}
    assert packing.pack_documents(df.where("false"), PATH).count() == 0


def test_ids_can_be_kept(spark):
    df = spark.createDataFrame([(None, "a b")], "doc_id long, text string")
    r = packing.pieces(df, PATH, keep_ids=True).first()
    assert r.doc_id is None and list(r.ids) == ids_of("a b")


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 60), max_size=20))
def test_configurations_hold_each_piece_once(histogram):
    found = packing.configurations(histogram, 64, 40)
    counts = {}
    for times, used in found:
        assert times > 0 and sum(length * n for length, n in used.items()) <= 64
        for length, n in used.items():
            counts[length] = counts.get(length, 0) + times * n
    assert counts == histogram
    bound = -(-sum(a * b for a, b in histogram.items()) // 64)
    plain = sum(t for t, _ in packing.best_fit(np.array([histogram.get(i, 0) for i in range(1, 65)])))
    assert bound <= sum(t for t, _ in found) <= max(bound + 2, 1.1 * plain + 1)


def test_pricing_finds_the_best_configuration():
    rng = np.random.default_rng(3)
    for _ in range(20):
        w = rng.random(14) * (rng.random(14) < 0.6)
        best = [0.0] * 15
        for room in range(1, 15):
            best[room] = max([best[room - 1]] + [best[room - i] + w[i - 1] for i in range(1, room + 1)])
        used = packing.best_configuration(w)
        assert (used * np.arange(1, 15)).sum() <= 14 and abs(used @ w - best[14]) < 1e-9


def test_the_program_places_nearly_all():
    rng = np.random.default_rng(5)
    histogram = {length: int(n) for length, n in enumerate(rng.integers(100, 300, 1024), 1) if length > 60}
    program, rest = packing.solved(histogram, 1024)
    placed = sum(times * n for times, used in program for n in used.values())
    assert placed >= 0.9 * sum(histogram.values())


def test_the_relaxation_covers_every_length():
    rng = np.random.default_rng(6)
    demand = rng.integers(0, 9, 128)
    covered = np.zeros(129)
    for config, times in packing.relaxed(demand, 10).items():
        assert times > 0 and sum(config) <= 128
        np.add.at(covered, list(config), times)
    assert (covered[1:] >= (1 - packing.TOLERANCE) * demand - 1e-6).all() and (covered[1:] <= demand + 1e-6).all()


def least(demand):
    """The configuration program's exact optimum: its dual over all configurations, by the simplex method."""
    cap, configs = len(demand), []

    def grow(config, room, longest):
        configs.append(config)
        for length in range(1, min(room, longest) + 1):
            if demand[length - 1]:
                grow([*config, length], room - length, length)

    grow([], cap, cap)
    rows = [np.bincount(c, minlength=cap + 1)[1:] for c in configs if c]
    m = len(rows)
    t = np.zeros((m + 1, cap + m + 1))
    t[:m, :cap], t[:m, cap:-1], t[:m, -1], t[m, :cap] = rows, np.eye(m), 1, -demand
    while (t[m, :-1] < -1e-9).any():
        j = int(np.flatnonzero(t[m, :-1] < -1e-9)[0])
        i = min((t[i, -1] / t[i, j], i) for i in range(m) if t[i, j] > 1e-9)[1]
        t[i] /= t[i, j]
        for k in range(m + 1):
            if k != i:
                t[k] -= t[k, j] * t[i]
    return t[m, -1]


def test_the_program_is_within_its_tolerance_of_the_optimum():
    rng = np.random.default_rng(4)
    for _ in range(12):
        demand = rng.integers(1, 30, 13) * (rng.random(13) < 0.5)
        if not demand.any():
            continue
        found, lower = packing.covering(demand)
        best = least(demand)
        assert lower <= best + 1e-6 and best - 1e-6 <= sum(found.values()) <= (1 + packing.TOLERANCE) * best + 1e-6
        assert abs(sum(packing.relaxed(demand).values()) - best) <= packing.TOLERANCE * best + 1e-6


@pytest.mark.parametrize("histogram, capacity", [({19: 4, 33: 5}, 64), ({19: 40_000, 33: 50_000}, 64), ({600: 4000, 1040: 5000}, 2048)])
def test_long_lengths_decide(histogram, capacity):
    found = packing.configurations(histogram, capacity)
    assert sum(times for times, _ in found) == max(histogram.values())
    demand = np.array([histogram.get(i, 0) for i in range(1, capacity + 1)])
    found, lower = packing.covering(demand)
    assert sum(found.values()) <= (1 + packing.TOLERANCE) * lower <= (1 + packing.TOLERANCE) * max(histogram.values())


def test_never_worse_than_plain_best_fit():
    rng = np.random.default_rng(8)
    for _ in range(40):
        histogram = {int(length): int(n) for length, n in zip(rng.integers(1, 65, 6), rng.integers(1, 500, 6), strict=True)}
        plain = packing.best_fit(np.array([histogram.get(i, 0) for i in range(1, 65)]))
        assert sum(t for t, _ in packing.configurations(histogram, 64)) <= sum(t for t, _ in plain)


def test_files_of_another_kind_are_refused():
    file = json.loads(open(PATH).read())
    assert packing.checked(file)["<|endoftext|>"] == LIBRARY.token_to_id("<|endoftext|>")
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"added_tokens": [{"content": "x", "id": 1, "lstrip": True}]}):
        with pytest.raises(ValueError):
            packing.checked(file | change)
