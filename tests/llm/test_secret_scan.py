import itertools
import math
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spatialplate.llm import secret_scan as S

TEXT = 'password=abcdefghijkl token : "0123456789abcdef" AKIAABCDEFGHIJKLMN x AKIASHORT api_key=\'A/b+c_d.e-f=\' token:secret:abcdefghijklmnop deadbeefdeadbeef0 secret= short PASSWD="ÀÀ" ApiKey=abcdefghijkl'


def test_base_spans():
    counts, digest = S.base_spans(TEXT)
    base = [(a, k, b) for a, k, b, _ in S.find(TEXT) if k < 3]
    assert counts == [4, 1, 2] == [sum(k == i for _, k, _ in base) for i in range(3)]
    assert [TEXT[a:b] for a, k, b in base if k == 1] == ["AKIAABCDEFGHIJKLMN"] and digest


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["password", "PassWord", "token", "apikey", "api_key", "secret", '"', "'", " ", "=", ":", "AKIA", "A1", "deadbeef", "0123", "abcdefghijkl", "é", "ſecret", "\n", "K"]), max_size=30).map("".join))
def test_base_spans_are_the_rule(text):
    base = [(a, k, b) for a, k, b, _ in S.find(text) if k < 3]
    import hashlib

    counts, digest = S.base_spans(text)
    assert counts == [sum(k == i for _, k, _ in base) for i in range(3)]
    assert digest == hashlib.sha256(",".join(f"{S.KINDS[k]}:{a}:{b}" for a, k, b in base).encode()).hexdigest()


def plain_cost(value):
    """The same costs, over all segmentations one by one."""
    unit, low, plain = math.log10(S._alphabet(value)), value.lower(), value.lower().translate(S.LEET)

    def options(a, b):
        out, part = [(b - a) * unit], low[a:b]
        if len(set(part)) == 1 and b - a >= 3 and (a == 0 or low[a - 1] != part[0]):
            out.append(unit + math.log10(b - a))
        if b - a >= 3 and all(x + y in S.NEXT for x, y in itertools.pairwise(part)) and (a == 0 or low[a - 1] + part[0] not in S.NEXT):
            out.append(1.7 + math.log10(b - a))
        if (m := S.DATE.match(low, a)) and m.end() == b:
            out.append(4.6)
        for text, extra in ((part, 0.0), (plain[a:b], 0.6)):
            if text in S.RANK and b - a >= 3:
                case = value[a:b]
                out.append(math.log10(S.RANK[text] + 10) + extra + (0.0 if case == case.lower() else 0.3 if case in (case.upper(), case.capitalize()) else 1.0))
                break
        return min(out)

    n = len(value)
    best = math.inf
    for cuts in itertools.product([0, 1], repeat=n - 1):
        at = [0, *[i + 1 for i, c in enumerate(cuts) if c], n]
        best = min(best, sum(options(a, b) for a, b in itertools.pairwise(at)) + S.JOIN * (len(at) - 2))
    return best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["password", "Dragon", "m0nkey", "aaaa", "qwer", "1234", "2020", "x", "7", "!", "Z"]), min_size=1, max_size=3).map(lambda x: "".join(x)[:11]))
def test_cost_is_the_least_over_all_segmentations(value):
    assert abs(S.guess_cost(value) - plain_cost(value)) < 1e-9


def test_costs_tell_random_from_guessable():
    for weak in ("password", "Password1", "qwertyuiop", "aaaaaaaaaaaaaaaa", "monkey2020-01-15", "letmein"):
        assert S.guess_cost(weak) < S.COST
    for strong in ("xK9#mQ2$vL7p", "f81d4fae7dec", "zjq8Vw2rTn"):
        assert S.guess_cost(strong) >= S.COST
    assert S.guess_cost("") == 0 and S.guess_cost("aB3$" * 20_000) > 1000


def test_contexts_add_spans_and_leave_base_ones():
    text = "the pwd: xK9#mQ2$vL7p. password is hunterxyz9Qw! pass: welcome passwd=short1"
    spans = [(S.KINDS[k], text[a:b]) for a, k, b, _ in S.find(text)]
    assert ("guess", "xK9#mQ2$vL7p") in spans and not any("welcome" in s for _, s in spans)


def test_rows(spark):
    rows = [(1, TEXT), (2, None), (3, ""), (3, ""), (None, "x" * 500_000 + " token=abcdefghijkl")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS spans", "2 AS id")
    out = S.digest(S.scan(df)).collect()
    assert len(out) == 5
    for r in out:
        counts, digest = S.base_spans(dict(rows)[r.doc_id])
        assert [r.n_assign, r.n_access, r.n_hex] == counts and r.base_sha256 == digest
    assert next(r for r in out if r.doc_id is None).spans == "assign:500001:500019" and S.scan(df.where("false")).count() == 0


def test_query(spark, sf):
    from spatialplate.llm.queries import QUERIES

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: ([r.n_assign, r.n_access, r.n_hex], r.base_sha256) for r in QUERIES["op4_secret_scan"](spark, sf).collect()}
    assert got == {i: S.base_spans(t) for i, t in texts.items()}


def test_the_corpus_ranks_words(spark):
    prose = ["it is required here that forgotten things stay (kennwort)", "das kennwort ist required, forgotten oder kennwort", "required forgotten kennwort"]
    rows = [(i, t) for i, t in enumerate(prose)] + [(7, "password is required here, secret: forgotten, pass: kennwort"), (8, "dbPassword=Xk9$mQ2!vL7z and credentials: password: Xk9$mQ2!vL"), (9, 'bypass: qW8$kZ2!pL; {"userPassword": "Zr4$nT8!wK"}')]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert S.ranked(df)[:3] == ["forgotten", "kennwort", "required"]
    got = {r.doc_id: [dict(rows)[r.doc_id][s.start : s.end] for s in r.spans if s.kind == "guess"] for r in S.scan(df).collect()}
    assert got[7] == [] and got[8] == ["Xk9$mQ2!vL7z", "Xk9$mQ2!vL"] and got[9] == ["Zr4$nT8!wK"]


def test_spans_of_the_method_against_a_list(spark, sf):
    """Planted values between plain texts, by their places; nothing here relies on find()."""
    import random

    rng = random.Random(6)
    rows, want = [], {}
    for i in range(40):
        text, spans = "", []
        for _ in range(4):
            text += rng.choice(["we met today. ", "the report is long; ", ""])
            key = rng.choice(["pwd: ", "passphrase=", "client_secret = '", "auth: "])
            strong = rng.random() < 0.5
            value = rng.choice(["xK9#mQ2$vL7p", "T7&uB1!zW5@e", "pL0?sX6%cN3*"]) if strong else rng.choice(["welcome", "monkey", "qwertyuiop", "aaaaaaaaaa"])
            if strong:
                spans.append((len(text + key), len(text + key + value)))
            text += key + value + " "
        rows.append((i, text))
        want[i] = spans
    got = {r.doc_id: [(s.start, s.end) for s in r.spans] for r in S.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


@pytest.mark.parametrize("copies", [1, 3, 100])
def test_a_value_that_leaks_often_stays_a_secret(spark, copies):
    rows = [(i, f"note {i}: pwd: kqzxvbnwpr, and password is kqzxvbnwpr") for i in range(copies)] + [(1_000 + i, "password is required here") for i in range(copies)]
    rows += [(2_000 + i, "patience is required") for i in range(3)]
    got = S.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(len([s for s in r.spans if s.kind == "guess"]) for r in got) == 2 * copies
    assert all(not r.spans for r in got if r.doc_id >= 1_000) and "kqzxvbnwpr" not in S.ranked(spark.createDataFrame(rows, "doc_id long, text string"))


@pytest.mark.parametrize("z", [10, 70, 5_000])
def test_contexts_inside_values_of_any_length(z):
    text = f"auth: {'z' * z}&token=abcdefghijklm&pwd=Xk9$mQ2!vL7p end"
    assert [(S.KINDS[k], text[a:b]) for a, k, b, _ in S.find(text)] == [("assign", "token=abcdefghijklm"), ("guess", "Xk9$mQ2!vL7p")]


def test_many_contexts_in_one_run_end_in_time():
    assert S.find("token=abcdefghijklmnop&" * 20_000 + "end")[0][1] == 0
    assert len(S.find("pwd=" * 100_000)) == 1 and S.find("pwd=a, " * 50_000) == []


def rule_spans(text):
    """Base spans by patterns written out here."""
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"(?i:password|passwd|secret|token|api_?key)[\"']? *[:=] *[\"']?([A-Za-z0-9+/_.=\-]+)", text) if len(m[1]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if m.end() - m.start() >= 16]
    return sorted(found)


def test_base_spans_by_patterns_of_the_test(spark, sf):
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        assert [x[:3] for x in S.find(r.text or "") if x[1] != 3] == rule_spans(r.text or "")
