import random
import zlib

import numpy as np
import pytest

from spatialplate.llm import language_id as L

SAMPLES = {"en": ["the cat and the hat are there with them " * 20], "de": ["der hund und die katze sind nicht hier " * 20], "ru": ["кошка и собака живут здесь вместе с нами " * 20]}


def plain_phrases(text, sample, table):
    """Longest matches one by one, over the whole text."""
    coded, known = (chr(0x4000).join(map(chr, [0x5000 + x for x in L.symbols(t, table).tolist()])) for t in (text, " ".join(dict.fromkeys(sample)).lower()))
    coded, known = coded.replace(chr(0x4000), ""), known.replace(chr(0x4000), "")
    n = at = 0
    while at < len(coded):
        end = at + 1
        while end <= len(coded) and coded[at:end] in known:
            end += 1
        at = max(at + 1, end - 1)
        n += 1
    return n


@pytest.mark.parametrize("block", [256, 7, 1])
def test_phrases_are_greedy_longest_matches(monkeypatch, block):
    monkeypatch.setattr(L, "BLOCK", block)
    model = L.Model.fit(SAMPLES)
    rng = random.Random(2)
    texts = ["".join(rng.choices("the catdrhunßèкошка ,.1", k=rng.randrange(900))) for _ in range(40)] + ["", "1 2", "the cat" * 300, SAMPLES["en"][0] * 3, "и кошка и собака живут здесь вместе с нами " * 9]
    found, sizes = model.phrases(texts)
    assert sizes.tolist() == [len(L.symbols(t, model.table)) for t in texts]
    for i, lang in enumerate(model.languages):
        assert found[i].tolist() == [plain_phrases(t, SAMPLES[lang], model.table) for t in texts]


def test_many_languages_and_scripts():
    rng = random.Random(11)
    alphabets = {f"latin{k}": "".join(rng.sample("abcdefghijklmnopqrstuvwxyzäöüéèñ", 20)) for k in range(5)} | {f"cyr{k}": "".join(rng.sample("абвгдежзийклмнопрстуфхцчшщыэюя", 20)) for k in range(3)}
    alphabets |= {"greek": "αβγδεζηθικλμνξοπρστυφχψω", "hangul": "".join(map(chr, range(0xAC00, 0xAC00 + 500)))} | {f"han{k}": "".join(map(chr, range(0x4E00 + 600 * k, 0x4E00 + 600 * (k + 1)))) for k in range(2)}
    assert len(alphabets) == 12

    def text(name, n):
        words = vocabulary[name]
        return " ".join(rng.choices(words, k=n))

    vocabulary = {k: ["".join(rng.choices(v, k=rng.randrange(2, 7))) for _ in range(400)] for k, v in alphabets.items()}
    model = L.Model.fit({k: [text(k, 200) for _ in range(24)] for k in alphabets})
    asked = [(k, text(k, 12)) for k in alphabets for _ in range(24)]
    got = model.predict([t for _, t in asked])[0]
    assert sum(k == g for (k, _), g in zip(asked, got, strict=True)) >= 0.99 * len(asked)


def test_the_sample_takes_whole_rows_and_finds_rare_letters(spark):
    rows = [(i, "12 34", "aa") for i in range(400)] + [(1000 + i, "1 " * 1500 + f"word{i} the end", "aa") for i in range(30)] + [(2000, "long " * 3000, "bb"), (2001, "longer " * 3000, "bb"), (2002, None, "bb"), (2003, "5", "cc")]
    got = L.sampled(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert set(got) == {"aa", "bb"} and len(got["aa"]) == L.ROWS and all(t.endswith("the end") for t in got["aa"]) and got["bb"] == ["long " * 3000]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    few = L.sampled(docs, rows=3, longest=20_000)
    assert len(few["aa"]) == 3 and set(few["aa"]) <= set(got["aa"]) and sorted(few["bb"]) == ["long " * 3000]
    assert L.sampled(docs, longest=4)["bb"] == ["long " * 3000]
    assert L.fit(docs, rows=2).languages == L.fit(docs).languages == ["aa", "bb"]


def test_automaton_knows_exactly_the_substrings():
    text = [0, 1, 0, 1, 1, 0, 2, 0, 1]
    follow = L.automaton(text)
    inside = {tuple(text[a:b]) for a in range(9) for b in range(a + 1, 10)}
    todo, seen = [((), 0)], set()
    while todo:
        word, s = todo.pop()
        for c, to in follow[s].items():
            seen.add((*word, c))
            todo.append(((*word, c), to))
    assert seen == inside


def test_predictions_and_odd_texts():
    model = L.Model.fit(SAMPLES)
    names, scores, _ = model.predict(["there is the cat", "die katze und der hund", "собака и кошка", None, "", "12 !!", "THE CAT"])
    assert names == ["en", "de", "ru", "und", "und", "und", "en"] and scores[3:6] == [0, 0, 0] and all(0 <= s <= 1 for s in scores)
    assert L.Model.fit({}).predict(["abc", None]) == (["und", "und"], [0.0, 0.0], [0.0, 0.0])
    assert L.Model.fit({"x": ["12"]}).languages == []


def test_rows(spark):
    df = spark.createDataFrame([(1, "the cat", "en"), (None, "der hund", None), (3, None, "de"), (3, None, "de")], "doc_id long, text string, lang string").selectExpr("*", "1 AS names", "2 AS score")
    out = L.identify(df, L.Model.fit(SAMPLES))
    assert out.columns == [*df.columns, "lang_pred", "lang_score", "lang_rate"]
    assert [(r.doc_id, r.lang_pred) for r in out.collect()] == [(1, "en"), (None, "de"), (3, "und"), (3, "und")]
    assert L.identify(df.where("false"), L.fit(df.where("false"))).count() == 0


def test_held_out_accuracy(spark, sf):
    from spatialplate.llm.queries import QUERIES

    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op5_cross_parsing"](spark, sf).collect()
    assert len(got) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    right = [r.lang_pred == docs[r.doc_id].lang for r in got if r.held_out and docs[r.doc_id].lang]
    assert np.mean(right) > 0.95 and all(0 <= r.score <= 1 for r in got)


def test_held_out_rows_are_not_learned_from(spark):
    rows = [(i, "abc def ghi " * 30, "xx" if zlib.crc32(str(i).encode()) % 4 == 2 else "yy") for i in range(40)]
    assert L.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string")).languages == ["yy"]
