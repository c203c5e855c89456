"""Learned operators: held-out accuracy, awkward rows, and the pipeline against its parts."""

import zlib

import numpy as np
import pytest

pytest.importorskip("surety.llm")
import corpus_pipeline  # noqa: E402
from surety.llm import contracts, crf_language, ngram_join, packing, quality_gbt  # noqa: E402

SMALL = "/root/testdata/sf0.01"


def test_language_held_out(spark):
    docs = contracts.table(spark, SMALL, "documents")
    got = contracts.op8_crf_language(spark, SMALL).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.97 and all(0 <= r["score"] <= 1 for r in got)


def test_language_of_odd_rows(spark):
    rows = [(0, "the house and the garden are here", "en"), (1, "das haus und der garten sind hier", "de"), (2, None, "en"), (3, "", "de"), (4, "123 !!", None), (5, "the garden", None), (None, "das haus und der garten", "x"), (0, "the house and the garden are here", "en")]
    docs = spark.createDataFrame([(i, t, g, "kept") for i, t, g in rows], "doc_id long, text string, lang string, score string")
    model = crf_language.LanguageCrf.fit([("en", "the house and the garden are here"), ("de", "das haus und der garten sind hier")])
    got = [r.asDict() for r in crf_language.identify(docs, model).collect()]
    found = {(r["doc_id"], r["text"]): r["lang_pred"] for r in got}
    assert len(got) == len(rows) and found[2, None] == found[3, ""] == found[4, "123 !!"] == "und" and found[5, "the garden"] == "en"
    nothing = crf_language.LanguageCrf.fit([])
    assert {r["lang_pred"] for r in crf_language.identify(docs, nothing).collect()} == {"und"}
    assert crf_language.identify(docs.where("false"), model).count() == 0 and crf_language.training_rows(docs.where("false").select("doc_id", "text", "lang")) == []


def test_words_of_code_switched_text_have_their_own_language(spark):
    """Documents of two languages spliced in runs of words: the words' labels against where they came from."""
    docs = contracts.table(spark, SMALL, "documents")
    model = contracts.language_model(docs)
    texts = {}
    for r in docs.where("lang is not null and length(text) > 400").orderBy("doc_id").collect():
        if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1:  # not learned from
            texts.setdefault(r["lang"], []).append([w for w in r["text"].split() if w.isalpha()])
    rng, rows, truth = np.random.default_rng(2), [], []
    for i in range(40):
        words, tags = [], []
        for lang in rng.permutation(sorted(texts))[:3]:
            pool = texts[lang][int(rng.integers(len(texts[lang])))]
            part = pool[: int(rng.integers(12, 30))]
            words += part
            tags += [lang] * len(part)
        rows.append((i, " ".join(words) + " 12!"))
        truth.append(tags)
    rows += [(100, None), (101, "12 !!"), (102, "é 中 x" + " wort" * 30_000)]
    got = {r["doc_id"]: r["words"] for r in crf_language.label_words(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert got[100] == got[101] == [] and len(got[102]) == 30_003
    assert all(rows[i][1][w["start"] : w["end"]].isalpha() and 0 <= w["probability"] <= 1 for i in range(40) for w in got[i])
    right = [w["lang"] == t for i, tags in enumerate(truth) for w, t in zip(got[i], tags)]
    assert all(len(got[i]) == len(tags) for i, tags in enumerate(truth)) and np.mean(right) > 0.9
    assert {tuple(r["words"]) for r in crf_language.label_words(spark.createDataFrame([(1, "x y")], "doc_id long, text string"), crf_language.LanguageCrf.fit([])).collect()} == {()}


def test_trees_split_where_brute_force_does():
    """The first tree's root against every cut of every statistic, and array traversal against a walk node by node."""
    rng = np.random.default_rng(8)
    x = np.round(rng.random((400, 4)), 2)
    y = ((x[:, 2] > 0.6) | (x[:, 0] < 0.1)).astype(float)
    model = quality_gbt.BoostedTrees.fit(x, y)
    p = y.mean()
    slope, curve = p - y, np.full(len(y), p * (1 - p))
    worth = lambda m: slope[m].sum() ** 2 / (curve[m].sum() + quality_gbt.RIDGE)
    best = max((worth(x[:, f] <= c) + worth(x[:, f] > c) for f in range(4) for c in np.unique(np.quantile(x[:, f], np.linspace(0, 1, quality_gbt.BINS + 1)[1:-1]))
                if min(curve[x[:, f] <= c].sum(), curve[x[:, f] > c].sum()) >= quality_gbt.LEAST_HESSIAN), default=0)
    f, c = model.feature[0, 0], model.cut[0, 0]
    assert abs(worth(x[:, f] <= c) + worth(x[:, f] > c) - best) < 1e-9
    slow = []
    for row in x[:50]:
        total = model.prior
        for t in range(len(model.feature)):
            node = 0
            while node < model.feature.shape[1]:
                node = 2 * node + 1 + int(row[model.feature[t, node]] > model.cut[t, node])
            total += model.value[t, node - model.feature.shape[1]]
        slow.append(1 / (1 + np.exp(-total)))
    assert np.allclose(model.score(x[:50]), slow)


def test_language_sample_reaches_the_whole_text(spark):
    boilerplate = "the house and the garden are here " * 60
    rows = [(i, boilerplate + " ".join(f"wort{k:04d}é" for k in range(3_000)), "de") for i in range(20)] + [(50, "kurz und gut", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = [t for _, t in crf_language.training_rows(docs)]
    long = [t for t in got if t != "kurz und gut"]
    assert len(got) == 21 and max(map(len, got)) <= crf_language.SAMPLE_CHARS + 20
    places = [int(w[4:8]) for t in long for w in t.split() if w.startswith("wort")]
    assert min(places) < 400 and max(places) > 2_600 and set(" ".join(long).split()) <= set(" ".join(t for _, t, _ in rows).split())


def test_forward_backward_by_enumeration():
    rng = np.random.default_rng(0)
    emit, step, upto = rng.random((5, 2)), rng.random((2, 2)), np.array([0, 3, 3, 5])
    share = crf_language.forward_backward(emit, step, upto)
    for a, b in ((0, 3), (3, 5)):
        total = np.zeros((b - a, 2))
        for code in range(2 ** (b - a)):
            path = [code >> k & 1 for k in range(b - a)]
            weight = np.prod([emit[a + k, y] for k, y in enumerate(path)]) * np.prod([step[x, y] for x, y in zip(path, path[1:])])
            for k, y in enumerate(path):
                total[k, y] += weight
        assert np.allclose(share[a:b], total / total.sum(axis=1, keepdims=True))


def test_quality_held_out(spark):
    labels = contracts.table(spark, SMALL, "labels")
    got = contracts.op3_quality_gbt(spark, SMALL).join(labels, "doc_id").collect()
    good = [r["score"] for r in got if r["held_out"] and r["quality"] == 1]
    bad = [r["score"] for r in got if r["held_out"] and r["quality"] == 0]
    assert np.mean(np.array(good)[:, None] > np.array(bad)[None]) > 0.95
    assert np.mean([r["predicted"] for r in got if r["held_out"] and r["quality"] == 1]) > 0.97


def test_quality_of_odd_rows(spark):
    docs = spark.createDataFrame([(0, None, "a"), (1, "", "b"), (None, "x y z", "c"), (2, "word " * 20_000, "d"), (2, "again", "e")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(0, 1), (1, None), (2, 0), (None, 1)], "doc_id long, quality int")
    model = contracts.quality_model(docs, labels)
    got = [r.asDict() for r in quality_gbt.score(docs, model).collect()]
    assert len(got) == 5 and all(0 <= r["score"] <= 1 for r in got)
    assert quality_gbt.score(docs.where("false"), contracts.quality_model(docs, labels.where("false"))).count() == 0


def test_trees_learn_a_threshold():
    rng = np.random.default_rng(4)
    x = rng.random((3000, 3))
    model = quality_gbt.BoostedTrees.fit(x, ((x[:, 0] > 0.4) ^ (x[:, 1] > 0.7)).astype(float))
    y = rng.random((1000, 3))
    assert np.mean((model.score(y) > 0.5) == ((y[:, 0] > 0.4) ^ (y[:, 1] > 0.7))) > 0.95


def test_pipeline_is_its_stages(spark):
    docs = contracts.table(spark, SMALL, "documents")
    names = docs.columns
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    lang = {r["doc_id"]: r for r in crf_language.identify(docs, contracts.language_model(docs)).collect()}
    kept = [i for i, r in lang.items() if r["lang_pred"] != "und" and r["score"] >= corpus_pipeline.LEAST_LANGUAGE_SCORE]
    one = corpus_pipeline.language(spark, docs, SMALL)
    assert one.columns == names and sorted(r["doc_id"] for r in one.collect()) == sorted(kept)
    two = corpus_pipeline.quality(spark, one, SMALL)
    three = corpus_pipeline.near_duplicates(spark, two, SMALL)
    groups = {r["doc_id"]: r["component_id"] for r in ngram_join.near_duplicates(two).collect()}
    assert two.columns == three.columns == names and sorted(r["doc_id"] for r in three.collect()) == sorted({g for g in groups.values()})
    four = corpus_pipeline.personal_data(spark, three, SMALL)
    changed = [r for r in four.collect() if r["text"] != texts[r["doc_id"]]]
    assert four.columns == names and changed and all("<" in r["text"] and r["n_chars"] == len(r["text"]) for r in changed)
    five = corpus_pipeline.pack(spark, four, SMALL).collect()
    tokens = {}
    for r in five:
        tokens[r["doc_id"]] = tokens.get(r["doc_id"], 0) + r["length"]
    assert set(tokens) == {r["doc_id"] for r in four.collect()} and len({(r["sequence_id"], r["offset"]) for r in five}) == len(five)
    assert packing.pack(four.where("false"), contracts.tokenizer_path("byte_bpe_50k.json"), 1).count() == 0
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.where("false"), SMALL).count() == 0


def test_stages_keep_columns_whose_names_they_use(spark):
    """Columns that clash with the operators' own, letters' case aside, come back as they came."""
    names = ["lang_pred", "Score", "text_key", "base", "added", "copies", "component", "h"]
    rows = [(i, t, "en", "s", 1, *[f"{c}{i}" for c in names]) for i, t in enumerate(["mail a@b.cc " + "the house of the garden is here and there " * 5, "the cat of the house is in the garden and on the way " * 3, None, ""])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in names))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns
        assert all(r[c] == f"{c}{r['doc_id']}" for r in out.collect() for c in names), name
    assert {r["doc_id"] for r in corpus_pipeline.pack(spark, docs, SMALL).collect()} == {0, 1, 2, 3}


def test_near_duplicate_stage_keeps_one_of_repeated_rows(spark):
    words = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, words, "en", "s", 1), (1, words, "en", "s", 1), (2, words + " end", "en", "s", 1), (3, "other", "en", "s", 1), (None, words, "en", "s", 1), (4, None, "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, SMALL).collect()), key=str)
    assert got == [1, 3, 4, None]


def test_near_duplicate_stage_judges_repeated_doc_ids_by_text(spark):
    words = [" ".join(f"{c}{i}" for i in range(30)) for c in "abcdef"]
    rows = [(1, words[0]), (1, words[1]), (2, words[2]), (3, words[2] + " end"), (3, words[3]), (4, words[4]), (4, words[4] + " end"), (4, words[4]), (5, words[5]), (5, words[5]), (6, "!!!"), (6, "???"), (6, "???")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, docs, SMALL).collect())
    four = [x for x in got if x[0] == 4]
    assert [x for x in got if x[0] != 4] == sorted([(1, words[0]), (1, words[1]), (2, words[2]), (3, words[3]), (5, words[5]), (6, "!!!"), (6, "???")])
    assert len(four) == 1 and four[0][1] in (words[4], words[4] + " end")
