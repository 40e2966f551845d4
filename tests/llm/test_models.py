import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rollmeter.llm import langid, quality, toxicity
from rollmeter.llm.frames import crc_mod
from rollmeter.llm.textcore import Words


def test_forward_backward_equals_the_plain_recursion():
    rng = np.random.default_rng(0)
    k, first = 3, np.array([0, 1, 1, 90, 91, 260])
    e, a, pi = rng.random((260, k)) + 0.01, rng.random((k, k)) + 0.1, rng.random(k) + 0.1
    got = langid.posteriors(e, first, a, pi)
    for x, y in zip(first, first[1:]):
        if x == y:
            continue
        al, be = [pi * e[x]], [np.ones(k)]
        for t in range(x + 1, y):
            v = (al[-1] @ a) * e[t]
            al.append(v / v.sum())
        for t in range(y - 1, x, -1):
            v = a @ (e[t] * be[-1])
            be.append(v / v.sum())
        p = np.array(al) * np.array(be[::-1])
        assert np.allclose(got[x:y], p / p.sum(1, keepdims=True))


def test_language_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.train(docs, crc_mod(F.col("doc_id"), 4) != 2)
    got = langid.predict(docs, model).where(crc_mod(F.col("doc_id"), 4) == 2).collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.95 and all(0 <= r.score <= 1 for r in got)
    odd = spark.createDataFrame([(1, None, "q"), (2, "", "q"), (3, "123 !!", "q"), (4, got[0].text * 40, "q")], "doc_id long, text string, score string")
    out = {r.doc_id: r for r in langid.predict(odd, model).collect()}
    assert [out[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and out[4].lang_pred == got[0].lang
    en, de = (next(r.text for r in got if r.lang == x) for x in ("en", "de"))
    mixed = spark.createDataFrame([(1, en[:300] + " " + de[:300])], "doc_id long, text string")
    labels = [w.lang for w in langid.word_labels(mixed, model).first().words]
    assert labels[:10].count("en") >= 8 and labels[-10:].count("de") >= 8


def test_posteriors_do_not_depend_on_the_window(monkeypatch):
    rng = np.random.default_rng(5)
    first = np.array([0, 3, 3, 170, 400])
    e, a, pi = rng.random((400, 4)) + 0.01, rng.random((4, 4)) + 0.1, rng.random(4) + 0.1
    want = langid.posteriors(e, first, a, pi)
    monkeypatch.setattr(langid, "TABLES", 64)  # windows of 100 words
    assert np.allclose(langid.posteriors(e, first, a, pi), want)


def test_seventy_languages_and_equal_posteriors(spark):
    r = random.Random(9)
    words = {k: [f"{chr(97 + k % 26)}{chr(97 + k // 26)}{r.choice('xyz')}{r.choice('aeiou')}{i}q".translate(str.maketrans("0123456789", "bcdfghjklm")) for i in range(12)] for k in range(70)}
    rows = [(10 * k + i, " ".join(r.choice(words[k]) for _ in range(60)), f"l{k:02}") for k in range(70) for i in range(6)]
    rows += [(9000, rows[0][1], None), (9000, rows[0][1], None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs, F.lit(True))
    assert len(model.languages) == 70 and len(model.hashed) * 70 <= langid.WEIGHTS
    got = langid.predict(docs, model).collect()
    assert np.mean([x.lang == x.lang_pred for x in got if x.lang]) > 0.95
    assert len({(x.lang_pred, x.score) for x in got if x.doc_id == 9000}) == 1
    assert langid.predict(docs.limit(0), model).count() == 0
    flat = langid.Model(["b", "c"], np.zeros((1024, 2)), langid.NameSet(np.zeros(0, np.uint64)), np.zeros((0, 2)), np.ones((2, 2)), np.ones(2))
    assert flat.classify(["some words"])[0] == ["b"]


def test_language_without_labels_is_und(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert langid.predict(docs, langid.train(docs, F.lit(True))).first().lang_pred == "und"


def examples(n):
    r = random.Random(4)
    clean = [f"w{k}" for k in range(400)]
    rows, labels = [], []
    for i in range(n):
        words = [r.choice(clean) for _ in range(r.choice([5, 60, 200]))]
        toxic = int(r.random() < 0.3)
        if toxic:
            for _ in range(max(1, len(words) // 40)):
                words[r.randrange(len(words))] = r.choice(["awful", "nasty", "vile"]) + r.choice(["", "ish"])
        rows.append((i, " ".join(words)))
        labels.append((i, toxic))
    return rows, labels


def test_nearest_examples_are_exact():
    rng = np.random.default_rng(1)
    n, v = 300, 40
    x = rng.random((n, v)) * (rng.random((n, v)) < 0.1)
    x = x[x.any(1)]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    own, feature = np.nonzero(x)
    order = np.argsort(feature, kind="stable")
    index = toxicity.Index(np.ones(v), np.arange(len(x)), np.zeros(len(x)), np.ones(len(x)), (feature[order], own[order], x[own, feature][order]))
    for q in x[:60]:
        f = np.flatnonzero(q)
        got, who = index.nearest(f, q[f], 10)
        want = np.sort(x @ q)[::-1]
        assert np.allclose(got, want[want > 0][:10]) and np.allclose(x[who] @ q, got)


def test_ties_at_the_kth_place_go_to_the_least_number():
    rng = np.random.default_rng(2)
    kinds = rng.random((6, 5)) * (rng.random((6, 5)) < 0.6) + np.eye(6, 5)
    x = kinds[rng.integers(0, 6, 400)]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    feature, own = np.nonzero(x.T)
    index = toxicity.Index(np.ones(5), np.arange(400), np.zeros(400), np.ones(400), (feature, own, x[own, feature]))
    for i in range(0, 400, 7):
        f = np.flatnonzero(x[i])
        _, who = index.nearest(f, x[i][f], 16, without=i)
        cos = x @ x[i]
        cos[i] = -1
        assert who.tolist() == np.lexsort((np.arange(400), -np.round(cos, 12)))[:16].tolist()


def plain_scores(model, docs, labels, learn):
    """The scores by dictionaries and a full comparison with all examples; terms and calibration are the model's."""
    import regex

    words = lambda t: regex.findall(r"[\p{L}\p{N}]+", (t or "").lower())
    known = {int(n): i for i, n in enumerate(model.vocabulary.known.names)}

    def features(t):
        w = words(t)
        spelled = list(w) + [(k, x[:k]) for x in w for k in toxicity.PREFIXES if len(x) > k]
        if not w:
            return {}
        name, _ = toxicity.base_terms(Words([" ".join(w)]))  # the words first, then their beginnings by length
        order = list(w) + [(k, x[:k]) for k in toxicity.PREFIXES for x in w if len(x) > k]
        assert len(order) == len(spelled) == len(name)
        count, number = {}, dict(zip(order, name.tolist()))
        for x in spelled:
            count[x] = count.get(x, 0) + 1
        out = {}
        for x, c in count.items():
            if number[x] in known:
                for b in range(toxicity.BANDS):
                    f = int(model.vocabulary.number[known[number[x]], b])
                    if f >= 0 and c / len(w) >= toxicity.RATES[b // 2] and c >= 1 + b % 2:
                        out[f] = 1 + np.log(c)
        return out

    every = [features(t) for _, t in docs]
    df = {}
    for x in every:
        for f in x:
            df[f] = df.get(f, 0) + 1

    def vector(x):
        v = {f: t * (np.log((1 + len(docs)) / (1 + df[f])) + 1) for f, t in x.items()}
        norm = np.sqrt(sum(y * y for y in v.values()))
        return {f: y / norm for f, y in v.items()}

    vectors = [vector(x) if x else {} for x in every]
    at = {d: i for i, (d, _) in enumerate(docs)}
    votes = dict(labels)
    rank = {int(d): k for k, d in enumerate(model.index.ids)}
    assert set(rank) == {d for d in votes if learn(d) and vectors[at[d]]}
    out = []
    for v in vectors:
        if not v:
            out.append((model.alone, []))
            continue
        cos = sorted((-round(c, 12), rank[d], d, c) for d in rank if (c := sum(x * vectors[at[d]].get(f, 0) for f, x in v.items())) > 0)[: toxicity.NEIGHBOURS]
        w = np.array([c * c for *_, c in cos])
        y = np.array([votes[d] for _, _, d, _ in cos])
        vote = (w @ y + 0.25 * model.prior) / (w.sum() + 0.25)  # all labels are examples here, so each stands for one
        out.append((model.calibrated(vote), [d for _, _, d, _ in cos]))
    return out


def test_scores_equal_a_full_comparison(spark):
    rows, labels = examples(240)
    rows += [(1000 + i, t) for i, (_, t) in enumerate(rows[:20])] + [(2000, ""), (2001, None), (2002, "awful nasty vile " * 30)]
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(docs, lab, crc_mod(F.col("doc_id"), 5) != 0)
    want = plain_scores(model, rows, labels, lambda d: zlib.crc32(str(d).encode()) % 5 != 0)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    for (d, _), (score, near) in zip(rows, want):
        assert np.isclose(got[d].score, score) and [e.doc_id for e in got[d].evidence] == near


def test_toxicity_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    lab = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert toxicity.score(docs.limit(0), toxicity.train(docs.limit(0), lab, F.lit(True))).count() == 0
    assert toxicity.score(docs, toxicity.train(docs, lab.limit(0), F.lit(True))).first().score == 0.0


def test_toxicity_learns_and_handles_odd_rows(spark):
    rows, labels = examples(400)
    docs = spark.createDataFrame([(i, t, 9) for i, t in rows] + [(1000, None, 1), (1001, "", 1), (5, rows[5][1], 1)], "doc_id long, text string, score long")
    lab = spark.createDataFrame([*labels, labels[5], (None, 1), (77777, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, lab, crc_mod(F.col("doc_id"), 5) != 0)
    got = [r for r in toxicity.score(docs, model).collect()]
    assert len(got) == 403
    truth = dict(labels)
    held = [(r.predicted, truth[r.doc_id]) for r in got if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert np.mean([a == b for a, b in held]) > 0.95
    assert all(r.predicted == 0 and r.evidence == [] for r in got if r.doc_id >= 1000)
    none = toxicity.train(docs, lab.where("toxic = 0"), F.lit(True))
    assert {r.score for r in toxicity.score(docs, none).collect()} == {0.0}


def test_quality_shrinks_sparse_sites(spark):
    r = random.Random(2)
    docs, labels = [], []
    for i in range(300):
        host = "big" if i < 200 else "mid" if i < 298 else "tiny"
        good = int(r.random() < (0.9 if host == "big" else 0.3 if host == "mid" else 0))
        docs.append((i, "plain words here. " * r.randint(1, 9) if good else "NOISE!! LOUD!! " * r.randint(1, 9), "en", host))
        labels.append((i, good))
    docs += [(900, None, None, None), (901, "", "en", "big")]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    got = {x.doc_id: x for x in quality.score(df, spark.createDataFrame(labels, "doc_id long, quality int"), F.col("doc_id") % 5 != 0).collect()}
    assert len(got) == 302 and all(0 <= x.score <= 1 for x in got.values())
    assert np.mean([got[i].predicted == y for i, y in labels if i % 5 == 0]) > 0.95
    assert got[0].p_path > got[250].p_path and 0.02 < got[299].p_path < 0.7


@pytest.mark.parametrize("n", [0, 3])
def test_quality_without_labels(spark, n):
    df = spark.createDataFrame([(i, "a", "en", "h") for i in range(n)], "doc_id long, text string, lang string, source string")
    assert quality.score(df, spark.createDataFrame([], "doc_id long, quality int"), F.lit(True)).count() == n


def test_a_toxic_word_of_few_of_many_examples_is_a_term(spark):
    plain = lambda i: f"the day {i % 7} was long and mild here"
    rows = [(i, plain(i) + (f" {zlib.crc32(str(i // 5).encode()):08x}" if i < 800 else "")) for i in range(1600)]  # a word has 5 of 800 toxic texts
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(i < 800)) for i, _ in rows], "doc_id long, toxic int")
    model = toxicity.train(docs, lab, F.col("doc_id") % 10 != 3)
    got = {r.doc_id: r for r in toxicity.score(docs.where("doc_id % 10 = 3"), model).collect()}
    assert model.vocabulary.size > 300  # by words and beginnings that only few texts have
    assert all(r.predicted == int(i < 800) and bool(r.evidence) == (i < 800) for i, r in got.items())


def test_quality_sites_equal_a_plain_shrinkage(spark):
    """Host and path posteriors recounted from the documents' own probabilities and labels."""
    r = random.Random(8)
    docs = [(i, r.choice(["plain words here. ", "NOISE!! LOUD!! "]) * r.randint(1, 5), r.choice(["en", "de"]), r.choice(["a", "a", "a", "b", "c"])) for i in range(200)]
    labels = {i: int(t.startswith("plain")) for i, t, _, _ in docs if i % 3}
    df = spark.createDataFrame([(*d, "extra") for d in docs], "doc_id long, text string, lang string, source string, score string")
    got = {x.doc_id: x for x in quality.score(df, spark.createDataFrame(list(labels.items()), "doc_id long, quality int"), F.col("doc_id") % 5 != 0).collect()}
    good, n = {}, {}
    for i, _, lang, host in docs:
        w, v = (1.0, float(labels[i])) if i in labels and i % 5 else (quality.WEIGHT_OF_GUESS, got[i].p_document)
        for key in ((), (host,), (host, lang)):
            good[key], n[key] = good.get(key, 0) + v * w, n.get(key, 0) + w
    mean = good[()] / n[()]

    def strength(level):
        own = [k for k in n if len(k) == level]
        return quality._moments(mean, len(own), sum(n[k] for k in own), sum(n[k] * (good[k] / n[k] - mean) ** 2 for k in own))

    for i, _, lang, host in docs:
        p_host = (good[host,] + strength(1) * mean) / (n[host,] + strength(1))
        p_path = (good[host, lang] + strength(2) * p_host) / (n[host, lang] + strength(2))
        assert np.isclose(got[i].p_host, p_host) and np.isclose(got[i].p_path, p_path)
