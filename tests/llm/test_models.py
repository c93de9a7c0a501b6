import collections
import re

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.util import AWKWARD, SCHEMA, documents, prose, rows
from tidemark.llm import mixing, quality_model, quality_rules, toxicity
from tidemark.session import stage


def slow_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    runs = collections.Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    inside = {i + k for i in range(len(words) - 2) if runs[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return words, inside, lines


def junk(k: int) -> str:
    kinds = [lambda p: " ".join(w + "###" for w in p.split()), lambda p: p.upper().replace(" ", "!! "), lambda p: "again and again " * 40 + p[:20]]
    return kinds[k % 3](prose(700 + k, 80))


def labelled(spark, n=240, bad=lambda k: k % 3 == 0, worse=junk, column="quality"):
    texts = [worse(k) if bad(k) else prose(k, 60 + k % 90) for k in range(n)]
    docs = spark.createDataFrame([(k, t, "en", "s", 0, 7, "l", "s", "c", "f", "u") for k, t in enumerate(texts)], SCHEMA)
    value = (lambda k: int(not bad(k))) if column == "quality" else (lambda k: int(bad(k)))
    labels = spark.createDataFrame([(k, value(k)) for k in range(n)] + [(None, 1), (5, None), (10**6, 0)], f"doc_id long, {column} int")
    return docs, labels, {k: value(k) for k in range(n)}


def test_statistics_equal_slow_ones():
    texts = [*AWKWARD, prose(1, 90), junk(0), junk(1), junk(2)]
    got = quality_model.statistics(pa.array(texts))
    for row, text in zip(got, texts, strict=True):
        words, inside, lines = slow_statistics(text)
        figure = dict(zip(quality_model.STATISTICS, row, strict=True))
        n = max(1, len(words))
        assert np.isclose(figure["log_words"], np.log1p(len(words))) and np.isclose(figure["repeated"], len(inside) / n)
        assert np.isclose(figure["symbols"], len(re.findall(r"[#*$%&|<>]", text or "")) / n) and np.isclose(figure["distinct"], len(set(words)) / n)
        assert np.isclose(figure["same_lines"], (len(lines) - len(set(lines))) / max(1, len(lines)))
        assert np.isclose(figure["capitals"], sum(map(str.isupper, "".join(words))) / max(1, sum(map(len, words))))


def test_additive_model_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = quality_model.fit(x[:3000], y[:3000])
    assert {(i, j) for i, j, _ in model.pairs} >= {(0, 1)}
    assert ((model.score(x[3000:]) >= 0.5) == y[3000:]).mean() > 0.95
    alone = quality_model.fit(x[:3000], y[:3000], pairs=0)
    assert ((alone.score(x[3000:]) >= 0.5) == y[3000:]).mean() < 0.6
    flat = quality_model.fit(x, np.ones(4000))
    assert np.allclose(flat.score(x), 4001 / 4002) and np.allclose(quality_model.fit(x[:0], y[:0]).score(x), 0.5)


def test_quality_scores_held_out_documents(spark):
    docs, labels, truth = labelled(spark)
    model = quality_model.fit_on(docs, labels.where("doc_id % 2 = 0"))
    got = quality_model.with_score(docs, model).collect()
    right = [(r.score >= 0.5) == truth[r.doc_id] for r in got if r.doc_id % 2]
    assert np.mean(right) > 0.95
    kept = quality_model.with_score(docs, model, keep_from=0.5)
    assert kept.columns == docs.columns and kept.count() == sum(r.score >= 0.5 for r in got)
    odd = quality_model.with_score(documents(spark), model).collect()
    assert len(odd) == len(rows()) and all(0 <= float(r.score) <= 1 for r in odd)
    assert len({r.score for r in odd if r.text in (None, "")}) == 1
    assert quality_model.with_score(docs.limit(0), model).count() == 0
    unknown = quality_model.fit_on(docs, labels.limit(0))
    assert {r.score for r in quality_model.with_score(docs, unknown).collect()} == {0.5}


def insulting(k: int) -> str:
    words = prose(k, 60 + k % 90).split(" ")
    words[7], words[30] = ["scumbag", "wretchpig", "vilefool"][k % 3], ["wretchpig,", "vilefool", "scumbag."][k % 3]
    return " ".join(words)


def test_kneser_ney_is_a_distribution():
    """Probabilities over the letters after a context sum to one, in either class."""
    words, twice = ["abba", "abc", "bac", "cab"], np.array([[3, 1], [0, 2], [1, 0], [0, 4]])
    found = toxicity.run_counts(words, twice)
    runs = found["run"].tolist()
    assert sum(found["counts"][:, 0]) == 3 * 5 + 4 and "\x02abba"[:5] in runs
    pair = toxicity.fit_models(runs, found["counts"])
    assert pair.evidence(["abba"])[0] > 0 > pair.evidence(["cab"])[0]
    assert pair.evidence([]).tolist() == [] and toxicity.fit_models([], np.zeros((0, 2))).evidence(["x"]).tolist() == [0.0]


def test_toxicity_scores_held_out_documents(spark):
    docs, labels, truth = labelled(spark, 300, lambda k: k % 4 == 0, insulting, "toxic")
    model = toxicity.fit_on(docs, labels.where("doc_id % 2 = 0 or doc_id % 8 = 4"))
    got = toxicity.with_score(docs, model).collect()
    assert np.mean([(r.score >= 0.5) == truth[r.doc_id] for r in got if r.doc_id % 8 not in (0, 2, 4, 6)]) > 0.97
    assert np.mean([r.score >= 0.5 for r in got if truth[r.doc_id]]) > 0.9
    kept = toxicity.with_score(docs, model, keep_below=0.5)
    assert kept.columns == docs.columns and kept.count() == sum(r.score < 0.5 for r in got)
    odd = toxicity.with_score(documents(spark), model).collect()
    assert len(odd) == len(rows()) and all(0 <= float(r.score) <= 1 for r in odd)
    assert toxicity.with_score(docs.limit(0), model).count() == 0
    unknown = toxicity.fit_on(docs, labels.where("toxic = 0"))
    assert all(r.score < 0.5 for r in toxicity.with_score(docs, unknown).limit(5).collect())


def test_counted_statistics_equal_slow_ones(spark):
    docs = documents(spark).unionByName(spark.createDataFrame([(5000 + k, junk(k), None, None, 0, 7, "l", "s", "c", "f", "u") for k in range(6)], SCHEMA))
    got = collections.Counter(tuple(r) for r in quality_rules.counted(docs).select("doc_id", *quality_rules.BASE).collect())
    want = collections.Counter()
    for r in docs.select("doc_id", "text").collect():
        words, inside, lines = slow_statistics(r.text)
        want[(r.doc_id, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", r.text or "")), len(lines) - len(set(lines)), len(inside))] += 1
    assert got == want


def test_decision_list_rejects_what_it_learned(spark):
    docs, labels, truth = labelled(spark)
    stats = stage(quality_rules.counted(docs))
    rules = quality_rules.learn_from(stats, labels.where("doc_id % 4 < 3"))
    assert 1 <= len(rules.rules) <= quality_rules.MAX_RULES and str(rules)
    got = quality_rules.judged(stats, rules).collect()
    fresh = [r for r in got if r.doc_id % 4 == 3]
    assert np.mean([r["rule"] is None for r in fresh if truth[r.doc_id]]) > 0.95
    assert np.mean([r.kept for r in fresh if not truth[r.doc_id]]) < 0.1
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed and r["rule"] is None)
    plan = quality_rules.judged(stats, rules)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    assert quality_rules.learn_from(stats, labels.limit(0)).rules == ()
    assert quality_rules.judged(stage(quality_rules.counted(docs.limit(0))), rules).count() == 0


def rake(weights, targets, **how):
    """``rake_cells`` of an array with an axis per margin."""
    at, out = np.nonzero(weights > 0), np.zeros(weights.shape)
    out[at] = mixing.rake_cells(at, weights[at], targets, **how)
    return out


def test_raking_meets_all_margins():
    rng = np.random.default_rng(1)
    weights = rng.random((4, 3, 5)) * (rng.random((4, 3, 5)) > 0.1)
    weights[:2, :2, 0] += 0.1
    targets = [rng.random(n) for n in weights.shape]
    out = rake(weights, targets)
    for k, want in enumerate(targets):
        assert np.allclose(out.sum(axis=tuple(a for a in range(3) if a != k)), want / want.sum(), atol=1e-6)
    assert (out[weights == 0] == 0).all()
    odds = out[0, 0, 0] * out[1, 1, 0] / (out[0, 1, 0] * out[1, 0, 0])
    assert np.isclose(odds, weights[0, 0, 0] * weights[1, 1, 0] / (weights[0, 1, 0] * weights[1, 0, 0]))


def test_sample_follows_the_chances(spark):
    docs = documents(spark, 600)
    targets = {"source": {"s0": 1.0, "s1": 1.0, "s2": 2.0, "s3": 2.0}, "lang": 0.5, "topic": 1.0}
    got, mixture = mixing.with_chances(docs, targets, topics=3)
    assert got.drop(*[c for c in got.columns if c.startswith("_mix")]).columns == docs.columns
    every = got.collect()
    assert len(every) == len(rows(600))
    expected = collections.Counter()
    for r in every:
        assert r["_mix_tokens"] == len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        assert 0 <= r["_mix_draw"] < 1 and 0 <= r["_mix_chance"] <= 1
        expected[r.source] += r["_mix_tokens"] * r["_mix_chance"]
    share = {k: v / sum(expected.values()) for k, v in expected.items()}
    assert share.get(None, 0) == 0
    for name, want in targets["source"].items():
        assert share[name] == pytest.approx(want / 6, abs=0.02)
    kept = mixing.mixed(docs, targets, topics=3)
    assert sorted(map(str, kept.collect())) == sorted(str(r) for r in got.where("_mix_draw < _mix_chance").select(docs.columns).collect())
    assert mixing.mixed(docs.limit(0), targets).count() == 0


def test_margins_that_cells_cannot_carry_blow_up_nothing():
    """Topics of one language each: languages and topics cannot both be met, and no odd cell pays for it."""
    rng = np.random.default_rng(0)
    weights = rng.random((5, 4, 6))
    for lang in range(4):
        for topic in range(6):
            weights[:, lang, topic] *= 1.0 if topic % 4 == lang else 1e-4
    natural = weights / weights.sum()
    targets = [natural.sum(axis=tuple(a for a in range(3) if a != k)) ** 0.8 for k in range(3)]
    out = rake(weights, targets, bound=3.0)
    factor = out / natural
    assert 1 / 3 - 1e-9 <= factor.min() and factor.max() <= 3.0 + 1e-9 and out.sum() == pytest.approx(1, abs=0.01)
    chance = mixing.chances(factor, out)
    assert chance.max() == 1.0 and (chance * natural).sum() > 0.5
    for k, want in enumerate(targets):
        assert np.allclose(out.sum(axis=tuple(a for a in range(3) if a != k)), want / want.sum(), atol=0.08)
