import random

import numpy as np
import pyarrow as pa

from tests.llm.util import prose
from tidemark.llm import toxicity
from tidemark.llm.words import ascii_words, strings
from tidemark.session import stage


def foreign(seed, words):
    rng = random.Random(seed)
    return " ".join("".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(6)) for _ in range(words))


def test_every_letter_run_counts_for_itself(spark):
    """No two runs share an entry, and the shared model over tables is the one in memory."""
    texts = [prose(k, 60) for k in range(60)] + [foreign(k, 60) for k in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    sample = spark.createDataFrame([(k, k % 2, "curve" if k % 5 == 0 else "counts") for k in range(50)], "doc_id long, label int, part string")
    coded = ascii_words(pa.array(texts))
    words, weights = strings(coded.distinct), np.zeros((len(coded.distinct), 2), np.int64)
    for k in range(50):
        np.add.at(weights[:, 1 - k % 2], coded.codes[coded.starts[k] : coded.starts[k + 1]], 1)
    want = toxicity.run_counts(words, weights)
    found = stage(toxicity.count_runs(docs, sample))
    assert len(want["key"]) > 15_000 and found.count() == len(want["key"])
    rows = found.join(toxicity.shared_model(found).withColumnRenamed("run", "run0"), "run0").toArrow()
    whole = toxicity.fit_models(want["run"].tolist(), want["counts"])
    run, context = (rows.column(c).to_numpy().view(np.uint64) for c in ("run0", "context0"))
    counts = np.stack([rows.column(c).to_numpy() for c in toxicity.KINDS], axis=1)
    pair = toxicity.class_models(run, context, counts[:, :2] + counts[:, 2:4], rows.column("shared").to_numpy())
    assert np.allclose(pair.evidence(words), whole.evidence(words)) and np.abs(whole.evidence(words)).max() > 1


def test_class_quotas_do_not_shift_the_scores(spark):
    """Both classes cut to the same number: scores still stand for the share of toxic documents among all labelled."""
    rng = random.Random(3)
    texts, labels = [], []
    for k in range(1600):
        marked, toxic = rng.random() < 0.5, 0
        toxic = int(rng.random() < (0.2 if marked else 0.02))
        texts.append((k, prose(k, 30) + (" vilefool scumbag" if marked else "")))
        labels.append((k, toxic))
    docs, known = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    score = [r.score for r in toxicity.with_score(docs, toxicity.fit_on(docs, known, class_rows=150)).collect()]
    share = np.mean([t for _, t in labels])
    assert 0.05 < share < 0.2 and abs(np.mean(score) - share) < 0.08
    assert np.mean([s >= 0.5 for s in score]) < 0.1
