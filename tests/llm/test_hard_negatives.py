import math
import random

import numpy as np

from tidemark.llm import hard_negatives

SCHEMA = "vec_id long, label int, embedding array<float>, pool string, score long, low int, id string"


def mined_slowly(rows, every, positives=5, negatives=5):
    """Every anchor against every row with Python integers."""
    usable = []
    for vec_id, label, vec in dict.fromkeys((r[0], r[1], None if r[2] is None else tuple(r[2])) for r in rows):
        if vec_id is None or label is None or vec is None or any(x is None or not math.isfinite(x) for x in vec):
            continue
        usable.append((vec_id, label, [math.floor(256 * float(np.float32(x))) for x in vec]))
    out = []
    for a, label, q in usable:
        if a % every:
            continue
        near = [(sum(x * y for x, y in zip(q, v, strict=True)), b, other) for b, other, v in usable if b != a and len(v) == len(q)]
        first = sorted({(-s, b) for s, b, other in near if other == label})[:positives]
        for minus, p in first:
            fit = sorted({(-s, b) for s, b, other in near if other != label and -80 * minus <= 100 * s <= -100 * minus})[:negatives]
            out += [(a, p, k, n, -minus, -s) for k, (s, n) in enumerate(fit, 1)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "p", 1, 2, "i") for r in rows], SCHEMA)


def found(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def vectors(n=700, dim=12, clusters=9, seed=1):
    """Clusters of near vectors of very different lengths, ties, copies, and rows that take no part."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dim))
    rows = []
    for k in range(n):
        vec = (centres[k % clusters] + 0.2 * rng.normal(size=dim)) * float(10 ** rng.uniform(-2, 1))
        rows.append((k, 0 if k % 3 == 0 else int(rng.integers(1, 5)), vec.astype(np.float32).tolist()))
    rows += [(1000 + k, k % 3, rows[50][2]) for k in range(30)]  # ties
    rows += [(k, r[1], r[2]) for k, r in enumerate(rows[:20])]  # repeated rows
    rows += [(2000 + k, 1, [0.0] * dim) for k in range(8)] + [(2010, 2, [-0.0001] * dim), (2020, 2, [0.0] * dim)]
    rows += [(3000, 1, None), (3010, None, [1.0] * dim), (3020, 1, [float("nan")] * dim), (3030, 1, [float("inf")] + [0.0] * (dim - 1)), (3040, 2, [None] + [1.0] * (dim - 1))]
    rows += [(None, 1, [1.0] * dim), (4000, 7, [1.0] * 3), (4001, 8, [1.0] * 3), (4002, 7, [2.0] * 3), (4010, 1, [])]
    random.Random(3).shuffle(rows)
    return rows


def test_mined_equals_brute_force_over_many_small_blocks(spark):
    rows = vectors()
    df = frame(spark, rows)
    got = found(hard_negatives.mined(df, df.where("vec_id % 10 = 0"), block=64, side=16, focus=3))
    want = mined_slowly(rows, 10)
    assert got == want and len(want) > 500


def test_mined_equals_brute_force_in_one_block(spark):
    rows = vectors(200, 5, 4, seed=2)
    df = frame(spark, rows)
    assert found(hard_negatives.mined(df, df.where("vec_id % 20 = 0"))) == mined_slowly(rows, 20)


def test_empty_tables_give_no_rows(spark):
    empty, some = frame(spark, []), frame(spark, vectors(60))
    assert found(hard_negatives.mined(empty, empty)) == found(hard_negatives.mined(some, empty)) == found(hard_negatives.mined(some.where("label = 99"), some)) == []


def block_of(rows, labels=None):
    rows = np.asarray(rows, np.int64)
    codes = np.zeros(len(rows), np.int64) if labels is None else labels
    return hard_negatives.CoordinateLists(np.arange(len(rows)), codes, {"a": 0}, rows, np.sqrt((rows.astype(float) ** 2).sum(axis=1)))


def test_feasible_ranges_lose_no_row_and_prune_where_vectors_are_close():
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(6, 24))
    rows = np.floor(256 * (centre[rng.integers(0, 6, 3000)] + 0.1 * rng.normal(size=(3000, 24))) * rng.uniform(0.9, 1, (3000, 1)))
    block, pruned = block_of(rows), 0
    for q in rows[::100].astype(np.int64):
        score = block.scores(q, slice(None))
        assert (score == rows.astype(np.int64) @ q).all()
        for need in (1, int(np.sort(score)[-5]), int(np.sort(score)[-300]), int(score.max()), int(score.max()) * 2):
            among = block.candidates(q, need, 4)
            held = set() if among is None else set(np.arange(3000)[among].tolist())
            assert set(np.flatnonzero(score >= need).tolist()) <= held
            pruned += len(held) < 1200
    assert pruned > 60


def test_scores_beyond_doubles_are_whole_numbers():
    block = block_of([[(1 << 27) + 1, 3], [5, 7]])
    assert block.scores(np.array([(1 << 27) - 1, 1]), slice(None)).tolist() == [(1 << 54) - 1 + 3, 5 * ((1 << 27) - 1) + 7]


def test_rows_too_long_for_whole_scores_take_no_part(spark):
    df = frame(spark, [(1, 1, [1e30, 0.0]), (2, 1, [2.0 ** 20, 2.0 ** 20]), (3, 1, [1.5, -1.0])])
    assert [(r["id"], r["vec"], r["len2"]) for r in hard_negatives.integer_rows(df).collect()] == [(3, [384, -256], 384**2 + 256**2)]
