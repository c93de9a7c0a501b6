import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tests.llm.util import AWKWARD, SCHEMA, documents, prose, rows
from tidemark.llm import neighbours, simhash
from tidemark.session import stage


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    runs = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def slow_classes(prints, ids, radius=3):
    """Smallest id reachable over links, by search."""
    out = {}
    for start in sorted(set(prints)):
        if start in out:
            continue
        seen, todo = {start}, [start]
        while todo:
            at = todo.pop()
            for other in set(prints) - seen:
                if (at ^ other).bit_count() <= radius:
                    seen.add(other)
                    todo.append(other)
        known = [i for p, i in zip(prints, ids, strict=True) if p in seen and i is not None]
        out |= dict.fromkeys(seen, min(known) if known else None)
    return out


def near_rows():
    """Long texts in chains of small edits, so that classes hold several fingerprints."""
    out = []
    for k in range(8):
        words = prose(50 + k, 1500).split(" ")
        for step in range(5):
            words = words[:]
            words[100 * step + 3] = f"edit{step}"
            out.append((1000 - 10 * k - step, " ".join(words)) + ("en", "s", 0, 7, "l", "s", "c", "f", "u"))
    return out


def test_fingerprints_equal_the_definition():
    for text in [*AWKWARD, *[prose(k, 30 + k) for k in range(20)], "A b\x0bC\x1cd É"]:
        assert simhash.fingerprint(text) == slow_fingerprint(text)


def test_trees_lose_no_pair():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 1500, dtype=np.uint64)
    flips = np.bitwise_or.reduce([np.uint64(1) << rng.integers(0, 64, 1500).astype(np.uint64) for _ in range(3)])
    prints = np.unique(np.concatenate([base, base ^ flips, rng.integers(0, 1 << 63, 500, dtype=np.uint64) | np.uint64(1 << 63)]))
    for parts in (1, 2, 4):
        met = np.zeros((len(prints), len(prints)), bool)
        for k in range(parts):
            mask = ((1 << (64 * (k + 1) // parts)) - 1) ^ ((1 << (64 * k // parts)) - 1)
            row, leaf, home = simhash.fit_tree(prints[:400], mask, 3 // parts, 4, k).route(prints)
            assert np.bincount(row[home], minlength=len(prints)).tolist() == [1] * len(prints)
            for x in np.unique(leaf):
                met[np.ix_(row[home & (leaf == x)], row[leaf == x])] = True
        near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 3
        assert not (near & ~(met | met.T)).any()


def test_classes_equal_search_over_all_pairs(spark):
    docs = documents(spark).unionByName(spark.createDataFrame(near_rows(), SCHEMA))
    slim = stage(simhash.with_fingerprint(docs.select("doc_id", "text")).drop("text"))
    every = slim.collect()
    want = slow_classes([r.fingerprint % (1 << 64) for r in every], [r.doc_id for r in every])
    assert len(set(want.values())) < len(want)
    for how in ({}, {"shard": 4, "tile": 6, "parts": 2}, {"shard": 8, "parts": 1}):
        got = {r.fingerprint % (1 << 64): r.component_id for r in simhash.near_duplicates(slim, **how).collect()}
        assert got == want
    assert simhash.near_duplicates(slim.limit(0)).count() == 0


def test_chains_of_links_close(spark):
    order = list(range(1, 300))
    random.Random(2).shuffle(order)
    edges = spark.createDataFrame([(x + 1, x) for x in order] + [(5000, 4000), (4500, 4000)], "a long, b long")
    got = {r.node: r.root for r in simhash.classes(edges).collect()}
    assert got == {**{x: 1 for x in range(2, 301)}, 5000: 4000, 4500: 4000}


def test_one_document_of_each_class_stays(spark):
    docs = documents(spark).unionByName(spark.createDataFrame(near_rows(), SCHEMA))
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns
    every = [(r.doc_id, slow_fingerprint(r.text)) for r in docs.collect()]
    want = slow_classes([p for _, p in every], [i for i, _ in every])
    got = [(r.doc_id, want[slow_fingerprint(r.text)]) for r in kept.collect()]
    assert sorted(x for x, _ in got if x is not None) == sorted({v for v in want.values() if v is not None})
    assert all(a == b for a, b in got)
    nulls = spark.createDataFrame([(None, prose(1, 50)), (None, prose(1, 50)), (None, prose(2, 50))], "doc_id long, text string")
    assert simhash.deduplicated(nulls).count() == 2
    assert simhash.deduplicated(docs.limit(0)).count() == 0


def brute_neighbours(items, queries, k):
    out = {}
    for q, v in queries:
        scored = []
        for i, w in items:
            if i != q and len(w) == len(v):
                scored.append((-float(np.dot(v, w) / (np.linalg.norm(v) * np.linalg.norm(w))), i))
        best = {}
        for s, i in scored:
            best[i] = min(s, best.get(i, 9.0))
        out[q] = sorted((s, i) for i, s in best.items())[:k]
    return out


SHAPE = "vec_id long, embedding array<float>, label int, bucket string, dim string, score string"


def vectors(spark, n=900):
    rng = np.random.default_rng(7)
    rows_ = [(i, rng.normal(size=16).astype(np.float32).tolist()) for i in range(n)]
    rows_ += [(2000 + i, rows_[5][1]) for i in range(40)]  # copies
    odd = [(3000, None), (3001, [0.0] * 16), (3002, [float("nan")] + [1.0] * 15), (3003, [float("inf")] * 16), (3004, []), (None, [1.0] * 16), (3005, [1.0, 2.0]), (3006, [None] + [1.0] * 15)]
    return rows_, spark.createDataFrame([(*r, 0, "b", "d", "s") for r in rows_ + odd], SHAPE)


def test_neighbours_reach_brute_force(spark):
    rows_, df = vectors(spark)
    asked = df.where("vec_id % 20 = 0")
    got = {}
    for r in neighbours.nearest(df, asked, k=5, index_block=100, query_block=10).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = brute_neighbours(rows_, [r for r in rows_ if r[0] % 20 == 0], 5)
    assert set(got) == set(want)
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [r for r, _, _ in found] == [1, 2, 3, 4, 5]
        assert [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
        exact = {i: -s for s, i in brute_neighbours(rows_, [(q, dict(rows_)[q])], 10**6)[q]}
        assert all(abs(exact[i] - s) < 1e-12 for _, i, s in found)
        hits += len({i for _, i, _ in found} & {i for _, i in want[q]})
    assert hits >= 0.9 * 5 * len(want)
    ties = [i for _, i, _ in got[2000]] if 2000 in got else []
    assert ties[:5] == [5, 2001, 2002, 2003, 2004]


def test_few_candidates_are_all_returned(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [-1.0, 0.1]), (2, [0.0, -1.0]), (3, [1e300, 1e300]), (9, [1.0])], "vec_id long, embedding array<double>")
    got = neighbours.nearest(df, df.where("vec_id in (0, 9)")).orderBy("rank").collect()
    assert [(r.query_id, r.vec_id) for r in got] == [(0, 3), (0, 2), (0, 1)]
    assert abs(got[0].score - 0.5**0.5) < 1e-12
    assert neighbours.nearest(df.limit(0), df.limit(0)).count() == 0


def test_hadamard_turns_keep_angles():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(20, 48))
    for table in range(3):
        y = neighbours.turned(x, table)
        assert np.allclose(y @ y.T / y.shape[1] ** 3, x @ x.T)


def test_rows_of_the_fixture_have_all_cases():
    assert {r[1] for r in rows()} >= set(AWKWARD) and F.col("x") is not None
