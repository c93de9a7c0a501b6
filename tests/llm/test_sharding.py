import collections
import zlib
from itertools import accumulate

import numpy as np
import pytest

from tests.llm.util import documents, prose, rows
from tidemark.llm import sharding
from tidemark.session import stage


def fewest(sizes, capacity):
    shards, held = 1, 0
    for s in sizes:
        if s > capacity:
            return 10**9
        shards, held = (shards, held + s) if held + s <= capacity else (shards + 1, s)
    return shards


def test_capacity_is_the_optimum():
    rng = np.random.default_rng(0)
    for _ in range(40):
        sizes = rng.integers(1, 50, rng.integers(1, 30)).tolist()
        shards = int(rng.integers(1, 8))
        ends = list(accumulate(sizes))
        best = next(c for c in range(1, sum(sizes) + 1) if fewest(sizes, c) <= shards)
        assert sharding.smallest_capacity(ends, shards) == best
        cut = sharding.cuts(ends, shards)
        assert len(cut) == shards and cut[-1] == ends[-1] and set(cut) <= set(ends)
        assert max(b - a for a, b in zip([0, *cut], cut)) == best or max(b - a for a, b in zip([0, *cut], cut)) < best + 1
    assert sharding.cuts([], 3) == [0, 0, 0]


def check(got, want_rows, shards):
    assert collections.Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == collections.Counter(
        (i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in want_rows
    )
    slots, homes, sizes = collections.defaultdict(list), collections.defaultdict(set), collections.Counter()
    for r in got:
        slots[r.shard].append(r.slot)
        homes[r.text_crc32].add(r.shard)
        sizes[r.shard] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(h) == 1 for h in homes.values()) and set(slots) <= set(range(shards))
    return sizes


def test_documents_in_shards(spark):
    want = [(r[0], r[1]) for r in rows(300)]
    sizes = check(sharding.shard_documents(documents(spark, 300), shards=5).collect(), want, 5)
    assert max(sizes.values()) < 1.1 * sum(sizes.values()) / 5
    few = check(sharding.shard_documents(documents(spark, 300), shards=5, resolution=8).collect(), want, 5)
    assert max(few.values()) == max(sizes.values())
    assert sharding.shard_documents(documents(spark).limit(0)).count() == 0


def test_a_group_with_a_third_of_all_bytes(spark):
    texts = [(k, prose(k, 50)) for k in range(200)] + [(1000 + k, prose(1, 50)) for k in range(100)] + [(None, None)] * 3
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    sizes = check(sharding.shard_documents(docs, shards=8).collect(), texts, 8)
    hot = max(sizes, key=sizes.get)
    rest = [v for k, v in sizes.items() if k != hot]
    assert len(rest) == 7 and max(rest) < 1.15 * min(rest)
    plan = sharding.shard_documents(docs, shards=8)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("resolution", [8, 500])
def test_known_ends_are_enough_at_any_resolution(spark, resolution):
    """Some ends, looked at closer where borders may fall, give the optimum of all ends."""
    rng = np.random.default_rng(resolution)
    for sizes, shards in ((rng.integers(1, 2000, 4000), 7), (rng.integers(1, 2000, 6000) * (rng.random(6000) > 0.02) + 1, 24), (np.append(rng.integers(1, 9, 500), 700), 3), (np.ones(40, int), 24)):
        ends = [int(e) for e in np.cumsum(sizes)]
        table = stage(spark.createDataFrame([(e, int(b)) for e, b in zip(ends, sizes, strict=True)], "end long, bytes long"))
        known = sharding.known_ends(table, shards, resolution)
        assert set(known) <= set(ends)
        assert sharding.smallest_capacity(known, shards) == sharding.smallest_capacity(ends, shards)
    few = sharding.known_ends(table.where("false"), 3, resolution)
    assert few == []


def test_few_of_many_ends_reach_the_driver(spark):
    sizes = np.random.default_rng(1).integers(1, 5000, 60_000)
    ends = [int(e) for e in np.cumsum(sizes)]
    table = stage(spark.createDataFrame([(e, int(b)) for e, b in zip(ends, sizes, strict=True)], "end long, bytes long"))
    known = sharding.known_ends(table, 24, 1024)
    assert len(known) < 10_000 and sharding.smallest_capacity(known, 24) == sharding.smallest_capacity(ends, 24)
