import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.util import AWKWARD, SCHEMA, documents, prose, rows
from tidemark.llm import resampling
from tidemark.llm.bytewords import Ranges, layout


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def features(text, longest=3):
    w = words(text)
    return [" ".join(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1)]


def resampled_slowly(docs, target, buckets=10_000, min_words=20, share=(5, 100)):
    counts = lambda texts: Counter(zlib.crc32(f.encode()) % buckets for t in texts for f in features(t))
    s, t = counts([x for _, x in docs]), counts(target)
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log(((t[b] + 1) * (total_s + buckets)) / ((s[b] + 1) * (total_t + buckets)))) for b in range(buckets)]
    out = []
    for doc_id, text in docs:
        own = features(text)
        weight = sum(gain[zlib.crc32(f.encode()) % buckets] for f in own)
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc_id, len(words(text)), len(own), weight, score, None])
    fit = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for k, r in enumerate(fit[: share[0] * len(fit) // share[1]], 1):
        r[5] = k
    return sorted(map(tuple, out), key=str)


@given(st.lists(st.one_of(st.none(), st.text(max_size=80)), max_size=12))
@settings(max_examples=60, deadline=None)
def test_words_of_any_texts_equal_the_definition(texts):
    found = layout(pa.array(texts, pa.string()))
    for i, text in enumerate(texts):
        own = slice(found.first[i], found.first[i + 1])
        assert [found.data[a:b].tobytes().decode() for a, b in zip(found.start[own], found.stop[own], strict=True)] == words(text)


def test_words_of_a_slice_of_an_array():
    texts = pa.array(["skip this", None, "Keep THIS, 日本", "", "and that", "not this"]).slice(1, 4)
    found = layout(texts)
    assert found.counts.tolist() == [0, 3, 0, 2] and found.owner().tolist() == [1, 1, 1, 3, 3]


def test_hashes_of_ranges_equal_the_libraries():
    data = np.random.default_rng(3).integers(0, 256, 5000, np.uint8)
    size = np.array([*range(1, 300), 1000, 2500])
    start = np.arange(len(size)) * 7
    ranges = Ranges(data)
    parts = [data[a : a + n].tobytes() for a, n in zip(start, size, strict=True)]
    assert ranges.xxh64(start, size, 9).tolist() == [xxhash.xxh64_intdigest(p, 9) for p in parts]
    assert ranges.crc32(start, size).tolist() == [zlib.crc32(p) for p in parts]


def test_colliding_keys_are_told_apart_by_their_bytes():
    words_ = layout(pa.array(["aa bb aa cc bb dd aaaaaaaaaaaaaaaaaab aaaaaaaaaaaaaaaaaac aaaaaaaaaaaaaaaaaab"]))
    size = words_.stop - words_.start
    slot, owner = resampling.slots(words_.ranges, words_.start, size, np.full(len(size), 5, np.uint64))
    texts = [words_.data[a:b].tobytes() for a, b in zip(words_.start, words_.stop, strict=True)]
    assert len(set(slot.tolist())) == len(set(texts)) == (owner >= 0).sum()
    assert all((slot[i] == slot[j]) == (a == b) for i, a in enumerate(texts) for j, b in enumerate(texts))


@pytest.mark.parametrize("table_words", [3, 1 << 15])
def test_tables_cut_anywhere_count_every_feature_once(monkeypatch, table_words):
    monkeypatch.setattr(resampling, "TABLE_WORDS", table_words)
    texts = AWKWARD[:9] + [prose(4, 60)]
    found, total = layout(pa.array(texts)), np.zeros(97, np.int64)
    for _, _, table in resampling.tables(found, buckets=97):
        total += table.bucket_totals(97)
    want = Counter(zlib.crc32(f.encode()) % 97 for t in texts for f in features(t))
    assert total.tolist() == [want[b] for b in range(97)]


def found(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()), key=str)


def test_resampled_equals_brute_force_with_awkward_rows(spark):
    docs, target = documents(spark, 90), [prose(k, 50) for k in (3, 8, 700)] + [None, "", "x" * 4000]
    got = found(resampling.resampled(docs, spark.createDataFrame([(t, 1) for t in target], "text string, doc_id int"), share=(40, 100)))
    assert got == resampled_slowly([r[:2] for r in rows(90)], target, share=(40, 100))


def test_few_buckets_and_other_lengths_of_runs(spark):
    docs = [(k, prose(k % 5, 19 + k % 4)) for k in range(60)]
    got = found(resampling.resampled(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([("an an be",)], "text string"), buckets=11))
    assert got == resampled_slowly(docs, ["an an be"], buckets=11)


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert found(resampling.resampled(none, none)) == []
    docs = [(1, prose(1, 30)), (2, None)]
    assert found(resampling.resampled(spark.createDataFrame(docs, "doc_id long, text string"), none)) == resampled_slowly(docs, [])


def test_registered_query_draws_by_the_contract(spark, tmp_path):
    docs = [(k, prose(k, 15 + k % 30)) for k in range(200)]
    target = [prose(k, 40) for k in range(5)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(t,) for t in target], "text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    from tidemark.llm.queries import queries

    got = sorted((tuple(r) for r in queries()["op12_resampling"](spark, str(tmp_path)).collect()), key=str)
    assert got == sorted(((r[0], *r[2:]) for r in resampled_slowly(docs, target)), key=str)
