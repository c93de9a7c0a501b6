import collections
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.util import AWKWARD, SCHEMA, crc, documents, prose, rows
from tidemark.llm import binary_tokens, packing, token_counts
from tidemark.llm.queries import vocabulary
from tidemark.llm.words import Encoder, ascii_words, text_slices
from tidemark.session import stage

BYTES, WORDS = "byte_bpe_50k.json", "word_bpe_49k.json"


def plain(name: str):
    t = Tokenizer.from_file(vocabulary(name))
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", [BYTES, WORDS])
def test_encoder_equals_the_library_on_whole_texts(name):
    rng = random.Random(4)
    texts = [*AWKWARD, *[prose(k, 200) for k in range(5)], *["".join(rng.choice(" \n\tab.É'1,ß") for _ in range(25)) for _ in range(800)]]
    enc, want = Encoder(vocabulary(name)), plain(name)
    for _ in range(2):  # the second time from memory
        starts, ids = enc.encode(pa.array(texts))
        assert all(ids[starts[i] : starts[i + 1]].tolist() == want(t) for i, t in enumerate(texts))
    assert enc.encode(pa.array([], pa.string()))[1].tolist() == []


def test_slices_hold_whole_texts():
    texts = pa.array(["a" * 5, "b" * 50, None, "c", "d" * 3])
    assert list(text_slices(texts, 10)) == [(0, 1), (1, 2), (2, 5)]
    coded = ascii_words(pa.array([" a b ", None, "b\ta"]))
    assert coded.counts.tolist() == [2, 0, 2] and [coded.distinct[int(c)].as_py() for c in coded.codes] == ["a", "b", "b", "a"]


def test_sum_of_squares_places_as_defined():
    rng = np.random.default_rng(2)
    lengths, limit = rng.integers(1, 30, 300), 40
    where, offset, fill = packing.sum_of_squares(lengths, limit)
    gaps: dict[int, int] = {}
    for i, size in enumerate(lengths.tolist()):
        def cost(state):
            n = collections.Counter(g for g in state.values() if g > 0)
            return sum(v * v for v in n.values())

        options = {}
        for seq, gap in gaps.items():
            if gap >= size:
                options[seq] = cost({**gaps, seq: gap - size})
        fresh = cost({**gaps, -1: limit - size})
        chosen = options.get(int(where[i]), fresh)
        assert chosen == min([*options.values(), fresh])
        assert offset[i] == limit - gaps.get(int(where[i]), limit)
        gaps[int(where[i])] = gaps.get(int(where[i]), limit) - size
    assert fill.max() <= limit and fill.sum() == lengths.sum()


def test_packing_holds_every_token_once(spark):
    docs = documents(spark)
    limit, encode = 256, plain(WORDS)
    pieces = stage(packing.pieces_of(docs, vocabulary(WORDS), limit=limit))
    out = packing.pack(pieces, limit=limit, group_rows=16).collect()
    want = collections.Counter()
    for r in rows():
        ids = [*encode(r[1]), 1]
        for k, at in enumerate(range(0, len(ids), limit)):
            part = ids[at : at + limit]
            want[(r[0], k, at, len(part), crc(part))] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    held = collections.defaultdict(list)
    for r in out:
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= limit
    assert len(held) <= 1.04 * sum(r.length for r in out) / limit + 1
    assert packing.pack_documents(docs.limit(0), vocabulary(WORDS)).count() == 0


def test_token_files_round_trip(spark, tmp_path):
    docs, encode = documents(spark), plain(BYTES)
    manifest = binary_tokens.write_token_files(docs.repartition(3), vocabulary(BYTES), folder=str(tmp_path / "out"))
    got = binary_tokens.read_token_files(manifest, with_ids=True).orderBy("start").collect()
    want = collections.Counter((r[0], tuple([*encode(r[1]), 0])) for r in rows())
    assert collections.Counter((r.doc_id, tuple(r.ids)) for r in got) == want
    at, last = 0, None
    for r in got:
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(r.ids), crc(r.ids))
        assert last is None or (r.doc_id is not None and r.doc_id >= last)
        at, last = at + r.n_tokens, r.doc_id if r.doc_id is not None else last
    shard = manifest.first()
    raw = np.fromfile(tmp_path / "out" / f"{shard.file}.bin", "<u2")
    assert len(raw) == shard.n_tokens
    assert binary_tokens.read_token_files(binary_tokens.write_token_files(docs.limit(0), vocabulary(BYTES))).count() == 0


def test_length_histogram_answers_any_limit(spark):
    docs, encode = documents(spark), plain(BYTES)
    sums = stage(token_counts.suffix_sums(token_counts.length_histogram(docs, vocabulary(BYTES), extra=1)))
    lengths = [len(encode(r[1])) + 1 for r in rows()]
    got = {r.n_tokens: r for r in sums.collect()}
    assert sorted(got) == sorted(set(lengths))
    for n, r in got.items():
        longer = [x for x in lengths if x > n]
        assert (r.n_docs, r.docs_longer, r.tokens_longer) == (lengths.count(n), len(longer), sum(longer))
        assert r.tokens_truncated == sum(min(x, n) for x in lengths) and r.tokens_within == sum(x for x in lengths if x <= n)
    for r in token_counts.at_limits(sums, [0, 7, 100, 10**9]).collect():
        assert (r["docs_over"], r.tokens_truncated, r.tokens_lost) == (
            sum(x > r["limit"] for x in lengths), sum(min(x, r["limit"]) for x in lengths), sum(max(0, x - r["limit"]) for x in lengths),
        )
    for r in token_counts.quantiles(sums, [0.01, 0.5, 1.0]).collect():
        assert r.n_tokens == min(n for n in lengths if sum(x <= n for x in lengths) >= r["share"] * len(lengths))
    empty = token_counts.suffix_sums(token_counts.length_histogram(spark.createDataFrame([], SCHEMA), vocabulary(BYTES)))
    assert empty.count() == 0
    assert sums.select(F.sum("n_docs")).first()[0] == len(lengths)
