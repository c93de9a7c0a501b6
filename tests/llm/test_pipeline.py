import collections

import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from tests.llm.test_models import insulting, junk
from tests.llm.test_similar import slow_classes, slow_fingerprint
from tests.llm.util import AWKWARD, crc, prose
from tidemark.llm.queries import vocabulary

CASES = {"junk": junk, "toxic": insulting}


def corpus() -> dict[int, tuple[str, str | None]]:
    """doc_id -> (what it is, text)."""
    out = {}
    for k in range(420):
        kind = "junk" if k % 6 == 0 else "toxic" if k % 6 == 1 else "clean"
        out[k] = (kind, CASES.get(kind, lambda i: prose(i, 60 + i % 200))(k))
    for k in range(2, 40, 6):
        out[1000 + k] = ("copy", out[k][1])
    return out


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder, docs = str(tmp_path_factory.mktemp("tables")), corpus()
    rows = [(k, t, ["en", "de", "fr"][k % 3], f"src{min(3, k % 7)}", len(t)) for k, (_, t) in docs.items()]
    rows += [(5000 + k, t, None, None, None) for k, t in enumerate(AWKWARD)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = [(k, int(kind != "junk"), int(kind == "toxic")) for k, (kind, _) in docs.items() if k % 4]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_stages_do_what_they_say(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns, kinds = docs.columns, {k: kind for k, (kind, _) in corpus().items()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    held = {}
    for k, (name, stage_of) in enumerate(corpus_pipeline.STAGES):
        out = stage_of(spark, docs, tables)
        out.write.parquet(f"{tables}/stage-{k}")
        docs = spark.read.parquet(f"{tables}/stage-{k}")
        held[name] = docs.collect()
        if k < 4:
            assert docs.columns == columns
            assert all(texts[r.doc_id] == r.text for r in held[name])
    ids = {name: {r.doc_id for r in rows} for name, rows in held.items()}
    kind = lambda name, what: [i for i in ids[name] if kinds.get(i) == what]
    assert len(kind("quality", "junk")) <= 3 and len(kind("quality", "clean")) >= 275
    assert ids["toxicity"] < ids["quality"] and len(kind("toxicity", "toxic")) <= 5 and len(kind("toxicity", "clean")) >= 275
    left = sorted(ids["toxicity"])
    want = slow_classes([slow_fingerprint(texts[i]) for i in left], left)
    assert ids["near_duplicates"] == set(want.values()) and not kind("near_duplicates", "copy")
    assert ids["mixture"] <= ids["near_duplicates"]
    encode = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    tokens = {i: [*encode.encode(texts[i] or "", add_special_tokens=False).ids, 1] for i in ids["mixture"]}
    assert collections.Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in held["packing"]) == collections.Counter(
        (i, a, len(ids_[a : a + 4096]), crc(ids_[a : a + 4096])) for i, ids_ in tokens.items() for a in range(0, len(ids_), 4096)
    )
    whole = corpus_pipeline.run(spark, tables)
    digest = lambda rows: sorted((r.doc_id, r.piece, r.ids_crc32) for r in rows)
    assert digest(whole.collect()) == digest(held["packing"])


CONTRACTS = {
    "op1": "doc_id piece start length ids_crc32 sequence_id offset", "op3": "query_id rank vec_id score", "op4": "doc_id held_out score predicted",
    "op5": "doc_id start n_tokens ids_crc32", "op6": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op11": "anchor_id positive_id rank negative_id positive_score negative_score", "op12": "doc_id n_features weight score rank",
    "op13": "doc_id n_words n_base first_word last_word base_labels labels score", "op7": "doc_id fingerprint component_id", "op8": "doc_id size text_crc32 law shard slot grown_shard", "op9": "doc_id held_out score predicted",
}


def test_registered_queries_return_their_columns(spark):
    queries = entry.queries()
    assert "pipeline" in queries and sorted(int(n[2:].split("_")[0]) for n in queries if n.startswith("op") and n[2].isdigit()) == list(range(1, 14))
    for name in ("op5_binary_tokens", "op7_simhash", "op8_sharding"):
        found = queries[name](spark, "/root/testdata/sf0.001")
        assert set(CONTRACTS[name[:3]].split()) <= set(found.columns)
        assert found.count() == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
