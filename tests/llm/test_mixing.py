import collections
import random

import pytest

from tests.llm.util import prose
from tidemark.llm import mixing


def expected_shares(rows, column):
    held = collections.Counter()
    for r in rows:
        held[r[column]] += r["_mix_tokens"] * r["_mix_chance"]
    return {k: v / sum(held.values()) for k, v in held.items()}


def test_small_sources_are_raked_by_themselves(spark):
    """A source of 0.2 % of the tokens with a target of its own, and hundreds that an exponent sets apart."""
    rows = [(k, prose(k % 5, 100), "en", "tiny" if k < 2 else f"s{k % 2}") for k in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got, _ = mixing.with_chances(docs, {"source": {"tiny": 0.005, "s0": 0.4, "s1": 0.595}, "lang": 1.0, "topic": 1.0}, topics=1)
    got = got.collect()
    assert all(r["_mix_chance"] > 0 for r in got)
    share = expected_shares(got, "source")
    # Its few documents are taken whole (SHORT), the others share the rest as asked.
    assert {r["_mix_chance"] for r in got if r.source == "tiny"} == {1.0} and share["tiny"] > 0.002
    assert share["s1"] / share["s0"] == pytest.approx(0.595 / 0.4, rel=0.01)

    rows = [(k, prose(1, 100), "en", f"s{k % 300 if k < 900 else k % 100}") for k in range(1100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got, _ = mixing.with_chances(docs, {"source": 0.0, "lang": 1.0, "topic": 1.0}, topics=1)
    share = expected_shares(got.collect(), "source")
    assert len(share) == 300 and max(share.values()) == pytest.approx(1 / 300, rel=0.01) and min(share.values()) == pytest.approx(1 / 300, rel=0.01)


@pytest.mark.parametrize("lang", [1.0, {"en": 0.5, "de": 0.5}])
def test_targets_far_from_the_natural_shares_are_met(spark, lang):
    """5 % to 25 % and 60 % to 10 %: no fixed multiple of the natural share stands in the way."""
    source = lambda k: "rare" if k % 20 == 0 else "common" if k % 20 < 13 else "other"
    docs = spark.createDataFrame([(k, prose(1, 80), "de" if k % 3 else "en", source(k)) for k in range(1200)], "doc_id long, text string, lang string, source string")
    targets = {"source": {"rare": 0.25, "common": 0.1, "other": 0.65}, "lang": lang, "topic": 1.0}
    got, mixture = mixing.with_chances(docs, targets, topics=1)
    share = expected_shares(got.collect(), "source")
    for name, want in targets["source"].items():
        assert share[name] == pytest.approx(want, abs=0.005)
        at = mixture.names[0].index(name)
        assert mixture.wanted[0][at] == pytest.approx(want) and mixture.reached[0][at] == pytest.approx(share[name])


def topical(k, topic, words=120):
    """A text of a topic's own forty words."""
    rng = random.Random(k)
    return " ".join(f"t{topic}w{rng.randrange(40)}" for _ in range(words))


def test_topics_come_from_all_distinct_texts_with_one_vote_each(spark):
    """Thousands of copies of one text pull no centre away, and a topic of 1 in 40 texts gets one of its own."""
    rows = [(k, topical(k, k % 3), "en", "s") for k in range(800)] + [(5000 + k, topical(90_000, 0), "en", "s") for k in range(2000)]
    rows += [(9000 + k, topical(7000 + k, "rare"), "en", "s") for k in range(20)] + [(9900, None, "en", "s"), (9901, "", "en", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(5)
    got, _ = mixing.with_chances(docs, {"source": 1.0, "lang": 1.0, "topic": 1.0}, topics=4)
    found = collections.defaultdict(set)
    for r in got.collect():
        if r.text:
            found["rare" if "trare" in r.text else r.text[:2]].add(r["_mix_topic"])
    assert len(found) == 4 and all(len(t) == 1 for t in found.values())
    assert len(set.union(*found.values())) == 4


def test_centres_do_not_depend_on_partitions(spark):
    rows = [(k, topical(k, k % 5, 30), "en", "s") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    one, many = (mixing.with_chances(docs.repartition(n), {"source": 1.0, "lang": 1.0, "topic": 1.0}, topics=5)[0].collect() for n in (1, 7))
    assert {r.doc_id: r["_mix_topic"] for r in one} == {r.doc_id: r["_mix_topic"] for r in many}


def test_columns_that_begin_with_mix_stay(spark):
    docs = spark.createDataFrame([(k, prose(k, 30), "en", "s", k, "x") for k in range(30)], "doc_id long, text string, lang string, source string, _mix_tokens long, _MIX_topic string")
    kept = mixing.mixed(docs, {"source": 1.0, "lang": 1.0, "topic": 1.0}, topics=2)
    assert kept.columns == docs.columns and all(r["_mix_tokens"] == r.doc_id and r["_MIX_topic"] == "x" for r in kept.collect()) and kept.count() > 10
