import re

import pyarrow as pa
import pytest

from tests.llm.util import documents, prose, rows
from tidemark.llm import licenses
from tidemark.llm.license_texts import PHRASES, WORDINGS


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def pattern_of(wording):
    """The wording as a regular expression over words that each end with a space."""
    out = []
    for part in re.split(r"(<<[^>]*>>)", wording):
        if part == "<<beginOptional>>":
            out.append("(?:")
        elif part == "<<endOptional>>":
            out.append(")?")
        elif part.startswith("<<var"):
            out.append(r"(?:[^ ]+ ){%s}" % re.search(r"match=(\d+,\d+)", part)[1])
        else:
            out += [re.escape(w) + " " for w in words(part)]
    return re.compile("(?:^|(?<= ))" + "".join(out))


PATTERNS = [(label, pattern_of(wording)) for label, wording in WORDINGS]


def scanned_slowly(text):
    w = words(text)
    base = [(i, label) for phrase, label in PHRASES.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    flat = "".join(x + " " for x in w)
    matched = {label for label, p in PATTERNS if p.search(flat)}
    names = {label for _, label in base}
    at = [i for i, _ in base]
    return (len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(names)), ",".join(sorted(names | matched)), 1.0 if matched else 0.5 if at else 0.0)


def plain(wording, fill="some name"):
    """A text of the wording with its optional parts and ``fill`` in its replaceable ones."""
    return re.sub(r"<<(?:begin|end)Optional>>", "", re.sub(r"<<var[^>]*>>", fill, wording))


def without_optional(wording):
    while (cut := re.sub(r"<<beginOptional>>(?:(?!<<beginOptional>>).)*?<<endOptional>>", "", wording, flags=re.S)) != wording:
        wording = cut
    return re.sub(r"<<var[^>]*>>", "anything", wording)


def licence_texts():
    out = []
    for k, (_, wording) in enumerate(WORDINGS):
        whole, short = plain(wording, "some"), without_optional(wording)
        broken = words(whole)
        broken[len(broken) // 2] = "wrong"
        out += [whole, short, f"{prose(k, 30)}\n{whole.upper()}\n{prose(k + 1, 20)}", " ".join(broken), whole.rsplit(None, 1)[0], f"{short} {short}"]
    out += ["mit license mit license", "MIT-License", "the general public", "apache", "general public license general public license apache license", "mit, licensed"]
    out += ["licensed under the licensed under the MIT License", "Licensed under CC BY-NC 4.0.", "licensed under cc by nc sa 4.0", "License: see mit license" + " x" * 5000]
    return out


def spans_of(scan, text):
    found = licenses.layout(pa.array([text]))
    return scan.spans(scan.numbers(found), found.last)


def test_every_wording_accepts_itself_and_no_changed_mandatory_word():
    for label, wording in WORDINGS:
        scan = licenses.Scan.of({}, [(label, wording)])
        for text in (plain(wording, "some"), without_optional(wording)):
            assert spans_of(scan, text)[0][1] == 0, (label, text)
        short = words(without_optional(wording))
        for k in range(len(short)):
            changed = " ".join([*short[:k], "wrong", *short[k + 1 :]])
            assert bool(spans_of(scan, changed)) == (short[k] == "anything"), (label, changed)


@pytest.mark.parametrize("wording", ["<<var;name=x;match=0,3>> licensed", "", "<<beginOptional>>all<<endOptional>>", "a <<beginOptional>> b"])
def test_wordings_that_cannot_be_searched_are_refused(wording):
    with pytest.raises(ValueError):
        licenses.compiled("x", wording)


def figures(df):
    return sorted((tuple(r) for r in df.select("doc_id", *licenses.COLUMNS.names).collect()), key=str)


def test_licenses_equal_regular_expressions_over_whole_texts(spark):
    texts = licence_texts()
    data = [(k, t) for k, t in enumerate(texts)] + [r[:2] for r in rows(20)] + [(7, texts[0]), (None, texts[1])]
    df = spark.createDataFrame([(a, b, "c", 5) for a, b in data], "doc_id long, text string, labels string, n_words int")
    out = licenses.with_licenses(df)
    assert out.columns == ["doc_id", "text", *licenses.COLUMNS.names]
    want = sorted(((a, *scanned_slowly(b)) for a, b in data), key=str)
    assert figures(out) == want
    assert {label for r in want for label in r[6].split(",") if label} >= {label for label, _ in WORDINGS}


def test_awkward_rows_keep_their_columns(spark):
    docs = documents(spark, 5)
    out = licenses.with_licenses(docs)
    assert out.count() == docs.count() and set(docs.columns) <= set(out.columns)
    assert licenses.with_licenses(docs.limit(0)).collect() == []


def test_spans_hold_the_longest_match_in_every_text(spark):
    df = spark.createDataFrame([(1, "x Licensed under the MIT License. y"), (2, None), (3, "licensed under the terms of the GNU General Public License 3"), (3, "no")], "doc_id long, text string")
    got = sorted(tuple(r) for r in licenses.license_spans(df).collect())
    assert got == [(1, "mit", 1, 6, "licensed under the mit license"), (3, "gpl-3.0", 0, 11, "licensed under the terms of the gnu general public license 3")]


def test_skips_nest_and_regions_have_bounds():
    scan = licenses.Scan.of({}, [("l", "a <<beginOptional>>b <<beginOptional>>c<<endOptional>> d<<endOptional>> e <<var;name=x;match=1,2>> f")])
    for text, yes in {"a e x f": 1, "a b d e x f": 1, "a b c d e x y f": 1, "a b c e x f": 0, "a e f": 0, "a e x y z f": 0, "a e f f": 1, "a c d e x f": 0}.items():
        assert bool(spans_of(scan, text)) == bool(yes), text
