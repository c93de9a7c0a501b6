"""Small documents with the awkward cases every operator must stand."""

import random
import zlib

SYLLABLES = "an be ci do el fi ga ho in ju ka lo mi no ou pe qui ro su ti un ve".split()


def prose(seed: int, words: int) -> str:
    rng = random.Random(seed)
    out = []
    for k in range(words):
        word = "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4)))
        out.append(word.capitalize() if k % 9 == 0 else word)
        if k % 9 == 8:
            out[-1] += rng.choice([".", ",", ".\n", "!"])
    return " ".join(out)


AWKWARD = [
    None, "", " ", "\n\n", "a", "a b", "one two three", "  lead and  double   spaces \n x", "tab\tand\rreturn\x0bcell\x0cfeed", "日本語 テスト。 É Étre naïve",
    "word " * 3000, "x" * 20_000, "same line\nsame line\nother\n\nsame line", "<|endoftext|> #*$%&|<> don't",
]

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, part int, length string, shard string, score string, fingerprint string, uid string"


def rows(n: int = 60) -> list[tuple]:
    """Awkward texts, prose, exact copies, a repeated row, a null id, and columns with clashing names."""
    texts = AWKWARD + [prose(k, 40 + 7 * k) for k in range(n)] + [prose(3, 61)] * 5
    out = [(k * 3 + 1, t, ["en", "de", None][k % 3], f"s{k % 4}" if k % 5 else None, 0) for k, t in enumerate(texts)]
    out += [out[20], out[20], (None, prose(900, 80), "en", "s1", 0), (None, None, None, None, None)]
    return [r + (7, "l", "s", "c", "f", "u") for r in out]


def documents(spark, n: int = 60):
    return spark.createDataFrame(rows(n), SCHEMA)


def crc(ids: list[int]) -> int:
    return zlib.crc32(b"".join(int(i).to_bytes(4, "little") for i in ids))
