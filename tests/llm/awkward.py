"""Rows that every operator has to survive."""

import random

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, fp long, rank int, fingerprint_48 string, part int, cid string, sig binary, members array<int>, node long, "
    "key string, n int, host string, path string, h string, run int, p double, cell long, rid long, vector string, vote double, `a.b` string"
)
EXTRA = (7, 1, "x", 3, None, None, [1], 5, "k", 2, "h", "p", "l", 0, 0.5, 9, 4, "v", 0.1, "dot")
WORDS = "the of to and in that it is was for on are with as his they at be this from have or by one had not but what all were when we there can an your which their said if do will each about how up out them".split()


def prose(seed: int, n: int, words=WORDS) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(words) + str(r.randint(0, 9)) * (r.random() < 0.3) for _ in range(n))


def row(doc_id, text, lang="en", source="s1"):
    return (doc_id, text, lang, source, len(text) if text else None, *EXTRA)


def rows():
    long_ = prose(99, 60_000)
    a, b = prose(1, 120), prose(2, 90)
    return [
        row(1, a), row(2, a), row(2, a), row(None, a), row(None, None), row(3, None), row(4, ""), row(5, ""), row(6, "   \n\t "), row(7, "one"), row(8, "one"), row(9, "%%% *** !!"),
        row(10, long_), row(11, long_ + " more"), row(12, b, None, None), row(13, b + " tail", None, "s2"), row(14, "日本語 の テキスト です " * 20, "ja"), row(15, "x" * 200_000), row(16, prose(5, 300)), row(17, "\x00 nul \x01 ctl"),
    ]


def frame(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
