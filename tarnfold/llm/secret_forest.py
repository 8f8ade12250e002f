"""Secret scans: candidates from every text, and a random forest that removes false positives.

1. A candidate is a run of at least MIN_LENGTH characters of A-Z, a-z, 0-9, + / _ - = (a dot inside counts as well) with a letter and a digit in it, or with
   capitals and small letters mixed inside, or a key's header line ("-----BEGIN ... KEY-----"), or whatever stands after a name such as password or token and a sign of
   assignment, from MIN_ASKED bytes on: up to the closing quote (on the line, at most 512 bytes), or to the next blank, quote, comma or semicolon.
2. Features: length and character shares; transitions, as changes of character class and as mean surprise under the letter pairs of the dictionary;
   the share that dictionary words cover; what the path says; the words and signs before and after.
3. The dictionary is made of the words that occur in most documents, counted over all of them.
4. A forest of gini trees is fitted on labelled findings (value, before, after, path, label). Without a table of these, labelled_findings makes one by a seed: keys,
   tokens and passwords in their surroundings against digests, ids, versions, file names, placeholders and long words in theirs.

Scanning is one pass without a shuffle; what is broadcast, the forest and max_words words, is of bounded size.

Defined results: null and empty texts have no candidates. A run is judged whole, of any length; of runs that repeat, each is a finding. Null paths count as empty. Null ids and
repeated rows are scanned like all others. Other columns are ignored. Empty tables give empty results. Ties of the vote (0.5) are secrets. The value itself is not returned but
its SHA-256.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .text_kernel import Words, buffers, slices

MIN_LENGTH = 16
MAX_WORDS = 20_000
LABELLED = 6000
TREES = 48
DEPTH = 10
LEAST_LEAF = 3
FEATURES_A_SPLIT = 6
SECRET_FROM = 0.5
SEED = 20240919
MIN_ASKED = 8
_NEAR = 48
_HEADER = re.compile(rb"-----BEGIN (?:[A-Z0-9]+ )*(?:PRIVATE|SECRET) KEY(?: BLOCK)?-----")
_NAMED = re.compile(rb"(?i)(?:key|token|secret|passwd|password|pwd|passphrase|credential|bearer|authorization)s?[\"']?[ \t]{0,4}[:=][ \t]{0,4}(?:\"([^\"\r\n]{8,512})\"|'([^'\r\n]{8,512})'|([^\s\"'`,;]{7,}[^\s\"'`,;.]))")
_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(48, 58), *range(65, 91), *range(97, 123), *b"+/_-=."]] = True
_ASKED = re.compile(r"(?i)(?:api|access|auth|private|client|signing|encryption|session|master|service)?[_\-. ]?(?:key|token|secret|passwd|password|pwd|passphrase|credential|bearer|authorization)s?\b")
_HARMLESS = re.compile(r"(?i)\b(?:sha\d*|md5|commit|checksum|digest|hash|etag|uuid|guid|version|revision|build|example|sample|test|dummy|placeholder|fake|integrity|file|image|id|ref|blob)\b")
_PREFIX = re.compile(r"^(?:AKIA|ASIA|gh[pousr]_|sk[-_]|pk[-_]|rk[-_]|xox[abprs]-|eyJ|AIza|ya29|glpat-|SG\.|npm_|-----BEGIN)")
_TEST_PATH = re.compile(r"(?i)(?:^|[/._-])(?:tests?|examples?|samples?|docs?|fixtures?|mocks?|vendor|readme|lock)(?:$|[/._-])")
_KEY_PATH = re.compile(r"(?i)(?:^|[/._-])(?:env|conf(?:ig)?|settings|secrets?|credentials?|prod(?:uction)?|deploy|ya?ml|ini|properties|tfvars)(?:$|[/._-])")


def candidates(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, first byte, last byte + 1) of every candidate, bytes counted in the column's buffer."""
    raw, offsets = buffers(column)
    if not len(raw):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = _INSIDE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[1:-1] = inside[1:] != inside[:-1]
    edge[offsets] = True
    cuts = np.flatnonzero(edge)
    starts, ends = cuts[:-1], cuts[1:]
    ok = inside[starts] & (ends - starts >= MIN_LENGTH)
    starts, ends = starts[ok], ends[ok]
    # punctuation around a run is not part of it
    for sign in b".-=/+_":
        while len(starts):
            trim = (raw[starts] == sign) & (ends - starts > 1)
            if sign == ord("=") or not trim.any():
                break
            starts = starts + trim
    while len(ends):
        trim = (raw[ends - 1] == ord(".")) | (raw[ends - 1] == ord("-"))
        if not (trim & (ends - starts > 1)).any():
            break
        ends = ends - (trim & (ends - starts > 1))
    digit, lower, upper = ((raw >= a) & (raw <= b) for a, b in ((48, 57), (97, 122), (65, 90)))
    total = [np.concatenate([[0], np.cumsum(x)]) for x in (digit, lower, upper)]
    d, lo, up = (t[ends] - t[starts] for t in total)
    # small letters and capitals that change within the run, beyond a capital at its start
    mixed = (lo > 2) & (up - (upper[starts] if len(starts) else 0) > 2)
    ok = (ends - starts >= MIN_LENGTH) & ((d > 0) & (lo + up > 0) | mixed)
    starts, ends = starts[ok], ends[ok]
    data = raw.tobytes()
    # a run that holds "name=value" counts from the value on
    named, headers = [], []
    cuts = offsets.tolist()
    for x, y in zip(cuts, cuts[1:]):
        named += [next(m.span(g) for g in (1, 2, 3) if m.start(g) >= 0) for m in _NAMED.finditer(data, x, y)]
        headers += [m.span() for m in _HEADER.finditer(data, x, y)]
    if named:
        first, last = (np.array(x, np.int64) for x in zip(*named))
        at = np.searchsorted(first, ends, "left") - 1
        over = (at >= 0) & (last[np.maximum(at, 0)] > starts)
        starts, ends = np.concatenate([starts[~over], first]), np.concatenate([ends[~over], last])
    if headers:
        starts = np.concatenate([starts, [x for x, _ in headers]]).astype(np.int64)
        ends = np.concatenate([ends, [y for _, y in headers]]).astype(np.int64)
    doc = np.searchsorted(offsets, starts, "right") - 1
    o = np.lexsort((starts, doc))
    return doc[o], starts[o], ends[o]


@dataclass
class Lexicon:
    """words of the dictionary, and the surprise of each pair of characters, small letters with others folded into one."""

    words: frozenset
    surprise: np.ndarray


def lexicon_of(counted: dict[str, int]) -> Lexicon:
    pairs = np.ones((28, 28))
    for word, n in counted.items():
        codes = [27, *_codes(word), 27]
        for a, b in zip(codes, codes[1:]):
            pairs[a, b] += n
    return Lexicon(frozenset(counted), -np.log2(pairs / pairs.sum(axis=1, keepdims=True)))


def _codes(text: str) -> list[int]:
    return [ord(c) - 97 if "a" <= c <= "z" else 26 for c in text.lower()]


def covered(value: str, words: frozenset) -> float:
    """Share of the letters and digits that lies in dictionary words of 4 letters or more, the longest first from the left."""
    low, at, held = value.lower(), 0, 0
    longest = 14
    while at < len(low):
        for n in range(min(longest, len(low) - at), 3, -1):
            if low[at : at + n] in words:
                held += n
                at += n
                break
        else:
            at += 1
    return held / max(1, sum(c.isalnum() for c in value))


def features(value: str, before: str, after: str, path: str, lex: Lexicon) -> list[float]:
    n = len(value)
    kinds = ["d" if c.isdigit() else "l" if c.islower() else "u" if c.isupper() else "s" for c in value]
    share = {k: kinds.count(k) / n for k in "dlus"}
    counts = np.array([value.count(c) for c in sorted(set(value))]) / n
    codes = _codes(value)
    surprise = lex.surprise
    left = before[-_NEAR:]
    near = " ".join(re.findall(r"[A-Za-z0-9_.\-]+", left)[-4:])
    touching = left.rstrip()[-1:]
    return [
        n,
        share["d"],
        share["l"],
        share["u"],
        share["s"],
        sum(a != b for a, b in zip(kinds, kinds[1:])) / max(1, n - 1),
        sum(surprise[a, b] for a, b in zip(codes, codes[1:])) / max(1, n - 1),
        float(-(counts * np.log2(counts)).sum()),
        len(set(value)) / n,
        covered(value, lex.words),
        float(re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", value) is not None),
        float(n in (32, 40, 64, 128)),
        float(re.fullmatch(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}", value) is not None),
        float(_PREFIX.match(value) is not None),
        float(_ASKED.search(near) is not None),
        float(_HARMLESS.search(near) is not None),
        float(touching in ("=", ":") or (touching in ('"', "'", "`") and left.rstrip().rstrip("\"'`").rstrip()[-1:] in ("=", ":"))),
        float(left[-1:] in ('"', "'", "`") and after[:1] == left[-1:]),
        float(value.count("/") + value.count(".") + value.count("-")) / n,
        float(_HARMLESS.search(after[:24]) is not None),
        float(_TEST_PATH.search(path) is not None),
        float(_KEY_PATH.search(path) is not None),
    ]


@dataclass
class Forest:
    """Trees as arrays: feature (-1 in a leaf), cut, left child, and the leaf's share of secrets."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    def vote(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, cut, left, share in self.trees:
            at = np.zeros(len(x), np.int64)
            while True:
                f = feature[at]
                go = f >= 0
                if not go.any():
                    break
                r = np.flatnonzero(go)
                at[r] = left[at[r]] + (x[r, f[r]] > cut[at[r]])
            total += share[at]
        return total / max(1, len(self.trees))


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, least: int = LEAST_LEAF, each: int = FEATURES_A_SPLIT, seed: int = SEED) -> Forest:
    """Bootstrapped gini trees, each split over a random choice of features."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(trees if len(y) else 0):
        rows = rng.integers(0, len(y), len(y))
        feature, cut, left, share = [-1], [0.0], [0], [0.0]
        todo = [(0, rows, 0)]
        while todo:
            node, own, level = todo.pop()
            t = y[own]
            share[node] = float(t.mean())
            if level >= depth or len(own) < 2 * least or t.min() == t.max():
                continue
            best = None
            for f in rng.permutation(x.shape[1])[:each]:
                v = x[own, f]
                o = np.argsort(v, kind="stable")
                v, s = v[o], np.cumsum(t[o])
                n = np.arange(1, len(v) + 1)
                ok = (v[1:] > v[:-1]) & (n[:-1] >= least) & (len(v) - n[:-1] >= least)
                if not ok.any():
                    continue
                a, na = s[:-1], n[:-1]
                b, nb = s[-1] - a, len(v) - na
                gini = a * (na - a) / na + b * (nb - b) / nb
                k = int(np.argmin(np.where(ok, gini, np.inf)))
                if best is None or gini[k] < best[0]:
                    best = (gini[k], int(f), float(v[k]))
            if best is None:
                continue
            _, feature[node], cut[node] = best
            left[node] = len(feature)
            side = x[own, best[1]] > best[2]
            for part in (own[~side], own[side]):
                todo.append((len(feature), part, level + 1))
                feature.append(-1)
                cut.append(0.0)
                left.append(0)
                share.append(0.0)
        out.append((np.array(feature), np.array(cut), np.array(left), np.array(share)))
    return Forest(out)


def labelled_findings(words: list[str], n: int = LABELLED, seed: int = SEED) -> list[tuple[str, str, str, str, int]]:
    """(value, before, after, path, label): made findings, half of them secrets. words: prose for the surroundings."""
    r = random.Random(seed)
    words = sorted(words) or ["lorem", "ipsum", "dolor", "amet"]
    alnum, b64 = string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/"
    run = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    prose = lambda k: " ".join(r.choice(words) for _ in range(k))
    digits = "0123456789abcdef"
    key_names = ["token", "api_key", "apikey", "secret", "password", "access_token", "auth_token", "client_secret", "passwd", "private_key", "SECRET_KEY", "API-KEY", "bearer", "credential"]
    plain_names = ["sha256", "md5", "commit", "checksum", "digest", "hash", "etag", "uuid", "id", "version", "revision", "build", "image", "file", "ref", "integrity", "blob"]
    secret = [lambda: run(digits, r.choice([32, 40, 64])), lambda: run(alnum, r.randint(20, 48)), lambda: run(b64, r.randint(24, 60)) + r.choice(["", "=", "=="]), lambda: "AKIA" + run(string.ascii_uppercase + "234567", 16)]
    secret += [lambda: "ghp_" + run(alnum, 36), lambda: "sk-" + run(alnum, 40), lambda: "xoxb-" + run("0123456789", 11) + "-" + run(alnum, 24), lambda: "eyJ" + run(alnum + "_-", 30) + "." + run(alnum + "_-", 60), lambda: run(alnum + "_-", r.randint(16, 24))]
    uuid_ = lambda: "-".join(run(digits, k) for k in (8, 4, 4, 4, 12))
    joined = lambda: r.choice(["-", "_", "/", ".", ""]).join(r.choice([str.lower, str.title])(r.choice(words)) for _ in range(r.randint(3, 6))) + str(r.randint(0, 9999))
    harmless = [lambda: run(digits, r.choice([32, 40, 64])), uuid_, joined, lambda: "2024-0" + str(r.randint(1, 9)) + "-1" + str(r.randint(0, 9)) + "T10-" + run("0123456789", 6), lambda: "v" + ".".join(str(r.randint(0, 99)) for _ in range(3)) + "-" + r.choice(words) + "-build" + str(r.randint(1, 999))]
    signs = alnum + "!@#$%^&*"
    secret += [lambda: run(signs, r.randint(8, 15)), lambda: r.choice(words)[:8] + run("0123456789", 3) + r.choice("!@#$%") + r.choice(words)[:6], lambda: "-".join(r.choice(words) for _ in range(r.randint(4, 6)))]
    holder = [lambda: r.choice(["changeme", "password", "none-given", "********", "${PASSWORD}", "<your-token>", "required", "see below", "os.environ"]), lambda: r.choice(["your_api_key_here_123", "XXXXXXXXXXXXXXXX0000", "REPLACE_WITH_TOKEN_1", "example-secret-value-1", "0000000000000000000a", "changeme-changeme-1", "abcdefghijklmnopqrstuvwxyz0123456789"])]
    paths = ["src3", "src17", "", "app/main.py", "config/prod.env", "deploy/settings.yml", "web", "notes.txt"]
    made = []
    for i in range(n):
        if i % 2 == 0:
            name, sign, quote = r.choice(key_names), r.choice([" = ", "=", ": ", ":", " "]), r.choice(['"', '"', "'", ""])
            made.append((r.choice(secret)(), prose(3) + " " + name + sign + quote, quote + " " + prose(3), r.choice(paths), 1))
            continue
        kind = r.random()
        path = r.choice([*paths, "tests/test_x.py", "docs/readme.md", "package.lock", "vendor/a.js"])
        if kind < 0.35:
            sign, quote = r.choice([" = ", "=", ": ", " "]), r.choice(['"', "", ""])
            made.append((r.choice(harmless)(), prose(3) + " " + r.choice(plain_names) + sign + quote, quote + " " + prose(3), path, 0))
        elif kind < 0.75:
            made.append((r.choice(harmless)(), prose(4) + " ", r.choice([" ", ". ", ", "]) + prose(3), path, 0))
        elif kind < 0.85:
            name, sign, quote = r.choice(key_names), r.choice([" = ", "=", ": "]), r.choice(['"', "'", ""])
            made.append((r.choice(holder)(), prose(3) + " " + name + sign + quote, quote + " " + prose(3), path, 0))
        else:
            name, sign = r.choice(key_names), r.choice([" = ", ": "])
            made.append((joined(), prose(3) + " " + name + sign, " " + prose(3), path, 0))
    return made


def dictionary(docs: DataFrame, text_col: str = "text", max_words: int = MAX_WORDS) -> dict[str, int]:
    """The words of 4 to 14 letters that occur in most documents, and in how many; ties by the word."""
    docs, text_col = common.numbered(docs, text_col)

    def run(batches):
        keys, counts, text = np.zeros(0, np.uint64), np.zeros(0, np.int64), {}
        for piece in slices(batches, "text"):
            w = Words(piece.column("text"))
            size = w.ends - w.starts
            digit = np.concatenate([[0], np.cumsum((w.raw >= 48) & (w.raw <= 57))])
            ok = (size >= 4) & (size <= 14) & (digit[w.ends] == digit[w.starts])
            h, doc, place = w.hash[ok], w.docs[ok], np.flatnonzero(ok)
            o = np.lexsort((doc, h))
            h, doc, place = h[o], doc[o], place[o]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
            uniq, first, n = np.unique(h[new], return_index=True, return_counts=True)
            for k, i in zip(uniq.tolist(), place[new][first].tolist()):
                if k not in text:
                    text[k] = w.text(i)
            both = np.concatenate([keys, uniq])
            keys, inv = np.unique(both, return_inverse=True)
            counts = np.bincount(inv, np.concatenate([counts, n]), len(keys)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([text[k] for k in keys.tolist()], pa.string()), pa.array(counts)], names=["word", "n"])

    counted = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    found = common.written(counted, "dictionary")
    # the least count among the first max_words, from a table of counts, so that no task sends its own first max_words on
    of_count = found.groupBy("n").agg(F.count("*").alias("words"))
    reached = of_count.withColumn("reached", F.sum("words").over(Window.orderBy(F.desc("n"))))
    least = reached.where(F.col("reached") >= max_words).agg(F.max("n").alias("n")).first()["n"] or 0
    return {r["word"]: r["n"] for r in found.where(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(max_words).collect()}


def fit(findings, lex: Lexicon, trees: int = TREES) -> Forest:
    """A forest from rows (value, before, after, path, label)."""
    rows = [(features(v, b or "", a or "", p or "", lex), y) for v, b, a, p, y in findings if v and y is not None]
    return grow(np.array([x for x, _ in rows] or np.zeros((0, 1))), np.array([float(y) for _, y in rows]), trees)


def scan(docs: DataFrame, lex: Lexicon, forest: Forest, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source", secret_from: float = SECRET_FROM) -> DataFrame:
    """(doc_id, first_byte, n_bytes, value_sha256, vote, is_secret) of every candidate; bytes count from the text's start in UTF-8."""
    docs, id_col, text_col, path_col = common.numbered(docs, id_col, text_col, path_col)
    held = docs.sparkSession.sparkContext.broadcast((lex, forest))
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(path_col).cast("string").alias("path"))

    def run(batches):
        words, trees = held.value
        for piece in slices(batches, "text"):
            raw, offsets = buffers(piece.column("text"))
            doc, start, end = candidates(piece.column("text"))
            if not len(doc):
                continue
            data, paths = raw.tobytes(), piece.column("path").to_pylist()
            x, hashes = [], []
            for d, s, e in zip(doc.tolist(), start.tolist(), end.tolist()):
                value = data[s:e]
                before = data[max(int(offsets[d]), s - 2 * _NEAR) : s].decode("utf-8", "ignore")
                after = data[e : min(int(offsets[d + 1]), e + 2 * _NEAR)].decode("utf-8", "ignore")
                x.append(features(value.decode("utf-8", "replace"), before, after, paths[d] or "", words))
                hashes.append(hashlib.sha256(value).hexdigest())
            vote = trees.vote(np.array(x))
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id").take(pa.array(doc)), pa.array(start - offsets[doc]), pa.array(end - start), pa.array(hashes), pa.array(vote), pa.array(vote >= secret_from)],
                names=["doc_id", "first_byte", "n_bytes", "value_sha256", "vote", "is_secret"],
            )

    return narrow.mapInArrow(run, f"doc_id {dict(narrow.dtypes)['doc_id']}, first_byte bigint, n_bytes bigint, value_sha256 string, vote double, is_secret boolean")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counted = dictionary(docs)
    lex = lexicon_of(counted)
    return scan(docs, lex, fit(labelled_findings(list(counted)), lex))
