"""Secret scans with a random forest against false positives (operator 9).

Method. Patterns find candidates in the whole text: private-key blocks, web tokens, values assigned to a
telling name, credentials in addresses, ids of access keys, tokens that begin as public services' do, and long
tokens with digits or mixed case (words of lower-case letters alone are candidates only where they are assigned). Each candidate becomes
numbers: its length, its character transitions (class changes, and a log ratio of character pairs learnt from
the labelled findings), its coverage by dictionary words (the whole words of a public vocabulary file, whose
path is a parameter), its path (``source``) and the words beside it. A
random forest trained on labelled findings drops what is no secret.

The tables hold no labelled findings, so :func:`labelled_findings` writes ``FINDINGS`` of them from a seed:
secrets of many shapes, and look-alikes (commit ids, checksums, UUIDs, card and phone numbers, identifiers,
placeholders). Own findings can be passed instead. The forest is fitted on the driver (its size is bounded by
parameters alone) and sent to the workers; documents are scanned where they lie, with no exchange.

The secret itself never leaves the worker: a finding holds its place, length and SHA-256.

Cases: null and empty texts have no findings; a text is scanned whole, at any length; a null path counts as
empty; of overlapping candidates that the forest keeps the longest counts; repeated rows give repeated findings; empty
tables give empty results; columns other than the three named are not read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import math
import random
import re
import uuid
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bound_batches

FINDINGS = 4_000
TREES = 40
DEPTH = 9
LIMIT = 0.5
SEED = 7
SCHEMA = "doc_id long, start long, length long, kind string, secret_sha256 string, score double"
ASIDE = 48

SECRET_WORDS = "token secret password passwd pwd apikey api_key access_key private_key credential auth bearer client_secret passphrase session_key encryption_key signing_key".split()
OTHER_WORDS = "commit sha sha1 sha256 md5 checksum digest hash uuid guid id revision version build etag integrity order card phone isbn invoice image png data commit_id changeset".split()
PATH_WORDS = "test tests example examples sample fixture fixtures mock docs doc demo tutorial".split()
MIN_WORD = 4
MAX_WORD = 14
#: Values that stand in a secret's place and are none.
PLACEHOLDERS = "your_api_key_here changeme123 xxxxxxxxxxxxxxxx <password> example_token_value REPLACE_ME_PLEASE placeholder-token os.environ['KEY'] getenv(TOKEN) None_placeholder insert-token-here dummy_secret_value ****************".split()
#: What is assigned: the end of a name, up to the sign, which ``NAME`` characters hold; and the sign with the value.
NAME = 24
_NAME = re.compile(r"(?i)(?:token|secret|passwd|password|pwd|passphrase|credential|api[_-]?key|_key|auth)[\"']?\Z")
_SIGN = re.compile("[:=]")
_VALUE = re.compile(r"(?>:=|=>|[:=])[^\S\n]*+[\"']?([^\s\"',;<>]{8,})")
_BLANK = re.compile(r"[^\S\n]")


def _assigned(text: str) -> Iterator[tuple[int, int]]:
    """Spans of assigned values. Names are looked for before signs, which are few, and none inside a value.

    Any blanks of the line may stand on either side of the sign; they are passed over once a sign.
    """
    end = behind = 0
    for sign in _SIGN.finditer(text):
        at = name = sign.start()
        while name > behind and _BLANK.match(text[name - 1]):
            name -= 1
        behind = at + 1
        if at >= end and _NAME.search(text[max(end, name - NAME) : name]) and (value := _VALUE.match(text, at)):
            end = value.end()
            yield value.span(1)


def _matched(pattern: str) -> Callable[[str], Iterator[tuple[int, int]]]:
    """The spans of a pattern: of its group, if it has one."""
    compiled = re.compile(pattern)
    return lambda text: (m.span(compiled.groups) for m in compiled.finditer(text))


#: How the tokens of public services begin, and the least length of the rest.
PREFIXES = (
    ("ghp_", 36), ("gho_", 36), ("ghs_", 36), ("github_pat_", 40), ("glpat-", 20), ("xoxb-", 20), ("xoxp-", 20), ("sk_live_", 16),
    ("rk_live_", 16), ("npm_", 36), ("hf_", 30), ("AIza", 35), ("pypi-", 50), ("dop_v1_", 60),
)
#: Patterns begin with plain text, if they can, and look back from behind it, as such a beginning is searched for fast.
CANDIDATES: tuple[tuple[str, Callable[[str], Iterator[tuple[int, int]]]], ...] = (
    # the body, with header lines or without, runs to the next five dashes
    ("private_key", _matched(r"-----BEGIN [A-Z0-9 ]*?PRIVATE KEY(?: BLOCK)?-----[^-]*+(?:-(?!----)[^-]*+)*+-----END [A-Z0-9 ]*?PRIVATE KEY(?: BLOCK)?-----")),
    ("web_token", _matched(r"eyJ(?<![\w-]eyJ)[\w-]{8,}\.[\w-]{8,}\.[\w-]{8,}")),
    ("address", _matched(r"://[^\s/:@]*+:([^\s/@]++)@")),
    ("assigned", _assigned),
    ("key_id", _matched(r"A[KS]IA(?<![A-Za-z0-9]A[KS]IA)[A-Z0-9]{16}(?![A-Za-z0-9])")),
    *[("prefixed", _matched(rf"{re.escape(start)}(?<![A-Za-z0-9_-]{re.escape(start)})[A-Za-z0-9_-]{{{least},}}")) for start, least in PREFIXES],
    # "=" only pads the end: a name before it is no part of the value
    ("token", _matched(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")),
)
_DIGIT = re.compile("[0-9]")
_KEY_RUN = re.compile(r"(?:[A-Za-z0-9+/=]\s*+){16}")
_WORD = re.compile(r"[a-z][a-z0-9_]*")
_LETTERS = re.compile(r"[a-z]{4,}")
_CLASSES = np.zeros(128, np.int8)
_CLASSES[48:58], _CLASSES[65:91], _CLASSES[97:123] = 1, 2, 3


@dataclass(frozen=True)
class Finding:
    kind: str
    start: int
    value: str
    before: str
    after: str
    path: str


def _worth(kind: str, value: str) -> bool:
    if kind == "token":
        return bool(_DIGIT.search(value)) or (value != value.lower() and value != value.upper())
    if kind == "prefixed":
        return bool(_DIGIT.search(value)) and len(set(value)) > 8
    return kind != "private_key" or bool(_KEY_RUN.search(value[value.index("-----", 5) + 5 : value.rindex("-----END")]))


def candidates(text: str, path: str | None = None) -> list[Finding]:
    """All candidate findings of a text, by place, overlapping ones too."""
    spans = []
    for kind, spans_of in CANDIDATES:
        spans += [(a, b, kind) for a, b in spans_of(text) if _worth(kind, text[a:b])]
    spans.sort(key=lambda s: (s[0], -s[1]))
    return [Finding(kind, a, text[a:b], text[max(0, a - ASIDE) : a], text[b : b + ASIDE], path or "") for a, b, kind in spans]


def longest(findings: list[Finding], scores: list[float]) -> list[int]:
    """Places of the findings that stay of overlapping ones: the longest first, then the higher score, then the first."""
    starts: list[int] = []
    kept: list[tuple[int, int]] = []  # end and place, by start
    for k in sorted(range(len(findings)), key=lambda k: (-len(findings[k].value), -scores[k], k)):
        a = findings[k].start
        b = a + len(findings[k].value)
        at = bisect_left(starts, b)
        if at == 0 or kept[at - 1][0] <= a:
            starts.insert(at, a)
            kept.insert(at, (b, k))
    return [k for _, k in kept]


def _entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


@lru_cache(maxsize=2)
def dictionary(path: str) -> frozenset[str]:
    """The whole words of letters, ``MIN_WORD`` to ``MAX_WORD`` long, in a public tokenizer's vocabulary file."""
    model = json.loads(Path(path).read_bytes())["model"]
    end = model["end_of_word_suffix"]
    words = {token.removesuffix(end).lower() for token in model["vocab"] if token.endswith(end)}
    return frozenset(w for w in words if w.isascii() and w.isalpha() and MIN_WORD <= len(w) <= MAX_WORD)


def _coverage(value: str, words: frozenset[str]) -> float:
    """Share of the characters that lie in dictionary words."""
    held = 0
    for run in _LETTERS.finditer(value.lower()):
        text, end = run[0], 0  # end: up to where the run is covered
        for at in range(len(text) - MIN_WORD + 1):
            for n in range(min(MAX_WORD, len(text) - at), max(MIN_WORD, end - at + 1) - 1, -1):
                if text[at : at + n] in words:
                    held += at + n - max(end, at)
                    end = at + n
                    break
    return held / len(value)


def _near(words: list[str], known: list[str]) -> float:
    """1 for a known word right beside, less for one further off, 0 for none."""
    for k, word in enumerate(words[:6]):
        if word in known or any(word.endswith("_" + x) for x in known):
            return 1 / (1 + k)
    return 0.0


def describe(f: Finding, pairs: dict[str, float], words: frozenset[str]) -> list[float]:
    value = f.value
    n = len(value)
    codes = np.frombuffer(value.encode("ascii", "replace"), np.uint8)
    kinds = _CLASSES[codes & 127]
    before = _WORD.findall(f.before.lower())[::-1]
    after = _WORD.findall(f.after.lower())
    path = set(_WORD.findall(f.path.lower().replace("/", " ")))
    tail = f.before.rstrip()
    shape = [float((kinds == k).mean()) for k in range(4)]
    low = value.lower()
    return [
        math.log(n),
        float((kinds[1:] != kinds[:-1]).mean()) if n > 1 else 0.0,
        sum(pairs.get(value[i : i + 2], 0.0) for i in range(n - 1)) / max(1, n - 1),
        _entropy(value),
        _coverage(value, words),
        *shape,
        float(all(c in "0123456789abcdef" for c in low)),
        sum(c in "aeiou" for c in low) / n,
        float(bool(re.fullmatch(r"[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", low))),
        float(bool(re.search(r"(.)\1{4}", value))),
        float(tail[-1:] in "\"'"),
        float(bool(re.search(r"[:=]\s*[\"']?$", f.before))),
        _near(before, SECRET_WORDS),
        _near(before, OTHER_WORDS),
        _near(after, SECRET_WORDS),
        float(bool(path & set(PATH_WORDS))),
        float(f.kind in ("private_key", "web_token", "key_id", "prefixed")),
        float(f.kind == "address"),
    ]


def _tree(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int) -> list[tuple[int, float, int, int, float]]:
    """A tree as rows (feature, threshold, left, right, share of secrets); feature -1 is a leaf."""
    rows: list = []

    def grow(at: np.ndarray, left: int) -> int:
        me, share = len(rows), float(y[at].mean())
        rows.append((-1, 0.0, -1, -1, share))
        if left == 0 or len(at) < 6 or share in (0.0, 1.0):
            return me
        best = (1e-9, -1, 0.0)
        own = share * (1 - share)
        for j in rng.choice(x.shape[1], max(2, math.isqrt(x.shape[1])), replace=False):
            column = x[at, j]
            for cut in np.unique(np.quantile(column, np.linspace(0.05, 0.95, 15))):
                low = column <= cut
                n = low.mean()
                if 0 < n < 1:
                    p, q = y[at[low]].mean(), y[at[~low]].mean()
                    gain = own - n * p * (1 - p) - (1 - n) * q * (1 - q)
                    if gain > best[0]:
                        best = (gain, int(j), float(cut))
        if best[1] >= 0:
            low = x[at, best[1]] <= best[2]
            a, b = grow(at[low], left - 1), grow(at[~low], left - 1)
            rows[me] = (best[1], best[2], a, b, share)
        return me

    grow(np.arange(len(y)), depth)
    return rows


class Forest:
    """A random forest over the features of :func:`describe`, with the table of character pairs and the dictionary."""

    def __init__(self, pairs: dict[str, float], words: frozenset[str], trees: list[list[tuple]]):
        self.pairs, self.words = pairs, words
        self.trees = [[np.array(c) for c in zip(*t, strict=True)] for t in trees]

    def score(self, findings: list[Finding]) -> np.ndarray:
        if not findings:
            return np.zeros(0)
        x = np.array([describe(f, self.pairs, self.words) for f in findings])
        total = np.zeros(len(x))
        for feature, cut, left, right, share in self.trees:
            at = np.zeros(len(x), np.int64)
            while (inner := feature[at] >= 0).any():
                go = x[np.arange(len(x)), np.maximum(feature[at], 0)] <= cut[at]
                at = np.where(inner, np.where(go, left[at], right[at]), at)
            total += share[at]
        return total / len(self.trees)


def train_forest(labelled: list[tuple[Finding, int]], words: frozenset[str], trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> Forest:
    counts: list[Counter] = [Counter(), Counter()]
    for f, y in labelled:
        counts[y].update(f.value[i : i + 2] for i in range(len(f.value) - 1))
    sums = [sum(c.values()) + 4096 for c in counts]
    pairs = {p: math.log((counts[1][p] + 1) / sums[1]) - math.log((counts[0][p] + 1) / sums[0]) for p in counts[0] | counts[1]}
    x = np.array([describe(f, pairs, words) for f, _ in labelled])
    y = np.array([v for _, v in labelled], float)
    rng = np.random.default_rng(seed)
    grown = []
    for _ in range(trees):
        drawn = rng.integers(0, len(y), len(y))
        grown.append(_tree(x[drawn], y[drawn], rng, depth))
    return Forest(pairs, words, grown)


def labelled_findings(words: frozenset[str], n: int = FINDINGS, seed: int = SEED) -> list[tuple[Finding, int]]:
    """Findings with labels (1: a secret), half and half, from written templates, dictionary words and a seed."""
    rng = random.Random(seed)
    pick, some = rng.choice, lambda alphabet, k: "".join(rng.choice(alphabet) for _ in range(k))
    hexes, mixed = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    syllables = "ta re on en the ing er an ti es ou ed in or nd st th le eau ment que ung lich keit cion dad mo ra li ko".split()
    known = sorted(words) or syllables
    paths = ["app/config.py", "src/settings.ini", "deploy/env.sh", "notes.md", "tests/test_auth.py", "docs/guide.md", "data/part-0", ""]

    def prose(k: int) -> str:
        # now and then a telling word stands somewhere before, of either kind and for either label
        return " ".join(pick(SECRET_WORDS + OTHER_WORDS) if rng.random() < 0.03 else "".join(pick(syllables) for _ in range(rng.randint(1, 4))) for _ in range(k))

    def names(k: int) -> list[str]:
        return [pick([pick(known), "".join(pick(syllables) for _ in range(3))]) for _ in range(k)]

    def secret() -> tuple[str, str]:
        shape = rng.random()
        if shape < 0.06:
            what, block = pick([("", ""), ("RSA ", ""), ("EC ", ""), ("PGP ", " BLOCK")])
            return "", f"-----BEGIN {what}PRIVATE KEY{block}-----\n{base64.b64encode(rng.randbytes(rng.randint(40, 900))).decode()}\n-----END {what}PRIVATE KEY{block}-----"
        if shape < 0.12:
            return pick(["bearer ", "jwt = ", "token: "]), "eyJ" + ".".join(some(mixed + "_-", rng.randint(16, 60)) for _ in range(3))
        if shape < 0.2:
            user = pick(["", pick(syllables) + pick(syllables)])
            word = "".join(pick(syllables) for _ in range(rng.randint(1, 4))) + some("0123456789", rng.randint(0, 3)) + pick(["", "pass"])
            return f"{pick(['https', 'postgres', 'redis'])}://{user}:", pick([some(mixed, rng.randint(3, 24)), word]) + "@"
        if shape < 0.26:
            start, least = pick(PREFIXES)
            return pick(["", "", "token ", "key: "]), start + some(mixed, least + rng.randint(0, 8))
        if shape < 0.32:
            return "", pick([some(mixed[:52], rng.randint(16, 40)), "AKIA" + some("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16)])
        name = pick(["token", "secret", "password", "api_key", "access_key", "client_secret", "auth_token", "passwd", "signing_key", "credential"])
        value = pick([
            lambda: some(hexes, pick([32, 40, 48, 64])), lambda: some(mixed, rng.randint(20, 48)),
            lambda: base64.b64encode(rng.randbytes(rng.randint(18, 40))).decode().rstrip("="), lambda: pick(["ghp_", "sk_live_", "xoxb-", "pat-"]) + some(mixed, 36), lambda: str(uuid.UUID(bytes=rng.randbytes(16), version=4)),
            lambda: "AKIA" + some("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16), lambda: some(mixed + "!#%+-_*", rng.randint(10, 22)),
            lambda: pick(["-", ".", "_", "+"]).join(names(rng.randint(2, 3))) + pick(["!", "?", "#", "$", "%"]) + some("0123456789", rng.randint(0, 2)),
        ])()
        q = pick(['"', "'", ""])
        return name + pick([" = ", "=", ": ", " := "]) + q, value

    def other() -> tuple[str, str]:
        digits = "0123456789"
        return pick([
            lambda: (pick(["commit ", "revision ", "sha1: ", "changeset "]), some(hexes, 40)),
            lambda: (pick(["md5 = ", "checksum: ", "etag: \"", "sha256:", "digest "]), some(hexes, pick([32, 40, 64]))),
            lambda: (pick(["id = ", "uuid: ", "guid ", "order "]), str(uuid.UUID(bytes=rng.randbytes(16), version=4))),
            lambda: (pick(["", "card ", "order ", "isbn ", prose(1) + " "]), some(digits, pick([16, 16, 16, 17, 18, 20]))),
            lambda: ("", "-".join(some(digits, rng.randint(3, 5)) for _ in range(4))),
            lambda: (pick(["", "see ", "class ", "import "]), "_".join("".join(pick(syllables) for _ in range(2)) for _ in range(3)) + some(digits, rng.randint(1, 3))),
            lambda: ("", "/".join("".join(pick(syllables) for _ in range(2)) for _ in range(4)) + "/" + some(digits, 3)),
            lambda: (pick(["token = \"", "password: ", "api_key = '", "secret="]), pick(PLACEHOLDERS)),
            lambda: (pick(["token = ", "auth: ", "the secret: ", "password = "]), "".join(pick(syllables) for _ in range(rng.randint(4, 7)))),
            lambda: ("", "".join(pick(syllables) for _ in range(rng.randint(5, 9))) + pick(digits)),
            lambda: (pick(["", "call ", "class ", "import "]), "".join(w if k == 0 and rng.random() < 0.5 else w.capitalize() for k, w in enumerate(names(rng.randint(3, 6))))),
            lambda: ("", "".join(pick(syllables) for _ in range(rng.randint(7, 12))).capitalize()),
            lambda: (pick(["", "the ", "see "]), pick(["-", "/", "_"]).join(w.capitalize() for w in names(rng.randint(3, 5)))),
            lambda: ("data:image/png;base64,", base64.b64encode(rng.randbytes(60)).decode()),
            lambda: ("built ", f"{rng.randint(1990, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}T{rng.randint(10, 23)}-{rng.randint(10, 59)}-00"),
        ])()

    out = []
    while len(out) < n:
        label = len(out) % 2
        lead, value = secret() if label else other()
        close = lead[-1] if lead[-1:] in "\"'" and lead else ""
        before, after = prose(rng.randint(0, 6)) + pick([" ", "\n", " | ", ", "]), close + pick([" ", "\n", "", "!! ", "###", " | "]) + prose(rng.randint(0, 5))
        if rng.random() < 0.12:
            lead, value, before, after = lead.upper(), value.upper(), before.upper(), after.upper()
        text = before + lead + value + after
        at = len(before) + len(lead)
        hits = [f for f in candidates(text, pick(paths)) if f.start < at + len(value) and f.start + len(f.value) > at]
        if hits:
            out.append((max(hits, key=lambda f: len(f.value)), label))
        elif label == 0:  # the patterns already leave it out; it still shows the forest what prose looks like
            out.append((Finding("token", at, value, text[max(0, at - ASIDE) : at], text[at + len(value) :][:ASIDE], pick(paths)), 0))
    return out


@lru_cache(maxsize=2)
def default_forest(vocabulary: str | None) -> Forest:
    words = dictionary(vocabulary) if vocabulary else frozenset()
    return train_forest(labelled_findings(words), words)


def scan(docs: DataFrame, forest: Forest | None = None, vocabulary: str | None = None, limit: float = LIMIT, id_column: str = "doc_id", text_column: str = "text", path_column: str = "source") -> DataFrame:
    """doc_id, start and length (code points), kind, secret_sha256 and score of every finding that is kept."""
    bound_batches(docs.sparkSession)
    # TREES trees of 2 ** (DEPTH + 1) rows at most, a pair table and the dictionary: of one size at any input
    sent = docs.sparkSession.sparkContext.broadcast(forest or default_forest(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = sent.value
        for batch in batches:
            ids, found, spans = [], [], []
            for doc_id, text, path in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                hits = candidates(text.as_py() or "", path)
                ids += [doc_id] * len(hits)
                spans.append((len(found), len(found) + len(hits)))
                found += hits
            scores = forest.score(found)
            rows = []
            for a, b in spans:
                held = [k for k in range(a, b) if scores[k] >= limit]
                for k in (held[j] for j in longest([found[k] for k in held], [scores[k] for k in held])):
                    f = found[k]
                    rows.append((ids[k], f.start, len(f.value), f.kind, hashlib.sha256(f.value.encode("utf-8")).hexdigest(), float(scores[k])))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "start", "length", "kind", "secret_sha256", "score"])

    rows = docs.select(*[F.col(f"`{c}`").cast(kind) for c, kind in ((id_column, "long"), (text_column, "string"), (path_column, "string"))])
    return rows.mapInArrow(run, SCHEMA)
