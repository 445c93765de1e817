"""Ranked search, the prefix trie and the URL filter against plain versions, on fixtures of odd cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import ranked, tries, urls

WORD = re.compile(r"[^\x20\x09-\x0D]+")

# --- 11

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def plain_terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_rank(docs, items, k):
    counted = [(i, Counter(plain_terms(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    total, length = len(counted), sum(sum(c.values()) for _, c in counted)
    having = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        scored = []
        for doc, own in counted:
            m = 25 + 75 * sum(own.values()) * total // length
            score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * having[t] + 1))) * (10**9 * own[t] // (1000 * own[t] + 8 * m)) for t in plain_terms(text) if t in own)
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank, doc, -least) for rank, (least, _, _, doc) in enumerate(sorted(scored)[:k], 1)]
    return out


def texts():
    rng = random.Random(4)
    words = ["the", "The", "of", "añb", "É", "é", "x1", "42", "rare", "one-two", "a_b", "´", "𝒜b", "end.", "<p>"]
    docs = [(i, " ".join(rng.choices(words, weights=range(len(words), 0, -1), k=rng.randrange(0, 40)))) for i in range(300)]
    docs += [(1000 + i, "the same copy of x1 and rare") for i in range(200)]  # a large group of ties
    docs += [(5, None), (None, "rare rare the"), (None, None), (7, ""), (8, " \n\x00 ... "), (9, "the " * 20_000), docs[3], docs[3]]
    items = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 30)))) for i in range(40)]
    items += [(50, None), (51, ""), (52, "unheard of"), (None, "rare"), (53, "the the of"), (53, "copy"), (53, "copy"), (54, " ".join(f"w{i}" for i in range(500)) + " rare")]
    return docs, items


@pytest.mark.parametrize(("most", "rows", "terms"), [(16_384, 2_000, 20_000), (16, 7, 30)])
def test_ranking_equals_brute_force(spark, monkeypatch, most, rows, terms):
    monkeypatch.setattr(ranked, "MOST_DOCS", most)  # shards, and blocks of queries
    monkeypatch.setattr(ranked, "BLOCK_ROWS", rows)
    monkeypatch.setattr(ranked, "BLOCK_TERMS", terms)
    docs, items = texts()
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"score": F.lit("clash"), "query": F.lit(1), "terms": F.lit(None)})
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit("clash"))
    got = ranked.rank(df.repartition(3), asked)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(map(tuple, got.collect())) == Counter(plain_rank(docs, items, 10))


def test_ranking_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    item = spark.createDataFrame([(1, "the")], "item_id long, text string")
    assert ranked.rank(none, item).collect() == []
    assert ranked.rank(spark.createDataFrame([(1, "the"), (2, "a")], none.schema), item.limit(0)).collect() == []


def test_threshold_stops_early_and_meets_all_ties():
    rng = np.random.default_rng(1)
    n, terms = 4_000, 30
    impacts = np.sort((1e5 * rng.pareto(1.5, (n, terms))).astype(np.int64) + 1, axis=0)[rng.permutation(n)]
    impacts[17] = impacts.max(axis=0) + 1  # outranks all
    impacts[100:140] = impacts[17] - 1  # equal scores at the edge of the k best
    shard = ranked.Shard(np.arange(n), np.arange(0, n * terms + 1, terms), np.tile(np.arange(terms), n), np.minimum(impacts, 2**31 - 1).ravel())
    asked, weights = np.array([2, 5, 11, 99]), np.array([3, 1, 7, 1])
    rows, scores, read = shard.search(asked, weights, 10, 1)
    whole = np.minimum(impacts, 2**31 - 1)[:, [2, 5, 11]] @ weights[:3]
    edge = np.sort(whole)[-10]
    assert set(np.flatnonzero(whole >= edge)) <= set(rows.tolist())
    assert dict(zip(rows.tolist(), scores.tolist(), strict=True)) == {r: whole[r] for r in rows.tolist()}
    assert read < 3 * n / 4
    assert len(shard.search(asked, weights, 10, int(whole.max()) + 1)[0]) == 0


# --- 12


def plain_trie(rows):
    turns = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            turns.setdefault(conv, []).append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest(), (role, text)))
    turns = {c: [x[-1] for x in sorted(t)] for c, t in turns.items()}
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(turns.get(c - int(math.fmod(c, 20)), [])[:h] + own[h:])
    members = {}
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
    saved = {n: (len(m) - 1) * len(WORD.findall(n[-1][1])) if n else 0 for n, m in members.items()}
    children = Counter(n[:-1] for n in members if n)
    out = []
    for n, m in members.items():
        under = [x for x in members if x[: len(n)] == n]
        ends = ",".join(map(str, sorted(c for c in m if built[c] == n)))
        out.append((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), children[n], sum(not children[x] for x in under), sum(saved[x] for x in under), hashlib.sha256(ends.encode()).hexdigest()))
    return out


def talks():
    rng = random.Random(12)
    said = ["hello", "hello there", "", " ", "é x\ty", None]
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(said)) for c in range(60) for t in range(rng.randrange(1, 9))]
    rows += [(c, t, "user", f"turn {t}") for c in range(100, 130) for t in range(c - 99)]  # each goes on where the last one ends
    rows += [(200 + i, t, "user", "the same") for i in range(25) for t in range(5)]  # equal conversations
    rows += [(300, t, "user", f"long {t % 7}") for t in range(400)] + [(301, t, "user", f"long {t % 7}") for t in range(300)]
    rows += [(400, 1, "user", "b"), (400, 1, "user", "a"), (400, None, "user", "z"), (400, None, None, None), (400, 1, "user", "a")]
    rows += [(-21, 0, "user", "below zero"), (-40, 0, "user", "its base"), (None, 0, "user", "of none"), (500, None, None, None), (501, 5, "user", "x" * 50_000)]
    return rows + [(600, 0, "user", "repeated")] * 30


@pytest.mark.parametrize("chunk", [4096, 5])
def test_trie_equals_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(tries, "CHUNK", chunk)
    df = spark.createDataFrame(talks(), "conv_id long, turn long, role string, text string")
    df = df.withColumns({"depth": F.lit("clash"), "key": F.lit(1), "range": F.lit(2)}).repartition(3)
    got = tries.prefix_trie(df)
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert got.columns == names
    assert sorted(map(tuple, got.collect()), key=str) == sorted(plain_trie(talks()), key=str)


@pytest.mark.parametrize("rows", [[], [(None, 1, "user", "x")], [(3, 0, "user", "only")]])
def test_trie_of_few_rows(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert sorted(map(tuple, tries.prefix_trie(df).collect()), key=str) == sorted(plain_trie(rows), key=str)


# --- 13


def plain_split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def fits(key, host, path):
    name, slash, rest = key.partition("/")
    return bool(host) and (host == name or host.endswith("." + name)) and path.startswith(slash + rest)


def plain_verdicts(pages, rules, listed):
    out = []
    for page, url in pages:
        host, path = plain_split(url)
        best = max(((len(k), len(k.partition("/")[0]), v == "block", k, v) for v, k in rules if fits(k, host, path)), default=None)
        other = "block" if any(fits(k, host, path) for k in listed) else "allow"
        out.append((page, host, path, best[3] if best else None, best[4] if best else other))
    return out


URLS = [
    None, "", "no scheme", "http://", "https:///es/1", "http://EXAMPLE.org/es/1?x=/fr/", "http://example.org", "http://example.org?/es/", "http://a.example.org/en/12#f",
    "http://example.org/en/2", "https://notexample.org/es/1", "http://x.com/fr/", "http://x.com/FR/1", "http://com/de/a", "http://dcom/de/a", "http://.com/de/", "http://a..org/",
    "http://user:pw@x.com:80/de/", "http://casino-win.example.net/a", "http://m.Casino.example.net", "http://casinos.example.net/", "http://x.ads/", "http://ads", "a://b://c.org/",
    "http://éa.com/fr/é", "http://x.com/de/\nnew", "http://pills.com/de/1", "http://pills.com/fr/1", "http://" + "a." * 5_000 + "org/es/", "http://x.com/de/" + "y" * 100_000, "http://x.com/de?a", "://org/",
]


def test_default_list_and_rules_equal_brute_force(spark):
    pages = [(i % 20 or None, u) for i, u in enumerate(URLS * 2)]
    df = spark.createDataFrame(pages, "page_id long, url string").withColumns({"rule": F.lit(0), "host": F.lit("clash"), "key": F.lit(1)}).repartition(3)
    bad = re.compile(r"(?:[^.]*-)?(?:ads|adult|bets|casino|pills|spam)(?:-[^.]*)?")
    listed = {".".join(labels[i:]) for _, u in pages for labels in [plain_split(u)[0].split(".")] for i in range(len(labels)) if bad.fullmatch(labels[i])}
    got = urls.judge_urls(df)
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    assert Counter(map(tuple, got.collect())) == Counter(plain_verdicts(pages, urls.RULES, listed))
    assert urls.judge_urls(df.limit(0)).collect() == []


@pytest.mark.parametrize("most_words", [1 << 20, 3])
def test_long_lists_equal_brute_force(spark, most_words):
    """Lists of hundreds of keys, in one part or several; most keys of the corpus are not listed."""
    rng = random.Random(13)
    tops, paths = ["org", "net", "com"], ["", "/", "/a/", "/a/b", "/c?x", "/cc"]
    pages = [(i, f"http://{rng.choice(['', 'www.', 'm.'])}h{rng.randrange(400)}.{rng.choice(tops)}{rng.choice(paths)}") for i in range(1500)]
    listed = sorted({f"h{rng.randrange(900)}.{rng.choice(tops)}{rng.choice(['', '/', '/a/'])}" for _ in range(300)})
    rules = [(rng.choice(["allow", "block"]), f"h{i}.net/{rng.choice(['', 'a', 'c'])}") for i in range(100)] + [("allow", "h200.com/"), ("block", "h200.com/"), ("allow", "h200.com/")]
    final = [r for r in rules if r != ("allow", "h200.com/")]
    df = spark.createDataFrame(pages, "page_id long, url string")
    keys = [(k.partition("/")[0].upper() + "".join(k.partition("/")[1:]),) for k in listed * 2]
    got = urls.judge_urls(df, rules, spark.createDataFrame(keys, "key string"), most_words=most_words)
    assert Counter(map(tuple, got.collect())) == Counter(plain_verdicts(pages, final, listed))


def test_cascade_tells_every_key_of_its_universe(spark):
    keys = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"), (F.col("id") % 10 == 0).alias("listed"))
    levels = urls.cascade(keys)
    assert 2 <= len(levels) <= 8
    assert keys.where(urls.member(F.col("key"), levels) != F.col("listed")).count() == 0
