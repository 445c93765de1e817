"""Search against brute force, the classifier's held-out accuracy, and the pipeline against plain versions of its stages."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import bpe, graph, knn, mixing, quality, queries
from tests.llm.test_text_operators import DDL, naive_components, naive_lines, naive_rules, sample, sha

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- 3


def vectors():
    rng = np.random.default_rng(8)
    rows = [(int(i), [float(x) for x in rng.normal(size=6)]) for i in range(400)]
    rows += [(1000 + i, [0.25, -0.5, 0.125, 0.0, 1.0, -1.0]) for i in range(300)]  # one very common vector
    rows += [(2000, None), (2050, [float("nan")] * 6), (2100, [float("inf"), *[0.0] * 5]), (2150, [1.0]), (2200, []), (2250, [None, *[0.0] * 5])]
    rows += [(2300, [0.0] * 6), (None, [1.0] * 6), (2350, [1e5] * 6), (2400, [3e38] * 6), (2401, [1e14, 1.0]), (2450, [-3e38, 1e20, 1.0, 0.5]), rows[3], rows[50]]
    rows += [(2500, [2.0, 0.5, 0.0, 0.0, 0.0, 0.0])] * 8 + [(2502, [1.0] * 9)]  # an id of more rows than k; a longer vector
    return rows


def naive_top(rows, every, k):
    """Python integers over all pairs; the shorter vector ends in zeros."""
    fine = [(i, [int(np.floor(256 * np.float64(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = Counter()
    for q, a in fine:
        if q % every == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in fine if i != q)[:k]
            out.update((q, max(-knn.END, min(knn.END, s)), i) for s, i in best)
    return out


@pytest.mark.parametrize("sizes", [{}, {"group": 3, "slice_rows": 50, "n_pivots": 9}, {"broadcast_bounds": 0, "n_pivots": 5, "slice_rows": 100}])
def test_top_k_equals_brute_force(spark, sizes):
    df = spark.createDataFrame(vectors(), "vec_id long, embedding array<float>").withColumn("cell", F.lit("clash")).repartition(4)
    got = knn.top_k(df, **sizes).collect()
    plain = {}
    for (q, s, i), n in naive_top(vectors(), 50, 5).items():
        plain.setdefault(q, []).extend([(s, i)] * n)
    for q, rows in plain.items():
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        # a repeated query row asks once more: the first five of all its answers; scores cut to a long tie by id
        assert [-r["score"] for r in mine] == [s for s, _ in sorted(rows)][:5]
        if all(abs(s) < knn.END for s, _ in rows):
            assert [r["vec_id"] for r in mine] == [i for _, i in sorted(rows)][:5]
        assert [r["rank"] for r in mine] == list(range(1, len(mine) + 1))
    assert {r["query_id"] for r in got} == set(plain)


def test_bounds_prune_clustered_vectors(spark):
    """Vectors of clusters reach few groups and queries few slices, and nothing is lost."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(20, 8)) * 40
    rows = [(int(i), [float(x) for x in centres[i % 20] + rng.normal(size=8)]) for i in range(4_000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    asked, sent, _ = knn.join_sides(df, 50, 5, 8, 200, 40, 10_000)
    assert sent.count() < 0.6 * 4_000 * asked.select("grp").distinct().count()
    assert asked.count() < 0.6 * 80 * 20
    got = Counter((r["query_id"], -r["score"], r["vec_id"]) for r in knn.top_k(df, group=8, slice_rows=200, n_pivots=40).collect())
    assert got == naive_top(rows, 50, 5)
    asked, sent, _ = knn.join_sides(df, 50, 5, knn.GROUP, knn.SLICE, None, knn.BROADCAST_BOUNDS)
    assert sent.count() <= 4_000 and asked.count() <= 80  # few queries are one group: no vector is sent twice


def test_top_k_of_few_and_none(spark):
    ddl = "vec_id long, embedding array<float>"
    assert knn.top_k(spark.createDataFrame([], ddl)).count() == 0
    assert knn.top_k(spark.createDataFrame([(0, None)], ddl)).count() == 0
    two = knn.top_k(spark.createDataFrame([(0, [1.0, 0.0]), (7, [0.5, 0.0])], ddl)).collect()
    assert [tuple(r) for r in two] == [(0, 1, 7, 256 * 128)]
    large = knn.top_k(spark.createDataFrame([(0, [1.0, 2.0]), (1, [1e14, 1.0]), (2, [3.0, 4.0])], "vec_id long, embedding array<double>"))
    assert sorted((r["rank"], r["vec_id"], r["score"]) for r in large.collect()) == [(1, 1, 65536 * (10**14 + 2)), (2, 2, 65536 * 11)]


def test_equal_rows_are_dealt_to_many_slices(spark):
    """30,000 rows equal in id and vector: no slice holds more than a few above its limit."""
    same = spark.range(30_000).select(F.lit(7).cast("long").alias("vec_id"), F.array(F.lit(0.5), F.lit(0.25)).cast("array<float>").alias("embedding"))
    few = spark.createDataFrame([(0, [1.0, 0.0]), (50, [0.0, 1.0]), (51, [0.1, 0.1])], "vec_id long, embedding array<float>")
    asked, sent, _ = knn.join_sides(same.unionByName(few), 50, 5, knn.GROUP, 1_000, 2, knn.BROADCAST_BOUNDS)
    assert max(r["count"] for r in sent.groupBy("grp", "slice").count().collect()) < 1_300
    got = sorted(map(tuple, knn.top_k(same.unionByName(few), slice_rows=1_000, n_pivots=2).collect()))
    assert got == [(q, rank, 7, 256 * (128 if q == 0 else 64)) for q in (0, 50) for rank in range(1, 6)]


def test_large_components_stay_exact():
    q, x = np.array([[3e8, 1.0]]), np.array([[3e8, 2.0], [3e8, 1.0], [1.0, 1.0]])
    found = knn.best_of(q, np.array([0]), x, np.array([5, 6, 7]), 2)
    assert found == [(0, 5, 9 * 10**16 + 2), (0, 6, 9 * 10**16 + 1)]


# --- 6, its graph


def test_components_equal_union_find(spark):
    rng = random.Random(6)
    edges = [(rng.randint(-500, 500), rng.randint(-500, 500)) for _ in range(450)] + [(i, i + 1) for i in range(1000, 1200)] + [(5000, i) for i in range(5001, 5300)] + [(7, 7)]
    group = {}

    def root(x):
        while group.setdefault(x, x) != x:
            x = group[x]
        return x

    for a, b in edges:
        ra, rb = root(a), root(b)
        group[max(ra, rb)] = min(ra, rb)
    got = {r["node"]: r["root"] for r in graph.star_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: root(n) for a, b in edges for n in (a, b) if root(n) != n}
    assert graph.star_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_samples_by_hash_hold_the_smallest(spark):
    from tessera.llm.common import smallest

    df = spark.range(50_000)
    key = F.xxhash64("id")
    few = smallest(df, key, 100, 50_000)
    assert 200 < few.count() < 800
    assert few.orderBy(key).limit(100).collect() == df.orderBy(key).limit(100).collect()
    assert smallest(df, key, 10_000, 50_000).count() == 50_000


# --- 8


def test_classifier_ranks_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.classify(docs, labels).join(labels, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r["held_out"]]
    good, bad = ([r["score"] for r in held if r["quality"] == q] for q in (1, 0))
    assert sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad)) > 0.9
    assert sum(r["predicted"] == r["quality"] for r in held) / len(held) > 0.95


def test_classifier_of_repeated_rows(spark):
    """Rows of a labelled id, equal or not, change neither the bound of what the driver reads nor, if equal, the model."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.select("doc_id", "text")
    plain = quality.train(docs, labels, per_class=20)
    chosen = [r["doc_id"] for r in quality.labelled_sample(labels, 20).collect()]
    again = docs.where(F.col("doc_id").isin(chosen)).crossJoin(spark.range(100)).drop("id")
    assert quality.train(docs.unionByName(again), labels, per_class=20) == plain
    one = next(r["doc_id"] for r in quality.labelled_sample(labels, 20).collect() if r["fold"] == quality.FIT_CURVE)
    texts = spark.range(10_000).select(F.lit(one).alias("doc_id"), F.concat(F.lit("words of text number "), "id").alias("text"))
    sizes = []
    fit = quality.fit_curve
    quality.fit_curve = lambda rows, *a: sizes.append(len(rows)) or fit(rows, *a)
    try:
        quality.train(docs.unionByName(texts), labels, per_class=20)
    finally:
        quality.fit_curve = fit
    assert sizes and sizes[0] <= 40


def test_classifier_equals_a_plain_version(spark):
    """Everything anew in plain Python: folds, blocks, dictionaries, sizes from fresh compressors, the curve by small steps."""
    import math

    import zstandard

    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    known = [(r["doc_id"], r["quality"]) for r in labels.collect() if r["quality"] in (0, 1) and r["doc_id"] in texts]

    def remainder(doc_id):
        return zlib.crc32(str(doc_id).encode()) % 3

    trained = []
    for q in (1, 0):
        pieces = sorted((zlib.crc32(b, d), b) for d, y in known if y == q and remainder(d) == 0 for i in range(0, len(texts[d]), 2048) if (b := texts[d][i : i + 2048]))
        samples = [b for _, b in pieces]
        size = min(112_640, max(1_024, sum(map(len, samples)) // 4))
        try:
            trained.append(zstandard.train_dictionary(size, samples).as_bytes())
        except zstandard.ZstdError:
            trained.append(b"".join(samples)[-size:])

    def inputs(text):
        sizes = [0, 0]
        for i in range(0, len(text), 2048):
            for k, d in enumerate(trained):
                fresh = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False)
                sizes[k] += len(fresh.compress(text[i : i + 2048]))
        ratio = math.log(sum(sizes) / (2 * len(text)))
        return (sizes[0] - sizes[1]) / sum(sizes), ratio, ratio**2

    fit = [(inputs(texts[d]), y) for d, y in known if remainder(d) == 2 and texts[d]]
    columns = list(zip(*(x for x, _ in fit), strict=True))
    means = [sum(c) / len(c) for c in columns]
    scales = [math.sqrt(sum((v - m) ** 2 for v in c) / len(c)) + 1e-9 for c, m in zip(columns, means, strict=True)]

    def scaled(x):
        return [1.0, *((v - m) / s for v, m, s in zip(x, means, scales, strict=True))]

    x, y = np.array([scaled(v) for v, _ in fit]), np.array([q for _, q in fit], float)
    w, pull = np.zeros(4), np.array([0.0, *[1e-2 * len(y) / 100] * 3])
    for _ in range(400_000):  # plain descent to the one minimum
        slope = x.T @ (1 / (1 + np.exp(-x @ w)) - y) + pull * w
        if np.abs(slope).max() < 1e-7:
            break
        w -= slope * 4 / (len(y) * np.abs(x).sum(axis=1).max())
    got = {r["doc_id"]: r for r in queries.op8_quality_classifier(spark, SF).collect()}
    assert len(got) == len(texts)
    for doc_id, text in texts.items():
        expected = 1 / (1 + math.exp(-min(35, max(-35, float(np.array(scaled(inputs(text))) @ w))))) if text else sum(y) / len(y)
        assert got[doc_id]["score"] == pytest.approx(expected, abs=2e-3)
        assert got[doc_id]["held_out"] == (remainder(doc_id) == 1) and got[doc_id]["predicted"] == int(got[doc_id]["score"] >= 0.5)


def test_classifier_learns_nothing_from_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("quality", F.when(quality.fold(F.col("doc_id")) == quality.HELD_OUT, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert Counter(map(tuple, quality.classify(docs, labels).collect())) == Counter(map(tuple, quality.classify(docs, turned).collect()))


def test_classifier_edges(spark):
    docs = spark.createDataFrame(sample(), DDL)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in quality.classify(docs, none).collect()} == {0.5}
    odd = spark.createDataFrame([(7, 1), (7, 1), (14, 0), (21, None), (None, 1), (28, 5), (35, 1), (42, 0), (49, 1), (56, 0)], "doc_id long, quality int")
    scores = quality.classify(docs, odd).collect()
    assert len(scores) == len(sample()) and all(0 <= r["score"] <= 1 for r in scores)
    assert quality.classify(docs.limit(0), odd).count() == 0


# --- the pipeline


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Every stage's input and output on the awkward rows, written and read again."""
    docs = spark.createDataFrame(sample(), DDL).select("doc_id", "text", "lang", "source", "n_chars")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, docs, SF).write.parquet(path)
        after = spark.read.parquet(path)
        out[name] = ([tuple(r) for r in docs.collect()], [tuple(r) for r in after.collect()], after.columns)
        docs = after
    return out


def test_stages_keep_the_columns(stages):
    for name in list(stages)[:-1]:
        assert stages[name][2] == ["doc_id", "text", "lang", "source", "n_chars"]


def test_quality_stage_drops_what_the_rules_reject(stages):
    before, after, _ = stages["quality_rules"]
    fails = Counter()
    for r in before:
        fails[r[3]] += naive_rules(r[1])[-1]
    kept = [r for r in before if not naive_rules(r[1])[-1]]
    assert all(2 * n <= sum(r[3] == h for r in before) + 2 for h, n in fails.items())  # no host is near the limit
    assert Counter(after) == Counter(kept)


def test_line_stage_equals_plain_python(stages):
    before, after, _ = stages["line_dedup"]
    expected = Counter()
    for (doc_id, _, _, digest), n in naive_lines(before).items():
        expected[(doc_id, digest)] += n
    assert Counter((r[0], sha(r[1])) for r in after) == expected
    assert all(r[4] == len(r[1]) for r in after)


def test_near_duplicate_stage_keeps_one_of_each(stages):
    before, after, _ = stages["simhash_dedup"]
    groups = {r[2] for r in naive_components(before)}
    assert sorted(r[0] for r in after if r[0] is not None) == sorted(g for g in groups if g is not None)
    assert not Counter(after) - Counter(before)


def test_mix_stage_takes_what_the_counts_say(spark, stages):
    before, after, _ = stages["mix_sources"]
    frame = spark.createDataFrame(before, "doc_id long, text string, lang string, source string, n_chars long")
    expected = Counter()
    for r in mixing.mix_counts(frame).collect():
        expected[r["doc_id"]] += r["taken"]
    got = Counter()
    for r in after:
        got[r[0]] += len(WORD.findall(r[1]))
    assert +got == +expected


def test_last_stage_encodes_every_row(stages):
    before, after, _ = stages["bpe_encode"]
    own = bpe.WordBpe(queries.vocabulary_path())
    expected = Counter((r[0], len(own.encode(r[1])), sha(own.decode(own.encode(r[1])))) for r in before)
    assert Counter((r[0], r[1], r[3]) for r in after) == expected


def test_run_equals_the_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert Counter(map(tuple, corpus_pipeline.run(spark, SF).collect())) == Counter(map(tuple, docs.collect()))


def test_empty_corpus_passes_through(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def test_stages_carry_columns_of_any_name(spark):
    """Extra columns, also with names that the operators use themselves, come through every stage but the last."""
    odd = "line_dedup row bits line o whole copy print turn spans text_crc32 n_words kept size shard fp".split()
    docs = spark.createDataFrame(sample(), DDL).select("doc_id", "text", "lang", "source", "n_chars", *[F.col("doc_id").alias(c) for c in odd])
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        if name != "bpe_encode":
            assert docs.columns == columns
            docs = spark.createDataFrame(docs.collect(), docs.schema)
            assert all(r["doc_id"] == r["fp"] == r["row"] for r in docs.collect())
    assert docs.count() > 0


def test_every_operator_has_one_query():
    names = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES)
    assert names == list(range(1, 11)) and set(queries.ORACLES) <= set(queries.QUERIES)
