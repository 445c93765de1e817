"""URL filters by Bloom filter cascades (operator 13), DataFrame functions only.

Method: a listed key is a host, or a host and the beginning of a path; it fits its host and all subdomains. The
key universe of a corpus is every key that any of its urls could be listed under: its hosts' suffixes by the
beginnings of its paths, in the shapes (labels, path lengths) that the list has. Level 0 of a cascade is a Bloom
filter of the listed keys that the universe holds; level 1 one of the unlisted keys that level 0 lets through;
level 2 one of the listed keys that level 1 lets through; and so on until nothing is let through wrongly. Every
key of the universe is then told exactly, by the parity of the first level that lacks it: a page's verdict is an
expression over its own url, without a join. Rules are two cascades (allow, block), of which the longest key that
fits decides; where none fits, a third cascade over a list of unwanted hosts does.

Scale: pages are read twice, the url column alone, and never exchanged. The universe costs two exchanges of
distinct keys after partial aggregation, so a host of a third of all rows is a few rows a task. Levels are built
from the rows that the level before let through, so their sizes shrink about 40-fold at each second step. A
filter travels as a literal of at most ``MOST_WORDS`` words, which is counted first; a list that needs more is
cut into parts by a hash of the key, each with a cascade of its own, which pages pass one after another.

Cases: a null url, or one without ``://``, has an empty host and path and fits no rule; ports and user names are
part of the host, as the text has them; repeated pages are judged alike; an empty table gives an empty result;
keys listed twice count once, a key that is allowed and blocked is blocked; of two keys of equal length that both
fit, that with the longer host decides. DNS has names of at most 127 labels: of a longer host the last 127 count.
Only the columns named are read, so clashing names in other columns are of no effect.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import durable, stored

#: Longest fitting rule wins: (verdict, host and beginning of the path).
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
#: Parts of a host's label, between hyphens, that put the host on the list where no other list is given.
UNWANTED = ("ads", "adult", "bets", "casino", "pills", "spam")
BITS = 8  # of a filter for each key
PROBES = 4
MOST_LABELS = 127
MOST_WORDS = 1 << 20  # 8 MB a level
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

Shape = tuple[int, list[int]]
Level = tuple[Column, int]


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def _let(value: Column, body) -> Column:
    """Bind ``value`` once as a lambda variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


def candidates(host: Column, path: Column, shape: Shape) -> Column:
    """The keys that a url could be listed under, longest first; an empty host has none."""
    labels, lengths = shape
    keys = F.flatten(
        F.transform(
            F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(max(1, labels))), lambda i: F.call_function("substring_index", host, F.lit("."), -i))),
            lambda suffix: F.transform(
                F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length(path)),
                lambda n: F.struct((-F.length(suffix) - n).alias("least"), (-F.length(suffix)).alias("host"), F.concat(suffix, F.substring(path, 1, n)).alias("key")),
            ),
        )
    )
    return F.when(host != "", F.transform(F.array_sort(keys), lambda k: k["key"])).otherwise(F.array().cast("array<string>"))


def _shape(keys: DataFrame) -> Shape:
    """Labels of the hosts and lengths of the paths in a list of keys; both are bounded by the longest key."""
    host, path = F.regexp_extract("key", "^[^/]*", 0), F.regexp_extract("key", "^[^/]*(.*)$", 1)
    found = keys.agg(F.max(F.length(host) - F.length(F.translate(host, ".", "")) + 1).alias("labels"), F.collect_set(F.length(path)).alias("lengths")).first()
    return min(found["labels"] or 0, MOST_LABELS), sorted(found["lengths"])


def _positions(key: Column, level: int, bits: int) -> Column:
    """Double hashing: ``PROBES`` places of a key in a filter."""
    return _let(
        F.xxhash64(F.lit(level), key),
        lambda h: F.transform(
            F.array(*[F.lit(i).cast("long") for i in range(PROBES)]),
            lambda i: (F.shiftrightunsigned(h, 32) + i * h.bitwiseAND(F.lit(0xFFFFFFFF).cast("long")).bitwiseOR(F.lit(1).cast("long"))) % bits,
        ),
    )


def _passes(key: Column, level: int, found: Level) -> Column:
    words, bits = found
    return F.forall(_positions(key, level, bits), lambda at: F.call_function("getbit", F.get(words, F.floor(at / 64).cast("int")), (at % 64).cast("int")) == 1)


def _filter(keys: DataFrame, n: int, level: int) -> Level:
    """A Bloom filter of ``n`` keys: words of 64 bits, as one literal. The driver reads at most n * BITS / 64 rows."""
    size = max(1, math.ceil(n * BITS / 64))
    bits = keys.select(F.explode(_positions(F.col("key"), level, size * 64)).alias("at"))
    words = [0] * size
    one = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 64).cast("int"))
    for word, value in bits.groupBy(F.floor(F.col("at") / 64).alias("word")).agg(F.bit_or(one)).collect():
        words[word] = value
    return F.from_json(F.lit(f"[{','.join(map(str, words))}]"), "array<bigint>"), size * 64  # folded once, when planned


def cascade(keys: DataFrame) -> list[Level]:
    """The levels for ``keys`` (key, listed), the key universe; they tell each of its keys exactly."""
    levels: list[Level] = []
    sides = [keys.where("listed"), keys.where("not listed")]
    while n := sides[0].count():
        levels.append(_filter(sides[0], n, len(levels)))
        through = sides[1].where(_passes(F.col("key"), len(levels) - 1, levels[-1]))
        sides = [durable(through), sides[0]]
    return levels


def member(key: Column, levels: list[Level]) -> Column:
    found = F.lit(len(levels) % 2 == 1)
    for i in range(len(levels) - 1, -1, -1):
        found = F.when(_passes(key, i, levels[i]), found).otherwise(F.lit(i % 2 == 1))
    return found


def universe(urls: DataFrame, listed: DataFrame, shape: Shape) -> DataFrame:
    """key, listed: all keys that the urls (host, path) could be listed under, and whether they are."""
    heads = urls.select("host", F.substring("path", 1, max(shape[1], default=0)).alias("path")).distinct()
    asked = heads.select(F.explode(candidates(F.col("host"), F.col("path"), shape)).alias("key"))
    both = asked.select("key", F.lit(False).alias("listed")).unionByName(listed.select("key", F.lit(True).alias("listed")))
    return both.groupBy("key").agg(F.max("listed").alias("listed"), F.min("listed").alias("only")).where("not only").drop("only")


def cascades(urls: DataFrame, listed: DataFrame, most_words: int = MOST_WORDS) -> tuple[Shape, list[list[Level]]]:
    """The list's shape, and a cascade for each of its parts; one part unless the filters would outgrow a literal."""
    shape = _shape(listed)
    keys = durable(universe(urls, listed, shape))
    parts = max(1, math.ceil(keys.where("listed").count() * BITS / 64 / most_words))
    return shape, [cascade(keys.where(_part(F.col("key"), parts) == i) if parts > 1 else keys) for i in range(parts)]


def _part(key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(-1), key), F.lit(parts))


def unwanted_hosts(urls: DataFrame, parts: Iterable[str] = UNWANTED) -> DataFrame:
    """key: the corpus's hosts with an unwanted part in a label, from that label on."""
    label = f"(?:[^.]*-)?(?:{'|'.join(parts)})(?:-[^.]*)?"
    name = F.call_function("substring_index", F.col("host"), F.lit("."), F.lit(-MOST_LABELS))
    key = F.regexp_extract(name, rf"(?:^|\.)({label}(?:\..*)?)$", 1)
    return urls.select(key.alias("key")).where("key <> ''").distinct()


def judge_urls(
    pages: DataFrame,
    rules: Iterable[tuple[str, str]] = RULES,
    listed: DataFrame | None = None,
    id_column: str = "page_id",
    url_column: str = "url",
    most_words: int = MOST_WORDS,
) -> DataFrame:
    """page_id, host, path, rule and verdict of every page.

    ``listed`` (key) holds further blocked hosts, or hosts and beginnings of paths, of any number; they decide
    where no rule fits. Without it, hosts with an unwanted word are listed.
    """
    spark, rules = pages.sparkSession, tuple(rules)
    host, path = host_and_path(F.col(url_column))
    urls = pages.select(F.col(id_column).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    judged = urls.withColumn("rule", F.lit(None).cast("string")).withColumn("blocked", F.lit(False))
    by_rule = {"block": _keys(spark, [k for v, k in rules if v == "block"])}
    by_rule["allow"] = _keys(spark, [k for v, k in rules if v == "allow"]).exceptAll(by_rule["block"])
    for verdict, keys in by_rule.items():
        for found in _judged_by(urls, keys, most_words):
            hit = F.get(F.filter(found[0], found[1]), 0)
            longer = hit.isNotNull() & (F.col("rule").isNull() | _outranks(F.col("hit"), F.col("rule")))
            judged = judged.withColumn("hit", hit).withColumn("blocked", F.when(longer, verdict == "block").otherwise(F.col("blocked")))
            judged = judged.withColumn("rule", F.when(longer, F.col("hit")).otherwise(F.col("rule"))).drop("hit")
            judged = found[2](judged)
    keys = unwanted_hosts(urls) if listed is None else _lowered(listed).distinct()
    for found in _judged_by(urls, keys, most_words):
        judged = found[2](judged.withColumn("blocked", F.col("blocked") | (F.col("rule").isNull() & F.exists(found[0], found[1]))))
    return judged.select("page_id", "host", "path", "rule", F.when(F.col("blocked"), "block").otherwise("allow").alias("verdict"))


def _lowered(keys: DataFrame) -> DataFrame:
    return keys.select(F.concat(F.translate(F.regexp_extract("key", "^[^/]*", 0), UPPER, LOWER), F.regexp_extract("key", "^[^/]*(.*)$", 1)).alias("key"))


def _outranks(hit: Column, rule: Column) -> Column:
    host = lambda key: F.length(F.regexp_extract(key, "^[^/]*", 0))
    return (F.length(hit) > F.length(rule)) | ((F.length(hit) == F.length(rule)) & (host(hit) > host(rule)))


def _judged_by(urls: DataFrame, keys: DataFrame, most_words: int):
    """For each part of a list: a url's candidates, the test of one, and what must happen to rows between parts."""
    shape, parts = cascades(urls, keys, most_words)
    asked = candidates(F.col("host"), F.col("path"), shape)
    for i, levels in enumerate(parts):
        yield asked, _test(levels, i, len(parts)), (stored if len(parts) > 1 else lambda df: df)


def _test(levels: list[Level], part: int, parts: int):
    """A cascade is exact for the keys of its own part alone."""
    return lambda key: (_part(key, parts) == part) & member(key, levels) if parts > 1 else member(key, levels)


def _keys(spark: SparkSession, keys: list[str]) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*[F.lit(k) for k in sorted(set(keys))]).cast("array<string>")).alias("key"))


ORACLE = f"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT row_number() OVER () AS rid, page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), '{UPPER}', '{LOWER}') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(verdict, rule, rhost, rpath) AS (VALUES
  ('allow', 'org/', 'org', '/'),
  ('block', 'example.org/es/', 'example.org', '/es/'),
  ('block', 'example.org/en/1', 'example.org', '/en/1'),
  ('allow', 'com/fr/', 'com', '/fr/'),
  ('block', 'com/de/', 'com', '/de/')),
f AS (
  SELECT rid, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM p JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY rid)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN
    regexp_matches(host, '(^|\\.)([^.]*-)?({'|'.join(UNWANTED)})(-[^.]*)?(\\.|$)') THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN f USING (rid)
"""
