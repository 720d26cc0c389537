"""URL rules by Bloom filter cascades: exact membership of a key without a join.

A rule is a host and the start of a path, and it fits the host's subdomains too. A url is
asked for as the few keys that some rule could have: ends of its host with starts of its
path. The first filter of a cascade holds the listed keys; the second those other keys
of the corpus that the first lets through; the third the listed keys that the second lets
through, and so on until nothing is let through wrongly. As all keys of the corpus were
tried while it was built, a cascade answers for every one of them exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringfold.llm.text import mix
from ringfold.workdir import stored

ALLOW, BLOCK = "allow", "block"
#: Listed keys whose filters are alive at once, at most about 75 MB; more are taken in several passes.
MOST_KEYS = 1 << 24
#: The first filter lets through no more keys than are listed, but is never sharper than this.
LEAST_RATE = 2.0**-24
#: Levels after the first let half of the wrong keys through.
NEXT_RATE = 0.5
_BLOCK_WORDS = 1 << 16


class Bloom(NamedTuple):
    """A Bloom filter over pairs of 64-bit hashes; ``words`` of 64 bits, ``probes`` bits per key."""

    words: np.ndarray
    probes: int
    level: int

    def holds(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        found = np.ones(len(h1), bool)
        if not len(self.words):
            return ~found
        for at in positions(h1, h2, self.level, self.probes, len(self.words)):
            found &= (self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return found


def positions(h1: np.ndarray, h2: np.ndarray, level: int, probes: int, words: int) -> Iterator[np.ndarray]:
    """Bit numbers of keys in a filter of ``words`` words, one array per probe; levels differ."""
    first, step = mix(h1 + np.uint64(level)), mix(h2 ^ np.uint64(level)) | np.uint64(1)
    for i in range(probes):
        yield mix(first + np.uint64(i) * step) % np.uint64(words << 6)


def filter_size(keys: int, rate: float) -> tuple[int, int]:
    """Words and probes of a filter for so many keys that lets through ``rate`` of the others."""
    bits = math.log2(1 / rate)
    return max(1, math.ceil(keys * bits / math.log(2) / 64)), max(1, round(bits))


class Cascade(NamedTuple):
    levels: list[Bloom]

    def listed(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Whether keys are listed: the number of filters that hold a key, one after another, is odd."""
        answer = np.zeros(len(h1), bool)
        asked = np.arange(len(h1))
        for bloom in self.levels:
            asked = asked[bloom.holds(h1[asked], h2[asked])]
            if not len(asked):
                break
            answer[asked] ^= True
        return answer


def _hashes(key: Column) -> tuple[Column, Column]:
    # the second is seeded by its first argument, so that it does not follow from the first
    return F.xxhash64(key), F.xxhash64(F.lit(1), key)


def url_host(url: Column) -> Column:
    """What follows the first ``://`` up to a slash, question or number sign, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to a question or number sign; else empty."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_rows(rules: DataFrame) -> DataFrame:
    """Distinct ``key, blocks, labels, length, h1, h2`` of rules ``host, path, verdict``.

    A key is host and path put together. Of a key with both verdicts the block counts. Rules
    with a null or a verdict of another name are left out.
    """
    host = F.translate(F.col("host"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    labels = F.when(host == "", 0).otherwise(F.size(F.split(host, r"\.")))
    rows = rules.where(F.col("verdict").isin(ALLOW, BLOCK) & F.col("host").isNotNull() & F.col("path").isNotNull()).select(
        F.concat(host, "path").alias("key"), (F.col("verdict") == BLOCK).alias("blocks"), labels.alias("labels"), F.length("path").alias("length")
    )
    h1, h2 = _hashes(F.col("key"))
    return rows.groupBy("key", "labels", "length").agg(F.max("blocks").alias("blocks")).withColumns({"h1": h1, "h2": h2})


def _candidates(shapes: list[tuple[int, int]]) -> Column:
    """Keys of ``host`` and ``path`` in these shapes, as structs ``size, labels, key, h1, h2``, longest first.

    A shape is a number of host labels from the end, and one of path characters from the start.
    """
    if not shapes:
        return F.array().cast("array<struct<size:int,labels:int,key:string,h1:bigint,h2:bigint>>")
    listed = ",".join(f"named_struct('labels',{a},'length',{b})" for a, b in shapes)
    keys = f"""
      transform(filter(array({listed}), s -> s.labels <= if(host = '', 0, size(split(host, '[.]'))) and s.length <= length(path)),
        s -> named_struct('labels', s.labels, 'key', concat(if(s.labels = 0, '', substring_index(host, '.', -s.labels)), left(path, s.length))))"""
    full = f"transform({keys}, k -> named_struct('size', length(k.key), 'labels', k.labels, 'key', k.key, 'h1', xxhash64(k.key), 'h2', xxhash64(1, k.key)))"
    return F.expr(f"sort_array({full}, false)")


def _bits(keys: DataFrame, level: int, rate: float, count: int) -> Bloom:
    """A filter of all ``keys`` (h1, h2). Its words are put together per block before they reach the driver."""
    words, probes = filter_size(count, rate)

    def set_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h1, h2 = (batch.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in ("h1", "h2"))
            at = np.concatenate([np.zeros(0, np.uint64), *positions(h1, h2, level, probes, words)])
            word, inverse = np.unique(at >> np.uint64(6), return_inverse=True)
            bits = np.zeros(len(word), np.uint64)
            np.bitwise_or.at(bits, inverse, np.uint64(1) << (at & np.uint64(63)))
            yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(bits.view(np.int64))], names=["word", "bits"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word = batch.column("word").to_numpy(zero_copy_only=False)
            bits = batch.column("bits").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array([word.tobytes()], pa.binary()), pa.array([bits.tobytes()], pa.binary())], names=["word", "bits"])

    set_words = keys.select("h1", "h2").mapInArrow(set_bits, "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    whole = np.zeros(words, np.uint64)
    for row in set_words.mapInArrow(blocks, "word binary, bits binary").toLocalIterator():
        whole[np.frombuffer(row.word, np.int64)] = np.frombuffer(row.bits, np.uint64)
    return Bloom(whole, probes, level)


def _let_through(keys: DataFrame, blooms: list[Bloom]) -> DataFrame:
    """``keys`` with ``passed``, an array of the numbers of the filters that hold a key."""
    shared = keys.sparkSession.sparkContext.broadcast(blooms)

    @F.arrow_udf("bigint")
    def passed(h1: pa.Array, h2: pa.Array) -> pa.Array:
        a, b = (h.to_numpy(zero_copy_only=False).view(np.uint64) for h in (h1, h2))
        mask = np.zeros(len(a), np.int64)
        for i, bloom in enumerate(shared.value):
            mask |= bloom.holds(a, b).astype(np.int64) << i
        return pa.array(mask)

    return keys.withColumn("passed", passed("h1", "h2")).where("passed <> 0")


def fit_cascades(lists: list[DataFrame], universe: DataFrame, distinct: int) -> list[Cascade]:
    """A cascade per list of keys (key, h1, h2), exact for every key of ``universe``.

    ``distinct``: about how many different keys the universe has, which sets the first
    filters' sharpness: what they let through is then about as much as is listed, whatever
    the size of the corpus. All lists (at most 62) share one pass over the universe. Keys
    are held apart by 128 bits of hash.
    """
    lists = [stored(rows.select("key", "h1", "h2"), "urls-listed") for rows in lists]
    counts = [rows.count() for rows in lists]
    rates = [min(NEXT_RATE, max(LEAST_RATE, n / (math.sqrt(2) * max(1, distinct - n)))) for n in counts]
    first = [_bits(rows, 0, rate, n) for rows, rate, n in zip(lists, rates, counts, strict=True)]
    # different keys that any first filter lets through; listed ones among them are told by a flag
    let = _let_through(universe.select("key", "h1", "h2"), first).groupBy("key", "h1", "h2").agg(F.first("passed").alias("passed"))
    let = stored(let, "urls-let-through")
    cascades = []
    for i, (rows, n) in enumerate(zip(lists, counts, strict=True)):
        own = let.where(F.shiftright("passed", i) % 2 == 1).select("key", "h1", "h2", F.lit(False).alias("is_listed"))
        both = own.unionByName(rows.withColumn("is_listed", F.lit(True)))
        wrong = both.groupBy("key", "h1", "h2").agg(F.max("is_listed").alias("is_listed")).where("NOT is_listed")
        cascades.append(_cascade(first[i], rows, stored(wrong.select("h1", "h2"), "urls-wrong")) if n else Cascade([]))
    return cascades


def _cascade(first: Bloom, listed: DataFrame, wrong: DataFrame) -> Cascade:
    """Filters over ``wrong`` and ``listed`` keys in turns, until one lets none of the others through."""
    levels, keep, other = [first], listed.select("h1", "h2"), wrong
    while n := other.count():
        levels.append(_bits(other, len(levels), NEXT_RATE, n))
        keep, other = other, stored(_let_through(keep, levels[-1:]).select("h1", "h2"), "urls-wrong")
    return Cascade(levels)


def _asked(rows: DataFrame, cascades: list[Cascade]) -> DataFrame:
    """``rows`` with ``found``: 2 * (place among the keys) + (1 if it blocks) of the first listed key, else null."""
    shared = rows.sparkSession.sparkContext.broadcast(cascades)

    @F.arrow_udf("bigint")
    def ask(keys: pa.Array) -> pa.Array:
        flat, sizes = keys.flatten(), keys.value_lengths().to_numpy(zero_copy_only=False)
        h1, h2 = (flat.field(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in ("h1", "h2"))
        found = np.full(len(keys), -1, np.int64)
        starts = np.r_[0, np.cumsum(sizes)]
        for blocks, cascade in enumerate(shared.value):
            hit = np.flatnonzero(cascade.listed(h1, h2))
            row = np.searchsorted(starts, hit, "right") - 1
            row, least = np.unique(row, return_index=True)
            place = (hit[least] - starts[row]) * 2 + blocks
            found[row] = np.where(found[row] < 0, place, np.minimum(found[row], place))
        return pa.array(found, mask=found < 0)

    return rows.withColumn("found", F.least("found", ask(F.transform("keys", lambda k: F.struct(k["h1"].alias("h1"), k["h2"].alias("h2"))))))


def judged_urls(
    pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", most_keys: int = MOST_KEYS
) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict.

    ``rules``: host, path, verdict (allow or block), see `rule_rows`. A rule fits its host and
    all subdomains where the path starts with the rule's; of those that fit the one with
    the most characters counts, of these the one with the most host labels. Urls that no
    rule fits are in no list and allowed, with a null ``rule``. A url that is null or has no
    ``://`` has an empty host and path, which only a rule without both fits. Repeated rows
    are judged each. Empty tables of pages or rules give no rows, or all allowed. Other columns
    are not read.
    """
    listed = stored(rule_rows(rules), "urls-rules")
    shapes = sorted((r.labels, r.length) for r in listed.select("labels", "length").distinct().collect())
    url = F.col(f"`{url_col}`").cast("string")
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), url_host(url).alias("host"), url_path(url).alias("path"))
    rows = rows.withColumn("keys", _candidates(shapes)).withColumn("found", F.lit(None).cast("bigint"))
    universe = rows.select(F.explode("keys").alias("k")).select("k.key", "k.h1", "k.h2")
    distinct = universe.agg(F.approx_count_distinct("h1")).first()[0] if shapes else 0
    passes = max(1, -(-listed.count() // most_keys))
    for i in range(passes):
        part = listed.where(F.pmod("h1", F.lit(passes)) == i)
        cascades = fit_cascades([part.where("NOT blocks"), part.where("blocks")], universe, distinct)
        rows = _asked(rows, cascades)
        if passes > 1:
            # filters of one pass are gone before the next one's are made
            rows = stored(rows, "urls-found")
    rule = F.element_at("keys", (F.shiftright("found", 1) + 1).cast("int"))["key"]
    verdict = F.when(F.col("found") % 2 == 1, BLOCK).otherwise(ALLOW)
    return rows.select("page_id", "host", "path", F.when(F.col("found").isNotNull(), rule).alias("rule"), verdict.alias("verdict"))


def rules_sql(rules: list[tuple[str, str, str]]) -> str:
    listed = ", ".join(f"('{host}', '{path}', '{verdict}')" for host, path, verdict in rules)
    return rf"""
WITH rules(host, path, verdict) AS (VALUES {listed}), cut AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path, row_number() OVER () AS pos
  FROM pages
), fit AS (
  SELECT c.pos, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS verdict
  FROM cut c JOIN rules r ON (c.host = r.host OR ends_with(c.host, '.' || r.host)) AND starts_with(c.path, r.path)
  GROUP BY c.pos
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM cut LEFT JOIN fit USING (pos)
"""
