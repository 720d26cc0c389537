"""Exact n-gram Jaccard join with skipping by the relations of sets.

Sets of word n-grams are ordered by one order of all n-grams, frequent ones last. Two sets
that are similar enough share an n-gram in their prefixes, so an inverted list of prefixes
finds every pair. Two kinds of work are skipped:

* Index level. A list entry carries its position and the size of its set. Entries are
  blocked by these, and blocks whose bounds cannot give the overlap are not met.
* Answer level. The members of a list are compared with one of them first, the one with the
  fewest n-grams of its own: of many near copies of a text, that text. Sets that are linked
  to it are already one component, so among them nothing is left to ask; and what is known
  about a set's distance to the common one bounds its distance to every set close to that
  one, by the triangle inequality of the Jaccard distance, before a pair of them is made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ringfold.llm.components import connected_components, extend_components
from ringfold.llm.samples import drawn
from ringfold.llm.text import NOT_SPACE, mix, run_hashes, runs_inside, split_words, text_slices, utf8
from ringfold.workdir import discard, stored

WORDS = 5
LEAST_PERCENT = 80
#: One document in so many is sampled for frequent n-grams, of which so many are known at most.
SAMPLE = 32
SAMPLE_HITS = 3
MOST_FREQUENT = 1 << 18
#: Members of a list beyond which it has more than one that all others are compared with, and how many.
LONG_LIST = 32
MORE_PIVOTS = 16
#: Documents to fetch up to which their ids are broadcast.
BROADCAST_IDS = 500_000


def shingles(column: pa.Array, words: int = WORDS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per slice of texts: row numbers and hashes of the distinct n-grams, sorted by both.

    Words are runs without ASCII white space, A-Z lower-cased. A text of fewer words than
    ``words`` but not none is one n-gram.
    """
    for a, b in text_slices(column, 1 << 20):
        data, offsets = utf8(column.slice(a, b - a))
        found = split_words(data, offsets, NOT_SPACE)
        counts = np.diff(found.first)
        starts = runs_inside(found, words)
        rows, hashes = found.row[starts], run_hashes(found.hash, words)[starts]
        for n in np.unique(counts[(counts > 0) & (counts < words)]).tolist():
            short = np.flatnonzero(counts == n)
            rows = np.append(rows, short)
            hashes = np.append(hashes, run_hashes(found.hash, n, seed=99)[found.first[short]])
        order = np.lexsort((hashes, rows))
        rows, hashes = rows[order], hashes[order]
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
        yield rows[new] + a, hashes[new]


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    """Elements of which similar sets share one: n - ceil(percent% of n) + 1, and none of an empty set."""
    return np.where(n > 0, n - (n * percent + 99) // 100 + 1, 0)


def _frequent(rows: DataFrame, words: int) -> np.ndarray:
    """Hashes of n-grams that a sample of documents has several times, in order."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, hashes in shingles(batch.column(1), words):
                gram, n = np.unique(hashes, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(n)], names=["gram", "n"])

    sample = rows.where(drawn(F.col("doc"), 1 / SAMPLE, 41)).mapInArrow(count, "gram bigint, n bigint")
    often = sample.groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") >= SAMPLE_HITS)
    best = often.orderBy(F.desc("n"), "gram").limit(MOST_FREQUENT).select("gram").toArrow()
    return np.sort(best.column("gram").to_numpy().view(np.uint64))


def _measured(rows: DataFrame, frequent: np.ndarray, words: int, percent: int) -> DataFrame:
    """Per document ``doc, n, h1, h2, prefix, own``; equal sets have equal ``h1, h2``.

    ``own`` are the n-grams of the prefix that are not frequent, in hundredths of the set.
    """

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = np.zeros(batch.num_rows, np.int64)
            h1 = np.zeros(batch.num_rows, np.uint64)
            h2 = np.zeros(batch.num_rows, np.uint64)
            rare = np.zeros(batch.num_rows, np.int8)
            prefixes, lengths = [np.zeros(0, np.uint64)], np.zeros(batch.num_rows, np.int64)
            for rows, grams in shingles(batch.column(1), words):
                if not len(rows):
                    continue
                first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
                n = np.diff(np.r_[first, len(rows)])
                own = rows[first]
                total[own] = n
                h1[own] = np.add.reduceat(mix(grams ^ np.uint64(0x5851F42D4C957F2D)), first)
                h2[own] = np.add.reduceat(mix(grams + np.uint64(0x14057B7EF767814F)), first)
                often = np.zeros(len(grams), bool)
                if len(frequent):
                    at = np.minimum(np.searchsorted(frequent, grams), len(frequent) - 1)
                    often = frequent[at] == grams
                order = np.lexsort((grams, often, rows))
                within = np.arange(len(rows)) - np.repeat(first, n)
                lengths[own] = prefix_length(n, percent)
                inside = within < np.repeat(lengths[own], n)
                prefixes.append(grams[order][inside])
                rare[own] = np.add.reduceat((inside & ~often[order]).astype(np.int64), first) * 100 // n
            flat = np.concatenate(prefixes).view(np.int64)
            bounds = np.r_[0, np.cumsum(lengths)].astype(np.int32)
            prefix = pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat))
            hashes = [pa.array(h.view(np.int64)) for h in (h1, h2)]
            arrays = [batch.column(0), pa.array(total), *hashes, prefix, pa.array(rare)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc", "n", "h1", "h2", "prefix", "own"])

    return rows.mapInArrow(measure, "doc bigint, n bigint, h1 bigint, h2 bigint, prefix array<bigint>, own tinyint")


def _sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """``doc, grams`` of the wanted documents, sorted hashes as bytes."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams: list[bytes] = [b""] * batch.num_rows
            for rows, hashes in shingles(batch.column(1), words):
                first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]]) if len(rows) else []
                for part in np.split(np.arange(len(rows)), first[1:]) if len(first) else []:
                    grams[rows[part[0]]] = hashes[part].tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(grams, pa.binary())], names=["doc", "grams"])

    return stored(docs.join(_small(wanted), "doc").mapInArrow(collect, "doc bigint, grams binary"), "jaccard-sets")


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs ``a, b`` with their exact ``common`` and ``united``."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            common, united = [], []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                common.append(both)
                united.append(len(p) + len(q) - both)
            arrays = [batch.column("a"), batch.column("b"), pa.array(common, pa.int64()), pa.array(united, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["a", "b", "common", "united"])

    x = sets.select(F.col("doc").alias("a"), F.col("grams").alias("x"))
    y = sets.select(F.col("doc").alias("b"), F.col("grams").alias("y"))
    return pairs.select("a", "b").join(x, "a").join(y, "b").mapInArrow(
        compare, "a bigint, b bigint, common bigint, united bigint"
    )


def _reachable(n: Column, at: Column, m: Column, bt: Column, percent: int) -> Column:
    """Whether sets of sizes ``n`` and ``m`` with a common element at 0-based positions can be similar.

    All that follows the first common element may be common, and nothing before it.
    """
    most = F.least(n - at, m - bt)
    return (most * (100 + percent) >= (n + m) * percent) & (F.least(n, m) * 100 >= F.greatest(n, m) * percent)


def jaccard_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = WORDS,
    percent: int = LEAST_PERCENT,
) -> DataFrame:
    """Per row: ``doc_id, n_shingles, component_id``.

    A document's set are its distinct n-grams of ``words`` words (runs without ASCII white
    space, A-Z lower-cased); fewer words are one n-gram, and without words or text the set
    is empty and linked with nothing. Two documents are linked when ``100 * common >=
    percent * united``, exactly. ``component_id`` is the least id reachable by links, also
    through other documents. Rows that share an id are one document in components. Rows
    with a null id have the set of their text and a null component. Other columns are not
    read. The result is stored, and the tables it is made from are deleted as soon as no
    step reads them.
    """
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).cast("string").alias("text"))
    frequent = _frequent(texts, words)
    measured = stored(_measured(texts, frequent, words, percent), "jaccard-prefixes")
    # documents with equal sets are one class, named by its least id
    full = measured.where("n > 0 AND doc IS NOT NULL")
    classes = full.groupBy("h1", "h2", "n").agg(F.min("doc").alias("rep"))
    classes = stored(classes, "jaccard-classes")
    keys = ["doc", "h1", "h2"]
    copies = full.select("doc", "h1", "h2", "n").join(classes, ["h1", "h2", "n"]).where("doc > rep").select(*keys)
    copies = stored(copies, "jaccard-copies")
    heads = full.join(_small(copies), keys, "left_anti")
    if _repeats(full.select("doc")):
        heads = heads.dropDuplicates(keys)
    entries = heads.select(F.col("doc").alias("rep"), "n", "own", F.posexplode("prefix").alias("at", "gram"))
    # lists of frequent n-grams are long: they are spread by document, and not counted
    spread = _spread_frequent(entries, frequent)
    per = Window.partitionBy("gram", "spread")
    counted = spread.withColumn("low", F.min("rep").over(per)).withColumn("high", F.max("rep").over(per))
    lists = stored(counted.where("spread > 0 OR low < high").select("gram", "rep", "n", "own", "at"), "jaccard-lists")
    # first every member of a list against one of it, the same one in many lists
    pivots = lists.groupBy("gram").agg(_pivot().alias("pivot"))
    pivots = pivots.select("gram", F.col("pivot.rep").alias("pivot"), F.col("pivot.n").alias("pivot_n"))
    near = F.least("n", "pivot_n") * 100 >= F.greatest("n", "pivot_n") * percent
    first = lists.join(pivots, "gram").where((F.col("rep") != F.col("pivot")) & near)
    first = first.select(F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b")).distinct()
    first = stored(first, "jaccard-pairs")
    known, links = _verified(texts, heads, first, words, percent)
    components = stored(connected_components(links), "jaccard-components")
    # long lists ask several more of their members, of those that are not linked yet
    more = _more_pivots(lists, components, known, percent)
    if more.count():
        compared, links = _verified(texts, heads, more, words, percent)
        known, before = known.unionByName(compared), components
        components = extend_components(before, links)
        discard(before)
    # then whatever is still open between components
    again = _open_pairs(lists, components, known, percent)
    discard(lists, first, more, known)
    if again.count():
        compared, links = _verified(texts, heads, again, words, percent)
        before, components = components, extend_components(components, links)
        discard(before, compared)
    discard(again)
    of = components.withColumnRenamed("node", "rep")
    named = classes.join(of, "rep", "left").select("h1", "h2", "n", F.coalesce("component", "rep").alias("component"))
    # rows that share an id connect their classes
    shared = full.groupBy("doc").agg(F.count("*").alias("rows")).where("rows > 1").select("doc")
    named = _joined_by_id(full, named, shared)
    alone = measured.where("n = 0 OR doc IS NULL").select("doc", "n", F.col("doc").alias("component"))
    linked = full.select("doc", "n", "h1", "h2").join(named, ["h1", "h2", "n"]).select("doc", "n", "component")
    found = linked.unionByName(alone).select(
        F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id")
    )
    found = stored(found, "jaccard-found")
    discard(measured, classes, copies, components)
    return found


def _pivot() -> Column:
    """The member of a list that others are compared with: few n-grams of its own, then the same one in many lists."""
    return F.min(F.struct("own", F.xxhash64("rep").alias("draw"), "rep", "n"))


def _spread_frequent(entries: DataFrame, frequent: np.ndarray) -> DataFrame:
    """Column ``spread``: 0, or for frequent n-grams a number from 1 to 1024 by document."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = batch.column("gram").to_numpy(zero_copy_only=False).view(np.uint64)
            spread = np.zeros(len(grams), np.int64)
            if len(frequent):
                at = np.minimum(np.searchsorted(frequent, grams), len(frequent) - 1)
                reps = batch.column("rep").to_numpy(zero_copy_only=False).view(np.uint64)
                spread = np.where(frequent[at] == grams, (mix(reps) % np.uint64(1024)).astype(np.int64) + 1, 0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(spread)], names=[*batch.schema.names, "spread"])

    return entries.mapInArrow(mark, "rep bigint, n bigint, own tinyint, at int, gram bigint, spread bigint")


def _small(ids: DataFrame) -> DataFrame:
    """Ids of stored rows, to be broadcast if they are measured to be few."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _members(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("doc")).union(pairs.select("b")).distinct()


def _repeats(rows: DataFrame) -> bool:
    """Whether an id has several rows."""
    return rows.groupBy("doc").count().where("count > 1").count() > 0


def _halved(rows: DataFrame) -> DataFrame:
    """Prefixes as the distinct low halves of their hashes, with the number ``k`` of whole ones."""

    def halve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, n, prefix = batch.columns
            k = prefix.value_lengths().to_numpy()
            halves = prefix.flatten().to_numpy().view(np.uint64).astype(np.uint32)
            row = np.repeat(np.arange(len(k)), k)
            order = np.lexsort((halves, row))
            halves, row = halves[order], row[order]
            new = np.ones(len(row), bool)
            new[1:] = (halves[1:] != halves[:-1]) | (row[1:] != row[:-1])
            bounds = np.r_[0, np.cumsum(np.bincount(row[new], minlength=len(k)))].astype(np.int32)
            short = pa.ListArray.from_arrays(pa.array(bounds), pa.array(halves[new].view(np.int32)))
            yield pa.RecordBatch.from_arrays([doc, n, pa.array(k, pa.int32()), short], names=["doc", "n", "k", "prefix"])

    return rows.select("doc", "n", "prefix").mapInArrow(halve, "doc bigint, n bigint, k int, prefix array<int>")


def _verified(
    texts: DataFrame, heads: DataFrame, pairs: DataFrame, words: int, percent: int
) -> tuple[DataFrame, DataFrame]:
    """Pairs with their exact overlap, and the links among them.

    Whole sets are only fetched of pairs whose prefixes allow a link: what two sets have in
    common is in both prefixes, or behind the prefix of one of them. For this bound prefixes
    are moved as the low halves of their hashes; elements of a prefix that agree in these
    are counted as common once more each, so the bound holds.
    """
    members = stored(_members(pairs), "jaccard-members")
    known = stored(_halved(heads.select("doc", "n", "prefix").join(_small(members), "doc")), "jaccard-known-prefixes")

    def side(doc: str, n: str, k: str, prefix: str) -> DataFrame:
        names = {"doc": doc, "n": n, "k": k, "prefix": prefix}
        return known.select(*[F.col(c).alias(name) for c, name in names.items()])

    met = pairs.join(side("a", "m", "j", "p"), "a").join(side("b", "n", "k", "q"), "b")
    behind = F.greatest(F.col("m") - F.col("j"), F.col("n") - F.col("k"))
    alike = F.least(F.col("j") - F.size("p"), F.col("k") - F.size("q"))
    most = F.least(F.size(F.array_intersect("p", "q")) + alike + behind, "m", "n")
    open_pairs = met.where(most * (100 + percent) >= (F.col("m") + F.col("n")) * percent).select("a", "b").distinct()
    open_pairs = stored(open_pairs, "jaccard-open-pairs")
    wanted = stored(_members(open_pairs), "jaccard-wanted")
    sets = _sets(texts.where(F.col("doc").isNotNull()), wanted, words)
    compared = stored(_compared(open_pairs, sets), "jaccard-known")
    discard(members, known, open_pairs, wanted, sets)
    return compared, compared.where(F.col("common") * 100 >= F.col("united") * percent).select("a", "b").distinct()


def _more_pivots(lists: DataFrame, components: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """Members of long lists with ``MORE_PIVOTS`` common ones that are not of their component."""
    draws = [F.min(F.struct(F.xxhash64("rep", F.lit(i)).alias("draw"), "rep", "n")) for i in range(MORE_PIVOTS)]
    long = lists.groupBy("gram").agg(F.count("*").alias("members"), F.array(*draws).alias("pivots"))
    long = stored(long.where(F.col("members") > LONG_LIST).select("gram", "pivots"), "jaccard-long-lists")
    met = lists.select("gram", "rep", "n").join(long, "gram").select("rep", "n", F.explode("pivots").alias("pivot"))
    met = met.select("rep", "n", F.col("pivot.rep").alias("other"), F.col("pivot.n").alias("m")).where("rep <> other").distinct()
    met = met.where(F.least("n", "m") * 100 >= F.greatest("n", "m") * percent)
    for end in ("rep", "other"):
        of = components.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}"))
        met = met.join(of, end, "left").withColumn(f"of_{end}", F.coalesce(f"of_{end}", end))
    met = met.where("of_rep <> of_other").select(F.least("rep", "other").alias("a"), F.greatest("rep", "other").alias("b"))
    pairs = stored(met.distinct().join(known.select("a", "b"), ["a", "b"], "left_anti"), "jaccard-pairs")
    discard(long)
    return pairs


def _open_pairs(lists: DataFrame, components: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """Pairs of a list in different components that may be linked and were not compared."""
    of = components.withColumnRenamed("node", "rep")
    placed = lists.join(of, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    mixed = placed.groupBy("gram").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), _pivot()["rep"].alias("pivot")
    )
    placed = placed.join(mixed.where("low < high").select("gram", "pivot"), "gram")
    # what is known of both distances to a common member bounds their own
    far = known.select("a", "b", (1 - F.col("common") / F.col("united")).alias("far"))
    far = far.select(F.col("a").alias("rep"), F.col("b").alias("pivot"), "far").unionByName(
        far.select(F.col("b").alias("rep"), F.col("a").alias("pivot"), "far")
    )
    placed = placed.join(far, ["rep", "pivot"], "left")
    far = F.when(F.col("rep") == F.col("pivot"), 0.0).otherwise(F.col("far")).alias("far")
    placed = stored(placed.select("gram", "rep", "n", "at", "component", far), "jaccard-placed")
    # sizes are cut into blocks of a factor, so that only neighbouring blocks of a list meet
    block = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / percent))).cast("int")
    left = placed.withColumn("block", F.explode(F.array(block - 1, block, block + 1)))
    right = placed.withColumn("block", block)
    right = right.select("gram", "block", *[F.col(c).alias(f"{c}2") for c in ("rep", "n", "at", "component", "far")])
    near = F.abs(F.col("far") - F.col("far2")) <= 1 - percent / 100 + 1e-9
    met = left.join(right, ["gram", "block"]).where(
        (F.col("rep") < F.col("rep2"))
        & (F.col("component") != F.col("component2"))
        & _reachable(F.col("n"), F.col("at"), F.col("n2"), F.col("at2"), percent)
        & F.coalesce(near, F.lit(True))
    )
    pairs = met.select(F.col("rep").alias("a"), F.col("rep2").alias("b")).distinct()
    pairs = stored(pairs.join(known.select("a", "b"), ["a", "b"], "left_anti"), "jaccard-pairs")
    discard(placed)
    return pairs


def _joined_by_id(full: DataFrame, named: DataFrame, shared: DataFrame) -> DataFrame:
    """Classes whose members share an id get one component."""
    rows = full.join(shared, "doc").select("doc", "h1", "h2", "n").join(named, ["h1", "h2", "n"])
    ties = rows.groupBy("doc").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a < b")
    ties = stored(rows.join(ties.select("doc", "a"), "doc").select("a", F.col("component").alias("b")).where("a < b"), "jaccard-ties")
    if not ties.count():
        return named
    lower = connected_components(ties).select(F.col("node").alias("component"), F.col("component").alias("lower"))
    joined = named.join(lower, "component", "left")
    return joined.select("h1", "h2", "n", F.coalesce("lower", "component").alias("component"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One document of each component, that with the least id, with all its columns.

    Rows under a null id stay. Of rows that share an id, the one with the least text stays.
    """
    found = jaccard_components(docs, id_col, text_col, **options)
    go = found.where("doc_id <> component_id").select(F.col("doc_id").alias(id_col)).distinct()
    kept = docs.join(F.broadcast(go) if go.count() <= BROADCAST_IDS else go, id_col, "left_anti").select(docs.columns)
    twice = found.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1")
    twice = stored(twice.select(F.col("doc_id").alias(id_col)), "jaccard-repeated-ids")
    n = twice.count()
    if not n:
        return kept
    twice = F.broadcast(twice) if n <= BROADCAST_IDS else twice
    row, least = F.struct(*docs.columns).alias("row"), F.min_by("row", F.col(f"row.{text_col}"))
    one = kept.join(twice, id_col).select(docs.columns).select(row).groupBy(F.col(f"row.{id_col}")).agg(
        F.coalesce(least, F.first("row")).alias("row")
    )
    return kept.join(twice, id_col, "left_anti").select(docs.columns).unionByName(one.select("row.*"))
