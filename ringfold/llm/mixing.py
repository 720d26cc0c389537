"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ringfold.workdir import stored

WEIGHTS = (1, 2, 3)
MOST_COPIES = 3
#: Ranks of a source are cut into so many ranges, and the range that holds the cut again.
RANGES = 4096
_KEY = ("rank", "doc_id", "size")
_WORD = r"[^\x20\x09-\x0D]+"
_DIGITS = 13


def text_size(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("bigint")


def uniform(doc_id: Column, seed: str) -> Column:
    """A number above 0 and below 1 that follows from the id alone."""
    digits = F.substring(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(seed)).cast("binary")), 1, _DIGITS)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(16**_DIGITS)


def source_targets(sized: DataFrame, weights: tuple[int, ...], most_copies: int) -> DataFrame:
    """Per source: ``source_size`` and ``target``, and how often all its documents are taken.

    Sources by code point, null last, have the weights in turn. They share the size of all
    sources by weight; a target stops at ``most_copies`` times the source's size and the
    excess is shared again. Sources in the order of limit over weight reach their limits
    one after another, so a running sum finds all targets at once.

    The windows run over one row per source.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), turn + 1).cast("bigint")
    limit = F.col("source_size") * most_copies
    per = per.withColumn("weight", weight).withColumn("limit", limit)
    fill = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    rest = fill.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    one = (F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0))).cast("double") / F.sum(
        "weight"
    ).over(rest).cast("double")
    per = per.withColumn("level", one)
    # the level rises with each source that is full and falls after the first that is not
    level = F.max("level").over(everything)
    per = per.withColumn("target", F.least(F.col("limit").cast("double"), level * F.col("weight")))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint")
    return per.select(
        "source", "source_size", "target", whole.alias("whole"), (F.col("target") - whole * F.col("source_size")).alias("rest")
    )


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    most_copies: int = MOST_COPIES,
    seed: str = "mix",
) -> DataFrame:
    """How many copies of each document a mix takes: ``doc_id, source, size, copies`` and sums.

    Every document is taken as often as its source's target holds all of it. What is left
    of the target, R words, is filled by a Pareto sample. Documents that fit into R get an
    inclusion probability L, proportional to the square root of their size (longer documents
    are worth more, but not in proportion) and 1 at most, such that the sum of L times size
    is R. Those with L = 1 are certain. The others are ranked by the odds U / (1 - U), with U
    from the document's id, over the inclusion odds L / (1 - L), and taken in this order; one
    that would overshoot R is passed over, so that later ones can still fill it. Last, the
    smallest document that was not taken is, if that brings the sum nearer to R.

    The ranking is never sorted: words are counted per range of ranks, then per part of the
    range in which the sum passes R; only that part is ordered. What follows the document
    passed over is counted again, of documents that still fit, until none does; each time
    the words left are fewer than those of the document passed over.

    Rows without a source are a source of their own, null texts have size 0 and are taken
    only as part of a whole source, rows with one id stay apart, but if their sizes are equal
    too, are taken or passed over together. Other columns are not read. An empty table gives
    no rows.

    Columns: doc_id, source, size, source_size, target, copies, taken.
    """
    sized = stored(_sized(docs, id_col, text_col, source_col, seed), "mix-sizes")
    return _copies(sized, _plan(sized, weights, most_copies))


def mixed_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    most_copies: int = MOST_COPIES,
    seed: str = "mix",
) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as ``mix_sources`` takes it, with all its columns."""
    sized = stored(_sized(docs, id_col, text_col, source_col, seed), "mix-sizes")
    whole_row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = _sized(docs, id_col, text_col, source_col, seed, whole_row)
    taken = _copies(rows, _plan(sized, weights, most_copies), "row").where("copies > 0")
    return taken.select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select("row.*")


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str, *more: Column) -> DataFrame:
    doc_id = F.col(f"`{id_col}`").cast("bigint")
    return docs.select(
        *more,
        doc_id.alias("doc_id"),
        F.col(f"`{source_col}`").cast("string").alias("source"),
        text_size(F.col(f"`{text_col}`")).alias("size"),
        uniform(doc_id, seed).alias("u"),
    )


def _join(rows: DataFrame, per_source: DataFrame, how: str = "inner") -> DataFrame:
    other = per_source.withColumnRenamed("source", "of_source")
    return rows.join(other, F.col("source").eqNullSafe(F.col("of_source")), how).drop("of_source")


def inclusion_scales(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source with a rest: ``scale`` and ``certain_above``.

    A document of size n is included with probability scale * sqrt(n), or for certain if n
    is larger than ``certain_above``. Found from one row per source and size.
    """
    sizes = _join(sized.groupBy("source", "size").agg(F.count("*").alias("n")), targets.select("source", "rest"))
    sizes = sizes.where((F.col("size") > 0) & (F.col("size") <= F.col("rest")))
    up = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    weighed = F.sum(F.col("n") * F.col("size") * F.sqrt(F.col("size").cast("double"))).over(up)
    words = F.sum(F.col("n") * F.col("size"))
    larger = words.over(Window.partitionBy("source")) - words.over(up)
    scales = sizes.withColumn("scale", (F.col("rest") - larger) / weighed)
    # the largest size that is not certain when all larger ones are
    open_ones = scales.where(F.col("scale") * F.sqrt(F.col("size").cast("double")) < 1)
    return open_ones.groupBy("source").agg(F.max_by("scale", "size").alias("scale"), F.max("size").alias("certain_above"))


def _ranked(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows with ``certain`` and ``rank``: from 0 to 1, null for those that cannot be in the sample."""
    rows = _join(sized, sources)
    fits = (F.col("size") > 0) & (F.col("size") <= F.col("rest"))
    certain = F.coalesce(fits & (F.col("scale").isNull() | (F.col("size") > F.col("certain_above"))), F.lit(False))
    share = F.col("scale") * F.sqrt(F.col("size").cast("double"))
    # u / (1 - u) over share / (1 - share), brought into 0 to 1
    over = F.col("u") * (1 - share)
    rank = F.when(fits & ~certain, over / (over + (1 - F.col("u")) * share))
    return rows.withColumn("certain", certain).withColumn("rank", rank)


def _first_beyond(words: DataFrame, at: str, left: Column) -> DataFrame:
    """Per source: the first range in which the words pass what is left, and the words before it."""
    run = Window.partitionBy("source").orderBy(at)
    summed = words.withColumn("through", F.sum("words").over(run)).where(F.col("through") > left)
    first = F.min_by(F.struct(at, (F.col("through") - F.col("words")).alias("before")), at)
    firsts = summed.groupBy("source").agg(first.alias("cut"))
    return firsts.select("source", F.col(f"cut.{at}").alias(f"cut_{at}"), F.col("cut.before").alias(f"before_{at}"))


def _still_open(ranked: DataFrame, state: DataFrame) -> DataFrame:
    """Ranked rows behind the last one passed over that fit into what is left, with ``gap``, ``range`` and ``part``."""
    open_rows = _join(ranked.select("source", *_KEY), state.where("NOT done").select("source", "gap", "after"))
    open_rows = open_rows.where((F.col("size") <= F.col("gap")) & (F.col("after").isNull() | (F.struct(*_KEY) > F.col("after"))))
    first = F.floor(F.col("rank") * RANGES)
    part = F.floor((F.col("rank") * RANGES - first) * RANGES)
    # stored, as it is read three times and most of it is gone in the next round
    return stored(open_rows.select("source", *_KEY, "gap", first.alias("range"), part.alias("part")), "mix-open")


def _next_stop(open_rows: DataFrame) -> DataFrame:
    """Per source the first document in the ranking that does not fit any more, and the words taken before it."""
    key = F.struct(*_KEY)
    total = (F.sum("size").alias("words"), F.first("gap").alias("gap"))
    ranges = _first_beyond(open_rows.groupBy("source", "range").agg(*total), "range", F.col("gap"))
    inside = _join(open_rows, ranges).where("range = cut_range")
    parts = inside.groupBy("source", "part", "before_range").agg(*total)
    parts = _first_beyond(parts, "part", F.col("gap") - F.col("before_range"))
    # only the documents of one part of one range per source are put in order, equal ones as one
    edge = _join(inside, parts).where("part = cut_part")
    edge = edge.groupBy("source", key.alias("key")).agg(
        F.sum("size").alias("words"), F.first("gap").alias("gap"), F.first(F.col("before_range") + F.col("before_part")).alias("before")
    )
    run = Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    through = F.col("before") + F.sum("words").over(run)
    beyond = edge.withColumn("through", through).where(F.col("through") > F.col("gap"))
    return beyond.groupBy("source").agg(F.min(F.struct("key", (F.col("through") - F.col("words")).alias("taken"))).alias("stop"))


def _plan(sized: DataFrame, weights: tuple[int, ...], most_copies: int) -> DataFrame:
    """Per source its target, how often it is taken whole, and which part of its ranking is taken."""
    targets = stored(source_targets(sized, weights, most_copies).coalesce(1), "mix-targets")
    sources = _join(targets, inclusion_scales(sized, targets), "left")
    sources = stored(sources.coalesce(1), "mix-scales")
    ranked = stored(_ranked(sized, sources).select("source", "doc_id", "size", "rank", "certain"), "mix-ranks")
    sure = ranked.where("certain").groupBy("source").agg(F.sum("size").alias("sure"))
    step = "struct<gap:double,after:struct<rank:double,doc_id:bigint,size:bigint>,stop:struct<rank:double,doc_id:bigint,size:bigint>>"
    state = _join(sources, sure, "left").select(
        "source",
        (F.col("rest") - F.coalesce("sure", F.lit(0))).alias("gap"),
        F.lit(None).cast("struct<rank:double,doc_id:bigint,size:bigint>").alias("after"),
        F.array().cast(f"array<{step}>").alias("steps"),
        F.lit(False).alias("done"),
    )
    ranked = ranked.where("NOT certain")
    state = stored(state.coalesce(1), "mix-steps")
    open_rows = ranked.where("rank IS NOT NULL")
    while state.where("NOT done").head(1):
        open_rows = _still_open(open_rows, state)
        found = _join(state, _next_stop(open_rows), "left")
        this = F.struct("gap", "after", F.col("stop.key").alias("stop")).cast(step)
        state = stored(
            found.select(
                "source",
                F.when(F.col("done") | F.col("stop").isNull(), F.col("gap")).otherwise(F.col("gap") - F.col("stop.taken")).alias("gap"),
                F.coalesce("stop.key", "after").alias("after"),
                F.when(F.col("done"), F.col("steps")).otherwise(F.concat("steps", F.array(this))).alias("steps"),
                (F.col("done") | F.col("stop").isNull()).alias("done"),
            ).coalesce(1),
            "mix-steps",
        )
    return stored(_topped_up(ranked, sources, state).coalesce(1), "mix-plan")


def _in_steps() -> Column:
    """Whether a ranked row is in one of its source's steps."""
    key = F.struct(*_KEY)
    return F.exists(
        "steps",
        lambda s: (F.col("size") <= s["gap"]) & (s["after"].isNull() | (key > s["after"])) & (s["stop"].isNull() | (key < s["stop"])),
    )


def _topped_up(ranked: DataFrame, sources: DataFrame, state: DataFrame) -> DataFrame:
    """Sources with their steps and ``extra``, one more document that brings their words nearer to what is left."""
    placed = _join(ranked.where("size > 0"), state.select("source", "steps"))
    key = F.struct("size", F.coalesce("rank", F.lit(1.0)).alias("rank"), "doc_id")
    taken = F.coalesce(F.col("rank").isNotNull() & _in_steps(), F.lit(False))
    words = placed.groupBy("source").agg(F.sum(F.when(taken, F.col("size")).otherwise(0)).alias("in_steps"))
    left = placed.where(~taken).select("source", key.alias("extra"))
    least = left.groupBy("source").agg(F.min("extra").alias("least"))
    same = _join(left, least).where(F.col("extra") == F.col("least")).groupBy("source", "extra").agg(F.count("*").alias("rows"))
    sure = _join(_join(state, words, "left"), same, "left")
    first = F.when(F.size("steps") > 0, F.col("steps")[0]["gap"]).otherwise(F.col("gap"))
    miss = first - F.coalesce("in_steps", F.lit(0))
    nearer = F.col("rows") * F.col("extra.size") < 2 * miss
    found = sure.select("source", "steps", F.when(nearer, F.col("extra")).alias("extra"))
    return _join(sources, found)


def _copies(sized: DataFrame, plan: DataFrame, *more: str) -> DataFrame:
    rows = _ranked(sized, plan)
    in_order = F.col("rank").isNotNull() & _in_steps()
    last = F.struct("size", F.coalesce("rank", F.lit(1.0)).alias("rank"), "doc_id") == F.col("extra")
    sampled = F.col("certain") | F.coalesce(in_order, F.lit(False)) | F.coalesce(last & (F.col("size") > 0), F.lit(False))
    copies = (F.col("whole") + sampled.cast("int")).cast("bigint")
    taken = (copies * F.col("size")).alias("taken")
    return rows.select(*more, "doc_id", "source", "size", "source_size", "target", copies.alias("copies"), taken)


MIX_SQL = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents
), per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    CAST(1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS BIGINT) AS weight
  FROM sized GROUP BY source
), filled AS (
  SELECT source, source_size, weight,
    (CAST(sum(source_size) OVER () AS BIGINT) - coalesce(CAST(sum(3 * source_size) OVER (
       ORDER BY CAST(3 * source_size AS DOUBLE) / CAST(weight AS DOUBLE), source NULLS LAST
       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0))::DOUBLE
    / CAST(sum(weight) OVER (ORDER BY CAST(3 * source_size AS DOUBLE) / CAST(weight AS DOUBLE), source NULLS LAST
       ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM per
), targets AS (
  SELECT source, source_size, least(CAST(3 * source_size AS DOUBLE), max(level) OVER () * weight) AS target FROM filled
), wholes AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM targets
), drawn AS (
  SELECT d.doc_id, d.source, d.size, w.source_size, w.target, w.whole, w.target - w.whole * w.source_size AS rest,
    (CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || 'mix'), 1, 13) AS BIGINT) AS DOUBLE) + 0.5)
      / 4503599627370496.0 AS u
  FROM sized d JOIN wholes w ON d.source IS NOT DISTINCT FROM w.source
), scales AS (
  SELECT source, max_by(scale, size) AS scale, max(size) AS certain_above FROM (
    SELECT source, size, (rest - (sum(n * size) OVER (PARTITION BY source) - sum(n * size) OVER up)) / sum(n * size * sqrt(size)) OVER up AS scale
    FROM (SELECT source, size, rest, count(*) AS n FROM drawn WHERE size > 0 AND size <= rest GROUP BY ALL)
    WINDOW up AS (PARTITION BY source ORDER BY size ROWS UNBOUNDED PRECEDING)
  ) WHERE scale * sqrt(size) < 1 GROUP BY source
), placed AS (
  SELECT d.*, coalesce(size > 0 AND size <= rest AND (scale IS NULL OR size > certain_above), false) AS certain, scale * sqrt(size) AS share
  FROM drawn d LEFT JOIN scales s ON d.source IS NOT DISTINCT FROM s.source
), ranked AS MATERIALIZED (
  SELECT *, CASE WHEN size > 0 AND size <= rest AND NOT certain THEN u * (1 - share) / (u * (1 - share) + (1 - u) * share) END AS rank
  FROM placed
), units AS (
  SELECT source, rank, doc_id, size, CAST(sum(size) AS DOUBLE) AS words FROM ranked WHERE rank IS NOT NULL GROUP BY ALL
), sure AS (
  SELECT source, any_value(rest) - coalesce(CAST(sum(size) FILTER (certain) AS BIGINT), 0) AS gap FROM ranked GROUP BY source
), numbered AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY rank, doc_id NULLS FIRST, size) AS k FROM units
), walk AS (
  SELECT source, gap, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS doc_id, CAST(NULL AS BIGINT) AS size, false AS fits FROM sure
  UNION ALL
  SELECT n.source, CASE WHEN n.words <= w.gap THEN w.gap - n.words ELSE w.gap END, n.k, n.doc_id, n.size, n.words <= w.gap
  FROM walk w JOIN numbered n ON w.source IS NOT DISTINCT FROM n.source AND n.k = w.k + 1
), fit AS MATERIALIZED (
  SELECT source, doc_id, size FROM walk WHERE fits
), marked AS MATERIALIZED (
  SELECT r.*, certain OR (rank IS NOT NULL AND EXISTS (
    SELECT 1 FROM fit f WHERE f.source IS NOT DISTINCT FROM r.source AND f.doc_id IS NOT DISTINCT FROM r.doc_id AND f.size = r.size)) AS in_sample
  FROM ranked r
), extra AS (
  SELECT e.source, e.doc_id, e.size FROM (
    SELECT source, size, coalesce(rank, 1.0) AS rank, doc_id, count(*) AS n FROM marked WHERE NOT in_sample AND size > 0
    GROUP BY source, size, coalesce(rank, 1.0), doc_id
    QUALIFY row_number() OVER (PARTITION BY source ORDER BY size, coalesce(rank, 1.0), doc_id NULLS FIRST) = 1
  ) e JOIN (SELECT source, arg_max(gap, k) AS gap FROM walk GROUP BY source) g ON e.source IS NOT DISTINCT FROM g.source
  WHERE CAST(e.n * e.size AS DOUBLE) < 2 * g.gap
)
SELECT m.doc_id, m.size, source_size, target,
  CAST((whole + CASE WHEN in_sample OR x.size IS NOT NULL THEN 1 ELSE 0 END) * m.size AS BIGINT) AS taken
FROM marked m LEFT JOIN extra x
  ON x.source IS NOT DISTINCT FROM m.source AND x.doc_id IS NOT DISTINCT FROM m.doc_id AND x.size = m.size
"""
