"""Compression of vectors to codes, one index per part, with codebooks fitted in rounds.

A round gives every part of a vector the nearest entry of its position's codebook, then
moves each entry to the floor of its parts' mean. Everything is in integers, so results are
exact and do not depend on the order of rows.

Most parts keep their entry, and bounds show it without a look at the codebook: one on the
distance to the own entry from above, one on the distance to all others from below. A
bound is never updated round by round. It keeps the round it was made in, all codebooks so
far are retained, and what an entry moved since that round is the norm of the sum of its
moves: at most, and mostly far less than, the sum of their norms. Only where the bounds
meet are distances computed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringfold.workdir import discard, stored

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
#: Integer components beyond this size would not leave room for exact 64-bit distances.
LARGEST = 1 << 24
#: Labels with so large a share of the rows are broadcast with their sums, whatever the number of labels.
HOT_SHARE = 1 / 1024
BROADCAST_ROWS = 100_000


class Bounds(NamedTuple):
    """Per part of some vectors at one position: the entry, both bounds and the rounds they are of."""

    code: np.ndarray
    upper: np.ndarray
    lower: np.ndarray
    upper_round: np.ndarray
    lower_round: np.ndarray


def _state_type(parts: int) -> np.dtype:
    return np.dtype(
        [
            ("code", "u1", (parts,)),
            ("upper", "<f4", (parts,)),
            ("lower", "<f4", (parts,)),
            ("upper_round", "<u2", (parts,)),
            ("lower_round", "<u2", (parts,)),
        ]
    )


def _above(x: np.ndarray) -> np.ndarray:
    return np.nextafter((x * (1 + 1e-6)).astype(np.float32), np.float32(np.inf))


def _below(x: np.ndarray) -> np.ndarray:
    return np.nextafter((x * (1 - 1e-6)).astype(np.float32), np.float32(-np.inf))


def squared_distances(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer points to integer entries, in 64 bits."""
    most = max(int(np.abs(points).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if 4 * points.shape[1] * most * most < 1 << 53:
        p, e = points.astype(np.float64), entries.astype(np.float64)
        found = (p * p).sum(1)[:, None] - 2 * (p @ e.T) + (e * e).sum(1)[None, :]
        return found.astype(np.int64)
    return np.stack([((points - e) ** 2).sum(1) for e in entries], axis=1)


class Moves:
    """How far the entries of one position went between the retained codebooks and the latest."""

    def __init__(self, history: np.ndarray) -> None:
        latest = history[-1].astype(np.float64)
        moved = np.sqrt(((history.astype(np.float64) - latest[None]) ** 2).sum(2))
        self.own = moved  # by round, entry
        order = np.sort(moved, axis=1)
        self.most = order[:, -1]
        self.second = order[:, -2] if moved.shape[1] > 1 else np.zeros(len(moved))
        self.first = moved.argmax(1)
        apart = np.sqrt(squared_distances(history[-1], history[-1]).astype(np.float64))
        np.fill_diagonal(apart, np.inf)
        self.half = apart.min(1) / 2  # nothing nearer than this to an entry is nearer to another

    def of_others(self, rounds: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The largest move since ``rounds`` of any entry but ``code``."""
        return np.where(self.first[rounds] == code, self.second[rounds], self.most[rounds])


def first_bounds(points: np.ndarray, entries: np.ndarray, at: int) -> Bounds:
    """The nearest entry of each point, the lower one of equals, with bounds of round ``at``."""
    far = squared_distances(points, entries)
    rows = np.arange(len(points))
    code = far.argmin(1)
    near = far[rows, code]
    far[rows, code] = np.iinfo(np.int64).max
    other = far.min(1).astype(np.float64) if far.shape[1] > 1 else np.full(len(points), np.inf)
    other[other >= float(np.iinfo(np.int64).max)] = np.inf
    stamp = np.full(len(points), at, np.uint16)
    return Bounds(code.astype(np.uint8), _above(np.sqrt(near)), _below(np.sqrt(other)), stamp, stamp)


def next_bounds(points: np.ndarray, history: np.ndarray, old: Bounds, moves: Moves | None = None) -> tuple[Bounds, int]:
    """The nearest entries of ``history[-1]``, from bounds of any earlier rounds; and the number of rescans."""
    moves = moves or Moves(history)
    now = len(history) - 1
    code = old.code.astype(np.int64)

    def sure(upper: np.ndarray, lower: np.ndarray, half: np.ndarray) -> np.ndarray:
        # strictly less, with room for rounding, so that ties are always rescanned
        return upper * (1 + 1e-9) + 1e-9 < np.maximum(lower, half)

    lower = old.lower.astype(np.float64) - moves.of_others(old.lower_round, code)
    upper = old.upper.astype(np.float64) + moves.own[old.upper_round, code]
    new = Bounds(*(a.copy() for a in old))
    doubt = np.flatnonzero(~sure(upper, lower, moves.half[code]))
    if len(doubt):
        exact = np.sqrt(((points[doubt] - history[-1][code[doubt]]) ** 2).sum(1).astype(np.float64))
        new.upper[doubt], new.upper_round[doubt] = _above(exact), now
        doubt = doubt[~sure(exact * (1 + 1e-12), lower[doubt], moves.half[code[doubt]])]
    if len(doubt):
        for mine, fresh in zip(new, first_bounds(points[doubt], history[-1], now), strict=True):
            mine[doubt] = fresh
    return new, len(doubt)


def _cuts(dimensions: int, parts: int) -> list[int]:
    return [dimensions * p // parts for p in range(parts + 1)]


def _integers(vectors: DataFrame, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    """``vec_id, label, points``: floors as little-endian 32-bit integers; unfit rows are left out."""
    vector = F.col(f"`{vector_col}`").cast("array<double>")
    fit = vector.isNotNull() & F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LARGEST / SCALE)
    )
    label = F.col(f"`{label_col}`").alias("label")
    rows = vectors.select(F.col(f"`{id_col}`").cast("bigint").alias("vec_id"), label, vector.alias("vector")).where(fit)

    def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("vector")
            flat = np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False)).astype("<i4")
            bounds = np.r_[0, np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))]
            points = [flat[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array(points, pa.binary())],
                names=["vec_id", "label", "points"],
            )

    return rows.mapInArrow(floors, f"vec_id bigint, label {rows.schema['label'].dataType.simpleString()}, points binary")


def _joined(column: pa.Array, dtype: np.dtype | str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype)


def _assign(rows: DataFrame, history: np.ndarray, parts: int) -> DataFrame:
    """Rows with ``state`` as of the latest codebook."""
    dimensions = history.shape[2]
    cuts, kind = _cuts(dimensions, parts), _state_type(parts)
    shared = rows.sparkSession.sparkContext.broadcast(history)
    bounded = "state" in rows.columns

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = [shared.value[:, :, a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        moves = [Moves(book) if bounded else None for book in books]
        for batch in batches:
            points = _joined(batch.column("points"), "<i4").reshape(batch.num_rows, dimensions).astype(np.int64)
            old = _joined(batch.column("state"), kind) if bounded else None
            state = np.zeros(batch.num_rows, kind)
            for p, book in enumerate(books):
                own = points[:, cuts[p] : cuts[p + 1]]
                if bounded:
                    found, _ = next_bounds(own, book, Bounds(*(old[f][:, p] for f in kind.names)), moves[p])
                else:
                    found = first_bounds(own, book[-1], len(book) - 1)
                for field, values in zip(kind.names, found, strict=True):
                    state[field][:, p] = values
            arrays = [batch.column(c) for c in ("vec_id", "label", "points")]
            yield pa.RecordBatch.from_arrays(
                [*arrays, pa.array([s.tobytes() for s in state], pa.binary())], names=["vec_id", "label", "points", "state"]
            )

    label = rows.schema["label"].dataType.simpleString()
    return rows.mapInArrow(assign, f"vec_id bigint, label {label}, points binary, state binary")


def _next_codebook(assigned: DataFrame, current: np.ndarray, parts: int) -> np.ndarray:
    """Entries at the floor of the mean of their parts. What reaches the driver has a codebook's size."""
    entries, dimensions = current.shape
    cuts, kind = _cuts(dimensions, parts), _state_type(parts)
    widest = max(b - a for a, b in zip(cuts[:-1], cuts[1:], strict=True))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((parts, entries, widest), np.int64)
        n = np.zeros((parts, entries), np.int64)
        for batch in batches:
            points = _joined(batch.column("points"), "<i4").reshape(batch.num_rows, dimensions).astype(np.int64)
            code = _joined(batch.column("state"), kind)["code"]
            for p in range(parts):
                np.add.at(sums[p, :, : cuts[p + 1] - cuts[p]], code[:, p], points[:, cuts[p] : cuts[p + 1]])
                n[p] += np.bincount(code[:, p], minlength=entries)
        part, entry = np.nonzero(n)
        arrays = [pa.array(part), pa.array(entry), pa.array(n[part, entry]), pa.array(list(sums[part, entry]), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(arrays, names=["part", "entry", "n", "sums"])

    rows = assigned.select("points", "state").mapInArrow(partial, "part bigint, entry bigint, n bigint, sums array<bigint>")
    total = rows.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(widest)])
    new = current.copy()
    for row in total.collect():
        a, b = cuts[row.part], cuts[row.part + 1]
        new[row.entry, a:b] = [row[f"s{i}"] // row.n for i in range(b - a)]
    return new


def codebooks_sha256(codebook: np.ndarray, parts: int = PARTS) -> str:
    """Digest of all components as decimal text by part, entry and position, joined by commas."""
    cuts = _cuts(codebook.shape[1], parts)
    flat = [str(x) for a, b in zip(cuts[:-1], cuts[1:], strict=True) for x in codebook[:, a:b].ravel().tolist()]
    return hashlib.sha256(",".join(flat).encode()).hexdigest()


class Codes(NamedTuple):
    """``rows``: vec_id, label, code (binary, a byte per part), error. ``codebook``: entries by dimensions."""

    rows: DataFrame
    codebook: np.ndarray


def vector_codes(
    vectors: DataFrame,
    id_col: str = "vec_id",
    label_col: str = "label",
    vector_col: str = "embedding",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
) -> Codes:
    """Codebooks fitted on all rows in ``rounds`` rounds, and every row's code under the last.

    A component x is floor(1024 * x). Codebooks start as the parts of the ``entries``
    smallest ids, of fewer where there are fewer rows; a null id comes last, and equal ids
    are ordered by their components. Of equally near entries the lower one is taken, and an
    entry without parts stays. Left out are rows whose vector is null, has null or
    non-finite components or some of 16,384 or more, is empty, or has another length than
    most vectors (of equally frequent lengths the largest). A length that ``parts`` does
    not divide is cut as evenly as it goes. Repeated rows count as often as they are there.
    An empty table gives no rows and an empty codebook. Other columns are not read.
    """
    if not 1 <= entries <= 256 or not 1 <= rounds < 1 << 16:
        raise ValueError("codes are one byte per part: 1 to 256 entries; and 1 to 65,535 rounds")
    rows = _integers(vectors, id_col, label_col, vector_col)
    lengths = rows.where(F.length("points") > 0).groupBy(F.length("points").alias("length")).count()
    usual = lengths.orderBy(F.desc("count"), F.desc("length")).first()
    if usual is None:
        schema = f"vec_id bigint, label {rows.schema['label'].dataType.simpleString()}, code binary, error bigint"
        return Codes(rows.sparkSession.createDataFrame([], schema), np.zeros((0, 0), np.int64))
    rows = stored(rows.where(F.length("points") == usual.length), "codes-points")
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "points").select("points").limit(entries).collect()
    history = np.stack([np.frombuffer(r.points, "<i4").astype(np.int64) for r in first])[None]
    for _ in range(rounds):
        assigned = stored(_assign(rows, history, parts), "codes-round")
        discard(rows)
        rows = assigned
        history = np.concatenate([history, _next_codebook(rows, history[-1], parts)[None]])
    return Codes(_coded(_assign(rows, history, parts), history[-1], parts), history[-1])


def _coded(assigned: DataFrame, codebook: np.ndarray, parts: int) -> DataFrame:
    dimensions = codebook.shape[1]
    cuts, kind = _cuts(dimensions, parts), _state_type(parts)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = _joined(batch.column("points"), "<i4").reshape(batch.num_rows, dimensions).astype(np.int64)
            code = np.ascontiguousarray(_joined(batch.column("state"), kind)["code"])
            error = np.zeros(batch.num_rows, np.int64)
            for p in range(parts):
                a, b = cuts[p], cuts[p + 1]
                error += ((points[:, a:b] - codebook[code[:, p], a:b]) ** 2).sum(1)
            arrays = [batch.column("vec_id"), batch.column("label"), pa.array([c.tobytes() for c in code], pa.binary())]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(error)], names=["vec_id", "label", "code", "error"])

    label = assigned.schema["label"].dataType.simpleString()
    return assigned.mapInArrow(measure, f"vec_id bigint, label {label}, code binary, error bigint")


def decoded(codes: DataFrame, codebook: np.ndarray, parts: int = PARTS, scale: int = SCALE) -> DataFrame:
    """``vec_id, vector``: the vectors that the codes stand for."""
    cuts = _cuts(codebook.shape[1], parts)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = _joined(batch.column("code"), np.uint8).reshape(batch.num_rows, parts)
            pieces = [codebook[code[:, p], cuts[p] : cuts[p + 1]] for p in range(parts)]
            whole = np.concatenate(pieces, axis=1) / scale
            vectors = pa.array(list(whole), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), vectors], names=["vec_id", "vector"])

    return codes.select("vec_id", "code").mapInArrow(build, "vec_id bigint, vector array<double>")


def with_label_sums(rows: DataFrame) -> DataFrame:
    """Rows with ``label_error``, the sum of ``error`` over rows of an equal label; nulls are one label.

    Sums are broadcast while labels are few. Of many labels only those of at least one row
    in 1,024 are, and the rest is joined by label, so no task gets the rows of a hot one.
    """
    sums = rows.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"), F.count("*").alias("members"))
    sums = stored(sums, "codes-labels")
    count, members = sums.agg(F.count("*"), F.sum("members")).first()
    same = F.col("label").eqNullSafe(F.col("of"))
    if count <= BROADCAST_ROWS:
        return rows.join(F.broadcast(sums), same).drop("of", "members")
    hot = F.broadcast(sums.where(F.col("members") >= HOT_SHARE * members)).drop("members")
    met = rows.join(hot, same, "left")
    rest = met.where("label_error IS NULL").drop("of", "label_error").join(sums.drop("members"), same).drop("of")
    return met.where("label_error IS NOT NULL").drop("of").unionByName(rest)


def coded_vectors(vectors: DataFrame, **options) -> DataFrame:
    """Per kept row: vec_id, code (two hex digits per part), error, label_error, codebooks_sha256."""
    found = vector_codes(vectors, **options)
    rows = stored(found.rows, "codes")
    digest = codebooks_sha256(found.codebook, options.get("parts", PARTS)) if found.codebook.size else ""
    summed = with_label_sums(rows)
    return summed.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _codes_sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    def assigned(t: int) -> str:
        return f"""
a{t} AS MATERIALIZED (
  SELECT vec_id, label, p, any_value(x) AS x, min(d * {entries} + e) % {entries} AS e, min(d) AS d
  FROM (
    SELECT k.vec_id, k.label, k.p, k.x, c.e,
      CAST(list_inner_product(k.x, k.x) - 2 * list_inner_product(k.x, c.x) + list_inner_product(c.x, c.x) AS BIGINT) AS d
    FROM cut k JOIN c{t} c ON k.p = c.p
  ) GROUP BY vec_id, label, p
)"""

    def moved(t: int) -> str:
        return f"""
m{t} AS (
  SELECT p, e, list(m ORDER BY i) AS x FROM (
    SELECT p, e, i, floor(sum(v) / count(*)) AS m
    FROM (SELECT p, e, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM a{t}) GROUP BY p, e, i
  ) GROUP BY p, e
), c{t + 1} AS MATERIALIZED (
  SELECT c.p, c.e, coalesce(m.x, c.x) AS x FROM c{t} c LEFT JOIN m{t} m ON c.p = m.p AND c.e = m.e
)"""

    steps = ",".join(assigned(t) + "," + moved(t) for t in range(rounds)) + "," + assigned(rounds)
    return f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), cut AS MATERIALIZED (
  SELECT vec_id, label, p, v[CAST(p * len(v) / {parts} + 1 AS BIGINT):CAST((p + 1) * len(v) / {parts} AS BIGINT)] AS x
  FROM kept, (SELECT unnest(range({parts})) AS p)
), c0 AS MATERIALIZED (
  SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x FROM cut
  QUALIFY row_number() OVER (PARTITION BY p ORDER BY vec_id) <= {entries}
),{steps}, errors AS (
  SELECT vec_id, any_value(label) AS label, string_agg(format('{{:02x}}', e), '' ORDER BY p) AS code,
    CAST(sum(d) AS BIGINT) AS error
  FROM a{rounds} GROUP BY vec_id
), digest AS (
  SELECT sha256(string_agg(array_to_string(list_transform(x, lambda v: CAST(CAST(v AS BIGINT) AS VARCHAR)), ','), ',' ORDER BY p, e)) AS digest
  FROM c{rounds}
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, digest AS codebooks_sha256
FROM errors, digest
"""


CODES_SQL = _codes_sql()
