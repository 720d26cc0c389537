"""Embedding near-duplicates by p-stable hashing.

A table of the index projects normalised vectors on random Gaussian directions, shifts
and quantises the projections; vectors that agree in all of them share a bucket. Vectors
of a bucket are compared exactly. Equal vectors are one class throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringfold.llm.components import connected_components
from ringfold.workdir import stored

LEAST_COSINE = 0.93
#: Tables, projections per table, and the width of a projection's cells. Two vectors at the
#: least cosine share a cell with probability 0.70, a bucket with 0.17, one of 24 with 0.989.
TABLES = 24
PROJECTIONS = 5
WIDTH = 1.0
#: Classes of a bucket that are compared in one piece; a larger bucket is cut into pairs of pieces.
PIECE = 1024


def _directions(dimensions: int, tables: int, projections: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64([17, dimensions, tables, projections]))
    return rng.standard_normal((dimensions, tables * projections)), rng.uniform(0, 1, tables * projections)


def bucket_keys(unit: np.ndarray, tables: int, projections: int, width: float) -> np.ndarray:
    """One 64-bit key per row and table."""
    along, shift = _directions(unit.shape[1], tables, projections)
    cells = np.floor(unit @ along / width + shift).astype(np.int64).reshape(len(unit), tables, projections)
    mixed = np.zeros((len(unit), tables), np.uint64)
    for j in range(projections):
        mixed = (mixed ^ cells[:, :, j].view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return mixed.view(np.int64)


def _unit(vectors: np.ndarray) -> np.ndarray:
    # scaled first, so that squares of very large or small components stay finite
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimensions)


def _local_roots(linked: np.ndarray) -> np.ndarray:
    """Least row number reachable by links, per row of a symmetric matrix."""
    n = len(linked)
    root = np.arange(n)
    while True:
        near = np.where(linked, root[None, :], n).min(axis=1)
        new = np.minimum(root, near)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def near_embeddings(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str | None = "label",
    least_cosine: float = LEAST_COSINE,
    tables: int = TABLES,
    projections: int = PROJECTIONS,
    width: float = WIDTH,
    piece: int = PIECE,
) -> DataFrame:
    """Per vector: ``vec_id, n_links, component_id, kept``.

    Vectors are compared where labels are equal and not null (with ``label_col`` None: all)
    and dimensions agree. Null or zero vectors, and those with null or non-finite
    components, link with nothing. ``n_links`` counts the other vectors found with a cosine
    of at least ``least_cosine``, in double precision; ``component_id`` is the least id
    reachable by links; ``kept`` marks the vector with that id. Rows with one id stay
    apart and are linked as others are. Other columns are not read.

    Equal vectors become one class before anything is compared, with counts combined before
    the shuffle. Buckets are counted; those of one class are dropped, and those of more
    than ``piece`` classes are compared piece by piece in tasks of their own, so that no
    task holds more than two pieces. A pair that shares several buckets counts in the
    first.
    """
    label = F.lit(0) if label_col is None else F.col(label_col)
    rows = vectors.select(
        F.col(id_col).cast("bigint").alias("vec_id"),
        F.xxhash64(label).alias("label"),
        label.isNotNull().alias("labelled"),
        F.col(vector_col).cast("array<double>").alias("vector"),
    )
    sound = F.coalesce(
        F.col("labelled")
        & (F.size("vector") > 0)
        & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("vector", lambda x: x != 0),
        F.lit(False),
    )
    rows = rows.withColumn("sound", sound)
    # a class is named by 128 bits of its label and vector
    name = [F.xxhash64("label", "vector").alias("h1"), F.xxhash64(F.lit(1), "vector", "label").alias("h2")]
    named = stored(rows.select("vec_id", "sound", *name), "vector-names")
    classes = stored(
        rows.where("sound")
        .groupBy(*name)
        .agg(
            F.min("vec_id").alias("class_id"),
            F.count("*").alias("members"),
            F.first("label").alias("label"),
            F.first("vector").alias("vector"),
        ),
        "vector-classes",
    )

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("vector").value_lengths().to_numpy(zero_copy_only=False)
            for d in np.unique(sizes).tolist():
                part = batch.filter(pa.array(sizes == d))
                found = bucket_keys(_unit(_matrix(part.column("vector"), d)), tables, projections, width)
                n = part.num_rows
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(part.column("h1").to_numpy(), tables)),
                        pa.array(np.repeat(part.column("h2").to_numpy(), tables)),
                        pa.array(np.repeat(part.column("label").to_numpy(), tables)),
                        pa.array(np.full(n * tables, d, np.int64)),
                        pa.array(np.tile(np.arange(tables), n)),
                        pa.array(found.ravel()),
                    ],
                    names=["h1", "h2", "label", "size", "table", "bucket"],
                )

    placed = classes.select("h1", "h2", "label", "vector").mapInArrow(
        keys, "h1 bigint, h2 bigint, label bigint, size bigint, table bigint, bucket bigint"
    )
    # of a bucket one name stands for label, dimension, table and cell
    placed = placed.select("h1", "h2", "table", F.xxhash64("label", "size", "table", "bucket").alias("bucket"))
    shared = placed.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    shared = shared.select("bucket", F.ceil(F.col("n") / piece).cast("int").alias("pieces"))
    kept = placed.join(shared, "bucket")
    # a class goes to every pair of pieces that its own piece is part of
    own = F.pmod(F.xxhash64("h1", "h2", F.lit(3)), F.col("pieces")).cast("int")
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("pieces") - 1),
        lambda other: F.struct(F.least(other, F.col("own")).alias("low"), F.greatest(other, F.col("own")).alias("high")),
    )
    kept = kept.withColumn("own", own).withColumn("pair", F.explode(pairs))
    kept = kept.select("h1", "h2", "table", "own", "bucket", F.col("pair.low").alias("low"), F.col("pair.high").alias("high"))
    full = kept.join(classes, ["h1", "h2"]).select("bucket", "low", "high", "table", "own", "class_id", "h1", "h2", "members", "vector")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        current = None
        for batch in batches:
            group = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("bucket", "low", "high")], 1)
            cuts = np.flatnonzero((group[1:] != group[:-1]).any(axis=1)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(group)], strict=True):
                if a == b:
                    continue
                if current is not None and (group[a] != current).any():
                    yield from _compare_group(waiting)
                    waiting = []
                current = group[a]
                waiting.append(batch.slice(a, b - a))
        if waiting:
            yield from _compare_group(waiting)

    def _compare_group(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.concat_batches(parts)
        n = rows.num_rows
        if n < 2:
            return
        columns = {c: rows.column(c).to_numpy(zero_copy_only=False) for c in ("table", "own", "class_id", "h1", "h2", "members")}
        matrix = _matrix(rows.column("vector"), len(rows.column("vector")[0]))
        unit = _unit(matrix)
        linked = unit @ unit.T >= least_cosine
        np.fill_diagonal(linked, False)
        low, high = rows.column("low")[0].as_py(), rows.column("high")[0].as_py()
        if low != high:  # pairs within a piece are compared where the piece meets itself
            linked &= columns["own"][:, None] != columns["own"][None, :]
        if not linked.any():
            return
        table = int(columns["table"][0])
        counted = linked
        if table:
            cells = bucket_keys(unit, tables, projections, width)[:, :table]
            i, j = np.nonzero(linked)
            again = (cells[i] == cells[j]).any(axis=1)
            counted = linked.copy()
            counted[i[again], j[again]] = False
        root = columns["class_id"][_local_roots(linked)]
        links = counted @ columns["members"]
        some = linked.any(axis=1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[c][some]) for c in ("h1", "h2", "class_id")] + [pa.array(root[some]), pa.array(links[some])],
            names=["h1", "h2", "class_id", "root", "links"],
        )

    groups = full.repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high", "class_id")
    found = groups.mapInArrow(compare, "h1 bigint, h2 bigint, class_id bigint, root bigint, links bigint")
    found = stored(found, "vector-links")
    links = found.groupBy("h1", "h2").agg(F.sum("links").alias("links"))
    components = connected_components(found.where("class_id <> root").select("class_id", "root").distinct(), "class_id", "root")
    per_class = (
        classes.select("h1", "h2", "class_id", "members")
        .join(links, ["h1", "h2"], "left")
        .join(components.withColumnRenamed("node", "class_id"), "class_id", "left")
        .select(
            "h1",
            "h2",
            (F.coalesce("links", F.lit(0)) + F.col("members") - 1).alias("n_links"),
            F.coalesce("component", "class_id").alias("component_id"),
        )
    )
    per_class = stored(per_class, "vector-results")
    joined = named.where("sound").join(per_class, ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    alone = named.where("NOT sound").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
