"""Merkle manifest of a dataset: one digest per document, group and whole, with proofs.

Documents are leaves in the order of their ids, below one tree per group, and the groups'
roots are leaves of one more tree. A level is made by a slot pivot: the children of a
parent are spread over as many columns as a parent has slots, by conditional aggregates.
The columns put together give the parent's digest; without a child's own column they are
its siblings, which is all that a proof needs. Only DataFrame functions are used.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ringfold.workdir import stored

FANOUT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows of a helper table up to which it is broadcast.
BROADCAST_ROWS = 100_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_STEP = "struct<before:string,after:string>"


def field_text(value: Column) -> Column:
    """A value as it is hashed: ``-`` for null, else its bytes, a colon, and itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*texts: Column) -> Column:
    """Lower-case hex SHA-256 of texts put together."""
    return F.sha2(F.concat(*texts), 256)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf gives with its siblings on the way up."""
    return F.aggregate(path, leaf, lambda node, step: F.sha2(F.concat(step["before"], node, step["after"]), 256))


def proof_digest(path: Column) -> Column:
    """Digest of all siblings, from the leaf's level up, left to right."""
    return F.sha2(F.concat_ws("", F.flatten(F.transform(path, lambda s: F.array(s["before"], s["after"])))), 256)


def _small(table: DataFrame) -> DataFrame:
    """A stored table, to be broadcast if it is measured to be short."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def _numbered(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Rows with ``at``, the place within ``group`` in this order, and ``n``, the group's size.

    Rows are cut by ranges of (group, order), so a group of any size is spread over tasks. A
    row's number within its range comes with its storing; what the ranges before hold of
    a group is a row per group and range.
    """
    keys = [F.asc_nulls_first(c) for c in ("group", *order)]
    # equal keys are cut as well, by their place in the stored rows
    apart = rows.withColumn("serial", F.monotonically_increasing_id()).repartitionByRange(*keys, "serial")
    ranged = apart.sortWithinPartitions(*keys, "serial").withColumn("serial", F.monotonically_increasing_id())
    ranged = stored(ranged, "manifest-order")
    ranged = ranged.withColumn("piece", F.shiftrightunsigned("serial", 33))
    pieces = ranged.groupBy("group", "piece").agg(F.count("*").alias("members"), F.min("serial").alias("least"))
    along = Window.partitionBy("group").orderBy("piece")
    before = F.sum("members").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("members")
    total = F.sum("members").over(Window.partitionBy("group"))
    pieces = stored(pieces.select("group", "piece", (F.col("least") - before).alias("zero"), total.alias("n")), "manifest-pieces")
    placed = ranged.join(_small(pieces), ["group", "piece"])
    return placed.withColumn("at", F.col("serial") - F.col("zero")).drop("serial", "piece", "zero")


def _upper(n: Column, fanout: int) -> Column:
    """Number of parents of ``n`` nodes."""
    return F.floor((n + (fanout - 1)) / fanout).cast("bigint")


def _runs(nodes: DataFrame, fanout: int) -> DataFrame:
    """Parents of the nodes: ``group, n, at``, slot columns ``s0 ...`` and their ``node``.

    ``nodes``: group, n, at and ``item``, a struct with a field ``node``. A run has at most
    ``fanout`` rows, however large its group is.
    """
    slots = [F.expr(f"max(if(at % {fanout} = {k}, item, null)) AS s{k}") for k in range(fanout)]
    parents = nodes.groupBy("group", _upper(F.col("n"), fanout).alias("n"), F.floor(F.col("at") / fanout).alias("at")).agg(*slots)
    return parents.withColumn("node", F.expr(f"sha2({_texts(range(fanout))}, 256)"))


def _texts(slots: Sequence[int]) -> str:
    """The nodes of these slots put together; empty slots add nothing."""
    return f"concat_ws('', {', '.join(f's{k}.node' for k in slots)})" if slots else "''"


def _children(runs: DataFrame, fanout: int) -> DataFrame:
    """The slots as rows again: ``group, at, top, item`` and ``path``, own siblings before the parent's path."""

    children = [
        f"""if(s{k} IS NULL, null, named_struct('slot', {k}, 'item', s{k}, 'path', concat(
          array(named_struct('before', {_texts(range(k))}, 'after', {_texts(range(k + 1, fanout))})), path)))"""
        for k in range(fanout)
    ]
    rows = runs.select("group", "at", "top", F.expr(f"explode(array_compact(array({', '.join(children)}))) AS child"))
    return rows.selectExpr("group", f"at * {fanout} + child.slot AS at", "top", "child.item", "child.path")


def proofs(leaves: DataFrame, order: Sequence[str], fanout: int = FANOUT) -> DataFrame:
    """Per leaf: ``group, item, top, path``.

    ``leaves`` has a column ``group`` without nulls and ``item``, a struct with the digest
    ``node`` and whatever goes with it; ``order`` are the fields of ``item`` that order a
    group, nulls first. Of equal ones any comes first. ``top`` is the group's root: while a
    level has several nodes, each run of ``fanout`` becomes one, the last run of any
    length; a lone leaf is the root itself. ``path`` lists what stands before and after the
    leaf's node on each level, from the bottom up. An empty table gives no rows.
    """
    if fanout < 2:
        raise ValueError("a parent needs two slots at least")
    level = _numbered(leaves.select("group", "item", *[F.col(f"item.{c}").alias(f"by_{i}") for i, c in enumerate(order)]),
                      [f"by_{i}" for i in range(len(order))])
    level = level.select("group", "n", "at", "item")
    height, most = 0, level.agg(F.max("n")).first()[0] or 0
    ends, pivots = [level.where("n = 1")], []
    while most > 1:
        runs = stored(_runs(level.where("n > 1"), fanout), f"manifest-level-{height}")
        pivots.append(runs)
        level = runs.select("group", "n", "at", F.struct("node").alias("item"))
        ends.append(level.where("n = 1"))
        height, most = height + 1, -(-most // fanout)
    below = None
    for h in range(height, -1, -1):
        # groups that end on this level start here, with nothing above them
        alone = ends[h].select("group", "at", F.col("item.node").alias("top"), "item", F.array().cast(f"array<{_STEP}>").alias("path"))
        if below is not None:
            above = below.select("group", "at", "top", "path")
            alone = alone.unionByName(_children(pivots[h].drop("n", "node").join(above, ["group", "at"]), fanout))
        below = stored(alone, "manifest-paths") if h else alone
    return below.select("group", "item", "top", "path")


def manifest(
    docs: DataFrame,
    fields: Sequence[str] = FIELDS,
    id_col: str = "doc_id",
    group_col: str = "lang",
    changed: dict[str, Column] | None = None,
    where_changed: Column | None = None,
    fanout: int = FANOUT,
) -> DataFrame:
    """Per document: doc_id, leaf, changed_leaf, subroot, root, path.

    A leaf is the digest of all ``fields`` (see `field_text`), so null and empty values
    differ. Below a group's root, leaves stand in the order of ids, a null id first and
    equal ids by their digests; groups stand in the order of their bytes, null first and
    apart from the empty one. ``path`` has the siblings up to ``root``. ``changed_leaf`` is
    the digest with the columns in ``changed`` replaced, on rows where ``where_changed``
    holds, else null. Repeated rows are leaves of their own. An empty table gives no rows.
    Columns not in ``fields`` are not read.
    """

    def leaf(values: dict[str, Column]) -> Column:
        return digest(*[field_text(values.get(c, F.col(f"`{c}`"))) for c in fields])

    group = F.coalesce(F.concat(F.lit("1"), F.col(f"`{group_col}`").cast("string")), F.lit("0"))
    other = F.when(where_changed, leaf(changed)) if changed else F.lit(None).cast("string")
    # texts are read once and not moved
    leaves = stored(
        docs.select(group.alias("group"), F.col(f"`{id_col}`").alias("id"), leaf({}).alias("node"), other.alias("changed")),
        "manifest-leaves",
    )
    rows = proofs(leaves.select("group", F.struct("node", "id", "changed").alias("item")), ["id", "node"], fanout)
    rows = stored(rows, "manifest-rows")
    tops = rows.groupBy("group").agg(F.first("top").alias("node"))
    tops = proofs(tops.select(F.lit("").alias("group"), F.struct("node", F.col("group").alias("name")).alias("item")), ["name"], fanout)
    tops = stored(tops.select(F.col("item.name").alias("group"), F.col("top").alias("root"), F.col("path").alias("above")), "manifest-tops")
    return rows.join(_small(tops), "group").select(
        F.col("item.id").alias("doc_id"),
        F.col("item.node").alias("leaf"),
        F.col("item.changed").alias("changed_leaf"),
        F.col("top").alias("subroot"),
        "root",
        F.concat("path", "above").alias("path"),
    )


def manifest_report(docs: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """Per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    In rows where 3 divides the crc32 of the id the text is lower-cased (A-Z) after the
    manifest was made, and ``folded_root`` comes from what is then there; ``verified`` says
    whether it is still the root. A null id is never changed.
    """
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    rows = manifest(docs, changed={"text": lower_ascii(F.col("text"))}, where_changed=hit, fanout=fanout)
    rows = rows.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"),
                       folded(F.coalesce("changed_leaf", "leaf"), F.col("path")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def _tree_sql(name: str, rows: str, fanout: int, levels: int) -> str:
    """``name_r0 ...``, the runs of each level, and ``name_top``, from rows (grp, node, pos, n)."""
    parts = [f"{name}_n0 AS (SELECT grp, n, pos, node FROM {rows})"]
    for k in range(levels):
        parts.append(
            f"""{name}_r{k} AS MATERIALIZED (
  SELECT grp, n, pos // {fanout} AS run, list(node ORDER BY pos) AS nodes FROM {name}_n{k} WHERE n > 1 GROUP BY grp, n, pos // {fanout}
), {name}_n{k + 1} AS MATERIALIZED (
  SELECT grp, (n + {fanout - 1}) // {fanout} AS n, run AS pos, sha256(array_to_string(nodes, '')) AS node FROM {name}_r{k}
)"""
        )
    tops = " UNION ALL ".join(f"SELECT grp, node FROM {name}_n{k} WHERE n = 1" for k in range(levels + 1))
    return ", ".join([*parts, f"{name}_top AS MATERIALIZED ({tops})"])


def _climb_sql(name: str, rows: str, tree: str, fanout: int, levels: int) -> str:
    """``name``: rows (grp, doc_id, leaf, folded, proof, pos, n) with ``folded`` and ``proof`` taken up to the top."""
    parts = [f"{name}_0 AS (SELECT * FROM {rows})"]
    before = f"coalesce(array_to_string(r.nodes[1:d.pos % {fanout}], ''), '')"
    after = f"coalesce(array_to_string(r.nodes[d.pos % {fanout} + 2:], ''), '')"
    for k in range(levels):
        parts.append(
            f"""{name}_{k + 1} AS MATERIALIZED (
  SELECT d.grp, d.doc_id, d.leaf, CASE WHEN d.n > 1 THEN sha256({before} || d.folded || {after}) ELSE d.folded END AS folded,
    d.proof || {before} || {after} AS proof, d.pos // {fanout} AS pos, (d.n + {fanout - 1}) // {fanout} AS n
  FROM {name}_{k} d LEFT JOIN {tree}_r{k} r ON d.n > 1 AND r.grp = d.grp AND r.run = d.pos // {fanout}
)"""
        )
    return ", ".join([*parts, f"{name} AS (SELECT * FROM {name}_{levels})"])


def _manifest_sql(fanout: int = FANOUT, levels: int = 8) -> str:
    """SQL for groups of up to ``fanout ** levels`` documents, and as many groups."""

    def field(c: str) -> str:
        return f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"

    def leaf(text: str) -> str:
        return f"sha256({' || '.join(field(text if c == 'text' else c) for c in FIELDS)})"

    # crc32 of the id's digits: eight shifts per byte
    digits = "list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))"
    shifted = "list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: xor(x >> 1, (x & 1) * 3988292384))"
    crc = f"xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, {digits}), lambda c, b: {shifted}))"
    return f"""
WITH marked AS MATERIALIZED (
  SELECT coalesce('1' || lang, '0') AS grp, doc_id, {leaf('text')} AS leaf,
    CASE WHEN {crc} % 3 = 0 THEN {leaf(f"translate(text, '{_UPPER}', '{_LOWER}')")} END AS other
  FROM documents
), leaves AS MATERIALIZED (
  SELECT grp, doc_id, leaf, coalesce(other, leaf) AS folded, '' AS proof,
    row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY grp) AS n
  FROM marked
), leaf_nodes AS (SELECT grp, leaf AS node, pos, n FROM leaves),
{_tree_sql('docs', 'leaf_nodes', fanout, levels)}, {_climb_sql('low', 'leaves', 'docs', fanout, levels)},
groups AS MATERIALIZED (
  SELECT '' AS grp, grp AS name, node, row_number() OVER (ORDER BY grp) - 1 AS pos, count(*) OVER () AS n FROM docs_top
),
{_tree_sql('langs', 'groups', fanout, levels)}, placed AS MATERIALIZED (
  SELECT g.grp, l.doc_id, l.leaf, l.folded, l.proof, g.pos, g.n, g.name FROM low l JOIN groups g ON g.name = l.grp
), starts AS (
  SELECT grp, doc_id, struct_pack(leaf := leaf, subroot := s.node) AS leaf, folded, proof, pos, n
  FROM placed p JOIN (SELECT name, node FROM groups) s USING (name)
), {_climb_sql('up', 'starts', 'langs', fanout, levels)}
SELECT doc_id, leaf.leaf AS leaf, leaf.subroot AS subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root,
  folded = root AS verified
FROM up, (SELECT node AS root FROM langs_top)
"""


MANIFEST_SQL = _manifest_sql()
