"""Benchmark decontamination by winnowing.

Of every window of test words the least k-gram hash is its fingerprint. A training text
selects the fingerprints of its own windows in the same way, so every window that both
share is found; a hit is then extended to the window's words and compared with them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ringfold.llm.text import ALNUM, LOWER, Words, run_hashes, runs_inside, split_words, text_slices, utf8
from ringfold.workdir import stored

WINDOW = 10
GRAM = 5
#: Windows of test items that a task holds at a time; more take further passes over the texts.
BLOCK_WINDOWS = 100_000


def _windows(words: Words, n: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For runs of ``n`` words: least hash of a k-gram in it, for each start, and which starts count."""
    k = min(gram, n)
    grams = run_hashes(words.hash, k)
    count = len(words.hash) - n + 1
    least = grams[: max(count, 0)].copy()
    for j in range(1, n - k + 1):
        np.minimum(least, grams[j : j + count], out=least)
    return least, runs_inside(words, n)


def _spelled(data: np.ndarray, words: Words, start: int, n: int) -> bytes:
    return b" ".join(data[words.start[i] : words.end[i]].tobytes() for i in range(start, start + n))


def benchmark_windows(
    benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM
) -> DataFrame:
    """``item, n_words, fingerprint, spelled``: one row per different window of an item.

    A window is ``window`` consecutive words; an item of fewer words is one window, one of
    none has none. A null item id is the item of the empty name.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in text_slices(batch.column(1)):
                data, offsets = utf8(batch.column(1).slice(a, b - a))
                data = LOWER[data]
                words = split_words(data, offsets, ALNUM, lower=False)
                lengths = np.minimum(np.diff(words.first), window)
                rows = set()
                for n in set(lengths[lengths > 0].tolist()):
                    least, starts = _windows(words, n, gram)
                    for s in starts[lengths[words.row[starts]] == n].tolist():
                        item = batch.column(0)[a + int(words.row[s])].as_py()
                        rows.add((item or "", n, int(least[s].view(np.int64)), _spelled(data, words, s, n)))
                columns = list(zip(*rows, strict=True)) or [[], [], [], []]
                kinds = (pa.string(), pa.int32(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                    names=["item", "n_words", "fingerprint", "spelled"],
                )

    rows = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(cut, "item string, n_words int, fingerprint bigint, spelled binary").distinct()


class _Block:
    """Some windows of test items, for look-up by fingerprint and then by their words."""

    def __init__(self, rows: list):
        self.fingerprints: dict[int, np.ndarray] = {}
        self.items: dict[bytes, list[str]] = {}
        seen: dict[int, set[int]] = {}
        for row in rows:
            seen.setdefault(row.n_words, set()).add(row.fingerprint)
            self.items.setdefault(bytes(row.spelled), []).append(row.item)
        for n, values in seen.items():
            self.fingerprints[n] = np.sort(np.fromiter(values, np.int64, len(values)).view(np.uint64))

    def hits(self, data: np.ndarray, words: Words, gram: int) -> Iterator[tuple[int, int, list[str]]]:
        """``(first word, number of words, items)`` of every occurrence."""
        for n, wanted in self.fingerprints.items():
            least, starts = _windows(words, n, gram)
            if not len(starts):
                continue
            # neighbours mostly share their fingerprint: look each selected one up once
            new = np.ones(len(least), bool)
            new[1:] = least[1:] != least[:-1]
            selected = least[new]
            at = np.minimum(np.searchsorted(wanted, selected), len(wanted) - 1)
            found = (wanted[at] == selected)[np.cumsum(new) - 1]
            for s in starts[found[starts]].tolist():
                items = self.items.get(_spelled(data, words, s, n))
                if items:
                    yield s, n, items


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField(
            "spans",
            T.ArrayType(T.StructType([T.StructField("from", T.LongType()), T.StructField("to", T.LongType())])),
        ),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)


def _pass(rows: DataFrame, block: _Block, gram: int) -> DataFrame:
    """Add the hits of one block to what earlier passes found. No shuffle."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kind = to_arrow_type(_FOUND)
        for batch in batches:
            texts = batch.column("text")
            for a, b in text_slices(texts):
                data, offsets = utf8(texts.slice(a, b - a))
                data = LOWER[data]
                words = split_words(data, offsets, ALNUM, lower=False)
                counts, first = np.diff(words.first).tolist(), words.first.tolist()
                spans: list[list] = [[] for _ in range(b - a)]
                items: list[set[str]] = [set() for _ in range(b - a)]
                for d, old in enumerate(batch.column("found").slice(a, b - a)):
                    if old.is_valid:
                        spans[d] = [(x["from"], x["to"]) for x in old["spans"].as_py()]
                        items[d].update(old["items"].as_py())
                for s, n, its in block.hits(data, words, gram):
                    d = int(words.row[s])
                    spans[d].append((s - first[d], s - first[d] + n))
                    items[d].update(its)
                found = [
                    {"n_words": c, "spans": [{"from": x, "to": y} for x, y in _merged(p)], "items": sorted(i)}
                    for c, p, i in zip(counts, spans, items, strict=True)
                ]
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found, kind) if n == "found" else part.column(n) for n in batch.schema.names],
                    names=batch.schema.names,
                )

    return rows.mapInArrow(scan, rows.schema)


def find_benchmark(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    keep: list[str] | None = None,
    window: int = WINDOW,
    gram: int = GRAM,
    block_windows: int = BLOCK_WINDOWS,
) -> DataFrame:
    """Where windows of test items occur in texts, one row per document.

    Columns: ``row`` (the columns named by ``keep``, default all), ``n_words``, ``n_hit``
    (words inside an occurrence), ``spans`` (ranges of hit words), ``items`` (ids of items
    with occurring windows, sorted as strings), ``contaminated``.

    Words are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z
    lower-cased. A null text has none. Windows are counted first and taken in blocks of
    ``block_windows``; documents are read once per block and never shuffled, so repeated
    passages, long texts and hot sources cost no more than their length. Without test
    windows nothing is hit.
    """
    windows = stored(benchmark_windows(benchmark, item_col, item_text_col, window, gram), "benchmark-windows")
    blocks = -(-windows.count() // block_windows)
    kept = F.struct(*[F.col(c) for c in (docs.columns if keep is None else keep)])
    nothing = F.lit(None).cast(_FOUND)
    rows = docs.select(kept.alias("row"), F.col(text_col).cast("string").alias("text"), nothing.alias("found"))
    for i in range(max(1, blocks)):
        # all windows with one fingerprint are in one block
        own = windows.where(F.pmod(F.xxhash64("fingerprint"), F.lit(max(1, blocks))) == i)
        rows = _pass(rows, _Block(own.collect()), gram)
    spans = F.col("found.spans")
    n_hit = F.aggregate(spans, F.lit(0).cast("bigint"), lambda n, s: n + s["to"] - s["from"])
    return rows.select("row", "found.n_words", n_hit.alias("n_hit"), spans.alias("spans"), "found.items", (n_hit > 0).alias("contaminated"))


def contamination_report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = find_benchmark(docs, benchmark, keep=[id_col], **options)
    return found.select(
        F.col("row").getField(id_col).alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that hold no window of a test item, with all their columns."""
    return find_benchmark(docs, benchmark, **options).where("NOT contaminated").select("row.*")


REPORT_SQL = r"""
WITH item_words AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), windows AS (
  SELECT DISTINCT coalesce(item, '') AS item, least(len(w), 10) AS n,
    array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS spelled
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item_words WHERE len(w) > 0)
), lengths AS (SELECT DISTINCT n FROM windows),
docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), starts AS (
  SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS spelled
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, lengths WHERE len(w) >= n)
), hits AS (
  SELECT s.r, s.i, s.n, x.item FROM starts s JOIN windows x ON s.n = x.n AND s.spelled = x.spelled
), words_hit AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r
), items_hit AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(t.items, '')) AS items_sha256,
  coalesce(h.n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN words_hit h USING (r) LEFT JOIN items_hit t USING (r)
"""
