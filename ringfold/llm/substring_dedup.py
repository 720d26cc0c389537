"""Removal of repeated byte strings with run-length compressed Burrows-Wheeler indexes.

One index over all texts cannot be spread over machines, so the corpus is cut by content.
Of the k-grams in a string of ``length`` bytes the one with the least hash is its anchor.
Equal strings have equal anchors: consecutive strings with one anchor make a segment of
some 70 bytes, and only segments of one anchor can hold equal strings. Most anchors are in
one document only and go no further. Equal segments are settled by their hashes. What is
left, different segments of one anchor, are the edges of repeated passages; their bytes
are fetched and indexed, many anchors to an index, and looked up in it by the order of their
suffixes. Only where one anchor has very many different segments, their strings are compared one by one instead.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringfold.llm.runlength import RunLengthIndex
from ringfold.llm.samples import drawn
from ringfold.llm.text import hash_spans, mix, prefix_hashes, text_slices, utf8
from ringfold.workdir import stored

LENGTH = 50
GRAM = 16
#: Strings that a segment has at most.
SEGMENT = 512
#: One document in so many is sampled for anchors that are in very many documents, which skip
#: the count of documents per anchor; so many of them are known at most.
SAMPLE = 32
SAMPLE_HITS = 8
MOST_FREQUENT = 1 << 17
#: Different segments of a frequent anchor beyond which their strings are compared by 128-bit hashes.
MANY_SEGMENTS = 20_000
#: Bytes of text in an index.
INDEX_BYTES = 1 << 20
#: Measured bytes of lists per document up to which they are broadcast; beyond, texts are shuffled.
#: So small that the plan is the same from some tens of MB of texts on, and shuffles grow as they do.
BROADCAST_BYTES = 2 << 20
#: Bits of an anchor's hash that are shuffled. Anchors that agree in them are only compared for
#: nothing. The low ones, as the least of several hashes has few high ones.
ANCHOR_BITS = 40
_PIECE = 512 << 10
_MARK_BITS = 22
_ANY = 2047


def _window_min(h: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        h = np.minimum(h[: len(h) - size], h[size:])
        size *= 2
    return np.minimum(h[: len(h) - (width - size)], h[width - size :]) if size < width else h


def _text_mark(text: bytes) -> int:
    """Tells texts apart that share an id."""
    return zlib.crc32(text) & ((1 << _MARK_BITS) - 1)


def _segments(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """``(anchor, hash of the segment, text, first start, starts, flanks)`` arrays, piece by piece."""
    n = len(data)
    if length <= gram:
        raise ValueError("an anchor is shorter than the strings")
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    for p in range(0, max(0, n - length + 1), _PIECE):
        q = min(n - length + 1, p + _PIECE)
        piece = data[p : q + length - 1]
        sums, inverse = prefix_hashes(piece)
        grams = hash_spans(sums, inverse, np.arange(len(piece) - gram + 1), np.arange(gram, len(piece) + 1))
        least = _window_min(grams, length - gram + 1)
        start = np.arange(p, q)
        row = rows[p:q]
        valid = start + length <= offsets[row + 1]
        new = np.ones(len(start), bool)
        new[1:] = (least[1:] != least[:-1]) | (row[1:] != row[:-1]) | ~valid[:-1]
        run = np.flatnonzero(new)
        # cut long runs
        within = np.arange(len(start)) - run[np.cumsum(new) - 1]
        new |= within % SEGMENT == 0
        first = np.flatnonzero(new & valid)
        bound = np.append(np.flatnonzero(new | ~valid), len(start))
        last = bound[np.searchsorted(bound, first, "right")]
        whole = hash_spans(sums, inverse, first, last + length - 1)
        flanks = _flanks(grams, least, sums, inverse, first, last - 1, length, gram)
        yield least[first], whole, row[first], first + p - offsets[row[first]], last - first, flanks


def _flanks(
    grams: np.ndarray,
    least: np.ndarray,
    sums: np.ndarray,
    inverse: np.ndarray,
    first: np.ndarray,
    last: np.ndarray,
    length: int,
    gram: int,
) -> np.ndarray:
    """Twice 11 bits of what stands before and after the anchors of segments.

    Of the bytes of a string beyond its anchor, half or more are on one side. So two
    segments only share a string if what stands on a side of their anchors agrees so far.
    0: no string of the segment has so much on that side. _ANY: the anchor's gram stands
    more than once in the segment, so that strings differ in which of them they hold.
    """
    beyond = length - gram
    half = (beyond + 1) // 2
    within = np.lib.stride_tricks.sliding_window_view(grams, beyond + 1)
    anchor = least[first][:, None]
    # every string has the gram: the segment's first one is in its first string, the last one in its last
    place = first + (within[first] == anchor).argmax(1)
    again = last + beyond - (within[last, ::-1] == anchor).argmax(1)
    out = np.full(len(first), (_ANY << 11) | _ANY, np.uint64)
    known = place == again
    at = place[known]
    before, after = np.maximum(at - half, 0), np.minimum(at + gram + half, len(sums) - 1)
    left = hash_spans(sums, inverse, before, at) % np.uint64(_ANY - 1) + np.uint64(1)
    right = hash_spans(sums, inverse, at, after) % np.uint64(_ANY - 1) + np.uint64(1)
    left[at - first[known] < half] = 0
    right[last[known] + beyond < at + half] = 0
    out[known] = (left << np.uint64(11)) | right
    return out


def _rows(columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], names=list(columns))


def _pack(mark: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """First start (32 bits) and number of starts (10 bits) in one number, below 22 bits more.

    These are the flanks of the segment, or where ids have several texts the text's mark.
    """
    m, s, c = (x.astype(np.uint64) for x in (mark, start, count))
    return ((m << np.uint64(42)) | (s << np.uint64(10)) | c).view(np.int64)


def _unpack(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    u = packed.view(np.uint64)
    mark = (u >> np.uint64(42)).astype(np.int64)
    return mark, ((u >> np.uint64(10)) & np.uint64(0xFFFFFFFF)).astype(np.int64), (u & np.uint64(1023)).astype(np.int64)


def _anchored(rows: DataFrame, frequent: np.ndarray, marked: bool, length: int, gram: int) -> DataFrame:
    """Segments of texts: ``doc, place, whole, anchor, spread``.

    ``spread`` is 0, or for frequent anchors a number from 1 to 1024 by document.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for a, b in text_slices(batch.column(1), 1 << 20):
                data, offsets = utf8(batch.column(1).slice(a, b - a))
                marks = np.zeros(b - a, np.int64)
                if marked:
                    raw = data.tobytes()
                    marks[:] = [_text_mark(raw[s:e]) for s, e in zip(offsets[:-1], offsets[1:], strict=True)]
                for anchor, whole, row, start, count, flanks in _segments(data, offsets, length, gram):
                    anchor = anchor & np.uint64((1 << ANCHOR_BITS) - 1)
                    spread = np.zeros(len(anchor), np.int32)
                    if len(frequent):
                        at = np.minimum(np.searchsorted(frequent, anchor.view(np.int64)), len(frequent) - 1)
                        often = frequent[at] == anchor.view(np.int64)
                        spread[often] = mix(ids[a + row[often]].view(np.uint64)) % np.uint64(1024) + np.uint64(1)
                    yield _rows(
                        {
                            "doc": ids[a + row],
                            "place": _pack(marks[row] if marked else flanks, start, count),
                            "whole": whole.view(np.int64),
                            "anchor": anchor.view(np.int64),
                            "spread": spread,
                        }
                    )

    return rows.mapInArrow(cut, "doc bigint, place bigint, whole bigint, anchor bigint, spread int")


_PLACED = "anchor bigint, doc bigint, place bigint, whole bigint, edge int"
#: ``edge``: settled as repeated; to be looked for; only looked in; either, of an anchor with many
#: segments; of a frequent anchor, not yet settled.
_SETTLED, _SOUGHT, _KNOWN, _MANY, _OFTEN = 0, 1, 2, 3, 4
#: Rows that are settled in one call.
_SETTLE_ROWS = 1 << 15


def group_starts(values: np.ndarray) -> np.ndarray:
    return np.r_[True, values[1:] != values[:-1]] if len(values) else np.zeros(0, bool)


def _may_share(group: np.ndarray, flanks: np.ndarray | None) -> np.ndarray:
    """For different segments, whether their flanks allow a string that another of the group has."""
    _, of, members = np.unique(group, return_inverse=True, return_counts=True)
    if flanks is None:
        return members[of] > 1
    out = np.zeros(len(group), bool)
    for flank in (flanks >> 11, flanks & _ANY):
        _, alike, times = np.unique(group * (_ANY + 1) + flank, return_inverse=True, return_counts=True)
        out |= (times[alike] > 1) & (flank > 0)
        out |= np.isin(group, np.unique(group[flank == _ANY]))
    return out & (members[of] > 1)


def _settled(rows: DataFrame, marked: bool) -> DataFrame:
    """``_PLACED`` rows from segments, one anchor after another. Anchors of one document go.

    A segment of which the same stands in a smaller document is repeated as a whole; the
    first of each different segment of an anchor is to be looked for in those of smaller
    documents. Anchors are in some hundred documents at most here; frequent ones, which are
    spread over tasks, pass through.
    """

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            n += batch.num_rows
            if n < _SETTLE_ROWS:
                continue
            # up to where the last anchor begins
            together = pa.concat_batches(held)
            anchors = together.column("anchor").to_numpy()
            last = int(np.searchsorted(anchors, anchors[-1]))
            yield from _one(together.slice(0, last))
            held, n = [together.slice(last)], len(anchors) - last
        if held:
            yield from _one(pa.concat_batches(held))

    def _one(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        columns = {c: rows.column(c).to_numpy() for c in ("anchor", "doc", "place", "whole", "spread")}
        often = columns["spread"] > 0
        if often.any():
            passed = {c: columns[c][often] for c in ("anchor", "doc", "place", "whole")}
            yield _rows({**passed, "edge": np.full(int(often.sum()), _OFTEN, np.int32)})
        anchor, doc, place, whole = (columns[c][~often] for c in ("anchor", "doc", "place", "whole"))
        if not len(anchor):
            return
        begins = group_starts(anchor)
        group, of = np.flatnonzero(begins), np.cumsum(begins) - 1
        kind = begins | group_starts(whole)
        first = doc[np.flatnonzero(kind)][np.cumsum(kind) - 1]  # rows are in order of document
        least, most = np.minimum.reduceat(doc, group)[of], np.maximum.reduceat(doc, group)[of]
        several = _may_share(of[kind], None if marked else _unpack(place[kind])[0])[np.cumsum(kind) - 1]
        edge = np.where(doc > first, _SETTLED, np.where(doc > least, _SOUGHT, _KNOWN)).astype(np.int32)
        out = (least < most) & ((edge == _SETTLED) | several)
        kept = {"anchor": anchor, "doc": doc, "place": place, "whole": np.zeros_like(whole), "edge": edge}
        yield _rows({c: x[out] for c, x in kept.items()})

    ordered = rows.repartition("anchor", "spread").sortWithinPartitions("anchor", "whole", "doc")
    return ordered.mapInArrow(settle, _PLACED)


def _settled_frequent(rows: DataFrame) -> DataFrame:
    """The same for anchors in very many documents, by counts that are combined before the shuffle."""
    classes = rows.groupBy("anchor", "whole").agg(F.min("doc").alias("first"))
    anchors = classes.groupBy("anchor").agg(F.min("first").alias("least"), F.count("*").alias("n"))
    classes = stored(classes.join(anchors, "anchor"), "segment-classes")
    edge = F.when(F.col("doc") > F.col("first"), _SETTLED).when(F.col("n") > MANY_SEGMENTS, _MANY)
    edge = edge.when(F.col("doc") > F.col("least"), _SOUGHT).otherwise(_KNOWN).cast("int")
    placed = rows.drop("edge").join(classes, ["anchor", "whole"]).withColumn("edge", edge)
    return placed.where((F.col("edge") == _SETTLED) | (F.col("n") > 1)).select("anchor", "doc", "place", "edge")


def _beside(docs: DataFrame, lists: DataFrame, column: str, entry_bytes: int, how: str) -> DataFrame:
    """Join stored lists per document to documents: broadcast if measured to be small."""
    size = lists.agg(F.sum(64 + entry_bytes * F.size(column))).first()[0] or 0
    return docs.join(F.broadcast(lists) if size <= BROADCAST_BYTES else lists, "doc", how)


def _index(rows: DataFrame, length: int) -> DataFrame:
    """Matches ``doc, place`` in rows ``shard, bytes, doc, place, sought``.

    A task indexes the segments of its anchors, ``INDEX_BYTES`` at a time. Equal strings
    have one anchor, and the segments of an anchor are never parted.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            shard = batch.column("shard").to_numpy()
            if held and size >= INDEX_BYTES:
                # up to where the last anchor ends
                last = int(np.searchsorted(shard, held[-1].column("shard")[-1].as_py(), "right"))
                if last < len(shard):
                    yield from _matches(pa.concat_batches([*held, batch.slice(0, last)]))
                    held, size = [], 0
                    batch = batch.slice(last)
            held.append(batch)
            size += batch.column("bytes").nbytes
        if held:
            yield from _matches(pa.concat_batches(held))

    def _matches(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        doc, place, sought = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "place", "sought"))
        index = RunLengthIndex(rows.column("bytes").to_pylist(), doc, length)
        text, start = index.matches(np.flatnonzero(sought))
        if len(text):
            above, first, _ = _unpack(place[text])
            yield _rows({"doc": doc[text], "place": _pack(above, first + start, np.ones(len(text), np.int64))})

    ordered = rows.repartition("shard").sortWithinPartitions("shard", "doc")
    return ordered.mapInArrow(search, "doc bigint, place bigint")


_FETCHED = "shard bigint, again bigint, bytes binary, doc bigint, place bigint, sought boolean"


def _fetch(docs: DataFrame, wanted: DataFrame, marked: bool, length: int) -> DataFrame:
    """The bytes of segments ``anchor, doc, place, edge``.

    Of anchors with many segments every string has a row, without its bytes: ``shard`` and
    ``again`` are 128 bits of it. Else ``again`` is null and ``shard`` the anchor.
    """
    lists = wanted.groupBy("doc").agg(F.collect_list(F.struct("anchor", "place", "edge")).alias("wanted"))
    lists = stored(lists, "segments-wanted")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, text, wanted in zip(batch.column("doc").to_pylist(), batch.column("text"), batch.column("wanted"), strict=True):
                raw = (text.as_py() or "").encode()
                anchor, place, edge = (x.to_numpy(zero_copy_only=False) for x in wanted.values.flatten())
                mark, start, count = _unpack(place)
                own = mark == _text_mark(raw) if marked else np.ones(len(place), bool)
                for i in np.flatnonzero(own).tolist():
                    s, n = int(start[i]), int(count[i])
                    if edge[i] <= _KNOWN:
                        whole = raw[s : s + n + length - 1]
                        out.append((int(anchor[i]), None, whole, doc, int(place[i]), bool(edge[i] == _SOUGHT)))
                        continue
                    at = _pack(np.full(n, mark[i]), np.arange(s, s + n), np.ones(n, np.int64)).tolist()
                    for j in range(n):
                        digest = hashlib.blake2b(raw[s + j : s + j + length], digest_size=16).digest()
                        out.append((*struct.unpack("<qq", digest), None, doc, at[j], True))
            columns = zip(*out, strict=True) if out else [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.bool_())
            names = ["shard", "again", "bytes", "doc", "place", "sought"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return _beside(docs, lists, "wanted", 48, "inner").select("doc", "text", "wanted").mapInArrow(read, _FETCHED)


def _spans(starts: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Byte ranges that cover the strings at ``(first start, number of starts)``."""
    out: list[list[int]] = []
    for s, n in sorted(starts):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s + n + length - 1)
        else:
            out.append([s, s + n + length - 1])
    return [(a, b) for a, b in out]


def _merged(places: DataFrame, marked: bool, length: int) -> DataFrame:
    """Per document the covered ranges of bytes: ``doc, spans`` with (mark, from, to) in turn."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = []
            for places in batch.column(1):
                mark, start, count = _unpack(places.values.to_numpy(zero_copy_only=False))
                mark = mark if marked else np.zeros_like(mark)
                by_mark: dict[int, list[tuple[int, int]]] = {}
                for m, s, c in zip(mark.tolist(), start.tolist(), count.tolist(), strict=True):
                    by_mark.setdefault(m, []).append((s, c))
                spans.append([x for m, rows in by_mark.items() for a, b in _spans(rows, length) for x in (m, a, b)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(pa.int64()))], names=["doc", "spans"])

    lists = places.groupBy("doc").agg(F.collect_list("place").alias("places"))
    return lists.mapInArrow(merge, "doc bigint, spans array<bigint>")


def repeated_spans(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM
) -> tuple[DataFrame, bool]:
    """``doc, spans``: the bytes of each document that also are in a smaller one, stored.

    With it, whether ids have several texts; spans then name the text by its checksum.

    A document's strings of ``length`` bytes count as repeated if one also starts in a
    document with a smaller id. Only documents with repeated strings have a row.
    """
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).cast("string").alias("text"))
    docs = docs.where(F.col("doc").isNotNull())
    marked = _several_texts(docs)
    none = np.zeros(0, np.int64)
    sample = _anchored(docs.where(drawn(F.col("doc"), 1 / SAMPLE, 31)), none, marked, length, gram)
    sample = sample.select("anchor", "doc").groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") >= SAMPLE_HITS)
    best = sample.orderBy(F.desc("n"), "anchor").limit(MOST_FREQUENT).collect()
    frequent = np.sort(np.array([r.anchor for r in best], np.int64))
    placed = stored(_settled(_anchored(docs, frequent, marked, length, gram), marked), "segments-placed")
    if len(frequent):
        often = _settled_frequent(placed.where(F.col("edge") == _OFTEN))
        placed = placed.where(F.col("edge") != _OFTEN).drop("whole").unionByName(often)
    fetched = stored(_fetch(docs, placed.where(F.col("edge") != _SETTLED), marked, length), "segments-fetched")
    found = _index(fetched.where("again IS NULL").drop("again"), length)
    if len(frequent):
        strings = fetched.where("again IS NOT NULL").select("shard", "again", "doc", "place")
        least = strings.groupBy("shard", "again").agg(F.min("doc").alias("least"), F.max("doc").alias("most"))
        least = least.where("least < most").select("shard", "again", "least")
        found = found.unionByName(strings.join(least, ["shard", "again"]).where("doc > least").select("doc", "place"))
    settled = placed.where(F.col("edge") == _SETTLED).select("doc", "place")
    return stored(_merged(settled.unionByName(found), marked, length), "repeated-spans"), marked


def _several_texts(docs: DataFrame) -> bool:
    """Whether an id has different texts."""
    texts = docs.select("doc", F.xxhash64("text").alias("text")).groupBy("doc").agg(F.min("text").alias("a"), F.max("text").alias("b"))
    return bool(texts.where("a <> b").head(1))


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: list[str] | None = None,
    length: int = LENGTH,
    gram: int = GRAM,
) -> DataFrame:
    """Per document: ``row`` (columns named by ``keep``, default all), ``kept``, and counts.

    Every byte that is covered by a string of ``length`` bytes which also starts in a
    document with a smaller id is removed. ``kept`` holds the remaining bytes; with
    ``n_bytes``, ``n_removed`` and ``n_spans`` (maximal removed runs).

    Texts are UTF-8 bytes and matches never cross documents. Null texts are empty. Texts
    under a null id are left whole and remove nothing. Texts that share an id are judged
    apart and do not remove from each other.
    """
    spans, marked = repeated_spans(docs, id_col, text_col, length, gram)
    kept = F.struct(*[F.col(c) for c in (docs.columns if keep is None else keep)])
    rows = docs.select(
        kept.alias("row"), F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).cast("string").alias("text")
    )
    rows = _beside(rows, spans, "spans", 8, "left").select("row", "text", "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for text, spans in zip(batch.column("text"), batch.column("spans"), strict=True):
                raw = (text.as_py() or "").encode()
                own: list[int] = []
                if spans.is_valid:
                    mark, flat = _text_mark(raw) if marked else 0, spans.as_py()
                    own = [x for i in range(0, len(flat), 3) if flat[i] == mark for x in flat[i + 1 : i + 3]]
                ends = [0, *own, len(raw)]
                left = b"".join([raw[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True)])
                out.append((left, len(raw), len(raw) - len(left), len(own) // 2))
            columns = zip(*out, strict=True) if out else [[]] * 4
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64())
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *arrays], names=["row", "kept", "n_bytes", "n_removed", "n_spans"])

    schema = rows.select(
        "row",
        F.lit(b"").alias("kept"),
        *(F.lit(0).cast("bigint").alias(c) for c in ("n_bytes", "n_removed", "n_spans")),
    ).schema
    return rows.mapInArrow(cut, schema)


