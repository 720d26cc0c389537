"""Language identification by compression: the language whose dictionary makes a text smallest."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringfold.llm.text import text_slices, utf8

#: Bytes of a language's dictionary, and of the pieces in which a text is compressed.
DICTIONARY_BYTES = 48 * 1024
PIECE_BYTES = 512
#: Training texts that are read per language, and bytes taken from each.
SAMPLE_TEXTS = 400
SAMPLE_BYTES = 512
LEVEL = 6
#: Bytes saved over the second best, per byte of text, below which a prediction is rejected.
NARROW = 0.01
UNKNOWN = "und"
_SHARPNESS = 40.0
_LETTERS = re.compile(r"[^\W\d_]+")


def fit_dictionaries(
    docs: DataFrame,
    training: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    sample_texts: int = SAMPLE_TEXTS,
    dictionary_bytes: int = DICTIONARY_BYTES,
) -> dict[str, bytes]:
    """Raw dictionaries by language, from a sample of the labelled rows where ``training`` holds.

    At most about ``sample_texts`` texts per language are chosen by a hash of text and id,
    each gives a piece of up to ``SAMPLE_BYTES`` from its middle. Languages are counted over
    all rows. Null, empty or blank texts and rows without a language are left out.
    """
    labelled = docs.where(training).select(
        F.col(lang_col).cast("string").alias("lang"),
        F.col(text_col).cast("string").alias("text"),
        F.xxhash64(F.col(text_col).cast("string"), F.col(id_col).cast("string")).alias("draw"),
    )
    labelled = labelled.where("lang IS NOT NULL AND trim(text) <> ''")
    counts = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    rates = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, sample_texts / n))])
    drawn = (F.col("draw").cast("double") / 2.0**64 + 0.5) < F.element_at(rates, F.col("lang"))
    size = F.length("text")
    middle = F.expr(f"substring(text, cast(greatest(1, (length(text) - {SAMPLE_BYTES}) / 2) as int), {SAMPLE_BYTES})")
    rows = labelled.where(drawn & (size > 0)).select("lang", "draw", middle.alias("piece")).collect()
    pieces: dict[str, list[str]] = {k: [] for k in counts}
    for row in sorted(rows, key=lambda r: r.draw):
        pieces[row.lang].append(row.piece)
    # the most frequent language first, which wins ties
    joined = {k: letters(" ".join(pieces[k]))[:dictionary_bytes] for k in sorted(counts, key=lambda k: (-counts[k], k))}
    return {k: raw for k, raw in joined.items() if len(raw) >= 8}


def letters(text: str) -> bytes:
    """The words of letters in a text, lower-cased, with single spaces: what is compressed."""
    return " ".join(_LETTERS.findall(text.lower())).encode()


class Compressors:
    """Sizes of a text under each language's dictionary."""

    def __init__(self, dictionaries: dict[str, bytes], level: int = LEVEL):
        self.languages = list(dictionaries)
        self._all = []
        for raw in dictionaries.values():
            known = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(level=level)
            self._all.append(
                zstandard.ZstdCompressor(
                    level=level, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False
                )
            )

    def sizes(self, text: bytes, piece_bytes: int = PIECE_BYTES) -> np.ndarray:
        pieces = [text[a : a + piece_bytes] for a in range(0, len(text), piece_bytes)]
        return np.array([sum([len(c.compress(p)) for p in pieces]) for c in self._all])


def identify(
    docs: DataFrame,
    dictionaries: dict[str, bytes],
    id_col: str = "doc_id",
    text_col: str = "text",
    narrow: float = NARROW,
    piece_bytes: int = PIECE_BYTES,
) -> DataFrame:
    """Per document: ``doc_id, lang_pred, score, margin, rejected``.

    A whole text is compressed piece by piece with the dictionary of every language; the
    smallest sum wins, on a tie the language of most training rows. ``margin`` is
    what it saves over the second best per byte of text; the prediction is ``rejected``
    where that is below ``narrow``. ``score`` (0 to 1) is the share of the winner when
    bytes saved count exponentially. A text that is null or has no letter, and every text
    if there are no dictionaries, is ``und`` with score 0 and margin 0, rejected.
    """

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = Compressors(dictionaries)
        for batch in batches:
            langs: list[str] = []
            scores: list[float] = []
            margins: list[float] = []
            for a, b in text_slices(batch.column(1)):
                data, offsets = utf8(batch.column(1).slice(a, b - a))
                raw = data.tobytes()
                for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    text = raw[s:e].decode("utf-8", "replace")
                    folded = letters(text)
                    if not compressors.languages or not any(map(str.isalpha, text)):
                        langs.append(UNKNOWN)
                        scores.append(0.0)
                        margins.append(0.0)
                        continue
                    sizes = compressors.sizes(folded, piece_bytes)
                    best = int(sizes.argmin())
                    lost = (sizes - sizes[best]) / len(folded)
                    langs.append(compressors.languages[best])
                    scores.append(float(1 / np.exp(-_SHARPNESS * lost).sum()))
                    margins.append(float(np.partition(lost, 1)[1]) if len(lost) > 1 else 1.0)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(langs, pa.string()),
                    pa.array(scores, pa.float64()),
                    pa.array(margins, pa.float64()),
                    pa.array([m < narrow for m in margins], pa.bool_()),
                ],
                names=["doc_id", "lang_pred", "score", "margin", "rejected"],
            )

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(predict, f"doc_id {kind}, lang_pred string, score double, margin double, rejected boolean")
