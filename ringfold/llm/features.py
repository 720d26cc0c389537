"""Dense features of whole texts, for classifiers of quality and toxicity."""

from __future__ import annotations

import operator
import re
from collections import Counter

import numpy as np

_OBFUSCATED = re.compile(r"(?<![^\W\d_])[^\W\d_]+[\d@$*!#%&]+[^\W\d_]|(?:(?<!\S)[^\W\d_][\s._-]){3,}")
#: Per byte, what it counts as: letters, capitals, digits, punctuation, white space.
_BYTES = [bytes([c]) for c in range(128)]
_CAPITAL = np.array([c < 128 and _BYTES[c].isupper() for c in range(256)])
_LETTER = np.array([c < 128 and _BYTES[c].isalpha() for c in range(256)])
_DIGIT = np.array([c < 128 and _BYTES[c].isdigit() for c in range(256)])
_SPACE = np.array([c < 128 and _BYTES[c].isspace() for c in range(256)])
_PUNCTUATION = np.array([32 < c < 127 for c in range(256)]) & ~_LETTER & ~_DIGIT
_CONTINUES = np.array([128 <= c < 192 for c in range(256)])

#: Forms of address of the four languages.
SECOND_PERSON = frozenset(
    "you your yours yourself yourselves u ur tu te ti toi vous ton ta tes votre vos du dich dir dein deine deiner"
    " ihr euch euer usted ustedes vosotros vuestro".split()
)

SHAPE_NAMES = (
    "log_words",
    "mean_word",
    "long_words",
    "one_letter_words",
    "capitals",
    "all_capital_words",
    "digits",
    "punctuation",
    "exclamations",
    "bars",
    "marked_words",
    "distinct_words",
    "same_as_before",
    "top_word",
    "words_per_line",
    "line_repeats",
    "most_capital_line",
    "other_characters",
    "links",
    "obfuscated",
    "second_person",
    "sentence_ends",
)
_SYMBOLS = frozenset("#$%&*@^~=+<>\\{}[]_`")


def shape(text: str) -> list[float]:
    """``SHAPE_NAMES`` of a text, as rates; an empty text is all zeros.

    Characters beyond ASCII count as letters.
    """
    tokens = text.split()
    n = len(tokens)
    if not n:
        return [0.0] * len(SHAPE_NAMES)
    bins = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
    chars = int(bins.sum() - bins[_CONTINUES].sum())
    wide = chars - int(bins[:128].sum())
    letters = int(bins[_LETTER].sum()) + wide
    punctuation = int(bins[_PUNCTUATION].sum())
    counts = Counter(tokens)
    marked = shouted = short = long = ends = address = 0
    for t, c in counts.items():
        size, last = len(t), t[-1]
        if size == 1:
            short += c
        elif last in _SYMBOLS:
            marked += c
        if size > 12:
            long += c
        if size > 2 and t.isupper():
            shouted += c
        if last in ".!?":
            ends += c
        if size < 14 and t.lower().strip(".,!?") in SECOND_PERSON:
            address += c
    lines = [line for line in text.split("\n") if line and not line.isspace()]
    capital_lines = sum(len(line) for line in lines if line.isupper())
    links = text.count("http://") + text.count("https://") + text.count("www.") + int(bins[64])
    return [
        float(np.log1p(n)),
        letters / n,
        long / n,
        short / n,
        int(bins[_CAPITAL].sum()) / max(1, letters),
        shouted / n,
        int(bins[_DIGIT].sum()) / chars,
        punctuation / chars,
        int(bins[33]) / n,
        counts.get("|", 0) / n,
        marked / n,
        len(counts) / n,
        sum(map(operator.eq, tokens, tokens[1:])) / n,
        max(counts.values()) / n,
        float(np.log1p(n / max(1, len(lines)))),
        1 - len(set(lines)) / max(1, len(lines)),
        capital_lines / chars,
        wide / chars,
        links / n,
        len(_OBFUSCATED.findall(text)) / n,
        address / n,
        ends / n,
    ]
