"""Counts over whole texts that the quality operators share."""

from __future__ import annotations

import numpy as np

from .textkernel import SPACE, Block, mix, span_hashes

_U = np.uint64


def _table(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


_SYMBOL, _DIGIT, _BANG, _STOP, _MARK = _table("#*$%&|<>"), _table("0123456789"), _table("!?"), _table(".!?"), _table(",;:.!?\"'()-")
_UPPER, _LOWER = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _table("abcdefghijklmnopqrstuvwxyz")

#: Names and order of the counts.
COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower", "n_digits", "n_bangs",
    "n_stops", "n_marks", "n_bytes", "n_chars", "n_distinct_words", "n_long_words", "n_short_words", "n_repeat_pairs", "sum_sq_word",
)


def counts(texts: list[bytes]) -> np.ndarray:
    """int64 [len(texts), len(COUNTS)]. Words are runs of bytes other than space and \\x09-\\x0D; lines are parted by \\n
    and count if they have a word; n_dup_lines are those equal to an earlier line of the text; n_repeat_words are words in
    3-word windows that the text has twice or more, n_repeat_pairs words equal to the word before."""
    import pandas as pd

    n = len(texts)
    if not n:
        return np.zeros((0, len(COUNTS)), np.int64)
    block = Block(texts)
    data = block.data
    starts, ends, doc = block.words()
    word = span_hashes(data, starts, ends)
    out: dict[str, np.ndarray] = {"n_words": np.bincount(doc, minlength=n)}

    def per_text(mask: np.ndarray) -> np.ndarray:  # with the newline that follows each text
        return np.add.reduceat(mask, block.starts, dtype=np.int64)

    head = (data & 0xC0) != 0x80
    inside = ~SPACE[data]
    out["word_chars"], out["n_chars"], out["n_bytes"] = per_text(head & inside), per_text(head) - 1, block.ends - block.starts
    for name, table in (("n_symbols", _SYMBOL), ("n_upper", _UPPER), ("n_lower", _LOWER), ("n_digits", _DIGIT), ("n_bangs", _BANG), ("n_stops", _STOP), ("n_marks", _MARK)):
        out[name] = per_text(table[data])

    stop = np.flatnonzero(data == 10)  # each text is followed by one
    begin = np.concatenate([[0], stop[:-1] + 1])
    full = np.maximum.reduceat(inside, begin)
    begin, stop = begin[full], stop[full]
    line_doc = np.searchsorted(block.ends, begin)
    key = span_hashes(data, begin, stop) ^ mix(line_doc.astype(np.uint64))
    out["n_lines"] = np.bincount(line_doc, minlength=n)
    code, keys = pd.factorize(key)
    first = np.zeros(len(keys), np.int64)
    first[code[::-1]] = np.arange(len(code))[::-1]
    out["n_dup_lines"] = out["n_lines"] - np.bincount(line_doc[first], minlength=n)

    salt = mix(doc.astype(np.uint64))
    repeated = np.zeros(len(word), bool)
    if len(word) > 2:
        at = np.flatnonzero(doc[:-2] == doc[2:])
        m, m2 = _U(0x9E3779B97F4A7C15), _U(0x9E3779B97F4A7C15**2 & (1 << 64) - 1)
        code, keys = pd.factorize(mix(word[at] * m2 + word[at + 1] * m + word[at + 2]) ^ salt[at])
        twice = at[np.bincount(code, minlength=len(keys))[code] > 1] if len(at) else at
        for k in range(3):
            repeated[twice + k] = True
    out["n_repeat_words"] = np.bincount(doc, weights=repeated, minlength=n).astype(np.int64)
    code, keys = pd.factorize(word ^ salt)
    first = np.zeros(len(keys), np.int64)
    first[code[::-1]] = np.arange(len(code))[::-1]
    out["n_distinct_words"] = np.bincount(doc[first], minlength=n)
    same = np.zeros(len(word), bool)
    same[1:] = (word[1:] == word[:-1]) & (doc[1:] == doc[:-1])
    out["n_repeat_pairs"] = np.bincount(doc, weights=same, minlength=n).astype(np.int64)
    size = ends - starts
    out["n_long_words"] = np.bincount(doc, weights=size > 12, minlength=n).astype(np.int64)
    out["n_short_words"] = np.bincount(doc, weights=size < 4, minlength=n).astype(np.int64)
    out["sum_sq_word"] = np.bincount(doc, weights=size.astype(float) ** 2, minlength=n).astype(np.int64)
    return np.stack([out[k] for k in COUNTS], axis=1).astype(np.int64)
