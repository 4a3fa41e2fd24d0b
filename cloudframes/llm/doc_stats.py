"""Counts of words, characters, lines and repeats of whole documents, a tile of texts at a time.

Words and lines are told apart by their bytes, windows by their words; codes only order them.
"""

import numpy as np

from . import common
from .common import distinct_slices, equal_rows, mixed, per_doc, text_tiles, words

SYMBOLS = b"#*$%&|<>"
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


def _class(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


_SYMBOL, _DIGIT, _UPPER, _STOP = _class(SYMBOLS), _class(b"0123456789"), _class(bytes(range(65, 91))), _class(b".,;:!?")


def _groups(columns: list[np.ndarray], code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of some columns: whether it occurs twice or more, and whether this is its first place."""
    order, same = equal_rows(columns, code)
    again = np.flatnonzero(same)
    twice, first = np.zeros(len(code), bool), np.ones(len(code), bool)
    twice[order[again]] = True
    twice[order[again - 1]] = True
    first[order[again]] = False
    return twice, first


def tile_stats(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    n = len(offsets) - 1
    size = np.diff(offsets)
    row_of = lambda at: np.searchsorted(offsets, at, side="right") - 1
    count = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets])
    starts, ends, row = words(data, offsets)
    word, values = distinct_slices(data, starts, ends)
    word = word.astype(np.int64)
    point = (data & 0xC0) != 0x80
    points = np.concatenate([[0], np.cumsum(point)])
    length = points[ends] - points[starts]
    out = {"n_bytes": size, "n_chars": np.diff(points[offsets]), "n_words": per_doc(row, n), "word_chars": per_doc(row, n, length), "n_symbols": count(_SYMBOL[data]), "n_digits": count(_DIGIT[data]), "n_upper": count(_UPPER[data]), "n_stops": count(_STOP[data]), "n_wide": count(data >= 0xC0), "square_chars": per_doc(row, n, length * length)}
    out["n_distinct"] = per_doc(np.unique(row * max(1, len(values)) + word) // max(1, len(values)), n)
    # words in 3-word windows that occur twice or more
    m = max(0, len(word) - 2)
    inside = row[:m] == row[2:] if m else np.zeros(0, bool)
    at = np.flatnonzero(inside)
    columns = [row[at], word[at], word[at + 1], word[at + 2]]
    code = sum((x.astype(np.uint64) * odd for x, odd in zip(columns, _ODD, strict=True)), np.zeros(len(at), np.uint64))
    twice, _ = _groups(columns, mixed(code) & common.CODE)
    covered = np.zeros(len(word) + 2, bool)
    for k in range(3):
        covered[at[twice] + k] = True
    out["n_repeat_words"] = per_doc(row[covered[: len(word)]], n)
    # lines with a word that equal an earlier line
    breaks = np.flatnonzero(data == 10)
    line_starts = np.unique(np.concatenate([offsets[:-1][size > 0], breaks + 1]))
    line_starts = line_starts[line_starts < len(data)] if len(data) else line_starts[:0]
    next_break = np.append(breaks, len(data))[np.searchsorted(breaks, line_starts)]
    line_row = row_of(line_starts)
    line_ends = np.minimum(next_break, offsets[1:][line_row])
    full = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_starts, line_ends, line_row = line_starts[full], line_ends[full], line_row[full]
    line, kinds = distinct_slices(data, line_starts, line_ends)
    key = line_row * max(1, len(kinds)) + line
    _, first = _groups([key], key)
    out["n_lines"] = per_doc(line_row, n)
    out["n_dup_lines"] = per_doc(line_row[~first], n)
    return out


def stats(column) -> dict[str, np.ndarray]:
    """tile_stats of all of an Arrow string column."""
    parts = [tile_stats(data, offsets) for _, _, data, offsets in text_tiles(column)]
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]} if parts else {}
