"""Statistics of whole texts that the quality operators (1 and 10) look at."""

from __future__ import annotations

import re
from collections import Counter
from operator import eq

import numpy as np

from .common import rolling

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
UPPER, DIGITS, BANGS = bytes(range(65, 91)), b"0123456789", b"!?"
WINDOW = 5
_SYMBOL_RUN = re.compile(rb"[#*$%&|<>]+")
_MARK = re.compile(rb"(?<![^ \t\n\x0b\x0c\r])[!-/:-@\[-`{-~]+(?![^ \t\n\x0b\x0c\r])")  # a word of ASCII punctuation

NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_bangs", "n_distinct", "n_symbol_runs", "n_marks", "n_short", "n_ends", "n_adjacent")


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """How many words are in windows of ``width`` words that occur twice or more; hashes choose windows, words decide."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    hashes = rolling(np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64), width, 0x9E3779B97F4A7C15)
    ordered = np.sort(hashes)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(hashes, twice)).tolist()
    windows = [tuple(words[i : i + width]) for i in at]
    counts = Counter(windows)
    edges = np.zeros(len(words) + 1, np.int32)
    for i, w in zip(at, windows, strict=True):
        if counts[w] > 1:
            edges[i] += 1
            edges[i + width] -= 1
    return int((np.cumsum(edges) > 0).sum())


def statistics(text: bytes, words: list[bytes]) -> tuple[int, ...]:
    """The statistics NAMES of a text in UTF-8 and its words."""

    def count(of: bytes) -> int:
        return len(text) - len(text.translate(None, of))

    seen, lines, again = set(), 0, 0
    for line in text.split(b"\n"):
        if line.strip(SPACES):
            lines += 1
            again += line in seen
            seen.add(line)
    chars = len(text.decode(errors="replace")) - count(SPACES)
    symbols = count(SYMBOLS)
    runs = len(_SYMBOL_RUN.findall(text)) if symbols else 0
    short = int((np.fromiter(map(len, words), np.int64, len(words)) <= 3).sum())
    return len(words), chars, symbols, again, repeated_words(words), lines, count(UPPER), count(DIGITS), count(BANGS), len(set(words)), runs, len(_MARK.findall(text)), short, count(b".!?"), sum(map(eq, words, words[1:]))


def shares(stats: np.ndarray) -> np.ndarray:
    """Shares that don't depend on the length of a text, one row for each row of statistics."""
    of = {n: stats[:, j].astype(float) for j, n in enumerate(NAMES)}
    words, chars, lines = np.maximum(of["n_words"], 1), np.maximum(of["word_chars"], 1), np.maximum(of["n_lines"], 1)
    return np.stack([
        of["n_symbols"] / chars, of["n_symbol_runs"] / words, of["n_marks"] / words, of["n_dup_lines"] / lines, of["n_repeat_words"] / words, of["n_upper"] / chars,
        of["n_digits"] / chars, of["n_bangs"] / words, np.minimum(chars / words, 60), of["n_short"] / words, np.minimum(words / np.maximum(of["n_ends"], 1), 200), of["n_adjacent"] / words,
    ], axis=1)


SHARES = ("symbols", "symbol_runs", "marks", "dup_lines", "repeats", "upper", "digits", "bangs", "word_length", "short", "sentence_length", "adjacent")
