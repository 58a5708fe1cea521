"""Layout estimates: font size by bisection, padding, greedy word wrap with shrinking over a table of character widths."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable
from itertools import accumulate
from math import floor, inf, isfinite, isnan

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.functions import text as X

#: Advance and line height in font sizes, usable share of a box, halvings.
ADVANCE, LEADING, USABLE, HALVINGS = 0.52, 1.2, 0.95, 64
#: In thousandths of a font size: the advance of a character that the width table lacks, and the height of a capital.
USUAL, CAPITAL = 520, 700


@F.pandas_udf(T.DoubleType())
def largest_fit(n_chars: pd.Series, room_w: pd.Series, room_h: pd.Series, low: pd.Series, high: pd.Series, advance: pd.Series, leading: pd.Series) -> pd.Series:
    """The greatest size between two at which so many characters fit into a room, by halving; ``low`` if none does."""
    n, w, h, lo, hi, advance, leading = (x.to_numpy(dtype=float) for x in (n_chars, room_w, room_h, low, high, advance, leading))
    lo, hi, best = lo.copy(), hi.copy(), lo.copy()
    for _ in range(HALVINGS):
        mid = (lo + hi) * 0.5
        per_line = np.maximum(w / (mid * advance), 1.0)
        ok = np.ceil(n / per_line) * leading * mid <= h
        lo, hi, best = np.where(ok, mid, lo), np.where(ok, hi, mid), np.where(ok, mid, best)
    return pd.Series(best)


def font_size(n_chars: Column, box_w: Column, box_h: Column, low: float = 10.0, high: float = 150.0) -> Column:
    """The greatest size that fits, by halving the range; the least size if none does. A fold of 64 steps is not
    compiled by Catalyst, so whole batches are halved as arrays."""
    return largest_fit(n_chars, box_w * USABLE, box_h * USABLE, F.lit(low), F.lit(high), F.lit(ADVANCE), F.lit(LEADING))


def stroke_of(size: Column, one_word: Column) -> Column:
    return F.when(one_word, F.greatest(F.lit(2), (size * 0.08).cast("int"))).otherwise(F.greatest(F.lit(1), (size * 0.05).cast("int")))


def padding(size: Column, stroke: Column) -> Column:
    return F.greatest(size * 0.3 + size * stroke, F.lit(15.0))


def _broken(word: str, room: int, wide: Callable[[str], int], hyphen: int) -> tuple[list[str], str]:
    """A word's longest beginnings that fit with a hyphen, one character at least, while the rest is wider than the room."""
    upto = [0, *accumulate(map(wide, word))]
    at, last, pieces = 0, len(word), []
    while upto[last] - upto[at] > room and last - at > 1:
        cut = min(last - 1, max(at + 1, bisect_right(upto, room - hyphen + upto[at], at) - 1))
        pieces.append(word[at:cut] + "-")
        at = cut
    return pieces, word[at:]


def wrapped(words: list[str], lengths: list[int], upto: list[int], room: int, wide: Callable[[str], int], blank: int, hyphen: int, most: float = inf) -> list[str] | None:
    """The lines of words in a room in whole thousandths of the font size; None once they are more than ``most``. ``upto`` are running
    sums of the lengths and a blank for each word.

    A word goes on the line while it fits. One wider than the room starts a line of its own and is cut (``_broken``); what is left of
    it goes on as a word does. Where a line ends is found in the running sums."""
    lines: list[str] = []
    i = 0
    while i < len(words):
        if lengths[i] > room:
            pieces, rest = _broken(words[i], room, wide, hyphen)
            end = max(i + 1, bisect_right(upto, room - sum(map(wide, rest)) + upto[i + 1], i) - 1)
            lines += [*pieces, " ".join([rest, *words[i + 1 : end]])]
        else:
            end = bisect_right(upto, room + blank + upto[i], i) - 1
            lines.append(" ".join(words[i:end]))
        if len(lines) > most:
            return None
        i = end
    return lines


def gap_of(size: int) -> float:
    """Distance of lines: the height of a capital and 0.45 of the size, cut to whole pixels."""
    return size * (CAPITAL / 1000) + int(size * 0.45)


def _fitted(words: list[str], box_w: float, box_h: float, start: int, wide: Callable[[str], int], length: Callable[[str], int], widest: int) -> tuple[int, list[str]]:
    if not words or start <= 8:
        return start, []
    if len(words) == 1:
        for size in range(start, 8, -2):
            stroke = max(2, int(size * 0.08))
            if length(words[0]) * size / 1000 + 2 * stroke <= box_w * 1.5 and gap_of(size) + 2 * stroke <= box_h * 1.2:
                return size, words
        return size - 2, []
    blank, hyphen = wide(" "), wide("-")
    lengths = [length(w) for w in words]
    upto, total, room = [0, *accumulate(n + blank for n in lengths)], sum(lengths), min(box_w * (USABLE * 1000), 1e15)
    for size in range(start, 8, -1):
        most = box_h * USABLE / gap_of(size)
        if size > 9 and isfinite(most) and (widest + hyphen) * size <= room and total * size > room * floor(most):
            continue  # a line is no longer than the room, and the words alone need more lines
        # whole numbers are within the room where they are within its whole part; a room that is not known holds one word a line
        lines = words if isnan(box_w) else wrapped(words, lengths, upto, floor(room) // size, wide, blank, hyphen, most + 1 if size > 9 else inf)
        if lines is not None and len(lines) * gap_of(size) <= box_h * USABLE:
            return size, lines
    return 8, lines or []


def fit_text(text: Column, box_w: Column, box_h: Column, start: Column, widths: list[int]) -> Column:
    """(size, lines): the first size from ``start`` down, above 8, at which the lines fit the box.

    More than one word: sizes fall by one and, if none fits, the last one's lines stay. One word: sizes fall by two, it may
    exceed the box somewhat, and there is no line if none fits. Without words there is no line. Sizes at which the words'
    plain length already needs too many lines are passed over unwrapped. Wrapping at one size is as many
    searches in the words' running lengths as there are lines; a fold of Catalyst would step through all characters."""

    @F.pandas_udf("size int, lines array<string>")
    def fitted(words: pd.Series, w: pd.Series, h: pd.Series, start: pd.Series) -> pd.DataFrame:
        known: dict[str, int] = {}
        widest = max([USUAL, *widths])
        wide = lambda c: widths[ord(c)] if ord(c) < len(widths) else USUAL

        def length(word: str) -> int:
            n = known.get(word)
            if n is None:
                n = known[word] = sum(map(wide, word))
            return n

        found = [(None, []) if pd.isna(s) else _fitted(list(ws), x, y, int(s), wide, length, widest) for ws, x, y, s in zip(words, w.to_numpy(dtype=float), h.to_numpy(dtype=float), start)]
        return pd.DataFrame({"size": pd.array([s for s, _ in found], "Int32"), "lines": [x for _, x in found]})

    return fitted(X.words(F.coalesce(text, F.lit(""))), box_w, box_h, start)
