"""Periodic runs in texts by multi-scale minimizers.

A run is a stretch of words that repeats with a smallest period q, at least ``TIMES`` times and over at least ``SHORTEST`` words,
and that no neighbouring word extends. Periods up to ``DIRECT`` are found by direct scans: words equal to those q places on. Longer
ones go by scales, each for periods above 3/4 G up to G. G-word windows hash alike exactly where they hold the same
words, and inside a run of such a period G words cover a period: equal windows of the run lie whole periods apart. So of
the windows at the places where a hash is the least of some G / 2 + 1 neighbours, the minimizers, each has its next equal one a
period on. Pairs of neighbouring equal minimizers at such a distance are the seeds; each is extended both ways by
comparing words, which also settles whether it is a run at all, and a stretch once found takes its other seeds with it.

Hashes have 64 bits; windows that collide could hide a seed, for a text of a million words with odds under one in ten million.
A text's work grows in proportion to its words times the number of scales, and its memory to its words; it needs no
shuffle, so copies and hot sources don't meet anywhere.

Defined cases: a null or empty text has no words and no runs; texts of any length are read whole; repeated rows are judged one by one; a
null id is kept; an empty table gives an empty result. Columns other than the key and the text, whatever their names, are passed by.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from fractions import Fraction
from functools import partial
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

SHORTEST, TIMES = 24, 3
#: Longest period that is scanned for directly.
DIRECT = 24

WORD = re.compile(r"[^\x20\x09-\x0D]+")
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
PLACE = np.uint64((1 << 28) - 1)

Planner = Callable[[int | None, int], np.ndarray | None]


class Run(NamedTuple):
    start: int
    length: int
    period: int


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * MIX[0]
    return h ^ (h >> np.uint64(29))


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _mixed(_mixed(a) * MIX[1] + b)


def _window_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours, by doubling."""
    done = 1
    while 2 * done <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return x if done == width else np.minimum(x[: len(x) - (width - done)], x[width - done :])


def _alike(x: np.ndarray, y: np.ndarray) -> int:
    """How many leading elements agree, looking no farther than some twice that many."""
    n, step, most = 0, 64, min(len(x), len(y))
    while n < most:
        other = np.flatnonzero(x[n : min(n + step, most)] != y[n : min(n + step, most)])
        if len(other):
            return n + int(other[0])
        n, step = min(n + step, most), 2 * step
    return most


def _is_smallest(x: np.ndarray, start: int, length: int, period: int) -> bool:
    """No divisor of the period is one: at three repeats or more, a smaller period would divide it."""
    rest, p = period, 2
    while rest > 1:
        if rest % p:
            p = p + 1 if p * p <= rest else rest
            continue
        while rest % p == 0:
            rest //= p
        q = period // p
        if np.array_equal(x[start : start + length - q], x[start + q : start + length]):
            return False
    return True


def _long_enough(length: int, period: int) -> bool:
    return length >= SHORTEST and length >= TIMES * period


def _short(x: np.ndarray) -> Iterator[Run]:
    for q in range(1, min(DIRECT, len(x) // TIMES) + 1):
        same = x[q:] == x[:-q]
        need = max(SHORTEST, TIMES * q) - q
        if np.count_nonzero(same) < need:
            continue
        ends = np.flatnonzero(np.diff(np.r_[False, same, False].astype(np.int8)))
        for a, b in zip(ends[::2].tolist(), ends[1::2].tolist(), strict=True):
            if b - a >= need and _is_smallest(x, a, b - a + q, q):
                yield Run(a, b - a + q, q)


def _long(x: np.ndarray) -> Iterator[Run]:
    most = len(x) // TIMES
    ladder = {1: _mixed(x.astype(np.uint64) + np.uint64(1))}  # hashes of windows of 1, 2, 4, ... words
    least, g = DIRECT, (4 * DIRECT + 3) // 3
    while least < most:
        size = 1 << (g.bit_length() - 1)
        for s in (1 << i for i in range(1, g.bit_length())):
            if s not in ladder:
                half = ladder[s // 2]
                ladder[s] = _joined(half[: len(half) - s // 2], half[s // 2 :]) if len(half) > s // 2 else half[:0]
        base = ladder[size]
        h = base if size == g else _joined(base[: len(base) - (g - size)], base[g - size :])
        width = g // 2 + 1
        if len(h) >= width:
            key = (h & ~PLACE) | np.arange(len(h), dtype=np.uint64)  # equal hashes: the leftmost
            at = (_window_least(key, width) & PLACE).astype(np.int64)
            at = at[np.r_[True, at[1:] != at[:-1]]]
            order = at[np.argsort(h[at], kind="stable")]
            a, b = order[:-1], order[1:]
            seed = (h[a] == h[b]) & (b - a > least) & (b - a <= g)
            reached: dict[int, int] = {}
            for i, q in sorted(zip(a[seed].tolist(), (b - a)[seed].tolist(), strict=True)):
                if i < reached.get(q, 0):
                    continue
                ahead = _alike(x[i:], x[i + q :])
                back = _alike(x[:i][::-1], x[q : i + q][::-1])
                reached[q] = i + ahead
                length = back + ahead + q
                if _long_enough(length, q) and _is_smallest(x, i - back, length, q):
                    yield Run(i - back, length, q)
        least, g = g, (4 * g + 3) // 3


def _regions(x: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches that hold every run whole, with the words beside it. All words of a run after its first period have been there
    before: runs lie on stretches of such words, and begin before them by at most half of their length. ``x`` numbers words as
    they first occur."""
    seen = np.r_[False, x[1:] <= np.maximum.accumulate(x)[:-1]]
    ends = np.flatnonzero(np.diff(np.r_[False, seen, False].astype(np.int8)))
    a, b = ends[::2], ends[1::2]
    wide = b - a >= SHORTEST - SHORTEST // TIMES
    now = None
    for s, e in sorted(zip((a - (b - a) // 2 - 1)[wide].tolist(), (b + 1)[wide].tolist(), strict=True)):
        if now is not None and s <= now[1]:
            now = (now[0], max(now[1], e))
            continue
        if now is not None:
            yield max(0, now[0]), min(len(x), now[1])
        now = (s, e)
    if now is not None:
        yield max(0, now[0]), min(len(x), now[1])


def runs(words: list[str]) -> list[Run]:
    """All runs, by start and then by period."""
    if len(words) < SHORTEST:
        return []
    if len(words) > int(PLACE):
        raise ValueError(f"a text of {len(words)} words; {int(PLACE)} can be numbered")
    x = pd.factorize(np.array(words, dtype=object))[0]
    return sorted(Run(a + r.start, r.length, r.period) for a, b in _regions(x) for r in {*_short(x[a:b]), *_long(x[a:b])})


def collapsed(words: list[str], found: list[Run]) -> list[str]:
    """The words without what repeats a run's first period."""
    kept = np.ones(len(words), dtype=bool)
    for r in found:
        kept[r.start + r.period : r.start + r.length] = False
    return [words[i] for i in np.flatnonzero(kept).tolist()]


def longest(found: list[Run]) -> Run | None:
    """The run with the most repeats."""
    return max(found, key=lambda r: (Fraction(r.length, r.period), -r.start, -r.period), default=None)


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


OUT = "doc_id {key}, n_words long, n_runs long, runs array<struct<start:long,length:long,period:long>>, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, collapsed string"


def _detect(batches: Iterator[pd.DataFrame], plan: Planner | None, with_text: bool) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for key, text in zip(b["doc_id"].tolist(), b["text"], strict=True):
            words = WORD.findall(text or "")
            order = plan(None if pd.isna(key) else int(key), len(words)) if plan else None
            if order is not None:
                words = [words[i] for i in order.tolist()]
            found = runs(words)
            best, left = longest(found), " ".join(collapsed(words, found))
            cells = (best.start, best.length, best.period, 1000 * best.length // best.period) if best else (None,) * 4
            listed = "".join(f"{r.start},{r.length},{r.period}\n" for r in found)
            rows.append((len(words), len(found), [dict(r._asdict()) for r in found], *cells, _sha256(listed), _sha256(left), left if with_text else None))
        names = ["n_words", "n_runs", "runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "collapsed"]
        out = pd.DataFrame(rows, columns=names, index=b.index)
        out.insert(0, "doc_id", b["doc_id"])
        yield out.astype({c: "Int64" for c in ("start", "length", "period", "exponent_milli")})


def detect(docs: DataFrame, key: str = "doc_id", text: str = "text", plan: Planner | None = None, with_text: bool = True) -> DataFrame:
    """``doc_id, n_words, n_runs, runs``, the run with the most repeats, digests, and the text without repeats (``collapsed``).

    ``plan(id, n)`` may name the words to read instead of the text's own, as places in it: so tests plant runs."""
    rows = docs.select(docs[key].alias("doc_id"), docs[text].cast("string").alias("text"))
    return rows.mapInPandas(partial(_detect, plan=plan, with_text=with_text), OUT.format(key=dict(rows.dtypes)["doc_id"]))
