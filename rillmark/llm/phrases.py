"""Phrase collocations by best-first branch and bound over counted prefixes.

A candidate is a phrase of 2 to ``LONGEST`` words that occurs ``LEAST`` times or more in its language. Cut after its first k words it
scores floor(1000 a n / (l r)), of its own count a, the counts l and r of its parts and the language's words n; the lowest-scoring cut
counts. A candidate inside a longer one of the same count is dropped. The first ``TOP`` of a language are returned.

Growth starts from single words. As a phrase is never more frequent than what is left of it when its first word is cut off, nothing
that begins with the word w scores above floor(1000 n / f(w)): the prefix's count bounds its whole subtree. All two-word phrases are
counted first; the score of their ``TOP``-th survivor is a floor that can only rise. Of the frontier, the words whose bound reaches
the floor are then grown, a word a level, and only through prefixes and pairs that are frequent; words below it can't change
the result or its ties, and never are. A language with fewer survivors than ``TOP`` is grown whole.

Texts are read twice: to count words, and to write them as 64-bit codes of frequent words, which all further passes read. A pass holds
filters of a fixed size (``BITS`` bits a level, whatever the corpus). Filters only leave out what can't be frequent; the counts that
decide are summed over the phrases' codes, which stand for one word each. Each task adds up what it has seen before anything
is shuffled, so a phrase on a third of all documents is a row a task. Whether a phrase lies in a longer one of its count is read from its
neighbours: all of its occurrences have the same word before them, or after them.

Defined cases: a null language is ``und``, a null or empty text has no words; texts of any length are read whole; repeated rows count as often
as they are there; ties are ordered by phrase, in order of UTF-8 bytes; an empty table gives an empty result. Columns other than the
language and the text, whatever their names, are never read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillmark.llm.batches import small_batches
from rillmark.llm.text import UPPER, whole
from rillmark.scratch import Scratch, materialize

LONGEST = 5
LEAST = 100
TOP = 2000
#: Bits of each filter.
BITS = 1 << 23
#: Codes that a task gathers before it adds them up, codes in a row of the encoded texts, and most words that it remembers.
CHUNK, ROW, REMEMBERED = 1_000_000, 5_000, 200_000
#: Rows that are handed to Python at once: texts, or as many rows of codes, some 10 MB.
BATCH = 250

TOKEN = re.compile(r"[.,;:!?\x0A-\x0D]|[^\x20\x09.,;:!?\x0A-\x0D]+")
BREAKS = frozenset(".,;:!?\n\x0b\x0c\r")
LOWER = str.maketrans(UPPER, UPPER.lower())
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
COUNTED = "codes array<long>, n long, lmin long, lmax long, rmin long, rmax long"


def code(lang: str, word: str) -> int:
    """The 64-bit hash of a lower-cased word of a language; never 0, which stands for no word."""
    return xxhash.xxh64_intdigest(f"{lang}\0{word}".encode("utf-8", "surrogatepass"), 42) or 1


def grown(h: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hashes of phrases from those without their last word, and its code."""
    x = (h ^ (h >> np.uint64(29))) * M1 + last * M2
    return x ^ (x >> np.uint64(32))


def phrase_hash(lang: str, words: list[str]) -> int:
    h = np.array([code(lang, words[0])], dtype=np.uint64)
    for w in words[1:]:
        h = grown(h, np.array([code(lang, w)], dtype=np.uint64))
    return int(h[0])


def _has(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    return bits[(h & np.uint64(BITS - 1)).astype(np.int64)]


def _unpacked(packed: Broadcast) -> np.ndarray:
    return np.unpackbits(np.frombuffer(packed.value, dtype=np.uint8)).astype(bool)


class _Codes(dict):
    """Codes of raw tokens: 0 for a break and for a word that the filter leaves out."""

    def __init__(self, lang: str, keep: np.ndarray):
        super().__init__()
        self.lang, self.keep = lang, keep

    def __missing__(self, token: str) -> int:
        c = 0 if token in BREAKS else code(self.lang, token.translate(LOWER))
        if c and not self.keep[c & (BITS - 1)]:
            c = 0
        if len(self) < REMEMBERED:
            self[token] = c
        return c


def _count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: dict[str, Counter[str]] = {}

    def out() -> pd.DataFrame:
        rows = pd.DataFrame([(g, w.translate(LOWER), n) for g, c in held.items() for w, n in c.items() if w not in BREAKS], columns=["lang", "word", "n"])
        held.clear()
        return rows

    for b in batches:
        for lang, text in zip(b["lang"], b["text"], strict=True):
            if lang not in held:
                held[lang] = Counter()
            held[lang].update(TOKEN.findall(text))
        if sum(map(len, held.values())) > REMEMBERED:
            rows = out()
            if len(rows):
                yield rows
    rows = out()
    if len(rows):
        yield rows


def _encode(batches: Iterator[pd.DataFrame], frequent: Broadcast) -> Iterator[pd.DataFrame]:
    """Texts as codes, some ``ROW`` a row, rows and documents ending in 0; breaks and rare words in a row are one 0."""
    keep, known, held, size = _unpacked(frequent), {}, [], 0
    for b in batches:
        for lang, text in zip(b["lang"], b["text"], strict=True):
            if lang not in known:
                if len(known) > 64:
                    known.clear()
                known[lang] = _Codes(lang, keep)
            tokens = TOKEN.findall(text)
            c = np.fromiter(map(known[lang].__getitem__, tokens), dtype=np.uint64, count=len(tokens))
            c = np.r_[c, np.uint64(0)]
            c = c[(c != 0) | np.r_[True, c[:-1] != 0]]
            held.append(c)
            size += len(c)
            if size >= ROW:
                yield pd.DataFrame({"codes": [np.concatenate(held).view(np.int64)]})
                held, size = [], 0
    if held:
        yield pd.DataFrame({"codes": [np.concatenate(held).view(np.int64)]})


def _chunks(batches: Iterator[pd.DataFrame]) -> Iterator[np.ndarray]:
    """Codes of some ``CHUNK`` tokens, beginning and ending in 0."""
    held, size = [np.zeros(1, dtype=np.int64)], 0
    for b in batches:
        for c in b["codes"]:
            held.append(np.asarray(c, dtype=np.int64))
            size += len(held[-1])
            if size >= CHUNK:
                yield np.concatenate(held).view(np.uint64)
                held, size = [np.zeros(1, dtype=np.int64)], 0
    if size:
        yield np.concatenate(held).view(np.uint64)


def _places(c: np.ndarray, filters: list[np.ndarray], start: np.ndarray | None, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For 2 words and more, up to one more than there are filters: the places where a phrase may begin, and all places' hashes. All shorter
    phrases that begin there are in their filters, as are all pairs; three words and more begin in ``start``."""
    if len(c) < 2:
        return
    h = grown(c[:-1], c[1:])
    good = (c[:-1] != 0) & (c[1:] != 0)
    pairs = good & _has(filters[0], h) if filters else good
    for m in range(2, longest + 1):
        if m > 2:
            if len(c) < m:
                return
            good = (good & _has(filters[m - 3], h))[: len(c) - m + 1] & pairs[m - 2 :]
            if m == 3 and start is not None:
                good &= _has(start, c[: len(good)])
            h = grown(h[: len(c) - m + 1], c[m - 1 :])
        yield m, np.flatnonzero(good), h


def _count_level(batches: Iterator[pd.DataFrame], filters: list[Broadcast], start: Broadcast | None) -> Iterator[pd.DataFrame]:
    """``h, n``: hashes of the phrases that are one word longer than those of the last filter."""
    bits, first = [_unpacked(f) for f in filters], None if start is None else _unpacked(start)
    for c in _chunks(batches):
        for m, at, h in _places(c, bits, first, len(bits) + 2):
            if m == len(bits) + 2 and len(at):
                found, n = np.unique(h[at], return_counts=True)
                yield pd.DataFrame({"h": found.view(np.int64), "n": n})


def _count_phrases(batches: Iterator[pd.DataFrame], filters: list[Broadcast], start: Broadcast | None, lengths: tuple[int, ...], wanted: Broadcast | None = None) -> Iterator[pd.DataFrame]:
    """The phrases of the given lengths that are in their filters, or in ``wanted``, as codes: their counts, and the least and greatest code before
    and after them."""
    bits = [_unpacked(f) for f in filters]
    first, asked = (None if f is None else _unpacked(f) for f in (start, wanted))
    for c in _chunks(batches):
        around = np.r_[np.uint64(0), c, np.uint64(0)].view(np.int64)
        for m, at, h in _places(c, bits, first, max(lengths)):
            at = at[_has(bits[m - 2] if asked is None else asked, h[at])] if m in lengths else at[:0]
            if not len(at):
                continue
            order = np.argsort(h[at], kind="stable")
            at, key = at[order], h[at][order]
            group = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            left, right = around[at], around[at + m + 1]
            yield pd.DataFrame({
                "codes": list(np.lib.stride_tricks.sliding_window_view(c.view(np.int64), m)[at[group]]), "n": np.diff(np.r_[group, len(key)]),
                "lmin": np.minimum.reduceat(left, group), "lmax": np.maximum.reduceat(left, group), "rmin": np.minimum.reduceat(right, group), "rmax": np.maximum.reduceat(right, group),
            })


def _named(rows: DataFrame, single: DataFrame, least: int) -> DataFrame:
    """``lang, phrase, words, n`` and the neighbours of the phrases with ``least`` occurrences: their codes are words again."""
    ends = [F.min("lmin").alias("lmin"), F.max("lmax").alias("lmax"), F.min("rmin").alias("rmin"), F.max("rmax").alias("rmax")]
    found = rows.groupBy("codes").agg(F.sum("n").alias("n"), *ends).where(F.col("n") >= least)
    spelt = found.select("*", F.posexplode("codes").alias("at", "code")).join(single.select("code", "lang", F.col("phrase").alias("word")), "code")
    joined = spelt.groupBy("codes", "n", "lmin", "lmax", "rmin", "rmax", "lang").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("w"))
    whole_ = joined.where(F.size("w") == F.size("codes"))  # a rare word that a filter has let in is no one's code
    return whole_.select("lang", F.array_join(F.transform("w", lambda x: x["word"]), " ").alias("phrase"), F.size("codes").alias("words"), "n", "lmin", "lmax", "rmin", "rmax")


def _filter(spark: SparkSession, hashes: DataFrame) -> Broadcast:
    """The filter of the hashes ``h``: its bits come to the driver in blocks, at most ``BITS`` of them at any size of the corpus."""
    place = F.col("h").bitwiseAND(F.lit(BITS - 1))
    blocks = hashes.select(F.shiftright(place, 15).cast("int").alias("block"), place.bitwiseAND(F.lit(32767)).cast("int").alias("bit")).groupBy("block").agg(F.collect_set("bit").alias("bits"))
    bits = np.zeros(BITS, dtype=bool)
    for r in blocks.toLocalIterator():
        bits[r["block"] * 32768 + np.array(r["bits"], dtype=np.int64)] = True
    return spark.sparkContext.broadcast(np.packbits(bits).tobytes())


def _hashed(phrases: DataFrame) -> DataFrame:
    """``h`` of the rows ``lang, phrase``."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            h = [phrase_hash(g, p.split(" ")) for g, p in zip(b["lang"], b["phrase"], strict=True)]
            yield pd.DataFrame({"h": np.array(h, dtype=np.uint64).view(np.int64)})

    return phrases.select("lang", "phrase").mapInPandas(each, "h long")


def _coded(words: DataFrame) -> DataFrame:
    """``lang, phrase, n`` of single words with their ``code``."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield b.assign(code=np.array([code(g, w) for g, w in zip(b["lang"], b["phrase"], strict=True)], dtype=np.uint64).view(np.int64))

    return words.mapInPandas(each, "lang string, phrase string, n long, code long")


def _score(a: str, n: str, left: str, right: str) -> Column:
    """The exact floor of 1000 a n / (l r)."""
    wide = lambda c: f"CAST({c} AS DECIMAL(38, 0))"
    return F.expr(f"(CAST(1000 AS DECIMAL(38, 0)) * {wide(a)} * {wide(n)}) div ({wide(left)} * {wide(right)})")


def _scored(found: DataFrame, counts: DataFrame, totals: DataFrame) -> DataFrame:
    """``lang, phrase, words, a, l, r, n, score`` of candidates: their lowest-scoring cut. ``counts`` has the parts."""
    w = F.split("phrase", " ")
    cut = found.select("lang", "phrase", "words", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    parts = cut.select("*", F.array_join(F.slice(w, 1, F.col("k")), " ").alias("first"), F.array_join(F.slice(w, F.col("k") + 1, F.col("words") - F.col("k")), " ").alias("rest"))
    one = lambda part, out: counts.select("lang", F.col("phrase").alias(part), F.col("n").alias(out))
    both = parts.join(one("first", "l"), ["lang", "first"]).join(one("rest", "r"), ["lang", "rest"]).join(F.broadcast(totals), "lang")  # one row a language
    best = both.withColumn("score", _score("a", "n", "l", "r")).groupBy("lang", "phrase", "words", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("x"))
    return best.select("lang", "phrase", "words", "a", "x.l", "x.r", "n", "x.score")


def _survives(longest: int) -> Column:
    """Whether no longer candidate holds the phrase as often as it occurs."""
    same = lambda side: (F.col(f"{side}min") == F.col(f"{side}max")) & (F.col(f"{side}min") != 0)
    return (F.col("words") >= longest) | ~(same("l") | same("r"))


def _ranked(scored: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")  # each task hands on its first ``top`` only
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", longest: int = LONGEST, least: int = LEAST, top: int = TOP) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's first ``top`` phrases."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(docs[lang].cast("string"), F.lit("und")).alias("lang"), whole(docs[text]).alias("text"))
    with small_batches(spark, BATCH), Scratch(spark, "phrases") as space:
        words = texts.mapInPandas(_count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
        words = space.keep(words, "words")
        totals = space.keep(words.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
        single = space.keep(_coded(words.where(F.col("n") >= least).select("lang", F.col("word").alias("phrase"), "n")), "single")
        if single.groupBy("code").count().where("count > 1").head():
            raise RuntimeError("two frequent words have one code")  # odds below one in a billion for a million words
        texts = space.keep(texts.mapInPandas(partial(_encode, frequent=_filter(spark, single.select(F.col("code").alias("h")))), "codes array<long>"), "codes")
        filters: list[Broadcast] = []

        def level(start: Broadcast | None) -> Broadcast:
            counted = texts.mapInPandas(partial(_count_level, filters=filters, start=start), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
            return _filter(spark, counted.where(F.col("n") >= least))

        def exact(start: Broadcast | None, lengths: tuple[int, ...], wanted: Broadcast | None = None) -> DataFrame:
            return _named(texts.mapInPandas(partial(_count_phrases, filters=filters, start=start, lengths=lengths, wanted=wanted), COUNTED), single, least)

        filters.append(level(None))
        two = space.keep(exact(None, (2,)), "two")
        counts = single.select("lang", "phrase", "n").unionByName(two.select("lang", "phrase", "n"))
        scored = space.keep(_scored(two.where(_survives(longest)), counts, totals), "scored-two")
        if longest > 2:
            # the frontier: first words whose bound reaches the score of their language's last place so far
            floor = _ranked(scored, top).where(F.col("rank") == top).select("lang", F.col("score").alias("floor"))
            rooted = single.join(F.broadcast(totals.withColumnRenamed("n", "total").join(floor, "lang", "left")), "lang")  # a row a language
            bound = F.expr("(CAST(1000 AS DECIMAL(38, 0)) * CAST(total AS DECIMAL(38, 0))) div CAST(n AS DECIMAL(38, 0))")
            start = _filter(spark, rooted.where(F.coalesce(bound >= F.col("floor"), F.lit(True))).select(F.col("code").alias("h")))
            for _ in range(3, longest + 1):
                filters.append(level(start))
            more = space.keep(exact(start, tuple(range(3, longest + 1))), "more")
            counts = counts.unionByName(more.select("lang", "phrase", "n"))
            # rests of these phrases may begin with a word that isn't grown: those are counted for themselves
            w, kept = F.split("phrase", " "), more.where(_survives(longest))
            rests = kept.where("words > 3").select("lang", F.explode(F.transform(F.sequence(F.lit(2), F.col("words") - 2), lambda i: F.array_join(F.slice(w, i, F.col("words") - i + 1), " "))).alias("phrase")).distinct()
            missing = space.keep(rests.join(counts, ["lang", "phrase"], "left_anti"), "missing")
            if longest > 3 and not missing.isEmpty():
                wanted = _filter(spark, _hashed(missing))
                filters[1:] = [_filter(spark, _hashed(missing.select("lang", F.array_join(F.slice(w, 1, m), " ").alias("phrase")).distinct())) for m in range(3, longest)]  # the ways to them
                filled = space.keep(exact(None, tuple(range(3, longest)), wanted).join(missing, ["lang", "phrase"], "left_semi"), "filled")
                counts = counts.unionByName(filled.select("lang", "phrase", "n"))
            scored = scored.unionByName(_scored(kept, counts, totals))
        return materialize(_ranked(scored, top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"), "collocations")
