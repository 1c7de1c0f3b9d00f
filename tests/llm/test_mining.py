"""Nearest neighbours, periodic runs and phrases: whole tables and hard cases against brute force."""

from __future__ import annotations

import random
import re
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from rillmark.llm import curve_search, periodic, phrases
from rillmark.llm import queries as Q
from tests.llm import brute

R = random.Random(11)


def table(folder, name, columns):
    return duckdb.connect().sql(f"SELECT {columns} FROM '/root/testdata/{folder}/{name}.parquet'").fetchall()


# --- nearest neighbours


def nearest_lists(rows, asks, k):
    """``query_id -> [(score, vec_id)]`` by all pairs of distinct usable rows."""
    rows = sorted({(i, tuple(map(float, v))) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)})
    dims = Counter(len(v) for _, v in rows)
    dim = max(dims, key=lambda d: (dims[d], d), default=0)
    rows = [(i, v) for i, v in rows if len(v) == dim]
    x = np.array([v for _, v in rows])
    out = {}
    for i, v in rows:
        if asks(i):
            ranked = sorted((-float(s), j) for s, (j, _) in zip((x * np.array(v)).sum(1), rows, strict=True) if j != i)
            out[i] = [(-s, j) for s, j in ranked[:k]]
    return out


def got_lists(df):
    found: dict = {}
    for r in df.orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
        assert r["rank"] == len(found[r["query_id"]])
    return found


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_op11_small_tables_are_exact(spark, folder):
    got = got_lists(Q.op11_nearest_neighbours(spark, f"/root/testdata/{folder}"))
    expected = nearest_lists(table(folder, "embeddings", "vec_id, embedding"), lambda i: i % 20 == 0, 20)
    assert got.keys() == expected.keys()
    for q, pairs in expected.items():
        assert [j for _, j in got[q]] == [j for _, j in pairs]
        assert [s for s, _ in got[q]] == pytest.approx([s for s, _ in pairs], abs=1e-12)


@pytest.mark.parametrize("clusters", [0, 40])
def test_windows_reach_the_recall(spark, clusters):
    """With many small cells: on vectors without structure, and on clustered ones, where windows are narrow."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(clusters or 1, 16)) * (6 if clusters else 0)
    rows = [(i, (centres[i % len(centres)] + rng.normal(size=16)).tolist()) for i in range(4000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = got_lists(curve_search.nearest(df, F.col("id") % 20 == 0, cell_rows=40))
    expected = nearest_lists(rows, lambda i: i % 20 == 0, 20)
    hit = sum(len({j for _, j in got[q]} & {j for _, j in p}) for q, p in expected.items())
    assert hit / (20 * len(expected)) >= 0.92
    numbers = curve_search.numbered(df.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), curve_search.fit_curves(df.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), 16), False).collect()
    if clusters:
        curve = sorted((r["numbers"][0], r["id"] % clusters) for r in numbers)
        changes = sum(a[1] != b[1] for a, b in zip(curve, curve[1:], strict=False))
        assert changes < 2000  # neighbours along the curve are mostly of one cluster; by chance 3,900 changes


def test_neighbour_cases(spark):
    same = [1.0, 2.0, 0.0]
    rows = [(i, same, "a") for i in range(0, 400)] + [(1000 + i, [float(i % 5), 1.0, -1.0 * (i % 3)], "b") for i in range(300)]
    rows += [(20, same, "again")] * 5 + [(40, None, "x"), (2000, [0.0, 0.0, 0.0], "x"), (2020, [], "x"), (2040, [1.0, None, 2.0], "x"), (2060, [1.0, float("nan"), 0.0], "x")]
    rows += [(2080, [1.0, float("inf"), 0.0], "x"), (None, same, "x"), (2100, [1.0, 2.0], "x"), (2120, [9.0, 9.0, 9.0], "x"), (-20, [-1.0, 0.5, 0.0], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, id string").select("*", *[F.lit("c").alias(c) for c in ("vec", "cell", "same", "user_id", "query_id", "rank", "score")])
    got = got_lists(curve_search.nearest(df, F.col("id") % 20 == 0, k=20, cell_rows=50))
    expected = nearest_lists([r[:2] for r in rows], lambda i: i % 20 == 0, 20)
    assert got.keys() == expected.keys()
    full = sum(got[q] == p for q, p in expected.items())
    assert full >= 0.9 * len(expected)
    assert got[20] == expected[20] and got[2120] == expected[2120]
    few = curve_search.nearest(spark.createDataFrame([(0, [1.0, 0.0]), (7, [0.5, 1.0])], "vec_id long, embedding array<double>"), F.col("id") % 20 == 0)
    assert [tuple(r) for r in few.collect()] == [(0, 1, 7, 0.5)]
    assert curve_search.nearest(df.limit(0), F.col("id") % 20 == 0).count() == 0


def test_hilbert_neighbours_touch():
    """Points with neighbouring numbers lie one step apart, and every point has a number of its own."""
    for dims, bits in ((2, 4), (3, 3)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims), -1).reshape(-1, dims)
        n = curve_search.hilbert(grid, bits)
        assert sorted(n) == list(range(len(grid)))
        path = grid[np.argsort(n)]
        assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


# --- periodic runs


def all_runs(w):
    """Every lag scanned."""
    out = []
    for q in range(1, len(w) // 3 + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            n = j - i + q
            if j > i and n >= max(24, 3 * q) and all(w[i : i + n - d] != w[i + d : i + n] for d in range(1, q)):
                out.append((i, n, q))
            i = j + 1
    return sorted(out)


def expected_runs(doc_id, text):
    w = brute.WORD.findall(text or "")
    order = Q.planted_runs(doc_id, len(w))
    w = w if order is None else [w[i] for i in order]
    found = all_runs(w)
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    cells = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (len(found), *cells, brute.sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), brute.sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_op12_brute_force(spark):
    got = {r["doc_id"]: tuple(r)[1:] for r in Q.op12_periodic_runs(spark, "/root/testdata/sf0.001").collect()}
    docs = [d for d in table("sf0.001", "documents", "doc_id, text")]
    assert len(got) == len(docs)
    for d, t in docs:
        if len(t or "") < 30_000:
            assert got[d] == expected_runs(d, t), d
    assert sum(r[0] > 0 for r in got.values()) > 5


def test_planted_runs_are_as_stated():
    import zlib

    for d in range(200):
        h, n = zlib.crc32(str(d).encode()), 50 + d
        order = Q.planted_runs(d, n)
        assert (order is None) == (h % 10 != 0)
        if order is not None:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            assert order.tolist() == [i if i < a else a + (i - a) % p for i in range(n)]


def test_runs_of_many_shapes():
    for _ in range(300):
        w: list[str] = []
        while len(w) < R.choice([30, 200, 700]):
            letters = R.choice(["ab", "abc", "abcdefghijklmnopqrstuvwxyz"])
            if R.random() < 0.5:
                p = [R.choice(letters) for _ in range(R.choice([1, 2, 3, 7, 23, 24, 25, 31, 33, 48, 65, 97]))]
                w += p * R.choice([2, 3, 3, 4, 6]) + p[: R.randrange(len(p) + 1)]
            else:
                w += [R.choice(letters) for _ in range(R.randrange(40))]
        assert [tuple(r) for r in periodic.runs(w)] == all_runs(w)


def test_run_cases(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "a " * 24), (4, "a " * 24), (None, "x y " * 30), (5, "a " * 23), (6, " ".join(map(str, range(900)))), (7, "w " * 200_000)]
    df = spark.createDataFrame([(*r, "c", "c") for r in rows], "doc_id long, text string, start string, runs string")
    got = sorted((tuple(r) for r in periodic.detect(df).select("doc_id", "n_words", "n_runs", "start", "length", "period", "exponent_milli", "collapsed").collect()), key=str)
    blank = (0, None, None, None, None)
    expected = [(1, 0, *blank, ""), (2, 0, *blank, ""), (3, 0, *blank, ""), (4, 24, 1, 0, 24, 1, 24000, "a"), (4, 24, 1, 0, 24, 1, 24000, "a"), (None, 60, 1, 0, 60, 2, 30000, "x y")]
    expected += [(5, 23, *blank, ("a " * 23).strip()), (6, 900, *blank, rows[7][1]), (7, 200_000, 1, 0, 200_000, 1, 200_000_000, "w")]
    assert got == sorted(expected, key=str)
    assert periodic.detect(df.limit(0)).count() == 0


# --- phrases


def all_phrases(docs, longest=5, least=100, top=2000):
    """``lang -> [(phrase, a, l, r, n, score)]`` by counting every phrase."""
    n, f, inside = Counter(), Counter(), {}
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(brute.LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, longest + 1):
                f.update((lang, *w[i : i + m]) for i in range(len(w) - m + 1))
    for key, c in f.items():
        for part in (key[:-1], (key[0], *key[2:])):
            if len(key) > 3 and f[part] == c:
                inside[part] = True
    out: dict = {}
    for key, a in f.items():
        lang, w = key[0], key[1:]
        if len(w) < 2 or a < least or key in inside:
            continue
        cuts = [(1000 * a * n[lang] // (f[(lang, *w[:k])] * f[(lang, *w[k:])]), k) for k in range(1, len(w))]
        s, k = min(cuts)
        out.setdefault(lang, []).append((" ".join(w), a, f[(lang, *w[:k])], f[(lang, *w[k:])], n[lang], s))
    return {g: sorted(x, key=lambda p: (-p[5], -p[1], p[0].encode()))[:top] for g, x in out.items()}


def got_phrases(df):
    out: dict = {}
    for r in df.orderBy("lang", "rank").collect():
        out.setdefault(r["lang"], []).append((r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]))
        assert r["rank"] == len(out[r["lang"]])
    return out


@pytest.mark.parametrize("top", [3, 12, 5000])
def test_phrases_against_brute_force(spark, monkeypatch, top):
    """Few places, so that most of the frontier is never grown, and small chunks and rows."""
    monkeypatch.setattr(phrases, "ROW", 50)
    words = ["A", "b", "cé", "É", "d", "e", "f,", "g", "h.", "New", "York", "City", "of"]
    docs = [(R.choice(["en", "fr", None, "en"]), " ".join(R.choice(words) if R.random() < 0.6 else "new york city hall, of a" for _ in range(R.randrange(60)))) for _ in range(400)]
    docs += [("en", None), (None, ""), ("fr", " . ,, \n"), ("en", "the the the the the the the " * 30)] + [("fr", "same words again and again")] * 40 + [("empty", "")]
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "lang string, text string, phrase string, n int").repartition(5)
    got = got_phrases(phrases.collocations(df, least=20, top=top))
    assert got == all_phrases(docs, least=20, top=top)


def test_phrase_ties_at_the_last_place(spark):
    docs = [("en", f"p{i} q{i}. r{i} s{i} t{i}") for i in range(30) for _ in range(25)] + [("en", "p1 x")] * 3
    df = spark.createDataFrame(docs, "lang string, text string")
    for top in (1, 29, 31, 59):
        assert got_phrases(phrases.collocations(df, least=20, top=top)) == all_phrases(docs, least=20, top=top)
    assert phrases.collocations(df.limit(0)).count() == 0


def test_scores_are_exact(spark):
    big = spark.createDataFrame([(10**13 + 7, 10**15 + 3, 10**13 + 9, 3 * 10**13 + 1)], "a long, n long, l long, r long")
    assert big.select(phrases._score("a", "n", "l", "r")).first()[0] == 1000 * (10**13 + 7) * (10**15 + 3) // ((10**13 + 9) * (3 * 10**13 + 1))
