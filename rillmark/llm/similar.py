"""Links between texts whose sets of five-word shingles are ``SIMILARITY`` alike: all of them, verified exactly.

Shingles have one order, rare ones first. Two sets that alike share so many shingles that the first common one lies in the
prefix of both: their first fifth, and one more. Prefixes are therefore grouped by shingle, in sorted runs:

* a run of up to ``CROWD`` texts gives all its pairs that have room for enough common shingles;
* a longer run is cut into blocks, each pair of blocks is a piece of work of its own, and a spanning forest of the pairs
  that bitmaps of the sets don't rule out is kept, so a hot shingle neither lands in one task nor becomes all its pairs.

Candidates form clusters. Inside a cluster every pair is a candidate: sets are compared block by block, and only a verified
pair joins two groups. A pair is passed over only where verified pairs have joined its texts already, so no link that
connects anything is lost, and what comes out is a spanning forest, fewer rows than there are texts.

Defined cases: equal texts count once; a text of fewer than five words has one shingle, its words; a text without words has
none and is like no other; texts of any length are read whole; an empty table gives no links.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillmark.llm.graph import components, join_lookup
from rillmark.llm.text import whole
from rillmark.scratch import Scratch

SHINGLE, SIMILARITY = 5, 0.8
SEED = 42
#: The order of shingles, on which no result depends: one text in ``SAMPLED`` is counted; the ``FREQUENT`` most frequent ones come last.
SAMPLED, FREQUENT = 16, 100_000
#: Texts under one shingle of which all pairs are formed; texts and shingles of a block beyond that.
CROWD, BLOCK, BLOCK_SHINGLES = 8, 512, 2_000_000
#: Up to so many row numbers (8 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Least bits of a bitmap; and the most that alike sets differ, by the sum of their sizes.
BITS, APART = 512, (1 - SIMILARITY) / (1 + SIMILARITY)
_PLACES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)  # odd numbers


def shingle_set(words: list[bytes]) -> np.ndarray:
    """Hashes of the different runs of five words, sorted. Each word is hashed once; a run mixes its words' hashes by place."""
    if not words:
        return np.array([], dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(w, SEED) for w in words], dtype=np.uint64)
    n = max(1, len(h) - SHINGLE + 1)
    mixed = np.zeros(n, dtype=np.uint64)
    for i, place in enumerate(_PLACES[: len(h)]):
        mixed += h[i : i + n] * np.uint64(place)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(_PLACES[0])
    mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed)


def split_words(text: str) -> list[bytes]:
    """Words in lower case, A-Z only, cut at ASCII white space only."""
    return text.encode().lower().split()


def bitmap(shingles: np.ndarray) -> np.ndarray:
    """One bit a class of shingles: whether their number is odd. Sets differ in at least as many shingles as bitmaps in bits.
    There are about as many classes as shingles; a longer bitmap is folded to the length of a shorter one."""
    bits = max(BITS, 1 << int(len(shingles)).bit_length())
    odd = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def _folded(words: np.ndarray, length: int) -> np.ndarray:
    while len(words) > length:
        words = words[: len(words) // 2] ^ words[len(words) // 2 :]
    return words


def prefix(shingles: np.ndarray, frequent: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The rarest shingles, one of which a set as alike must share. ``frequent`` is sorted; others are all as rare."""
    n = len(shingles)
    cut = n - ceil(SIMILARITY * n - 1e-6) + 1 if n else 0
    if not len(frequent) or not n:
        return shingles[:cut]
    at = np.minimum(np.searchsorted(frequent, shingles), len(frequent) - 1)
    return shingles[np.lexsort((shingles, np.where(frequent[at] == shingles, counts[at], 0)))][:cut]


def _counted(batches: Iterator[pd.DataFrame], chunk: int = 2_000_000) -> Iterator[pd.DataFrame]:
    """Shingles that occur in several texts of a chunk, and in how many; equal texts (equal ``k``) count once."""
    held, seen, size = [], set(), 0

    def frame() -> pd.DataFrame:
        h, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.array([], dtype=np.uint64), np.array([], dtype=np.int64))
        return pd.DataFrame({"h": h[n > 1].view(np.int64), "n": n[n > 1].astype(np.int64)})

    for b in batches:
        for k, t in zip(b["k"].tolist(), b["t"], strict=True):
            if k not in seen:
                seen.add(k)
                held.append(shingle_set(split_words(t)))
                size += len(held[-1])
                if size > chunk:
                    yield frame()
                    held, seen, size = [], set(), 0
    yield frame()


def frequent_shingles(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles of a sample of the texts ``k, t``, sorted, and their counts: at most ``FREQUENT``."""
    found = texts.where(F.pmod("k", F.lit(SAMPLED)) == 0).mapInPandas(_counted, "h long, n long")
    rows = found.groupBy("h").agg(F.sum("n").alias("n")).where("n > 2").orderBy(F.desc("n"), "h").limit(FREQUENT).collect()
    hashes, counts = (np.array([r[i] for r in rows], dtype=np.int64) for i in (0, 1))
    order = np.argsort(hashes.view(np.uint64))
    return hashes.view(np.uint64)[order], counts[order]


def _roomy(na, ia, nb, ib):
    """Whether two sets can share enough if these are the places of their first common shingle."""
    return np.minimum(na - ia, nb - ib) * (1 + SIMILARITY) >= (na + nb) * SIMILARITY - 1e-6


class _Bitmaps:
    """Which sets of a run sizes and bitmaps don't rule out."""

    def __init__(self, n: np.ndarray, words: list[np.ndarray]):
        self.n, self.length = n, np.array([len(w) for w in words])
        self.at, self.words = {}, {}
        for length in np.unique(self.length).tolist():
            rows = np.nonzero(self.length >= length)[0]
            self.at[length] = np.full(len(n), -1)
            self.at[length][rows] = np.arange(len(rows))
            self.words[length] = np.stack([_folded(words[r], length) for r in rows.tolist()])

    def close(self, a: int, rest: np.ndarray) -> np.ndarray:
        na, nb = self.n[a], self.n[rest]
        sized = rest[np.minimum(na, nb) >= SIMILARITY * np.maximum(na, nb) - 1e-6]
        ok = []
        for length in np.unique(np.minimum(self.length[a], self.length[sized])).tolist():
            part = sized[np.minimum(self.length[a], self.length[sized]) == length]
            words, at = self.words[length], self.at[length]
            apart = np.bitwise_count(words[at[part]] ^ words[at[a]]).sum(1, dtype=np.int64)
            ok.append(part[apart <= (na + self.n[part]) * APART + 1e-6])
        return np.sort(np.concatenate(ok)) if ok else sized


def _close_sets(a: Column, b: Column) -> Column:
    """The same for two structs ``n, b``."""
    na, nb = a["n"], b["n"]
    length = F.least(F.size(a["b"]), F.size(b["b"]))

    def folded(words: Column) -> Column:  # sizes differ by less than half, so lengths by one fold
        half = F.transform(F.sequence(F.lit(0), length - 1), lambda i: F.get(words, i).bitwiseXOR(F.get(words, i + length)))
        return F.when(F.size(words) == length, words).when(F.size(words) == 2 * length, half)

    apart = F.aggregate(F.zip_with(folded(a["b"]), folded(b["b"]), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    sized = F.least(na, nb) >= SIMILARITY * F.greatest(na, nb) - 1e-6
    return sized & (F.coalesce(apart, F.lit(0)) <= (na + nb) * APART + 1e-6)


def _meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows ``key, k, n, i`` sorted by key: ``x, y`` of the pairs of short runs; ``x`` and the key of the texts of long ones."""
    columns = ("key", "k", "n", "i")
    held, long_key = [np.array([], dtype=np.int64)] * 4, None

    def pairs(key, k, n, i, starts, length):
        for a in range(length):
            for b in range(a + 1, length):
                x, y = starts + a, starts + b
                ok = (k[x] != k[y]) & _roomy(n[x], i[x], n[y], i[y])
                yield np.minimum(k[x], k[y])[ok], np.maximum(k[x], k[y])[ok]

    def frame(found: list, crowd: list) -> pd.DataFrame:
        xy = [np.concatenate([f[j] for f in found]) if found else held[0][:0] for j in (0, 1)]
        both = pd.DataFrame({"x": xy[0], "y": xy[1]}).drop_duplicates()
        many = [np.concatenate([c[j] for c in crowd]) if crowd else held[0][:0] for j in (0, 1)]
        alone = np.repeat([False, True], [len(both), len(many[0])])
        masked = lambda a, b, mask: pd.arrays.IntegerArray(np.concatenate([a, b]), mask)
        return pd.DataFrame({
            "x": np.concatenate([both["x"].to_numpy(), many[0]]), "y": masked(both["y"].to_numpy(), many[0], alone), "key": masked(both["y"].to_numpy(), many[1], ~alone),
        })

    for batch in batches:
        rows = [np.concatenate([h, batch[c].to_numpy()]) for h, c in zip(held, columns, strict=True)]
        key, k = rows[0], rows[1]
        if not len(key):
            continue
        starts = np.concatenate([[0], np.nonzero(np.diff(key))[0] + 1])
        lengths = np.diff(np.concatenate([starts, [len(key)]]))
        found, crowd = [], []
        if key[0] == long_key:
            crowd.append((k[: lengths[0]], key[: lengths[0]]))
            starts, lengths = starts[1:], lengths[1:]
        if len(starts) and lengths[-1] <= CROWD:  # may go on in the next batch
            held, starts, lengths = [r[starts[-1] :] for r in rows], starts[:-1], lengths[:-1]
        else:
            held, long_key = [r[:0] for r in rows], int(key[-1])
        for length in range(2, CROWD + 1):
            found += pairs(*rows, starts[lengths == length], length)
        for s, n in zip(starts[lengths > CROWD].tolist(), lengths[lengths > CROWD].tolist(), strict=True):
            crowd.append((k[s : s + n], key[s : s + n]))
        yield frame(found, crowd)
    if len(held[0]) > 1:
        yield frame([*pairs(*held, np.array([0]), len(held[0]))], [])


def _runs(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """The runs of equal keys of sorted rows, as arrays by column. A run is bounded by two blocks."""
    held: dict[str, np.ndarray] | None = None
    for b in batches:
        if not len(b):
            continue
        rows = {c: b[c].to_numpy() if held is None else np.concatenate([held[c], b[c].to_numpy()]) for c in b.columns}
        change = np.zeros(len(rows[keys[0]]) - 1, dtype=bool)
        for c in keys:
            change |= rows[c][1:] != rows[c][:-1]
        cuts = [0, *(np.nonzero(change)[0] + 1).tolist()]
        for s, e in zip(cuts, cuts[1:], strict=False):
            yield {c: v[s:e] for c, v in rows.items()}
        held = {c: v[cuts[-1] :] for c, v in rows.items()}
    if held is not None:
        yield held


class _Groups:
    """Labels of texts, joined by verified pairs."""

    def __init__(self, start: np.ndarray):
        self.label = np.unique(start, return_inverse=True)[1].reshape(-1)

    def join(self, a: int, b: int) -> None:
        self.label[self.label == self.label[b]] = self.label[a]


def _sides(run: dict[str, np.ndarray], at: int) -> np.ndarray:
    """Rows with which row ``at`` is paired: later ones of its own block's run, or all of the other block."""
    block, i, j = run["block"], run["i"][0], run["j"][0]
    if i == j:
        return np.arange(at + 1, len(block))
    return np.nonzero(block == j)[0] if block[at] == i else np.array([], dtype=np.int64)


def _near_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs of texts under one shingle: a spanning forest of the pairs that sizes and bitmaps don't rule out."""
    for run in _runs(batches, ["key", "i", "j"]):
        k, bits = run["k"], _Bitmaps(run["n"], [np.asarray(b, dtype=np.int64).view(np.uint64) for b in run["b"]])
        groups, out = _Groups(k), []
        for a in range(len(k)):
            rest = _sides(run, a)
            rest = rest[groups.label[rest] != groups.label[a]]
            for c in bits.close(a, rest).tolist():
                if groups.label[c] != groups.label[a]:
                    out.append((min(k[a], k[c]), max(k[a], k[c])))
                    groups.join(a, c)
        yield pd.DataFrame(out, columns=["x", "y"]).astype("int64")


def _verify_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs of texts of one cluster: a spanning forest of the pairs whose sets are alike; ``node`` is what is linked."""
    for run in _runs(batches, ["cluster", "i", "j"]):
        node, sets = run["node"], [np.asarray(s, dtype=np.int64).view(np.uint64) for s in run["s"]]
        n = np.array([len(s) for s in sets])
        bits = _Bitmaps(n, [bitmap(s) for s in sets])
        groups, out = _Groups(node), []
        for a in range(len(node)):
            rest = _sides(run, a)
            rest = rest[groups.label[rest] != groups.label[a]]
            for c in bits.close(a, rest).tolist():
                if groups.label[c] != groups.label[a]:
                    shared = len(np.intersect1d(sets[a], sets[c], assume_unique=True))
                    if shared and shared >= SIMILARITY * (n[a] + n[c] - shared) - 1e-6:
                        out.append((node[a], node[c]))
                        groups.join(a, c)
        yield pd.DataFrame(out, columns=["a", "b"]).astype("int64")


def _paired(rows: DataFrame, id_: str) -> DataFrame:
    """``rows`` once for each pair ``i, j`` of the ``blocks`` of their group in which they take part; ``block`` is their own."""
    placed = rows.withColumn("block", F.pmod(F.xxhash64(id_), F.col("blocks")).cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, "block").alias("i"), F.greatest(o, "block").alias("j")))
    return placed.select("*", F.explode(others).alias("pair")).select("*", "pair.i", "pair.j").drop("pair", "blocks")


def _worked(rows: DataFrame, work, key: str, schema: str) -> DataFrame:
    return rows.repartition(key, "i", "j").sortWithinPartitions(key, "i", "j").mapInPandas(work, schema)


def prefixed(docs: DataFrame, text: str, row: Column, first) -> DataFrame:
    """``k`` (the text's hash), ``n, p, b`` (size, prefix and bitmap of its shingle set), ``row``, ``rid`` (a number of the row, to be
    written at once) and ``fp``, what ``first`` computes from the words: one pass over the texts."""
    t = whole(docs[text])
    held = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs.select(F.xxhash64(t).alias("k"), t.alias("t"))))

    @F.pandas_udf("struct<fp:long,n:int,p:array<long>,b:array<long>>")
    def measure(texts: pd.Series) -> pd.DataFrame:
        out = []
        for x in texts:
            words = split_words(x)
            s = shingle_set(words)
            out.append((first(words), len(s), prefix(s, *held.value).view(np.int64), bitmap(s).view(np.int64)))
        return pd.DataFrame(out, columns=["fp", "n", "p", "b"])

    return docs.select(F.xxhash64(t).alias("k"), measure(t).alias("m"), row.alias("row"), F.monotonically_increasing_id().alias("rid")).select("k", "m.*", "row", "rid")


def one_a_text(rows: DataFrame) -> DataFrame:
    """The row with the least ``rid`` of each ``k``; rows of texts without copies aren't moved while those with are few."""
    copied = rows.groupBy("k").agg(F.min("rid").alias("least"), F.count(F.lit(1)).alias("rows")).where("rows > 1").select("k", "least")
    known = F.broadcast(copied) if copied.count() <= BROADCAST_ROWS else copied
    return rows.join(known, "k", "left").where("least is null or least = rid").drop("least")


def candidates(texts: DataFrame, space: Scratch) -> DataFrame:
    """``x, y``: pairs that connect all texts ``k, n, p, b`` which may be alike."""
    shingles = texts.select("k", F.col("n").cast("long").alias("n"), F.posexplode("p").alias("i", "key"))
    sorted_ = shingles.select("key", "k", "n", F.col("i").cast("long").alias("i")).repartition("key").sortWithinPartitions("key")
    met = space.keep(sorted_.mapInPandas(_meet, "x long, y long, key long"), "met")
    info = texts.select("k", F.col("n").cast("long").alias("n"), "b")
    side = lambda k, s: info.select(F.col("k").alias(k), F.struct("n", "b").alias(s))

    pairs = met.where("y is not null").select("x", "y").distinct()
    both = pairs.join(side("x", "a"), "x").join(side("y", "b"), "y")
    few = both.where(_close_sets(F.col("a"), F.col("b"))).select("x", "y")
    crowd = met.where("y is null").select("key", F.col("x").alias("k"))
    sizes = crowd.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    many = _worked(_paired(join_lookup(crowd, sizes, "key").join(info, "k"), "k"), _near_blocks, "key", "x long, y long")
    return few.unionByName(many).distinct()


def similar_links(texts: DataFrame, docs: DataFrame, space: Scratch, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``a, b``: links between the nodes ``fp`` of the texts ``k, fp, n, p, b, row``, one row a text; several texts may share a node. They
    connect what texts that are alike connect. ``docs`` has the texts themselves; ``row.{key}`` says in which rows."""
    met = space.keep(candidates(texts, space), "candidates")
    clusters = components(met.select(F.col("x").alias("a"), F.col("y").alias("b")), space)
    named = texts.select("k", F.col("fp").alias("node"), F.col("n").cast("long").alias("n"), F.col(f"row.{key}").alias("id"))
    wanted = named.join(clusters.select(F.col("node").alias("k"), F.col("root").alias("cluster")), "k")
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks")
    wanted = space.keep(wanted, "wanted")
    placed = space.keep(wanted.join(wanted.groupBy("cluster").agg(blocks), "cluster").drop("n"), "placed")

    @F.pandas_udf("array<long>")
    def sets(t: pd.Series) -> pd.Series:
        return pd.Series([shingle_set(split_words(x)).view(np.int64) for x in t])

    t = docs.select(docs[key].alias("doc"), F.xxhash64(whole(docs[text])).alias("hash"), whole(docs[text]).alias("t"))
    found = t.join(F.broadcast(placed) if placed.count() <= BROADCAST_ROWS else placed, (F.col("hash") == F.col("k")) & F.col("doc").eqNullSafe(F.col("id")))
    rows = found.select("cluster", "blocks", "k", "node", sets("t").alias("s"))
    return _worked(_paired(rows, "k"), _verify_blocks, "cluster", "a long, b long")
