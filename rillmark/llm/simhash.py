"""SimHash near-duplicates by multi-index hashing.

A fingerprint has 64 bits; a bit is set where over half of the text's shingle hashes have it. Fingerprints link at ``RADIUS``
(4) or fewer differing bits. Each is cut into two segments of 32 bits; of two linked fingerprints, one segment differs in at
most 2 bits. Both put the Hamming ball of radius 1 around each of their segments into a table, so linked ones meet under a
common key: the point between the two. What meets is verified on all 64 bits.

What meets under a key isn't paired up as rows: keys are sorted, each run of equal keys is linked in one pass, and a spanning
forest of its links comes out, fewer rows than the run has. Runs longer than ``BLOCK`` are cut into blocks, and each pair of
blocks is a piece of work of its own, so no task holds a hot key. Components are then found by alternating stars, each
round written to the shared folder.

Deduplication also links texts whose sets of five-word shingles are 80 % alike, whose fingerprints often differ in more bits:
``similar`` finds all of them, verified exactly.

Defined cases: a null or empty text has fingerprint zero, which links like any other; equal texts, repeated rows and null
ids are all kept, each row getting its component's smallest non-null id; an empty table gives an empty result; texts are
read whole; other columns are carried in ``row``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillmark.llm.batches import small_batches
from rillmark.llm.graph import components, join_lookup
from rillmark.llm.similar import one_a_text, prefixed, similar_links, split_words
from rillmark.llm.text import whole
from rillmark.scratch import Scratch, materialize

SHINGLE = 4
RADIUS = 4
BLOCK = 2048
SEED = 42
#: Up to so many documents to keep (16 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def _majority(hashes: list[int]) -> int:
    h = np.array(hashes, dtype="<u8")
    votes = np.zeros(64, dtype=np.int64)
    for part in np.array_split(h, len(h) // 65536 + 1):
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(h), bitorder="little").view("<u8")[0])


def shingle_hashes(words: list[bytes], shingle: int, seed: int = SEED) -> list[int]:
    """Hashes of all runs of ``shingle`` words, repeats included; of the whole sequence if it has fewer; none of no words."""
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return [digest(joined, seed)] if words else []
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-shingle].tolist()]
    return [digest(joined[a : b - 1], seed) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)]


def of_words(words: list[bytes], shingle: int = SHINGLE) -> int:
    """The fingerprint as a signed number."""
    hashes = shingle_hashes(words, shingle)
    return _signed(_majority(hashes)) if hashes else 0


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, text: str = "text") -> DataFrame:
    """``row`` (the document's columns without its text), ``k`` (the text's hash) and ``fp``, the fingerprint as a signed long."""

    @F.pandas_udf("long")
    def fp(t: pd.Series) -> pd.Series:
        return pd.Series([of_words(split_words(x), shingle) for x in t], dtype="int64")

    t = whole(docs[text])
    return docs.select(_row(docs, text).alias("row"), F.xxhash64(t).alias("k"), fp(t).alias("fp"))


def _row(docs: DataFrame, text: str) -> Column:
    return F.struct(*[docs[c] for c in docs.columns if c != text])


def _ball_keys(fp: Column, table: Column) -> Column:
    """Keys under which a fingerprint meets others: its table and the segment's number above the 33 points of its ball."""
    segments = (fp.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(fp, 32))
    flips = (0, *(1 << b for b in range(32)))
    above = F.shiftleft(table.cast("long"), 33)
    return F.array(*[above + s.bitwiseXOR(F.lit(m).cast("long")) + F.lit(n << 32) for n, s in enumerate(segments) for m in flips])


def _forest(x: np.ndarray, y: np.ndarray | None = None, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links of a spanning forest over ``x``, or over the links between ``x`` and ``y``."""
    both = x if y is None else np.concatenate([x, y])
    label = np.arange(len(both))
    links = []
    for i in range(len(x)):
        rest = np.arange(i + 1, len(both)) if y is None else np.arange(len(x), len(both))
        near = rest[np.bitwise_count(both[rest] ^ x[i]) <= radius]
        near = near[label[near] != label[i]]
        for j in near.tolist():
            if label[j] != label[i]:
                links.append((int(both[i]), int(both[j])))
                label[label == label[j]] = label[i]
    return links


def _link_runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by key: links of each run of equal keys; the rows of a run over ``BLOCK`` go on under their key."""
    held_key, held = None, np.array([], dtype=np.uint64)
    long_run = False

    def links(values: np.ndarray, key: int) -> list[tuple]:
        return [(a, b, key) for a, b in _forest(np.unique(values))]

    def frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["a", "b", "key"])
        a = np.array([_signed(r[0]) for r in rows], dtype=np.int64)
        return out.assign(a=a, b=pd.array([None if r[1] is None else _signed(r[1]) for r in rows], dtype="Int64"), key=out["key"].astype("int64"))

    for batch in batches:
        keys, fps = batch["key"].to_numpy(), batch["fp"].to_numpy().view(np.uint64)
        out: list[tuple] = []
        cuts = np.concatenate([[0], np.nonzero(np.diff(keys))[0] + 1, [len(keys)]]) if len(keys) else [0]
        lengths = np.diff(cuts)
        first, last = 0, len(lengths) - 1
        for k in [first, *(np.nonzero(lengths[1:-1] > 1)[0] + 1).tolist(), last] if last > 0 else ([first] if last == 0 else []):
            key, run = int(keys[cuts[k]]), fps[cuts[k] : cuts[k + 1]]
            if k == first and key == held_key:
                held = np.concatenate([held, run])
            elif k in (first, last):
                if len(held) > 1 and not long_run:
                    out += links(held, held_key)
                held_key, held, long_run = key, run, False
            else:
                out += links(run, key)
            if k in (first, last) and (long_run or len(held) > BLOCK):
                out += [(int(v), None, held_key) for v in held]
                held, long_run = held[:0], True
        yield frame(out)
    if len(held) > 1 and not long_run:
        yield frame(links(held, held_key))


def _link_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each row: two blocks of fingerprints under a common key, or one block alone."""
    for batch in batches:
        rows = []
        for key, x, y in zip(batch["key"], batch["x"], batch["y"], strict=True):
            x = np.array(x, dtype=np.int64).view(np.uint64)
            rows += [(_signed(a), _signed(b), key) for a, b in _forest(x, None if y is None else np.array(y, dtype=np.int64).view(np.uint64))]
        yield pd.DataFrame(rows, columns=["a", "b", "key"]).astype("int64")


def links(fps: DataFrame, space: Scratch) -> DataFrame:
    """``table, a, b``: for ``table, fp``, verified links between distinct fingerprints of a table that connect whatever is
    connected."""
    distinct = fps.select("table", "fp").distinct()
    keyed = distinct.select("fp", F.explode(_ball_keys(F.col("fp"), F.col("table"))).alias("key"))
    met = space.keep(keyed.repartition("key").sortWithinPartitions("key", "fp").mapInPandas(_link_runs, "a long, b long, key long"), "links")
    short = met.where("b is not null")
    hot = met.where("b is null").select("key", F.col("a").alias("fp")).distinct()
    n_blocks = hot.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / (BLOCK // 2)).cast("int").alias("n"))
    blocks = hot.join(n_blocks, "key").select("key", "n", "fp", F.pmod(F.xxhash64("fp"), F.col("n")).cast("int").alias("block"))
    blocks = blocks.groupBy("key", "n", "block").agg(F.collect_list("fp").alias("fps"))
    left = blocks.select("key", F.col("fps").alias("x"), F.col("block").alias("i"), F.explode(F.sequence(F.col("block"), F.col("n") - 1)).alias("j"))
    right = blocks.select("key", F.col("fps").alias("y"), F.col("block").alias("j"))
    work = left.join(right, ["key", "j"]).select("key", "x", F.when(F.col("i") != F.col("j"), F.col("y")).alias("y"))
    found = short.unionByName(work.mapInPandas(_link_blocks, "a long, b long, key long"))
    return found.select(F.shiftrightunsigned("key", 33).cast("int").alias("table"), "a", "b").distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, text: str = "text", key: str = "doc_id", copies: bool = False) -> DataFrame:
    """``row, text_key, fingerprint`` (16 hex digits) and ``component_id``, the smallest id of all documents reachable by links.
    With ``copies``, similar texts link too."""
    with small_batches(docs.sparkSession), Scratch(docs.sparkSession, "near-duplicates") as space:
        if copies:
            marked = space.keep(prefixed(docs, text, _row(docs, text), lambda words: of_words(words, shingle)), "texts")
        else:
            marked = space.keep(fingerprints(docs, shingle, text), "fingerprints")
        per_fp = marked.groupBy("fp").agg(F.min(f"row.{key}").alias("least"))
        pairs = links(marked.select(F.lit(0).alias("table"), "fp"), space).select("a", "b")
        if copies:
            pairs = pairs.unionByName(space.keep(similar_links(one_a_text(marked), docs, space, text, key), "similar"))
        found = components(pairs, space).withColumnRenamed("node", "fp")
        rooted = space.keep(per_fp.join(found, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "rooted")
        least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
        of_fp = space.keep(join_lookup(rooted, least, "root").select("fp", "component_id"), "components")
        hex_fp = F.lower(F.lpad(F.hex("fp"), 16, "0"))
        out = join_lookup(marked.select("row", "k", "fp"), of_fp, "fp").select("row", F.col("k").alias("text_key"), hex_fp.alias("fingerprint"), "component_id")
        return materialize(out, "near-duplicates")


def drop_near_duplicates(docs: DataFrame, shingle: int = SHINGLE, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One document of each component of near copies: the one with the smallest id (equal ids: the smallest text hash, one
    row of it)."""
    found = near_duplicates(docs.select(key, text), shingle, text, key, copies=True)
    id_ = F.col(f"row.{key}")
    best = found.groupBy("component_id").agg(F.min(F.struct(id_.isNull().alias("no_id"), id_.alias("id"), F.col("text_key").alias("hash"))).alias("best"))
    rows = found.groupBy(id_.alias("id"), F.col("text_key").alias("hash")).agg(F.count(F.lit(1)).alias("rows"))
    kept = best.select("best.*")
    kept = materialize(rows.join(kept, rows["id"].eqNullSafe(kept["id"]) & (rows["hash"] == kept["hash"]), "left_semi"), "kept")
    kept = F.broadcast(kept) if kept.count() <= BROADCAST_ROWS else kept
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), docs[key].alias("key"), F.xxhash64(whole(docs[text])).alias("text_key"))
    chosen = packed.join(kept, packed["key"].eqNullSafe(F.col("id")) & (packed["text_key"] == F.col("hash")))
    several = chosen.where("rows > 1").groupBy("key", "text_key").agg(F.first("doc").alias("doc"))
    return chosen.where("rows = 1").select("doc.*").unionByName(several.select("doc.*"))
