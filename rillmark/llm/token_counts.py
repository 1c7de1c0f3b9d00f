"""Token counts through a digest cache.

Counts are kept by the digest of the normalised content and of the tokenizer's version (its file and options). Only distinct
misses are encoded; they are appended to the cache and joined back to all documents.

The vocabulary is the byte-level BPE of a ``tokenizers`` JSON file. Texts are encoded by ``tiktoken`` with that vocabulary's
own ranks, some five times faster; texts with a character of the planes on which the two libraries were not compared
are encoded by ``tokenizers`` itself, and so are all texts if the file describes anything else than the fast way does. Both give
the same counts.

Defined cases: a null text is empty and has no tokens; repeated rows each get their text's count; an empty table gives an
empty result; texts of any length are encoded whole; other columns, whatever their names, are passed along in ``row``.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillmark.llm.digest_store import resolve

#: Both libraries were found to class every code point before these alike.
_NOT_COMPARED = re.compile("[\U00030000-\U0010ffff]")
FIELDS = "n_tokens long"
#: Fixed value: how this vocabulary's library cuts text into pieces before merging.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others, in order, from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def _reads_alike(model: dict) -> bool:
    """Whether the file describes what the fast way does: plain byte-level BPE, pieces cut by the standard pattern, merges in
    order of their pieces' ids, and special tokens that are matched as they stand."""
    bpe, cut = model["model"], model.get("pre_tokenizer") or {}
    plain = bpe.get("type", "BPE") == "BPE" and not any(bpe.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback"))
    standard = cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True) and not model.get("normalizer")
    exact = not any(t.get(k) for t in model["added_tokens"] for k in ("lstrip", "rstrip", "single_word"))
    if not (plain and standard and exact):
        return False
    pairs = (m.split(" ") if isinstance(m, str) else m for m in bpe["merges"])
    ids = [bpe["vocab"].get(a + b, -1) for a, b in pairs]
    return -1 not in ids and all(x < y for x, y in zip(ids, ids[1:], strict=False))


@lru_cache(maxsize=2)
def _encoders(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    of = _byte_of_char()
    special = {t["content"]: t["id"] for t in model["added_tokens"]}
    slow = Tokenizer.from_file(path)
    slow.no_truncation()
    slow.no_padding()
    if not _reads_alike(model):
        return None, set(special), slow
    ranks = {bytes(of[c] for c in piece): i for piece, i in model["model"]["vocab"].items() if piece not in special}
    fast = tiktoken.Encoding("byte_bpe", pat_str=PIECES, mergeable_ranks=ranks, special_tokens=special)
    return fast, set(special), slow


def count_tokens(text: str, path: str) -> int:
    fast, special, slow = _encoders(path)
    if fast and (text.isascii() or not _NOT_COMPARED.search(text)):
        return len(fast.encode(text, allowed_special=special, disallowed_special=()))
    return len(slow.encode(text, add_special_tokens=False).ids)


def tokenizer_version(path: str) -> str:
    """Digest of the vocabulary file and of the options under which texts are encoded."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + b"|no special tokens added|strings of special tokens recognised|whole text").hexdigest()


def count(docs: DataFrame, cache: str, path: str, text: str = "text") -> DataFrame:
    """``row`` (the document's own columns), ``n_bytes``, ``n_tokens``."""

    @F.pandas_udf(FIELDS)
    def encode(t: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"n_tokens": [count_tokens(x, path) for x in t]})

    return resolve(docs, cache, tokenizer_version(path), encode, FIELDS, text).select("row", "n_bytes", "found.n_tokens")
