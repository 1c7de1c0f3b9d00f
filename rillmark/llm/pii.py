"""Personal data: exact base patterns, and a skip-chain conditional random field that adds what they miss.

The field's nodes are a document's tokens with a digit, an ``@`` or a written-out one; all other tokens are certain to be none.
Neighbouring tokens share a chain potential. Tokens with the same core (their letters and digits), the same name before an
``@``, or the same last seven digits share a skip potential with the next such token, however far apart, so a number written
once in full and later in part gets one label throughout; where a base span holds one of them, each gets the evidence of its
label directly. Loopy belief propagation passes messages along all edges, for all documents of a batch at once, until they
settle. Base spans hold their tokens' labels; other tokens that end up as personal data become additional spans of the kinds
``email_like`` and so on, if they have the least form of their kind.

The field is fitted on what the patterns can't read. In a sample of at most ``SAMPLE`` texts, half of the base spans are
rewritten in other forms (local numbers, other marks between digits, ``[at]``), and some are repeated later in part; the labels
are known, since they come from before the rewriting, and the patterns give none of them. Local weights are those of a
regularised softmax over the counted features, chain and skip potentials log ratios of counted pairs.

Defined cases: a null text is empty; repeated rows get equal spans; spans of one start are ordered by kind; an empty table, or
one without any base span, gives a model that adds nothing; texts of any length are read whole, in time proportional to their
length; other columns, whatever their names, are passed along in ``row`` or kept.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillmark.llm.spans import Span, joined, ordered, sha256
from rillmark.llm.text import whole

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, *(f"{k}_like" for k in BASE_KINDS))
LABELS = ("none", *BASE_KINDS)
#: At most so many different texts are counted to fit the potentials.
SAMPLE = 20_000
DAMPING, SURE, HELD = 0.3, 0.6, 8.0
#: Strength of the softmax's penalty, in counts, and its steps.
PENALTY, STEPS = 0.5, 300
#: Messages of a document are passed on until none changes by more than ``SETTLED``, or as often as it has tokens (``SWEEPS`` if it has fewer).
SWEEPS, SETTLED = 12, 1e-3
FIELDS = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_AT = re.compile(r"[\[(]at[\])]", re.IGNORECASE)
_NODE = re.compile(r"[0-9@]|[\[(][Aa][Tt][\])]")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_CORE = re.compile(r"[^\W_]+")
_TRIM = re.compile(r"^[^\w+(@]+|[^\w)]+$")
# Words that often stand before personal data.
CUES = {
    "email": ("mail", "email", "e-mail", "contact", "write"),
    "ip": ("ip", "host", "server", "address", "addr"),
    "card": ("card", "visa", "mastercard", "credit", "iban"),
    "phone": ("phone", "tel", "telephone", "call", "mobile", "fax"),
}
_CUE = {w: k for k, ws in CUES.items() for w in ws}


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    done = 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            yield "email", start, m.end()
            done = m.end()


def base_spans(text: str) -> list[Span]:
    found = list(_emails(text)) if "@" in text else []
    if _DIGIT.search(text):
        found += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups())]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and _luhn(digits):
                found.append(("card", m.start(), m.end()))
        if "+" in text:
            found += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m[0])) <= 15]
    return ordered(found, KINDS)


@dataclass
class Graph:
    """Nodes of one document: where they stand, their features, the label a base span gives them, and edges. ``held``: nodes
    whose key a base span holds elsewhere, beyond the reach of one edge, and its label."""

    spans: list[tuple[int, int]]
    features: list[tuple[str, ...]]
    given: list[int]
    chain: list[tuple[int, int]]
    skip: list[tuple[int, int]]
    held: list[tuple[int, int]] = field(default_factory=list)


def _features(token: str, before: str) -> tuple[str, ...]:
    runs = re.findall("[0-9]+", token)
    digits = sum(map(len, runs))
    bucket = next((str(b) for b in (0, 1, 3, 6, 8, 11, 19) if digits <= b), "many")
    cue = _CUE.get(before.strip(".,:;()[]").lower(), "none")
    letters = "letters" if any(c.isalpha() for c in token) else "no letters"
    marks = "".join(c for c in "@+(-./_:," if c in token[:-1]) + ("at" if _AT.search(token) else "")
    lengths = "-".join(str(min(len(r), 9)) for r in runs[:4]) + ("+" if len(runs) > 4 else "")
    octets = len(runs) == 4 and all(len(r) <= 3 and int(r) <= 255 for r in runs)
    luhn = 12 <= digits <= 19 and _luhn("".join(runs))
    return (f"digits {bucket}", f"marks {marks}", letters, f"cue {cue}", f"runs {lengths}, {letters}", f"luhn {luhn}, digits {bucket}", f"octets {octets}")


def _keys(token: str) -> set[str]:
    cores = _CORE.findall(token.lower())
    digits = "".join(_DIGIT.findall(token))
    keys = {"".join(cores)} if len("".join(cores)) >= 4 else set()
    if "@" in token:
        keys.add("".join(_CORE.findall(token.lower().split("@", 1)[0])))
    if len(digits) >= 7:
        keys.add(f"…{digits[-7:]}")
    return {k for k in keys if len(k) >= 4}


def build_graph(text: str, base: list[Span]) -> Graph:
    g, before, last = Graph([], [], [], [], []), "", -2
    seen: dict[str, list[int]] = {}
    at, active = 0, []  # base spans sorted by start, and those that reach into the present token
    for i, m in enumerate(_TOKEN.finditer(text)):
        token = m[0]
        if _NODE.search(token):
            node = len(g.spans)
            while at < len(base) and base[at][1] < m.end():
                active.append(base[at])
                at += 1
            active = over = [b for b in active if b[2] > m.start()]
            g.spans.append((m.start(), m.end()))
            g.features.append(_features(token, before))
            g.given.append(LABELS.index(over[0][0]) if over else 0)
            if last == i - 1:
                g.chain.append((node - 1, node))
            for key in _keys(token):
                if key in seen:
                    g.skip.append((seen[key][-1], node))
                seen.setdefault(key, []).append(node)
            last = i
        before = token
    linked = {(a, b) for edge in g.skip for a, b in (edge, edge[::-1])}
    held = set()
    for nodes in seen.values():
        near = next((v for v in nodes if g.given[v]), None)
        for v in nodes if near is not None else ():
            if g.given[v]:
                near = v
            elif (near, v) not in linked:
                held.add((v, g.given[near]))
    g.held = sorted(held)
    return g


@dataclass(frozen=True)
class Crf:
    unary: dict[str, np.ndarray]
    prior: np.ndarray
    chain: np.ndarray
    skip: np.ndarray

    def beliefs(self, graphs: list[Graph]) -> list[np.ndarray]:
        """Belief of each label at each node, by loopy propagation over all graphs at once."""
        sizes = [len(g.spans) for g in graphs]
        offset = np.concatenate([[0], np.cumsum(sizes)]).astype(int)
        n, k = int(offset[-1]), len(LABELS)
        if not n:
            return [np.zeros((0, k)) for _ in graphs]
        local = np.tile(self.prior, (n, 1))
        sources, sinks, tables, owners = [], [], [], []
        for number, (g, o) in enumerate(zip(graphs, offset, strict=False)):
            for i, (f, y) in enumerate(zip(g.features, g.given, strict=True)):
                for x in f:
                    local[o + i] += self.unary.get(x, 0.0)
                if y:
                    local[o + i, y] += HELD
            for i, y in g.held:
                local[o + i] += self.skip[y]
            for t, edges in ((0, g.chain), (1, g.skip)):
                for a, b in edges:
                    owners += [number, number]
                    sources += [o + a, o + b]
                    sinks += [o + b, o + a]
                    tables += [2 * t, 2 * t + 1]
        logs = lambda x: x - np.log(np.exp(x - x.max(1, keepdims=True)).sum(1, keepdims=True)) - x.max(1, keepdims=True)
        if sources:
            src, dst = np.array(sources), np.array(sinks)
            potential = np.stack([self.chain, self.chain.T, self.skip, self.skip.T])[np.array(tables)]
            message = np.zeros((len(src), k))
            owner, most = np.array(owners), np.maximum(SWEEPS, sizes)
            moving = np.arange(len(src))  # edges of documents whose messages still change; both directions are neighbours
            total = local.copy()
            for sweep in range(int(most.max())):
                s, d, own = src[moving], dst[moving], message[moving]
                nodes = np.unique(d)
                total[nodes] = local[nodes]
                np.add.at(total, d, own)
                cavity = total[s] - own[np.arange(len(moving)) ^ 1]
                joint = cavity[:, :, None] + potential[moving]
                top = joint.max(1)
                new = DAMPING * own + (1 - DAMPING) * logs(top + np.log(np.exp(joint - top[:, None, :]).sum(1)))
                message[moving] = new
                change = np.zeros(len(graphs))
                np.maximum.at(change, owner[moving], np.abs(new - own).max(1))
                moving = moving[((change > SETTLED) & (sweep + 1 < most))[owner[moving]]]
                if not len(moving):
                    break
            np.add.at(local, dst, message)
        p = np.exp(logs(local))
        return [p[offset[i] : offset[i + 1]] for i in range(len(graphs))]


def _other_form(kind: str, written: str, pick: int) -> str:
    """The same data in a form that the base patterns don't read."""
    runs = re.findall("[0-9]+", written)
    if kind == "email":
        return written.replace("@", ("[at]", "(at)", "[AT]")[pick % 3])
    if kind == "ip":
        return ("-", ",", "_")[pick % 3].join(runs)
    if kind == "card":
        digits = "".join(runs)
        return (".", "/", "_")[pick % 3].join(digits[i : i + 4] for i in range(0, len(digits), 4))
    local = "".join(runs[1:]) if len(runs) > 1 else runs[0]
    return (f"({local[:3]}) {local[3:6]}-{local[6:]}", f"{local[:3]}-{local[3:6]}-{local[6:]}", f"{local[:3]}.{local[3:6]}.{local[6:]}")[pick % 3]


def rewritten(text: str, base: list[Span]) -> tuple[str, list[Span]]:
    """The text with half of its base spans in other forms and some of them repeated in part at its end, and the spans that
    the base patterns no longer find, with their kinds. Choices are hashes of the text and the place."""
    out, truth, at, more = [], [], 0, []
    seed = hashlib.md5(text.encode()).digest()
    for n, (kind, a, z) in enumerate(base):
        if a < at:
            continue
        draw = seed[n % 16] + 7 * (n // 16)
        new = _other_form(kind, text[a:z], draw // 4) if draw % 2 else text[a:z]
        out.append(text[at:a])
        if draw % 2:
            start = sum(map(len, out))
            truth.append((kind, start, start + len(new)))
        elif draw % 4 == 0 and kind in ("card", "phone"):
            more.append((kind, "".join(re.findall("[0-9]", new))[-7:]))
        out.append(new)
        at = z
    out.append(text[at:])
    for kind, part in more:
        out.append(" ")
        start = sum(map(len, out))
        truth.append((kind, start, start + len(part)))
        out.append(part)
    whole_text = "".join(out)
    found = base_spans(whole_text)
    return whole_text, [s for s in truth if not any(b[1] < s[2] and b[2] > s[1] for b in found)]


def _count_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        counts: Counter = Counter()
        for text in b["text"]:
            if not _NODE.search(text):
                continue
            new, truth = rewritten(text, base_spans(text))
            g = build_graph(new, base_spans(new))
            label = list(g.given)
            for i, (a, z) in enumerate(g.spans):
                label[i] = label[i] or next((LABELS.index(k) for k, s, e in truth if s < z and e > a), 0)
            for f, y in zip(g.features, label, strict=True):
                counts[("node", "|".join(f), y, 0)] += 1
            for kind, edges in (("chain", g.chain), ("skip", g.skip)):
                for a, c in edges:
                    counts[(kind, "", label[a], label[c])] += 1
        yield pd.DataFrame([(*k, n) for k, n in counts.items()], columns=["what", "name", "y", "z", "n"])


def _softmax(rows: list[tuple[tuple[str, ...], int, int]]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Weights of features and labels that fit the counted ``features, label, n`` best, with a quadratic penalty."""
    names = sorted({f for fs, _, _ in rows for f in fs})
    at = {f: i for i, f in enumerate(names)}
    index = np.array([[*(at[f] for f in fs), len(names)] for fs, _, _ in rows])
    y, n = np.eye(len(LABELS))[[r[1] for r in rows]], np.array([r[2] for r in rows], dtype=float)[:, None]
    w, m, v = np.zeros((len(names) + 1, len(LABELS))), 0.0, 0.0
    for step in range(1, STEPS + 1):
        z = w[index].sum(1)
        p = np.exp(z - z.max(1, keepdims=True))
        off = np.repeat(n * (p / p.sum(1, keepdims=True) - y), index.shape[1], axis=0)
        grad = np.stack([np.bincount(index.ravel(), off[:, c], len(w)) for c in range(len(LABELS))], 1)
        grad = (grad + PENALTY * w) / n.sum()
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return {f: w[i] for f, i in at.items()}, w[-1]


def fit(docs: DataFrame, sample: int = SAMPLE, seed: int = 42, text: str = "text") -> Crf:
    """Fits on at most ``sample`` different texts, those with the least hashes. The counts are bounded as the features are, by
    the kinds of tokens that so many texts hold; they are collected already summed."""
    hashed = docs.select(F.xxhash64(whole(docs[text]), F.lit(seed)).alias("k"))
    share = min(1.0, 2 * sample / max(docs.count(), 1))  # a coarse cut before the exact one keeps the final sort small
    ks = hashed.where(F.pmod("k", F.lit(1 << 30)) < int(share * (1 << 30))).distinct().orderBy(F.pmod("k", F.lit(1 << 30)), "k").limit(sample)
    texts = docs.select(F.xxhash64(whole(docs[text]), F.lit(seed)).alias("k"), whole(docs[text]).alias("text"))
    chosen = texts.join(F.broadcast(ks), "k", "left_semi").groupBy("k").agg(F.first("text").alias("text")).select("text")
    counted = chosen.mapInPandas(_count_batches, "what string, name string, y int, z int, n long")
    rows = counted.groupBy("what", "name", "y", "z").agg(F.sum("n").alias("n")).collect()
    k = len(LABELS)
    tables = {"chain": np.full((k, k), 0.5), "skip": np.full((k, k), 0.5)}
    nodes = []
    for r in rows:
        if r["what"] == "node":
            nodes.append((tuple(r["name"].split("|")), r["y"], r["n"]))
        else:
            tables[r["what"]][r["y"], r["z"]] += r["n"]
    if not any(y for _, y, _ in nodes):
        return Crf({}, np.array([0.0] + [-20.0] * (k - 1)), np.zeros((k, k)), np.zeros((k, k)))

    def ratio(c: np.ndarray) -> np.ndarray:
        return np.log(c * c.sum() / (c.sum(1, keepdims=True) * c.sum(0, keepdims=True)))

    unary, prior = _softmax(sorted(nodes))
    return Crf(unary, prior, ratio(tables["chain"]), ratio(tables["skip"] + tables["skip"].T))


def _has_form(kind: str, text: str, repeated: bool = False) -> bool:
    """Whether a found span has at least what any of its kind has. Seven or eight digits, which dates and large numbers have too, are a
    phone number only where they repeat another mention."""
    digits, runs = len(_DIGIT.findall(text)), len(re.findall("[0-9]+", text))
    return {"email": "@" in text or bool(_AT.search(text)), "ip": runs >= 4, "card": digits >= 7, "phone": (7 if repeated else 9) <= digits <= 15}[kind]


def added_spans(text: str, g: Graph, belief: np.ndarray, base: list[Span]) -> list[Span]:
    """Runs of neighbouring nodes with one sure label that no base span touches."""
    runs, linked, again = [], {b for _, b in g.chain}, {i for edge in g.skip for i in edge} | {i for i, _ in g.held}
    for i, ((a, z), p) in enumerate(zip(g.spans, belief, strict=True)):
        y = int(p.argmax())
        if not y or p[y] < SURE or g.given[i]:
            continue
        if runs and runs[-1][0] == y and runs[-1][3] == i - 1 and i in linked:
            runs[-1][2:] = [z, i]
        else:
            runs.append([y, a, z, i])
    out = []
    for y, a, z, last in runs:
        lead = _TRIM.match(text[a:z])
        a += lead.end() if lead and lead.start() == 0 and lead.end() < z - a else 0
        tail = re.search(r"[^\w)]+$", text[a:z])
        z -= len(tail[0]) if tail else 0
        if a < z and _has_form(LABELS[y], text[a:z], last in again) and not any(b[1] < z and b[2] > a for b in base):
            out.append((f"{LABELS[y]}_like", a, z))
    return out


def find_spans(texts: list[str], model: Crf) -> list[tuple[list[Span], list[Span]]]:
    """Base spans and all spans of each text."""
    graphs, bases = [], []
    for t in texts:
        base = base_spans(t)
        bases.append(base)
        graphs.append(build_graph(t, base) if _NODE.search(t) else Graph([], [], [], [], []))
    beliefs = model.beliefs(graphs)
    return [(b, ordered(b + added_spans(t, g, p, b), KINDS)) for t, g, p, b in zip(texts, graphs, beliefs, bases, strict=True)]


def mask_text(text: str, spans: list[Span]) -> str:
    """The text with each span, joined where they overlap, as the kind of the first in brackets."""
    out, at = [], 0
    for kind, a, z in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.removesuffix('_like').upper()}]"]
        at = max(at, z)
    return "".join(out) + text[at:]


def _pieces(texts: pd.Series, model: Crf, step: int = 256) -> Iterator[tuple[str, list[Span], list[Span]]]:
    for i in range(0, len(texts), step):
        part = texts.iloc[i : i + step].tolist()
        for t, (base, spans) in zip(part, find_spans(part, model), strict=True):
            yield t, base, spans


def detect(docs: DataFrame, model: Crf, text: str = "text") -> DataFrame:
    """``row`` (the document's columns without its text) and the counts, digest and spans of ``FIELDS``."""

    @F.pandas_udf(FIELDS)
    def find(t: pd.Series) -> pd.DataFrame:
        rows = [(*(sum(s[0] == k for s in base) for k in BASE_KINDS), sha256(joined(base)), joined(spans)) for _, base, spans in _pieces(t, model)]
        return pd.DataFrame(rows, columns=[f.split()[0] for f in FIELDS.split(", ")])

    found = docs.select(F.struct(*[docs[c] for c in docs.columns if c != text]).alias("row"), find(whole(docs[text])).alias("found"))
    return found.select("row", "found.*")


def mask(docs: DataFrame, model: Crf, text: str = "text") -> DataFrame:
    """The documents with personal data masked in their text; ``n_chars``, if there, counts the new text."""

    @F.pandas_udf("string")
    def hide(t: pd.Series) -> pd.Series:
        return pd.Series([mask_text(x, spans) for x, _, spans in _pieces(t, model)], dtype="object")

    new = F.when(docs[text].isNotNull(), hide(whole(docs[text])))
    out = docs.withColumn(text, new)
    return out.withColumn("n_chars", F.char_length(text).cast("long")) if "n_chars" in docs.columns else out
