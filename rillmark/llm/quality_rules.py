"""Quality rules as a bitmask ledger.

``ledger`` evaluates every rule once a document and keeps the measurements and one failure bit a rule. Policies are
versioned masks over those bits, so a verdict under another policy, or an ablation that leaves one rule out, reads the
ledger and never the text again.

Defined cases: a null text has no words and fails ``few_words``; texts of any length are measured whole; an empty table gives an
empty ledger; repeated rows are judged one by one; null ids stay. Other columns, whatever their names, are passed over.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillmark.llm.text import WORD, count_chars, let, whole, words

WINDOW = 5


@dataclass(frozen=True)
class Rule:
    bit: int
    name: str
    fails: str  # SQL over the measurements

    @property
    def mask(self) -> int:
        return 1 << self.bit


RULES = (
    Rule(0, "few_words", "n_words < 10"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    Rule(2, "symbols", "100 * n_symbols > 10 * n_words"),
    Rule(3, "exclamations", "100 * n_exclaim > 50 * n_words"),
    Rule(4, "repeated_lines", "100 * n_dup_lines > 50 * n_lines"),
    Rule(5, "echoed_words", "100 * n_echo > 30 * n_words"),
    Rule(6, "word_length", "word_chars < 2 * n_words OR word_chars > 15 * n_words"),
    Rule(7, "digits", "100 * n_digits > 50 * word_chars"),
)


@dataclass(frozen=True)
class Policy:
    version: str
    mask: int


def policy(version: str, *names: str) -> Policy:
    known = {r.name: r.mask for r in RULES}
    return Policy(version, sum(known[n] for n in set(names)))


BASE = policy("base", "few_words", "repeated_windows")
STRICT = policy("strict", *(r.name for r in RULES))
POLICIES = (BASE, STRICT)


def _repeat_words(w: Column, h: Column, n: Column) -> Column:
    """Words inside 5-word windows that occur at least twice in the text. ``h`` holds the words' hashes; five of them
    folded stand for a window. Equal folds are a necessary sign of equal windows, so a text without any ends there;
    others sort their windows and compare the words of neighbours."""

    def fold(a: Column, b: Column) -> Column:
        return F.zip_with(a, b, lambda x, y: F.xxhash64(x, y))

    k = n - (WINDOW - 1)
    pairs = fold(F.slice(h, 1, n - 1), F.slice(h, 2, n - 1))
    fives = let(pairs, lambda p: fold(fold(F.slice(p, 1, k), F.slice(p, 3, k)), F.slice(h, 5, k)))

    def same(x: Column, y: Column) -> Column:
        equal = (x["f"] == y["f"]) & (F.slice(w, x["p"], WINDOW) == F.slice(w, y["p"], WINDOW))
        return F.coalesce(equal, F.lit(False))

    def covered(s: Column) -> Column:
        hit = F.transform(s, lambda x, j: F.when(same(x, F.get(s, j - 1)) | same(x, F.get(s, j + 1)), x["p"]))
        return let(
            F.sort_array(F.filter(hit, lambda p: p.isNotNull())),
            lambda q: F.aggregate(
                F.transform(q, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(q, i + 1) - p, F.lit(WINDOW)))),
                F.lit(0).cast("long"),
                lambda a, x: a + x,
            ),
        )

    def found(f: Column) -> Column:
        ordered = F.sort_array(F.transform(f, lambda x, i: F.struct(x.alias("f"), (i + 1).alias("p"))))
        return F.when(F.size(F.array_distinct(f)) == k, F.lit(0).cast("long")).otherwise(let(ordered, covered))

    return F.when(n < WINDOW + 1, F.lit(0).cast("long")).otherwise(let(fives, found))


def measure(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row a document: the key and its measurements."""
    t = whole(F.col(text))
    parts = docs.select(
        F.col(key).alias("doc_id"),
        words(F.col(text)).alias("w"),
        F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD)).alias("l"),
        F.regexp_replace(t, "[^#*$%&|<>!0-9]+", "").alias("marks"),
    ).select("*", F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
    w, h, n = F.col("w"), F.col("h"), F.size("w")
    return parts.select(
        "doc_id",
        n.cast("long").alias("n_words"),
        F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
        count_chars(F.col("marks"), "[#*$%&|<>]").alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        _repeat_words(w, h, n).alias("n_repeat_words"),
        F.size("l").cast("long").alias("n_lines"),
        count_chars(F.col("marks"), "!").alias("n_exclaim"),
        count_chars(F.col("marks"), "[0-9]").alias("n_digits"),
        F.size(F.filter(h, lambda x, i: F.get(h, i - 1) == x)).cast("long").alias("n_echo"),
    )


def ledger(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The measurements and ``fail_bits``: bit ``r.bit`` is set where rule ``r`` fails."""
    bits = F.lit(0).cast("long")
    for r in RULES:
        bits = bits + F.when(F.expr(r.fails), F.lit(r.mask).cast("long")).otherwise(F.lit(0).cast("long"))
    return measure(docs, text, key).withColumn("fail_bits", bits)


def rejected(p: Policy) -> Column:
    return F.col("fail_bits").bitwiseAND(F.lit(p.mask).cast("long")) != 0


def apply_policy(led: DataFrame, p: Policy = STRICT) -> DataFrame:
    """The ledger with ``base_failed``, ``kept`` and the policy's version."""
    base = rejected(BASE)
    return led.select("*", base.alias("base_failed"), (~base & ~rejected(p)).alias("kept"), F.lit(p.version).alias("policy"))


def ablation(led: DataFrame, p: Policy = STRICT) -> DataFrame:
    """For each rule of the policy: documents that fail it, that fail nothing else, and that would be kept without it.

    Documents are first counted by their bits, so what follows is at most one row a combination of bits."""
    by_bits = led.groupBy(F.col("fail_bits").bitwiseAND(F.lit(p.mask).cast("long")).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    rules = [r for r in RULES if r.mask & p.mask]
    cells = []
    for r in rules:
        cells += [
            F.sum(F.when(F.col("b").bitwiseAND(F.lit(r.mask).cast("long")) != 0, F.col("n"))).alias(f"failed_{r.bit}"),
            F.sum(F.when(F.col("b") == r.mask, F.col("n"))).alias(f"sole_{r.bit}"),
            F.sum(F.when(F.col("b").bitwiseAND(F.lit(p.mask & ~r.mask).cast("long")) == 0, F.col("n"))).alias(f"kept_{r.bit}"),
        ]
    rows = F.array(
        *(
            F.struct(
                F.lit(r.name).alias("rule"),
                *(F.coalesce(F.col(f"{k}_{r.bit}"), F.lit(0)).cast("long").alias(a) for k, a in (("failed", "n_failed"), ("sole", "n_sole"), ("kept", "n_kept_without"))),
            )
            for r in rules
        )
    )
    return by_bits.agg(*cells).select(F.inline(rows)).withColumn("policy", F.lit(p.version))


def keep(docs: DataFrame, p: Policy = STRICT) -> DataFrame:
    """The documents that the policy keeps, with their own columns: a filter in place, without a join.

    The ledger's row goes through ``explode`` so that the optimiser doesn't push the filter into the measurements, where each
    of its rules would measure the text anew."""
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc_id"), docs["text"].alias("text"))
    judged = ledger(packed).select(F.explode(F.array(F.struct("doc_id", "fail_bits"))).alias("x")).select("x.doc_id", "x.fail_bits")
    return judged.where(~rejected(Policy("kept", p.mask | BASE.mask))).select("doc_id.*")
