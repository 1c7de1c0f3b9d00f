"""URL filters: an ordered rule list first, gradient-boosted trees on lexical features for the rest.

A rule is ``host/path``: it fits its host and all subdomains where the URL's path starts with the rule's, and the longest
fitting rule decides. Undecided URLs are judged by boosted trees over length, depth, digit ratio, entropy, parameter counts
and statistics of the host's suffix and of its letter triples, trained on labelled URLs (at most ``SAMPLE`` distinct ones,
chosen by hash). A statistic of a training URL is taken from other hosts' labels only, so that the trees can't learn hosts
by heart; statistics are kept in ``BUCKETS`` hashed places, so scoring needs no join. A URL is blocked from the score on that
has blocked the unwanted with a precision of ``PRECISION`` on hosts which the trees haven't seen: where no score does, as where
labels have nothing to do with URLs, none is blocked.

Labels are given, or come from what is there: ``content_labels`` marks the undecided URLs whose page fails the quality rules, and
``rule_labels`` those that the rule list blocks.

Defined cases: a null URL or one without ``://`` has an empty host and path, no rule fits, and the trees judge its empty
features; with no labels, labels of one class only, or only one class among the hosts that the trees may learn from (as where all
URLs have one host), every undecided URL is allowed; a URL labelled both ways counts by its
majority, a tie as wanted; repeated rows are judged alike; URLs of any length are read whole; an empty table gives an empty
result. Columns other than the URL, the page and the key, whatever their names, are passed along in ``row``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillmark.llm import quality_rules
from rillmark.llm.text import UPPER, let, whole
from rillmark.scratch import materialize

#: Most labelled URLs that the trees are fitted on.
SAMPLE = 20_000
#: Hashed places of the suffixes' and letter triples' statistics, folds of hosts, and labels that a statistic starts from.
BUCKETS, FOLDS, PRIOR = 1024, 5, 20
#: Least precision of blocking on unseen hosts, and least number of URLs on which it is measured.
PRECISION, LEAST = 0.9, 20

FEATURES = (
    "url_length", "host_length", "path_length", "host_labels", "path_depth", "digit_ratio", "host_hyphens", "path_hyphens",
    "host_entropy", "url_entropy", "parameters", "has_fragment", "is_https", "suffix_share", "suffix_rate", "triple_rate",
)


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    rule: str

    @property
    def host(self) -> str:
        return self.rule.split("/", 1)[0]

    @property
    def path(self) -> str:
        return "/" + self.rule.split("/", 1)[1]


RULES = (
    UrlRule("block", "com/en/"),
    UrlRule("allow", "example.com/en/7"),
    UrlRule("allow", "net/de/"),
    UrlRule("block", "example.net/de/8"),
    UrlRule("block", "org/es/"),
)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host, with A-Z lower-cased, and path."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    u = F.coalesce(url.cast("string"), F.lit(""))
    return F.translate(F.regexp_extract(u, pattern, 1), UPPER, UPPER.lower()), F.regexp_extract(u, pattern, 2)


def longest_rule(host: Column, path: Column, rules: tuple[UrlRule, ...] = RULES) -> Column:
    """``struct(n, rule, verdict)`` of the longest rule that fits, or null; equal rules: the later verdict by name."""
    fits = []
    for r in rules:
        on_host = (host == r.host) | host.endswith("." + r.host)
        found = F.struct(F.lit(len(r.rule)).alias("n"), F.lit(r.rule).alias("rule"), F.lit(r.verdict).alias("verdict"))
        fits.append(F.when(on_host & path.startswith(r.path), found))
    return F.array_max(F.array(*fits))


def _entropy(s: Column) -> Column:
    """Bits a character, over the characters of ``s``."""

    def bits(x: Column) -> Column:
        n = F.char_length(x).cast("double")
        share = lambda c: (n - F.char_length(F.replace(x, c, F.lit("")))) / n
        parts = F.transform(F.array_distinct(F.split(x, "")), lambda c: F.when(c == "", F.lit(0.0)).otherwise(-share(c) * F.log2(share(c))))
        return F.when(n > 0, F.aggregate(parts, F.lit(0.0), lambda a, p: a + p)).otherwise(F.lit(0.0))

    return let(s, bits)


def _count(s: Column, text: str) -> Column:
    return (F.char_length(s) - F.char_length(F.replace(s, F.lit(text), F.lit("")))) / float(len(text))


def lexical(pages: DataFrame, url: str = "url") -> DataFrame:
    """``pages`` rows under ``row``, with ``host, path, suffix`` and the features that need the URL alone."""
    host, path = split_url(F.col(url))
    cut = pages.select(F.struct(*[pages[c] for c in pages.columns]).alias("row"), F.coalesce(F.col(url).cast("string"), F.lit("")).alias("u"), host.alias("host"), path.alias("path"))
    u, h, p = F.col("u"), F.col("host"), F.col("path")
    query = F.regexp_extract(u, r"(?s)\?([^#]*)", 1)
    return cut.select(
        "row", "host", "path",
        F.substring_index(h, ".", -1).alias("suffix"),
        F.char_length(u).cast("double").alias("url_length"),
        F.char_length(h).cast("double").alias("host_length"),
        F.char_length(p).cast("double").alias("path_length"),
        (_count(h, ".") + 1).alias("host_labels"),
        _count(p, "/").alias("path_depth"),
        ((F.char_length(u) - F.char_length(F.regexp_replace(u, "[0-9]", ""))) / F.greatest(F.char_length(u), F.lit(1))).alias("digit_ratio"),
        _count(h, "-").alias("host_hyphens"),
        _count(p, "-").alias("path_hyphens"),
        _entropy(h).alias("host_entropy"),
        _entropy(u).alias("url_entropy"),
        F.when(query == "", 0.0).otherwise(_count(query, "&") + 1).alias("parameters"),
        F.contains(u, F.lit("#")).cast("double").alias("has_fragment"),
        F.startswith(u, F.lit("https://")).cast("double").alias("is_https"),
    )


def _draw(url: Column, seed: int) -> Column:
    return F.pmod(F.xxhash64(url, F.lit(seed)), F.lit(1 << 52)).cast("double") / float(1 << 52)


def sample_urls(urls: DataFrame, most: int = SAMPLE, seed: int = 42) -> DataFrame:
    """At most ``most`` distinct URLs of the column ``url``, those with the least hashes."""
    share = 2 * most / max(urls.count(), 1)  # a coarse cut before the exact one keeps the final sort small
    return urls.where("url is not null").where(_draw(F.col("url"), seed) < share).select("url").distinct().orderBy(_draw(F.col("url"), seed), "url").limit(most)


def visible_text(html: Column) -> Column:
    """What a page shows, roughly: no scripts, styles, comments or tags."""
    bare = F.regexp_replace(whole(html), r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->", " ")
    return F.regexp_replace(bare, r"<[^>]*>", " ")


def content_labels(pages: DataFrame, rules: tuple[UrlRule, ...] = RULES, url: str = "url", html: str = "html", most: int = SAMPLE, seed: int = 42) -> DataFrame:
    """``url, label`` of a sample of the URLs that no rule decides: 1 where the page's text fails the quality rules."""
    host, path = split_url(F.col(url))
    plain = pages.select(F.col(url).cast("string").alias("url"), host.alias("host"), path.alias("path"), F.col(html).alias("html")).where(longest_rule(F.col("host"), F.col("path"), rules).isNull())
    chosen = sample_urls(plain.select("url"), most, seed)
    read = plain.join(F.broadcast(chosen), "url", "left_semi").select("url", visible_text(F.col("html")).alias("text"))
    led = materialize(quality_rules.ledger(materialize(read, "page-texts"), "text", "url"), "page-ledger")
    return led.select(F.col("doc_id").alias("url"), quality_rules.rejected(quality_rules.STRICT).cast("int").alias("label"))


def rule_labels(pages: DataFrame, rules: tuple[UrlRule, ...] = RULES, url: str = "url", most: int = SAMPLE, seed: int = 42) -> DataFrame:
    """``url, label`` of a sample of the URLs that a rule decides: 1 where it blocks them."""
    host, path = split_url(F.col(url))
    judged = pages.select(F.col(url).cast("string").alias("url"), host.alias("host"), path.alias("path")).select("url", longest_rule(F.col("host"), F.col("path"), rules).alias("best")).where("best is not null")
    chosen = sample_urls(judged.select("url"), most, seed)
    return judged.join(F.broadcast(chosen), "url", "left_semi").select("url", (F.col("best.verdict") == "block").cast("int").alias("label")).distinct()


def _bucket(s: Column) -> Column:
    return F.pmod(F.xxhash64(s), F.lit(BUCKETS)).cast("int")


def _triples(host: Column) -> Column:
    """Places of the letter triples of the host's name, without its suffix."""
    name = F.regexp_replace(host, r"\.[^.]*$", "")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(name) - 2, F.lit(1))), lambda i: _bucket(F.substring(name, i, F.lit(3))))


def _table(values: list[float]) -> Column:
    """A list as one constant."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast("array<double>")


class UrlModel:
    """Boosted trees, the statistics that they look up (``tables[name][fold]``, the last one over all labels), and the score
    from which on a URL is blocked."""

    def __init__(self, trees, tables: dict[str, list[list[float]]], cut: float = math.inf):
        self.trees, self.tables, self.cut = trees, tables, cut

    def features(self, urls: DataFrame, fold: Column | None = None) -> DataFrame:
        def look(name: str, place: Column) -> Column:
            if fold is None:
                return F.get(_table(self.tables[name][-1]), place)
            return F.get(F.get(F.array(*[_table(t) for t in self.tables[name][:-1]]), fold), place)

        mean = F.aggregate(F.transform(_triples(F.col("host")), lambda p: look("triple_rate", p)), F.lit(0.0), lambda a, x: a + x) / F.size(_triples(F.col("host")))
        suffix = _bucket(F.col("suffix"))
        added = urls.withColumns({"suffix_share": look("suffix_share", suffix), "suffix_rate": look("suffix_rate", suffix), "triple_rate": mean})
        return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(added)

    def judge(self, urls: DataFrame) -> DataFrame:
        """``urls`` with ``score``, the likelihood that the URL is unwanted."""
        if self.trees is None:
            return urls.withColumn("score", F.lit(0.0))
        return self.trees.transform(self.features(urls)).withColumn("score", F.get(vector_to_array("probability"), 1))


def _tables(sample: DataFrame) -> dict[str, list[list[float]]]:
    """Smoothed label rates by place, each fold's without its own hosts, then those of all hosts."""
    suffix = sample.select("fold", F.lit("suffix").alias("kind"), _bucket(F.col("suffix")).alias("place"), "label")
    triple = sample.select("fold", F.lit("triple").alias("kind"), F.explode(F.array_distinct(_triples(F.col("host")))).alias("place"), "label")
    counted = suffix.unionByName(triple).groupBy("kind", "fold", "place").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("bad"))
    found = {kind: np.zeros((2, FOLDS, BUCKETS)) for kind in ("suffix", "triple")}
    for r in counted.collect():  # at most 2 x FOLDS x BUCKETS rows
        found[r["kind"]][:, r["fold"], r["place"]] = r["n"], r["bad"]
    out: dict[str, list[list[float]]] = {"suffix_share": [], "suffix_rate": [], "triple_rate": []}
    for left_out in [*range(FOLDS), None]:
        kept = [f for f in range(FOLDS) if f != left_out]
        (n, bad), (tn, tbad) = (found[k][:, kept].sum(1) for k in ("suffix", "triple"))
        rate = bad.sum() / max(n.sum(), 1)
        out["suffix_share"].append((n / max(n.sum(), 1)).tolist())
        out["suffix_rate"].append(((bad + PRIOR * rate) / (n + PRIOR)).tolist())
        out["triple_rate"].append(((tbad + PRIOR * rate) / (tn + PRIOR)).tolist())
    return out


def fit(labelled: DataFrame, seed: int = 42) -> UrlModel:
    """``labelled``: ``url, label`` (0 or 1; others are left out)."""
    usable = labelled.where("label in (0, 1) and url is not null").select(F.col("url").cast("string").alias("url"), "label")
    chosen = usable.join(F.broadcast(sample_urls(usable, SAMPLE, seed)), "url", "left_semi").groupBy("url").agg((F.avg("label") > 0.5).cast("int").alias("label"))
    fold = F.pmod(F.xxhash64("host", F.lit(seed)), F.lit(FOLDS)).cast("int")
    sample = materialize(lexical(chosen).select("row.label", fold.alias("fold"), *[c for c in lexical(chosen).columns if c != "row"]), "labelled-urls")
    n, bad = sample.where("fold > 0").agg(F.count(F.lit(1)), F.sum("label")).first()  # fold 0 is for choosing the cut
    if not n or bad in (0, n):
        return UrlModel(None, {})
    model = UrlModel(None, _tables(sample))
    trees = GBTClassifier(featuresCol="features", labelCol="label", maxIter=20, maxDepth=4, stepSize=0.3, subsamplingRate=0.8, minInstancesPerNode=20, seed=seed)
    rows = materialize(model.features(sample, F.col("fold")).select("features", F.col("label").cast("double").alias("label"), "fold").coalesce(1), "url-features")  # of SAMPLE rows
    model.trees = trees.fit(rows.where("fold > 0"))
    held = model.trees.transform(rows.where("fold = 0")).select(F.get(vector_to_array("probability"), 1).alias("score"), "label").collect()  # of SAMPLE rows
    model.cut = _cut([(r["score"], r["label"]) for r in held])
    return model


def _cut(scored: list[tuple[float, float]]) -> float:
    """The least score from which on ``PRECISION`` of the labels are 1."""
    cut, bad = math.inf, 0.0
    ordered = sorted(scored, reverse=True)
    for n, (score, label) in enumerate(ordered, 1):
        bad += label
        last = n == len(ordered) or ordered[n][0] < score
        if last and n >= LEAST and bad >= PRECISION * n:
            cut = score
    return cut


def judge(pages: DataFrame, model: UrlModel, rules: tuple[UrlRule, ...] = RULES, url: str = "url") -> DataFrame:
    """``row`` (the page without its text), ``host, path, rule, verdict`` and the trees' ``score``."""
    scored = model.judge(lexical(pages, url))
    best = longest_rule(F.col("host"), F.col("path"), rules)
    return scored.select("row", "host", "path", "score", best.alias("best")).select(
        "row", "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.when(F.col("score") >= model.cut, "block").otherwise("allow")).alias("verdict"), "score",
    )
