"""The registered queries over a whole small table, against SQL or brute force."""

from __future__ import annotations

import re

import duckdb
import pytest
from pyspark.sql import functions as F

from rillmark.llm import queries as Q
from tests.compare import differences
from tests.llm import brute

FOLDER = "/root/testdata/sf0.001"


def table(name, columns):
    return duckdb.connect().sql(f"SELECT {columns} FROM '{FOLDER}/{name}.parquet'").fetchall()


DOCS = table("documents", "doc_id, text")


def rows(spark, name, key="doc_id"):
    got = Q.queries()[name](spark, FOLDER).collect()
    by = {r[key]: r for r in got}
    assert len(by) == len(got)
    return by


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_equals_sql(spark, name):
    assert differences(Q.queries()[name](spark, FOLDER), Q.oracle_sql()[name], FOLDER) == []


def test_op1_brute_force_and_labels(spark):
    got = rows(spark, "op1_quality_rules")
    for d, t in DOCS:
        r = got[d]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute.measures(t)
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    labels = dict(table("labels", "doc_id, quality"))
    assert all(got[d]["kept"] for d, q in labels.items() if q == 1 and not got[d]["base_failed"])
    assert sum(got[d]["kept"] for d, q in labels.items() if q == 0) <= 1


def test_op3_hosts_rules_and_model(spark):
    got = rows(spark, "op3_url_filters", "page_id")
    rules = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
    for p, url in table("pages", "page_id, url"):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url)
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fits = [(len(r), r, v) for v, r in rules if ("." + host).endswith("." + r.split("/", 1)[0]) and path.startswith("/" + r.split("/", 1)[1])]
        r = got[p]
        assert (r["host"], r["path"], r["rule"]) == (host, path, max(fits)[1] if fits else None)
        assert r["verdict"] == (max(fits)[2] if fits else r["verdict"])


    judged = [r for r in got.values() if r["rule"] is None]
    blocked, allowed = ([r["score"] for r in judged if r["verdict"] == v] for v in ("block", "allow"))
    assert allowed and (not blocked or min(blocked) > max(allowed))


def test_op4_brute_force(spark):
    got = rows(spark, "op4_benchmark_decontamination")
    for d, (n, hit, ids) in brute.contamination(DOCS, table("benchmark", "item_id, text")).items():
        r = got[d]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == (n, hit, len(ids), brute.sha(",".join(ids)), hit > 0)


def test_op5_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    got = Q.op5_quality_classifier(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out").collect()
    assert len(got) > 50
    assert sum(r["predicted"] == r["quality"] for r in got) / len(got) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got)


def test_op6_brute_force(spark):
    got = rows(spark, "op6_secret_scans")
    for d, t in DOCS:
        base = brute.secret_base(t or "")
        r = got[d]
        assert r["base_sha256"] == brute.sha(brute.joined(base))
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(s[0] == k for s in base) for k in ("assign", "access", "hex"))
        assert set(filter(None, brute.joined(base).split(","))) <= set(r["spans"].split(","))


def test_op7_brute_force(spark):
    got = rows(spark, "op7_simhash_near_dedup")
    prints = {d: brute.fingerprint(t) for d, t in DOCS}
    expected = brute.components(prints)
    for d, f in prints.items():
        assert (got[d]["fingerprint"], got[d]["component_id"]) == (f"{f:016x}", expected[d])


def test_op8_brute_force(spark):
    got = rows(spark, "op8_pii")
    for d, t in DOCS:
        base = brute.pii_base(t or "")
        r = got[d]
        assert r["base_sha256"] == brute.sha(brute.joined(base))
        assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == tuple(sum(s[0] == k for s in base) for k in ("email", "ip", "card", "phone"))
        assert set(filter(None, brute.joined(base).split(","))) <= set(r["spans"].split(","))


def test_op9_equals_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    got = rows(spark, "op9_token_counts")
    for d, text in DOCS:
        n = len(t.encode(text or "", add_special_tokens=False).ids)
        assert (got[d]["n_bytes"], got[d]["n_tokens"], got[d]["over_limit"]) == (len((text or "").encode()), n, n > 1024)


def test_op10_targets_and_reruns(spark):
    got = rows(spark, "op10_mixing")
    assert got == rows(spark, "op10_mixing")
    docs = table("documents", "doc_id, source, text")
    size = {d: len(brute.WORD.findall(t or "")) for d, _, t in docs}
    per: dict = {}
    for d, s, _ in docs:
        per[s] = per.get(s, 0) + size[d]
    names = sorted((s for s in per if s is not None), key=lambda s: s.encode()) + [None] * (None in per)
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    total, target, free = sum(per.values()), {}, set(names)
    while True:
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * per[s]}
        if not over:
            break
        target |= {s: 3.0 * per[s] for s in over}
        free -= over
    target |= share
    taken: dict = {}
    for d, s, _ in docs:
        r = got[d]
        assert (r["size"], r["source_size"]) == (size[d], per[s])
        assert r["target"] == pytest.approx(target[s])
        assert 0 <= r["taken"] <= 3 * size[d] and (size[d] == 0 or r["taken"] % size[d] == 0)
        taken[s] = taken.get(s, 0) + r["taken"]
    largest = max(size.values())
    assert all(abs(taken[s] - target[s]) <= largest for s in per)


def test_queries_read_whole_tables(spark):
    for name, q in Q.queries().items():
        if name.startswith(("op1_", "op5_")):
            assert q(spark, FOLDER).count() == len(DOCS), name


def test_native_queries_run_no_python(spark):
    for name in ("op1_quality_rules", "op3_url_filters", "op4_benchmark_decontamination", "op10_mixing"):
        plan = Q.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan), name


def test_nothing_is_capped(spark):
    assert Q.op2_chat_formatting(spark, FOLDER).agg(F.sum("n_turns")).first()[0] == len(table("conversations", "conv_id")) + 2
