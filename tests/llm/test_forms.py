"""What the methods add to the base patterns, on texts written by hand; bounds of broadcasts at work."""

from __future__ import annotations

import pytest

from rillmark.llm import digest_store, pii, secret_scan, similar, simhash
from tests.llm import brute
from tests.llm.test_cases import frame, prose

FOLDER = "/root/testdata/sf0.1"
BEFORE = "the people of the town came to see "
#: Personal data in forms that neither the base patterns read nor the model's own rewriting makes, but for the last five.
PERSONAL = [
    "call me at 974 555 3436 after six", "tel. (0974) 555 34 36 in the evening", "phone 0974/5553436 please", "reach me on 974 - 555 - 3436 today", "write to ann.lee @ mail.example.com soon",
    "mail bob{at}corp.example.net now", "mail ann.lee(at)mail.example(dot)com now", "my card 4111:1111:1111:1111 was charged", "card 4111*1111*1111*1111 expires", "server 192;168;4;20 is down", "ip 10/20/30/40 answers",
    "email ann.lee[at]mail.example.com now", "credit card 4111.1111.1111.1111 expires", "the host at 192-168-4-20 is down", "call (974) 555-3436 now", "phone: 974.555.3436 ok",
]
CLEAN = [
    "in 1984 some 25 of 3,000 people left", "version 4.2.1 of the program", "chapters 12-14 and pages 555-560", "on 2024/05/17 at 10:30 they met", "the score was 3-2 in 1998", "room 974 on floor 12",
    "about 1,000,000 words in 12 books", "see section 10.2.3 there", "from 1914-1918 to 1939-1945", "item no. 20240517 costs 19.99", "a ratio of 16:9 or 4:3", "table 3.4 has 120 rows",
]


def test_pii_on_forms_written_by_hand(spark):
    """10 of 16 are found at least, and nothing in clean sentences."""
    model = pii.fit(spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text"))
    added = lambda texts: [len(spans) > len(base) for base, spans in pii.find_spans([BEFORE + t for t in texts], model)]
    assert sum(added(PERSONAL)) >= 10
    assert sum(added(PERSONAL[:11])) >= 5
    assert not any(added(CLEAN))


SECRETS = {
    "private_key": ["-----BEGIN RSA PRIVATE KEY-----", "-----BEGIN PRIVATE KEY-----"],
    "github": ["ghp_" + "a1B2" * 9, "gho_" + "Z" * 40],
    "slack": ["xoxb-1234567890-abc", "xoxp-aaaaaaaaaa"],
    "jwt": ["eyJhbGciOiJI.eyJzdWIiOiIx.c2lnbmF0dXJl"],
    "url_password": ["ann:s3cr3t@"],
}
NO_SECRETS = ["-----BEGIN PUBLIC KEY-----", "ghp_short", "xoxq-1234567890", "eyJab.eyJcd.ef", "https://example.com/@name", "see http://host:80/ now"]


def test_secret_kinds_beyond_the_base(spark):
    rows, expected = [], {}
    for kind, samples in SECRETS.items():
        for secret in samples:
            text = f"{prose(8)} https://{secret}db.example.com/x" if kind == "url_password" else f"é {prose(8)} ({secret}) {prose(3)}"
            at = text.index(secret)
            expected[len(rows)] = f"{kind}:{at}:{at + len(secret)}"
            rows.append((len(rows), text, "s"))
    clean = [(100 + i, f"{prose(5)} {t} {prose(5)}", "s") for i, t in enumerate(NO_SECRETS)]
    got = {r["row"]["doc_id"]: r for r in secret_scan.scan(frame(spark, rows + clean), digest_store.open_store(spark, "kinds")).collect()}
    for i, span in expected.items():
        assert span in got[i]["spans"].split(","), (rows[i], got[i]["spans"])
        assert got[i]["base_sha256"] == brute.sha(brute.joined(brute.secret_base(rows[i][1])))
    assert all(got[i]["spans"] == brute.joined(brute.secret_base(t)) for i, t, _ in clean)


@pytest.mark.parametrize("rows", [0, 1_000_000])
def test_near_copies_with_and_without_broadcasts(spark, monkeypatch, rows):
    for module in (similar, simhash):
        monkeypatch.setattr(module, "BROADCAST_ROWS", rows)
    base = [prose(80) for _ in range(6)]
    texts = [*base, *(b + " one more" for b in base), *base[:2], base[0].replace(" ", "  "), prose(80)]
    kept = simhash.drop_near_duplicates(frame(spark, [(i, t, "s") for i, t in enumerate(texts)]))
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 15]
