"""Secret scans over an incremental blob ledger.

Every version of every path is a row; its content is a blob named by SHA-256. Only pairs of a blob and a rule version that
the ledger doesn't hold are scanned, and findings are joined back to all paths and versions that hold the blob.

Defined cases: a null text is the empty blob; repeated rows each get the blob's findings; an empty table gives an empty
result; text of any length is scanned whole, in time proportional to it; other columns are passed along in ``row``.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillmark.llm.digest_store import resolve
from rillmark.llm.spans import Span, joined, ordered, sha256

VERSION = "secrets-1"
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "private_key", "github", "slack", "jwt", "url_password")

# The patterns of the rules.
_ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
_MORE = {
    "private_key": ("-----BEGIN", re.compile(r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----")),
    "github": ("gh", re.compile(r"\bgh[pousr]_[A-Za-z0-9]{36,}")),
    "slack": ("xox", re.compile(r"\bxox[abprs]-[A-Za-z0-9-]{10,}")),
    "jwt": ("eyJ", re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+")),
    "url_password": ("://", re.compile(r"(?<=://)[A-Za-z0-9_.-]{1,64}:[^\s/@:]{3,128}@")),
}
_HINTS = ("passw", "secret", "token", "api")

FIELDS = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def base_spans(text: str) -> list[Span]:
    found = []
    low = text.lower()
    if any(h in low for h in _HINTS):
        found += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return ordered(found, KINDS)


def scan_text(text: str) -> tuple:
    base = base_spans(text)
    more = [(k, m.start(), m.end()) for k, (hint, p) in _MORE.items() if hint in text for m in p.finditer(text)]
    n = [sum(s[0] == k for s in base) for k in BASE_KINDS]
    return (*n, sha256(joined(base)), joined(ordered(base + more, KINDS)))


def scan(versions: DataFrame, ledger: str, version: str = VERSION, text: str = "text") -> DataFrame:
    """``row`` (the version's own columns), ``digest`` and the findings of its blob."""

    @F.pandas_udf(FIELDS)
    def scanned(t: pd.Series) -> pd.DataFrame:
        names = [f.split()[0] for f in FIELDS.split(", ")]
        return pd.DataFrame([scan_text(x) for x in t], columns=names)

    return resolve(versions, ledger, version, scanned, FIELDS, text).select("row", "digest", "found.*")
