"""The whole profile as one report (A10 of the inventory)."""

from __future__ import annotations

from rillmark.operators import profile as P
from rillmark.plans import encodings, learning, profiles, streams  # noqa: F401 - their queries are the report's sections
from rillmark.plans.base import QUERIES, SQL, query
from rillmark.scratch import new_folder
from rillmark.sources import tables as T

#: The sections of the report: queries by name, and the column that names their rows where they have several.
_SECTIONS = {
    "label_cardinality": "split", "top_share": "k", "items_for_pct": "pct", "gini": None, "positive_popularity": None, "sequence_length_stats": None, "distinct_buckets": "field", "embedding_coverage": None,
    "item_metadata_card": None, "top_categories": "category", "split_summary": "split", "history_summary": None, "log_histogram": "bin", "rows_per_user": None, "behaviour_mix": "event_type", "behaviour_profile": None,
    "norm_stats": "space", "dim_means": "dim", "value_range": None, "mean_pairwise_cosine": None, "encoding_footprint": "encoding", "catalogue_funnel": "stage", "behaviour_funnel": "stage",
    "latency_summary": "event_type", "request_counts": "endpoint", "vocab_stats": None, "vocab_coverage": None, "join_loss_audit": None, "user_overlap": None,
}


def _report_sql() -> str:
    parts = []
    for name, key in _SECTIONS.items():
        rest, label = (f"COLUMNS(* EXCLUDE ({key}))", f"{key}::VARCHAR || '.' || metric") if key else ("COLUMNS(*)", "metric")
        named = f"{key}, " if key else ""
        parts.append(f"SELECT '{name}' AS section, {label} AS metric, value FROM (UNPIVOT (SELECT {named}{rest}::DOUBLE FROM ({SQL[name]})) ON {rest} INTO NAME metric VALUE value)")
    return " UNION ALL ".join(parts)


@query("profile_report", _report_sql())
def profile_report(s, d):
    """Every profile as one long table, written as JSON and read back. Interactions, clicks and the lengths of histories are written once for all sections."""
    with T.written_once():
        sections = {name: (QUERIES[name](s, d), key) for name, key in _SECTIONS.items()}
    return P.write_report(P.report(sections), new_folder(s, "profile"))
