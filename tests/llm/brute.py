"""Brute-force versions of the pipeline's filtering stages, but for the trained one."""

import duckdb

from test_dedup import brute_components
from test_scans import brute_hits


def brute_stages(name, rows, sf_dir):
    """doc_ids that the stage must keep, sorted; rows are (doc_id, text, ...)."""
    if name == "exact dedup":
        keep = {}
        for i, t, *_ in rows:
            keep[t or ""] = max(i, keep.get(t or "", i))
        return sorted(keep.values())
    if name == "MinHash near-dedup":
        return sorted(i for i, _, c in brute_components(rows, 5, 80) if i == c)
    items = duckdb.sql(f"SELECT item_id, text FROM '{sf_dir}/benchmark.parquet'").fetchall()
    return sorted(i for i, t, *_ in rows if not brute_hits(t, items)[1])
