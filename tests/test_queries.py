"""Registered queries against their SQL at sf0.001: one of each group here, all of them at the driver's gate."""

import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
NAMES = ["s1_scans", "s2_fingerprint", "s4_feedback_json", "e3_mrz_lines", "e11_extract", "v1_aadhaar", "v5_birth_date", "v7_mrz", "j2_parse_payload", "j5_compare_registry",
         "c4_dossier", "c6_addresses", "g2_shared", "g5_pairs", "g6_clusters", "w3_ring_report", "c5_near_portraits", "i2_quality", "i3_error_level", "i5_outliers", "i5_summary", "i9_histogram", "c3_histograms",
         "f3_verdict", "f7_severity", "w1_review_queue", "w5_scan_scores", "s5_audit", "j4_not_found", "i3_fitted_errors", "i6_boxes", "i6_fitted_boxes", "i10_scan_regions", "st1_scan_stream", "st2_closing_stream", "st2_latest_verdict_stream", "st3_rescore", "st4_first_uploads", "st4_late_uploads"]


def plain(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    return f"{float(v):.9g}" if type(v).__name__ == "Decimal" else str(v)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted("|".join(plain(r[c]) for c in columns) for r in df.collect())
    cursor = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = sorted("|".join(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall())
    assert got == want


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())
