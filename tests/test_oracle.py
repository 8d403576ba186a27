"""Registered queries against their SQL on the smallest tables.

ORACLE_ALL=1 checks every query; otherwise one or two per area.
"""

import math
import os

import pytest

from trackloom.workload.catalog import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = [
    "parse_lenient_number", "parse_frame_index", "direction_degrees", "pivot_keypoints_wide", "scan_long_details",
    "clean_features_25", "fill_linear", "score_windows", "error_stats", "error_by_group", "trust_effect",
    "greedy_candidate_fold", "select_and_export", "flow_region_stats", "alignment_report", "entity_split",
    "project_points", "scan_detections_text", "best_row_selection",
]


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return repr(v)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE) if os.environ.get("ORACLE_ALL") else SAMPLE)
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    ours = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    cur = duck.execute(ORACLE[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    theirs = sorted(tuple(norm(r[i]) for i in at) for r in cur.fetchall())
    assert ours == theirs
