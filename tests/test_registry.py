"""Every query with SQL is run beside DuckDB on a few operators of each kind; all of them import without a session."""

import glob
import os
import subprocess
import sys
from collections import Counter

import pytest

D = "/root/testdata/sf0.001"
SOME = ["norm_agg", "csc_offsets", "edge_ids", "edge_softmax_bwd", "agg_argmax", "two_hop_sample", "gcn_two_layer", "gat_layer", "minibatch_gradients", "sampled_blocks", "edge_softmax_columns_bwd", "gat_heads_layer", "star_norm_agg", "message_lists", "slot_edges", "weighted_edge_roundtrip", "numbered_flow_vertices", "adam_step_compat"]


def test_imports_without_session():
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q)"
    assert subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(os.path.dirname(__file__))).returncode == 0


@pytest.mark.skipif(not os.path.isdir(D), reason="no test data")
@pytest.mark.parametrize("name", SOME)
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    from graphloom.plans.queries import QUERIES, SQL

    con = duckdb.connect()
    for p in glob.glob(f"{D}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    a, b = QUERIES[name](spark, D).toPandas(), con.execute(SQL[name]).df()
    assert sorted(a.columns) == sorted(b.columns)
    rows = lambda f: Counter(tuple(round(v, 4) if isinstance(v, float) else v for v in r) for r in f[sorted(a.columns)].astype(object).values.tolist())
    assert rows(a) == rows(b)
