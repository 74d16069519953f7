"""The registered queries on the smallest tables: columns of their contracts, and SQL where there is some."""

import os
import sys
from pathlib import Path

import pytest

from regionpairs.llm import queries

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
import oracle  # noqa: E402

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
COLUMNS = {
    "op1_media": "doc_id:bigint n_bytes:bigint payload_bytes:bigint payload_sha256:string tail_crc32:bigint media_bytes:bigint media_sha256:string feature:string",
    "op2_quality": "doc_id:bigint score:double keep:boolean",
    "op3_url_filter": "page_id:bigint host:string path:string rule:string verdict:string",
    "op4_brown_lm": "doc_id:bigint held_out:boolean n_tokens:bigint n_known:bigint train_tokens:bigint base_score:double score:double",
    "op5_token_files": "doc_id:bigint start:bigint n_tokens:bigint ids_crc32:bigint",
    "op6_jaccard_join": "doc_id:bigint n_shingles:bigint component_id:bigint",
    "op7_decontaminate": "doc_id:bigint n_words:bigint n_hit:bigint n_items:bigint items_sha256:string contaminated:boolean",
    "op8_line_dedup": "doc_id:bigint n_lines:bigint n_cut:bigint",
    "op9_bpe": "doc_id:bigint n_tokens:bigint ids_sha256:string decoded_sha256:string",
    "op10_toxicity": "doc_id:bigint held_out:boolean score:double predicted:int",
    "op11_centroids": "vec_id:bigint cluster:int distance:bigint cluster_inertia:bigint inertia:bigint centroid_sha256:string",
    "op12_packing": "doc_id:bigint start:bigint length:bigint ids_crc32:bigint doc_tokens:bigint sequence_id:bigint offset:bigint",
    "op13_conversations": "conv_id:bigint gaps:bigint blank:bigint duplicate:bigint truncated:bigint illegal:bigint cost:bigint audit:string repaired_sha256:string",
}
TABLES = {"op3": "pages", "op11": "embeddings", "op13": "conversations"}


@pytest.mark.parametrize("name", list(COLUMNS))
def test_columns(spark, name):
    df = queries.QUERIES[name](spark, SF_DIR)
    kinds = [f"{c}:{t}" for c, t in df.dtypes]
    want = COLUMNS[name].split()
    assert kinds[: len(want)] == want
    # op12's rows are pieces, those of op13's table are turns
    key = {"op12": "doc_id", "op13": "conv_id"}.get(name.split("_")[0])
    rows = lambda df: df.select(key).distinct() if key else df
    assert rows(df).count() == rows(spark.read.parquet(f"{SF_DIR}/{TABLES.get(name.split('_')[0], 'documents')}.parquet")).count()


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_sql(spark, name):
    assert oracle.compare(spark, queries.QUERIES[name], queries.ORACLE_SQL[name], SF_DIR) == ""
