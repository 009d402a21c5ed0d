"""The registered queries on the smallest tables: their columns and one row for each document."""

import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
COLUMNS = {
    "op1_warc": "page_id payload_bytes payload_digest record_type refers_to",
    "op2_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op3_language": "doc_id held_out lang_pred score",
    "op4_jaccard": "doc_id n_shingles component_id",
    "op5_mtree": "query_id rank vec_id score",
    "op6_toxicity": "doc_id held_out score predicted",
    "op7_sharding": "doc_id size text_crc32 law shard slot grown_shard",
    "op8_licenses": "doc_id n_words n_base first_word last_word base_labels labels score",
    "op9_sentencepiece": "doc_id n_ids ids_crc32 exact n_best best_crc32",
    "op10_telephony": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature",
    "op11_learned_partitions": "query_id rank vec_id score",
    "op12_filter_audit": "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley",
    "op13_treap_search": "item_id rank doc_id score",
    "pipeline": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
}


@pytest.mark.parametrize("name", COLUMNS)
def test_columns_and_rows(spark, name):
    df = entry.queries()[name](spark, DATA)
    assert df.columns == COLUMNS[name].split()
    rows = df.count()
    docs = spark.read.parquet(f"{DATA}/documents.parquet").count()
    if name in ("op3_language", "op4_jaccard", "op6_toxicity", "op7_sharding", "op8_licenses", "op9_sentencepiece", "op10_telephony"):
        assert rows == docs
    else:
        assert rows > 0


@pytest.mark.parametrize("name", ["op1_warc", "op4_jaccard", "op5_mtree", "op12_filter_audit", "op13_treap_search"])
def test_query_equals_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    store = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "benchmark", "labels"):
        store.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    columns = COLUMNS[name].split()
    expected = store.execute(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, entry.queries()[name](spark, DATA).select(*columns).collect()), key=repr) == sorted(expected, key=repr)
