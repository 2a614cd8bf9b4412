import sys
from pathlib import Path

import pytest

from fieldspark.llm.queries import ORACLE_SQL, QUERIES

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from oracle import SF, rows_of_query, rows_of_sql  # noqa: E402

pytestmark = pytest.mark.skipif(not SF.exists(), reason="the driver's tables are not here")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    assert rows_of_query(spark, QUERIES[name]) == rows_of_sql(ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_columns_of_the_contract(spark, name):
    want = {
        "op1_ann": "query_id:bigint rank:int vec_id:bigint score:double",
        "op2_licenses": "doc_id:bigint n_words:bigint n_base:bigint first_word:bigint last_word:bigint base_labels:string labels:string score:double",
        "op3_simhash": "doc_id:bigint fingerprint:string component_id:bigint",
        "op4_topk": "query_id:bigint rank:int vec_id:bigint score:bigint",
        "op5_urls": "page_id:bigint host:string path:string rule:string verdict:string",
        "op6_mixing": "doc_id:bigint size:bigint source_size:bigint target:double taken:bigint",
        "op8_bpe": "doc_id:bigint n_tokens:bigint ids_sha256:string decoded_sha256:string",
        "op9_language_id": "doc_id:bigint held_out:boolean lang_pred:string score:double",
        "op10_toxicity": "doc_id:bigint held_out:boolean score:double predicted:int",
    }.get(name)
    df = QUERIES[name](spark, str(SF))
    assert want is None or want.split() == [f"{c}:{t}" for c, t in df.dtypes]
