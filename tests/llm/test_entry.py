import re

import __spark_entry__ as entry
from kinsift.llm.entry import QUERIES, SQL


def test_all_are_registered():
    assert sorted(int(re.match(r"op(\d+)_", q)[1]) for q in QUERIES) == list(range(1, 11))
    assert QUERIES.keys() | {"pipeline"} <= entry.queries().keys() and SQL.keys() <= QUERIES.keys() and SQL.keys() <= entry.oracle_sql().keys()


def test_contract_columns(spark, small):
    want = {
        1: "doc_id fingerprint component_id", 2: "doc_id held_out score predicted", 3: "doc_id held_out score predicted", 4: "doc_id size text_crc32 law shard slot grown_shard",
        6: "page_id payload_bytes payload_digest record_type refers_to", 7: "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
        8: "doc_id size source_size target taken", 9: "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature", 10: "doc_id n_tokens ids_sha256 decoded_sha256",
    }
    for name, query in QUERIES.items():
        n = int(re.match(r"op(\d+)_", name)[1])
        if n in want:
            assert set(want[n].split()) <= set(query(spark, small).columns)
