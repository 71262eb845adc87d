"""Every registered training-data query on the smallest tables: against its DuckDB twin, or by the shape of its rows."""

import os

import pytest

from furrow.llm.queries import QUERIES, SQL
from tests.test_queries import FOLDER, Counter, duck, plain  # noqa: F401

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")

COLUMNS = {
    "op1_decontaminate": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    "op2_mix_sources": ["doc_id", "size", "source_size", "target", "taken"],
    "op3_quality": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op4_near_duplicates": ["doc_id", "class_id"],
    "op5_main_text": ["page_id", "url", "text", "n_chars"],
    "op6_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op7_chat": ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
    "op8_tokens": ["doc_id", "n_bytes", "n_tokens", "over_limit"],
    "op9_urls": ["page_id", "host", "path", "rule", "verdict"],
    "op10_languages": ["doc_id", "held_out", "lang_pred", "score"],
    "op11_jaccard_join": ["doc_id", "n_shingles", "component_id"],
    "op12_importance": ["doc_id", "n_features", "weight", "score", "rank"],
    "op13_fill_in_middle": ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"],
}
TABLE = {"op5_main_text": "pages", "op9_urls": "pages", "op7_chat": None}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query(spark, duck, name):  # noqa: F811
    df = QUERIES[name](spark, FOLDER)
    assert df.columns[: len(COLUMNS[name])] == COLUMNS[name]
    columns = sorted(df.columns)
    got = [str([plain(v) for v in r]) for r in df.select(*columns).collect()]
    if table := TABLE.get(name, "documents"):
        assert len(got) == duck.execute(f"SELECT count(*) FROM {table}").fetchone()[0]
    if name in SQL:
        result = duck.execute(SQL[name])
        names = [d[0] for d in result.description]
        assert Counter(got) == Counter(str([plain(r[names.index(c)]) for c in columns]) for r in result.fetchall())


def test_all_queries_are_listed():
    assert set(QUERIES) == set(COLUMNS)
