from datetime import datetime

from ozalid.llm import q_canonical


def test_repeated_rows_of_an_item_count_once(spark, tmp_path, monkeypatch):
    seen = {}
    monkeypatch.setattr(q_canonical, "map_values", lambda cases, value, terms, used: seen.update({r["term_id"]: r["used"] for r in used.collect()}) or cases)
    spark.createDataFrame([(1, "liver"), (2, "lung")], "term_id long, name string").write.parquet(f"{tmp_path}/answer_terms.parquet")
    rows = [("q1", "liver", None, None, datetime(2026, 1, 1 + i)) for i in range(20)] + [(f"q{i}", "lung", None, None, datetime(2026, 1, 1)) for i in (2, 3)]
    spark.createDataFrame(rows, "question_id string, gt_answer string, option_A string, modality_type string, loaded_at timestamp").write.parquet(f"{tmp_path}/qa_items.parquet")
    q_canonical.mapped(spark, str(tmp_path))
    assert seen == {1: 1, 2: 2}
