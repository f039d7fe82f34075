"""Queries on inputs larger than the cuts they once had."""

from datetime import date

from lakeloom import plans


def test_every_pending_task_is_claimed(spark, tmp_path):
    jobs = [(j, date(2024, 1, 1)) for j in range(600)]
    items = [(j, n, 1, 1, "N", "O", 1.0, 1.0, date(2024, 1, 2)) for j in range(600) for n in (1, 2)]
    spark.createDataFrame(jobs, "o_orderkey long, o_orderdate date").write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame(items, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_returnflag string, l_linestatus string, l_quantity double, l_extendedprice double, l_shipdate date").write.parquet(str(tmp_path / "lineitem.parquet"))
    out = plans.load()["fair_claim_order"](spark, str(tmp_path)).collect()
    assert [tuple(r) for r in out] == [(j, n, n) for n in (1, 2) for j in range(600)]


def test_odd_documents_are_compared(spark, tmp_path):
    spark.createDataFrame([(1,), (2,), (3,), (4,)], "doc_id long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(2,), (3,), (3,), (5,)], "doc_id long").write.parquet(str(tmp_path / "labels.parquet"))
    out = plans.load()["bijection_failures"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, out)) == [(1, False, True), (4, False, True), (5, True, False)]


def test_titles_match_from_three_quarters(spark, tmp_path):
    texts = ["one two three four", "one two three five", "one two six seven", "one eight nine ten"]
    spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [tuple(r) for r in plans.load()["title_overlap"](spark, str(tmp_path)).collect()] == [(0, 1, 3)]


def test_quotes_are_found_wherever_they_stand(spark, tmp_path):
    texts = ["before it all one two three four five six after", "xone two three four fivex", "one two three", "none", "a short one"]
    quotes = ["one two three four five", "one two", "three four five six seven", "", "e two three four f"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(quotes)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = {tuple(r) for r in plans.load()["issue_resolution"](spark, str(tmp_path)).collect()}
    assert out == {(i, d) for i, q in enumerate(quotes) for d, x in enumerate(texts) if q in x}
