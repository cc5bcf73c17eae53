from collections import Counter

from quillgraph.operators import incremental, joins


def test_crowded_values_equal_a_plain_join(spark, monkeypatch):
    monkeypatch.setattr(joins, "MANY", 3)
    left = spark.createDataFrame([(k, i) for i, k in enumerate(["a"] * 5 + ["b"] * 2 + [None] * 4 + ["c"] * 3 + ["d"])], "k string, i int")
    right = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3), ("d", 4), ("e", 5), (None, 6)], "k string, j int")
    got, want = joins.join_crowded(left, right, "k").collect(), left.join(right, "k").collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, want))


def test_no_task_holds_all_symbols_of_a_file(spark, monkeypatch):
    """All symbols in one file: none of them is shuffled to its task."""
    n, before = 150_000, spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        symbols = spark.range(n).selectExpr("concat('s', id) as id", "'f' as file_id", "'n' as name", "'q' as qualified_name", "'class' as kind", "'csharp' as language")
        files = spark.range(2).selectExpr("if(id = 0, 'f', 'g') as id", "concat('src/', id) as relative_path")
        rels = spark.createDataFrame([], "target_symbol_id string, kind string")
        df = incremental.resolution_snapshot(symbols, files, rels).select("id", "relative_path")
        sizes = df.rdd.glom().map(len).collect()
        assert sum(sizes) == n and max(sizes) < n
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_baseline_drops_files_before_symbols_move(spark):
    """Files that are affected or deleted go before symbols are joined, so symbols are never gathered by path."""
    symbols = spark.createDataFrame([(f"s{i}", f"f{i % 4}", "n", "q", "class", "csharp") for i in range(12)], "id string, file_id string, name string, qualified_name string, kind string, language string")
    files = spark.createDataFrame([(f"f{i}", f"src/{i}") for i in range(4)], "id string, relative_path string")
    rels = spark.createDataFrame([("s2", "exports")], "target_symbol_id string, kind string")
    affected = spark.createDataFrame([("src/0", "batch")], "relative_path string, why string")
    changes = spark.createDataFrame([("src/0", "modified"), ("src/3", "deleted")], "relative_path string, change string")
    got = incremental.resolution_baseline(symbols, files, rels, affected, changes).select("id", "relative_path", "exported").collect()
    assert sorted(map(tuple, got)) == sorted((f"s{i}", f"src/{i % 4}", i == 2) for i in range(12) if i % 4 in (1, 2))
