import uuid

from pyspark.sql import functions as F

from cityhop.llm.exact_stream import exact_duplicates, run_stream, sha256


def expected(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    return sorted((i, max((x for x in groups[t or ""] if x is not None), default=None), len(groups[t or ""])) for i, t in rows if i is not None)


def answers(df):
    return sorted((r["doc_id"], r["keep_id"], r["group_size"]) for r in df.collect() if r["doc_id"] is not None)


ROWS = [(1, "a"), (2, "b"), (9, "a"), (3, None), (4, ""), (5, "A"), (6, "a "), (7, "z" * 300_000), (8, "z" * 300_000), (11, "b"), (12, "é"), (None, "a"), (2, "b")]


def stored(make, tmp_path, rows, partitions=4):
    path = str(tmp_path / f"t{uuid.uuid4().hex}.parquet")
    make(rows, partitions).withColumn("digest", F.lit("x")).withColumn("kept", F.lit(1)).withColumn("value", F.lit(1)).write.parquet(path)
    return path


def test_groups_and_keepers(spark, make, tmp_path):
    path = stored(make, tmp_path, ROWS)
    got = exact_duplicates(spark, path, files_per_trigger=1)  # several micro-batches
    assert answers(got) == expected(ROWS)
    assert all(r["kept"] == (r["doc_id"] == r["keep_id"]) for r in got.collect())


def test_one_file(spark, make, tmp_path):
    folder = stored(make, tmp_path, ROWS, 1)
    file = next(f for f in spark.read.parquet(folder).inputFiles())
    assert answers(exact_duplicates(spark, file)) == expected(ROWS)


def test_equal_digests_are_told_apart_by_bytes(spark, make, tmp_path):
    path = stored(make, tmp_path, ROWS)
    got = exact_duplicates(spark, path, digest=lambda c: F.substring(sha256(c), 1, 0))  # all digests collide
    assert answers(got) == expected(ROWS)


def test_state_goes_on_with_new_files(spark, make, tmp_path):
    path, checkpoint = stored(make, tmp_path, [(1, "a"), (2, "b")]), str(tmp_path / "state")
    assert {r["group_size"] for r in run_stream(spark, path, checkpoint).collect()} == {1}
    make([(3, "a")], 1).withColumn("digest", F.lit("x")).withColumn("kept", F.lit(1)).withColumn("value", F.lit(1)).write.mode("append").parquet(path)
    state = {r["keep_id"]: r for r in run_stream(spark, path, checkpoint).collect()}
    assert {k: r["group_size"] for k, r in state.items()} == {3: 2, 2: 1}
    assert state[3]["locator"]["file"].endswith(".parquet")


def test_empty_table(spark, make, tmp_path):
    assert exact_duplicates(spark, stored(make, tmp_path, [], 1)).collect() == []
