"""Hand-made cases for the keep/fix decisions, and partition independence."""

from pyspark.sql import functions as F

from conftest import SF_SMALL


def test_log_line_author_with_bar_shifts_fields(spark):
    # kept behaviour: split on the first four bars only
    from corpusflow.operators.commits import parse_log_lines

    df = spark.createDataFrame([("r", "abc|p1 p2|ann|bot|2024-01-01T00:00:00+00:00|fix it"), ("r", "short|x")],
                               "repo string, log_line string")
    good, bad = parse_log_lines(df)
    r = good.first()
    assert (r.sha, r.parent_sha, r.author, r.authored_at) == ("abc", "p1", "ann", "bot")
    assert r.message == "2024-01-01T00:00:00+00:00|fix it"
    assert bad.count() == 1


def test_merge_prefix_rule(spark):
    from corpusflow.operators.commits import is_merge

    df = spark.createDataFrame([("Merge branch x",), ("merge pull request",), ("Merged things",), ("fix merge ",)],
                               "m string")
    assert [r.x for r in df.select(is_merge(F.col("m")).alias("x")).collect()] == [True, True, False, False]


def test_empty_expected_is_exact_but_not_substring(spark):
    from corpusflow.operators.scoring import score

    df = spark.createDataFrame([(1, "c", "v", "", "anything"), (2, "c", "v", "Paris", " paris is nice")],
                               "example_id long, category string, variant string, expected string, generated string")
    rows = {r.example_id: r for r in score(df).collect()}
    assert rows[1].exact and not rows[1].substring
    assert rows[2].exact and rows[2].substring and not rows[2].strict


def test_clear_progress_empty_tier_matches_nothing(spark):
    from corpusflow.operators.bands import clear_progress

    p = spark.createDataFrame([("mainstream", "python", 50, None, 3)],
                              "tier string, language string, star_range_low int, star_range_high int, repos_found long")
    assert clear_progress(p, "")[1].first().removed == 0
    assert clear_progress(p, None)[1].first().removed == 1


def test_progress_leaves_out_processing(spark):
    from corpusflow.operators.reports import data_totals, progress

    c = spark.createDataFrame([("a", "processing", None, None), ("b", "downloaded", None, None),
                               ("c", "pending", 10, 2)],
                              "full_name string, status string, actual_size_bytes long, commit_count long")
    p = progress(c).first()
    assert p.total_repos == 2 and p.processing == 1 and p.completed == 1 and p.progress_percent == 50.0
    t = data_totals(c).first()
    assert (t.total_repos_with_data, t.total_size_bytes, t.total_commits) == (1, 0, 0)


def test_global_census_keeps_broad_result(spark):
    # fix: the first broad page is kept (union), not replaced by the ranges
    from corpusflow.operators.bands import global_census

    rows = [(f"o/r{i}", 100 + i * 7, False) for i in range(2500)]
    snap = spark.createDataFrame(rows, "full_name string, stars int, fork boolean").withColumn("language", F.lit("x"))
    got = {r.full_name for r in global_census(snap, min_stars=100, target=100000, cap=1000).collect()}
    top1000 = {f"o/r{i}" for i in range(1500, 2500)}
    assert top1000 <= got


def test_partition_independence(spark):
    from corpusflow.plans.registry import all_queries

    qs = all_queries()
    keys = ["cat_apply_transitions", "bnd_census", "ret_doc_scores", "tok_batches", "com_shuffled"]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        results = {}
        for n in (1, 2, 8):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            for k in keys:
                rows = sorted(map(repr, qs[k].fn(spark, SF_SMALL).collect()))
                results.setdefault(k, []).append(rows)
        for k, runs in results.items():
            assert runs[0] == runs[1] == runs[2], k
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_every_changed_file_is_looked_up_at_the_parent(spark, inputs):
    from conftest import SF_SMALL
    from corpusflow.plans.registry import all_queries
    from oracle_harness import check, duck_con

    blobs = {(r["repo"], r["sha"], r["path"]): r["content"] for r in inputs["blobs"].collect()}
    want = {(r["repo"], r["parent_sha"], path) for r in inputs["commits"].collect() if r["parent_sha"]
            for path in (r["files_text"] or "").split("\n") if path}
    query = all_queries()["src_files_at_parent"]
    got = query.fn(spark, SF_SMALL).collect()
    assert sorted((r["repo"], r["sha"], r["path"]) for r in got) == sorted(want)
    assert all(r["content"] == blobs.get((r["repo"], r["sha"], r["path"])) for r in got)
    assert check(spark, duck_con(SF_SMALL), "src_files_at_parent", query, SF_SMALL)["status"] == "ok"
