"""Raw files to labeled panel: the rules on absent streams, event times and ties."""

import gzip

import pytest
from pyspark.sql import functions as F

from cadence.operators import labels as L
from cadence.operators import panel as P
from cadence.schemas import FEATURES
from cadence.sources import files, mapping, raw, sinks

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    base = tmp_path_factory.mktemp("repositories")

    def put(repo, stream, header, *rows):
        folder = base / repo
        folder.mkdir(exist_ok=True)
        (folder / f"{stream}.csv").write_text("\n".join([header, *rows]) + "\n")

    put(
        "a__x", "commits", "sha,author_date,author_login,comment_count",
        "1,2020-01-05T00:00:00Z,ann,", "2,2020-03-31T23:59:59Z,,", "3,garbage,bob,1", "4,,bob,1",
        "5,2020-07-01 10:00:00,bob,4",
    )
    put(
        "a__x", "issues", "created_at,closed_at,state,comments,user_login",
        "2020-01-10T00:00:00Z,2020-08-01T00:00:00Z,closed,3,cat", "bad,2020-08-02T00:00:00Z,closed,9,dan",
    )
    put(
        "a__x", "pull_requests", "created_at,merged_at,closed_at,state,comments,user_login",
        "2020-01-01T00:00:00Z,2020-01-02T00:00:00Z,2020-01-02T00:00:00Z,closed,0,eve",
        "2020-01-01T00:00:00Z,,2020-01-03T00:00:00Z,closed,1,eve",
    )
    put("a__x", "stargazers", "starred_at,user_login", "2020-01-01T00:00:00Z,fay")
    put(
        "a__x", "repository", "forks_count,fetched_at",
        "5,2020-01-01T00:00:00Z", "7,2020-02-01T00:00:00Z", "6,2020-02-01T00:00:00Z", ",2020-03-01T00:00:00Z",
    )
    put("b__y", "commits", "sha,author_date,author_login,comment_count", '1,2021-05-01T00:00:00Z,"a, ""b""",2')
    put("b__y", "stargazers", "starred_at,user_login", "nonsense,fay")
    return str(base)


@pytest.fixture(scope="module")
def panel(spark, root):
    return {
        (r["repo_id"], r["year"], r["quarter"]): r
        for r in P.panel_from_streams(raw.scan_streams(spark, root)).collect()
    }


def test_quarters_and_event_times(panel):
    assert set(panel) == {("a__x", 2020, 1), ("a__x", 2020, 3), ("b__y", 2021, 2)}
    first, third = panel["a__x", 2020, 1], panel["a__x", 2020, 3]
    assert (first.commit_count, third.commit_count) == (2, 1)
    assert (first.issue_count, first.issue_closed, third.issue_count, third.issue_closed) == (1, 0, 0, 2)
    assert (first.pr_count, first.pr_merged) == (2, 1)
    assert (first.total_contributors, third.total_contributors) == (1, 1)


def test_absent_stream_is_null_and_quiet_quarter_is_zero(panel):
    assert panel["a__x", 2020, 3].star_count == 0
    assert panel["a__x", 2020, 3].fork_count == 0
    lone = panel["b__y", 2021, 2]
    assert (lone.star_count, lone.issue_count, lone.pr_count, lone.fork_count) == (None, None, None, None)
    assert (lone.commit_count, lone.total_contributors) == (1, 1)


def test_latest_snapshot_skips_null_and_breaks_ties(panel):
    assert panel["a__x", 2020, 1].fork_count == 7


def test_null_comments_and_logins(spark, root):
    row = P.quarterly_commits(raw.scan_commits(spark, root)).filter("repo_id = 'a__x' and quarter = 1").first()
    assert (row.commit_count, row.commit_authors, row.commit_comments) == (2, 1, 0)
    closed = P.quarterly_prs_closed_unmerged(raw.scan_pull_requests(spark, root)).collect()
    assert [(r.quarter, r.pr_closed_unmerged) for r in closed] == [(1, 1)]


def test_missing_files_and_columns_give_nothing(spark, root, tmp_path):
    assert raw.scan_commits(spark, str(tmp_path)).count() == 0
    folder = tmp_path / "r__z"
    folder.mkdir()
    (folder / "repository.csv").write_text("forks_count,updated_at\n3,2020-01-01\n")
    assert raw.scan_repository_snapshots(spark, str(tmp_path)).count() == 0


HEADERS = {
    "r0": "user_name,starred_at\nzed,2019-01-01\n",  # the first file lacks a required column
    "r1": "starred_at,user_login\n2020-01-01,ann\nx,amy\n,al\n",
    "r2": "user_login,starred_at\nbob,2021-01-01\n",
    "r3": 'user_login,note,starred_at\ncyd,"two\nlines",2022-01-01\n',
    "r4 +é": "starred_at,user_login\n2023-01-01,dan\n",
    "r5": "",
}


@pytest.fixture
def stargazers(tmp_path):
    for repo, text in HEADERS.items():
        (tmp_path / repo).mkdir()
        (tmp_path / repo / "stargazers.csv").write_text(text)
    return str(tmp_path)


def test_every_file_is_read_under_its_own_header(spark, stargazers):
    rows = raw.scan_stargazers(spark, stargazers).orderBy("repo_id").collect()
    assert [(r.repo_id, r.user_login, r.starred_at.year) for r in rows] == [
        ("r1", "ann", 2020), ("r2", "bob", 2021), ("r3", "cyd", 2022), ("r4 +é", "dan", 2023),
    ]


def test_scan_report_names_what_was_left_out(spark, stargazers):
    found = {r.path.split("/")[-2][:2]: (r.status, r.rows, r.rejected) for r in raw.scan_report(spark, stargazers, "stargazers").collect()}
    assert found == {
        "r0": ("missing columns: user_login", 0, 0), "r1": ("ok", 3, 1), "r2": ("ok", 1, 0), "r3": ("ok", 1, 0),
        "r4": ("ok", 1, 0), "r5": ("could not read file", 0, 0),
    }


def test_repo_limit_reads_the_first_directories_only(spark, stargazers):
    assert [p.split("/")[-2] for p in raw.stream_paths(spark, stargazers, "stargazers", repo_limit=3)] == ["r0", "r1", "r2"]
    assert {r.repo_id for r in raw.scan_streams(spark, stargazers, repo_limit=3)["stargazers"].collect()} == {"r1", "r2"}


def test_files_cut_off_after_the_header(spark, tmp_path):
    whole = "starred_at,user_login\n" + "".join(f"2020-01-0{i % 9 + 1},user{i}\n" for i in range(5000))
    packed = gzip.compress(whole.encode())
    texts = {
        "a": whole.encode(), "b": whole[:-35].encode(), "c": (whole + '2020-01-01,"open\n').encode(),
        "d": b"starred_at,user_login\n2020-01-01\n2020-01-01,x,y\n\n2020-01-02,\xff\n", "e": b"starred_at,user_login", "f": b"\x00\x01",
    }
    for repo, data in texts.items():
        (tmp_path / repo).mkdir()
        (tmp_path / repo / "stargazers.csv").write_bytes(data)
    found = {r.path.split("/")[-2]: (r.status, r.rows) for r in raw.scan_report(spark, str(tmp_path), "stargazers").collect()}
    assert found["a"] == ("ok", 5000) and found["e"] == ("ok", 0) and found["d"] == ("ok", 3)
    assert found["b"][0] == "last row incomplete" and found["c"][0] != "ok" and found["f"][0] != "ok"
    rows = raw.scan_stargazers(spark, str(tmp_path)).filter("repo_id = 'd'").collect()
    assert sorted(str(r.user_login) for r in rows) == ["None", "x", "\ufffd"]
    cut = tmp_path / "cut.csv.gz"
    cut.write_bytes(packed[: len(packed) // 2])
    inventory = {r.path.rsplit("/", 1)[1]: r.status for r in files.file_inventory(spark, str(tmp_path)).collect()}
    assert inventory["cut.csv.gz"] != "ok"


def test_large_files_are_read_in_pieces(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(raw, "PIECE_BYTES", 1000)
    (tmp_path / "r").mkdir()
    rows = [f"2020-01-01 00:00:{i % 60:02d},user{i}" for i in range(900)]
    (tmp_path / "r" / "stargazers.csv").write_text("\n".join(["starred_at,user_login", *rows]))
    pieces = raw.file_pieces(spark, raw.stream_paths(spark, str(tmp_path), "stargazers"), multi_line=False)
    assert pieces.count() > 20
    found = raw.scan_stargazers(spark, str(tmp_path), multi_line=False)
    assert sorted(r.user_login for r in found.collect()) == sorted(f"user{i}" for i in range(900))
    report = raw.scan_report(spark, str(tmp_path), "stargazers", multi_line=False).collect()
    assert [(r.status, r.rows) for r in report] == [("ok", 900)]


def test_scan_reads_no_file_on_the_driver(spark, stargazers):
    plan = raw.scan_stargazers(spark, stargazers)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan binaryFile") == 1 and "content" not in plan and "Exchange" not in plan


def test_one_pass_panel_equals_stream_joins(spark):
    one = mapping.panel(spark, SF)
    many = P.panel_from_streams(mapping.streams(spark, SF), mapping.SNAPSHOT_TIE_BREAK)
    assert one.count() == 280
    assert one.exceptAll(many).count() == 0 and many.exceptAll(one).count() == 0


def test_labels_on_ties_and_missing_scores(spark):
    rows = [("a", 2020, q, v) for q, v in ((1, 1), (2, 2), (3, 3), (4, 4))]
    rows += [("a", 2021, 1, 10), ("b", 2021, 1, None)]
    panel = spark.createDataFrame(rows, "repo_id string, year int, quarter int, commit_count long")
    scored = L.activity_score(panel)
    assert L.percentile_threshold(scored, 0.6).first().threshold == pytest.approx(3.4)
    labels = {(r.repo_id, r.year, r.quarter): r.is_active for r in L.label_activity(panel, 0.75).collect()}
    assert labels["a", 2020, 4] == 1  # the score equals the threshold
    assert labels["a", 2020, 3] == 0 and labels["b", 2021, 1] == 0
    with pytest.raises(ValueError):
        L.percentile_threshold(scored, 0.4)


def test_score_weights(spark):
    one = spark.createDataFrame([tuple([1] * 8)], ", ".join(f"{c} long" for c in FEATURES))
    assert L.activity_score(one).first().activity_score == 7.3


def test_sinks_and_scans_round_trip(spark, tmp_path):
    panel = mapping.panel(spark, SF)
    sinks.write_panel(panel, f"{tmp_path}/panel")
    assert files.read_panel(spark, f"{tmp_path}/panel.parquet").exceptAll(panel).count() == 0
    assert files.scan_file(spark, f"{tmp_path}/panel.csv", "csv").count() == 280
    parts = [
        [(r.repo_id, r.year, r.quarter) for r in spark.read.parquet(str(p)).collect()]
        for p in sorted((tmp_path / "panel.parquet").glob("part-*"))
    ]
    assert sum(parts, []) == sorted(sum(parts, []))


def test_mixed_formats_and_inventory(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x,y\n1,"two\nlines"\n')
    (tmp_path / "b.tsv").write_text("x\ty\n1\t2\n3\t4\n")
    (tmp_path / "c.jsonl").write_text('{"k": 1}\n{"k": 2}\n')
    (tmp_path / "d.json").write_text('[\n {"k": 1, "m": 2},\n {"k": 3}\n]\n')
    (tmp_path / "f.txt").write_text("no reader")
    (tmp_path / "g.json").write_text('{"k": 1}\n{"k": 2}\n{"k": \n{"k": 3}\n')
    (tmp_path / "h.parquet").write_text("not parquet")
    (tmp_path / "i.json").write_text("7\n")
    with gzip.open(tmp_path / "e.csv.gz", "wt") as out:
        out.write("p,q,r\n1,2,3\n")
    counts = {n: files.scan_file(spark, f"{tmp_path}/{n}").count() for n in ("a.csv", "b.tsv", "c.jsonl", "d.json", "e.csv.gz")}
    assert counts == {"a.csv": 1, "b.tsv": 2, "c.jsonl": 2, "d.json": 2, "e.csv.gz": 1}
    found = {r.path.rsplit("/", 1)[1]: r for r in files.file_inventory(spark, str(tmp_path)).collect()}
    assert found["f.txt"].status == "no reader" and found["f.txt"].rows is None
    assert (found["a.csv"].rows, found["a.csv"].columns) == (1, 2)
    assert (found["e.csv.gz"].rows, found["e.csv.gz"].columns) == (1, 3)
    assert (found["d.json"].rows, found["d.json"].columns, found["d.json"].status) == (2, 2, "ok")
    assert (found["g.json"].rows, found["g.json"].status) == (3, "1 unreadable lines")
    assert files.scan_file(spark, f"{tmp_path}/g.json").count() == 3
    assert found["h.parquet"].status == "could not read file" and found["c.jsonl"].rows == 2
    with pytest.raises(ValueError):
        files.scan_file(spark, f"{tmp_path}/f.txt")


def test_many_directories_are_listed_and_written_by_tasks(spark, tmp_path, monkeypatch):
    """One file per repository whatever its name, and the same report as Spark's own listing gives."""
    names = [f"r{i}" for i in range(30)] + ["a/b:c=%d", "x y", "é", None]
    texts = [(n, f"2020-01-{i % 28 + 1:02d}", t) for i, n in enumerate(names) for t in ("u,1", None, "", 'q"q', "two\nlines")]
    rows = spark.createDataFrame(texts, "repo_id string, starred_at string, user_login string")
    for _ in range(2):  # again over what is there
        raw.write_raw(rows, f"{tmp_path}/stargazers")
    folders = sorted(p.name for p in (tmp_path / "stargazers").iterdir())
    rows.write.partitionBy("repo_id").csv(f"{tmp_path}/own")
    assert folders == sorted(p.name for p in (tmp_path / "own").iterdir() if p.is_dir())
    assert all(len(list((tmp_path / "stargazers" / f).iterdir())) == 1 for f in folders)
    (tmp_path / "stargazers" / "empty").mkdir()
    (tmp_path / "stargazers" / "empty" / "part.csv").write_text("")
    (tmp_path / "stargazers" / "empty" / "_hidden.csv").write_text("starred_at,user_login\n2020-01-01,x\n")
    (tmp_path / "stargazers" / "beside.csv").write_text("starred_at,user_login\n2020-01-01,x\n")
    found = {}
    for readers in (200, 3):
        monkeypatch.setattr(raw, "READERS", readers)
        scan = raw.scan_stargazers(spark, str(tmp_path), layout=raw.WRITTEN_LAYOUT)
        report = raw.scan_report(spark, str(tmp_path), "stargazers", layout=raw.WRITTEN_LAYOUT)
        plan = scan._jdf.queryExecution().executedPlan().toString()
        assert ("binaryFile" in plan) == (readers == 200)
        found[readers] = sorted(map(str, scan.collect())), sorted(map(str, report.collect()))
        kept = {(r.repo_id, r.user_login) for r in scan.collect()}
        assert {t for n, t in kept if n == "x y"} == {"u,1", None, "", 'q"q', "two\nlines"}
        assert len(scan.collect()) == len(texts)
    assert found[200] == found[3]
    assert raw.scan_stargazers(spark, f"{tmp_path}/nothing", layout=raw.WRITTEN_LAYOUT).count() == 0


def test_a_cell_reaches_the_second_grouping_in_few_rows(spark):
    """However many tasks group the actors, they hand on at most SPREAD partial rows of a cell."""
    made = spark.range(6000, numPartitions=12).select(
        F.concat(F.lit("r"), F.col("id") % 1).alias("repo_id"), F.when(F.col("id") % 3 == 0, 7).otherwise(1).cast("tinyint").alias("kind"),
        F.timestamp_seconds(1578182400 + F.col("id") % 1000).alias("ts"),
        F.when(F.col("id") % 3 != 0, (F.col("id") % 500).cast("string")).alias("actor"), F.lit(1).cast("long").alias("comments"),
    )
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        counted = P.actor_partials(made).rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
        assert 1 < sum(n > 0 for n in counted) <= P.SPREAD and sum(counted) <= 500 + P.SPREAD
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    row = P.quarterly_activity(made).first()
    assert (row.commit_count, row.commit_authors, row.star_count, row.star_users, row.commit_comments) == (4000, 500, 2000, 0, 4000)


def test_many_lines_are_grouped_in_more_tasks(spark, tmp_path, monkeypatch, capsys):
    """The tasks that group actors grow with the lines, so that a task's groups stay few; rows stay the same."""
    day = "timestamp_ntz'2020-01-15' + make_dt_interval(int(id % 200))"
    spark.range(4000, numPartitions=3).selectExpr(
        "if(id % 53 = 0, NULL, id % 900) AS l_orderkey", "id % 23 AS l_partkey", "if(id % 31 = 0, NULL, id % 12) AS l_suppkey", "int(id % 7) AS l_linenumber",
        "double(id % 5) AS l_quantity", "double(id) AS l_extendedprice", "(id % 11) / 100 AS l_discount", "0.0D AS l_tax",
        "element_at(array('A', 'N', 'R'), int(id % 3) + 1) AS l_returnflag", "if(id % 3 = 0, 'F', 'O') AS l_linestatus", f"{day} AS l_shipdate",
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(1000).selectExpr("id % 800 AS o_orderkey", "id % 9 AS o_custkey", f"{day} AS o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    sf = str(tmp_path)
    assert mapping.tasks_for_events(spark, sf) is None
    few = mapping.panel(spark, sf).collect()
    monkeypatch.setattr(mapping, "LINES_A_TASK", 300)
    assert mapping.tasks_for_events(spark, sf) == 14
    assert P.actor_partials(mapping.panel_events(spark, sf), 14).rdd.getNumPartitions() == 14
    many = mapping.panel(spark, sf)
    many.explain()
    assert ", 14), REPARTITION_BY_NUM" in capsys.readouterr().out
    assert sorted(many.collect(), key=str) == sorted(few, key=str) and few


def test_panel_of_two_rows_a_line_equals_that_of_all_events(spark, tmp_path):
    """Ends and stars ride on commits and openings; NULLs, repeated orders and lines count as they do in single events."""
    day = "timestamp_ntz'2020-01-15' + make_dt_interval({})"
    lines = spark.range(400, numPartitions=3).selectExpr(
        "id % 90 AS l_orderkey", "if(id % 29 = 0, NULL, id % 23) AS l_partkey", "if(id % 31 = 0, NULL, id % 12) AS l_suppkey",
        "if(id % 37 = 0, NULL, int(id % 7)) AS l_linenumber", "double(id % 5) AS l_quantity", "double(id) AS l_extendedprice",
        "if(id % 17 = 0, NULL, (id % 11) / 100) AS l_discount", "0.0D AS l_tax", "element_at(array('A', 'N', 'R', NULL), int(id % 4) + 1) AS l_returnflag",
        "if(id % 3 = 0, 'F', 'O') AS l_linestatus", f"if(id % 41 = 0, NULL, {day.format('id')}) AS l_shipdate",
    )
    orders = spark.range(100).selectExpr("id % 80 AS o_orderkey", "if(id % 13 = 0, NULL, id % 9) AS o_custkey", f"if(id % 19 = 0, NULL, {day.format('id * 3')}) AS o_orderdate")
    lines.unionAll(lines.filter("l_orderkey % 10 = 0")).write.parquet(f"{tmp_path}/lineitem.parquet")
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    sf = str(tmp_path)
    forks = P.latest_snapshot(mapping.snapshots(spark, sf), mapping.SNAPSHOT_TIE_BREAK)
    single, packed = mapping.events(spark, sf), mapping.panel_events(spark, sf)
    assert packed.count() == single.filter("kind IN (1, 2, 4)").count() < single.count()
    wanted = P.activity_panel(single, forks)
    got = mapping.panel(spark, sf)
    assert got.schema == wanted.schema
    assert sorted(got.collect(), key=str) == sorted(wanted.collect(), key=str)


def test_riders_count_as_events_of_their_own(spark):
    made = spark.createDataFrame(
        [(1, 1, 3, 7, 5), (1, 1, 3, 7, 2), (1, 1, None, 7, None), (1, 2, 7, None, None), (2, 4, None, 8, 1), (2, 3, None, None, None)],
        "repo_id long, kind tinyint, also tinyint, actor long, comments long",
    ).withColumn("ts", F.lit("2020-02-01").cast("timestamp"))
    rows = {r.repo_id: r for r in P.quarterly_activity(made).collect()}
    one, two = rows[1], rows[2]
    assert (one.commit_count, one.commit_authors, one.commit_comments, one.issue_count, one.issue_closed, one.star_count) == (3, 1, 7, 1, 2, 1)
    assert (two.pr_count, two.pr_merged, two.issue_count, two.issue_closed) == (1, 0, 0, 1)
    assert (one.pr_count, two.commit_count, two.star_count) == (None, None, None)


def test_events_may_carry_their_quarter(spark):
    """Events with ``period`` in place of ``ts`` give the same rows, also in years before 1."""
    days = ["2020-02-01", "2020-03-31", "2020-04-01", "0001-01-01", "-0003-05-01"]
    made = spark.createDataFrame([(i % 2, 1, d, i % 3, 1) for i, d in enumerate(days * 4)], "repo_id long, kind tinyint, day string, actor long, comments long")
    timed = made.withColumn("ts", F.col("day").cast("timestamp_ntz")).drop("day")
    dated = timed.withColumn("period", F.year("ts") * 4 + F.quarter("ts") - 1).drop("ts")
    wanted, got = P.actor_partials(timed), P.actor_partials(dated)
    assert wanted.schema == got.schema and wanted.filter("period < 0").count()
    assert sorted(wanted.collect()) == sorted(got.collect())
    counted = timed.groupBy("repo_id", F.year("ts").alias("year"), F.quarter("ts").alias("quarter")).agg(F.count("*").alias("commit_count"), F.count_distinct("actor").alias("commit_authors"))
    assert sorted(P.quarterly_activity(dated).select(counted.columns).collect()) == sorted(counted.collect())
