from skeinwork.operators import text, topk
from skeinwork.sources import files, sinks
from skeinwork.streaming import counts


def write(path, content):
    path.write_text(content)
    return str(path)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_readers(spark, tmp_path):
    f = lambda name, content: write(tmp_path / name, content)
    assert rows(files.ratings(spark, f("r", "3,7,5,2005-01-01\n\nbad\n4,8,1\n"))) == [(0, 3, 7, 5.0), (3, 4, 8, 1.0)]
    assert rows(files.query_pairs(spark, f("q", "3,7\n1,2,x\n"))) == [(0, 3, 7), (1, 1, 2)]
    assert rows(files.vectors(spark, f("v", "5:2 6:1\n\n7:3\n"))) == [(0, 5, 2), (0, 6, 1), (2, 7, 3)]
    assert rows(files.dictionary(spark, f("d", "sakharov 11218\nword 0\n"))) == [("sakharov", 11218), ("word", 0)]
    assert rows(files.document_frequencies(spark, f("df", "0:166\n1:3\n"))) == [(0, 166), (1, 3)]
    assert rows(files.clusters(spark, f("c", "0 4\n1 5\n"))) == [(0, 4), (1, 5)]
    assert rows(files.gold(spark, f("g", "A\nunlabeled\nB\n"))) == [(0, "A"), (2, "B")]
    assert rows(files.edges(spark, f("e", "1 2 1\n1 2 1\n3 1\n"))) == [(1, 2), (1, 2), (3, 1)]
    assert rows(files.distribution(spark, f("t", "2 1 1:0.25 9:0.75\n"))) == [("2-1", 2, 1, 1, 0.25), ("2-1", 2, 1, 2, 0.75)]
    assert rows(files.document_topics(spark, f("dt", "5 1\n6 2\n"))) == [(5, 1), (6, 2)]
    assert rows(files.values(spark, f("s", "1.5\nx\n"))) == [(0, 1.5), (1, None)]
    assert rows(files.stop_list(spark, f("st", "a an\nthe a\n"))) == [("a",), ("an",), ("the",)]
    assert rows(files.cleaned(spark, f("cl", "5\tgood food\n"))) == [(0, 5, "good food")]
    assert rows(files.coded(spark, f("co", "5\t1 2 2\n1\t\n"))) == [(0, 5, [1, 2, 2]), (1, 1, [])]
    assert rows(files.reviews(spark, f("j", '{"stars": 4, "text": "ok"}\nnope\n{"text": "x", "review_id": "r1"}\n'))) == [(0, 4, "ok", None), (2, None, "x", "r1")]
    lists = tmp_path / "lists"
    lists.mkdir()
    write(lists / "12-1.results.txt", "0 Q0 22401 1 -3.35914 indri\n")
    write(lists / "other.txt", "0 Q0 1 1 -1 indri\n")
    assert rows(files.run_lists(spark, str(lists))) == [("12-1", 22401, 1, -3.35914, "indri")]
    assert files.exists(spark, str(lists)) and not files.exists(spark, str(tmp_path / "none"))
    assert files.constant_matrix(spark, 2, 3).count() == 6
    assert rows(files.random_matrix(spark, 5, 5, density=0.5, seed=1)) == rows(files.random_matrix(spark, 5, 5, density=0.5, seed=1).repartition(3))


def test_line_numbers_of_split_files(spark, tmp_path):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        path = write(tmp_path / "long", "".join(f"{k} {'x' * (k % 60)}\n" for k in range(3000)))
        assert all(r["pos"] == int(r["value"].split(" ")[0]) for r in files.lines(spark, path).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_sinks(spark, tmp_path):
    def lines_of(name):
        return [r["value"] for r in files.lines(spark, str(tmp_path / name)).orderBy("pos").collect()]

    scores = spark.createDataFrame([(1, 2.5), (0, 3.0)], "pos long, s double")
    sinks.write_scores(scores, str(tmp_path / "scores"), "s")
    assert lines_of("scores") == ["3.000000", "2.500000"]
    sinks.write_clusters(spark.createDataFrame([(1, 5), (0, 4)], "doc_id long, cluster_id long"), str(tmp_path / "clusters"))
    assert lines_of("clusters") == ["0 4", "1 5"]
    sinks.write_rank(spark.createDataFrame([(1, 0.25), (2, 0.5)], "doc_id long, r double"), str(tmp_path / "rank"))
    assert lines_of("rank") == ["2 0.5", "1 0.25"]
    sinks.write_dictionary(spark.createDataFrame([("b", 1), ("a", 0)], "token string, idx int"), str(tmp_path / "dict"))
    assert lines_of("dict") == ["a 0", "b 1"]
    sinks.write_cleaned(spark.createDataFrame([(0, 5, "a\tb\nc")], "pos long, stars int, text string"), str(tmp_path / "clean"))
    assert lines_of("clean") == ["5\ta b c"]
    sinks.write_coded(spark.createDataFrame([(0, 5, [3, 1])], "pos long, stars int, ids array<int>"), str(tmp_path / "coded"))
    assert lines_of("coded") == ["5\t3 1"]
    sinks.write_classes(spark.createDataFrame([(0, 5, 4.5)], "pos long, hard int, soft double"), str(tmp_path / "classes"))
    assert lines_of("classes") == ["5 4.500000"]
    sinks.write_report(spark.createDataFrame([(3, None)], "users long, average double"), str(tmp_path / "report"))
    assert lines_of("report") == ["users: 3", "average: none"]
    assert rows(sinks.write_table(scores, str(tmp_path / "table"))) == [(0, 3.0), (1, 2.5)]


def test_streams(spark, data, tmp_path):
    batch = spark.read.parquet(f"{data}/documents.parquet")
    (tmp_path / "in").mkdir()
    batch.repartition(3).write.mode("overwrite").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    counts.run_available(counts.label_counts(stream, "stars"), "stars_so_far", str(tmp_path / "c1"))
    assert rows(spark.table("stars_so_far")) == rows(text.label_histogram(batch, "stars"))
    counts.run_available(counts.term_counts(stream), "terms_so_far", str(tmp_path / "c2"))
    assert rows(spark.table("terms_so_far")) == rows(text.vocabulary_counts(text.term_frequency(text.tokenize(batch, stop_words=()))).select("token", "ctf", "df"))
    timed = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in")).selectExpr("*", "cast(posted_at as timestamp) as at")
    counts.run_available(counts.windowed_counts(timed, "at", "source"), "by_day", str(tmp_path / "c3"), mode="append")
    assert spark.table("by_day").count() >= 0


def test_small_helpers(spark):
    df = spark.createDataFrame([(1, 5, 0.5), (1, 4, 0.5), (2, 9, 0.1)], "k int, c int, v double")
    assert rows(topk.arg_best(df, "k", "c", "v")) == [(1, 4), (2, 9)]
    assert topk.sample(df, "c", 2, 1).count() == 2
    assert [r["rank"] for r in topk.top_k(df, ["k"], 1, [df["v"].desc(), df["c"].asc()]).collect()] == [1, 1]
