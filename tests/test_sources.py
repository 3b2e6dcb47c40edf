"""Readers and writers on small files."""

from __future__ import annotations

import pytest

from glossaria.sources import corpora, results

LINES = {"fin_Latn": ["Hei  ", "", "kolme"], "zho_Hans": ["一", "二"], "srp_Cyrl": [" да", "ne", "", ""]}


@pytest.fixture
def folder(tmp_path):
    for lang, lines in LINES.items():
        (tmp_path / f"{lang}.dev").write_text("\n".join(lines) + "\n", encoding="utf-8")
    (tmp_path / "ignored.txt").write_text("x\n")
    return str(tmp_path)


def test_read_parallel_corpus(spark, folder):
    got = corpora.read_parallel_corpus(spark, folder, corpus="dev").collect()
    found = {(r.language, r.sentence_id): r.text for r in got}
    assert found == {(lang, i): t.strip() for lang, lines in LINES.items() for i, t in enumerate(lines)}
    assert {r.corpus for r in got} == {"dev"}


def test_line_numbers_across_splits(spark, tmp_path):
    for lang, n in (("aaa_Latn", 5000), ("bbb_Latn", 3000)):
        (tmp_path / f"{lang}.dev").write_text("".join(f"{lang} line {i}\n" for i in range(n)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8000")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    try:
        df = corpora.read_parallel_corpus(spark, str(tmp_path))
        assert df.rdd.getNumPartitions() > 5
        got = [(r.language, r.sentence_id, r.text) for r in df.collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.set("spark.sql.files.openCostInBytes", cost)
    assert len(got) == 8000
    assert all(text == f"{lang} line {i}" for lang, i, text in got)


def test_newstest_layout(spark, tmp_path):
    (tmp_path / "newstest2019-ref.srp-Cyrl.txt").write_text("а\r\nб\r\n", encoding="utf-8")
    (tmp_path / "newstest2019-src.eng.txt").write_text("a\nb\n")
    got = corpora.read_parallel_corpus(spark, str(tmp_path), "newstest").collect()
    assert sorted((r.language, r.sentence_id, r.text) for r in got) == [
        ("eng", 0, "a"), ("eng", 1, "b"), ("srp-Cyrl", 0, "а"), ("srp-Cyrl", 1, "б"),
    ]


def test_split_tables(spark, tmp_path):
    (tmp_path / "ace").mkdir()
    (tmp_path / "ace" / "train.csv").write_text('text,label\n"a, ""b""\nc",positive\n')
    (tmp_path / "ace" / "test.csv").write_text("text,label\nd,neutral\n")
    got = corpora.read_split_tables(spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in got) == [('a, "b"\nc', "positive", "ace", "train"), ("d", "neutral", "ace", "test")]


def test_unpivot_drops_nulls(spark, rows):
    df = spark.createDataFrame([(0, "x", "y", 7), (1, None, "z", 8)], "sentence_id long, ace string, ban string, idx long")
    long = corpora.unpivot_parallel_table(df, drop=("idx",))
    assert rows(long) == [(0, "ace", "x"), (0, "ban", "y"), (1, "ban", "z")]
    assert rows(corpora.unpivot_parallel_table(df, drop=("idx",), shuffle_seed=3)) == rows(long)


def test_tsv_to_jsonl(spark, tmp_path):
    (tmp_path / "in.tsv").write_text('a "q"\tb\nc\td\n')
    results.tsv_to_jsonl(spark, str(tmp_path / "in.tsv"), str(tmp_path / "out"), "k1", "k2")
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == [
        '{"k1":"a \\"q\\"","k2":"b"}', '{"k1":"c","k2":"d"}',
    ]
    (tmp_path / "bad.tsv").write_text("a\tb\tc\n")
    with pytest.raises(Exception, match="expected 2 fields"):
        results.tsv_to_jsonl(spark, str(tmp_path / "bad.tsv"), str(tmp_path / "out2"), "k1", "k2")


def test_concat_result_files(spark, tmp_path):
    schema = spark.createDataFrame([("a-b", 1)], "language_pair string, n long").schema
    for run, n in (("x", 1), ("y", 2)):
        (tmp_path / run).mkdir()
        (tmp_path / run / "metrics.csv").write_text(f"language_pair,n\n{run}-z,{n}\n")
        (tmp_path / run / "other.csv").write_text("language_pair,n\nq,9\n")
    got = results.concat_result_files(spark, str(tmp_path), "metrics.csv", schema).collect()
    assert sorted(tuple(r) for r in got) == [("x-z", 1), ("y-z", 2)]


@pytest.mark.parametrize("fmt", ["tsv", "csv", "json", "parquet"])
def test_write_results(spark, tmp_path, fmt):
    df = spark.createDataFrame([("a\tb,c", 1.5)], "name string, value double")
    path = str(tmp_path / fmt)
    results.write_results(df, path, fmt)
    reader = spark.read.schema(df.schema).option("header", "true").option("sep", "\t" if fmt == "tsv" else ",")
    assert reader.format("csv" if fmt in ("tsv", "csv") else fmt).load(path).collect() == df.collect()


def test_save_and_load_prunes_by_language(spark, tmp_path):
    df = spark.createDataFrame([("fin", 0, "a"), ("swe", 0, "b")], "language string, sentence_id long, text string")
    corpora.save_dataset(df, str(tmp_path / "d"))
    one = corpora.load_dataset(spark, str(tmp_path / "d")).where("language = 'fin'")
    assert [r.text for r in one.collect()] == ["a"]
    assert len(one.inputFiles()) >= 1
    assert "PartitionFilters: [isnotnull(language" in one._jdf.queryExecution().toString()


def test_language_scripts(spark, rows):
    codes = spark.createDataFrame([("zho_Hant",), ("zho_Hans",), ("fin_Latn",)], "language string")
    assert rows(corpora.language_scripts(codes)) == [("fin", ["Latn"]), ("zho", ["Hans", "Hant"])]


def test_line_numbers_over_files_of_a_language(spark, tmp_path):
    data = [(lang, i, f"{lang} {i}") for lang, n in (("x", 900), ("y", 41)) for i in range(n)]
    df = spark.createDataFrame(data, "language string, sentence_id long, text string").repartition(7)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # keeps several ranges
    try:
        corpora.write_parallel_corpus(df, str(tmp_path / "corpus"))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(list((tmp_path / "corpus" / "language=x").glob("*.txt"))) > 1
    got = corpora.read_parallel_corpus(spark, str(tmp_path / "corpus"), "folders").collect()
    assert sorted((r.language, r.sentence_id, r.text) for r in got) == sorted(data)


def test_corpora_stored_by_position_join_without_exchange(spark, rows):
    from glossaria.operators import pairs

    data = [(lang, i, f"{lang}{i}") for lang in "abc" for i in range(200)]
    corpus = spark.createDataFrame(data, "language string, sentence_id long, text string")
    corpora.save_by_position(corpus, "stored_by_position", 4)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        aligned = pairs.align_to_target(spark.table("stored_by_position"), "a")
        counts = spark.table("stored_by_position").groupBy("sentence_id").count()
        for df in (aligned, counts):
            assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" in pairs.align_to_target(corpus, "a")._jdf.queryExecution().executedPlan().toString()
        assert rows(aligned) == rows(pairs.align_to_target(corpus, "a"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        spark.sql("DROP TABLE stored_by_position")
