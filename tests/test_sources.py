"""Text and CSV sources, result files."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tagloom.checks import queries
from tagloom.operators.corrections import KNOWN_CORRECTIONS
from tagloom.plans.prepare import read_test, read_train
from tagloom.sources import sinks
from tagloom.sources.sinks import (
    pred_label_rows,
    run_folder,
    run_note,
    submission_rows,
    write_csv,
    write_metrics,
    write_note,
)
from tagloom.sources.tables import noun_documents, parse_list, read_csv, read_noun_csv, read_tagged_csv
from tagloom.sources.text import read_lines, read_tagged_text


def test_line_ends_and_last_line(spark, tmp_path):
    path = tmp_path / "lines.txt"
    path.write_bytes(b"a\r\nb\rc\n\nlast-no-newline")
    rows = sorted(read_tagged_text(spark, str(path)).collect())
    assert [r.sentence for r in rows] == ["a", "b", "c", "", "last-no-newline"]
    assert [r.row_id for r in rows] == [0, 1, 2, 3, 4]
    assert read_lines(spark, str(path)).columns == ["sentence"]


@pytest.mark.parametrize("split_bytes", ["97", "1000", "128m"])
def test_numbers_follow_file_and_line_order(spark, tmp_path, split_bytes):
    """Files of very different sizes, cut into many splits that are packed in any order."""
    expected = []
    for number, size in enumerate([3, 400, 1, 90, 0, 700]):
        lines = [f"file {number} line {i} <이름{i}:PS>" for i in range(size)]
        (tmp_path / f"part-{number}.txt").write_text("".join(f"{x}\n" for x in lines), encoding="utf-8")
        expected += lines
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split_bytes)
    spark.conf.set("spark.sql.files.openCostInBytes", "50")
    try:
        rows = read_tagged_text(spark, str(tmp_path)).orderBy("row_id").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [r.row_id for r in rows] == list(range(len(expected)))
    assert [r.sentence for r in rows] == expected


def test_train_and_test_readers(spark, tmp_path):
    row_id, find, _ = KNOWN_CORRECTIONS[0]
    path = tmp_path / "train.txt"
    path.write_text("".join(f"{find} x\n" for _ in range(row_id + 2)), encoding="utf-8")
    train = {r.row_id: r.train_label for r in read_train(spark, str(path)).filter(f"row_id >= {row_id}").collect()}
    assert train == {row_id: "일녀:QT", row_id + 1: ""}
    assert read_test(spark, str(path)).filter("train_label <> ''").count() == 0


def test_csv_round_trip_keeps_every_character(spark, tmp_path):
    rows = [(1, ' "quoted", comma\\ '), (2, "two\nlines"), (3, "<이름:PS>"), (4, 'end"'), (5, "back\\slash")]
    frame = spark.createDataFrame(rows, "row_id long, sentence string")
    write_csv(frame, str(tmp_path / "csv"))
    assert sorted(map(tuple, read_tagged_csv(spark, str(tmp_path / "csv"), multi_line=True).collect())) == rows


def test_noun_csv_takes_less_disk_than_its_text(spark, tmp_path, monkeypatch):
    """All five noun columns are written and read back, in files of bounded rows."""
    monkeypatch.setattr(sinks, "ROWS_PER_FILE", 20)
    monkeypatch.setattr(queries, "new_path", lambda spark, name: str(tmp_path / name))
    rows = [(i, " ".join(f"word{(i * k) % 89} it's" for k in range(1, 300))) for i in range(50)] + [(50, None), (51, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    found = queries.noun_csv(spark, str(tmp_path)).groupBy("doc_id").agg(F.count("text").alias("n"), F.sum(F.octet_length("text")).alias("size")).collect()
    assert {r.doc_id: r.n for r in found} == {i: (0 if i == 50 else 5) for i in range(52)}
    files = list((tmp_path / "nouns").glob("part-*"))
    assert len(files) == 3 and sum(f.stat().st_size for f in files) < sum(r["size"] or 0 for r in found) / 2


def test_csv_columns_go_by_name(spark, tmp_path):
    path = tmp_path / "named.csv"
    path.write_text("note,sentence,row_id\nx,one,7\ny,two,3\n", encoding="utf-8")
    assert sorted(map(tuple, read_tagged_csv(spark, str(path)).collect())) == [(3, "two"), (7, "one")]
    path = tmp_path / "bare.csv"
    path.write_text("sentence,label\none,a\ntwo,b\n", encoding="utf-8")
    assert sorted(map(tuple, read_tagged_csv(spark, str(path)).collect())) == [(0, "one"), (1, "two")]
    with pytest.raises(ValueError, match="no column text"):
        read_csv(spark, str(path), "sentence string, text string")


def test_printed_lists(spark):
    cells = ["""["d'or", 'b', 'c']""", r"""['it\'s', "a\"b", '']""", "[]", None]
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string")
    found = {r.i: r.v for r in rows.select("i", parse_list(F.col("c")).alias("v")).collect()}
    assert found == {0: ["d'or", "b", "c"], 1: ["it's", 'a"b'], 2: [], 3: None}


def test_noun_csv(spark, tmp_path):
    path = tmp_path / "nouns.csv"
    names = ["kkma", "hannanum", "komoran", "mecab", "okt"]
    header = ",".join(["doc_id", *[f"{n}_nouns" for n in names]])
    path.write_text(f"{header}\n7,\"['가방', '나라']\",[],\"['x']\",\"['y', 'y']\",\"['z']\"\n", encoding="utf-8")
    docs = {r.analyzer: r.nouns for r in noun_documents(read_noun_csv(spark, str(path))).collect()}
    assert docs == {"kkma": ["가방", "나라"], "hannanum": [], "komoran": ["x"], "mecab": ["y", "y"], "okt": ["z"]}


def test_printed_lists_in_odd_forms(spark):
    cells = ["['a', \"b'c\", '', 'd\\\\e', 'f\\'g']", "['open, \"x\"", "'a\"b' \"c", "'" + '"' * 20000 + "'", "['\\\n']", "[]", "", None]
    rows = spark.createDataFrame(list(enumerate(cells)), "i long, c string")
    found = [r.v for r in rows.select("i", parse_list(F.col("c")).alias("v")).orderBy("i").collect()]
    assert found == [["a", "b'c", "d\\e", "f'g"], ["x"], ['a"b'], ['"' * 20000], [], [], [], None]


def test_plain_lists_are_not_searched_item_by_item(spark):
    plan = spark.range(1).select(parse_list(F.col("id").cast("string")).alias("v"))._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE WHEN Contains" in plan and "filter(" not in plan and "substring(" not in plan


def test_result_rows(spark):
    pairs = spark.createDataFrame([(1, "p: a:PS", "p: b:PS"), (2, "c:LC", "p:")], "row_id long, pred string, label string")
    rows = {r.row_id: (r.pred, r.label) for r in pred_label_rows(pairs, "p:").collect()}
    assert rows == {1: ("a:PS", "b:PS"), 2: ("c:LC", "")}
    test = spark.createDataFrame([(2, "q: two"), (1, "q: one")], "row_id long, input_sentence string")
    rows = {tuple(r) for r in submission_rows(test, pairs.select("row_id", "pred"), "q:", "p:").collect()}
    assert rows == {(1, "one", "a:PS"), (2, "two", "c:LC")}


def test_metrics_note_and_folder(spark, tmp_path):
    metrics = spark.createDataFrame([(1.5, "한글")], "bleu double, note string")
    write_metrics(metrics, str(tmp_path / "m"))
    text = "".join(p.read_text(encoding="utf-8") for p in (tmp_path / "m").glob("*.json"))
    assert "한글" in text and '"bleu":1.5' in text
    write_note(spark, run_note("a:", "b:"), str(tmp_path / "n"))
    assert "input text: a:" in "".join(p.read_text() for p in (tmp_path / "n").glob("*.txt"))
    folder = run_folder("/base/", datetime(2024, 1, 2, 3, 4), prefix="extract entity:", n_split=10)
    assert folder == "/base/run_id=prefixextract-entity-_n_split10_date02-03-04"
