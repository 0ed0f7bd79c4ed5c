"""Golden rows of extraction, cleaning and preparation."""

import re

import pytest
from pyspark.sql import functions as F

from tagloom.functions.cleaning import clean_sentence
from tagloom.functions.tags import raw_tags
from tagloom.functions.text import WHITESPACE, strip, whitespace_tokens, without_prefix
from tagloom.operators.corrections import CORRECTION_SCHEMA, KNOWN_CORRECTIONS, apply_corrections, known_corrections
from tagloom.plans.prepare import prepare, prepare_basic

GOLDEN = [
    ("<홍길동:PS>이 <서울:LC>에서!! ~~ 100%%", "홍길동이 서울에서 ~ 100%", ["홍길동:PS", "서울:LC"]),
    ("tag none text", "tag none text", []),
    ("<3:30:TI>에 <둘:QT>", "3에 둘", ["3:30:TI", "둘:QT"]),
    ("시간: 3 <서울:LC> 끝", "시간 끝", ["서울:LC"]),
    ("일녀<QT> 그리고 <홍:PS>", "일녀QT 그리고 홍", ["QT 그리고 홍:PS"]),
    ("<a<b:PS>", "ab", ["ab:PS"]),
    ("<:PS> x", "x", [":PS"]),
    ("<x:> y", "x y", ["x:"]),
    ("ㅋㅋ <北京:LC> é", "", ["北京:LC"]),
    ("x:y>z<w:LC>", "xzw", ["w:LC"]),
    ("<1,000명:QT> 1,000명", "1 000명 1 000명", ["1,000명:QT"]),
    ("<x:PS", "x PS", []),
    ("<a:PS><b:LC>", "ab", ["a:PS", "b:LC"]),
    ("a <b:PS>", "a b", ["b:PS"]),
    ("", "", []),
    ("<a\nb:PS> c:d\ne>", "a b c d e", []),
    ("<a:b\u0085c>", "a", ["a:b\u0085c"]),
]


@pytest.fixture(scope="module")
def golden(spark):
    rows = [(i, s) for i, (s, _, _) in enumerate(GOLDEN)]
    return spark.createDataFrame(rows, "row_id long, sentence string")


def test_golden_rows(golden):
    found = golden.select(
        "row_id", clean_sentence(F.col("sentence")).alias("clean"), raw_tags(F.col("sentence")).alias("raw")
    ).collect()
    for row in found:
        _, clean, raw = GOLDEN[row.row_id]
        assert (row.clean, row.raw) == (clean, raw), GOLDEN[row.row_id]


def test_cleaning_keeps_exactly_the_alphabet(spark):
    """Every character of the basic plane against the plain definition."""
    codes = [c for c in range(1, 0x10000) if not 0xD800 <= c < 0xE000] + [0x1F600, 0x10FFFF]
    rows = spark.createDataFrame([(c, f"a{chr(c)}b") for c in codes], "code long, sentence string")
    wrong = [
        r.code
        for r in rows.select("code", clean_sentence(F.col("sentence")).alias("clean")).collect()
        if r.clean != re.sub(r"[^가-힣a-zA-Z0-9.%~]", " ", re.sub("<", "", f"a{chr(r.code)}b"))
    ]
    assert wrong == []


def test_strip_is_unicode_aware(spark):
    rows = spark.createDataFrame([(f"{WHITESPACE}x{WHITESPACE}y{WHITESPACE}",)], "s string")
    row = rows.select(strip(F.col("s")).alias("s"), whitespace_tokens(F.col("s")).alias("t")).first()
    assert row.s == f"x{WHITESPACE}y" and row.t == ["x", "y"]
    assert len(WHITESPACE) == 29
    empty = spark.createDataFrame([("",), (WHITESPACE,)], "s string")
    assert [r.t for r in empty.select(whitespace_tokens(F.col("s")).alias("t")).collect()] == [[], []]


def test_prepare_columns(golden):
    row = prepare(golden, "extract entity:", "extracted entity:").filter("row_id = 0").first()
    assert row.input_sentence == "extract entity: 홍길동이 서울에서 ~ 100%"
    assert row.train_label == "extracted entity: 홍길동:PS 서울:LC"
    assert (row.name, row.entity, row.joined_entity) == (["홍길동", "서울"], ["PS", "LC"], "PS LC")
    untagged = prepare(golden).filter("row_id = 1").first()
    assert (untagged.labels, untagged.train_label, untagged.entity) == ([], "", [])
    three_parts = prepare(golden).filter("row_id = 2").first()
    assert (three_parts.name, three_parts.entity) == (["3", "둘"], ["TI", "QT"])


def test_prepare_basic_keeps_marks_and_list(golden):
    row = prepare_basic(golden).filter("row_id = 0").first()
    assert row.org_sentence == "홍길동이 서울에서 ~~ 100%%"
    assert row.train_label == ["홍길동:PS", "서울:LC"]


def test_corrections(spark):
    row_id, find, replacement = KNOWN_CORRECTIONS[0]
    rows = spark.createDataFrame([(row_id, f"x {find} y"), (1, f"x {find} y"), (2, "ab")], "row_id long, sentence string")
    fixed = {r.row_id: r.sentence for r in apply_corrections(rows, known_corrections(spark)).collect()}
    assert fixed == {row_id: f"x {replacement} y", 1: f"x {find} y", 2: "ab"}
    several = spark.createDataFrame([(2, "a", "1"), (2, "b", "2"), (9, "x", "y")], CORRECTION_SCHEMA)
    fixed = {r.row_id: r.sentence for r in apply_corrections(rows, several).collect()}
    assert fixed[2] == "12"


def test_prefix_is_literal(spark):
    rows = spark.createDataFrame([(" a.b: x a.b: y ",), ("acb: x",)], "s string")
    assert [r.s for r in rows.select(without_prefix(F.col("s"), "a.b:").alias("s")).collect()] == ["x  y", "acb: x"]


def test_preparation_runs_on_a_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.txt").write_text("".join(f"{s}\n" for s, _, _ in GOLDEN[:4]), encoding="utf-8")
    stream = spark.readStream.schema("value string").text(str(source)).withColumnRenamed("value", "sentence")
    query = (
        prepare(stream)
        .writeStream.format("memory")
        .queryName("prepared_stream")
        .option("checkpointLocation", str(tmp_path / "state"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination(60)
    found = {r.sentence: r.input_sentence for r in spark.table("prepared_stream").collect()}
    assert found == {s: clean for s, clean, _ in GOLDEN[:4]}
