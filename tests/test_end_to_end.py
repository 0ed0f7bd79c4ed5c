"""One run of the whole program: read, prepare, split, augment, encode, predict, score, write."""

import re
from datetime import datetime

from pyspark.sql import functions as F

from tagloom.checks.stub_model import pattern_model
from tagloom.operators.alignment import align
from tagloom.operators.augment import augment
from tagloom.operators.infer import batch_predict
from tagloom.operators.label_folds import split_by_labels
from tagloom.operators.split import model_columns, split_train_valid
from tagloom.operators.vocab import INPUT_LIMIT, LABEL_LIMIT, build_vocabulary, decode_columns, encode_columns
from tagloom.plans.evaluate import evaluate, evaluate_ids
from tagloom.plans.prepare import LABEL_PREFIX, PREFIX, read_test, read_train
from tagloom.session import materialise
from tagloom.sources.sinks import (
    pred_label_rows,
    run_folder,
    run_note,
    submission_rows,
    write_csv,
    write_metrics,
    write_note,
)
from tagloom.sources.tables import read_csv


def sentences(n, start=0):
    for i in range(start, start + n):
        place = f" <NATION {i % 7}:LC>에서" if i % 3 else ""
        count = f" <{i}개:QT> 샀다" if i % 4 == 0 else ""
        yield f"사람 <Customer {i}:PS>은{place} <{1990 + i % 9}-01-{1 + i % 28:02}:DT>에!!{count}~~"


def test_whole_program(spark, tmp_path):
    for name, lines in (("train", sentences(120)), ("test", sentences(40, 500))):
        (tmp_path / f"{name}.txt").write_text("\n".join(lines) + "\n", encoding="utf-8")
    train = materialise(read_train(spark, str(tmp_path / "train.txt"), PREFIX, LABEL_PREFIX), "train")
    test = materialise(read_test(spark, str(tmp_path / "test.txt"), PREFIX, LABEL_PREFIX), "test")
    assert (train.count(), test.count()) == (120, 40)

    for split in (split_train_valid, split_by_labels):
        part, valid = split(train, 10)
        assert valid.count() == 12 and part.join(valid, "row_id").count() == 0
        assert model_columns(valid).columns == ["input_sentence", "train_label"]
    part, valid = materialise(part, "part"), materialise(valid, "valid")

    more = materialise(augment(part, 3, label_prefix=LABEL_PREFIX), "more")
    assert more.count() == 4 * 108 and more.filter("round = 0").join(part, "row_id").count() == 108
    vocab = materialise(build_vocabulary(more, ["input_sentence", "train_label"]), "vocab")
    limits = {"input_ids": ("input_sentence", INPUT_LIMIT), "labels": ("train_label", LABEL_LIMIT)}
    coded = encode_columns(more, vocab, limits)
    longest = coded.agg(F.max(F.size("input_ids")).alias("i"), F.max(F.size("labels")).alias("l")).first()
    assert 4 < longest["i"] <= INPUT_LIMIT and 4 < longest["l"] <= LABEL_LIMIT
    back = decode_columns(coded, vocab, {"text": "input_ids"})
    assert back.filter(F.col("text") != F.regexp_replace("input_sentence", " +", " ")).count() == 0

    answers = batch_predict(test, pattern_model).withColumn("pred", F.concat(F.lit(LABEL_PREFIX + " "), "pred"))
    pairs = materialise(align(answers, test.selectExpr("row_id", "train_label AS label")), "pairs")
    metrics = materialise(evaluate(pairs, label_prefix=LABEL_PREFIX), "metrics")
    scores = metrics.first().asDict()
    assert 0 < scores["bleu"] <= 100 and 0 < scores["acc"] <= scores["f1"] <= 1
    words = materialise(build_vocabulary(pairs, ["pred", "label"]), "words")
    ids = encode_columns(pairs, words, {"pred_ids": ("pred", None), "label_ids": ("label", None)})
    assert evaluate_ids(ids.select("row_id", "pred_ids", "label_ids"), words, label_prefix=LABEL_PREFIX).count() == 1

    folder = run_folder(str(tmp_path / "runs"), datetime(2024, 5, 6, 7, 8), n_split=10, n_augment=3)
    assert re.fullmatch(r".*/runs/run_id=n_split10_n_augment3_date06-07-08", folder)
    write_metrics(metrics, f"{folder}/metrics")
    write_note(spark, run_note(PREFIX, LABEL_PREFIX), f"{folder}/note")
    write_csv(pred_label_rows(pairs, LABEL_PREFIX), f"{folder}/pred_label")
    write_csv(submission_rows(test, answers, PREFIX, LABEL_PREFIX), f"{folder}/submission")
    assert spark.read.json(f"{folder}/metrics").first().asDict() == scores
    assert [r.value for r in spark.read.text(f"{folder}/note").collect()] == [f"input text: {PREFIX}: ", f", label text: {LABEL_PREFIX}"]
    written = read_csv(spark, f"{folder}/pred_label", "row_id long, pred string, label string").collect()
    assert len(written) == 40 and not any(LABEL_PREFIX in (r.pred or "") + r.label for r in written)
    assert any(r.pred != r.label for r in written)
    sent = {r.row_id: r.input_sentence for r in read_csv(spark, f"{folder}/submission", "row_id long, input_sentence string").collect()}
    assert len(sent) == 40 and not any(PREFIX in s for s in sent.values())


def test_metrics_of_ids_are_those_of_texts(spark):
    rows = [(1, "a b:PS c:LC", "a b:PS c:LC"), (2, "none", "d:DT"), (3, None, "e f:OG")]
    pairs = spark.createDataFrame(rows, "row_id long, pred string, label string")
    vocab = materialise(build_vocabulary(pairs.fillna(""), ["pred", "label"]), "vocab")
    limits = {"pred_ids": ("pred", None), "label_ids": ("label", None)}
    coded = encode_columns(pairs, vocab, limits).select("row_id", *limits)
    spaced = pairs.select("row_id", *[F.regexp_replace(c, ":", " :").alias(c) for c in ("pred", "label")])
    assert evaluate_ids(coded, vocab).first() == evaluate(spaced).first()
