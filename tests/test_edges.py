"""Empty and degenerate inputs."""

from pyspark.sql import functions as F

from tagloom.checks.stub_model import pattern_model
from tagloom.operators.augment import augment
from tagloom.operators.dictionary import dictionary_sizes, entity_dictionary
from tagloom.operators.infer import batch_predict
from tagloom.operators.profile import length_profile, tag_counts, tag_share
from tagloom.operators.silhouette import silhouette_exact, silhouette_squared
from tagloom.operators.split import labelled_split, stratified_folds
from tagloom.operators.tfidf import tfidf
from tagloom.operators.vocab import build_vocabulary, encode
from tagloom.plans.prepare import prepare


def corpus(spark, *sentences):
    return prepare(spark.createDataFrame(list(enumerate(sentences)), "row_id long, sentence string"))


def test_empty_corpus(spark):
    rows = corpus(spark)
    assert tag_counts(rows).count() == 0 and tag_share(tag_counts(rows)).count() == 0
    assert entity_dictionary(rows).count() == 0 and dictionary_sizes(rows).count() == 0
    assert stratified_folds(rows, 4).count() == 0 and labelled_split(rows).count() == 0
    assert augment(rows, 2).count() == 0
    assert batch_predict(rows, pattern_model).count() == 0
    profile = length_profile(rows, "input_sentence", 3).first()
    assert (profile.n_rows, profile.n_tokens, profile.longest, profile.above_limit) == (0, None, None, 0)


def test_corpus_without_entities(spark):
    rows = corpus(spark, "one", "two words", "")
    for inline in (1 << 20, -1):
        found = augment(rows, 1, inline_bytes=inline).filter("round = 1").collect()
        assert {(r.row_id, r.input_sentence, r.train_label) for r in found} == {(0, "one", ""), (1, "two words", ""), (2, "", "")}
    vocab = build_vocabulary(rows, ["train_label"])
    assert vocab.count() == 9
    assert {tuple(r.ids) for r in encode(rows, vocab, "input_sentence", 10).collect()} == {(2, 1), (2, 2, 1), (1,)}


def test_documents_without_terms(spark):
    docs = spark.createDataFrame([(1, []), (2, ["x"])], "doc_id long, nouns array<string>")
    assert tfidf(docs).count() == 0


def test_one_cluster_and_one_row(spark):
    rows = spark.createDataFrame([(1, [0.0, 1.0], [5]), (2, [1.0, 1.0], [5])], "id long, x array<double>, labels array<int>")
    assert {r.s for r in silhouette_exact(rows, "id", "x").collect()} == {0.0}
    single = rows.limit(1).withColumn("cluster", F.get("labels", F.lit(0)))
    assert [r.s for r in silhouette_squared(single, "id", "x", "cluster").collect()] == [0.0]


def test_frequent_tag_and_copies(spark):
    """One sentence makes up nearly the whole corpus."""
    rows = prepare(
        spark.range(3000).select(
            F.col("id").alias("row_id"),
            F.when(F.col("id") % 50 == 0, F.concat(F.lit("<n"), F.col("id"), F.lit(":LC>"))).otherwise("<같은:PS>이").alias("sentence"),
        )
    )
    assert {r.tag: r.n_names for r in dictionary_sizes(rows).collect()} == {"LC": 60, "PS": 1}
    inline, joined = (augment(rows, 1, inline_bytes=b) for b in (1 << 20, 0))
    assert inline.exceptAll(joined).count() == 0 and joined.exceptAll(inline).count() == 0
    drawn = joined.filter("round = 1 and row_id % 50 = 0").agg(F.count_distinct("train_label")).first()[0]
    assert drawn > 25


def test_silhouettes_of_missing_vectors(spark):
    """Rows without a vector or a cluster have no score and do not count for others."""
    rows = [(1, 0, [0.0]), (2, 0, [1.0]), (3, 1, [9.0]), (4, None, [5.0]), (5, 1, None), (6, None, None)]
    points = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    whole = {r.vec_id: r.s for r in silhouette_squared(points, "vec_id", "embedding", "label").collect()}
    usable = {r.vec_id: r.s for r in silhouette_squared(points.dropna(), "vec_id", "embedding", "label").collect()}
    assert usable.keys() == {1, 2, 3} and whole == {**usable, 4: None, 5: None, 6: None}


def test_intermediates_of_threads_stay_apart(spark):
    from threading import Thread

    from tagloom.session import intermediates, new_path

    seen = []
    with intermediates(spark) as folder:
        worker = Thread(target=lambda: seen.append(new_path(spark, "x")))
        worker.start()
        worker.join()
        assert new_path(spark, "x").startswith(folder) and not seen[0].startswith(folder)
    assert not new_path(spark, "x").startswith(folder)
