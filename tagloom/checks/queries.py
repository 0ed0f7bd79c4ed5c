"""Registered queries: one per operator, each over whole tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.checks import fixtures as fx
from tagloom.checks.stub_model import pattern_model
from tagloom.functions.arrays import elements
from tagloom.functions.cleaning import clean_sentence
from tagloom.functions.segments import segments
from tagloom.functions.tags import tag_structs
from tagloom.functions.text import strip, whitespace_tokens, without_prefix
from tagloom.operators import cluster, coreset, silhouette, silhouette_sampled
from tagloom.operators.alignment import align
from tagloom.operators.augment import augment, swap_entities
from tagloom.operators.corrections import apply_corrections
from tagloom.operators.dictionary import dictionary_sizes, distinct_names, entities, entity_dictionary
from tagloom.operators.heavy_hitters import heavy_hitters
from tagloom.operators.infer import batch_map, batch_predict
from tagloom.operators.label_folds import fold_balance, fold_quotas, label_folds
from tagloom.operators.neighbours import neighbour_graph, neighbour_layout
from tagloom.operators.numbering import number_by_key
from tagloom.operators.order_stats import exact_quantiles
from tagloom.operators.profile import (
    indicator_tags,
    label_indicators,
    length_profile,
    split_counts,
    tag_counts,
    tag_share,
    tag_share_mean,
)
from tagloom.operators.scoring import (
    bleu,
    bleu_stats,
    entity_f1_macro,
    with_bleu_counts,
    with_entity_counts,
    with_entity_scores,
)
from tagloom.operators.split import (
    labelled_split,
    model_columns,
    rows_in,
    rows_not_in,
    signature,
    split_train_valid,
    stratified_folds,
)
from tagloom.operators.subword import SubwordVocabulary, decode_subwords, encode_subwords
from tagloom.operators.tfidf import noun_text, term_documents, tfidf, vocabulary
from tagloom.operators.vocab import (
    INPUT_LIMIT,
    LABEL_LIMIT,
    LABEL_MASK,
    SPECIALS,
    build_vocabulary,
    decode,
    encode,
    encode_columns,
    restore_mask,
)
from tagloom.plans.evaluate import best_runs, evaluate, evaluate_ids
from tagloom.plans.explore import documents_2d, sweep_by_analyzer, sweep_means, sweep_scores
from tagloom.plans.prepare import LABEL_PREFIX, PREFIX, prepare, prepare_basic
from tagloom.session import materialise, new_path
from tagloom.sources.quoted_csv import read_quoted_csv
from tagloom.sources.sinks import pred_label_rows, run_note, submission_rows, write_csv, write_metrics, write_note
from tagloom.sources.tables import noun_documents, read_csv, read_noun_csv, read_tagged_csv
from tagloom.sources.text import read_tagged_text

ROUNDS = 2
QUANTILES = (0.0, 0.01, 0.25, 0.5, 0.95, 0.99, 1.0)
TOP_TERMS, TERM_COUNTERS = 500, 2_000


def joined(items: Column, separator: str = "|") -> Column:
    return F.array_join(items, separator)


def six(name: str) -> Column:
    return F.round(F.col(name), 6).alias(name)


def plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare(fx.tagged(spark, sf_dir))


def prefixed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare(fx.tagged(spark, sf_dir), PREFIX, LABEL_PREFIX)


def stored(prepared: DataFrame) -> DataFrame:
    """A prepared corpus written once, for jobs that pass over it more than once and then read
    only the columns they need."""
    return materialise(prepared, "prepared")


# --- extraction and cleaning -------------------------------------------------------------------


def tag_extract(spark, sf_dir):
    labels = tag_structs(F.col("sentence"))
    rows = fx.tagged(spark, sf_dir).select("row_id", labels.alias("labels"))
    return rows.select("row_id", F.size("labels").cast("bigint").alias("n_tags"), joined(F.col("labels.raw")).alias("raw"))


def entity_rows(spark, sf_dir):
    return entities(plain(spark, sf_dir), "row_id").withColumn("pos", F.col("pos").cast("bigint"))


def clean(spark, sf_dir):
    return fx.tagged(spark, sf_dir).select("row_id", clean_sentence(F.col("sentence")).alias("clean"))


def clean_basic(spark, sf_dir):
    return prepare_basic(fx.tagged(spark, sf_dir)).select(
        "row_id", "org_sentence", joined(F.col("train_label")).alias("train_label")
    )


def corrected(spark, sf_dir):
    return apply_corrections(fx.tagged(spark, sf_dir), fx.corrections(spark))


def label_strings(spark, sf_dir):
    return plain(spark, sf_dir).select("row_id", "train_label")


def joined_entity(spark, sf_dir):
    return plain(spark, sf_dir).select("row_id", "joined_entity")


def prefixed(spark, sf_dir):
    return prefixed_rows(spark, sf_dir).select("row_id", "input_sentence", "train_label")


def name_tag_arrays(spark, sf_dir):
    return plain(spark, sf_dir).select("row_id", joined(F.col("name")).alias("name"), joined(F.col("entity")).alias("entity"))


def flat(prepared: DataFrame) -> DataFrame:
    return prepared.select(
        "row_id",
        "sentence",
        "train_label",
        joined(F.col("name")).alias("name"),
        joined(F.col("entity")).alias("entity"),
        "input_sentence",
        "joined_entity",
    )


def prepare_train(spark, sf_dir):
    return flat(prepare(fx.tagged(spark, sf_dir), PREFIX, LABEL_PREFIX, fx.corrections(spark)))


def prepare_test(spark, sf_dir):
    return flat(prefixed_rows(spark, sf_dir))


def strip_prefix(spark, sf_dir):
    return prefixed_rows(spark, sf_dir).select(
        "row_id",
        without_prefix(F.col("input_sentence"), PREFIX).alias("input_sentence"),
        without_prefix(F.col("train_label"), LABEL_PREFIX).alias("train_label"),
    )


def strip_decoded(spark, sf_dir):
    padded = F.concat(F.lit(" \t"), F.col("text"), F.lit("　\n"))
    return fx.table(spark, sf_dir, "conversations").select("conv_id", "turn", strip(padded).alias("text"))


def model_ready(spark, sf_dir):
    return model_columns(prefixed_rows(spark, sf_dir), "row_id")


# --- profiles ----------------------------------------------------------------------------------


def q_tag_counts(spark, sf_dir):
    return tag_counts(plain(spark, sf_dir))


def q_tag_share(spark, sf_dir):
    return tag_share(tag_counts(plain(spark, sf_dir)))


def q_tag_share_mean(spark, sf_dir):
    rows = stored(plain(spark, sf_dir).select("row_id", "entity"))
    test = fx.in_test_part()
    return tag_share_mean(tag_counts(rows.filter(~test)), tag_counts(rows.filter(test)))


def q_entity_dictionary(spark, sf_dir):
    return entity_dictionary(plain(spark, sf_dir))


def q_dictionary_sizes(spark, sf_dir):
    return dictionary_sizes(plain(spark, sf_dir))


def q_distinct_names(spark, sf_dir):
    return distinct_names(plain(spark, sf_dir))


def unique_tags(spark, sf_dir):
    return indicator_tags(plain(spark, sf_dir))


def q_label_indicators(spark, sf_dir):
    return label_indicators(plain(spark, sf_dir))


def q_length_profile(spark, sf_dir):
    return length_profile(fx.documents(spark, sf_dir), "text", INPUT_LIMIT)


def label_length_profile(spark, sf_dir):
    return length_profile(prefixed_rows(spark, sf_dir), "train_label", LABEL_LIMIT)


def value_quantiles(spark, sf_dir):
    """Exact quantiles of document lengths and of prices."""
    text = F.coalesce("text", F.lit(""))
    lengths = fx.documents(spark, sf_dir).select(
        F.size(whitespace_tokens(text)).alias("n_words"), F.char_length(text).alias("n_chars")
    )
    prices = fx.table(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").cast("double").alias("price"))
    lengths = materialise(lengths, "lengths")
    found = exact_quantiles(lengths, ["n_words", "n_chars"], QUANTILES).unionByName(
        exact_quantiles(prices, ["price"], QUANTILES)
    )
    return found.select("column", "quantile", "n", six("value"))


# --- numbering and splitting -------------------------------------------------------------------


def row_numbering(spark, sf_dir):
    return number_by_key(fx.tagged(spark, sf_dir), "row_id").select("row_id", "position")


def folds(spark, sf_dir):
    return stratified_folds(stored(plain(spark, sf_dir).select("row_id", "entity")), 10).select("row_id", "fold")


def folds_default(spark, sf_dir):
    rows = stored(plain(spark, sf_dir).select("row_id", "entity", "joined_entity"))
    return stratified_folds(rows).groupBy("fold", "joined_entity").agg(F.count(F.lit(1)).alias("n_rows"))


def train_valid_split(spark, sf_dir):
    return labelled_split(stored(prefixed_rows(spark, sf_dir)), 10)


def first_fold(spark, sf_dir):
    _, valid = split_train_valid(stored(plain(spark, sf_dir)), 10)
    return valid.select("row_id", "input_sentence")


def index_gather(spark, sf_dir):
    rows = stored(plain(spark, sf_dir))
    _, valid = split_train_valid(rows, 4)
    ids = materialise(valid.select("row_id"), "valid-ids")
    parts = rows_in(rows, ids).withColumn("part", F.lit("valid")).unionByName(
        rows_not_in(rows, ids).withColumn("part", F.lit("train"))
    )
    return parts.select("row_id", "part", "train_label")


def q_split_counts(spark, sf_dir):
    return split_counts(labelled_split(stored(prefixed_rows(spark, sf_dir)), 10))


def label_fold_quotas(spark, sf_dir):
    rows = plain(spark, sf_dir).groupBy(signature(F.col("entity")).alias("signature")).agg(F.count(F.lit(1)).alias("n"))
    labels = F.filter(F.split("signature", " "), lambda x: x != "")
    quotas = fold_quotas(materialise(rows.withColumn("labels", labels), "sets"), 10)
    return quotas.select("signature", "n", "base", F.size("extra").cast("bigint").alias("leftover"))


def label_fold_balance(spark, sf_dir):
    """How many rows of every label, label set and in all the ten folds hold."""
    rows = stored(plain(spark, sf_dir).select("row_id", "entity"))
    return fold_balance(rows.join(label_folds(rows, 10), "row_id"), 10)


# --- augmentation ------------------------------------------------------------------------------


def entity_swap(spark, sf_dir):
    return swap_entities(stored(prefixed_rows(spark, sf_dir)), ROUNDS)


def entity_swap_joined(spark, sf_dir):
    return swap_entities(stored(prefixed_rows(spark, sf_dir)), ROUNDS, inline_bytes=0)


def augmented_union(spark, sf_dir):
    return augment(stored(prefixed_rows(spark, sf_dir)), ROUNDS, label_prefix=LABEL_PREFIX)


# --- vocabulary --------------------------------------------------------------------------------


def vocab_build(spark, sf_dir):
    return build_vocabulary(prefixed_rows(spark, sf_dir), ["input_sentence", "train_label"])


def full_vocabulary(rows):
    return materialise(build_vocabulary(rows, ["input_sentence", "train_label"]), "vocab")


def ids_text(coded: DataFrame) -> DataFrame:
    return coded.select("row_id", joined(F.col("ids").cast("array<string>"), " ").alias("ids"))


def encode_ids(spark, sf_dir):
    rows = stored(prefixed_rows(spark, sf_dir))
    return ids_text(encode(rows, full_vocabulary(rows), "input_sentence", INPUT_LIMIT))


def encode_augmented(spark, sf_dir):
    """Both model columns of all rounds; a row occurs once per round."""
    rows = augment(stored(prefixed_rows(spark, sf_dir)), ROUNDS, label_prefix=LABEL_PREFIX)
    rows = materialise(rows, "augmented")
    limits = {"input_ids": ("input_sentence", INPUT_LIMIT), "label_ids": ("train_label", LABEL_LIMIT)}
    coded = encode_columns(rows, full_vocabulary(rows), limits, keep=["row_id", "round"])
    texts = [joined(F.col(c).cast("array<string>"), " ").alias(c) for c in limits]
    return coded.select("row_id", F.col("round").cast("bigint").alias("round"), *texts)


def encode_documents(spark, sf_dir):
    docs = fx.documents(spark, sf_dir).select(F.col("doc_id").alias("row_id"), "text")
    vocab = materialise(build_vocabulary(docs, ["text"]), "vocab")
    return ids_text(encode(docs, vocab, "text", None))


def masked_labels(spark, sf_dir):
    rows = stored(prefixed_rows(spark, sf_dir))
    vocab = full_vocabulary(rows)
    coded = encode(rows, vocab, "train_label", LABEL_LIMIT)
    return coded.withColumn("ids", F.concat("ids", F.array_repeat(F.lit(LABEL_MASK), 3))), vocab


def mask_restore(spark, sf_dir):
    coded, _ = masked_labels(spark, sf_dir)
    return ids_text(coded.withColumn("ids", restore_mask(F.col("ids"))))


def decode_ids(spark, sf_dir):
    coded, vocab = masked_labels(spark, sf_dir)
    return decode(coded.withColumn("ids", restore_mask(F.col("ids"))), vocab)


def subwords() -> SubwordVocabulary:
    import public_tokenizers

    return SubwordVocabulary.read(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def subword_round_trip(spark, sf_dir):
    """Whole documents, encoded and decoded; the last offset is the end of the text."""
    vocab = subwords()
    docs = fx.documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    coded = materialise(encode_subwords(docs, vocab, {"coded": ("text", None)}).select("doc_id", "coded"), "subwords")
    back = decode_subwords(coded.withColumn("ids", F.col("coded.ids")), vocab, {"text": "ids"})
    return back.select("doc_id", "text", F.element_at("coded.ends", -1).cast("bigint").alias("n_chars"))


def subword_reserved(spark, sf_dir):
    """How often each tag token is one id in the labels."""
    vocab = subwords()
    coded = encode_subwords(prefixed_rows(spark, sf_dir).select("row_id", "train_label"), vocab, {"all": ("train_label", None)})
    ids = elements(coded, ["row_id"], F.col("all.ids"), "id")
    tags = F.array(*map(F.lit, vocab.reserved))
    own = ids.filter(F.col("id").between(len(SPECIALS), vocab.first_rank - 1))
    return own.groupBy(F.get(tags, F.col("id") - len(SPECIALS)).alias("tag")).agg(F.count(F.lit(1)).alias("n"))


def subword_encode(spark, sf_dir):
    """Model columns cut at 100 and 90 subwords, with the characters that each id covers."""
    rows = stored(prefixed_rows(spark, sf_dir).select("row_id", "input_sentence", "train_label"))
    limits = {"input": ("input_sentence", INPUT_LIMIT), "label": ("train_label", LABEL_LIMIT)}
    coded = encode_subwords(rows, subwords(), limits)
    parts = [joined(F.col(f"{n}.{p}").cast("array<string>"), " ").alias(f"{n}_{p}") for n in limits for p in ("ids", "starts", "ends")]
    return coded.select("row_id", *parts)


# --- scoring -----------------------------------------------------------------------------------


def align_predictions(spark, sf_dir):
    pairs = fx.predictions(spark, sf_dir)
    return align(pairs.select("row_id", "pred"), pairs.select("row_id", "label"))


def segment_parse(spark, sf_dir):
    rows = elements(fx.predictions(spark, sf_dir), ["row_id"], segments(F.col("pred")), "segment", pos="pos")
    return rows.select(
        "row_id", F.col("pos").cast("bigint").alias("pos"), joined(F.col("segment.tokens")).alias("tokens"), F.col("segment.tag").alias("tag")
    )


def entity_precision(spark, sf_dir):
    return with_entity_counts(fx.predictions(spark, sf_dir)).select("row_id", "n_pred", "tp")


def entity_recall(spark, sf_dir):
    return with_entity_counts(fx.predictions(spark, sf_dir)).select("row_id", "n_gold", "recalled")


def entity_f1_acc(spark, sf_dir):
    return with_entity_scores(fx.predictions(spark, sf_dir)).select("row_id", six("f1"), six("acc"))


def entity_counts_long_rows(spark, sf_dir):
    """All predictions of a customer as one row, which holds dozens of entities."""
    owners = fx.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_custkey").alias("owner"))
    parts = fx.predictions(spark, sf_dir).join(owners, "row_id")
    listed = F.array_sort(F.collect_list(F.struct("row_id", "pred", "label")))
    rows = parts.groupBy(F.col("owner").alias("row_id")).agg(listed.alias("rows"))
    long = rows.select("row_id", *[joined(F.col(f"rows.{c}"), " ").alias(c) for c in ("pred", "label")])
    return with_entity_counts(long).select("row_id", "n_pred", "n_gold", "tp", "recalled")


def q_entity_f1_macro(spark, sf_dir):
    return entity_f1_macro(fx.predictions(spark, sf_dir)).select(six("f1"), six("acc"))


def bleu_rows(spark, sf_dir):
    return with_bleu_counts(fx.bleu_pairs(spark, sf_dir)).drop("label", "pred")


def q_bleu_stats(spark, sf_dir):
    return bleu_stats(fx.bleu_pairs(spark, sf_dir))


def bleu_score(spark, sf_dir):
    return bleu(fx.bleu_pairs(spark, sf_dir)).select(six("bleu"))


def evaluation_missing(spark, sf_dir):
    """A prediction that is missing counts as empty."""
    lost = F.when(F.col("row_id") % 13 != 0, F.col("pred"))
    return evaluate(fx.predictions(spark, sf_dir).withColumn("pred", lost)).select(six("bleu"), six("f1"), six("acc"))


def evaluation_from_ids(spark, sf_dir):
    """Metrics of id batches, labels padded by the mask."""
    pairs = stored(fx.predictions(spark, sf_dir).select("row_id", "pred", "label"))
    vocab = materialise(build_vocabulary(pairs, ["pred", "label"]), "vocab")
    limits = {"pred_ids": ("pred", LABEL_LIMIT), "label_ids": ("label", LABEL_LIMIT)}
    coded = encode_columns(pairs, vocab, limits, keep=["row_id"])
    coded = coded.withColumn("label_ids", F.concat("label_ids", F.array_repeat(F.lit(LABEL_MASK), 3)))
    return evaluate_ids(coded, vocab).select(six("bleu"), six("f1"), six("acc"))


def evaluation_report(spark, sf_dir):
    return evaluate(fx.predictions(spark, sf_dir)).select(six("bleu"), six("f1"), six("acc"))


def run_metrics(spark, sf_dir):
    runs = fx.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("row_id"), F.col("o_orderpriority").alias("run_id")
    )
    return evaluate(fx.predictions(spark, sf_dir).join(runs, "row_id"), by=["run_id"])


def best_run(spark, sf_dir):
    top = best_runs(run_metrics(spark, sf_dir))
    return top.select("run_id", F.col("place").cast("bigint").alias("place"), six("bleu"), six("f1"), six("acc"))


# --- batch inference ---------------------------------------------------------------------------


def measure(batch: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame(
        {
            "row_id": batch["row_id"],
            "input_chars": batch["input_sentence"].str.len(),
            "label_upper": batch["train_label"].str.upper(),
        }
    )


def q_batch_map(spark, sf_dir):
    return batch_map(
        prefixed_rows(spark, sf_dir),
        measure,
        "row_id long, input_chars long, label_upper string",
        ["row_id", "input_sentence", "train_label"],
    )


def q_batch_predict(spark, sf_dir):
    return batch_predict(plain(spark, sf_dir), pattern_model)


# --- result files ------------------------------------------------------------------------------


def q_pred_label_rows(spark, sf_dir):
    pairs = fx.predictions(spark, sf_dir)
    with_prefix = pairs.withColumns({c: F.concat(F.lit(LABEL_PREFIX + " "), F.col(c)) for c in ("pred", "label")})
    return pred_label_rows(with_prefix, LABEL_PREFIX)


def q_submission_rows(spark, sf_dir):
    preds = fx.predictions(spark, sf_dir).select(
        "row_id", F.concat(F.lit(LABEL_PREFIX + " "), F.col("pred")).alias("pred")
    )
    return submission_rows(prefixed_rows(spark, sf_dir), preds, PREFIX, LABEL_PREFIX)


def submission_csv(spark, sf_dir):
    path = new_path(spark, "submission")
    write_csv(q_submission_rows(spark, sf_dir), path)
    return read_csv(spark, path, "row_id long, input_sentence string, pred string")


def metrics_json(spark, sf_dir):
    path = new_path(spark, "metrics")
    write_metrics(evaluation_report(spark, sf_dir), path)
    return spark.read.schema("bleu double, f1 double, acc double").json(path)


def run_notes(spark, sf_dir):
    """Notes of runs named after order priorities, written to their folders and read back."""
    runs = fx.table(spark, sf_dir, "orders").select("o_orderpriority").distinct().orderBy("o_orderpriority").collect()
    base = new_path(spark, "runs")
    for k, row in enumerate(runs):
        write_note(spark, run_note(f"{PREFIX}{k}", f"{LABEL_PREFIX} {row[0]}"), f"{base}/run_id={k}")
    lines = spark.read.text(f"{base}/run_id=*").select("value", F.col("_metadata.file_path").alias("path"))
    run_id = F.regexp_extract("path", r"run_id=(\d+)", 1).cast("bigint")
    return lines.select(run_id.alias("run_id"), F.col("value").alias("line"))


def quoted_csv(spark, sf_dir):
    """Whole documents in CSV fields, line breaks and quotes included, read split by split."""
    path = new_path(spark, "quoted-csv")
    docs = fx.documents(spark, sf_dir).select("doc_id", "lang", F.replace(F.col("text"), F.lit("the"), F.lit('"the"')).alias("text"))
    write_csv(docs, path)
    return read_quoted_csv(spark, path, "doc_id long, text string, lang string")


def text_lines(spark, sf_dir):
    """Sentences written in key order come back numbered in that order."""
    path = new_path(spark, "lines")
    rows = fx.tagged(spark, sf_dir).repartitionByRange("row_id").sortWithinPartitions("row_id")
    rows.select("sentence").write.text(path)
    return read_tagged_text(spark, path)


def document_lines(spark, sf_dir):
    """Lines of whole documents, written as text files and read back."""
    path = new_path(spark, "documents")
    fx.documents(spark, sf_dir).select("text").write.text(path)
    lines = read_tagged_text(spark, path)
    return lines.groupBy("sentence").agg(F.count(F.lit(1)).alias("n_lines"))


def tagged_csv(spark, sf_dir):
    """Columns in another order, with others between; the key comes from the file."""
    path = new_path(spark, "tagged-csv")
    rows = fx.tagged(spark, sf_dir).select(F.lit("x").alias("note"), "sentence", (F.col("row_id") % 3).alias("part"), "row_id")
    write_csv(rows, path)
    return read_tagged_csv(spark, path)


def noun_csv(spark, sf_dir):
    """The file repeats most nouns once per analyzer, so it is written compressed."""
    path = new_path(spark, "nouns")
    wide = fx.noun_table(spark, sf_dir)

    def printed(column: str) -> Column:
        """Every fourth noun gets a quote inside, and so the other kind around it."""
        quoted = F.transform(
            column,
            lambda x, i: F.when(i % 4 == 1, F.concat(F.lit('"'), x, F.lit("'s\""))).otherwise(
                F.concat(F.lit("'"), x, F.lit("'"))
            ),
        )
        return F.concat(F.lit("["), joined(quoted, ", "), F.lit("]")).alias(column)

    write_csv(wide.select("doc_id", *[printed(c) for c in wide.columns[1:]]), path, compression="lz4")
    docs = noun_documents(read_noun_csv(spark, path))
    return docs.select("doc_id", "analyzer", F.size("nouns").cast("bigint").alias("n_nouns"), noun_text(F.col("nouns")).alias("text"))


# --- text features and clusters ----------------------------------------------------------------


def kkma_documents(spark, sf_dir):
    return fx.noun_table(spark, sf_dir).select("doc_id", F.col("kkma_nouns").alias("nouns"))


def q_noun_documents(spark, sf_dir):
    return noun_documents(fx.noun_table(spark, sf_dir)).select("doc_id", "analyzer", noun_text(F.col("nouns")).alias("text"))


def flattened_nouns(spark, sf_dir):
    """All noun lists as one bag of nouns."""
    nouns = elements(kkma_documents(spark, sf_dir), ["doc_id"], F.col("nouns"), "noun", pos="pos")
    return nouns.withColumn("pos", F.col("pos").cast("bigint"))


def tfidf_vocab(spark, sf_dir):
    docs = term_documents(kkma_documents(spark, sf_dir), noun_text(F.col("nouns")), "doc_id")
    return vocabulary(docs).select("term", "df", six("idf"))


def top_terms(spark, sf_dir):
    """The most frequent terms, by bounded summaries and an exact second count."""
    docs = term_documents(kkma_documents(spark, sf_dir), noun_text(F.col("nouns")), "doc_id")
    found = heavy_hitters(materialise(docs, "terms"), F.col("terms"), TOP_TERMS, TERM_COUNTERS)
    return found.select(F.col("item").alias("term"), F.col("n").alias("df"))


def tfidf_weights(spark, sf_dir):
    return tfidf(kkma_documents(spark, sf_dir)).select("doc_id", "term", six("weight"))


def tfidf_by_analyzer(spark, sf_dir):
    docs = noun_documents(fx.noun_table(spark, sf_dir))
    return tfidf(docs, by=["analyzer"]).select("analyzer", "doc_id", "term", six("weight"))


def centre_assignment(spark, sf_dir):
    points = fx.vectors(spark, sf_dir)
    centres = cluster.cluster_means(points, "label", "embedding")
    return cluster.assign_to_centres(points, centres, "embedding").select("vec_id", "label", "cluster")


def exact_rows(spark, sf_dir):
    points = fx.vectors(spark, sf_dir).withColumn("labels", F.array("label"))
    return silhouette.silhouette_exact(points, "vec_id", "embedding")


def squared_rows(spark, sf_dir):
    return silhouette.silhouette_squared(fx.vectors(spark, sf_dir), "vec_id", "embedding", "label")


def silhouette_rows(spark, sf_dir):
    return exact_rows(spark, sf_dir).select("vec_id", "cluster", six("a"), six("b"), six("s"))


def silhouette_mean(spark, sf_dir):
    return exact_rows(spark, sf_dir).agg(F.avg("s").alias("silhouette")).select(six("silhouette"))


def silhouette_sq_rows(spark, sf_dir):
    return squared_rows(spark, sf_dir).select("vec_id", "label", six("a"), six("b"), six("s"))


def silhouette_sq_mean(spark, sf_dir):
    return squared_rows(spark, sf_dir).agg(F.avg("s").alias("silhouette_sq")).select(six("silhouette_sq"))


def silhouette_profile(spark, sf_dir):
    scored = exact_rows(spark, sf_dir).select("vec_id", "cluster", six("s"))
    return silhouette.silhouette_profile(scored, ["cluster"], "vec_id").select(
        "cluster", "position", "vec_id", "s", "cluster_size"
    )


def silhouette_profile_sq(spark, sf_dir):
    """Profiles of two labellings, from the linear form."""
    points = fx.vectors(spark, sf_dir).withColumn("halves", F.col("label") % 2)
    scored = [
        silhouette.silhouette_squared(points, "vec_id", "embedding", c).select(
            F.lit(c).alias("labelling"), F.col(c).cast("int").alias("cluster"), "vec_id", six("s")
        )
        for c in ("label", "halves")
    ]
    both = scored[0].unionByName(scored[1])
    return silhouette.silhouette_profile(both, ["labelling", "cluster"], "vec_id").select(
        "labelling", "cluster", "position", "vec_id", "s", "cluster_size"
    )


def silhouette_sampled_rows(spark, sf_dir):
    """The sampled form, whose samples hold small clusters whole."""
    return silhouette_sampled.silhouette_sampled(fx.vectors(spark, sf_dir), "vec_id", "embedding", "label").select(
        "vec_id", F.col("label").alias("cluster"), six("a"), six("b"), six("s")
    )


def coreset_sweep(spark, sf_dir):
    """Costs over all rows of centres fitted to one weighted sample."""
    points = materialise(fx.vectors(spark, sf_dir), "points")
    fits = coreset.fit_centres(coreset.coreset(points, "vec_id", "embedding"))
    return coreset.sweep_costs(coreset.label_all(points, "embedding", fits))


def q_centre_update(spark, sf_dir):
    """One k-means step from the label means."""
    points = fx.vectors(spark, sf_dir)
    centres = cluster.cluster_means(points, "label", "embedding")
    moved = cluster.centre_update(points, centres, "embedding")
    return elements(moved, ["cluster"], F.col("centre"), "x", pos="dim").select(
        "cluster", F.col("dim").cast("bigint").alias("dim"), six("x")
    )


def q_sweep_by_analyzer(spark, sf_dir):
    return sweep_by_analyzer(fx.noun_table(spark, sf_dir))


def cluster_rows(spark, sf_dir):
    """Silhouettes of one cluster only."""
    return silhouette_sq_rows(spark, sf_dir).filter(F.col("label") == 3)


def pca_2d(spark, sf_dir):
    return cluster.pca_2d(fx.vectors(spark, sf_dir)).select("vec_id", *[F.get("point", F.lit(i)).alias(n) for i, n in enumerate("xy")])


def neighbour_links(spark, sf_dir):
    return neighbour_graph(fx.vectors(spark, sf_dir), "vec_id", "embedding").select("vec_id", "neighbour", six("distance"))


def layout_2d(spark, sf_dir):
    """Two coordinates that keep neighbourhoods, where ``pca_2d`` is linear."""
    return neighbour_layout(fx.vectors(spark, sf_dir), "vec_id", "embedding").select(
        "vec_id", *[F.get("point", F.lit(i)).alias(n) for i, n in enumerate("xy")]
    )


def kmeans_sweep(spark, sf_dir):
    return sweep_means(sweep_scores(cluster.pca_2d(fx.vectors(spark, sf_dir)), "vec_id", exact=True))


def kmeans_sweep_squared(spark, sf_dir):
    return sweep_means(sweep_scores(cluster.pca_2d(fx.vectors(spark, sf_dir)), "vec_id", exact=False))


def tfidf_2d(spark, sf_dir):
    return documents_2d(kkma_documents(spark, sf_dir)).select("doc_id", *[F.get("point", F.lit(i)).alias(n) for i, n in enumerate("xy")])


QUERIES = {
    "tag_extract": tag_extract,
    "tag_split": entity_rows,
    "clean_sentence": clean,
    "clean_sentence_basic": clean_basic,
    "corrections": corrected,
    "label_string": label_strings,
    "joined_entity": joined_entity,
    "prefixed": prefixed,
    "name_tag_arrays": name_tag_arrays,
    "prepare_train": prepare_train,
    "prepare_test": prepare_test,
    "strip_prefix": strip_prefix,
    "strip_decoded": strip_decoded,
    "model_columns": model_ready,
    "tag_counts": q_tag_counts,
    "tag_share": q_tag_share,
    "tag_share_mean": q_tag_share_mean,
    "entity_dictionary": q_entity_dictionary,
    "distinct_names": q_distinct_names,
    "dictionary_sizes": q_dictionary_sizes,
    "unique_tags": unique_tags,
    "label_indicators": q_label_indicators,
    "length_profile": q_length_profile,
    "label_length_profile": label_length_profile,
    "value_quantiles": value_quantiles,
    "row_numbering": row_numbering,
    "stratified_folds": folds,
    "fold_signatures": folds_default,
    "train_valid_split": train_valid_split,
    "first_fold": first_fold,
    "index_gather": index_gather,
    "split_counts": q_split_counts,
    "label_fold_quotas": label_fold_quotas,
    "label_fold_balance": label_fold_balance,
    "entity_swap": entity_swap,
    "entity_swap_joined": entity_swap_joined,
    "augmented_union": augmented_union,
    "vocab_build": vocab_build,
    "encode_ids": encode_ids,
    "encode_augmented": encode_augmented,
    "encode_documents": encode_documents,
    "mask_restore": mask_restore,
    "decode_ids": decode_ids,
    "subword_round_trip": subword_round_trip,
    "subword_reserved": subword_reserved,
    "subword_encode": subword_encode,
    "align_predictions": align_predictions,
    "segment_parse": segment_parse,
    "entity_precision": entity_precision,
    "entity_recall": entity_recall,
    "entity_f1_acc": entity_f1_acc,
    "entity_counts_long_rows": entity_counts_long_rows,
    "entity_f1_macro": q_entity_f1_macro,
    "bleu_rows": bleu_rows,
    "bleu_stats": q_bleu_stats,
    "bleu_score": bleu_score,
    "evaluation_report": evaluation_report,
    "evaluation_missing": evaluation_missing,
    "evaluation_from_ids": evaluation_from_ids,
    "run_metrics": lambda spark, sf_dir: run_metrics(spark, sf_dir).select("run_id", six("bleu"), six("f1"), six("acc")),
    "best_run": best_run,
    "batch_map": q_batch_map,
    "batch_predict": q_batch_predict,
    "pred_label_rows": q_pred_label_rows,
    "submission_rows": q_submission_rows,
    "submission_csv": submission_csv,
    "metrics_json": metrics_json,
    "run_notes": run_notes,
    "quoted_csv": quoted_csv,
    "text_lines": text_lines,
    "document_lines": document_lines,
    "tagged_csv": tagged_csv,
    "noun_csv": noun_csv,
    "noun_documents": q_noun_documents,
    "flattened_nouns": flattened_nouns,
    "tfidf_vocab": tfidf_vocab,
    "top_terms": top_terms,
    "tfidf_weights": tfidf_weights,
    "tfidf_by_analyzer": tfidf_by_analyzer,
    "centre_assignment": centre_assignment,
    "silhouette_rows": silhouette_rows,
    "silhouette_mean": silhouette_mean,
    "silhouette_sq_rows": silhouette_sq_rows,
    "silhouette_sq_mean": silhouette_sq_mean,
    "silhouette_profile": silhouette_profile,
    "silhouette_profile_sq": silhouette_profile_sq,
    "silhouette_sampled_rows": silhouette_sampled_rows,
    "coreset_sweep": coreset_sweep,
    "centre_update": q_centre_update,
    "sweep_by_analyzer": q_sweep_by_analyzer,
    "cluster_rows": cluster_rows,
    "pca_2d": pca_2d,
    "neighbour_links": neighbour_links,
    "layout_2d": layout_2d,
    "kmeans_sweep": kmeans_sweep,
    "kmeans_sweep_squared": kmeans_sweep_squared,
    "tfidf_2d": tfidf_2d,
}
