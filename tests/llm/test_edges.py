"""Every operator on nulls, empty and very long texts, repeated rows, empty tables and odd columns."""

import re

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tagloom.llm import fertility
from tagloom.llm.chat_format import format_turns, read_back
from tagloom.llm.decontaminate import contamination, drop_contaminated
from tagloom.llm.fertility import fertility_rules
from tagloom.llm.html_content import main_text
from tagloom.llm.mixing import mix, mixture
from tagloom.llm.near_dedup import keep_one_of_each, near_duplicates
from tagloom.llm.pii import personal_data
from tagloom.llm.quality_knn import keep_good, quality_scores
from tagloom.llm.sharding import assign_shards
from tagloom.llm.token_counts import token_counts

LONG = "lorem ipsum dolor 12.5 " * 40_000
# Columns whose names the operators use for themselves.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, hit string, k int, _score int, block int, _id int, _dropped int, row int, runs int"
ROWS = [
    (1, None, None, None, None, 1, 1, "h", 1, 1, 1, 1, 1, 1, 1),
    (2, "", "en", "a", 0, 1, 1, "h", 1, 1, 1, 1, 1, 1, 1),
    (3, LONG, "en", "a", len(LONG), 1, 1, "h", 1, 1, 1, 1, 1, 1, 1),
    (4, "a a a a a", "en", "a", 9, 1, 1, "h", 1, 1, 1, 1, 1, 1, 1),
    (4, "a a a a a", "en", "a", 9, 1, 1, "h", 1, 1, 1, 1, 1, 1, 1),
    (5, "\n\t ", "fr", "b", 3, 1, 1, "h", 1, 1, 1, 1, 1, 1, 1),
    (None, "mail me at x.y@example.com or +1 (555) 123-4567", None, "b", 4, 1, 1, "h", 1, 1, 1, 1, 1, 1, 1),
    (6, "漢字かな交じり文 🙂 é", "ja", None, 14, 1, 1, "h", 1, 1, 1, 1, 1, 1, 1),
]
LABELS = [(3, 1, 0), (4, 0, 0), (6, 1, 0), (2, None, 0), (1, 1, 0), (99, 1, 0), (4, 1, 0)]
ITEMS = [(1, "lorem ipsum dolor 12 5 lorem ipsum dolor 12 5 lorem ipsum dolor 12"), (2, None), (3, ""), (None, "é")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3, "k").persist()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


def test_operators_return_every_row(docs, labels, items):
    n = len(ROWS)
    scores = quality_scores(docs, labels).collect()
    assert len(scores) == n and all(0 <= r.score <= 1 for r in scores)
    groups = near_duplicates(docs).collect()
    assert len(groups) == n
    assert all(r.kept for r in groups) and {r.component_id for r in groups if r.doc_id} == {1, 2, 3, 4, 5, 6}
    rules = {r.doc_id: r for r in fertility_rules(docs).collect()}
    assert rules[4].n_repeat_words == 5 and rules[1].base_failed and not rules[2].kept
    hits = {r.doc_id: r for r in contamination(docs, items).collect()}
    assert hits[3].contaminated and hits[3].n_items == 1 and hits[6].n_hit == 1 and hits[6].n_items == 0
    assert hits[1].n_words == 0 and not hits[1].contaminated
    counts = {r.doc_id: r for r in token_counts(docs).collect()}
    assert counts[1].n_tokens == counts[2].n_tokens == 0 and counts[3].over_limit
    found = {r.doc_id: r for r in personal_data(docs).collect()}
    assert (found[None].n_email, found[None].n_phone, found[2].spans) == (1, 1, "")
    assert assign_shards(docs, 4).count() == n
    assert mixture(docs).select("doc_id").distinct().count() == n - 1


def test_texts_without_words_beside_a_band(spark):
    """Their language has a band, as other documents pass; long runs of white space are encoded whole."""
    rows = [(i, " ".join(f"w{(i * k) % 97}" for k in range(2, 90)), "en") for i in range(1, 40)]
    texts = [None, "", " ", "\n\t\n", "\u3000", "a" + " " * 1_100_000 + "b\n", "\n" * 1_100_000]
    odd = [(100 + i, text, "en") for i, text in enumerate(texts)]
    found = {r.doc_id: r for r in fertility_rules(spark.createDataFrame(rows + odd, "doc_id long, text string, lang string")).collect()}
    assert len(found) == len(rows) + len(odd) and any(found[r[0]].kept for r in rows)
    assert [found[r[0]].n_words for r in odd] == [0, 0, 0, 0, 1, 2, 0]
    assert all(found[r[0]].base_failed and not found[r[0]].kept for r in odd)


def test_runs_of_white_space_are_one_match(monkeypatch):
    coder = fertility.Coder(*map(public_tokenizers.path, (fertility.PAIRS, fertility.PIECES)))
    texts = ["", " ", "a    b", "   ", "  x\t\t\t y \u3000\u3000\u3000.\x85\x85\x85", "a\x1c\x1c\x1cb  's   's", "\t\t\t\t'll    12"]
    whole = [len(coder.pairs.encode(t)) for t in texts]
    monkeypatch.setattr(fertility, "LONG_TEXT", 0)
    monkeypatch.setattr(fertility, "RUNS", re.compile(fertility.RUNS.pattern.replace(str(fertility.LONG_RUN), "2")))
    assert [coder.n_pairs(t) for t in texts] == whole


def test_stages_keep_the_columns(docs, labels, items):
    for kept in (keep_good(docs, labels), keep_one_of_each(docs), drop_contaminated(docs, items), mix(docs)):
        assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
    assert {r.doc_id for r in drop_contaminated(docs, items).collect()} == {1, 2, 4, 5, None}
    assert {r.doc_id for r in mix(docs).collect()} == {1, 2, 3, 4, 5, 6, None}
    assert keep_one_of_each(docs).count() == len(ROWS)


def test_empty_tables(docs, labels, items):
    none = docs.limit(0)
    frames = [
        quality_scores(none, labels), near_duplicates(none), fertility_rules(none), contamination(none, items),
        token_counts(none), personal_data(none), assign_shards(none), mixture(none), mix(none), keep_one_of_each(none),
    ]
    assert [f.count() for f in frames] == [0] * len(frames)
    assert {r.score for r in quality_scores(docs, labels.limit(0)).collect()} == {0.5}
    assert not contamination(docs, items.limit(0)).filter("n_hit > 0").count()


def test_pages(spark):
    rows = [(1, "u", None), (2, "u", ""), (3, "u", "<p>only"), (4, "u", "<" * 50_000), (4, "u", "<p>x" * 50_000), (5, None, "<nav>a</nav>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1))
    found = sorted((r.page_id, r.n_chars) for r in main_text(pages).collect())
    assert found[:3] == [(1, 0), (2, 0), (3, 4)] and len(found) == 6 and found[-1] == (5, 0)
    assert main_text(pages.limit(0)).count() == 0


def test_conversations(spark):
    rows = [
        (1, 0, "user", None), (1, 1, None, "x"), (1, 1, None, "x"), (None, 0, "assistant", "<|end|>\\ é"),
        (2, None, "assistant", ""), (3, 0, "as\nsist\\ant", "<|turn|>user\nhi<|end|>\n[INST]<s></s>"),
        (4, 0, "assistant", "y" * 5_000_000),
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(0))
    back = {r.conv_id: r for r in read_back(format_turns(turns)).collect()}
    assert {k: r.n_turns for k, r in back.items()} == {1: 3, None: 1, 2: 1, 3: 1, 4: 1}
    assert back[4].loss_chars == 5_000_000 and back[None].loss_chars == 10 and back[3].loss_chars == 0
    assert read_back(format_turns(turns.limit(0))).count() == 0


def test_pipeline_runs_from_end_to_end(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    result = corpus_pipeline.run(spark, small).persist()
    slots = result.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.max("slot").alias("last")).collect()
    assert all(r["n"] == r["last"] + 1 for r in slots)
    kept = result.select("doc_id").distinct()
    assert kept.join(docs, "doc_id", "left_anti").count() == 0
    left = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, left, small).persist()
        # Filters drop whole documents and the mixture shows each of the others at least once.
        assert after.join(left, "doc_id", "left_anti").count() == 0
        lost = left.join(after, "doc_id", "left_anti").count()
        assert lost == 0 if name == "mix_sources" else 0 <= lost < left.count() / 2
        left = after
    assert left.select("doc_id").distinct().count() == kept.count() < docs.count()
