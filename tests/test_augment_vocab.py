"""Entity swap and vocabulary."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tagloom.checks import fixtures as fx
from tagloom.operators import vocab as vocab_module
from tagloom.operators.augment import augment, replace_first, swap_entities
from tagloom.operators.vocab import build_vocabulary, decode, encode, restore_mask
from tagloom.plans.prepare import LABEL_PREFIX, PREFIX, prepare


@pytest.fixture(scope="module")
def prepared(spark, small):
    frame = prepare(fx.tagged(spark, small), PREFIX, LABEL_PREFIX).persist()
    yield frame
    frame.unpersist()


def test_replace_first_in_order(spark):
    cases = [
        ("홍 길동이 서울에서", [("홍 길동", "김:X"), ("서울", "서울 서울"), ("서울", "부산")], "김:X이 부산 서울에서"),
        ("1 000명", [("1,000명", "둘")], "1 000명"),
        ("abc", [("", "Z")], "Zabc"),
        ("a.b a.b", [("a.b", "$1\\")], "$1\\ a.b"),
    ]
    for text, steps, want in cases:
        column = F.lit(text)
        for old, new in steps:
            column = replace_first(column, F.lit(old), F.lit(new))
        assert spark.range(1).select(column.alias("x")).first().x == want


def test_both_forms_agree_and_keep_tags(prepared):
    inline = swap_entities(prepared, 2)
    joined = swap_entities(prepared.repartition(17), 2, inline_bytes=0)
    a, b = (sorted(map(tuple, f.collect())) for f in (inline, joined))
    assert a == b and len(a) == 2 * prepared.count()
    tags = {r.row_id: r.entity for r in prepared.select("row_id", "entity").collect()}
    names = {(r.tag, r.name) for r in prepared.select(F.explode("labels").alias("l")).select("l.tag", "l.name").collect()}
    for row_id, _, _, label in a[:300]:
        parts = [p for p in label.split(" ")]
        assert [p.split(":")[-1] for p in parts if ":" in p] == tags[row_id]
    single = [(r[0], r[3]) for r in a if " " not in r[3] and r[3]]
    assert all((label.split(":")[1], label.split(":")[0]) in names for _, label in single)


def test_rounds_and_originals(prepared):
    n = prepared.count()
    for rounds in (0, 1, 3):
        rows = augment(prepared, rounds)
        assert rows.count() == (rounds + 1) * n
        originals = rows.filter("round = 0").select("row_id", "input_sentence", "train_label")
        assert originals.exceptAll(prepared.select("row_id", "input_sentence", "train_label")).count() == 0


def test_rows_without_entities_and_odd_names(spark):
    rows = prepare(
        spark.createDataFrame(
            [(1, "plain"), (2, "<3:30:TI>에"), (3, "<a,b:PS>c"), (4, "<:LC>x")], "row_id long, sentence string"
        )
    )
    for inline in (1 << 20, 0):
        found = {r.row_id: (r.input_sentence, r.train_label) for r in swap_entities(rows, 1, inline_bytes=inline).collect()}
        # One name per tag: every draw returns it. Middle parts of a label stay.
        assert found == {1: ("plain", ""), 2: ("3에", "3:30:TI"), 3: ("a bc", "a,b:PS"), 4: ("x", ":LC")}
    prefixed = {r.row_id: r.train_label for r in swap_entities(rows, 1, label_prefix="p:").collect()}
    assert prefixed == {1: "p:", 2: "p: 3:30:TI", 3: "p: a,b:PS", 4: "p: :LC"}


def test_given_dictionary_may_lack_a_tag(spark):
    rows = prepare(spark.createDataFrame([(1, "<a:PS> <b:LC>"), (2, "<c:LC>")], "row_id long, sentence string"))
    dictionary = spark.createDataFrame([("PS", 0, "new")], "tag string, idx long, name string")
    for inline in (1 << 20, 0):
        found = swap_entities(rows, 1, dictionary=dictionary, inline_bytes=inline).collect()
        assert {r.row_id: (r.input_sentence, r.train_label) for r in found} == {1: ("new b", "new:PS b:LC"), 2: ("c", "c:LC")}


def test_vocabulary_order_and_cap(spark):
    texts = spark.createDataFrame([("b a b x:PSy",), ("a b :PS",)], "text string")
    full = {r.token: r.id for r in build_vocabulary(texts, ["text"]).collect()}
    assert full == {
        "<pad>": 0, "</s>": 1, "<unk>": 2, ":DT": 3, ":LC": 4, ":OG": 5, ":PS": 6, ":QT": 7, ":TI": 8,
        "b": 9, "a": 10, "x": 11, "y": 12,
    }
    capped = {r.token: r.id for r in build_vocabulary(texts, ["text"], max_size=11).collect()}
    assert capped == {k: v for k, v in full.items() if v < 11}


def test_encode_and_decode(spark):
    texts = spark.createDataFrame([(1, "b a q x:PSy"), (2, ""), (3, "a a a a a")], "row_id long, text string")
    vocab = build_vocabulary(texts.filter("row_id <> 1").unionByName(spark.createDataFrame([(9, "x y b")], texts.schema)), ["text"])
    ids = {r.token: r.id for r in vocab.collect()}
    coded = {r.row_id: r.ids for r in encode(texts, vocab, "text", 4).collect()}
    assert coded == {1: [ids["b"], ids["a"], 2, 1], 2: [1], 3: [ids["a"]] * 3 + [1]}
    full = encode(texts, vocab, "text", 100)
    masked = full.withColumn("ids", F.concat("ids", F.array(F.lit(-100), F.lit(-100))))
    assert {r.row_id: r.ids[-2:] for r in masked.select("row_id", restore_mask(F.col("ids")).alias("ids")).collect()}[1] == [0, 0]
    text = {r.row_id: r.text for r in decode(masked.withColumn("ids", restore_mask(F.col("ids"))), vocab).collect()}
    assert text == {1: "b a x :PS y", 2: "", 3: "a a a a a"}


def test_rare_tokens_take_the_shuffled_join(prepared, monkeypatch):
    vocab = build_vocabulary(prepared, ["input_sentence", "train_label"]).persist()
    want = sorted(map(str, encode(prepared, vocab, "input_sentence", 100).collect()))
    text = sorted(map(str, decode(encode(prepared, vocab, "input_sentence", 100), vocab).collect()))
    monkeypatch.setattr(vocab_module, "HEAD_ENTRIES", 15)
    coded = encode(prepared, vocab, "input_sentence", 100)
    assert sorted(map(str, coded.collect())) == want
    assert sorted(map(str, decode(coded, vocab).collect())) == text
    vocab.unpersist()


def test_sparse_ids_and_repeated_rows(spark, monkeypatch):
    """Ids may have gaps, and rows that share a key stay apart, on both paths."""
    vocab = spark.createDataFrame([("<unk>", 2), ("a", 7), ("b", 60_000), ("long" * 40, 70_000)], "token string, id int")
    texts = spark.createDataFrame(
        [(1, 0, "a b"), (1, 1, "b q"), (1, 1, "b q"), (2, 0, None), (3, 0, "long" * 40)], "row_id long, round int, text string"
    )
    want = [(1, 0, [7, 60_000, 1]), (1, 1, [60_000, 2, 1]), (1, 1, [60_000, 2, 1]), (2, 0, [1]), (3, 0, [70_000, 1])]
    for head in (500_000, 2, 0):
        monkeypatch.setattr(vocab_module, "HEAD_ENTRIES", head)
        coded = encode(texts, vocab, "text", 100, keys=["row_id", "round"])
        assert sorted((r.row_id, r["round"], r.ids) for r in coded.collect()) == want
        text = decode(coded, vocab, keys=["row_id", "round"]).collect()
        assert sorted(r.text for r in text) == ["", "a b", "b", "b", "long" * 40]
    assert encode(texts, vocab, "text", None).count() == 5


def test_a_vocabulary_that_fits_needs_no_shuffle(prepared):
    vocab = build_vocabulary(prepared, ["input_sentence"])
    plan = encode(prepared, vocab, "input_sentence", 100)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.split("InMemoryRelation")[0]


def test_rest_of_a_vocabulary_and_odd_column_names(spark, monkeypatch):
    """Entries beyond the look-up, frequent unknown tokens, columns with the names used inside."""
    from tagloom.operators import vocab as v

    texts = [f"a b w{i} w{i} unknown" for i in range(40)]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "row_id long, text string")
    table = v.build_vocabulary(frame, ["text"]).filter("token <> 'unknown'")
    want = {r.row_id: r.ids for r in v.encode(frame, table, "text", None).collect()}
    odd = frame.selectExpr("*", "'x' AS _coded_row", "1 AS _row", "2 AS _key", "3 AS _own")
    for entries in (3, 30):
        monkeypatch.setattr(v, "HEAD_ENTRIES", entries)
        coded = v.encode_columns(odd, table, {"ids": ("text", None)})
        assert coded.columns == [*odd.columns, "ids"]
        assert {r.row_id: r.ids for r in coded.collect()} == want


def test_the_head_of_a_vocabulary_is_filtered_not_sorted(spark, monkeypatch):
    """Each task of a sorted limit sends up to the whole limit to the driver."""
    monkeypatch.setattr(vocab_module, "HEAD_ENTRIES", 40)
    vocab = spark.range(200, numPartitions=8).selectExpr("concat('t', id) AS token", "cast(id AS int) AS id")
    monkeypatch.setattr(type(vocab), "orderBy", lambda *_: pytest.fail("sorted limit"))
    entries, whole = vocab_module._head(vocab)
    assert entries == [(f"t{i}", i) for i in range(40)] and not whole
    sparse = vocab.filter("id % 10 = 0").selectExpr("token", "id * 1000 AS id")
    assert vocab_module._head(sparse) == ([(f"t{i}", i * 1000) for i in range(0, 200, 10)], True)


def test_tokens_of_a_batch():
    """Like splitting each text on its own, wherever white space is, and cut at the limit."""
    spaces = [chr(c) for c in range(0x110000) if chr(c).isspace()]
    texts = [f"{s}a{s}{s}b:PS{s}" for s in spaces] + [None, "", " ", "x", " :OG", "a\u200bb 가:LC나", "a b c d e f"]
    split = [(t or "").replace(":PS", " :PS ").replace(":OG", " :OG ").replace(":LC", " :LC ").split() for t in texts]
    tokens = vocab_module._tokeniser()
    for n in range(1, len(texts) + 1):
        assert tokens(pa.array(texts[:n], pa.string())).to_pylist() == split[:n]
    assert tokens(pa.array(texts, pa.string()).slice(3, 9), 2).to_pylist() == [t[:2] for t in split[3:12]]
    assert tokens(pa.array([], pa.string()), 2).to_pylist() == []


def test_rows_are_stored_as_ids_with_only_their_open_tokens(spark, monkeypatch):
    """Neither texts nor the tokens that were found are written; a row with a null text adds nothing to the vocabulary."""
    stored = {}

    def keep(df, name):
        stored[name] = df.localCheckpoint()
        return stored[name]

    rows = [(i % 7, f"often w{i} often {'x' * 70}", f"n{i}:PS often") for i in range(40)] + [(50, None, "lost"), (51, "", "often")]
    frame = spark.createDataFrame(rows, "row_id long, text string, label string")
    vocab = build_vocabulary(frame, ["text", "label"])
    ids = {r.token: r.id for r in vocab.collect()}
    assert "lost" not in ids and ids["often"] == 9 and ids["x" * 70] == 10 and len(ids) == 9 + 2 + 80
    monkeypatch.setattr(vocab_module, "HEAD_ENTRIES", 12)
    monkeypatch.setattr(vocab_module, "materialise", keep)
    coded = vocab_module.encode_columns(frame, vocab, {"a": ("text", 4), "b": ("label", None)}, keep=["row_id"])
    assert coded.columns == ["row_id", "a", "b"]
    want = [(r, [ids["often"], ids[t.split()[1]], ids["often"], 1], [ids[n.split(":")[0]], 6, ids["often"], 1]) for r, t, n in rows[:40]]
    assert sorted(map(tuple, coded.collect())) == sorted([*want, (50, [1], [2, 1]), (51, [1], [ids["often"], 1])])
    found = stored["resolved"]
    assert found.columns == ["row_id", "_coded", "_coded_row"]
    open_keys = [o.key for r in found.collect() for o in r._coded.open]
    assert "often" not in open_keys and len(open_keys) <= 81
