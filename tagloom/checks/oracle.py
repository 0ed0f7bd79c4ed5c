"""The same queries as SQL over the supplied tables, for an independent engine.

Written from the behaviour, not from the Spark plans: plain patterns with lazy dots, global
windows, cross joins and recursive list folds are fine here, where data is small.
"""

from __future__ import annotations

from tagloom.checks.queries import ROUNDS
from tagloom.checks.stub_model import RULES
# Fixed values, spelled out here so that a wrong one in the package does not pass on both sides.
WS = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"
SPECIALS = ("<pad>", "</s>", "<unk>")
RESERVED = (":DT", ":LC", ":OG", ":PS", ":QT", ":TI")
INPUT_LIMIT, LABEL_LIMIT = 100, 90
PREFIX, LABEL_PREFIX = "extract entity:", "extracted entity:"

TAGGED = """
tagged as (
 select o_orderkey as row_id,
 concat('주문 ', cast(o_orderkey as varchar(20)), ' <', c_name, ':PS>',
  case when o_orderkey % 3 <> 0 then concat('이 <', n_name, ':LC>에서') else '' end,
  case when o_orderkey % 2 = 0 then concat(' <', cast(cast(o_orderdate as date) as varchar(10)), ':DT>에!! ') else '' end,
  case when o_orderkey % 5 = 0 then concat(' <', cast(o_orderkey % 24 as varchar(5)), '시:TI>쯤') else '' end,
  case when o_orderkey % 7 < 3 then concat(' <', c_mktsegment, ':OG> 부문') else '' end,
  case when o_orderkey % 4 = 1 then concat(' (<', cast(o_orderkey % 1000 as varchar(5)), '개:QT>)') else '' end,
  ' 샀다~~') as sentence
 from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey)"""

CORRECTED = """
corrected as (
 select row_id, case when row_id = 5 then replace(sentence, '<5시:TI>', '<다섯 시:TI>') else sentence end as sentence
 from tagged)"""


def strip(text: str) -> str:
    return f"regexp_replace(regexp_replace({text}, '^{WS}+', ''), '{WS}+$', '')"


def basic_clean(text: str) -> str:
    text = f"replace(regexp_replace({text}, ':.*?>', '', 'g'), '<', '')"
    text = f"regexp_replace({text}, '[^가-힣a-zA-Z0-9.%~]', ' ', 'g')"
    return f"trim(regexp_replace({text}, '[ ]+', ' ', 'g'))"


def full_clean(text: str) -> str:
    return f"regexp_replace(regexp_replace({basic_clean(text)}, '[~]+', '~', 'g'), '[%]+', '%', 'g')"


def prepared(source: str = "tagged", prefix: str = "", label_prefix: str = "") -> str:
    """CTEs ``raws`` and ``prep`` over ``source``."""
    return f"""
raws as (
 select row_id, sentence,
  list_transform(regexp_extract_all(sentence, '<.*?:.*?>'), lambda m: replace(replace(m, '<', ''), '>', '')) as raw
 from {source}),
prep as (
 select row_id, sentence, raw,
  list_transform(raw, lambda m: split_part(m, ':', 1)) as name,
  list_transform(raw, lambda m: split_part(m, ':', -1)) as entity,
  {strip(f"concat('{label_prefix}', ' ', array_to_string(raw, ' '))")} as train_label,
  {strip(f"concat('{prefix}', ' ', {full_clean('sentence')})")} as input_sentence,
  array_to_string(list_transform(raw, lambda m: split_part(m, ':', -1)), ' ') as joined_entity
 from raws)"""


PLAIN = f"{TAGGED},{prepared()}"
PREFIXED = f"{TAGGED},{prepared('tagged', PREFIX, LABEL_PREFIX)}"

ENTITIES = """
ents as (
 select row_id, unnest(range(len(raw))) as pos, unnest(raw) as raw, unnest(name) as name, unnest(entity) as tag
 from prep)"""


def folds(k: int) -> str:
    return f"""
sigs as (select *, array_to_string(list_sort(list_distinct(entity)), ' ') as sig,
  md5(concat(row_id, '|1514')) as h from prep),
folds as (select *, cast((row_number() over (order by sig, h, row_id) - 1) % {k} as integer) as fold from sigs)"""


DICTIONARY = """
dict as (
 select tag, name, row_number() over (partition by tag order by md5(name), name) - 1 as idx
 from (select distinct tag, name from ents)),
dict_sizes as (select tag, count(*) as n from dict group by tag)"""

SWAPPED = f"""
picks as (
 select e.row_id, r.round, list({{'name': e.name, 'new': d.name, 'raw': e.raw}} order by e.pos) as picks
 from ents e cross join (select unnest(range(1, {ROUNDS + 1})) as round) r
 join dict_sizes s on s.tag = e.tag
 join dict d on d.tag = e.tag
  and d.idx = cast('0x' || substring(md5(concat_ws('|', e.row_id, r.round, e.pos, 1514)), 1, 15) as bigint) % s.n
 group by 1, 2),
swapped as (
 select p.row_id, cast(r.round as integer) as round,
  case when k.picks is null then input_sentence else
   list_reduce(k.picks, lambda t, x: case when strpos(t, x.name) = 0 then t else
     concat(substring(t, 1, strpos(t, x.name) - 1), x.new, substring(t, strpos(t, x.name) + length(x.name))) end,
    input_sentence) end as input_sentence,
  coalesce(array_to_string(list_transform(k.picks,
    lambda x: concat(x.new, substring(x.raw, length(x.name) + 1))), ' '), '') as train_label
 from prep p cross join (select unnest(range(1, {ROUNDS + 1})) as round) r
 left join picks k on k.row_id = p.row_id and k.round = r.round)"""

PREDICTIONS = f"""{TAGGED},{prepared()},
pairs as (
 select row_id, label,
 case when row_id % 11 = 0 then 'none'
      when row_id % 7 = 0 then replace(label, ':LC', ':OG')
      when row_id % 5 = 0 then concat('x ', label, ' 외:PS')
      when row_id % 9 = 0 then replace(label, ' ', '  ')
      else label end as pred
 from (select row_id, array_to_string(raw, ' ') as label from prep))"""

BLEU_PAIRS = """
pairs as (
 select row_id, label,
 case when row_id % 3 = 0 then replace(label, 'an', 'on') when row_id % 7 = 0 then 'a b' else label end as pred
 from (select conv_id * 100 + turn as row_id, text as label from conversations))"""


def segments(text: str) -> str:
    """Only text up to the last tag matters, so each piece ends with its tag."""
    pieces = f"regexp_extract_all({text}, '((?s:.*?))(:[A-Za-z]+)', 1)"
    tags = f"regexp_extract_all({text}, ':[A-Za-z]+')"
    return (
        f"list_transform(range(len({tags})), lambda i: {{'k': string_split("
        f"case when i = 0 then ({pieces})[1] else substring(({pieces})[i + 1], 2) end, ' '), 't': ({tags})[i + 1]}})"
    )


def token_match(one: str, other: str) -> str:
    shared = f"len(list_filter({one}.k, lambda tk: list_contains({other}.k, tk)))"
    return f"({shared} > 0 and {shared} >= len({one}.k) - 2)"


SCORED = f"""
segs as (select row_id, {segments('pred')} as ps, {segments('label')} as gs from pairs),
cand as (
 select row_id, len(ps) as n_pred, len(gs) as n_gold, ps, gs,
  list_transform(ps, lambda p: list_filter(range(len(gs)), lambda i: {token_match('p', 'gs[i + 1]')})) as options,
  len(list_filter(gs, lambda g: coalesce(list_filter(ps, lambda p: {token_match('g', 'p')})[1].t = g.t, false))) as recalled
 from segs),
greedy as (
 with recursive walk(row_id, step, used, tp) as (
  select row_id, 0::bigint, []::bigint[], 0::bigint from cand
  union all
  select w.row_id, w.step + 1,
   case when f.hit is null then w.used else list_append(w.used, f.hit) end,
   w.tp + case when f.hit is not null and c.gs[f.hit + 1].t = c.ps[w.step + 1].t then 1 else 0 end
  from walk w join cand c on c.row_id = w.row_id and w.step < c.n_pred
  cross join lateral (select list_filter(c.options[w.step + 1], lambda i: not list_contains(w.used, i))[1] as hit) f)
 select w.row_id, w.tp from walk w join cand c on c.row_id = w.row_id and w.step = c.n_pred),
scored as (
 select row_id, n_pred::bigint as n_pred, n_gold::bigint as n_gold, tp, recalled::bigint as recalled,
  case when n_pred = 0 or n_gold = 0 or tp = 0 or recalled = 0 then 0.0::double
   else 2.0::double / (1.0::double / (tp::double / n_pred) + 1.0::double / (recalled::double / n_gold)) end as f1,
  case when n_pred = 0 or n_gold = 0 or tp = 0 or recalled = 0 then 0.0::double
   else recalled::double / n_gold end as acc
 from cand join greedy using (row_id))"""


def tokens_13a(text: str) -> str:
    for old, new in (
        ("'<skipped>'", "''"),
        ("'-' || chr(10)", "''"),
        ("chr(10)", "' '"),
        ("'&quot;'", "'\"'"),
        ("'&amp;'", "'&'"),
        ("'&lt;'", "'<'"),
        ("'&gt;'", "'>'"),
    ):
        text = f"replace({text}, {old}, {new})"
    text = f"concat(' ', {text}, ' ')"
    for pattern, new in (
        (r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" \1 "),
        (r"([^0-9])([\.,])", r"\1 \2 "),
        (r"([\.,])([^0-9])", r" \1 \2"),
        (r"([0-9])(-)", r"\1 \2 "),
    ):
        text = f"regexp_replace({text}, '{pattern}', '{new}', 'g')"
    return f"list_filter(string_split_regex({text}, '{WS}+'), lambda t: t <> '')"


BLEU_ROWS = f"""
toks as (select row_id, {tokens_13a('pred')} as p, {tokens_13a('label')} as g from pairs),
sized as (select row_id, p, g, n from toks cross join (select unnest(range(1, 5)) as n)),
pgrams as (
 select row_id, n, gram, count(*) as c from (
  select row_id, n, unnest(list_transform(range(len(p) - n + 1), lambda i: array_to_string(p[i + 1:i + n], ' '))) as gram
  from sized) group by all),
ggrams as (
 select row_id, n, gram, count(*) as c from (
  select row_id, n, unnest(list_transform(range(len(g) - n + 1), lambda i: array_to_string(g[i + 1:i + n], ' '))) as gram
  from sized) group by all),
hits as (
 select a.row_id, a.n, sum(least(a.c, b.c)) as m from pgrams a join ggrams b using (row_id, n, gram) group by all),
bleu_rows as (
 select t.row_id,
  {', '.join(f"coalesce(sum(m) filter (n = {n}), 0)::bigint as matches_{n}" for n in range(1, 5))},
  {', '.join(f"greatest(any_value(len(p)) - {n - 1}, 0)::bigint as totals_{n}" for n in range(1, 5))},
  any_value(len(p))::bigint as pred_len, any_value(len(g))::bigint as label_len
 from toks t left join hits h on h.row_id = t.row_id group by t.row_id)"""

BLEU_COLUMNS = [f"{kind}_{n}" for kind in ("matches", "totals") for n in range(1, 5)] + ["pred_len", "label_len"]
BLEU_SUMS = ", ".join(f"sum({c})::bigint as {c}" for c in BLEU_COLUMNS)


def bleu_value() -> str:
    logs = []
    for n in range(1, 5):
        zeros = " + ".join(f"(case when matches_{i} = 0 then 1 else 0 end)" for i in range(1, n + 1))
        logs.append(
            f"ln(100.0::double * (case when matches_{n} > 0 then matches_{n}::double "
            f"else 1.0::double / pow(2.0, {zeros}) end) / nullif(totals_{n}, 0))"
        )
    brevity = "(case when pred_len < label_len then exp(1.0::double - label_len::double / nullif(pred_len, 0)) else 1.0::double end)"
    return (
        "case when matches_1 + matches_2 + matches_3 + matches_4 > 0 then "
        f"coalesce({brevity} * exp(({' + '.join(logs)}) / 4), 0) else 0 end"
    )


def vocab_tokens(text: str) -> str:
    for token in RESERVED:
        text = f"replace({text}, '{token}', ' {token} ')"
    return f"list_filter(string_split_regex({text}, '{WS}+'), lambda t: t <> '')"


def vocab(source: str, columns: list[str]) -> str:
    fixed = [*SPECIALS, *RESERVED]
    tokens = ", ".join(vocab_tokens(c) for c in columns)
    quoted = ", ".join(f"'{t}'" for t in fixed)
    given = " union all ".join(f"select '{t}', {i}" for i, t in enumerate(fixed))
    return f"""
vtoks as (select unnest(list_concat({tokens}{', []' if len(columns) == 1 else ''})) as token from {source}),
vranked as (select token, row_number() over (order by n desc, token) as r
  from (select token, count(*) as n from vtoks where token not in ({quoted}) group by token)),
vocab(token, id) as ({given} union all select token, cast(r + {len(fixed) - 1} as integer) from vranked)"""


def decoded(column: str) -> str:
    """Text of an encoded and decoded column: its tokens up to the limit."""
    return f"array_to_string(({vocab_tokens(column)})[1:{LABEL_LIMIT - 1}], ' ')"


def encoded(source: str, key: str, column: str, limit: int | None) -> str:
    cut = "" if limit is None else f"[1:{limit - 1}]"
    return f"""
pieces as (select {key} as row_id, unnest(toks) as token, unnest(range(len(toks))) as pos
  from (select {key}, ({vocab_tokens(column)}){cut} as toks from {source})),
coded as (
 select s.row_id, list(c.id order by c.pos) filter (c.pos is not null) as ids
 from (select {key} as row_id from {source}) s
 left join (select p.row_id, p.pos, coalesce(v.id, 2) as id from pieces p left join vocab v using (token)) c
 using (row_id) group by 1)"""


WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')"
NOUNS = f"""
nouns as (
 select doc_id, a.analyzer, list_filter(words, lambda w: length(w) >= a.n) as nouns
 from (select doc_id, {WORDS} as words from documents)
 cross join (values ('kkma', 2), ('hannanum', 3), ('komoran', 4), ('mecab', 5), ('okt', 6)) as a(analyzer, n))"""


def tfidf(where: str) -> str:
    return f"""{NOUNS},
docterms as (select distinct analyzer, doc_id, unnest(nouns) as term from nouns where {where}),
dfs as (select analyzer, term, count(*) as df from docterms group by all),
ndocs as (select analyzer, count(*) as n from nouns where {where} group by all),
vocab as (
 select analyzer, term, df, ln((1 + n)::double / (1 + df)) + 1 as idf
 from (select *, row_number() over (partition by analyzer order by df desc, term) as r from dfs) join ndocs using (analyzer)
 where r <= 25000),
hits as (select analyzer, doc_id, term, idf from docterms join vocab using (analyzer, term)),
norms as (select analyzer, doc_id, sqrt(sum(idf * idf)) as norm from hits group by all),
weights as (select analyzer, doc_id, term, round(idf / norm, 6) as weight from hits join norms using (analyzer, doc_id))"""


def silhouettes(distance: str) -> str:
    return f"""
vecs as (select vec_id, label, embedding::double[] as e from embeddings),
per_cluster as (
 select x.vec_id, x.label, y.label as other, sum({distance}) as total, count(*) as n
 from vecs x cross join vecs y group by all),
sil as (
 select vec_id, label,
  sum(total) filter (other = label) / nullif(sum(n) filter (other = label) - 1, 0) as a,
  min(total / n) filter (other <> label) as b
 from per_cluster group by all),
scored as (
 select vec_id, label, a, b, case when a is null then 0 else coalesce((b - a) / nullif(greatest(a, b), 0), 0) end as s
 from sil)"""


EXACT = silhouettes("list_distance(x.e, y.e)")
SQUARED = silhouettes("pow(list_distance(x.e, y.e), 2)")


def with_(ctes: str, body: str) -> str:
    return f"with {ctes.strip()} {body}"


FLAT = (
    "row_id, sentence, train_label, array_to_string(name, '|') as name, array_to_string(entity, '|') as entity, "
    "input_sentence, joined_entity"
)


def length_profile(text: str, source: str, limit: int) -> str:
    n = f"len(list_filter(string_split_regex({text}, '{WS}+'), lambda t: t <> ''))"
    return (
        f"select count(*) as n_rows, sum(n)::bigint as n_tokens, max(n)::bigint as longest, "
        f"count(*) filter (n > {limit}) as above_limit, "
        "quantile_cont(n, 0.5)::double as p50, quantile_cont(n, 0.95)::double as p95, quantile_cont(n, 0.99)::double as p99 "
        f"from (select {n} as n from {source})"
    )


def share(source: str) -> str:
    return (
        f"select tag, round_even(n::double / (select sum(n) from {source}) * 100, 2) as share_pct from {source}"
    )


COUNTS = "counts as (select tag, count(*) as n from ents group by tag)"
TEST_PART = "substring(md5(concat(row_id, '|split')), 1, 1) < '3'"

SETS = """
sets as (select row_id, list_sort(list_distinct(entity)) as tags from prep)"""

BALANCE = """
counted as (
 select 'label' as kind, tag as name, count(*) as n_rows from (select unnest(tags) as tag from sets) group by tag
 union all select 'set', array_to_string(tags, ' '), count(*) from sets group by tags
 union all select 'all', '', count(*) from sets)"""


def quantiles(source: str, column: str) -> str:
    """One row per quantile; the quantiles are the fixed values of the query."""
    return " union all ".join(
        f"select '{column}' as \"column\", {q}::double as quantile, count({column}) as n, "
        f"round(quantile_cont({column}::double, {q}), 6) as value from {source}"
        for q in (0.0, 0.01, 0.25, 0.5, 0.95, 0.99, 1.0)
    )


LONG_ROWS = PREDICTIONS.replace("pairs as (", "single as (", 1) + """,
pairs as (
 select o_custkey as row_id, string_agg(pred, ' ' order by row_id) as pred, string_agg(label, ' ' order by row_id) as label
 from single join orders on o_orderkey = row_id group by o_custkey)"""

RULE_HITS = ", ".join(
    f"list_transform(regexp_extract_all(input_sentence, '{pattern}'), lambda m: concat(m, ':{tag}'))" for pattern, tag in RULES
)

SUBMISSION = with_(
    f"{PREDICTIONS}",
    f"select row_id, {full_clean('sentence')} as input_sentence, {strip('pred')} as pred from pairs join tagged using (row_id)",
)
REPORT = with_(
    f"{PREDICTIONS},{SCORED},{BLEU_ROWS}, sums as (select {BLEU_SUMS} from bleu_rows), "
    "macro as (select avg(f1) as f1, avg(acc) as acc from scored)",
    f"select round({bleu_value()}, 6) as bleu, round(f1, 6) as f1, round(acc, 6) as acc from sums cross join macro",
)
RUNS = (
    f"{PREDICTIONS},{SCORED},{BLEU_ROWS}, runs as (select o_orderpriority as run_id, {BLEU_SUMS}, avg(f1) as f1, avg(acc) as acc "
    "from bleu_rows join scored using (row_id) join orders on o_orderkey = row_id group by 1), "
    f"metrics as (select run_id, {bleu_value()} as bleu, f1, acc from runs)"
)
EXACT_ROWS = "select vec_id, label as cluster, round(a, 6) as a, round(b, 6) as b, round(s, 6) as s from scored"
SQUARED_ROWS = "select vec_id, label, round(a, 6) as a, round(b, 6) as b, round(s, 6) as s from scored"


PROFILE = (
    "select '{name}' as labelling, label as cluster, row_number() over (partition by label order by round(s, 6), vec_id) - 1 "
    "as position, vec_id, round(s, 6) as s, count(*) over (partition by label) as cluster_size from scored"
)

ORACLE = {
    "tag_extract": with_(PLAIN, "select row_id, len(raw) as n_tags, array_to_string(raw, '|') as raw from prep"),
    "tag_split": with_(f"{PLAIN},{ENTITIES}", "select row_id, pos, raw, name, tag from ents"),
    "clean_sentence": with_(TAGGED, f"select row_id, {full_clean('sentence')} as clean from tagged"),
    "clean_sentence_basic": with_(
        PLAIN,
        f"select row_id, {basic_clean('sentence')} as org_sentence, array_to_string(raw, '|') as train_label from prep",
    ),
    "corrections": with_(f"{TAGGED},{CORRECTED}", "select row_id, sentence from corrected"),
    "label_string": with_(PLAIN, "select row_id, train_label from prep"),
    "joined_entity": with_(PLAIN, "select row_id, joined_entity from prep"),
    "prefixed": with_(PREFIXED, "select row_id, input_sentence, train_label from prep"),
    "name_tag_arrays": with_(
        PLAIN, "select row_id, array_to_string(name, '|') as name, array_to_string(entity, '|') as entity from prep"
    ),
    "prepare_train": with_(
        f"{TAGGED},{CORRECTED},{prepared('corrected', PREFIX, LABEL_PREFIX)}", f"select {FLAT} from prep"
    ),
    "prepare_test": with_(PREFIXED, f"select {FLAT} from prep"),
    "strip_prefix": with_(PLAIN, "select row_id, input_sentence, train_label from prep"),
    "strip_decoded": f"select conv_id, turn, {strip('text')} as text from conversations",
    "model_columns": with_(PREFIXED, "select row_id, input_sentence, train_label from prep"),
    "tag_counts": with_(f"{PLAIN},{ENTITIES}", "select tag, count(*) as n_entities from ents group by tag"),
    "tag_share": with_(f"{PLAIN},{ENTITIES},{COUNTS}", share("counts")),
    "tag_share_mean": with_(
        f"{PLAIN},{ENTITIES}, train_n as (select tag, count(*) as n from ents where not {TEST_PART} group by tag), "
        f"test_n as (select tag, count(*) as n from ents where {TEST_PART} group by tag), "
        f"a as ({share('train_n')}), b as ({share('test_n')})",
        "select tag, coalesce(a.share_pct, 0) as train_pct, coalesce(b.share_pct, 0) as test_pct, "
        "round_even((coalesce(a.share_pct, 0) + coalesce(b.share_pct, 0)) / 2, 0) as mean_pct from a full join b using (tag)",
    ),
    "entity_dictionary": with_(f"{PLAIN},{ENTITIES},{DICTIONARY}", "select tag, idx, name from dict"),
    "distinct_names": with_(f"{PLAIN},{ENTITIES}", "select distinct tag, name from ents"),
    "dictionary_sizes": with_(
        f"{PLAIN},{ENTITIES}", "select tag, count(distinct name) as n_names from ents group by tag"
    ),
    "unique_tags": with_(f"{PLAIN},{ENTITIES}", "select distinct lower(tag) as tag from ents where length(tag) >= 2"),
    "label_indicators": with_(
        PLAIN,
        "select row_id, "
        + ", ".join(f"cast(list_contains(entity, '{t}') as integer) as {t.lower()}" for t in ("DT", "LC", "OG", "PS", "QT", "TI"))
        + " from prep",
    ),
    "length_profile": length_profile("text", "documents", INPUT_LIMIT),
    "label_length_profile": with_(PREFIXED, length_profile("train_label", "prep", LABEL_LIMIT)),
    "row_numbering": with_(TAGGED, "select row_id, row_number() over (order by row_id) - 1 as position from tagged"),
    "stratified_folds": with_(f"{PLAIN},{folds(10)}", "select row_id, fold from folds"),
    "fold_signatures": with_(
        f"{PLAIN},{folds(4)}", "select fold, joined_entity, count(*) as n_rows from folds group by all"
    ),
    "train_valid_split": with_(
        f"{PREFIXED},{folds(10)}",
        "select row_id, case when fold = 0 then 'valid' else 'train' end as split, input_sentence, train_label from folds",
    ),
    "first_fold": with_(f"{PLAIN},{folds(10)}", "select row_id, input_sentence from folds where fold = 0"),
    "index_gather": with_(
        f"{PLAIN},{folds(4)}",
        "select row_id, case when fold = 0 then 'valid' else 'train' end as part, train_label from folds",
    ),
    "split_counts": with_(
        f"{PLAIN},{folds(10)}",
        "select case when fold = 0 then 'valid' else 'train' end as split, count(*) as n_rows, 3::bigint as n_columns "
        "from folds group by 1",
    ),
    "label_fold_quotas": with_(
        f"{PLAIN},{SETS}",
        "select array_to_string(tags, ' ') as signature, count(*) as n, count(*) // 10 as base, count(*) % 10 as leftover "
        "from sets group by tags",
    ),
    "label_fold_balance": with_(
        f"{PLAIN},{SETS},{BALANCE}",
        "select kind, name, n_rows, n_rows // 10 as least, (n_rows + 9) // 10 as most, "
        "case when n_rows % 10 = 0 then 10 else n_rows % 10 end as n_most from counted",
    ),
    "value_quantiles": f"with lengths as (select len(list_filter(string_split_regex(coalesce(text, ''), '{WS}+'), lambda t: t <> '')) "
    "as n_words, length(coalesce(text, '')) as n_chars from documents), prices as (select l_extendedprice as price from lineitem) "
    + " union all ".join([quantiles("lengths", "n_words"), quantiles("lengths", "n_chars"), quantiles("prices", "price")]),
    "subword_round_trip": "select doc_id, coalesce(text, '') as text, length(coalesce(text, '')) as n_chars from documents",
    "subword_reserved": with_(
        PREFIXED,
        "select tag, count(*) as n from (select unnest(regexp_extract_all(train_label, '"
        + "|".join(RESERVED)
        + "')) as tag from prep) group by tag",
    ),
    "run_notes": with_(
        "runs as (select o_orderpriority as p, row_number() over (order by o_orderpriority) - 1 as run_id from (select distinct o_orderpriority from orders))",
        f"select run_id, unnest([concat('input text: {PREFIX}', run_id, ': '), concat(', label text: {LABEL_PREFIX} ', p)]) as line from runs",
    ),
    "quoted_csv": "select doc_id, replace(text, 'the', '\"the\"') as text, lang from documents",
    "top_terms": with_(
        NOUNS,
        "select term, count(*) as df from (select distinct doc_id, unnest(nouns) as term from nouns where analyzer = 'kkma') "
        "group by term order by df desc, term limit 500",
    ),
    "silhouette_sampled_rows": with_(EXACT, EXACT_ROWS),
    "entity_swap": with_(
        f"{PREFIXED},{ENTITIES},{DICTIONARY},{SWAPPED}", "select row_id, round, input_sentence, train_label from swapped"
    ),
    "augmented_union": with_(
        f"{PREFIXED},{ENTITIES},{DICTIONARY},{SWAPPED}",
        f"select row_id, round, input_sentence, {strip(f'''concat('{LABEL_PREFIX}', ' ', train_label)''')} as train_label from swapped "
        "union all select row_id, 0, input_sentence, train_label from prep",
    ),
    "vocab_build": with_(f"{PREFIXED},{vocab('prep', ['input_sentence', 'train_label'])}", "select token, id from vocab"),
    "encode_ids": with_(
        f"{PREFIXED},{vocab('prep', ['input_sentence', 'train_label'])},"
        f"{encoded('prep', 'row_id', 'input_sentence', INPUT_LIMIT)}",
        "select row_id, array_to_string(list_append(coalesce(ids, []), 1), ' ') as ids from coded",
    ),
    "encode_augmented": with_(
        f"{PREFIXED},{ENTITIES},{DICTIONARY},{SWAPPED}, aug as ("
        f"select row_id, round, input_sentence, {strip(f"""concat('{LABEL_PREFIX}', ' ', train_label)""")} as train_label from swapped "
        "union all select row_id, 0, input_sentence, train_label from prep), keyed as ("
        "select row_id * 10 + round as key, input_sentence, train_label from aug),"
        f"{vocab('keyed', ['input_sentence', 'train_label'])},"
        f"{encoded('keyed', 'key', 'input_sentence', INPUT_LIMIT)}, inputs as (select * from coded),"
        f"{encoded('keyed', 'key', 'train_label', LABEL_LIMIT).replace('pieces', 'label_pieces').replace('coded as', 'label_coded as')}",
        "select i.row_id // 10 as row_id, i.row_id % 10 as round, "
        "array_to_string(list_append(coalesce(i.ids, []), 1), ' ') as input_ids, "
        "array_to_string(list_append(coalesce(l.ids, []), 1), ' ') as label_ids "
        "from inputs i join label_coded l using (row_id)",
    ),
    "encode_documents": with_(
        f"{vocab('documents', ['text'])},{encoded('documents', 'doc_id', 'text', None)}",
        "select row_id, array_to_string(list_append(coalesce(ids, []), 1), ' ') as ids from coded",
    ),
    "mask_restore": with_(
        f"{PREFIXED},{vocab('prep', ['input_sentence', 'train_label'])},"
        f"{encoded('prep', 'row_id', 'train_label', LABEL_LIMIT)}",
        "select row_id, array_to_string(list_concat(coalesce(ids, []), [1, 0, 0, 0]), ' ') as ids from coded",
    ),
    "decode_ids": with_(
        f"{PREFIXED},{vocab('prep', ['input_sentence', 'train_label'])},"
        f"{encoded('prep', 'row_id', 'train_label', LABEL_LIMIT)}",
        "select s.row_id, coalesce(string_agg(v.token, ' ' order by p.pos), '') as text from prep s "
        "left join pieces p on p.row_id = s.row_id left join vocab v on v.token = p.token and v.id > 2 group by 1",
    ),
    "align_predictions": with_(PREDICTIONS, "select row_id, pred, label from pairs"),
    "segment_parse": with_(
        f"{PREDICTIONS}, segs as (select row_id, {segments('pred')} as ps from pairs)",
        "select row_id, pos, array_to_string(p.k, '|') as tokens, p.t as tag from "
        "(select row_id, unnest(range(len(ps))) as pos, unnest(ps) as p from segs)",
    ),
    "entity_precision": with_(f"{PREDICTIONS},{SCORED}", "select row_id, n_pred, tp from scored"),
    "entity_recall": with_(f"{PREDICTIONS},{SCORED}", "select row_id, n_gold, recalled from scored"),
    "entity_f1_acc": with_(
        f"{PREDICTIONS},{SCORED}", "select row_id, round(f1, 6) as f1, round(acc, 6) as acc from scored"
    ),
    "entity_counts_long_rows": with_(f"{LONG_ROWS},{SCORED}", "select row_id, n_pred, n_gold, tp, recalled from scored"),
    "entity_f1_macro": with_(
        f"{PREDICTIONS},{SCORED}", "select round(avg(f1), 6) as f1, round(avg(acc), 6) as acc from scored"
    ),
    "bleu_rows": with_(f"{BLEU_PAIRS},{BLEU_ROWS}", "select * from bleu_rows"),
    "bleu_stats": with_(f"{BLEU_PAIRS},{BLEU_ROWS}", f"select {BLEU_SUMS} from bleu_rows"),
    "bleu_score": with_(
        f"{BLEU_PAIRS},{BLEU_ROWS}, sums as (select {BLEU_SUMS} from bleu_rows)",
        f"select round({bleu_value()}, 6) as bleu from sums",
    ),
    "evaluation_report": REPORT,
    "evaluation_missing": REPORT.replace("case when row_id % 11 = 0", "case when row_id % 13 = 0 then '' when row_id % 11 = 0"),
    "evaluation_from_ids": REPORT.replace("pairs as (", "raw_pairs as (", 1).replace(
        "from prep))", f"from prep)), pairs as (select row_id, {decoded('label')} as label, {decoded('pred')} as pred from raw_pairs)", 1
    ),
    "run_metrics": with_(RUNS, "select run_id, round(bleu, 6) as bleu, round(f1, 6) as f1, round(acc, 6) as acc from metrics"),
    "best_run": with_(
        RUNS,
        "select run_id, row_number() over (order by m.f1 desc, run_id) as place, round(bleu, 6) as bleu, "
        "round(m.f1, 6) as f1, round(acc, 6) as acc from metrics m order by m.f1 desc, run_id limit 3",
    ),
    "batch_map": with_(
        PREFIXED, "select row_id, length(input_sentence) as input_chars, upper(train_label) as label_upper from prep"
    ),
    "batch_predict": with_(PLAIN, f"select row_id, array_to_string(list_concat({RULE_HITS}), ' ') as pred from prep"),
    "pred_label_rows": with_(
        PREDICTIONS, f"select row_id, {strip('pred')} as pred, {strip('label')} as label from pairs"
    ),
    "submission_rows": SUBMISSION,
    "submission_csv": SUBMISSION,
    "metrics_json": REPORT,
    "text_lines": with_(TAGGED, "select row_number() over (order by row_id) - 1 as row_id, sentence from tagged"),
    "document_lines": r"select sentence, count(*) as n_lines from (select unnest(string_split_regex(text, '\r\n|\n|\r')) as sentence "
    "from documents) group by 1",
    "tagged_csv": with_(TAGGED, "select row_id, sentence from tagged"),
    "noun_csv": with_(
        NOUNS,
        "select doc_id, analyzer, len(nouns) as n_nouns, array_to_string(list_transform(range(1, len(nouns) + 1), "
        "lambda i: case when i % 4 = 2 then concat(nouns[i], chr(39), 's') else nouns[i] end), ' ') as text from nouns",
    ),
    "noun_documents": with_(NOUNS, "select doc_id, analyzer, array_to_string(nouns, ' ') as text from nouns"),
    "flattened_nouns": with_(
        NOUNS,
        "select doc_id, unnest(range(len(nouns))) as pos, unnest(nouns) as noun from nouns where analyzer = 'kkma'",
    ),
    "tfidf_vocab": with_(tfidf("analyzer = 'kkma'"), "select term, df, round(idf, 6) as idf from vocab"),
    "tfidf_weights": with_(tfidf("analyzer = 'kkma'"), "select doc_id, term, weight from weights"),
    "tfidf_by_analyzer": with_(tfidf("true"), "select analyzer, doc_id, term, weight from weights"),
    "centre_assignment": """
with vecs as (select vec_id, label, embedding::double[] as e from embeddings),
dims as (select label, unnest(e) as x, unnest(range(len(e))) as dim from vecs),
means as (select label, dim, avg(x) as x from dims group by all),
centres as (select label, list(x order by dim) as c from means group by label),
ranked as (select v.vec_id, v.label, c.label as cluster,
  row_number() over (partition by v.vec_id order by list_distance(v.e, c.c), c.label) as r from vecs v cross join centres c)
select vec_id, label, cluster from ranked where r = 1""",
    "centre_update": """
with vecs as (select vec_id, label, embedding::double[] as e from embeddings),
dims as (select label, unnest(e) as x, unnest(range(len(e))) as dim from vecs),
means as (select label, dim, avg(x) as x from dims group by all),
centres as (select label, list(x order by dim) as c from means group by label),
ranked as (select v.vec_id, v.e, c.label as cluster,
  row_number() over (partition by v.vec_id order by list_distance(v.e, c.c), c.label) as r from vecs v cross join centres c),
moved as (select cluster, unnest(e) as x, unnest(range(len(e))) as dim from ranked where r = 1)
select cluster, dim, round(avg(x), 6) as x from moved group by cluster, dim""",
    "silhouette_rows": with_(EXACT, EXACT_ROWS),
    "silhouette_mean": with_(EXACT, "select round(avg(s), 6) as silhouette from scored"),
    "silhouette_sq_rows": with_(SQUARED, SQUARED_ROWS),
    "silhouette_sq_mean": with_(SQUARED, "select round(avg(s), 6) as silhouette_sq from scored"),
    "silhouette_profile": with_(
        EXACT,
        "select label as cluster, row_number() over (partition by label order by round(s, 6), vec_id) - 1 as position, "
        "vec_id, round(s, 6) as s, count(*) over (partition by label) as cluster_size from scored",
    ),
    "silhouette_profile_sq": " union all ".join(
        f"select * from ({with_(SQUARED, PROFILE.format(name=name))})".replace("from embeddings", source)
        for name, source in (
            ("label", "from embeddings"),
            ("halves", "from (select vec_id, embedding, label % 2 as label from embeddings)"),
        )
    ),
    "cluster_rows": with_(SQUARED, f"{SQUARED_ROWS} where label = 3"),
}
ORACLE["entity_swap_joined"] = ORACLE["entity_swap"]
