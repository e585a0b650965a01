"""Registered queries of the operators; each reads its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bandwise.llm import (
    dart_minhash,
    exact_dedup,
    importance,
    language_crf,
    licenses,
    mixing,
    ngram_trie,
    piece_transducer,
    quality_fm,
    quotes,
    secret_novelty,
    term_pipeline,
    vector_caps,
)
from bandwise.llm.common import remainder, table


def op1_quality_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    machine = quality_fm.fit(docs, labels.where(remainder("doc_id", 5) != 0))
    return quality_fm.score(docs.select("doc_id", "text", "n_chars"), machine).select(
        "doc_id",
        (remainder("doc_id", 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= quality_fm.THRESHOLD).cast("int").alias("predicted"),
    )


def op2_piece_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_transducer.encode(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("domain", mixing.domain())
    return mixing.plan(docs, ["domain", "lang", "source"])


def op4_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_crf.fit(docs.where(remainder("doc_id", 3) != 1))
    found = language_crf.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "n_languages")


def op5_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dart_minhash.near_groups(table(spark, sf_dir, "documents"))


def op6_ngram_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_trie.score(table(spark, sf_dir, "documents"), remainder("doc_id", 10) == 0)


def op7_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.format_chats(table(spark, sf_dir, "conversations"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op10_vector_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_caps.near_vectors(table(spark, sf_dir, "embeddings"))


def op11_secret_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secret_novelty.report(secret_novelty.scan(docs, secret_novelty.identifiers(docs)))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op13_term_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_pipeline.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def registry() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    functions = (op1_quality_machine, op2_piece_transducer, op3_source_mixing, op4_language_crf, op5_dart_minhash, op6_ngram_trie, op7_quotation_linking, op8_exact_dedup, op9_license_scan, op10_vector_caps, op11_secret_novelty, op12_importance_resampling, op13_term_pipeline)
    return {f.__name__: f for f in functions}


OP8 = """
with d as (select doc_id, coalesce(text, '') as text from documents),
g as (select text, max(doc_id) as keep_id, count(*) as group_size from d group by text)
select d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id as kept, sha256(d.text) as text_sha256
from d join g on d.text = g.text
"""

# one level of the tree: children `k` share the budget of `p`, capacity c and weight w of each
_LEVEL = """
n{i} as (select {keys}, sum(supply)::double * 2 as c, pow(sum(supply)::double, 0.5) as w from leaves group by {keys}
         having sum(supply) > 0),
o{i} as (select *,
         coalesce(sum(c) over (partition by {family} order by c / w, {keys} rows between unbounded preceding and 1 preceding), 0) as before,
         sum(w) over (partition by {family} order by c / w, {keys} rows between current row and unbounded following) as rest
         from (select n.*, p.budget as above from n{i} n join b{above} p on {same}) x),
f{i} as (select *, c * rest <= (above - before) * w as filled from o{i}),
b{i} as (select {keys}, case when filled then c else (above - coalesce(sum(case when filled then c end) over (partition by {family}), 0))
         / (sum(case when not filled then w end) over (partition by {family})) * w end as budget from f{i}),
"""


def _levels(path: list[str]) -> str:
    found = []
    for i in range(1, len(path) + 1):
        above = path[: i - 1]
        same = " and ".join(f"n.{c} is not distinct from p.{c}" for c in above) or "true"
        found.append(_LEVEL.format(i=i, above=i - 1, keys=", ".join(path[:i]), family=", ".join(above) or "1", same=same))
    return "".join(found)


OP3 = f"""
with d as (
  select doc_id, 'd' || ((strpos('0123456789abcdef', substr(md5(source), 1, 1)) - 1) % 4) as domain, lang, source,
         len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+')) as tokens from documents),
leaves as (select domain, lang, source, sum(tokens)::bigint as supply from d group by all),
b0 as (select least(floor(sum(supply) * 1.0), sum(supply) * 2)::double as budget from leaves),
{_levels(["domain", "lang", "source"])}
q as (select l.*, coalesce(floor(greatest(b.budget, 0) + 1e-6), 0)::bigint as quota from leaves l left join b3 b
      on l.domain is not distinct from b.domain and l.lang is not distinct from b.lang and l.source is not distinct from b.source),
e as (select *, case when supply > 0 then quota // supply else 0 end as epochs from q),
r as (select d.*, e.supply, e.quota, e.epochs, e.quota - e.epochs * e.supply as rest,
             md5('17-' || e.epochs || '-' || coalesce(d.doc_id::varchar, '')) as key
      from d join e on d.domain is not distinct from e.domain and d.lang is not distinct from e.lang and d.source is not distinct from e.source),
s as (select *, coalesce(sum(tokens) over (partition by domain, lang, source order by key
      rows between unbounded preceding and 1 preceding), 0) as begins from r)
select doc_id, domain, lang, source, tokens, (epochs + case when begins < rest then 1 else 0 end)::int as copies, supply, quota from s
"""

OP7 = r"""
with recursive m as (
  select row_number() over () as message, conv_id, turn, role, coalesce(conv_id::varchar, '') as conversation,
         coalesce(turn, 4611686018427387904) as place, coalesce(text, '') as text from conversations),
split as (select message, conversation, place, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) as parts from m),
numbered as (select message, conversation, place, unnest(parts) as raw, unnest(range(len(parts))) as line from split),
lines as (
  select *, length(replace(replace(regexp_extract(raw, '^((?:[ \t]*>)+)', 1), ' ', ''), chr(9), '')) as level,
         trim(regexp_replace(lower(case when regexp_matches(raw, '^[ \t]*>') then regexp_extract(raw, '^((?:[ \t]*>)+)[ \t]?(.*)$', 2)
              else raw end), '[ \t]+', ' ', 'g')) as normal from numbered),
quoted as (select *, lag(line) over w as previous, lag(level) over w as previous_level from lines where level > 0 and normal <> ''
           window w as (partition by message order by line)),
passed as (select *, sum(case when previous + 1 = line and previous_level = level then 0 else 1 end) over (partition by message order by line) as passage
           from quoted),
origins as (select conversation, normal, min(struct_pack(place := place, message := message)) as origin from lines
            where level = 0 and normal <> '' group by all),
matched as (select p.message, p.passage, p.level, case when o.origin.place < p.place then o.origin end as origin, count(*) as n
            from passed p left join origins o using (conversation, normal) group by all),
passages as (select message, passage, level, max(case when origin is not null then struct_pack(n := n, f := -origin.place, o := origin) end) as best
             from matched group by all),
replies as (
  select message, count(*) as n_passages, count(best) as n_linked, max(level) as max_level,
         max(case when best is not null then struct_pack(l := -level, n := best.n, p := -best.o.place, o := best.o) end).o as target
  from passages group by message),
paths as (
  select m.message, [m.place] as path from m left join replies r using (message) where r.target is null
  union all
  select r.message, list_append(p.path, m.place) from replies r join paths p on p.message = r.target.message join m on m.message = r.message),
cleaned as (
  select m.*, r.n_passages, r.n_linked, r.max_level, r.target, p.path,
    case when r.n_passages > 0 then trim(regexp_replace(regexp_replace(
      array_to_string(list_filter(list_transform(range(len(parts)), lambda i: case
        when regexp_matches(parts[i + 1], '^[ \t]*>') then null
        when regexp_matches(parts[i + 1], '^On [^\n]* wrote:[ \t]*$') and regexp_matches(coalesce(parts[i + 2], ''), '^[ \t]*>') then null
        else parts[i + 1] end), lambda x: x is not null), chr(10)), '^\n+', ''), '\n+$', '')) else m.text end as content
  from m join split s using (message) left join replies r using (message) join paths p using (message))
select conv_id, turn, role, case when target.place <> 4611686018427387904 then target.place end as reply_to,
  array_to_string(list_transform(path, lambda x: lpad(x::varchar, 19, '0')), '/') as path, (len(path) - 1)::int as depth,
  coalesce(n_passages, 0) as n_passages, coalesce(n_linked, 0) as n_linked, coalesce(max_level, 0)::int as max_level, content,
  '<|' || coalesce(role, 'user') || '|>' || chr(10) || content || chr(10) || '<|end|>' || chr(10) as formatted
from cleaned
"""


# CRC-32 of the words: a table of 256 remainders by rule, then one step per byte
OP12 = r"""
with recursive steps as (
  select i, i as v, 0 as k from range(256) t(i)
  union all select i, case when v % 2 = 1 then xor(3988292384, v // 2) else v // 2 end, k + 1 from steps where k < 8),
remainders as (select list(v order by i) as r from steps where k = 8),
split as (
  select 'd' as side, row_number() over () as row, doc_id, text from documents
  union all select 'b', row_number() over (), null, text from benchmark),
lists as (select side, row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
          '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from split),
features as (select side, row, unnest(words) as word from lists),
spelled as (select word, hex(word) as h from (select distinct word from features)),
bytes as (select word, list_transform(range(len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::bigint) as bs from spelled),
hashed as (select word, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, bs),
           lambda c, b: xor(c // 256, r[(xor(c, b) % 256) + 1]))) % 10000 as bucket from bytes, remainders),
held as (select side, row, bucket from features join hashed using (word)),
buckets as (select bucket, count(*) filter (side = 'd') as s, count(*) filter (side = 'b') as t from held group by bucket),
totals as (select coalesce(sum(s), 0) as s_all, coalesce(sum(t), 0) as t_all from buckets),
gain as (select bucket, floor(1000 * ln(((t + 1)::double * (s_all + 10000)::double) / ((s + 1)::double * (t_all + 10000)::double)))::bigint as g
         from buckets, totals),
weights as (select row, count(*) as n_features, sum(g)::bigint as weight from held join gain using (bucket) where side = 'd' group by row),
noise as (select row, doc_id, len(words) as n_words, ('0x' || substr(sha256('2024:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint as h
          from lists where side = 'd'),
scored as (select doc_id, n_words, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
           coalesce(weight, 0) + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296)))::bigint as score
           from noise left join weights using (row)),
ranked as (select *, row_number() over (order by n_words < 20, score desc, doc_id) as place,
           floor(10 * count(*) filter (n_words >= 20) over () / 100) as drawn from scored)
select doc_id, n_features::bigint as n_features, weight::bigint as weight, score::bigint as score,
  case when place <= drawn then place end::bigint as rank from ranked
"""

OP13 = r"""
with split as (
  select 'd' as side, row_number() over () as row, doc_id as id, text from documents
  union all select 'b', row_number() over (), item_id, text from benchmark),
lists as (select side, row, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
          '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms from split),
totals as (select count(*)::bigint as n_all, sum(len(terms))::bigint as l_all from lists where side = 'd' and len(terms) > 0),
found as (select side, row, id, len(terms)::bigint as n, unnest(terms) as term from lists),
asked as (select distinct row as item, id as item_id, term from found where side = 'b'),
held as (select row, id as doc_id, n, term, count(*)::bigint as tf from found
         where side = 'd' and term in (select term from asked) group by all),
weight as (select term, floor(1000 * ln((2 * n_all + 2)::double / (2 * count(*) + 1)))::bigint as w from held, totals group by term, n_all),
parts as (select row, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_all) // l_all))) as c
          from held join weight using (term), totals),
scores as (select item, item_id, row, doc_id, sum(c)::bigint as score from asked join parts using (term) group by all),
ranked as (select *, row_number() over (partition by item order by score desc, doc_id, row) as rank from scores where score > 0)
select item_id, rank::int as rank, doc_id, score from ranked where rank <= 10
"""


def statements() -> dict[str, str]:
    return {"op12_importance_resampling": OP12, "op13_term_pipeline": OP13, "op3_source_mixing": OP3, "op7_quotation_linking": OP7, "op8_exact_dedup": OP8}
