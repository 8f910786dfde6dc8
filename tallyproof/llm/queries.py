"""The registered queries of the corpus operators and, where SQL can express them, their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyproof.llm.common import read


def op6_rolling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyproof.llm.substring_dedup import remove_repeated_windows

    return remove_repeated_windows(read(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256", "n_intervals")


OP6_SQL = r"""
with d as (
  select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
wins as (
  select doc_id, i, md5(array_to_string(ws[i:i + 34], ' ')) as h from (select doc_id, ws, unnest(range(1, len(ws) - 33)) as i from d)),
hits as (select doc_id, i from (select *, count(*) over (partition by h) as c from wins) where c > 1),
gone as (select distinct doc_id, unnest(range(i, i + 35)) as p from hits),
starts as (
  select doc_id, count(*) as n_removed, count(*) filter (not again) as n_intervals
  from (select doc_id, p, coalesce(lag(p) over (partition by doc_id order by p) = p - 1, false) as again from gone) group by doc_id),
words as (select doc_id, unnest(range(1, len(ws) + 1)) as p, unnest(ws) as w from d),
kept as (
  select doc_id, string_agg(w, ' ' order by p) as t from words anti join gone using (doc_id, p) group by doc_id)
select doc_id, len(ws)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256,
       coalesce(n_intervals, 0)::bigint as n_intervals
from d left join starts using (doc_id) left join kept using (doc_id)
"""


def op7_line_frequency_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyproof.llm.quality_rules import judge_documents

    return judge_documents(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_line_words"
    )


OP7_SQL = r"""
with w as (
  select doc_id, coalesce(source, chr(1)) as host, coalesce(text, '') as t,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws
  from documents),
windows as (
  select doc_id, i, count(*) over (partition by doc_id, ws[i], ws[i + 1], ws[i + 2]) as c
  from (select doc_id, ws, unnest(range(1, len(ws) - 1)) as i from w)),
repeats as (
  select doc_id, count(distinct p) as n from (select doc_id, unnest([i, i + 1, i + 2]) as p from windows where c >= 2) group by doc_id),
lines as (
  select doc_id, host, t, line,
         regexp_replace(trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g')), '[0-9]', '0', 'g') as norm
  from (select doc_id, host, t, unnest(string_split(t, chr(10))) as line from w)),
dups as (select doc_id, count(*) - count(distinct line) as n from lines where norm <> '' group by doc_id),
hosts as (select host, count(distinct t) as d from lines where norm <> '' group by host),
hot as (
  select host, norm from lines join hosts using (host) where norm <> '' group by host, norm, d
  having count(distinct t) > 5 and 100 * count(distinct t) > 5 * d),
lost as (
  select doc_id, sum(len(string_split(norm, ' ')))::bigint as n from lines join hot using (host, norm) group by doc_id),
base as (
  select w.doc_id, len(ws)::bigint as n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
         coalesce(dups.n, 0)::bigint as n_dup_lines, coalesce(repeats.n, 0)::bigint as n_repeat_words,
         coalesce(lost.n, 0)::bigint as n_line_words
  from w left join dups using (doc_id) left join repeats using (doc_id) left join lost using (doc_id)),
failed as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from base)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and 100 * (n_words - n_line_words) >= 50 * n_words as kept, n_line_words
from failed
"""

def op8_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyproof.llm.url_filters import judge_urls

    return judge_urls(read(spark, sf_dir, "pages"), read(spark, sf_dir, "labels")).select("page_id", "host", "path", "rule", "verdict")


def _op8_sql() -> str:
    strength = """select coalesce(1 / least(0.99::double, greatest(0.001::double,
          (sum(n * pow(k / n - p, 2)) / nullif(sum(n * p * (1 - p)) / sum(n), 0) - (count(*) - 1))
          / nullif(sum(n) - sum(n * n) / sum(n) - (count(*) - 1), 0))) - 1, 999::double) as s from {} where n > 0"""
    return rf"""
with judged as (
  select page_id, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') as path from pages),
outcomes as (
  select host, good from (select distinct page_id, host from judged where host <> '')
  join (select doc_id as page_id, min((quality = 1 and toxic = 0)::int) as good from labels
        where quality is not null and toxic is not null group by doc_id) using (page_id)),
seen as (select host, count(*)::double as n, sum(good)::double as k from outcomes group by host),
counts as (
  select host, coalesce(n, 0) as n, coalesce(k, 0) as k, array_to_string(string_split(host, '.')[-2:], '.') as domain,
         string_split(host, '.')[-1] as suffix
  from (select distinct host from judged where host <> '') left join seen using (host)),
d0 as (select domain, suffix, sum(n) as n, sum(k) as k from counts group by all),
s0 as (select suffix, sum(n) as n, sum(k) as k from d0 group by all),
whole as (select (coalesce(sum(k), 0) + 1) / (coalesce(sum(n), 0) + 2) as p from s0),
s1 as (select * from s0, whole), ss as ({strength.format('s1')}),
s2 as (select suffix, (k + s * p) / (n + s) as p from s1, ss),
d1 as (select domain, n, k, p from d0 join s2 using (suffix)), ds as ({strength.format('d1')}),
d2 as (select domain, (k + s * p) / (n + s) as p from d1, ds),
h1 as (select host, n, k, p from counts join d2 using (domain)), hs as ({strength.format('h1')}),
h2 as (select host, n, s, (k + s * p) / (n + s) as rate from h1, hs),
passed as (select host, rate - 1.2816 * sqrt(rate * (1 - rate) / (n + s + 1)) >= 0.6 as pass from h2),
ruled as (
  select judged.*, pass, case
    when (host = 'example.com' or host like '%.example.com') and path like '/de/%' then 'example.com/de/'
    when (host = 'example.net' or host like '%.example.net') and path like '/en/%' then 'example.net/en/'
    when (host = 'org' or host like '%.org') and path like '/fr/%' then 'org/fr/'
    when (host = 'net' or host like '%.net') and path like '/%' then 'net/' end as rule
  from judged left join passed using (host))
select page_id, host, path, rule,
       case when rule in ('example.net/en/', 'org/fr/') then 'allow' when rule is not null then 'block'
            when pass then 'allow' else 'block' end as verdict
from ruled
"""


def op10_benchmark_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyproof.llm.decontaminate import digest

    return digest(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


OP10_SQL = r"""
with d as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as ws from documents),
b as (
  select item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as ws from benchmark),
bw as (
  select distinct item_id, least(len(ws), 10) as n, array_to_string(ws[i:i + 9], ' ') as win
  from (select item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) as i from b where len(ws) > 0)),
lengths as (select distinct n from bw),
dw as (
  select doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') as win
  from (select doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) as i from d, lengths where len(ws) >= n)),
hits as (select doc_id, i, dw.n, item_id from dw join bw using (n, win)),
words as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from hits) group by doc_id),
items as (
  select doc_id, count(distinct item_id) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as ids
  from hits group by doc_id)
select doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join words using (doc_id) left join items using (doc_id)
"""

def op1_column_suffix_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyproof.llm.suffix_dedup import remove_repeated_strings

    return remove_repeated_strings(read(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op2_universe_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyproof.llm.jaccard_join import jaccard_components

    return jaccard_components(read(spark, sf_dir, "documents"))


OP2_SQL = r"""
with recursive w as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
s as (
  select distinct doc_id, md5(array_to_string(ws[i:i + 4], ' ')) as g from (select doc_id, ws, unnest(range(1, greatest(2, len(ws) - 3))) as i from w where len(ws) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
shared as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
links as (select a, b from shared join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 75 * (x.n + y.n - c)),
walk(doc_id, seen) as (select doc_id, doc_id from n union select w.doc_id, l.b from walk w join links l on w.seen = l.a)
select w.doc_id, coalesce(any_value(n.n), 0)::bigint as n_shingles, coalesce(min(k.seen), w.doc_id) as component_id
from w left join n using (doc_id) left join walk k on k.doc_id = w.doc_id group by w.doc_id
"""


def op3_heap_merge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyproof.llm.tokens import token_counts

    return token_counts(read(spark, sf_dir, "documents"))


def op4_mixing_coder_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyproof.llm.token_file import round_trip

    return round_trip(read(spark, sf_dir, "documents"))


def op5_splitting_tree_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from tallyproof.llm.mixing import mix

    mixed = mix(read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", F.array_join(F.col("shards").cast("array<string>"), ",").alias("shards"))


def _op5_sql() -> str:
    levels = "".join(
        f"""n{k + 1} as (
  select number, block, pass, 2 * node + (row_number() over (partition by node
    order by md5(concat_ws(':', 'mix', '{k}', number, block, pass))) > (count(*) over (partition by node) + 1) // 2)::int as node
  from n{k}),
"""
        for k in range(4)
    )
    return rf"""
with sizes as (
  select doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::bigint as size,
         md5('mix:' || coalesce(doc_id::varchar, 'null')) as place
  from documents),
s0 as (
  select source, sum(size)::bigint as source_size, row_number() over (order by source asc nulls last) as number
  from sizes group by source),
s1 as (select *, [5, 2, 1][((number - 1) % 3 + 1)::int] as weight, 3 * source_size as cap, (sum(source_size) over ())::bigint as total from s0),
s2 as (
  select *, (total - coalesce(sum(cap) over w, 0)) * weight >= cap * (sum(weight) over () - coalesce(sum(weight) over w, 0)) as "full"
  from s1 window w as (order by cap / weight, number rows between unbounded preceding and 1 preceding)),
s3 as (
  select *, case when "full" then cap::double else weight * ((total - coalesce(sum(cap) filter ("full") over (), 0))::double
         / (sum(weight) filter (not "full") over ())::double) end as target
  from s2),
plan as (
  select source, number, source_size, target, greatest(1, ceil(4096 * source_size::double / total))::int as blocks,
         floor(target + 0.5)::bigint // greatest(source_size, 1) as passes,
         floor(target + 0.5)::bigint % greatest(source_size, 1) as extra
  from s3),
rows as (
  select sizes.*, plan.* exclude (source), (('0x' || place[:3])::int * blocks) // 4096 as block,
         coalesce(sum(size) over (partition by number order by place, doc_id rows between unbounded preceding and 1 preceding), 0) as before
  from sizes join plan on sizes.source is not distinct from plan.source),
taken as (select *, least(size, greatest(0, extra - before)) as last from rows),
cut as (select number, max(block) as cut_block from taken where last > 0 group by number),
d as (
  select plan.number, unnest(range(0, blocks)) as block, passes, cut_block from plan left join cut using (number)),
n0 as (
  select number, block, unnest(range(0, passes + (block <= coalesce(cut_block, -1))::int)) as pass, 0 as node from d),
{levels}shards as (select number, block, list(node order by pass) as nodes from n4 group by number, block)
select doc_id, size, source_size, target, (passes * size + last)::bigint as taken,
       coalesce(array_to_string(nodes[:case when size = 0 then 0 else passes + (last > 0)::int end], ','), '') as shards
from taken left join shards using (number, block)
"""


def op9_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyproof.llm.personal_data import find_personal_data

    return find_personal_data(read(spark, sf_dir, "documents")).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")


def op11_bit_plane_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from tallyproof.llm.hard_negatives import mine_hard_negatives

    vectors = read(spark, sf_dir, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mine_hard_negatives(vectors, F.col("vec_id") % 50 == 0)


OP11_SQL = """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as x
  from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select a.vec_id as anchor_id, b.vec_id as id, a.label = b.label as same,
         list_sum(list_transform(range(1, len(a.x) + 1), lambda i: a.x[i] * b.x[i]))::bigint as score
  from v a join v b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id),
positives as (
  select anchor_id, id as positive_id, score as positive_score from scored where same
  qualify row_number() over (partition by anchor_id order by score desc, id) <= 5)
select anchor_id, positive_id, row_number() over (partition by anchor_id, positive_id order by score desc, id)::int as rank,
       id as negative_id, positive_score, score as negative_score
from positives join scored using (anchor_id)
where not same and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score
qualify rank <= 3
"""


def op12_packed_term_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyproof.llm.source_audit import audit_sources

    return audit_sources(read(spark, sf_dir, "documents"))


OP12_SQL = r"""
with d as (
  select coalesce(lang, '') as lang, coalesce(source, '') as source, row_number() over () as doc,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as ts
  from documents),
groups as (select distinct lang, source from d),
counted as (select lang, source, doc, term, count(*) as n from (select lang, source, doc, unnest(ts) as term from d) group by all),
kept as (select lang, term from counted group by lang, term having count(distinct doc) >= 10),
sparse as (select lang, source, term, sum(n)::hugeint as c from counted semi join kept using (lang, term) group by all),
vocabulary as (select lang, count(*)::hugeint as v from kept group by lang),
own as (
  select lang, source, term, coalesce(c, 0) as c, sum(coalesce(c, 0)) over (partition by lang, source) as n, v
  from groups join kept using (lang) join vocabulary using (lang) left join sparse using (lang, source, term)),
p as (select lang, source, term, c, 1 + (1000000000 * (c + 2)) // (n + 2 * v) as p from own),
whole as (
  select lang, term, 1 + (1000000000 * (c + 2)) // (sum(c) over (partition by lang) + 2 * v) as q
  from (select lang, term, sum(c)::hugeint as c from sparse group by all) join vocabulary using (lang)),
pairs as (
  select a.lang, a.source, b.source as item, coalesce(sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)), 0)::bigint as value
  from groups a join groups b on a.lang = b.lang and a.source <> b.source
  left join p x on x.lang = a.lang and x.source = a.source
  left join p y on y.lang = b.lang and y.source = b.source and y.term = x.term group by all),
terms as (
  select lang, source, term as item, ((p - q) * (p - q) // (p + q))::bigint as value from p join whole using (lang, term) where c > 0 and p > q)
select lang, source, 'pair' as part, item, value, row_number() over (partition by lang, source order by value desc, item)::int as rank from pairs
union all
select lang, source, 'term', item, value, row_number() over (partition by lang, source order by value desc, item)::int as rank from terms qualify rank <= 10
"""


def op13_trie_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyproof.llm.simhash import fingerprint_components

    return fingerprint_components(read(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_column_suffix_order,
        op2_universe_partition,
        op3_heap_merge_counts,
        op4_mixing_coder_file,
        op5_splitting_tree_mix,
        op6_rolling_windows,
        op7_line_frequency_rules,
        op8_host_reputation,
        op9_weak_supervision,
        op10_benchmark_automaton,
        op11_bit_plane_negatives,
        op12_packed_term_audit,
        op13_trie_fingerprints,
    )
}
ORACLES = {
    "op2_universe_partition": OP2_SQL,
    "op5_splitting_tree_mix": _op5_sql(),
    "op6_rolling_windows": OP6_SQL,
    "op7_line_frequency_rules": OP7_SQL,
    "op8_host_reputation": _op8_sql(),
    "op10_benchmark_automaton": OP10_SQL,
    "op11_bit_plane_negatives": OP11_SQL,
    "op12_packed_term_audit": OP12_SQL,
}
