"""Registered queries of the text operators and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortloom.llm import (
    collocations, contamination, host_rules, importance, set_join, sharding, source_mix, threads, token_counts,
    token_file, unit_dedup, url_reputation, whitening,
)
from cohortloom.llm.common import word_count
from cohortloom.storage import materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register the decorated ``(spark, folder)`` function under its own name."""

    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


_SHRINK = """
  select {keys}, n, f, prior, n + strength as weight, (f + strength * prior) / (n + strength) as mean
  from (select g.*, (1 - rho) / rho as strength from {groups} g, (
    select least(0.999, greatest(1e-6, coalesce(case when sum(n * prior * (1 - prior)) > 0 then
      (sum(n * (f::double / n - prior) * (f::double / n - prior)) - sum(prior * (1 - prior)))
      / sum(n * prior * (1 - prior)) end, 0.0))) as rho
    from {groups} where n > 0))"""


@query()
def op1_token_file(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's place, length and checksum, decoded from the written token file."""
    path = token_file.default_path(spark)
    token_file.write(table(spark, folder, "documents"), path, "byte_bpe_50k.json")
    read = token_file.read(spark, path)
    return read.select(F.col("key").alias("doc_id"), "start", "n_tokens", "ids_crc32", "n_pieces")


@query(r"""
with w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (
  select distinct doc_id, array_to_string(w[i:i + 4], ' ') as t from w, generate_series(1, greatest(len(w) - 4, 1)) g(i) where len(w) > 0),
n as (select doc_id, count(*) as n from s group by doc_id),
pairs as (
  select a.doc_id as x, b.doc_id as y, count(*) as common from s a join s b on a.t = b.t and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
links as (
  select x, y from pairs join n a on x = a.doc_id join n b on y = b.doc_id where 100 * common >= 75 * (a.n + b.n - common)),
edges as (select x as a, y as b from links union all select y, x from links),
reach as (
  with recursive r as (select doc_id as a, doc_id as b from n union select r.a, e.b from r join edges e on r.b = e.a) select * from r)
select documents.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(c.component_id, documents.doc_id) as component_id
from documents left join n using (doc_id) left join (select a as doc_id, min(b) as component_id from reach group by a) c using (doc_id)
""")
def op2_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    """Size of every document's shingle set and the component of its links."""
    return set_join.link_components(table(spark, folder, "documents")).select("doc_id", "n_shingles", "component_id")


@query(r"""
with base as (
  select page_id, coalesce(url, '') as u from pages),
rest as (
  select page_id, case when position('://' in u) > 0 then substr(u, position('://' in u) + 3) else '' end as r from base),
parts as (
  select page_id, translate(regexp_extract(r, '^[^/?#]*', 0, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(r, '^[^/?#]*([^?#]*)', 1, 's') as path from rest),
known as (
  select doc_id as page_id, max(case when quality = 0 then 1 else 0 end) as bad from labels where quality is not null group by doc_id),
counts as (
  select host, count(bad) as n, coalesce(sum(bad), 0) as f from parts left join known using (page_id) group by host),
bare as (
  select *, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') as b from counts),
hosts as (
  select host, n, f, case when regexp_matches(b, '^[0-9.]+$') or starts_with(b, '[') then '#' else split_part(b, '.', -1) end as suffix,
    case when regexp_matches(b, '^[0-9.]+$') or starts_with(b, '[') then b
      when position('.' in b) > 0 then split_part(b, '.', -2) || '.' || split_part(b, '.', -1) else b end as domain from bare),
whole as (select coalesce(sum(f)::double / nullif(sum(n), 0), 0.0) as prior from hosts),
g1 as (select suffix, sum(n)::bigint as n, sum(f)::bigint as f, any_value(prior) as prior from hosts, whole group by suffix),
s1 as (""" + _SHRINK.format(keys="suffix", groups="g1") + r"""),
g2 as (select domain, suffix, sum(h.n)::bigint as n, sum(h.f)::bigint as f, any_value(s1.mean) as prior from hosts h join s1 using (suffix) group by domain, suffix),
s2 as (""" + _SHRINK.format(keys="domain, suffix", groups="g2") + r"""),
g3 as (select host, h.n, h.f, s2.mean as prior from hosts h join s2 using (domain, suffix)),
s3 as (""" + _SHRINK.format(keys="host", groups="g3") + r"""),
rules as (
  select * from (values ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')) t(kind, name, start)),
fitting as (
  select page_id, host, path, max(struct_pack(l := length(name || start), r := name || start, k := kind)) as best
  from (select distinct page_id, host, path from parts) p join rules on (host = name or ends_with(host, '.' || name)) and starts_with(path, start)
  group by page_id, host, path)
select p.page_id, p.host, p.path, best.r as rule,
  coalesce(best.k, case when mean - 1.645 * sqrt(mean * (1 - mean) / (weight + 1)) > 0.5 then 'block' else 'allow' end) as verdict,
  round(mean, 9) as bad_rate
from parts p join s3 using (host) left join fitting f on f.page_id is not distinct from p.page_id and f.host = p.host and f.path = p.path
""")
def op3_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    """Verdict of every page; labels are read as page outcomes by id (bad: quality 0)."""
    labels = table(spark, folder, "labels").where(F.col("quality").isNotNull())
    outcomes = labels.select(F.col("doc_id").alias("page_id"), (F.col("quality") == 0).cast("int").alias("bad"))
    judged = url_reputation.judge(table(spark, folder, "pages"), outcomes)
    return judged.withColumn("bad_rate", F.round("bad_rate", 9))


@query()
def op4_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes and tokens of every document."""
    return token_counts.count(table(spark, folder, "documents"), "piece_bpe_32k.model")


@query(r"""
with sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size from documents),
totals as (
  select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) as rank from sized group by source),
capped as (
  select *, case (rank - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as weight, 3 * source_size as cap from totals),
scanned as (
  select *, coalesce(sum(cap) over before, 0)::bigint as caps, coalesce(sum(weight) over before, 0)::bigint as weights,
    sum(source_size) over ()::bigint as words_total, sum(weight) over ()::bigint as weights_total
  from capped window before as (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding)),
targets as (
  select source, source_size, least(cap::double, (select max((words_total - caps)::double / (weights_total - weights)) from scanned) * weight) as target
  from scanned),
ranked as (
  select doc_id, s.source, size, source_size, target,
    case when source_size > 0 then target / source_size else 0.0 end as rate,
    ('0x' || substr(md5('11|0|' || coalesce(s.source, '') || '|' || (s.source is null)::varchar), 1, 8))::bigint / 4294967296.0::double as u,
    row_number() over (partition by s.source order by size, md5('11|' || doc_id), doc_id) as k
  from sized s join targets t on s.source is not distinct from t.source)
select doc_id, size, source_size, target,
  least(floor(u + k * rate) - floor(u + (k - 1) * rate), 3)::bigint * size as taken,
  least(floor(u + k * rate) - floor(u + (k - 1) * rate), 3)::integer as copies
from ranked
""")
def op5_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    """Copies and words that the mix takes of every document."""
    docs = table(spark, folder, "documents")
    sized = materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix-sizes")
    planned = source_mix.plan_copies(sized, ["doc_id"])
    taken = (F.col("copies") * F.col("size")).cast("long")
    return planned.select("doc_id", "size", "source_size", "target", taken.alias("taken"), "copies")


@query(r"""
with dw as (
  select row_number() over () as rowid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents),
iw as (
  select coalesce(item_id::varchar, '') as item,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark),
windows as (
  select distinct item, least(len(w), 13) as m, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') as win
  from iw, generate_series(1, greatest(len(w) - 12, 1)) g(i) where len(w) > 0),
places as (
  select rowid, i, m, array_to_string(w[i:i + m - 1], ' ') as win
  from dw, (select distinct m from windows) x, generate_series(1, len(w) - m + 1) g(i)),
found as (select rowid, i, places.m, item from places join windows using (m, win)),
hits as (
  select rowid, count(distinct p) as n_hit from (select rowid, unnest(generate_series(i, i + m - 1)) as p from (select distinct rowid, i, m from found)) group by rowid),
items as (select rowid, count(*) as n_items, string_agg(item, ',' order by item) as ids from (select distinct rowid, item from found) group by rowid)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from dw left join hits using (rowid) left join items using (rowid)
""")
def op6_contamination(spark: SparkSession, folder: str) -> DataFrame:
    """Hit words and items of every document."""
    found = contamination.find(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return contamination.verdict(found).select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


@query()
def op7_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """Importance weight and verdict of every document."""
    return importance.classify(table(spark, folder, "documents"), table(spark, folder, "labels"), F.col("quality") == 1)


@query(r"""
with recursive m as (
  select conv_id, turn, role, row_number() over (partition by conv_id order by turn nulls first) as n, string_split(coalesce(text, ''), chr(10)) as lines from conversations),
l as (
  select conv_id, n, i, lines[i] as line, regexp_extract(lines[i], '^(?:[ \t]?>)+[ \t]?', 0) as marks from m, generate_series(1, len(lines)) g(i)),
x as (
  select conv_id, n, i, line, length(regexp_replace(marks, '[^>]', '', 'g')) as level,
    trim(regexp_replace(translate(regexp_replace(line, '^(?:[ \t]?>)+[ \t]?', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g')) as norm from l),
islands as (select *, i - row_number() over (partition by conv_id, n, level order by i) as run from x where level > 0),
passages as (select conv_id, n, level, list(norm order by i) as w from islands where norm <> '' group by conv_id, n, level, run),
lengths as (select 1 << j as k from generate_series(0, 30) g(j) where 1 << j <= (select max(len(w)) from passages)),
asked as (
  select distinct conv_id, n, level, k, array_to_string(w[i:i + k - 1], chr(10)) as run
  from passages, lengths, generate_series(1, len(w) - k + 1) g(i)),
said as (select conv_id, n, list(norm order by i) as w from x where level = 0 and norm <> '' group by conv_id, n),
origins as (
  select conv_id, k, array_to_string(w[i:i + k - 1], chr(10)) as run, min(n) as origin
  from said, lengths, generate_series(1, len(w) - k + 1) g(i) group by all),
links as (
  select q.conv_id, q.n, (max(struct_pack(l := -level, k := q.k, o := origin))).o as origin
  from asked q join origins o on q.conv_id is not distinct from o.conv_id and q.k = o.k and q.run = o.run where origin < q.n group by q.conv_id, q.n),
own as (
  select conv_id, n, coalesce(string_agg(case when level = 0 then line end, chr(10) order by i), '') as text, count(*) filter (level > 0) as n_quoted from x group by conv_id, n),
t as (
  select m.conv_id, m.turn, m.role, m.n, k.origin, case when m.n > 1 then coalesce(k.origin, m.n - 1) end as reply_to
  from m left join links k on m.conv_id is not distinct from k.conv_id and m.n = k.n),
tree as (
  select conv_id, n, [n] as path from t where n = 1
  union all select t.conv_id, t.n, list_append(tree.path, t.n) from t join tree on t.conv_id is not distinct from tree.conv_id and t.reply_to = tree.n)
select t.conv_id, row_number() over (partition by t.conv_id order by path) as position, turn, role, reply_to, origin is not null as linked, n_quoted, text
from t join tree on t.conv_id is not distinct from tree.conv_id and t.n = tree.n join own on t.conv_id is not distinct from own.conv_id and t.n = own.n
""")
def op8_reply_order(spark: SparkSession, folder: str) -> DataFrame:
    """Every message in reply order, without its quotes."""
    return threads.reply_order(table(spark, folder, "conversations"))


@query()
def op9_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every removed unit with its offsets and the unit that is kept."""
    return unit_dedup.repeated_units(table(spark, folder, "documents"))


@query(r"""
with words as (
  select doc_id, source, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
windows as (
  select rowid, doc_id, i, w[i:i + 4] as win from (select row_number() over () as rowid, * from words) x, generate_series(1, len(w) - 4) g(i)),
again as (
  select rowid, i from (select rowid, i, count(*) over (partition by rowid, win) as c from windows) where c > 1),
gaps as (
  select rowid, least(5, coalesce(lead(i) over (partition by rowid order by i) - i, 5)) as n from again),
repeats as (select rowid, sum(n)::bigint as n_repeat_words from gaps group by rowid),
figures as (
  select doc_id, source, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
    (length(text) - length(translate(text, '#*$%&|<>', '')))::bigint as n_symbols,
    (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words
  from (select row_number() over () as rowid, *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from words) x
  left join repeats using (rowid)),
judged as (
  select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from figures),
g as (
  select source, count(*) as n, sum(base_failed::int)::bigint as f, (select sum(base_failed::int)::double / count(*) from judged) as prior from judged group by source),
s as (""" + _SHRINK.format(keys="source", groups="g") + r""")
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and not (mean - 1.645 * sqrt(mean * (1 - mean) / (weight + 1)) > 0.5) as kept, round(mean, 9) as host_rate
from judged j join s on j.source is not distinct from s.source
""")
def op10_host_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Base figures and verdict of every document, with its source's shrunk failure rate."""
    judged = host_rules.judge(table(spark, folder, "documents"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.round("host_rate", 9).alias("host_rate"))


@query()
def op11_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """Whitened value of every vector on each of the first components."""
    return whitening.whiten(table(spark, folder, "embeddings"))


@query()
def op12_shards(spark: SparkSession, folder: str) -> DataFrame:
    """Shard and slot of every document, read back from the written shards."""
    docs = table(spark, folder, "documents")
    path = sharding.default_path(spark)
    sharding.write(docs, path)
    body = F.coalesce("text", F.lit(""))
    return sharding.read(spark, path, docs.schema).select(
        "doc_id", (F.octet_length(body) + sharding.RECORD_BYTES).cast("long").alias("size"),
        F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


@query(r"""
with d as (
  select coalesce(lang, 'und') as lang,
    string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') as pieces from documents),
w as (select lang, regexp_extract_all(pieces[i], '[^\x20\x09]+') as w from d, generate_series(1, len(pieces)) g(i)),
f as (
  select lang, m, w[i:i + m - 1] as p, count(*)::bigint as f from w, (values (1), (2), (3)) x(m), generate_series(1, len(w) - m + 1) g(i)
  group by lang, m, w[i:i + m - 1]),
c as (select lang, m, p, f as a from f where m > 1 and f >= 10),
cuts as (
  select c.lang, c.m, c.p, a, k, l.f as l, r.f as r, ((1000000::hugeint * a * a) // (l.f::hugeint * r.f))::bigint as score
  from c, generate_series(1, c.m - 1) g(k) join f l on l.lang = c.lang and l.p = c.p[1:k] join f r on r.lang = c.lang and r.p = c.p[k + 1:c.m]),
best as (select * from cuts qualify row_number() over (partition by lang, p order by score, k) = 1),
longer as (
  select lang, q, max(a) as a from (select lang, p[1:2] as q, a from c where m = 3 union all select lang, p[2:3], a from c where m = 3) group by lang, q),
kept as (select b.* from best b left join longer x on b.lang = x.lang and b.p = x.q where x.a is null or 100 * x.a < 50 * b.a),
named as (select lang, array_to_string(p, ' ') as phrase, a, l, r, score from kept),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from named)
select lang, rank, phrase, a, l, r, n, score from ranked join (select lang, sum(f)::bigint as n from f where m = 1 group by lang) using (lang)
where rank <= 2000
""")
def op13_phrases(spark: SparkSession, folder: str) -> DataFrame:
    """The strongest phrases of every language."""
    return collocations.mine(table(spark, folder, "documents"))
