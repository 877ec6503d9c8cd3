"""Queries: sources, columns, reshaping, filters, joins, summaries, windows, scalars."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortloom.functions import names, scalars
from cohortloom.operators import ranks, tables, visits as vis
from cohortloom.sources import lookups, tables as src
from cohortloom.storage import scratch_path
from study.registry import query
from study.views import (
    COUNTS_SPARSE_SQL, COUNTS_SQL, MEASURE_SQL, SUBJECTS_SQL, VISITS_SQL, counts, measure, real,
    sql_real, subjects, table, visits,
)


# ---- sources and sinks -------------------------------------------------------

@query(f"select c_custkey, c_name, c_mktsegment, {sql_real('c_acctbal', 2)} as balance from customer")
def csv_scan(spark, folder):
    path = scratch_path(spark, "csv")
    src.write_csv(table(spark, folder, "customer"), path)
    back = src.read_csv(spark, path, "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string")
    return back.select("c_custkey", "c_name", "c_mktsegment", real("c_acctbal", 2).alias("balance"))


@query("""select p_partkey, p_name, p_type, nullif(p_size, 7)::bigint as size from part""")
def tsv_scan(spark, folder):
    path = scratch_path(spark, "tsv")
    part = table(spark, folder, "part").select("p_partkey", "p_name", "p_type", F.nullif("p_size", F.lit(7)).alias("size"))
    src.write_csv(part, path, sep="\t")
    return src.read_tsv(spark, path, "p_partkey bigint, p_name string, p_type string, size bigint")


BRANDS = [f"Brand#{i}" for i in range(1, 26)]


@query(f"with {COUNTS_SQL} select feature, sample::varchar as sample_id, {sql_real('value', 2)} as value from counts")
def matrix_scan(spark, folder):
    path = scratch_path(spark, "matrix")
    src.write_csv(tables.to_wide(counts(spark, folder), ["sample"], "feature", "value", BRANDS), path)
    long = src.read_matrix(spark, path, "sample_id", "feature")
    return long.where(F.col("value").isNotNull()).select("feature", "sample_id", real("value", 2).alias("value"))


@query("""with places(i, written) as (select * from (values (0, 'Tuscon'), (1, 'Ft. Worth'), (2, 'Boston'), (3, 'WILTON'), (4, 'plano')))
, fixed(i, meant) as (select * from (values (0, 'Tucson'), (1, 'Fort Worth'), (2, 'Boston'), (3, 'Wilton'), (4, 'Plano')))
select c_custkey, meant as city from customer join places on c_custkey % 5 = i join fixed using (i)""")
def inline_lookup(spark, folder):
    written = F.element_at(F.array(*map(F.lit, ("Tuscon", "Ft. Worth", "Boston", "WILTON", "plano"))),
                           (F.col("c_custkey") % 5 + 1).cast("int"))
    fixes = lookups.lookup_table(spark, lookups.CITY_CORRECTIONS, "written", "meant")
    people = table(spark, folder, "customer").select("c_custkey", written.alias("written"))
    joined = people.join(F.broadcast(fixes), "written", "left")  # a fixed list
    return joined.select("c_custkey", F.coalesce("meant", "written").alias("city"))


@query(f"with {SUBJECTS_SQL} select site::bigint as site, count(*) as n, sum(carrier)::bigint as carriers from subjects group by site")
def stage_read(spark, folder):
    path = scratch_path(spark, "stage")
    src.write_stage(subjects(spark, folder), path)
    return src.read_stage(spark, path).groupBy(F.col("site").cast("long").alias("site")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("carrier").alias("carriers"))


@query("select p_brand, count(*) as n from part group by p_brand")
def csv_sink(spark, folder):
    path = scratch_path(spark, "sink")
    src.write_csv(table(spark, folder, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n")), path)
    return src.read_csv(spark, path, "p_brand string, n bigint")


@query(f"select count(*) as n, {sql_real('avg(quality)')} as share, 'quality' as kind from labels")
def json_sink(spark, folder):
    path = scratch_path(spark, "json")
    record = table(spark, folder, "labels").agg(F.count(F.lit(1)).alias("n"), real(F.avg("quality")).alias("share"))
    src.write_json(record.withColumn("kind", F.lit("quality")), path)
    return src.read_json(spark, path, "n bigint, share double, kind string")


# ---- columns -----------------------------------------------------------------

@query(f"select p_partkey as id, p_name as label, {sql_real('p_retailprice', 2)} as price from part")
def select_rename(spark, folder):
    df = table(spark, folder, "part").drop("p_type", "p_size")
    return df.withColumnsRenamed({"p_partkey": "id", "p_name": "label"}).select("id", "label", real("p_retailprice", 2).alias("price"))


@query("select l_orderkey, l_linenumber::bigint as l_linenumber, l_suppkey, l_partkey from lineitem")
def column_selectors(spark, folder):
    df = table(spark, folder, "lineitem")
    picked = tables.column_range(df, "l_orderkey", "l_linenumber")
    keys = set(tables.columns_ending(df, "key"))
    return df.select(*[F.col(c) if c in keys else F.col(c).cast("long").alias(c) for c in picked])


@query("""select c_custkey, 'ID' || c_custkey || '-P' as run, 'S' || (c_custkey % 7) || '-x' as site from customer""")
def header_cleaning(spark, folder):
    df = table(spark, folder, "customer")
    key = F.col("c_custkey").cast("string")
    run = F.concat(F.lit("ID"), key, F.lit("-P"), F.col("c_nationkey").cast("string"), F.lit("_a"))
    head = F.concat(F.lit("["), key, F.lit("]S"), (F.col("c_custkey") % 7).cast("string"), F.lit("-x"),
                    F.when(F.col("c_custkey") % 2 == 0, "-b38").otherwise(""), F.lit(":GT"))
    return df.select("c_custkey", names.clean_run_name(run).alias("run"), names.clean_genotype_header(head).alias("site"))


@query("""select page_id, nullif(split_part(url, '/', 3), '') as host, nullif(split_part(url, '/', 5), '') as tail,
case when regexp_matches(url, 'page=[0-9]+') then regexp_extract(url, 'page=([0-9]+)', 1) end as page_text from pages""")
def split_parts(spark, folder):
    url = F.col("url")
    page = names.part(F.regexp_replace(names.part(url, "page=", 2), r"[^0-9].*$", ""), "@", 1)
    blank = lambda c: F.nullif(c, F.lit(""))
    return table(spark, folder, "pages").select(
        "page_id", blank(names.part(url, "/", 3)).alias("host"), blank(names.part(url, "/", 5)).alias("tail"),
        blank(page).alias("page_text"))


@query("""with named as (select p_partkey, p_name, row_number() over (partition by p_name order by p_partkey) as k from part)
select p_partkey, p_name || case when k > 1 then '.' || (k - 1) else '' end as name from named""")
def feature_naming(spark, folder):
    part = table(spark, folder, "part")
    ids = part.select(F.col("p_partkey").alias("id"))
    # the annotation also holds later rows that must lose against the first
    first = part.select(F.col("p_partkey").alias("ann_id"), F.col("p_name").alias("name"), F.lit(1).alias("place"))
    later = part.select(F.col("p_partkey").alias("ann_id"), F.lit("zzz").alias("name"), F.lit(2).alias("place"))
    out = tables.map_features(ids, first.unionByName(later), "id", "ann_id", "name", "id", "place")
    return out.select(F.col("id").alias("p_partkey"), "name")


@query(r"""select user_id, event_id, case when event_id % 3 = 0 then 'X' || event_id || '.' || event_type
when event_id % 3 = 1 then event_type || '.' || event_id else '.' || event_type end as name from events""")
def syntactic_names(spark, folder):
    e = table(spark, folder, "events")
    i, t = F.col("event_id").cast("string"), F.col("event_type")
    raw = (F.when(F.col("event_id") % 3 == 0, F.concat(i, F.lit("-"), t))
           .when(F.col("event_id") % 3 == 1, F.concat(t, F.lit(" "), i)).otherwise(F.concat(F.lit("."), t)))
    return e.select("user_id", "event_id", names.syntactic(raw).alias("name"))


@query(f"""with {COUNTS_SQL}, named as (select p_brand, min(p_type) as target from part where p_brand like '%1%' group by p_brand)
select feature, max(target) as target, {sql_real('sum(value)', 2)} as total from counts left join named on p_brand = feature group by feature""")
def feature_lookup(spark, folder):
    totals = counts(spark, folder).groupBy("feature").agg(real(F.sum("value"), 2).alias("total"))
    names_ = table(spark, folder, "part").where(F.col("p_brand").contains("1")).groupBy(
        F.col("p_brand").alias("feature")).agg(F.min("p_type").alias("target"))
    return totals.join(names_, "feature", "left").select("feature", "target", "total")


@query("""select l_orderkey, l_linenumber::bigint as line, nullif(case when l_linenumber = 2 then 0 else l_linenumber end, 7)::bigint as a,
nullif(case when l_quantity::int = 2 then 0 else l_quantity::int end, 7)::bigint as b from lineitem""")
def across_columns(spark, folder):
    df = table(spark, folder, "lineitem").select(
        "l_orderkey", F.col("l_linenumber").alias("line"), F.col("l_linenumber").alias("a"), F.col("l_quantity").cast("int").alias("b"))
    cleaned = tables.across(df, ["a", "b"], lambda c: scalars.clean_code(c, to_null=[7], to_zero=[2]))
    return cleaned.select("l_orderkey", *[F.col(c).cast("long").alias(c) for c in ("line", "a", "b")])


@query("""with c as (select l_orderkey, max(case when l_linenumber = 1 then 1 end) as a, max(case when l_returnflag = 'R' then 1 end) as b,
max(case when l_linestatus = 'O' then 1 end) as d from lineitem group by l_orderkey)
select l_orderkey, (coalesce(a,0) + coalesce(b,0) + coalesce(d,0))::bigint as total,
(coalesce(a,0) + coalesce(b,0) + coalesce(d,0) > 1)::int::bigint as flag from c""")
def row_sum_flag(spark, folder):
    li = table(spark, folder, "lineitem")
    c = li.groupBy("l_orderkey").agg(
        F.max(F.when(F.col("l_linenumber") == 1, 1)).alias("a"), F.max(F.when(F.col("l_returnflag") == "R", 1)).alias("b"),
        F.max(F.when(F.col("l_linestatus") == "O", 1)).alias("d"))
    total = scalars.row_sum(F.col("a"), F.col("b"), F.col("d"))
    return c.select("l_orderkey", total.cast("long").alias("total"), scalars.exceeds(total, 1).cast("long").alias("flag"))


# ---- reshaping ---------------------------------------------------------------

@query(f"""with {COUNTS_SQL} select sample, {', '.join(sql_real(f"sum(case when feature = 'Brand#{i}' then value end)", 2) + f' as b{i}' for i in range(1, 26))}
from counts group by sample""")
def long_to_wide(spark, folder):
    wide = tables.to_wide(counts(spark, folder), ["sample"], "feature", "value", BRANDS)
    return wide.select("sample", *[real(F.col(f"`{n}`"), 2).alias(f"b{i}") for i, n in enumerate(BRANDS, 1)])


@query(f"""select o_orderkey, name, {sql_real('value', 2)} as value from (
select o_orderkey, 'price' as name, o_totalprice as value from orders union all
select o_orderkey, 'customer', o_custkey from orders)""")
def wide_to_long(spark, folder):
    o = table(spark, folder, "orders").select("o_orderkey", F.col("o_totalprice").alias("price"), F.col("o_custkey").cast("double").alias("customer"))
    return tables.to_long(o, ["o_orderkey"], ["price", "customer"], "name").select("o_orderkey", "name", real("value", 2).alias("value"))


@query(f"""with t as (select l_linenumber, l_returnflag || l_linestatus as site, sum(l_quantity) as q from lineitem group by all)
select site, {', '.join(sql_real(f'max(case when l_linenumber = {i} then q end)', 2) + f' as s{i}' for i in range(1, 8))} from t group by site""")
def transpose(spark, folder):
    sites = [a + b for a in "ANR" for b in "FO"]
    totals = table(spark, folder, "lineitem").groupBy(
        "l_linenumber", F.concat("l_returnflag", "l_linestatus").alias("site")).agg(F.sum("l_quantity").alias("q"))
    by_line = tables.to_wide(totals, ["l_linenumber"], "site", "q", sites)
    long = tables.to_long(by_line, ["l_linenumber"], name="site").where(F.col("value").isNotNull())
    back = tables.to_wide(long, ["site"], "l_linenumber", "value", list(range(1, 8)))
    return back.select("site", *[real(F.col(f"`{i}`"), 2).alias(f"s{i}") for i in range(1, 8)])


@query(f"""with {MEASURE_SQL} select sample, count(*) as n, {sql_real('sum(value * position)', 5)} as weighted from measure group by sample""")
def vector_assembly(spark, folder):
    rows = tables.assemble(measure(spark, folder), ["sample"], "feature", "value")
    parts = F.transform("features", lambda v, i: v * i)
    return rows.select("sample", F.size("features").cast("long").alias("n"),
                       real(F.aggregate(parts, F.lit(0.0), lambda a, b: a + b), 5).alias("weighted"))


@query(f"""with {SUBJECTS_SQL} select subject, (grp = 'BUILDING')::int::double as g1, (grp = 'FURNITURE')::int::double as g2,
(grp = 'HOUSEHOLD')::int::double as g3, (grp = 'MACHINERY')::int::double as g4,
case when site % 3 = 2 then -1.0::double else (site % 3 = 0)::int::double end as b1,
case when site % 3 = 2 then -1.0::double else (site % 3 = 1)::int::double end as b2,
carrier * (grp = 'BUILDING')::int::double as c_x_g1 from subjects""")
def design_columns(spark, folder):
    s = subjects(spark, folder).withColumn("batch", F.col("site") % 3)
    groups = tables.treatment_contrasts("grp", ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"], "g")
    batches = tables.sum_contrasts("batch", [0, 1, 2], "b")
    both = tables.interaction({"c": F.col("carrier").cast("double")}, {"g1": groups["g1"]})
    cols = {**groups, **batches, **both}
    return s.select("subject", *[c.alias(n) for n, c in cols.items()])


# ---- filters -----------------------------------------------------------------

@query("select o_orderkey, o_orderstatus from orders where o_orderstatus in ('F', 'P') and o_orderpriority <> '1-URGENT'")
def row_filters(spark, folder):
    o = table(spark, folder, "orders")
    kept = o.where(F.col("o_orderstatus").isin("F", "P") & (F.col("o_orderpriority") != "1-URGENT"))
    return kept.select("o_orderkey", "o_orderstatus")


@query("""select page_id, tail from (select page_id, split_part(url, '#', 2) as tail from pages) where tail <> ''""")
def drop_blank_keys(spark, folder):
    p = table(spark, folder, "pages").select("page_id", names.part(F.col("url"), "#", 2).alias("tail"))
    return p.where(tables.present("tail"))


@query("select o_orderkey, o_custkey from orders where o_custkey in (select o_custkey from orders group by 1 having count(*) >= 12)")
def keep_repeated_keys(spark, folder):
    return tables.keep_repeated(table(spark, folder, "orders").select("o_orderkey", "o_custkey"), "o_custkey", 12)


@query("""select event_id, user_id from events where user_id in
(select user_id from events group by 1 having count(distinct event_type) >= 5)""")
def keep_distinct_keys(spark, folder):
    e = table(spark, folder, "events").select("event_id", "user_id", "event_type")
    return tables.keep_repeated(e, "user_id", 5, "event_type").select("event_id", "user_id")


@query("""select lang, source, doc_id, n_chars from documents
qualify row_number() over (partition by lang, source order by doc_id) = 1""")
def first_row_per_key(spark, folder):
    d = table(spark, folder, "documents").select("lang", "source", "doc_id", "n_chars")
    return tables.first_per_key(d, ["lang", "source"], ["doc_id"])


@query("""select c_custkey from customer where c_custkey <> (select c_custkey from customer order by c_custkey limit 1 offset 4)""")
def drop_row_at_position(spark, folder):
    return tables.drop_position(table(spark, folder, "customer").select("c_custkey"), ["c_custkey"], 5)


@query("""select doc_id, quality::bigint as quality, n_chars from documents left join labels using (doc_id)
where quality is not null and nullif(n_chars % 5, 0) is not null""")
def complete_cases(spark, folder):
    d = table(spark, folder, "documents").select("doc_id", "n_chars", F.nullif(F.col("n_chars") % 5, F.lit(0)).alias("m"))
    joined = d.join(table(spark, folder, "labels"), "doc_id", "left")
    return joined.dropna(subset=["quality", "m"]).select("doc_id", F.col("quality").cast("long").alias("quality"), "n_chars")


_QUALITY_SQL = f"""with {{counts}}, n as (select count(distinct sample) as n from counts),
full_matrix as (select feature, sample, coalesce(value, 0) as value from
  (select distinct feature from counts) cross join (select distinct sample from counts) left join counts using (feature, sample)),
q as (select feature, sum(value) as total, var_samp(value) as variance, avg((value > {{cut}})::int) as detected from full_matrix group by feature)
select feature, {sql_real('total', 2)} as total, {sql_real('variance', 4)} as variance, {sql_real('detected')} as detected
from q where total > 0 and variance > 0 and detected >= 0.2"""


def _quality(df, cut):
    n_samples = df.agg(F.count_distinct("sample")).first()[0]
    q = tables.feature_quality(df, "feature", "value", n_samples, cut)
    kept = tables.passing_features(q)
    return kept.select("feature", real("total", 2).alias("total"), real("variance", 4).alias("variance"), real("detected").alias("detected"))


@query(_QUALITY_SQL.format(counts=COUNTS_SQL, cut=1))
def feature_quality_filter(spark, folder):
    return _quality(counts(spark, folder), 1)


@query(_QUALITY_SQL.format(counts=COUNTS_SPARSE_SQL, cut=1))
def feature_quality_filter_sparse(spark, folder):
    return _quality(counts(spark, folder, "p_partkey"), 1)


@query("""select c_custkey as key, 'left' as side, 'orders' as other from customer where c_custkey not in (select o_custkey from orders)
union all select doc_id, 'right', 'labels' from documents where doc_id not in (select doc_id from labels)""")
def alignment_check(spark, folder):
    key = lambda name, column: table(spark, folder, name).select(F.col(column).alias("key"))
    people = tables.key_mismatches(key("customer", "c_custkey"), key("orders", "o_custkey"), "key")
    texts = tables.key_mismatches(key("labels", "doc_id"), key("documents", "doc_id"), "key")
    return people.withColumn("other", F.lit("orders")).unionByName(texts.withColumn("other", F.lit("labels")))


# ---- joins -------------------------------------------------------------------

@query(f"""with {SUBJECTS_SQL} select grp, count(*) as n, {sql_real('sum(o_totalprice)', 2)} as total from orders join subjects on subject = o_custkey group by grp""")
def inner_join(spark, folder):
    o = table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("subject")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"))
    joined = o.join(subjects(spark, folder), "subject")
    return joined.groupBy("grp").agg(F.sum("n").alias("n"), real(F.sum("total"), 2).alias("total"))


@query(f"""with {VISITS_SQL} select subject, visit, {sql_real('score')} as score, {sql_real('price', 2)} as price from visits""")
def natural_join_visits(spark, folder):
    v = visits(spark, folder)
    left = v.select("subject", "visit", real("score").alias("score"))
    right = v.select("subject", "visit", real("price", 2).alias("price"))
    return tables.natural_join(left, right)


@query("""select c_custkey, n_orders, doc_chars, n_events, part_size::bigint as part_size, s_name from customer
left join (select o_custkey as c_custkey, count(*) as n_orders from orders group by 1) using (c_custkey)
left join (select doc_id as c_custkey, n_chars as doc_chars from documents where n_chars > 200) using (c_custkey)
left join (select user_id as c_custkey, count(*) as n_events from events group by 1) using (c_custkey)
left join (select p_partkey as c_custkey, p_size as part_size from part where p_size > 10) using (c_custkey)
left join (select s_suppkey as c_custkey, s_name from supplier) using (c_custkey)""")
def left_join_chain(spark, folder):
    key = "c_custkey"
    t = lambda n: table(spark, folder, n)
    others = [
        t("orders").groupBy(F.col("o_custkey").alias(key)).agg(F.count(F.lit(1)).alias("n_orders")),
        t("documents").where("n_chars > 200").select(F.col("doc_id").alias(key), F.col("n_chars").alias("doc_chars")),
        t("events").groupBy(F.col("user_id").alias(key)).agg(F.count(F.lit(1)).alias("n_events")),
        t("part").where("p_size > 10").select(F.col("p_partkey").alias(key), F.col("p_size").cast("long").alias("part_size")),
        t("supplier").select(F.col("s_suppkey").alias(key), "s_name"),
    ]
    return tables.left_join_chain(t("customer").select(key), others, key)


@query("""select coalesce(a.user_id, b.user_id, c.user_id) as user_id, a.n as n_click, b.n as n_view, c.n as n_error from
(select user_id, count(*) as n from events where event_type = 'click' group by 1 having count(*) > 10) a full join
(select user_id, count(*) as n from events where event_type = 'view' group by 1 having count(*) > 12) b on a.user_id = b.user_id full join
(select user_id, count(*) as n from events where event_type = 'error' group by 1 having count(*) > 14) c on coalesce(a.user_id, b.user_id) = c.user_id""")
def full_join_three(spark, folder):
    e = table(spark, folder, "events")
    one = lambda kind, low: e.where(F.col("event_type") == kind).groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > low)
    return tables.full_join_tables({"click": one("click", 10), "view": one("view", 12), "error": one("error", 14)}, "user_id")


@query("""select 'in' as kind, count(*) as n from documents where doc_id in (select doc_id from labels)
union all select 'out', count(*) from documents where doc_id not in (select doc_id from labels)""")
def semi_anti_join(spark, folder):
    d, keys = table(spark, folder, "documents").select("doc_id"), table(spark, folder, "labels").select("doc_id")
    n = lambda how, kind: d.join(keys, "doc_id", how).agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")
    return n("left_semi", "in").unionByName(n("left_anti", "out"))


@query("""select a.k, n_left, n_right from (select nullif(c_nationkey, 3)::bigint as k, count(*) as n_left from customer group by 1) a
join (select nullif(s_nationkey, 3)::bigint as k, count(*) as n_right from supplier group by 1) b on a.k is not distinct from b.k""")
def missing_keys_match(spark, folder):
    c = table(spark, folder, "customer").groupBy(F.nullif("c_nationkey", F.lit(3)).cast("long").alias("k")).agg(F.count(F.lit(1)).alias("n_left"))
    s = table(spark, folder, "supplier").groupBy(F.nullif("s_nationkey", F.lit(3)).cast("long").alias("k")).agg(F.count(F.lit(1)).alias("n_right"))
    return tables.na_join(c, s, "k", na_matches=True)


# ---- aggregations --------------------------------------------------------------

@query(f"with {SUBJECTS_SQL} select grp, carrier::bigint as carrier, count(*) as n from subjects group by all")
def count_by_group(spark, folder):
    return subjects(spark, folder).groupBy("grp", F.col("carrier").cast("long").alias("carrier")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""with {MEASURE_SQL}, m as (select feature, avg(case when y = 1 then value end) as p, avg(case when y = 0 then value end) as q from measure group by feature)
select feature, {sql_real('p')} as mean_pos, {sql_real('q')} as mean_neg, case when p - q < 0 then 'down' else 'up' end as direction from m""")
def class_means(spark, folder):
    m = tables.class_means(measure(spark, folder), "feature", "value", "y")
    return m.select("feature", real("mean_pos").alias("mean_pos"), real("mean_neg").alias("mean_neg"), "direction")


@query("""select o_custkey as subject, arg_min(o_orderpriority, (o_orderdate, o_orderkey)) as first_priority,
arg_min(o_orderstatus, (o_orderdate, o_orderkey)) as first_status from orders group by 1""")
def first_attributes(spark, folder):
    o = table(spark, folder, "orders")
    picked = tables.first_per_key(o.select("o_custkey", "o_orderdate", "o_orderkey", "o_orderpriority", "o_orderstatus"),
                                  ["o_custkey"], ["o_orderdate", "o_orderkey"])
    return picked.select(F.col("o_custkey").alias("subject"), F.col("o_orderpriority").alias("first_priority"),
                         F.col("o_orderstatus").alias("first_status"))


@query(f"""select l_returnflag, count(*) as n, {sql_real('avg(l_extendedprice)', 4)} as mean, {sql_real('median(l_extendedprice)', 4)} as median,
{sql_real('min(l_extendedprice)', 2)} as low, {sql_real('max(l_extendedprice)', 2)} as high from lineitem group by 1""")
def summary_by_group(spark, folder):
    li = table(spark, folder, "lineitem").select("l_returnflag", "l_extendedprice")
    plain = li.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), real(F.avg("l_extendedprice"), 4).alias("mean"),
        real(F.min("l_extendedprice"), 2).alias("low"), real(F.max("l_extendedprice"), 2).alias("high"))
    middle = ranks.exact_quantiles(li, ["l_returnflag"], "l_extendedprice", {"median": 0.5})
    return plain.join(middle.withColumn("median", real("median", 4)), "l_returnflag")


@query(f"""with {MEASURE_SQL}, e as (select feature, visit, avg(case when y = 1 then value end) - avg(case when y = 0 then value end) as est from measure group by all),
s as (select feature, count(*) as n, avg((est > 0)::int) as p, avg((est < 0)::int) as q from e group by 1)
select feature, n as n_visits, {sql_real('p')} as frac_pos, {sql_real('q')} as frac_neg, (p = 1 or q = 1) as all_same, (p >= 0.8 or q >= 0.8) as mostly_same from s""")
def sign_consistency(spark, folder):
    m = tables.class_means(measure(spark, folder).withColumn("key", F.struct("feature", "visit")), "key", "value", "y")
    e = m.select("key.feature", (F.col("mean_pos") - F.col("mean_neg")).alias("est"))
    s = tables.sign_consistency(e, "feature", "est")
    return s.select("feature", "n_visits", real("frac_pos").alias("frac_pos"), real("frac_neg").alias("frac_neg"), "all_same", "mostly_same")


@query(f"""select l_linestatus, {sql_real('quantile_cont(l_extendedprice, 0.333333)', 3)} as a, {sql_real('quantile_cont(l_extendedprice, 0.8)', 3)} as b,
{sql_real('quantile_cont(l_extendedprice, 0.975)', 3)} as c from lineitem group by 1""")
def exact_quantiles(spark, folder):
    q = ranks.exact_quantiles(table(spark, folder, "lineitem"), ["l_linestatus"], "l_extendedprice", {"a": 0.333333, "b": 0.8, "c": 0.975})
    return q.select("l_linestatus", *[real(c, 3).alias(c) for c in "abc"])


@query(f"with {COUNTS_SPARSE_SQL} select {sql_real('min(case when value > 1 then value end) / 2')} as half, count(*) as n from counts")
def positive_half_minimum(spark, folder):
    from cohortloom.operators.normalize import log_offset

    c = counts(spark, folder, "p_partkey").withColumn("over", F.when(F.col("value") > 1, F.col("value")).otherwise(0.0))
    return log_offset(c, "over").crossJoin(c.agg(F.count(F.lit(1)).alias("n"))).select(real("offset").alias("half"), "n")


@query(f"""with q as (select quantile_cont(o_totalprice, 0.5) as m from orders) select case when o_totalprice <= m then 'Low' else 'High' end as band,
count(*) as n, {sql_real('avg((o_orderstatus = $$F$$)::int)')} as share_f, {sql_real('avg(o_custkey)', 4)} as mean_key from orders cross join q group by 1""")
def profile_by_half(spark, folder):
    o = table(spark, folder, "orders")
    q = ranks.exact_quantiles(o, [], "o_totalprice", {"m": 0.5})
    band = F.when(F.col("o_totalprice") <= F.col("m"), "Low").otherwise("High")
    return o.crossJoin(F.broadcast(q)).groupBy(band.alias("band")).agg(
        F.count(F.lit(1)).alias("n"), real(F.avg((F.col("o_orderstatus") == "F").cast("double"))).alias("share_f"),
        real(F.avg("o_custkey"), 4).alias("mean_key"))


@query("""with r as (select min(l_extendedprice) as lo, max(l_extendedprice) as hi from lineitem)
select least(floor((l_extendedprice - lo) / ((hi - lo) / 50)) + 1, 50)::bigint as bin, count(*) as n from lineitem cross join r group by 1""")
def histogram_bins(spark, folder):
    h = tables.histogram(table(spark, folder, "lineitem").select("l_extendedprice"), "l_extendedprice", 50)
    return h.select(F.col("bin").cast("long").alias("bin"), "n")


@query("select c_mktsegment, " + ", ".join(f"{sql_real(f'quantile_cont(c_acctbal, {p})', 3)} as {n}" for n, p in
       (("low", 0), ("q1", 0.25), ("median", 0.5), ("q3", 0.75), ("high", 1))) + " from customer group by 1")
def five_numbers(spark, folder):
    f = tables.five_numbers(table(spark, folder, "customer"), ["c_mktsegment"], "c_acctbal")
    return f.select("c_mktsegment", *[real(c, 3).alias(c) for c in ("low", "q1", "median", "q3", "high")])


# ---- windows, order, sets --------------------------------------------------------

@query(f"with {VISITS_SQL} select subject, record, day::bigint as day, visit from visits")
def visit_numbering(spark, folder):
    return visits(spark, folder).select("subject", "record", F.col("day").cast("long").alias("day"), "visit")


@query(f"with {VISITS_SQL} select subject, record, {sql_real('years')} as years, {sql_real('score')} as score from visits where day = 0")
def baseline_rows(spark, folder):
    v = visits(spark, folder).select("subject", "record", "day", "years", "score")
    b = vis.baseline_rows(v, "subject", "day")
    return b.select("subject", "record", real("years").alias("years"), real("score").alias("score"))


_P_SQL = "p as (select o_orderkey as k, o_orderstatus as g, ((o_orderkey * 7919) % 10007 + 1) / 10008.0::double as p from orders)"


@query(f"""with {_P_SQL}, r as (select *, p * count(*) over (partition by g) / row_number() over (partition by g order by p, k) as s from p)
select k, g, {sql_real('least(1.0, min(s) over (partition by g order by p, k rows between current row and unbounded following))', 9)} as q from r""")
def fdr_adjust(spark, folder):
    o = table(spark, folder, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("g"),
                                              (((F.col("o_orderkey") * 7919) % 10007 + 1) / F.lit(10008.0)).alias("p"))
    return ranks.adjust_fdr(o, ["g"], "p", ["k"], "q").select("k", "g", real("q", 9).alias("q"))


@query(f"with {VISITS_SQL} select subject, visit, {sql_real('years', 9)} as years from visits")
def years_from_baseline(spark, folder):
    return visits(spark, folder).select("subject", "visit", real("years", 9).alias("years"))


@query(f"with {COUNTS_SQL} select feature, {sql_real('sum(value)', 2)} as total from counts group by 1 order by sum(value) desc, feature")
def order_by_score(spark, folder):
    t = counts(spark, folder).groupBy("feature").agg(F.sum("value").alias("total"))
    return t.orderBy(F.desc("total"), "feature").select("feature", real("total", 2).alias("total"))


@query(f"""with {COUNTS_SQL} select sample, feature, {sql_real('value', 2)} as value from counts
qualify row_number() over (partition by sample order by value desc, feature) <= 3""")
def top_k_per_group(spark, folder):
    from cohortloom.operators.information import top_per_replicate

    t = top_per_replicate(counts(spark, folder), "sample", "feature", "value", 3).where("selected = 1")
    return t.select("sample", "feature", real("value", 2).alias("value"))


@query("""select 'customer' as grp, c_custkey as id, c_nationkey::bigint as nation from customer
union all select 'supplier', s_suppkey, s_nationkey from supplier""")
def tagged_union(spark, folder):
    c = table(spark, folder, "customer").select(F.lit("customer").alias("grp"), F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("long").alias("nation"))
    s = table(spark, folder, "supplier").select(F.lit("supplier").alias("grp"), F.col("s_suppkey").alias("id"), F.col("s_nationkey").cast("long").alias("nation"))
    return c.unionByName(s)


# ---- scalars ---------------------------------------------------------------------

_GENO = """geno as (select p_partkey, ['0/0','0/1','1/1'][(p_size % 3 + 1)::int] as g1, ['0/0','0/1','1/1'][((p_partkey // 3) % 3 + 1)::int] as g2 from part),
calls as (select *, case when g1 = '0/0' and g2 = '1/1' then '22' when g1 = '0/0' and g2 = '0/1' then '23' when g1 = '0/1' and g2 = '0/1' then '24'
 when g1 = '0/0' and g2 = '0/0' then '33' when g1 = '0/1' and g2 = '0/0' then '34' when g1 = '1/1' and g2 = '0/0' then '44' end as call from geno)"""


def genotypes(spark, folder):
    p = table(spark, folder, "part")
    pick = lambda i: F.element_at(F.array(*map(F.lit, ("0/0", "0/1", "1/1"))), i.cast("int") + 1)
    return p.select("p_partkey", pick(F.col("p_size") % 3).alias("g1"), pick(F.floor(F.col("p_partkey") / 3) % 3).alias("g2"))


@query(f"with {_GENO} select p_partkey, g1, g2, call from calls")
def genotype_call(spark, folder):
    return genotypes(spark, folder).withColumn("call", scalars.allele_call(F.col("g1"), F.col("g2")))


@query(f"with {_GENO} select p_partkey, (coalesce(call, '') in ('24','34','44'))::int::bigint as carrier, (call in ('24','34','44'))::int::bigint as known from calls")
def carrier_status(spark, folder):
    g = genotypes(spark, folder).withColumn("call", scalars.allele_call(F.col("g1"), F.col("g2")))
    return g.select("p_partkey", scalars.carrier_flag(F.col("call")).cast("long").alias("carrier"),
                    scalars.carrier_flag(F.col("call"), "null").cast("long").alias("known"))


@query("""select l_linenumber::bigint as code, nullif(case when l_linenumber = 2 then 0 else l_linenumber end, 7)::bigint as cleaned, count(*) as n from lineitem group by all""")
def code_cleaning(spark, folder):
    c = F.col("l_linenumber")
    li = table(spark, folder, "lineitem").select(c.cast("long").alias("code"), scalars.clean_code(c, [7], [2]).cast("long").alias("cleaned"))
    return li.groupBy("code", "cleaned").agg(F.count(F.lit(1)).alias("n"))


@query(f"""with t as (select page_id, split_part(url, 'page=', 2) as raw from pages)
select page_id, {sql_real("case when raw = '' then 0 else try_cast(raw as double) end", 3)} as number,
{sql_real("(case when raw = '' then 0 else try_cast(raw as double) end) * (page_id % 3)", 3)} as product from t""")
def safe_numbers(spark, folder):
    raw = names.part(F.col("url"), "page=", 2)
    p = table(spark, folder, "pages").select("page_id", scalars.number_or_default(raw).alias("number"))
    return p.select("page_id", real("number", 3).alias("number"), real(F.col("number") * (F.col("page_id") % 3), 3).alias("product"))


@query("""select o_orderkey, case o_orderpriority when '1-URGENT' then 'first' when '2-HIGH' then 'second' when '5-LOW' then 'last' else o_orderpriority end as priority from orders""")
def dictionary_recode(spark, folder):
    mapping = {"1-URGENT": "first", "2-HIGH": "second", "5-LOW": "last"}
    return table(spark, folder, "orders").select("o_orderkey", scalars.recode(F.col("o_orderpriority"), mapping).alias("priority"))


@query("""select c_custkey, coalesce(nullif(c_mktsegment, 'BUILDING'), 'NA') || ',' || c_nationkey as key from customer""")
def composed_key(spark, folder):
    return table(spark, folder, "customer").select(
        "c_custkey", scalars.joined_key(F.nullif("c_mktsegment", F.lit("BUILDING")), F.col("c_nationkey")).alias("key"))


@query(f"select l_orderkey, l_linenumber::bigint as line, {sql_real('case when l_tax > 0 then log2(l_tax) end')} as lt from lineitem")
def guarded_log2(spark, folder):
    return table(spark, folder, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("line"), real(scalars.safe_log2(F.col("l_tax"))).alias("lt"))


@query(f"""with {COUNTS_SPARSE_SQL}, o as (select min(case when value > 0 then value end) / 2 as off from counts),
grid as (select * from (select distinct sample from counts) cross join (select distinct feature from counts))
select sample, feature, {sql_real('log2(coalesce(value, 0) + off)')} as lv from grid left join counts using (sample, feature) cross join o""")
def log2_with_offset(spark, folder):
    from cohortloom.operators.normalize import log2_with_offset as shift, log_offset

    c = counts(spark, folder, "p_partkey")
    offset = log_offset(c, "value")
    level = lambda cells: shift(cells, "value", "lv", offset).withColumn("lv", real("lv"))
    return tables.complete_grid(c, "sample", "feature", "value", each=level).select("sample", "feature", "lv")


@query(f"""with {_P_SQL}, r as (select *, p * count(*) over () / row_number() over (order by p, k) as s from p),
q as (select k, least(1.0, min(s) over (order by p, k rows between current row and unbounded following)) as q from r)
select k, {sql_real('-log10(q)')} as neg_log, q < 0.9 as significant from q""")
def volcano_columns(spark, folder):
    o = table(spark, folder, "orders").select(F.col("o_orderkey").alias("k"), (((F.col("o_orderkey") * 7919) % 10007 + 1) / F.lit(10008.0)).alias("p"))
    q = ranks.adjust_fdr(o, [], "p", ["k"], "q")
    return q.select("k", real(scalars.neg_log10(F.col("q"))).alias("neg_log"), (F.col("q") < 0.9).alias("significant"))


@query(f"""with s as (select o_custkey as subject, avg(ln(o_totalprice)) as est, stddev_samp(ln(o_totalprice)) / sqrt(count(*)) as se from orders group by 1 having count(*) > 1)
select subject, {sql_real('est - 1.96 * se')} as low, {sql_real('est + 1.96 * se')} as high, {sql_real('exp(est - 10)')} as ratio from s""")
def wald_interval(spark, folder):
    ln = F.log("o_totalprice")
    s = table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("subject")).agg(
        F.avg(ln).alias("est"), (F.stddev_samp(ln) / F.sqrt(F.count(F.lit(1)))).alias("se"), F.count(F.lit(1)).alias("n")).where("n > 1")
    e, se = F.col("est"), F.col("se")
    return s.select("subject", real(scalars.wald_low(e, se)).alias("low"), real(scalars.wald_high(e, se)).alias("high"), real(F.exp(e - 10)).alias("ratio"))


@query("""with f as (select user_id, count_if(event_type = 'click') > 13 as a, count_if(event_type = 'view') > 13 as b, count_if(event_type = 'error') > 13 as c from events group by 1)
select user_id, case when a and b and c then 'shared' when a and not b and not c then 'only_click' when b and not a and not c then 'only_view'
when c and not a and not b then 'only_error' else 'other' end as category from f""")
def flag_category(spark, folder):
    n = lambda kind: (F.count_if(F.col("event_type") == kind) > 13).alias(kind)
    f = table(spark, folder, "events").groupBy("user_id").agg(n("click"), n("view"), n("error"))
    cat = scalars.specificity_category(F.col("click"), F.col("view"), F.col("error"), ("shared", "only_click", "only_view", "only_error", "other"))
    return f.select("user_id", cat.alias("category"))


@query(f"""with q as (select quantile_cont(c_acctbal, 1/3) as lo, quantile_cont(c_acctbal, 2/3) as hi from customer)
select c_custkey, case when c_acctbal <= lo then 'fast' when c_acctbal >= hi then 'slow' else 'mid' end as grp, (c_acctbal <= lo)::int::bigint as fast from customer cross join q""")
def tertile_groups(spark, folder):
    c = table(spark, folder, "customer").select("c_custkey", "c_acctbal")
    q = ranks.exact_quantiles(c, [], "c_acctbal", {"lo": 1 / 3, "hi": 2 / 3})
    g = c.crossJoin(F.broadcast(q)).withColumn("grp", scalars.tertile_group(F.col("c_acctbal"), F.col("lo"), F.col("hi")))
    return g.select("c_custkey", "grp", (F.col("grp") == "fast").cast("long").alias("fast"))


@query("select o_orderkey, (o_orderstatus = 'F')::int::bigint as y from orders")
def outcome_label(spark, folder):
    return table(spark, folder, "orders").select("o_orderkey", scalars.outcome_flag(F.col("o_orderstatus"), "F").cast("long").alias("y"))
