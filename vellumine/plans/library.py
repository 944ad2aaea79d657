"""Queries over the library: entries, users, playlists, trees, events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellumine.functions import clean as C
from vellumine.operators import library as L
from vellumine.sources.tables import table, with_timestamps

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def papers(spark: SparkSession, d: str) -> DataFrame:
    return L.current(table(spark, d, "papers"))


def viewer(spark: SparkSession, d: str) -> DataFrame:
    """The viewer of the scoped queries: the first user by name who is no administrator, as a one-row table."""
    return table(spark, d, "users").where("not coalesce(admin, false)").agg(F.min("name").alias("me"))


_CUR = "cur as (select * exclude rn from (select *, row_number() over (partition by id order by written desc nulls last) as rn from papers) where rn = 1)"
_ME = "me as (select min(name) as me from users where not coalesce(admin, false))"


@query(f"with {_CUR} select status, count(*) as n, round(sum(coalesce(duration, 0)) / 3600, 3) as hours from cur group by status")
def status_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Entries and hours by status."""
    return papers(spark, d).groupBy("status").agg(F.count("*").alias("n"), F.round(F.sum(F.coalesce("duration", F.lit(0.0))) / 3600, 3).alias("hours"))


_USAGE = f"""{_CUR}, per as (select owner, count(*) as entries, round(sum(case when status = 'ready' then coalesce(duration, 0) else 0 end) / 3600, 2) as hours,
 round(sum(case when status = 'ready' and coalesce(billed, 'operator') = 'operator' then coalesce(duration, 0) else 0 end) / 3600, 4) as metered_hours from cur group by owner),
 us as (select name, quota['operator_h'] as cap, self_hosting, coalesce(entries, 0) as entries, coalesce(hours, 0) as hours, coalesce(metered_hours, 0) as metered_hours from users left join per on name = owner)"""


@query(f"with {_USAGE} select name, entries, hours from us")
def owner_usage(spark: SparkSession, d: str) -> DataFrame:
    """Entries and ready hours of every user."""
    return L.usage(table(spark, d, "users"), papers(spark, d)).select("name", "entries", "hours")


@query(f"with {_USAGE} select name, metered_hours from us")
def operator_metering(spark: SparkSession, d: str) -> DataFrame:
    """Hours the operator pays for."""
    return L.usage(table(spark, d, "users"), papers(spark, d)).select("name", "metered_hours")


@query(f"with {_USAGE} select name, cap, metered_hours, not coalesce(self_hosting, false) and cap is not null and metered_hours >= cap as blocked from us")
def quota_gate(spark: SparkSession, d: str) -> DataFrame:
    """Users at their cap."""
    return L.usage(table(spark, d, "users"), papers(spark, d)).select("name", "cap", "metered_hours", "blocked")


@query(f"with {_CUR} select count(*) filter (where status = 'pending') as queued, count(*) filter (where status = 'generating') as generating, count(*) filter (where status in ('error', 'blocked')) as needs_attention, count(*) filter (where status = 'ready') as ready from cur")
def health_kpis(spark: SparkSession, d: str) -> DataFrame:
    """Queue and health figures."""
    s = F.col("status")
    return papers(spark, d).agg(F.count_if(s == "pending").alias("queued"), F.count_if(s == "generating").alias("generating"), F.count_if(s.isin("error", "blocked")).alias("needs_attention"), F.count_if(s == "ready").alias("ready"))


@query(f"with {_CUR}, {_ME} select id, owner, status from cur, me where status <> 'reserving' and (owner = me.me or coalesce(shared, false))")
def scoped_library(spark: SparkSession, d: str) -> DataFrame:
    """What one viewer sees."""
    p = papers(spark, d).join(F.broadcast(viewer(spark, d)))  # one row
    return L.visible(p, F.col("me"), F.lit(False)).select("id", "owner", "status")


@query(f"with {_CUR}, {_ME} select id, case when owner = me.me then resume_t else resume_by[me.me] end as my_resume, case when owner = me.me then last_opened else opened_by[me.me] end as my_opened from cur, me where status <> 'reserving' and (owner = me.me or coalesce(shared, false))")
def reader_state(spark: SparkSession, d: str) -> DataFrame:
    """Visible entries with the viewer's own position."""
    p = L.visible(papers(spark, d).join(F.broadcast(viewer(spark, d))), F.col("me"), F.lit(False))
    return L.reader_state(p, F.col("me")).select("id", "my_resume", "my_opened")


@query(f"with {_CUR} select id, last_opened, resume_t from cur where status = 'ready' and resume_t > 30 order by coalesce(last_opened, 0) desc, resume_t desc, id limit 8")
def resume_top8(spark: SparkSession, d: str) -> DataFrame:
    """The eight entries to go on with (O01); the limit is the feature."""
    p = papers(spark, d).where((F.col("status") == "ready") & (F.col("resume_t") > L.RESUME_FLOOR))
    return p.orderBy(F.coalesce("last_opened", F.lit(0.0)).desc(), F.desc("resume_t"), "id").limit(L.RESUME_TOP).select("id", "last_opened", "resume_t")


@query(f"with {_CUR} select id, added from cur where status = 'ready' order by added desc nulls last, id limit 5")
def shelf_recent(spark: SparkSession, d: str) -> DataFrame:
    """The five newest entries (O02); the limit is the feature."""
    return papers(spark, d).where("status = 'ready'").orderBy(F.col("added").desc_nulls_last(), "id").limit(L.RECENT).select("id", "added")


@query("select event_id, user_id, value, 'other' as kind from events where event_type = 'error' order by event_id desc limit 50")
def issues_latest(spark: SparkSession, d: str) -> DataFrame:
    """The last fifty issue reports with unknown kinds as other (O03, P22); the limit is the feature."""
    kind = F.when(F.col("event_type").isin(L.ISSUE_KINDS), F.col("event_type")).otherwise("other")
    return table(spark, d, "events").where("event_type = 'error'").orderBy(F.desc("event_id")).limit(50).select("event_id", "user_id", "value", kind.alias("kind"))


def members(spark: SparkSession, d: str) -> DataFrame:
    """Orders as playlists of parts: place, length and how far they were heard."""
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("playlist"), F.col("l_linenumber").alias("pos"), "l_partkey", F.col("l_quantity").alias("q"))
    pa = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_retailprice").alias("duration"))
    return li.join(pa, "l_partkey").select("playlist", "pos", F.col("l_partkey").alias("item"), "duration", (F.col("q") * 40).alias("resume"))


_MEM = "m as (select l_orderkey as playlist, l_linenumber as pos, l_partkey as item, p_retailprice as duration, l_quantity * 40 as resume from lineitem join part on l_partkey = p_partkey)"


@query(f"with {_MEM} select playlist, count(*) as n, round(sum(least(resume, duration)) / coalesce(nullif(sum(duration), 0), 1), 4) as progress from m group by playlist")
def playlist_progress(spark: SparkSession, d: str) -> DataFrame:
    """Share heard of every playlist."""
    return L.progress(members(spark, d))


@query(f"with {_MEM} select playlist, coalesce(min(pos) filter (where pos >= 2 and not resume >= 0.95 * duration), 2) as next from m group by playlist")
def next_unfinished(spark: SparkSession, d: str) -> DataFrame:
    """The first unfinished member from the second on."""
    return L.next_unfinished(members(spark, d), F.lit(2)).select("playlist", "next")


@query(
    """with s as (select l_orderkey as list, l_linenumber as pos, l_partkey as item, l_returnflag = 'N' as mine from lineitem), r as (select list, pos, row_number() over (partition by list order by pos) as rank from s where mine),
    w as (select list, item, row_number() over (partition by list order by item desc, pos) as rank from s where mine), p as (select r.list, r.pos, w.item as new from r join w using (list, rank)) select s.list, s.pos, coalesce(new, item) as item from s left join p using (list, pos)"""
)
def order_splice(spark: SparkSession, d: str) -> DataFrame:
    """Lists in which only one's own slots are reordered."""
    s = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("list"), F.col("l_linenumber").alias("pos"), F.col("l_partkey").alias("item"), (F.col("l_returnflag") == "N").alias("mine"))
    w = Window.partitionBy("list").orderBy(F.desc("item"), "pos")
    wanted = s.where("mine").select("list", F.row_number().over(w).alias("rank"), "item")
    return L.splice(s, wanted)


@query("select count(*) as differ from ((select l_orderkey, l_partkey from lineitem except all select l_orderkey, l_partkey from lineitem where l_linenumber <= 6) union all (select l_orderkey, l_partkey from lineitem where l_linenumber <= 6 except all select l_orderkey, l_partkey from lineitem))")
def order_multiset_check(spark: SparkSession, d: str) -> DataFrame:
    """How far two orders differ as multisets."""
    a = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    b = a.where("l_linenumber <= 6").select("l_orderkey", "l_partkey")
    a = a.select("l_orderkey", "l_partkey")
    return a.exceptAll(b).unionByName(b.exceptAll(a)).agg(F.count("*").alias("differ"))


def tree(spark: SparkSession, d: str) -> DataFrame:
    """Regions, nations and customers as one tree of folders."""
    r = table(spark, d, "region").select(F.concat(F.lit("r"), F.col("r_regionkey")).alias("id"), F.col("r_name").alias("name"), F.lit(None).cast("string").alias("parent"))
    n = table(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("id"), F.col("n_name").alias("name"), F.concat(F.lit("r"), F.col("n_regionkey")).alias("parent"))
    c = table(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey")).alias("id"), F.col("c_name").alias("name"), F.concat(F.lit("n"), F.col("c_nationkey")).alias("parent"))
    return r.unionByName(n).unionByName(c)


_TREE = "t as (select 'r' || r_regionkey as id, r_name as name, null::varchar as parent from region union all select 'n' || n_nationkey, n_name, 'r' || n_regionkey from nation union all select 'c' || c_custkey, c_name, 'n' || c_nationkey from customer)"


@query(f"with recursive {_TREE}, up as (select id, name as path, parent, 1 as depth from t union all select u.id, t.name || ' / ' || u.path, t.parent, u.depth + 1 from up u join t on u.parent = t.id), far as (select id, max(depth) as depth from up group by id) select up.id, up.path, up.depth from up join far using (id, depth)")
def folder_paths(spark: SparkSession, d: str) -> DataFrame:
    """Paths of all folders by a recursive query."""
    return L.paths(tree(spark, d))


@query(f"with recursive {_TREE}, up as (select id, parent as above from t where parent is not null union all select u.id, t.parent from up u join t on u.above = t.id where t.parent is not null) select id, true as rejected from up where above = 'r1' union all select 'r1', true")
def folder_cycle_check(spark: SparkSession, d: str) -> DataFrame:
    """Folders under which region 1 must not be moved: itself and all below it."""
    tree(spark, d).createOrReplaceTempView("__vellumine_moves")
    return spark.sql("with recursive down(id) as (select 'r1' union all select t.id from __vellumine_moves t join down on t.parent = down.id) select id, true as rejected from down")


@query(f"with {_CUR} select id from cur where contains(lower(concat_ws(' ', title, authors, year::varchar)), 'polymer')")
def search_titles(spark: SparkSession, d: str) -> DataFrame:
    """Entries whose title, authors or year hold the search text."""
    return papers(spark, d).where(F.contains(F.lower(F.concat_ws(" ", "title", "authors", F.col("year").cast("string"))), F.lit("polymer"))).select("id")


_COMMAS = "(length({0}) - length(replace({0}, ',', '')))"


@query(
    f"""with {_CUR}, r as (select doc_id, extractor, any_value(title) as title, any_value(authors) as authors, any_value(year) as year from (select distinct doc_id, run, extractor, title, authors, year from meta) where run = 1 or extractor = 'llm' group by doc_id, extractor),
    h as (select doc_id, max(title) as title, max(authors) as authors, max(year) as year from meta where extractor = 'heuristic' group by doc_id), l as (select doc_id, max(title) as title, max(authors) as authors, max(year) as year from meta where extractor = 'llm' group by doc_id)
    select cur.id, case when meta_locked then cur.title else coalesce(nullif(h.title, ''), nullif(l.title, ''), cur.title) end as title,
    case when meta_locked then cur.authors when {_COMMAS.format("coalesce(l.authors, '')")} > {_COMMAS.format("coalesce(h.authors, '')")} then l.authors else coalesce(nullif(h.authors, ''), nullif(l.authors, ''), cur.authors) end as authors,
    case when meta_locked then cur.year else coalesce(h.year, l.year, cur.year) end as year from cur left join h on cur.id = h.doc_id left join l on cur.id = l.doc_id"""
)
def meta_merge(spark: SparkSession, d: str) -> DataFrame:
    """Entries with merged data of the extraction runs: locks first, then the heuristic run, then the model."""
    m = table(spark, d, "meta")

    def of(extractor: str, a: str) -> DataFrame:
        return m.where(F.col("extractor") == extractor).groupBy("doc_id").agg(F.max("title").alias(f"{a}_title"), F.max("authors").alias(f"{a}_authors"), F.max("year").alias(f"{a}_year")).withColumnRenamed("doc_id", "id")

    j = papers(spark, d).join(of("heuristic", "h"), "id", "left").join(of("llm", "l"), "id", "left")
    empty = lambda c: F.nullif(F.col(c), F.lit(""))
    commas = lambda c: F.length(F.coalesce(c, F.lit(""))) - F.length(F.replace(F.coalesce(c, F.lit("")), F.lit(","), F.lit("")))
    authors = F.when(F.col("meta_locked"), F.col("authors")).when(commas("l_authors") > commas("h_authors"), F.col("l_authors")).otherwise(F.coalesce(empty("h_authors"), empty("l_authors"), "authors"))
    return j.select("id", F.when(F.col("meta_locked"), F.col("title")).otherwise(F.coalesce(empty("h_title"), empty("l_title"), "title")).alias("title"), authors.alias("authors"), F.when(F.col("meta_locked"), F.col("year")).otherwise(F.coalesce("h_year", "l_year", "year")).alias("year"))


@query("with h as (select doc_id, substring(sha1(text), 1, 10) as hash from documents where text is not null) select hash, min(doc_id) as kept, count(*) as copies from h group by hash having count(*) > 1")
def dedupe_by_hash(spark: SparkSession, d: str) -> DataFrame:
    """Texts stored more than once, by a hash, with the first."""
    h = table(spark, d, "documents").where("text is not null").select("doc_id", F.substring(F.sha1(F.col("text").cast("binary")), 1, 10).alias("hash"))
    return h.groupBy("hash").agg(F.min("doc_id").alias("kept"), F.count("*").alias("copies")).where("copies > 1")


def events(spark: SparkSession, d: str) -> DataFrame:
    return with_timestamps(table(spark, d, "events"), "ts")


@query("with h as (select event_id, user_id, epoch_us(ts) as us from events) select event_id, count(*) over (partition by user_id order by us range between 86399999999 preceding and current row) - count(*) over (partition by user_id, us) as before, count(*) over (partition by user_id order by us range between 86399999999 preceding and current row) - count(*) over (partition by user_id, us) >= 10 as throttled from h")
def throttle_sliding(spark: SparkSession, d: str) -> DataFrame:
    """Events with the number of earlier ones in a sliding day, and the throttle."""
    h = events(spark, d).select("event_id", "user_id", F.unix_micros("ts").alias("us"))
    return L.throttled(h, "user_id", "us", 86400, 10).select("event_id", "before", "throttled")


@query()
def progress_emission(spark: SparkSession, d: str) -> DataFrame:
    """Progress reports of users that are sent on."""
    e = table(spark, d, "events").select(F.col("user_id").alias("key"), F.struct(F.col("event_id").alias("seq"), (F.col("value") / 100).alias("frac"), F.col("event_type").alias("label")).alias("r"))
    return L.emitted(e.groupBy("key").agg(F.sort_array(F.collect_list("r")).alias("reports")))


@query(
    """with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) <= interval 30 minutes then 0 else 1 end as opens from events), s as (select *, sum(opens) over (partition by user_id order by ts) as k from g)
    select user_id, count(*) as sessions, max(n) as longest from (select user_id, k, count(*) as n from s group by all) group by user_id"""
)
def idle_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions closed by half an hour of silence, by user."""
    s = L.sessions(events(spark, d), "user_id", "ts", "30 minutes")
    return s.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


@query("select user_id, event_type, arg_max(value, event_id) as value, max(event_id) as event_id from events group by user_id, event_type")
def last_position(spark: SparkSession, d: str) -> DataFrame:
    """The last value of every user and kind: the last write wins."""
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.max_by("value", "event_id").alias("value"), F.max("event_id").alias("event_id"))


@query("select coalesce(o_orderstatus, 'all') as status, coalesce(o_orderpriority, 'all') as priority, count(*) as n, count(distinct o_custkey) as customers from orders group by rollup (o_orderstatus, o_orderpriority)")
def status_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Counts on three levels (native extra)."""
    o = table(spark, d, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("customers"))
    return o.select(F.coalesce("o_orderstatus", F.lit("all")).alias("status"), F.coalesce("o_orderpriority", F.lit("all")).alias("priority"), "n", "customers")


@query()
def approx_distinct_users(spark: SparkSession, d: str) -> DataFrame:
    """Users by kind of event, estimated (native extra)."""
    return table(spark, d, "events").groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.02).alias("users"))


@query("with u as (select distinct id from papers where status = 'ready'), m as (select distinct doc_id from meta) select id, exists (select 1 from m where m.doc_id = u.id) as extracted from u")
def queue_semi_join(spark: SparkSession, d: str) -> DataFrame:
    """Ready entries and whether an extraction run knows them."""
    u = table(spark, d, "papers").where("status = 'ready'").select("id").distinct()
    m = table(spark, d, "meta").select(F.col("doc_id").alias("id")).distinct().withColumn("known", F.lit(True))
    return u.join(m, "id", "left").select("id", F.coalesce("known", F.lit(False)).alias("extracted"))


@query(f"with {_CUR} select owner, count(*) as n, count(*) >= 200 as full from cur group by owner")
def owner_caps(spark: SparkSession, d: str) -> DataFrame:
    """Entries of every owner against the cap of 200."""
    return papers(spark, d).groupBy("owner").agg(F.count("*").alias("n")).withColumn("full", F.col("n") >= 200)


@query("select event_id, case when try_cast(value as double) >= 0 and not isnan(value) then value end as clean, least(greatest(value / 20, 0.5), 2.0) as speed, round(pow(2, value / 100), 6) as rate from events")
def number_checks(spark: SparkSession, d: str) -> DataFrame:
    """Finite non-negative numbers, clamped speeds and rates."""
    e = table(spark, d, "events")
    return e.select("event_id", C.finite_non_negative(F.col("value").cast("string")).alias("clean"), C.clamp(F.col("value") / 20, 0.5, 2.0).alias("speed"), F.round(F.pow(F.lit(2.0), F.col("value") / 100), 6).alias("rate"))
