"""Queries over sources, sinks and extraction rules."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumine.operators import extract as X
from vellumine.operators import layout as L
from vellumine.operators import library as B
from vellumine.plans.text import escaped, unescaped
from vellumine.session import shared_dir
from vellumine.sources import files as S
from vellumine.sources.tables import table
from vellumine.streaming import feeds

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def units(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "units").select("doc_id", "pos", "kind", F.coalesce("text", F.lit("")).alias("text"), "t0", "t1", "para_end").dropDuplicates(["doc_id", "pos"])


_U = "u as (select doc_id, pos, any_value(kind) as kind, coalesce(any_value(text), '') as text, any_value(t0) as t0, any_value(t1) as t1 from units group by doc_id, pos)"


@query(f"with {_U} select doc_id, count(*) as units, round(max(t1), 3) as duration, count(*) filter (where kind = 'heading') as headings from u group by doc_id")
def manifest_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Manifests written as JSON and read again."""
    docs = S.manifests(units(spark, d), B.current(table(spark, d, "papers")))
    u = S.manifest_units(docs)
    return u.groupBy("doc_id").agg(F.count("*").alias("units"), F.round(F.max("duration"), 3).alias("duration"), F.count_if(F.col("kind") == "heading").alias("headings"))


@query("with docs as (select doc_id, trim(regexp_replace(text, '[\\s\\p{Z}\\x0b\\x1c-\\x1f\\x85]+', ' ', 'g'), ' ') as t, section from documents where text is not null) select doc_id, 0 as pos, 'heading' as kind, coalesce(section, 'Text') as text from docs union all select doc_id, 1, 'body', t from docs")
def tei_like_units(spark: SparkSession, d: str) -> DataFrame:
    """Units read from markup (S07): each document is written as TEI with a reference and a note in it."""
    docs = table(spark, d, "documents").where("text is not null")
    tei = F.concat(F.lit("<div><head n='1'>"), escaped(F.coalesce("section", F.lit("Text"))), F.lit("</head><p>"), escaped(F.col("text")), F.lit('<ref type="bibr">[3]</ref></p><note>page furniture</note></div>'))
    return S.tei_units(docs.select("doc_id", tei.alias("tei"))).withColumn("text", unescaped(F.col("text")))


@query("select event_type, count(*) as n, round(sum(value), 2) as total from events where event_id % 10 <> 3 group by event_type")
def log_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Events appended as JSON lines among broken lines and read again (S10, K04); every tenth line is broken."""
    path = f"{shared_dir(spark)}/log-{uuid.uuid4().hex}"
    e = table(spark, d, "events").select("event_id", "event_type", "value")
    good = F.to_json(F.struct("event_id", "event_type", "value"))
    e.select(F.when(F.col("event_id") % 10 == 3, F.concat(F.lit("{broken "), good)).otherwise(good).alias("value")).write.mode("append").text(path)
    log = S.read_log(spark, path, "event_id bigint, event_type string, value double")
    return log.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("select name, admin, created, epoch, self_hosting, quota['operator_h'] as cap from users")
def accounts_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Accounts written as a table version and as strict JSON, and read again."""
    u = S.write_table(table(spark, d, "users"), f"{shared_dir(spark)}/accounts")
    path = f"{shared_dir(spark)}/accounts-{uuid.uuid4().hex}"
    u.write.json(path)
    back = S.read_accounts(spark, path, u.schema)
    return back.select("name", "admin", "created", "epoch", "self_hosting", F.try_element_at("quota", F.lit("operator_h")).alias("cap"))


@query("with docs as (select doc_id, text from documents where text is not null) select doc_id, length(text)::int as result from docs")
def cache_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Results by content key: half come from the cache, the others are computed once for equal texts."""
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", "text")
    cache = docs.where("doc_id % 2 = 0").select(F.sha2("text", 256).alias("key"), F.length("text").alias("result")).dropDuplicates(["key"])
    out, _ = S.cached(docs, cache, F.col("text"), lambda new: new.withColumn("result", F.length("text")))
    return out.select("doc_id", "result")


@query()
def title_selection(spark: SparkSession, d: str) -> DataFrame:
    """Titles from the lines of first pages by size, with titles known from meta."""
    w = L.page_words(table(spark, d, "words").where("page = 0")).withColumn("col", F.when(F.col("x0") >= L.PAGE_WIDTH / 2, 1).otherwise(0))
    lines = L.lines_of(w).groupBy("doc_id", "line").agg(F.round(F.max(F.col("y1") - F.col("y0")), 1).alias("size"), F.sort_array(F.collect_list(F.struct("x0", "pos", "text"))).alias("ws"))
    known = table(spark, d, "meta").groupBy("doc_id").agg(F.max("title").alias("known"))
    rows = lines.select("doc_id", F.col("line").alias("pos"), "size", F.array_join(F.transform("ws", lambda x: x["text"]), " ").alias("text")).join(known, "doc_id", "left")
    return X.titles(rows)


@query(
    rf"""with {_U}, x as (select doc_id, pos, kind, case when kind = 'body' then 'Abstract. ' || text else text end as text from u), h as (select *, regexp_extract(text, '(?i)^((?:\d+(?:\.\d+)*\.?\s+\p{{Lu}}[^.:]{{2,70}}|abstract|keywords?|index terms)[.:])\s+', 1) as head from x),
    s as (select *, head <> '' and length(text) - length(head) > 30 as cut from h) select doc_id, pos, 0 as part, case when cut then 'heading' else kind end as kind, case when cut then head else text end as text from s union all select doc_id, pos, 1, kind, ltrim(substring(text, length(head) + 1), ' ') from s where cut"""
)
def run_in_headings(spark: SparkSession, d: str) -> DataFrame:
    """Headings that run into their paragraphs split off (P12); every body unit begins with one."""
    u = units(spark, d).withColumn("text", F.when(F.col("kind") == "body", F.concat(F.lit("Abstract. "), "text")).otherwise(F.col("text")))
    return X.run_in_headings(u)


@query(
    f"""with {_U}, f as (select distinct doc_id, text, regexp_replace(lower(text), '[^a-z0-9]+', '', 'g') as key from u where kind = 'heading'), k as (select distinct doc_id, regexp_replace(lower(text), '[^a-z0-9]+', '', 'g') as known from u where kind = 'heading' and pos < 40),
    g as (select doc_id, key from f where key <> '' group by all) select doc_id, count(*) as missing from g where not exists (select 1 from k where k.doc_id = g.doc_id and known <> '' and (contains(known, key) or contains(key, known))) group by doc_id"""
)
def missing_headings(spark: SparkSession, d: str) -> DataFrame:
    """Headings that the first forty units of a document don't have."""
    h = units(spark, d).where("kind = 'heading'")
    return X.missing_headings(h, h.where("pos < 40")).groupBy("doc_id").agg(F.count("*").alias("missing"))


@query()
def mapped_text(spark: SparkSession, d: str) -> DataFrame:
    """Units cleaned with a box for every character."""
    return X.mapped_units(units(spark, d).where("text <> ''").select("doc_id", "pos", "text"))


@query(
    "with m as (select doc_id, title, extractor, list_position(['llm', 'grobid', 'heuristic'], extractor) as r from meta where title is not null and title <> '') select doc_id, title as value, extractor from (select *, row_number() over (partition by doc_id order by r, title) as rn from m where r > 0) where rn = 1"
)
def extractor_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Titles of the first usable extractor."""
    return X.first_usable(table(spark, d, "meta"), ["llm", "grobid", "heuristic"], F.col("title"))


@query("with k as (select event_id, user_id, json_extract_string(props, '$.k') as token from events) select token, min(event_id) as event_id, arg_min(user_id, event_id) as user_id, count(*) - 1 as rejected from k group by token")
def single_use_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Tokens taken once: the first use wins, later ones are rejected."""
    e = table(spark, d, "events").withColumn("token", F.get_json_object("props", "$.k"))
    return e.groupBy("token").agg(F.min("event_id").alias("event_id"), F.min_by("user_id", "event_id").alias("user_id"), (F.count("*") - 1).alias("rejected"))


@query("select distinct id, case when error is not null then 'error' when coalesce(duration, 0) > 3600 then 'blocked' else 'ready' end as outcome from papers where status in ('pending', 'generating')")
def work_queue(spark: SparkSession, d: str) -> DataFrame:
    """Pending and interrupted entries through a queue, in micro-batches."""
    like = table(spark, d, "papers")
    stream = feeds.file_stream(spark, f"{d}/paper[s].parquet", like)
    todo = stream.where(F.col("status").isin("pending", "generating"))
    outcome = F.when(F.col("error").isNotNull(), "error").when(F.coalesce("duration", F.lit(0.0)) > 3600, "blocked").otherwise("ready")
    return feeds.collect_once(todo.select("id", outcome.alias("outcome"))).distinct()
