"""Queries over narrated units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellumine.functions import clean as C
from vellumine.functions import folds
from vellumine.operators import narration as N
from vellumine.sources.tables import table

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
    """Units without repeated rows, null texts as empty."""
    u = table(spark, d, "units").select("doc_id", "pos", "kind", "text", "rects", "para_end", "pause", "t0", "t1").dropDuplicates(["doc_id", "pos"])
    return u.withColumn("text", F.coalesce("text", F.lit("")))


_U = "u as (select doc_id, pos, any_value(kind) as kind, coalesce(any_value(text), '') as text, any_value(rects) as rects, any_value(para_end) as para_end, any_value(pause) as pause, any_value(t0) as t0, any_value(t1) as t1 from units group by doc_id, pos)"
_BLANK = r"[\s\p{Z}\x0b\x1c-\x1f\x85]"
_O = "(partition by doc_id order by pos)"


@query(
    f"""with {_U}, l as (select *, coalesce(para_end, false) or lead(kind) over {_O} is null as para_last from u),
    p as (select *, case kind when 'heading' then 0.7 when 'equation' then 1.6 else case when para_last then 0.5 else 0.25 end end as pause_s from l),
    n as (select *, (length(text) * 1600)::bigint as n, floor(pause_s * 24000)::bigint as rest from p),
    s as (select *, coalesce(sum(n + rest) over (partition by doc_id order by pos rows between unbounded preceding and 1 preceding), 0) as before from n)
    select doc_id, pos, para_last, round(before / 24000.0, 3) as start_s, round((before + n) / 24000.0, 3) as end_s from s"""
)
def narration_timeline(spark: SparkSession, d: str) -> DataFrame:
    """Running times of units from the lengths of their texts and pauses."""
    u = N.with_pauses(units(spark, d))
    return N.timeline(u, F.length("text") * N.SAMPLES_PER_CHAR, F.col("pause_s")).select("doc_id", "pos", "para_last", "start_s", "end_s")


@query(f"with {_U}, e as (select doc_id, max(t1) as duration from u group by doc_id), h as (select * from u join e using (doc_id) where kind = 'heading') select doc_id, pos, text, t0 as from_s, coalesce(lead(t0) over {_O}, duration) as to_s from h")
def section_extents(spark: SparkSession, d: str) -> DataFrame:
    """Sections with their extent in time."""
    return N.sections(units(spark, d))


def positions(spark: SparkSession, d: str) -> DataFrame:
    """Places in narrations that readers ask for: a time in each stored paper."""
    p = table(spark, d, "papers").select(F.col("id").alias("doc_id"), "written", "resume_t").where("resume_t is not null")
    return p.distinct()


@query(
    f"""with {_U}, p as (select distinct id as doc_id, written, resume_t from papers where resume_t is not null), t as (select doc_id, t0, substring(text, 1, 400) as heard from u where text <> '' and t0 is not null)
    select p.doc_id, p.written, p.resume_t, t.heard from p asof left join t on p.doc_id = t.doc_id and p.resume_t >= t.t0"""
)
def unit_at_time(spark: SparkSession, d: str) -> DataFrame:
    """The sentence read at a stored position: the latest with a text at or before it."""
    u = units(spark, d).where("t0 is not null")
    return N.as_of(positions(spark, d), u, "doc_id", "resume_t", "t0", {"heard": F.substring(F.nullif("text", F.lit("")), 1, 400)})


@query(
    f"""with {_U}, p as (select distinct id as doc_id, written, resume_t from papers where resume_t is not null), a as (select doc_id, t0, pos from u where t0 is not null), s as (select doc_id, t0, pos as section from u where kind = 'heading' and t0 is not null),
    x as (select p.*, a.pos from p asof left join a on p.doc_id = a.doc_id and p.resume_t >= a.t0) select x.doc_id, x.written, x.resume_t, coalesce(x.pos, -1) as unit, coalesce(s.section, 0) as section from x asof left join s on x.doc_id = s.doc_id and x.resume_t >= s.t0"""
)
def active_section(spark: SparkSession, d: str) -> DataFrame:
    """The active unit (-1 before the first) and section (0 before the first) at a stored position."""
    u = units(spark, d).where("t0 is not null")
    out = N.as_of(positions(spark, d), u, "doc_id", "resume_t", "t0", {"unit": F.col("pos"), "section": F.when(F.col("kind") == "heading", F.col("pos"))})
    return out.fillna(-1, ["unit"]).fillna(0, ["section"])


def _rects(u: DataFrame) -> DataFrame:
    r = u.where("rects is not null").select("doc_id", "pos", F.posexplode("rects").alias("k", "r"))
    return r.select("doc_id", "pos", "k", "r.page", "r.x0", "r.y0", "r.x1", "r.y1")


_RECTS = f"{_U}, e as (select doc_id, pos, unnest(range(len(rects)))::int as k, unnest(rects) as r from u where rects is not null), rc as (select doc_id, pos, k, r.page as page, r.x0 as x0, r.y0 as y0, r.x1 as x1, r.y1 as y1 from e)"
_POINTS = "pt as (select distinct doc_id, page, 0 as id, 306.0 as x, 200.5 as y from rc union all select distinct doc_id, page, 1, 40.0, 500.25 from rc union all select distinct doc_id, page, 2, 590.0, 700.75 from rc)"


@query(
    f"""with {_RECTS}, {_POINTS}, j as (select pt.*, rc.pos, k, y1, greatest(x0 - x, x - x1, 0) as dx, greatest(y0 - y, y - y1, 0) as dy from pt join rc using (doc_id, page)),
    s as (select *, round(3 * dy + dx + case when y > y1 then 500 else 0 end, 4) as score from j), r as (select *, row_number() over (partition by doc_id, page, id order by case when dx = 0 and dy = 0 then 0 else 1 end, case when dx = 0 and dy = 0 then -pos end, case when dx = 0 and dy = 0 then -k end, score, pos, k) as rn from s)
    select doc_id, page, id, pos from r where rn = 1"""
)
def nearest_rect(spark: SparkSession, d: str) -> DataFrame:
    """The unit at or nearest to three points of each page."""
    rects = _rects(units(spark, d))
    pages = rects.select("doc_id", "page").distinct()
    pts = F.explode(F.array(*[F.struct(F.lit(i).alias("id"), F.lit(x).alias("x"), F.lit(y).alias("y")) for i, x, y in ((0, 306.0, 200.5), (1, 40.0, 500.25), (2, 590.0, 700.75))]))
    points = pages.select("doc_id", "page", pts.alias("p")).select("doc_id", "page", "p.id", "p.x", "p.y")
    return N.nearest_rect(points, rects)


@query(f"with {_RECTS}, w as (select *, sum(greatest(x1 - x0, 0)) over (partition by doc_id, pos order by k) as run, sum(greatest(x1 - x0, 0)) over (partition by doc_id, pos) as total from rc) select doc_id, pos, min(k) filter (where run >= 0.6 * total)::int as k from w where total > 0 group by doc_id, pos")
def sub_position(spark: SparkSession, d: str) -> DataFrame:
    """The rectangle read at three fifths of a unit's time, by widths."""
    width = F.greatest(F.col("x1") - F.col("x0"), F.lit(0.0))
    unit = Window.partitionBy("doc_id", "pos")
    w = _rects(units(spark, d)).withColumn("run", F.sum(width).over(unit.orderBy("k"))).withColumn("total", F.sum(width).over(unit))
    return w.where("total > 0").groupBy("doc_id", "pos").agg(F.min(F.when(F.col("run") >= 0.6 * F.col("total"), F.col("k"))).alias("k"))


@query(
    f"""with {_U}, c as (select *, kind = 'heading' or coalesce(para_end, false) as closes from u), o as (select *, coalesce(lag(closes) over {_O} or kind = 'heading', true) as opens from c),
    g as (select *, sum(opens::int) over {_O} as grp from o) select doc_id, grp::bigint as grp, string_agg(case when kind = 'heading' then '## ' || text else text end, ' ' order by pos) as paragraph from g where text <> '' group by doc_id, grp"""
)
def paragraph_text(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs with marked headings."""
    return N.paragraphs(units(spark, d))


@query(
    f"""with {_U}, f as (select *, not regexp_matches(regexp_replace(regexp_replace(text, '{_BLANK}+$', ''), '["”’)»]+$', ''), '[.!?]$') as open from u), j as (select *, coalesce(kind = 'body' and lag(kind) over {_O} = 'body' and lag(open) over {_O}, false) as joins from f),
    g as (select *, sum(case when joins then 0 else 1 end) over {_O} as grp from j), m as (select doc_id, grp::bigint as grp, min(kind) as kind, count(*) as rows, list(text order by pos) as ts from g group by doc_id, grp)
    select doc_id, grp, kind, rows, case when len(ts) = 1 then ts[1] else regexp_replace(array_to_string(list_filter(list_transform(ts[:len(ts) - 1], lambda x: regexp_replace(x, '{_BLANK}+$', '')), lambda x: x <> ''), chr(10)), '^{_BLANK}+', '') || chr(10) || ts[len(ts)] end as text from m"""
)
def continuation_merge(spark: SparkSession, d: str) -> DataFrame:
    """Body units merged with unfinished ones before them."""
    return N.continuations(units(spark, d))


@query(
    f"""with {_U}, t as (select doc_id, max(title) as title from meta where title is not null group by doc_id), k as (select u.doc_id, pos, text, title, regexp_replace(lower(title), '[^a-z0-9]+', '', 'g') as tk, regexp_replace(lower(text), '[^a-z0-9]+', '', 'g') as xk from u left join t using (doc_id) where kind = 'body' and length(text) > 12),
    f as (select * from k where title is null or tk = '' or xk = '' or not (contains(tk, xk) or contains(xk, tk))), b as (select *, coalesce(sum(length(text)) over (partition by doc_id order by pos rows between unbounded preceding and 1 preceding), 0) as before from f)
    select doc_id, substring(string_agg(text, ' ' order by pos), 1, 360) as preview from b where before <= 320 group by doc_id"""
)
def preview_text(spark: SparkSession, d: str) -> DataFrame:
    """Previews of documents."""
    titles = table(spark, d, "meta").select("doc_id", "title").where("title is not null")
    return N.preview(units(spark, d), titles)


@query(f"with {_U}, r as (select doc_id, pos, row_number() over {_O} as rn from u where text <> '') select doc_id, pos, ((rn - 1) // 8)::int as batch from r")
def fixed_batches(spark: SparkSession, d: str) -> DataFrame:
    """Units that are sent, in batches of eight."""
    u = units(spark, d).where("text <> ''")
    return u.select("doc_id", "pos", F.floor((F.row_number().over(N.in_order()) - 1) / 8).cast("int").alias("batch"))


@query()
def window_packing(spark: SparkSession, d: str) -> DataFrame:
    """Windows of units under a size and a count, packed in order (W21); the size of a unit is that of its head and tail, and 60."""
    return windows_of(units(spark, d))


def windows_of(u: DataFrame) -> DataFrame:
    """(doc_id, pos, win) of units (doc_id, pos, text)."""
    s = C.head_tail(F.col("text"))
    est = F.length(s["head"]) + F.length(s["tail"]) + 60
    g = u.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", est.alias("est")))).alias("us"))
    z = g.select("doc_id", F.explode(F.arrays_zip(F.col("us.pos").alias("pos"), folds.packed_windows(F.col("us.est")).alias("win"))).alias("z"))
    return z.select("doc_id", F.col("z.pos").alias("pos"), F.col("z.win").alias("win"))


@query(f"with {_U}, l as (select *, max(case when kind = 'body' then pos end) over (partition by doc_id) as last from u) select doc_id, count(*) filter (where pos <= last) as kept, count(*) filter (where kind = 'body') as bodies, cast(sum(case when kind = 'body' and trim(text) <> '' then len(regexp_split_to_array(trim(text), ' +')) else 0 end) as bigint) as words, count(*) filter (where kind = 'body') >= 3 and sum(case when kind = 'body' and trim(text) <> '' then len(regexp_split_to_array(trim(text), ' +')) else 0 end) >= 300 as accepted from l group by doc_id")
def acceptance_guards(spark: SparkSession, d: str) -> DataFrame:
    """Trailing headings dropped, and whether a document has enough to be narrated."""
    u = units(spark, d).withColumn("last", F.max(F.when(F.col("kind") == "body", F.col("pos"))).over(Window.partitionBy("doc_id")))
    n = F.when((F.col("kind") == "body") & (F.trim("text") != ""), F.size(F.split(F.trim("text"), " +"))).otherwise(0)
    body = F.col("kind") == "body"
    return u.groupBy("doc_id").agg(F.count_if(F.col("pos") <= F.col("last")).alias("kept"), F.count_if(body).alias("bodies"), F.sum(n).alias("words")).withColumn("accepted", (F.col("bodies") >= 3) & (F.col("words") >= 300))


@query(f"with {_U} select doc_id, sha256(string_agg(text, chr(1) order by pos)) as sig, count(*) as n from u group by doc_id")
def content_signature(spark: SparkSession, d: str) -> DataFrame:
    """Order-sensitive signatures of documents."""
    g = units(spark, d).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "text"))).alias("us"), F.count("*").alias("n"))
    return g.select("doc_id", F.sha2(F.array_join(F.transform("us", lambda x: x["text"]), "\x01"), 256).alias("sig"), "n")


@query(f"with {_U}, s as (select doc_id, sha256(string_agg(text, chr(1) order by pos)) as sig from u group by doc_id), done as (select sig, 25 as upto from s where ascii(sig) % 2 = 0) select u.doc_id, u.pos from u join s using (doc_id) left join done using (sig) where u.pos >= coalesce(upto, 0)")
def resume_todo(spark: SparkSession, d: str) -> DataFrame:
    """Units still to do after a checkpoint keyed by signature: half of the signatures have 25 units done."""
    u = units(spark, d)
    sig = content_signature(spark, d).select("doc_id", "sig")
    done = sig.where(F.ascii("sig") % 2 == 0).select("sig", F.lit(25).alias("upto")).distinct()
    return u.join(sig, "doc_id").join(done, "sig", "left").where(F.col("pos") >= F.coalesce("upto", F.lit(0))).select("doc_id", "pos")


@query(f"with {_U} select doc_id, pos, case when text = '' then 0 else length(text) * 1600 end::bigint as samples from u")
def ordered_parallel_map(spark: SparkSession, d: str) -> DataFrame:
    """A stand-in voice over units in parallel; silent units keep their place."""
    from vellumine.operators.runners import run_voice

    return run_voice(units(spark, d).select("doc_id", "pos", "text"), "stub")
