"""Queries over page layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumine.functions import folds
from vellumine.operators import layout as L
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


def words(spark: SparkSession, d: str) -> DataFrame:
    return L.page_words(table(spark, d, "words"))


_W = "w as (select distinct doc_id, page, x0, y0, x1, y1, text, pos from words where text is not null and text <> '' and x0 is not null and y0 is not null)"
_LINES = f"""{_W}, c as (select *, case when x0 >= 306 then 1 else 0 end as col from w),
 n as (select *, case when lag(col) over d = col and y0 - lag(y0) over d <= 5 then 0 else 1 end as brk from c window d as (partition by doc_id, page order by col, y0, x0, pos)),
 l as (select *, cast(sum(brk) over (partition by doc_id, page order by col, y0, x0, pos rows unbounded preceding) as int) as line from n),
 r0 as (select *, case when x0 - max(x1) over (partition by doc_id, page, line order by x0, pos rows between unbounded preceding and 1 preceding) <= {{gap}} then 0 else 1 end as opens from l),
 r as (select *, cast(sum(opens) over (partition by doc_id, page, line order by x0, pos rows unbounded preceding) as int) as run from r0)"""
_BLOCKS = _LINES.format(gap="60.0") + ", b as (select doc_id, page, line, run, line * 100 + run as id, round(min(x0), 2) as x0, round(min(y0), 2) as y0, round(max(x1), 2) as x1, round(max(y1), 2) as y1, count(*) as n from r group by doc_id, page, line, run)"
_SPAN = "(x1 - x0 > 0.55 * 612 or (x1 - x0 >= 0.30 * 612 and abs((x0 + x1) / 2 - 306.0) < 0.06 * 612))"
_GUTTERS = f""", sb as (select * from b where not {_SPAN}), ex as (select doc_id, page, greatest(0.0, y1 - y0) as h, unnest(range(greatest(0, least(239, trunc(x0 / 2.55)))::bigint, greatest(0, least(239, trunc(x1 / 2.55)))::bigint + 1)) as bin from sb),
 cv as (select doc_id, page, bin, sum(h) as h from ex group by all), pk as (select *, max(h) over (partition by doc_id, page) as peak from cv), fu as (select * from pk where h > 0.1 * peak),
 nx as (select *, lead(bin) over (partition by doc_id, page order by bin) as nb from fu), gt as (select doc_id, page, round((nb - (nb - bin - 1) / 2.0) * 2.55, 4) as gutter from nx where nb - bin - 1 >= 2)"""


def blocks(spark: SparkSession, d: str) -> DataFrame:
    return L.blocks_of(words(spark, d))


@query(f"with {_W} select doc_id, count(*) filter (where not (y1 < 0.07 * 792 or y0 > 0.92 * 792)) as body, count(*) filter (where not (y1 < 0.07 * 792 or y0 > 0.93 * 792)) as labelled_body, count(*) as total from w group by doc_id")
def margin_filter(spark: SparkSession, d: str) -> DataFrame:
    """Words outside the header and footer bands, by either rule."""
    y0, y1 = F.col("y0"), F.col("y1")
    return words(spark, d).groupBy("doc_id").agg(F.count_if(L.in_body_band(y0, y1)).alias("body"), F.count_if(L.in_body_band(y0, y1, bottom=L.MARGIN_BOTTOM_LABELLED)).alias("labelled_body"), F.count("*").alias("total"))


@query("with " + _LINES.format(gap="10.0") + " select doc_id, page, line, run, round(min(x0), 2) as x0, round(min(y0), 2) as y0, round(max(x1), 2) as x1, round(max(y1), 2) as y1, count(*) as n from r group by doc_id, page, line, run")
def x_runs(spark: SparkSession, d: str) -> DataFrame:
    """Rectangles of lines, cut where the gap exceeds ten points."""
    w = words(spark, d).withColumn("col", F.when(F.col("x0") >= 306, 1).otherwise(0))
    return L.bounding_boxes(L.x_runs(L.lines_of(w)), "doc_id", "page", "line", "run")


@query(f"with {_BLOCKS}{_GUTTERS} select doc_id, page, gutter from gt")
def column_gutters(spark: SparkSession, d: str) -> DataFrame:
    """Middles of the gutters of every page."""
    return L.gutters(blocks(spark, d))


@query(
    f"""with {_BLOCKS}{_GUTTERS}, gs as (select doc_id, page, list(gutter) as gs from gt group by all), sp as (select *, {_SPAN} as span from b), j as (select sp.*, gs from sp left join gs using (doc_id, page)),
    k as (select *, case when span then -1 else coalesce(len(list_filter(gs, lambda x: x <= x0)), 0) end as col, sum(span::int) over (partition by doc_id, page order by y0 range between unbounded preceding and current row) as band from j)
    select doc_id, page, id, span, col::int as col, band::bigint as band, row_number() over (partition by doc_id, page order by band, col, y0, x0, id)::int as place from k"""
)
def reading_order(spark: SparkSession, d: str) -> DataFrame:
    """Blocks in reading order, by bands and columns."""
    return L.reading_order(blocks(spark, d)).select("doc_id", "page", "id", "span", "col", "band", "place")


@query(
    f"""with {_BLOCKS}, cr as (select *, case when x0 < 286 and x1 > 326 then 1 else 0 end as crosses from b),
    g as (select *, 2 * sum(crosses) over (partition by doc_id, page order by y0, x0, id rows unbounded preceding) - crosses as grp, case when crosses = 0 and x0 >= 306 then 1 else 0 end as side from cr)
    select doc_id, page, id, row_number() over (partition by doc_id, page order by grp, side, y0, x0, id)::int as place from g"""
)
def two_column_order(spark: SparkSession, d: str) -> DataFrame:
    """Blocks in the older two-column order."""
    return L.two_column_order(blocks(spark, d)).select("doc_id", "page", "id", "place")


@query(
    f"""with {_BLOCKS} select w.doc_id, w.page, w.pos, w.text, min(b.id)::int as block from w join b on w.doc_id = b.doc_id and w.page = b.page
    and (w.x0 + w.x1) / 2 between b.x0 and b.x1 and (w.y0 + w.y1) / 2 between b.y0 and b.y1 group by all"""
)
def word_block_assign(spark: SparkSession, d: str) -> DataFrame:
    """Words with the first block that holds their middle."""
    return L.assign_words(words(spark, d), blocks(spark, d))


@query(f"with {_W}, h as (select doc_id, round(y1 - y0, 1) as size, sum(length(text)) as w, min(pos) as first from w group by all) select doc_id, max({{'w': w, 'f': -first, 's': size}}).s as size from h group by doc_id")
def weighted_mode_size(spark: SparkSession, d: str) -> DataFrame:
    """The height with most characters, by document; the first seen of equals."""
    w = words(spark, d).withColumn("size", F.round(F.col("y1") - F.col("y0"), 1))
    return L.weighted_mode(w, ["doc_id"], "size", F.length("text"), "pos")


@query(f"with {_W}, h as (select doc_id, page, list_sort(list(round(y1 - y0, 3))) as hs from w group by all) select doc_id, page, hs[len(hs) // 2 + 1] as height from h")
def upper_median_height(spark: SparkSession, d: str) -> DataFrame:
    """The upper median of word heights, by page."""
    return words(spark, d).groupBy("doc_id", "page").agg(L.upper_median(F.round(F.col("y1") - F.col("y0"), 3)).alias("height"))


@query(
    f"""with {_W}, h as (select doc_id, page, list_sort(list(round(y1 - y0, 3))) as hs from w group by all), m as (select doc_id, page, hs[len(hs) // 2 + 1] as height from h)
    select doc_id, page, count(*) filter (where round(y1 - y0, 3) >= 0.75 * height) as kept, count(*) as total from w join m using (doc_id, page) group by all"""
)
def superscript_strip(spark: SparkSession, d: str) -> DataFrame:
    """Words at least three quarters of the upper-median height, by page."""
    w = words(spark, d).withColumn("h", F.round(F.col("y1") - F.col("y0"), 3))
    m = w.groupBy("doc_id", "page").agg(L.upper_median(F.col("h")).alias("height"))
    return w.join(m, ["doc_id", "page"]).groupBy("doc_id", "page").agg(F.count_if(F.col("h") >= 0.75 * F.col("height")).alias("kept"), F.count("*").alias("total"))


@query()
def line_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Greedy lines by overlap."""
    return L.line_clusters(words(spark, d))


@query()
def band_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Bands of consecutive words."""
    return L.band_clusters(words(spark, d))


@query()
def layout_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of lines of one height and pitch."""
    w = words(spark, d).withColumn("col", F.lit(0))
    lines = L.bounding_boxes(L.lines_of(w), "doc_id", "page", "line")
    return L.layout_runs(lines)


@query()
def drop_cap_join(spark: SparkSession, d: str) -> DataFrame:
    """Words with drop caps joined."""
    w = words(spark, d).withColumn("col", F.when(F.col("x0") >= 306, 1).otherwise(0))
    return L.drop_caps(L.lines_of(w)).select("doc_id", "page", "pos", "text")


@query()
def dehyphenate_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of each page with divided words joined."""
    w = L.lines_of(words(spark, d).withColumn("col", F.when(F.col("x0") >= 306, 1).otherwise(0)))
    page = w.groupBy("doc_id", "page").agg(F.sort_array(F.collect_list(F.struct("line", "x0", "pos", "text"))).alias("ws"))
    return page.select("doc_id", "page", folds.dehyphenate_tokens(F.col("ws.text")).alias("tokens"))
