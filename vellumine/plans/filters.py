"""Queries over filters of pages, blocks and names, ordered picks, unions, and entries that come, go and are looked up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumine.functions import clean as C
from vellumine.operators import library as L
from vellumine.operators.multivalue import explode_packed
from vellumine.plans.library import _CUR, papers
from vellumine.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}

# What a delivery cover sheet says, and how long it may be; words of journals and publishers; labels of figures;
# tokens below which a document has no text layer; how much smaller than the body small print is.
COVER_SHEET = r"(?i)thank you for using our service|interlibrary\s+(?:services|loan)|article\s+express|\billiad\b|notice\s+warning\s+concerning\s+copyright\s+restrictions"
COVER_LENGTH = 4000
PUBLISHER_WORDS = r"(?i)sciencedirect|elsevier|springer|ieee|acta|journal|proceedings|conference|universit"
FIGURE_LABEL = r"(?i)^(figure|fig\b|table)"
NO_TEXT_LAYER = 40
SMALL_PRINT = 1.1


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def units(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "units").select("doc_id", "pos", "kind", F.coalesce("text", F.lit("")).alias("text"), "t0", "t1").distinct()


_U = "u as (select distinct doc_id, pos, kind, coalesce(text, '') as text, t0, t1 from units)"
_SPACE = r"[\s\p{Z}\x0b\x1c-\x1f\x85]+"


@query(
    """with w as (select distinct doc_id, page, pos, x0, y0, y1, text from words where text is not null and text <> '' and y0 is not null and y1 is not null), s as (select *, round(y1 - y0, 1) as size from w),
    h as (select doc_id, page, size, sum(length(text)) as n from s group by all), b as (select doc_id, page, max({'n': n, 's': size}).s as body from h group by all)
    select doc_id, page, count(*) filter (where size < body - 1.1) as small, count(*) as total from s join b using (doc_id, page) group by doc_id, page"""
)
def small_print(spark: SparkSession, d: str) -> DataFrame:
    """Words of every page set smaller than its body (P02); the body's size is the one with most characters."""
    w = table(spark, d, "words").where("text is not null and text <> '' and y0 is not null and y1 is not null").select("doc_id", "page", "pos", "x0", "y0", "y1", "text").distinct()
    s = w.select("doc_id", "page", F.round(F.col("y1") - F.col("y0"), 1).alias("size"), F.length("text").alias("n"))
    sizes = s.groupBy("doc_id", "page", "size").agg(F.sum("n").alias("n"), F.count("*").alias("words"))
    body = sizes.groupBy("doc_id", "page").agg(F.max_by("size", F.struct("n", "size")).alias("body"))
    j = sizes.join(body, ["doc_id", "page"])
    return j.groupBy("doc_id", "page").agg(F.sum(F.when(F.col("size") < F.col("body") - SMALL_PRINT, F.col("words")).otherwise(0)).alias("small"), F.sum("words").alias("total"))


@query("with l as (select source, unnest(string_split(text, chr(10))) as line from documents where text is not null) select source, count(*) filter (where ltrim(line, ' ') like '©%') as dropped, count(*) as lines from l group by source")
def copyright_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines that begin with a copyright sign, by source."""
    line = table(spark, d, "documents").where("text is not null").select("source", F.explode(F.split("text", "\n")).alias("line"))
    return line.groupBy("source").agg(F.count_if(F.startswith(F.ltrim("line"), F.lit("©"))).alias("dropped"), F.count("*").alias("lines"))


@query(f"select doc_id, regexp_matches(text, '{COVER_SHEET}') and length(text) < {COVER_LENGTH} as cover from documents where text is not null")
def cover_sheets(spark: SparkSession, d: str) -> DataFrame:
    """Texts that are the cover sheet of a delivery: they say so and hold no real prose."""
    t = F.col("text")
    return table(spark, d, "documents").where("text is not null").select("doc_id", (t.rlike(COVER_SHEET) & (F.length(t) < COVER_LENGTH)).alias("cover"))


@query(f"with d as (select doc_id, trim(regexp_replace(text, '{_SPACE}', ' ', 'g'), ' ') as t from units where text is not null), n as (select doc_id, sum(case when t = '' then 0 else len(string_split(t, ' ')) end) as n from (select distinct doc_id, pos, t from (select doc_id, pos, trim(regexp_replace(text, '{_SPACE}', ' ', 'g'), ' ') as t from units where text is not null)) group by doc_id) select doc_id, n::bigint as tokens, n < {NO_TEXT_LAYER} as needs_ocr from n")
def needs_ocr(spark: SparkSession, d: str) -> DataFrame:
    """Documents with next to no text (P20)."""
    u = table(spark, d, "units").where("text is not null").select("doc_id", "pos", C.squeeze(F.col("text")).alias("t")).distinct()
    return u.groupBy("doc_id").agg(F.sum(C.word_count(F.col("t"))).alias("tokens")).withColumn("needs_ocr", F.col("tokens") < NO_TEXT_LAYER)


@query(f"with {_U} select doc_id, pos, text, regexp_matches(text, '[A-Za-z]{{3}}') and not regexp_matches(text, '{FIGURE_LABEL}') as sane from u where kind = 'heading'")
def sane_heads(spark: SparkSession, d: str) -> DataFrame:
    """Headings that hold a word and are no label of a figure or table."""
    h = units(spark, d).where("kind = 'heading'")
    return h.select("doc_id", "pos", "text", (F.col("text").rlike("[A-Za-z]{3}") & ~F.col("text").rlike(FIGURE_LABEL)).alias("sane"))


@query()
def author_junk(spark: SparkSession, d: str) -> DataFrame:
    """Authors of every run that are none: words of journals or publishers, or a word twice."""
    m = table(spark, d, "meta").select("doc_id", "run", "authors").where("authors is not null").distinct()
    a = explode_packed(m, "authors", "author", "pos")
    words = F.split(C.squeeze(F.col("author")), " ")
    return a.select("doc_id", "run", "pos", "author", (F.col("author").rlike(PUBLISHER_WORDS) | (F.size(F.array_distinct(words)) < F.size(words))).alias("junk"))


@query(f"with {_CUR}, v as (select * from cur where status <> 'reserving' and coalesce(shared, false)) select hash, arg_min(id, {{'a': coalesce(added, 0), 'i': id}}) as id, count(*) as copies from v where hash is not null group by hash")
def dedupe_visible(spark: SparkSession, d: str) -> DataFrame:
    """The entry an upload with a known hash leads to: the first of those any reader may see."""
    p = papers(spark, d).where("hash is not null and coalesce(shared, false) and coalesce(status, '') <> 'reserving'")
    return p.groupBy("hash").agg(F.min_by("id", F.struct(F.coalesce("added", F.lit(0.0)), "id")).alias("id"), F.count("*").alias("copies"))


@query(f"with {_CUR} select d.doc_id, d.paper_id, cur.title from (select distinct doc_id, paper_id from documents where section = 'reader note') d left join cur on d.paper_id = cur.id")
def notes_with_titles(spark: SparkSession, d: str) -> DataFrame:
    """Reader notes with the title of their paper, without one where it is gone."""
    n = table(spark, d, "documents").where("section = 'reader note'").select("doc_id", "paper_id").distinct()
    return n.join(papers(spark, d).select(F.col("id").alias("paper_id"), "title"), "paper_id", "left").select("doc_id", "paper_id", "title")


@query(f"with w as (select distinct doc_id, pos, text, words from units where words is not null and text is not null), t as (select doc_id, pos, words, string_split(trim(regexp_replace(text, '{_SPACE}', ' ', 'g'), ' '), ' ') as ts from w) select doc_id, pos, len(words) as timed, len(ts) as written, len(words) <> len(ts) as mismatch, (select count(*) from (select unnest(range(1, least(len(words), len(ts)) + 1)) as i) where words[i].w = ts[i]) as equal from t")
def positional_zip(spark: SparkSession, d: str) -> DataFrame:
    """Words with times beside the words of the text, by place; lists of different length are a mismatch."""
    w = table(spark, d, "units").where("words is not null and text is not null").select("doc_id", "pos", "text", "words").distinct()
    w = w.withColumn("ts", F.split(C.squeeze(F.col("text")), " "))
    same = F.size(F.filter(F.arrays_zip(F.col("words.w").alias("a"), F.col("ts").alias("b")), lambda x: x["a"] == x["b"]))
    return w.select("doc_id", "pos", F.size("words").cast("bigint").alias("timed"), F.size("ts").cast("bigint").alias("written"), (F.size("words") != F.size("ts")).alias("mismatch"), same.cast("bigint").alias("equal"))


@query("with gone as (select p_partkey from part where p_size = 1) select l_orderkey as playlist, count(*) as kept from lineitem where l_partkey not in (select p_partkey from gone) group by l_orderkey")
def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    """Playlists after entries are deleted: the deleted leave every list (J21); parts of size one are deleted."""
    gone = table(spark, d, "part").where("p_size = 1").select(F.col("p_partkey").alias("l_partkey"))
    return table(spark, d, "lineitem").join(gone, "l_partkey", "left_anti").groupBy(F.col("l_orderkey").alias("playlist")).agg(F.count("*").alias("kept"))


@query("with m as (select distinct doc_id, run, authors, year from meta) select doc_id, arg_min(authors, run) filter (where authors <> '') as authors, arg_min(year, run) filter (where year is not null) as year from m group by doc_id")
def first_nonempty(spark: SparkSession, d: str) -> DataFrame:
    """Authors and year of the first run that has any."""
    m = table(spark, d, "meta")
    return m.groupBy("doc_id").agg(F.min_by("authors", F.when(F.col("authors") != "", F.col("run"))).alias("authors"), F.min_by("year", F.when(F.col("year").isNotNull(), F.col("run"))).alias("year"))


@query("with e as (select id, written, unnest(map_entries(resume_by)) as e from papers where resume_by is not null) select id, e.key as reader, arg_max(e.value, written) as position from e where e.value >= 0 group by id, e.key")
def map_merge(spark: SparkSession, d: str) -> DataFrame:
    """Positions of every reader over all stores of an entry: the last write wins, impossible ones are skipped."""
    e = table(spark, d, "papers").where("resume_by is not null").select("id", "written", F.explode("resume_by").alias("reader", "position"))
    return e.where("position >= 0").groupBy("id", "reader").agg(F.max_by("position", "written").alias("position"))


@query(f"with {_U} select doc_id, arg_max(t1, pos) as duration, count(*) as units from u where t1 is not null group by doc_id")
def running_duration(spark: SparkSession, d: str) -> DataFrame:
    """The length of a narration: the end of its last unit."""
    return units(spark, d).where("t1 is not null").groupBy("doc_id").agg(F.max_by("t1", "pos").alias("duration"), F.count("*").alias("units"))


@query("select name from users where name is not null order by name")
def names_ascending(spark: SparkSession, d: str) -> DataFrame:
    """Names of users in order."""
    return table(spark, d, "users").where("name is not null").select("name").orderBy("name")


@query(f"with {_CUR} select id, title, year, added from cur where status = 'ready' order by year desc nulls last, lower(title) nulls last, id")
def shelf_sorted(spark: SparkSession, d: str) -> DataFrame:
    """Ready entries by year, newest first, then title (O06): a range-partitioned sort."""
    return sorted_shelf(papers(spark, d).where("status = 'ready'"), "year", True).select("id", "title", "year", "added")


def sorted_shelf(entries: DataFrame, by: str, flip: bool = False) -> DataFrame:
    """Entries by title, year or added, in either direction; those without a value come last, ties by title and id."""
    key = F.lower("title") if by == "title" else F.col(by)
    return entries.orderBy(key.desc_nulls_last() if flip else key.asc_nulls_last(), F.lower("title").asc_nulls_last(), "id")


@query(
    f"""with {_U}, t as (select doc_id, arg_min(title, run) as text from meta where title <> '' group by doc_id) select doc_id, 0 as part, -1 as pos, text from t union all
    select distinct paper_id, 1, doc_id::int, text from documents where section = 'abstract' and paper_id is not null and text is not null union all select doc_id, 2, pos, text from u where kind = 'body'"""
)
def union_of_parts(spark: SparkSession, d: str) -> DataFrame:
    """Title, abstracts and body units of every paper in one list."""
    title = table(spark, d, "meta").where("title <> ''").groupBy("doc_id").agg(F.min_by("title", "run").alias("text"))
    abstract = table(spark, d, "documents").where("section = 'abstract' and paper_id is not null and text is not null").select(F.col("paper_id").alias("doc_id"), F.lit(1).alias("part"), F.col("doc_id").cast("int").alias("pos"), "text").distinct()
    body = units(spark, d).where("kind = 'body'").select("doc_id", F.lit(2).alias("part"), "pos", "text")
    return title.select("doc_id", F.lit(0).alias("part"), F.lit(-1).alias("pos"), "text").unionByName(abstract).unionByName(body)


@query("select name, false as added from users union all select distinct owner, true from papers where owner is not null and owner not in (select name from users where name is not null)")
def insert_if_absent(spark: SparkSession, d: str) -> DataFrame:
    """Users with the owners that are none yet."""
    u = table(spark, d, "users").select("name", F.lit(False).alias("added"))
    new = table(spark, d, "papers").where("owner is not null").select(F.col("owner").alias("name")).distinct().join(u.select("name"), "name", "left_anti")
    return u.unionByName(new.select("name", F.lit(True).alias("added")))


@query(f"with {_CUR} select owner, count(*) filter (where coalesce(shared, false)) as shared, count(*) as mine from cur group by owner")
def may_change_counts(spark: SparkSession, d: str) -> DataFrame:
    """Entries every owner may change, and how many of them others may only see."""
    return L.may_change(papers(spark, d), F.col("owner"), F.lit(True)).groupBy("owner").agg(F.count_if(F.coalesce("shared", F.lit(False))).alias("shared"), F.count("*").alias("mine"))
