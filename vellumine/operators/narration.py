"""Narration over ordered units: timelines, pauses, paragraphs, positions in time and space.

Units are (doc_id, pos, kind, text, rects, para_end, pause, t0, t1, words). Order is data: every window sorts by pos, which
is unique in a document. A document is one window group; groups of any length stream through the window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Sampling rate, characters a second of the stand-in voice, pauses by path and kind.
RATE = 24000
SAMPLES_PER_CHAR = 1600
PAUSES = {"labelled": {"heading": 0.7, "para": 0.5, "body": 0.25, "equation": 1.6}, "plain": {"heading": 0.7, "para": 0.35, "body": 0.08, "equation": 1.6}}


def in_order(*keys: str):  # noqa: ANN201
    """The window of a document's units in order."""
    return Window.partitionBy("doc_id").orderBy(*(keys or ("pos",)))


def with_pauses(units: DataFrame, path: str = "labelled") -> DataFrame:
    """Units with para_last (the next is a heading or none, or the unit ends a paragraph) and the pause after them."""
    p = PAUSES[path]
    last = F.coalesce(F.col("para_end"), F.lit(False)) | F.lead("kind").over(in_order()).isNull()
    pause = F.when(F.col("kind") == "heading", p["heading"]).when(F.col("kind") == "equation", p["equation"]).when(F.col("para_last"), p["para"]).otherwise(p["body"])
    return units.withColumn("para_last", last).withColumn("pause_s", pause)


def timeline(units: DataFrame, samples: Column, pause: Column) -> DataFrame:
    """Units with start and end in seconds: sound, then the pause in whole samples."""
    u = units.withColumn("n", samples.cast("bigint")).withColumn("rest", F.floor(pause * RATE).cast("bigint"))
    before = F.coalesce(F.sum(F.col("n") + F.col("rest")).over(in_order().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return u.withColumn("start_s", F.round(before / RATE, 3)).withColumn("end_s", F.round((before + F.col("n")) / RATE, 3))


def sections(units: DataFrame) -> DataFrame:
    """Headings with their extent in time: to the next heading, the last to the end."""
    end = units.groupBy("doc_id").agg(F.max("t1").alias("duration"))
    h = units.where("kind = 'heading'").join(end, "doc_id")
    return h.select("doc_id", "pos", "text", F.col("t0").alias("from_s"), F.coalesce(F.lead("t0").over(in_order()), F.col("duration")).alias("to_s"))


def as_of(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, carry: dict[str, Column]) -> DataFrame:
    """Each left row with the latest right row at or before its time, by key (J03): a merged running last, one sort by key.

    carry maps output names to columns of ``right``; nulls are skipped, so an empty value falls back to an earlier one.
    """
    names = list(carry)
    r = right.select(F.col(key), F.col(right_time).alias("__t"), F.lit(0).alias("__side"), *[carry[n].alias(n) for n in names])
    others = [c for c in left.columns if c not in names]
    l_ = left.select(F.col(key), F.col(left_time).alias("__t"), F.lit(1).alias("__side"), *[F.lit(None).cast(right.select(carry[n].alias(n)).schema[0].dataType).alias(n) for n in names], F.struct(*[F.col(c) for c in others]).alias("__row"))
    both = r.withColumn("__row", F.lit(None).cast(l_.schema["__row"].dataType)).unionByName(l_)
    w = Window.partitionBy(key).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    run = both.select("*", *[F.last(n, ignorenulls=True).over(w).alias(f"__{n}") for n in names]).where("__side = 1")
    return run.select("__row.*", *[F.col(f"__{n}").alias(n) for n in names])


def paragraphs(units: DataFrame) -> DataFrame:
    """Text grouped into paragraphs, headings marked by ## (K11): a heading or a paragraph's end closes a group."""
    closes = (F.col("kind") == "heading") | F.coalesce(F.col("para_end"), F.lit(False))
    opens = F.coalesce(F.lag(closes).over(in_order()) | (F.col("kind") == "heading"), F.lit(True))
    u = units.withColumn("grp", F.sum(F.when(opens, 1).otherwise(0)).over(in_order()))
    line = F.when(F.col("kind") == "heading", F.concat(F.lit("## "), F.col("text"))).otherwise(F.col("text"))
    g = u.where("text is not null and text <> ''").withColumn("line", line).groupBy("doc_id", "grp").agg(F.sort_array(F.collect_list(F.struct("pos", "line"))).alias("ls"))
    return g.select("doc_id", "grp", F.array_join(F.transform("ls", lambda x: x["line"]), " ").alias("paragraph"))


def continuations(rows: DataFrame) -> DataFrame:
    """Body rows merged with the one before that does not end a sentence (W01): islands of a running flag.

    White space and then closing signs at the end say nothing of it. Parts stand on lines of their own; blank parts before the
    last leave no line.
    """
    bare = F.regexp_replace(F.regexp_replace("text", r"(?U)\s+$", ""), "[\"”’)»]+$", "")
    open_ = ~bare.rlike(r"[.!?]$")
    joins = F.coalesce((F.col("kind") == "body") & (F.lag("kind").over(in_order()) == "body") & F.lag(open_).over(in_order()), F.lit(False))
    g = rows.withColumn("grp", F.sum(F.when(joins, 0).otherwise(1)).over(in_order()))
    merged = g.groupBy("doc_id", "grp").agg(F.sort_array(F.collect_list(F.struct("pos", "text"))).alias("ts"), F.min("kind").alias("kind"), F.count("*").alias("rows"))
    before = F.filter(F.transform(F.slice("ts", F.lit(1), F.size("ts") - 1), lambda x: F.regexp_replace(x["text"], r"(?U)\s+$", "")), lambda x: x != "")
    head = F.regexp_replace(F.array_join(before, "\n"), r"(?U)^\s+", "")
    text = F.when(F.size("ts") == 1, F.get("ts", F.lit(0))["text"]).otherwise(F.concat(head, F.lit("\n"), F.element_at("ts", -1)["text"]))
    return merged.select("doc_id", "grp", "kind", "rows", text.alias("text"))


def preview(units: DataFrame, titles: DataFrame, enough: int = 320, most: int = 360) -> DataFrame:
    """The first texts of a document until enough characters, cut at most (P25, W23). titles: (doc_id, title)."""
    key = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")
    t = titles.groupBy("doc_id").agg(F.max("title").alias("title"))
    u = units.where("kind = 'body' and length(text) > 12").join(t, "doc_id", "left")
    same = F.contains(key("title"), key("text")) | F.contains(key("text"), key("title"))
    u = u.where(F.col("title").isNull() | (key("title") == "") | (key("text") == "") | ~same)
    before = F.coalesce(F.sum(F.length("text")).over(in_order().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    some = u.withColumn("before", before).where(F.col("before") <= enough)
    g = some.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "text"))).alias("ts"))
    return g.select("doc_id", F.substring(F.array_join(F.transform("ts", lambda x: x["text"]), " "), 1, most).alias("preview"))


def nearest_rect(points: DataFrame, rects: DataFrame) -> DataFrame:
    """Each point with the unit whose rectangle holds it, the last of several, else the nearest one.

    Distance is three times the vertical one plus the horizontal one, plus 500 where the point lies below. Both sides meet
    by document and page: points (doc_id, page, id, x, y), rects (doc_id, page, pos, k, x0, y0, x1, y1).
    """
    j = points.join(rects, ["doc_id", "page"])
    dx = F.greatest(F.col("x0") - F.col("x"), F.col("x") - F.col("x1"), F.lit(0.0))
    dy = F.greatest(F.col("y0") - F.col("y"), F.col("y") - F.col("y1"), F.lit(0.0))
    inside = (dx == 0) & (dy == 0)
    score = F.round(3 * dy + dx + F.when(F.col("y") > F.col("y1"), 500).otherwise(0), 4)
    best = j.groupBy("doc_id", "page", "id").agg(F.max(F.when(inside, F.struct("pos", "k"))).alias("held"), F.min_by("pos", F.struct(score, "pos", "k")).alias("near"))
    return best.select("doc_id", "page", "id", F.coalesce(F.col("held.pos"), F.col("near")).alias("pos"))
