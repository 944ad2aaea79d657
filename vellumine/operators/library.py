"""Library analytics: current entries, row-level security, usage, playlists, trees, throttles.

papers keeps every store of an entry; the current one has the largest ``written``. Unknown optional fields keep their
meaning: an absent ``billed`` is the operator's, an absent duration counts nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumine.session import cut, small

# Fixed values.
DONE, RESUME_FLOOR, RESUME_TOP, RECENT = 0.95, 30.0, 8, 5
STATUSES = ["reserving", "pending", "generating", "ready", "error", "blocked"]
ISSUE_KINDS = ["skip", "garbled", "order", "pronunciation", "other"]


def current(papers: DataFrame) -> DataFrame:
    """The latest store of every entry: a partial aggregation by id, no window over all stores."""
    cols = papers.columns
    return papers.groupBy("id").agg(F.max_by(F.struct(*cols), "written").alias("p")).select("p.*")


def visible(papers: DataFrame, viewer: Column, admin: Column) -> DataFrame:
    """Entries a viewer may see: own, shared, or all for administrators; never reserved ones."""
    return papers.where((F.coalesce("status", F.lit("")) != "reserving") & (admin | (F.col("owner") == viewer) | F.coalesce("shared", F.lit(False))))


def may_change(papers: DataFrame, viewer: Column, admin: Column) -> DataFrame:
    """Entries a viewer may change: sharing is not enough."""
    return papers.where(admin | (F.col("owner") == viewer))


def billed_by_operator() -> Column:
    """Whether an entry counts for its owner's quota."""
    return (F.col("status") == "ready") & (F.coalesce("billed", F.lit("operator")) == "operator")


def usage(users: DataFrame, papers: DataFrame) -> DataFrame:
    """Users with entries, ready hours, metered hours, cap and whether they are blocked."""
    ready = F.sum(F.when(F.col("status") == "ready", F.coalesce("duration", F.lit(0.0))).otherwise(0.0))
    metered = F.sum(F.when(billed_by_operator(), F.coalesce("duration", F.lit(0.0))).otherwise(0.0))
    per = papers.groupBy("owner").agg(F.count("*").alias("entries"), F.round(ready / 3600, 2).alias("hours"), F.round(metered / 3600, 4).alias("metered_hours"))
    j = users.select("name", F.try_element_at("quota", F.lit("operator_h")).alias("cap"), "self_hosting").join(per, F.col("name") == F.col("owner"), "left").drop("owner")
    j = j.fillna(0, ["entries"]).fillna(0.0, ["hours", "metered_hours"])
    blocked = ~F.coalesce("self_hosting", F.lit(False)) & F.col("cap").isNotNull() & (F.col("metered_hours") >= F.col("cap"))
    return j.withColumn("blocked", blocked)


def reader_state(papers: DataFrame, viewer: Column) -> DataFrame:
    """Entries with the viewer's own position: the owner's columns, or the viewer's entry in the maps."""
    own = F.col("owner") == viewer
    return papers.withColumn("my_resume", F.when(own, F.col("resume_t")).otherwise(F.try_element_at("resume_by", viewer))).withColumn("my_opened", F.when(own, F.col("last_opened")).otherwise(F.try_element_at("opened_by", viewer)))


def progress(members: DataFrame) -> DataFrame:
    """Playlists with their size and share heard (A14): (playlist, pos, duration, resume)."""
    heard = F.sum(F.least(F.col("resume"), F.col("duration")))
    return members.groupBy("playlist").agg(F.count("*").alias("n"), F.round(heard / F.coalesce(F.nullif(F.sum("duration"), F.lit(0.0)), F.lit(1.0)), 4).alias("progress"))


def next_unfinished(members: DataFrame, anchor: Column) -> DataFrame:
    """The first unfinished member at or after the anchor position, else the anchor."""
    done = F.col("resume") >= DONE * F.col("duration")
    m = members.withColumn("anchor", anchor)
    return m.groupBy("playlist", "anchor").agg(F.coalesce(F.min(F.when((F.col("pos") >= F.col("anchor")) & ~done, F.col("pos"))), F.first("anchor")).alias("next"))


def splice(slots: DataFrame, wanted: DataFrame) -> DataFrame:
    """A list in which only the visible slots are reordered (O05): slots (list, pos, item, mine), wanted (list, rank, item)."""
    w = Window.partitionBy("list").orderBy("pos")
    mine = slots.where("mine").withColumn("rank", F.row_number().over(w)).select("list", "pos", "rank")
    put = mine.join(wanted.withColumnRenamed("item", "new"), ["list", "rank"]).select("list", "pos", "new")
    return slots.join(put, ["list", "pos"], "left").select("list", "pos", F.coalesce("new", "item").alias("item"))


def throttled(hits: DataFrame, key: str, ts: str, seconds: int = 60, limit: int = 10) -> DataFrame:
    """Hits with the number of earlier hits less than ``seconds`` before them, and whether they are throttled.

    ts is in microseconds; the bound is strict, and rejected hits count.
    """
    w = Window.partitionBy(key).orderBy(ts).rangeBetween(-(seconds * 1_000_000 - 1), 0)
    same = Window.partitionBy(key, ts)
    before = F.count("*").over(w) - F.count("*").over(same)
    return hits.withColumn("before", before).withColumn("throttled", F.col("before") >= limit)


def sessions(events: DataFrame, key: str, ts: str, gap: str = "30 minutes") -> DataFrame:
    """Sessions closed by inactivity."""
    s = events.groupBy(key, F.session_window(ts, gap)).agg(F.count("*").alias("n"))
    return s.select(key, F.col("session_window.start").alias("began"), "n")


def paths(nodes: DataFrame) -> DataFrame:
    """Slashed paths of a tree (id, name, parent) of any size and depth; a missing parent ends the chain.

    Only folders that have something below them are chained, and every round doubles how far they reach up; one join then
    gives all nodes their paths. An id with several rows keeps its longest chains. A folder below itself is an error.
    """
    nodes = nodes.select("id", "name", "parent").where("id is not null")
    inner = nodes.join(nodes.select(F.col("parent").alias("id")).distinct(), "id", "left_semi")
    known = inner.select(F.col("id").alias("parent"), F.col("id").alias("up")).distinct()
    chain = cut(inner.join(known, "parent", "left").select("id", F.col("name").alias("path"), "up", F.lit(1).alias("n")))
    for _ in range(_doublings(chain.select("id", "up").distinct())):
        above = chain.select(F.col("id").alias("up"), F.col("path").alias("p"), F.col("up").alias("next"), F.col("n").alias("m"))
        longer = chain.where("up is not null").join(above, "up").select("id", F.concat("p", F.lit(" / "), "path").alias("path"), F.col("next").alias("up"), (F.col("n") + F.col("m")).alias("n"))
        chain = cut(chain.where("up is null").unionByName(longer))
    chain = small(chain.select(F.col("id").alias("parent"), F.col("path").alias("p"), F.col("n").alias("m")))
    path = F.when(F.col("m").isNull(), F.col("name")).otherwise(F.concat("p", F.lit(" / "), "name"))
    full = nodes.join(chain, "parent", "left").select("id", path.alias("path"), (F.coalesce("m", F.lit(0)) + 1).alias("depth"))
    several = cut(full.groupBy("id").agg(F.min("depth").alias("least"), F.max("depth").alias("far")).where("least < far").select("id", "far"))
    return full.join(small(several), "id", "left").where("far is null or depth = far").select("id", "path", "depth")


def _doublings(hops: DataFrame) -> int:
    """How often hops (id, up) must be joined with themselves until every chain has ended; an error if one never does."""
    hops = cut(hops)
    most, rounds = hops.select("id").distinct().count(), 0
    while not hops.where("up is not null").isEmpty():
        if 2**rounds > most:
            one = hops.where("up is not null").first().id
            raise ValueError(f"folder {one} stands below itself, or below a folder that does: it has no path")
        above = hops.select(F.col("id").alias("up"), F.col("up").alias("next"))
        longer = hops.where("up is not null").join(above, "up").select("id", F.col("next").alias("up"))
        hops, rounds = cut(hops.where("up is null").unionByName(longer).distinct()), rounds + 1
    return rounds


def emitted(rows: DataFrame, step: float = 0.02) -> DataFrame:
    """Progress reports that are sent: a step on from the last sent, the end, or another label.

    rows: (key, reports ARRAY<STRUCT<seq, frac, label>> in order); a fold whose state is the last sent report.
    """
    sent = "array<struct<seq:bigint,frac:double,label:string>>"
    zero = F.struct(F.array().cast(sent).alias("out"), F.lit(-1.0).alias("frac"), F.lit(None).cast("string").alias("label"))

    def one(a: Column, r: Column) -> Column:
        send = (r["frac"] - a["frac"] >= step) | (r["frac"] >= 1) | ~r["label"].eqNullSafe(a["label"])
        return F.when(send, F.struct(F.concat(a["out"], F.array(F.struct(r["seq"].alias("seq"), r["frac"].alias("frac"), r["label"].alias("label")))).alias("out"), r["frac"].alias("frac"), r["label"].alias("label"))).otherwise(a)

    return rows.select("key", F.explode(F.aggregate("reports", zero, one, lambda a: a["out"])).alias("r")).select("key", "r.seq", "r.frac", "r.label")
