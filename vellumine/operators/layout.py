"""Page layout: bands, columns, reading order, line clusters, rectangles. One page is one group; pages are independent.

Word and block tables are (doc_id, page, x0, y0, x1, y1, text, pos). Rows with null boxes are left out, equal rows count once.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the layout rules.
MARGIN_TOP, MARGIN_BOTTOM, MARGIN_BOTTOM_LABELLED = 0.07, 0.92, 0.93
SPAN_WIDTH, CENTRED, CENTRED_WIDTH = 0.55, 0.06, 0.30
BINS, GUTTER, EMPTY = 240, 0.008, 0.10
X_GAP, DROP_CAP, OVERLAP, GAP_RATIO, SIZE_DELTA, HEIGHT_DELTA = 10.0, 1.6, 0.5, 1.6, 0.6, 0.25
PAGE_WIDTH, PAGE_HEIGHT = 612.0, 792.0


def page_words(words: DataFrame) -> DataFrame:
    """Distinct words with boxes, hash-partitioned by page so that every page operator after it needs no shuffle."""
    w = words.select("doc_id", "page", "x0", "y0", "x1", "y1", "text", "pos").where("text is not null and text <> '' and x0 is not null and y0 is not null")
    return w.repartition("doc_id", "page").dropDuplicates()


def in_body_band(y0: Column, y1: Column, height: float = PAGE_HEIGHT, bottom: float = MARGIN_BOTTOM) -> Column:
    """Whether a box is outside the running-header and footer bands."""
    return ~((y1 < MARGIN_TOP * height) | (y0 > bottom * height))


def lines_of(words: DataFrame, tolerance: float = 5.0) -> DataFrame:
    """Words with the number of their line in the page: words whose tops differ by less than the tolerance in a column."""
    page = Window.partitionBy("doc_id", "page")
    down = page.orderBy("col", "y0", "x0", "pos")
    same = (F.lag("col").over(down) == F.col("col")) & (F.col("y0") - F.lag("y0").over(down) <= tolerance)
    return words.withColumn("brk", F.when(same, 0).otherwise(1)).withColumn("line", F.sum("brk").over(down.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("brk")


def x_runs(words: DataFrame, gap: float = X_GAP) -> DataFrame:
    """Words of lines with the number of their run: a gap beyond the last right edge opens one."""
    line = Window.partitionBy("doc_id", "page", "line").orderBy("x0", "pos")
    before = F.max("x1").over(line.rowsBetween(Window.unboundedPreceding, -1))
    return words.withColumn("opens", F.when(F.col("x0") - before <= gap, 0).otherwise(1)).withColumn("run", F.sum("opens").over(line.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("opens")


def bounding_boxes(words: DataFrame, *keys: str) -> DataFrame:
    """Union of boxes by key, two decimals (A10)."""
    return words.groupBy(*keys).agg(F.round(F.min("x0"), 2).alias("x0"), F.round(F.min("y0"), 2).alias("y0"), F.round(F.max("x1"), 2).alias("x1"), F.round(F.max("y1"), 2).alias("y1"), F.count("*").alias("n"))


def blocks_of(words: DataFrame) -> DataFrame:
    """Blocks: x-runs of lines, as boxes with an id in the page."""
    split = words.withColumn("col", F.when(F.col("x0") >= 306, 1).otherwise(0))
    boxes = bounding_boxes(x_runs(lines_of(split), 60.0), "doc_id", "page", "line", "run")
    return boxes.withColumn("id", F.col("line") * 100 + F.col("run"))


def spans_columns(x0: Column, x1: Column, width: float = PAGE_WIDTH) -> Column:
    """Whether a block belongs to no single column."""
    return (x1 - x0 > SPAN_WIDTH * width) | ((x1 - x0 >= CENTRED_WIDTH * width) & (F.abs((x0 + x1) / 2 - width / 2) < CENTRED * width))


def gutters(blocks: DataFrame, width: float = PAGE_WIDTH) -> DataFrame:
    """(doc_id, page, gutter): middles of the nearly empty runs between columns.

    Blocks add their heights to the bins they touch; a run is empty below a tenth of the fullest bin and must be closed.
    """
    step = width / BINS
    b = blocks.where(~spans_columns(F.col("x0"), F.col("x1"), width))
    bin_ = lambda c: F.greatest(F.lit(0), F.least(F.lit(BINS - 1), (F.col(c) / step).cast("int")))
    cover = b.select("doc_id", "page", F.greatest(F.lit(0.0), F.col("y1") - F.col("y0")).alias("h"), F.explode(F.sequence(bin_("x0"), bin_("x1"))).alias("bin"))
    cover = cover.groupBy("doc_id", "page", "bin").agg(F.sum("h").alias("h"))
    page = Window.partitionBy("doc_id", "page")
    full = cover.withColumn("peak", F.max("h").over(page)).where(F.col("h") > EMPTY * F.col("peak"))
    nxt = F.lead("bin").over(page.orderBy("bin"))
    # Between two full bins lies a run of empty ones; margins have no full bin on one side.
    run = full.withColumn("next", nxt).withColumn("n", F.col("next") - F.col("bin") - 1)
    least = max(1, round(GUTTER * BINS))
    return run.where(F.col("n") >= least).select("doc_id", "page", F.round((F.col("next") - F.col("n") / 2) * step, 4).alias("gutter"))


def reading_order(blocks: DataFrame, width: float = PAGE_WIDTH) -> DataFrame:
    """Blocks with span, column, band and their place in reading order (W02): bands between spanning blocks, columns in bands."""
    g = gutters(blocks, width).groupBy("doc_id", "page").agg(F.sort_array(F.collect_list("gutter")).alias("gs"))
    b = blocks.join(g, ["doc_id", "page"], "left").withColumn("span", spans_columns(F.col("x0"), F.col("x1"), width))
    col = F.when(F.col("span"), -1).otherwise(F.coalesce(F.size(F.filter("gs", lambda x: x <= F.col("x0"))), F.lit(0)))
    down = Window.partitionBy("doc_id", "page").orderBy("y0").rangeBetween(Window.unboundedPreceding, 0)
    b = b.withColumn("col", F.when(F.col("gs").isNull() & ~F.col("span"), 0).otherwise(col)).withColumn("band", F.sum(F.col("span").cast("int")).over(down))
    order = Window.partitionBy("doc_id", "page").orderBy("band", "col", "y0", "x0", "id")
    return b.withColumn("place", F.row_number().over(order)).drop("gs")


def two_column_order(blocks: DataFrame, width: float = PAGE_WIDTH) -> DataFrame:
    """The older order: a block that crosses the middle closes left-then-right groups."""
    mid = width / 2
    crosses = ((F.col("x0") < mid - 20) & (F.col("x1") > mid + 20)).cast("int")
    down = Window.partitionBy("doc_id", "page").orderBy("y0", "x0", "id")
    b = blocks.withColumn("crosses", crosses).withColumn("grp", 2 * F.sum("crosses").over(down.rowsBetween(Window.unboundedPreceding, 0)) - F.col("crosses"))
    side = F.when((F.col("crosses") == 0) & (F.col("x0") >= mid), 1).otherwise(0)
    order = Window.partitionBy("doc_id", "page").orderBy("grp", "side", "y0", "x0", "id")
    return b.withColumn("side", side).withColumn("place", F.row_number().over(order))


def assign_words(words: DataFrame, blocks: DataFrame, bin_height: float = 36.0) -> DataFrame:
    """Words with the first block in order that holds their middle (J02): a range join on bins of y, re-checked."""
    cy, cx = (F.col("w.y0") + F.col("w.y1")) / 2, (F.col("w.x0") + F.col("w.x1")) / 2
    b = blocks.select("doc_id", "page", "id", F.col("x0").alias("bx0"), F.col("y0").alias("by0"), F.col("x1").alias("bx1"), F.col("y1").alias("by1"))
    b = b.withColumn("bin", F.explode(F.sequence(F.floor(F.col("by0") / bin_height), F.floor(F.col("by1") / bin_height))))
    w = words.alias("w").select("w.*", cx.alias("cx"), cy.alias("cy")).withColumn("bin", F.floor(F.col("cy") / bin_height))
    hit = w.join(b, ["doc_id", "page", "bin"]).where("cx between bx0 and bx1 and cy between by0 and by1")
    return hit.groupBy("doc_id", "page", "pos", "text").agg(F.min("id").alias("block"))


def weighted_mode(rows: DataFrame, keys: list[str], value: str, weight: Column, order: str) -> DataFrame:
    """The value with most weight by key, the first seen of equals."""
    by = rows.groupBy(*keys, value).agg(F.sum(weight).alias("w"), F.min(order).alias("first"))
    return by.groupBy(*keys).agg(F.max_by(value, F.struct("w", -F.col("first"))).alias(value))


def upper_median(c: Column) -> Column:
    """The upper median of a group, not interpolated (A08). The group must be bounded, as a page or block is."""
    a = F.sort_array(F.collect_list(c))
    return F.get(a, F.floor(F.size(a) / 2).cast("int"))


def drop_caps(words: DataFrame) -> DataFrame:
    """Words in order with drop caps joined to the word they begin."""
    page = Window.partitionBy("doc_id", "page").orderBy("line", "x0", "pos")
    h, nh = F.col("y1") - F.col("y0"), F.lead(F.col("y1") - F.col("y0")).over(page)
    nxt = F.lead("text").over(page)
    fragment = nxt.rlike(r"^\p{Ll}") | (nxt.rlike(r"^\p{Lu}$") & ~nxt.isin("A", "I"))
    takes = F.coalesce(F.col("text").rlike(r"^\p{Lu}$") & fragment & (nh > 0) & (h >= DROP_CAP * nh), F.lit(False))
    w = words.withColumn("nxt", nxt).withColumn("takes", takes).withColumn("taken", F.coalesce(F.lag(takes).over(page), F.lit(False)))
    # A taken word can't take: runs of candidates alternate.
    return w.where(~F.col("taken")).select("doc_id", "page", "pos", F.when(F.col("takes"), F.concat("text", "nxt")).otherwise(F.col("text")).alias("text"), "takes")


# ---------------------------------------------------------------- stateful folds, one page at a time


def _by_page(df: DataFrame, fold, schema: str) -> DataFrame:  # noqa: ANN001
    """Apply a Python fold to each page, in batches of sorted partitions rather than one call a page."""
    cols = [f.name for f in df.schema.fields]
    sorted_ = df.repartition("doc_id", "page").sortWithinPartitions("doc_id", "page", "y0", "x0", "pos")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: pd.DataFrame | None = None
        for b in batches:
            if rest is not None:
                b = pd.concat([rest, b], ignore_index=True)
            if not len(b):
                continue
            last = (b["doc_id"] == b["doc_id"].iloc[-1]) & (b["page"] == b["page"].iloc[-1])
            rest = b[last]
            yield from _fold_groups(b[~last], fold)
        if rest is not None and len(rest):
            yield from _fold_groups(rest, fold)

    return sorted_.select(*cols).mapInPandas(run, schema)


def _fold_groups(b: pd.DataFrame, fold) -> Iterator[pd.DataFrame]:  # noqa: ANN001
    if len(b):
        out = [fold(g) for _, g in b.groupby(["doc_id", "page"], sort=False)]
        yield pd.concat(out, ignore_index=True)


def _clusters(g: pd.DataFrame) -> pd.DataFrame:
    lines: list[list[float]] = []
    at = []
    for y0, y1 in zip(g["y0"], g["y1"]):
        for k, (a, b) in enumerate(lines):
            if min(y1, b) - max(y0, a) > OVERLAP * min(y1 - y0, b - a):
                lines[k] = [min(a, y0), max(b, y1)]
                at.append(k)
                break
        else:
            lines.append([y0, y1])
            at.append(len(lines) - 1)
    order = {k: i for i, k in enumerate(sorted(range(len(lines)), key=lambda k: (lines[k][0], k)))}
    return pd.DataFrame({"doc_id": g["doc_id"], "page": g["page"], "pos": g["pos"], "line": [order[k] for k in at]})


def line_clusters(words: DataFrame) -> DataFrame:
    """Greedy lines by overlap of heights: a word joins the first line it overlaps, which grows."""
    return _by_page(words.select("doc_id", "page", "x0", "y0", "x1", "y1", "pos"), _clusters, "doc_id string, page int, pos int, line int")


def _bands(g: pd.DataFrame) -> pd.DataFrame:
    out, band, k = [], None, -1
    for x0, y0, x1, y1 in zip(g["x0"], g["y0"], g["x1"], g["y1"]):
        if band and abs(y0 - band[1]) <= 0.5 * ((y1 - y0) + (band[3] - band[1])) / 2:
            band = [min(band[0], x0), min(band[1], y0), max(band[2], x1), max(band[3], y1)]
        else:
            band, k = [x0, y0, x1, y1], k + 1
        out.append(k)
    return pd.DataFrame({"doc_id": g["doc_id"], "page": g["page"], "pos": g["pos"], "band": out})


def band_clusters(words: DataFrame) -> DataFrame:
    """Consecutive words in bands, compared with the band as it has grown."""
    return _by_page(words.select("doc_id", "page", "x0", "y0", "x1", "y1", "pos"), _bands, "doc_id string, page int, pos int, band int")


class _Run(NamedTuple):
    """The open run: its number, the last line's top and height, and the pitch its first two lines have set."""

    number: int
    top: float
    height: float
    pitch: float | None

    def take(self, line: tuple[float, float]) -> _Run:
        """The run a line belongs to: a new one where its height or its distance does not fit."""
        top, height = line
        apart = top - self.top
        other_type = abs(height - self.height) > HEIGHT_DELTA * max(self.height, 1e-9)
        if other_type or self.pitch is not None and apart > GAP_RATIO * self.pitch:
            return _Run(self.number + 1, top, height, None)
        return _Run(self.number, top, height, apart if self.pitch is None and apart > 0.5 else self.pitch)


def _runs(g: pd.DataFrame) -> pd.DataFrame:
    lines = list(zip(g["y0"], g["h"]))
    states = accumulate(lines[1:], _Run.take, initial=_Run(0, *lines[0], None))
    return pd.DataFrame({"doc_id": g["doc_id"], "page": g["page"], "pos": g["pos"], "run": [s.number for s in states]})


def layout_runs(lines: DataFrame) -> DataFrame:
    """Runs of lines of one height and pitch (W09, the form for scanned pages). lines: (doc_id, page, y0, y1, x0, line)."""
    rows = lines.select("doc_id", "page", "x0", "y0", (F.col("y1") - F.col("y0")).alias("h"), F.col("line").alias("pos"))
    return _by_page(rows, _runs, "doc_id string, page int, pos int, run int").withColumnRenamed("pos", "line")
