"""Operators of the core on small fixtures."""

import pytest
from pyspark.sql import functions as F

from vellumine.operators import layout as L
from vellumine.operators import library as B
from vellumine.operators import narration as N
from vellumine.operators.multivalue import explode_packed, split_packed


def order(spark, blocks, width=612.0):
    rows = [("d", 0, i, float(x0), float(y), float(x1), float(y + 20)) for i, x0, y, x1 in blocks]
    df = spark.createDataFrame(rows, "doc_id string, page int, id int, x0 double, y0 double, x1 double, y1 double")
    return [r.id for r in L.reading_order(df, width).orderBy("place").collect()]


def b(*rows):
    return [(i, x, y, x + 250) for i, x, y in rows]


def test_reading_order(spark):
    assert order(spark, b((0, 60, 100), (1, 320, 100), (2, 60, 300), (3, 320, 300))) == [0, 2, 1, 3]
    assert order(spark, b((0, 70, 500), (1, 72, 100), (2, 71, 300))) == [1, 2, 0]
    assert order(spark, [(0, 40, 100, 220), (1, 240, 100, 420), (2, 440, 100, 600)]) == [0, 1, 2]
    assert order(spark, [(11, 161, 75, 450), (12, 190, 93, 422), (0, 54, 166, 290), (5, 302, 165, 545)]) == [11, 12, 0, 5]
    assert order(spark, [(0, 54, 100, 290), (1, 302, 100, 545), (9, 54, 300, 545), (2, 54, 400, 290), (3, 302, 400, 545)]) == [0, 1, 9, 2, 3]
    six = [(1, 104, 61, 232), (2, 43, 79, 260), (3, 407, 51, 445), (4, 305, 61, 332), (5, 305, 90, 555), (6, 305, 120, 555)]
    assert order(spark, six, 595.0) == [1, 2, 3, 4, 5, 6]


def words(spark, rows):
    return spark.createDataFrame([("d", 0, *map(float, r[:4]), r[4], i) for i, r in enumerate(rows)], "doc_id string, page int, x0 double, y0 double, x1 double, y1 double, text string, pos int")


def test_bands_and_runs(spark):
    got = [r.band for r in L.band_clusters(words(spark, [(10, 100, 30, 112, "a"), (32, 100, 50, 112, "b"), (10, 130, 40, 142, "c")])).orderBy("pos").collect()]
    assert got == [0, 0, 1]
    line = [(10 + 6 * i, 100, 15 + 6 * i, 110, "x") for i in range(5)] + [(200 + 6 * i, 100, 205 + 6 * i, 110, "x") for i in range(5)]
    w = words(spark, line).withColumn("line", F.lit(0))
    assert {r.x0 for r in L.bounding_boxes(L.x_runs(w), "run").collect()} == {10.0, 200.0}


def test_line_clusters(spark):
    got = L.line_clusters(words(spark, [(200, 100, 220, 110, "third"), (50, 101, 70, 111, "first"), (120, 99, 140, 109, "second"), (10, 130, 20, 140, "next")])).orderBy("pos").collect()
    assert [r.line for r in got] == [0, 0, 0, 1]


def test_drop_caps(spark):
    w = words(spark, [(10, 100, 20, 128, "R"), (22, 100, 60, 110, "econstruction"), (62, 100, 70, 110, "of")]).withColumn("line", F.lit(0))
    assert [r.text for r in L.drop_caps(w).orderBy("pos").collect()] == ["Reconstruction", "of"]
    w = words(spark, [(10, 100, 20, 110, "A"), (22, 100, 60, 110, "common"), (62, 100, 70, 110, "approach")]).withColumn("line", F.lit(0))
    assert [r.text for r in L.drop_caps(w).orderBy("pos").collect()] == ["A", "common", "approach"]


def test_as_of(spark):
    left = spark.createDataFrame([("d", 12.5), ("d", -1.0), ("e", 3.0)], "k string, t double")
    right = spark.createDataFrame([("d", 0.0, "modulus"), ("d", 10.0, "Poisson"), ("d", 12.0, None)], "k string, t0 double, text string")
    got = {(r.k, r.t): r.heard for r in N.as_of(left, right, "k", "t", "t0", {"heard": F.col("text")}).collect()}
    assert got == {("d", 12.5): "Poisson", ("d", -1.0): None, ("e", 3.0): None}


def test_metering(spark):
    papers = spark.createDataFrame(
        [("bob", "ready", 3600.0, "operator"), ("bob", "ready", 3600.0, "self"), ("bob", "pending", 1800.0, "operator"), ("carol", "ready", 10800.0, None)], "owner string, status string, duration double, billed string"
    )
    users = spark.createDataFrame([("bob", {"operator_h": 3.0}, False), ("carol", {"operator_h": 3.0}, False), ("dan", None, None)], "name string, quota map<string,double>, self_hosting boolean")
    got = {r.name: (r.metered_hours, r.blocked) for r in B.usage(users, papers).collect()}
    assert got == {"bob": (1.0, False), "carol": (3.0, True), "dan": (0.0, False)}


def test_playlists(spark):
    m = spark.createDataFrame([("l", 1, 1000.0, 1000.0), ("l", 2, 1000.0, 980.0), ("l", 3, 1000.0, 0.0)], "playlist string, pos int, duration double, resume double")
    assert B.progress(m).first().progress == 0.66
    assert B.next_unfinished(m, F.lit(2)).first().next == 3


def test_security(spark):
    p = spark.createDataFrame([("a", "alice", "ready", False), ("b", "alice", "ready", True), ("c", "mallory", "ready", None), ("d", "mallory", "reserving", False)], "id string, owner string, status string, shared boolean")
    assert {r.id for r in B.visible(p, F.lit("mallory"), F.lit(False)).collect()} == {"b", "c"}
    assert {r.id for r in B.may_change(p, F.lit("mallory"), F.lit(False)).collect()} == {"c", "d"}


def test_emitted(spark):
    rows = spark.createDataFrame([("k", [(1, 0.0, "a"), (2, 0.01, "a"), (3, 0.02, "a"), (4, 0.03, "b"), (5, 1.0, "b")])], "key string, reports array<struct<seq:bigint,frac:double,label:string>>")
    assert [r.seq for r in B.emitted(rows).orderBy("seq").collect()] == [1, 3, 4, 5]


@pytest.mark.parametrize(
    "field, want",
    [
        (None, []), ("", []), (" ; , ", []), ("A. One", ["A. One"]), ("A One, B Two and C Three", ["A One", "B Two", "C Three"]), ("One, A. and Two, Bea C.", ["One, A.", "Two, Bea C."]),
        ("One AB, Two C", ["One AB", "Two C"]), ('"One, A.","Two, ""Bea"" B."', ["One, A.", 'Two, "Bea" B.']), ('["A One", "B Two"]', ["A One", "B Two"]), ("A One1,2 · B Two2", ["A One", "B Two"]),
        ("A One†, B Two∗", ["A One", "B Two"]), ("A One | | B Two", ["A One", "B Two"]), ("A One, Jr., B Two", ["A One, Jr.", "B Two"]), ("One, A., Two, B. C., & Three, D.", ["One, A.", "Two, B. C.", "Three, D."]),
        ("X Working Group on Bone and Joint Loading; A One", ["X Working Group on Bone and Joint Loading", "A One"]), ("A One、B Two", ["A One", "B Two"]), ("A One\r\nB Two", ["A One", "B Two"]), ('"Unclosed, A. and B Two', ['"Unclosed, A.', "B Two"]),
    ],
)
def test_packed(spark, field, want):
    assert spark.createDataFrame([(field,)], "a string").select(split_packed(F.col("a")).alias("v")).first().v == want


def test_packed_rows(spark):
    df = spark.createDataFrame([("d", 1, "A One; B Two", 7), ("d", 1, "A One; B Two", 7), ("e", 1, None, 8)], "doc_id string, run int, authors string, pos int")
    got = explode_packed(df, "authors", "author", "pos", at_least=2).collect()
    assert sorted((r.author, r.pos) for r in got) == [("A One", 1), ("A One", 1), ("B Two", 2), ("B Two", 2)]
    assert explode_packed(df.limit(0), "authors").count() == 0
    long = spark.createDataFrame([("; ".join(["Ada Name"] * 3000),)], "authors string")
    assert explode_packed(long, "authors").count() == 3000


def test_window_packing_against_brute_force(spark, tmp_path):
    import random
    import re

    from vellumine.plans import narration

    rng = random.Random(4)
    pick = ["One short sentence of about forty characters.", "Short first. " + "w" * 700 + ". Short last.", "no end " * 60, "", "Tab\tand\nline.  Two spaces! Then more?", None, "x" * 140 + ". " + "y" * 160]
    texts = {doc: [rng.choice(pick) for _ in range(n)] for doc, n in (("a", 1), ("b", 70), ("c", 71), ("d", 300))}
    rows = [(doc, i, "body", t) for doc, ts in texts.items() for i, t in enumerate(ts)]
    df = spark.createDataFrame(rows + rows[:50], "doc_id string, pos int, kind string, text string")
    more = "null as rects, false as para_end, 0D as pause, 0D as t0, 0D as t1".split(", ")
    df.selectExpr("*", *more).withColumn("rects", F.lit(None).cast("array<int>")).write.parquet(f"{tmp_path}/units.parquet")
    want = {}
    for doc, ts in texts.items():
        win = size = n = 0
        for i, t in enumerate(ts):
            parts = re.split(r"(?<=[.!?])\s+", " ".join((t or "").split()))
            est = len(parts[0][:150]) + len(parts[-1][:150]) + 60
            if n and (size + est > 15000 or n >= 70):
                win, size, n = win + 1, 0, 0
            want[doc, i] = win
            size, n = size + est, n + 1
    assert {(r.doc_id, r.pos): r.win for r in narration.window_packing(spark, str(tmp_path)).collect()} == want


def test_contained_banners_against_brute_force(spark):
    import random

    from vellumine.plans import text

    rng = random.Random(12)
    heads = ["Results", "3 RESULTS", "Journal of Tests", "of tests", "ration analysis", "short", "", "Übersicht der Größen", "x" * 45, "y" * 46, "𝑎𝑏𝑐𝑑𝑒𝑓"]
    bodies = ["journal of tests 12 (1999)", "The integration analysis held.", "Results", "no banner here", "die übersicht der größen steht", "x" * 60, "y" * 60, "see 𝑎𝑏𝑐𝑑𝑒𝑓 there", None, "tiny"]
    rows = [(f"d{rng.randint(0, 9)}", i, *((("heading", rng.choice(heads)) if rng.random() < 0.5 else ("body", rng.choice(bodies))))) for i in range(60)]
    rows += [("a", 0, "heading", h) for h in heads] + [("b", 0, "body", x) for x in bodies] + [("c", 0, None, "only Results")]
    banners = {t.lower() for _, _, k, t in rows if k == "heading" and 6 <= len(t) <= 45}
    want = {}
    for b in banners:
        docs = {d for d, _, k, t in rows if t and b in t.lower() and not (k == "heading" and t.lower() == b)}
        if docs:
            want[b] = len(docs)
    df = spark.createDataFrame(rows, "doc_id string, pos int, kind string, text string").where("text is not null")
    assert {r.banner: r.docs for r in text.contained(df).collect()} == want
    assert want["ration analysis"] and want["of tests"] and text.contained(df.limit(0)).count() == 0


def test_contained_banners_shuffle_no_text(spark, duck):
    from vellumine.plans import text

    rows = [("a", "heading", "Results"), ("b", "body", "our results, RESULTS and results of tests"), (None, "body", "the results"), (None, "heading", "of tests"), ("c", "heading", "Results of tests"), ("c", "heading", "Results of tests"), ("d", None, "results")]
    df = spark.createDataFrame([(d, i, k, t) for i, (d, k, t) in enumerate(rows)], "doc_id string, pos int, kind string, text string")
    duck.execute("create or replace temp table units as select * from (values " + ", ".join("(" + ", ".join("null" if v is None else f"'{v}'" for v in (d, k, t)) + f", {i})" for i, (d, k, t) in enumerate(rows)) + ") v(doc_id, kind, text, pos)")
    try:
        want = set(duck.execute(text.SQL["banner_semi_join"]).fetchall())
    finally:
        duck.execute("drop table temp.units")
    for at_once in (1, 2, 100):
        got = text.contained(df, at_once=at_once)
        assert {tuple(r) for r in got.collect()} == want == {("results", 3), ("of tests", 2), ("results of tests", 1)}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan


def test_contained_banner_of_rows_without_document(spark):
    from vellumine.plans import text

    df = spark.createDataFrame([("a", "heading", "Results"), ("b", "body", "results."), (None, "body", "the results")], "doc_id string, kind string, text string")
    assert [tuple(r) for r in text.contained(df).collect()] == [("results", 1)]


def test_paths_of_deep_and_large_trees(spark):
    deep = spark.range(1, 151).select(F.concat(F.lit("d"), "id").alias("id"), F.concat(F.lit("D"), "id").alias("name"), F.concat(F.lit("d"), F.col("id") - 1).alias("parent"))
    got = {r.id: (r.path, r.depth) for r in B.paths(deep).collect()}
    assert got == {f"d{i}": (" / ".join(f"D{k}" for k in range(1, i + 1)), i) for i in range(1, 151)}
    top = spark.createDataFrame([("r", "R", None), ("n", "N", "r")], "id string, name string, parent string")
    wide = top.unionByName(spark.range(400_000).select(F.concat(F.lit("c"), "id").alias("id"), F.col("id").cast("string").alias("name"), F.lit("n").alias("parent")))
    rows = B.paths(wide)
    assert rows.where("path = concat('R / N / ', substring(id, 2)) and depth = 3").count() == 400_000 and rows.count() == 400_002


def test_paths_of_odd_trees(spark, duck):
    rows = [("a", "A", None), ("b", "B", "a"), ("b", "B2", "gone"), ("c", "C", "b"), ("d", None, "c"), ("e", "E", "d"), ("f", "F", "gone"), ("g", "G", "f"), ("g", "G", "f"), (None, "N", "a"), ("h", "H", None), ("h", "H2", None), ("i", "I", "h")]
    nodes = spark.createDataFrame(rows, "id string, name string, parent string")
    t = "t(id, name, parent) as (values " + ", ".join("(" + ", ".join("null" if v is None else f"'{v}'" for v in r) + ")" for r in rows) + ")"
    want = duck.execute(f"with recursive {t}, up as (select id, name as path, parent, 1 as depth from t union all select u.id, t.name || ' / ' || u.path, t.parent, u.depth + 1 from up u join t on u.parent = t.id), far as (select id, max(depth) as depth from up group by id) select up.id, up.path, up.depth from up join far using (id, depth)").fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in B.paths(nodes).collect())
    assert B.paths(nodes.limit(0)).count() == 0
    with pytest.raises(ValueError, match="below itself"):
        B.paths(spark.createDataFrame([("a", "A", "b"), ("b", "B", "a"), ("c", "C", "b")], "id string, name string, parent string"))


def test_hard_texts_are_not_left_out(spark, tmp_path):
    from vellumine.functions import spoken
    from vellumine.plans import text

    texts = ["FEA of NiTi", "an ROI in vitro, HMMs", "Poissons and Poisson", "a ‹b› c", "a < b > c & d &lt; e", "<ref>kept</ref> &amp;", "plain"]
    df = spark.createDataFrame([(i, t, "en", "s", None) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, section string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    said = {r.doc_id: r.said for r in text.respell_terms(spark, str(tmp_path)).collect()}
    assert said == {i: spoken._TERM.sub(lambda m: spoken.RESPELLED[m.group()], t + " FEA of NiTi in Abaqus") for i, t in enumerate(texts)}
    assert {r.doc_id: r.body for r in text.markup_text_extract(spark, str(tmp_path)).collect()} == dict(enumerate(texts))
    from vellumine.plans import sources

    assert {r.doc_id: r.text for r in sources.tei_like_units(spark, str(tmp_path)).where("kind = 'body'").collect()} == dict(enumerate(texts))
