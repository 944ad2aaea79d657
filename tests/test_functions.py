"""Literal pairs for the text functions and folds."""

import pytest
from pyspark.sql import functions as F

from vellumine.functions import clean as C
from vellumine.functions import folds
from vellumine.functions.spoken import spoken


def one(spark, f, text):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize(
    "text, want",
    [
        ("The person-\nalized implant [3, 5–7] works  well.", "The personalized implant works well."),
        ("fact [12] here", "fact here"),
        ("5–9", "5 to 9"),
        ("where εx and εy are", "where ε x and ε y are"),
        ("σmax at 2θ", "σ max at 2 θ"),
        ("\U0001d438 denotes the yield stress.", "E denotes the yield stress."),
        ("\U0001d70e\U0001d70e\U0001d466\U0001d466 and \U0001d708\U0001d708.", "σ y and ν."),
        ("at ± 0.65∘ relative", "at ± 0.65° relative"),
        ("f ∘ g", "f ∘ g"),
        ("heated to 37℃", "heated to 37°C"),
        ("ElectroPuls™", "ElectroPuls™"),
        (None, None),
        ("", ""),
    ],
)
def test_clean(spark, text, want):
    assert one(spark, C.clean_mapped, text) == want


@pytest.mark.parametrize(
    "text, want",
    [
        ("H U M A N", "HUMAN"), ("a b s t r a c t", "abstract"), ("SC I EN C E RO B OT ICS FOCUS", ""), ("HUMAN ROBOT TASK FORCE for control", "HUMAN ROBOT TASK FORCE for control"),
        ("HU MA N-ROB OT IN TER AC TI ON The role of collaborative robotics", "The role of collaborative robotics"),
    ],
)
def test_tracked(spark, text, want):
    assert one(spark, lambda c: C.drop_banner_runs(C.detrack(c)), text) == want


@pytest.mark.parametrize(
    "text, want",
    [
        ("yield 276 MPa, modulus 68.9 GPa", "yield 276 megapascals, modulus 68.9 gigapascals"), ("density 2.7 g/cm3", "density 2.7 grams per cubic centimeter"), ("1 mm", "1 millimeter"), ("1,000 mg", "1,000 milligrams"),
        ("at 37 °C", "at 37 degrees Celsius"), ("only 5%", "only 5 percent"), ("printed in 3D", "printed in 3D"), ("10-15 mm", "10-15 millimeters"), ("AISI-304L at 276 MPa", "AISI-304L at 276 megapascals"),
        ("HMMs and HMM", "H M Ms and H M M"), ("TiCl4 and ECMO and HMMx", "TiCl4 and ECMO and HMMx"), ("Al2O3", "aluminum 2 O 3"), ("H2O", "H 2 O"), ("CO2", "CO2"), (None, None), ("", ""),
    ],
)
def test_spoken(text, want):
    assert spoken(text) == want


def test_sentences(spark):
    assert one(spark, C.split_sentences, "One. Two is here. Three!") == ["One.", "Two is here.", "Three!"]
    assert folds.token_runs("See Fig. 3 here. Next one.") == ["See Fig. 3 here.", "Next one."]
    parts = folds.overlong_parts("x" * 300 + ", " + "y" * 300 + ", tail.")
    assert len(parts) == 2 and all(len(p) <= 451 for p in parts)
    assert "".join(folds.piece_parts("word " * 900)).replace(" ", "") == "word" * 900


def test_folds_agree(spark):
    words = ["re-", "placement", "now.", "a-", "b-", "c", "", "end-"]
    got = spark.createDataFrame([(words,)], "ws array<string>").select(folds.dehyphenate_tokens(F.col("ws")).alias("x")).first().x
    assert got == folds.dehyphenated(words) == ["replacement", "now.", "ab-", "c", "end"]


def test_small_functions(spark):
    assert spark.range(1).select(C.hms(F.lit(3725.9)).alias("x")).first().x == "1:02:05"
    assert one(spark, C.path_parts, " A / B//C ") == ["A", "B", "C"]
    assert one(spark, C.collapse_spaced, "a b s t r a c t") == "abstract"
    assert one(spark, C.strip_tex, r"\textbf Title") == "Title"
    assert one(spark, C.json_object, 'noise {"a": {"b": 1}} tail') == '{"a": {"b": 1}}'
    assert one(spark, C.finite_non_negative, "NaN") is None
    assert one(spark, C.html_escape, "<a & 'b'>") == "&lt;a &amp; &#x27;b&#x27;&gt;"
    assert [tuple(r) for r in one(spark, C.parse_coords, "1,10,20,30,5;bad;2,0,0,1,1")] == [(0, 10.0, 20.0, 40.0, 25.0), (1, 0.0, 0.0, 1.0, 1.0)]
    assert one(spark, C.markup_text, "<p>Text<ref>[1]</ref> goes on.</p>") == "Text goes on."
    assert one(spark, C.name_vote, "Glenn Daehn, Alan Luo and Mary Smith") is True
    assert one(spark, C.strip_section_prefix, "Abstract — We show") == "We show"
    assert one(spark, C.keyword_separators, "a · b; c") == "a, b, c"


def test_spoken_column_agrees(spark):
    from vellumine.functions.spoken import spoken_column

    texts = ["reached\n73% of 1,000 mg/mL", "12 mmまで20.3 MPa and 5%6%", "Ti-6Al-4V at 1 m2/s2, FEA of Al2O3", "10-15 mm, 3.5 MPa; AISI-304L", "x5 mm 5 mm", "", None, "1.0 h", "Poisson 2 °C H2O", "4\u00a0µm/°C"]
    for t in texts:
        assert one(spark, spoken_column, t) == spoken(t)


def test_token_sentences_agree(spark):
    for t in ["See Fig. 3 here. Next one.", "w" * 500 + " a b. c", "word " * 300, "Was it so ? Yes! (No.) e.g. this 3.5. And", "", None]:
        assert one(spark, folds.token_sentences, t) == folds.token_runs(t)
