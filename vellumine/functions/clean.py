"""Text-cleaning functions as Column expressions: no Python worker, inside code generation where Spark has it.

Null in gives null out; empty text stays empty. Character classes are Unicode-aware ((?U)) unless said otherwise.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters replaced one to one, and those replaced by several.
ONE_FROM = "\u2010\u2011\u2012\u00ad\u00a0\u2002\u2003\u2009\u202f"
ONE_TO = "----     "
SEVERAL = [("\ufb01", "fi"), ("\ufb02", "fl"), ("\u2032", " prime"), ("\u2208", " in ")]
FOLD_KEPT = "\u2122\u2116\u2139"  # read well as they stand
GREEK = "\u0370-\u03ff\u1f00-\u1fff\u00b5"
UNREADABLE = "[\u0900-\u0dff\u1100-\u11ff\u1200-\u139f\uac00-\ud7af]"
CITATION = r"\s*\[[0-9,;\s–—-]+\]"
SENTENCE_GAP = r'(?<=[.!?])\s+(?=[A-Z0-9("“])'
STOP_HEADING = r"(?i)^(references|bibliography|literature\s+cited)\b"
BANNER = r"(?i)^(sciencedirect|available online|journal homepage|www\.)"
NUMBERED_HEADING = r"^\d+(\.\d+)*\.?\s+\S"
SECTION_KEYWORD = r"(?i)^(abstract|keywords?|index terms)\b"
AFFILIATION = r"(?i)\b(Universit|Department|Institute|Laborator|School of|College|Center for|Centre|Faculty|Hospital|Academy)"
EMAIL = r"\b[\w.+-]+@[\w-]+\.\w"
PAPER_NUMBER = r"^[A-Z]{2,}\d{4}-\d+"


def squeeze(c: Column) -> Column:
    """White space to single spaces, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def char_fixes(c: Column) -> Column:
    """Typographic hyphens, spaces, ligatures and two mathematical signs."""
    c = F.translate(c, ONE_FROM, ONE_TO)
    for a, b in SEVERAL:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def dehyphenate(c: Column) -> Column:
    """Words divided at a line break."""
    return F.regexp_replace(c, r"(?U)(\w)-\n(\w)", "$1$2")


def join_lines(c: Column) -> Column:
    """Line breaks to single spaces."""
    return F.regexp_replace(c, r"(?U)\s*\n\s*", " ")


def strip_citations(c: Column) -> Column:
    """Numeric citations in brackets with the space before them."""
    return F.regexp_replace(c, CITATION, "")


def spoken_ranges(c: Column) -> Column:
    """An en dash between digits reads "to" (F06)."""
    return F.regexp_replace(c, r"(\d)\s*–\s*(\d)", "$1 to $2")


def degree_signs(c: Column) -> Column:
    """A ring operator after a number is a degree sign."""
    return F.regexp_replace(c, "(\\d\\s*)[\u2218\u25e6]", "$1°")


def collapse_math(c: Column) -> Column:
    """Doubled mathematical letters to one."""
    return F.regexp_replace(c, r"([\x{1D400}-\x{1D7FF}])\1+", "$1")


@lru_cache(maxsize=1)
def fold_table() -> tuple[str, str, list[tuple[str, str]]]:
    """Mathematical and letter-like characters and their plain letters, made from the Unicode data."""
    one_a, one_b, many = [], [], []
    for lo, hi in ((0x1D400, 0x1D800), (0x2100, 0x2150)):
        for cp in range(lo, hi):
            a = chr(cp)
            b = unicodedata.normalize("NFKC", a)
            if a == b or a in FOLD_KEPT:
                continue
            if len(b) == 1:
                one_a.append(a)
                one_b.append(b)
            else:
                many.append((a, b))
    return "".join(one_a), "".join(one_b), many


def fold_math(c: Column) -> Column:
    """Mathematical and letter-like letters to plain ones."""
    a, b, many = fold_table()
    c = F.translate(c, a, b)
    for x, y in many:
        c = F.replace(c, F.lit(x), F.lit(y))
    return c


def drop_unreadable(c: Column) -> Column:
    """Scripts that stand for broken font maps to spaces."""
    return F.regexp_replace(c, UNREADABLE, " ")


def space_greek(c: Column) -> Column:
    """A space between a Greek letter and a Latin letter or digit."""
    return F.regexp_replace(F.regexp_replace(c, f"([{GREEK}])([A-Za-z0-9])", "$1 $2"), f"([A-Za-z0-9])([{GREEK}])", "$1 $2")


def collapse_space(c: Column) -> Column:
    """Two or more white-space characters to one space; ends trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s{2,}", " "))


def clean_mapped(c: Column) -> Column:
    """F01 and F03 to F12, in this order."""
    for step in (char_fixes, dehyphenate, join_lines, strip_citations, spoken_ranges, degree_signs, collapse_math, fold_math, drop_unreadable, space_greek, collapse_space):
        c = step(c)
    return c


def detrack(c: Column) -> Column:
    """Three or more single letters in a row are one word."""
    return F.regexp_replace(c, r"(?<=\b[A-Za-z]) (?=[A-Za-z] [A-Za-z]\b)|(?<=\b[A-Za-z] [A-Za-z]) (?=[A-Za-z]\b)", "")


def drop_banner_runs(c: Column) -> Column:
    """Within each run of capital tokens the longest suffix of four or more whose mean length is at most three goes."""
    toks = F.filter(F.split(squeeze(c), " "), lambda t: t != "")
    caps = lambda t: (F.upper(t) == t) & (F.lower(t) != t)
    # A reversed fold over runs: state holds kept tokens and the open run.
    zero = F.struct(F.array().cast("array<string>").alias("keep"), F.array().cast("array<string>").alias("run"))

    def cut_suffix(run: Column) -> Column:
        n = F.size(run)
        starts = F.filter(
            F.when(n >= 4, F.sequence(F.lit(1), n - 3)).otherwise(F.array().cast("array<int>")),
            lambda i: F.aggregate(F.slice(run, i, n - i + 1), F.lit(0), lambda a, t: a + F.length(t)) <= 3 * (n - i + 1),
        )
        return F.when(F.size(starts) > 0, F.slice(run, F.lit(1), F.get(starts, F.lit(0)) - 1)).otherwise(run)

    def step(acc: Column, t: Column) -> Column:
        more = F.struct(acc["keep"].alias("keep"), F.concat(acc["run"], F.array(t)).alias("run"))
        close = F.struct(F.concat(acc["keep"], cut_suffix(acc["run"]), F.array(t)).alias("keep"), F.array().cast("array<string>").alias("run"))
        return F.when(caps(t), more).otherwise(close)

    return F.aggregate(toks, zero, step, lambda acc: F.array_join(F.concat(acc["keep"], cut_suffix(acc["run"])), " "))


def clean_text(c: Column) -> Column:
    """The whole pipeline, F01 to F14."""
    return drop_banner_runs(detrack(clean_mapped(c)))


def split_sentences(c: Column) -> Column:
    """ARRAY<STRING> of sentences by terminators before capitals, digits, brackets and quotes."""
    return F.split(c, SENTENCE_GAP)


def head_tail(c: Column, n: int = 150) -> Column:
    """First and last sentence, n characters each."""
    parts = F.split(squeeze(c), r"(?<=[.!?])\s+")
    return F.struct(F.substring(F.element_at(parts, 1), 1, n).alias("head"), F.substring(F.element_at(parts, -1), 1, n).alias("tail"))


def alnum_key(c: Column) -> Column:
    """Lower-case letters and digits alone."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


def strip_tex(c: Column) -> Column:
    """TeX macros with the space after them."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\\[A-Za-z@]+\s*", ""))


def collapse_spaced(c: Column) -> Column:
    """A fully letter-spaced heading to one word, else null."""
    return F.when(c.rlike(r"(?U)^(?:\w )+\w$"), F.replace(c, F.lit(" "), F.lit("")))


def caps_heading(c: Column) -> Column:
    """Whether a line is a heading in capitals."""
    letters, upper = F.regexp_count(c, F.lit(r"\p{L}")), F.regexp_count(c, F.lit(r"\p{Lu}"))
    return (F.length(c) >= 6) & (letters >= 5) & (upper >= 0.85 * letters)


def heading_kind(c: Column) -> Column:
    """numbered, keyword, stop, caps or null for a line."""
    return F.when(c.rlike(STOP_HEADING), "stop").when(c.rlike(SECTION_KEYWORD), "keyword").when(c.rlike(NUMBERED_HEADING), "numbered").when(caps_heading(c), "caps")


def affiliation_hits(c: Column) -> Column:
    """Number of affiliation words."""
    return F.regexp_count(c, F.lit(AFFILIATION))


def is_affiliation(c: Column) -> Column:
    """Whether a block is an affiliation or correspondence block."""
    return c.rlike(EMAIL) | (affiliation_hits(c) >= 2) | ((affiliation_hits(c) >= 1) & c.rlike(r"^[0-9a-f]\b"))


def author_list(c: Column) -> Column:
    """Whether a line is a dotted author list with markers."""
    return (F.regexp_count(c, F.lit("·")) >= 2) & c.rlike(r"\d(?:,\d+)*\s*·")


def name_fragment(c: Column) -> Column:
    """Whether a line is a short wrapped rest of an author line."""
    words = F.split(squeeze(c), " ")
    return (F.size(words) >= 2) & (F.size(words) <= 6) & (F.length(c) < 40) & F.forall(words, lambda w: w.rlike(r"^\p{Lu}"))


def name_vote(c: Column) -> Column:
    """Whether a line is an author line: two name-like parts or more, three fifths of all."""
    parts = F.transform(F.split(F.regexp_replace(c, r"\([^)]*\)", " "), r"(?i),|\band\b"), lambda p: F.regexp_replace(p, r"^[ .∗*†‡]+|[ .∗*†‡]+$", ""))
    parts = F.filter(parts, lambda p: F.length(p) > 2)
    words = lambda p: F.filter(F.split(squeeze(p), " "), lambda w: ~w.rlike(r"^\d+$") & ~((F.length(w) == 1) & ~w.rlike(r"^\p{Lu}")))
    namish = F.filter(parts, lambda p: F.size(words(p)).between(2, 4) & F.forall(words(p), lambda w: w.rlike(r"^\p{Lu}")))
    return (F.length(c) <= 250) & (F.size(namish) >= 2) & (F.size(namish) >= 0.6 * F.size(parts))


def parse_authors(c: Column) -> Column:
    """Author names of an author line, joined by commas."""
    t = F.regexp_replace(squeeze(F.translate(c, "\u2010\u2011\u2012\u00ad", "----")), r"\([^)]*\)", " ")
    parts = F.when(F.contains(t, F.lit("·")), F.split(t, "·")).otherwise(F.split(t, r"(?i),|\band\b"))
    words = lambda p: F.filter(F.transform(F.filter(F.split(squeeze(p), " "), lambda w: ~w.rlike(r"^\d+$") & ~((F.length(w) == 1) & ~w.rlike(r"^\p{Lu}"))), lambda w: F.regexp_replace(w, r"\d+$", "")), lambda w: w != "")
    names = F.transform(parts, lambda p: F.regexp_replace(F.array_join(words(p), " "), r"^[ .∗*†‡]+|[ .∗*†‡]+$", ""))
    return F.array_join(F.filter(names, lambda n: F.length(n) > 1), ", ")


def years(c: Column) -> Column:
    """ARRAY<INT> of plausible publication years."""
    return F.transform(F.regexp_extract_all(c, F.lit(r"\b(19[5-9]\d|20[0-3]\d)\b"), F.lit(1)), lambda y: y.cast("int"))


def narratable(c: Column) -> Column:
    """Whether a text can be read out."""
    solid = F.regexp_replace(c, r"(?U)\s+", "")
    letters = F.regexp_count(solid, F.lit(r"\p{L}"))
    return ~c.rlike(r"[\uE000-\uF8FF]") & (F.length(solid) >= 3) & ~((F.length(solid) > 15) & (letters < 0.4 * F.length(solid)))


def word_count(c: Column) -> Column:
    """Words by white space."""
    t = squeeze(c)
    return F.when(t == "", 0).otherwise(F.size(F.split(t, " ")))


def sentence_breaks(c: Column) -> Column:
    """Sentence ends before a capital or bracket (P10)."""
    return F.regexp_count(squeeze(c), F.lit(r"[.!?]\s+[A-Z(]"))


def rescued(label: Column, text: Column) -> Column:
    """Whether a block labelled furniture, caption, table or front matter is body text after all (P10)."""
    n = word_count(text)
    return label.isin(3, 4, 5, 6) & narratable(text) & ((n >= 120) | ((n >= 55) & (sentence_breaks(text) >= 2)))


def slug(c: Column, n: int = 40) -> Column:
    """File-name slug."""
    s = F.regexp_replace(F.lower(c), "[^a-z0-9.]+", "-")
    return F.regexp_replace(F.substring(F.regexp_replace(s, r"^[-.]+|[-.]+$", ""), 1, n), r"[-.]+$", "")


def html_escape(c: Column) -> Column:
    """Markup signs as entities (F32)."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def script_json(c: Column) -> Column:
    """JSON text that may stand in a script element."""
    for a, b in (("</", "<\\/"), ("\u2028", "\\u2028"), ("\u2029", "\\u2029")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def parse_coords(c: Column) -> Column:
    """ARRAY<STRUCT<page,x0,y0,x1,y1>> of "page,x,y,w,h;…"; malformed parts go; pages count from 0."""
    parts = F.transform(F.split(c, ";"), lambda p: F.transform(F.split(p, ","), lambda x: x.try_cast("double")))
    good = F.filter(parts, lambda p: (F.size(p) >= 5) & F.forall(F.slice(p, 1, 5), lambda x: x.isNotNull()))
    return F.transform(good, lambda p: F.struct((F.get(p, F.lit(0)).cast("int") - 1).alias("page"), F.get(p, F.lit(1)).alias("x0"), F.get(p, F.lit(2)).alias("y0"), (F.get(p, F.lit(1)) + F.get(p, F.lit(3))).alias("x1"), (F.get(p, F.lit(2)) + F.get(p, F.lit(4))).alias("y1")))


def markup_text(c: Column) -> Column:
    """Text of markup without the content of ref and note elements but with what follows them."""
    c = F.regexp_replace(c, r"(?s)<(ref|note)\b[^>]*?/>", "")
    c = F.regexp_replace(c, r"(?s)<(ref|note)\b[^>]*>.*?</\1>", "")
    return squeeze(F.regexp_replace(c, r"<[^>]+>", " "))


def path_parts(c: Column) -> Column:
    """ARRAY<STRING> of a slashed path, trimmed, without empty parts."""
    return F.filter(F.transform(F.split(c, "/"), lambda p: F.trim(p)), lambda p: p != "")


def last_four(c: Column) -> Column:
    """Only the last four characters of a secret."""
    return F.right(c, F.lit(4))


def hms(seconds: Column) -> Column:
    """Seconds as h:mm:ss, or m:ss below an hour."""
    s = F.floor(F.greatest(seconds, F.lit(0.0))).cast("bigint")
    h, m, r = F.floor(s / 3600).cast("bigint"), F.floor((s % 3600) / 60).cast("bigint"), s % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, r)).otherwise(F.format_string("%d:%02d", m, r))


def username(c: Column) -> Column:
    """A valid user name in lower case, else null."""
    u = F.lower(F.trim(c))
    return F.when(u.rlike(r"^[a-z0-9][a-z0-9_-]{1,31}$"), u)


def keyword_separators(c: Column) -> Column:
    """Dots and semicolons between keywords to commas."""
    return F.regexp_replace(c, r"\s*[·;]\s*", ", ")


def strip_section_prefix(c: Column) -> Column:
    """"Abstract" and "Keywords" prefixes go."""
    return F.trim(F.regexp_replace(c, r"(?i)^(abstract|keywords?|index terms)\b\s*[.:—–-]*\s*", ""))


def json_object(c: Column) -> Column:
    """The text from the first to the last brace."""
    return F.nullif(F.regexp_extract(c, r"(?s)\{.*\}", 0), F.lit(""))


def clamp(c: Column, lo: float, hi: float) -> Column:
    """A number kept within bounds."""
    return F.least(F.greatest(c, F.lit(lo)), F.lit(hi))


def finite_non_negative(c: Column) -> Column:
    """A number from text if it is finite and not negative, else null."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x) & (x >= 0) & (x < float("inf")), x)
