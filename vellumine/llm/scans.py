"""Noise in text from scanned pages: hyphens at line ends, misread characters, running headers and page numbers.

Reading order comes from the boxes, one page at a time: pages are hashed apart, so no document is ever gathered into one task,
and a page's columns, type size and edges are its own, not its document's. Misread words are found by anagram hashes: a rare
word and a frequent one whose hashes differ by known confusions are joined in SQL by equal hash, verified and ranked; numbers
meet by the hashes of their shapes. Hyphens are settled by what the corpus writes: joined, compound or suspended. Furniture
inside a unit stands between the last word of one page and the first of the next.

Cases: words with null or empty text, null keys or null or unusable boxes are left out; equal rows count once; pages may come
in any order; empty tables give empty results; ties in position fall to pos; units without text have no noise.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumine.session import cut, small

# What is printed, what is read instead.
CONFUSIONS = [
    ("e", "c"), ("s", "5"), ("o", "0"), ("a", "@"), ("t", "f"), ("i", "!"), ("n", "ri"), ("g", "9"), ("l", "1"), ("d", "cl"), ("h", "b"), ("u", "ii"),
    ("m", "rn"), ("ti", "ü"), ("li", "h"), ("i", "l"), ("w", "vv"), ("b", "8"), ("i", "1"), ("c", "e"), ("f", "t"), ("l", "i"), ("b", "h"), ("h", "li"),
    ("ü", "ti"), ("rn", "m"), ("cl", "d"), ("z", "2"), ("q", "9"), ("b", "6"), ("ä", "a"), ("ö", "o"),
]
# Letters read for printed digits, and the digits.
LETTER_FOR_DIGIT, DIGIT_FOR_LETTER = "OoDlISBgbzZ", "00011589622"
# Confusable characters and, after them, sequences that become one class, to verify a join of hashes.
_CLASS_FROM, _CLASS_TO = "c50@f!i19qhb86z2äöé", "esoatlllgguuuuzzaoe"
_CLASS_RUNS = [("ü", "tl"), ("rn", "m"), ("rl", "n"), ("el", "d"), ("vv", "w"), ("ll", "u")]
HYPHENS = "-‐‑­¬"
# Words that follow a suspended hyphen ("pre- and post-test").
CONJUNCTIONS = ["and", "or", "to", "und", "oder", "bis", "et", "ou", "y", "o", "e", "nor", "versus", "vs"]
_OPENING = r"""^[\s"'“”„«»‘’()\[\]{}]+"""
_CLOSED = r"""[.!?:。！？][\s"'“”»’)\]]*$"""
_ROMAN = re.compile(r"^[ivxlcdm1]+$", re.I)
_NUMBER = re.compile(r"^[\[({]?[0-9OoIlSBgbzZq|!]*[0-9][0-9OoIlSBgbzZq|!]*[\])}]?$")
_DECORATION = re.compile(r"^[–—\-·•|~*]+$")
_PAGE_WORDS = {"page", "p.", "pp.", "p", "seite", "s.", "pag.", "pág.", "página", "of", "von", "de", "sur", "/", "стр."}
LONG_LINE = 6
_EDGE_SIGNS = " \t\r\n\"'“”„«»‘’()[]{}.,;:?…/–—"
_DIVIDED = f"[\\p{{L}}0-9@!][{HYPHENS}]$"


def bare(c: Column) -> Column:
    """A token without punctuation at its ends. A sign inside a word stays, and an exclamation mark before one."""
    return F.rtrim(F.ltrim(c, F.lit(_EDGE_SIGNS)), F.lit(_EDGE_SIGNS + "!"))


def core(c: Column) -> Column:
    """The same in lower case."""
    return F.lower(bare(c))


# ---------------------------------------------------------------- layout

LAYOUT = "doc_id string, page int, k int, pos int, text string, label string, flags int, after string, after_pos int, nth int"
# Bits of flags.
FIRST, SECOND, TOP, LAST, UPPER = 1, 2, 4, 8, 16
_CHUNK_ROWS, _CHUNK_PAGES, _WIDTH = 200_000, 1000, 2048


def page_words(words: DataFrame) -> DataFrame:
    """Readable words, a page's rows side by side: hashed apart by page and sorted by one number."""
    some = words.select("doc_id", "page", "x0", "y0", "x1", "y1", "text", "pos").where("text is not null and trim(text) <> '' and x0 is not null and y0 is not null and doc_id is not null and page is not null and pos is not null")
    some = some.where("not isnan(x0) and not isnan(y0) and abs(x0) < 1e6 and abs(y0) < 1e6").withColumn("pk", F.xxhash64("doc_id", "page"))
    return some.repartition("pk").sortWithinPartitions("pk")


def laid_out(words: DataFrame) -> DataFrame:
    """The words in reading order (LAYOUT), one row a word.

    k is the place in the page; label is header or pageno for furniture and null in the body; after is the word behind a word
    divided at a line end; nth counts the paragraphs begun in the page. flags: FIRST and SECOND are the halves of such a word,
    TOP and LAST a page's first and last body word, UPPER the words of its first line.
    """
    return page_words(words).mapInArrow(_layout_batches, LAYOUT)


def _layout_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows are gathered up to a page's end; a page is bounded, so is what is held."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if b.num_rows:
            held.append(b)
        if sum(x.num_rows for x in held) >= _CHUNK_ROWS:
            t = pa.Table.from_batches(held)
            pk = t.column("pk").to_numpy()
            whole = int(np.searchsorted(pk, pk[-1]))
            if whole:
                yield from _layout(t.slice(0, whole))
                held = t.slice(whole).to_batches()
    if held:
        yield from _layout(pa.Table.from_batches(held))


def _layout(t: pa.Table) -> Iterator[pa.RecordBatch]:
    """Whole pages in any order; pages are told apart by document and number, whatever their hashes."""
    doc = t.column("doc_id").combine_chunks()
    codes = (doc.combine_chunks() if isinstance(doc, pa.ChunkedArray) else doc).dictionary_encode().indices.to_numpy().astype(np.int64)
    key = (codes << 32) + t.column("page").to_numpy().astype(np.int64)
    _, g = np.unique(key, return_inverse=True)
    order = np.argsort(g, kind="stable")
    g = g[order]
    for a in range(0, int(g[-1]) + 1, _CHUNK_PAGES):
        lo, hi = np.searchsorted(g, [a, a + _CHUNK_PAGES])
        yield _lay_pages(t, order[lo:hi], g[lo:hi] - a)


def _lay_pages(t: pa.Table, rows: np.ndarray, g: np.ndarray) -> pa.RecordBatch:
    x0, y0, x1, y1 = (t.column(c).to_numpy().astype(float)[rows] for c in ("x0", "y0", "x1", "y1"))
    pos = t.column("pos").to_numpy()[rows]
    starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
    pages = len(starts)
    # Size of the type: the height most words of the page have. Furniture is smaller and stands beyond all words of that size.
    h = y1 - y0
    known = np.isfinite(h) & (h > 0)
    size = np.full(pages, 10.0)
    at, n = np.unique(g[known] * 65536 + np.minimum(np.round(h[known] * 10), 65535).astype(np.int64), return_counts=True)
    best = np.lexsort((at, n, at >> 16))
    size[(at >> 16)[best]] = (at & 65535)[best] / 10.0  # the last of a page, with the most words, stays
    size = _body_size(size, h, y0, g, starts)
    em = size[g]
    full = ~known | (h >= 0.95 * em)
    top = np.minimum.reduceat(np.where(full, y0, np.inf), starts)
    low = np.maximum.reduceat(np.where(full, y0, -np.inf), starts)
    band = np.where(y0 < top[g] - 0.3 * em, 0, np.where(y0 > low[g] + 0.3 * em, 2, 1))
    # Columns: the left margin is the first left edge many lines share; a second column has its own edge behind an empty gutter.
    body = full & (band == 1)
    edge = np.clip(np.round(x0), 0, _WIDTH - 1).astype(np.int64)
    at, n = np.unique(g[body] * _WIDTH + edge[body], return_counts=True)
    of, x = at // _WIDTH, at % _WIDTH
    most = np.zeros(pages, np.int64)
    np.maximum.at(most, of, n)
    left = np.full(pages, np.inf)
    often = n >= 0.4 * most[of]
    np.minimum.at(left, of[often], x[often].astype(float))
    end = np.clip(np.where(np.isfinite(x1), x1, x0), 0, _WIDTH - 1).astype(np.int64)
    flat = pages * _WIDTH
    cover = np.bincount((g * _WIDTH + edge)[body], minlength=flat) - np.bincount((g * _WIDTH + end)[body], minlength=flat)
    cover = np.cumsum(cover.reshape(pages, _WIDTH), axis=1)
    right = np.full(pages, np.inf)
    some = (n >= 2) & (x >= left[of] + 15 * size[of])
    of, x, n = of[some], x[some], n[some]
    gutter = cover[of[:, None], np.maximum(x[:, None] - np.arange(3, 9), 0)].max(axis=1) if len(of) else np.zeros(0)
    free = gutter <= 0.05 * n
    np.minimum.at(right, of[free], x[free].astype(float))
    col = np.where((band == 1) & (x0 >= right[g] - 3), 1, 0)
    # Lines, then words along them; equal rows are neighbours in this order and only the first stays.
    down = np.lexsort((pos, x0, y0, col, band, g))
    again = np.zeros(len(down), bool)
    again[1:] = (g[down][1:] == g[down][:-1]) & (pos[down][1:] == pos[down][:-1]) & (x0[down][1:] == x0[down][:-1]) & (y0[down][1:] == y0[down][:-1])
    down = down[~again]
    gd, bd, cd, yd = g[down], band[down], col[down], y0[down]
    new = np.r_[True, (gd[1:] != gd[:-1]) | (bd[1:] != bd[:-1]) | (cd[1:] != cd[:-1]) | (yd[1:] - yd[:-1] > 0.5 * em[down][1:])]
    line = np.cumsum(new)
    across = np.lexsort((pos[down], x0[down], line))
    seq, line = down[across], line[across]
    g, band, col, x0, y0, em, pos = g[seq], band[seq], col[seq], x0[seq], y0[seq], em[seq], pos[seq]
    text = t.column("text").combine_chunks()
    text = (text.combine_chunks() if isinstance(text, pa.ChunkedArray) else text).take(pa.array(rows[seq]))
    count = len(seq)
    same_page = np.r_[g[1:] == g[:-1], False]
    begins = np.r_[True, line[1:] != line[:-1]]
    stops = np.r_[begins[1:], True]
    band = _bare_numbers(band, g, y0, em, begins, stops, text)
    labels: list[str | None] = [None] * count
    for a, b in zip(np.flatnonzero(begins), np.flatnonzero(stops) + 1):
        if band[a] != 1:
            labels[a:b] = _line_labels(text.slice(a, b - a).to_pylist())
    inside = band == 1
    next_in = np.r_[inside[1:], False] & same_page
    ends = np.flatnonzero(stops & inside)
    first = np.zeros(count, bool)
    first[ends] = pc.match_substring_regex(text.take(pa.array(ends)), _DIVIDED).to_numpy(zero_copy_only=False)
    follows = first & next_in
    second = np.r_[False, follows[:-1]]
    after = pa.array(np.arange(1, count + 1), mask=~follows)
    before_in = np.r_[False, inside[:-1]] & np.r_[False, same_page[:-1]]
    is_top, is_last = inside & ~before_in, inside & ~next_in
    # A paragraph begins at an indented line or after a wider gap.
    margin = np.where(col == 1, right[g], left[g])
    indented = (x0 > margin + 0.4 * em) & (x0 < margin + 4 * em)
    gap = np.r_[False, (y0[1:] - y0[:-1] > 2.4 * em[1:]) & same_page[:-1]] & before_in
    opens = begins & inside & (indented | gap)
    run = np.cumsum(opens)
    page_at = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
    base = (run - opens)[page_at]
    of_page = np.cumsum(np.r_[True, g[1:] != g[:-1]]) - 1
    nth = run - base[of_page]
    upper_line = np.full(len(page_at), -1, np.int64)
    tops = np.flatnonzero(is_top)
    upper_line[of_page[tops]] = line[tops]
    flags = FIRST * first + SECOND * second + TOP * is_top + LAST * is_last + UPPER * (inside & (line == upper_line[of_page]))
    take = pa.array(rows[seq])
    cols = [
        _flat(t, "doc_id").take(take), _flat(t, "page").take(take), pa.array((np.arange(count) - page_at[of_page]).astype(np.int32)), pa.array(pos.astype(np.int32)), text, pa.array(labels, pa.string()), pa.array(flags.astype(np.int32)),
        text.take(after), pa.array(pos.astype(np.int32)).take(after), pa.array(nth.astype(np.int32)),
    ]
    return pa.RecordBatch.from_arrays(cols, names=[f.split()[0] for f in LAYOUT.split(", ")])


def _body_size(size: np.ndarray, h: np.ndarray, y0: np.ndarray, g: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The type of a page that has hardly any text: where the words of most frequent size are one line above all larger ones,
    and at most one below them, they are furniture, and the smallest larger size is the body's."""
    larger = h > 1.05 * size[g]
    equal = np.abs(h - size[g]) <= 0.05 * size[g]
    low, high = np.minimum.reduceat(np.where(larger, y0, np.inf), starts)[g], np.maximum.reduceat(np.where(larger, y0, -np.inf), starts)[g]
    ok = np.isfinite(low[starts])
    for side, must in ((equal & (y0 < low), True), (equal & (y0 > high), False)):
        first, last = np.minimum.reduceat(np.where(side, y0, np.inf), starts), np.maximum.reduceat(np.where(side, y0, -np.inf), starts)
        some = np.isfinite(first)
        ok &= np.where(some, last - np.where(some, first, 0) <= 0.5 * size, not must)
    ok &= ~np.logical_or.reduceat(equal & (y0 >= low) & (y0 <= high), starts)
    return np.where(ok, np.minimum.reduceat(np.where(larger, h, np.inf), starts), size)


def _flat(t: pa.Table, name: str) -> pa.Array:
    c = t.column(name).combine_chunks()
    return c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c


def _bare_numbers(band: np.ndarray, g: np.ndarray, y0: np.ndarray, em: np.ndarray, begins: np.ndarray, stops: np.ndarray, text: pa.Array) -> np.ndarray:
    """Page numbers in the size of the body: a first or last line that is nothing else and stands well apart from its neighbour."""
    heads, tails = np.flatnonzero(begins), np.flatnonzero(stops)
    out = band
    far = (g[heads[1:]] == g[heads[:-1]]) & (np.abs(y0[heads[1:]] - y0[heads[:-1]]) > 2.4 * em[heads[1:]]) & (band[heads[1:]] == 1) & (band[heads[:-1]] == 1)
    for k in np.flatnonzero(far) + 1:
        a, b = heads[k - 1], heads[k]
        for j, alone in ((k - 1, k < 2 or g[heads[k - 2]] != g[a]), (k, k + 1 == len(heads) or g[heads[k + 1]] != g[b])):
            if alone and tails[j] - heads[j] < 6 and set(_line_labels(text.slice(heads[j], tails[j] + 1 - heads[j]).to_pylist())) == {"pageno"}:
                out = out.copy() if out is band else out
                out[heads[j] : tails[j] + 1] = 0 if j < k else 2
    return out


def _line_labels(tokens: list[str]) -> list[str]:
    """Labels of the words of a furniture line: pageno for a page number with its decoration at either end, else header."""
    n = len(tokens)

    def run(order: list[int]) -> set[int]:
        got: set[int] = set()
        digits = False
        for k in order:
            t = tokens[k]
            if _DECORATION.match(t) or t.lower() in _PAGE_WORDS:
                got.add(k)
            elif _NUMBER.match(t) and not (n > 1 and t[0] == "(" and t[-1] == ")") or (len(got) == k and _ROMAN.match(t) and (len(t) > 1 or n == 1) and order[0] == k and (n == 1 or t.islower())):
                got.add(k)
                digits = True
            else:
                break
        return got if digits else set()

    whole = run(list(range(n)))
    if len(whole) == n:
        return ["pageno"] * n
    tail = run(list(range(n - 1, -1, -1)))
    return ["pageno" if k in whole or k in tail else "header" for k in range(n)]


# ---------------------------------------------------------------- vocabulary and corrections


def anagram_hash(c: Column) -> Column:
    """Sum of the hashes of a word's characters: words with the same letters have the same value."""
    return F.aggregate(F.split(c, ""), F.lit(0).cast("bigint"), lambda acc, x: acc + F.when(x == "", F.lit(0).cast("bigint")).otherwise(F.pmod(F.xxhash64(x), F.lit(1 << 40))))


def _hash(word: str) -> int:
    """The anagram hash of a word known beforehand."""
    return sum((xxhash.xxh64(c.encode(), seed=42).intdigest()) % (1 << 40) for c in word)


def skeleton(c: Column) -> Column:
    """The form in which confusable words are equal, to verify a join of hashes."""
    c = F.translate(c, _CLASS_FROM, _CLASS_TO)
    for run, one in _CLASS_RUNS:
        c = F.replace(c, F.lit(run), F.lit(one))
    return c


def _differences(c: Column, pairs: list[tuple[str, str]], side: int) -> Column:
    """ARRAY<BIGINT>: printed less noisy hash of the confusions whose printed (0) or noisy (1) side is in a word.

    Noisy sides may show only after another confusion is undone ("helc1" for "held"), so they are sought with letters for
    signs too.
    """
    plain = F.translate(c, "15089@!6", "lsobgaib")
    all_ = F.array(*[F.struct(F.lit(p[side]).alias("s"), F.lit(_hash(p[0]) - _hash(p[1])).cast("bigint").alias("d")) for p in pairs])
    return F.array_distinct(F.transform(F.filter(all_, lambda x: F.contains(c, x["s"]) | (F.contains(plain, x["s"]) if side else F.lit(False))), lambda x: x["d"]))


def corrections(rare: DataFrame, vocab: DataFrame, pairs: list[tuple[str, str]] = CONFUSIONS, odd_ratio: float = 1.0, plain_ratio: float = 12.0) -> DataFrame:
    """(word, right, steps): for each word of ``rare`` (word, n) the best frequent variant of ``vocab`` (word, n).

    A variant differs by one to three confusions: the hash of the rare word plus one or two differences meets that of the
    variant, or, where the word has digits or signs inside, the variant's less a third difference, so no word's confusions
    need be tried three at a time. Words with digits or signs need a variant that is as frequent; plain words one that is
    plain_ratio times as frequent.
    """
    odd = F.col("word").rlike(r"\p{L}[0-9@!]|[0-9@!]\p{L}")
    w = rare.select("word", "n", odd.alias("odd"), anagram_hash(F.col("word")).alias("h"), _differences(F.col("word"), pairs, 1).alias("d")).where("size(d) > 0")
    two = F.array_distinct(F.flatten(F.transform("d", lambda a: F.transform("d", lambda b: a + b))))
    step = lambda a, k: F.transform(a, lambda x: F.struct(F.lit(k).alias("steps"), x.alias("d")))
    w = w.select("word", "n", "odd", "h", F.explode(F.concat(step(F.col("d"), 1), step(two, 2))).alias("s")).select("word", "n", "odd", "s.steps", (F.col("h") + F.col("s.d")).alias("h"))
    v = vocab.where(~F.col("word").rlike(r"\p{L}.*[0-9@!]|[0-9@!].*\p{L}")).select(F.col("word").alias("right"), F.col("n").alias("m"), anagram_hash(F.col("word")).alias("v"), _differences(F.col("word"), pairs, 0).alias("d"))
    none = F.array(F.struct(F.lit(0).alias("steps"), F.lit(0).cast("bigint").alias("d")))
    v = v.select("right", "m", "v", F.explode(F.concat(none, step(F.col("d"), 1))).alias("s")).select("right", "m", F.col("s.steps").alias("more"), (F.col("v") - F.col("s.d")).alias("h"))
    near = w.join(v, "h").where("right <> word and (odd or more = 0)").withColumn("steps", F.col("steps") + F.col("more"))
    near = near.where(F.when(F.col("odd"), F.col("m") >= odd_ratio * F.col("n")).otherwise((F.col("m") >= F.greatest(F.lit(3), plain_ratio * F.col("n"))) & (F.length("word") >= 3)))
    near = near.where((F.levenshtein("word", "right") <= 2 * F.col("steps")) & (F.col("odd") | (F.col("steps") == 1) | (skeleton(F.col("word")) == skeleton(F.col("right")))))
    best = near.groupBy("word").agg(F.min_by("right", F.struct("steps", -F.col("m"))).alias("right"), F.min("steps").alias("steps"))
    # A variant may be misread itself: its own correction is taken.
    again = best.select(F.col("word").alias("right"), F.col("right").alias("better"))
    return best.join(again, "right", "left").select("word", F.coalesce("better", "right").alias("right"), "steps")


def number_corrections(forms: DataFrame) -> DataFrame:
    """(tok, right) of the tokens of ``forms`` (tok, n) that are numbers with letters for digits.

    A number is hardly ever frequent, its shape is: digits become 9, and the shape with letters meets, by the same hashes and
    one to three confusions, a frequent shape without them. One letter before six digits or more is a mark of its own.
    """
    letters = F.col("tok").rlike(r"^(?=.*[0-9])[0-9OoDlISBgbzZ]+(?:[.,][0-9OoDlISBgbzZ]+)*%?$") & ~F.col("tok").rlike(r"^[A-Z][0-9]{6,}$") & (F.length("tok") >= 2)
    shape = F.regexp_replace("tok", "[0-9]", "9")
    odd = forms.where(letters & F.col("tok").rlike("[A-Za-z]"))
    shapes = forms.where(F.col("tok").rlike(r"^[0-9][0-9.,]*%?$")).groupBy(shape.alias("word")).agg(F.sum("n").alias("n"))
    rare = odd.groupBy(shape.alias("word")).agg(F.sum("n").alias("n"))
    found = corrections(rare, shapes, [("9", x) for x in LETTER_FOR_DIGIT])
    plain = F.translate("tok", LETTER_FOR_DIGIT, DIGIT_FOR_LETTER)
    met = odd.withColumn("word", shape).join(found.select("word", F.col("right").alias("as_shape")), "word")
    return met.select("tok", plain.alias("right")).where(F.regexp_replace("right", "[0-9]", "9") == F.col("as_shape"))


def has(flag: int) -> Column:
    """Whether a word of the layout has a flag."""
    return F.col("flags").bitwiseAND(F.lit(flag)) != 0


def _strip_hyphen(c: Column) -> Column:
    return F.regexp_replace(c, f"[{HYPHENS}]$", "")


def cased(right: Column, seen: Column) -> Column:
    """A word in lower case written as the one seen: as it stands where only its case differs, else by its capitals."""
    capital = F.concat(F.upper(F.substring(right, 1, 1)), F.substring(right, 2, 1 << 20))
    return F.when(F.lower(seen) == right, seen).when(seen.rlike(r"^[^\p{Ll}]*\p{Lu}[^\p{Ll}]*\p{Lu}[^\p{Ll}]*$"), F.upper(right)).when(seen.rlike(r"^\p{Lu}"), capital).otherwise(right)


def ends_divided(c: Column) -> Column:
    """Whether a token ends with a hyphen after a letter."""
    hyphen = F.endswith(c, F.lit(HYPHENS[0]))
    for sign in HYPHENS[1:]:
        hyphen = hyphen | F.endswith(c, F.lit(sign))
    return hyphen & c.rlike(_DIVIDED)


class ScanNoise:
    """The noise of all scanned documents, found once and given as rows or as repaired text."""

    def __init__(self, words: DataFrame, units: DataFrame) -> None:
        docs = words.where("doc_id is not null").select("doc_id").distinct()
        some = units.select("doc_id", "pos", "text").join(docs, "doc_id", "left_semi").where("text is not null and trim(text) <> '' and pos is not null")
        flat = some.repartition("doc_id", "pos").distinct()
        self.flat = cut(flat.select("doc_id", "pos", F.split(F.trim("text"), r"\s+").alias("ts")))
        self.layout = cut(laid_out(words))
        self.body = self.layout.where("label is null")
        self._furniture_in_units()
        self._ends()
        self._vocabulary()

    def _furniture_in_units(self) -> None:
        """Furniture inside units: tokens of a page's furniture lines between the last word before the page and its first.

        seams: (doc_id, pos, k, g, noise), g tokens from place k on. A unit is met by the last word of the page before and the
        first token of the furniture behind it, then checked on its tokens. A running header of LONG_LINE words or more is also
        met elsewhere, by its first two words, with a printed page number of its document behind it.
        """
        edges = self.layout.where(F.col("label").isNotNull() | has(TOP) | has(LAST))
        by = edges.groupBy("doc_id", "page").agg(
            F.max(F.when(has(TOP), F.col("text"))).alias("top"), F.max(F.when(has(LAST), F.col("text"))).alias("last"), F.sort_array(F.collect_list(F.when(F.col("label").isNotNull(), F.struct("k", "text", "label")))).alias("furn")
        )
        doc = Window.partitionBy("doc_id").orderBy("page")
        known = F.last("last", ignorenulls=True).over(doc.rowsBetween(Window.unboundedPreceding, -1))
        of = lambda c, label: F.filter(c, lambda x: x["label"] == label)["text"]
        foot = F.coalesce(F.lag("furn").over(doc), F.array().cast("array<struct<k:int,text:string,label:string>>"))
        seams = by.select("doc_id", "top", known.alias("before"), "furn", foot.alias("foot")).where("top is not null and before is not null and size(furn) + size(foot) > 0")
        opening = F.array_compact(F.array(*[F.get(of(c, label), F.lit(0)) for c in ("furn", "foot") for label in ("header", "pageno")]))
        both = F.concat("furn", "foot")
        seams = seams.select("doc_id", "top", "before", of(both, "header").alias("heads"), of(both, "pageno").alias("numbers"), F.explode(F.array_distinct(opening)).alias("first")).distinct()
        heads = by.select("doc_id", of(F.col("furn"), "header").alias("heads")).where(F.size("heads") >= LONG_LINE).distinct()
        heads = heads.select("doc_id", F.lit(None).cast("string").alias("top"), F.get("heads", F.lit(0)).alias("before"), "heads", F.array().cast("array<string>").alias("numbers"), F.get("heads", F.lit(1)).alias("first"))
        printed = by.select("doc_id", F.array_join(of(F.col("furn"), "pageno"), " ").alias("number")).where("number <> ''").distinct()
        t = self.flat.select("doc_id", "pos", F.posexplode("ts").alias("k", "before"), "ts").select("doc_id", "pos", "k", "before", F.get("ts", F.col("k") + 1).alias("first")).where("first is not null")
        hits = t.join(small(cut(seams.unionByName(heads))), ["doc_id", "before", "first"])
        hits = cut(hits).join(self.flat, ["doc_id", "pos"])
        lines = hits.where(F.col("top").isNull() & (F.slice("ts", F.col("k") + 1, F.size("heads")) == F.col("heads")))
        behind = F.transform(F.sequence(F.lit(1), F.lit(LONG_LINE)), lambda n: F.array_join(F.slice("ts", F.col("k") + F.size("heads") + 1, n), " "))
        lines = lines.select("doc_id", "pos", "k", F.size("heads").alias("g"), F.explode(F.array_distinct(F.concat(F.array(F.lit("")), behind))).alias("number"))
        numbers = lines.where("number <> ''").join(printed, ["doc_id", "number"]).withColumn("g", F.col("g") + F.size(F.split("number", " "))).select("doc_id", "pos", "k", "g", F.array(F.lit("header"), F.lit("pageno")).alias("noise"))
        lines = lines.where("number = ''").select("doc_id", "pos", "k", "g", F.array(F.lit("header")).alias("noise")).unionByName(numbers)
        hits = hits.where("top is not null")
        furn = F.concat("heads", "numbers")
        gap = lambda g: F.slice("ts", F.col("k") + 2, g)
        fits = F.filter(F.sequence(F.lit(1), F.size(furn)), lambda g: (F.get("ts", F.col("k") + 1 + g) == F.col("top")) & F.forall(gap(g), lambda x: F.array_contains(furn, x)))
        hits = hits.withColumn("g", F.get(fits, F.lit(0))).where("g is not null")
        held = gap(F.col("g"))
        kind = lambda a, b: F.exists(held, lambda x: F.array_contains(a, x) & ~F.array_contains(b, x))
        noise = F.array_compact(F.array(F.when(kind("heads", "numbers"), F.lit("header")), F.when(kind("numbers", "heads"), F.lit("pageno"))))
        self.seams = cut(hits.select("doc_id", "pos", (F.col("k") + 1).alias("k"), "g", noise.alias("noise")).unionByName(lines).distinct())
        gone = self.seams.groupBy("doc_id", "pos").agg(F.collect_set(F.struct("k", "g")).alias("gone"))
        kept = F.filter("ts", lambda x, i: ~F.exists("gone", lambda s: (i >= s["k"]) & (i < s["k"] + s["g"])))
        self.units = self.flat.join(gone, ["doc_id", "pos"], "left").select("doc_id", "pos", F.when(F.col("gone").isNull(), F.col("ts")).otherwise(kept).alias("ts"))

    def _ends(self) -> None:
        """Divided words of words and units: (tab, doc_id, page, pos, k, text, next, next_pos); pos or, in units, k + 1 tells the second half."""
        e = self.body.where(has(FIRST)).select("doc_id", "page", "pos", "text", F.col("after").alias("next"), F.col("after_pos").alias("next_pos"))
        tops = self.body.where(has(TOP)).select("doc_id", (F.col("page") - 1).alias("page"), F.col("text").alias("t"), F.col("pos").alias("p"))
        turned = e.where("next is null").join(tops, ["doc_id", "page"], "left").select("doc_id", "page", "pos", "text", F.col("t").alias("next"), F.col("p").alias("next_pos"))
        e = e.where("next is not null").unionByName(turned).select(F.lit("words").alias("tab"), "doc_id", "page", "pos", F.lit(None).cast("int").alias("k"), "text", "next", "next_pos")
        u = self.units.select("doc_id", "pos", "ts", F.posexplode("ts").alias("k", "text")).where(ends_divided(F.col("text"))).withColumn("next", F.get("ts", F.col("k") + 1)).where("next is not null")
        u = u.select(F.lit("units").alias("tab"), "doc_id", F.lit(None).cast("int").alias("page"), "pos", "k", "text", "next", F.lit(None).cast("int").alias("next_pos"))
        self.ends = cut(e.unionByName(u))

    def unit_tokens(self) -> DataFrame:
        """Tokens of units without furniture: (doc_id, pos, k, text)."""
        return self.units.select("doc_id", "pos", F.posexplode("ts").alias("k", "text"))

    def _vocabulary(self) -> None:
        """Words and their counts, the corrections of misread words and tokens, and the judged pairs of halves.

        Tokens are counted as they stand, less the halves of divided words; all else is done once for each different token.
        """
        spark = self.ends.sparkSession
        one = lambda df, c, n: df.select(F.col(c).alias("text"), F.lit(n).cast("bigint").alias("n"))
        seen = one(self.body, "text", 1).unionByName(one(self.unit_tokens(), "text", 1)).unionByName(one(self.ends.where("next is not null"), "next", -1))
        raw = seen.groupBy("text").agg(F.sum("n").alias("n")).where("n > 0").where(~ends_divided(F.col("text")))
        self.raw = cut(raw.select("text", "n", bare(F.col("text")).alias("tok")).where("tok <> ''"))
        forms = self.raw.groupBy("tok").agg(F.sum("n").alias("n"))
        pairs = cut(hyphen_pairs(self.ends.where("next is not null").select("text", "next").distinct(), "text", "next"))
        made = pairs.select(F.explode(F.array("joined", "compound")).alias("word")).distinct().withColumn("n", F.lit(0).cast("bigint"))
        known = cut(forms.select(F.lower("tok").alias("word"), "n").unionByName(made).groupBy("word").agg(F.sum("n").alias("n")).repartition(spark.sparkContext.defaultParallelism))
        usual = known.where("n >= 1 and length(word) >= 2")
        rare = known.where(F.col("word").rlike(r"\p{L}") & (F.length("word") >= 2) & ~F.col("word").rlike(r"^\d+(st|nd|rd|th)$"))
        right = corrections(rare, usual)
        self.lexicon = cut(known.join(right.select("word", "right"), "word", "left"))
        words = forms.withColumn("word", F.lower("tok")).join(self.lexicon.where("right is not null").select("word", "right"), "word").select("tok", cased(F.col("right"), F.col("tok")).alias("right"))
        # A token that can be a number is one.
        numbers = number_corrections(forms)
        bad = words.withColumn("number", F.lit(False)).unionByName(numbers.withColumn("number", F.lit(True))).groupBy("tok").agg(F.max_by("right", F.struct("number", "right")).alias("right"))
        # By the token as it stands, so that no other token is looked at.
        self.bad = small(cut(self.raw.join(bad, "tok").select("text", F.replace(F.col("text"), F.col("tok"), F.col("right")).alias("right"))))
        self.pairs = cut(self._judged(pairs))

    def _judged(self, pairs: DataFrame) -> DataFrame:
        """Pairs of halves with is_break, whether either half is misread (bad1, bad2), and what they make together.

        The four words of a pair (joined, compound, both halves) are looked up at once.
        """
        roles = ("joined", "compound", "w1", "w2")
        asked = pairs.select("text", "next", F.explode(F.array(*[F.struct(F.lit(r).alias("role"), F.col(r).alias("word")) for r in roles])).alias("a")).select("text", "next", "a.role", "a.word")
        got = asked.join(self.lexicon, "word").groupBy("text", "next").agg(*[F.max(F.when(F.col("role") == r, F.col(c))).alias(f"{c}_{r}") for r in roles for c in ("n", "right")])
        p = pairs.join(got, ["text", "next"], "left")
        n = lambda c: F.coalesce(F.col(f"n_{c}"), F.lit(0))
        compound = (n("compound") > n("joined")) | (n("joined") == 0) & F.col("right_compound").isNotNull() & F.col("right_joined").isNull()
        known = (n("joined") > 0) | F.col("right_joined").isNotNull()
        suspended = F.col("w2").isin(CONJUNCTIONS) & ~known
        both = (n("w1") >= 5) & (n("w2") >= 5) & (F.length("w1") >= 3) & (F.length("w2") >= 3)
        is_break = F.when(F.col("w2") == "", False).when(compound, False).when(known, True).when(suspended, False).when(both, False).otherwise(True)
        right = F.when(compound, F.col("right_compound")).otherwise(F.col("right_joined"))
        whole = F.when(compound, F.col("compound")).otherwise(F.col("joined"))
        bad1 = F.coalesce(~right.startswith(F.col("w1")), F.lit(False))
        bad2 = F.coalesce(~right.endswith(F.col("w2")), F.lit(False))
        return p.select("text", "next", "w1", "w2", "compound", F.col("right_compound"), is_break.alias("is_break"), (~compound & suspended).alias("suspended"), bad1.alias("bad1"), bad2.alias("bad2"), F.coalesce(right, whole).alias("whole"))

    def found(self) -> DataFrame:
        """(tab, doc_id, pos, noise) of every case."""
        row = lambda df, tab, noise, pos="pos": df.select(F.lit(tab).alias("tab") if tab else F.col("tab"), "doc_id", F.col(pos).alias("pos"), noise.alias("noise"))
        furn = row(self.layout.where("label is not null"), "words", F.col("label"))
        inside = row(self.seams, "units", F.explode("noise"))
        e = self.ends.join(self.pairs.select("text", "next", "is_break", "bad1", "bad2").where("is_break or bad1 or bad2"), ["text", "next"])
        case = lambda ok, pos, noise: F.when(ok, F.struct(pos.alias("pos"), F.lit(noise).alias("noise")))
        cases = F.array_compact(F.array(case(F.col("is_break"), F.col("pos"), "break"), case(F.col("bad1"), F.col("pos"), "glyph"), case(F.col("bad2"), F.coalesce("next_pos", "pos"), "glyph")))
        halves = e.select("tab", "doc_id", F.explode(cases).alias("c")).select("tab", "doc_id", "c.pos", "c.noise")
        bad = self.bad.select("text")
        whole = self.body.select("doc_id", "pos", "text").join(bad, "text", "left_semi").join(self.ends.where("tab = 'words' and next_pos is not null").select("doc_id", F.col("next_pos").alias("pos")), ["doc_id", "pos"], "left_anti")
        units = self.unit_tokens().join(bad, "text", "left_semi").join(self.ends.where("tab = 'units'").select("doc_id", "pos", (F.col("k") + 1).alias("k")), ["doc_id", "pos", "k"], "left_anti")
        misread = [row(df, tab, F.lit("glyph")) for df, tab in ((whole, "words"), (units, "units"))]
        return furn.unionByName(inside).unionByName(halves).unionByName(misread[0]).unionByName(misread[1]).distinct()

    def _glued(self, rows: DataFrame) -> DataFrame:
        """rows (text, next, taken, ...) with glue, what each token gives to its paragraph, and merged: it gives its second half too.

        A word is set right as a whole at its first half; halves whose signs stand between them, and words divided more than
        once, are only put together.
        """
        plain = F.regexp_replace(_strip_hyphen(F.col("text")), _OPENING, "")
        after = bare(F.col("next"))
        made = F.when(F.col("is_break"), F.col("whole")).otherwise(F.coalesce("right_compound", "compound"))
        seen = F.when(F.col("is_break"), F.concat(plain, after)).otherwise(F.concat(plain, F.lit("-"), after))
        begins = F.regexp_extract("text", _OPENING, 0)
        closes = F.substring("next", F.length(after) + 1, F.length("next"))
        pairs = self.pairs.withColumn("merged", merges()).select("text", "next", "is_break", "suspended", "w2", "merged", F.when(merges(), F.concat(begins, cased(made, seen), closes, F.lit(" "))).alias("made"))
        # Only first halves meet the pairs; the other words stay where they are.
        halves = rows.where("next is not null").join(pairs, ["text", "next"], "left")
        rows = rows.where("next is null").unionByName(halves, allowMissingColumns=True).join(self.bad, "text", "left")
        right = F.when(F.col("right").isNull() | F.col("half"), F.col("text")).otherwise(F.col("right"))
        apart = F.col("is_break").isNull() | F.col("suspended") | (F.col("w2") == "")
        glue = F.when(F.col("taken"), F.lit("")).when(F.col("merged"), F.col("made")).when(apart, F.concat(right, F.lit(" "))).when(F.col("is_break"), _strip_hyphen(right)).otherwise(right)
        return rows.withColumn("merged", F.coalesce("merged", F.lit(False)) & ~F.col("taken")).withColumn("glue", glue)

    def paragraphs(self) -> DataFrame:
        """(doc_id, page, para, text): repaired paragraphs in reading order, numbered by document; page is the one they begin on.

        A paragraph begins at an indented line or after a wider gap. The first line of a page goes on with the paragraph of the
        page before unless it is indented, or a heading behind a finished sentence; the halves of a word divided there always
        meet. Divided words are joined, misread words, divided ones included, corrected.
        """
        e = self.ends.where("tab = 'words'").select("doc_id", "pos", "text", "next", "next_pos")
        taken = e.join(self.pairs.where(merges()).select("text", "next"), ["text", "next"], "left_semi").where("next_pos is not null").select("doc_id", F.col("next_pos").alias("pos"), F.lit(True).alias("taken")).distinct()
        behind = e.where("next_pos is not null").select("doc_id", F.col("next_pos").alias("pos"), F.lit(True).alias("half")).distinct()
        words = self.body.select("doc_id", "page", "k", "nth", "pos", "text", "flags", has(UPPER).alias("upper"))
        # Only line ends and what follows them meet the pairs.
        seldom = words.where(has(FIRST | SECOND | TOP)).join(e.select("doc_id", "pos", "next"), ["doc_id", "pos"], "left").join(taken, ["doc_id", "pos"], "left").join(behind, ["doc_id", "pos"], "left")
        rows = words.where(~has(FIRST | SECOND | TOP)).unionByName(seldom, allowMissingColumns=True).withColumns({c: F.coalesce(c, F.lit(False)) for c in ("taken", "half")}).withColumn("next", F.col("next").cast("string"))
        fixed = self._glued(rows)
        ws = fixed.groupBy("doc_id", "page", "nth").agg(F.sort_array(F.collect_list(F.struct("k", "glue", "text", "merged", "upper"))).alias("ws"))
        last = F.element_at("ws", -1)
        parts = ws.select(
            "doc_id", "page", "nth", F.array_join(F.col("ws.glue"), "").alias("text"), F.struct(last["text"].alias("text"), last["merged"].alias("merged")).alias("last"),
            F.transform(F.filter("ws", lambda w: w["upper"]), lambda w: w["text"]).alias("upper"),
        )
        parts = cut(parts)
        pages = parts.groupBy("doc_id", "page").agg(F.max("nth").alias("n"), F.min("nth").alias("indented"), F.max_by("last", "nth").alias("last"), F.min_by("upper", "nth").alias("upper"))
        doc = Window.partitionBy("doc_id").orderBy("page")
        pages = pages.withColumn("last", F.lag("last").over(doc))
        begin = F.array_join(F.slice("upper", 1, 2), " ")
        heading = begin.rlike(r"^\d+(?:\.\d+)*\.? \p{Lu}") | (F.size("upper") <= 4) & begin.rlike(r"^\p{Lu}") & ~F.element_at("upper", -1).rlike(_CLOSED)
        goes_on = F.col("last").isNotNull() & (ends_divided(F.col("last.text")) | (F.col("indented") == 0) & ~(F.col("last.text").rlike(_CLOSED) & heading))
        pages = pages.withColumn("joins", F.when(goes_on, 1).otherwise(0)).withColumn("own", F.col("n") - F.col("indented") + 1)
        base = F.sum(F.col("own") - F.col("joins")).over(doc.rowsBetween(Window.unboundedPreceding, 0)) - F.col("own")
        pages = pages.select("doc_id", "page", "indented", base.alias("base"))
        paras = parts.select("doc_id", "page", "nth", "text").join(pages, ["doc_id", "page"]).select("doc_id", "page", (F.col("base") + F.col("nth") - F.col("indented")).alias("para"), "text")
        text = F.trim(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page", "text"))), lambda x: x["text"]), ""))
        return paras.groupBy("doc_id", "para").agg(F.min("page").alias("page"), text.alias("text")).select("doc_id", "page", "para", "text")

    def repaired_units(self) -> DataFrame:
        """(doc_id, pos, text): the units of scanned documents without furniture, their words joined and corrected; units without text give none."""
        e = self.ends.where("tab = 'units'").select("doc_id", "pos", "k", "text", "next")
        joined = e.join(self.pairs.where(merges()).select("text", "next", F.lit(True).alias("taken")), ["text", "next"], "left")
        behind = joined.select("doc_id", "pos", (F.col("k") + 1).alias("k"), "taken", F.lit(True).alias("half"))
        t = self.unit_tokens().join(e.drop("text"), ["doc_id", "pos", "k"], "left").join(behind, ["doc_id", "pos", "k"], "left")
        rows = t.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("taken", "half")})
        fixed = self._glued(rows)
        text = F.trim(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "glue"))), lambda x: x["glue"]), ""))
        return fixed.groupBy("doc_id", "pos").agg(text.alias("text"))


def merges() -> Column:
    """Of a judged pair: whether both halves come out as one word at the place of the first."""
    after = bare(F.col("next"))
    return (F.col("w2") != "") & ~F.col("suspended") & F.startswith(F.col("next"), after) & ~ends_divided(F.col("next"))


def hyphen_pairs(rows: DataFrame, first: str, second: str) -> DataFrame:
    """rows with the parts of a divided word: w1, w2, joined and compound."""
    w1 = F.lower(F.regexp_replace(_strip_hyphen(F.col(first)), _OPENING, ""))
    w2 = core(F.col(second))
    return rows.withColumn("w1", w1).withColumn("w2", w2).withColumn("joined", F.concat("w1", "w2")).withColumn("compound", F.concat("w1", F.lit("-"), "w2"))
