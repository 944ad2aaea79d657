"""Evaluation texts leaking into training text.

A generalised suffix automaton over the words of the normalised test items is built once, packed into flat arrays and sent to
the workers (the items are a fixed, size-checked set); training tokens stream through it, and maximal matches are gathered per
item. An exact alignment of the item with the matched region then decides: the document must hold at least half of the item's
words in order, in one or two stretches, and in those stretches most of the words that tell the item from other items. Spans
beyond the limits of length or coverage can be removed.

Cases: null and empty texts leak nothing; items without words leak nowhere; documents that hold several items give one row
for each; repeated rows give equal results; texts of any length are streamed whole; removed spans leave one space.
"""

from __future__ import annotations

import re
import unicodedata
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Items beyond this size go through the corpus in several passes: an automaton takes some 110 bytes a byte while it is built
# on the driver, and a tenth of that in each worker.
MAX_ITEM_BYTES = 2 << 20
SEED = 3  # words of the shortest match that counts; shorter ones count where they hold a telling word
STRETCH = 4  # words of the shortest stretch
LENGTH = 50  # words beyond which a stretch is removed whatever its item's share
_WORD = re.compile(r"[^\W_]+")
_HIDDEN = re.compile("[\u00ad\u200b-\u200f\u2060-\u2064\ufeff\u034f]")
_MARKS = re.compile("[\u0300-\u036f]+")
_SPACED = {i: " " for i in range(128) if not chr(i).isalnum()}
_MIXED = re.compile("[A-Za-z][\u0430-\u0458]|[\u0430-\u0458][A-Za-z]")
_ALIKE = str.maketrans("аеорсухіѕј", "aeopcyxisj")


def words_of(text: str) -> list[str]:
    """Normalised words: compatibility forms, no accents, no case, no punctuation."""
    if text.isascii():
        return text.lower().translate(_SPACED).split()
    text = _MARKS.sub("", unicodedata.normalize("NFKD", _HIDDEN.sub("", text)))
    if _MIXED.search(text):
        text = re.sub(r"\w*[A-Za-z]\w*", lambda m: m.group().translate(_ALIKE), text)
    return _WORD.findall(text.lower())


def word_spans(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    """The words of a text and, for each, where the piece between white space that holds it begins and ends."""
    words: list[str] = []
    at: list[tuple[int, int]] = []
    for m in re.finditer(r"\S+", text):
        got = words_of(m.group())
        words += got
        at += [m.span()] * len(got)
    return words, at


def telling_limit(items: int) -> int:
    """In how many of so many items a word may stand and still tell them from others."""
    return max(3, items // 60)


class LeakIndex:
    """Generalised suffix automaton of the items, with occurrences.

    few: the words that stand in few of all items, where these items are but a part of them.
    """

    def __init__(self, items: list[tuple[int, str]], few: set[str] | None = None) -> None:
        self.items = {i: w for i, t in items if t and (w := words_of(t))}
        self.vocab: dict[str, int] = {}
        df: Counter = Counter()
        for ws in self.items.values():
            df.update(set(ws))
            for w in ws:
                self.vocab.setdefault(w, len(self.vocab))
        # Words that tell an item from others; numbers only where an item has no others.
        few = {w for w, n in df.items() if n <= telling_limit(len(self.items))} if few is None else few
        self.rare = set()
        for ws in self.items.values():
            own = {w for w in ws if w in few}
            self.rare |= {w for w in own if not w.isdigit()} or own or set(ws)
        self.tells = bytearray(w in self.rare for w in self.vocab)
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = array("i", [-1]), array("i", [0])
        own: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for i, ws in self.items.items():
            last = 0
            for p, w in enumerate(ws):
                last = self._extend(last, self.vocab[w])
                own[last].append((i, p))
        # Occurrences of a state are its own and those of the states that link to it: a tree, walked where a match ends.
        self.at = dict(own)
        self.below: dict[int, list[int]] = defaultdict(list)
        for s in range(1, len(self.link)):
            if self.link[s] > 0:
                self.below[self.link[s]].append(s)
        self.below = dict(self.below)
        # Most states have one way on: two arrays hold those, and only the others keep a table.
        self.one_word, self.one_state = array("i", [-1]) * len(self.next), array("i", [-1]) * len(self.next)
        self.many: dict[int, dict[int, int]] = {}
        for s, ways in enumerate(self.next):
            if len(ways) == 1:
                ((self.one_word[s], self.one_state[s]),) = ways.items()
            elif ways:
                self.many[s] = ways
        del self.next

    def _step(self, s: int, c: int) -> int:
        """The state behind a word, or -1."""
        if self.one_word[s] == c:
            return self.one_state[s]
        ways = self.many.get(s)
        return -1 if ways is None else ways.get(c, -1)

    def _extend(self, last: int, c: int) -> int:
        nx, link, ln = self.next, self.link, self.len
        if c in nx[last]:
            q = nx[last][c]
            if ln[q] == ln[last] + 1:
                return q
            return self._clone(last, c, q)
        cur = self._state(ln[last] + 1)
        p = last
        while p != -1 and c not in nx[p]:
            nx[p][c] = cur
            p = link[p]
        if p == -1:
            link[cur] = 0
        else:
            q = nx[p][c]
            link[cur] = q if ln[q] == ln[p] + 1 else self._clone(p, c, q)
        return cur

    def _clone(self, p: int, c: int, q: int) -> int:
        k = self._state(self.len[p] + 1)
        self.next[k] = dict(self.next[q])
        self.link[k] = self.link[q]
        self.link[q] = k
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = k
            p = self.link[p]
        return k

    def _state(self, length: int) -> int:
        self.next.append({})
        self.link.append(-1)
        self.len.append(length)
        return len(self.len) - 1

    def segments(self, ids: list[int | None]) -> dict[int, list[tuple[int, int, int]]]:
        """By item: maximal matches (document end, item end, length) of at least SEED words or with a telling one."""
        step, link, ln, tells = self._step, self.link, self.len, self.tells
        found: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        s = length = 0
        told = -1  # where the last telling word stands
        for k, c in enumerate(ids):
            t = -1 if c is None else step(s, c)
            if t < 0:
                if length and (length >= SEED or told >= k - length):
                    self._note(found, k, s, length)
                if c is None:
                    s = length = 0
                    continue
                while s and t < 0:
                    s = link[s]
                    length = ln[s]
                    t = step(s, c)
                if t < 0:
                    s = length = 0
                    continue
            s, length = t, length + 1
            if tells[c]:
                told = k
        if length and (length >= SEED or told >= len(ids) - length):
            self._note(found, len(ids), s, length)
        return found

    def _note(self, found: dict, k: int, s: int, length: int) -> None:
        walk = [s]
        while walk:
            s = walk.pop()
            for i, p in self.at.get(s, ()):
                found[i].append((k - 1, p, length))
            walk.extend(self.below.get(s, ()))

    def stretches(self, text: str | None, tell: float = 0.5) -> Iterator[tuple[int, list[tuple]]]:
        """(item, its stretches) of every item of which the text holds telling words; a stretch is (item begin, item end, words,
        telling words matched and there, first and last word in the text)."""
        ws = words_of(text) if text else []
        if tell > 0 and self.rare.isdisjoint(ws):  # no telling word at all
            return
        get = self.vocab.get
        for item, segs in self.segments([get(w) for w in ws]).items():
            spans = [x for x in self._align(ws, self.items[item], segs) if x[2] >= STRETCH and x[3] >= 0.5 * x[4]]
            if spans:
                yield item, spans

    def leaks(self, text: str | None, share: float = 0.5, tell: float = 0.5) -> list[tuple[int, float, float]]:
        """(item, share of its words, share of its telling words in the matched stretches) for every item held by the text."""
        return [(item, got[0][0] / len(self.items[item]), got[0][1] / max(1, got[0][2])) for item, got in self._held(text, share, tell)]

    def _held(self, text: str | None, share: float, tell: float) -> Iterator[tuple[int, tuple]]:
        for item, spans in self.stretches(text, tell):
            got = _best_stretches(spans)
            if got and got[0][0] >= share * len(self.items[item]) and got[0][1] >= tell * max(1, got[0][2]):
                yield item, got

    def spans(self, text: str | None, share: float = 0.5, tell: float = 0.5, length: int = LENGTH) -> list[tuple[int, int, int, int, float]]:
        """(item, begin, end, words, share of the item) of every stretch beyond a limit, as offsets in the text.

        The stretches of an item that leaked are beyond the limit of coverage, any other of ``length`` words beyond that of
        length. The walk over the text is that of leaks().
        """
        over: dict[int, set[tuple]] = defaultdict(set)
        for item, spans in self.stretches(text, tell):
            got = _best_stretches(spans)
            if got and got[0][0] >= share * len(self.items[item]) and got[0][1] >= tell * max(1, got[0][2]):
                over[item].update(got[1])
            over[item].update(x for x in spans if x[2] >= length)
        if not any(over.values()):
            return []
        _, at = word_spans(text)
        return [(item, at[x[5]][0], at[x[6]][1], x[2], x[2] / len(self.items[item])) for item, some in over.items() for x in sorted(some, key=lambda x: x[5])]

    def _align(self, ws: list[str], iw: list[str], segs: list[tuple[int, int, int]]) -> list[tuple]:
        """Stretches of the document that follow the item: matches near one diagonal are one stretch."""
        chains: list[list[tuple[int, int, int]]] = []
        near: list[list[tuple[int, int, int]]] = []  # those whose end is not yet out of reach
        for d, p, l in sorted({(k - l + 1, p - l + 1, l) for k, p, l in segs}):
            near = [ch for ch in near if d - (ch[-1][0] + ch[-1][2]) <= 12]
            best = None
            for ch in near:
                d0, p0, l0 = ch[-1]
                gap_d, gap_p = d - (d0 + l0), p - (p0 + l0)
                if -3 <= gap_d and -3 <= gap_p <= 12 and d >= d0 and p > p0 and abs(gap_d - gap_p) <= 6 and (best is None or ch[-1][0] > best[-1][0]):
                    best = ch
            if best is None:
                chains.append([(d, p, l)])
                near.append(chains[-1])
            else:
                best.append((d, p, l))
        return [self._score(ws, iw, ch[0][0], ch[0][1], ch[-1][0] + ch[-1][2], ch[-1][1] + ch[-1][2]) for ch in chains]

    def _score(self, ws: list[str], iw: list[str], d0: int, p0: int, d1: int, p1: int) -> tuple:
        """A stretch grown over a few changed words at its ends."""
        d0, p0 = self._grow(ws, iw, d0, p0, -1)
        d1, p1 = self._grow(ws, iw, d1 - 1, p1 - 1, 1)
        a, b = iw[p0 : p1 + 1], ws[d0 : d1 + 1]
        hit = _common(a, b)
        rare = self.rare
        return p0, p1 + 1, sum(hit), sum(h and w in rare for h, w in zip(hit, a)), sum(w in rare for w in a), d0, d1

    @staticmethod
    def _grow(ws: list[str], iw: list[str], d: int, p: int, step: int) -> tuple[int, int]:
        while True:
            for dd, pp in ((1, 1), (2, 2), (1, 2), (2, 1), (2, 3), (3, 2), (3, 3)):
                x, y = d + step * dd, p + step * pp
                if 0 <= x < len(ws) and 0 <= y < len(iw) and ws[x] == iw[y]:
                    d, p = x, y
                    break
            else:
                return d, p


def _best_stretches(spans: list[tuple]) -> tuple[tuple[int, int, int], tuple[tuple, ...]] | None:
    """Words matched, telling words matched and there, of the best one or two stretches that meet in at most two words of the
    item, and the stretches.

    A stretch is paired with the best of those that end before it begins: sorted by item end, one running maximum holds for
    all of them, however many stretches there are. Of equal matches the one with more telling words counts.
    """
    value = lambda t: (t[0][0], t[0][1] / max(1, t[0][2]))
    one = lambda x: (tuple(x[2:5]), (x,))
    ends = sorted(spans, key=lambda x: x[1])
    best = first = None
    k = 0
    for y in sorted(spans, key=lambda x: x[0]):
        while k < len(ends) and ends[k][1] <= y[0] + 2:
            first = max(filter(None, (first, one(ends[k]))), key=value)
            k += 1
        pair = None if first is None else (tuple(a + b for a, b in zip(first[0], y[2:5])), (*first[1], y))
        best = max(filter(None, (best, one(y), pair)), key=value)
    return best


def _best_pair(spans: list[tuple]) -> tuple[int, int, int] | None:
    """The figures of the best one or two stretches."""
    best = _best_stretches(spans)
    return best and best[0]


def _common(a: list[str], b: list[str]) -> list[bool]:
    """Which words of a are in a longest common subsequence with b.

    A row of the table is one number with a bit for each word of b, so a row costs a few operations on it; the rows are kept
    to find the words from the end.
    """
    where: dict[str, int] = defaultdict(int)
    for j, y in enumerate(b):
        where[y] |= 1 << j
    full = (1 << len(b)) - 1
    row, rows = full, []
    for x in a:
        met = row & where.get(x, 0)
        row = ((row + met) | (row - met)) & full
        rows.append(row)
    hit, i, j = [False] * len(a), len(a), len(b)
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:  # nothing gained by this word of b
            j -= 1
        elif i > 1 and not rows[i - 2] >> (j - 1) & 1:  # gained before this word of a
            i -= 1
        else:
            hit[i - 1] = True
            i, j = i - 1, j - 1
    return hit


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(i, w) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if t for w in set(words_of(t))]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([w for _, w in rows], pa.string())], names=["item_id", "word"])


def _indexes(items: DataFrame, most: int) -> Iterator[LeakIndex]:
    """Automata of the items, of at most some ``most`` bytes each; words that tell items apart are counted over all items."""
    items = items.select("item_id", "text").where("text is not null").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = int(total // most) + 1
    if passes == 1:
        yield LeakIndex([(r.item_id, r.text) for r in items.toLocalIterator()])
        return
    from vellumine.session import cut

    words = cut(items.mapInArrow(_item_words, "item_id bigint, word string").distinct())
    count = words.select("item_id").distinct().count()
    few = cut(words.groupBy("word").count().where(F.col("count") <= telling_limit(count)).select("word"))
    for k in range(passes):
        mine = F.pmod(F.xxhash64("item_id"), F.lit(passes)) == k
        own = {r.word for r in words.where(mine).select("word").distinct().join(few, "word", "left_semi").toLocalIterator()}
        yield LeakIndex([(r.item_id, r.text) for r in items.where(mine).toLocalIterator()], own)


def _over(documents: DataFrame, items: DataFrame, most: int, schema: str, rows) -> DataFrame:  # noqa: ANN001
    """The documents' texts through every automaton: rows(index, text) gives what stands behind the document's id."""
    docs = documents.select("doc_id", "text").where("text is not null and text <> ''")
    found = None
    for index in _indexes(items, most):
        one = docs.mapInArrow(_stream(documents.sparkSession.sparkContext.broadcast(index), schema, rows), schema)
        found = one if found is None else found.unionByName(one)
    return found


def leak_rows(documents: DataFrame, items: DataFrame, share: float = 0.5, tell: float = 0.5, most: int = MAX_ITEM_BYTES) -> DataFrame:
    """(doc_id, item_id, share, tell): every document that holds a passage of a test item, and how much of it.

    The items are read to the driver only behind a check of their size; a larger set goes through the corpus in several
    passes, so no item and no document is left out.
    """
    return _over(documents, items, most, "doc_id bigint, item_id bigint, share double, tell double", lambda index, text: index.leaks(text, share, tell))


def leak_spans(documents: DataFrame, items: DataFrame, share: float = 0.5, tell: float = 0.5, length: int = LENGTH, most: int = MAX_ITEM_BYTES) -> DataFrame:
    """(doc_id, item_id, begin, end, words, share): the stretches of test items beyond a limit, as offsets in code points."""
    return _over(documents, items, most, "doc_id bigint, item_id bigint, begin int, end int, words int, share double", lambda index, text: index.spans(text, share, tell, length))


def without_leaks(documents: DataFrame, items: DataFrame, share: float = 0.5, tell: float = 0.5, length: int = LENGTH, most: int = MAX_ITEM_BYTES) -> DataFrame:
    """documents with the column cleaned: the text without the spans of leak_spans, one space in place of each run of them."""
    spans = leak_spans(documents, items, share, tell, length, most).groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("begin", "end"))).alias("__leak_spans"))
    text = F.col("text")
    start = F.struct(F.lit("").alias("s"), F.lit(0).alias("at"))
    fold = F.aggregate(
        F.coalesce("__leak_spans", F.array().cast("array<struct<begin:int,end:int>>")),
        start,
        lambda acc, x: F.when(x["end"] <= acc["at"], acc)
        .when(x["begin"] <= acc["at"], F.struct(acc["s"].alias("s"), x["end"].alias("at")))
        .otherwise(F.struct(F.concat(acc["s"], F.rtrim(text.substr(acc["at"] + 1, x["begin"] - acc["at"])), F.lit(" ")).alias("s"), x["end"].alias("at"))),
        lambda acc: F.when(acc["at"] == 0, text).otherwise(F.trim(F.concat(acc["s"], F.ltrim(text.substr(acc["at"] + 1, F.length(text)))))),
    )
    return documents.join(spans, "doc_id", "left").withColumn("cleaned", fold).drop("__leak_spans")


_KINDS = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64()}


def _stream(index, schema: str, rows):  # noqa: ANN001
    fields = [f.split() for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = index.value  # read once by a worker process, not once a task
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            out = [(d, *x) for d, t in zip(ids, batch.column("text").to_pylist()) for x in rows(automaton, t)]
            cols = list(zip(*out)) if out else [()] * len(fields)
            yield pa.RecordBatch.from_arrays([pa.array(c, _KINDS[kind]) for c, (_, kind) in zip(cols, fields)], names=[name for name, _ in fields])

    return run
