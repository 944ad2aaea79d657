"""Sentence boundaries across languages and scripts.

A pushdown automaton reads only the signs that can matter (terminators, quotes, brackets, line breaks, spaces of scripts
without terminators). Its stack holds the open quotations and brackets; an abbreviation trie and rules for numbers, initials
and list marks decide about full stops. Offsets are code points of the given text; invisible characters are transparent.

Cases: null and empty texts have no sentences; a text without a terminator is one sentence; unbalanced quotes and brackets
count as ordinary characters; repeated rows give repeated results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa

# Abbreviations that never end a sentence when a capital follows, by language, without their last full stop.
NEVER_END = """
dr prof mr mrs ms st vs cf e.g i.e approx no nos fig figs eq eqs sec secs tab tabs vol vols pp p ed eds ref refs chap ch
dept gen col capt lt sgt rev hon messrs mt ft jan feb mar apr jun jul aug sept oct nov dec viz resp esp incl al s.d u.s u.k u.n
abb nr fa bzw vgl ca z.b d.h u.a s.o s.u o.ä i.d.r bd hr fr frl hrsg str tel ggf evtl sog inkl zzgl max min mind allg
m mm mme mlle mlles dra sr sra srta d dña ud uds núm pág págs art av avda fig. p.ej ej ee.uu ee uu env c.-à-d c.-a-d ex
проф рис табл т.е т.к т.д т.п см ср им ул г-н г-жа акад доц напр стр гл
डॉ श्री प्रो कु सं चि
أ.د د أ م ص
""".split()
# Abbreviations after which a sentence ends when a capital follows.
MAY_END = "etc usw usf a.m p.m inc ltd co corp jr sr u.s u.k u.n u.s.a ph.d гг г руб млн тыс др пр min sec hr hrs".split()
# Words that open a sentence and are hardly ever names, for stops after acronyms and initials.
STARTERS = set(
    "the this that these those a an in on at it its he she we they you there here one two both each all no not if when while although because since for from with by to as our their his her what which who why how where is are was were do does did and but or yet however "
    "der die das ein eine es er sie wir im am in auf bei nach für und aber le la les un une il elle nous on dans pour el los las una en se y".split()
)
# German words after which a number with a full stop is an ordinal.
ORDINAL_BEFORE = set("der die das dem den des am im vom zum zur beim ins jeder jede jedes jedem jeden dieser diese dieses diesem diesen einer eines einem einen seit bis ab ihr ihre seine unser".split())

TERMINATORS = ".!?…。！？｡．؟۔।॥։።"
WIDE = "。！？｡．"
OPEN = {"(": ")", "[": "]", "{": "}", "（": "）", "［": "］", "【": "】", "〔": "〕", "“": "”", "„": "“”", "«": "»", "「": "」", "『": "』", "《": "》", "〈": "〉", "‹": "›", "｢": "｣"}
CLOSERS = set("".join(OPEN.values()))
BRACKETS = set("([{（［【〔")
INVISIBLE = "\u00ad\u200b\u200c\u200d\u200e\u200f\u2060\u2061\u2062\u2063\ufeff\u180e\u034f\u202a\u202b\u202c\u202d\u202e\u2066\u2067\u2068\u2069"

_TOKEN = re.compile(r'[.!?…。！？｡．؟۔।॥։።]+|["“”„«»‹›「」『』｢｣《》〈〉(){}\[\]（）［］【】〔〕]|\n\s*\n\s*|(?<=[฀-๿])\s+(?=[฀-๿])')
_HIDDEN = re.compile(f"[{INVISIBLE}！-～]")
_NO_WORD = set("()[]{}\"“”„«»‹›,;:!?…。")
_NEXT_WORD = re.compile(r"[\s\"“„«‹(\[¿¡]*([^\W\d_]+)")
_CLOSING = set("\"”“’»›)]}」』｣》〉）］】〕'")


def _trie(words: list[str]) -> dict:
    root: dict = {}
    for w in words:
        node = root
        for c in reversed(w):
            node = node.setdefault(c, {})
        node[""] = True
    return root


_NEVER, _MAY = _trie(NEVER_END), _trie(MAY_END)


def _in_trie(trie: dict, s: str, end: int) -> bool:
    """Whether a word of the trie, standing alone, ends before ``end`` in the lower-case text s."""
    node, i = trie, end - 1
    while i >= 0 and s[i] in node:
        node = node[s[i]]
        if "" in node and (i == 0 or not (s[i - 1].isalnum() or s[i - 1] in ".'’-")):
            return True
        i -= 1
    return False


def _visible(text: str) -> tuple[str, list[int] | None]:
    """The text without invisible characters and with ASCII widths, and the offsets of its characters."""
    if not _HIDDEN.search(text):
        return text, None
    out, at = [], []
    for i, c in enumerate(text):
        if c in INVISIBLE:
            continue
        out.append(chr(ord(c) - 0xFEE0) if "０" <= c <= "９" or "Ａ" <= c <= "Ｚ" or "ａ" <= c <= "ｚ" or c == "．" else c)
        at.append(i)
    return "".join(out), at


_STRAIGHT = re.compile(r'"|\n\s*\n')


def _pairs(t: str) -> dict[int, int]:
    """Straight quotation marks that open, and where they close: by parity in their paragraph; an odd last one pairs with none."""
    pairs: dict[int, int] = {}
    opened = -1
    for m in _STRAIGHT.finditer(t):
        if m.group() != '"':
            opened = -1
        elif opened < 0:
            opened = m.start()
        else:
            pairs[opened] = m.start()
            opened = -1
    return pairs


def sentence_starts(text: str | None) -> list[int]:
    """Offsets of the first characters of the second and later sentences of a text."""
    if not text:
        return []
    t, at = _visible(text)
    cuts: list[int] = []
    low = t.lower()
    n = len(t)
    stack: list[tuple[str, int, bool]] = []  # closing signs, where it opened, whether it opened a sentence
    start = 0  # of the open sentence
    straight = _pairs(t) if '"' in t else {}
    thai = "฀" <= max(t) and any("฀" <= c <= "๿" for c in t)

    def cut(k: int) -> None:
        nonlocal start
        while k < n and t[k].isspace():
            k += 1
        if k < n and k > start and t[start:k].strip():
            cuts.append(k)
            start = k

    def starts_sentence(k: int, stop: str) -> bool:
        """Whether what stands at k, after a terminator and its closers, can begin a sentence."""
        j = k
        while j < n and t[j].isspace():
            j += 1
        if j >= n:
            return False
        c = t[j]
        while c in "\"'“„«‹‘¿¡([（「『【—–-•*" and j + 1 < n:
            j += 1
            while j < n and t[j].isspace():
                j += 1
            if j >= n:
                return False
            c = t[j]
        if c.isalpha():  # also words such as pH and mRNA
            return not c.islower() or j + 1 < n and t[j + 1].isupper()
        return c.isdigit() or c in "#§$€£+±~…"

    for m in _TOKEN.finditer(t):
        a, b = m.span()
        s = m.group()
        c = s[0]
        if c == "\n":
            if not stack:
                cut(b)
            continue
        if c.isspace():
            if thai and not stack:
                cut(b)
            continue
        if c in TERMINATORS:
            k = b
            if stack:
                continue
            while k < n and t[k] in _CLOSING and not (t[k] in "\"'“" and (k + 1 < n and t[k + 1].isalnum())) and t[k] not in OPEN:
                k += 1
            if _ends_sentence(t, low, a, k, s, start, starts_sentence):
                cut(k)
            continue
        # Quotes and brackets.
        if c == '"':
            if stack and stack[-1][0] == '"':
                c_close = True
            elif stack and any(x[0] == '"' for x in stack):
                while stack and stack[-1][0] != '"':
                    stack.pop()
                c_close = True
            else:
                c_close = False
        else:
            c_close = bool(stack) and c in stack[-1][0]
            if not c_close and c in CLOSERS and c not in OPEN:
                depth = next((i for i in range(len(stack) - 1, -1, -1) if c in stack[i][0]), None)
                if depth is None:
                    continue
                del stack[depth + 1 :]
                c_close = True
        if not c_close:
            if c not in OPEN and c != '"':
                continue
            close = OPEN.get(c, '"')
            nxt = straight.get(a, -1) if c == '"' else min((x for x in (t.find(q, b) for q in close) if x >= 0), default=-1)
            if nxt < 0 or "\n\n" in t[a:nxt]:
                continue
            if c in "([{" and a > start and t[a - 1].isalnum() and nxt - a < 4:
                stack.append((close, a, False))
                continue
            stack.append((close, a, not t[start:a].strip(" \t\n ¿¡—–-")))
            continue
        close, opened, first = stack.pop()
        if stack:
            continue
        k = b
        inner = t[opened + 1 : a].rstrip()
        if inner and inner[-1] in TERMINATORS:
            while k < n and t[k] in _CLOSING and t[k] not in OPEN and t[k] not in "\"'":
                k += 1
            wide = inner[-1] in WIDE or not t[opened].isascii() and "　" <= t[opened]
            if k < n and (t[k].isspace() or wide):
                if wide and not first:
                    continue
                if t[opened] in BRACKETS and not first:
                    continue
                if starts_sentence(k, inner[-1]) and not (inner[-1] == "." and _in_trie(_NEVER, low, opened + len(inner))):
                    cut(k)
        continue
    return cuts if at is None else [at[k] for k in cuts]


def _word_before(t: str, end: int) -> str:
    """The word that ends at an offset, however long."""
    i = end
    while i and not t[i - 1].isspace() and t[i - 1] not in _NO_WORD:
        i -= 1
    return t[i:end]


def _run_before(t: str, end: int) -> str:
    """What stands without white space before an offset."""
    i = end
    while i and not t[i - 1].isspace():
        i -= 1
    return t[i:end]


def _ends_sentence(t: str, low: str, a: int, k: int, s: str, start: int, starts_sentence) -> bool:  # noqa: ANN001
    n = len(t)
    if k >= n:
        return False
    c = s[-1]
    if any(x in WIDE for x in s) and (c != "．" or not t[k].isdigit()):
        return True
    if c in "।॥؟۔։።":
        return True
    gap = t[k].isspace()
    if c in "!?":
        return gap and starts_sentence(k, c) or (not gap and t[k].isupper() and t[a - 1 : a].islower())
    if len(s) > 1 or c == "…":
        return gap and starts_sentence(k, c)
    # One full stop.
    before = t[a - 1] if a else ""
    if not gap:
        # A missing space: "... to wear.Participants ..."
        if t[k].isupper() and k == a + 1 and before.islower() and k + 1 < n and (t[k + 1].islower() or t[k + 1].isspace()):
            w = _word_before(t, a)
            return len(w) > 2 and w.isalpha() and not _in_trie(_NEVER, low, a) and "://" not in _run_before(t, a)
        return False
    if not starts_sentence(k, "."):
        return False
    if t[a + 1 : k].strip():  # closers stand between: the stop is the sentence's own
        return True
    word = _word_before(t, a)
    nm = _NEXT_WORD.match(t, k)
    following = nm.group(1) if nm else ""
    if word and word.isdigit():
        if not t[start : a - len(word)].strip():  # list mark
            return False
        if len(word) <= 2 and following[:1].isupper():
            j = a - len(word)
            while j and t[j - 1].isspace():
                j -= 1
            if _run_before(t, j).lower() in ORDINAL_BEFORE:
                return False
        return True
    if _in_trie(_MAY, low, a):
        if _in_trie(_NEVER, low, a):
            return following.lower() in STARTERS and following[:1].isupper() or low[max(0, a - 3) : a] == "min" and not low[max(0, a - 4) : a - 3].isalpha() and following[:1].isupper()
        return following[:1].isupper() or not following or not following[:1].islower()
    if _in_trie(_NEVER, low, a):
        return False
    letters = word.strip(".-")
    if len(letters) == 1 and letters.isalpha() and letters.isascii() | ("Ѐ" <= letters <= "ӿ") | letters.isupper():
        return following.lower() in STARTERS and following[:1].isupper() and letters.isupper() and bool(t[start : a - 1].strip())
    if re.fullmatch(r"(?:[^\W\d_]\.)+[^\W\d_]", word):  # acronym with stops
        return following.lower() in STARTERS and following[:1].isupper()
    return True


def sentences(text: str | None) -> list[tuple[int, int]]:
    """(begin, end) of every sentence, in order, covering the text."""
    if not text:
        return []
    starts = [0, *sentence_starts(text)]
    return list(zip(starts, [*starts[1:], len(text)]))


def cut_batches(keys: list[str], text_column: str = "text"):
    """A mapInArrow function giving (keys..., cut INT) of the second and later sentences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take: list[int] = []
            cuts: list[int] = []
            for i, t in enumerate(batch.column(text_column).to_pylist()):
                for c in sentence_starts(t):
                    take.append(i)
                    cuts.append(c)
            idx = pa.array(take, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(k).take(idx) for k in keys] + [pa.array(cuts, pa.int32())], names=[*keys, "cut"])

    return run


def sentence_batches(keys: list[str], text_column: str = "text"):
    """A mapInArrow function giving (keys..., sent INT, begin INT, end INT, sentence STRING)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take: list[int] = []
            rows: list[tuple[int, int, int, str]] = []
            for i, t in enumerate(batch.column(text_column).to_pylist()):
                for s, (a, b) in enumerate(sentences(t)):
                    take.append(i)
                    rows.append((s, a, b, t[a:b]))
            idx = pa.array(take, pa.int32())
            cols = list(zip(*rows)) if rows else [(), (), (), ()]
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(k).take(idx) for k in keys] + [pa.array(c, k) for c, k in zip(cols, kinds)], names=[*keys, "sent", "begin", "end", "sentence"])

    return run
