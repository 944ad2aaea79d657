"""Variant spellings of names typed by people, linked.

A spelling is parsed into a family name (or the head of a group's name) and given tokens. A symmetric-delete neighbourhood
index finds family names of any length one edit apart; counts, given names and shared papers settle which rare spelling
belongs to which frequent one, through chains of any length. Given tokens are aligned by optimal assignment (Hungarian method),
permitting initials, short forms, abbreviations and one typo. Signatures of a family meet by keys of their first tokens, so a
common family name is never compared with itself as a whole.

Cases: null and empty names link nothing; equal spellings are one; a name of one token links only to spellings of that
token alone; an empty table gives no link. Groups of spellings are joined through their few signatures, so equal signatures
are never compared with one another.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumine.session import cut, spread

# Short forms of given names.
SHORT_FORMS = """
alexandra alexander alex xander lexi; andrew andreas andy drew; anthony tony; barbara barb babs; benjamin ben benny; bernard bernie; catherine cathy cath kate katie kat; katarina katharina katherine katharine kathryn kathy kate katie kat kay
charles charlie chuck; christina christine chris tina chrissy; christopher chris kit; daniel dan danny; david dave davy; deborah debbie deb; donald don donny; dorothy dot dolly; edward ed eddie ted ned
eleanor elena ellie nell nora leonor; elizabeth beth liz lizzy betty eliza libby; emilio emil; frances francesca fran frankie franny; francis frank frankie; frederick friedrich fred freddy fritz; gabriela gabriele gabi gaby; gabriel gabe
george georgie; gerald gerry jerry; gregory greg; gustav gus; harold harry hal; henry harry hank; henrietta hetty etta hattie; isabella isabel isa bella izzy; jacob jake; james jim jimmy jamie; jennifer jen jenny; john jack johnny
jonathan jon; joseph joe joey jo; joshua josh; judith judy; kenneth ken kenny; laurence lawrence larry laurie; leonard leo len lenny; louis louise lou; lucia lucy; margaret margarethe maggie meg peggy; martin marty; matthew matt matty matthias
michael mike mick mickey; nicholas nick nicky; oliver ollie; pamela pam; patricia pat patty tricia; patrick pat paddy; peter pete; philip phil; rebecca becky becca; richard rich rick dick ricky; robert rob bob bobby robbie bert
ronald ron; samuel samantha sam sammy; sebastian seb bastian; stephen steven steve; susanna susan susanne sue susie; theodore ted theo; theresa teresa tess tessa terry; thomas tom tommy; timothy tim timmy; ulrika ulrike ulla rika; ursula uschi ulla; valerie val; victor vic; victoria vicky tori; vincent vince vinny
walter walt wally; wilhelmina willa mina billie minna; william will bill billy liam wilhelm; yolanda yola; zachary zach zack zac; zofia zosia; sophia sofia sophie
"""
_FORMS: dict[str, set[int]] = {}
for _k, _line in enumerate(re.split(r"[;\n]+", SHORT_FORMS.strip())):
    for _w in _line.split():
        _FORMS.setdefault(_w, set()).add(_k)
_HEADS = {k: line.split()[0] for k, line in enumerate(re.split(r"[;\n]+", SHORT_FORMS.strip()))}
# Words that only say what kind of group it is, and words between.
GROUP_KINDS = set("group consortium cons laboratory laboratories lab labs centre center ctr cent institute inst network netw initiative init society soc committee comm collaboration collab team project proj association assoc department dept alliance council board unit working wg grp".split())
_BETWEEN = {"of", "for", "on", "in", "and", "the", "&", "de", "für", "und", "et", "at"}
SUFFIXES = {"jr", "sr", "jnr", "snr", "ii", "iii", "iv", "phd", "md"}
_NICK = re.compile(r'["“][^"”]*["”]|\([^)]*\)')


def fold(s: str) -> str:
    """Lower case without accents; ß and stroke letters as their plain letters."""
    s = unicodedata.normalize("NFKD", s.translate(str.maketrans({"ß": "ss", "ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "đ": "d", "æ": "ae", "œ": "oe"})))
    return "".join(c for c in s if not unicodedata.combining(c)).lower()


def parse_name(name: str | None) -> tuple[str, list[str], str] | None:
    """(family, given tokens, suffix) of a spelling; for a group its head and the words that name its field."""
    if not name or not name.strip():
        return None
    s = _NICK.sub(" ", name.replace("’", "'"))
    parts = [p.strip() for p in s.split(",") if p.strip()]
    suffix = ""
    kept = []
    for p in parts:
        if fold(p).strip(". ") in SUFFIXES and kept:
            suffix = fold(p).strip(". ")
        else:
            kept.append(p)
    if not kept:
        return None
    words = kept[0].split()
    if len(words) > 1 and fold(words[-1]).strip(".") in SUFFIXES and not (len(words) == 2 and words[-1].isupper() and len(words[-1]) < 3):
        suffix = fold(words[-1]).strip(".")
        words = words[:-1]
    plain = [fold(w).strip(".") for w in words]
    if len(words) > 1 and any(w in GROUP_KINDS for w in plain[1:]) and not (len(words) == 2 and words[1].isupper()):
        tail = [w for p in [words[1:], *(q.split() for q in kept[1:])] for w in (fold(x).strip(".") for x in p) if w and w not in GROUP_KINDS and w not in _BETWEEN]
        return plain[0], tail, ""
    if len(kept) > 1:
        return " ".join(plain), _given(kept[1].split()), suffix
    if len(words) == 1:
        return plain[0], [], suffix
    last = words[-1]
    # "Family FM": capitals without stops after a family name.
    if re.fullmatch(r"[^\W\d_]{1,3}", last) and last.isupper() and any(len(w.strip(".")) > 1 and not (w.isupper() and len(w) <= 3) for w in words[:-1]):
        return " ".join(plain[:-1]), list(fold(last)), suffix
    k = len(words) - 1
    while k > 1 and plain[k - 1] in {"van", "von", "de", "der", "den", "di", "da", "del", "la", "al", "el", "bin", "ter", "ten"}:
        k -= 1
    return " ".join(plain[k:]), _given(words[:k]), suffix


def _long_form(w: str) -> str:
    """The long form of a short form that begins with another letter ("bill" for "william"), so initials agree."""
    heads = [_HEADS[k] for k in sorted(_FORMS.get(w, ()))]
    return heads[0] if heads and all(h[0] != w[0] for h in heads) else w


def _given(words: list[str]) -> list[str]:
    out: list[str] = []
    for w in words:
        for x in re.findall(r"[^\W\d_]+", w):
            if len(x) <= 3 and x.isupper() and len(x) > 1 and "." not in w and len(words) == 1:
                out.extend(fold(x))
            else:
                out.append(_long_form(fold(x)))
    return out


def one_edit(a: str, b: str) -> bool:
    """Whether two words are equal or one insertion, deletion, replacement or swap of neighbours apart."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    if len(a) < len(b):
        a, b = b, a
    return a[i + 1 :] == b[i:]


def _token_cost(a: str, b: str) -> int | None:
    """Cost of taking one given token for another; None if they can't be the same."""
    if a == b:
        return 0
    if len(a) == 1 or len(b) == 1:
        return 1 if a[0] == b[0] else None
    if _FORMS.get(a, set()) & _FORMS.get(b, set()):
        return 1
    if a.startswith(b) and len(b) >= 3 or b.startswith(a) and len(a) >= 3:
        return 1
    if min(len(a), len(b)) >= 4 and one_edit(a, b) and not (a in _FORMS and b in _FORMS):
        return 2
    for x, y in ((a, b), (b, a)):  # a typo of a short form's long form
        if x in _FORMS and len(y) >= 5 and any(one_edit(y, z) for z, ks in _FORMS.items() if ks & _FORMS[x] and len(z) >= 5):
            return 3
    return None


def assignment(costs: list[list[float]]) -> float:
    """Least total cost of giving every row a column of its own (Hungarian method); rows are no more than columns."""
    n, m = len(costs), len(costs[0])
    u, v, match, way = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        match[0] = i
        j0 = 0
        least, used = [float("inf")] * (m + 1), [False] * (m + 1)
        while True:
            used[j0] = True
            i0, delta, j1 = match[j0], float("inf"), 0
            for j in range(1, m + 1):
                if not used[j]:
                    c = costs[i0 - 1][j - 1] - u[i0] - v[j]
                    if c < least[j]:
                        least[j], way[j] = c, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            for j in range(m + 1):
                if used[j]:
                    u[match[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            j0 = j1
            if not match[j0]:
                break
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    return -v[0]


_NEVER = 1000.0


def aligned(a: list[str], b: list[str], most: float = 4) -> bool:
    """Whether two lists of given tokens can be one person's: the best assignment leaves no token of the shorter list over.

    First tokens belong together, and a token that stands before its neighbour costs 2. The Hungarian method gives the least
    cost of all assignments; only where that is low enough are the places looked at, from the cheapest on. Any length goes.
    """
    if not a or not b:
        return not a and not b
    if len(a) > len(b):
        a, b = b, a
    costs = [[_NEVER if (c := _token_cost(x, y)) is None else float(c) for y in b] for x in a]
    if costs[0][0] >= most or assignment(costs) >= most:
        return False
    seen: set[tuple[int, int, frozenset[int], float]] = set()

    def place(i: int, last: int, taken: frozenset[int], spent: float) -> bool:
        if i == len(a):
            return True
        if (i, last, taken, spent) in seen:
            return False
        seen.add((i, last, taken, spent))
        for k in sorted((k for k in range(len(b)) if k not in taken), key=lambda k: (k < last, costs[i][k], k)):
            c = spent + costs[i][k] + 2 * (k < last)
            if c < most and place(i + 1, k, taken | {k}, c):
                return True
        return False

    return place(1, 0, frozenset([0]), costs[0][0])


def _edit_keys(w: str) -> set[str]:
    """A word and the words with one character less."""
    return {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}


def first_keys(given: str) -> tuple[list[str], list[str]]:
    """Keys under which a signature is laid down and under which it asks: two whose first tokens can agree share one.

    An initial asks all signatures of its family and initial; there are few different signatures of initials.
    """
    w = given.split(" ")[0]
    if len(w) < 2:
        return ["*", "i"], ["*"]
    keys = {"=" + w, "p" + w[:3], *("f%d" % k for k in _FORMS.get(w, ()))}
    if len(w) >= 4:
        keys |= {"d" + x for x in _edit_keys(w)}
    if w in _FORMS:
        keys |= {"d" + x for z, ks in _FORMS.items() if ks & _FORMS[w] and len(z) >= 5 for x in _edit_keys(z)}
    return ["*", *sorted(keys)], ["i", *sorted(keys)]


def _key_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    strings = pa.list_(pa.string())
    for batch in batches:
        keys = [first_keys(g or "") for g in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([k[0] for k in keys], strings), pa.array([k[1] for k in keys], strings)], names=["given", "laid", "asks"])


def _aligned_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ok = [aligned((p or "").split(), (q or "").split()) for p, q in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
        yield batch.filter(pa.array(ok, pa.bool_()))


def _parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(n, p[0], " ".join(p[1]), p[2]) for n in batch.column(0).to_pylist() if (p := parse_name(n))]
        cols = list(zip(*rows)) if rows else [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=["name", "family", "given", "suffix"])


def deletes(c: Column) -> Column:
    """A word and the words with one character less: two words one edit apart share one of them."""
    return F.array_distinct(F.concat(F.array(c), F.transform(F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1))), lambda i: F.concat(c.substr(F.lit(1), i - 1), c.substr(i + 1, F.length(c))))))


def _near(c: Column, d: Column) -> Column:
    """One edit apart, a swap of neighbours included."""
    return (F.levenshtein(c, d) <= 1) | ((F.levenshtein(c, d) == 2) & (F.length(c) == F.length(d)) & (F.array_sort(F.split(c, "")) == F.array_sort(F.split(d, ""))))


def usual_forms(words: DataFrame, ratio: float, least: int) -> DataFrame:
    """(w, usual): for each of words (w, n) that is rare the most frequent word one edit apart, at least ratio times as frequent."""
    keyed = words.where(F.length("w") >= least).select("w", "n", F.explode(deletes(F.col("w"))).alias("k"))
    other = keyed.select(F.col("w").alias("v"), F.col("n").alias("m"), "k")
    near = keyed.join(spread(other), "k").where((F.col("w") != F.col("v")) & (F.col("m") >= ratio * F.col("n"))).where(_near(F.col("w"), F.col("v")))
    return near.groupBy("w").agg(F.max_by("v", F.struct("m", "v")).alias("usual"))


def spelling_links(values: DataFrame) -> DataFrame:
    """(name_a, name_b), name_a < name_b, of two spellings of one person or group.

    values: (doc_id, run, name), one row per occurrence. Shared papers count as evidence where spellings are equally rare.
    """
    # No table of names is broadcast: all of them grow, and so would what the driver holds.
    seen = cut(values.where("name is not null and trim(name) <> ''").select("doc_id", "run", "name"))
    counts = cut(seen.groupBy("name").agg(F.count("*").alias("n")))
    parsed = cut(counts.select("name").mapInArrow(_parse_batches, "name string, family string, given string, suffix string")).join(spread(counts), "name")
    # Given names: a rare one is taken for the usual one an edit apart.
    first = F.split("given", " ")[0]
    given = parsed.where(F.length(first) >= 2).groupBy(first.alias("w")).agg(F.sum("n").alias("n"))
    usual = usual_forms(given, 8.0, 2)
    parsed = parsed.withColumn("w", first).join(spread(usual), "w", "left")
    rest = F.regexp_replace("given", r"^\S+", "")
    parsed = cut(parsed.withColumn("given", F.when(F.col("usual").isNull(), F.col("given")).otherwise(F.concat("usual", rest))).select("name", "n", "family", "given", "suffix", F.substring("given", 1, 1).alias("ini")))
    # Family names by first initial: nodes of the neighbourhood index.
    fn = F.split("given", " ")[0]
    nodes = parsed.groupBy("family", "ini").agg(F.sum("n").alias("n"), F.collect_set(F.when(F.length(fn) > 1, fn)).alias("firsts"))
    nodes = cut(nodes)
    keyed = nodes.where("family <> ''").select("family", "ini", "n", "firsts", F.explode(deletes(F.col("family"))).alias("k"))
    a, b = keyed, keyed.select(F.col("family").alias("to"), "ini", F.col("n").alias("m"), F.col("firsts").alias("to_firsts"), "k")
    more = (F.col("m") > F.col("n")) | ((F.col("m") == F.col("n")) & (F.col("to") < F.col("family")))
    near = a.join(spread(b), ["k", "ini"]).where((F.col("family") != F.col("to")) & more).where(_near(F.col("family"), F.col("to"))).drop("k").distinct()
    # Evidence of shared papers: both spellings stand in one paper, in different runs; in one run they are two people.
    place = seen.join(spread(parsed.select("name", "family", "ini")), "name").select("doc_id", "run", "family", "ini").distinct()
    here = near.select("family", "ini", "to").distinct()
    both = here.join(spread(place), ["family", "ini"]).join(spread(place.select("doc_id", F.col("run").alias("run2"), F.col("family").alias("to"), "ini")), ["doc_id", "to", "ini"])
    shared = both.groupBy("family", "ini", "to").agg(F.count_if(F.col("run") != F.col("run2")).alias("apart"), F.count_if(F.col("run") == F.col("run2")).alias("beside"))
    near = near.join(spread(shared), ["family", "ini", "to"], "left").fillna(0, ["apart", "beside"])
    same_first = F.arrays_overlap("firsts", "to_firsts")
    open_first = (F.size("firsts") == 0) | (F.size("to_firsts") == 0)
    # Short names are often an edit apart by chance: counts alone say nothing of them.
    open_first = open_first & (F.length("family") >= 5)
    sure = (F.col("beside") == 0) & ((F.col("apart") > 0) | same_first | (open_first & (F.col("m") >= 3 * F.col("n"))))
    best = near.where(sure).withColumn("score", F.struct((F.col("apart") > 0).cast("int"), same_first.cast("int"), "m", "to"))
    root = best.groupBy("family", "ini").agg(F.max_by("to", "score").alias("root"))
    root = cut(root)
    # A root may be rare itself: roots are followed until none moves; counts rise along them, so there is no circle.
    while True:
        up = root.select(F.col("family").alias("root"), "ini", F.col("root").alias("higher"))
        root = cut(root.join(spread(up), ["root", "ini"], "left").select("family", "ini", F.coalesce("higher", "root").alias("root"), F.col("higher").isNotNull().alias("moved")))
        if root.where("moved").isEmpty():
            break
        root = root.drop("moved")
    root = root.drop("moved")
    whole = cut(parsed.join(spread(root), ["family", "ini"], "left").select("name", F.coalesce("root", "family").alias("family"), "ini", F.concat_ws("|", "given", "suffix").alias("sig"), "given", "suffix"))
    # Signatures of a family and initial that share a key of their first tokens are compared; spellings come through them.
    sigs = whole.groupBy("family", "ini", "sig", "given", "suffix").agg(F.count("*").alias("spellings")).drop("spellings")
    keys = sigs.select("given").distinct().mapInArrow(_key_batches, "given string, laid array<string>, asks array<string>")
    sigs = cut(sigs.join(spread(keys), "given"))
    x = sigs.select("family", "ini", F.col("sig").alias("sa"), F.col("given").alias("ga"), F.col("suffix").alias("ja"), F.explode("asks").alias("key"))
    y = sigs.select("family", "ini", F.col("sig").alias("sb"), F.col("given").alias("gb"), F.col("suffix").alias("jb"), F.explode("laid").alias("key"))
    near = x.join(spread(y), ["family", "ini", "key"]).where("sa <> sb").where((F.col("ja") == F.col("jb")) | (F.col("ja") == "") | (F.col("jb") == ""))
    near = near.select("family", "ini", F.least("sa", "sb").alias("sa"), F.greatest("sa", "sb").alias("sb"), F.when(F.col("sa") < F.col("sb"), F.col("ga")).otherwise(F.col("gb")).alias("ga"), F.when(F.col("sa") < F.col("sb"), F.col("gb")).otherwise(F.col("ga")).alias("gb"))
    near = cut(near.distinct())
    good = near.select("ga", "gb").distinct().mapInArrow(_aligned_batches, "ga string, gb string")
    pairs = near.join(spread(good), ["ga", "gb"]).select("family", "ini", "sa", "sb").unionByName(sigs.select("family", "ini", F.col("sig").alias("sa"), F.col("sig").alias("sb")))
    na = whole.select("family", "ini", F.col("sig").alias("sa"), F.col("name").alias("n1"))
    nb = whole.select("family", "ini", F.col("sig").alias("sb"), F.col("name").alias("n2"))
    full = pairs.join(spread(na), ["family", "ini", "sa"]).join(spread(nb), ["family", "ini", "sb"]).where("n1 <> n2 and (sa <> sb or n1 < n2)")
    return full.select(F.least("n1", "n2").alias("name_a"), F.greatest("n1", "n2").alias("name_b")).distinct()
