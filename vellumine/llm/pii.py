"""Personal information inside free text.

Bootstrapped contextual extraction. One pass over the texts gives candidate spans by shape (names in any script with capitals,
numbers, e-mail and postal addresses) with their instance (given name, digit shape, form of address) and the words before them
(the pattern). Spark scores the graph of patterns and instances until nothing changes: seed instances make patterns trusted,
trusted patterns make unseen instances trusted. Candidates are joined with the scored graph; nothing of the corpus goes to the
driver. Fewer than six digits are no telephone or identity number.

Cases: null and empty texts have no mention; repeated texts have the same mentions under each id; overlapping candidates are
settled by kind (e-mail, address, number, name) and then by the earlier start; other columns pass unchanged.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _letters(category: str) -> str:
    """The inside of a regular-expression class: all letters of a category in the scripts that have capitals."""
    out, first = [], None
    for cp in range(0xC0, 0x2000 + 1):
        inside = cp < 0x2000 and unicodedata.category(chr(cp)) == category
        if inside and first is None:
            first = cp
        elif not inside and first is not None:
            out.append(chr(first) if first == cp - 1 else f"{chr(first)}-{chr(cp - 1)}")
            first = None
    return "".join(out)


UP, LOW = "A-Z" + _letters("Lu"), "a-z" + _letters("Ll")
# Seed given names and short forms, in lower case.
SEED_GIVEN = set(
    """
    adam alan albert alex alexandra alfred alice amir amy ana andrea andrew andy angela anika anna anne anthony antonio arvid barbara becky ben
    benjamin bernard beth bill bob brian carl carla carlos carmen carol caroline catherine cathy charles charlie chris christina christopher
    claire clara daniel david deborah diana dick dominic donald edward eleanor elena elin elizabeth ellen ellie emil emilio emily emma eric
    ethan eva fatima felix fernando fiona frances francesca francis frank fran fred freddy frederick gabi gabriel gabriela george gerald grace greg gregory
    gustav hamid hannah hans harold harry heinrich helen henri henrietta henry hetty hiroko hugo ian ingrid irene isa isabella ivan jack
    jacob james jane janet jean jennifer jenny jens jim joan joe john joseph juan judith julia julian kamal karen karl kate katarina katherine katie kay
    ken kenneth kevin larry laura laurence lawrence lars leo leonard linda liz louis louise lucia lucy luis luke magda margaret maria marie mario
    martha martin mary matt matthew maurice michael miguel mike mohamed monica nadia nancy nicholas nick nicole nina odile oliver ollie olga omar
    oscar otto pablo pamela patricia paul paula pedro peggy peter philip rachel ralph raymond rebecca richard rob robert roger rosa ruth
    sam samuel sandra sara sarah sebastian simon sofia sophie stephen steve sue susan susanna sven tess theresa thomas tim timothy tom tony ulrika umberto
    ursula uschi vera vicky victor victoria vince vincent walt walter wendy wilhelmina willa william xavier yolanda yusuf yvonne zachary zack zainab zofia
    """.split()
)
TITLES = "dr prof mr mrs ms miss mx sir herr frau fräulein monsieur madame mademoiselle señor señora sr sra dra don doña dipl ing rev hon professor doctor participant patient paciente probandin proband".split()
_STREET = "Street St Road Rd Lane Ln Avenue Ave Drive Dr Court Ct Close Way Place Pl Square Sq Terrace Crescent Boulevard Blvd Hill Row Walk Gardens Grove Park Mews Hollow Parkway Circle Quay Wharf Yard Green".split()
_TOWN = rf"[{UP}][\w'’]+(?:[ -](?:(?:sur|de|la|le|les|am|an|der|on|upon|under|del|los|las|in|im|bei)[ -])*[{UP}][\w'’]+){{0,3}}"
_UNIT = r"(?:(?:Flat|Apt\.?|Apartment|Unit|Suite|Room|House) \d+\w?,?\s+)?"
ADDRESS = [
    re.compile(rf"(?<![\w.-]){_UNIT}\d{{1,5}}[A-Za-z]?,? (?:[A-Z][\w'’]+ ){{1,4}}?(?:{'|'.join(_STREET)})\b\.?(?:,? (?:Apt\.?|Flat|Suite|Unit|No\.?|#) ?\d+\w?)?(?:, ?|\s*\n){_TOWN}"),
    re.compile(rf"(?<!\w)P\.? ?O\.? ?Box \d+,?\s+{_TOWN}"),
    re.compile(rf"(?<![\w.-]){_UNIT}\d{{1,5}}[A-Za-z]? (?:[A-Z][\w'’]+ ?){{1,4}}(?:, ?(?:Apt\.?|Flat|Suite|Unit) ?\d+\w?)?(?:, ?|\s*\n){_TOWN},? [A-Z]{{1,2}}\d? ?\d[\dA-Z]{{2,4}}\b"),
    re.compile(rf"(?<![\w.-])\d{{1,4}}(?: ?(?:bis|ter|quater))?,? (?:rue|avenue|av\.|impasse|place|boulevard|bd|allée|allee|chemin|quai|route|cours|square|passage|villa|sentier|ruelle) [^,\n]{{2,50}},\s*(?:F-)?\d{{5}} {_TOWN}"),
    re.compile(rf"(?<!\w)(?:Calle|Plaza|Avenida|Avda\.?|Paseo|C/|Camino|Carrera|Ronda|Travesía|Glorieta|Carretera|Callejón)[ ][^,\n]{{1,50}}?,? (?:n\.?º ?)?\d{{1,4}}(?:, [^,\n]{{1,18}}){{0,3}}, (?:E-)?\d{{5}} {_TOWN}"),
    re.compile(rf"(?<![\w.-])(?:(?:Am|An der|An den|Im|Zum|Zur|Auf der|Auf dem|In der|In den|Unter den|Hinter dem|Vor dem|Bei der|Alte|Alter|Neue|Obere|Untere|Große|Kleine) )?[{UP}][\w.-]+(?: (?!\d)[{UP}][\w.-]+){{0,2}} \d{{1,4}} ?[a-z]?,\s*(?:D-|A-|CH-)?\d{{4,5}} {_TOWN}"),
]
_AT = r"(?: ?@ ?| ?＠ ?| ?\[ ?at ?\] ?| ?\( ?at ?\) ?| at (?=[\w-]+ (?:dot|\.) ))"
_DOT = r"(?:\.| ?\[ ?(?:dot|\.) ?\] ?| ?\( ?(?:dot|\.) ?\) ?| dot )"
EMAIL = re.compile(rf"(?<![\w.+@-])[A-Za-zÀ-ÿ0-9][\w.+-]*{_AT}[A-Za-z0-9][\w-]*(?:{_DOT}[A-Za-z][\w-]*)+", re.I)
_MAYBE_EMAIL = re.compile(r"@|＠|[\[(] ?at ?[\])]| dot ", re.I)
_FAMILY = rf"(?:(?:van|von|de|der|den|di|da|del|la|el|al|bin|ter|ten) ){{0,2}}(?:Mc|Mac|O['’]|D['’])?[{UP}](?:[{LOW}'’]+|[{UP}]+)(?:-[{UP}](?:[{LOW}'’]+|[{UP}]+))*"
NAME = re.compile(rf"(?<![\w.@'’-])(?=((?P<g>[{UP}](?:[{LOW}]+|[{UP}]+)(?:-[{UP}][{LOW}]+)?) (?:[A-Z]\. ?)*{_FAMILY}|(?P<i>(?:[{UP}]\.(?: |-)?)+){_FAMILY}))(?P<first>[{UP}])")
LOWER = re.compile(rf"(?<![\w.@+'’-])(?P<g>{'|'.join(sorted(SEED_GIVEN, key=lambda w: (-len(w), w)))}) (?:[a-z]\. ?)*[{LOW}]{{4,}}(?:-[{LOW}]{{3,}})?(?![\w@])")
# What a text must hold for each form of address to be sought: far cheaper than the form itself.
_MAYBE_ADDRESS = [
    re.compile(rf"\d[A-Za-z]?,? [A-Z][\w'’]+ (?:[A-Z][\w'’]+ )*(?:{'|'.join(_STREET)})\b"), re.compile("Box "), re.compile(r"[A-Z]{1,2}\d? ?\d[\dA-Z]{2,4}\b"),
    re.compile("rue |avenue|av\\.|impasse|place |boulevard|bd |allée|allee|chemin|quai|route|cours |square|passage|villa|sentier|ruelle"), re.compile("Calle|Plaza|Aven|Avda|Paseo|C/|Camino|Carre|Ronda|Travesía|Glorieta"),
    re.compile(r",\s*(?:D-|A-|CH-)?\d{4,5} "),
]
_AFTER_SIGN = re.compile(r"[^\w\s.@+'’-][a-z]{3,11} ")
NUMBER = re.compile(r"\d(?:\d|[ ./()-](?=[\d(])|\) (?=\d)| \((?=\d)){4,}\d")
_DIGIT = re.compile(r"\d")
_BEFORE = re.compile(r"[^\W\d_]+|\d+")


def left_context(t: str, start: int) -> tuple[str, str]:
    """The word before an offset and the one before that; numbers are '#', a sentence or line begin is '^', titles are one."""
    end = start
    while end and t[end - 1] in " \t(\"'«„“[":
        end -= 1
    if not end or t[end - 1] == "\n":
        return "^", "^"
    a = end
    for _ in range(2):  # two pieces between white space, however long
        while a and t[a - 1].isspace():
            a -= 1
        while a and not t[a - 1].isspace():
            a -= 1
    tail = t[a:end]
    words = _BEFORE.findall(tail)
    if not words:
        return "^", "^"
    norm = [w.lower() if not w.isdigit() else "#" for w in words[-2:]]
    # "75 ms." is a measure, no title.
    norm = [("<title>" if w in TITLES and not (w == "ms" and k and norm[k - 1] == "#") else w) for k, w in enumerate(norm)]
    one = norm[-1]
    two = norm[-2] if len(norm) > 1 else "^"
    if tail[-1] in ".!?。" and one != "<title>" and not (one in ("tel", "ph", "no", "nr", "id", "telef", "tél", "fax", "mob")):
        one, two = "^", "^"
    return one, two


def shape(s: str) -> str:
    """Digits as 9, letters as A."""
    return re.sub(r"[A-Za-z]", "A", re.sub(r"\d", "9", s))


def email_form(s: str) -> str:
    """How an e-mail address is written: with its sign, in brackets, or in words alone."""
    return "sign" if "@" in s or "＠" in s else "brackets" if "[" in s or "(" in s else "words"


def _in_caps(t: str, a: int, b: int) -> bool:
    """Whether a span of capitals stands in running text of capitals."""
    before, after = re.search(r"(\w{3,})\W*$", t[max(0, a - 24) : a]), re.match(r"\W*(\w{3,})", t[b : b + 24])
    return any(x and x.group(1).isalpha() and x.group(1).isupper() for x in (before, after))


def candidates(t: str) -> list[tuple[str, int, int, str, str, str]]:
    """(kind, begin, end, instance, word before, the one before that) of a text."""
    out: list[tuple[str, int, int, str, str, str]] = []
    taken: list[tuple[int, int]] = []

    def free(a: int, b: int) -> bool:
        k = bisect_left(taken, (a, b))
        return (k == 0 or taken[k - 1][1] <= a) and (k == len(taken) or taken[k][0] >= b)

    if _MAYBE_EMAIL.search(t):
        for m in EMAIL.finditer(t):
            a, b = m.span()
            if free(a, b):
                insort(taken, (a, b))
                out.append(("email", a, b, email_form(m.group()), *left_context(t, a)))
    if _DIGIT.search(t):
        for k, rx in enumerate(ADDRESS):
            for m in rx.finditer(t) if _MAYBE_ADDRESS[k].search(t) else ():
                a, b = m.span()
                if free(a, b):
                    insort(taken, (a, b))
                    out.append(("address", a, b, f"form {k}", *left_context(t, a)))
        for m in NUMBER.finditer(t):
            a, b = m.span()
            lead = ""
            if a and t[a - 1] == "(":
                if ")" in t[a:b]:
                    a -= 1
            if t[a - 1 : a] == "+":
                a -= 1
                if t[a - 1 : a] == "(":
                    a -= 1
            else:
                p = re.search(r"(?<![\w-])[A-Z]{1,2}[ -]?$", t[max(0, a - 4) : a])
                if p and p.group().strip(" -") not in ("ID", "NO", "NR", "PO", "N"):
                    lead = p.group()
                    a -= len(lead)
            if a and (t[a - 1].isalnum() or t[a - 1] in "+-/@_" or (t[a - 1] in ".,:" and t[a - 2 : a - 1].isdigit())):
                continue
            e = re.match(r"[A-Z](?!\w)|-[A-Z](?!\w)" + ("| [A-Z](?!\\w)" if lead else ""), t[b : b + 4])
            if e:
                b += e.end()
            if b < len(t) and (t[b].isalnum() or t[b] in "@_" or (t[b] in "-/:" and t[b + 1 : b + 2].isalnum())):
                continue
            s = t[a:b]
            if sum(c.isdigit() for c in s) < 6 or not free(a, b):
                continue
            out.append(("number", a, b, shape(s), *left_context(t, a)))
            insort(taken, (a, b))
    for m in NAME.finditer(t):
        a, b = m.start(), m.end(1)
        if not free(a, b) or t[b : b + 7].lstrip(" ,").startswith("et al"):
            continue
        g = m.group("g")
        if g and len(g) > 1 and g.isupper() and _in_caps(t, a, b):
            out.append(("name", a, b, "<caps>", *left_context(t, a)))
        elif g:
            out.append(("name", a, b, g.lower(), *left_context(t, a)))
        else:
            out.append(("name", a, b, "<initials>", *left_context(t, a)))
    # The long alternation runs only where one of its words stands after white space, or any word after a sign.
    if not SEED_GIVEN.isdisjoint(t.split()) or _AFTER_SIGN.search(t):
        for m in LOWER.finditer(t):
            if free(*m.span()):
                out.append(("lower", m.start(), m.end(), m.group("g"), *left_context(t, m.start())))
    return out


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(d, *c) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if t for c in candidates(t)]
        cols = list(zip(*rows)) if rows else [()] * 7
        kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "kind", "a", "b", "instance", "one", "two"])


# Forms that are seeds: addresses with a street and a number or a postcode, e-mail with a sign or brackets.
SEED_FORMS = {"address": ["form 0", "form 2", "form 3", "form 4", "form 5"], "email": ["sign", "brackets"]}
_PLAIN = ["<initials>", "<caps>"]  # instances that tell nothing by themselves


def score_graph(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(instances, patterns) of the scored graph: (class, instance) and (class, pattern) that are trusted.

    A pattern is trusted when at least two different trusted instances of one class are in it, four fifths of all trusted
    ones are of that class, and half of what it surrounds is trusted (numbers, whose shapes vary: a tenth for patterns of two
    words, or a quarter where seeds alone make it trusted); an instance when a third of its occurrences lies in trusted
    patterns, at least two of them. Seeds are trusted from the start, and what is trusted once stays so: rounds go on until
    one adds nothing. Forms of addresses are few, so one trusted form makes a pattern of theirs.
    """
    from vellumine.session import cut

    two = F.concat_ws(" ", "two", "one")
    # Sentence beginnings tell nothing of a class.
    nodes = found.where(~F.col("instance").isin(_PLAIN) & (F.col("kind") != "lower"))
    mass = cut(nodes.groupBy("kind", "instance").agg((2 * F.count("*")).alias("all")))  # an occurrence has two patterns
    edges = (
        nodes.select("kind", "instance", F.explode(F.array(two, F.col("one"))).alias("pattern"))
        .where(~F.col("pattern").isin("^", "^ ^"))
        .groupBy("kind", "instance", "pattern")
        .agg(F.count("*").alias("n"))
    )
    edges = cut(edges)
    total = cut(edges.groupBy("kind", "pattern").agg(F.sum("n").alias("all")))
    # Seeds: given names; numbers with a country code are telephones; national formats with letters at both ends or at the end are identities.
    kind, inst = F.col("kind"), F.col("instance")
    form = F.lit(False)
    for k, forms in SEED_FORMS.items():
        form = form | (kind == k) & inst.isin(forms)
    seed = (
        F.when((kind == "name") & inst.isin(sorted(SEED_GIVEN)), "name")
        .when((kind == "number") & inst.rlike(r"^\(?\+9"), "phone")
        .when((kind == "number") & inst.rlike(r"^AA ?99 ?99 ?99 ?A$|^99999999-?A$|^999-99-9999$"), "idnum")
        .when(form, kind)
    )
    trusted = cut(mass.select("kind", "instance", seed.alias("class"), F.lit(True).alias("seeded")).where("class is not null"))
    few = "kind in ('address', 'email')"
    while True:
        by = edges.join(trusted, ["kind", "instance"]).groupBy("kind", "class", "pattern").agg(F.sum("n").alias("n"), F.count_distinct("instance").alias("kinds"), F.max("seeded").alias("seeded"))
        known = by.groupBy("kind", "pattern").agg(F.sum("n").alias("known"))
        scored = by.join(total, ["kind", "pattern"]).join(known, ["kind", "pattern"])
        patterns = cut(scored.where(f"5 * n >= 4 * known and ((kinds >= 2 or {few}) and 2 * n >= all or kind = 'number' and pattern like '% %' and kinds >= 2 and 10 * n >= all or kind = 'number' and seeded and 4 * n >= all)").select("kind", "class", "pattern"))
        more = edges.join(patterns, ["kind", "pattern"]).groupBy("kind", "class", "instance").agg(F.sum("n").alias("n"), F.count_distinct("pattern").alias("kinds"))
        new = more.join(mass, ["kind", "instance"]).where("kinds >= 2 and 3 * n >= all").join(trusted, ["kind", "instance"], "left_anti")
        new = cut(new.groupBy("kind", "instance").agg(F.max_by("class", F.struct("n", "class")).alias("class")).withColumn("seeded", F.lit(False)))
        if new.isEmpty():
            return trusted, patterns
        trusted = cut(trusted.unionByName(new))


def mentions(documents: DataFrame) -> DataFrame:
    """(doc_id, pii, a, b): every mention of personal information, begin and end as offsets in code points."""
    from vellumine.session import cut

    docs = documents.select("doc_id", "text").where("text is not null and text <> ''")
    found = cut(docs.mapInArrow(_batches, "doc_id bigint, kind string, a int, b int, instance string, one string, two string"))
    trusted, patterns = score_graph(found)
    rest = found.withColumn("graph", F.when(F.col("kind") == "lower", "name").otherwise(F.col("kind"))).withColumn("pair", F.concat_ws(" ", "two", "one"))
    inst = trusted.select(F.col("kind").alias("graph"), "instance", F.col("class").alias("by_instance"))
    pat2 = patterns.select(F.col("kind").alias("graph"), F.col("pattern").alias("pair"), F.col("class").alias("by_pair"))
    pat1 = patterns.select(F.col("kind").alias("graph"), F.col("pattern").alias("one"), F.col("class").alias("by_one"))
    joined = rest.join(inst, ["graph", "instance"], "left").join(pat2, ["graph", "pair"], "left").join(pat1, ["graph", "one"], "left")
    context = F.coalesce("by_pair", "by_one")
    pii = (
        F.when(F.col("kind") == "number", F.coalesce(context, "by_instance"))
        .when(F.col("kind").isin("email", "address"), F.coalesce("by_instance", context))
        .when(F.col("kind") == "lower", context)
        .when(F.col("instance") == "<initials>", context)
        .when(F.col("instance") == "<caps>", F.col("by_pair"))
        .otherwise(F.coalesce("by_instance", "by_pair"))
    )
    picked = joined.withColumn("pii", pii).where("pii is not null").withColumn("strength", F.when(F.col("by_instance").isNotNull(), 1).otherwise(0)).select("doc_id", "pii", "a", "b", "strength")
    # Overlapping name candidates ("Participant Lucia", "Lucia Mirasorud"): one with a trusted given name goes first.
    names = picked.where("pii = 'name'").distinct()
    w = Window.partitionBy("doc_id").orderBy("a", "b")
    names = (
        names.withColumn("prev_b", F.lag("b").over(w)).withColumn("prev_s", F.lag("strength").over(w)).withColumn("next_a", F.lead("a").over(w)).withColumn("next_s", F.lead("strength").over(w))
        .where(~((F.coalesce(F.col("next_a") < F.col("b"), F.lit(False)) & (F.col("next_s") > F.col("strength"))) | (F.coalesce(F.col("prev_b") > F.col("a"), F.lit(False)) & (F.col("prev_s") >= F.col("strength")))))
        .select("doc_id", "pii", "a", "b")
    )
    return picked.where("pii <> 'name'").select("doc_id", "pii", "a", "b").unionByName(names).distinct()


def redact(documents: DataFrame) -> DataFrame:
    """documents with the column redacted: each mention replaced by a placeholder of its type, all else untouched."""
    spans = mentions(documents).groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("a", "b", "pii"))).alias("__pii_spans"))
    # The spans of one document fold into its text from left to right.
    start = F.struct(F.lit("").alias("s"), F.lit(0).alias("at"))
    text = F.col("text")
    fold = F.aggregate(
        F.coalesce("__pii_spans", F.array().cast("array<struct<a:int,b:int,pii:string>>")),
        start,
        lambda acc, x: F.when(x["a"] < acc["at"], acc).otherwise(
            F.struct(F.concat(acc["s"], text.substr(acc["at"] + 1, x["a"] - acc["at"]), F.lit("["), F.upper(x["pii"]), F.lit("]")).alias("s"), x["b"].alias("at"))
        ),
        lambda acc: F.concat(acc["s"], text.substr(acc["at"] + 1, F.length(text))),
    )
    return documents.join(spans, "doc_id", "left").withColumn("redacted", fold).drop("__pii_spans")
