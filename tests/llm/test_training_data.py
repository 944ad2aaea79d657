"""Operators for training data: literal cases, brute force on small fixtures, and hard rows (nulls, empties, repeats)."""

import random
import unicodedata
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from vellumine.llm import chunks, leaks, lookalikes, names, packing, pii, queries, scans, sentences


def cuts(text):
    return [text[a:b].strip() for a, b in sentences.sentences(text)]


@pytest.mark.parametrize(
    "text, want",
    [
        ("One is here. Two is there.", ["One is here.", "Two is there."]),
        ("Dr. A. Smith saw Fig. 3. It was fine.", ["Dr. A. Smith saw Fig. 3.", "It was fine."]),
        ('He wrote, "It slipped. We went on." on the form. Then he left.', ['He wrote, "It slipped. We went on." on the form.', "Then he left."]),
        ('The log ended with "No fault found." First we rinsed.', ['The log ended with "No fault found."', "First we rinsed."]),
        ("It held. (The lid stayed shut.) It opened.", ["It held.", "(The lid stayed shut.)", "It opened."]),
        ("Am 4. Mai kam er. Die 19. Reihe fehlt. Siehe Tab. 4. Die Werte sind da.", ["Am 4. Mai kam er.", "Die 19. Reihe fehlt.", "Siehe Tab. 4.", "Die Werte sind da."]),
        ("测量值介于6.24之间！他写道：“动了。要固定。”并停止。结束。", ["测量值介于6.24之间！", "他写道：“动了。要固定。”并停止。", "结束。"]),
        ("操作者は「動いた。固定だ。」と記録した。次だ。", ["操作者は「動いた。固定だ。」と記録した。", "次だ。"]),
        ("แบบจำลอง 64.1 เปอร์เซ็นต์ รอยต่อแตกหัก", ["แบบจำลอง 64.1 เปอร์เซ็นต์", "รอยต่อแตกหัก"]),
        ("मापन दोहराया गया। डॉ. मद्रक ने सुझाया।", ["मापन दोहराया गया।", "डॉ. मद्रक ने सुझाया।"]),
        ("لماذا انكسرت؟ أهمل النموذج.", ["لماذا انكسرت؟", "أهمل النموذج."]),
        ("¿Por qué? ¡El sensor no! EE. UU. y otros.", ["¿Por qué?", "¡El sensor no!", "EE. UU. y otros."]),
        ("described as moderate to wear.Participants said so.", ["described as moderate to wear.", "Participants said so."]),
        ("Unbalanced (bracket. Next one.", ["Unbalanced (bracket.", "Next one."]),
        ("no end", ["no end"]),
    ],
)
def test_sentences(text, want):
    assert cuts(text) == want


@pytest.mark.parametrize("n", [3, 20, 60, 600])
def test_long_quotations_are_one_sentence(n):
    quoted = " ".join(["It moved again. We fixed it."] * n)
    assert len(cuts(f'He wrote, "{quoted}" and stopped. Then he left.')) == 2
    assert len(cuts(f"{'x' * n} " * 9 + f"Dr. Adam saw {'y' * 90}.Participants {'z' * 90}. End.")) == 3
    assert len(cuts(f'One " only. Two.\n\n"{quoted}" he said. Three.')) == 4


def test_sentences_cover_everything():
    assert sentences.sentences(None) == [] and sentences.sentences("") == []
    rng = random.Random(3)
    for _ in range(300):
        t = "".join(rng.choice(["a", "B", ". ", "! ", "\n\n", '"', "(", ")", "。", "「", "」", " ", "1.", "ก ", "​"]) for _ in range(60))
        spans = sentences.sentences(t)
        assert "".join(t[a:b] for a, b in spans) == t and all(a < b for a, b in spans)


def test_chunks():
    rng = random.Random(5)
    for kind in range(4):
        parts = [["Some words stand here. ", "words, more; ", "word ", "w"][kind] * rng.randint(1, 4) for _ in range(900 if kind < 3 else 3000)]
        t = "".join(parts)
        got = chunks.split_oversized(t)
        assert got[0][0] == 0 and got[-1][1] == len(t)
        for (a, b, _), (c, _, _) in zip(got, got[1:]):
            assert 100 <= b - c <= 200 and b - a <= 1900
        assert chunks.cut_level(t) == chunks.LEVELS[kind]
    assert chunks.split_oversized(None) == [] and chunks.split_oversized("") == [(0, 0, "whole")]
    # An edit at the end leaves the pieces at the beginning as they were.
    t = " ".join(f"Sentence number {i} is {rng.random()} long." for i in range(400))
    a, b = chunks.split_oversized(t), chunks.split_oversized(t[:-300] + "changed" + t[-290:])
    assert a[: len(a) - 3] == b[: len(a) - 3]


def test_levels_come_from_the_chunker(monkeypatch):
    import pyarrow as pa

    rng = random.Random(11)
    parts = ["Some words stand here. ", "words, more; ", "word ", "w" * 300, "w" * 1750 + " ", "w" * 1750 + ", ", "W" * 1850 + ". "]
    texts = ["".join(rng.choice(parts[: rng.randint(1, len(parts))]) * rng.randint(1, 60) for _ in range(rng.randint(3, 30))) for _ in range(60)]
    texts = [t for t in texts if len(t) > chunks.LIMIT] + ["W" * 1850 + ". " + "V" * 1850 + ".", None, "", "short"]
    chunked = []
    split = chunks.split_oversized
    monkeypatch.setattr(chunks, "split_oversized", lambda text, *a, **k: chunked.append(text) or split(text, *a, **k))
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["k", "text"])
    (got,) = chunks.level_batches(["k"])(iter([batch]))
    want = {i: chunks.cut_level(t) for i, t in enumerate(texts) if t and len(t) > chunks.LIMIT}
    assert dict(zip(got["k"].to_pylist(), got["cut_at"].to_pylist())) == want and chunked == [texts[i] for i in want]
    assert set(want.values()) == set(chunks.LEVELS)
    assert want[len(texts) - 4] == "sentence"  # the overlap leaves no room for such a sentence, the rule does


def test_lookalikes(spark):
    rows = [
        ("t", "a", "Adhesion of nylon suture"), ("t", "b", "Ad⁠hesi­on of nylon suture"), ("t", "c", "Ａｄｈｅｓｉｏｎ оf nylоn suture"), ("t", "d", "adhesion of nylon suture"), ("t", "e", "Adhesion of\nnylon suture"),
        ("t", "f", "naïve"), ("t", "g", "naïve"), ("t", "h", "naive"), ("t", "i", "m²"), ("t", "j", "m2"), ("t", "k", "ﬁrst"), ("t", "l", "first"), ("t", "o", "\u0435\u0301clat"), ("t", "p", "\u00e9clat"), ("t", "m", None), ("t", "n", ""), ("t", "a", "Adhesion of nylon suture"), ("u", "z", "Adhesion of nylon suture"),
    ]
    df = spark.createDataFrame(rows, "tab string, key string, text string").withColumn("form", F.lit("clash"))
    got = {(r.key_a, r.key_b) for r in lookalikes.alike_pairs(df.select("tab", "key", "text", "form")).collect()}
    assert got == {("a", "b"), ("a", "c"), ("b", "c"), ("f", "g"), ("k", "l"), ("o", "p")}
    assert lookalikes.alike_pairs(df.limit(0)).count() == 0


def test_lookalike_forms_against_unicode(spark):
    samples = ["ｶﾞｽ", "ＡＢＣ１２３", "ﬀﬁﬂ", "é", "اﺎ", "ⅣⅤ", "plain"]
    df = spark.createDataFrame([(s,) for s in samples], "text string")
    got = {r.text: r.form for r in lookalikes.with_form(df, "text").collect()}
    for s in samples[:-2]:
        assert got[s] == unicodedata.normalize("NFKC", s)


def brute_leak(item, doc):
    from difflib import SequenceMatcher

    a, b = leaks.words_of(item), leaks.words_of(doc)
    return sum(m.size for m in SequenceMatcher(None, a, b, False).get_matching_blocks() if m.size >= 4) >= 0.5 * len(a)


def test_leaks_against_brute_force():
    rng = random.Random(7)
    vocab = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}x" for i in range(400)]
    items = [(i, " ".join(rng.choices(vocab, k=60))) for i in range(25)]
    index = leaks.LeakIndex(items)
    for n in range(120):
        i, text = rng.choice(items)
        w = text.split()
        share = rng.choice([0, 0.2, 0.7, 1.0])
        start = rng.randint(0, int(60 * (1 - share)))
        part = w[start : start + int(60 * share)]
        for k in range(5, len(part), 17):
            part[k] = "Changed"
        doc = " ".join(rng.choices(["filler", "text", "other"], k=40) + part + rng.choices(["tail", "more"], k=30)).upper()
        found = {x[0] for x in index.leaks(doc)}
        assert found == {j for j, t in items if brute_leak(t, doc)}, (n, share)
    assert index.leaks(None) == [] and index.leaks("") == []


@pytest.mark.parametrize("times", [1, 8, 30])
def test_leaks_among_repeats(times):
    rng = random.Random(8)
    w = [f"v{chr(97 + i % 26)}{chr(97 + i // 26)}y" for i in range(100)]
    items = [(1, " ".join(w)), (2, " ".join(f"u{x}" for x in w))]
    pad = lambda: rng.choices(["filler", "text", "other"], k=30)
    repeats = [x for _ in range(times) for x in (*w[:45], *pad())]
    index = leaks.LeakIndex(items)
    assert [x[:2] for x in index.leaks(" ".join([*repeats, *w[80:95]]))] == [(1, 0.6)]
    assert [x[:2] for x in index.leaks(" ".join([*w[80:95], *pad(), *repeats]))] == [(1, 0.6)]
    assert index.leaks(" ".join(repeats)) == [] and index.leaks(" ".join([*repeats, *w[30:45]])) == []


def test_best_pair_against_brute_force():
    rng = random.Random(9)
    for _ in range(500):
        spans = []
        for _ in range(rng.randint(0, 12)):
            a, size = rng.randint(0, 40), rng.randint(4, 20)
            there = rng.randint(0, size)
            spans.append((a, a + size, rng.randint(1, size), rng.randint(0, there), there))
        sums = [x[2:] for x in spans] + [tuple(a + b for a, b in zip(x[2:], y[2:])) for x, y in combinations(spans, 2) if x[1] <= y[0] + 2 or y[1] <= x[0] + 2]
        got = leaks._best_pair(spans)
        assert (got and got[0]) == max((t[0] for t in sums), default=None) and (got is None or got in sums)


def test_common_words_against_brute_force():
    rng = random.Random(21)
    for _ in range(300):
        a, b = rng.choices("abcd", k=rng.randint(0, 12)), rng.choices("abcd", k=rng.randint(0, 12))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        hit = leaks._common(a, b)
        assert sum(hit) == table[-1][-1]
        rest = iter(b)
        assert all(any(x == y for y in rest) for x, h in zip(a, hit) if h)


@pytest.mark.parametrize("every", [3, 4, 5, 0])
def test_leaks_with_words_changed_throughout(every):
    rng = random.Random(22)
    vocab = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}x" for i in range(500)]
    items = [(i, " ".join(rng.sample(vocab, 60))) for i in range(60)]
    index = leaks.LeakIndex(items)
    for i in (0, 17, 59):
        ws = [f"changed{k}" if every and k % every == 0 else w for k, w in enumerate(items[i][1].split())]
        text = "Some text before. " + ", ".join(ws) + ". And some behind."
        assert [x[0] for x in index.leaks(text)] == [i]
        ((item, a, b, n, share),) = index.spans(text)
        assert item == i and text[:a].startswith("Some text before.") and "And some" in text[b - 1 :] and share >= 0.5 and n >= 30


def test_leaks_in_several_passes(spark):
    rng = random.Random(23)
    vocab = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}x" for i in range(300)]
    items = [(i, " ".join(rng.choices(vocab, k=30))) for i in range(40)]
    docs = [(i, "Here it begins. " + " ".join(items[i][1].upper().split()[: 10 + i]) + " here it ends.") for i in range(40)] + [(100, None), (101, ""), (102, "nothing of it")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("cleaned", F.lit("clash"))
    e = spark.createDataFrame(items, "item_id bigint, text string")
    whole = {(r.doc_id, r.item_id) for r in leaks.leak_rows(d, e).collect()}
    assert whole and whole == {(r.doc_id, r.item_id) for r in leaks.leak_rows(d, e, most=1500).collect()}
    cleaned = {r.doc_id: r.cleaned for r in leaks.without_leaks(d, e).collect()}
    for k, t in docs:
        assert cleaned[k] == ("Here it begins. here it ends." if (k, k) in whole else t)
    assert leaks.leak_spans(d.limit(0), e).count() == 0 and leaks.without_leaks(d, e.limit(0)).where("cleaned = text").count() == 42


def test_leak_rows(spark):
    item = "The ferry mechanic swaps brass bolts for borrowed ones yet the pedozegard whistle still sounds late near the bahumiorsk quay tonight"
    docs = spark.createDataFrame([(1, item.upper(), 0), (1, item.upper(), 0), (2, None, 0), (3, "", 0), (4, "The ferry mechanic swaps brass bolts.", 0)], "doc_id bigint, text string, item_id int")
    items = spark.createDataFrame([(9, "t", item, "a"), (10, "t", None, None)], "item_id bigint, task string, text string, answer string")
    assert {(r.doc_id, r.item_id) for r in leaks.leak_rows(docs, items).collect()} == {(1, 9)}
    assert leaks.leak_rows(docs, items.limit(0)).count() == 0 and leaks.leak_rows(docs.limit(0), items).count() == 0


def test_names():
    assert names.parse_name("Tudovegard, Francesca") == ("tudovegard", ["francesca"], "")
    assert names.parse_name("Sodivamund WL") == ("sodivamund", ["w", "l"], "")
    assert names.parse_name("W. L. SODIVAMUND Jr.") == ("sodivamund", ["w", "l"], "jr")
    assert names.parse_name("Zufeloleax Lab. of Speech Robotics") == ("zufeloleax", ["speech", "robotics"], "")
    assert names.parse_name(None) is None and names.parse_name(" ") is None
    assert names.aligned(["walter", "l"], ["w"]) and not names.aligned(["walter", "l"], ["w", "k"]) and not names.aligned(["walter"], ["l"])
    assert names.aligned(["peggy"], ["margaret"]) and names.aligned(["frantesca"], ["francesca"])
    for a, b in combinations(["zupasokamp", "zuapsokamp", "zupasokamps", "zupasokam", "zupasokemp"], 2):
        assert names.one_edit(a, b) == (brute_edit(a, b) <= 1)


def test_assignment_against_brute_force():
    from itertools import permutations

    rng = random.Random(13)
    for _ in range(200):
        n, m = rng.randint(1, 4), rng.randint(4, 6)
        costs = [[rng.choice([0, 1, 2, 3, 1000]) for _ in range(m)] for _ in range(n)]
        assert names.assignment(costs) == min(sum(costs[i][k] for i, k in enumerate(order)) for order in permutations(range(m), n))
    words = ["anna", "clara", "a", "c", "an", "beth", "elizabeth", "w", "walter", "wa", "clarra"]

    def brute(a, b):
        a, b = sorted((a, b), key=len)
        best = 99
        for order in permutations(range(len(b)), len(a)):
            costs = [names._token_cost(x, b[k]) for x, k in zip(a, order)]
            if None not in costs:
                best = min(best, sum(costs) + 2 * sum(x > y for x, y in zip(order, order[1:])) + 4 * (order[0] != 0))
        return best < 4

    for _ in range(600):
        a, b = rng.choices(words, k=rng.randint(1, 4)), rng.choices(words, k=rng.randint(1, 6))
        assert names.aligned(a, b) == brute(a, b), (a, b)
        if names.aligned(a, b):
            assert set(names.first_keys(" ".join(a))[1]) & set(names.first_keys(" ".join(b))[0])
    long = [chr(97 + i) * 6 for i in range(24)]
    assert names.aligned(["anna", "clara"], ["anna", "eva", "marie", "clara", "ruth", "ida"]) and names.aligned(long, long[:3] + long[5:]) and not names.aligned(long, long[1:])
    assert names.aligned(["a"] * 9, ["a"] * 14) and not names.aligned(["a"] * 9 + ["x"], ["a"] * 14)


def test_short_names_and_chains(spark):
    rows = [("d1", 1, "Anna Chen"), ("d1", 2, "Anna Cehn"), ("d2", 1, "Bea Chen"), ("d3", 1, "Carl Smith"), ("d3", 2, "Carl Smth"), ("d4", 1, "Dora Kim"), ("d4", 1, "Dora Kin")]
    rows += [(f"{n} {i}", 1, n) for n, k in (("Max Radufeld", 9), ("Max Radufelt", 4), ("Max Radufelts", 2), ("Max Radufeltss", 1)) for i in range(k)]
    got = {(r.name_a, r.name_b) for r in names.spelling_links(spark.createDataFrame(rows, "doc_id string, run int, name string")).collect()}
    chain = sorted(["Max Radufeld", "Max Radufelt", "Max Radufelts", "Max Radufeltss"])
    assert got == {("Anna Cehn", "Anna Chen"), ("Carl Smith", "Carl Smth")} | set(combinations(chain, 2))


def brute_edit(a, b):
    d = [[i + j if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_name_links(spark):
    spell = ["Francesca Tudovegard", "F. Tudovegard", "Tudovegard, Fran", "Francesca TUDOOVEGARD", "Emilio Tudovegard", "Walter L. Sodivamund", "W. K. Sodivamund", "Sodivamund W", None, ""]
    rows = [(f"d{i}", 1, s) for i, s in enumerate(spell)] + [(f"e{i}", 1, "Francesca Tudovegard") for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id string, run int, name string")
    got = {(r.name_a, r.name_b) for r in names.spelling_links(df).collect()}
    one = sorted(spell[:4])
    assert got == set(combinations(one, 2)) | {tuple(sorted(p)) for p in (("Walter L. Sodivamund", "Sodivamund W"), ("W. K. Sodivamund", "Sodivamund W"))}
    assert names.spelling_links(df.limit(0)).count() == 0


def test_packing(spark):
    rng = random.Random(1)
    docs = [(i, "word " * rng.randint(1, 1500)) for i in range(400)] + [(900, "word " * 5000), (901, None), (902, ""), (903, "word"), (903, "word")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("size", F.lit("clash"))
    got = packing.pack(df).toPandas()
    assert (got.groupby("container")["size"].sum() == got.groupby("container").fill.first()).all() and got.fill.max() <= 2048
    assert set(got.doc_id) == {d for d, t in docs if t}
    assert got.container.nunique() <= 1.05 * got["size"].sum() / 2048 + 2
    assert packing.pack(df.limit(0)).count() == 0


def test_packing_rule_against_brute_force():
    rng = random.Random(2)
    state = packing.SumOfSquares(20)
    for _ in range(400):
        size = rng.randint(1, 20)
        n = state.open.copy()
        options = [(2 * int(n[20 - size]) + 1 if size < 20 else 0, 21)]
        for room in range(size, 21):
            if n[room]:
                m = n.copy()
                m[room] -= 1
                if room > size:
                    m[room - size] += 1
                options.append((int((m[1:] ** 2).sum() - (n[1:] ** 2).sum()), room))
        state.place(size)
        after = int((state.open[1:] ** 2).sum() - (n[1:] ** 2).sum())
        assert after == min(o[0] for o in options)


def test_pii(spark):
    texts = [
        (1, "Please write to Ingrid Radumifeld at ingrid.radu@mail.example.com or call +44 20 7946 0149."),
        (2, "We thank Vera Trepulofeld and James Bifohalen for help. See 228 Tannery Court, Marlowe Springs VB3 2QT."),
        (3, "Her passport QQ 09 79 06 B was checked. Samples 9372-9-961 were pooled on 2014-05-19."),
        (4, "jane_doe (at) mail dot example dot com is the address. According to Kaler et al. (2001) it works."),
        (5, None), (6, ""), (7, "Die Unterlagen gehen an Arvid Zubamebek, Kesselgasse 4a, 99370 Grauental."), (1, "Please write to Ingrid Radumifeld at ingrid.radu@mail.example.com or call +44 20 7946 0149."),
    ]
    df = spark.createDataFrame(texts, "doc_id bigint, text string").withColumn("spans", F.lit("clash"))
    got = {(r.doc_id, r.pii, r.a) for r in pii.mentions(df).collect()}
    t = dict(texts)
    for d, kind, piece in [(1, "email", "ingrid.radu"), (2, "address", "228 Tannery"), (4, "email", "jane_doe"), (7, "address", "Kesselgasse"), (1, "name", "Ingrid Rad"), (2, "name", "Vera T"), (2, "name", "James B")]:
        assert (d, kind, t[d].index(piece)) in got, piece
    assert not any(d == 3 and a in (t[3].index("9372"), t[3].index("2014")) for d, _, a in got)
    red = {r.doc_id: r.redacted for r in pii.redact(df.dropDuplicates(["doc_id"])).collect()}
    assert red[4].startswith("[EMAIL] is the address.") and red[5] is None and red[6] == ""
    assert pii.mentions(df.limit(0)).count() == 0


def test_pii_in_any_script(spark):
    people = ["Šárka Novaková", "Łukasz Wiśniewski", "Иван Петров", "Ελένη Παππά", "Ingrid Radumifeld", "Vera Trepulofeld", "James Bifohalen"]
    rows = [(k, f"We thank {p} for help. They wrote it.") for k, p in enumerate(people)] + [(10 + k, f"We thank {p.split()[0]} Zubamebek for help. Later we asked {p.split()[0]} Otherfeld again.") for k, p in enumerate(people)]
    rows += [(30 + k, f"We thank {g} Dokosokamp for help.") for k, g in enumerate(("Anna", "Carl", "Emma", "Hugo", "Laura", "Oscar", "Ruth", "Simon"))]
    rows += [(90, "It took 75.15 ms. See Books 12 for tables."), (91, "x" * 300 + f". We thank {people[0]} for help."), (92, "Card 1234 5678 9012 3456 78 is none.")]
    got = {(r.doc_id, r.pii, r.a) for r in pii.mentions(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {(k, "name", 9) for k in (*range(7), *range(30, 38))} | {(10 + k, "name", 9) for k in range(7)} | {(10 + k, "name", rows[7 + k][1].rindex(p.split()[0])) for k, p in enumerate(people)} | {(91, "name", 311)}
    assert pii.left_context("in 75.15 ms. See", 13) == ("^", "^") and pii.left_context("y" * 99 + " " + "z" * 99 + " A", 200) == ("z" * 99, "y" * 99)


def page(doc, page_no, top, rows, header=None, number=None):
    out = []
    if header:
        x = 71.3
        for w in header.split():
            out.append((doc, page_no, x, top - 25.4, x + 5 * len(w), top - 16.0, w))
            x += 5 * len(w) + 5
    for k, row in enumerate(rows):
        x = 58.0
        for w in row.split():
            out.append((doc, page_no, x, top + 14.5 * k, x + 5 * len(w), top + 14.5 * k + 10, w))
            x += 5 * len(w) + 5
    if number:
        out.append((doc, page_no, 80.7, 737.2, 95.0, 745.0, number))
    return out


def test_scan_noise(spark):
    body = ["the surface was cleaned and the reso-", "nance of the surface was measured with a", "finite-element code. The surfacc held, the", "finite-", "element code and resonance agreed, pre- and", "post-test scans of the surface were clean"]
    rows = []
    for p in range(6):
        lines = [x.replace("surfacc", "surface") for x in body]
        rows += page("d", p, 80.0, lines * 2 + (body if p == 3 else lines), "Kaler et al. Annals of Tests 12 (1999)" if p else None, str(340 + p))
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)] + [("d", 0, None, None, None, None, None, 9999), ("d", 0, 1.0, 1.0, 2.0, 2.0, "", 9998)], "doc_id string, page int, x0 double, y0 double, x1 double, y1 double, text string, pos int")
    df = df.unionByName(df.where("page = 2")).withColumn("line", F.lit("clash"))
    units = spark.createDataFrame([("d", 0, "the surface was cleaned and the reso- nance held"), ("d", 1, "the surfacc Kaler et al. Annals of Tests 12 (1999) 343 was clean"), ("d", 2, None), ("other", 0, "reso- nance"), ("d", 0, "the surface was cleaned and the reso- nance held")], "doc_id string, pos int, text string")
    noise = scans.ScanNoise(df, units)
    got = {(r.tab, r.pos, r.noise) for r in noise.found().collect()}
    texts = {i: r for i, r in enumerate(rows)}
    word = lambda kind: {texts[p][6] for tab, p, n in got if tab == "words" and n == kind}
    assert word("break") == {"reso-"} and word("glyph") == {"surfacc"} and word("pageno") == {str(340 + p) for p in range(6)}
    assert word("header") == set("Kaler et al. Annals of Tests 12 (1999)".split())
    assert {(p, n) for tab, p, n in got if tab == "units"} == {(0, "break"), (1, "glyph"), (1, "header"), (1, "pageno")}
    text = " ".join(r.text for r in noise.paragraphs().collect())
    assert "resonance of the surface" in text and "finite-element code and" in text and "surfacc" not in text and "Annals" not in text
    empty = scans.ScanNoise(df.limit(0), units)
    assert empty.found().count() == 0 and empty.paragraphs().count() == 0


def test_paragraphs_run_over_pages(spark):
    filler = ["the surface was clean and the resonance of", "the surface was measured with care and the", "resonance held while the surface was measured"]
    one = ["    The surface of the plate was measured with", *filler, "and the surface was measured, and the reso-"]
    two = ["nance) of the surface was clean and the surfacc", *filler, "was clean. Then the resonance, and the rcso-", "nance held the pre-", "and post-test (finite-", "element) surface was measured."]
    three = ["3 Results", *filler, "and the resonance was clean.", "    Another surface was measured with care", *filler]
    four = ["    The next page begins with an indented line", *filler, "and the surface held."]
    rng = random.Random(6)
    rows = []
    for p, lines in enumerate([one, two, three, four, filler * 3, filler * 3, ["finite-element code", "finite-element code", "finite-element code", "post-test code"]]):
        for k, line in enumerate(lines):
            x = 58.0 + (10 if line.startswith("    ") else 0)
            for w in line.split():
                rows.append(("d", p, x, 80.0 + 14.5 * k, x + 5 * len(w), 90.0 + 14.5 * k, w))
                x += 5 * len(w) + 5 + rng.randint(0, 6)  # words one below another would be a second column
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id string, page int, x0 double, y0 double, x1 double, y1 double, text string, pos int")
    units = spark.createDataFrame([("d", 0, "The rcso- nance held, pre- and post-test; the Surfacc (reso- nance) was clean"), ("d", 1, None), ("d", 2, ""), ("other", 0, "reso- nance")], "doc_id string, pos int, text string")
    noise = scans.ScanNoise(df, units)
    got = [(r.page, r.text) for r in noise.paragraphs().orderBy("doc_id", "para").collect()]
    flow = " ".join(filler)
    assert got[0] == (0, f"The surface of the plate was measured with {flow} and the surface was measured, and the resonance) of the surface was clean and the surface {flow} was clean. Then the resonance, and the resonance held the pre- and post-test (finite-element) surface was measured.")
    assert got[1] == (2, f"3 Results {flow} and the resonance was clean.")
    assert got[2] == (2, f"Another surface was measured with care {flow}")
    assert got[3][0] == 3 and got[3][1].startswith("The next page begins") and len(got) == 4
    assert [r.para for r in scans.ScanNoise(df.where("page > 3"), units).paragraphs().collect()] == [0]
    assert {(r.pos, r.text) for r in noise.repaired_units().collect()} == {(0, "The resonance held, pre- and post-test; the Surface (resonance) was clean")}
    empty = scans.ScanNoise(df.limit(0), units)
    assert empty.paragraphs().count() == 0 and empty.repaired_units().count() == 0


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_runs(name, spark, data):
    df = queries.QUERIES[name](spark, data)
    assert df.count() >= 0 and len(df.columns) == len(set(df.columns))


def test_tables_of_names_are_never_broadcast(spark):
    from vellumine.llm import names

    rows = [("d1", 1, "Anna Kowalska"), ("d1", 2, "A. Kowalska"), ("d2", 1, "Anna Kowlska"), ("d3", 1, "Bo Lind")]
    links = names.spelling_links(spark.createDataFrame(rows, "doc_id string, run int, name string"))
    usual = names.usual_forms(spark.createDataFrame([("anna", 80), ("ana", 2)], "w string, n bigint"), 8.0, 2)
    for df in (links, usual):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert ("A. Kowalska", "Anna Kowalska") in {(r.name_a, r.name_b) for r in links.collect()}
    assert [tuple(r) for r in usual.collect()] == [("ana", "anna")]
