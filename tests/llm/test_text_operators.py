import hashlib
import random
import re

import pytest

from casehours.llm import chat, decontaminate, langid, sentence_spans
from casehours.llm.common import table
from tests.llm.helpers import DOCS, edited, frame, odd_texts, prose

DATA = "/root/testdata/sf0.01"


def test_language_held_out_accuracy(spark):
    docs = table(spark, DATA, "documents")
    got = langid.identified(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert len(got) > 250 and (got.lang_pred == got.lang).mean() > 0.98
    assert got.score.between(0, 1).all()


def test_language_of_awkward_texts(spark):
    rng = random.Random(8)
    fr = "éaile que les réaux de la ou ment tion"
    rows = [(i, prose(rng, 80), "en", None, None, 1) for i in range(60)] + [(100 + i, " ".join(rng.sample(fr.split(), 9) * 8), "fr", None, None, 1) for i in range(60)]
    rows += [(300 + i, t, None, None, None, 1) for i, t in enumerate(odd_texts(rng))] + [(None, "12 34 !!", None, None, None, 1), (None, None, "en", None, None, 1)]
    df = spark.createDataFrame(rows, DOCS + ", held_out int")
    got = langid.identified(df).collect()
    assert len(got) == len(rows)
    named = {r["doc_id"]: r for r in got}
    assert named[300]["lang_pred"] == "und" and named[301]["lang_pred"] == "und" and named[300]["score"] == 0
    assert all(r["lang_pred"] in ("en", "fr", "und") and 0 <= r["score"] <= 1 for r in got)
    assert all(r["lang_pred"] == "und" and not r["held_out"] for r in got if r["doc_id"] is None)
    assert langid.identified(spark.createDataFrame([], DOCS)).count() == 0
    unlabelled = langid.identified(spark.createDataFrame([(1, "abc", None, None, None)], DOCS)).collect()
    assert unlabelled[0]["lang_pred"] == "und"
    assert langid.keep_identified(df).columns == df.columns


def brute_languages(rows, held_out):
    """Predictions from plain sets of n-grams, each false positive of the filters aside."""
    from collections import Counter

    def grams(text):
        out, t = [], " " + re.sub(r"[\x00-\x7f]", lambda m: m[0].lower() if m[0].isalpha() else " ", text.translate({c: c + 32 for c in range(0xC0, 0xDF) if c != 0xD7})) + "  "
        data = t.encode()
        for k in range(len(data) - langid.GRAM + 1):
            g = data[k : k + langid.GRAM]
            if sum(b != 32 for b in g) >= 2:
                out.append(g)
        return out

    counts = {}
    for i, text, lang in rows:
        if lang is not None and text is not None and not held_out(i):
            counts.setdefault(lang, Counter()).update(grams(text))
    known = {x: {g for g, n in c.items() if n >= max(2.0, sum(c.values()) * 4e-5)} for x, c in sorted(counts.items())}
    out = []
    for i, text, _ in rows:
        own = grams(text or "")
        hits = {x: sum(g in k for g in own) for x, k in known.items()}
        best = max(hits, key=hits.get) if re.search(r"[^\W\d_]", text or "") else "und"
        out.append((i, best, hits[best] / len(own) if best != "und" and own else 0.0))
    return out


def test_language_against_brute_force(spark):
    import zlib

    rng = random.Random(18)
    alphabets = {f"l{k:02d}": [prose(rng, 1).rstrip(".") for _ in range(40)] for k in range(70)}
    rows, at = [], 0
    for lang, words in alphabets.items():
        for _ in range(9):
            rows.append((at, " ".join(rng.choices(words, k=60)), lang))
            at += 1
    rows += [(at, rows[0][1].upper(), None), (at + 1, "É Ü × ß " + rows[9][1], None), (at + 2, "12 ?!", "l00"), (at + 3, None, "l00"), (at + 4, "", None), (at + 4, "", None), (at + 5, rows[30][1], "l03"), (at + 6, rows[30][1], "l03")]
    df = spark.createDataFrame([(i, t, x, None, 0, True, "q") for i, t, x in rows], DOCS + ", held_out boolean, code string")
    got = sorted((r["doc_id"], r["lang_pred"], r["score"]) for r in langid.identified(df).collect())
    expected = sorted(brute_languages(rows, lambda i: zlib.crc32(str(i).encode()) % 3 == 1))
    assert [g[0] for g in got] == [e[0] for e in expected]
    assert sum(g[1] == e[1] for g, e in zip(got, expected, strict=True)) >= len(rows) - 2  # the correction is an estimate
    assert all(abs(g[2] - e[2]) < 0.02 for g, e in zip(got, expected, strict=True))
    assert {g[1] for g in got} == {*alphabets, "und"}


SENTENCES, LONG_WORDS = sentence_spans.SENTENCES, sentence_spans.LONG_WORDS


def brute_spans(texts: dict) -> dict:
    """Sentences removed of each document, by plain Python."""
    def sentences(t):
        out, own, at = [], [], 0
        for m in re.finditer(r"[^\x20\x09-\x0D]+", t):
            if own and (re.search(r"[.!?][\"')\]}]?$", own[-1]) or re.search(r"[\r\n]", t[at : m.start()])):
                out.append(own)
                own = []
            own.append(m[0])
            at = m.end()
        return [*out, own] if own else out

    places = {}
    for i, t in sorted(texts.items()):
        s = [[re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in x] for x in sentences(t or "")]
        for a in range(len(s)):
            words = []
            for b in range(a, min(len(s), a + SENTENCES)):  # longer runs cover nothing that these do not
                words += s[b]
                if b + 1 - a == min(SENTENCES, len(s)) or len(words) >= LONG_WORDS:
                    places.setdefault(tuple(words), []).append((i, a, b + 1))
    out = {}
    for own in places.values():
        for i, a, b in own:
            if (i, a) != min(own)[:2]:
                out.setdefault(i, set()).update(range(a, b))
    return out


def test_sentence_spans_against_brute_force(spark):
    rng = random.Random(9)
    passages = [prose(rng, n) for n in (25, 60, 80, 200)]
    texts = [" ".join([prose(rng, rng.randint(5, 60)) + ".", rng.choice(passages) + ".", prose(rng, 30)]) for _ in range(40)] + odd_texts(rng) + [passages[2] + ".\n" + passages[2], "w " * 70, prose(rng, 9) + ". " + "w " * 70, "one short text", "One  short\ttext"]
    got = {r["doc_id"]: r for r in sentence_spans.repeated_sentences(frame(spark, texts)).collect()}
    expected = brute_spans(dict(enumerate(texts)))
    assert set(got) == set(expected)
    for i, r in got.items():
        assert {k for a, b in r["removed_spans"] for k in range(a, b)} == expected[i], i
        assert r["removed"] == len(expected[i]) and min(r["first_docs"]) <= i


def all_run_spans(texts: list[list[str]]) -> dict:
    """Sentences removed when all runs, short and long, are compared; texts as lists of sentences."""
    places = {}
    for i, s in enumerate(texts):
        for a in range(len(s)):
            for b in range(a + 1, len(s) + 1):
                words = " ".join(s[a:b]).split()
                if b - a >= min(SENTENCES, len(s)) or len(words) >= LONG_WORDS:
                    places.setdefault(tuple(words), []).append((i, a, b))
    out = {}
    for own in places.values():
        for i, a, b in own:
            if (i, a) != min(own)[:2]:
                out.setdefault(i, set()).update(range(a, b))
    return out


def test_sentence_spans_cover_all_runs(spark):
    rng = random.Random(13)
    sentence = lambda n: " ".join(prose(rng, 1).rstrip(".") for _ in range(n)) + "."
    passages = [[sentence(n) for n in lengths] for lengths in [(25, 5, 5), (55, 40), (15, 3, 10), (3, 3, 30), (60,), (30,), (19,), (4, 4, 4)]]
    passages += [[sentence(rng.choice((1, 2, 5, 9, 21, 52))) for _ in range(rng.randint(1, 6))] for _ in range(20)]
    texts = [[sentence(7), *p, sentence(30)] for p in passages for _ in range(2)]
    for _ in range(30):
        drawn = [rng.choice(passages) for _ in range(3)]
        texts.append([s for p in drawn for s in [sentence(rng.randint(1, 30)), *p[rng.randint(0, len(p) - 1) :]]])
    got = {r["doc_id"]: r for r in sentence_spans.repeated_sentences(frame(spark, [" ".join(t) for t in texts])).collect()}
    assert {i: {k for a, b in r["removed_spans"] for k in range(a, b)} for i, r in got.items()} == all_run_spans(texts)
    assert got[1]["removed_spans"] == [[1, 4]] and got[3]["removed_spans"] == [[1, 3]]
    assert got[9]["removed_spans"] == [[1, 2]] and 11 not in got and 13 not in got  # one sentence of 60, 30, 19 words
    assert got[15]["removed_spans"] == [[1, 4]]  # three short sentences


def test_sentence_spans_awkward_rows(spark):
    text = prose(random.Random(10), 90)
    df = spark.createDataFrame([(None, text, None, None, None, 1), (2, text, None, None, None, 1), (2, text, None, None, None, 1), (1, text, None, None, None, 1)], DOCS + ", span int")
    got = sentence_spans.repeated_sentences(df).collect()
    assert sorted(map(str, (r["doc_id"] for r in got))) == ["2", "2", "None"] and all(r["text"] == "" and r["first_docs"] == [1] for r in got)
    assert sentence_spans.repeated_sentences(spark.createDataFrame([], DOCS)).count() == 0


def test_sentence_spans_passages_inside_sentences(spark):
    rng = random.Random(15)
    words = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(8)) for _ in range(n)]
    p50, p49, p120 = words(50), words(49), words(120)
    texts = [
        [*words(30), *p50, *words(20)], [*words(9), *p50, *words(70)],  # one sentence each
        [*words(40), *p49, *words(40)], [*p49, *words(60)],
        [*words(5), *p120[:60], "x.", *p120[60:], *words(3)], [*words(8), *p120[10:60], "x.", *p120[60:100], *words(5)], [*p120[20:60], "X.", *p120[60:90], *words(9)],
        ["w"] * 300,  # repeats only itself
    ]
    df = frame(spark, [" ".join(t) for t in texts])
    got = {r["doc_id"]: r for r in sentence_spans.repeated_sentences(df, least_words=15, passage_words=50).collect()}
    assert {i: (r["removed_passages"], r["first_docs"]) for i, r in got.items()} == {1: ([[9, 59]], [0]), 5: ([[8, 99]], [4]), 6: ([[0, 71]], [4])}
    assert got[1]["text"].split() == texts[1][:9] + texts[1][59:] and got[6]["text"].split() == texts[6][71:]
    assert sentence_spans.repeated_sentences(df).count() == 0
    rows = [(i, " ".join(texts[k]), None, None, None) for i, k in ((None, 1), (7, 0), (7, 5), (3, 2))]  # rows of one id, or without one
    got = sentence_spans.repeated_sentences(spark.createDataFrame(rows, DOCS), passage_words=50).collect()
    assert [(r["doc_id"], r["first_docs"], r["removed_passages"]) for r in got] == [(None, [7], [[9, 59]])]


def test_sentence_spans_have_least_words(spark):
    rng = random.Random(16)
    sentence = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(8)) for _ in range(n)) + "."
    passages = [[sentence(n) for n in lengths] for lengths in [(1, 1, 1), (5, 5, 4), (5, 5, 5), (4, 4, 4, 4, 1), (2,) * 9, (20, 20), (50,)]]
    texts = [[sentence(7), *p, sentence(30)] for p in passages for _ in range(2)]
    got = {r["doc_id"]: r["removed_spans"] for r in sentence_spans.repeated_sentences(frame(spark, [" ".join(t) for t in texts]), least_words=15).collect()}
    assert got == {5: [[1, 4]], 7: [[1, 6]], 9: [[1, 10]], 13: [[1, 2]]}
    kept = {r["doc_id"] for r in sentence_spans.repeated_sentences(frame(spark, [" ".join(t) for t in texts])).collect()}
    assert kept == {1, 3, 5, 7, 9, 13}


@pytest.mark.parametrize("step", (1, -1))
def test_sentence_spans_of_repeated_ids(spark, step):
    rng = random.Random(14)
    sentence = lambda n: " ".join(prose(rng, 1).rstrip(".") for _ in range(n)) + "."
    s, u = (" ".join(sentence(5) for _ in range(3)) for _ in range(2))
    x, y, v = (sentence(6) for _ in range(3))
    rows = [(1, f"{s} {x}"), (5, f"{s} {y}"), (5, f"{u} {v}"), (None, f"{u} {x}"), (None, f"{y} {v}")][::step]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS)
    got = [(r["doc_id"], r["text"], r["first_docs"]) for r in sentence_spans.repeated_sentences(df).collect()]
    assert sorted(got, key=str) == sorted([(5, y, [1]), (None, x, [5])], key=str)


BENCH = "item_id long, text string, template int"


def test_decontamination_values_of_several_words(spark):
    rng = random.Random(21)
    story = "So then {} bought {} red pens and {} old books in {} today and went straight back to the small house by the river"
    german = "dann kaufte der alte mann {} rote stifte und {} alte bücher für das kleine haus an dem langen fluss"
    items = [story.format("Mary Ann", "twenty-one", "thirty two", "New York"), german.format("vier", "1 200")]
    texts = [f"{prose(rng, 20)}. {t} {prose(rng, 20)}" for t in (story.format("Otto", "seven", "9", "Rome"), story.format("Mary Ann", "twenty-one", "thirty two", "New York"), story.format("Jean Paul Otto", "1 200 000", "ninety-one", "Rome"), german.format("dreizehn", "7"))]
    bench = spark.createDataFrame([(i, t, 0) for i, t in enumerate(items)], BENCH)
    got = {(r["doc_id"], r["item_id"]): (r["kind"], r["consistent"]) for r in decontaminate.contaminations(frame(spark, texts), bench).collect()}
    assert got == {(0, 0): ("reparameterised", True), (1, 0): ("verbatim", True), (2, 0): ("reparameterised", True), (3, 1): ("reparameterised", True)}


def test_decontamination_numbers_map_one_to_one_where_windows_are_missing(spark):
    rng = random.Random(22)
    words = [w.rstrip(".") for w in prose(rng, 40).split()]
    item = " ".join([*words[:5], "7", *words[5:10], "7", *words[10:15], "7", *words[15:30]])
    part = lambda a, b, c: " ".join([*words[:5], a, *words[5:10], b, *words[10:15], c, words[15]])
    whole = lambda a, b, c: f"{part(a, b, c)} {' '.join(words[16:30])}"
    texts = [f"{prose(rng, 20)} {t} {prose(rng, 20)}" for t in (part("3", "3", "3"), part("3", "4", "5"), part("7", "7", "7"), whole("3", "4", "5"))]
    bench = spark.createDataFrame([(0, item, 0)], BENCH)
    got = {r["doc_id"]: (r["kind"], r["consistent"]) for r in decontaminate.contaminations(frame(spark, texts), bench).collect()}
    assert got == {0: ("reparameterised", True), 2: ("verbatim", True), 3: ("reparameterised", False)}


def test_decontamination(spark):
    rng = random.Random(11)
    items = [prose(rng, 30) for _ in range(20)] + ["yesterday the farmer Otto gave 12 kg of apples to Berta and 3 more apples to Otto before the long evening market closed", "too short to tell", None]
    other = "yesterday the farmer Anna gave 950 mg of apples to Carlos and 7.5 more apples to Anna before the long evening market closed"
    torn = "yesterday the farmer Anna gave 950 mg of apples to Carlos and 7.5 more apples to Peter before the long evening market closed"
    texts = [prose(rng, 50) for _ in range(60)] + odd_texts(rng)
    leaks = {(len(texts) + k, k): "verbatim" for k in range(10)}
    texts += [f"{prose(rng, 40)} {items[k]} {prose(rng, 30)}" for k in range(10)]
    leaks[(len(texts), 20)] = "reparameterised"
    texts.append(f"{prose(rng, 20)}. So {other} and so on")
    texts.append(f"{prose(rng, 20)}. So {torn} and so on")
    leaks[(len(texts), 3)] = "verbatim"
    texts.append(items[3].upper())
    bench = spark.createDataFrame([(i, t, 0) for i, t in enumerate(items)], BENCH)
    got = {(r["doc_id"], r["item_id"]): r["kind"] for r in decontaminate.contaminations(frame(spark, texts), bench).collect()}
    assert got == leaks
    shuffled = {(r["doc_id"], r["item_id"]): r["kind"] for r in decontaminate.contaminations(frame(spark, texts), bench, broadcast_windows=0).collect()}
    assert shuffled == leaks
    kept = decontaminate.drop_contaminated(frame(spark, texts), bench)
    assert {r["doc_id"] for r in kept.collect()} == set(range(len(texts))) - {d for d, _ in leaks}


def test_decontamination_conflicting_values(spark):
    rng = random.Random(14)
    parts = [prose(rng, 14).replace(".", "") for _ in range(4)]
    item = "{} then 12 of them saw Otto, {} until 12 others met Otto there {} {}"
    fruit = "a basket holds {} apples that were shared among {} friends who ate them all before the long walk back home"
    items = [item.format(*parts), fruit.format(3, 3)]
    numbers = items[0].replace("12 others", "13 others")
    names = items[0].replace("met Otto", "met Anna")
    texts = [f"{prose(rng, 20)} {t} {prose(rng, 20)}" for t in (items[0], numbers, names, fruit.format(5, 4), prose(rng, 60))]
    bench = spark.createDataFrame([(i, t, 0) for i, t in enumerate(items)], BENCH)
    for few in (decontaminate.BROADCAST_WINDOWS, 0):
        got = {(r["doc_id"], r["item_id"]): r["kind"] for r in decontaminate.contaminations(frame(spark, texts), bench, broadcast_windows=few).collect()}
        assert got == {(0, 0): "verbatim", (1, 0): "reparameterised", (2, 0): "reparameterised", (3, 1): "reparameterised"}
    assert {r["doc_id"] for r in decontaminate.drop_contaminated(frame(spark, texts), bench).collect()} == {4}


def found(spark, texts, items, **options):
    bench = spark.createDataFrame([(i, t, 0) for i, t in enumerate(items)], BENCH)
    return {(r["doc_id"], r["item_id"]): r["kind"] for r in decontaminate.contaminations(frame(spark, texts), bench, **options).collect()}


def test_decontamination_short_and_number_heavy_items(spark):
    rng = random.Random(15)
    line = "12 7 99 3 1044 8 15 16 23 42 4 108"
    items = ["What is 3 plus 4", "name the capital", "yes", line]
    texts = [f"{prose(rng, 20)} {t} {prose(rng, 20)}" for t in (items[0], "what is 3 plus 5", items[1].upper(), "yes", line, line.replace("23", "24").replace("99", "98"))] + ["Yes!"]
    expected = {(0, 0): "verbatim", (2, 1): "verbatim", (6, 2): "verbatim", (4, 3): "verbatim"}
    assert found(spark, texts, items) == found(spark, texts, items, broadcast_windows=0) == expected


def test_decontamination_names_and_number_words(spark):
    rng = random.Random(16)
    story = "{0} has {1} sweet apples in the basket and gives {2} of them to {3} on the way home. How many sweet apples does {0} still have in the basket?"
    drive = "{0} drove {1} miles through the long cold night until the road was closed by snow near the river"
    items = [story.format("Alice", "12", "5", "Bob"), drive.format("John", "three")]
    texts = [f"{prose(rng, 20)}. {t} {prose(rng, 20)}" for t in (story.format("Maria", "40", "nine", "Pedro"), drive.format("Peter", "seven"), drive.format("John", "three"))]
    assert found(spark, texts, items) == {(0, 0): "reparameterised", (1, 1): "reparameterised", (2, 1): "verbatim"}


def brute_contaminations(texts, items):
    """(document, first item of the class): kind, by comparing every place of every document with every place of every item."""
    import regex

    d, w = decontaminate, decontaminate.WINDOW

    def read(text):
        t = regex.sub(d._UNIT, "\\1 \x03\\2", regex.sub(d._IN_GROUPS, "\x05", text or ""))
        t = regex.sub(d._IN_NAME, "\x06", regex.sub(d._NAME, "\x02\\1", t))
        t = regex.sub(d._FIRST, "\\1\x04\\2", t)
        marked = regex.findall(d._TOKEN, t.lower())
        inside = {x[1:] for x in marked if x[0] == "\x02"}
        words = [("\x02" if x[1:] in inside else "") + x[1:] if x[0] == "\x04" else x for x in marked]
        joined = []
        for k, x in enumerate(words):
            counts = x in d.NUMBER_WORDS or x == "one" and k > 0 and words[k - 1] in d.NUMBER_WORDS
            joined = [*joined[:-1], (f"{joined[-1][0]}\x05{x}", True)] if counts and joined and joined[-1][1] else [*joined, (x, counts)]
        words = [x for x, _ in joined]
        kinds = [1 if "0" <= x[0] <= "9" or x in d.NUMBER_WORDS or "\x05" in x else ord(x[0]) if x[0] in "\x02\x03" else x for x in words]
        return words, kinds

    def literals(kinds):
        return len({k for k in kinds if isinstance(k, str)})

    classes = {}
    for i, t in enumerate(items):
        words, kinds = read(t)
        slots = [x for x, k in zip(words, kinds, strict=True) if not isinstance(k, str)]
        if words:
            classes.setdefault((tuple(kinds), tuple(map(slots.index, slots))), []).append((i, words))
    out = {}
    for doc, t in enumerate(texts):
        words, kinds = read(t)
        for (item_kinds, _), members in classes.items():
            n, first = len(item_kinds), members[0][1]
            rich = [q for q in range(n - w + 1) if literals(item_kinds[q : q + w]) >= d.LITERALS]
            kinds_found = []
            for offset in range(-n, len(words)):
                hits = {}
                for q in range(max(n - w + 1, 1)):
                    length = min(n, w)
                    own, p = words[offset + q : offset + q + length], offset + q
                    if p < 0 or len(own) < length or (n < d.LEAST_INSIDE and len(words) != n):
                        continue
                    if q in rich and tuple(kinds[p : p + w]) == item_kinds[q : q + w]:
                        hits[q] = (not any(m[q : q + w] == own for _, m in members), [(k, a, b) for k, a, b in zip(item_kinds[q : q + w], first[q : q + w], own, strict=True) if not isinstance(k, str)])
                    elif q not in rich and any([x.lstrip("\x02\x03") for x in m[q : q + length]] == [x.lstrip("\x02\x03") for x in own] for _, m in members):
                        hits[q] = (False, [])
                pairs = {x for _, slots in hits.values() for x in slots}
                torn = {(k, a) for k, a, _ in pairs if len({y for j, x, y in pairs if (j, x) == (k, a)}) > 1}
                good = lambda bad: [q for q, (other, slots) in hits.items() if not other or not any((k, a) in bad for k, a, _ in slots)]  # noqa: B023, E731
                loose, strict = good({t for t in torn if t[0] == 2}), good(torn)
                windows = max(n - w + 1, 1)
                whole = len(loose) >= windows or rich and set(rich) <= set(loose)
                counted = loose if whole else strict
                need = lambda m: min(d.NEED, -(-m // 2))
                if counted and (len(counted) >= need(windows) or rich and len(set(counted) & set(rich)) >= need(len(rich))):
                    kinds_found.append(any(other for other, _ in hits.values()))
            if kinds_found:
                out[doc, members[0][0]] = "reparameterised" if all(kinds_found) else "verbatim"
    return out


def test_decontamination_against_brute_force(spark):
    rng = random.Random(17)
    names, units = ["Otto", "Berta", "Anna", "Carlos"], ["kg", "miles", "%"]

    def item(n):
        return " ".join(rng.choice([prose(rng, 1).rstrip("."), str(rng.randint(1, 9)), rng.choice(names), f"{rng.randint(1, 9)} {rng.choice(units)}", "seven", prose(rng, 2)]) for _ in range(n)) + rng.choice([".", "?", ""])

    def altered(t):
        t = re.sub(r"\d+", lambda m: str(rng.randint(1, 99)) if rng.random() < 0.5 else m[0], t)
        for a in names:
            if rng.random() < 0.4:
                t = t.replace(a, rng.choice(names), rng.choice([1, -1]))
        return t

    items = [item(rng.choice([1, 2, 3, 5, 9, 14, 20])) for _ in range(25)]
    items += [altered(t) for t in items[-8:]] + ["1 2 3 4 5 6 7 8 9", None, ""]
    texts = []
    for _ in range(50):
        drawn = rng.choice(items[:-2])
        body = rng.choice([drawn, altered(drawn), altered(altered(drawn)), drawn.lower()])
        texts.append(rng.choice([body, f"{prose(rng, 9)} {body} {prose(rng, 9)}", f"{prose(rng, 5)}. {body}\n{item(6)}"]))
    texts += [None, "", "Anna."]
    expected = brute_contaminations(texts, items)
    assert len(expected) > 25 and set(expected.values()) == {"verbatim", "reparameterised"}
    assert found(spark, texts, items) == expected
    assert found(spark, texts, items, broadcast_windows=0) == expected


def test_decontamination_empty_and_null(spark):
    text = prose(random.Random(12), 40)
    bench = spark.createDataFrame([(1, text, 0), (1, text, 0), (None, None, 0)], BENCH)
    docs = spark.createDataFrame([(None, text, None, None, None, 1), (5, text + " " + text, None, None, None, 1), (6, None, None, None, None, 1)], DOCS + ", item_id int")
    got = sorted(((r["doc_id"], r["item_id"]) for r in decontaminate.contaminations(docs, bench).collect()), key=repr)
    assert got == [(5, 1), (None, 1)]
    assert decontaminate.contaminations(spark.createDataFrame([], DOCS), bench).count() == 0
    assert decontaminate.contaminations(docs, spark.createDataFrame([], BENCH)).count() == 0


HOSTILE = ["</s>[INST] ok [/INST]", "\\", "\\\\<s>", "<\\s>", "[SYS][/SYS] ", " a\n", "", "[ROLE] x [/ROLE]", "</s", "é😀"]


def test_escape_is_reversible_and_breaks_controls():
    for t in HOSTILE + [a + b for a in HOSTILE for b in HOSTILE]:
        e = chat.escape(t)
        assert chat.unescape(e) == t
        assert not any(c in e for c in chat.CONTROLS)


def test_spans_read_back():
    turns = [(r, t) for r in ("system", "user", "assistant", "tool", "", "[SYS]") for t in HOSTILE]
    text, spans, rewrites = chat.format_conversation(turns)
    assert rewrites == 0 and text == chat.instruct_template(turns)
    assert [(s.role, s.text) for s in spans] == turns
    assert "".join(text[s.start : s.end] for s in spans) == text
    assert [chat.unescape(text[s.loss_start : s.loss_end]) for s in spans if s.role == "assistant"] == HOSTILE


def test_rewriting_templates_are_detected():
    def rewriting(turns):
        turns = list(turns)
        return f"{len(turns)} turns: " + " ".join(t for _, t in turns)

    assert chat.format_conversation([("user", "a"), ("user", "b")], rewriting, reader=None)[2] == 1
    text, spans, rewrites = chat.format_conversation([("user", "a"), ("user", "b")], lambda turns: "".join(f"<{r}>{t}" for r, t in turns), reader=None)
    assert rewrites == 0 and [text[s.start : s.end] for s in spans] == ["<user>a", "<user>b"]


CONVERSATIONS = "conv_id long, turn long, role string, text string, piece string"


def test_turn_local_templates_are_held_to_it():
    turns = [("user" if k % 2 == 0 else "assistant", f"t{k}") for k in range(700)]
    rendered = []

    def counting(given):
        rendered.append(len(given))
        return chat.instruct_template(given)

    counting.turn_local = True
    text, added = chat.incremental(turns, counting)
    assert text == chat.instruct_template(turns) == "".join(x for _, x, _ in added) and not any(r for *_, r in added)
    assert sum(rendered) < 4 * len(turns)

    def rewriting(given):  # writes turn 5 anew from turn 300 on
        return chat.instruct_template([(r, "changed" if k == 5 and len(given) > 300 else t) for k, (r, t) in enumerate(given)])

    rewriting.turn_local = True
    for n, times in ((700, 1), (301, 1), (300, 0)):
        text, spans, rewrites = chat.format_conversation(turns[:n], rewriting)
        assert rewrites == times and text == rewriting(turns[:n]) and len(spans) == min(n, 300)


def test_a_template_that_lies_at_its_third_turn():
    def lying(given):  # takes a turn back and brings it again
        given = list(given)
        return chat.instruct_template([(r, "other" if len(given) == 3 and k == 0 else t) for k, (r, t) in enumerate(given)])

    turns = [("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", "d")]
    assert chat.format_conversation(turns, lying)[2] == 2
    assert not hasattr(chat.instruct_template, "turn_local")


def test_chat_of_a_very_long_text(spark):
    long = "</s>[INST] é\\ " * 300_000
    df = spark.createDataFrame([(1, 0, "user", "q", ""), (1, 1, "assistant", long, ""), (1, 2, "assistant", "", "")], CONVERSATIONS)
    r = chat.digests(df).collect()[0]
    assert (r["loss_chars"], r["loss_sha256"]) == (len(long), hashlib.sha256(long.encode()).hexdigest())


def test_long_conversations_keep_their_prefix():
    turns = [("user" if k % 2 == 0 else "assistant", f"t{k}") for k in range(300)]
    numbered = lambda given: "".join(f"{k}:{t};" for k, (_, t) in enumerate(given))
    text, spans, rewrites = chat.format_conversation(turns, numbered, reader=None)
    assert rewrites == 0 and text == numbered(turns) and text[spans[-1].start : spans[-1].end] == "299:t299;"
    dropping = lambda given: "".join(t for _, t in (list(given)[100:] if len(list(given)) > 290 else given))
    text, _, rewrites = chat.format_conversation(turns, dropping, reader=None)
    assert rewrites == 1 and text == dropping(turns)
    assert chat.format_conversation(turns)[0] == chat.instruct_template(turns)


def test_chat_digests(spark):
    rows = [(1, 1, "assistant", "b", ""), (1, 0, "user", None, ""), (None, 0, None, "x", ""), (2, None, "assistant", "</s>", ""), (2, 0, "assistant", "é", ""), (2, 0, "assistant", "é", "")]
    df = spark.createDataFrame(rows, CONVERSATIONS)
    got = {r["conv_id"]: r for r in chat.digests(df).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert (got[1]["n_turns"], got[1]["turns_sha256"], got[1]["loss_chars"], got[1]["loss_sha256"]) == (2, sha("user\n\nassistant\nb\n"), 1, sha("b"))
    assert got[2]["loss_sha256"] == sha("</s>éé") and got[2]["n_turns"] == 3
    assert got[None]["turns_sha256"] == sha("\nx\n") and got[None]["loss_chars"] == 0
    pieces = chat.formatted(df).filter("conv_id = 1").orderBy("position").collect()
    assert "".join(p["piece"] for p in pieces) == "<s>[INST]  [/INST] b </s>" and pieces[1]["loss_start"] == 19
    assert chat.digests(spark.createDataFrame([], CONVERSATIONS)).count() == 0
    with pytest.raises(ValueError):
        chat.read_turn("nothing")
    assert edited
