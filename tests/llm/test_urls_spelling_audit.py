"""URL templates, spelling variants and the filter audit against plain Python."""

import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

from casehours.llm import filter_audit, spelling, url_filters
from tests.llm.helpers import DOCS, odd_texts, prose

LABELS = "doc_id long, quality int, toxic int, part string"


# ---------------------------------------------------------------- URL templates

PAGES = "page_id long, url string, html string, host string, score double, bad int"
RULES = [("com", "/", True), ("example.com", "/en/", False), ("www.example.com", "/en/", True), ("net", "/es/", False)]


def judged(spark, urls, bad=(), rules=RULES, ids=None):
    pages = spark.createDataFrame([(i, u, None, "h", 0.5, 7) for i, u in zip(ids or range(len(urls)), urls, strict=True)], PAGES)
    labels = spark.createDataFrame([(i, b) for i, b in bad] or [(None, None)], "id long, bad boolean")
    return url_filters.judged(pages, labels, rules)


def test_hosts_paths_and_rules(spark):
    cases = [
        ("HTTP://WWW.Example.COM/en/a?x=/b#c", "www.example.com", "/en/a", "www.example.com/en/", "allow"),
        ("https://m.example.com/en/a", "m.example.com", "/en/a", "example.com/en/", "block"),
        ("https://example.com/EN/a", "example.com", "/EN/a", "com/", "allow"),
        ("http://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
        ("http://com", "com", "", None, "allow"),
        ("http://a.net/es", "a.net", "/es", None, "allow"),
        ("http://a.net/es/", "a.net", "/es/", "net/es/", "block"),
        ("x://a.net:80/es/?q://z", "a.net:80", "/es/", None, "allow"),
        ("//a.net/es/", "", "", None, "allow"),
        ("http://É.Ä.net#/es/", "É.Ä.net", "", None, "allow"),
        ("http://?a", "", "", None, "allow"),
        ("a\nb://h\n1/p\nq?", "h\n1", "/p\nq", None, "allow"),
        ("", "", "", None, "allow"),
        (None, "", "", None, "allow"),
    ]
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in judged(spark, [c[0] for c in cases]).collect()}
    assert got == {i: c[1:] for i, c in enumerate(cases)}


def test_variable_segments_become_wildcards_and_bad_templates_go(spark):
    rng = random.Random(1)
    urls, bad = [], []
    for i in range(900):
        kind = ("news", "shop", "ads", "spam")[i % 4]
        urls.append(f"http://site.org/{kind}/{rng.randrange(10**6)}/{'v' if kind == 'shop' else 'w'}?k={i}")
        if rng.random() < 0.5:
            bad.append((i, rng.random() < (0.95 if kind in ("ads", "spam") else 0.04)))
    got = {r["page_id"]: r for r in judged(spark, urls, bad, []).collect()}
    templates = defaultdict(set)
    for i, r in got.items():
        kind = ("news", "shop", "ads", "spam")[i % 4]
        templates[r["template"]].add(kind)
        assert r["verdict"] == ("block" if kind in ("ads", "spam") else "allow"), (urls[i], r["template"], r["score"])
    # alike siblings are one branch, ids are a wildcard, what follows the wildcard is literal again
    assert templates == {'/["ads","spam"]/*/["w"]': {"ads", "spam"}, '/["news","shop"]/*/["v","w"]': {"news", "shop"}}


def test_few_labels_do_not_reject(spark):
    urls = [f"http://small.org/a/{i}" for i in range(30)] + [f"http://big.org/b/{i}" for i in range(100)]
    got = judged(spark, urls, [(0, True), (1, True), *((30 + i, False) for i in range(60))], []).collect()
    assert {r["verdict"] for r in got} == {"allow"}
    got = judged(spark, urls, [*((i, True) for i in range(30)), *((30 + i, False) for i in range(60))], []).collect()
    assert all((r["verdict"] == "block") == (r["page_id"] < 30) for r in got)


def test_urls_awkward_rows(spark):
    deep = "http://deep.org/" + "/".join(f"s{k}" for k in range(3000))
    urls = [None, None, deep, deep, "http://a.org/%7C|{}\"[x]/*", "http://a.org//x///y", "http://a.org/" + "z" * 1_000_000] + ["http://rep.org/a"] * 40
    got = judged(spark, urls, [(1, True), (None, True), (1, False), (2, None)], ids=[None, 1, 2, 2, 3, 3, None] + [5] * 40).collect()
    assert len(got) == 47 and {r["template"] for r in got if r["host"] == "deep.org"} == {"/*" * 8 + "/**"}
    assert {r["template"] for r in got if r["page_id"] == 3} == {"/*/*"} and {r["template"] for r in got if r["page_id"] == 5} == {'/["a"]'}
    assert url_filters.judged(spark.createDataFrame([], PAGES), spark.createDataFrame([], "id long, bad boolean"), RULES).count() == 0
    many = judged(spark, [f"http://a.org/{k}/x" for k in range(300)] + ["http://a.org/*/x"] * 30).collect()
    assert {r["template"] for r in many} == {'/*/["x"]', '/["*"]/["x"]'}  # a literal star is no wildcard


# ---------------------------------------------------------------- spelling variants


def brute_variants(rows, least_points=6, least_count=5, times=5, modulus=199):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-z\u00C0-\u00FF]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % modulus == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    words = {w: c for w, c in n.items() if len(w) >= least_points and c >= least_count}
    letters = sorted({c for w in words for c in w})

    def near(w):
        out = {w[:k] + w[k + 1 :] for k in range(len(w))} | {w[:k] + c + w[k:] for k in range(len(w) + 1) for c in letters} | {w[:k] + c + w[k + 1 :] for k in range(len(w)) for c in letters}
        return [x for x in out if x in words and x != w]

    found = {}
    for w, c in words.items():
        others = near(w)
        best = min(others, key=lambda x: (-words[x], x), default=None)
        found[w] = (best if best and words[best] >= times * c else None, len(others))
    out = {}
    for w, (form, n_near) in found.items():
        root = w
        while found[root][0]:
            root = found[root][0]
        out[w] = (form, root, words[w], n_near, words[form] if form else None)
    return out


def variants(spark, rows, **more):
    df = spark.createDataFrame([(i, t, "n", "word", 1, 2, "s") for i, t in rows], DOCS + ", n int, word string")
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.spelling_variants(df, **more).collect()}


def typo(rng, word):
    for _ in range(rng.choice((1, 1, 1, 2))):
        k, c = rng.randrange(len(word)), rng.choice("abcéÀö")
        word = rng.choice((word[:k] + word[k + 1 :], word[:k] + c + word[k:], word[:k] + c + word[k + 1 :]))
    return word


def test_spelling_against_brute_force(spark):
    rng = random.Random(7)
    words = ["".join(rng.choice("aabcdeéÖnrst") for _ in range(rng.randint(5, 12))) for _ in range(60)] + ["abcabc", "bcabca", "cabcab", "straße", "STRASSE", "Österreich", "österreich"]
    pool = [w for w in words for _ in range(rng.choice((5, 6, 30, 200)))]
    pool += [v for w in words for v in [typo(rng, w)] for _ in range(rng.choice((4, 5, 6, 25)))]
    pool += [v for w in words for v in [typo(rng, typo(rng, w))] for _ in range(5)]
    rng.shuffle(pool)
    rows = [(rng.choice((k, k % 7, None)), rng.choice((" ", ", ", "-1")).join(pool[k * 40 : k * 40 + 40])) for k in range(len(pool) // 40 + 1)]
    rows += [*enumerate(odd_texts(rng)), (3, "a×bcdef÷ " * 6)]
    expected = brute_variants(rows)
    assert variants(spark, rows) == expected
    assert sum(e[0] is not None for e in expected.values()) > 20 and any(e[1] not in (w, e[0]) for w, e in expected.items())
    altered = brute_variants(rows, modulus=3)
    assert variants(spark, rows, modulus=3) == altered != expected


def test_every_pair_one_edit_apart_meets(spark):
    rng = random.Random(8)
    base = "abacadaé"
    words = {base} | {typo(rng, base) for _ in range(300)} | {"".join(rng.sample(base, 8)) for _ in range(200)}
    df = spark.createDataFrame([(w,) for w in sorted(words)], "word string")
    got = {(r["a"], r["b"]) for r in spelling.near_pairs(df).collect()}

    def one(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    assert {tuple(sorted(p)) for p in got} == {p for p in itertools.combinations(sorted(words), 2) if one(*p)} and len(got) == len({tuple(sorted(p)) for p in got})


def test_spelling_chains_and_ties(spark):
    rows = [(1, "abcdefg " * 5 + "abcdef " * 25 + "abcdeg " * 125 + "abcdeh " * 625), (2, "qwertyx " * 5 + "qwertya " * 30 + "qwertyb " * 30)]
    got = variants(spark, rows, modulus=10**9)
    assert got["abcdefg"][:2] == ("abcdef", "abcdeh") or got["abcdefg"][0] == "abcdeg"
    assert got["abcdef"][:2] == ("abcdeh", "abcdeh") and got["abcdeh"] == (None, "abcdeh", 625, 2, None)
    assert got["qwertyx"] == ("qwertya", "qwertya", 5, 2, 30)


def test_spelling_long_texts_and_empty(spark, monkeypatch):
    monkeypatch.setattr(spelling, "PIECE", 50)
    text = "wordles " * 400 + "x" * 500 + " " + "y" * 49 + " wordles"
    assert spelling.runs_of(text.encode()) == {"wordles": 401, "x" * 500: 1, "y" * 49: 1}
    assert variants(spark, []) == {} and variants(spark, [(1, None), (None, ""), (2, "a b")]) == {}


# ---------------------------------------------------------------- filter audit


def brute_audit(docs, labels):
    good, toxic = ({i for i, q, t in labels if i is not None and (q, t)[k] == 1} for k in (0, 1))
    fails = []
    for i, text, part in docs:
        text = text or ""
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
        own = ("A" if len(words) < 200 else "") + ("B" if 100 * len(set(words)) < 50 * len(words) else "") + ("C" if 100 * len(re.findall("[A-Z]", text)) > 2 * len(text) else "") + ("D" if re.search("[#$%&*|]", text) else "")
        own += "E" if i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in docs) else ""
        fails.append((part or "", own, i in good, i in toxic))
    out = {}
    for part in {f[0] for f in fails}:
        own = [f for f in fails if f[0] == part]
        total = Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for step, letter in enumerate(order, 1):
                gone = [f for f in left if letter in f[1]]
                left = [f for f in left if letter not in f[1]]
                total[letter] += len(gone)
                redundant = sum(letter in f[1] for f in own) - len(gone)
                out[part, order, step] = [len(left), len(gone), redundant, sum(f[1] == letter for f in own), sum(f[2] for f in gone), sum(f[3] for f in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(total[order[step - 1]])
    return out


def audited(spark, docs, labels):
    df = spark.createDataFrame([(i, t, "en", s, 1, 2, "x") for i, t, s in docs], DOCS + ", failed int, part string")
    marks = spark.createDataFrame([(*x, "p") for x in labels], LABELS)
    rows = filter_audit.audit(df, marks).collect()
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    assert all(r["filter"] == r["filter_order"][r["step"] - 1] for r in rows)
    return {(r["part"], r["filter_order"], r["step"]): [r[c] for c in names] for r in rows}


def test_filter_audit_against_brute_force(spark):
    rng = random.Random(12)
    texts = odd_texts(rng)[:-1] + [prose(rng, n) for n in (150, 199, 200, 201, 300)] + ["w " * 250, "A " + "b " * 300, "B" * 300 + " b c" * 100, "a\x0bb\x0cc\x1cd " * 60]
    docs = [(i, rng.choice(texts), rng.choice(("s0", "s0", "s1", "", None))) for i in range(120)]
    docs += [(rng.randrange(120), rng.choice(texts), "s1") for _ in range(20)] + [(None, t, "s0") for t in texts[:8]] + docs[:5]
    labels = [(rng.randrange(150), rng.choice((0, 1, None)), rng.choice((0, 1, None))) for _ in range(120)] + [(None, 1, 1)]
    assert audited(spark, docs, labels) == brute_audit(docs, labels)


def test_filter_audit_empty(spark):
    assert audited(spark, [], [(1, 1, 1)]) == {}
    assert audited(spark, [(1, None, None)], []) == brute_audit([(1, None, None)], [])
