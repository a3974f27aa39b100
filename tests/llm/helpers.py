"""Small awkward documents and brute-force versions."""

import random
import re
from collections import Counter, defaultdict

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SYLLABLES = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split()
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def prose(rng: random.Random, words: int) -> str:
    out, left = [], rng.randint(5, 12)
    for _ in range(words):
        w = "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4)))
        left -= 1
        if left == 0:
            w, left = w + ".", rng.randint(5, 12)
        out.append(w)
    return " ".join(out)


def edited(rng: random.Random, text: str, share: float) -> str:
    return " ".join(prose(rng, 1) if rng.random() < share else w for w in text.split(" "))


def rows(texts, lang="en"):
    return [(i, t, lang, f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]


def frame(spark, texts, lang="en"):
    return spark.createDataFrame(rows(texts, lang), DOCS)


def odd_texts(rng: random.Random) -> list:
    base = prose(rng, 60)
    return [None, "", " \n\t ", "a", "A b C", base, base, base.upper(), edited(rng, base, 0.02), prose(rng, 60_000), "Ünïcödé Ça 日本語 " * 20, "x" * 3_000_000, "\x00\x01 nul", base + " ", prose(rng, 5), "</s>[INST] <|endoftext|> 12 kg"]


def shingles(text, size=5):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def components_of(docs: dict) -> dict:
    """Smallest reachable id by brute force over all pairs that share a shingle."""
    sets, by, parent = {i: shingles(t) for i, t in docs.items()}, defaultdict(list), {i: i for i in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sorted(sets):
        common = Counter(j for s in sets[i] for j in by[s])
        for j, n in common.items():
            if 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
        for s in sets[i]:
            by[s].append(i)
    return {i: find(i) for i in docs}
