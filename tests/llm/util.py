"""Small fixtures and brute-force versions."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYLLABLES = ["an", "er", "on", "th", "ti", "re", "ou", "ne", "sta", "mo", "ki", "lu", "pe", "da", "vo", "si"]


def prose(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))) for _ in range(n))


def documents(seed: int = 1, n: int = 60) -> list[tuple]:
    """(doc_id, text, lang, source, n_chars): prose, exact and near copies, passages, odd rows."""
    rng = random.Random(seed)
    texts: list[str | None] = []
    passage = prose(rng, 90)
    for i in range(n):
        kind = i % 6
        if kind == 1 and texts:
            texts.append(texts[rng.randrange(len(texts))])
        elif kind == 2 and texts:
            w = (texts[rng.randrange(len(texts))] or "x").split(" ")
            w[rng.randrange(len(w))] = "edited"
            texts.append(" ".join(w))
        elif kind == 3:
            texts.append(prose(rng, rng.randint(0, 60)) + " " + passage + " " + prose(rng, rng.randint(0, 60)))
        else:
            texts.append(prose(rng, rng.choice([1, 3, 12, 80, 200])))
    texts += [None, "", "   \n\t ", "a" * 1500, "ab" * 700, "a" * 1500, "one", "One", prose(rng, 4000), "ü é ß 日本 " * 60]
    rows = [(i, x, "en" if i % 3 else None, f"src{i % 4}" if i % 7 else None, len(x or "")) for i, x in enumerate(texts)]
    return [*rows, rows[0], (None, "null id text here", "en", "src1", 17)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows, schema=SCHEMA, parts=3):
    return spark.createDataFrame(rows, schema).repartition(parts)


def crc(value, m: int) -> int:
    return zlib.crc32(("" if value is None else str(value)).encode()) % m


def fold(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingle_set(text: str | None, n: int) -> frozenset:
    w = WORD.findall(fold(text))
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute_components(docs: list[tuple], n: int, num: int, den: int) -> list[tuple]:
    """Sorted (doc_id, n_shingles, component_id) of each row."""
    sets = [shingle_set(t, n) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and den * len(a & b) >= num * len(a | b):
                root[find(i)] = find(j)
    least: dict[int, int | None] = {}
    for i, (d, _) in enumerate(docs):
        r = find(i)
        least[r] = d if least.get(r) is None else min(d, least[r]) if d is not None else least[r]
    out = [(d, len(sets[i]), least[find(i)] if sets[i] else d) for i, (d, _) in enumerate(docs)]
    return sorted(out, key=str)


def base_counts(text: str | None) -> tuple:
    t = text or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit)
