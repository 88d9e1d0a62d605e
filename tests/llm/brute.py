"""Plain restatements of the operators, row by row, and a table of awkward documents."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from itertools import combinations

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BASE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
#: Extra columns bear names that operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, h string, size string, node string, bucket string, n_words string, kept string, score string, w string, pattern string"


def awkward() -> list[tuple]:
    texts = [
        (0, BASE),
        (1, BASE + " phi"),
        (2, BASE),
        (3, "Alpha\tBETA  gamma\n\ndelta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"),
        (4, None),
        (5, ""),
        (6, " \n\t "),
        (7, "x"),
        (8, "x"),
        (9, "one two three four"),
        (10, "ONE two three four"),
        (11, "123 456 | | |"),
        (12, " ".join(f"w{i}" for i in range(30_000))),
        (13, " ".join(f"w{i}" for i in range(29_000))),
        (14, "été À la É " * 20),
        (15, "noch ein Satz mit dreizehn Wörtern der hier steht und nur einmal vorkommt " + BASE),
        (16, "\u00a0nbsp\u00a0words and\x1cseparators <|endoftext|> end"),
        (17, "a" * 5000),
        (18, " ".join(["same"] * 100)),
        (19, " ".join(["same"] * 101)),
        (-5, BASE + " phi"),
        (2**40, BASE),
        (21, "Das ist ein deutscher Satz und noch einer " * 5),
        (22, "This is an English sentence and another one " * 5),
    ]
    rows = [(i, t, ("de" if i % 3 == 0 else "en") if i != 7 else None, [None, "a", "b", "ä"][i % 4]) for i, t in texts]
    rows += [rows[0], rows[4], (None, BASE, None, None), (None, None, "en", "a"), (1, "other text of document one entirely", "en", "b")]
    return [(*r, None if r[1] is None else len(r[1]), *["zz"] * 10) for r in rows]


def words(t: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def low_words(t: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))


def sha(t: str) -> str:
    return hashlib.sha256(t.encode()).hexdigest()


def repeated_windows(rows: list[tuple], k: int = 13) -> list[tuple]:
    order = lambda i: (i is None, i)
    first: dict = {}
    for i, t in rows:
        w = words(t)
        for a in range(len(w) - k + 1):
            key = tuple(w[a : a + k])
            if key not in first or order(i) < order(first[key]):
                first[key] = i
    out = []
    for i, t in rows:
        w, hit = words(t), set()
        for a in range(len(w) - k + 1):
            if order(first[tuple(w[a : a + k])]) < order(i):
                hit.update(range(a, a + k))
        out.append((i, len(w), len(hit), sha(" ".join(x for n, x in enumerate(w) if n not in hit))))
    return out


def contamination(rows: list[tuple], items: list[tuple], k: int = 13) -> list[tuple]:
    windows = defaultdict(set)
    for item, t in items:
        w = low_words(t)
        n = min(k, len(w))
        for a in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[a : a + n])].add(item)
    out = []
    for i, t in rows:
        w, hit, met = low_words(t), set(), set()
        for n in {len(x) for x in windows}:
            for a in range(len(w) - n + 1):
                if (key := tuple(w[a : a + n])) in windows:
                    hit.update(range(a, a + n))
                    met |= windows[key]
        out.append((i, len(w), len(hit), len(met), sha(",".join(sorted(map(str, met)))), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def shingles(t: str | None) -> frozenset:
    w = [x.encode() for x in words((t or "").translate(LOW))]
    return frozenset(tuple(w[a : a + 5]) for a in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def near(rows: list[tuple], percent: int = 85) -> list[tuple]:
    root = {i: i for i, _ in rows if i is not None}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    sets = [(i, shingles(t)) for i, t in rows]
    for (i, a), (j, b) in combinations([x for x in sets if x[0] is not None], 2):
        if a and b and min(len(a), len(b)) * 100 >= percent * max(len(a), len(b)) and 100 * len(a & b) >= percent * len(a | b):
            x, y = find(i), find(j)
            root[max(x, y)] = min(x, y)
    return [(i, len(s), None, True) if i is None else (i, len(s), find(i) if s else i, (find(i) if s else i) == i) for i, s in sets]


def exact(rows: list[tuple]) -> list[tuple]:
    by = defaultdict(list)
    for i, t in rows:
        by[t or ""].append(i)
    out = []
    for i, t in rows:
        ids = by[t or ""]
        best = max((x for x in ids if x is not None), default=None)
        out.append((i, best, len(ids), i == best, sha(t or "")))
    return out
