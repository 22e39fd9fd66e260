"""Brute-force versions of the operators, and a table of awkward documents."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
VOCABULARY = "the quick brown fox jumps over a lazy dog while many small birds watch from tall green trees near quiet river stones".split()


def prose(seed: int, words: int) -> str:
    gen = random.Random(seed)
    return " ".join(gen.choice(VOCABULARY) + (str(gen.randrange(60)) if gen.random() < 0.5 else "") for _ in range(words))


def documents() -> list[tuple]:
    """(doc_id, text, lang, source, n_chars, score, spans, _h): nulls in any column, empty and long texts, copies, near copies, repeated rows."""
    shared = prose(900, 70)
    rows = []
    for i in range(40):
        rows.append((i, prose(i, 20 + 3 * i), "en", f"s{i % 3}"))
    rows += [
        (100, None, "en", "s0"), (101, "", None, None), (102, "   \t ", "de", "s1"), (103, "word", "en", "s1"), (104, "two words", "en", "s4"),
        (105, prose(5, 35), "en", "s0"), (106, prose(5, 35).upper(), "en", "s2"), (107, prose(1, 3) + " " + shared + " " + prose(2, 5), "fr", "s2"),
        (108, shared + " end", "fr", None), (109, "ab" * 400, "en", "s1"), (110, "é" * 150 + prose(7, 40) + "漢字 😀 " * 30, "zh", "s1"),
        (111, prose(11, 6000), "en", "s0"), (111, prose(11, 6000), "en", "s0"), (111, "another text under an id", "en", "s0"), (None, prose(3, 12), "en", "s2"), (None, None, None, None),
        (112, "write to a.b+c@mail.example.org or 4111 1111 1111 1111, call +49 (30) 1234-5678 or 10.0.0.255; IBAN DE89 3704 0044 0532 0130 00, SSN 078-05-1120", "en", "s1"),
        (113, "x@y.z_w@v.u 1.2.3.4.5.6.7.8 300.1.1.1 4111111111111112 +1-22 +12345678901 a@b 1.1.1.1", "en", "s1"),
    ]
    return [(*r, len(r[1] or ""), 7.5, "mine", 1) for r in rows]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, spans string, _h int"


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    text = text or ""
    kinds = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }

    def luhn(d: str) -> bool:
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    out = []
    for rank, (kind, pattern) in enumerate(kinds.items()):
        for m in re.finditer(pattern, text):
            d = re.sub(r"[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]
            if good:
                out.append((m.start(), rank, m.end()))
    return sorted(out)


def repeated(texts: list[str | None], length: int = 200) -> list[list[bool]]:
    """For each text, which of its bytes a string of `length` bytes covers that starts at two places."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        out.append(gone)
    return out


def simhash(text: str | None, shingle: int = 3) -> int:
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(fps: list[int], limit: int = 2) -> list[int]:
    """A class number for each fingerprint."""
    root = list(range(len(fps)))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= limit:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(fps))]


def targets(rows: list[tuple[str | None, int]], weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> dict[str | None, float]:
    size: dict[str | None, int] = defaultdict(int)
    for source, n in rows:
        size[source] += n
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    capped: set[str | None] = set()
    while True:
        left = sum(size.values()) - sum(cap * size[s] for s in capped)
        open_ = [s for s in order if s not in capped]
        total = sum(weight[s] for s in open_)
        share = {s: left * weight[s] / total for s in open_}
        above = {s for s in open_ if share[s] > cap * size[s]}
        if not above:
            return share | {s: float(cap * size[s]) for s in capped}
        capped |= above


def jaccard(a: str | None, b: str | None) -> float:
    x, y = (Counter(w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w) for t in (a, b))
    keys = x.keys() | y.keys()
    return sum(min(x[k], y[k]) for k in keys) / sum(max(x[k], y[k]) for k in keys) if keys else 1.0


def sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()
