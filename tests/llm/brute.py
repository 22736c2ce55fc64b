"""Plain Python versions of what the queries return."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(number)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def digits(match) -> str:
    return re.sub("[^0-9]", "", match.group())


PII = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.group().split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15),
]
SECRETS = [
    ("assign", r"(?ai:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m.group(1)) >= 12),
    ("access", r"AKIA[A-Z0-9]+", lambda m: len(m.group()) >= 18),
    ("hex", r"[0-9a-f]+", lambda m: len(m.group()) >= 16),
]


def base(text: str | None, kinds) -> tuple:
    """Counts by kind and the digest of the spans."""
    found = [(m.start(), rank, m.end(), k) for rank, (k, p, ok) in enumerate(kinds) for m in re.finditer(p, text or "") if ok(m)]
    line = ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(found))
    counts = Counter(k for *_, k in found)
    return (*(counts[k] for k, *_ in kinds), hashlib.sha256(line.encode()).hexdigest())


def quality(text: str | None) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text or ""
    w = WORD.findall(text)
    windows = list(zip(w, w[1:], w[2:]))
    often = Counter(windows)
    covered = {p for i, x in enumerate(windows) if often[x] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (
        len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered),
        len(w) < 50 or 100 * len(covered) > 50 * len(w),
    )


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def shingles(text: str | None, k: int, short: bool = True) -> frozenset:
    w = words(text)
    if len(w) < k:
        return frozenset([tuple(w)]) if w and short else frozenset()
    return frozenset(zip(*[w[i:] for i in range(k)]))


def near_groups(texts: list[str | None], k: int, percent: int = 80) -> list[int]:
    """For each text the first text of its group."""
    sets = [shingles(t, k) for t in texts]
    parent = list(range(len(texts)))

    def root(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    where: dict = {}
    for i, s in enumerate(sets):
        both = Counter(j for x in s for j in where.get(x, ()))
        for j, n in both.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
        for x in s:
            where.setdefault(x, []).append(i)
    return [root(i) for i in range(len(texts))]
