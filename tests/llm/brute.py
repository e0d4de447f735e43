"""Plain versions of the operators, for comparison on small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BENCH_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def shingle_set(text: str | None, size: int = 5) -> frozenset:
    words = WORD.findall((text or "").translate(LOWER))
    if len(words) < size:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def jaccard(a: frozenset, b: frozenset) -> float:
    return len(a & b) / len(a | b) if a | b else 1.0


def components(rows: list[tuple[int, str | None]], percent: int = 75) -> list[tuple[int, int, int]]:
    """(doc_id, n_shingles, component_id) in the order of the rows."""
    sets = [shingle_set(text) for _, text in rows]
    parent = list(range(len(rows)))

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    holders = defaultdict(list)
    for i, own in enumerate(sets):
        met = Counter(j for shingle in own for j in holders[shingle])
        for shingle in own:
            holders[shingle].append(i)
        for j, both in met.items():
            if 100 * both >= percent * (len(own) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    smallest: dict[int, int] = {}
    for i, (doc_id, _) in enumerate(rows):
        smallest[root(i)] = min(doc_id, smallest.get(root(i), doc_id))
    return [
        (doc_id, len(sets[i]), smallest[root(i)]) for i, (doc_id, _) in enumerate(rows)
    ]


def bench_words(text: str | None) -> list[str]:
    return BENCH_WORD.findall((text or "").translate(LOWER))


def contamination(text: str | None, items: list[tuple[object, str | None]], window: int = 10):
    """(n_words, set of hit places, sorted item names)."""
    words, hit, names = bench_words(text), set(), set()
    for name, said in items:
        own = bench_words(said)
        n = min(window, len(own))
        runs = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if n else set()
        for i in range(len(words) - n + 1) if n else []:
            if tuple(words[i : i + n]) in runs:
                hit.update(range(i, i + n))
                names.add(str(name))
    return len(words), hit, sorted(names)


def line_key(line: str) -> str:
    return line.strip(" \t\n\x0b\x0c\r").translate(LOWER)


def kept_lines(rows: list[tuple[int, str | None]], chars: int = 40, docs: int = 5):
    """(doc_id, n_lines, n_dropped, text) in the order of the rows."""
    holders = defaultdict(set)
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            holders[line_key(line)].add(doc_id)
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [
            line
            for line in lines
            if len(line_key(line)) < chars
            or len(holders[line_key(line)]) < docs
            or max(holders[line_key(line)]) == doc_id
        ]
        out.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out
