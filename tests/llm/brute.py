"""Plain Python versions of the operators, for small inputs."""

import hashlib
import re

import xxhash


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def low(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def groups(ids, linked):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(ids)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if linked(a, b):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def simhash(text: str, size: int = 3) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", low(text))
    if not words:
        return 0
    grams = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def shingles(text: str, size: int = 5) -> set:
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} or ({tuple(words)} if words else set())


def jaccard(a: set, b: set) -> float:
    return len(a & b) / len(a | b) if a | b else 1.0


def repeats(texts: list[bytes], length: int) -> list[tuple]:
    counts: dict[bytes, int] = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            counts[t[i : i + length]] = counts.get(t[i : i + length], 0) + 1
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if counts[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(t, gone) if not g)
        runs = len(re.findall(b"\1+", bytes(gone)))
        out.append((len(t), len(t) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
    return out


def benchmark_hits(text: str | None, items: list[tuple], window: int = 10) -> tuple:
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t or ""))

    mine, hit, named = words(text), set(), set()
    for item, t in items:
        theirs = words(t)
        n = min(window, len(theirs))
        grams = {tuple(theirs[i : i + n]) for i in range(len(theirs) - n + 1)} if n else set()
        for i in range(len(mine) - n + 1):
            if n and tuple(mine[i : i + n]) in grams:
                hit.update(range(i, i + n))
                named.add(str(item))
    return len(mine), len(hit), len(named), sha(",".join(sorted(named))), bool(hit)
