"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingles(text: str | None, k: int) -> frozenset:
    words = WORD.findall(lower(text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def groups(links, nodes) -> dict:
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return {n: find(n) for n in nodes}


def near(texts: dict, k: int, percent: int) -> dict:
    sets = {i: shingles(t, k) for i, t in texts.items()}
    ids = sorted(sets)
    links = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return groups(links, ids)


def without_repeats(texts: dict, size: int = 100) -> dict:
    """What is left of the texts' bytes, by id."""
    seen, out = set(), {}
    for i in sorted(texts):
        b = texts[i].encode()
        keep = bytearray(b"\1" * len(b))
        for p in range(len(b) - size + 1):
            if b[p : p + size] in seen:
                keep[p : p + size] = bytes(size)
            seen.add(b[p : p + size])
        out[i] = bytes(c for c, f in zip(b, keep, strict=True) if f)
    return out


def repeats(texts: dict, size: int = 100) -> dict:
    """``n_bytes, n_removed, n_spans, sha256`` by id."""
    seen, out = set(), {}
    for i in sorted(texts):
        b = (texts[i] or "").encode()
        keep = bytearray(b"\1" * len(b))
        for p in range(len(b) - size + 1):
            w = b[p : p + size]
            if w in seen:
                keep[p : p + size] = bytes(size)
            else:
                seen.add(w)
        kept = bytes(c for c, f in zip(b, keep, strict=True) if f)
        spans = sum(1 for x in range(len(b)) if not keep[x] and (x == 0 or keep[x - 1]))
        out[i] = (len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest())
    return out


def counts(text: str | None) -> tuple:
    text = text or ""
    words = WORD.findall(text)
    tri = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + j for i in range(len(words) - 2) if tri[tuple(words[i : i + 3])] > 1 for j in range(3)}
    seen, lines = set(), 0
    for line in text.split("\n"):
        lines += bool(WORD.search(line)) and line in seen
        seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), lines, len(covered)


SECRETS = (
    ("assign", re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 1, 12),
    ("access", re.compile("AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile("[0-9a-f]+"), 0, 16),
)


def secrets(text: str | None) -> list:
    out = [(m.start(), p, m.end(), kind) for p, (kind, rx, g, n) in enumerate(SECRETS) for m in rx.finditer(text or "") if len(m[g]) >= n]
    return sorted(out)


ADDED_SECRETS = (
    (r"gh[opsru]_[A-Za-z0-9]+", 40), (r"xox[abprs]-[A-Za-z0-9-]+", 15), (r"AIza[A-Za-z0-9_-]+", 39),
    (r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 30), ("-----BEGIN [A-Z ]*PRIVATE KEY-----", 0),
)


def redacted(text: str) -> str:
    """The text with ``[SECRET]`` for each run of overlapping spans."""
    spans = [(a, b) for a, _, b, _ in secrets(text)] + [m.span() for rx, n in ADDED_SECRETS for m in re.finditer(rx, text) if len(m[0]) >= n]
    out, at = [], 0
    for a, b in sorted(spans):
        if a >= at:
            out += [text[at:a], "[SECRET]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def corpus(seed: int, n: int = 120) -> dict:
    """Texts with copies, near copies, shared passages, blanks and repeats."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    text = lambda k: " ".join(rng.choice(words) for _ in range(k))
    passage, out = text(60), {}
    for i in range(n):
        kind = rng.random()
        if kind < 0.15 and out:
            out[i] = rng.choice(list(out.values()))
        elif kind < 0.45 and out:
            cut = rng.choice(list(out.values()) + [passage]).split(" ")
            for _ in range(rng.randint(1, 3)):
                cut[rng.randrange(len(cut))] = rng.choice(words)
            out[i] = " ".join(cut)
        elif kind < 0.6:
            out[i] = text(rng.randint(0, 30)) + "\n" + passage + " " + text(rng.randint(0, 30))
        elif kind < 0.7:
            out[i] = rng.choice(words) * rng.randint(0, 80)
        else:
            out[i] = text(rng.randint(0, 200))
    out[n], out[n + 1], out[n + 2] = "", " \n\t", (rng.choice(words) + " ") * 3000
    return out
