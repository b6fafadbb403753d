"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import collections
import hashlib
import re


def near_duplicates(rows, percent=85):
    """(doc_id, n_shingles, component_id, kept) of (doc_id, text) rows with distinct ids."""
    sets = {}
    for doc, text in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
        sets[doc] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    holders = collections.defaultdict(list)
    for d, s in sets.items():
        shared = collections.Counter()
        for x in s:
            shared.update(holders[x])
            holders[x].append(d)
        for e, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[e]) - n):
                a, b = sorted((find(d), find(e)))
                root[b] = a
    return sorted((d, len(s), find(d), find(d) == d) for d, s in sets.items())


def remove_repeats(rows, size=50):
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of (doc_id, text) rows."""
    return sorted((d, n, gone, spans, hashlib.sha256(kept).hexdigest()) for d, n, gone, spans, kept in kept_bytes(rows, size))


def kept_bytes(rows, size=50):
    """The same with the bytes that are left."""
    texts = [(d, (t or "").encode()) for d, t in rows]
    first = {}
    for d, b in sorted(texts):
        for i in range(len(b) - size + 1):
            first[b[i : i + size]] = min(d, first.get(b[i : i + size], d))
    out = []
    for d, b in texts:
        gone = bytearray(len(b))
        for i in range(len(b) - size + 1):
            if first[b[i : i + size]] < d:
                gone[i : i + size] = b"\1" * size
        kept = bytes(x for x, y in zip(b, gone, strict=True) if not y)
        out.append((d, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), kept))
    return out


def contamination(docs, items, window=10):
    """(doc_id, n_words, n_hit, item ids) of (doc_id, text) rows."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    windows = []
    for item, text in items:
        w = words(text)
        windows += [(str(item), tuple(w[i : i + window])) for i in range(max(1, len(w) - window + 1))] if w else []
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for item, win in windows:
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i : i + len(win)]) == win:
                    hit.update(range(i, i + len(win)))
                    found.add(item)
        out.append((doc, len(w), len(hit), sorted(found)))
    return sorted(out)


def fingerprint(samples, frame=128, hop=64, peaks=2, fan=3):
    """Codes of spectral-peak pairs, frame by frame and bin by bin."""
    import numpy as np

    x = [b - 128.0 for b in samples] + [0.0] * max(0, frame - len(samples))
    window = np.hanning(frame)
    size = [np.round(np.abs(np.fft.rfft(np.array(x[i : i + frame]) * window)), 3)[1:] for i in range(0, len(x) - frame + 1, hop)]
    found = []
    for t, own in enumerate(size):
        near = [size[k] for k in (t - 1, t, t + 1) if 0 <= k < len(size)]
        tops = [b for b in range(1, len(own) - 1) if own[b - 1] < own[b] >= own[b + 1] and own[b] > 0 and all(own[b] >= n[b] for n in near)]
        found += [(t, b + 1) for b in sorted(tops, key=lambda b: (-own[b], b))[:peaks]]
    pairs = [(a, b) for i, a in enumerate(found) for b in found[i + 1 : i + 1 + fan] if b[0] - a[0] < 256]
    return sorted(a[0] << 32 | a[1] << 20 | b[1] << 8 | b[0] - a[0] for a, b in pairs)
