"""Plain versions of the operators, for small inputs."""

import hashlib
import re
from collections import defaultdict


def shingles(text, words):
    own = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(own) < words:
        return {tuple(own)} if own else set()
    return {tuple(own[i : i + words]) for i in range(len(own) - words + 1)}


def components(texts, words, percent=80):
    """{doc_id: (n_shingles, component_id)} of {doc_id: text}."""
    sets = {d: shingles(t, words) for d, t in texts.items()}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    own = sorted(sets)
    for i, d in enumerate(own):
        for e in own[:i]:
            n = len(sets[d] & sets[e])
            if n and 100 * n >= percent * (len(sets[d]) + len(sets[e]) - n):
                a, b = root(d), root(e)
                parent[max(a, b)] = min(a, b)
    return {d: (len(sets[d]), root(d)) for d in sets}


def cut(texts, least=100):
    """{doc_id: (n_bytes, n_removed, n_spans, kept bytes)} of {doc_id: text}."""
    seen, out = set(), {}
    for d in sorted(texts):
        data = (texts[d] or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - least + 1):
            own = data[i : i + least]
            if own in seen:
                gone[i : i + least] = b"\1" * least
            seen.add(own)
        spans = len(re.findall(b"\1+", bytes(gone)))
        out[d] = len(data), sum(gone), spans, bytes(b for b, g in zip(data, gone, strict=True) if not g)
    return out


def records(pages):
    """{page_id: (payload_bytes, digest, record_type, refers_to)} of {page_id: html}."""
    import base64

    groups = defaultdict(list)
    for p, html in pages.items():
        groups[html or ""].append(p)
    out = {}
    for payload, members in groups.items():
        data = payload.encode()
        digest, last = base64.b32encode(hashlib.sha1(data).digest()).decode(), max(members)
        for p in members:
            out[p] = len(data), digest, "response" if p == last else "revisit", None if p == last else last
    return out


def auc(scores, labels):
    good, bad = ([s for s, y in zip(scores, labels, strict=True) if y == c] for c in (1, 0))
    return sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad))
