"""Plain-Python results that the operators are held against."""

import hashlib
import re


def repeats(rows, length):
    """Per (doc_id, text): n_bytes, n_removed, n_spans, sha256 of what is left."""
    first = {}
    for doc, text in rows:
        if doc is None:
            continue
        raw = (text or "").encode()
        for i in range(len(raw) - length + 1):
            g = raw[i : i + length]
            if g not in first or doc < first[g]:
                first[g] = doc
    out = []
    for doc, text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        if doc is not None:
            for i in range(len(raw) - length + 1):
                if first[raw[i : i + length]] < doc:
                    gone[i : i + length] = b"\x01" * length
        left = bytes(b for b, g in zip(raw, gone) if not g)
        spans = len(re.findall(b"\x01+", bytes(gone)))
        out.append((doc, len(raw), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return out


def shingle_set(text, words):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not found:
        return frozenset()
    if len(found) < words:
        return frozenset([tuple(found)])
    return frozenset(tuple(found[i : i + words]) for i in range(len(found) - words + 1))


def jaccard(rows, words=5, percent=80):
    """Per (doc_id, text): n_shingles and the least id reachable."""
    sets = [(doc, shingle_set(text, words)) for doc, text in rows]
    lists = {}
    for i, (doc, s) in enumerate(sets):
        if doc is not None:
            for g in s:
                lists.setdefault(g, []).append(i)
    parent = {doc: doc for doc, _ in sets}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    common = {}
    for members in lists.values():
        for a in range(len(members)):
            for b in range(a + 1, len(members)):
                key = members[a], members[b]
                common[key] = common.get(key, 0) + 1
    for (a, b), n in common.items():
        if 100 * n >= percent * (len(sets[a][1]) + len(sets[b][1]) - n):
            p, q = find(sets[a][0]), find(sets[b][0])
            if p != q:
                parent[max(p, q)] = min(p, q)
    return [(doc, len(s), None if doc is None else find(doc)) for doc, s in sets]
