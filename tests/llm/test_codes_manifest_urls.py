"""Vector codes, the Merkle manifest and URL rules against plain Python."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest

from ringfold.llm import manifest as M
from ringfold.llm import url_filter as U
from ringfold.llm import vector_codes as V

# ---- vector codes


def plain_codes(rows, parts, entries, rounds):
    """(vec_id, code hex, error) per kept row in plain integers, and the codebooks."""
    kept = [
        (i, label, [math.floor(1024 * x) for x in v])
        for i, label, v in rows
        if v and all(x is not None and math.isfinite(x) for x in v)
    ]
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, np.array(r[2], "<i4").tobytes()))
    d = len(kept[0][2])
    cuts = [d * p // parts for p in range(parts + 1)]

    def cut(v, p):
        return v[cuts[p] : cuts[p + 1]]

    books = [[cut(v, p) for _, _, v in order[:entries]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            members = {}
            for _, _, v in kept:
                members.setdefault(nearest(cut(v, p), books[p])[1], []).append(cut(v, p))
            for k, xs in members.items():
                books[p][k] = [sum(c) // len(xs) for c in zip(*xs)]
    out = []
    for i, label, v in kept:
        found = [nearest(cut(v, p), books[p]) for p in range(parts)]
        out.append((i, label, "".join(f"{k:02x}" for _, k in found), sum(e for e, _ in found)))
    text = ",".join(str(x) for book in books for e in book for x in e)
    return out, hashlib.sha256(text.encode()).hexdigest()


def vector_rows():
    rng = random.Random(5)
    centres = [[rng.gauss(0, 1) for _ in range(10)] for _ in range(6)]
    rows = [(i * 7 % 401, rng.choice([1, 2, None]), [c + rng.gauss(0, 0.2) for c in rng.choice(centres)]) for i in range(150)]
    rows += [rows[3], rows[3], (rows[4][0], 1, rows[5][2])]  # repeated rows, a repeated id
    rows += [(900, 1, None), (901, 1, []), (902, 2, [float("nan")] * 10), (903, 2, [None] + [0.0] * 9), (904, 1, [math.inf] * 10)]
    rows += [(905, 2, [0.0] * 10), (906, 2, [0.0] * 10), (None, None, [0.25] * 10)]
    return rows


def test_codes_equal_plain_integers(spark):
    rows = vector_rows()
    schema = "vec_id bigint, label int, embedding array<double>, code string, points string, state string, error string"
    table = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], schema).repartition(5)
    got = V.coded_vectors(table, parts=4, entries=12, rounds=4).collect()
    want, digest = plain_codes(rows, 4, 12, 4)
    assert sorted((r.vec_id or -1, r.code, r.error) for r in got) == sorted((i or -1, c, e) for i, _, c, e in want)
    assert {r.codebooks_sha256 for r in got} == {digest}
    sums = {}
    for _, label, _, e in want:
        sums[label] = sums.get(label, 0) + e
    assert sorted(r.label_error for r in got) == sorted(sums[label] for _, label, _, _ in want)


def test_many_labels(spark, monkeypatch):
    monkeypatch.setattr(V, "BROADCAST_ROWS", 3)
    monkeypatch.setattr(V, "HOT_SHARE", 0.2)
    rows = [(None, 5), (None, 6)] + [(1, k) for k in range(40)] + [(k, k) for k in range(2, 30)]
    table = spark.createDataFrame(rows, "label int, error bigint")
    got = sorted(((r.label or -1, r.label_error) for r in V.with_label_sums(table).collect()))
    sums = {}
    for label, e in rows:
        sums[label] = sums.get(label, 0) + e
    assert got == sorted((label or -1, sums[label]) for label, _ in rows)


def test_no_vectors(spark):
    empty = spark.createDataFrame([(1, 1, None)], "vec_id bigint, label int, embedding array<float>")
    assert V.coded_vectors(empty).collect() == []


def test_bounds_are_exact_and_tighter_than_added_moves():
    rng = np.random.Generator(np.random.PCG64(3))
    centres = rng.integers(-900, 900, (40, 6))
    points = centres[rng.integers(0, 40, 4000)] + rng.integers(-90, 90, (4000, 6))
    history = points[None, :64].copy()
    bounds = V.first_bounds(points, history[0], 0)
    rescans, added = [], []
    stamped, drift = None, None
    for _ in range(8):
        book = history[-1].copy()
        for k in np.unique(bounds.code):
            book[k] = points[bounds.code == k].sum(0) // (bounds.code == k).sum()
        history = np.concatenate([history, book[None]])
        moves = V.Moves(history)
        # what bounds would be from the sum of the norms of each round's moves
        steps = np.sqrt((np.diff(history, axis=0).astype(float) ** 2).sum(2))
        since = np.cumsum(steps[::-1], axis=0)[::-1]
        assert (moves.own[:-1] <= since + 1e-9).all()
        loose_lower = bounds.lower - np.where(bounds.lower_round < len(since), since[bounds.lower_round.clip(max=len(since) - 1)].max(1), 0)
        loose_upper = bounds.upper + since[bounds.upper_round, bounds.code]
        added.append(int((loose_upper >= np.maximum(loose_lower, moves.half[bounds.code])).sum()))
        bounds, n = V.next_bounds(points, history, bounds)
        rescans.append(n)
        assert (bounds.code == V.squared_distances(points, history[-1]).argmin(1)).all()
    assert sum(rescans) < sum(added) and sum(rescans) < 0.6 * 8 * len(points)


def test_distances_beyond_doubles():
    rng = np.random.Generator(np.random.PCG64(4))
    points, entries = (rng.integers(-(1 << 24), 1 << 24, (5, 64)) for _ in range(2))
    want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(x, y)) for y in entries] for x in points]
    assert V.squared_distances(points, entries).tolist() == want


def test_decoded(spark):
    rows = [(i, 0, [float(i % 3), 0.5, -1.0, 2.0]) for i in range(20)]
    found = V.vector_codes(spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<double>"), entries=8)
    back = {r.vec_id: r.vector for r in V.decoded(found.rows, found.codebook).collect()}
    assert back == {i: v for i, _, v in rows}


# ---- manifest


def H(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def plain_leaf(row):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def plain_tree(nodes, fanout):
    """The root and, per node, its siblings as (before, after) from the bottom up."""
    paths, level = [[] for _ in nodes], [([i], n) for i, n in enumerate(nodes)]
    while len(level) > 1:
        new = []
        for a in range(0, len(level), fanout):
            run = level[a : a + fanout]
            for k, (members, _) in enumerate(run):
                for i in members:
                    paths[i].append(("".join(n for _, n in run[:k]), "".join(n for _, n in run[k + 1 :])))
            new.append((sum((m for m, _ in run), []), H(*[n for _, n in run])))
        level = new
    return level[0][1], paths


def plain_manifest(rows, fanout=8):
    """rows: (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    subroots, inner = [], {}
    for g in names:
        leaves = sorted(((r[0] is not None, r[0] or 0, plain_leaf(r), r) for r in groups[g]), key=lambda x: x[:3])
        top, paths = plain_tree([x[2] for x in leaves], fanout)
        subroots.append(top)
        inner[g] = [(x[3], x[2], p) for x, p in zip(leaves, paths)]
    root, above = plain_tree(subroots, fanout)
    out = []
    for g, subroot, over in zip(names, subroots, above):
        for r, leaf, path in inner[g]:
            path = path + over
            node = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None:
                node = plain_leaf((*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])))
            for before, after in path:
                node = H(before, node, after)
            out.append((r[0], leaf, subroot, root, H(*[x for step in path for x in step]), node, node == root))
    return out


def manifest_rows():
    rng = random.Random(9)
    rows = [(i * 13 % 1201, rng.choice(["a", None, "b:c"]), rng.choice(["en", "en", "en", "", None, "ä", "z"]), rng.choice([None, i]), f"Text {i} É") for i in range(300)]
    rows += [rows[7], rows[7], (rows[8][0], "x", "en", 1, "other"), (None, None, None, None, None), (-5, "", "lone", 0, "")]
    return rows + [(5000 + i, "s", f"lang{i}", 1, "A b") for i in range(20)]


@pytest.mark.parametrize("fanout", [8, 2])
def test_manifest_equals_plain_tree(spark, fanout):
    rows = manifest_rows()
    schema = "doc_id bigint, source string, lang string, n_chars bigint, text string, `group` string, node string, at string, `a.b` string"
    table = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], schema).repartition(6)
    got = [tuple(r) for r in M.manifest_report(table, fanout).collect()]
    assert sorted(got, key=repr) == sorted(plain_manifest(rows, fanout), key=repr)


def test_proof_of_one_document(spark):
    rows = manifest_rows()
    table = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string")
    one = M.manifest(table).where("doc_id = 13").first()
    node = one.leaf
    for step in one.path:
        node = H(step.before, node, step.after)
    assert node == one.root and one.changed_leaf is None


def test_manifest_of_few(spark):
    schema = "doc_id bigint, source string, lang string, n_chars bigint, text string"
    assert M.manifest_report(spark.createDataFrame([], schema)).collect() == []
    rows = [(1, None, None, None, "x" * 100_000)]
    got = [tuple(r) for r in M.manifest_report(spark.createDataFrame(rows, schema)).collect()]
    assert got == plain_manifest(rows)


# ---- url rules


def plain_verdict(url, rules):
    host, path = "", ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fit = [
        (len(h + p), h.count(".") + 1 if h else 0, v == "block", h + p, v)
        for h, p, v in rules
        if (host == h or host.endswith("." + h) or h == "") and path.startswith(p)
    ]
    best = max(fit, default=None)
    return host, path, best and best[3], best[4] if best else "allow"


URLS = [
    None, "", "no scheme", "http://", "https://Example.ORG/es/1?x#y", "http://a.example.org/en/12", "http://example.orgx/es/",
    "http://b.example.com/fr/1", "http://example.com/de/2/", "http://org", "http://org/", "ftp://x.org:80/es/", "http://a.org?/es/",
    "http://example.org#/es/", "http://h://i/j", "http://.org/q", "http://example.org/ES/", "http://example.org/es", "http://ü.org/é" * 50,
    "http://" + "a." * 3000 + "com/fr/" + "b" * 20000,
]
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def asked(spark, urls):
    schema = "page_id bigint, url string, host string, path string, keys string, found string, rule string, `u.v` string"
    return spark.createDataFrame([(i if i != 4 else None, u, *"xxxxxx") for i, u in enumerate(urls)], schema).repartition(4)


@pytest.mark.parametrize("passes", [1, 3])
def test_verdicts(spark, passes):
    urls = URLS + URLS[4:7]
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = U.judged_urls(asked(spark, urls), rules, most_keys=-(-len(RULES) // passes)).collect()
    want = [(i if i != 4 else None, *plain_verdict(u, RULES)) for i, u in enumerate(urls)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_many_rules(spark):
    rng = random.Random(2)
    hosts = [f"{a}.{b}" for a in "abcdefgh" for b in ("com", "org", "net")]
    rules = [(rng.choice(hosts), f"/{rng.randint(0, 60)}", rng.choice(["allow", "block"])) for _ in range(900)]
    rules += [("", "", "block"), ("com", "", "allow")]
    unique = {(h, p): max(v for a, b, v in rules if (a, b) == (h, p)) for h, p, _ in rules}
    urls = [f"http://{rng.choice(['', 'www.'])}{rng.choice(hosts)}/{rng.randint(0, 99)}" for _ in range(3000)]
    table = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string").repartition(3)
    got = U.judged_urls(table, spark.createDataFrame([*rules, (None, "/", "block"), ("x", "/", "?")], "host string, path string, verdict string")).collect()
    plain = [(h, p, v) for (h, p), v in unique.items()]
    assert sorted(map(tuple, got)) == sorted((i, *plain_verdict(u, plain)) for i, u in enumerate(urls))


def test_no_pages_or_no_rules(spark):
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert U.judged_urls(asked(spark, []), spark.createDataFrame(RULES, none.schema)).collect() == []
    got = U.judged_urls(asked(spark, URLS[4:8]), none).collect()
    assert {(r.rule, r.verdict) for r in got} == {(None, "allow")} and len(got) == 4


def test_cascade_is_exact(spark):
    keys = spark.range(40_000).selectExpr("cast(id AS string) AS key", "xxhash64(cast(id AS string)) AS h1", "xxhash64(1, cast(id AS string)) AS h2")
    listed = keys.where("cast(key AS int) % 10 = 0")
    cascade = U.fit_cascades([listed, keys.limit(0)], keys, 40_000)
    assert len(cascade[0].levels) > 3 and not cascade[1].levels
    rows = keys.collect()
    h1, h2 = (np.array([r[c] for r in rows], np.int64).view(np.uint64) for c in ("h1", "h2"))
    assert cascade[0].listed(h1, h2).tolist() == [int(r.key) % 10 == 0 for r in rows]
    # about what is listed is let through wrongly, however many keys there are
    assert sum(len(b.words) for b in cascade[0].levels) * 64 < 12 * 4_000
