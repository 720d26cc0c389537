"""Operators over texts against plain Python, on rows with nulls, ties, repeats and long texts."""

import itertools
import random

import brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from ringfold import workdir
from ringfold.llm import substring_dedup
from ringfold.llm.decontaminate import contamination_report, drop_contaminated, find_benchmark
from ringfold.llm.inputs import small_batches
from ringfold.llm.jaccard_join import jaccard_components, keep_one
from ringfold.llm.mixing import mix_sources, mixed_documents
from ringfold.llm.runlength import RunLengthIndex
from ringfold.llm.substring_dedup import remove_repeats
from ringfold.workdir import stored


def _key(row):
    return tuple((x is not None, x) for x in row)


def same(got, want):
    assert sorted(map(_key, map(tuple, got))) == sorted(map(_key, want))


@pytest.mark.parametrize("length", [20, 50])
def test_repeats(edge_docs, edge_rows, length):
    found = remove_repeats(edge_docs, keep=["doc_id", "row"], length=length)
    rows = found.selectExpr("row.doc_id", "n_bytes", "n_removed", "n_spans", "sha2(kept, 256)").collect()
    same(rows, brute.repeats([r[:2] for r in edge_rows], length))


@pytest.mark.parametrize("many", [1, 100])
def test_repeats_by_string_in_many_shards(edge_docs, edge_rows, monkeypatch, many):
    """Anchors with many segments, and anchors known as frequent, give the same."""
    monkeypatch.setattr(substring_dedup, "MANY_SEGMENTS", many)
    monkeypatch.setattr(substring_dedup, "SAMPLE", 1)
    monkeypatch.setattr(substring_dedup, "SAMPLE_HITS", 2)
    monkeypatch.setattr(substring_dedup, "INDEX_BYTES", 500)
    monkeypatch.setattr(substring_dedup, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(substring_dedup, "_PIECE", 700)
    found = remove_repeats(edge_docs, keep=["doc_id"], length=30)
    rows = found.selectExpr("row.doc_id", "n_bytes", "n_removed", "n_spans", "sha2(kept, 256)").collect()
    same(rows, brute.repeats([r[:2] for r in edge_rows], 30))


def _pair_with_a_doubled_anchor(seed):
    """Two texts with a passage that ends or begins beside a separator run or a doubled phrase."""
    rng = random.Random(seed)

    def words(n):
        return "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=n))

    phrase = words(16)
    twice = [rng.choice("-.=*") * rng.randint(17, 33), phrase * 2, phrase + words(rng.randint(1, 17)) + phrase][seed % 3]
    passage = words(rng.randint(35, 60)) + twice + words(rng.randint(35, 60))
    return [words(70) + passage[rng.randint(0, 45) : len(passage) - rng.randint(0, 60)] + words(70) for _ in range(2)]


def test_repeats_with_a_doubled_anchor(spark):
    # the first seeds are ones where the two segments of a passage's edge have unlike bytes around the first of the two
    seeds = [97, 958, 1119, 1125, 1338, 4120, 7373, *range(60)]
    texts = [t for seed in seeds for t in _pair_with_a_doubled_anchor(seed)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = remove_repeats(docs, keep=["doc_id"])
    rows = found.selectExpr("row.doc_id", "n_bytes", "n_removed", "n_spans", "sha2(kept, 256)").collect()
    same(rows, brute.repeats(list(enumerate(texts)), 50))


def test_repeats_under_one_id(spark):
    """Texts that share an id are judged apart and do not remove from each other."""
    one, two = "abcdefghij" * 8, "0123456789abcdefghijklmnop" * 4
    rows = [(4, one), (4, two), (6, two + one), (2, one[:60])]
    found = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {(r.row.doc_id, r.n_bytes): r.n_removed for r in found.collect()}
    assert got == {(4, 80): 80, (4, 104): 0, (6, 184): 184, (2, 60): 0}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.binary(max_size=30).map(lambda b: bytes(x % 3 for x in b)), st.integers(0, 4)), min_size=1, max_size=8), st.integers(1, 9))
def test_run_length_index(texts, length):
    owners = np.array([o for _, o in texts])
    raw = [t for t, _ in texts]
    got = set(zip(*(x.tolist() for x in RunLengthIndex(raw, owners, length).matches())))
    want = {
        (i, a)
        for i, t in enumerate(raw)
        for a in range(len(t) - length + 1)
        if any(owners[j] < owners[i] and t[a : a + length] in u for j, u in enumerate(raw))
    }
    assert got == want


def test_run_length_index_sorts_what_is_tied(monkeypatch):
    """Suffixes that differ early are not sorted again with each doubling."""
    rng = random.Random(8)
    texts = [bytes(rng.choices(b"abcdefghijklmnopqrstuvwxyz ", k=70)) for _ in range(400)]
    texts += [texts[0][5:] + texts[1][:40], texts[2] + b"x"]
    n = sum(len(t) + 1 for t in texts)
    made = []

    def counted(f):
        def g(a, *args, **options):
            made.append(len(a))
            return f(a, *args, **options)

        return g

    for name in ("sort", "argsort", "unique"):
        monkeypatch.setattr(np, name, counted(getattr(np, name)))
    text, _ = RunLengthIndex(texts, np.arange(len(texts)), 50).matches()
    assert sorted(set(text.tolist())) == [400, 401]
    assert sum(made) < 3 * n


def test_anchors_are_short(spark):
    """Anchors of which all segments are shuffled have 40 bits of their hash, spread evenly."""
    rng = random.Random(9)
    docs = spark.createDataFrame([(i, "".join(rng.choices("abcdefgh ", k=400))) for i in range(50)], "doc long, text string")
    rows = substring_dedup._anchored(docs, np.zeros(0, np.int64), False, 50, 16).select("anchor").collect()
    anchors = {r.anchor for r in rows}
    assert 0 <= min(anchors) and max(anchors) < 1 << 40 and len(anchors) == len(rows)
    assert 0.4 < sum(a >= 1 << 39 for a in anchors) / len(anchors) < 0.6


@pytest.mark.parametrize("words, percent", [(5, 80), (2, 60)])
def test_jaccard(edge_docs, edge_rows, words, percent):
    found = jaccard_components(edge_docs, words=words, percent=percent)
    same(found.collect(), brute.jaccard([r[:2] for r in edge_rows], words, percent))


def test_jaccard_known_frequent(edge_docs, edge_rows, monkeypatch):
    from ringfold.llm import jaccard_join

    monkeypatch.setattr(jaccard_join, "SAMPLE", 1)
    monkeypatch.setattr(jaccard_join, "BROADCAST_IDS", 0)
    same(jaccard_components(edge_docs).collect(), brute.jaccard([r[:2] for r in edge_rows]))


@pytest.mark.parametrize("with_original, edits", [(True, 6), (False, 8)])
def test_jaccard_many_near_copies(spark, monkeypatch, with_original, edits):
    """Copies far from each other are linked through their text; without it they are compared pair by pair."""
    from ringfold.llm import jaccard_join

    rng = random.Random(5)
    text = [f"w{i}" for i in range(300)]
    rows = [(0, " ".join(text))] * with_original
    for i in range(1, 151):
        words = list(text)
        for at in rng.sample(range(300), rng.randint(3, edits)):
            words[at] = f"x{i}y{at}"
        rows.append((i, " ".join(words)))
    made = []

    def counted(df, name):
        out = stored(df, name)
        made.append((name, out.count()))
        return out

    monkeypatch.setattr(jaccard_join, "stored", counted)
    monkeypatch.setattr(jaccard_join, "SAMPLE", 1)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    same(jaccard_components(docs).collect(), brute.jaccard(rows))
    if with_original:
        assert sum(n for name, n in made if name == "jaccard-pairs") <= 3 * len(rows)


def test_jaccard_ids_with_several_texts(spark):
    long = " ".join(map(str, range(100)))
    rows = [(5, long), (3, "a b c d e f g"), (5, "a b c d e f g"), (9, long), (7, "x y"), (7, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard_components(docs).collect()}
    assert got == {5: 3, 3: 3, 9: 3, 7: 7}
    assert sorted(r.doc_id for r in keep_one(docs).collect()) == [3, 7]


def test_keep_one(edge_docs, edge_rows):
    want = sorted({d for d, _, c in brute.jaccard([r[:2] for r in edge_rows]) if d == c and d is not None})
    kept = keep_one(edge_docs)
    assert kept.columns == edge_docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == want and ids.count(None) == 1


def test_jaccard_deletes_what_it_stored(edge_docs, tmp_path, monkeypatch):
    numbers = itertools.count()
    monkeypatch.setattr(workdir, "work_dir", lambda _, name: f"{tmp_path}/{name}-{next(numbers)}")
    keep_one(edge_docs).count()
    left = {f.name.rsplit("-", 1)[0] for f in tmp_path.iterdir()}
    # what the result is read from, ties of ids, and stars of components
    assert left <= {"jaccard-found", "jaccard-repeated-ids", "jaccard-ties", "components"}


def test_shuffle_files_go_with_their_query(spark):
    def files():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {f for f in found.mkString("|").split("|") if "shuffle_" in f}

    small_batches(spark)
    before = files()
    for _ in range(3):
        stored(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "shuffled")
    assert files() <= before


@pytest.fixture
def benchmark(spark, edge_rows):
    passages = [r[1].split(" ") for r in edge_rows if r[1] and len(r[1]) > 300 and len(r[1]) < 2000]
    items = [
        (1, " ".join(passages[0][:14])),
        (2, " ".join(passages[1][3:13]).upper()),
        (3, "One"),
        (4, None),
        (5, "..."),
        (6, "not in any text at all, this one is quite new to them"),
        (10, " ".join(passages[0][2:12])),
        (None, "two"),
        (1, " ".join(passages[0][:14])),
    ]
    return spark.createDataFrame(items, "item_id long, text string")


def plain_contamination(rows, items, window=10):
    import hashlib
    import re

    def words(t):
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)

    windows = set()
    for item, text in items:
        w = words(text)
        n = min(window, len(w))
        windows |= {("" if item is None else str(item), tuple(w[i : i + n])) for i in range(len(w) - n + 1) if n}
    for doc, text in rows:
        w = words(text)
        hit, found = set(), set()
        for item, win in windows:
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i : i + len(win)]) == win:
                    hit.update(range(i, i + len(win)))
                    found.add(item)
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        yield doc, len(w), len(hit), len(found), digest, bool(hit)


@pytest.mark.parametrize("block", [100_000, 3])
def test_contamination(edge_docs, edge_rows, benchmark, block):
    got = contamination_report(edge_docs, benchmark, block_windows=block).collect()
    same(got, list(plain_contamination([r[:2] for r in edge_rows], [tuple(r) for r in benchmark.collect()])))


def test_drop_contaminated(edge_docs, benchmark):
    clean = drop_contaminated(edge_docs, benchmark)
    assert clean.columns == edge_docs.columns
    hit = find_benchmark(edge_docs, benchmark).where("contaminated").count()
    assert 0 < hit and clean.count() == edge_docs.count() - hit


def test_mix(edge_docs, edge_rows):
    rows = mix_sources(edge_docs).collect()
    assert len(rows) == len(edge_rows)
    sizes, targets, taken = {}, {}, {}
    for r in rows:
        assert 0 <= r.copies <= 3 and r.taken == r.copies * r.size
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        targets[r.source] = r.target
    assert abs(sum(targets.values()) - sum(sizes.values())) < 1e-6
    for s, size in sizes.items():
        assert targets[s] <= 3 * size
        # no document that is not in the sample would fit, or bring the sum nearer
        whole = min(r.copies for r in rows if r.source == s)
        miss = targets[s] - taken[s]
        assert all(abs(miss - r.size) >= abs(miss) for r in rows if r.source == s and r.size and r.copies == whole)
    assert sorted(map(str, rows)) == sorted(map(str, mix_sources(edge_docs.repartition(7)).collect()))


def test_mix_passes_over_a_long_document(spark):
    """A source that cannot take its one long document is filled from the short ones."""
    rows = [(i, "w " * (5000 if i == 7 else 10), "a") for i in range(400)] + [(1000 + i, "w " * 37, "b") for i in range(20)]
    rows += [(2000 + i, "w " * 100, "c") for i in range(5)]
    got = mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for s in "abc":
        own = [r for r in got if r.source == s]
        miss = abs(sum(r.taken for r in own) - own[0].target)
        assert miss <= max(10 if s == "a" else min(r.size for r in own) / 2, 0.01 * own[0].target), (s, miss, own[0].target)


def test_inclusion_probabilities(spark):
    """Over many sources of the same sizes a document is in the sample about as often as its probability says."""
    sizes = [20, 80, 20, 80, 180, 20, 80] * 60
    rows = [(i * 1000 + k, "w " * n, f"s{i:03}") for i in range(8) for k, n in enumerate(sizes)]
    found = mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=(1, 2)).collect()
    for turn in (0, 1):  # two thirds of each of these sources are taken, and four thirds of each of those
        own = [r for r in found if int(r.source[1:]) % 2 == turn]
        rest = own[0].target - turn * own[0].source_size
        scale = rest / sum(n**1.5 for n in sizes)
        for size in (20, 80, 180):
            copies = [r.copies - turn for r in own if r.size == size]
            p = min(1, scale * size**0.5)
            assert 0.1 < p < 0.97
            assert abs(sum(copies) - len(copies) * p) < 4 * (len(copies) * p * (1 - p)) ** 0.5 + 0.03 * len(copies), (turn, size)


def test_mixed_documents(edge_docs):
    mixed = mixed_documents(edge_docs)
    assert mixed.columns == edge_docs.columns
    assert mixed.count() == sum(r.copies for r in mix_sources(edge_docs).collect())


def test_targets_fill_up(spark):
    """Two sources run full one after another; the rest shares what they leave."""
    rows = [(i, "w " * n, s) for i, (s, n) in enumerate([("a", 300), ("b", 10), ("c", 5), ("d", 300)])]
    found = mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    got = {r.source: r.target for r in found.collect()}
    assert got["b"] == 30 and got["c"] == 15 and got["a"] + got["d"] == 615 - 45
    assert got["a"] == pytest.approx(got["d"])


def test_empty_tables(no_docs, spark):
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert remove_repeats(no_docs).count() == 0
    assert jaccard_components(no_docs).count() == 0
    assert keep_one(no_docs).count() == 0
    assert contamination_report(no_docs, nothing).count() == 0
    assert mix_sources(no_docs).count() == 0
    assert mixed_documents(no_docs).count() == 0
