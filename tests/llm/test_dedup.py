"""Exact, substring, suffix-array and Jaccard deduplication against brute force; edge cases."""

import hashlib
import random
import re

import numpy as np
import pytest

from tamiz.llm import common, exact_dedup, ngram_join, substring_dedup, suffix_array, superkmers

from . import brute
from .conftest import make


def test_filters_merge_without_loss():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 2**64, 500, np.uint64)
    a, b = np.unique(rng.choice(keys, 900), return_counts=True), np.unique(rng.choice(keys, 700), return_counts=True)
    back = []
    for (fp, n), q in ((a, 9), (b, 11)):
        piece = exact_dedup.encode(fp, n, 0, 1 << q, 64 - q)
        got = exact_dedup.decode(**piece)
        assert (got[0] == fp).all() and (got[1] == n).all()
        back.append(got)
    fp, n = exact_dedup.merged(back)
    assert dict(zip(fp.tolist(), n.tolist())) == {int(k): int(dict(zip(*map(np.ndarray.tolist, a))).get(int(k), 0) + dict(zip(*map(np.ndarray.tolist, b))).get(int(k), 0)) for k in fp}


def test_exact(docs, texts, empty):
    norm = {d: re.sub(brute.SPACE, b" ", brute.raw(t)) for d, t in texts}
    groups = {}
    for d, t in norm.items():
        groups.setdefault(t, []).append(d)
    want = {d: (min(groups[t]), len(groups[t]), d == min(groups[t]), hashlib.sha256(t).hexdigest()) for d, t in norm.items()}
    assert {r[0]: tuple(r)[1:] for r in exact_dedup.exact_groups(docs).collect()} == want
    assert exact_dedup.exact_groups(empty).count() == 0


def test_substrings(docs, texts, empty):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], hashlib.sha256(r["kept"]).hexdigest()) for r in substring_dedup.without_passages(docs).collect()}
    assert got == brute.repeated_words(texts)
    assert substring_dedup.without_passages(empty).count() == 0


def test_suffix_array(docs, texts, empty):
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in suffix_array.without_repeats(docs).collect()}
    assert got == brute.repeated_bytes(texts)
    assert suffix_array.without_repeats(empty).count() == 0


def test_heavy_minimisers_give_the_same(docs, texts, monkeypatch):
    real = superkmers.heavy_minimisers
    for least in (2, 10**9):  # all their repeated windows are common ones; none is
        monkeypatch.setattr(superkmers, "heavy_minimisers", lambda *a, **k: (np.unique(superkmers_of(texts)), real(*a, **k)[1], least))
        check(docs, texts)


def check(docs, texts):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], hashlib.sha256(r["kept"]).hexdigest()) for r in substring_dedup.without_passages(docs).collect()}
    assert got == brute.repeated_words(texts)


def superkmers_of(texts):
    """Half of all minimisers, to be taken as heavy."""
    raw = [brute.raw(t) for _, t in texts]
    units = superkmers.Units(np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(r) for r in raw])].astype(np.int64), True, 4)
    value = superkmers.super_kmers(units, 20, 4)[2]
    return value[value % np.uint64(2) == 0]


def test_merged_transforms_sort_suffixes():
    rng = random.Random(3)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randint(4, 30))) for _ in range(40)]
    text = np.frombuffer(b"".join(strings), np.uint8)
    off = np.r_[0, np.cumsum([len(s) for s in strings])].astype(np.int64)
    shard = np.sort(np.array([rng.randrange(3) for _ in strings]))
    places, common = suffix_array.repeated_intervals(text, off, shard, 10)
    turned = []
    for p in places.tolist():
        k = int(np.searchsorted(off, p, "right")) - 1
        s = strings[k]
        i = p - int(off[k])
        turned.append(((s[i:] + s[:i]) * 10)[:10])
    assert turned == sorted(turned) and sorted(places.tolist()) == list(range(len(text)))
    for a, b, c in zip(turned, turned[1:], common[1:].tolist()):
        shared = next((i for i in range(10) if a[i] != b[i]), 10)
        assert c <= shared and (c < 10) == (shared < 10)


def test_jaccard(docs, texts, empty):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(docs).collect()}
    assert got == brute.jaccard_components(texts)
    assert ngram_join.jaccard_components(empty).count() == 0


def test_jaccard_chain_without_common_pivot(spark):
    """Links reach from copy to copy though the ends are far apart."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(120)]
    rows = []
    for k in range(30):
        rows.append((k, " ".join(words)))
        for _ in range(2):
            words[rng.randrange(120)] = f"n{k}{rng.randrange(1000)}"
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(make(spark, [(d, t, "en", "s") for d, t in rows]), heavy_share=1 / 4).collect()}
    assert got == brute.jaccard_components(rows)


def test_jaccard_recursion(spark):
    """Regions that hold a third of all documents, divided down to pairs, some near one another and some far from all."""
    rng = random.Random(11)
    base, passages = [f"b{i}" for i in range(100)], [[f"p{i}x{j}" for j in range(14)] for i in range(12)]
    rows = []
    for _ in range(60):  # a hot region of near copies, not all within the radius of one another
        w = list(base)
        for _ in range(rng.randrange(7)):
            w[rng.randrange(100)] = f"n{rng.randrange(10**6)}"
        rows.append(" ".join(w))
    for _ in range(60):  # mixtures of common passages: far from one another, but for some
        rows.append(" ".join(sum(rng.sample(passages, 5), [])))
    rows += [r + " fin" for r in rng.sample(rows, 20)]
    rows = list(enumerate(rows))
    docs = make(spark, [(d, t, "en", "s") for d, t in rows])
    want = brute.jaccard_components(rows)
    assert 20 < len({c for _, c in want.values()}) < 130
    for pivots, leaf, most in ((1, 2, 40), (3, 8, 5)):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(docs, heavy_share=1 / 10, leaf=leaf, pivots=pivots, most=most).collect()}
        assert got == want


def test_sets_joined_in_one_task():
    rng = np.random.default_rng(3)
    base = np.arange(100, dtype=np.uint64)
    sets = [np.unique(np.r_[rng.choice(base, 100 - k % 25, replace=False), rng.integers(1000, 1040, k % 30).astype(np.uint64)]) for k in range(90)]
    both = ngram_join.common_counts(sets)
    want = {(i, j) for i in range(90) for j in range(i + 1, 90) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))}
    assert all(both[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(90) for j in range(i + 1, 90))
    assert brute.components(range(90), ngram_join.spanning_links(sets, 80)) == brute.components(range(90), want)


def test_frequent_values_in_bounded_memory():
    rng = np.random.default_rng(2)
    values = np.r_[np.repeat(np.arange(5, dtype=np.uint64), 400), rng.integers(10, 10**9, 4000).astype(np.uint64)]
    seen = common.Frequent(64)
    for part in np.array_split(rng.permutation(values), 50):
        seen.add(part)
        assert len(seen.values) <= 64 and seen.held < 64 + len(part)
    seen.settle()
    assert set(range(5)) <= set(seen.values[seen.counts > 100].tolist())


def test_a_doc_id_with_two_texts_joins_their_components(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(40)) for c in "ab")
    out = ngram_join.jaccard_components(make(spark, [(1, a, None, None), (2, a, None, None), (2, b, None, None), (3, b, None, None)]))
    assert {(r["doc_id"], r["component_id"]) for r in out.collect()} == {(1, 1), (2, 1), (3, 1)}


@pytest.mark.parametrize("operator", [exact_dedup.exact_groups, substring_dedup.without_passages, suffix_array.without_repeats, ngram_join.jaccard_components])
def test_repeated_rows_and_missing_ids(spark, operator):
    text = " ".join(f"palabra{i}" for i in range(60))
    out = operator(make(spark, [(1, text, "es", "a"), (1, text, "es", "a"), (None, text, "es", "a"), (2, text, None, None)])).collect()
    assert len(out) == 4


def test_parities_never_exceed_the_difference():
    """Bits in which two sets' parities differ, folded to the shorter one, are no more than the shingles in which they differ."""
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 2**64, n, np.uint64)) for n in (1, 5, 130, 250, 260)] + [np.zeros(0, np.uint64)]
    sets += [np.union1d(sets[3][20:], sets[4][:15]), sets[4][:200]]
    size = np.array([len(s) for s in sets])
    words, begin = ngram_join.parities(np.repeat(np.arange(len(sets)), size), np.concatenate(sets), size)
    bits = [words[a:b] for a, b in zip(begin[:-1], begin[1:])]
    assert [len(b) for b in bits] == [2, 2, 4, 4, 8, 2, 4, 4]
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            k = min(len(bits[i]), len(bits[j]))
            x, y = (np.bitwise_xor.reduce(bits[m].reshape(-1, k), axis=0) for m in (i, j))
            differ = int(np.unpackbits((x ^ y).view(np.uint8)).sum())
            assert differ <= len(np.setxor1d(a, b)) and (differ - len(np.setxor1d(a, b))) % 2 == 0


def test_a_stored_table_leaves_no_shuffle_files(spark):
    """What its query shuffled goes at its end, and the session's setting is as before."""
    import time

    files = lambda: {f for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n") if "/shuffle_" in f}
    setting, before = spark.conf.get(common.CLEANUP), files()
    out = common.stored(spark.range(50_000).selectExpr("id % 7919 as k").groupBy("k").count())
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before
    assert out.count() == 7919 and spark.conf.get(common.CLEANUP) == setting


def test_regions_in_parts(spark):
    """Regions found part by part are those found at once, of shingles that are frequent or not, and parts leave no tables."""
    import os

    rng = random.Random(5)
    often = set(range(-20, 20))
    rows = []
    for x in range(80):
        prefix = sorted(rng.sample(range(-60, 60), 12), key=lambda g: (g in often, g))
        rows.append((x, rng.randint(20, 40), prefix, sum(g not in often for g in prefix)))
    reps = spark.createDataFrame(rows, "x long, n long, prefix array<long>, rare int")
    folder = os.path.dirname(common.stored(reps).stored_at).removeprefix("file:")
    there = set(os.listdir(folder))
    whole, parts = (sorted(map(tuple, ngram_join.first_regions(reps, k).collect())) for k in (1, 5))
    assert whole == parts and len({r[0] for r in whole}) > 100
    assert len(set(os.listdir(folder)) - there) == 2
