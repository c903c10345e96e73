"""Byte-level BPE against the tokenizer library, centroids and fill-in-middle against plain Python."""

import hashlib
import math
import random
import re

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tamiz.llm import byte_bpe, centroids, fill_in_middle
from tamiz.llm.queries import QUERIES

from .conftest import make


def sha(data):
    return hashlib.sha256(data).hexdigest()


# Byte-level BPE


@pytest.fixture(scope="module")
def bpe():
    P = pytest.importorskip("public_tokenizers")
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.ranks_of(path), special_tokens={})
    return path, P.PATTERN, library, byte_bpe.Encoder(path, P.PATTERN, *byte_bpe.spelled(P.PATTERN))


def same_ids(bpe, text):
    path, _, library, own = bpe
    ids = np.frombuffer(own.encode(np.frombuffer(text.encode(), np.uint8)), "<u4").tolist()
    assert ids == library.encode_ordinary(text)
    assert byte_bpe.decoded(ids, byte_bpe.bytes_of(path), leaf=3) == text.encode()


@pytest.mark.parametrize("letters", ["ab", "aaaaab", " \n\ta", "é日a ", "'s t0", "abcdefghij", "=-", "ͰA՘ \x1c\x85\xa01"])
def test_bpe_of_random_texts(bpe, letters):
    rng = random.Random(len(letters))
    for n in (0, 1, 2, 31, 32, 33, 65, 200, 1500):
        for _ in range(8):
            same_ids(bpe, "".join(rng.choice(letters) for _ in range(n)))


@pytest.mark.parametrize("word", ["a", "abc", " ", "=", "日", "ab ", "the", "\U00011de0"])
def test_bpe_of_long_runs(bpe, word):
    same_ids(bpe, word * 30_011)


def test_bpe_of_every_code_point(bpe):
    """Letters, numbers and white space are those of the library's own Unicode version."""
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    same_ids(bpe, "".join(every))
    random.Random(1).shuffle(every)
    same_ids(bpe, "".join(every[:200_000]))


def test_bpe_joins_equal_direct_merges(bpe):
    """Halves cut anywhere join to what the merges give for the whole."""
    merges, rng = bpe[3].merges, random.Random(3)
    for _ in range(300):
        data = bytes(rng.choice(b"aabehlnot -") for _ in range(rng.randint(2, 90)))
        cut = rng.randrange(1, len(data))
        assert merges.join(merges.direct(data[:cut]), merges.direct(data[cut:])) == merges.few(data) == merges.many(data)


def test_bpe_of_halved_texts(bpe, monkeypatch):
    monkeypatch.setattr(byte_bpe, "TEXT_LEAF", 7)
    rng = random.Random(4)
    for _ in range(60):
        same_ids(bpe, "".join(rng.choice(" \n　abé1!'s") for _ in range(rng.randint(0, 300))))


def test_bpe_of_documents(spark, docs, texts, bpe):
    """Nulls, empties, repeats, very long texts and columns with clashing names."""
    path, pattern, library, _ = bpe
    out = byte_bpe.decode(byte_bpe.encode(docs, path, pattern), path).collect()
    want = sorted((d, np.array(library.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for d, t in texts)
    assert sorted((r["doc_id"], bytes(r["ids"]), bytes(r["bytes"])) for r in out) == want
    twice = make(spark, [(1, "uno dos", "es", "a")] * 2 + [(None, None, None, None), (None, "x", None, None)])
    assert sorted(byte_bpe.encode(twice, path, pattern).select(F.coalesce("doc_id", F.lit(-1)), F.length("ids")).collect()) == [(-1, 0), (-1, 4), (1, 4 * len(library.encode_ordinary("uno dos"))), (1, 4 * len(library.encode_ordinary("uno dos")))]
    extra = spark.sql("select 1L as doc_id, 'a b' as text, 'x' as ids, 2 as bytes, 3 as h1")
    assert [len(r["ids"]) for r in byte_bpe.encode(extra, path, pattern).collect()] == [8]
    assert byte_bpe.decode(byte_bpe.encode(make(spark, []), path, pattern), path).count() == 0


def test_bpe_query(spark, tmp_path, docs, texts, bpe):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = QUERIES["op11_byte_bpe"](spark, str(tmp_path))
    assert out.dtypes == [("doc_id", "bigint"), ("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")]
    want = {d: (len(ids := bpe[2].encode_ordinary(t or "")), sha(np.array(ids, "<u4").tobytes()), sha((t or "").encode())) for d, t in texts}
    assert {r[0]: tuple(r)[1:] for r in out.collect()} == want


# Fill-in-middle


def numbers(doc_id):
    h = sha(f"42:{'' if doc_id is None else doc_id}".encode())
    return [int(h[8 * k:8 * k + 8], 16) for k in range(4)]


def filled(doc_id, text):
    """n, form, prefix_chars, middle_chars, output by the contract, in plain Python."""
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    h, n = numbers(doc_id), len(units)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def fim_texts():
    rng = random.Random(6)
    marks = ["<P>", "<S>", "<M>", "<", "<P", ">", "P>", "<<S", "é", "日本", "😀", "\x1f", "\x0b", " ", "\n", "uno", "two,"]
    out = [None, "", " ", "\t\n", "a", " a", "a ", "<P>", "<", "<<P>", "<P<S", "a" * 5000, "x " * 4000, "é " * 700 + "<M>", "日" * 1000]
    return out + ["".join(rng.choice(marks[3:] if k % 2 else marks) for _ in range(rng.randint(0, 60))) for k in range(600)]


def test_fim_equals_plain_python(spark):
    texts = list(enumerate(fim_texts())) + [(None, "uno dos tres"), (3, "rep eat"), (3, "rep eat")]
    docs = make(spark, [(d, t, None, None) for d, t in texts]).withColumn("h1", F.lit("x")).withColumn("output", F.lit(1)).withColumn("form", F.lit(0))
    out = fill_in_middle.fill_in_middle(docs)
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted((tuple(r) for r in out.collect()), key=key) == sorted(((d, *filled(d, t)) for d, t in texts), key=key)
    forms = {r["form"] for r in out.select("form").distinct().collect()}
    assert forms == {"plain", "psm", "spm"}
    again = out.withColumn("text", fill_in_middle.restored(F.col("output"), F.col("form"))).select("doc_id", "text").collect()
    assert sorted((tuple(r) for r in again), key=key) == sorted(((d, t or "") for d, t in texts), key=key)
    assert fill_in_middle.fill_in_middle(make(spark, [])).count() == 0


def test_fim_scan_in_slices_is_one_scan():
    rng = random.Random(8)
    for _ in range(200):
        stream = np.frombuffer("".join(rng.choice(["<", "P", ">", "S", " ", "é", "日", "😀", "x", "\t"]) for _ in range(rng.randint(0, 40))).encode() + b"\xff", np.uint8)
        state, want = 0, []
        for b in stream.tolist():
            want.append(int(fill_in_middle.EMITS[state * 256 + b]))
            state = int(fill_in_middle.GOES[state * 256 + b])
        for length in (1, 2, 3, 7, 64):
            assert fill_in_middle.scanned(stream, length).tolist() == want


def test_fim_query(spark, tmp_path, docs, texts):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = QUERIES["op13_fill_in_middle"](spark, str(tmp_path))
    assert out.dtypes == [("doc_id", "bigint"), ("n", "bigint"), ("form", "string"), ("prefix_chars", "bigint"), ("middle_chars", "bigint"), ("output_sha256", "string"), ("restored_sha256", "string")]
    want = {d: (n, form, p, m, sha(o.encode()), sha((t or "").encode())) for d, t in texts for n, form, p, m, o in [filled(d, t)]}
    assert {r[0]: tuple(r)[1:] for r in out.collect()} == want


# Centroids


def clustered(rows, k=8, n_rounds=10, dims=64, scale=1024):
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of rows (vec_id, vector), by the contract."""
    kept = [(v, [math.floor(scale * float(x)) for x in e]) for v, e in rows if e is not None and len(e) == dims and all(x is not None and math.isfinite(x) for x in e)]
    seeds = sorted((sha(f"3:{v}".encode()), q) for v, q in kept if v is not None)[:k]
    cs = [q for _, q in seeds]
    gap = lambda q, c: sum((a - b) ** 2 for a, b in zip(q, c))
    near = lambda q: min(range(len(cs)), key=lambda j: (gap(q, cs[j]), j))
    for _ in range(n_rounds):
        groups = {}
        for _, q in kept:
            groups.setdefault(near(q), []).append(q)
        cs = [[sum(c) // len(groups[j]) for c in zip(*groups[j])] if j in groups else c0 for j, c0 in enumerate(cs)]
    got = [(v, j := near(q), gap(q, cs[j])) for v, q in kept]
    total = sum(d for *_, d in got)
    return [(v, j, d, sum(x for _, i, x in got if i == j), total, sha(",".join(map(str, cs[j])).encode())) for v, j, d in got]


def vector_rows(n=120, dims=64, seed=5):
    rng = random.Random(seed)
    middles = [[rng.uniform(-1, 1) for _ in range(dims)] for _ in range(5)]
    rows = [(i, [float(np.float32(m + rng.gauss(0, 0.2))) for m in middles[i % 5]]) for i in range(n)]
    rows += [(n, None), (n + 1, []), (n + 2, [1.0] * (dims - 1)), (n + 3, [1.0] * (dims + 1)), (n + 4, [float("nan")] * dims), (n + 5, [0.5] * (dims - 1) + [None]), (n + 6, [float("inf")] * dims)]
    return rows + [(n + 7, [0.0] * dims), (n + 8, [0.0] * dims), (n + 9, rows[3][1]), (None, rows[4][1]), (7, rows[8][1]), (7, rows[8][1])]


def frame(spark, rows, kind="float"):
    return spark.createDataFrame([(v, e, 1, "x") for v, e in rows], f"vec_id long, embedding array<{kind}>, cluster int, q string").repartition(3)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_centroids_equal_plain_python(spark, kind):
    rows = vector_rows()
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, centroids.clusters(frame(spark, rows, kind)).collect()), key=key) == sorted(clustered(rows), key=key)


def test_centroids_of_few_or_no_vectors(spark):
    few = [(1, [0.5, 1.0]), (2, [0.5, 1.0]), (3, [-3.25, 1e4])]
    assert sorted(map(tuple, centroids.clusters(frame(spark, few), dims=2).collect())) == sorted(clustered(few, dims=2))
    assert centroids.clusters(frame(spark, [])).count() == 0
    assert centroids.clusters(frame(spark, [(1, None), (2, [1.0])])).count() == 0


def test_components_out_of_range_are_refused(spark):
    with pytest.raises(Exception, match="64 bits"):
        centroids.clusters(frame(spark, [(1, [1e30, 0.0])]), dims=2)


def test_nearest_is_exact_where_float32_is_not():
    """Distances that differ by 1, or not at all, among components far beyond float32's whole numbers."""
    rng = np.random.default_rng(2)
    for largest in (3, 1000, 1 << 25):
        c = rng.integers(-largest, largest + 1, (8, 64))
        c[5], c[6] = c[2], c[2]
        c[6, 0] += 1
        q = np.r_[c, np.repeat(c, 4, 0) + rng.integers(-2, 3, (32, 64)), (c[:1] + c[1:2]) // 2, rng.integers(-largest, largest + 1, (500, 64))]
        exact = ((q[:, None, :] - c[None]) ** 2).sum(axis=2)
        assert (centroids.nearest(q, c) == exact.argmin(axis=1)).all()


def test_centroids_query(spark, tmp_path):
    rows = [r for r in vector_rows(40) if r[0] is not None]
    frame(spark, rows).drop("q").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert pq.read_table(f"{tmp_path}/embeddings.parquet").num_rows == len(rows)
    out = QUERIES["op12_centroids"](spark, str(tmp_path))
    assert out.dtypes == [("vec_id", "bigint"), ("cluster", "int"), ("distance", "bigint"), ("cluster_inertia", "bigint"), ("inertia", "bigint"), ("centroid_sha256", "string")]
    assert sorted(map(tuple, out.collect())) == sorted(clustered(rows))
