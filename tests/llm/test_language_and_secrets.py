"""Language identification against plain Python, with few and many languages; secret scans of very long lines."""

import math
import random
import time

from tamiz.llm import language_id, secrets
from tamiz.llm.queries import QUERIES

KINDS = ("declared", "suffix", "host", "domain")


def fused(rows, names, least=0.5, margin=12.0, strength=20.0, use=KINDS):
    """(language, posterior, text_language, accepted) of rows (declared, suffix, host, domain, ev, p), by the docstring, value by value."""
    n = len(names)
    soft = lambda x: [math.exp(v - max(x)) / sum(math.exp(w - max(x)) for w in x) for v in x]
    known = [r for r in rows if r["p"] is not None]
    overall = [sum(r["p"][k] for r in known) for k in range(n)]
    prior = [(v + 1) / (sum(overall) + n) for v in overall]
    counts = {c: {} for c in KINDS}
    for r in known:
        for c in use:
            if r[c] is not None:
                own = counts[c].setdefault(r[c], [0.0] * n)
                for k in range(n):
                    own[k] += r["p"][k]
    out = []
    for r in rows:
        if r["ev"] is None:
            out.append((None, None, None, False))
            continue

        def shrunk(c, parent, r=r):
            own = counts[c].get(r[c])
            own = [0.0] * n if own is None else [max(0.0, v - q) for v, q in zip(own, r["p"])]
            return [(v + strength * q) / (sum(own) + strength) for v, q in zip(own, parent)]

        at = prior
        for c in ("domain", "host"):
            if c in use:
                at = shrunk(c, at)
        score = [e + math.log(q) for e, q in zip(r["ev"], at)]
        for c in ("declared", "suffix"):
            if c in use:
                score = [s + math.log(v / q) for s, v, q in zip(score, shrunk(c, prior), prior)]
        post = soft(score)
        best = post.index(max(post))
        out.append((names[best], post[best], names[r["ev"].index(max(r["ev"]))], r["ev"][best] > -margin and post[best] >= least))
    return out


def languages(n, seed=1):
    rng = random.Random(seed)
    return [["".join(rng.choice("abcdefghijklmnopñé") for _ in range(rng.randint(3, 7))) for _ in range(25)] for _ in range(n)]


def frame(spark, n_rows, n_languages, seed=2):
    rng, words, rows = random.Random(seed), languages(n_languages), []
    for i in range(n_rows):
        k = i % n_languages
        text = " ".join(rng.choice(words[k]) for _ in range(rng.choice([0, 1, 3, 20])))
        text = rng.choice([text, text, text, None, "123 !?", "zzzz"]) if i % 9 == 0 else text
        pick = lambda v: None if rng.random() < 0.2 else v
        rows.append((i, text, pick(f"l{k if rng.random() < 0.9 else 0}"), pick(f"s{k % 3}"), pick(f"h{i % 11}"), pick(f"d{i % 4}")))
    return spark.createDataFrame(rows, "doc_id long, text string, declared string, suffix string, host string, domain string").repartition(3)


def compare(spark, df, use):
    args = {c: c if c in use else None for c in KINDS}
    model = language_id.fit_text(df, "declared")
    seen = language_id.text_evidence(df, model, ["doc_id", *KINDS]).orderBy("doc_id").collect()
    want = fused([r.asDict() for r in seen], model.languages, use=use)
    got = language_id.identify(df, **args, model=model).orderBy("doc_id").collect()
    assert len(got) == len(want)
    for g, (language, posterior, text_language, accepted) in zip(got, want):
        assert (g["language"], g["text_language"], g["accepted"]) == (language, text_language, accepted)
        assert (g["posterior"] is None) == (posterior is None) and (posterior is None or abs(g["posterior"] - posterior) < 1e-9)
    return got


def test_identify_equals_plain_python(spark):
    df = frame(spark, 200, 5)
    got = compare(spark, df, KINDS)
    compare(spark, df, ("declared", "host"))
    compare(spark, df, ("host", "domain"))
    assert {g["accepted"] for g in got} == {True, False} and any(g["language"] is None for g in got)


def test_identify_with_many_languages(spark):
    began = time.time()
    got = compare(spark, frame(spark, 400, 120), ("declared", "host"))
    assert time.time() - began < 120 and len({g["language"] for g in got}) > 60


def test_counts_of_a_block_equal_those_row_by_row(spark):
    df = frame(spark, 60, 4)
    model = language_id.fit_text(df, "declared")
    import numpy as np

    rows = [(r["declared"], (r["text"] or "").encode()) for r in df.collect() if r["declared"] is not None]
    sums = np.zeros((len(model.languages), language_id.BUCKETS))
    for tag, raw in rows:
        np.add.at(sums[model.languages.index(tag)], language_id.grams(np.frombuffer(raw, np.uint8)), 1)
    frequency = language_id.smoothed(sums)
    assert np.allclose(model.scores, np.log(frequency / language_id.background_frequency(frequency.mean(axis=0))), atol=1e-5)


def test_pages_by_all_kinds_of_evidence(spark, tmp_path):
    words = languages(3)
    rng = random.Random(4)
    rows = [(i, f"https://www.h{i % 5}.e{i % 3}.{'abc'[i % 3]}x/p", f'<html lang="{"abc"[i % 3]}a"><script>no no no</script><p>{" ".join(rng.choice(words[i % 3]) for _ in range(30))}</p></html>') for i in range(60)] + [(60, None, None), (61, "x", "")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    out = QUERIES["llm_page_languages"](spark, str(tmp_path))
    assert out.dtypes == [("page_id", "bigint"), ("declared", "string"), ("language", "string"), ("posterior", "double"), ("text_language", "string"), ("accepted", "boolean")]
    got = {r["page_id"]: r for r in out.collect()}
    assert len(got) == 62 and all(got[i]["language"] == f"{'abc'[i % 3]}a" and got[i]["accepted"] for i in range(60)) and not got[60]["accepted"] and got[61]["language"] is None


def test_long_lines_take_linear_time():
    rng = random.Random(3)
    made = lambda n: ("https://x.org/?" + "&".join(f"api_key{i}=v{rng.random():.12f}" for i in range(n))).encode()
    seconds = []
    for n in (8000, 32_000):
        line = made(n)
        began = time.time()
        found = secrets.spans(line)
        seconds.append(time.time() - began)
        assert len(found) >= n
    assert seconds[1] < 10 * max(seconds[0], 0.05)


def test_values_of_addresses_and_assignments():
    text = b'see https://x.org/a?token=abcDEF123&user=bob&api_key=zz9yy8xx7#frag and password=hunter2024&more, secret: "s p a c e d" pwd=abc'
    values = {text[a:b] for a, b in secrets.spans(text)}
    assert {b"abcDEF123", b"zz9yy8xx7", b"hunter2024&more", b"s p a c e d"} <= values
    assert b"abcDEF123&user=bob" not in values and b"abc" not in values
