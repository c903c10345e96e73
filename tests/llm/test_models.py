"""Mixing, packing, vectors, language, toxicity and secrets: against brute force, round trips and held-out rows."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from tamiz.llm import language_id, mixing, near_vectors, packing, secrets, toxicity

from . import brute
from .conftest import make


def test_targets_share_the_excess(spark):
    rows = [("a", 10), ("b", 1000), ("c", 500), (None, 400), ("d", 0)]
    got = {r["src"]: r["target"] for r in mixing.targets(spark.createDataFrame(rows, "src string, size long")).collect()}
    size = {s: n for s, n in rows}
    weight = dict(zip(sorted(s for s in size if s) + [None], [5, 2, 1, 5, 2]))
    target, fixed = {}, {}
    while True:
        rest, w = sum(size.values()) - sum(fixed.values()), sum(weight[s] for s in size if s not in fixed)
        target = {**fixed, **{s: rest * weight[s] / w for s in size if s not in fixed}}
        over = {s: 3.0 * size[s] for s in size if s not in fixed and target[s] > 3 * size[s]}
        if not over:
            break
        fixed |= over
    assert got == pytest.approx(target)


def test_flight_keeps_both_totals():
    rng = np.random.default_rng(2)
    p, size = rng.random(500), rng.integers(1, 900, 500)
    out = mixing.flight(p, size, rng)
    assert ((out > 1e-9) & (out < 1 - 1e-9)).sum() <= 2
    assert out.sum() == pytest.approx(p.sum(), abs=1e-6) and (out * size).sum() == pytest.approx((p * size).sum(), rel=1e-6)
    same = mixing.flight(p, np.full(500, 7), np.random.default_rng(1))
    assert same.sum() == pytest.approx(p.sum(), abs=1e-6)


def test_mix(docs, texts, empty):
    rows = mixing.mix(docs, cell=20).collect()
    again = {r["doc_id"]: r["times"] for r in mixing.mix(docs.repartition(7), cell=20).collect()}
    assert {r["doc_id"]: r["times"] for r in rows} == again and len(rows) == len(texts)
    by = {}
    for r in rows:
        assert 0 <= r["times"] <= 3 and r["taken"] == r["times"] * r["size"]
        x = by.setdefault(r["src"], [0, r["target"], 0])
        x[0] += r["taken"]
        x[2] = max(x[2], r["size"])
    for taken, target, largest in by.values():
        assert abs(taken - target) <= largest
    assert mixing.mix(empty).count() == 0


def test_packs_hold_what_they_may():
    rng = random.Random(1)
    counts = {n: rng.randint(0, 50) for n in range(1, 300)} | {2048: 9}
    patterns = packing.shortest_pack_first({n: c for n, c in counts.items() if c})
    assert all(sum(p) <= 2048 for p, _ in patterns)
    back = {}
    for p, c in patterns:
        for n in p:
            back[n] = back.get(n, 0) + c
    assert back == {n: c for n, c in counts.items() if c}


def test_packing_round_trip(docs, texts, empty):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = packing.tokenizer(path)
    want = {}
    for d, t in texts:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want |= {(d, s): (len(ids[s:s + 2048]), zlib.crc32(ids[s:s + 2048].tobytes()), len(ids)) for s in range(0, len(ids), 2048)}
    rows = packing.pack(docs, path).collect()
    assert {(r["doc_id"], r["start"]): (r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows} == want
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(empty, path).count() == 0


def test_near_vectors(spark):
    rng = np.random.default_rng(5)
    rows, base = [], rng.standard_normal((12, 16))
    for i in range(150):
        v = base[i % 12] + rng.standard_normal(16) * (0.02 if i % 3 else 0.5)
        rows.append((i, v.tolist(), i % 2))
    rows += [(200, rows[1][1], 1), (201, [0.0] * 16, 0), (202, None, 0), (203, [float("nan")] * 16, 0), (204, rows[1][1], None), (205, [None] * 16, 1), (206, [1e200 * x for x in rows[1][1]], 1), (1, rows[1][1], 1)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in near_vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), most_rows=20).collect()}
    fine = {i: (np.array(v) / np.abs(v).max(), lab) for i, v, lab in rows if v and lab is not None and None not in v and np.isfinite(v).all() and any(v)}
    unit = {i: (v / np.linalg.norm(v), lab) for i, (v, lab) in fine.items()}
    ids = sorted(unit)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1:] if unit[a][1] == unit[b][1] and unit[a][0] @ unit[b][0] >= 0.98]
    where = brute.components(sorted({r[0] for r in rows}), links)
    n = {i: sum(i in x for x in links) for i in where}
    assert got == {i: (n[i], where[i], where[i] == i) for i in where}
    assert near_vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_language(spark, empty):
    rng = random.Random(6)
    stems = {"en": "the and ing tion ed of to in".split(), "de": "der und ung sch ein ich".split(), "fr": "le eau que ment ou des".split()}
    text = lambda s: " ".join("".join(rng.choice(stems[s]) for _ in range(rng.randint(1, 3))) for _ in range(40))
    rows = [(i, text(s), s if i % 10 else "en", s) for i, s in enumerate(list(stems) * 60)]
    rows += [(1000, None, "en", "en"), (1001, "123 !!", "de", "de"), (1002, "ja", "de", "de"), (1003, text("fr"), None, None)]
    got = {r["doc_id"]: r for r in language_id.identify(make(spark, rows), host="source").collect()}
    right = sum(got[d]["language"] == s for d, _, _, s in rows[:180])
    assert right >= 175 and got[1003]["language"] == "fr" and got[1002]["accepted"]
    assert not got[1000]["accepted"] and not got[1001]["accepted"] and got[1000]["language"] is None
    assert sum(got[d]["accepted"] for d, *_ in rows[:180]) == 180
    assert language_id.identify(empty).count() == 0


def test_rare_languages_are_modelled(spark):
    rng = random.Random(16)
    stems = {"en": "the and ing tion ed of to in", "de": "der und ung sch ein ich", "fr": "le eau que ment ou des", "es": "los cion ado para muy por", "it": "gli zione che sono della", "pt": "nao coes uma com lho"}
    text = lambda s: " ".join("".join(rng.choice(stems[s].split()) for _ in range(rng.randint(1, 3))) for _ in range(40))
    declared = ["en"] * 80 + ["de"] * 60 + ["fr"] * 40 + ["es"] * 19 + ["it"] * 5 + ["pt"]
    rows = [(i, text(s), s, s) for i, s in enumerate(declared)]
    held = [(1000 + 10 * k + i, text(s), None, None) for k, s in enumerate(stems) for i in range(10)]
    junk = [(2000 + i, " ".join("".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(8)) for _ in range(40)), "en", "en") for i in range(10)]
    got = {r["doc_id"]: r for r in language_id.identify(make(spark, rows + held + junk), host="source").collect()}
    for d, _, s, _ in rows:
        assert got[d]["language"] == s and got[d]["accepted"], (d, s)
    for k, s in enumerate(stems):
        assert sum(got[1000 + 10 * k + i]["language"] == s for i in range(10)) >= 9, s
    assert not any(got[d]["accepted"] and got[d]["language"] in ("es", "it", "pt") for d, *_ in junk)


def test_no_language_is_left_out_for_their_number(spark):
    rows = [(i, f"texto numero {i} de la lengua", f"l{i % 230:03d}", "s") for i in range(460)]
    assert len(language_id.fit_text(make(spark, rows), "lang").languages) == 230


def test_forward_and_backward_are_exact():
    rng = np.random.default_rng(3)
    u, order, first = rng.standard_normal(37), rng.standard_normal((2, 2)), 0.3
    begins = np.zeros(37, bool)
    begins[[0, 5, 20]] = True
    want, r = [], None
    a = np.exp(order)
    for t in range(37):
        r = np.exp(first + u[t]) if begins[t] else np.exp(u[t]) * (a[0, 1] + a[1, 1] * r) / (a[0, 0] + a[1, 0] * r)
        want.append(r)
    assert toxicity.ratios(u, begins, order, first) == pytest.approx(np.array(want))


def test_toxicity_on_held_out_rows(spark, empty):
    rng = random.Random(7)
    bad, good = ["zafio", "mezquino", "ruin", "vil"], [f"p{i}" for i in range(300)]
    rows = []
    for i in range(400):
        w = [rng.choice(good) for _ in range(rng.randint(5, 60))]
        toxic = i % 4 == 0
        for _ in range(2 * toxic):
            w[rng.randrange(len(w))] = rng.choice(bad).upper() + "!"
        rows.append((i, " ".join(w), "es", "s", toxic))
    docs = make(spark, [r[:4] for r in rows] + [(900, None, "es", "s"), (901, "", "es", "s")])
    labels = spark.createDataFrame([(r[0], int(r[4])) for r in rows if r[0] < 250], "doc_id long, toxic int")
    field = toxicity.train(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs, field).collect()}
    for d, text, _, _, toxic in rows[250:]:
        assert (got[d]["score"] >= 0.7) == toxic, d
        assert all(text.encode()[s["start"]:s["end"]].decode().lower().split("!")[0] in bad for s in got[d]["spans"])
    assert got[900]["score"] < 0.5 and got[900]["spans"] == []
    assert toxicity.train(docs, labels.where("toxic = 0")) is None
    assert toxicity.toxicity(empty, field).count() == 0


def test_secrets(spark, empty):
    findings = secrets.labelled_findings(3000, seed=9)
    model = secrets.train(spark, findings.head(2000))
    docs = make(spark, [(i, t, "en", "s") for i, t in enumerate(findings["text"][2000:])] + [(9000, None, "en", "s"), (9001, "", None, None)])
    found = {(r["doc_id"], r["start"], r["end"]): r["is_secret"] for r in secrets.scan(docs, model).collect()}
    hits = [(found.get((i, a, b), False), bool(y)) for i, (a, b, y) in enumerate(findings[["start", "end", "label"]][2000:].itertuples(index=False))]
    assert sum(f == y for f, y in hits) / len(hits) > 0.93
    assert secrets.scan(empty, model).count() == 0


def test_secrets_of_each_shape_at_exact_offsets(spark):
    rng = random.Random(31)
    own = lambda chars, k: "".join(rng.choice(chars) for _ in range(k))
    some = "abcdefghkmnpqrstuvwxyzABCDEFGHKMNPQRSTUVWXYZ23456789"
    shapes = {
        "short quoted": lambda: ('conf password = "', "hunter" + own("0123456789", 4), '" del mar'),
        "wide quoted": lambda: ('la "password": "', "P@ssw" + own("0123456789", 2) + "rd!" + own("0123456789", 4) + "#" + own("abcx", 1), '", que'),
        "wide unquoted": lambda: ("DB_PASSWORD=", "Tr0" + own(some, 4) + "&" + own(some, 3) + "!" + own("0123456789", 3), "\nnext line"),
        "short unquoted": lambda: ("user ana pwd: ", own(some, 6) + own("0123456789", 3), " y luego"),
        "environment": lambda: ("export API_KEY=", own(some, 32), "\nPORT=80"),
        "address": lambda: ("see https://example.com/list?page=2&token=", own(some, 32), "&lang=es now"),
        "long quoted": lambda: ('SECRET_KEY = "', own(some, 40), '" y'),
    }
    rows = [(name, *make_one()) for name, make_one in shapes.items() for _ in range(20)]
    line = b"https://example.com/?token=abcdef77&password=hunter2024&page=2"
    assert {b"abcdef77", b"hunter2024"} <= {line[a:b] for a, b in secrets.spans(line)}
    model = secrets.train(spark)
    found = {}
    for r in secrets.scan(make(spark, [(i, a + k + b, "en", "s") for i, (_, a, k, b) in enumerate(rows)]), model).collect():
        found.setdefault(r["doc_id"], {})[r["start"], r["end"]] = r
    hit = dict.fromkeys(shapes, 0)
    for i, (name, a, k, _) in enumerate(rows):
        r = found.get(i, {}).get((len(a), len(a) + len(k)))
        hit[name] += bool(r and r["is_secret"] and r["sha256"] == hashlib.sha256(k.encode()).hexdigest())
    assert min(hit.values()) >= 18, hit
    wrong = sum(r["is_secret"] and s != (len(rows[i][1]), len(rows[i][1]) + len(rows[i][2])) for i, of in found.items() for s, r in of.items())
    assert wrong <= 0.05 * len(rows), wrong
    harmless = ['the password is "sunshine and rain"', "key: something else", "password = os.getenv('HOME_PLACE')", 'api_key = "<your-api-key>"', "password: ********", "the key = value.name here"]
    bad = [r for r in secrets.scan(make(spark, [(i, t, "en", "s") for i, t in enumerate(harmless)]), model).collect() if r["is_secret"]]
    assert len(bad) <= 1, bad
