"""Operators on hand-made rows, and a registered query of each kind against its SQL."""

import numbers
import os

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tamiz.operators import chunks, dedup, evaluate, relational, review, stats, vectors
from tamiz.sources import scans, sinks


def same_as_sql(spark, name, d="/root/testdata/sf0.001"):
    """A registered query gives what its SQL gives."""
    from tamiz.plans.queries import ORACLES, QUERIES

    con = duckdb.connect()
    for t in os.listdir(d):
        con.execute(f"create view {t[:-8]} as select * from '{d}/{t}'")
    a, b = QUERIES[name](spark, d).toPandas(), con.execute(ORACLES[name]).df()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns) and len(a)

    def plain(x):
        """Rows as texts; numbers of either engine compare by value."""
        return sorted(str([None if v is None or v is pd.NA or v != v else round(float(v), 9) if isinstance(v, numbers.Number) and not isinstance(v, bool) else str(v) for v in r]) for r in x[cols].astype(object).itertuples(index=False))

    assert plain(a) == plain(b)


def test_upsert_keeps_what_is_null(spark):
    a = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, x string, y int")
    b = spark.createDataFrame([(2, None, 5), (3, "c", None)], "k int, x string, y int")
    assert sorted(map(tuple, relational.upsert(a, b, ["k"]).collect())) == [(1, "a", 1), (2, "b", 5), (3, "c", None)]


def test_orphans_without_key_stay_out(spark):
    c = spark.createDataFrame([(1, "p"), (2, "q"), (3, None)], "id int, post_id string")
    p = spark.createDataFrame([("p",)], "id string")
    assert [r["id"] for r in relational.orphans(c, p, "post_id", "id").collect()] == [2]


def comments(spark, rows):
    return spark.createDataFrame([(f"c{i}", t, a, "p", 0, i) for i, (t, a) in enumerate(rows)], "id string, text string, author string, post_id string, likes int, pos int")


def test_duplicate_groups(spark):
    long_ = "esta es una frase bastante larga que sigue"
    rows = [(long_, "x"), (long_ + " y sigue y sigue hasta el final de todo", "x"), (long_ + " 17 min", "x"), ("otra cosa distinta", "x"), (long_, "y"), ("", "x"), (None, "x")]
    got = dedup.clusters(comments(spark, rows))
    assert sorted((r["id"], r["cluster"]) for r in got.collect()) == [("c0", "c0"), ("c1", "c0"), ("c2", "c0")]
    plan = dedup.merge_plan(got).first()
    assert plan["canonical_id"] == "c1" and plan["duplicate_ids"] == ["c0", "c2"] and plan["removed_count"] == 2
    with pytest.raises(ValueError):
        dedup.clusters(comments(spark, rows), 1.5)


def test_frequency_of_nothing(spark):
    v = spark.createDataFrame([], "categoria string")
    f = stats.frequency(v, stats.universe_of(v, ["a", "b"]), "categoria").orderBy("rango").collect()
    assert [(r["value"], r["n"], r["pct"]) for r in f] == [("a", 0, 0.0), ("b", 0, 0.0)]


def test_adjusted_view(spark):
    a = spark.createDataFrame([(1, "A", "1.1", "true", None), (2, "A", "1.1", "false", None), (3, "A", "1.1", "true", "CODIGO_99"), (4, "A", None, "true", None)], "id int, categoria string, dimension string, tiene_violencia string, exclusion_label string")
    f = spark.createDataFrame([(1, "false", "ninguna", None, "2026-01", 0), (1, "true", None, None, "2025-01", 1), (2, "false", None, None, "2026", 2), (3, "false", "B", None, "2026", 3)],
                              "analysis_result_id int, agrees string, corrected_categoria string, corrected_dimension string, updated_at string, pos int")
    got = {r["id"]: (r["categoria"], r["tiene_violencia"], r["has_feedback"], r["adjusted_by_human"]) for r in review.adjusted(a, f).collect()}
    assert got == {1: ("ninguna", "false", True, True), 2: ("A", "true", True, False), 3: ("A", "true", True, False), 4: ("A", "true", False, False)}


def test_evaluation(spark):
    items = spark.createDataFrame([(1, None, None), (2, None, "X"), (3, None, None)], "content_id int, gt_exclusion string, pred_exclusion string")
    t = spark.createDataFrame([(1, "A", "1"), (1, "B", None)], "content_id int, categoria string, dimension string")
    p = spark.createDataFrame([(1, "A", "1"), (3, "C", "2")], "content_id int, categoria string, dimension string")
    got = {r["content_id"]: (r["match"], r["jaccard"], r["item_fp"]) for r in evaluate.per_item(items, t, p).collect()}
    assert got == {1: ("partial", 0.5, False), 2: ("none", 1.0, False), 3: ("none", 0.0, True)}
    m = evaluate.micro(t, p).first()
    assert (m["tp"], m["fp"], m["fn"]) == (1, 1, 1)


def test_chunks(spark):
    text = ". ".join(f"Frase numero {i} de la serie" for i in range(60)) + "."
    rows = spark.createDataFrame([(1, None), (2, " a  b "), (3, text), (4, "x" * 130 + ". fin"), (5, "")], "id int, text string")
    got = {r["id"]: r["c"] for r in rows.select("id", chunks.chunk_list("text", 100, 10).alias("c")).collect()}
    assert got[1] == got[5] == [] and got[2] == ["a b"] and got[4] == ["x" * 100, "x" * 30 + ". fin"]
    parts = got[3]
    assert all(b.startswith(a[-10:].lstrip()) for a, b in zip(parts, parts[1:])) and all(len(p) <= 110 for p in parts)
    whole = parts[0] + "".join(b[len(a[-10:].lstrip()):] if b.startswith(a[-10:]) else b for a, b in zip(parts, parts[1:]))
    assert [w for i in range(60) if (w := f"Frase numero {i} de") not in whole] == []
    flat = chunks.chunked(rows, "id", size=100, overlap=10)
    assert flat.groupBy("id").count().count() == 3 and flat.select("chunk_id").distinct().count() == flat.count() == 1 + 2 + len(parts)


def test_repeated_keys_of_a_batch(spark):
    now = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    batch = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (3, "z", 1)], "id int, v string, pos int")
    got = relational.upsert(now.withColumn("pos", F.lit(0)), batch, ["id"], "pos")
    assert sorted((r["id"], r["v"]) for r in got.collect()) == [(1, "y"), (2, "b"), (3, "z")]
    filled = relational.fill_missing(spark.createDataFrame([(1, None), (2, "b")], "id int, v string"), spark.createDataFrame([(1, "p"), (1, "q")], "id int, value string"), "id", "v")
    assert sorted((r["id"], r["v"]) for r in filled.collect()) == [(1, "q"), (2, "b")]


def test_search_refuses_unbounded_queries(spark):
    e = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "vec_id int, embedding array<double>")
    q = e.selectExpr("vec_id as query_id", "embedding as query")
    got = vectors.search(e, q, 2).where("rank = 2").orderBy("query_id").collect()
    assert [r["vec_id"] for r in got] == [1, 0, 1, 2, 3]
    with pytest.raises(ValueError):
        vectors.search(e, q, 2, most_queries=3)


def test_scans_and_sinks(spark, tmp_path):
    (tmp_path / "seeds.txt").write_text("# lista\n\nhttps://facebook.com/pagina\nhttps://x.org/a\n")
    assert sorted(map(tuple, scans.seeds(spark, str(tmp_path / "seeds.txt")).collect())) == [("https://facebook.com/pagina", "page"), ("https://x.org/a", "unknown")]
    (tmp_path / "k").mkdir()
    (tmp_path / "k/a.md").write_text("# Uno\ntexto")
    assert scans.knowledge(spark, str(tmp_path / "k")).first()["content"] == "Uno\ntexto"
    assert scans.fenced_tokens("x\n```plain\na\n# no\nb\n```") == ["a", "b"] and scans.sections("## A\n1\n## B\n2") == {"A": "1", "B": "2"}
    sinks.write_csv(spark.createDataFrame([(1, ["a", "b"])], "i int, m array<string>"), str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).first()["m"] == "a|b"


@pytest.mark.parametrize("name", ["r3_labels_nested", "r17_upsert_customers", "a3_frequency_dimension", "a5_crosstab_pivot", "v1_adjusted", "g5_class_metrics", "l5_valid_labels", "l7_keyword_labels", "k3_nearest_vectors", "l12_feedback_payload", "l13_valid_pairs", "a23_precision_shown"])
def test_query_against_sql(spark, name):
    same_as_sql(spark, name)


def test_a_large_block_compares_only_what_may_be_alike(spark, monkeypatch):
    import difflib
    import random

    r = random.Random(5)
    words = ["".join(r.choice("aeinorsthdlwbu") for _ in range(r.randint(2, 8))) for _ in range(300)]
    texts = [" ".join(r.choice(words) for _ in range(26)) for _ in range(300)]
    texts += [t[:90] + t[93:] for t in texts[:5]] + [t[: len(t) // 2] for t in texts[5:10]]
    tried, matcher = [], difflib.SequenceMatcher

    def counted(*a):
        tried.append(a)
        return matcher(*a)

    monkeypatch.setattr(difflib, "SequenceMatcher", counted)
    heads, places = dedup.Heads(0.95), []
    for t in texts:
        places.append(heads.first(t))
        if places[-1] is None:
            heads.add(t)
    assert places[:300] == [None] * 300 and places[300:] == list(range(10)) and len(tried) < 50
    got = dedup.clusters(comments(spark, [(t, "x") for t in texts]))
    assert sorted((x["cluster"], x["id"]) for x in got.collect()) == sorted((f"c{k}", f"c{i}") for k in range(10) for i in (k, 300 + k))
    assert sorted((x["old"], x["new"]) for x in dedup.duplicate_map(got).collect()) == sorted((f"c{300 + k}", f"c{k}") for k in range(10))


@pytest.mark.parametrize("threshold", [0.0, 0.5, 0.8, 0.95, 1.0])
def test_duplicates_as_by_comparing_all(threshold):
    import difflib
    import random

    r, heads, tails = random.Random(7), dedup.Heads(threshold), 0
    for _ in range(10):
        base, seen = ["".join(r.choice("abc dñ€") for _ in range(n)) for n in (4, 30, 80, 300)], []
        heads.clear()
        for _ in range(30):
            t = list(r.choice(base))
            for _ in range(r.choice([0, 1, 3, 8])):
                t[r.randrange(len(t))] = r.choice(["", "x", "yz"])
            t = "".join(t)[: r.choice([1000, 25, 1000])] or "x"
            cut = lambda a, b: len(a) >= 20 and len(b) >= int(1.5 * len(a)) and b.startswith(a)
            want = next((k for k, h in enumerate(seen) if cut(t, h) or cut(h, t) or difflib.SequenceMatcher(None, t, h).ratio() >= threshold), None)
            assert heads.first(t) == want
            tails += want is not None
            if want is None:
                seen.append(t)
                heads.add(t)
    assert tails


@pytest.mark.parametrize("digits", [None, 2])
def test_search_by_cells_is_exact(spark, monkeypatch, digits):
    """Cells, parts and salts, near values of one component, copies, and vectors of other lengths or without numbers: as all pairs give them."""
    monkeypatch.setattr(vectors, "CELL", 16)
    monkeypatch.setattr(vectors, "PER_CELL", 4)
    monkeypatch.setattr(vectors, "SEEN", 8)
    monkeypatch.setattr(vectors, "TOGETHER", 40)
    x = [[float(i % 7 * 3), float(i * i % 11), float(i // 3)] for i in range(600)] + [[7.0, 7.0, 7.0]] * 60
    x += [None, [], [], [1.0], [1.0, float("nan"), 2.0], [None, 1.0, 2.0], [1e200, 0.0, 0.0], [float("inf"), 0.0, 0.0], [-0.0, 0.0, 0.0], [0.0, -0.0, 0.0]]
    rows = spark.createDataFrame([(f"r{i}", v) for i, v in enumerate(x)], "vec_id string, embedding array<double>").repartition(3)
    q = rows.where("vec_id like '%3' or vec_id >= 'r65'").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    pairs = rows.crossJoin(q).withColumn("distance", vectors.squared_distance("embedding", "query"))
    w = Window.partitionBy("query_id").orderBy(F.asc_nulls_last("distance" if digits is None else F.round("distance", digits)), "vec_id")
    want = pairs.withColumn("rank", F.row_number().over(w)).where("rank <= 4").select("query_id", "vec_id", "rank")
    assert sorted(map(tuple, vectors.search(rows, q, 4, digits=digits).select("query_id", "vec_id", "rank").collect())) == sorted(map(tuple, want.collect()))


def test_search_meets_few_pairs(spark, monkeypatch):
    """Queries go to the cells that may hold their nearest rows: four times the rows and queries make about four times the visits."""
    monkeypatch.setattr(vectors, "CELL", 32)

    def visits(n):
        x = np.random.default_rng(3).random((n, 2))
        cells = vectors.Cells(x, 16, 0)
        q = x[::20]
        i, at = cells.about(q, cells.bounds(q, 3))
        assert len(cells.sizes) > n // 32 and set(zip(range(len(q)), cells.of(q))) <= set(zip(i, at))
        return len(i)

    assert visits(8000) < 5 * visits(2000)


def test_search_works_its_input_out_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def read(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    rows = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(20)], "vec_id long, embedding array<double>")
    q = rows.where("vec_id < 5").selectExpr("vec_id as query_id", "embedding as query").mapInPandas(read, "query_id long, query array<double>")
    assert vectors.search(rows, q, 2).count() == 10 and seen.value == 5


def test_search_ranks_what_it_rounds(spark):
    rows = spark.createDataFrame([(1, [1.00000002]), (2, [1.0]), (3, [1.1])], "vec_id long, embedding array<double>")
    q = spark.createDataFrame([(7, [0.0])], "query_id long, query array<double>")
    found = lambda k, **w: [(r["vec_id"], r["distance"], r["rank"]) for r in vectors.search(rows, q, k, **w).orderBy("rank").collect()]
    assert found(2, digits=6) == [(1, 1.0, 1), (2, 1.0, 2)] and found(1, digits=6) == [(1, 1.0, 1)]
    assert [r[0] for r in found(2)] == [2, 1]
