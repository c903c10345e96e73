"""Evaluation with a classifier of this job, seeds by rounds, all rules in one pass."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tamiz.functions.text import month_of
from tamiz.functions.vocabulary import ALL_DIMENSIONS, CODES
from tamiz.operators import classify, discovery, evaluate, stats
from tamiz.sources.model import view


def test_live_evaluation_of_stored_labels_equals_the_stored_one(spark):
    """A model that says what is stored is judged as the stored labels are."""
    stored = {"uno": [("VDG_VIOLENCIA_SIMBOLICA", "1.1"), ("VDG_HOSTILIDAD_FEMINICIDIO", "3.1")], "dos": [], "tres": [("VDG_VIOLENCIA_SIMBOLICA", "1.2")], "cuatro": []}
    rows = [(k, f"este es el texto {k}", "CODIGO_99" if k == "cuatro" else None) for k in stored] + [("vacio", "", None), ("risa", "jajaja", "CODIGO_99")]
    truth = spark.createDataFrame([("uno", "VDG_VIOLENCIA_SIMBOLICA", "1.1"), ("dos", "VDG_VIOLENCIA_SIMBOLICA", "1.1"), ("tres", "VDG_VIOLENCIA_SIMBOLICA", "1.3")], "content_id string, categoria string, dimension string")
    items = spark.createDataFrame(rows, "content_id string, text string, gt_exclusion string")

    def model(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: json.dumps({"clasificaciones": [{"categoria": c, "dimension": d, "severidad": "media"} for c, d in stored[t.split()[-1]]]}))

    found, predicted = evaluate.live(items, lambda c: classify.classify(c, model))
    assert sorted(map(tuple, predicted.collect())) == sorted((k, c, d) for k, ls in stored.items() for c, d in ls)
    got = {r["content_id"]: (r["match"], r["jaccard"], r["item_fp"], r["item_fn"]) for r in evaluate.per_item(found, truth, predicted).collect()}
    assert got == {"uno": ("partial", 0.5, False, False), "dos": ("none", 0.0, False, True), "tres": ("none", 0.0, False, False), "cuatro": ("none", 1.0, False, False), "risa": ("exact", 1.0, False, False)}
    m = evaluate.micro(truth, predicted).first()
    assert (m["tp"], m["fp"], m["fn"]) == (1, 2, 2)
    focus = {r["content_id"]: r for r in evaluate.focused(found, truth, predicted).collect()}
    assert {k: r["match"] for k, r in focus.items()} == {"uno": "partial", "dos": "fn", "tres": "none", "cuatro": "exact", "risa": "exact"}
    assert focus["uno"]["pred"] == ["VDG_HOSTILIDAD_FEMINICIDIO::3.1", "VDG_VIOLENCIA_SIMBOLICA::1.1"] and focus["uno"]["seconds"] > 0 and focus["risa"]["seconds"] is None
    s = evaluate.focused_summary(evaluate.focused(found, truth, predicted)).first()
    assert (s["n_items"], s["exact"], s["partial"], s["fp"], s["fn"], s["none"], s["errors"]) == (5, 2, 1, 0, 1, 1, 0)


def test_what_fails_stays_among_the_items(spark):
    def model(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: "{broken")

    items = spark.createDataFrame([("a", "un texto normal", None)], "content_id string, text string, gt_exclusion string")
    found, predicted = evaluate.live(items, lambda c: classify.classify(c, model))
    assert predicted.count() == 0 and found.first()["error"] == "invalid_json"
    codes = spark.createDataFrame([(1,), (6,), (0,), (7,), (None,)], "o int").select(evaluate.category_of(F.col("o"), CODES)).collect()
    assert [r[0] for r in codes] == [CODES[0], CODES[5], "UNKNOWN_0", "UNKNOWN_7", None]


EDGES = [("a", "b", 0.9), ("a", "c", 0.6), ("b", "d", 0.7), ("b", "a", 1.0), ("d", "e", 0.8), ("c", "f", 1.0), ("a", "e", 0.1), ("d", "g", 0.9), ("b", "g", 0.5), ("d", None, 1.0)]


def test_seeds_by_rounds(spark, tmp_path):
    edges = spark.createDataFrame(EDGES, "discovered_from string, url string, score double")
    asked = []

    def discover(seeds):
        asked.append(sorted(r["url"] for r in seeds.collect()))
        return edges.join(seeds.select(F.col("url").alias("s")), F.col("discovered_from") == F.col("s"), "left_semi")

    d = discovery.Discovery(spark, str(tmp_path / "d"))
    d.start(spark.createDataFrame([("a",), ("a",), (None,)], "url string"))
    assert d.run(discover, most_rounds=1) == [1]
    # As if the run had been lost here: another one goes on, and asks nothing again.
    d = discovery.Discovery(spark, str(tmp_path / "d"))
    d.start(spark.createDataFrame([("zzz",)], "url string"))
    assert d.run(discover) == [1, 2] and asked == [["a"], ["b"], ["d"], ["e", "g"]]
    want = [("a", None, None, 0), ("b", "a", 0.9, 1), ("d", "b", 0.7, 2), ("e", "d", 0.8, 3), ("g", "d", 0.9, 3)]
    assert sorted(map(tuple, d.seeds().collect())) == want
    assert discovery.Discovery(spark, str(tmp_path / "none")).run(discover) == []


def test_the_votes_are_read_once(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    votes = stats.placed(stats.votes(view(spark, d, "m_analysis"), view(spark, d, "m_labels")), view(spark, d, "m_posts"), view(spark, d, "m_pages"), month_of("date"))
    votes.write.parquet(str(tmp_path / "v"))
    v = spark.read.parquet(str(tmp_path / "v"))
    rules = stats.all_rules(v)
    plan = rules._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation ") == 1 or plan.count("Relation[") == 1
    rows = {(r["seccion"], r["fila"], r["columna"]): r for r in rules.collect()}
    for section, values, column in ((stats.CATEGORY, CODES, "categoria"), (stats.DIMENSION, ALL_DIMENSIONS, "dimension")):
        for r in stats.frequency(v, stats.universe_of(v, values), column).collect():
            own = rows[section, r["value"], None]
            assert (own["n"], own["pct"], own["pct_acumulado"], own["rango"]) == (r["n"], r["pct"], r["pct_acumulado"], r["rango"])
    for r in stats.grid(v).collect():
        own = rows[stats.GRID, r["categoria"], r["dimension"]]
        assert (own["n"], own["pct"]) == (r["n"], round(r["pct"], 2))
    pages = v.groupBy("categoria", "pagina").count().collect()
    assert {k[1:]: r["n"] for k, r in rows.items() if k[0] == stats.PAGE} == {(r["categoria"], r["pagina"]): r["count"] for r in pages}


def test_the_file_of_all_rules(spark):
    d = "/root/testdata/sf0.001"
    v = stats.placed(stats.votes(view(spark, d, "m_analysis"), view(spark, d, "m_labels")), view(spark, d, "m_posts"), view(spark, d, "m_pages"), month_of("date"))
    rows = stats.snapshot(view(spark, d, "m_analysis"), view(spark, d, "m_feedback"), v).collect()
    by = {}
    for r in rows:
        by.setdefault(r["seccion"], []).append(json.loads(r["fila"]))
    assert by["valores_perdidos"] == [json.loads(stats.missing_values(view(spark, d, "m_analysis")).toJSON().first())]
    assert {r["moda"] for r in by["moda_categoria"]} == {r["moda"] for r in stats.modes(v, "categoria").collect()}
    assert by["confiabilidad"][0]["soporte"] == stats.reliability(stats.confusion(view(spark, d, "m_feedback"), view(spark, d, "m_analysis"))).first()["soporte"]


@pytest.mark.parametrize("name", ["g7_live_items", "g8_focused_items", "g1_truth_codes", "s21_all_rules", "s19_statistics_file"])
def test_against_sql(spark, name):
    from .test_operators import same_as_sql

    same_as_sql(spark, name)


def test_promoted_reviews(spark):
    from tamiz.operators.review import promoted

    a = spark.createDataFrame([(1, "A", "1.1", "baja", "false", "CODIGO_99", "X"), (2, "A", None, "baja", "true", None, None), (3, "A", None, "baja", "true", None, None), (4, "A", "1.1", "baja", "true", None, None)], "id int, categoria string, dimension string, severidad string, tiene_violencia string, exclusion_label string, exclusion_codigo string")
    ls = spark.createDataFrame([(1, 0, "A", "1.1", "baja"), (4, 0, "A", "1.1", "baja")], "analysis_result_id int, orden int, categoria string, dimension string, severidad string")
    f = spark.createDataFrame([(0, 1, "true", None, None), (1, 1, "false", None, None), (2, 1, "false", "VDG_Z", None), (3, 2, "false", "VIOLENCIA_COMUN", None), (4, 3, None, None, "2.1"), (5, 9, "false", "VDG_Z", None)], "pos int, analysis_result_id int, agrees string, corrected_categoria string, corrected_dimension string")
    fl = spark.createDataFrame([(1, 0, "VDG_SALVAGUARDA_FALSO_POSITIVO", "6.3", "baja"), (1, 1, "VDG_Y", "2.2", "alta"), (1, 2, "VDG_W", None, "alta"), (2, 0, "VDG_Q", None, "alta")], "pos int, orden int, categoria string, dimension string, severidad string")
    rows, labels, left = promoted(a, ls, f, fl)
    got = {r["id"]: tuple(r)[1:] for r in rows.collect()}
    assert got == {1: ("VDG_Y", "2.2", "alta", "true", None, None, 1), 2: ("VIOLENCIA_COMUN", None, "ninguna", "false", "VIOLENCIA_COMUN", "FEEDBACK_PROMOTION", 3), 3: ("ninguna", "2.1", "ninguna", "false", None, None, 4), 4: ("A", "1.1", "baja", "true", None, None, None)}
    assert sorted((r["analysis_result_id"], r["orden"], r["categoria"]) for r in labels.collect()) == [(1, 0, "VDG_SALVAGUARDA_FALSO_POSITIVO"), (1, 1, "VDG_Y"), (1, 2, "VDG_W"), (2, 0, "VIOLENCIA_COMUN"), (4, 0, "A")]
    assert sorted(r["pos"] for r in left.collect()) == [0, 5]


def test_ranks_over_ranges(spark):
    from tamiz.operators.vectors import above

    rows = [(i, (i * 37 % 50) / 10) for i in range(300)] + [(1000, None)]
    df = spark.createDataFrame(rows, "i int, score double").repartition(3)
    good = sorted((s for _, s in rows if s is not None and s >= 1.0), reverse=True)
    for parts in (1, 2, 7, 500):
        got = above(df, threshold=1.0, parts=parts).collect()
        assert len(got) == len(good) and all(r["rank"] == good.index(r["score"]) + 1 for r in got)
    assert above(df, threshold=99.0).count() == 0


def test_the_violence_report_is_written_in_folders(spark, tmp_path):
    from tamiz.sources.sinks import write_violence_report

    a = spark.createDataFrame([(1, "A", "alta", "true"), (2, None, "alta", "true"), (3, "A", "baja", "false")], "id int, categoria string, severidad string, tiene_violencia string")
    write_violence_report(a, f"{tmp_path}/r")
    got = spark.read.json(f"{tmp_path}/r")
    assert sorted((r["seccion"], r["valor"], r["id"]) for r in got.collect()) == [("categoria", "A", 1), ("categoria", "unknown", 2), ("severidad", "alta", 1), ("severidad", "alta", 2)]


def test_live_runs_the_classifier_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def model(texts):
        seen.add(len(texts))
        return [None for _ in texts]

    from tamiz.operators import classify, evaluate

    items = spark.createDataFrame([(i, f"una frase cualquiera sobre el trabajo numero {i}", None) for i in range(9)], "content_id long, text string, gt_exclusion string")
    kept, predicted = evaluate.live(items, lambda c: classify.classify(c, model), f"{tmp_path}/live")
    truth = spark.createDataFrame([(1, "a", None)], "content_id long, categoria string, dimension string")
    assert evaluate.per_item(kept, truth, predicted).count() == 9 and evaluate.focused(kept, truth, predicted).count() == 9 and seen.value == 9


def test_error_rows_and_exact_groups_filter_by_nothing_costly(spark):
    from tamiz.operators import analyse, dedup

    rows = [("post", f"p{i}", "una frase cualquiera sobre el trabajo", r) for i, r in enumerate(["{}", "no json", None, "[]"])]
    content = spark.createDataFrame(rows, "content_type string, content_id string, text string, reply string").selectExpr("content_type", "content_id", "content_id as post_id", "cast(null as string) as comment_id", "text", "reply")
    errors = analyse.error_rows(analyse.analysed(content, reply="reply"))
    assert sorted((r["content_id"], r["error_bucket"], r["error"]) for r in errors.collect()) == [("p1", "errors_parse", "invalid_json"), ("p2", "errors_model", "no_reply"), ("p3", "errors_validation", "not_an_object")]
    comments = spark.createDataFrame([("a", "Hola  a todas", "x", "p"), ("b", "hola a todas", " x", "p"), ("c", "hola a todas", "y", "p"), ("d", " ", "x", "p"), ("e", None, "x", "p"), ("f", "hola a todas", None, None)], "id string, text string, author string, post_id string")
    groups = dedup.exact_clusters(comments)
    assert sorted((r["id"], r["cluster"], r["text"]) for r in groups.collect()) == [("a", "a", "Hola  a todas"), ("b", "a", "hola a todas")]
    for df in (errors, groups):
        filters = [line for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Filter" in line]
        assert not [f for f in filters if "RLIKE" in f or "regexp" in f or "json" in f]
    assert "Join" not in groups._jdf.queryExecution().optimizedPlan().toString()
