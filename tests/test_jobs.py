"""Jobs, few-shot examples, suggestions, ingest, titles and samples."""

import json

import pytest
from pyspark.sql import functions as F

from tamiz.__main__ import main
from tamiz.operators import chunks, feedback, fewshots, loads, store
from tamiz.plans.store import letters
from tamiz.sources import scans

PAGE = """<title>T</title><body><div role="article"><a href="/p">Página</a><p>te voy a matar dice la nota</p><ul><li data-testid="comment">jajajaja</li><li data-testid="comment">Me parece que no es cierto nada</li>
<li data-testid="comment">Me parece que no es cierto nada de eso que cuentan aquí ustedes</li></ul></div></body>"""


def test_jobs_from_pages_to_report(spark, tmp_path):
    spark.createDataFrame([(1, "https://x/1", PAGE), (2, "https://x/2", "<p>")], "page_id int, url string, html string").write.parquet(f"{tmp_path}/html")
    run = lambda *a: main([a[0], "--store", f"{tmp_path}/s", *a[1:]], spark)
    got = run("all", "--html", f"{tmp_path}/html")
    # One comment is another one's beginning, by the same unknown author.
    assert (got["pages"], got["posts"], got["comments"], got["posts_analyzed"], got["comments_analyzed"], got["errors"]) == (2, 1, 2, 1, 2, 0)
    assert run("analyze")["posts_analyzed"] == 0
    assert run("status")["analyses"] == 3
    assert run("report")["estados"] == {"basura": 1, "con_violencia": 1, "sin_violencia": 1}
    comment = lambda author: {"id": author, "text": "Esto lo dicen dos personas aquí", "author": author, "date": None, "likes": "1", "created_at": None, "url": None}
    post = {"id": "a", "text": "x", "author": None, "date": None, "likes": None, "shares": None, "url": None, "comments": [comment("Ana"), comment("Eva")]}
    spark.createDataFrame([("g", "u", "T", 1, None, None, None, [post])], loads.NESTED).write.parquet(f"{tmp_path}/nested")
    assert run("load", "--nested", f"{tmp_path}/nested")["comments"] == 4
    assert run("dedup") == {"duplicates": 1, "analyses_of_duplicates": 0, "applied": False} and run("status")["comments"] == 4
    assert run("dedup", "--apply")["applied"] and run("status")["comments"] == 3 and run("dedup")["duplicates"] == 0
    with pytest.raises(SystemExit):
        run("load")


def test_few_shots(spark, tmp_path):
    label = {"_id": 1, "categoria": " VDG_X ", "dimension": "1.1", "severidad": "Alta-extrema", "justificacion": " j ", "marcadores_detectados": ["a", "", None, 3]}
    data = {"examples": [{"text": " uno ", "result": {"clasificaciones": [label, 5], "severidad_global": "extrema"}}, {"text": "dos", "result": {"categoria": "VDG_Y", "severidad": "media", "tiene_violencia": False}},
                         {"text": "tres", "result": {"categoria": "ninguna", "exclusion_label": "CODIGO_99"}}, {"text": None}, "x"]}
    (tmp_path / "f.json").write_text(json.dumps(data))
    got = scans.few_shots(spark, str(tmp_path / "f.json")).orderBy("pos").collect()
    assert [(r["text"], r["tiene_violencia"], r["severidad"], r["exclusion_label"]) for r in got] == [("uno", True, "alta", None), ("dos", False, "media", None), ("tres", False, "ninguna", "CODIGO_99"), ("", False, "ninguna", None)]
    assert got[0]["labels"][0].asDict() == {"categoria": "VDG_X", "dimension": "1.1", "severidad": "alta", "justificacion": "j", "evidencia": "", "regla_disparada": None, "marcadores": ["a", "3"]}
    assert got[1]["labels"][0]["categoria"] == "VDG_Y" and got[2]["labels"] == []
    (tmp_path / "g.json").write_text('{"examples": []}')
    with pytest.raises(ValueError):
        scans.few_shots(spark, str(tmp_path / "g.json"))


def test_suggestions(spark):
    rows = [("1.1, 2.2", [("VDG_A", "1.1"), ("VDG_B", None), ("ninguna", None)]), ("VDG_B", [("VDG_B", None)]), ("3.3", [("VDG_A", "1.1")]), ("", []), (None, None)]
    df = spark.createDataFrame(rows, "s string, l array<struct<categoria:string,dimension:string>>")
    got = [r[0] for r in df.select(fewshots.suggestion("s", "l")).collect()]
    assert [(r["coinciden"], r["faltan"], r["resultado"]) for r in got] == [(["1.1"], ["2.2"], "algunas"), (["VDG_B"], [], "todas"), ([], ["3.3"], "ninguna"), ([], [], "vacio"), ([], [], "vacio")]
    assert got[0]["sobran"] == ["VDG_A/1.1", "VDG_B/"] and got[1]["ia"] == ["VDG_B/"]


def test_ingest(spark, tmp_path):
    long_ = " ".join(f"Frase numero {i} de la serie." for i in range(60))
    files = spark.createDataFrame([("a.md", f"# Título\n**{long_}**"), ("b.txt", "corto"), ("c.txt", " \n")], "source string, content string")
    c = store.Collection(spark, f"{tmp_path}/c", letters, parts=2)
    got = {r["source"]: (r["chunks"], r["error"]) for r in store.ingest(files, c, tags=" x, ,y").collect()}
    n = len(spark.createDataFrame([(f"Título\n{long_}",)], "t string").select(chunks.chunk_list("t")).first()[0])
    assert got == {"a.md": (n, None), "b.txt": (1, None), "c.txt": (0, "sin chunks extraíbles")} and c.count() == n + 1
    rows = c.table.read().where("source = 'a.md'").collect()
    assert {r["metadata"]["format"] for r in rows} == {"md"} and {r["metadata"]["tags"] for r in rows} == {"x,y"} and {r["metadata"]["total_chunks"] for r in rows} == {str(n)} and "**" not in rows[0]["text"]
    store.ingest(files, c)
    assert c.count() == n + 1
    store.ingest(spark.createDataFrame([("a.md", "nuevo")], "source string, content string"), c, replace=True)
    assert sorted(r["text"] for r in c.table.read().collect()) == ["corto", "nuevo"]


def test_titles_and_samples(spark):
    dims = spark.createDataFrame([("A", "Uno", "1.1"), ("A", "Uno", "1.2"), ("B", "", "2.1")], "categoria string, label string, dimension string")
    none = spark.createDataFrame([], "code string, title string, source string")
    rows, changed = fewshots.seeded_titles(none, dims)
    assert sorted(map(tuple, rows.collect())) == [("A", "Uno", "taxonomy"), ("B", "B", "taxonomy")] and changed.count() == 0
    rows, changed = fewshots.seeded_titles(spark.createDataFrame([("A", "Mío", "override")], "code string, title string, source string"), dims)
    assert [tuple(r) for r in rows.collect()] == [("A", "Mío", "override")] and changed.count() == 1
    df = spark.range(50)
    assert fewshots.first_rows(df, 7).count() == 7 and fewshots.random_rows(df, 7, 1).count() == 7 and fewshots.random_rows(df, 7, 1).collect() == fewshots.random_rows(df, 7, 1).collect()


def test_full_form_labels(spark):
    one = ("VDG_MANOSFERA_ANTIFEMINISMO", "4.1", " Alta ", None, "e", " r ", " a ,b,", 0.5, None, "Sí")
    df = spark.createDataFrame([([one, ("otra", *one[1:]), one, ("ninguna", "", None, "j", None, "", None, None, 1.0, None)],), (None,)], f"l array<{feedback.FULL_LABEL}>")
    got = [r[0] for r in df.select(feedback.full_form_labels("l")).collect()]
    assert [tuple(x) for x in got[0]] == [("VDG_MANOSFERA_ANTIFEMINISMO", "4.1", "alta", "", "e", "r", ["a", "b"], 0.5, None, True), ("ninguna", None, "ninguna", "j", "", None, [], None, 1.0, False)] and got[1] == []


@pytest.mark.parametrize("name", ["m7_few_shots", "l19_suggestions", "m10_inspector_rows", "l11_full_form_labels"])
def test_against_sql(spark, name):
    from .test_operators import same_as_sql

    same_as_sql(spark, name)
