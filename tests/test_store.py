"""Embedding providers, collections of documents, corrections as examples."""

import json

import pytest
from pyspark.sql import functions as F

from tamiz.operators import store
from tamiz.plans.store import letters


def counted(spark):
    seen = spark.sparkContext.accumulator(0)

    def provider(texts):
        seen.add(len(texts))
        return letters(texts)

    return seen, provider


def test_a_provider_is_asked_once_for_each_different_text(spark):
    rows = spark.createDataFrame([(i, None if i % 7 == 0 else f"texto {i % 5}") for i in range(60)], "i int, text string").repartition(4)
    seen, provider = counted(spark)
    got = {r["i"]: r["embedding"] for r in store.embedded(rows, provider).collect()}
    assert seen.value == 5 and got[0] is None and got[1] == letters(["texto 1"])[0] and len(got) == 60
    known = store.vectors_of(rows.where("text in ('texto 1', 'texto 2')"), letters).cache()
    seen, provider = counted(spark)
    again = {r["i"]: r["embedding"] for r in store.embedded(rows, provider, known=known).collect()}
    assert seen.value == 3 and again == got
    assert store.embedded(rows.limit(0), letters).count() == 0


def docs(spark, *rows):
    return spark.createDataFrame(rows, "id string, source string, text string, metadata map<string,string>")


def test_add_search_delete_search(spark, tmp_path):
    seen, provider = counted(spark)
    c = store.Collection(spark, f"{tmp_path}/c", provider, parts=3)
    q = spark.createDataFrame([(1, "aaa"), (2, " "), (3, None)], "query_id int, text string")
    assert c.count() == 0 and c.search(q).count() == 0
    seen.value = 0
    c.add(docs(spark, ("1", "x", "aa", {"k": "v"}), ("2", "x", "ee", None), ("3", "y", "aae", {"k": "w"}), ("4", None, "rr", None), ("5", "y", " ", None)))
    assert c.count() == 4 and seen.value == 4
    found = lambda **w: [(r["query_id"], r["id"], r["distance"]) for r in c.search(q, 2, **w).orderBy("rank").collect()]
    assert found() == [(1, "1", 1.0), (1, "3", 2.0)]
    assert found(where={"k": "w"}) == [(1, "3", 2.0)] and found(where={"k": "z"}) == []
    c.delete("1")
    assert found() == [(1, "3", 2.0), (1, "2", 13.0)]
    c.add(docs(spark, ("3", "y", "aaa", None), ("6", "x", "aaaa", None)))
    assert found() == [(1, "3", 0.0), (1, "6", 1.0)]
    c.delete_source("x")
    assert found() == [(1, "3", 0.0), (1, "4", 13.0)] and c.count() == 2
    c.replace_sources(docs(spark, ("7", "y", "a", None), ("8", "z", "e", None)))
    assert sorted((r["id"], r["source"]) for r in c.table.read().collect()) == [("4", "desconocido"), ("7", "y"), ("8", "z")]
    c.delete_source("desconocido")
    assert c.count() == 2


def test_ids_of_their_own(spark, tmp_path):
    c = store.Collection(spark, f"{tmp_path}/c", letters, parts=2)
    rows = spark.createDataFrame([("a", 0, "uno"), ("a", 1, "dos"), ("b", 0, "uno")], "source string, chunk_index int, text string")
    c.add(rows)
    c.add(rows)
    assert c.count() == 3 and c.table.read().select("id").distinct().count() == 3


LABELS = [{"categoria": "VDG_X", "dimension": None, "severidad": "media", "confianza": 1.0, "regla_disparada": None, "marcadores": ['a"b', "ñ\n"], "falso_positivo": True, "score_ajuste": 0.5, "justificacion": 'dice "x"\t', "evidencia": "\\"},
          {"categoria": "VDG_Y", "dimension": "1.1", "severidad": "alta", "confianza": None, "regla_disparada": "R", "marcadores": None, "falso_positivo": None, "score_ajuste": 1.0, "justificacion": "", "evidencia": None}]


def test_examples_are_json(spark):
    df = spark.createDataFrame([("hola", LABELS), ("nada", [])], f"t string, l array<{store.LABEL}>")
    one, none = (r[0] for r in df.select(store.example_text("t", "l")).collect())
    head, body = one.split("\nRESULTADO: ")
    want = {"tiene_violencia": True, "severidad_global": "alta", "clasificaciones": [{"categoria": x["categoria"], "dimension": x["dimension"], "severidad": x["severidad"], "confianza": x["confianza"], "regla_disparada": x["regla_disparada"], "marcadores_detectados": x["marcadores"] or [],
            "es_falso_positivo_probable": bool(x["falso_positivo"]), "score_ajuste": x["score_ajuste"], "justificacion": x["justificacion"], "evidencia": x["evidencia"]} for x in LABELS]}
    assert head == 'TEXTO: "hola"' and body == json.dumps(want, ensure_ascii=False)
    assert none == 'TEXTO: "nada"\nRESULTADO: {"tiene_violencia": false, "severidad_global": "ninguna", "clasificaciones": []}'


def test_pending_corrections_are_pushed_and_marked(spark, tmp_path):
    kind = "id int, content_type string, content_id string, agrees string, indexed string, text_snapshot string, corrected_categoria string, corrected_dimension string, corrected_justificacion string, reviewer_user_id int, chromadb_id string, added_at string"
    rows = [(1, "post", "p1", "false", "false", "un texto", "VDG_X", "1.1", "por x", 7, None, "2026"), (2, None, "p2", "false", None, "", None, "2.1", None, None, "f2", None), (3, "post", "p1", "true", "false", "t", "VDG_X", None, None, 7, None, None),
            (4, "post", "p1", "false", "true", "t", "VDG_X", None, None, 7, "f4", None), (5, "post", "p1", "false", "false", "t", None, "", None, 7, None, None), (6, "post", "p9", "false", "false", None, "VDG_X", None, None, 99, None, None)]
    f = spark.createDataFrame(rows, kind)
    a = spark.createDataFrame([("post", "p1", "VDG_A"), ("post", "p2", "VDG_B")], "content_type string, content_id string, categoria string")
    t = spark.createDataFrame([("post", "p2", "otro texto")], "content_type string, content_id string, text string")
    u = spark.createDataFrame([(7, "ana")], "id int, username string")
    pushed = store.corrections(f, a, t, u).cache()
    got = {r["id"]: r for r in pushed.collect()}
    assert set(got) == {"feedback_1", "f2"}
    assert got["feedback_1"]["metadata"] == {"source": "human_feedback", "feedback_id": "1", "content_type": "post", "content_id": "p1", "corrected_categoria": "VDG_X", "corrected_dimension": "1.1", "original_categoria": "VDG_A", "label_count": "1", "user_id": "7", "added_by_username": "ana", "added_at": "2026"}
    assert got["f2"]["metadata"]["corrected_categoria"] == "VDG_B" and '"justificacion": "Revisado por humano"' in got["f2"]["text"] and got["f2"]["text"].startswith('TEXTO: "otro texto"')
    now = {r["id"]: (r["indexed"], r["chromadb_id"]) for r in store.marked(f, pushed).collect()}
    assert now == {1: ("true", "feedback_1"), 2: ("true", "f2"), 3: ("false", None), 4: ("true", "f4"), 5: ("false", None), 6: ("false", None)}
    assert store.corrections(store.marked(f, pushed), a, t, u).count() == 0
    c = store.Collection(spark, f"{tmp_path}/c", letters, parts=2)
    c.add(pushed)
    q = spark.createDataFrame([(1, "otro texto")], "query_id int, text string")
    assert c.search(q, 3, {"source": "human_feedback"}).count() == 2
    c.delete("f2")
    assert [r["id"] for r in c.search(q, 3).collect()] == ["feedback_1"]


@pytest.mark.parametrize("name", ["u1_embedded_documents", "k10_vectors_to_ask", "m5_pending_corrections", "k4_correction_search"])
def test_against_sql(spark, name):
    from .test_operators import same_as_sql

    same_as_sql(spark, name)


def test_a_provider_is_asked_for_some_texts_at_a_time(spark):
    def few(texts):
        if len(texts) > store.ASKED:
            raise ValueError(len(texts))
        return letters(texts)

    rows = spark.range(5 * store.ASKED).selectExpr("concat('texto ', id) as text").coalesce(1)
    assert store.embedded(rows, few).where("embedding is not null").count() == 5 * store.ASKED
