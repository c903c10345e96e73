"""Stored replies, the model hook, batch analysis with write-back, and tables that change by partitions."""

import json
from collections.abc import Iterator

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tamiz.functions.labels import highest_severity
from tamiz.operators import analyse, classify, replies
from tamiz.sources.tables import Partitioned

ONE = {"categoria": "VDG_MANOSFERA_ANTIFEMINISMO", "dimension": "04.1", "severidad": "media-alta", "justificacion": " j ", "marcadores_detectados": "b, a", "confianza": "0.5", "score_ajuste": True, "es_falso_positivo_probable": 1}


def read(spark, texts, **options):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, r string")
    return [r.asDict(recursive=True) for r in replies.classifications(df, "r", **options).orderBy("i").collect()]


def test_every_ladder_step(spark):
    texts = ['{"a": "it\'s"}', "{'a': [1, true]}", r'{"a": "\_x\["}', "{'a': (1, None), 'b': True,}", "not json", "", None, " ", "null", "{'a': null, 'b': True}", "'x'"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = replies.repaired(df, "t").orderBy("i").select("json_step", F.col("json").cast("string"), "json_rescue").collect()
    assert [r[0] for r in got] == ["strict", "quotes", "escapes", "literal", "unread", None, None, None, "strict", "unread", "quotes"]
    assert [r[1] for r in got[:4]] == ['{"a":"it\'s"}', '{"a":[1,true]}', '{"a":"_x["}', '{"a":[1,null],"b":true}']
    assert [r[2] for r in got] == [None] * 4 + ["not json"] + [None] * 4 + ["{'a': null, 'b': True}", None]


def test_only_rows_that_failed_go_to_python(spark, monkeypatch):
    df = spark.createDataFrame([(str(i), '{"a": 1}' if i % 2 else "{'a': None}") for i in range(10)], "i string, t string")
    seen = spark.sparkContext.accumulator(0)

    def counted(text):
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for b in batches:
                seen.add(int(b.notna().sum()))
                yield b.map(replies.literal_json, na_action="ignore").astype(object)

        return F.pandas_udf(run, "string")(text)

    monkeypatch.setattr(replies, "literals", counted)
    assert replies.repaired(df, "t").where("json_step = 'literal'").count() == 5
    assert seen.value == 5


def test_replies_of_every_shape(spark):
    body = json.dumps({"tiene_violencia": "sí", "clasificaciones": [ONE, "no object", {**ONE, "severidad": "alta"}, {"categoria": "ninguna"}, {"categoria": "violencia simbolica", "dimension": "9.9"}]}, ensure_ascii=False)
    fenced = read(spark, [body, f"```json\n{body}\n```", f"<think>{{x}}</think>\n<b>Sure:</b> {body} bye"])
    assert all({k: v for k, v in r.items() if k not in ("i", "r")} == {k: v for k, v in fenced[0].items() if k not in ("i", "r")} for r in fenced)
    labels = fenced[0]["labels"]
    assert [(x["categoria"], x["dimension"], x["severidad"]) for x in labels] == [("VDG_MANOSFERA_ANTIFEMINISMO", "4.1", "alta"), ("VDG_VIOLENCIA_SIMBOLICA", None, "ninguna")]
    assert labels[0] == {"categoria": "VDG_MANOSFERA_ANTIFEMINISMO", "dimension": "4.1", "severidad": "alta", "marcadores": ["b", "a"], "justificacion": "j", "evidencia": "", "regla_disparada": None, "confianza": 0.5, "score_ajuste": None, "falso_positivo": True}
    assert fenced[0]["tiene_violencia"] is True and fenced[0]["severidad_global"] == "alta" and fenced[0]["error"] is None and fenced[0]["rescue"] is None


def test_single_labels_and_exclusions(spark):
    one, none, common, listed, given = read(spark, [
        json.dumps({**ONE, "tiene_violencia": 0}), '{"categoria": "ninguna", "severidad": "alta", "tiene_violencia": true}', '{"categoria": "violencia_comun"}',
        json.dumps({"clasificaciones": [{"categoria": "VIOLENCIA_COMUN", "regla_disparada": "R", "justificacion": "w"}, ONE]}), '{"clasificaciones": [], "exclusion_label": "CODIGO_99", "exclusion_codigo": "X", "severidad_global": "extrema"}'])
    assert one["labels"][0]["justificacion"] == " j " and one["tiene_violencia"] is False and one["severidad_global"] == "media"
    assert none["labels"] == [] and none["tiene_violencia"] is False and none["severidad_global"] == "ninguna"
    assert (common["exclusion_label"], common["exclusion_codigo"], common["exclusion_justificacion"], common["labels"]) == ("VIOLENCIA_COMUN", "VIOLENCIA_COMUN_LLM", replies.REASON, [])
    assert (listed["exclusion_label"], listed["exclusion_codigo"], listed["exclusion_justificacion"], listed["labels"], listed["severidad_global"]) == ("VIOLENCIA_COMUN", "R", "w", [], "ninguna")
    assert (given["exclusion_label"], given["exclusion_codigo"], given["severidad_global"], given["tiene_violencia"]) == ("CODIGO_99", "X", "alta", False)


def test_each_error_has_its_code_and_its_text(spark):
    texts = [None, "", "<think>x</think>", "{'categoria': 'x'}", "words", "[1]", "7", '{"a": 1, "a": 2}']
    got = read(spark, texts)
    assert [r["error"] for r in got] == ["no_reply", "empty_response_after_strip", "empty_response_after_strip", "invalid_json", "invalid_json", "not_an_object", "not_an_object", "invalid_json"]
    assert [r["rescue"] for r in got] == texts and all(r["labels"] == [] and r["tiene_violencia"] is False and r["exclusion_label"] is None for r in got)
    assert read(spark, ["{'categoria': 'Manosfera'}"], repair=True)[0]["labels"][0]["categoria"] == "VDG_MANOSFERA_ANTIFEMINISMO"
    assert read(spark, []) == []


def test_highest_severity(spark):
    df = spark.createDataFrame([(1, ["baja", "alta"]), (2, []), (3, None), (4, ["x", None, "media"])], "i int, s array<string>")
    assert [r[0] for r in df.orderBy("i").select(highest_severity("s")).collect()] == ["alta", "ninguna", "ninguna", "media"]


TEXTS = [(1, "una frase normal"), (2, "jajaja"), (3, ""), (4, None), (5, "https://a.b/c"), (6, "te voy a matar"), (7, "otra frase normal")]


def test_excluded_texts_reach_no_model(spark):
    seen = spark.sparkContext.accumulator(0)

    def model(texts: pd.Series) -> pd.Series:
        seen.add(len(texts))
        return texts.map(lambda t: json.dumps({"clasificaciones": [{**ONE, "evidencia": t}]}) if "una" in t else None)

    df = spark.createDataFrame(TEXTS, "i int, text string")
    got = {r["i"]: r for r in classify.classify(df, model).collect()}
    assert seen.value == 3
    assert got[1]["labels"][0]["evidencia"] == "una frase normal" and got[1]["error"] is None and got[1]["tiene_violencia"] == "true"
    assert got[2]["exclusion_codigo"] == "COND_4_SOLO_RISA" and got[2]["labels"] == [] and got[2]["error"] is None
    assert got[3]["exclusion_codigo"] is None and got[3]["labels"] == [] and got[3]["tiene_violencia"] == "false"
    assert got[6]["error"] == "no_reply" and [x["regla_disparada"] for x in got[6]["labels"]] == ["rule-based:amenaza_muerte", "rule-based:amenaza_general"] and got[6]["labels"][0]["confianza"] == 1.0


def test_a_model_that_fails_leaves_the_keywords(spark):
    def model(texts: pd.Series) -> pd.Series:
        raise ConnectionError("away")

    got = {r["i"]: r for r in classify.classify(spark.createDataFrame(TEXTS, "i int, text string"), model).collect()}
    assert [got[i]["error"] for i in (1, 2, 6)] == ["no_reply", None, "no_reply"] and len(got[6]["labels"]) == 2
    without = {r["i"]: r for r in classify.classify(spark.createDataFrame(TEXTS, "i int, text string")).collect()}
    assert without[6]["labels"] == got[6]["labels"] and without[6]["error"] is None


def content(spark, rows):
    return spark.createDataFrame(rows, "content_type string, content_id string, post_id string, comment_id string, text string, reply string")


def state(store):
    rows = sorted((r["content_type"], r["content_id"], r["categoria"], r["tiene_violencia"], r["exclusion_codigo"]) for r in store.rows.read().collect())
    return rows, sorted((r["content_id"], r["orden"], r["categoria"], r["severidad"]) for r in store.labels.read().collect())


def test_batches_are_written_back_once(spark, tmp_path):
    two = json.dumps({"clasificaciones": [ONE, {"categoria": "VDG_HOSTILIDAD_FEMINICIDIO", "severidad": "alta"}]})
    rows = [("post", "p1", "p1", None, "una frase normal", two), ("comment", "c1", "p1", "c1", "otra frase normal", "{broken"), ("comment", "c2", "p1", "c2", "te voy a matar", None), ("post", "p2", "p2", None, "jajaja", two), ("post", None, None, None, "sin id", two)]
    store = analyse.Analyses(spark, str(tmp_path), parts=4)
    counts = store.run(content(spark, rows), reply="reply", name="first")
    assert counts == {"posts_analyzed": 2, "comments_analyzed": 2, "violence_detected_posts": 1, "violence_detected_comments": 1, "errors": 2, "errors_model": 1, "errors_parse": 1, "errors_validation": 0}
    after = state(store)
    assert after[0] == [("comment", "c1", "ninguna", "false", None), ("comment", "c2", "VDG_HOSTILIDAD_FEMINICIDIO", "true", None), ("post", "p1", "VDG_HOSTILIDAD_FEMINICIDIO", "true", None), ("post", "p2", "ninguna", "false", "COND_4_SOLO_RISA")]
    assert after[1] == [("c2", 0, "VDG_HOSTILIDAD_FEMINICIDIO", "alta"), ("c2", 1, "VDG_HOSTILIDAD_FEMINICIDIO", "media"), ("p1", 0, "VDG_HOSTILIDAD_FEMINICIDIO", "alta"), ("p1", 1, "VDG_MANOSFERA_ANTIFEMINISMO", "media")]
    assert sorted(map(tuple, store.errors("first").collect())) == [("comment", "c1", "errors_parse", "invalid_json"), ("comment", "c2", "errors_model", "no_reply")]
    again = store.run(content(spark, rows), reply="reply", name="second")
    assert set(again.values()) == {0} and state(store) == after
    more = store.run(content(spark, [*rows, ("post", "p3", "p3", None, "hola a todas las personas", None)]), reply="reply", name="third")
    assert more["posts_analyzed"] == 1 and len(state(store)[0]) == 5 and state(store)[1] == after[1]
    # Everything again, with other replies: labels that are gone don't stay behind.
    whole = store.run(content(spark, [(*r[:5], '{"clasificaciones": []}') for r in rows]), reply="reply", again=True, name="fourth")
    assert whole["errors"] == 0 and state(store)[1] == [] and len(state(store)[0]) == 5


def test_content_is_cleaned(spark):
    posts = spark.createDataFrame([("p", "Texto … Ver más", "Ana")], "id string, text string, author string")
    comments = spark.createDataFrame([("c", "Ana Pérez Me parece bien 18 sem Me gusta Responder 3", "Ana Pérez", "p")], "id string, text string, author string, post_id string")
    got = {r["content_id"]: r for r in analyse.content_of(posts, comments).collect()}
    assert got["p"]["text"] == "Texto" and got["c"]["text"] == "Me parece bien" and got["c"]["post_id"] == "p" and got["c"]["comment_id"] == "c"


def test_partitioned_tables(spark, tmp_path):
    t = Partitioned(spark, f"{tmp_path}/t", "k int, v string, source string", "source")
    make = lambda rows: spark.createDataFrame(rows, "k int, v string, source string")
    held = lambda: sorted((r["k"], r["v"], r["source"] or "-") for r in t.read().collect())
    assert held() == []
    t.replace(make([(1, "a", "x"), (2, "b", "x"), (3, "c", "y é/="), (4, "d", None)]))
    t.upsert(make([(2, "B", "x"), (5, "e", "z")]), ["k"])
    assert held() == [(1, "a", "x"), (2, "B", "x"), (3, "c", "y é/="), (4, "d", "-"), (5, "e", "z")]
    t.delete(F.col("source") == "y é/=")
    t.delete(F.col("k") == 1)
    t.delete(F.col("k") == 99)
    assert held() == [(2, "B", "x"), (4, "d", "-"), (5, "e", "z")]
    t.delete(F.col("source").isNull())
    t.replace(make([]), ["z"])
    assert held() == [(2, "B", "x")]


@pytest.mark.parametrize("name", ["x24_repaired_json", "l6_parsed_replies", "l10_batch_analysis", "o2_batch_counts", "e9_exclusion_of_documents", "l9_classified_documents"])
def test_against_sql(spark, name):
    from .test_operators import same_as_sql

    same_as_sql(spark, name)
