"""Text, exclusion, label and address functions on hand-made rows."""

from pyspark.sql import functions as F

from tamiz.functions import exclusion, labels, text, urls
from tamiz.operators.classify import keyword_labels
from tamiz.sources import html


def values(spark, rows, make, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, t {kind}")
    return [r[0] for r in df.orderBy("i").select(make(F.col("t"))).collect()]


def test_clean_post(spark):
    rows = [None, "", "Facebook Facebook Hola mundo", "t 0 6 8 5 · Buenos días a todos", "Texto … Ver más", "hola hola mundo mundo", "fin de la nota a b c d e f 1 2"]
    assert values(spark, rows, text.clean_post) == ["", "", "Hola mundo", "Buenos días a todos", "Texto", "hola mundo mundo", "fin de la nota"]
    twice = "Esta es la primera frase de la nota. Sigue así por mucho rato. Esta es la primera frase de la nota. Sigue así por mucho rato. Y acaba con esto otro."
    once = values(spark, [twice], text.clean_post)
    assert once == ["Esta es la primera frase de la nota. Sigue así por mucho rato. Y acaba con esto otro."]
    assert values(spark, once, text.clean_post) == once


def test_long_text_ends(spark):
    assert values(spark, ["a " * 20 + "palabra " * 30_000], lambda c: F.length(text.clean_post(c)))[0] > 0


def test_clean_comment(spark):
    rows = ["Ana Pérez Me parece bien 18 sem Me gusta Responder 3", "Hola 5 e gusta", None]
    got = values(spark, rows, text.clean_comment)
    assert (got[0]["body"], got[0]["time_ago"], got[0]["responses"]) == ("parece bien", "18 sem", 3)
    assert got[1]["body"] == "" or got[1]["body"] == "Hola"
    assert tuple(got[2]) == ("", None, 0)
    known = spark.createDataFrame([("Ana Pérez Me parece bien", "Ana Pérez")], "t string, a string").select(text.clean_comment("t", "a")["body"]).first()[0]
    assert known == "Me parece bien"


def test_small_values(spark):
    assert values(spark, ["2026-01-02", "02/01/2026", "2026-01-02T03:04:05", "x", None], lambda c: text.parsed_date(c).cast("string")) == ["2026-01-02 00:00:00", "2026-01-02 00:00:00", "2026-01-02 03:04:05", None, None]
    assert values(spark, ["7", "-7", "x", None], text.as_count) == [7, 0, 0, 0]
    assert values(spark, ['["a","","b"]', "a, b,,", "", None], text.as_markers) == [["a", "b"], ["a", "b"], [], []]
    assert values(spark, [" Sí ", "0", None], text.as_truth) == [True, False, False]
    assert values(spark, ["2026-03-04T05:06:07Z", "ayer", None], text.month_of) == ["2026-03", "Sin fecha", "Sin fecha"]
    assert values(spark, ["## Hola\n**mundo** [aquí](x)\n```\n**x**\n```"], text.plain_markdown) == ["Hola\nmundo aquí\n**x**"]


def test_exclusion(spark):
    rows = [None, "  ", "zzzz", "https://a.b/c", "mira https://a.b/c", "@ana @luis", "hola @ana", "!!! ...", "aaa bien", "JAJAJA!!", "Ok.", "qué", "Un comentario normal"]
    assert values(spark, rows, exclusion.exclusion_code) == ["COND_1_NA", "COND_1_VACIO", "COND_3_RUIDO_TIPOGRAFICO", "COND_2_ENLACE_HUERFANO", None, "COND_6_TAG_PERSONA", None, "COND_3_RUIDO_TIPOGRAFICO",
                                                             "COND_3_RUIDO_TIPOGRAFICO", "COND_4_SOLO_RISA", "COND_5_REACCION_CORTA", "COND_5_REACCION_CORTA", None]
    assert values(spark, ["qué IMBÉCIL", "imbécil y feminazi", "hola", None], exclusion.common_violence) == ["VIOLENCIA_COMUN", None, None, None]


def test_labels(spark):
    assert values(spark, ["violencia-simbólica", "VIOLENCIA_COMUN", "", None, "...", "otra cosa"], labels.category) == ["VDG_VIOLENCIA_SIMBOLICA", "VIOLENCIA_COMUN", "ninguna", "ninguna", "VDG_VIOLENCIA_SIMBOLICA", "ninguna"]
    assert values(spark, ["Baja-Media", "extrema", "x", None], labels.severity) == ["baja", "alta", "ninguna", "ninguna"]
    kind = "array<struct<categoria:string,dimension:string,severidad:string,marcadores:array<string>>>"
    one = lambda c, d, s, m=(): (c, d, s, list(m))
    got = values(spark, [[one("VDG_VIOLENCIA_SIMBOLICA", "1.1", "baja"), one("VDG_MANOSFERA_ANTIFEMINISMO", "4.1", "alta", ["a"]), one("VDG_VIOLENCIA_SIMBOLICA", "1.1", "media"), one("ninguna", None, "alta"),
                          one("VDG_MANOSFERA_ANTIFEMINISMO", "4.1", "alta", ["b"])], [], None], labels.valid_labels, kind)
    assert [(x["categoria"][:8], x["severidad"], x["marcadores"]) for x in got[0]] == [("VDG_MANO", "alta", ["a"]), ("VDG_MANO", "alta", ["b"]), ("VDG_VIOL", "media", [])]
    assert got[1] == [] and got[2] == []


def test_keywords(spark):
    got = values(spark, ["te voy a MATAR", "a la cocina", "a la cocina, activista", None], keyword_labels)
    assert [(x["dimension"], x["severidad"]) for x in got[0]] == [("3.2", "alta"), ("3.1", "media")]
    assert got[1] == [] and got[2][0]["dimension"] == "5.2" and got[3] == []


def test_urls_and_pages(spark):
    rows = ["https://www.facebook.com/pag", "https://facebook.com/groups/x", "https://m.facebook.com/p/posts/12", "https://notfacebook.com/p", "https://facebook.com/", None]
    assert values(spark, rows, urls.url_class) == ["page", "group", "post", "unknown", "unknown", "unknown"]
    assert values(spark, ['<input name="email"><input name="pass">', "x", None], urls.is_login_wall) == [True, False, False]
    page = spark.createDataFrame([(1, "u", "<html><title> T </title><body><p>Uno <b>dos</b></p><script>x</script><li>tres<p>cuatro</li></body>")], "page_id int, url string, html string")
    assert [(r["tag"], r["text"]) for r in html.blocks(page).orderBy("idx").collect()] == [("p", "Uno dos"), ("p", "cuatro"), ("li", "tres")]
    assert html.page_metadata(page).first()["title"] == "T"
    assert values(spark, ["1/2/3"], lambda c: html.tree_distance(c, F.lit("1/2/4/1"))) == [3]
