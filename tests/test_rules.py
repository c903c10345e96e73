"""The taxonomy's front matter, glossaries, patterns and buckets, and operators that go by them."""

import pytest

from tamiz.functions import exclusion
from tamiz.functions.vocabulary import CATEGORIES
from tamiz.operators import classify
from tamiz.sources import rules

from .test_functions import values


def markdown(categories=CATEGORIES, more=""):
    rows = []
    for i, (code, label, severity, dims) in enumerate(categories, 1):
        rows += [f"  - code: {code}", f'    label: "{label}"', f"    orden: {i}", f"    gravedad: {severity}", "    subdimensiones:"]
        for d, text in dims:
            rows += [f'      - code: "{d}"', f"        descripcion: '{text}'"]
    return "---\nversion: \"2.1\"\n\ncategorias:\n" + "\n".join(rows) + f"\n{more}\n---\n\n# Texto\ncategorias: no\n"


EXCLUDED = "\ncategorias_exclusion:\n  - code: EXC_X\n    codigo_canonico: CODIGO_99\n    descripcion: x\n\nleetspeak_global:\n  a: 4\n  b: \"8\""


def test_front_matter():
    got = rules.front_matter('---\na: 1\nb: "x: y"\nc:\n  - k: v\n    l:\n      - m: 2.5\n        n: z\n      - m: q\n  - k: w\nd:\n  e: f\n---\nbody')
    assert got == {"a": 1, "b": "x: y", "c": [{"k": "v", "l": [{"m": 2.5, "n": "z"}, {"m": "q"}]}, {"k": "w"}], "d": {"e": "f"}}


@pytest.mark.parametrize("text", ["", "a: 1", "---\n---\n", "---\n\n---", "---\nsin dos puntos\n---", "---\na:\n---", "---\na:\nb: 1\n---", "---\n  a: 1\n---", "---\na: 1\n  b: 2\n---", "---\na:\n  - b: 1\n c: 2\n---", "---\n- a: 1\n---"])
def test_front_matter_that_is_none(text):
    with pytest.raises(rules.FormatError):
        rules.front_matter(text)


def test_taxonomy(spark, tmp_path):
    (tmp_path / "t.md").write_text(markdown(more=EXCLUDED))
    t = rules.taxonomy(spark, str(tmp_path / "t.md"))
    assert [(r["categoria"], r["orden"], r["label"], r["gravedad"], r["dimensiones"]) for r in rules.category_views(t.dimensions).collect()] == [(c, i, label, g, [d for d, _ in ds]) for i, (c, label, g, ds) in enumerate(CATEGORIES, 1)]
    assert [tuple(r) for r in t.exclusions.collect()] == [("EXC_X", "CODIGO_99", "x")]
    assert rules.misaligned(t.dimensions).count() == 0
    assert rules.misaligned(t.dimensions.where("dimension <> '4.4'")).collect()[0]["side"] == "missing"
    (tmp_path / "u.md").write_text("x")
    with pytest.raises(rules.FormatError):
        rules.taxonomy(spark, str(tmp_path / "*.md"))


@pytest.mark.parametrize("change, said", [
    (lambda c: c[:5], "5 categories, not 6"),
    (lambda c: [c[1], c[0], *c[2:]], "sub-dimensions are 2.1,2.2,2.3"),
    (lambda c: [("X_1", *c[0][1:]), *c[1:]], "a code starts with VDG_"),
    (lambda c: [(*c[0][:2], "grave", c[0][3]), *c[1:]], "unknown severity grave"),
    (lambda c: [(*c[0][:3], c[0][3][:2]), *c[1:]], "sub-dimensions are 1.1,1.2"),
    (lambda c: [(*c[0][:3], [("1.1", "a"), ("1.1", "b"), ("1.3", "c")]), *c[1:]], "1.1: twice"),
    (lambda c: [(*c[0][:3], [("1.1", ""), *c[0][3][1:]]), *c[1:]], "1.1: no description"),
    (lambda c: [*c[:4], c[3], c[5]], "twice"),
])
def test_taxonomies_that_are_not_valid(spark, change, said):
    with pytest.raises(ValueError, match=said):
        rules.taxonomy_of(spark, markdown(change(CATEGORIES)))


def test_exclusions_that_are_not_valid(spark):
    for bad, said in (("  - code: NO\n    codigo_canonico: A", "starts with EXC_"), ("  - code: EXC_A\n    codigo_canonico: 'a b'", "no canonical code"), ("  - code: EXC_A\n    codigo_canonico: A\n  - code: EXC_A\n    codigo_canonico: B", "EXC_A: twice"),
                      ("  - code: EXC_A\n    codigo_canonico: A\n  - code: EXC_B\n    codigo_canonico: A", "A: twice")):
        with pytest.raises(ValueError, match=said):
            rules.taxonomy_of(spark, markdown(more=f"\ncategorias_exclusion:\n{bad}"))


def documents(spark, **texts):
    return spark.createDataFrame(list(texts.items()), "path string, content string")


def test_glossaries(spark):
    docs = documents(spark, a="# A\n```plain\n`Uno`\n\n# no\n uno \nDOS tres\n```\n```\nfuera\n```", b="sin bloque", c="```\n\n```", d=None)
    assert sorted(map(tuple, rules.glossary(docs).collect())) == [("a", "dos tres"), ("a", "uno")]
    assert rules.words_of(rules.glossary(docs)) == ["dos tres", "uno"]
    with pytest.raises(ValueError):
        rules.words_of(rules.glossary(docs), most=1)


def test_a_changed_glossary_changes_the_cascade(spark):
    rows = ["jajaja", "guau guau", "nada de nada", "ok"]
    assert values(spark, rows, exclusion.exclusion_code) == ["COND_4_SOLO_RISA", None, None, "COND_5_REACCION_CORTA"]
    docs = documents(spark, g="```plain\n^(guau ?)+$ # COND_5_REACCION_CORTA\n(rota # COND_4_SOLO_RISA\nnada.* # OTRA\n^ok|jajaja$\n```")
    found = rules.usable_patterns(rules.patterns(docs))
    assert found == [("^(guau ?)+$", "COND_5_REACCION_CORTA"), ("nada.*", "COND_4_SOLO_RISA"), ("^ok|jajaja$", "COND_4_SOLO_RISA")]
    assert values(spark, rows, lambda c: exclusion.exclusion_code(c, found)) == ["COND_4_SOLO_RISA", "COND_5_REACCION_CORTA", "COND_4_SOLO_RISA", "COND_4_SOLO_RISA"]
    assert values(spark, rows, lambda c: exclusion.exclusion_code(c, [])) == [None] * 4
    assert values(spark, ["un perro", "un perro azul", "idiota"], lambda c: exclusion.common_violence(c, ["perro"], ["azul"])) == ["VIOLENCIA_COMUN", None, None]


BUCKETS = "pos int, name string, categoria string, dimension string, severidad string, score int, words array<string>, context array<string>"


def test_changed_buckets_change_the_labels(spark):
    dims = spark.createDataFrame([("C", "1.1"), ("D", "2.1")], "categoria string, dimension string")
    table = spark.createDataFrame([(2, "b", "D", "2.1", "alta", 3, ["Pérro"], ["azul"]), (1, "a", "C", "1.1", "baja", 1, ["gato", "perro"], None)], BUCKETS)
    buckets = rules.buckets_of(table, dims)
    assert [b[0] for b in buckets] == ["a", "b"]
    got = values(spark, ["un PERRO", "un perro azul", "una zorra", None], lambda c: classify.keyword_labels(c, buckets=buckets))
    assert [[(x["categoria"], x["marcadores"]) for x in g] for g in got] == [[("C", ["perro"])], [("D", ["Pérro"]), ("C", ["perro"])], [], []]
    labelled = classify.classify(spark.createDataFrame([("el perro come",)], "text string"), buckets=buckets).first()
    assert labelled["labels"][0]["regla_disparada"] == "rule-based:a"
    for bad in ((1, "x", "C", "2.1", "baja", 1, ["a"], None), (1, "x", "C", "1.1", "Baja", 1, ["a"], None), (1, "x", "C", "1.1", "baja", 1, [], None), (1, "x", None, None, "baja", 1, ["a"], None), (1, "x", "C", "1.1", None, 1, ["a"], None)):
        with pytest.raises(ValueError, match="x"):
            rules.buckets_of(spark.createDataFrame([bad], BUCKETS), dims)


def test_drift(spark):
    docs = documents(spark, a="`Calladita  té ves` → **1.2** y `otra` → 2.1, `nueva` → 3.3 y `Calladita te ves` →6.1", b=None)
    markers = spark.createDataFrame([("6.1", "calladita te ves"), ("2.2", "Otra")], "dimension string, marcador string")
    overlaps = spark.createDataFrame([("2.2", "ótra", "2.1")], "dimension string, marcador string, secundaria string")
    assert [tuple(r) for r in rules.drifted(docs, markers, overlaps).collect()] == [("a", "Calladita  té ves", "1.2", "6.1")]


@pytest.mark.parametrize("name", ["s10_glossary_tokens", "s10_glossary_patterns", "e6_scanned_patterns", "e8_scanned_words", "l7_scanned_buckets", "l16_marker_drift"])
def test_against_sql(spark, name):
    from .test_operators import same_as_sql

    same_as_sql(spark, name)
