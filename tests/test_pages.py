"""Posts and comments of pages, embedded JSON, nested loads."""

import json

import pytest
from pyspark.sql import functions as F

from tamiz.operators import loads
from tamiz.sources import elements as E
from tamiz.sources import html


def pages(spark, *texts):
    return spark.createDataFrame([(i, f"https://x/{i}#a", t) for i, t in enumerate(texts)], "page_id int, url string, html string")


ARTICLE = """<html><body><div><div aria-label="Publicación de Ana María"><h3><a href="#"></a><a href="/ana">Ana <i>M.</i></a></h3> 3 h <p>Hola a todas las personas</p><time datetime="2026-01-02">ayer</time>
<span>12 reacciones</span> 4 comentarios 5 veces compartido<ul><li data-testid="UFI2Comment/x"><a href="/luis">Luis</a> Me parece bien 7 Me gusta</li></ul></div></div>
<div><div aria-label="publicacion de &quot;Eva&quot;"><p>Segunda nota que es distinta</p></div><section><p data-testid="comment-2">Otra cosa que decir</p></section></div><p data-testid="comment-3">abcd</p><p data-testid="comment">Lejos de todo</p></body></html>"""


def test_posts_and_comments(spark):
    found = E.elements(pages(spark, ARTICLE, None, "", "<p>nada"))
    posts = E.posts_in(found).orderBy("post_idx").collect()
    assert [(p["author"], p["date"], p["likes"], p["comments_count"], p["shares"], p["url"]) for p in posts] == [("Ana María", "2026-01-02", 12, 4, 5, "https://x/0#a#post_0"), ("Unknown", "", 0, 0, 0, "https://x/0#a#post_1")]
    assert "Hola a todas" in posts[0]["text"] and posts[1]["text"] == "Segunda nota que es distinta"
    comments = E.comments_in(found)
    assert sorted((c["comment_idx"], c["author"], c["likes"], c["text"]) for c in comments.collect()) == [(0, "Luis", 7, "Luis Me parece bien 7 Me gusta"), (1, "Unknown", 0, "Otra cosa que decir"), (3, "Unknown", 0, "Lejos de todo")]
    near = E.nearest(comments, E.posts_in(found))
    assert sorted((c["comment_idx"], c["post_idx"]) for c in near.collect()) == [(0, 0), (1, 1), (3, 0)]


def test_the_first_selector_that_finds_any_counts(spark):
    texts = ['<div role="article">corto</div><div data-pagelet="f">texto bastante largo</div>', '<div class="a userContent">texto bastante largo</div><div role="article">otro texto bastante largo</div>', '<div role="article">texto bastante largo</div><div role="article"> texto  bastante largo</div><p>Responder <b>a ti</b></p>']
    found = E.elements(pages(spark, *texts))
    assert sorted((p["page_id"], p["post_idx"], p["text"], p["url"]) for p in E.posts_in(found).collect()) == [(0, 0, "texto bastante largo", "https://x/0#a#post_0"), (1, 0, "texto bastante largo", "https://x/1#a#post_0"), (2, 0, "texto bastante largo", "https://x/2#a#post_0")]
    assert [(c["page_id"], c["text"]) for c in E.comments_in(found).collect()] == [(2, "Responder a ti")]


def brute_nearest(tree_posts, tree_comments):
    """Steps through the first common ancestor, the first post of equally near ones."""
    def steps(p, c):
        return next((i + j for i, x in enumerate(reversed(p)) for j, y in enumerate(reversed(c)) if x == y), float("inf"))

    return {k: min(range(len(tree_posts)), key=lambda i: (steps(tree_posts[i], c), i)) for k, c in tree_comments.items()}


def test_nearest_posts_equal_all_pairs(spark):
    import random

    rng = random.Random(5)
    for _ in range(3):
        paths = [[0]]
        for k in range(1, 60):
            paths.append([*rng.choice(paths[-12:]), k])
        rng.shuffle(paths)
        posts, comments = paths[:15], dict(enumerate(paths[15:]))
        comments[99] = [1000]
        p = spark.createDataFrame([(1, i, x) for i, x in enumerate(posts)], "page_id int, post_idx int, path array<int>")
        c = spark.createDataFrame([(1, k, x) for k, x in comments.items()] + [(2, 0, [0])], "page_id int, comment_idx int, path array<int>")
        assert {r["comment_idx"]: r["post_idx"] for r in E.nearest(c, p).collect()} == brute_nearest(posts, comments)


def script(node, tail=""):
    return f'<p>5" {{ </p><script>{json.dumps(node, ensure_ascii=False)}{tail}</script>'


NODE = {"brace": "}{\\\"", "owner": {"name": 'Eva "la {mayor}"'}, "message": {"text": "Un texto con } y \"comillas\" é"}, "creation_time": 1700000000, "feedback": {"id": "f9", "total_comment_count": 8}}


def test_embedded_posts(spark):
    twice = script({"a": [NODE, {**NODE, "post_id": "77"}]})
    other = script({"x": {"actor": {"name": "Actriz"}, "message": {"text": "otro texto largo"}, "publish_time": 0, "video_id": "v1"}})
    cut = script(NODE)[:-60]
    short = script({"message": {"text": "corto"}})
    bare = json.dumps({**NODE, "message": {"text": "fuera de un script \\u00e9"}})
    rows = E.embedded_posts(pages(spark, twice, other, cut, short, None, bare)).orderBy("page_id").collect()
    got = [(r["page_id"], r["post_idx"], r["text"], r["author"], r["date"], r["comments_count"], r["post_id"], r["url"]) for r in rows]
    assert got == [(0, 0, "Un texto con } y \"comillas\" é", 'Eva "la {mayor}"', "2023-11-14T22:13:20+00:00", 8, "f9", "https://x/0#post_f9"), (1, 0, "otro texto largo", "Actriz", "", 0, "v1", "https://x/1#post_v1"),
                   (5, 0, "fuera de un script \\u00e9", 'Eva "la {mayor}"', "2023-11-14T22:13:20+00:00", 8, "f9", "https://x/5#post_f9")]


def test_objects_around_places():
    text = '{"a": "\\\\", "b": {"c": "}\\"{", "d": [{"e": 1}, {"f": "x"}]}, "g": {"h": 2}'
    at = [text.index(k) for k in ('"c"', '"e"', '"f"', '"d"', '"a"', '"h"')]
    inner = '{"c": "}\\"{", "d": [{"e": 1}, {"f": "x"}]}'
    assert [x and text[x[0]:x[1]] for x in E.around(text, at)] == [inner, '{"e": 1}', '{"f": "x"}', inner, None, '{"h": 2}']
    assert E.around(text, [text.index('"f"')], far=1) == [(text.index('{"f"'), text.index('{"f"') + 10)] and E.around("", [0]) == [None]
    assert E.around("{" + "x" * 50 + "}", [40], far=20) == [None]


def test_strategies_in_order(spark):
    p = pages(spark, '<div role="article">texto bastante largo</div>' + script(NODE), script(NODE), "<p>nada</p>")
    got = E.posts_by(p, E.dom_posts, E.embedded_posts)
    assert sorted((r["page_id"], r["strategy"]) for r in got.collect()) == [(0, "dom_posts"), (1, "embedded_posts")]


def test_hierarchy_as_text(spark):
    h = E.hierarchy(pages(spark, "<title>T</title>" + ARTICLE, "<title>U</title>")).orderBy("page_id")
    first, second = h.select(E.hierarchy_text()).collect()
    assert first[0].startswith("PÁGINA: T\nURL: https://x/0#a\n" + "=" * 50 + "\n\nPUBLICACIÓN 1:\nAutor: Ana María\nFecha: 2026-01-02\nLikes: 12\nComentarios: 4\nCompartidos: 5\n" + "-" * 40 + "\nTexto:\n")
    assert "\n\n  COMENTARIOS (2):\n    1. Luis: Luis Me parece bien 7 Me gusta...\n      Likes: 7, Fecha: \n    2. Unknown: Lejos de todo..." in first[0] and "\n\nPUBLICACIÓN 2:" in first[0]
    assert second[0] == "PÁGINA: U\nURL: https://x/1#a\n" + "=" * 50


def test_reduced_pages(spark):
    meta = '<meta property="og:title" content="T"><meta name="x"><link rel="stylesheet" href="s"><link rel="icon" href="i">'
    small, big = "<p>x</p>", f"<head>{meta}<script>{'s' * 60}</script><style>y</style></head><body>{'b' * 30}</body>"
    got = [r[0] for r in pages(spark, small, big, big + "z" * 200, None).orderBy("page_id").select(html.reduced("html", 40)).collect()]
    assert got[0] == small and got[3] is None
    assert got[1] == f"<body>{'b' * 30}</body>"[:40] + "... [TRUNCATED]" and got[2] == got[1]
    whole = [r[0] for r in pages(spark, big).select(html.reduced("html", 120)).collect()][0]
    assert whole == f"<body>{'b' * 30}</body>"
    assert pages(spark, big).select(html.reduced("html", 40, None)).first()[0] == f"<head>{meta}</head><body>{'b' * 30}</body>"


# Nested loads

LONG = "esta es una frase bastante larga que sigue y sigue"


def nested(spark, rows):
    return spark.createDataFrame(rows, loads.NESTED)


def post(pid, text, comments=(), **more):
    return {"id": pid, "text": text, "author": "Ana", "date": None, "likes": None, "shares": None, "url": None, "comments": list(comments), **more}


def comment(cid, text, author="Luis", likes="0"):
    return {"id": cid, "text": text, "author": author, "date": "2026-01-02T03:04:05Z", "likes": likes, "created_at": None, "url": "u"}


def page(pid, posts):
    return (pid, "u", "T", 5, None, None, None, posts)


def stored(s):
    p = sorted((r["id"], r["posts_extracted"], r["comments_extracted"]) for r in s.pages.read().collect())
    return p, sorted((r["id"], r["page_id"], r["comments_count"]) for r in s.posts.read().collect()), sorted((r["id"], r["post_id"], r["text"]) for r in s.comments.read().collect())


def test_loading_twice_gives_the_same(spark, tmp_path):
    one = page("g", [post("a", "x", [comment("c1", LONG), comment(None, LONG + " 17 min", likes="3"), comment(None, "otra"), comment(None, "otra", "Eva")], likes="7", date="2026-01-02T03:04:05"), post("a", "y"), post(None, "z", [comment("", None)])])
    s = loads.PageStore(spark, str(tmp_path), parts=3)
    s.load(nested(spark, [one, page("h", None), page(None, [post("q", "q")])]))
    first = stored(s)
    assert first == ([("g", 3, 4), ("h", 0, 0)], [("a", "g", 3), ("g_p1", "g", 0), ("g_p2", "g", 1)], [("a_c0", "a", LONG + " 17 min"), ("a_c1", "a", "otra"), ("a_c2", "a", "otra"), ("g_p2_c0", "g_p2", "")])
    a = s.posts.read().where("id = 'a'").first()
    assert (a["author"], a["likes"], str(a["date"]), a["source"]) == ("", 7, "2026-01-02 03:04:05", "facebook_page")
    assert all("Ana" not in r["preprocessed_data"] and "Luis" not in r["preprocessed_data"] for r in s.pages.read().collect()) and {r["author"] for r in s.comments.read().collect()} == {""}
    s.load(nested(spark, [one, page("h", None)]))
    assert stored(s) == first
    s.load(nested(spark, [page("g", [post("b", "x")])]))
    assert stored(s) == ([("g", 1, 0), ("h", 0, 0)], [("b", "g", 0)], [])


def test_saved_comments(spark):
    now = spark.createDataFrame([("c1", "viejo", 1, "p"), ("c9", "queda", 2, "p")], "id string, text string, likes int, post_id string")
    batch = spark.createDataFrame([("c1", LONG, "Ana", "p", 5, None, 0), ("c2", LONG + " 17 min", "Ana", "p", 1, None, 1), ("c3", "distinta", "Ana", "p", None, None, 2)], "id string, text string, author string, post_id string, likes int, created_at string, pos int")
    got = loads.saved_comments(now, batch)
    assert sorted(map(tuple, got.collect())) == [("c1", "viejo", 1, "p"), ("c2", LONG + " 17 min", 1, "p"), ("c3", "distinta", None, "p"), ("c9", "queda", 2, "p")]


def test_comment_lists(spark):
    item = {"text": "Ana Pérez Me parece bien 18 sem Me gusta Responder 3", "author": "Ana Pérez", "date": "2026-01-02", "likes": "4", "url": "u"}
    replies = [json.dumps([item, "no object", {"content": "hola que tal", "likes": None}]), json.dumps({"comments": item}), "{'comment': [{'text': 'hola', 'likes': 2, 'responses': 5},]}", "no json", None, "[]", "{}"]
    df = spark.createDataFrame([(f"p{i}", r) for i, r in enumerate(replies)], "post_id string, reply string")
    got = {(r["post_id"], r["idx"]): r for r in loads.comment_lists(df).collect()}
    assert set(got) == {("p0", 0), ("p0", 2), ("p1", 0), ("p2", 0)}
    a = got["p0", 0]
    assert (a["text"], a["author"], str(a["date"]), a["likes"], a["responses"], a["time_ago"], len(a["id"])) == ("Me parece bien", "Ana Pérez", "2026-01-02 00:00:00", 4, 3, "18 sem", 16)
    assert got["p0", 2]["likes"] == 0 and got["p2", 0]["responses"] == 5 and a["id"] == got["p1", 0]["id"]
    assert {(r["post_id"], r["idx"]) for r in loads.comment_lists(df, most=1, shortest=5).collect()} == {("p0", 0), ("p1", 0)}


@pytest.mark.parametrize("name", ["x27_posts_of_pages", "x30_nearest_posts", "m13_page_hierarchies", "s6_embedded_posts", "x26_json_fields", "r20_page_load", "r20_loaded_comments", "r21_saved_comments", "d2_duplicate_comments", "m14_comment_lists"])
def test_against_sql(spark, name):
    from .test_operators import same_as_sql

    same_as_sql(spark, name)


def test_embedded_posts_carry_no_page(spark):
    """Counts are those of what follows a message within FAR characters, as reading that part of the page gives them; a page does not go beside each of its messages."""
    import re

    node = lambda i, more: '{"message": {"text": "Nota numero %d de prueba"}, %s "x": 1}' % (i, more)
    stated = ['"feedback": {"total_comment_count" : 12},', '"comment_count":3,', '"feedback": {"total_comment_count": 0}, "comment_count": 7,', '"comment_count": 99999999999999999999,', ""]
    html = "".join(f"<script>{node(i, stated[i % 5])}</script>" for i in range(40)) + "ñ" * (E.FAR - 60) + "<script>" + node(41, "") + '"comment_count": 4567</script>'
    for m in E.messages_in(html):
        part = html[m["at"]:m["at"] + E.FAR]
        scope = part.find(E.SCOPE)
        total = re.search(r'"total_comment_count"\s*:\s*(\d+)', part[scope + len(E.SCOPE):], re.ASCII) if scope >= 0 else None
        count = re.search(r'"comment_count"\s*:\s*(\d+)', part, re.ASCII)
        assert (m["total"], m["count"]) == (total and total[1], count and count[1])
    rows = E.embedded_posts(spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string"))
    assert "html" not in rows._jdf.queryExecution().optimizedPlan().toString().split("Generate")[0]
    assert [r["comments_count"] for r in rows.orderBy("post_idx").collect()][:4] == [12, 3, 7, 12]


def test_elements_leave_a_page_bit_by_bit(spark):
    n = 2 * E.ROWS + 7
    html = '<body onload="x"><div role="article">' + "".join(f'<p data-testid="comment" id="{i}">texto {i}</p>' for i in range(n)) + "</div></body>"
    assert next(E.elements_in(html))["kind"] == "post"  # rows are made as they are taken
    t = E._Tree()
    t.feed(html)
    assert set().union(*t.attrs) <= E.READ
    found = E.elements(spark.createDataFrame([(1, "u", html), (2, None, None), (None, "v", html)], "page_id int, url string, html string"))
    got = [(r["page_id"], r["url"], r["idx"], r["text"]) for r in found.where("kind = 'comment'").collect()]
    assert sorted(map(str, got)) == sorted(str((p, u, i, f"texto {i}")) for p, u in ((1, "u"), (None, "v")) for i in range(n))
