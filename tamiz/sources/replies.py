"""SQL of made model replies over documents, in the shapes that real ones come in; Spark and a plain SQL engine read it alike."""

from __future__ import annotations


def _label(cat: str, dim: str, sev: str, more: str) -> str:
    return f"""concat('{{"categoria": "', {cat}, '", "dimension": ', case when {dim} is null then 'null' else concat('"', {dim}, '"') end, ', "severidad": "', {sev}, '", "justificacion": "j', cast(n_chars as string), '"', {more}, '}}')"""


def reply_sql(category: str, second: str, dims: str, sev: str) -> str:
    """id, content_id and reply of every document: lists of labels plain, fenced and among thoughts and prose, one label, truncated,
    prose, nothing, common violence alone and in a list, single quotes, a Python literal, no object, an exclusion, and none at all."""
    one = _label("cat", "dim", "sev", """', "confianza": 0.', cast(doc_id % 9 + 1 as string), ', "marcadores_detectados": ["m', cast(n_chars % 3 as string), '", ""]'""")
    two = _label("cat2", "dim2", "sev2", """', "marcadores_detectados": "b,  a"'""")
    three = _label("cat", "dim", "'alta-extrema'", """', "confianza": "0.5", "marcadores_detectados": ["m', cast(n_chars % 3 as string), '"], "es_falso_positivo_probable": "sí"'""")
    several = f"""concat('{{"tiene_violencia": ', case n_chars % 4 when 0 then 'false' when 1 then '"Si"' else 'true' end, ', "clasificaciones": [', {one}, ', ', {two}, ', 7, ', {three}, ']}}')"""
    shapes = [
        several,
        f"concat('```json', chr(10), {several}, chr(10), '```')",
        f"""concat('<think>maybe {{"a": 1}} then</think> Answer: ', {several}, ' Done.')""",
        one,
        f"""concat('{{"clasificaciones": [', {one}, ', {{"categoria": "')""",
        "'no sé qué decir'",
        "'<think>nothing</think>'",
        """'{"categoria": " violencia_comun ", "justificacion": "pelea", "codigo": "VC_1"}'""",
        f"""concat('{{"clasificaciones": [', {two}, ', {{"categoria": "VIOLENCIA_COMUN", "severidad": "alta", "regla_disparada": "R9"}}]}}')""",
        f"replace({several}, '\"', chr(39))",
        f"""replace(replace(concat('{{"tiene_violencia": True, "clasificaciones": [', {two}, ',], }}'), '"', chr(39)), 'null', 'None')""",
        "'[1, 2]'",
        """concat('{"categoria": "ninguna", "severidad_global": "media", "exclusion_label": "CODIGO_99", "exclusion_codigo": "X', cast(n_chars % 3 as string), '"}')""",
    ]
    pick = " ".join(f"when {i} then {shape}" for i, shape in enumerate(shapes))
    return f"""select doc_id as id, concat('d', doc_id) as content_id, case doc_id % {len(shapes) + 1} {pick} end as reply
        from (select *, {dims.format(c='cat')} as dim, {dims.format(c='cat2')} as dim2
        from (select doc_id, n_chars, {category} as cat, {second} as cat2, {sev.format(x='n_chars')} as sev, {sev.format(x='(n_chars + 1)')} as sev2 from documents) as q) as r"""
