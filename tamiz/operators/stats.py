"""The six descriptive rules: missing values, frequencies, modes, contingency tables, alerts, reliability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamiz.functions.vocabulary import ALL_DIMENSIONS, CODES, COMMON, DIMENSIONS, JUNK, NONE


def is_excluded() -> Column:
    return F.coalesce(F.col("exclusion_label").isin(JUNK, COMMON), F.lit(False))


def percent(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(100.0 * part, whole), F.lit(0.0))


def missing_values(analysis: DataFrame) -> DataFrame:
    """One row: counts and shares of junk and of common violence, and the alert level."""
    n = analysis.agg(F.count("*").alias("total"), F.count_if(F.col("exclusion_label") == JUNK).alias("n_basura"), F.count_if(F.col("exclusion_label") == COMMON).alias("n_comun"))
    p = n.withColumn("pct_basura", F.round(percent(F.col("n_basura"), F.col("total")), 2)).withColumn("pct_comun", F.round(percent(F.col("n_comun"), F.col("total")), 2))
    return p.withColumn("nivel", F.when(F.col("pct_basura") > 10, "critica").when(F.col("pct_basura") > 5, "preventiva").otherwise("ok"))


def missing_codes(analysis: DataFrame) -> DataFrame:
    return analysis.where(F.col("exclusion_label") == JUNK).groupBy(F.coalesce("exclusion_codigo", F.lit("SIN_CODIGO")).alias("codigo")).agg(F.count("*").alias("n"))


def votes(analysis: DataFrame, labels: DataFrame, keep_none: bool = False) -> DataFrame:
    """A row for each label of a violent row that isn't excluded; rows without labels vote with their own category.

    analysis(id, ...), labels(analysis_result_id, categoria, dimension): the labels join as rows, so that no list of
    them is built. All columns of analysis stay, but for categoria and dimension, which are the vote's.
    """
    rest = [c for c in analysis.columns if c not in ("categoria", "dimension")]
    valid = analysis.where((F.col("tiene_violencia") == "true") & ~is_excluded())
    ls = labels.select(F.col("analysis_result_id").alias("_k"), F.col("categoria").alias("_c"), F.col("dimension").alias("_d"))
    joined = valid.join(ls, F.col("id") == F.col("_k"), "left")
    own = F.col("_k").isNull()
    out = joined.select(*rest, F.coalesce(F.when(own, F.col("categoria")).otherwise(F.col("_c")), F.lit(NONE)).alias("categoria"),
                        F.when(own, F.col("dimension")).otherwise(F.col("_d")).alias("dimension"))
    return out if keep_none else out.where(F.col("categoria") != NONE)


def frequency(vote: DataFrame, universe: DataFrame, column: str) -> DataFrame:
    """Count, valid share and running share of every value of universe(value, pos), zeros too; most frequent first, then by position.

    The windows are over the universe's few rows, after grouping.
    """
    n = vote.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_v")).agg(F.count("*").alias("_n"))
    u = universe.join(n, F.col("value") == F.col("_v"), "left").select("value", "pos", F.coalesce("_n", F.lit(0)).cast("long").alias("n"))
    every, order = Window.partitionBy(), Window.orderBy(F.desc("n"), "pos")
    pct = percent(F.col("n"), F.sum("n").over(every))
    u = u.withColumn("_p", pct)
    return u.select("value", "n", F.round("_p", 2).alias("pct"), F.round(F.sum("_p").over(order.rowsBetween(Window.unboundedPreceding, 0)), 2).alias("pct_acumulado"),
                    F.row_number().over(order).alias("rango"))


def modes(vote: DataFrame, column: str) -> DataFrame:
    """All values of the highest frequency, and whether there are several."""
    n = vote.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("moda")).agg(F.count("*").alias("n"))
    top = n.withColumn("r", F.rank().over(Window.orderBy(F.desc("n")))).where("r = 1").drop("r")
    return top.withColumn("multimodal", F.count("*").over(Window.partitionBy()) > 1)


def grid(vote: DataFrame) -> DataFrame:
    """Category x sub-dimension, all cells, with the share of each cell in its column."""
    cells = vote.where(F.col("dimension").isNotNull()).groupBy(F.col("categoria").alias("_c"), F.col("dimension").alias("_d")).agg(F.count("*").alias("_n"))
    spark = vote.sparkSession
    frame = spark.createDataFrame([(c, d, i, j) for i, c in enumerate(CODES) for j, d in enumerate(ALL_DIMENSIONS)], "categoria string, dimension string, row_pos int, col_pos int")
    full = frame.join(cells, (F.col("categoria") == F.col("_c")) & (F.col("dimension") == F.col("_d")), "left")
    return with_column_share(full.select("categoria", "dimension", "row_pos", "col_pos", F.coalesce("_n", F.lit(0)).cast("long").alias("n")), "dimension")


def with_column_share(cells: DataFrame, column: str) -> DataFrame:
    return cells.withColumn("pct", percent(F.col("n"), F.sum("n").over(Window.partitionBy(column))))


def grid_pivot(vote: DataFrame) -> DataFrame:
    """The same as a table, one column for every sub-dimension."""
    wide = vote.where(F.col("dimension").isNotNull()).groupBy("categoria").pivot("dimension", ALL_DIMENSIONS).count().na.fill(0)
    return wide.select("categoria", *[F.col(f"`{d}`").alias("d" + d.replace(".", "_")) for d in ALL_DIMENSIONS])


def by_page(vote: DataFrame, posts: DataFrame, pages: DataFrame) -> DataFrame:
    """Category x page title: the title of the post's page, else its id, else a constant."""
    p = posts.select(F.col("id").alias("_p"), "page_id")
    t = pages.select(F.col("id").alias("_g"), "title")
    placed = vote.join(p, F.coalesce("post_id", "content_id") == F.col("_p"), "left").join(t, F.col("page_id") == F.col("_g"), "left")
    titled = placed.select("categoria", F.coalesce("title", "page_id", F.lit("Sin página")).alias("pagina"))
    return with_column_share(titled.groupBy("categoria", "pagina").agg(F.count("*").alias("n")), "pagina")


def by_month(vote: DataFrame, posts: DataFrame, month: Column) -> DataFrame:
    """Category x month of the post; month: expression over the posts' columns."""
    p = posts.select(F.col("id").alias("_p"), month.alias("_m"))
    dated = vote.join(p, F.coalesce("post_id", "content_id") == F.col("_p"), "left").select("categoria", F.coalesce("_m", F.lit("Sin fecha")).alias("mes"))
    return with_column_share(dated.groupBy("categoria", "mes").agg(F.count("*").alias("n")), "mes")


def pattern_alert(cells: DataFrame, order: list[str]) -> DataFrame:
    """The cell with the highest share of its column, the first of several; none if all are 0."""
    return cells.where("pct > 0").orderBy(F.desc("pct"), *order).limit(1)


def confusion(feedback: DataFrame, analysis: DataFrame) -> DataFrame:
    """One row vp, vn, fp, fn: agreement takes the prediction as truth, disagreement the corrected category."""
    a = analysis.select(F.col("id").alias("_k"), (~is_excluded() & (F.col("tiene_violencia") == "true")).alias("pred"))
    j = feedback.join(a, F.col("analysis_result_id") == F.col("_k"))
    cat = F.coalesce("corrected_categoria", F.lit(""))
    truth = F.when(F.col("agrees") == "true", F.col("pred")).otherwise(~cat.isin("", NONE))
    return j.withColumn("truth", truth).agg(F.count_if(F.expr("pred and truth")).alias("vp"), F.count_if(F.expr("not pred and not truth")).alias("vn"), F.count_if(F.expr("pred and not truth")).alias("fp"), F.count_if(F.expr("not pred and truth")).alias("fn"))


def reliability(matrix: DataFrame) -> DataFrame:
    """Precision, recall, F1 (0 where undefined) and support."""
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    m = matrix.withColumn("precision", ratio(F.col("vp"), F.col("vp") + F.col("fp"))).withColumn("recall", ratio(F.col("vp"), F.col("vp") + F.col("fn")))
    return m.withColumn("f1", ratio(2 * F.col("vp"), 2 * F.col("vp") + F.col("fp") + F.col("fn"))).withColumn("soporte", F.col("vp") + F.col("vn") + F.col("fp") + F.col("fn"))


def state(row_violent: str = "tiene_violencia") -> Column:
    """Which of four a row counts as: junk, common violence, violent or not."""
    return F.when(F.col("exclusion_label") == JUNK, "basura").when(F.col("exclusion_label") == COMMON, "comun").when(F.col(row_violent) == "true", "con_violencia").otherwise("sin_violencia")


def state_counts(analysis: DataFrame) -> DataFrame:
    return analysis.groupBy(state().alias("estado")).agg(F.count("*").alias("n"))


def violent_counts(analysis: DataFrame) -> DataFrame:
    """Two counts over rows that aren't excluded; rows that are neither true nor false count in none."""
    return analysis.where(~is_excluded()).agg(F.count_if(F.col("tiene_violencia") == "true").alias("con_violencia"), F.count_if(F.col("tiene_violencia") == "false").alias("sin_violencia"))


def bars(vote: DataFrame) -> DataFrame:
    """Votes and share of the categories, zeros too."""
    f = frequency(vote, universe_of(vote, CODES), "categoria")
    return f.select(F.col("value").alias("codigo"), F.col("n").alias("cantidad"), F.round(percent(F.col("n"), F.sum("n").over(Window.partitionBy())), 1).alias("porcentaje"))


def universe_of(df: DataFrame, values: list[str]) -> DataFrame:
    return df.sparkSession.createDataFrame(list(enumerate(values)), "pos int, value string").select("value", "pos")


def label_pairs(vote: DataFrame) -> DataFrame:
    """Distribution over (category, sub-dimension) of votes, NONE and missing sub-dimensions too."""
    n = vote.groupBy("categoria", F.coalesce("dimension", F.lit("—")).alias("dimension")).agg(F.count("*").alias("n"))
    return n.withColumn("pct", F.round(percent(F.col("n"), F.sum("n").over(Window.partitionBy())), 1))


def headline(analysis: DataFrame, vote: DataFrame) -> DataFrame:
    """One row: valid rows, violent ones, their share and the most frequent category (first by code of several)."""
    base = analysis.where(~is_excluded()).agg(F.count("*").alias("total"), F.count_if(F.col("tiene_violencia") == "true").alias("violent"))
    top = vote.groupBy("categoria").count().agg(F.min_by("categoria", F.struct(-F.col("count"), F.col("categoria"))).alias("top"))
    return base.crossJoin(top).withColumn("violent_pct", F.round(percent(F.col("violent"), F.col("total")), 1))  # one row each


def drill_down(vote: DataFrame) -> DataFrame:
    """Every category's sub-dimensions with their votes within that category."""
    n = vote.groupBy(F.col("categoria").alias("_c"), F.col("dimension").alias("_d")).agg(F.count("*").alias("_n"))
    frame = vote.sparkSession.createDataFrame([(c, d) for c, ds in DIMENSIONS.items() for d in ds], "categoria string, dimension string")
    return frame.join(n, (F.col("categoria") == F.col("_c")) & (F.col("dimension") == F.col("_d")), "left").select("categoria", "dimension", F.coalesce("_n", F.lit(0)).cast("long").alias("n"))


# All rules at once

CATEGORY, DIMENSION, GRID, PAGE, MONTH = "frecuencia_categoria", "frecuencia_subdimension", "cruce_subdimension", "cruce_pagina", "cruce_mes"
#: Sections in order, each with the columns that its rows and its columns are by.
SECTIONS = {CATEGORY: ("categoria", None), DIMENSION: ("dimension", None), GRID: ("categoria", "dimension"), PAGE: ("categoria", "pagina"), MONTH: ("categoria", "mes")}
NO_PAGE, NO_MONTH = "Sin página", "Sin fecha"


def placed(vote: DataFrame, posts: DataFrame, pages: DataFrame, month: Column) -> DataFrame:
    """categoria, dimension, pagina and mes of every vote. month: expression over the posts' columns."""
    t = pages.select(F.col("id").alias("_g"), "title")
    p = posts.select(F.col("id").alias("_p"), F.col("page_id").alias("_page"), month.alias("_m")).join(t, F.col("_page") == F.col("_g"), "left")
    return vote.join(p, F.coalesce("post_id", "content_id") == F.col("_p"), "left").select("categoria", "dimension", F.coalesce("title", "_page", F.lit(NO_PAGE)).alias("pagina"), F.coalesce("_m", F.lit(NO_MONTH)).alias("mes"))


def section_counts(vote: DataFrame) -> DataFrame:
    """seccion, fila, columna and n of all sections of votes(categoria, dimension, pagina, mes), in one pass over the votes.

    Every vote becomes a row for each section and is counted before anything moves. Votes without a sub-dimension count
    in no section by it.
    """
    one = lambda name, row, col: F.struct(F.lit(name).alias("seccion"), F.col(row).alias("fila"), (F.col(col) if col else F.lit(None).cast("string")).alias("columna"), (F.lit(True) if "dimension" not in (row, col) else F.col("dimension").isNotNull()).alias("counts"))
    rows = vote.select(F.explode(F.array(*[one(name, row, col) for name, (row, col) in SECTIONS.items()])).alias("s")).where("s.counts")
    return rows.groupBy("s.seccion", "s.fila", "s.columna").agg(F.count("*").alias("n"))


def all_rules(vote: DataFrame) -> DataFrame:
    """seccion, fila, columna, n, pct, pct_acumulado and rango: frequencies and contingency tables together.

    Frequencies and the fixed grid have zeros too. pct is a value's share of its frequency table, or a cell's of its column.
    The windows are over counts, not votes: a frequency table has as many rows as the taxonomy, a cross table as its column has categories.
    """
    frame = [(CATEGORY, c, None, i) for i, c in enumerate(CODES)] + [(DIMENSION, d, None, i) for i, d in enumerate(ALL_DIMENSIONS)] + [(GRID, c, d, 0) for c in CODES for d in ALL_DIMENSIONS]
    zeros = vote.sparkSession.createDataFrame(frame, "seccion string, fila string, columna string, pos int").withColumn("n", F.lit(0).cast("long"))
    # The zeros join as rows, so that the counts are read once; what a fixed section's frame hasn't goes.
    cells = section_counts(vote).withColumn("pos", F.lit(None).cast("int")).unionByName(zeros).groupBy("seccion", "fila", "columna").agg(F.sum("n").alias("n"), F.max("pos").alias("pos"))
    cells = cells.where(F.col("seccion").isin(PAGE, MONTH) | F.col("pos").isNotNull())
    ranked = F.col("seccion").isin(CATEGORY, DIMENSION)
    cells = cells.withColumn("_p", percent(F.col("n"), F.sum("n").over(Window.partitionBy("seccion", "columna"))))
    w = Window.partitionBy("seccion", "columna").orderBy(F.desc("n"), "pos", "fila")
    return cells.select("seccion", "fila", "columna", "n", F.round("_p", 2).alias("pct"), F.when(ranked, F.round(F.sum("_p").over(w.rowsBetween(Window.unboundedPreceding, 0)), 2)).alias("pct_acumulado"), F.when(ranked, F.row_number().over(w)).alias("rango"))


def snapshot(analysis: DataFrame, feedback: DataFrame, vote: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """seccion and fila (JSON) of every rule's result, for one file: missing values and codes, frequencies, modes, cross tables, the alert, reliability.

    vote: as placed gives it. rules: as all_rules gives them, where they are stored already.
    """
    r = all_rules(vote) if rules is None else rules
    row = lambda df, name: df.select(F.lit(name).alias("seccion"), F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("fila"))
    tables = r.select("seccion", F.to_json(F.struct("fila", "columna", "n", "pct", "pct_acumulado", "rango"), {"ignoreNullFields": "false"}).alias("fila"))
    top = F.max("n").over(Window.partitionBy("seccion"))
    modes_ = r.where(F.col("seccion").isin(CATEGORY, DIMENSION)).withColumn("_t", top).where("n = _t and n > 0").select(F.concat(F.lit("moda_"), F.regexp_replace("seccion", "^frecuencia_", "")).alias("seccion"), F.to_json(F.struct(F.col("fila").alias("moda"), "n")).alias("fila"))
    matrix = reliability(confusion(feedback, analysis))
    return (row(missing_values(analysis), "valores_perdidos").unionByName(row(missing_codes(analysis), "codigos_exclusion")).unionByName(tables).unionByName(modes_).unionByName(row(matrix, "confiabilidad")))


def votes_of_category(vote: DataFrame, code: str) -> DataFrame:
    """One row: the number of votes of one category."""
    return vote.agg(F.count_if(F.col("categoria") == code).alias("n"))
