"""Embeddings from an outside provider, collections of documents with vectors, and human corrections as examples to search."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamiz.functions.labels import primary_label
from tamiz.functions.text import hashed_id, plain_markdown, readable, trimmed
from tamiz.functions.vocabulary import NONE
from tamiz.sources.tables import Partitioned, bucket_of

from .chunks import chunk_list
from .vectors import search

#: Texts of a batch to their vectors, in order.
Provider = Callable[[list[str]], list[list[float]]]
VECTORS = "digest string, embedding array<double>"
#: Texts that a provider is asked for at a time.
ASKED = 512
COLLECTION = "id string, source string, text string, metadata map<string,string>, embedding array<double>, bucket int"
PROVENANCE = "human_feedback"


def vectors_of(texts: DataFrame, provider: Provider, text: str = "text", known: DataFrame | None = None) -> DataFrame:
    """digest and embedding of every different text that has any and is not among known(digest, embedding).

    Equal texts meet by their digests before the provider sees them: it is asked once for each, batch by batch, in the tasks.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ASKED):
                some = batch.slice(at, ASKED)
                vectors = pa.array([[float(x) for x in v] for v in provider(some.column("_text").to_pylist())], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([some.column("digest"), vectors], names=["digest", "embedding"])

    rows = texts.where(F.col(text).isNotNull()).select(F.sha2(text, 256).alias("digest"), F.col(text).alias("_text"))
    if known is not None:
        rows = rows.join(known.select(F.col("digest").alias("_known")), F.col("digest") == F.col("_known"), "left_anti")
    once = rows.groupBy("digest").agg(F.first("_text").alias("_text"))
    return once.select("digest", "_text").mapInArrow(run, VECTORS)


def embedded(rows: DataFrame, provider: Provider, text: str = "text", known: DataFrame | None = None) -> DataFrame:
    """rows with embedding; null for a null text. known: vectors that need not be asked for, as vectors_of gives them."""
    new = vectors_of(rows, provider, text, known)
    every = new if known is None else known.select("digest", "embedding").unionByName(new)
    return rows.join(every.withColumnRenamed("digest", "_digest"), F.sha2(text, 256) == F.col("_digest"), "left").drop("_digest")


class Collection:
    """Documents with metadata and vectors below one folder, kept in parts by source."""

    def __init__(self, spark: SparkSession, path: str, provider: Provider, parts: int = 64):
        self.provider, self.parts = provider, parts
        self.table = Partitioned(spark, path, COLLECTION, "bucket")

    def rows(self, documents: DataFrame) -> DataFrame:
        """documents(source, text, and id, chunk_index or metadata if they have them) as rows of the collection. An id not given is made of source and chunk, so that it never meets another's."""
        has = set(documents.columns)
        source = F.coalesce("source", F.lit("desconocido")) if "source" in has else F.lit("desconocido")
        made = hashed_id(source, F.col("chunk_index") if "chunk_index" in has else F.md5("text"))
        own = F.coalesce("id", made) if "id" in has else made
        meta = F.coalesce("metadata", F.create_map().cast("map<string,string>")) if "metadata" in has else F.create_map().cast("map<string,string>")
        df = documents.where(trimmed(F.coalesce("text", F.lit(""))) != "").select(own.alias("id"), source.alias("source"), "text", meta.alias("metadata"))
        return embedded(df.dropDuplicates(["id"]), self.provider).withColumn("bucket", bucket_of(self.parts, "source"))

    def add(self, documents: DataFrame) -> None:
        """Documents in place of those of their source and id; others are added."""
        self.table.upsert(self.rows(documents), ["source", "id"])

    def replace_sources(self, documents: DataFrame) -> None:
        """Documents in place of all that their sources had."""
        owners = documents.select(F.coalesce("source", F.lit("desconocido")).alias("source")).distinct().withColumn("bucket", bucket_of(self.parts, "source"))
        self.table.replace_of(owners, self.rows(documents), ["source"])

    def delete(self, *ids: str) -> None:
        self.table.delete(F.col("id").isin(*ids))

    def delete_source(self, source: str) -> None:
        self.table.delete((F.col("bucket") == bucket_of(self.parts, "source")) & (F.col("source") == source))

    def count(self) -> int:
        return self.table.read().count()

    def search(self, queries: DataFrame, k: int = 5, where: dict[str, str] | None = None, most_queries: int = 10_000) -> DataFrame:
        """query_id, id, source, text, metadata, distance, rank: the k nearest documents of every query(query_id, text), all there are where they are fewer. A blank query finds none. where: what a document's metadata must say."""
        return find(self.table.read(), queries, self.provider, k, where, most_queries)


def find(documents: DataFrame, queries: DataFrame, provider: Provider, k: int, where: dict[str, str] | None = None, most_queries: int = 10_000) -> DataFrame:
    for key, value in (where or {}).items():
        documents = documents.where(F.col("metadata")[key] == value)
    asked = embedded(queries.where(trimmed(F.coalesce("text", F.lit(""))) != ""), provider).select("query_id", F.col("embedding").alias("query"))
    near = search(documents.select(F.col("id").alias("vec_id"), "embedding"), asked, k, most_queries)
    own = documents.select("id", "source", "text", "metadata")
    return near.join(own, F.col("vec_id") == F.col("id")).select("query_id", "id", "source", "text", "metadata", "distance", "rank")


def ingest(files: DataFrame, collection: Collection, replace: bool = False, tags: str = "", size: int = 500, overlap: int = 50) -> DataFrame:
    """Chunks of files(source, content) into a collection; source, chunks and error ('sin chunks extraíbles') of every file.

    Markdown (by the name's ending) loses its marks. replace: what a file's source had goes. tags: parted by commas, kept in the
    metadata with format, chunk_index and total_chunks.
    """
    text = F.when(F.lower("source").endswith(".md"), plain_markdown("content")).otherwise(readable("content"))
    pieces = files.select("source", F.posexplode(chunk_list(text, size, overlap)).alias("chunk_index", "text"))
    totals = pieces.groupBy(F.col("source").alias("_s")).agg(F.count("*").alias("_n"))
    named = ",".join(t for t in (x.strip() for x in tags.split(",")) if t)
    meta = {"source": F.col("source"), "format": F.when(F.lower("source").endswith(".md"), "md").otherwise("txt"), "chunk_index": F.col("chunk_index").cast("string"), "total_chunks": F.col("_n").cast("string"), **({"tags": F.lit(named)} if named else {})}
    rows = pieces.join(totals, F.col("source") == F.col("_s")).select("source", "chunk_index", "text", F.create_map(*[x for k, v in meta.items() for x in (F.lit(k), v)]).alias("metadata"))
    (collection.replace_sources if replace else collection.add)(rows)
    return files.select("source").distinct().join(totals, F.col("source") == F.col("_s"), "left").select("source", F.coalesce("_n", F.lit(0)).alias("chunks"), F.when(F.col("_n").isNull(), "sin chunks extraíbles").alias("error"))


# Corrections


def json_text(value: Column) -> Column:
    """A text as JSON; null as null."""
    made = F.to_json(F.struct(value.cast("string").alias("s")))
    return F.when(value.isNull(), "null").otherwise(F.substring(made, F.lit(6), F.length(made) - 6))


def example_text(text: Column | str, labels: Column | str) -> Column:
    """A correction as the example that models are shown: the text, and the result as JSON.

    labels: a list of struct(categoria, dimension, severidad, confianza, regla_disparada, marcadores, falso_positivo, score_ajuste, justificacion, evidencia).
    """
    t, ls = (F.col(x) if isinstance(x, str) else x for x in (text, labels))
    number = lambda c: F.coalesce(c.cast("double").cast("string"), F.lit("null"))
    truth = lambda c: F.when(F.coalesce(c, F.lit(False)), "true").otherwise("false")

    def label(x: Column) -> Column:
        listed = F.concat(F.lit("["), F.array_join(F.transform(F.coalesce(x["marcadores"], F.array().cast("array<string>")), json_text), ", "), F.lit("]"))
        fields = [("categoria", json_text(x["categoria"])), ("dimension", json_text(x["dimension"])), ("severidad", json_text(x["severidad"])), ("confianza", number(x["confianza"])), ("regla_disparada", json_text(x["regla_disparada"])),
                  ("marcadores_detectados", listed), ("es_falso_positivo_probable", truth(x["falso_positivo"])), ("score_ajuste", number(x["score_ajuste"])), ("justificacion", json_text(x["justificacion"])), ("evidencia", json_text(x["evidencia"]))]
        parts = [part for i, (k, v) in enumerate(fields) for part in (F.lit(f'{", " if i else "{"}"{k}": '), v)]
        return F.concat(*parts, F.lit("}"))

    top = F.when(F.size(ls) > 0, F.coalesce(primary_label(ls)["severidad"], F.lit(NONE))).otherwise(NONE)
    return F.concat(F.lit('TEXTO: "'), t, F.lit('"\nRESULTADO: {"tiene_violencia": '), truth(F.size(ls) > 0), F.lit(', "severidad_global": '), json_text(top), F.lit(', "clasificaciones": ['), F.array_join(F.transform(ls, label), ", "), F.lit("]}"))


LABEL = "struct<categoria:string,dimension:string,severidad:string,confianza:double,regla_disparada:string,marcadores:array<string>,falso_positivo:boolean,score_ajuste:double,justificacion:string,evidencia:string>"


def one_label(categoria: Column, dimension: Column, justificacion: Column) -> Column:
    """A flat correction as a list of labels; an empty one for none."""
    null = F.lit(None)
    label = F.struct(categoria.alias("categoria"), dimension.alias("dimension"), F.lit(NONE).alias("severidad"), F.lit(1.0).alias("confianza"), null.cast("string").alias("regla_disparada"), F.array().cast("array<string>").alias("marcadores"),
                     F.lit(False).alias("falso_positivo"), F.lit(1.0).alias("score_ajuste"), justificacion.alias("justificacion"), F.lit("").alias("evidencia"))
    return F.when(F.coalesce(categoria, F.lit("")).isin("", NONE), F.array().cast(f"array<{LABEL}>")).otherwise(F.array(label).cast(f"array<{LABEL}>"))


def corrections(feedback: DataFrame, analyses: DataFrame, texts: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """Pending corrections as documents of a collection: id, source, text (the example), metadata, feedback_id.

    feedback: id, content_type, content_id, agrees, indexed, text_snapshot, corrected_categoria, corrected_dimension, corrected_justificacion, reviewer_user_id, chromadb_id, added_at.
    Pending is what disagrees, corrects something and isn't indexed. A review without its text takes it from texts(content_type, content_id, text);
    one without any is left out. analyses(content_type, content_id, categoria) gives the category that was corrected, users(id, username) the reviewer's name.
    """
    given = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    pending = feedback.where((F.col("agrees") == "false") & (F.coalesce("indexed", F.lit("false")) != "true") & (given("corrected_categoria") | given("corrected_dimension") | given("corrected_justificacion")))
    kind, cid = F.coalesce("content_type", F.lit("post")), F.coalesce("content_id", F.lit(""))
    t = texts.select(F.col("content_type").alias("_tt"), F.col("content_id").alias("_ti"), F.col("text").alias("_text"))
    a = analyses.select(F.col("content_type").alias("_at"), F.col("content_id").alias("_ai"), F.col("categoria").alias("_own"))
    rows = pending.join(t, (kind == F.col("_tt")) & (cid == F.col("_ti")), "left").join(a, (kind == F.col("_at")) & (cid == F.col("_ai")), "left")
    if users is not None:
        rows = rows.join(users.select(F.col("id").alias("_uid"), F.col("username").alias("_user")), F.col("reviewer_user_id") == F.col("_uid"), "left")
    else:
        rows = rows.withColumns({"_uid": F.lit(None).cast("string"), "_user": F.lit(None).cast("string")})
    text = F.coalesce(F.nullif("text_snapshot", F.lit("")), "_text")
    category = F.coalesce(F.nullif("corrected_categoria", F.lit("")), "_own", F.lit(NONE))
    why = F.coalesce(F.nullif("corrected_justificacion", F.lit("")), F.lit("Revisado por humano"))
    said = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    meta = {"source": F.lit(PROVENANCE), "feedback_id": F.col("id").cast("string"), "content_type": kind, "content_id": cid, "corrected_categoria": category, "corrected_dimension": said(F.col("corrected_dimension")), "original_categoria": said(F.col("_own")),
            "label_count": F.lit("1"), "user_id": said(F.col("_uid")), "added_by_username": said(F.col("_user")), "added_at": said(F.col("added_at"))}
    return rows.where(trimmed(F.coalesce(text, F.lit(""))) != "").select(
        F.coalesce(F.nullif("chromadb_id", F.lit("")), F.concat(F.lit("feedback_"), F.col("id").cast("string"))).alias("id"), F.lit(PROVENANCE).alias("source"), example_text(text, one_label(category, F.col("corrected_dimension"), why)).alias("text"),
        F.create_map(*[x for k, v in meta.items() for x in (F.lit(k), v)]).alias("metadata"), F.col("id").alias("feedback_id"))


def marked(feedback: DataFrame, pushed: DataFrame) -> DataFrame:
    """feedback with those of pushed(feedback_id, id) as indexed under their id."""
    p = pushed.select(F.col("feedback_id").alias("_f"), F.col("id").alias("_id"))
    j = feedback.join(p, F.col("id") == F.col("_f"), "left")
    done = F.col("_f").isNotNull()
    return j.withColumns({"indexed": F.when(done, "true").otherwise(F.col("indexed")), "chromadb_id": F.when(done, F.col("_id")).otherwise(F.col("chromadb_id"))}).select(*feedback.columns)
