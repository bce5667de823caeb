"""Repository semantics on tables: inserts that find what is there, lookups, metadata search, updates, deletes, views, erasure.

Tables are DataFrames in, DataFrames out; the caller writes the result. PostgreSQL's order of nulls is stated wherever it matters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def insert_status(new: DataFrame, stored: DataFrame) -> DataFrame:
    """(filename, id, status) for new documents (filename, file_hash, extracted_text): inserted, exists (same hash, or same text where a hash
    is missing) or conflict (another document has the name). Of several stored or new rows with one name the first id counts."""
    s = stored.groupBy("filename").agg(F.min_by(F.struct(F.col("id").alias("stored_id"), F.col("file_hash").alias("old_hash"), F.col("extracted_text").alias("old_text")), "id").alias("o")).select("filename", "o.*")
    j = new.select("filename", "file_hash", "extracted_text").join(s, "filename", "left")
    same = F.when(F.col("file_hash").isNotNull() & F.col("old_hash").isNotNull(), F.col("file_hash") == F.col("old_hash")).otherwise(F.col("extracted_text").eqNullSafe(F.col("old_text")))
    return j.select("filename", F.col("stored_id").alias("id"), F.when(F.col("stored_id").isNull(), "inserted").when(same, "exists").otherwise("conflict").alias("status"))


def metadata_is(c: Column, filters: dict[str, object]) -> Column:
    """All of the keys have these values, compared as JSON texts; no filter fits everything."""
    import json

    ok = F.lit(True)
    for k, v in filters.items():
        ok = ok & F.coalesce(F.get_json_object(c, f"$['{k}']") == (v if isinstance(v, str) else json.dumps(v)), F.lit(False))
    return ok


def merge_metadata(old: Column, new: Column) -> Column:
    """Shallow merge of two JSON objects, the new values first; values keep their JSON form."""
    as_map = lambda c: F.coalesce(F.from_json(c, "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    kept = F.map_filter(as_map(old), lambda k, v: ~F.array_contains(F.map_keys(as_map(new)), k))
    return F.to_json(F.map_concat(kept, as_map(new)))


def newest(df: DataFrame, by: str, limit: int, tie: str = "id") -> DataFrame:
    return df.orderBy(F.col(by).desc_nulls_first(), tie).limit(limit)


def by_page(clauses: DataFrame) -> DataFrame:
    return clauses.orderBy(F.col("page_number").asc_nulls_last(), "id")


def delete_documents(documents: DataFrame, children: dict[str, tuple[DataFrame, str]], gone: DataFrame) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Documents without those in ``gone`` (id), and every child table (frame, foreign key) without their rows."""
    keep = lambda df, key: df.join(gone.select(F.col("id").alias(key)), key, "left_anti")
    return keep(documents, "id"), {n: keep(df, key) for n, (df, key) in children.items()}


def latest_stage(log: DataFrame) -> DataFrame:
    """The last entry of each document and stage."""
    return log.groupBy("document_id", "processing_stage").agg(F.max_by(F.struct("id", "status", "error_message", "created_at"), F.struct("created_at", "id")).alias("e")).select("document_id", "processing_stage", "e.*")


def failed_documents(log: DataFrame) -> DataFrame:
    return log.filter("status = 'failed' and document_id is not null").select("document_id").distinct()


def clause_fields(clauses: DataFrame, docs: DataFrame) -> DataFrame:
    """Clauses as extracted fields of their documents: (doc_id, field_name, value JSON, confidence)."""
    j = clauses.join(docs.select(F.col("id").alias("document_id"), "doc_id", "doc_type"), "document_id")
    value = F.to_json(F.struct(F.col("clause_text").alias("text"), F.col("page_number").alias("page"), F.struct("bbox_x", "bbox_y", "bbox_width", "bbox_height").alias("bbox")))
    return j.select("doc_id", "doc_type", F.col("id").alias("clause_id"), F.concat(F.lit("clause_"), F.coalesce("clause_type", F.lit("unknown"))).alias("field_name"), value.alias("value"), F.col("confidence_score").alias("confidence"))


def clause_view(fields: DataFrame, doc_type: str = "contract") -> DataFrame:
    """Clauses read back from the fields of documents of one type ('_' in the name pattern stands for any character)."""
    f = fields.filter((F.col("doc_type") == doc_type) & F.col("field_name").like("clause_%") & F.col("value").isNotNull())
    return f.select("clause_id", "doc_id", F.substring("field_name", 8, 1000).alias("clause_type"), F.get_json_object("value", "$.text").alias("clause_text"), F.get_json_object("value", "$.page").cast("int").alias("page_number"), "confidence")


def erase(log: DataFrame, key_col: str, gone: DataFrame, pseudonym: Column, note: dict[str, Column] | None = None) -> DataFrame:
    """An audit log in which erased documents appear under a pseudonym only. With ``note`` an event is appended for each of them that has
    these columns and the pseudonym, and nulls elsewhere."""
    g = gone.select(F.col("id").alias(key_col), pseudonym.alias("_p"))
    j = log.join(g, key_col, "left")
    kept = j.select(*(F.coalesce(F.col("_p"), F.col(c).cast("string")).alias(c) if c == key_col else F.col(c) for c in log.columns))
    if note is None:
        return kept
    kinds = dict(kept.dtypes)
    return kept.unionByName(g.select(*(F.col("_p").alias(c) if c == key_col else note.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in kept.columns)))


def by_key(df: DataFrame, column: str, value: object) -> DataFrame:
    """The row of a key; the filter reaches the scan. Keys are unique, so a second row is an error of the store."""
    return df.filter(F.col(column) == F.lit(value))


def id_of(df: DataFrame, filename: str) -> int | None:
    row = by_key(df, "filename", filename).select("id").orderBy("id").first()
    return None if row is None else row["id"]


def insert_rows(stored: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Stored rows and new ones; a new row whose key is stored is left out, and one of equal new keys is taken."""
    return stored.unionByName(new.dropDuplicates([key]).join(stored.select(key), key, "left_anti").select(*stored.columns))


def delete_by_document(clauses: DataFrame, document_ids: DataFrame) -> DataFrame:
    return clauses.join(document_ids.select(F.col("id").alias("document_id")), "document_id", "left_anti").select(*clauses.columns)


def count_by_document(clauses: DataFrame) -> DataFrame:
    return clauses.filter("document_id is not null").groupBy("document_id").agg(F.count("*").alias("clauses"))


def by_type(clauses: DataFrame, clause_type: str, limit: int) -> DataFrame:
    """The newest clauses of a type."""
    return newest(clauses.filter(F.col("clause_type") == clause_type), "created_at", limit)


def update_text(documents: DataFrame, new: DataFrame, key: str = "id", column: str = "extracted_text") -> DataFrame:
    """``update_column`` that raises LookupError where a key has no row."""
    lost = new.join(documents.select(key), key, "left_anti").select(key).first()
    if lost is not None:
        raise LookupError(f"no row with {key} {lost[0]}")
    return update_column(documents, new, key, column)


def documents_to_legal(documents: DataFrame) -> DataFrame:
    """Documents of the first schema as contracts of the second: the type in the metadata, else the file name, as title; both kept as
    metadata."""
    meta = F.to_json(F.struct("filename", F.from_json(F.coalesce("metadata", F.lit("{}")), "map<string,variant>").alias("original_metadata")))
    return documents.select(
        F.lit("contract").alias("doc_type"),
        F.coalesce(F.get_json_object("metadata", "$.contract_type"), "filename").alias("title"),
        F.col("file_hash").alias("content_hash"),
        F.col("extracted_text").alias("full_text"),
        meta.alias("metadata"),
        F.col("uploaded_at").alias("created_at"),
    )


def bounding_box(x: Column, y: Column, width: Column, height: Column) -> Column:
    """The box of a clause, null unless all four sides are known."""
    known = x.isNotNull() & y.isNotNull() & width.isNotNull() & height.isNotNull()
    return F.when(known, F.struct(x.alias("x"), y.alias("y"), width.alias("width"), height.alias("height")))


def is_failed(status: Column) -> Column:
    return F.coalesce(status == "failed", F.lit(False))


def is_completed(status: Column) -> Column:
    return F.coalesce(status == "completed", F.lit(False))


def inverted_index(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(token, doc, n): words of a text with their counts, for full-text search by joins."""
    words = F.filter(F.split(F.lower(F.col(text_col)), r"(?U)[^\p{L}\p{N}]+"), lambda w: w != "")
    return df.select(F.col(id_col).alias("doc"), F.explode(words).alias("token")).groupBy("token", "doc").agg(F.count("*").alias("n"))


def search(index: DataFrame, words: list[str]) -> DataFrame:
    """(doc, hits): documents that have all of the words."""
    want = sorted({w.lower() for w in words})
    found = index.filter(F.col("token").isin(want)).groupBy("doc").agg(F.count_distinct("token").alias("k"), F.sum("n").alias("hits"))
    return found.filter(F.col("k") == len(want)).select("doc", "hits")


def update_column(df: DataFrame, new: DataFrame, key: str, column: str) -> DataFrame:
    """Rows with a column's new values (key, column) where there are any; keys without a row are ignored."""
    n = new.groupBy(key).agg(F.first(column).alias("_new"), F.lit(True).alias("_set"))
    return df.join(n, key, "left").withColumn(column, F.when(F.col("_set"), F.col("_new")).otherwise(F.col(column))).drop("_new", "_set").select(*df.columns)


def jdbc(spark, url: str, dbtable: str, key: str | None = None, parts: int = 16, bounds: tuple[int, int] | None = None, **options: str) -> DataFrame:
    """A table of a database as a DataFrame, read in parallel along a numeric key where its bounds are given."""
    r = spark.read.format("jdbc").option("url", url).option("dbtable", dbtable).options(**options)
    if key and bounds:
        r = r.option("partitionColumn", key).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", parts)
    return r.load()


def append_jdbc(df: DataFrame, url: str, dbtable: str, key: str, **options: str) -> None:
    """Append rows whose key the database's table does not have, each key once: a retry appends nothing twice. A missing table is made."""
    spark = df.sparkSession
    new = df.dropDuplicates([key])
    try:
        new = new.join(jdbc(spark, url, dbtable, **options).select(F.col(key).alias("_known")), F.col(key) == F.col("_known"), "left_anti")
    except Exception as e:  # each database has its own words for a missing table
        if not any(w in str(e).lower() for w in ("not exist", "not found", "no such", "unknown table", "42p01", "42x05")):
            raise
    new.write.format("jdbc").option("url", url).option("dbtable", dbtable).options(**options).mode("append").save()
