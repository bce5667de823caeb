"""p5: splitting legal_docs.full_text over 6,000 and document_chunks.chunk_text over 1,200 characters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm.splitting import split_oversized
from lexloom.session import table

DOC_LIMIT, CHUNK_LIMIT, OVERLAP = 6000, 1200, 200


def _pieces(spark: SparkSession, sf_dir: str, with_text: bool) -> DataFrame:
    docs = split_oversized(table(spark, sf_dir, "legal_docs"), "legal_docs", "id", "full_text", DOC_LIMIT, OVERLAP, with_text)
    return docs.unionByName(split_oversized(table(spark, sf_dir, "document_chunks"), "document_chunks", "id", "chunk_text", CHUNK_LIMIT, OVERLAP, with_text))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir, False).filter("piece_no = 0").select("table_name", "row_id", "boundary")


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir, True)


def p5_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every text over the limit whether its pieces are within it, repeat at most OVERLAP characters of the piece before, and lose
    nothing but white space."""
    pieces = _pieces(spark, sf_dir, True)
    bare = lambda c: F.translate(c, _BLANKS, "")
    limit = F.when(F.col("table_name") == "legal_docs", DOC_LIMIT).otherwise(CHUNK_LIMIT)
    fresh = F.expr("substring(piece_text, new_from - char_start + 1, char_end - new_from)")
    told = pieces.groupBy("table_name", "row_id").agg(
        F.bool_and(F.col("char_end") - F.col("char_start") <= limit).alias("fits"),
        F.bool_and((F.col("new_from") - F.col("char_start")).between(0, OVERLAP)).alias("repeats"),
        bare(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece_no", fresh.alias("t")))), lambda x: x["t"]), "")).alias("new_text"),
    )
    texts = table(spark, sf_dir, "legal_docs").select(F.lit("legal_docs").alias("table_name"), F.col("id").alias("row_id"), F.col("full_text").alias("t"))
    texts = texts.unionByName(table(spark, sf_dir, "document_chunks").select(F.lit("document_chunks").alias("table_name"), F.col("id").alias("row_id"), F.col("chunk_text").alias("t")))
    return told.join(texts, ["table_name", "row_id"]).select("table_name", "row_id", "fits", "repeats", (F.col("new_text") == bare(F.col("t"))).alias("whole"))


def p5_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces after the first by how much of the overlap they could repeat."""
    later = _pieces(spark, sf_dir, False).filter("piece_no > 0")
    return later.groupBy("table_name", "boundary").agg(F.count("*").alias("pieces"), F.avg("overlap_missing").alias("mean_missing"), F.count_if(F.col("overlap_missing") == OVERLAP).alias("without"))


#: White space of Python's str.isspace, character by character and as a class.
_BLANKS = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: White space of Python's str.isspace, as RE2 spells it.
_WS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_MARK = "chr(57344)"


def _level_sql(name: str, column: str, limit: int) -> str:
    para = rf"regexp_replace(t, '{_WS}*\n{_WS}*\n{_WS}*', {_MARK}, 'g')"
    sent = rf"regexp_replace({para}, '([.!?]){_WS}+', '\1' || {_MARK}, 'g')"
    word = rf"regexp_replace(t, '{_WS}+', {_MARK}, 'g')"
    fits = lambda marked: f"list_max(list_transform(string_split({marked}, {_MARK}), lambda x: length(regexp_replace(regexp_replace(x, '^{_WS}+', ''), '{_WS}+$', '')))) <= {limit}"
    return f"""SELECT '{name}' AS table_name, id AS row_id,
      CASE WHEN {fits(para)} THEN 'paragraph' WHEN {fits(sent)} THEN 'sentence' WHEN {fits(word)} THEN 'word' ELSE 'character' END AS boundary
      FROM (SELECT id, {column} AS t FROM {name} WHERE length({column}) > {limit})"""


QUERIES = {"p5_found": p5_found, "p5_pieces": p5_pieces, "p5_cover": p5_cover, "p5_overlaps": p5_overlaps}
ORACLE = {
    "p5_found": _level_sql("legal_docs", "full_text", DOC_LIMIT) + " UNION ALL " + _level_sql("document_chunks", "chunk_text", CHUNK_LIMIT),
    "p5_cover": f"""SELECT 'legal_docs' AS table_name, id AS row_id, true AS fits, true AS repeats, true AS whole FROM legal_docs WHERE length(full_text) > {DOC_LIMIT}
      UNION ALL SELECT 'document_chunks', id, true, true, true FROM document_chunks WHERE length(chunk_text) > {CHUNK_LIMIT}""",
}
