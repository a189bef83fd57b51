"""The queries of the problems tagged llm, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import boilerplate, encoding, language, mixing, packing, residue, sitelines, spam, splitting
from corpusloom.llm.tokens import with_tokens
from corpusloom.plans.joins import sized_join
from corpusloom.plans.storage import materialize
from corpusloom.sources.tables import table


def limit_of(spark: SparkSession, d: str, name: str) -> tuple[int, int]:
    """(max_tokens, overlap_tokens) of one row of size_limits."""
    r = table(spark, d, "size_limits").filter(F.col("limit_name") == name).agg(F.max("max_tokens"), F.max("overlap_tokens")).first()
    if r[0] is None:
        raise ValueError(f"size_limits has no row {name}")
    return int(r[0]), int(r[1] or 0)


def records(spark: SparkSession, d: str, page_col: str = "content") -> DataFrame:
    """(record_kind, record_id, body): all pages and texts."""
    pages = table(spark, d, "pages").select(F.lit("page").alias("record_kind"), F.col("page_id").alias("record_id"), F.col(page_col).alias("body"))
    return pages.unionByName(table(spark, d, "text_out").select(F.lit("text").alias("record_kind"), F.col("text_id").alias("record_id"), F.col("extracted_text").alias("body")))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    r = records(spark, d)
    return encoding.examine(r, "body", encoding.train(r, "body"))


def p1_restored(spark: SparkSession, d: str) -> DataFrame:
    r = records(spark, d)
    return encoding.examine(r, "body", encoding.train(r, "body"), restore=True)


def odd_records(lines: DataFrame, headings: DataFrame | None = None) -> DataFrame:
    """(record_kind, record_id) of the records of a line table that the operators on residue or on spam find."""
    filled = materialize(residue.slots(lines), "filled")
    return residue.residue(lines, headings, filled).unionByName(spam.spam(lines, filled=filled).filter("spam").select("record_kind", "record_id")).distinct()


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Texts of residue or spam aren't judged: the operators of problems 6 and 7 find them among the texts, and they are taken out before any line is labelled."""
    texts = table(spark, d, "text_out").select("text_id", "base_domain", "url", "extracted_text")
    weights, heads = boilerplate.train_with_headings(table(spark, d, "pages"))
    sited = texts.select(F.lit("text").alias("record_kind"), F.col("text_id").alias("record_id"), F.col("base_domain").alias("site"), "url", F.col("extracted_text").alias("body"))
    odd = odd_records(residue.line_table(sited), spark.createDataFrame([(h,) for h in heads], "masked long"))
    judged = sized_join(texts, odd.select(F.col("record_id").alias("text_id")), ["text_id"], "left_anti", limit=residue.HELD)
    return boilerplate.boilerplate_lines(judged, weights).withColumnRenamed("id", "text_id")


def p2_main(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages")
    return boilerplate.main_body(pages, boilerplate.train(pages)).withColumnRenamed("id", "page_id")


def _classified(spark: SparkSession, d: str, odd: DataFrame | None = None) -> DataFrame:
    """The lines of all texts with their languages, but for the text_ids of ``odd``; garbled texts are judged by their original."""
    texts = table(spark, d, "text_out").select("text_id", "lang", "extracted_text")
    dictionaries = language.train(texts)
    judged = texts if odd is None else sized_join(texts, odd, ["text_id"], "left_anti", limit=residue.HELD)
    return language.classify(judged, dictionaries, mend=encoding.mender(encoding.train(texts, "extracted_text")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Texts that p6_found or p7_found list aren't judged: both operators run over one line table of all pages and texts."""
    odd = odd_records(residue.line_table(_sited(spark, d))).filter("record_kind = 'text'")
    return language.misfits(_classified(spark, d, odd.select(F.col("record_id").alias("text_id")))).withColumnRenamed("id", "text_id")


def p3_segments(spark: SparkSession, d: str) -> DataFrame:
    return language.segments(_classified(spark, d)).withColumnRenamed("id", "text_id")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return sitelines.repeated_lines(table(spark, d, "text_out")).select(F.col("id").alias("text_id"), "line_no")


def p4_clean(spark: SparkSession, d: str) -> DataFrame:
    texts = table(spark, d, "text_out").select("text_id", "base_domain", "extracted_text")
    return sitelines.without_lines(texts, sitelines.repeated_lines(texts)).select("text_id", "extracted_text")


def _sited(spark: SparkSession, d: str) -> DataFrame:
    """(record_kind, record_id, site, url, body): all pages and texts with their site."""
    pages = table(spark, d, "pages").select(F.lit("page").alias("record_kind"), F.col("page_id").alias("record_id"), F.col("base_domain").alias("site"), "url", F.col("content").alias("body"))
    return pages.unionByName(table(spark, d, "text_out").select(F.lit("text").alias("record_kind"), F.col("text_id").alias("record_id"), F.col("base_domain").alias("site"), "url", F.col("extracted_text").alias("body")))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue(residue.line_table(_sited(spark, d)))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_scores(spark, d).filter("spam").select("record_kind", "record_id")


def p7_scores(spark: SparkSession, d: str) -> DataFrame:
    return spam.spam(residue.line_table(_sited(spark, d)))


def p8_pack(spark: SparkSession, d: str) -> DataFrame:
    sized = with_tokens(table(spark, d, "documents").select("doc_id", "text"))
    return packing.pack(sized, limit_of(spark, d, "container")[0])


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p8_pack(spark, d), limit_of(spark, d, "container")[0])


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    targets = table(spark, d, "mix_targets")
    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    sized = with_tokens(docs.join(F.broadcast(targets.select("source").distinct().limit(mixing.MOST_SOURCES)), "source", "left_semi"))
    return mixing.mix(sized, targets), targets


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.share_report(*_mixed(spark, d))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """The documents that the splitter cuts, each with its first piece."""
    return p10_pieces(spark, d).filter("piece_no = 0").select("doc_id")


def p10_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split(table(spark, d, "documents"), *limit_of(spark, d, "piece"))


QUERIES = {f.__name__: f for f in (p1_found, p1_restored, p2_found, p2_main, p3_found, p3_segments, p4_found, p4_clean, p6_found, p7_found, p7_scores, p8_pack, p8_fill, p9_mix, p9_shares, p10_found, p10_pieces)}
