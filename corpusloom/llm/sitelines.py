"""Problem 4: lines that one site repeats over its documents.

Each line's documents are kept as compressed bitmaps per site, as containers of 32,768 ids: a sparse container is an array of 16-bit
positions, a dense one a bitmap. The bitmaps of variants of a line (alike in their letters) are united, their exact cardinalities are held against
the thresholds, and the lines whose document stands in the bitmap of a line above them are found or removed. A bitmap holds every document of its line, so a line is looked up by its key alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.plans.joins import sized_join
from corpusloom.plans.storage import materialize

#: A line is repeated if it stands in at least so many and at least this share of a site's texts.
MIN_TEXTS, MIN_SHARE = 4, 0.15
#: Containers of lines that occur at most so often are arrays, others bitmaps.
SPARSE = 1024


def letters(line):
    """The letters of a line, lower-cased."""
    return F.lower(F.regexp_replace(line, r"[^\p{L}]+", ""))


def keyed_lines(texts: DataFrame, id_col: str = "text_id", text_col: str = "extracted_text", site_col: str = "base_domain") -> DataFrame:
    """(site, id, line_no, k1, k2, variant) of every line that has letters. k1, k2: 96 bits of hash of its letters."""
    t = texts.select(F.col(site_col).alias("site"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).filter("t is not null and site is not null and id is not null")
    lines = t.select("site", "id", F.posexplode(F.split("t", "\n")).alias("p", "line")).filter(F.length("line") > 0)
    keyed = lines.select("site", "id", (F.col("p") + 1).cast("int").alias("line_no"), letters(F.col("line")).alias("l"), F.xxhash64("line").alias("variant")).filter("l <> ''")
    return keyed.select("site", "id", "line_no", F.xxhash64("l").alias("k1"), F.hash("l").alias("k2"), "variant")


def line_bitmaps(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """(site, k1, k2, bucket, positions, bitmap, n): the united containers of each wanted line; one of positions and bitmap is null.

    lines: as of keyed_lines. wanted: (site, k1, k2, n_rows), n_rows the number of lines. First each variant gets its own
    containers, then those of all variants are united.
    """
    at = sized_join(lines, wanted, ["site", "k1", "k2"], "inner").select("site", "k1", "k2", "variant", "n_rows", F.bitmap_bucket_number("id").alias("bucket"), F.bitmap_bit_position("id").alias("pos"))
    key = ["site", "k1", "k2", "bucket"]
    sparse = at.filter(F.col("n_rows") <= SPARSE).groupBy(*key, "variant").agg(F.collect_set(F.col("pos").cast("smallint")).alias("a"))
    sparse = sparse.groupBy(*key).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("a")))).alias("positions"))
    sparse = sparse.select(*key, "positions", F.lit(None).cast("binary").alias("bitmap"), F.size("positions").cast("long").alias("n"))
    dense = at.filter(F.col("n_rows") > SPARSE).groupBy(*key, "variant").agg(F.bitmap_construct_agg("pos").alias("b"))
    dense = dense.groupBy(*key).agg(F.bitmap_or_agg("b").alias("bitmap"))
    return sparse.unionByName(dense.select(*key, F.lit(None).cast("array<smallint>").alias("positions"), "bitmap", F.bitmap_count("bitmap").alias("n")))


def repeated_lines(texts: DataFrame, min_texts: int = MIN_TEXTS, min_share: float = MIN_SHARE, id_col: str = "text_id", text_col: str = "extracted_text", site_col: str = "base_domain") -> DataFrame:
    """(site, id, line_no) of each line that its site repeats in at least ``min_texts`` and ``min_share`` of its texts.

    Lines are the same when their letters, lower-cased, are; lines without letters are never found. Rows with a null text count as
    texts of their site; rows with a null site or id are left out. A text given twice (same id) counts once, its lines come out once.
    Empty tables give no rows. A line in a third of all rows is one key of partial sums before any shuffle.
    """
    # 15-bit positions fit a signed 16-bit integer
    sites = texts.select(F.col(site_col).alias("site"), F.col(id_col).cast("long").alias("id")).filter("site is not null and id is not null").distinct().groupBy("site").agg(F.count("*").alias("n_texts"))
    lines = materialize(keyed_lines(texts, id_col, text_col, site_col), "lines")
    counts = lines.groupBy("site", "k1", "k2").agg(F.count("*").alias("n_rows")).filter(F.col("n_rows") >= min_texts)
    # a line has at most as many texts as occurrences: what fails here can't pass below
    wanted = materialize(counts.join(sites, "site").filter(F.col("n_rows") >= min_share * F.col("n_texts") - 1e-9), "wanted")
    maps = line_bitmaps(lines, wanted.select("site", "k1", "k2", "n_rows"))
    exact = maps.groupBy("site", "k1", "k2").agg(F.sum("n").alias("n"))
    over = exact.join(wanted, ["site", "k1", "k2"]).filter((F.col("n") >= min_texts) & (F.col("n") >= min_share * F.col("n_texts") - 1e-9))
    return sized_join(lines, over.select("site", "k1", "k2"), ["site", "k1", "k2"]).select("site", "id", "line_no").distinct()


def without_lines(texts: DataFrame, lines: DataFrame, id_col: str = "text_id", text_col: str = "extracted_text") -> DataFrame:
    """``texts`` with the lines (id, line_no) taken out of ``text_col``; all other columns and rows stay.

    A text that loses all its lines becomes empty; a null stays null.
    """
    gone = lines.groupBy("id").agg(F.collect_set("line_no").alias("__gone")).withColumnRenamed("id", "__id")
    joined = texts.join(gone, F.col(id_col).cast("long") == F.col("__id"), "left").drop("__id")
    kept = F.array_join(F.filter(F.split(F.col(text_col), "\n"), lambda x, i: ~F.array_contains(F.col("__gone"), (i + 1).cast("int"))), "\n")
    return joined.withColumn(text_col, F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(kept)).drop("__gone")
