"""Mixing sources to target weights by systematic sampling.

Each document of a source expects target / size copies. Their prefix sums within the source, shifted by one random offset,
cross integers; a document is emitted once per integer crossed. Within a source, rows are dealt to buckets by a hash of their
id (about ``BUCKET_ROWS`` or the square root of the source's rows in each), so that no task holds a whole source; a bucket's
rows are ordered by size, up and down in turn, which keeps the words taken close to the target.

Nulls: a null text has size 0; a null source is a source of its own, ordered last; a null id is an id of its own. Rows that
repeat count each. A source whose texts have no words has target 0 and takes nothing. Texts are read once, to count their words,
however long; rows of equal size are ordered by hashes. An empty table gives an empty result.
Other columns pass through :func:`mix` unchanged, whatever they are named.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, eq_null_safe, global_rank, table

#: A source's weight by its place in the order of names, repeating.
WEIGHTS = (5, 2, 1)
#: No source is repeated beyond so many times its size.
MAX_REPEAT = 3
#: Least rows of a bucket of a source.
BUCKET_ROWS = 512
SEED = "mix-1"


def n_words(text: str | Column) -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(c.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def _hash32(c: Column) -> Column:
    return F.conv(F.substring(F.md5(c.cast("binary")), 1, 8), 16, 10).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(source, n_docs, source_size, target) from rows of (source, size).

    The water level R / W rises until no further source reaches its cap: each round is one aggregate that returns two sums.
    """
    sources = sized.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size"))
    ranked = global_rank(sources, ["source"], "_rank")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    ranked = cut(ranked.withColumn("_w", weight.cast("long")))
    cap = F.col("source_size") * max_repeat
    total = int(ranked.agg(F.sum("source_size")).first()[0] or 0)
    wide = "decimal(38,0)"

    def full(left: int, weighed: int) -> Column:
        return (cap.cast(wide) * F.lit(weighed).cast(wide)).cast(wide) <= (F.col("_w").cast(wide) * F.lit(left).cast(wide)).cast(wide)

    left, weighed = total, int(ranked.agg(F.sum("_w")).first()[0] or 0)
    while True:
        capped = full(left, weighed)
        row = ranked.agg(F.sum(F.when(capped, cap)), F.sum(F.when(~capped, F.col("_w")))).first()
        now = total - int(row[0] or 0), int(row[1] or 0)
        if now == (left, weighed) or now[1] == 0:
            break
        left, weighed = now
    level = left / weighed if weighed else 0.0
    target = F.when(full(left, weighed), cap.cast("double")).otherwise(F.col("_w").cast("double") * F.lit(level))
    return ranked.select("source", "n_docs", "source_size", target.alias("target"))


def _copies(sized: DataFrame, targets: DataFrame, seed: str) -> DataFrame:
    """Add _copies to rows that have source, doc_id and size, and leave source_size and target beside."""
    n = F.col("n_docs").cast("double")
    known = targets.withColumn("_buckets", F.ceil(n / F.greatest(F.lit(float(BUCKET_ROWS)), F.sqrt(n))).cast("long"))
    bucket = F.pmod(_hash32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.col("_buckets"))
    dealt = eq_null_safe(sized, known, ["source"], "inner").withColumn("_bucket", bucket)
    slim = eq_null_safe(sized.select("source", "doc_id"), known, ["source"], "inner").withColumn("_bucket", bucket)
    counts = slim.groupBy("source", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("source", "_bucket", F.coalesce(before, F.lit(0)).alias("_before"))
    turn = F.when(F.col("_bucket") % 2 == 0, F.col("size")).otherwise(-F.col("size"))
    order = [turn, F.col("doc_id").asc_nulls_first(), *([F.col("_tie")] if "_tie" in sized.columns else [])]
    placed = dealt.withColumn("_place", F.row_number().over(Window.partitionBy("source", "_bucket").orderBy(*order)))
    placed = eq_null_safe(placed, offsets, ["source", "_bucket"], "inner")
    place = (F.col("_place") + F.col("_before")).cast("double")
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    start = _hash32(F.concat(F.lit(seed), F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")))) / F.lit(4294967296.0)
    crossed = F.floor(place * each + start) - F.floor((place - 1) * each + start)
    return placed.withColumn("_copies", crossed.cast("long")).drop("_buckets", "_bucket", "_place", "_before", "n_docs")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT, seed: str = SEED) -> DataFrame:
    """The mixed documents: every row as often as its copies say, with the columns of docs."""
    names = docs.columns
    packed = docs.select(F.struct(*[docs[c] for c in names]).alias("_row"), F.col("doc_id"), F.col("source").cast("string").alias("source"), n_words("text").alias("size"), F.xxhash64("text").alias("_tie"))
    sized = cut(packed.select("source", "doc_id", "size"))
    taken = _copies(packed, source_targets(sized, weights, max_repeat), seed)
    repeated = taken.filter("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
    return repeated.select(*[F.col("_row").getField(c).alias(c) for c in names])


def mix_plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT, seed: str = SEED) -> DataFrame:
    """doc_id, size, source_size, target, copies and taken of every document, without its text."""
    sized = cut(docs.select("doc_id", F.col("source").cast("string").alias("source"), n_words("text").alias("size")))
    out = _copies(sized, source_targets(sized, weights, max_repeat), seed)
    return out.select("doc_id", "size", "source_size", "target", F.col("_copies").alias("copies"), (F.col("_copies") * F.col("size")).alias("taken"))


def query(spark, sf_dir):
    """op10: the plan of the mix over all documents."""
    return mix_plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), sources AS (
  SELECT source, count(*) AS n_docs, sum(size)::BIGINT AS source_size,
         [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w
  FROM sized GROUP BY source
), ordered AS (
  SELECT *, 3 * source_size AS cap, sum(source_size) OVER () AS total, sum(w) OVER () AS all_w,
         coalesce(sum(3 * source_size) OVER o, 0) AS cap_before, coalesce(sum(w) OVER o, 0) AS w_before
  FROM sources WINDOW o AS (ORDER BY source_size::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
  SELECT first((total - cap_before)::DOUBLE / (all_w - w_before) ORDER BY source_size::DOUBLE / w, source NULLS LAST) AS lvl,
         first(source_size::DOUBLE / w ORDER BY source_size::DOUBLE / w, source NULLS LAST) AS at_ratio
  FROM ordered WHERE cap::HUGEINT * (all_w - w_before) > (total - cap_before)::HUGEINT * w
), targets AS (
  SELECT source, n_docs, source_size,
         CASE WHEN at_ratio IS NULL OR source_size::DOUBLE / w < at_ratio THEN cap::DOUBLE ELSE w::DOUBLE * lvl END AS target,
         ceil(n_docs::DOUBLE / greatest(512.0, sqrt(n_docs::DOUBLE)))::BIGINT AS buckets
  FROM ordered, level
), dealt AS (
  SELECT s.*, t.source_size, t.target, ('0x' || substr(md5(coalesce(s.doc_id::VARCHAR, '')), 1, 8))::BIGINT % t.buckets AS bucket
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY bucket, CASE WHEN bucket % 2 = 0 THEN size ELSE -size END, doc_id NULLS FIRST)::DOUBLE AS place,
         CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS per_doc,
         ('0x' || substr(md5('mix-1' || coalesce('=' || source, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS start
  FROM dealt
)
SELECT doc_id, size, source_size, target,
       (floor(place * per_doc + start) - floor((place - 1) * per_doc + start))::BIGINT * size AS taken
FROM placed
"""
