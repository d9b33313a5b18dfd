"""Importance resampling towards a target: hashed n-gram counts of both sides, a gain for each bucket, draws by Gumbel noise.

A position table has a row for each word of each document (posexplode).  For orders above 1, lead() over a document's positions
puts the following words beside a word, and an order's feature is the words joined by a blank.  A feature's bucket is the CRC-32 of its bytes
modulo ``buckets``.  Buckets are counted over all documents and over all target texts; the gain of one is the log-ratio of its smoothed
shares, in thousandths, rounded down.  Gains are joined to the positions, and a document's weight is their mean, rounded down.  Its score adds
Gumbel noise that follows from its id alone, so the highest scores are a sample without replacement in proportion to exp(weight / 1000).

The position table is written once (order and bucket, no words) and read twice.  Positions of a document are in one task until they are summed,
so what is shuffled is a row a bucket and task, and a row a document.  Only orders above 1 shuffle words, by document.  The table of gains has
``buckets`` rows whatever the input; it is broadcast up to a million of them.  Ranks come from a range-partitioned sort and
an offset for each partition.

Defined cases: null texts have no words, so weight 0 and, with ``min_words`` above 0, no rank; a null id draws as an empty one and comes first among
ties; repeated rows are documents each; very long texts are read whole; an empty table of documents gives no rows; an empty target has
no counts, and gains are those of the smoothing; extra columns of either table are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settle, table
from .decontaminate import words_of
from .sharding import numbered

BUCKETS, ORDERS, MIN_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, 2024


def position_table(docs: DataFrame, orders: int, buckets: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, n, bucket) for each run of n = 1 .. ``orders`` words; a row without words has one entry, with nulls."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))  # numbered before the explode
    # posexplode_outer: for the inner form Catalyst infers a filter and extracts the words a second time
    rows = rows.select("row", "doc_id", F.posexplode_outer(words_of(F.col("text"))).alias("pos", "word"))
    following = Window.partitionBy("row").orderBy("pos")
    bucket = lambda feature: F.crc32(feature.cast("binary")) % buckets
    if orders == 1:
        return rows.select("row", "doc_id", F.when(F.col("pos").isNotNull(), 1).cast("byte").alias("n"), bucket(F.col("word")).cast("int").alias("bucket"))
    last = F.col("word")
    runs = [F.struct(F.lit(1).alias("n"), last.alias("feature"))]
    for k in range(1, orders):
        rows = rows.withColumn(f"next{k}", F.lead("word", k).over(following))
        feature = F.concat_ws(" ", "word", *[F.col(f"next{i}") for i in range(1, k + 1)])
        runs.append(F.when(F.col(f"next{k}").isNotNull(), F.struct(F.lit(k + 1).alias("n"), feature.alias("feature"))))
    rows = rows.select("row", "doc_id", F.explode(F.array(*runs)).alias("run")).where(F.col("run").isNotNull())
    return rows.select("row", "doc_id", F.when(F.col("run.feature").isNotNull(), F.col("run.n")).cast("byte").alias("n"), bucket(F.col("run.feature")).cast("int").alias("bucket"))


def _counts(positions: DataFrame, name: str) -> DataFrame:
    return positions.where("bucket is not null").groupBy("bucket").agg(F.count(F.lit(1)).alias(name))


def gains(documents: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """(bucket, gain) for each bucket of the documents, from two position tables."""
    s, t = settle(_counts(documents, "s"), "bucket-counts"), settle(_counts(target, "t"), "bucket-counts")
    all_s, all_t = (df.agg(F.coalesce(F.sum(df.columns[1]), F.lit(0))).first()[0] for df in (s, t))
    both = s.join(t, "bucket", "left").withColumn("t", F.coalesce("t", F.lit(0)))
    real = lambda c: (c + 1).cast("double")
    ratio = (real(F.col("t")) * float(all_s + buckets)) / (real(F.col("s")) * float(all_t + buckets))
    return both.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).cast("long").alias("gain"))


def gumbel(doc_id: Column, seed: int) -> Column:
    """Noise of an id in thousandths, rounded down: the first 32 bits of a digest are its uniform number."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resample(docs: DataFrame, target: DataFrame, orders: int = ORDERS, buckets: int = BUCKETS, min_words: int = MIN_WORDS, percent: int = PERCENT, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score, rank: the drawn documents have ranks from 1, the others null.

    Of the N documents of ``min_words`` words and more, floor(N * percent / 100) are drawn.
    """
    positions = settle(position_table(docs, orders, buckets, id_col, text_col), "positions")
    wanted = position_table(target.select(F.lit(None).cast("int").alias("doc_id"), F.col(target_text_col).alias("text")), orders, buckets)
    gain = gains(positions, wanted, buckets)
    gain = F.broadcast(gain) if buckets <= 1_000_000 else gain
    told = positions.join(gain, "bucket", "left").groupBy("row", "doc_id").agg(F.count("bucket").alias("n_features"), F.count(F.when(F.col("n") == 1, 1)).alias("n_words"), F.sum("gain").alias("sum"))
    mean = F.expr("(sum - pmod(sum, n_features)) div n_features")
    told = told.withColumn("weight", F.when(F.col("n_features") > 0, mean).otherwise(0).cast("long")).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    told = settle(told.select("doc_id", "n_features", "n_words", "weight", "score", (-F.col("score")).alias("by")), "weights")
    ranked, n = numbered(told.where(F.col("n_words") >= min_words), ["by", "doc_id"], "number")
    rank = F.when(F.col("number") < n * percent // 100, F.col("number") + 1).cast("long")
    rest = told.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    out = ["doc_id", "n_features", "weight", "score", "rank"]
    return ranked.withColumn("rank", rank).select(*out).unionByName(rest.select(*out))


def op12_importance_resampling(spark, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# CRC-32 a byte at a time, for each distinct word
ORACLE = {
    "op12_importance_resampling": r"""
WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
texts AS (SELECT 'd' AS side, row_number() OVER () AS r, doc_id, text FROM documents UNION ALL SELECT 'b', row_number() OVER (), NULL, text FROM benchmark),
cut AS (SELECT side, r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
words AS (SELECT side, r, unnest(w) AS word FROM cut),
vocab AS (SELECT word, xor(list_reduce(list_transform(range(1, length(h), 2), lambda i: CAST('0x' || substr(h, i, 2) AS BIGINT)), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), 4294967295), 4294967295) % 10000 AS bucket
          FROM (SELECT DISTINCT word, hex(encode(word)) AS h FROM words), crc),
counts AS (SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM words JOIN vocab USING (word) GROUP BY bucket),
sums AS (SELECT coalesce(sum(s), 0) AS all_s, coalesce(sum(t), 0) AS all_t FROM counts),
gain AS (SELECT bucket, CAST(floor(1000.0::DOUBLE * ln(((t + 1)::DOUBLE * (all_s + 10000)::DOUBLE) / ((s + 1)::DOUBLE * (all_t + 10000)::DOUBLE))) AS BIGINT) AS gain FROM counts, sums),
mean AS (SELECT r, count(*) AS n, CAST(sum(gain) AS BIGINT) AS total FROM words JOIN vocab USING (word) JOIN gain USING (bucket) WHERE side = 'd' GROUP BY r),
told AS (SELECT doc_id, len(w) AS n_features, CASE WHEN n > 0 THEN (total - ((total % n) + n) % n) // n ELSE 0 END AS weight,
         CAST(floor(-1000.0::DOUBLE * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5)::DOUBLE / 4294967296.0::DOUBLE))) AS BIGINT) AS noise
         FROM cut LEFT JOIN mean USING (r) WHERE side = 'd'),
scored AS (SELECT doc_id, n_features, weight, weight + noise AS score FROM told),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS FIRST) AS k, count(*) FILTER (n_features >= 20) OVER () AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND k <= n * 10 // 100 THEN k END AS rank FROM ranked"""
}
QUERIES = {"op12_importance_resampling": op12_importance_resampling}
