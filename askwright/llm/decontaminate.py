"""Benchmark passages in documents, by winnowing; DataFrame functions only.

Words are maximal runs of digits, a-z and non-ASCII characters after lower-casing A-Z.  A window is ``span``
consecutive words of an item; an item of fewer words is one window.  Winnowing hashes every run of k words and
keeps the minimum hash of each w consecutive runs, with k + w - 1 = the window's length, so equal windows keep
equal minima: no shared window can be missed.  A document window whose minimum is among the fingerprints of the
test items is extended to the whole window and compared word by word (a join on the window's text), so no hash
collision can add one.

Up to ``max_literals`` test fingerprints are a literal set that each task holds (8 bytes each), and documents need
no shuffle for the search.  Beyond, document minima are joined to the test fingerprints by a shuffle.

Defined cases: null texts have no words; empty tables give no rows, or rows without hits; repeated items and repeated
rows are each judged on their own; a null item id is listed as an empty string, and items of one id are one item; equal minima
are one mark, whichever run has them; very long texts are read whole, as one array of words; extra columns of either table are not
read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, settle, table

#: Fixed value of the contract: what a word is made of.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPAN, GRAM = 10, 5


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def _upto(n: Column, none: str) -> Column:
    """0 .. n-1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.expr(none))


def _minima(df: DataFrame, span: int, gram: int, name: str) -> DataFrame:
    """Adds ``name``: for each start of ``span`` words in the column `hashes`, the least hash of its runs of ``gram`` words."""
    k = min(gram, span)
    w = span - k + 1
    none = "cast(array() as array<int>)"
    grams = F.transform(_upto(F.size("hashes") - (k - 1), none), lambda i: F.xxhash64(F.lit(k), *[F.col("hashes")[i + j] for j in range(k)], F.col("hashes")[i]))
    if w == 1:  # a lambda with a single reference to the runs would be merged with them and hash them anew for each element
        return df.withColumn(name, grams)
    df = df.withColumn("__grams", grams)
    least = F.transform(_upto(F.size("hashes") - (span - 1), none), lambda i: F.least(*[F.col("__grams")[i + j] for j in range(w)]))
    return df.withColumn(name, least).drop("__grams")


def _tokenised(df: DataFrame, text_col: str, *keep: Column) -> DataFrame:
    return df.select(*keep, words_of(F.col(text_col)).alias("words")).withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))


def item_windows(benchmark: DataFrame, span: int = SPAN, gram: int = GRAM, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, length, window, mark) for each window of each item."""
    items = _tokenised(benchmark, text_col, F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"))
    out = None
    # posexplode_outer: for the inner form Catalyst infers a filter and evaluates the nested arrays again for each element
    for length in range(1, span + 1):
        size = F.size("words")
        of = _minima(items.where(size == length if length < span else size >= span), length, gram, "minima")
        of = of.select("item", "words", F.posexplode_outer("minima").alias("start", "mark")).where(F.col("start").isNotNull())
        of = of.select("item", F.lit(length).alias("length"), F.array_join(F.expr(f"slice(words, start + 1, {length})"), " ").alias("window"), "mark")
        out = of if out is None else out.unionByName(of)
    return out


def _starts(minima: Column, marks: list[int]) -> Column:
    """Where one of the marks is the minimum."""
    return F.filter(_upto(F.size(minima), "cast(array() as array<int>)"), lambda i: minima[i].isin(marks))


def _windows_at(starts: str, length: int) -> Column:
    return F.transform(starts, lambda i: F.struct(F.lit(length).alias("length"), i.alias("start"), F.array_join(F.slice(F.col("words"), i + 1, F.lit(length)), " ").alias("window")))


def contamination(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, gram: int = GRAM, max_literals: int = 100_000, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", carry: list[Column] | None = None) -> DataFrame:
    """For each row: id, the carried columns, n_words, n_hit, n_items, items_sha256, contaminated."""
    windows = settle(item_windows(benchmark, span, gram, item_id_col, item_text_col).distinct(), "item-windows")
    marks = {}
    for length, n in windows.groupBy("length").agg(F.count_distinct("mark")).collect():
        marks[length] = n
    literal = sum(marks.values()) <= max_literals
    carry = carry or []
    names = [f"__carry{i}" for i in range(len(carry))]
    rows = _tokenised(docs, text_col, F.col(id_col).alias("doc_id"), *[c.alias(n) for c, n in zip(carry, names, strict=True)])
    found = "cast(array() as array<struct<length:int,start:int,window:string>>)"
    if literal:
        parts = []
        for length in sorted(marks):
            kept = [r[0] for r in windows.where(F.col("length") == length).select("mark").distinct().collect()]
            rows = _minima(rows, length, gram, f"__minima{length}")
            minima = F.col(f"__minima{length}")
            rows = rows.withColumn(f"__at{length}", _starts(minima, kept))
            parts.append(_windows_at(f"__at{length}", length))
        rows = rows.select("doc_id", *names, F.size("words").cast("long").alias("n_words"), (F.concat(*parts) if parts else F.expr(found)).alias("near"))
        base = settle(rows.withColumn("row", F.monotonically_increasing_id()), "windows")
        near = base.where(F.size("near") > 0).select("row", F.inline("near"))
    else:
        whole = settle(rows.withColumn("row", F.monotonically_increasing_id()), "words")
        base = whole.select("doc_id", *names, F.size("words").cast("long").alias("n_words"), "row")
        near = None
        for length in sorted(marks):
            at = _minima(whole, length, gram, "minima").select("row", F.posexplode_outer("minima").alias("start", "mark")).where(F.col("start").isNotNull())
            hit = at.join(windows.where(F.col("length") == length).select("mark").distinct(), "mark").select("row", "start")
            starts = hit.groupBy("row").agg(F.collect_list("start").alias("starts"))  # no more than the row has words
            of = whole.join(starts, "row").select("row", "words", F.explode("starts").alias("start"))
            of = of.select("row", F.lit(length).alias("length"), "start", F.array_join(F.expr(f"slice(words, start + 1, {length})"), " ").alias("window"))
            near = of if near is None else near.unionByName(of)
        near = near if near is not None else base.select("row", F.inline(F.expr(found)))
    from pyspark.sql import Window

    hits = settle(near.join(windows.select("length", "window").distinct(), ["length", "window"]), "hits")
    before = Window.partitionBy("row").orderBy("start", "length").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("length")
    fresh = F.greatest(F.lit(0), end - F.greatest("start", F.coalesce("until", F.lit(0))))
    words = hits.withColumn("until", F.max(end).over(before)).groupBy("row").agg(F.sum(fresh).cast("long").alias("n_hit"))
    items = hits.select("row", "length", "window").distinct().join(windows.select("length", "window", "item"), ["length", "window"]).select("row", "item").distinct()
    items = items.groupBy("row").agg(F.count(F.lit(1)).alias("n_items"), F.array_join(F.array_sort(F.collect_list("item")), ",").alias("items"))
    told = base.join(words, "row", "left").join(items, "row", "left")
    hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return told.select("doc_id", *[F.col(n) for n in names], "n_words", hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.sha2(F.coalesce("items", F.lit("")).cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without a benchmark window.  A row is known by its id and the hash of its text."""
    mark = F.xxhash64(F.col(text_col))
    found = contamination(docs, benchmark, id_col=id_col, text_col=text_col, carry=[mark], **options)
    bad = settle(found.where("contaminated").select(F.col("doc_id").alias("__aw_id"), F.col("__carry0").alias("__aw_mark")).distinct(), "contaminated")
    return docs.join(bad, docs[id_col].eqNullSafe(bad["__aw_id"]) & (F.xxhash64(docs[text_col]) == bad["__aw_mark"]), "left_anti")


def op10_winnowing(spark, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = {
    "op10_winnowing": r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
item AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS win
         FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM iw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM item),
doc AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS win
        FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS s FROM dw, sizes WHERE len(w) >= n)),
hit AS (SELECT doc_id, doc.n, s, item_id FROM doc JOIN item ON doc.n = item.n AND doc.win = item.win),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, coalesce(CAST(item_id AS VARCHAR), '') AS i FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""
}
QUERIES = {"op10_winnowing": op10_winnowing}
