"""Audit of how far the sources of a language differ in their words, by DuckDB over shards of terms.

A task counts the terms of its documents with DuckDB, a few megabytes of text at a time; Spark merges the counts of a (language,
source, term), so a word that is everywhere is one row a source before it meets its shard.  Shards are hashes of language
and term: a shard holds every count of its terms.  One DuckDB statement drops the terms of too few documents; a second, with the totals
of all groups joined on, sums what each pair of sources adds over the terms both have and lists the shard's best terms of each
group.  Spark adds up the sums and ranks.

A pair's sum over all kept terms needs no table of sources times terms.  A group's share p of a term that it lacks is one number z, so with
f the difference of two shares

    sum f(p, q) = sum over terms of both of f(p, q) - f(p, z') - f(z, q) + f(z, z')
                + sum over terms of the one of f(p, z') + the same for the other + (V - terms of the one - terms of the other) * f(z, z')

The second line needs how often a share occurs in a group, not the terms.  All arithmetic is in whole numbers.

A DuckDB connection lives for a task, in memory, on one thread, over slices of bounded size; it writes no file.  Rows are sorted by term
inside a shard, so a slice ends between two terms, and a term has at most a row for each source of its language.  The result has a row for each
pair of sources of a language: that is its definition.

Defined cases: null text, language and source are empty strings (and one group with them); repeated rows are documents each; a document
without terms gives its group all the same; a language without kept terms has pairs of value 0 and no terms; ties are ranked by the
item's bytes; very long texts are read whole; an empty table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import portions, release, settle, small_batches, table

#: Bytes of text and rows of counts that one DuckDB statement is given.
TEXT_BYTES, COUNT_ROWS = 8 << 20, 200_000
MIN_DOCS, TOP = 10, 10
#: Every byte of a text as itself where it belongs to a term (A-Z in lower case), else a blank.
TERM_BYTES = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256))
UNIT = 1_000_000_000

COUNTS = """
WITH words AS (SELECT r, unnest(string_split(text, ' ')) AS term FROM part),
     own AS (SELECT r, term, count(*) AS n FROM words WHERE term <> '' GROUP BY r, term)
SELECT lang, source, term, CAST(sum(n) AS BIGINT) AS n, count(*) AS docs FROM own JOIN part USING (r) GROUP BY lang, source, term"""

KEPT = """
SELECT lang, source, term, n, row_number() OVER (PARTITION BY lang, term ORDER BY source) = 1 AS first_of_term
FROM part QUALIFY sum(docs) OVER (PARTITION BY lang, term) >= {min_docs}"""

SUMS = """
WITH shared AS (
  SELECT a.lang, a.source, b.source AS item, a.p, a.z, b.p AS q, b.z AS y
  FROM part a JOIN part b ON a.lang = b.lang AND a.term = b.term AND a.source < b.source),
pairs AS (
  SELECT 'pair' AS part, lang, source, item, CAST(sum((p - q) * (p - q) // (p + q) - (p - y) * (p - y) // (p + y)
         - (z - q) * (z - q) // (z + q) + (z - y) * (z - y) // (z + y)) AS BIGINT) AS value
  FROM shared GROUP BY lang, source, item),
told AS (SELECT lang, source, term, p, 1 + CAST(1000000000::HUGEINT * (sum(n) OVER (PARTITION BY lang, term) + 2) // of_lang AS BIGINT) AS q FROM part),
terms AS (
  SELECT 'term' AS part, lang, source, term AS item, (p - q) * (p - q) // (p + q) AS value FROM told WHERE p > q
  QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, term) <= {top})
FROM pairs UNION ALL FROM terms"""


def _duck():
    import duckdb

    con = duckdb.connect(":memory:")
    con.execute("SET threads = 1")
    con.execute("SET temp_directory = ''")
    return con


def _ask(con, query: str, part: pa.Table, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    con.register("part", part)
    told = con.sql(query).to_arrow_table()
    con.unregister("part")
    yield from told.select(schema.names).cast(schema).to_batches(max_chunksize=20_000)


def _term_text(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The batch with term bytes only in its texts; lengths stay, so the offsets are those of the text."""
    text = pc.fill_null(batch.column("text").cast(pa.string()), "")
    _, offsets, data = text.buffers()
    data = pa.py_buffer(data.to_pybytes().translate(TERM_BYTES)) if data is not None else None
    return pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("source"), pa.StringArray.from_buffers(len(text), offsets, data, None, 0, text.offset)], ["lang", "source", "text"])


def _term_slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Tables of about ``rows`` rows of a stream sorted by (lang, term); the rows of a term are in one table."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) < rows:
            continue
        whole = pa.Table.from_batches(held)
        same = pc.and_(pc.equal(whole["lang"], whole["lang"][-1]), pc.equal(whole["term"], whole["term"][-1]))
        end = len(whole) - pc.sum(same).as_py()
        if end:
            yield whole.slice(0, end)
        held = whole.slice(end).to_batches()
    if held:
        yield pa.Table.from_batches(held)


def _share(count: Column, total: Column) -> Column:
    """1 + floor(10^9 * (count + 2) / total); the product is wider than a long."""
    wide = F.lit(UNIT).cast("decimal(10,0)") * (count.cast("decimal(19,0)") + F.lit(2).cast("decimal(1,0)"))
    return F.when(total > 0, 1 + F.call_function("div", wide, total.cast("decimal(20,0)"))).otherwise(1).cast("long")


def _difference(p: str, q: str) -> Column:
    return F.expr(f"({p} - {q}) * ({p} - {q}) div ({p} + {q})")


def term_counts(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, term, n, docs): how often a term occurs in a group and in how many of its documents."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _duck()
        for part in (p for b in batches for p in portions(iter([_term_text(b)]), TEXT_BYTES)):
            yield from _ask(con, COUNTS, pa.Table.from_batches([part]).append_column("r", pa.array(range(len(part)), pa.int32())), schema)
        con.close()
        release()

    small_batches(docs.sparkSession)
    empty = F.lit("")
    rows = docs.select(F.coalesce(F.col(lang_col), empty).alias("lang"), F.coalesce(F.col(source_col), empty).alias("source"), F.col(text_col).alias("text"))
    counts = rows.mapInArrow(count, "lang string, source string, term string, n long, docs long")
    return counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _by_shard(rows: DataFrame, query: str, fields: list[tuple[str, pa.DataType]], ddl: str) -> DataFrame:
    """The query over all rows, which are dealt to shards by (lang, term)."""
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _duck()
        for part in _term_slices(batches, COUNT_ROWS):
            yield from _ask(con, query, part, schema)
        con.close()
        release()

    return rows.repartition("lang", "term").sortWithinPartitions("lang", "term").mapInArrow(run, ddl)


def source_divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """lang, source, part (`pair` or `term`), item, value, rank; see the module."""
    groups = docs.select(F.coalesce(F.col(lang_col), F.lit("")).alias("lang"), F.coalesce(F.col(source_col), F.lit("")).alias("source")).distinct()
    text = pa.string()
    kept = _by_shard(term_counts(docs, lang_col, source_col, text_col), KEPT.format(min_docs=int(min_docs)), [("lang", text), ("source", text), ("term", text), ("n", pa.int64()), ("first_of_term", pa.bool_())], "lang string, source string, term string, n long, first_of_term boolean")
    kept = settle(kept, "kept-terms")
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("n_group"), F.count(F.lit(1)).alias("terms"), F.sum(F.col("first_of_term").cast("long")).alias("firsts"))
    langs = totals.groupBy("lang").agg(F.sum("firsts").alias("v"), F.sum("n_group").alias("n_lang"))
    none = F.lit(0).cast("long")
    totals = groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").select("lang", "source", *[F.coalesce(c, none).alias(c) for c in ("n_group", "terms", "v", "n_lang")])
    totals = totals.withColumn("total", F.col("n_group") + 2 * F.col("v")).withColumn("z", _share(none, F.col("total")))
    totals = settle(totals, "groups")  # a row a group: whether it is broadcast follows from its size on disk

    rows = kept.join(totals.select("lang", "source", "total", "z", (F.col("n_lang") + 2 * F.col("v")).alias("of_lang")), ["lang", "source"])
    rows = rows.select("lang", "source", "term", "n", _share(F.col("n"), F.col("total")).alias("p"), "z", "of_lang")
    sums = _by_shard(rows, SUMS.format(top=int(top)), [("part", text), ("lang", text), ("source", text), ("item", text), ("value", pa.int64())], "part string, lang string, source string, item string, value long")
    sums = settle(sums, "shard-sums")

    both = sums.where("part = 'pair'").select("lang", "source", "item", "value")
    shares = rows.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("m"))
    others = totals.select("lang", F.col("source").alias("item"), F.col("z").alias("y"), F.col("terms").alias("its"))
    one = shares.join(others, "lang").where("source <> item").groupBy("lang", "source", "item").agg(F.sum(F.col("m") * _difference("p", "y")).alias("value"))
    rest = totals.join(others, "lang").where("source <> item").select("lang", "source", "item", ((F.col("v") - F.col("terms") - F.col("its")) * _difference("z", "y")).alias("value"))
    turned = lambda df: df.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    pairs = both.unionByName(turned(both)).unionByName(one).unionByName(turned(one)).unionByName(rest)
    pairs = pairs.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("part", F.lit("pair"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    terms = sums.where("part = 'term'").withColumn("rank", rank).where(F.col("rank") <= top)
    return pairs.withColumn("rank", rank).unionByName(terms).select("lang", "source", "part", "item", "value", "rank")


def op11_source_divergence(spark, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


ORACLE = {
    "op11_source_divergence": r"""
WITH docs AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
       regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
words AS (SELECT r, lang, source, unnest(w) AS term FROM docs),
kept AS (SELECT lang, term FROM words GROUP BY ALL HAVING count(DISTINCT r) >= 10),
counts AS (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL),
dense AS (SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n FROM (SELECT DISTINCT lang, source FROM docs) g JOIN kept k USING (lang) LEFT JOIN counts USING (lang, source, term)),
shares AS (SELECT *, 1 + CAST(1000000000::HUGEINT * (n + 2) // (sum(n) OVER (PARTITION BY lang, source) + 2 * count(*) OVER (PARTITION BY lang, source)) AS BIGINT) AS p FROM dense),
whole AS (SELECT lang, term, 1 + CAST(1000000000::HUGEINT * (sum(n) + 2) // (sum(sum(n)) OVER (PARTITION BY lang) + 2 * count(*) OVER (PARTITION BY lang)) AS BIGINT) AS q FROM dense GROUP BY lang, term),
pair AS (SELECT a.lang, a.source, b.source AS item, CAST(sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS BIGINT) AS value
         FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM docs),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
          FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM shares JOIN whole USING (lang, term) WHERE n > 0 AND p > q)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM (FROM pairs UNION ALL FROM terms)
QUALIFY part = 'pair' OR rank <= 10"""
}
QUERIES = {"op11_source_divergence": op11_source_divergence}
