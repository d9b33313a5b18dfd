"""Splits, caps, mixes, shuffles and shards by md5 draws."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import sampling as S
from ..operators import assembly as B
from ..operators import questions as Q
from ..session import table


def split_md5_mod20(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", S.md5_mod20(F.md5("text")).alias("bucket"))
    return d.select("doc_id", "bucket", F.when(F.col("bucket") == 0, "test").otherwise("train").alias("split"))


def split_crc32_mod10(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.when(F.crc32(F.col("doc_id").cast("string")) % 10 == 0, "test").otherwise("train").alias("split"))


def split_stratified(spark, sf_dir):
    return S.stratified_split(table(spark, sf_dir, "labels"), "quality", 0.2, "split", "doc_id").select("doc_id", "quality", "split")


def even_odd_halves(spark, sf_dir):
    return S.halves(table(spark, sf_dir, "embeddings"), ["label"], ["vec_id"]).select("vec_id", "label", "half")


def mix_capped_weighted(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return S.mix(d, "lang", "doc_id", {"en": 0.5, "de": 2.0, "es": 0.0}, 150, "mix").select("doc_id", "lang", "pass", "order_key")


def rank_shards(spark, sf_dir, batch: int = 4, world: int = 3):
    """Batches dealt to ranks in turn; what does not fill a round for all is left out."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return B.rank_batches(d, "lang", "doc_id", batch, world)


def shuffle_options(spark, sf_dir):
    n = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("options")).withColumn("label", F.lit(1))
    n = n.withColumn("probs", F.transform("options", lambda o, i: (i + 1) / F.lit(10.0)))
    told = Q.shuffle_options(n, "shuffle", "n_regionkey", probs="probs")
    return told.select("n_regionkey", F.array_join("options", "|").alias("options"), "label", F.round(F.get("probs", F.col("label")), 3).alias("p"))


def sample_distractors(spark, sf_dir):
    """Three wrong types for each part; the vocabulary of types is small and shared."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    vocab = p.agg(F.array_sort(F.collect_set("p_type")).alias("all"))
    told = p.crossJoin(F.broadcast(vocab)).withColumn("wrong", S.pick("wrong", F.array_except("all", F.array("p_type")), F.col("p_partkey"), 3))
    return told.select("p_partkey", F.array_join("wrong", "|").alias("wrong"))


def balanced_cap(spark, sf_dir):
    return S.cap_each(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", 40, "cap", "doc_id")


def gallery_sample(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("role = 'user'").withColumn("key", F.concat_ws("-", "conv_id", "turn")).withColumn("set", F.col("conv_id") % 5)
    return S.cap_each(c, "set", 6, "gallery", "key").select("key", "set")


def frame_thinning(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "event_type")
    return e.where(S.uniform("thin", "event_id") < 0.3).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def coin_flips(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.round(S.uniform("coin", "doc_id"), 6).alias("u"), S.whole("die", 6, "doc_id").alias("die"))


def similar_labels(spark, sf_dir, k: int = 3):
    """Wrong labels, half by coin from those that share a word, drawn without replacement within each pool."""
    p = table(spark, sf_dir, "part").select(F.col("p_type").alias("label")).distinct()
    vocab = p.agg(F.array_sort(F.collect_set("label")).alias("all"))
    told = p.crossJoin(F.broadcast(vocab)).withColumn("s", B.similar_and_other(F.col("label"), F.col("all"), k))
    return told.select("label", "s.n_near", F.array_join("s.wrong", "|").alias("wrong"))


def game_phrasing(spark, sf_dir):
    """A random phrasing and label set for each frame, options shuffled."""
    e = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 4).cast("int").alias("label"))
    asks = F.array(F.lit("Which way?"), F.lit("Where should it go?"), F.lit("Pick a move."))
    sets = F.array(F.array(*[F.lit(x) for x in ("up", "down", "left", "right")]), F.array(*[F.lit(x) for x in ("north", "south", "west", "east")]))
    e = e.select("event_id", "label", F.get(asks, S.whole("ask", 3, "event_id")).alias("instructions"), F.get(sets, S.whole("set", 2, "event_id")).alias("options"))
    return Q.shuffle_options(e, "frames", "event_id").select("event_id", "instructions", F.array_join("options", "|").alias("options"), "label")


def count_split_type(spark, sf_dir):
    rows = split_md5_mod20(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id")
    return rows.groupBy("split", F.when(F.col("toxic") == 1, "noul").otherwise("choice").alias("type")).agg(F.count(F.lit(1)).alias("n"))


def tiny_buckets(spark, sf_dir):
    """Question-size buckets of nations per region."""
    n = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.count(F.lit(1)).cast("int").alias("k"))
    return n.select("n_regionkey", A.option_bucket(F.lit("choice"), F.col("k")).alias("bucket"))


_U = "CAST(('0x' || substr(md5({0}), 1, 8)) AS BIGINT)"


def _u(text: str) -> str:
    return _U.format(text)


_DIGIT = "(instr('0123456789abcdef', substr(h, i, 1)) - 1)"
_MOD20 = f"(SELECT doc_id, ((instr('0123456789abcdef', substr(h, 32, 1)) - 1) + 16 * list_sum(list_transform(range(1, 32), lambda i: {_DIGIT}))) % 20 AS bucket FROM (SELECT doc_id, md5(text) AS h FROM documents))"
_SHUF = "list_transform(list_sort(list_transform(range(1, len({o}) + 1), lambda i: [md5('{seed}:' || {key} || ':' || (i - 1)), CAST(i AS VARCHAR)])), lambda s: CAST(s[2] AS INT))"
# CRC-32 of the digits of doc_id: the table of the reflected polynomial, then a byte at a time
_CRC_TABLE = "list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i))"
_CRC = "xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT)), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), 4294967295), 4294967295)"
ORACLE = {
    "split_crc32_mod10": f"SELECT doc_id, CASE WHEN {_CRC} % 10 = 0 THEN 'test' ELSE 'train' END AS split FROM documents, (SELECT {_CRC_TABLE} AS t)",
    "split_md5_mod20": f"SELECT doc_id, CAST(bucket AS INT) AS bucket, CASE WHEN bucket = 0 THEN 'test' ELSE 'train' END AS split FROM {_MOD20}",
    "split_stratified": "SELECT doc_id, quality, CASE WHEN row_number() OVER (PARTITION BY quality ORDER BY md5('split:' || doc_id), doc_id) <= greatest(1, round_even(count(*) OVER (PARTITION BY quality) * 0.2, 0)) THEN 'test' ELSE 'train' END AS split FROM labels",
    "even_odd_halves": "SELECT vec_id, label, CASE WHEN (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) % 2 = 0 THEN 'even' ELSE 'odd' END AS half FROM embeddings",
    "mix_capped_weighted": """WITH w AS (SELECT doc_id, lang, CASE lang WHEN 'en' THEN 0.5 WHEN 'de' THEN 2.0 WHEN 'es' THEN 0.0 ELSE 1.0 END AS w FROM documents), p AS (SELECT *, CAST(greatest(1, floor(w + 0.999)) AS INT) AS passes FROM w),
x AS (SELECT *, unnest(range(1, passes + 1)) AS "pass" FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY md5('mix:' || doc_id || ':' || "pass"), doc_id) AS k, least(floor(count(*) OVER (PARTITION BY lang) / passes * w), floor(150 * w)) AS want FROM x)
SELECT doc_id, lang, CAST("pass" AS INT) AS "pass", md5('mix-order:' || doc_id || ':' || "pass") AS order_key FROM r WHERE k <= want""",
    "rank_shards": """SELECT doc_id, lang, CAST(i // 4 AS INT) AS batch, CAST(i // 4 % 3 AS INT) AS rank FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents) WHERE i // 4 < n // 12 * 3""",
    "shuffle_options": f"""WITH g AS (SELECT n_regionkey, list_sort(list(n_name)) AS o FROM nation GROUP BY 1), s AS (SELECT n_regionkey, o, {_SHUF.format(o="o", seed="shuffle", key="n_regionkey")} AS i FROM g)
SELECT n_regionkey, array_to_string(list_transform(i, lambda x: o[x]), '|') AS options, CAST(list_position(i, 2) - 1 AS INT) AS label, CAST(0.2 AS DOUBLE) AS p FROM s""",
    "sample_distractors": """SELECT p_partkey, string_agg(w, '|' ORDER BY k) AS wrong FROM (SELECT p_partkey, w, row_number() OVER (PARTITION BY p_partkey ORDER BY md5('wrong:' || p_partkey || ':' || w), w) AS k FROM part, (SELECT DISTINCT p_type AS w FROM part) WHERE w <> p_type) WHERE k <= 3 GROUP BY 1""",
    "balanced_cap": "SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5('cap:' || doc_id), doc_id) <= 40",
    "gallery_sample": """SELECT key, "set" FROM (SELECT conv_id || '-' || turn AS key, conv_id % 5 AS "set" FROM conversations WHERE role = 'user') QUALIFY row_number() OVER (PARTITION BY "set" ORDER BY md5('gallery:' || key), key) <= 6""",
    "frame_thinning": f"SELECT event_type, count(*) AS n FROM events WHERE {_u('''('thin:' || event_id)''')} / 4294967296.0 < 0.3 GROUP BY 1",
    "coin_flips": f"SELECT doc_id, round({_u('''('coin:' || doc_id)''')} / 4294967296.0, 6) AS u, CAST({_u('''('die:' || doc_id)''')} % 6 AS INT) AS die FROM documents",
    "similar_labels": f"""WITH v AS (SELECT DISTINCT p_type AS label FROM part), c AS (SELECT label, CAST(list_sum(list_transform([1, 2, 3], lambda i: CASE WHEN {_u("'near:' || label || ':' || i")} / 4294967296.0 < 0.5 THEN 1 ELSE 0 END)) AS INT) AS coins FROM v),
x AS (SELECT a.label, b.label AS w, list_has_any(string_split(a.label, ' '), string_split(b.label, ' ')) AS near FROM v a, v b WHERE a.label <> b.label),
r AS (SELECT x.*, row_number() OVER (PARTITION BY x.label, near ORDER BY md5(CASE WHEN near THEN 'near:' ELSE 'far:' END || x.label || ':' || w), w) AS k, least(coins, count(*) FILTER (WHERE near) OVER (PARTITION BY x.label)) AS n_near FROM x JOIN c USING (label))
SELECT label, CAST(n_near AS INT) AS n_near, string_agg(w, '|' ORDER BY near DESC, k) AS wrong FROM r WHERE (near AND k <= n_near) OR (NOT near AND k <= 3 - n_near) GROUP BY 1, 2""",
    "game_phrasing": f"""WITH e AS (SELECT event_id, CAST(event_id % 4 AS INT) AS label, ['Which way?', 'Where should it go?', 'Pick a move.'][{_u("'ask:' || event_id")} % 3 + 1] AS instructions,
[['up', 'down', 'left', 'right'], ['north', 'south', 'west', 'east']][{_u("'set:' || event_id")} % 2 + 1] AS o FROM events), s AS (SELECT *, {_SHUF.format(o="o", seed="frames", key="event_id")} AS i FROM e)
SELECT event_id, instructions, array_to_string(list_transform(i, lambda x: o[x]), '|') AS options, CAST(list_position(i, label + 1) - 1 AS INT) AS label FROM s""",
    "count_split_type": f"SELECT CASE WHEN bucket = 0 THEN 'test' ELSE 'train' END AS split, CASE WHEN toxic = 1 THEN 'noul' ELSE 'choice' END AS type, count(*) AS n FROM {_MOD20} JOIN labels USING (doc_id) GROUP BY 1, 2",
    "tiny_buckets": "SELECT n_regionkey, 'choice:' || CASE WHEN count(*) <= 2 THEN '2' WHEN count(*) <= 5 THEN '3-5' WHEN count(*) <= 10 THEN '6-10' ELSE '11+' END AS bucket FROM nation GROUP BY 1",
}
_FUNCTIONS = [split_md5_mod20, split_crc32_mod10, split_stratified, even_odd_halves, mix_capped_weighted, rank_shards, shuffle_options, sample_distractors, balanced_cap, gallery_sample, frame_thinning, coin_flips, similar_labels, game_phrasing, count_split_type, tiny_buckets]
QUERIES = {f.__name__: f for f in _FUNCTIONS}
