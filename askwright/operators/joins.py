"""Joins of question rows with teachers, features, earlier output and evaluation sets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sampling as S
from ..functions import text as T
from ..functions.ranks import places
from ..session import settled
from .questions import drawn_pool


def attach_teacher(rows: DataFrame, teacher: DataFrame, keys: list[str], options: str = "k", order: str = "ord") -> DataFrame:
    """Left join with teacher probabilities: null keys match, the last duplicate wins, a wrong number of probabilities is none."""
    last = teacher.groupBy(*keys).agg(F.max_by("probs", order).alias("__probs")).select(*[F.col(k).alias(f"__{k}") for k in keys], "__probs")
    on = F.lit(True)
    for k in keys:
        on = on & rows[k].eqNullSafe(last[f"__{k}"])
    told = rows.join(last, on, "left")
    return told.select(*[rows[c] for c in rows.columns], F.when(F.size("__probs") == F.col(options), F.col("__probs")).alias("probs"))


def with_all_media(rows: DataFrame, features: DataFrame, key: str, media: str = "media", path: str = "path") -> DataFrame:
    """Rows whose media are all in the feature index; rows without media stay.

    Only keys and paths are exploded and joined; the rows themselves meet a list of keys to drop.
    """
    items = rows.select(key, F.explode(media).alias(path)).distinct()
    lost = items.join(features.select(path).distinct(), path, "left_anti").select(key).distinct()
    return rows.join(lost, key, "left_anti")


def not_yet_done(rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that an earlier run has not written; null keys are equal."""
    return rows.join(done.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct(), [rows[k].eqNullSafe(F.col(f"__{k}")) for k in keys], "left_anti")


def held_out_bases(train: DataFrame, test: DataFrame, path: str) -> DataFrame:
    """Train rows that are no augmented copy (`name_3` of `name`) of a test row."""
    base = lambda df: F.regexp_replace(df[path], r"_\d+$", "")
    held = test.select(base(test).alias("__base")).distinct()
    return train.join(held, base(train) == F.col("__base"), "left_anti")


def first_of(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    by = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(by)).where("__n = 1").drop("__n")


def merged(tables: list[DataFrame], keys: list[str], later_wins: bool = True) -> DataFrame:
    """Union of tables in which one row of each key stays: that of the last table, or of the first."""
    rows = None
    for i, t in enumerate(tables):
        t = t.withColumn("__i", F.lit(i if not later_wins else -i))
        rows = t if rows is None else rows.unionByName(t, allowMissingColumns=True)
    return first_of(rows, keys, ["__i"]).drop("__i")


def overlap(evaluation: DataFrame, train: DataFrame, key: str = "id", image: str = "image", text: str = "text") -> DataFrame:
    """(id, tag) of evaluation rows whose image is in training: `question` if the question is too, else `image`.

    Train rows are reduced to distinct (image, normalised text) before the join; a left join on both and a semi-join on the image
    alone replace a set of questions per image, which could be of any size.
    """
    seen = train.where("split = 'train'").select(F.col(image).alias("__image"), T.normalise(F.col(text)).alias("__text")).distinct()
    images = seen.select("__image").distinct()
    rows = evaluation.withColumn("__norm", T.normalise(F.col(text)))
    rows = rows.join(images, rows[image] == F.col("__image"), "left_semi")
    both = seen.select(F.col("__image").alias("__i"), F.col("__text").alias("__t")).withColumn("__hit", F.lit(True))
    told = rows.join(both, (rows[image] == F.col("__i")) & (rows["__norm"] == F.col("__t")), "left")
    return told.select(key, F.when(F.col("__hit"), "question").otherwise("image").alias("tag"))


def contained_items(docs: DataFrame, items: DataFrame, words: int = 8, doc_id: str = "doc_id", item_id: str = "item_id") -> DataFrame:
    """(doc, item) pairs where the normalised item is part of the normalised document.

    Candidates share the hash of the item's first ``words`` words (all of a shorter one) with a run of theirs; only they are compared
    as strings.
    """
    i = items.select(item_id, T.normalise(F.col("text")).alias("item")).where("item <> ''").withColumn("w", F.split("item", " "))
    i = i.withColumn("n", F.least(F.size("w"), F.lit(words))).withColumn("head", F.expr("xxhash64(slice(w, 1, n))")).drop("w")
    d = docs.select(doc_id, T.normalise(F.col("text")).alias("doc"))
    lengths = [r[0] for r in i.select("n").distinct().collect()]  # at most `words` numbers
    runs = None
    for n in sorted(lengths):
        w = d.select(doc_id, F.split("doc", " ").alias("w")).where(F.size("w") >= n)
        r = w.select(doc_id, F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - (n - 1)), lambda k: F.xxhash64(F.slice(F.col("w"), k, F.lit(n)))))).alias("head"))
        runs = r if runs is None else runs.unionByName(r)
    if runs is None:
        return d.crossJoin(i).select(doc_id, item_id).limit(0)
    found = runs.join(i, "head").join(d, doc_id)
    return found.where(F.contains(F.concat(F.lit(" "), F.col("doc"), F.lit(" ")), F.concat(F.lit(" "), F.col("item"), F.lit(" ")))).select(doc_id, item_id).distinct()


def word_negatives(captions: DataFrame, seed: str, key: str = "clip", text: str = "caption", first: int = 4) -> DataFrame:
    """For each caption another clip's that shares a content word: the word drawn by the row, then the caption from all of that word.

    Captions of one text count once and none is drawn that the clip has itself.  Repeated rows count once; captions that share no word with
    another have no row, nor have null ones or those of a null clip.
    """
    base = captions.select(F.col(key), F.col(text), F.md5(F.col(text)).alias("__own")).where(F.col(text).isNotNull() & F.col(key).isNotNull())
    told = drawn_by_word(base, [seed], key, text, first).drop("draw")
    once = base.select("__own", text).dropDuplicates(["__own"])
    told = told.join(once, "__own").select(key, F.col(text), "__other")
    return told.join(once.select(F.col("__own").alias("__other"), F.col(text).alias("negative")), "__other").select(key, text, "negative")


def _counted(batches):
    """(word, bucket, n) of texts whose distinct words are ``__packed``; a batch counts its own."""
    for batch in batches:
        words = pc.split_pattern(batch["__packed"], " ")
        owner, words = pc.list_parent_indices(words), words.flatten()
        if "__in" in batch.schema.names:
            words = pc.binary_join_element_wise(batch["__in"].take(owner), words, ":")
        told = pa.table({"word": words, "bucket": batch["bucket"].take(owner)}).group_by(["word", "bucket"]).aggregate([([], "count_all")])
        yield from told.rename_columns(["word", "bucket", "n"]).to_batches(65_536)


def _nth_of_words(columns: list[str]):
    """The ``nth`` text, by digest, of those that have the asked word, without the asking one; the texts of a bucket and what is asked of them."""

    def run(asks: pa.Table, texts: pa.Table) -> pa.Table:
        texts = texts.sort_by("__own").combine_chunks()
        if len(asks) and len(texts):
            words = pc.split_pattern(texts["__packed"].combine_chunks(), " ")
            names, owner, words = asks["word"].unique(), pc.list_parent_indices(words), words.flatten()
            if "__in" in texts.column_names:
                words = pc.binary_join_element_wise(texts["__in"].combine_chunks().take(owner), words, ":")
            code = pc.index_in(words, value_set=names)
            has = pc.is_valid(code).to_numpy(zero_copy_only=False)
            code, owner = code.drop_null().to_numpy(), owner.to_numpy()[has]
            owner = owner[np.argsort(code, kind="stable")]
            size = np.bincount(code, minlength=len(names))
            place = (np.cumsum(size) - size)[pc.index_in(asks["word"], value_set=names).to_numpy()] + asks["nth"].to_numpy()
            own = pc.fill_null(pc.index_in(asks["__own"], value_set=texts["__own"].combine_chunks()), len(texts)).to_numpy()  # texts of other buckets: after all
            place += owner[place] >= own
            other = texts["__own"].take(pa.array(owner[place]))
        else:
            asks, other = asks.slice(0, 0), pa.chunked_array([], pa.string())
        return asks.select(columns).append_column("__other", other)

    return run


def _row_of(key: str) -> Column:
    return F.concat_ws(":", F.col(key).cast("string"), "__own")


def _ordered_words(head: Column, words: Column) -> Column:
    """The words in the order of their draws; the digest before each has 32 digits."""
    return F.transform(F.sort_array(F.transform(words, lambda w: F.concat(F.md5(F.concat(head, w)), w))), lambda x: F.substring(x, 33, 1 << 30))


def dealt_words(base: DataFrame, seeds: list[str], key: str, text: str, first: int = 4, within: str | None = None, most: int = 4096, draws: Column | None = None) -> DataFrame:
    """(key, __own, __in, bucket, __packed, chances) of distinct captions (key, text, __own), written once: a text's content words in one string,
    null but for the first caption of a text, and for each of the ``draws`` (numbers of the ``seeds``; all) the ``first`` words in the order that the row draws.

    Both are told where the text lies.  Rows are dealt in 64 buckets by md5, each cut by leading digits of the digest so that about ``most`` texts are one part.
    """
    draws = F.array(*[F.lit(i) for i in range(len(seeds))]) if draws is None else draws
    deep, parts = 0, base.select(key).count() // most
    while 64 * 16**deep < parts:
        deep += 1
    bucket = (F.conv(F.substring(F.md5("__own"), 1, 4), 16, 10).cast("int") % 64).cast("long") * 16**deep + (F.conv(F.substring("__own", 1, deep), 16, 10).cast("long") if deep else 0)
    inner = F.lit(None).cast("string") if within is None else F.col(within).cast("string")
    seen = base.select(key, "__own", inner.alias("__in"), bucket.alias("bucket"), draws.alias("__draws"), T.content_words(F.col(text)).alias("__words"))
    heads = F.transform("__draws", lambda d: F.struct(d.alias("draw"), F.concat(_of_draw([s + "-word:" for s in seeds], d), _row_of(key), F.lit(":")).alias("head")))
    chances = F.transform(heads, lambda d: F.struct(d["draw"].alias("draw"), F.slice(_ordered_words(d["head"], _named("__words", within)), 1, first).alias("words")))
    dealt = seen.select(key, "__own", "__in", "bucket", F.array_join("__words", " ").alias("__packed"), chances.alias("chances"))  # a third of the array, where it is shuffled
    dealt = dealt.repartition("bucket").dropDuplicates(["bucket", "__own", key])
    again = F.row_number().over(Window.partitionBy("bucket", "__own").orderBy(key)) > 1
    return settled(dealt.withColumn("__packed", F.when(~again, F.col("__packed"))), "captions")  # after the shuffle, which deals out large files


def _of_draw(names: list[str], draw: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), draw + 1)


def _named(words: Column | str, within: str | None) -> Column:
    """Words of different values of ``within`` are different."""
    return F.transform(words, lambda w: w if within is None else F.concat(F.col("__in"), F.lit(":"), w))


def drawn_by_word(base: DataFrame, seeds: list[str], key: str, text: str, first: int = 4, within: str | None = None, most: int = 4096, captions: DataFrame | None = None) -> DataFrame:
    """(key, __own, draw, __other) of captions (key, text, __own): for each of the ``seeds`` a caption of another clip that shares a content
    word, by their digests.  With ``within`` words of different values of that column are different; the digest has to tell them apart too.
    ``captions`` are those of ``dealt_words``, where only some draws are needed.

    A row's first words in its order are looked up, and only rows none of which another text has try all.  A word's captions are numbered by bucket and
    digest, and the row's own does not count.  Texts are dealt by bucket with their words in one string, so a word is counted there before
    anything is shuffled, and what is asked goes to the texts' words, which are not shuffled one by one.  Clips with several captions go through ``drawn_pool``.
    """
    captions = dealt_words(base, seeds, key, text, first, within, most) if captions is None else captions
    unpacked = _named(F.when(F.col("__packed") == "", F.array().cast("array<string>")).otherwise(F.split("__packed", " ")), within)
    row = _row_of(key)
    rows = captions.select(key, "__own")
    texts = captions.where("__packed is not null").select("__own", "bucket", "__packed", *([] if within is None else ["__in"]))
    several = settled(rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select(key), "clips")
    crowded = not several.isEmpty()

    counted = texts.where("__packed <> ''").drop("__own").mapInArrow(_counted, "word string, bucket long, n long")
    filled = counted.repartition("word").groupBy("word", "bucket").agg(F.sum("n").alias("n"))
    of_word = filled.groupBy("word").agg(F.sum("n").alias("size"), F.array_sort(F.collect_list(F.struct("bucket", "n"))).alias("filled")).where("size > 1")
    drawn = F.conv(F.substring(F.md5(F.concat(_of_draw([s + ":0:" for s in seeds], F.col("draw")), row)), 1, 12), 16, 10).cast("long")
    start = F.struct(F.pmod(drawn, F.col("size") - 1).alias("left"), F.lit(None).cast("long").alias("bucket"))

    def met(s, b):
        others = b["n"] - (b["bucket"] == F.col("mine")).cast("long")
        return F.when(s["bucket"].isNotNull(), s).when(s["left"] < others, F.struct(s["left"].alias("left"), b["bucket"].alias("bucket"))).otherwise(F.struct((s["left"] - others).alias("left"), s["bucket"].alias("bucket")))

    def told(tried: DataFrame) -> DataFrame:
        """(key, __own, draw, x) of (key, __own, mine, draw, words): the first word that another text has and the place of its drawn text, or nulls."""
        tried = tried.select(key, "__own", "mine", "draw", F.posexplode("words").alias("rank", "word"))
        place = F.when(F.col("size").isNotNull(), F.aggregate("filled", start, met))
        x = tried.join(of_word, "word", "left").select(key, "__own", "draw", F.col("size").isNull().alias("none"), "rank", "word", place.alias("m"))
        x = x.select(key, "__own", "draw", F.struct("none", "rank", "word", F.col("m.bucket").alias("bucket"), F.col("m.left").alias("nth")).alias("x"))
        return x.groupBy(key, "__own", "draw").agg(F.min("x").alias("x"))

    single = captions.join(several, key, "left_anti") if crowded else captions
    picks = settled(told(single.select(key, "__own", F.col("bucket").alias("mine"), F.inline("chances"))), "drawn-words")
    rest = picks.where("x.none").select(key, "__own", "draw")
    if not rest.isEmpty():
        rest = rest.join(texts, "__own").withColumn("__words", unpacked).where(F.size("__words") > first)
        words = _ordered_words(F.concat(_of_draw([s + "-word:" for s in seeds], F.col("draw")), row, F.lit(":")), F.col("__words"))
        picks = picks.unionByName(settled(told(rest.select(key, "__own", F.col("bucket").alias("mine"), "draw", words.alias("words"))), "drawn-words"))
    asked = picks.where("not x.none").select(key, "__own", "draw", "x.word", "x.bucket", "x.nth")
    kind = captions.schema[key].dataType.simpleString()
    drawn_of_words = asked.groupBy("bucket").cogroup(texts.groupBy("bucket")).applyInArrow(_nth_of_words([key, "__own", "draw"]), f"`{key}` {kind}, __own string, draw int, __other string")

    if crowded:
        many = rows.join(several, key, "left_semi")
        held = many.groupBy(key).agg(F.collect_set("__own").alias("answers"))
        own = many.join(texts, "__own").withColumn("__words", unpacked).withColumn("__row", row)
        answers = texts.select(F.explode(unpacked).alias("kind"), F.col("__own").alias("answer"))
        for i, s in enumerate(seeds):
            by_row = own.join(held, key).select("__row", "answers", S.shuffled(s + "-word", F.col("__words"), F.col("__row")).alias("kinds"))
            other = drawn_pool(by_row, answers, "__row", s, 1, 1).select("__row", F.col("wrong")[0].alias("__other"))
            drawn_of_words = drawn_of_words.unionByName(own.select(key, "__own", "__row", F.lit(i).alias("draw")).join(other, "__row").drop("__row"))
    return drawn_of_words


def drawn_by_clip(rows: DataFrame, asks: DataFrame, seeds: list[str], key: str, within: str) -> DataFrame:
    """(key, within, __own, draw, __other) of ``asks`` (key, within, __own, draw) about distinct captions (key, within, __own): for each, by the seed of
    its draw, a caption of another clip of the same ``within``, the clip drawn by the row from all, then one of its captions.  Clips and captions are numbered, so none is an array."""
    clips = rows.groupBy(key, within).agg(F.count(F.lit(1)).alias("n"), F.min("__own").alias("only"))
    clips = settled(places(clips, [within], [key]), "clips")
    row = F.concat_ws(":", F.col(key).cast("string"), "__own")
    number = lambda i: F.conv(F.substring(F.md5(F.concat(_of_draw([f"{s}:{i}:" for s in seeds], F.col("draw")), row)), 1, 12), 16, 10).cast("long")
    free = F.pmod(number(1), F.col("of") - 1)
    asked = asks.join(clips.where("of > 1").select(key, within, "at", "of"), [key, within])
    asked = asked.select(key, within, "__own", "draw", (free + (free >= F.col("at")).cast("long")).alias("place"))
    other = clips.select(within, F.col(key).alias("__clip"), F.col("at").alias("place"), "n", "only")
    met = asked.join(other, [within, "place"])
    told = met.where("n = 1").select(key, within, "__own", "draw", F.col("only").alias("__other"))
    if not clips.where("n > 1").isEmpty():
        several = clips.where("n > 1").select(key, within)
        own = settled(places(rows.join(several, [key, within], "left_semi").select(key, within, "__own"), [within, key], ["__own"], "nth", "n"), "clip-captions")
        met = met.where("n > 1").withColumn("nth", F.pmod(number(2), F.col("n"))).drop("n", "only")
        told = told.unionByName(met.join(own.select(within, F.col(key).alias("__clip"), "nth", F.col("__own").alias("__other")), [within, "__clip", "nth"]).select(key, within, "__own", "draw", "__other"))
    return told


def nearest(vectors: DataFrame, k: int = 5, max_sim: float = 0.9, wide: int = 3, block: int = 4096, key: str = "vec_id", vector: str = "embedding", text: str | None = None) -> DataFrame:
    """(key, rank, other, sim): the k most similar others below ``max_sim`` among the ``wide`` * k most similar.

    With ``text``, others of the same normalised text are no neighbours.  Vectors are dealt to hashed blocks; each pair of blocks is one matrix product whose rows keep their best, so what is shuffled
    grows with the number of blocks and not with the number of pairs.  Exact; similarities are rounded to six places.
    """
    import pandas as pd

    n, kind = vectors.count(), "string" if vectors.schema[key].dataType.simpleString() == "string" else "long"
    blocks = max(1, -(-n // block))
    best = wide * k + 1
    rows = vectors.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"), F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("b"))
    grid = F.sequence(F.lit(0), F.lit(blocks - 1))
    sides = rows.withColumn("other", F.explode(grid))
    left = sides.select(F.col("b").alias("i"), F.col("other").alias("j"), F.lit(True).alias("asks"), "id", "v")
    right = sides.select(F.col("other").alias("i"), F.col("b").alias("j"), F.lit(False).alias("asks"), "id", "v")

    def top(group: pd.DataFrame) -> pd.DataFrame:
        a, b = group[group["asks"]], group[~group["asks"]]
        if not len(a) or not len(b):
            return pd.DataFrame({"id": [], "other": [], "sim": []})
        ids, sims = b["id"].to_numpy(), np.round(np.stack(a["v"]) @ np.stack(b["v"]).T, 6)
        by_id = np.unique(ids.astype(str) if ids.dtype == object else ids, return_inverse=True)[1]
        order = np.lexsort((np.broadcast_to(by_id, sims.shape), -sims), axis=1)[:, :best]
        return pd.DataFrame({"id": np.repeat(a["id"].to_numpy(), order.shape[1]), "other": ids[order].ravel(), "sim": np.take_along_axis(sims, order, 1).ravel()})

    told = left.unionByName(right).groupBy("i", "j").applyInPandas(top, f"id {kind}, other {kind}, sim double")
    by = Window.partitionBy("id").orderBy(F.desc("sim"), "other")
    told = told.withColumn("r", F.row_number().over(by)).where(F.col("r") <= wide * k).where((F.col("other") != F.col("id")) & (F.col("sim") < max_sim))
    if text is not None:
        norm = vectors.select(F.col(key).alias("id"), F.md5(T.normalise(F.col(text))).alias("norm"))
        told = told.join(norm, "id").join(norm.select(F.col("id").alias("other"), F.col("norm").alias("its")), "other").where("norm <> its").drop("norm", "its")
    told = told.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    return told.select(F.col("id").alias(key), "rank", "other", "sim")
