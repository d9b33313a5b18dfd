"""Wrong labels from label sets of any size: labels and the labels of each word are numbered, and a row looks up the numbers it draws.

No row sees the label set: what is joined to a row is its own label's words and a fixed number of drawn places.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sampling as S
from ..functions import text as T
from ..functions.ranks import places
from ..session import settled


def label_index(labels: DataFrame, label: str = "label", parts: Callable[[Column], Column] = T.words) -> tuple[DataFrame, DataFrame]:
    """(label, at, of) with the places of the distinct labels, and (word, label, at, of) with those of the labels of each word (``parts``)."""
    once = labels.select(F.col(label).alias("label")).where("label is not null").distinct()
    words = once.select(F.explode(F.array_distinct(parts(F.col("label")))).alias("word"), "label").where("word <> ''")
    return places(once, [], ["label"]), places(words, ["word"], ["label"])


def wrong_labels(rows: DataFrame, labels: DataFrame, key: str, label: str, k: int = 3, seed: str = "near", spare: int = 3, parts: Callable[[Column], Column] = T.words) -> DataFrame:
    """(key, n_near, wrong): ``k`` distinct wrong labels for each row, by a coin each from those that share a word with its own or from the rest.

    Labels that share a word: a row draws a word of its label for each, then a place among the word's other labels.  The rest: places among
    all other labels.  ``spare`` more are drawn of either, so that equal ones and those of the rest that share a word after all are passed over; where
    one side has too few the other fills up.  Fewer than ``k`` there are only where there are fewer other labels.  Keys are unique; a row
    whose label is null or not among ``labels`` has no row here.
    """
    numbered, of_words = label_index(labels, label, parts)
    numbered, of_words = settled(numbered, "labels"), settled(of_words, "label-words")
    own = settled(rows.select(F.col(key).alias("key"), F.col(label).alias("label")).join(numbered, "label"), "own-labels")
    number = lambda kind, i, n: F.pmod(F.conv(F.substring(S.draw(f"{seed}-{kind}", F.lit(i), "key"), 1, 12), 16, 10).cast("long"), n)
    skipped = lambda free: free + (free >= F.col("at")).cast("long")  # noqa: E731  past one's own place
    draws = k + spare

    far, taken = own, F.array("at")  # without replacement: a number is moved past the smaller places that are taken
    for i in range(draws):
        free = number("far", i, F.col("of") - 1 - i)
        far = far.withColumn(f"p{i}", F.when(F.col("of") - 1 > i, F.aggregate(F.array_sort(taken), free, lambda place, t: place + (t <= place).cast("long"))))
        taken = F.concat(taken, F.array(f"p{i}"))
    far = far.select("key", "label", F.posexplode(F.array_compact(F.array(*[f"p{i}" for i in range(draws)]))).alias("i", "place"))
    far = far.join(numbered.select(F.col("at").alias("place"), F.col("label").alias("other")), "place").select("key", "label", "i", "other", F.lit(False).alias("near"))
    # the words that other labels have too, in the row's order; a draw takes the next of them, from the first again after the last
    shared = of_words.where("of > 1").groupBy("label").agg(F.array_sort(F.collect_list(F.struct("word", "at", "of"))).alias("shared"))  # a label's own words
    ordered = F.transform(F.array_sort(F.transform("shared", lambda w: F.struct(F.md5(F.concat_ws(":", F.lit(f"{seed}-word"), F.col("key").cast("string"), w["word"])).alias("d"), w.alias("w")))), lambda x: x["w"])
    near = own.select("key", "label").join(shared, "label").withColumn("shared", ordered)
    near = near.select("key", "label", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(draws - 1)), lambda i: F.get("shared", i % F.size("shared")))).alias("i", "w")).select("key", "label", "i", "w.word", "w.at", "w.of")
    near = near.withColumn("place", skipped(number("near", F.col("i"), F.col("of") - 1)))
    near = near.join(of_words.select("word", F.col("at").alias("place"), F.col("label").alias("other")), ["word", "place"]).select("key", "label", "i", "other", F.lit(True).alias("near"))

    drawn = far.unionByName(near).withColumn("near", F.arrays_overlap(parts(F.col("label")), parts(F.col("other"))))
    told = drawn.groupBy("key", "label", "other").agg(F.min("i").alias("i"), F.first("near").alias("near"))
    told = told.groupBy("key").agg(*[F.transform(F.array_sort(F.collect_list(F.when(F.col("near") == side, F.struct("i", "other")))), lambda x: x["other"]).alias(name) for side, name in ((True, "close"), (False, "others"))])
    heads = sum((F.when(S.uniform(f"{seed}-coin", "key", F.lit(i)) < 0.5, 1).otherwise(0) for i in range(1, k)), F.when(S.uniform(f"{seed}-coin", "key", F.lit(0)) < 0.5, 1).otherwise(0))
    n = F.least(F.size("close"), F.greatest(heads, k - F.size("others")))
    wrong = F.concat(F.slice("close", F.lit(1), n), F.slice("others", F.lit(1), F.lit(k) - n))
    return told.select(F.col("key").alias(key), n.alias("n_near"), wrong.alias("wrong"))
