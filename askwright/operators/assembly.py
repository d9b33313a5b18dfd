"""Putting rows together before training or evaluation: predicates, limits, joins of clips with what is known about them, layouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import sampling as S
from ..functions import text as T
from ..functions.ranks import places
from .questions import shuffle_options

# How a description says that a clip has no speech or no music, and the twelve keys.
NO_SPEECH = r"(?i)\b(no|not contain any|does not contain|doesn't contain|without)\b[^.]*\bspeech"
NO_MUSIC = r"(?i)\b(no|not contain any|does not contain|doesn't contain|without)\b[^.]*\bmusic"
KEYS = ("C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B")


def modality(images: Column, audios: Column, which: str) -> Column:
    """Whether a row's media are pictures alone (`image`), hold a sound (`audio`), or are there at all (`any`)."""
    has = lambda c: F.coalesce(F.size(F.filter(c, lambda x: x.isNotNull() & (x != ""))), F.lit(0)) > 0
    return {"image": has(images) & ~has(audios), "audio": has(audios), "any": has(images) | has(audios)}[which]


def has_speech(description: Column) -> Column:
    return ~F.coalesce(description, F.lit("")).rlike(NO_SPEECH)


def has_music(description: Column) -> Column:
    return ~F.coalesce(description, F.lit("")).rlike(NO_MUSIC)


def without_mask(text: Column, mask: str = "[MASK]") -> Column:
    """Text in which the tokenizer's mask token is a blank, so that a user cannot add a marker."""
    return F.replace(text, F.lit(mask), F.lit(" "))


def state_text(rows: DataFrame, state: str) -> Column:
    """A text state as it is, any other as JSON."""
    return F.col(state) if isinstance(rows.schema[state].dataType, StringType) else F.to_json(F.col(state))


def rebased(path: Column, old: str, new: str) -> Column:
    """A path below ``old`` as one below ``new``; other paths are left as they are."""
    root = old if old.endswith("/") else old + "/"
    return F.when(F.startswith(path, F.lit(root)), F.concat(F.lit(new.rstrip("/") + "/"), F.substring(path, len(root) + 1, 1 << 30))).otherwise(path)


def first_of_each(rows: DataFrame, group: str, order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows of each set; the window's limit drops the others before the shuffle."""
    by = Window.partitionBy(group).orderBy(*order)
    return rows.withColumn("__rank", F.row_number().over(by)).where(F.col("__rank") <= n).drop("__rank")


def sets_for(rows: DataFrame, group: str, audio: str, hears: bool) -> DataFrame:
    """Rows of the sets that a model can answer: a set that has a sound anywhere is skipped whole by one that hears none."""
    if hears:
        return rows
    silent = rows.groupBy(group).agg(F.bool_or(F.col(audio).isNotNull()).alias("__a")).where("not __a").select(group)
    return rows.join(silent, group, "left_semi")


def gallery(rows: DataFrame, group: str, key: str, media: list[str], per: int = 6, seed: str = "gallery", split: str = "split") -> DataFrame:
    """Up to ``per`` test rows with media of each set, by draw."""
    some = rows.where((F.col(split) == "test") & F.coalesce(*[F.col(m) for m in media]).isNotNull())
    return S.cap_each(some, group, per, seed, key)


def held_out_sets(rows: DataFrame, names: list[str], group: str = "source", split: str = "split") -> DataFrame:
    """Sets that are never trained on: all their train and test rows are test rows of `holdout:name`."""
    out = F.col(group).isin(names)
    kept = rows.where(~out | F.col(split).isin("train", "test"))
    return kept.withColumns({group: F.when(out, F.concat(F.lit("holdout:"), F.col(group))).otherwise(F.col(group)), split: F.when(out, "test").otherwise(F.col(split))})


def with_answers(clips: DataFrame, answers: DataFrame, key: str, split: str = "split") -> DataFrame:
    """Clips with what is asked and answered about them; only train clips get answers."""
    told = [c for c in answers.columns if c != key]
    joined = clips.join(answers, key, "left")
    return joined.withColumns({c: F.when(F.col(split) == "train", F.col(c)) for c in told})


def by_suffix(members: DataFrame, metadata: DataFrame, member: str = "member", location: str = "location", parts: int = 2) -> DataFrame:
    """Archive members with the metadata whose location is their last ``parts`` path parts."""
    tail = F.array_join(F.slice(F.split(member, "/"), F.greatest(F.lit(1), F.size(F.split(member, "/")) - (parts - 1)), parts), "/")
    return members.withColumn(location, tail).join(metadata, location)


def frames_of(spans: DataFrame, frames: DataFrame, store: str = "store", low: str = "lo", high: str = "hi", frame: str = "frame") -> DataFrame:
    """Frames of half-open spans [low, high): both sides meet in bins of a store, and the ends are compared there.

    A span's bins are as wide as the greatest power of 16 that it holds, so it is cut in at most 17, whatever its length, and the frames it
    meets are at most three times its own.  A frame is a row for each width that occurs (16 at most).  Empty spans and nulls meet none.
    """
    first, last = F.col(low).cast("long"), F.col(high).cast("long") - 1
    level = sum((F.when(last - first + 1 >= 16**i, 1).otherwise(0) for i in range(1, 16)), F.lit(0))
    cut = spans.where(first <= last).withColumn("__level", level)
    levels = [r[0] for r in cut.select("__level").distinct().collect()]  # at most 16 numbers
    cut = cut.withColumn("__bin", F.explode(F.sequence(F.expr(f"shiftright(cast({low} as bigint), 4 * __level)"), F.expr(f"shiftright(cast({high} as bigint) - 1, 4 * __level)"))))
    binned = frames.withColumn(frame, F.col(frame).cast("long")).withColumn("__level", F.explode(F.array(*[F.lit(x) for x in levels]).cast("array<int>")))
    binned = binned.withColumn("__bin", F.expr(f"shiftright({frame}, 4 * __level)"))
    return cut.join(binned, [store, "__level", "__bin"]).where((F.col(frame) >= first) & (F.col(frame) <= last)).drop("__level", "__bin")


def with_media(rows: DataFrame, source: DataFrame, key: str, media: list[str]) -> DataFrame:
    """Rows with the media columns of their source, read in a second scan, after questions and pools were made of the text columns alone."""
    return rows.join(source.select(key, *media), key, "left")


def clip_files(rows: DataFrame, key: str, samples: str, rate: int, seconds: int = 0, ext: str = "flac") -> DataFrame:
    """Rows of usable clips with the file of the clip and the samples that are kept of it.

    A clip of under a tenth of a second is dropped with all its rows; of a longer one than ``seconds`` the middle is kept.  One file a
    clip, named by the clip's digest, so that names need no counting.
    """
    ok = rows.groupBy(key).agg(F.min(samples).alias("__n")).where(F.col("__n") >= rate // 10)
    limit = F.lit(seconds * rate) if seconds else F.col("__n")
    kept = F.least(F.col("__n"), limit)
    ok = ok.select(key, F.concat(F.substring(F.sha1(F.col(key).cast("string").cast("binary")), 1, 16), F.lit(f".{ext}")).alias("file"), F.expr("0L").alias("start") if not seconds else F.floor((F.col("__n") - kept) / 2).alias("start"), kept.cast("long").alias("n_kept"))
    return rows.join(ok, key)


def labelling_progress(rows: DataFrame, probs: str = "probs", label: str = "label") -> DataFrame:
    """How many rows a teacher labelled, on how many it failed, and how often its likeliest option is the label."""
    best = F.array_position(F.col(probs), F.array_max(probs)) - 1
    told = F.col(probs).isNotNull()
    right = F.count_if(told & (best == F.col(label)))
    return rows.agg(F.count_if(told).alias("labelled"), F.count_if(~told).alias("failed"), F.round(right / F.greatest(F.lit(1), F.count_if(told)), 6).alias("accuracy"))


def phrased(rows: DataFrame, asks: list[str], sets: list[list[str]], seed: str, key: str, augment: bool = True) -> DataFrame:
    """A frame's question: a drawn phrasing and label set with options in a drawn order, or the first of each as they are."""
    asked, named = F.array(*map(F.lit, asks)), F.array(*[F.array(*map(F.lit, s)) for s in sets])
    if not augment:
        return rows.withColumns({"instructions": asked[0], "options": named[0]})
    rows = rows.withColumns({"instructions": F.get(asked, S.whole(seed + "-ask", len(asks), key)), "options": F.get(named, S.whole(seed + "-set", len(sets), key))})
    return shuffle_options(rows, seed, key)


def similar_and_other(label: Column, vocabulary: Column, k: int = 3, seeds: tuple[str, str] = ("near", "far")) -> Column:
    """struct(n_near, wrong): k wrong labels of an array of distinct ones, without replacement.

    A coin for each says whether it comes from the labels that share a word with the right one or from the others; where too few
    share one, others take their place.  The vocabulary is that of a label set's classes and small.
    """
    near = F.filter(vocabulary, lambda x: (x != label) & F.arrays_overlap(T.words(x), T.words(label)))
    far = F.filter(vocabulary, lambda x: (x != label) & ~F.arrays_overlap(T.words(x), T.words(label)))
    heads = [F.when(S.uniform(seeds[0], label, F.lit(i)) < 0.5, 1).otherwise(0) for i in range(1, k + 1)]
    n = F.least(F.size(near), sum(heads[1:], heads[0]))
    return F.struct(n.alias("n_near"), F.concat(S.pick(seeds[0], near, label, n), S.pick(seeds[1], far, label, F.lit(k) - n)).alias("wrong"))


def rank_batches(rows: DataFrame, group: str, order: str, batch: int, world: int) -> DataFrame:
    """Batches of a group's rows dealt to ranks in turn, the same number to each; what does not fill a round is left out."""
    rows = places(rows, [group], [order], "__at", "__of")
    rows = rows.withColumn("__at", F.floor(F.col("__at") / batch))
    rows = rows.where(F.col("__at") < F.floor(F.col("__of") / (batch * world)) * world)
    return rows.withColumns({"batch": F.col("__at").cast("int"), "rank": F.pmod("__at", F.lit(world)).cast("int")}).drop("__at", "__of")


def splice_order(valid: Column, texts: Column) -> Column:
    """Where the tokens of a row come from: [CLS], the media tokens that are there, the text, then the masked media tokens.

    Positions before: 0 is [CLS], 1 to size(valid) are media, the other ``texts`` - 1 are text.
    """
    media = F.when(F.size(valid) > 0, F.sequence(F.lit(1), F.size(valid))).otherwise(F.expr("cast(array() as array<int>)"))
    there = F.filter(media, lambda i: F.get(valid, i - 1))
    masked = F.filter(media, lambda i: ~F.get(valid, i - 1))
    text = F.when(texts > 1, F.sequence(F.size(valid) + 1, F.size(valid) + texts - 1)).otherwise(F.expr("cast(array() as array<int>)"))
    return F.concat(F.array(F.lit(0)), there, text, masked)


def padded(items: Column, size: int, filler: Column) -> Column:
    """struct(items, mask): cut or filled to ``size``, the mask true where an item is one of the row's."""
    n = F.least(F.size(items), F.lit(size))
    whole = F.concat(F.slice(items, F.lit(1), n), F.array_repeat(filler, F.lit(size) - n))
    return F.struct(whole.alias("items"), F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: i < n).alias("mask"))


def inverted(m: Column) -> Column:
    """Values to keys; of several keys with one value the last stays."""
    entries = F.map_entries(m)
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda later: later["value"] == e["value"]))
    return F.map_from_entries(F.transform(last, lambda e: F.struct(e["value"].alias("key"), e["key"].alias("value"))))


def difference_hash(grey: Column, size: int = 16) -> Column:
    """Hex of a perceptual hash: for each of ``size`` rows of ``size`` + 1 grey values (row by row), whether each is brighter than the one before."""
    at = lambda k: F.floor(k / size).cast("int") + k
    bit = lambda g, k: F.when(F.get(g, at(k) + 1) > F.get(g, at(k)), 1).otherwise(0)
    digit = lambda g, d: F.lower(F.hex(8 * bit(g, 4 * d) + 4 * bit(g, 4 * d + 1) + 2 * bit(g, 4 * d + 2) + bit(g, 4 * d + 3)))
    told = lambda g: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(size * size // 4 - 1)), lambda d: digit(g, d)), "")
    return F.get(F.transform(F.array(grey), told), F.lit(0))  # a variable: the values are worked out once, not for every bit


def music_facts(bpm: Column, root: Column, mode: Column, prob: Column, metre: Column, key: Column, seed: str = "music") -> Column:
    """An array of (kind, options, label): tempo, mode, key root and metre, each where the annotation is clear enough."""
    one = lambda when, kind, options, label: F.when(when, F.struct(F.lit(kind).alias("kind"), options.alias("options"), label.cast("int").alias("label")))
    words = lambda *w: F.array(*map(F.lit, w))
    far = F.least(F.abs(bpm - 80), F.abs(bpm - 120)) > 5
    others = F.array_remove(words(*KEYS), root)
    roots = S.shuffled(seed + "-order", F.concat(S.pick(seed, others, key, 3), F.array(root)), key)
    return F.array_compact(
        F.array(
            one(far, "tempo", words("slow", "moderate", "fast"), F.when(bpm < 80, 0).when(bpm < 120, 1).otherwise(2)),
            one(prob > 0.6, "mode", words("major", "minor"), mode == "minor"),
            one((prob > 0.7) & root.isin(*KEYS), "key", roots, F.array_position(roots, root) - 1),
            one(metre.isin(3, 4), "metre", words("three", "four"), metre == 4),
        )
    )
