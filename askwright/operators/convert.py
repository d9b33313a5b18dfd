"""Raw data sets to typed-question rows, as a registry: name -> function of DataFrames.

Every converter returns (id, state, type, instructions, criteria, label, split) and, where its rows belong together, grp and rot.
Families share a builder: labelled clips and pictures, captions, listed options, yes or no, pooled answers.  Raw columns are named in
each docstring; media stay references.  Draws are md5 draws on the row's id, so a converter's rows do not depend on partitioning.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StringType, StructField, StructType

from ..functions import sampling as S
from ..functions import text as T
from ..session import settled
from . import questions as Q
from . import assembly as A
from .joins import dealt_words, drawn_by_clip, drawn_by_word, held_out_bases
from .labels import wrong_labels
from .neighbours import similar

CONVERTERS: dict[str, Callable[..., DataFrame]] = {}
IMAGE, AUDIO, BOTH = Q.STATES["image"], Q.STATES["audio"], Q.STATES["image+audio"]
PHOTO = "Photo."


def converter(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    CONVERTERS[f.__name__] = f
    return f


def _row(id_: Column, state: Column | str, kind: str, ask: Column | str, criteria: Column | None, label: Column, split: Column | str, *more: Column) -> list[Column]:
    text = lambda c: F.lit(c) if isinstance(c, str) else c
    none = F.lit(None).cast("array<string>")
    return [id_.cast("string").alias("id"), text(state).alias("state"), F.lit(kind).alias("type"), text(ask).alias("instructions"), (none if criteria is None else criteria).alias("criteria"), label.cast("int").alias("label"), text(split).alias("split"), *more]


def _ordered(seed: str, key: Column, options: Column) -> Column:
    return S.shuffled(seed + "-order", F.array_distinct(options), key)


def of_options(df: DataFrame, options: Column, answer: Column, state: Column | str, ask: Column | str, split: Column | str, id_: str = "id") -> DataFrame:
    """A choice of the listed options; rows with too few, equal or no right one are left out."""
    rows = df.withColumns({"__o": options, "__a": answer.cast("int")})
    rows = rows.where((F.size("__o") >= 2) & (F.size(F.array_distinct("__o")) == F.size("__o")) & F.col("__a").between(0, F.size("__o") - 1))
    return rows.select(*_row(F.col(id_), state, "choice", ask, F.col("__o"), F.col("__a"), split))


def yes_no(df: DataFrame, answer: Column, state: Column | str, ask: Column | str, split: Column | str, id_: str = "id", *more: Column) -> DataFrame:
    said = F.lower(T.strip(answer))
    return df.where(said.isin("yes", "no")).select(*_row(F.col(id_), state, "noul", ask, None, said == "yes", split, *more))


def labelled(df: DataFrame, label: str, which: str, is_it: str | None, state: str, split: Column | str, seed: str, id_: str = "id", most: int = 3, name: Callable[[Column], Column] = lambda c: c, vocab: DataFrame | None = None) -> DataFrame:
    """Which of these, with 1 to ``most`` other labels, and is it this one, true by a coin.  The vocabulary is one small row."""
    words = (df if vocab is None else vocab).agg(F.array_sort(F.collect_set(label)).alias("__all"))
    rows = df.crossJoin(F.broadcast(words)).withColumn("__w", F.array_except("__all", F.array(label)))
    key = F.col(id_)
    wrong = S.pick(seed, F.col("__w"), key, S.whole(seed + "-many", most, key) + 1)
    options = _ordered(seed, key, F.concat(wrong, F.array(F.col(label))))
    rows = rows.withColumn("__o", options).where(F.size("__o") >= 2)
    out = rows.select(*_row(key, state, "choice", which, F.transform("__o", name), F.array_position("__o", F.col(label)) - 1, split))
    if is_it is None:
        return out
    shown = F.when(S.uniform(seed + "-coin", key) < 0.5, F.col(label)).otherwise(F.get(S.pick(seed + "-other", F.col("__w"), key, 1), 0))
    asked = rows.withColumn("__s", shown)
    return out.unionByName(asked.select(*_row(key, state, "noul", F.replace(F.lit(is_it), F.lit("{}"), name(F.col("__s"))), None, F.col("__s") == F.col(label), split)))


MATCH_ASKS = ("Does this description fit?", "Is this an accurate description?", "Is this what it shows or sounds like?")
PICK_ASKS = ("Which description fits best?", "Which of these is described?", "What is going on here?")


def _told_small(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` with that column of whole texts compressed, for shuffles: 43 bytes of 100, where blocks of a shuffle have 64."""

    def run(batches):
        import zstandard

        small = zstandard.ZstdCompressor().compress
        for batch in batches:
            told = pa.array([None if x is None else small(x.as_buffer()) for x in batch[text]], pa.binary())
            yield batch.set_column(batch.schema.get_field_index(text), text, told)

    return rows.mapInArrow(run, StructType([StructField(f.name, BinaryType()) if f.name == text else f for f in rows.schema]))


def _told_whole(rows: DataFrame, lists: str, text: str) -> DataFrame:
    """``rows`` with the compressed texts in a list of (draw, text) whole again, some rows at a time."""

    def run(batches):
        import zstandard

        whole = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for at in range(0, len(batch), 128):
                part = batch.slice(at, 128)
                flat = part[lists].flatten()
                told = pa.StructArray.from_arrays([flat.field("draw"), pa.array([whole(x.as_buffer()) for x in flat.field(text)], pa.binary()).cast(pa.string())], ["draw", text])
                ends = pc.cumulative_sum(pc.list_value_length(part[lists]))
                told = pa.ListArray.from_arrays(pa.concat_arrays([pa.array([0], ends.type), ends]), told)
                yield part.set_column(part.schema.get_field_index(lists), lists, told)

    kind = ArrayType(StructType([StructField("draw", IntegerType()), StructField(text, StringType())]))
    return rows.mapInArrow(run, StructType([StructField(f.name, kind) if f.name == lists else f for f in rows.schema]))


def captioned(df: DataFrame, state: str, split: str, seed: str, clip: str = "id", caption: str = "caption", near: DataFrame | None = None) -> DataFrame:
    """Does this fit, and which fits: a negative or the caption by a coin, and one to three negatives beside the caption.

    Each negative is by a coin of its own a caption of the same split that shares a content word, where there is one, or any of another clip;
    ``near`` (clip, negative) takes the place of the first kind.  Asks are drawn too.  A caption whose split has no other clip is asked about
    alone.  Captions of one split that agree when they are normalised are one, so none is a negative of the other; equal negatives are one
    option; null and empty captions and null clips are left out.
    """
    base = df.select(F.col(clip).alias("clip"), F.col(caption).alias("caption"), F.coalesce(F.col(split), F.lit("")).alias("split")).where("caption <> '' and clip is not null")
    norm = F.coalesce(F.nullif(T.normalise(F.col("caption")), F.lit("")), F.col("caption"))
    base = base.withColumn("__own", F.md5(F.concat_ws(":", F.col("split"), norm)))
    seeds = [f"{seed}-{i}" for i in range(4)]
    by = ["clip", "split", "__own"]
    row = F.concat_ws(":", F.col("clip").cast("string"), "__own")
    shown, many = S.uniform(seed + "-coin", row) < 0.5, S.whole(seed + "-many", 3, row) + 1
    # the draws that a row needs: the first for the match, unless the caption itself is shown, and those of its options; and which of them are near
    needed = F.filter(F.array(*[F.lit(i) for i in range(4)]), lambda i: F.when(i == 0, ~shown).otherwise(i <= many))
    is_near = lambda i: F.pmod(F.conv(F.substring(S.draw(seed + "-near", i, row), 1, 8), 16, 10).cast("long"), F.lit(2)) == 0
    captions = dealt_words(base, seeds, "clip", "caption", within="split", draws=F.filter(needed, is_near))
    rows = captions.select("clip", F.col("__in").alias("split"), "__own")
    asks = rows.select(*by, F.explode(needed).alias("draw"))
    close = settled(drawn_by_word(base, seeds, "clip", "caption", within="split", captions=captions).select("clip", "__own", "draw", "__other"), "near-captions")
    close = asks.where(is_near(F.col("draw"))).join(close, ["clip", "__own", "draw"], "left")
    far = drawn_by_clip(rows, asks.where(~is_near(F.col("draw"))).unionByName(close.where("__other is null").drop("__other")), seeds, "clip", "split")
    drawn = close.where("__other is not null").unionByName(far).where("__other <> __own")  # another clip may have the same caption
    texts = base.groupBy(F.col("__own").alias("__other")).agg(F.min("caption").alias("text"))
    told = drawn.join(_told_small(texts, "text"), "__other").drop("__other")
    if near is not None:
        hard = _told_small(near.select("clip", F.col("negative").alias("__hard")).dropDuplicates(["clip"]), "__hard")
        told = told.join(hard, "clip", "left").withColumn("text", F.when(is_near(F.col("draw")), F.coalesce("__hard", "text")).otherwise(F.col("text"))).drop("__hard")
    own = _told_small(base.select(*by, F.lit(-1).alias("draw"), F.col("caption").alias("text")), "text")
    told = told.unionByName(own).repartition(*by).groupBy(*by).agg(F.array_sort(F.collect_set(F.struct("draw", "text"))).alias("drawn"))
    rows = _told_whole(told, "drawn", "text").withColumn("row", row)
    of = lambda keep: F.transform(F.filter("drawn", keep), lambda x: x["text"])
    rows = rows.withColumn("caption", F.array_min(of(lambda x: x["draw"] < 0)))
    rows = rows.withColumn("said", F.coalesce(F.get(of(lambda x: x["draw"] == 0), 0), F.col("caption")))
    rows = rows.withColumn("options", S.shuffled(seed + "-order", F.concat(F.array_distinct(F.array_remove(of(lambda x: x["draw"] > 0), F.col("caption"))), F.array("caption")), F.col("row")))
    ask = lambda asks, name: F.get(F.array(*map(F.lit, asks)), S.whole(seed + name, len(asks), F.col("row")))
    match = _row(F.col("clip"), state, "noul", F.concat(ask(MATCH_ASKS, "-match"), F.lit(' "'), F.col("said"), F.lit('"')), None, F.col("said") == F.col("caption"), F.col("split"))
    pick = _row(F.col("clip"), state, "choice", ask(PICK_ASKS, "-pick"), F.col("options"), F.array_position("options", F.col("caption")) - 1, F.col("split"))
    both = F.array(F.struct(*match), F.when(F.size("options") > 1, F.struct(*pick)))
    return rows.select(F.inline(F.filter(both, lambda x: x.isNotNull())))


def pooled(df: DataFrame, state: str, split: Column, seed: str, id_: str = "id", kind: str | None = None) -> DataFrame:
    """Short answers with wrong ones of questions of the same kind (``kind``, or the question's first words)."""
    rows = df.withColumn("__k", F.array(F.col(kind)) if kind else F.array_distinct(T.question_kinds(F.col("question"))))
    pool = rows.select(F.explode("__k").alias("kind"), "answer").distinct()
    wrong = Q.drawn_pool(rows.select(F.col(id_).alias("id"), "answer", F.col("__k").alias("kinds")), pool, "id", seed).select("id", "wrong")
    rows = rows.join(wrong.withColumnRenamed("id", "__id"), rows[id_] == F.col("__id"))
    key = F.col(id_)
    options = _ordered(seed, key, F.concat(F.slice(F.col("wrong"), F.lit(1), S.whole(seed + "-many", 3, key) + 1), F.array("answer")))
    rows = rows.withColumn("__o", options)
    return rows.select(*_row(key, state, "choice", F.col("question"), F.col("__o"), F.array_position("__o", F.col("answer")) - 1, split))


def _crc_split(c: Column, n: int = 10) -> Column:
    return F.when(F.crc32(c.cast("string").cast("binary")) % n == 0, "test").otherwise("train")


def _mod_split(c: Column, n: int) -> Column:
    return F.when(F.pmod(c.cast("long"), F.lit(n)) == 0, "test").otherwise("train")


# ---- pictures ----


@converter
def aokvqa(df):
    """id, question, choices[], correct_choice_idx, split"""
    return of_options(df, F.col("choices"), F.col("correct_choice_idx"), PHOTO, F.col("question"), F.col("split"))


@converter
def scienceqa(df):
    """id, question, choices[], answer (index), hint, split"""
    return of_options(df, F.col("choices"), F.col("answer"), F.coalesce(F.nullif(T.strip(F.col("hint")), F.lit("")), F.lit(IMAGE)), F.col("question"), F.col("split"))


@converter
def vqav2(df):
    """id, image_id, question, multiple_choice_answer, answer_type, question_type"""
    split, answer, key = _crc_split(F.col("image_id")), F.col("multiple_choice_answer"), F.col("id")
    out = yes_no(df.where("answer_type = 'yes/no'"), answer, PHOTO, F.col("question"), split)
    n = answer.try_cast("int")
    near = F.filter(F.sequence(F.greatest(F.lit(0), n - 3), n + 3), lambda x: x != n)
    picked = S.pick("vqa", F.transform(near, lambda x: x.cast("string")), key, S.whole("vqa-many", 3, key) + 1)
    rows = df.where((F.col("answer_type") == "number") & n.between(0, 20)).withColumn("__o", _ordered("vqa", key, F.concat(picked, F.array(n.cast("string")))))
    out = out.unionByName(rows.select(*_row(key, PHOTO, "choice", F.col("question"), F.col("__o"), F.array_position("__o", n.cast("string")) - 1, split)))
    other = df.where((F.col("answer_type") == "other") & (F.length(answer) <= 40)).withColumn("answer", answer)
    return out.unionByName(pooled(other, PHOTO, split, "vqa-pool", kind="question_type"))


@converter
def imagenet(df):
    """id, label, split"""
    return labelled(df, "label", "What is shown in this image?", None, PHOTO, F.col("split"), "imagenet")


@converter
def cauldron(df):
    """id, images[] (content hashes), texts[] {user, assistant}: every turn of every row through the rule cascade"""
    split = F.when(S.md5_mod20(F.md5(F.array_join("images", ""))) == 0, "test").otherwise("train")
    turns = df.where(F.size("images") > 0).select(F.col("id").alias("__row"), split.alias("split"), F.posexplode("texts").alias("at", "t"))
    turns = turns.select(F.concat_ws("-", F.col("__row").cast("string"), F.col("at").cast("string")).alias("id"), "split", "t.user", "t.assistant")
    told = Q.cascade(turns.select("id", "user", "assistant"))
    return told.join(turns.select("id", "split"), "id").select("id", "state", "type", "instructions", F.when(F.size("criteria") > 0, F.col("criteria")).alias("criteria"), "label", "split")


@converter
def gqa(df, images=None):
    """id, imageId, question, answer, kind, split; ``images`` keeps the rows whose picture is there"""
    if images is not None:
        df = df.join(images.select(F.col("id").alias("imageId")).distinct(), "imageId", "left_semi")
    out = yes_no(df, F.col("answer"), PHOTO, F.col("question"), F.col("split"))
    rest = df.where(~F.lower("answer").isin("yes", "no")).withColumn("__two", T.alternatives(F.col("question"), F.col("answer")))
    two = rest.where("__two is not null")
    out = out.unionByName(of_options(two, F.col("__two"), F.array_position("__two", F.col("answer")) - 1, PHOTO, F.col("question"), F.col("split")))
    return out.unionByName(pooled(rest.where("__two is null"), PHOTO, F.col("split"), "gqa", kind="kind"))


@converter
def cc3m(df, vectors=None, k: int = 30, max_sim: float = 0.9):
    """id, caption, split: captions of three words and more; with ``vectors`` (id, embedding) a negative is one of the nearest by ``similar``

    As in the reference the four nearest are passed over where there are more, and neighbours are of the same split.
    """
    df = df.where(F.size(T.words(F.col("caption"))) >= 3)
    if vectors is None:
        return captioned(df, IMAGE, "split", "cc3m")
    near = None
    for r in df.select("split").distinct().collect():
        own = df.where(F.col("split") == r["split"]).select("id", "caption")
        found = similar(own.join(vectors.select("id", "embedding"), "id"), k, max_sim, key="id", text="caption")
        near = found if near is None else near.unionByName(found)
    if near is None:
        return captioned(df, IMAGE, "split", "cc3m")
    near = near.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", "other"))).alias("n"))
    hard = F.when(F.size("n") > 4, F.slice("n", F.lit(5), F.lit(k))).otherwise(F.col("n"))
    near = near.withColumn("hard", hard).select(F.col("id").alias("clip"), F.get("hard", S.whole("cc3m-near", F.size("hard"), "id"))["other"].alias("other"))
    near = near.join(df.select(F.col("id").alias("other"), F.col("caption").alias("negative")), "other")
    return captioned(df, IMAGE, "split", "cc3m", near=near)


@converter
def omniinstruct(df):
    """id, video_id, question, answer"""
    return pooled(df.where(F.size(T.words(F.col("answer"))).between(1, 5)), BOTH, _mod_split(F.col("video_id"), 20), "omni")


# ---- sounds ----


@converter
def esc50(df):
    """id, category, fold"""
    return labelled(df, "category", "Which sound is this?", "Is this the sound of {}?", AUDIO, F.when(F.col("fold").cast("int") == 5, "test").otherwise("train"), "esc50", name=T.humanise)


# Emotions and vocal sounds by their keys, as they are said in English and Chinese, and the two answers about a voice.
EMOTIONS = {"angry": ("angry", "生气"), "sad": ("sad", "悲伤"), "disgust": ("disgusted", "厌恶"), "fear": ("afraid", "害怕"), "neutral": ("neutral", "平静"), "happy": ("happy", "开心")}
VOCAL_SOUNDS = {"Laughter": ("laughter", "笑声"), "Sigh": ("a sigh", "叹气"), "Cough": ("a cough", "咳嗽"), "Throat clearing": ("throat clearing", "清嗓子"), "Sneeze": ("a sneeze", "打喷嚏"), "Sniff": ("a sniff", "吸鼻子")}
VOICES = (("man", "woman"), ("男声", "女声"))
SECOND = 0.3  # share of questions in the second language, and of clips that are asked about the voice


def _said(names: dict[str, tuple[str, str]], keys: Column, second: Column) -> Column:
    """Keys as they are said in the first or the second language."""
    of = [F.create_map(*[F.lit(x) for k, v in names.items() for x in (k, v[i])]) for i in (0, 1)]
    return F.transform(keys, lambda k: F.when(second, F.element_at(of[1], k)).otherwise(F.element_at(of[0], k)))


def named(rows: DataFrame, label: str, names: dict[str, tuple[str, str]], which: tuple[str, str], is_it: str, split: Column, seed: str, most: int, *more: Column) -> DataFrame:
    """Clips of a fixed set of labels: which of these, in either language, and is it this one.  Other labels are left out."""
    key = F.col("id")
    rows = rows.where(F.col(label).isin(*names)).withColumn("__w", F.array_remove(F.array(*map(F.lit, names)), F.col(label)))
    second = S.uniform(seed + "-language", key) < SECOND
    options = _ordered(seed, key, F.concat(S.pick(seed, F.col("__w"), key, S.whole(seed + "-many", most, key) + 1), F.array(label)))
    rows = rows.withColumn("__o", options).withColumn("__s", F.when(S.uniform(seed + "-coin", key) < 0.5, F.col(label)).otherwise(F.get(S.pick(seed + "-other", F.col("__w"), key, 1), 0)))
    ask = F.when(second, F.lit(which[1])).otherwise(F.lit(which[0]))
    out = rows.select(*_row(key, AUDIO, "choice", ask, _said(names, F.col("__o"), second), F.array_position("__o", F.col(label)) - 1, split, *more))
    one = _said(names, F.array("__s"), F.lit(False))[0]
    return out.unionByName(rows.select(*_row(key, AUDIO, "noul", F.replace(F.lit(is_it), F.lit("{}"), one), None, F.col("__s") == F.col(label), split, *more)))


def voices(rows: DataFrame, woman: Column, split: Column, seed: str, *more: Column) -> DataFrame:
    """Whether a man or a woman speaks, for a drawn share of the clips where that is known (``woman`` is not null)."""
    key = F.col("id")
    some = rows.where(woman.isNotNull() & (S.uniform(seed + "-voice", key) < SECOND))
    first = S.uniform(seed + "-voice-language", key) < 0.5
    pair = lambda i: F.array(*map(F.lit, VOICES[i]))
    return some.select(*_row(key, AUDIO, "choice", F.when(first, "Is the speaker a man or a woman?").otherwise("说话的是男声还是女声？"), F.when(first, pair(0)).otherwise(pair(1)), woman, split, *more))


@converter
def cremad(df):
    """id (actor_...), emotion, gender?, and how many heard each emotion (a column named by its key)?  Votes ride along as a map."""
    split = _mod_split(F.regexp_extract("id", r"^(\d+)_", 1), 10)
    heard = [c for c in EMOTIONS if c in df.columns]
    votes = F.map_filter(F.create_map(*[x for c in heard for x in (F.lit(c), F.col(c).cast("double"))]), lambda k, v: v.isNotNull()) if heard else F.lit(None)
    df = df.withColumn("emotion", F.lower("emotion"))
    votes = votes.cast("map<string,double>").alias("votes")
    out = named(df, "emotion", EMOTIONS, ("How does the speaker sound?", "说话人是什么情绪？"), "Does the speaker sound {}?", split, "cremad", 5, votes)
    if "gender" not in df.columns:
        return out
    gender = F.lower("gender")
    woman = F.when(gender.isin("male", "female"), gender == "female")
    return out.unionByName(voices(df.where(F.col("emotion").isin(*EMOTIONS)), woman, split, "cremad", votes))


@converter
def vocalsound(df):
    """id, label, split, speaker? (f... or m...)"""
    out = named(df, "label", VOCAL_SOUNDS, ("Which vocal sound is this?", "这是哪种人声？"), "Is this {}?", F.col("split"), "vocalsound", 5)
    if "speaker" not in df.columns:
        return out
    first = F.substring("speaker", 1, 1)
    return out.unionByName(voices(df.where(F.col("label").isin(*VOCAL_SOUNDS)), F.when(first.isin("f", "m"), first == "f"), F.col("split"), "vocalsound"))


@converter
def gtzan(df):
    """member (genre.index.wav)"""
    rows = df.select(F.col("member").alias("id"), F.regexp_extract("member", r"([a-z]+)\.(\d+)", 1).alias("genre"), F.regexp_extract("member", r"([a-z]+)\.(\d+)", 2).cast("int").alias("n"))
    return labelled(rows, "genre", "Which genre is this music?", "Is this {} music?", AUDIO, F.when(F.col("n") >= 80, "test").otherwise("train"), "gtzan")


@converter
def clotho(df):
    """id, text (captions run together), split"""
    rows = df.select("id", "split", F.explode(T.captions(F.col("text"))).alias("caption"))
    return captioned(rows, AUDIO, "split", "clotho")


@converter
def audiocaps(df):
    """id, caption, split: the first caption of a clip"""
    return captioned(df.groupBy("id", "split").agg(F.min("caption").alias("caption")), AUDIO, "split", "audiocaps")


@converter
def clothoaqa(df):
    """id, question, answer, split: yes and no answers"""
    return yes_no(df, F.col("answer"), AUDIO, F.col("question"), F.col("split"))


MUSIC_ASKS = {"tempo": "How fast is this music?", "mode": "Is this in a major or a minor key?", "key": "What key is this music in?", "metre": "Does the beat count to three or to four?"}


@converter
def musicbench(train, test, members=None):
    """location, alt_caption, bpm, and root, mode, keyprob, metre where they are known, of both parts; train rows that are augmented copies
    of test clips are left out, and so are clips that are no member of an archive where ``members`` (member) is given."""
    rows = held_out_bases(train, test, "location").withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))
    if members is not None:
        rows = A.by_suffix(members.select("member"), rows)
    rows = rows.withColumn("id", F.col("location"))
    out = captioned(rows.withColumn("caption", F.coalesce(T.strip(F.col("alt_caption")), F.lit(""))), AUDIO, "split", "music")
    known = lambda c, kind: F.col(c) if c in rows.columns else F.lit(None).cast(kind)
    facts = A.music_facts(F.col("bpm").cast("double"), known("root", "string"), known("mode", "string"), known("keyprob", "double"), known("metre", "int"), F.col("id"))
    facts = rows.select("id", "split", F.inline(facts))
    ask = F.element_at(F.create_map(*[F.lit(x) for kv in MUSIC_ASKS.items() for x in kv]), F.col("kind"))
    return out.unionByName(facts.select(*_row(F.col("id"), AUDIO, "choice", ask, F.col("options"), F.col("label"), F.col("split"))))


@converter
def minds14(df):
    """id, intent, lang?: the language rides along"""
    rows = labelled(df, "intent", "What does the caller want?", "Does the caller want {}?", AUDIO, _crc_split(F.col("id")), "minds14", name=T.humanise)
    if "lang" not in df.columns:
        return rows
    langs = df.select(F.col("id").cast("string").alias("id"), "lang").distinct()
    return rows.join(langs, "id", "left")


def _of_set(rows: DataFrame, wrong: DataFrame, other: DataFrame, label: str, which: str, is_it: str | None, seed: str, name: Callable[[Column], Column]) -> DataFrame:
    """Which of 1 to 3 wrong labels and the right one, and is it this one, from labels that were drawn by number."""
    key = F.col("id")
    rows = rows.join(wrong.select("id", F.col("wrong").alias("__w")), "id")
    options = _ordered(seed, key, F.concat(F.slice("__w", F.lit(1), S.whole(seed + "-many", 3, key) + 1), F.array(label)))
    rows = rows.withColumn("__o", options)
    out = rows.select(*_row(key, AUDIO, "choice", which, F.transform("__o", name), F.array_position("__o", F.col(label)) - 1, F.col("split")))
    if is_it is None:
        return out
    rows = rows.join(other.select("id", F.get("wrong", F.lit(0)).alias("__other")), "id")
    rows = rows.withColumn("__s", F.when(S.uniform(seed + "-coin", key) < 0.5, F.col(label)).otherwise(F.col("__other")))
    return out.unionByName(rows.select(*_row(key, AUDIO, "noul", F.replace(F.lit(is_it), F.lit("{}"), name(F.col("__s"))), None, F.col("__s") == F.col(label), F.col("split"))))


@converter
def vggsound(df, answers=None):
    """id, label, split; ``answers`` (id, answer_1 .. answer_3): what is heard, whether there is speech, whether there is music.

    Wrong labels are half from those that share a word, by number.  Train clips with answers are asked whether their description fits, and
    about speech and music.
    """
    rows = df.select("id", "label", "split").where("label is not null")
    wrong, other = (wrong_labels(rows, rows, "id", "label", k, f"vggsound-{k}") for k in (3, 1))
    out = _of_set(rows, wrong, other, "label", "What can be heard?", "Can you hear {}?", "vggsound", lambda c: c)
    if answers is None:
        return out
    told = A.with_answers(rows.select("id", "split"), answers, "id").where("split = 'train'")
    said = F.regexp_replace(T.strip(F.col("answer_1")), r"[.]+$", "")
    out = out.unionByName(captioned(told.withColumn("caption", F.coalesce(said, F.lit(""))), AUDIO, "split", "vggsound"))
    for column, ask, there in (("answer_2", "Is anyone speaking in this clip?", A.has_speech), ("answer_3", "Is there music in this clip?", A.has_music)):
        some = told.where(F.coalesce(F.col(column), F.lit("")) != "")
        out = out.unionByName(some.select(*_row(F.col("id"), AUDIO, "noul", ask, None, there(F.col(column)), F.col("split"))))
    return out


@converter
def slurp(df):
    """id, intent (scenario_action), split: wrong intents are half of the same scenario"""
    rows = df.select("id", "intent", "split").where("intent is not null")
    wrong = wrong_labels(rows, rows, "id", "intent", 3, "slurp", parts=lambda c: F.slice(F.split(c, "_"), 1, 1))
    human = lambda c: F.replace(F.replace(T.humanise(c), F.lit("iot"), F.lit("smart home")), F.lit("qa"), F.lit("question"))
    return _of_set(rows, wrong, wrong, "intent", "What does the user want?", None, "slurp", human)


@converter
def mmau(df):
    """id, question, choices (JSON list as text), answer"""
    rows = df.withColumn("__c", F.from_json("choices", "array<string>"))
    return of_options(rows, F.col("__c"), F.array_position("__c", F.col("answer")) - 1, AUDIO, F.col("question"), "test")


@converter
def songdescriber(df):
    """id, caption: all test"""
    return captioned(df.withColumn("split", F.lit("test")), AUDIO, "split", "songs")


@converter
def avqa(df):
    """id, question (with lettered options as text lines), answer (letter), split"""
    parsed = T.lettered(F.col("question"), F.col("answer"))
    rows = df.withColumn("__p", parsed).where("__p is not null")
    return of_options(rows, F.col("__p.options"), F.col("__p.index"), BOTH, F.col("__p.question"), F.col("split"))


@converter
def fsd50k(df):
    """id, labels (comma list, most specific first), split: any label outside a clip's own is absent"""
    rows = df.withColumn("__l", F.split("labels", ","))
    vocab = rows.select(F.explode("__l").alias("l")).agg(F.array_sort(F.collect_set("l")).alias("__all"))
    rows = rows.crossJoin(F.broadcast(vocab)).withColumn("__absent", F.array_except("__all", "__l"))
    key = F.col("id")
    present = F.when(S.uniform("fsd-first", key) < 0.7, F.col("__l")[0]).otherwise(F.get(S.pick("fsd-any", F.col("__l"), key, 1), 0))
    rows = rows.withColumn("__yes", present).withColumn("__o", _ordered("fsd", key, F.concat(S.pick("fsd", F.col("__absent"), key, 3), F.array("__yes"))))
    out = rows.select(*_row(key, AUDIO, "choice", "Which of these can be heard in the clip?", F.transform("__o", T.humanise), F.array_position("__o", F.col("__yes")) - 1, F.col("split")))
    asked = rows.withColumn("__ask", F.when(S.uniform("fsd-coin", key) < 0.5, F.col("__yes")).otherwise(F.get(S.pick("fsd-no", F.col("__absent"), key, 1), 0))).where("__ask is not null")
    return out.unionByName(asked.select(*_row(key, AUDIO, "noul", F.concat(F.lit("Can you hear "), T.humanise(F.col("__ask")), F.lit(" in this clip?")), None, F.array_contains("__l", F.col("__ask")), F.col("split"))))


# ---- benchmarks, all test ----


@converter
def mmbench(df):
    """index, question, hint, A, B, C, D, answer: a row for each rotation"""
    options = F.array_compact(F.array(*[F.when(~T.null_like(F.col(c)), T.strip(F.col(c))) for c in "ABCD"]))
    answer = F.when(F.col("answer").isin(*"ABCD"), F.ascii("answer") - 65)
    rows = df.select(F.col("index").cast("string").alias("id"), "question", F.when(~T.null_like(F.col("hint")), T.strip(F.col("hint"))).alias("context"), options.alias("options"), answer.cast("int").alias("answer"))
    rows = Q.rotate(rows.where(F.col("answer").isNotNull() & (F.size("options") >= 2) & (F.col("answer") < F.size("options"))))
    return rows.select(*_row(F.col("id"), Q.state_of(F.lit("image"), F.col("context")), "choice", T.strip(F.col("question")), F.col("options"), F.col("label"), "test", "grp", "rot"))


@converter
def mmstar(df):
    """index, question (options as `Options: A: x, B: y` or as `(A) x` lines after `Choices:`), answer (letter)"""
    text = F.col("question")
    inline = text.rlike(r"(?s)\n?Options:\s*(.*)$")
    tail = F.when(inline, F.regexp_extract(text, r"(?s)\n?Options:\s*(.*)$", 1)).otherwise(F.regexp_extract(text, r"(?s)\n?Choices:\s*(.*)$", 1))
    cut = F.when(inline, F.split(T.strip(tail), r"(?:^|,\s*|\n)\s*[A-F][:.]\s")).otherwise(F.split(T.strip(tail), r"(?:^|\n)\s*\([A-F]\)\s*"))
    options = F.transform(F.slice(cut, 2, 10), lambda o: F.regexp_replace(T.strip(o), r",+$", ""))
    letters = F.when(inline, F.regexp_extract_all(T.strip(tail), F.lit(r"(?:^|,\s*|\n)\s*([A-F])[:.]\s"), F.lit(1))).otherwise(F.regexp_extract_all(T.strip(tail), F.lit(r"(?:^|\n)\s*\(([A-F])\)\s*"), F.lit(1)))
    rows = df.withColumns({"__o": options, "__l": letters, "__stem": T.strip(F.regexp_replace(text, r"(?s)\n?(Options|Choices):\s*.*$", ""))})
    rows = rows.where(F.array_join("__l", "") == F.substring(F.lit("ABCDEF"), F.lit(1), F.size("__l"))).where(F.size("__l") > 0)
    return of_options(rows.withColumn("id", F.col("index").cast("string")), F.col("__o"), F.array_position("__l", F.col("answer")) - 1, IMAGE, F.col("__stem"), "test")


@converter
def mme(df):
    """question_id, question, answer, category, image: both questions on an image form a group"""
    rows = df.withColumn("id", F.col("question_id"))
    return yes_no(rows, F.col("answer"), IMAGE, T.without_answer_request(F.col("question")), "test", "id", F.concat_ws("/", "category", "image").alias("grp"))


@converter
def pope(df):
    """id, question, answer"""
    return yes_no(df, F.col("answer"), IMAGE, F.col("question"), "test")


@converter
def seed_bench(df):
    """id, question, choice_a .. choice_d, answer (letter)"""
    options = F.array(*[F.col(f"choice_{c}") for c in "abcd"])
    return of_options(df, options, F.when(F.col("answer").isin(*"ABCD"), F.ascii("answer") - 65), IMAGE, F.col("question"), "test")


@converter
def omnibench(df):
    """id, question, options[], answer (text)"""
    return of_options(df, F.col("options"), F.array_position("options", F.col("answer")) - 1, BOTH, F.col("question"), "test")


@converter
def airbench(df):
    """id, question, choice_a .. choice_d (some null), answer_gt (text)"""
    options = F.array_compact(F.array(*[F.col(f"choice_{c}") for c in "abcd"]))
    return of_options(df.withColumn("__c", options), F.col("__c"), F.array_position("__c", F.col("answer_gt")) - 1, AUDIO, F.col("question"), "test")


@converter
def chat_targets(df):
    """id, messages (JSON: [{content: [{text}]}]), targets (JSON: {option: probability}): the likeliest option is the label"""
    text = F.from_json("messages", "array<struct<content:array<struct<text:string>>>>")
    said = F.filter(F.flatten(F.transform(text, lambda m: F.transform(m["content"], lambda c: c["text"]))), lambda t: t.isNotNull())
    target = F.map_entries(F.from_json("targets", "map<string,double>"))
    rows = df.withColumns({"__t": said, "__e": target}).where("size(__t) = 1")
    best = F.array_max(F.transform("__e", lambda e: e["value"]))
    return of_options(rows, F.transform("__e", lambda e: e["key"]), F.array_position(F.transform("__e", lambda e: e["value"]), best) - 1, IMAGE, F.col("__t")[0], "test")


@converter
def finetune(df, question="Which one is it?", fraction=0.2):
    """file, label, question?, state?: labelled files with a stratified split"""
    rows = Q.examples_to_rows(df, question).withColumn("id", F.col("file"))
    return S.stratified_split(rows, "label", fraction, "finetune", "id").select("id", "state", "type", "instructions", "criteria", "label", "split")
