"""The question model: validation, rendering, rotations, shuffles, prompts, budgets, the rule cascade over chat turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sampling as S
from ..functions import text as T

# Texts of a yes/no question without criteria, and the state of a picture or clip.
NO_TEXT, YES_TEXT = "no, the statement does not hold", "yes, the statement holds"
STATES = {"image": "Image.", "audio": "Audio clip.", "image+audio": "Image and audio clip."}
MAX_OPTIONS = 6


def problem(question: Column) -> Column:
    """What is wrong with a question struct (type, instructions, criteria), or null."""
    kind, n = question["type"], F.coalesce(F.size(question["criteria"]), F.lit(0))
    return (
        F.when(kind.isNull() | ~kind.isin("choice", "score", "noul") | question["instructions"].isNull(), "type and instructions are needed")
        .when((kind == "choice") & (n <= 0), "choice needs criteria")
        .when((kind == "score") & (n <= 0), "score needs a list of criteria")
    )


def rendered(question: Column) -> Column:
    """Option texts in the order of labels: `key` or `key: value`, `level i: value`, or no and yes."""
    criteria, blank = question["criteria"], lambda v: v.isNull() | (v == "")
    choice = F.transform(criteria, lambda c: F.when(blank(c["value"]), c["key"]).otherwise(F.concat(c["key"], F.lit(": "), c["value"])))
    score = F.transform(criteria, lambda c, i: F.concat(F.lit("level "), i.cast("string"), F.lit(": "), F.coalesce(F.nullif(c["value"], F.lit("")), c["key"])))
    of = lambda key: F.get(F.filter(criteria, lambda c: c["key"] == key), 0)["value"]
    noul = F.array(F.concat(F.lit("false: "), F.coalesce(F.nullif(of("false"), F.lit("")), F.lit(NO_TEXT))), F.concat(F.lit("true: "), F.coalesce(F.nullif(of("true"), F.lit("")), F.lit(YES_TEXT))))
    return F.when(question["type"] == "choice", choice).when(question["type"] == "score", score).when(question["type"] == "noul", noul)


def state_of(modality: Column, context: Column) -> Column:
    base = F.lit(None).cast("string")
    for name, text in STATES.items():
        base = F.when(modality == name, text).otherwise(base)
    return F.when(F.coalesce(context, F.lit("")) == "", base).otherwise(F.trim(F.concat_ws(" ", base, context)))


def rotate(rows: DataFrame, options: str = "options", answer: str = "answer", key: str = "id") -> DataFrame:
    """A row for each rotation of the options, with the group, the rotation and the label in it."""
    n = F.size(options)
    turned = rows.withColumn("rot", F.explode(F.sequence(F.lit(0), n - 1)))
    told = F.element_at(F.col(options), F.col(answer) + 1)
    moved = F.concat(F.slice(F.col(options), F.col("rot") + 1, n), F.slice(F.col(options), F.lit(1), F.col("rot")))
    return turned.withColumn("label", (F.array_position(moved, told) - 1).cast("int")).withColumn("grp", F.col(key)).withColumn(options, moved)


def shuffle_options(rows: DataFrame, seed: str, key: str, options: str = "options", label: str = "label", probs: str | None = None) -> DataFrame:
    """Options in a drawn order, the label (and each option's probability) moved along.

    A row with fewer than two options, as those of yes-or-no questions, is left as it is.
    """
    zipped = F.transform(F.col(options), lambda o, i: F.struct(F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string"), i.cast("string"))).alias("d"), i.alias("i"), o.alias("o"), *([F.get(F.col(probs), i).alias("p")] if probs else [])))
    some = F.coalesce(F.size(options), F.lit(0)) > 1
    moved = lambda new, old: F.when(some, new).otherwise(F.col(old))
    rows = rows.withColumn("__z", F.when(some, F.array_sort(zipped)))
    told = {label: moved((F.array_position(F.transform("__z", lambda z: z["i"]), F.col(label)) - 1).cast("int"), label), options: moved(F.transform("__z", lambda z: z["o"]), options)}
    if probs:
        told[probs] = moved(F.transform("__z", lambda z: z["p"]), probs)
    return rows.withColumns(told).drop("__z")


def prompt(kind: Column, instructions: Column, options: Column, context: Column) -> Column:
    """A chat prompt: lettered options, or a request for yes or no."""
    head = F.when(F.coalesce(context, F.lit("")) != "", F.concat(context, F.lit("\n"))).otherwise("")
    lines = F.array_join(F.transform(options, lambda o, i: F.concat(F.chr(65 + i), F.lit(". "), o)), "\n")
    choice = F.concat(head, instructions, F.lit("\n"), lines, F.lit("\nAnswer with the option's letter from the given choices directly."))
    return F.when(kind == "noul", F.concat(head, instructions, F.lit("\nAnswer the question using a single word: Yes or No."))).otherwise(choice)


def budget(state: Column, head: Column, options: Column, max_len: int = 512, head_len: int = 192, option_cap: int = 48) -> Column:
    """Token counts of a sequence from the lengths of its parts: kept head, options and state, markers and total.

    Each option is a marker and at most ``option_cap`` tokens; if fewer than 16 are left for the head, options shrink to an equal
    share of at least four.
    """
    first = F.transform(options, lambda n: 1 + F.least(n, F.lit(option_cap)))
    of = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    per = F.greatest(F.lit(4), F.floor((head_len - 16) / F.greatest(F.size(options), F.lit(1))).cast("int"))
    kept = F.when(head_len - of(first) < 16, F.transform(first, lambda n: F.least(n, per))).otherwise(first)
    head_kept = F.least(head, F.greatest(F.lit(8), head_len - of(kept)))
    prefix = 3 + head_kept + of(kept)
    state_kept = F.least(state, F.greatest(F.lit(0), max_len - prefix - 1))
    markers = F.transform(kept, lambda n, i: 2 + head_kept + of(F.slice(kept, F.lit(1), i)))
    return F.struct(head_kept.alias("head"), of(kept).alias("options"), state_kept.alias("state"), F.size(F.filter(markers, lambda m: m < max_len)).alias("markers"), F.least(F.lit(max_len), prefix + state_kept + 1).alias("total"))


def option_probabilities(top: Column, variants: Column) -> Column:
    """struct(probs, mass) from (token, logprob) pairs: the share of each option's spellings; null probs for no mass."""
    mass = F.transform(variants, lambda v: F.aggregate(F.filter(top, lambda t: F.array_contains(v, T.strip(t["token"]))), F.lit(0.0), lambda s, t: s + F.exp(t["logprob"])))
    total = F.aggregate(mass, F.lit(0.0), lambda s, x: s + x)
    return F.struct(F.when(total > 0, F.transform(mass, lambda m: m / total)).alias("probs"), total.alias("mass"))


def pools(turns: DataFrame) -> DataFrame:
    """(kind, answer) pairs of short answers: the wrong options for questions of a kind.  Kept as rows, never as one array."""
    told = turns.select(T.clean_answer(F.col("assistant")).alias("answer"), T.context_and_question(T.without_hints(F.col("user")))["question"].alias("question"))
    short = told.where(F.size(T.words(F.col("answer"))).between(1, 5))
    return short.select(F.explode(F.array_distinct(T.question_kinds(F.col("question")))).alias("kind"), "answer").distinct()


def drawn_pool(asked: DataFrame, pool: DataFrame, key: str, seed: str, least: int = 3, most: int = 3, buckets: int = 64) -> DataFrame:
    """(key, kind, wrong): ``most`` answers drawn by the key from all others of the first of its ``kinds`` that has ``least``.

    ``asked`` has the key, ``kinds`` and ``answer`` (or distinct ``answers``, none of which is drawn); ``pool`` has each (kind, answer) once
    and may have the text to show.  Answers are
    numbered in buckets of their kind by md5, so a common kind is not one task's and SQL can repeat the numbers; places are drawn
    without replacement from the kind's size and joined, so no answer is left out and no kind is ever an array.
    """
    from pyspark.sql import Window

    assert most <= least
    pool = pool if "shown" in pool.columns else pool.withColumn("shown", F.col("answer"))
    by = Window.partitionBy("kind", "bucket").orderBy("answer")
    numbered = pool.withColumn("bucket", (F.conv(F.substring(F.md5("answer"), 1, 4), 16, 10).cast("int") % buckets)).withColumn("nth", F.row_number().over(by) - 1)
    sized = pool.groupBy("kind").agg(F.count(F.lit(1)).alias("size"))
    filled = numbered.groupBy("kind", "bucket").agg(F.count(F.lit(1)).alias("n")).groupBy("kind").agg(F.array_sort(F.collect_list(F.struct("bucket", "n"))).alias("filled"))
    several = "answers" in asked.columns
    asked = asked.select(key, F.explode("answers").alias("answer"), "kinds") if several else asked
    own = asked.select(key, "answer", F.posexplode("kinds").alias("rank", "kind")).join(sized, "kind").join(numbered.select("kind", "answer", "bucket", "nth"), ["kind", "answer"], "left")
    if several:
        held = F.collect_list(F.when(F.col("nth").isNotNull(), F.struct("bucket", "nth")))
        own = own.groupBy(key, "rank", "kind").agg(F.first("size").alias("size"), held.alias("own"))
    else:
        own = own.withColumn("own", F.array_compact(F.array(F.when(F.col("nth").isNotNull(), F.struct("bucket", "nth")))))
    own = own.withColumn("size", F.col("size") - F.size("own")).where(F.col("size") >= least)
    best = own.groupBy(key).agg(F.min_by(F.struct("kind", "size", "own"), "rank").alias("__b")).select(key, "__b.*").join(filled, "kind")
    before = lambda o: F.aggregate(F.filter("filled", lambda b: b["bucket"] < o["bucket"]), F.lit(0).cast("long"), lambda n, b: n + b["n"])
    # drawn places are moved past the smaller ones that are taken: the answer's own, then those drawn before
    taken, places = F.transform("own", lambda o: before(o) + o["nth"]), []
    for i in range(most):
        free = F.pmod(F.conv(F.substring(S.draw(seed, F.lit(i), key), 1, 12), 16, 10).cast("long"), F.col("size") - i)
        best = best.withColumn(f"__{i}", F.aggregate(F.array_sort(taken), free, lambda at, t: at + (t <= at).cast("long")))
        places.append(F.col(f"__{i}"))
        taken = F.concat(taken, F.array(F.col(f"__{i}")))
    found = best.select(key, "kind", "filled", F.posexplode(F.array(*places)).alias("draw", "at"))
    start = F.struct(F.col("at").alias("left"), F.lit(None).cast("int").alias("bucket"))
    met = F.aggregate("filled", start, lambda s, b: F.when(s["bucket"].isNotNull(), s).when(s["left"] < b["n"], F.struct(s["left"].alias("left"), b["bucket"].alias("bucket"))).otherwise(F.struct((s["left"] - b["n"]).alias("left"), s["bucket"].alias("bucket"))))
    found = found.withColumn("__m", met).select(key, "kind", "draw", F.col("__m.bucket").alias("bucket"), F.col("__m.left").cast("int").alias("nth"))
    told = found.join(numbered.select("kind", "bucket", "nth", "shown"), ["kind", "bucket", "nth"])
    return told.groupBy(key, "kind").agg(F.transform(F.array_sort(F.collect_list(F.struct("draw", "shown"))), lambda s: s["shown"]).alias("wrong"))


def cascade(turns: DataFrame, seed: str = "turns", key: str = "id", pool: DataFrame | None = None) -> DataFrame:
    """Chat turns (key, user, assistant) to typed questions; turns that no rule takes are left out.

    Rules in order: lettered choices, listed options, yes or no, a description that fits or not, a number, a pooled short answer.
    """
    user, answer = F.col("user"), F.col("assistant")
    rows = turns.withColumn("__l", F.coalesce(T.lettered(user, answer), T.listed(user, answer))).withColumn("__c", T.context_and_question(T.without_hints(user))).withColumn("__a", T.clean_answer(answer))
    wrong = drawn_pool(rows.select(key, F.col("__a").alias("answer"), T.question_kinds(F.col("__c.question")).alias("kinds")), pools(turns) if pool is None else pool, key, seed)
    rows = rows.join(wrong.withColumnRenamed("wrong", "__w").drop("kind"), key, "left")
    options, index, k = F.col("__l.options"), F.col("__l.index"), F.col(key).cast("string")
    # of more options than are kept, the right one and drawn others, in their order
    ranked = F.transform(options, lambda o, i: F.struct(F.when(i == index, "").otherwise(F.md5(F.concat_ws(":", F.lit(seed), k, i.cast("string")))).alias("d"), i.alias("i"), o.alias("o")))
    few = F.array_sort(F.transform(F.slice(F.array_sort(ranked), 1, MAX_OPTIONS), lambda s: F.struct(s["i"].alias("i"), s["o"].alias("o"))))
    kept, at = F.transform(few, lambda s: s["o"]), (F.array_position(F.transform(few, lambda s: s["i"]), index) - 1).cast("int")
    two = F.transform(kept, F.lower)
    is_yes_no = F.size(kept).isin(2) & F.array_contains(two, "yes") & F.array_contains(two, "no")
    question, said = F.col("__c.question"), F.col("__a")
    long = F.size(T.words(said)) > 5
    value = T.number(said)
    drawn = lambda items, right: F.transform(F.array_sort(F.transform(F.array_distinct(F.concat(items, F.array(right))), lambda x: F.struct(F.md5(F.concat_ws(":", F.lit(seed), F.lit("order"), k, x)).alias("d"), x.alias("x")))), lambda s: s["x"])
    picks = S.whole(seed + "-many", 3, key) + 1
    numbers = drawn(S.pick(seed, F.transform(T.near_numbers(value), T.number_text), k, picks), T.number_text(value))
    pooled = drawn(F.slice(F.col("__w"), F.lit(1), picks), said)
    none, empty = F.lit(None), F.array().cast("array<string>")
    item = lambda rule, kind, q, crit, label: F.struct(F.lit(rule).alias("rule"), F.lit(kind).alias("type"), q.alias("instructions"), crit.alias("criteria"), label.cast("int").alias("label"))
    told = (
        F.when(F.col("__l").isNotNull() & is_yes_no, item("options", "noul", F.col("__l.question"), empty, F.get(two, at) == "yes"))
        .when(F.col("__l").isNotNull(), item("options", "choice", F.col("__l.question"), kept, at))
        .when((question == "") | (said == ""), none)
        .when(F.lower(said).isin("yes", "no"), item("yes_no", "noul", question, empty, F.lower(said) == "yes"))
        .when(long, item("description", "noul", F.concat(F.lit('Does this description match the image? "'), said, F.lit('"')), empty, F.lit(1)))
        .when(value.isNotNull(), item("number", "choice", question, numbers, F.array_position(numbers, T.number_text(value)) - 1))
        .when(F.col("__w").isNotNull(), item("pool", "choice", question, pooled, F.array_position(pooled, said) - 1))
    )
    background = F.coalesce(F.nullif(F.coalesce(F.col("__l.background"), F.col("__c.background")), F.lit("")), F.lit(STATES["image"]))
    return rows.withColumn("__q", told).where("__q is not null").select(key, background.alias("state"), "__q.*")


def examples_to_rows(examples: DataFrame, question: str, state: str | None = None) -> DataFrame:
    """(file, label, question?, state?) to question rows: noul for two labels that mean no and yes, else a choice of all labels."""
    labels = examples.agg(F.array_sort(F.collect_set("label")).alias("labels"))
    pair = F.array_sort(F.transform("labels", F.lower))
    yes_no = F.array_contains(F.array(F.array(F.lit("no"), F.lit("yes")), F.array(F.lit("false"), F.lit("true")), F.array(F.lit("否"), F.lit("是"))), pair)
    rows = examples.withColumn("media", T.media_kind(F.col("file"))).where("media is not null").crossJoin(F.broadcast(labels.where(F.size("labels") >= 2).withColumn("noul", yes_no)))
    have = lambda c: F.nullif(F.col(c), F.lit("")) if c in examples.columns else F.lit(None).cast("string")
    return rows.select(
        "file", "media", F.coalesce(have("question"), F.lit(question)).alias("instructions"),
        F.coalesce(have("state"), F.lit(state), F.when(F.col("media") == "image", STATES["image"]).otherwise(STATES["audio"])).alias("state"),
        F.when(F.col("noul"), "noul").otherwise("choice").alias("type"), F.when(~F.col("noul"), F.col("labels")).alias("criteria"),
        F.when(F.col("noul"), F.lower("label").isin("yes", "true", "是").cast("int")).otherwise((F.array_position("labels", F.col("label")) - 1).cast("int")).alias("label"),
    )
