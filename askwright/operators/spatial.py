"""Questions about boxes in images: where, left or right, above, bigger, present or not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sampling as S
from .questions import shuffle_options

# Names of the cells of a 3 x 3 grid, row by row.
CELLS = ["top left", "top", "top right", "left", "center", "right", "bottom left", "bottom", "bottom right"]
# How each kind of question is asked.
ASKS = {
    "location": ("Where is the {a} in the image?", "Where in the picture is the {a}?", "In which part of the image is the {a}?"),
    "side": ("Is the {a} to the left or to the right of the {b}?", "Where is the {a} relative to the {b}?"),
    "left": ("Is the {a} to the left of the {b}?", "Is the {a} on the left side of the {b}?"),
    "above": ("Is the {a} above the {b}?", "Is the {a} higher up in the image than the {b}?"),
    "seen": ("Which of these can be seen in the image?", "Which object appears in this picture?"),
    "not_shown": ("Which of these is not in the image?", "Which object does not appear in this picture?"),
    "bigger": ("Which looks bigger in the image, the {a} or the {b}?", "Which takes up more of the picture?"),
}
SIDES = ("to the left", "to the right")


def cell(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """Name of the cell that holds the box's centre."""
    col = F.least(F.lit(2), F.floor((x + w / 2) / width * 3).cast("int"))
    row = F.least(F.lit(2), F.floor((y + h / 2) / height * 3).cast("int"))
    return F.get(F.array(*[F.lit(c) for c in CELLS]), row * 3 + col)


def single_objects(boxes: DataFrame, min_area: float = 0.01) -> DataFrame:
    """Boxes of names that an image shows once, crowds aside, and large enough to ask about."""
    alone = F.count(F.lit(1)).over(Window.partitionBy("image_id", "name"))
    kept = boxes.where("not iscrowd").withColumn("__n", alone).where("__n = 1").drop("__n")
    return kept.where(F.col("area") >= min_area * F.col("width") * F.col("height"))


def pairs(single: DataFrame, most: int = 3, seed: str = "pairs") -> DataFrame:
    """Unordered pairs of an image's objects, at most ``most`` an image, with offsets of centres and the ratio of areas."""
    a, b = (single.select("image_id", *[F.col(c).alias(f"{p}_{c}") for c in ("name", "x", "y", "w", "h", "area")], *(["width", "height"] if p == "p" else [])) for p in "pq")
    both = a.join(b, "image_id").where("p_name < q_name")
    by = Window.partitionBy("image_id").orderBy(S.draw(seed, "image_id", "p_name", "q_name"))
    both = both.withColumn("__n", F.row_number().over(by)).where(F.col("__n") <= most).drop("__n")
    dx = ((F.col("p_x") + F.col("p_w") / 2) - (F.col("q_x") + F.col("q_w") / 2)) / F.col("width")
    dy = ((F.col("p_y") + F.col("p_h") / 2) - (F.col("q_y") + F.col("q_h") / 2)) / F.col("height")
    return both.withColumns({"dx": dx, "dy": dy, "ratio": F.col("p_area") / F.greatest(F.lit(1.0), F.col("q_area"))})


def relations(both: DataFrame) -> DataFrame:
    """(image_id, kind, p, q, label): left or right if clearly apart sideways, else above, and bigger if sizes differ clearly."""
    side = (F.abs("dx") > 0.2) & ((F.col("p_x") + F.col("p_w") < F.col("q_x")) | (F.col("q_x") + F.col("q_w") < F.col("p_x")))
    up = ~side & (F.abs("dy") > 0.2) & ((F.col("p_y") + F.col("p_h") < F.col("q_y")) | (F.col("q_y") + F.col("q_h") < F.col("p_y")))
    size = (F.col("ratio") > 2) | (F.col("ratio") < 0.5)
    one = lambda when, kind, label: F.when(when, F.struct(F.lit(kind).alias("kind"), label.cast("int").alias("label")))
    found = F.array_compact(F.array(one(side, "left", F.col("dx") < 0), one(up, "above", F.col("dy") < 0), one(size, "bigger", F.col("ratio") <= 1)))
    return both.select("image_id", F.col("p_name").alias("p"), F.col("q_name").alias("q"), F.inline(found))


def _present(boxes: DataFrame, min_area: float) -> DataFrame:
    """(image_id, name, visible): names in an image, crowds aside, and whether one is large enough to see."""
    large = F.col("area") >= min_area * F.col("width") * F.col("height")
    return boxes.where("not iscrowd").groupBy("image_id", "name").agg(F.max(large).alias("visible"))


def identity(boxes: DataFrame, categories: DataFrame, min_area: float = 0.01, seed: str = "identity") -> DataFrame:
    """(image_id, seen, wrong): a visible name and three absent ones, those of its supercategory first."""
    present = _present(boxes, min_area)
    by = Window.partitionBy("image_id").orderBy(S.draw(seed, "image_id", "name"))
    seen = present.where("visible").withColumn("__n", F.row_number().over(by)).where("__n = 1").select("image_id", F.col("name").alias("seen"))
    # the vocabulary of names is a fixed list, so the cross join adds a bounded factor
    names = F.broadcast(categories.select("name", "supercategory"))
    own = seen.join(F.broadcast(categories.select(F.col("name").alias("seen"), F.col("supercategory").alias("own"))), "seen")
    absent = own.crossJoin(names).join(present.select("image_id", "name"), ["image_id", "name"], "left_anti")
    order = Window.partitionBy("image_id").orderBy(F.col("supercategory") != F.col("own"), S.draw(seed, "image_id", "name"))
    three = absent.withColumn("__n", F.row_number().over(order)).where("__n <= 3")
    return three.groupBy("image_id", "seen").agg(F.array_sort(F.collect_list("name")).alias("wrong")).where(F.size("wrong") == 3)


def not_shown(boxes: DataFrame, told: DataFrame, min_area: float = 0.01, seed: str = "missing") -> DataFrame:
    """(image_id, shown, missing): three visible names of an image that has as many, and one of the absent names in ``identity``'s rows."""
    by = Window.partitionBy("image_id").orderBy(S.draw(seed, "image_id", "name"))
    three = _present(boxes, min_area).where("visible").withColumn("__n", F.row_number().over(by)).where("__n <= 3")
    shown = three.groupBy("image_id").agg(F.array_sort(F.collect_list("name")).alias("shown")).where(F.size("shown") == 3)
    return shown.join(told, "image_id").select("image_id", "shown", F.get("wrong", S.whole(seed, 3, "image_id")).alias("missing"))


def questions(boxes: DataFrame, categories: DataFrame, min_area: float = 0.01, test: float = 0.02, most: int = 10_000, seed: str = "boxes") -> DataFrame:
    """Questions about annotated boxes: (image_id, key, kind, type, instructions, options, label, split).

    Kinds are location (at most ``most`` an answer, since most objects are in the centre), side or left, above, bigger, seen and
    not_shown; left and above are yes-or-no questions without options.  The two objects of a pair change places by a coin, and
    another decides between side and left.  A share ``test`` of the images is the test split.
    """
    single = single_objects(boxes, min_area)
    none = F.lit(None).cast("string")
    key = F.concat_ws(":", F.col("image_id").cast("string"), "about", "p", "q")
    columns = ["image_id", "key", "kind", "a", "b", "options", "label"]

    box = [F.col(c) for c in ("x", "y", "w", "h", "width", "height")]
    where = single.select("image_id", F.lit("location").alias("about"), F.col("name").alias("p"), none.alias("q"), cell(*box).alias("right"))
    where = where.withColumns({"key": key, "kind": F.lit("location"), "a": F.col("p"), "b": none, "label": F.lit(0)})
    where = S.cap_each(where, "right", most, f"{seed}-location", "key")
    others = F.array_remove(F.array(*map(F.lit, CELLS)), F.col("right"))
    where = where.withColumn("options", F.concat(F.array("right"), S.pick(f"{seed}-cells", others, F.col("key"), 3)))

    pair = relations(pairs(single)).withColumn("about", F.col("kind"))
    swapped = S.uniform(f"{seed}-swap", "image_id", "p", "q") < 0.5
    pair = pair.withColumns({"key": key, "a": F.when(swapped, F.col("q")).otherwise(F.col("p")), "b": F.when(swapped, F.col("p")).otherwise(F.col("q")), "label": F.when(swapped, 1 - F.col("label")).otherwise(F.col("label"))})
    side = (F.col("about") == "left") & (S.uniform(f"{seed}-side", "key") < 0.5)
    options = F.when(side, F.array(*map(F.lit, SIDES))).when(F.col("about") == "bigger", F.array("a", "b"))
    pair = pair.withColumns({"kind": F.when(side, "side").otherwise(F.col("about")), "options": options, "label": F.when(side, 1 - F.col("label")).otherwise(F.col("label"))})

    told = identity(boxes, categories, min_area)
    missing = not_shown(boxes, told, min_area)
    named = told.select("image_id", F.lit("seen").alias("about"), F.concat(F.array("seen"), "wrong").alias("options"))
    named = named.unionByName(missing.select("image_id", F.lit("not_shown").alias("about"), F.concat(F.array("missing"), "shown").alias("options")))
    named = named.withColumns({"p": none, "q": none, "a": none, "b": none, "kind": F.col("about"), "label": F.lit(0)}).withColumn("key", key)

    rows = where.select(columns).unionByName(pair.select(columns)).unionByName(named.select(columns))
    asked = F.lit(None).cast("string")
    for kind, asks in ASKS.items():
        asked = F.when(F.col("kind") == kind, F.get(F.array(*map(F.lit, asks)), S.whole(f"{seed}-ask", len(asks), "key"))).otherwise(asked)
    name = lambda text, slot, c: F.replace(text, F.lit(slot), F.coalesce(F.col(c), F.lit("")))
    kind = F.when(F.col("options").isNull(), "noul").otherwise("choice")
    split = F.when(S.uniform(f"{seed}-split", "image_id") < test, "test").otherwise("train")
    rows = rows.withColumns({"type": kind, "instructions": name(name(asked, "{a}", "a"), "{b}", "b"), "split": split})
    return shuffle_options(rows, f"{seed}-order", "key").select("image_id", "key", "kind", "type", "instructions", "options", "label", "split")


def tiles(images: DataFrame, grid: int) -> DataFrame:
    """The whole image and grid x grid crops in reading order, as boxes of whole pixels."""
    at = F.explode(F.sequence(F.lit(0), F.lit(grid * grid if grid > 1 else 0)))
    rows = images.withColumn("tile", at)
    c, r = (F.col("tile") - 1) % grid, F.floor((F.col("tile") - 1) / grid)
    edge = lambda size, i: F.floor(F.col(size) * i / grid).cast("int")
    first = F.col("tile") == 0
    return rows.withColumns({"left": F.when(first, 0).otherwise(edge("width", c)), "top": F.when(first, 0).otherwise(edge("height", r)), "right": F.when(first, F.col("width")).otherwise(edge("width", c + 1)), "bottom": F.when(first, F.col("height")).otherwise(edge("height", r + 1))})


def pooled_grid(cells: Column, side: int, target: int) -> Column:
    """A square grid, row by row, averaged over square blocks to ``target`` x ``target``; null for another number of cells."""
    if side % target:
        raise ValueError("the target side must divide the side")
    k = side // target
    block = lambda i: F.flatten(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda r: F.slice(cells, (F.floor(i / target) * k + r).cast("int") * side + (i % target) * k + 1, F.lit(k))))
    mean = F.transform(F.sequence(F.lit(0), F.lit(target * target - 1)), lambda i: F.aggregate(block(i), F.lit(0.0), lambda a, x: a + x.cast("double")) / (k * k))
    return F.when(F.size(cells) == side * side, mean)
