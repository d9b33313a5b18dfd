"""Text parsers as columns: question clean-up, option lists, captions, labels.

Everything is built-in functions; a parser that can fail gives null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A line that tells how to answer, by its start or by a word anywhere.
HINT_LINE = r"(?i)^\W*(answer|respond|reply|keep it|be (brief|succinct|concise)|short answer|concise|brief|quick|write|use|pick|select|choose|make your selection|give|provide|offer|state|answer the question|a (short|brief|very short)|one word|single word|very brief|with a)\b"
HINT_ANYWHERE = r"(?i)\b(choices?|options?|answers?|rationale|respon(se|d)|explain)\b"
# The parts of a question that lists its options, and of its answer.
QUESTION_MARK = r"(?:^|\n)Question:\s*"
CONTEXT_MARK = r"\n(Hint|Context):"
CHOICES_MARK = r"\nChoices:\s*\n"
CHOICE_LINE = r"^([A-Z])\.\s*(.+)$"
CHOICE_ANSWER = r"(?i)^(?:answer:\s*)?([A-Z])\b"
OPTIONS_MARK = r"(?s)\nOptions:\s*(.+?)\.?\s*$"
# Wrong years by offset, other wrong numbers by scale.
YEAR_OFFSETS = [-5, -3, -2, -1, 1, 2, 3, 5]
SCALES = [0.5, 0.75, 0.9, 1.1, 1.25, 1.5, 2.0]
# Words that carry no content in a caption.
STOP_WORDS = "a an the and or of to in on at by for with from into onto is are was were be being been it its this that there their then than while as some someone something people person sound sounds noise noises".split()
# Adjectives that belong to the colour after them.
MODIFIERS = ["light", "dark", "bright", "pale", "deep"]


def strip(c: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def normalise(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def words(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def without_hints(c: Column) -> Column:
    """Lines before the first one, the first line aside, that tells how to answer."""
    lines = F.split(strip(c), "\n")
    hint = F.transform(lines, lambda x, i: (i > 0) & (strip(x).rlike(HINT_LINE) | x.rlike(HINT_ANYWHERE)))
    at = F.array_position(hint, F.lit(True)).cast("int")
    return F.when(at > 0, strip(F.array_join(F.slice(lines, F.lit(1), at - 1), "\n"))).otherwise(strip(c))


def clean_answer(c: Column) -> Column:
    first = strip(F.get(F.split(F.regexp_replace(strip(c), r"(?i)^answer:\s*", ""), "\n"), 0))
    return strip(F.regexp_replace(first, r"\.+$", ""))


def _match(c: Column, pattern: str) -> tuple[Column, Column]:
    """1-based start of the first match (0 for none) and the position after it."""
    start = F.regexp_instr(c, F.lit(pattern))
    return start, start + F.length(F.regexp_extract(c, pattern, 0))


def context_and_question(c: Column) -> Column:
    """struct(background, question): what stands before `Question:`, and a hint or context after it, is background."""
    start, end = _match(c, QUESTION_MARK)
    before = F.when(start > 0, strip(F.substring(c, F.lit(1), start - 1))).otherwise("")
    question = F.when(start > 0, F.substring(c, end, F.length(c))).otherwise(c)
    hint, _ = _match(question, CONTEXT_MARK)
    tail = F.when(hint > 0, strip(F.substring(question, hint, F.length(question)))).otherwise("")
    background = F.array_join(F.filter(F.array(tail, before), lambda x: x != ""), "\n")
    return F.struct(background.alias("background"), strip(F.when(hint > 0, F.substring(question, F.lit(1), hint - 1)).otherwise(question)).alias("question"))


def lettered(user: Column, answer: Column) -> Column:
    """struct(background, question, options, index) of choices listed as `A. text` lines; null if they are not."""
    start, end = _match(user, CHOICES_MARK)
    lines = F.transform(F.split(F.substring(user, end, F.length(user)), "\n"), strip)
    misses = F.array_position(F.transform(lines, lambda x: x.rlike(CHOICE_LINE)), F.lit(False)).cast("int")
    listed_lines = F.when(misses > 0, F.slice(lines, F.lit(1), misses - 1)).otherwise(lines)
    options = F.transform(listed_lines, lambda x: F.regexp_replace(strip(F.regexp_extract(x, CHOICE_LINE, 2)), r"\.+$", ""))
    letter = F.regexp_extract(strip(answer), CHOICE_ANSWER, 1)
    index = F.ascii(F.upper(letter)) - 65
    parts = context_and_question(F.substring(user, F.lit(1), start - 1))
    good = (start > 0) & (letter != "") & (index < F.size(options)) & (F.size(F.array_distinct(options)) == F.size(options))
    return F.when(good, F.struct(parts["background"].alias("background"), parts["question"].alias("question"), options.alias("options"), index.alias("index")))


def listed(user: Column, answer: Column) -> Column:
    """The same struct for `Options: a, b, c.` with the answer given as text."""
    start, _ = _match(user, OPTIONS_MARK)
    options = F.filter(F.transform(F.split(F.regexp_extract(user, OPTIONS_MARK, 1), ","), strip), lambda x: x != "")
    lowered = F.transform(options, F.lower)
    index = F.array_position(lowered, F.lower(clean_answer(answer))).cast("int") - 1
    good = (start > 0) & (index >= 0) & (F.size(F.array_distinct(lowered)) == F.size(lowered))
    return F.when(good, F.struct(F.lit("").alias("background"), without_hints(F.substring(user, F.lit(1), start - 1)).alias("question"), options.alias("options"), index.alias("index")))


def number(c: Column) -> Column:
    """A number with or without thousands commas, below a thousand million."""
    v = F.replace(c, F.lit(","), F.lit("")).try_cast("double")
    return F.when(F.abs(v) < 1e9, v)


def number_text(v: Column) -> Column:
    return F.when(v == F.floor(v), v.cast("long").cast("string")).otherwise(v.cast("string"))


def near_numbers(v: Column) -> Column:
    """Plausible wrong numbers: neighbours of small ones, other years of years, multiples of the rest."""
    whole_number = v == F.floor(v)
    small = F.filter(F.transform(F.sequence(F.lit(-4), F.lit(4)), lambda d: v + d), lambda x: (x != v) & (x >= 0))
    years = F.transform(F.array(*[F.lit(d) for d in YEAR_OFFSETS]), lambda d: v + d)
    scaled = F.transform(F.array(*[F.lit(s) for s in SCALES]), lambda s: F.when(whole_number, F.round(v * s, 0)).otherwise(F.round(v * s, 2)))
    scaled = F.filter(F.array_sort(F.array_distinct(scaled)), lambda x: x != v)
    return F.when(whole_number & (F.abs(v) <= 20), small).when(whole_number & (v >= 1900) & (v <= 2100), years).otherwise(scaled)


def question_kinds(c: Column) -> Column:
    """The first four, three and two words."""
    w = F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), F.lit(0))
    return F.array(*[F.array_join(F.slice(w, 1, n), " ") for n in (4, 3, 2)])


def content_words(c: Column) -> Column:
    """Distinct words of more than three letters that are no stop words, in order."""
    w = F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z]{4,}"), F.lit(0)))
    return F.sort_array(F.filter(w, lambda x: ~x.isin(STOP_WORDS)))


def captions(c: Column) -> Column:
    """Captions run together, cut at sentence ends and where a small letter meets a capital; those of four words and more."""
    parts = F.split(strip(c), r"(?<=[.!?])\s+|(?<=[a-z])\s+(?=[A-Z])")
    return F.transform(F.filter(parts, lambda p: F.size(words(p)) >= 4), lambda p: F.regexp_replace(strip(p), r"\.+$", ""))


def clean_option(c: Column) -> Column:
    """`to the right of the cup` is `right`."""
    bare = F.regexp_replace(strip(c), r"^(to the|to|the|a|an)\s+", "")
    return strip(F.get(F.split(bare, r"\s+(?:of|than|in|on|at|from)\s+"), 0))


def alternatives(question: Column, answer: Column) -> Column:
    """Both options of `Is the sky blue or gray?` if the answer is one of them, else null."""
    pattern = r"(?U)(\w[\w -]*?) or (\w[\w -]*?)\?$"  # letters of any script
    before = words(F.regexp_extract(question, pattern, 1))
    n = F.size(before)
    kept = F.when((n > 1) & F.get(before, n - 2).isin(MODIFIERS), F.slice(before, n - 1, F.lit(2))).otherwise(F.slice(before, F.greatest(n, F.lit(1)), F.lit(1)))
    left, right = clean_option(F.array_join(kept, " ")), clean_option(F.regexp_extract(question, pattern, 2))
    good = (answer == left) | (answer == right)
    return F.when(good & (left != right) & (left != "") & (right != ""), F.array(left, right))


def humanise(c: Column) -> Column:
    """`Male_speech_and_man_speaking` to words."""
    return F.lower(F.replace(F.replace(c, F.lit("_and_"), F.lit(" and ")), F.lit("_"), F.lit(" ")))


def null_like(c: Column) -> Column:
    """Null, NaN as text, `none` and blank."""
    return c.isNull() | F.lower(strip(c)).isin("", "nan", "none")


def without_answer_request(c: Column) -> Column:
    """A question without the closing sentence that asks for yes or no or for one word."""
    return F.regexp_replace(strip(c), r"(?i)\s*Please answer (yes or no|this question with one word)\.?\s*$", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.[^./]+$", 0))


def media_kind(path: Column) -> Column:
    """image, audio or null by the file's extension."""
    e = extension(path)
    # Extensions of either kind.
    return F.when(e.isin(".jpg", ".jpeg", ".png", ".webp", ".bmp"), "image").when(e.isin(".wav", ".flac", ".mp3", ".ogg", ".m4a"), "audio")
