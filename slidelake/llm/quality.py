"""Quality rules: counts of words, symbols and repetitions, and divergence from the language.

Everything here is built-in DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slidelake.llm.shared import small, stored

# The classes of characters, besides white space, symbols and all others.
CLASSES = {"upper": r"\p{Lu}+", "digit": r"[0-9]+", "stop": r"[.,;:!?'\"\-]+"}
SYMBOLS, SPACE = r"[#*$%&|<>]+", r"[\x20\x09-\x0D]+"
#: Characters, the most of many texts, that no class above has.
OTHERS = r"[a-zß-öø-ÿ]+"
#: What is taken off both ends of a word before it is compared with the common words.
AROUND = ".,;:!?\"'()"
#: Cells of the filter that words pass before they are looked up.
CELLS = 4096


def _measured(docs: DataFrame, text_column: str) -> DataFrame:
    """Adds _text, its _words, their hashes _hashes, and _marks: the text without OTHERS, which is short."""
    found = docs.withColumn("_text", F.coalesce(F.col(text_column), F.lit(""))).withColumn("_parts", F.split("_text", SPACE))
    empty = lambda i: F.when(F.get("_parts", i) == "", 1).otherwise(0)
    # only before a first and after a last white space is a part empty
    first, last = empty(F.lit(0)), empty(F.size("_parts") - 1)
    found = found.withColumn("_words", F.slice("_parts", first + 1, F.greatest(F.lit(0), F.size("_parts") - first - last))).drop("_parts")
    found = found.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    return found.withColumn("_marks", F.regexp_replace("_text", OTHERS, ""))


def _count(pattern: str) -> F.Column:
    """How many characters of a class the text has; the pattern is of runs of marks."""
    return (F.length("_marks") - F.length(F.regexp_replace("_marks", pattern, ""))).cast("long")


def base_rules(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed.

    n_repeat_words counts the words that are in a 3-word window found twice or more; windows
    are compared by a 64-bit hash. Null counts as a text without words.
    """
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    n = F.size("_hashes")
    from_word = lambda i: F.slice("_hashes", F.lit(i), n - 2)
    pairs = F.zip_with(from_word(1), from_word(2), lambda a, b: F.xxhash64(a, b))
    windows = F.when(n >= 3, F.zip_with(pairs, from_word(3), lambda a, b: F.xxhash64(a, b))).otherwise(F.array().cast("array<long>"))
    found = (
        _measured(docs, text_column)
        .withColumn("n_words", n.cast("long"))
        .withColumn("word_chars", F.length("_text") - _count(SPACE))
        .withColumn("n_symbols", _count(SYMBOLS))
        .withColumn("_lines", lines)
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
        .withColumn("_windows", windows)
    )
    again = F.size(F.array_distinct("_windows")) < F.size("_windows")
    pairs = F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    found = found.withColumn("_sorted", F.when(again, pairs))
    equal = lambda x, i: F.coalesce(F.get("_sorted", i)["h"] == x["h"], F.lit(False))
    twice = F.filter("_sorted", lambda x, i: equal(x, i - 1) | equal(x, i + 1))
    found = found.withColumn("_at", F.sort_array(F.transform(twice, lambda x: x["i"])))
    covered = F.aggregate(F.transform("_at", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("_at", i + 1) - p, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    found = found.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    return found.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).drop("_lines", "_windows", "_sorted", "_at")


def _classes() -> F.Column:
    """Counts of the classes of characters: those of CLASSES, white space, symbols, others."""
    counts = [_count(p) for p in CLASSES.values()]
    counts += [F.length("_text").cast("long") - F.col("word_chars"), F.col("n_symbols")]
    rest = F.length("_text").cast("long")
    for c in counts:
        rest = rest - c
    return F.array(*counts, rest)


def common_words(rows: DataFrame, words: int, least_words: int) -> DataFrame:
    """(ref_lang, ref_hashes, ref_cells): the common words of each language, and a filter for them.

    Of the words of letters alone, without the marks around them, those that the most documents
    of the language have twice or more in one form, and of equal ones the first. Only documents
    of at least `least_words` words count, each once a word. Counts are exact, made in part
    before the shuffle.
    """
    parts = rows.select("ref_lang", F.split(F.coalesce("text", F.lit("")), SPACE).alias("parts"))
    # nothing stands before a first and after a last white space
    n = F.size("parts") - F.when(F.get("parts", F.lit(0)) == "", 1).otherwise(0) - F.when(F.get("parts", F.size("parts") - 1) == "", 1).otherwise(0)
    found = parts.select("ref_lang", F.sort_array(F.when(n >= least_words, F.col("parts"))).alias("s"))
    twice = F.array_distinct(F.transform(F.array_distinct(F.filter("s", lambda w, i: w == F.get("s", i - 1))), _bare))
    each = found.select("ref_lang", F.explode(twice).alias("w")).groupBy("ref_lang", "w").agg(F.count("*").alias("n"))
    turn = Window.partitionBy("ref_lang").orderBy(F.desc("n"), "w")
    top = each.where(F.col("w").rlike(r"^[\p{L}\p{M}]+$")).withColumn("turn", F.row_number().over(turn)).where(F.col("turn") <= words)
    # at most `words` rows of a language
    lists = top.groupBy("ref_lang").agg(F.array_sort(F.collect_list(F.struct("turn", "w"))).alias("top"))
    hashes = lists.select("ref_lang", F.transform("top", lambda x: F.xxhash64(x["w"])).alias("ref_hashes"))
    cells = F.transform("ref_hashes", _cell)
    return hashes.withColumn("ref_cells", F.transform(F.sequence(F.lit(0), F.lit(CELLS - 1)), lambda i: F.array_contains(cells, i)))


def _bare(word: F.Column) -> F.Column:
    """A word as it is compared with the common words."""
    return F.btrim(word, F.lit(AROUND))


def _cell(hashed: F.Column) -> F.Column:
    return F.pmod(hashed, F.lit(CELLS)).cast("int")


def _hits() -> F.Column:
    """(i, n) for each common word of the text: its place from 1 and how often it occurs."""
    likely = F.filter(F.transform("_words", lambda w: F.xxhash64(_bare(w))), lambda h: F.get("ref_cells", _cell(h)))
    places = F.sort_array(F.filter(F.transform(likely, lambda h: F.array_position("ref_hashes", h).cast("int")), lambda i: i > 0))
    # where each place's run starts in the sorted places
    starts = lambda s: F.filter(F.transform(s, lambda x, k: F.when((k == 0) | (F.get(s, k - 1) != x), k)), lambda k: k.isNotNull())
    runs = lambda s: F.transform(F.array(starts(s)), lambda b: F.transform(b, lambda k, j: F.struct(F.get(s, k).alias("i"), (F.coalesce(F.get(b, j + 1), F.size(s)) - k).alias("n"))))[0]
    return F.transform(F.array(places), runs)[0]


def references(features: DataFrame) -> DataFrame:
    """(ref_lang, ref_shares, ref_classes): shares of the common words in all words, sums of the classes.

    Over the documents that pass the base rules; a language without any has those of all.
    """
    width = len(CLASSES) + 3
    totals = features.groupBy("ref_lang", "base_failed").agg(F.sum("n_words").alias("all_words"), F.array(*[F.sum(F.coalesce(F.get("classes", F.lit(i)), F.lit(0))) for i in range(width)]).alias("ref_classes"))
    each = features.select("ref_lang", "base_failed", F.explode("hits").alias("x")).groupBy("ref_lang", "base_failed", "x.i").agg(F.sum("x.n").alias("n"))
    # at most as many rows as the language has common words
    counts = each.groupBy("ref_lang", "base_failed").agg(F.map_from_entries(F.collect_list(F.struct("i", "n"))).alias("counts"))
    both = totals.join(counts, ["ref_lang", "base_failed"], "left")
    chosen = both.groupBy("ref_lang").agg(F.min_by(F.struct("all_words", "ref_classes", "counts"), "base_failed").alias("of"))
    size = F.coalesce(F.array_max(F.map_keys("of.counts")), F.lit(0))
    shares = F.transform(F.sequence(F.lit(0), size), lambda i: F.coalesce(F.try_element_at("of.counts", i), F.lit(0)) / F.col("of.all_words"))
    return chosen.select("ref_lang", F.col("of.ref_classes").alias("ref_classes"), F.when(F.col("of.all_words") > 0, shares).otherwise(F.array().cast("array<double>")).alias("ref_shares"))


def sparse_distance(hits: F.Column, n: F.Column) -> F.Column:
    """js_distance of the words of a text to its language's; hits has its candidate words alone."""
    term = lambda a, b: F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0) + F.when(b > 0, b * F.log2(2 * b / (a + b))).otherwise(0.0)
    pairs = F.filter(F.transform(hits, lambda x: F.struct((x["n"] / n).alias("a"), F.get("ref_shares", x["i"]).alias("b"))), lambda x: x["b"].isNotNull())
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("b"), F.lit(0.0).alias("sum"))
    add = lambda acc, x: F.struct((acc["a"] + x["a"]).alias("a"), (acc["b"] + x["b"]).alias("b"), (acc["sum"] + term(x["a"], x["b"])).alias("sum"))

    def total(acc: F.Column) -> F.Column:
        common = F.aggregate("ref_shares", F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))
        others = term(F.greatest(F.lit(0.0), 1 - acc["a"]), F.greatest(F.lit(0.0), 1 - common))
        return F.sqrt(F.greatest(F.lit(0.0), acc["sum"] + others + common - acc["b"]) / 2)

    return F.when(n > 0, F.aggregate(pairs, zero, add, total))


def limits(found: DataFrame, distance: str, size: str, spread: float, least: float) -> DataFrame:
    """(ref_lang, band, middle, limit): of the distances of a language's documents of a size.

    Documents count together if twice the binary logarithm of their size is the same, rounded down. The
    limit is the median and `spread` times the distance between the quartiles, of which `least`
    is the smallest. Quantiles are taken from exact counts of distances in steps of 1/1000.
    """
    steps = found.where(f"{distance} is not null and not base_failed").groupBy("ref_lang", band(size).alias("band"), F.ceil(F.col(distance) * 1000).alias("step")).agg(F.count("*").alias("n"))
    q = steps.groupBy("ref_lang", "band").agg(F.expr("percentile(step, array(0.25, 0.5, 0.75), n)").alias("q"))
    return q.select("ref_lang", "band", (F.col("q")[1] / 1000).alias("middle"), (F.col("q")[1] / 1000 + spread * F.greatest(F.lit(least), (F.col("q")[2] - F.col("q")[0]) / 1000)).alias("limit"))


def band(size: str) -> F.Column:
    return F.floor(2 * F.log2(F.greatest(F.col(size), F.lit(1)))).cast("int")


def js_distance(p: str, q: str) -> F.Column:
    """Jensen-Shannon distance (base 2) of two histograms of counts; null if one is empty."""
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)

    def part(x: F.Column, y: F.Column) -> F.Column:
        return F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(0.0)

    x, y = total(F.col(p)), total(F.col(q))
    terms = F.zip_with(p, q, lambda a, b: part(a / x, b / y) + part(b / y, a / x))
    return F.when((x > 0) & (y > 0), F.sqrt(F.greatest(F.lit(0.0), total(terms) / 2)))


def quality(docs: DataFrame, class_limit: float = 0.35, word_limit: float = 0.45, words: int = 64, least_words: int = 50, least_chars: int = 200, id_column: str = "doc_id", text_column: str = "text", lang: str = "lang") -> DataFrame:
    """Per row: doc_id, the base counts, base_failed, kept, class_js and word_js.

    A document is kept if it passes the base rules, and neither histogram is farther from its
    language's reference than its limit. The references are those of the documents that pass
    the base rules. A limit comes from the distances of all such documents of the language that
    have about the same size (see limits), and is at most `class_limit` or `word_limit`. For
    words it also lies at least 15 % of the way from a text without any common word to the
    median, so that such a text is beyond it. A histogram counts only from `least_chars`
    characters or `least_words` words.

    Null and empty texts fail the base rules. Null lang is a language of its own, the same as an
    empty one. Rows that repeat are judged each. Texts are read whole, however long; ties among
    common words go to the first word. Other columns are ignored, whatever their names; an
    empty table gives no rows.
    """
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"), F.coalesce(F.col(lang), F.lit("")).alias("ref_lang"))
    common = small(stored(common_words(rows, words, least_words), "words"))
    found = base_rules(rows).join(common, "ref_lang", "left")
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    hits = F.coalesce(_hits(), F.array().cast("array<struct<i:int,n:int>>")).alias("hits")
    features = found.select("doc_id", "ref_lang", *counts, F.length("_text").alias("n_chars"), _classes().alias("classes"), hits)
    features = stored(features, "features")
    found = features.join(small(stored(references(features), "references")), "ref_lang")
    found = found.withColumn("class_js", F.when(F.col("n_chars") >= least_chars, js_distance("classes", "ref_classes")))
    found = found.withColumn("word_js", F.when(F.col("n_words") >= least_words, sparse_distance(F.col("hits"), F.col("n_words"))))
    without = sparse_distance(F.array().cast("array<struct<i:int,n:int>>"), F.lit(1)).alias("without")
    found = stored(found.select("doc_id", "ref_lang", *counts, "n_chars", "class_js", "word_js", without), "distances")
    by_class = limits(found, "class_js", "n_chars", 8.0, 0.02).select("ref_lang", F.col("band").alias("chars"), F.col("limit").alias("of_class"))
    by_word = limits(found, "word_js", "n_words", 3.0, 0.02).select("ref_lang", F.col("band").alias("words"), F.col("limit").alias("of_word"), "middle")
    found = found.withColumn("chars", band("n_chars")).withColumn("words", band("n_words"))
    found = found.join(small(by_class), ["ref_lang", "chars"], "left").join(small(by_word), ["ref_lang", "words"], "left")
    of_word = F.when(F.col("middle") < F.col("without"), F.least("of_word", 0.15 * F.col("middle") + 0.85 * F.col("without"))).otherwise(F.col("of_word"))
    near = F.coalesce(F.col("class_js") <= F.least("of_class", F.lit(class_limit)), F.lit(True)) & F.coalesce(F.col("word_js") <= F.least(of_word, F.lit(word_limit)), F.lit(True))
    return found.select("doc_id", *counts, (~F.col("base_failed") & near).alias("kept"), "class_js", "word_js")
