"""Spelling variants: words one edit apart, found in sorted lists, and the form each word leads to."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slidelake.llm.shared import Work

#: Characters of a word, after A-Z are lower-cased.
LETTERS = "[a-zÀ-ÿ]+"
#: Words of one shared beginning that make a list of their own; longer lists are cut.
LIST = 50_000
#: Words whose matrix rows are followed at a time; rows of sorted lists that a task holds, and that it goes through.
QUERIES, HELD, PER_TASK = 20_000, 60_000, 150_000
PAIRS = "word string, near string, near_n long"


def noisy_runs(docs: DataFrame, every: int = 97, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(word): each run of letters of every whole text, A-Z lower-cased.

    Of a run for which `every` divides the CRC-32 h of '<id>:<run>' the code point h mod length
    is missing. Null texts have no runs; a null id counts as an empty one.
    """
    ident = F.coalesce(F.col(id_column).cast("string"), F.lit(""))
    lowered = F.translate(F.col(text_column), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    runs = docs.select(ident.alias("id"), F.explode(F.regexp_extract_all(lowered, F.lit(LETTERS), F.lit(0))).alias("run"))
    hashed = runs.select("run", F.crc32(F.concat_ws(":", "id", "run")).alias("h"))
    at = F.expr("cast(h % char_length(run) AS int)")
    without = F.concat(F.expr("substring(run, 1, cast(h % char_length(run) AS int))"), F.substring("run", at + 2, F.lit(1 << 30)))
    return hashed.select(F.when(F.col("h") % every == 0, without).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame, least_length: int = 5, least_n: int = 3) -> DataFrame:
    """(word, n) of the words of at least so many code points and occurrences; counted before the shuffle."""
    counted = words.where(F.char_length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= least_n)


def _key(kind: Column | str, m: str, shared: str, rest: str) -> Column:
    """The name of a list: its kind and way, m, how many code points its words share, and these (and what else is equal)."""
    return F.concat_ws(":", F.lit(kind) if isinstance(kind, str) else kind, F.expr(m).cast("string"), F.expr(shared).cast("string"), F.expr(rest))


def _lists(words: DataFrame, work: Work) -> DataFrame:
    """(list, word, n): the lists in which words one edit apart meet.

    Of two such words, the shorter of length L, the first L // 2 code points are equal, or the
    last. So a word of length 2m or 2m + 1 stands in the list of its first m code points, and
    one of length 2m + 2 in that list too, as the longer of a pair; likewise for the words read
    backwards (way b). No list stays longer than LIST: where its words share no more than c code
    points, two of them one edit apart either share c + 1, and meet in a list of these, or their
    edit is at place c, and then all that follows is equal; they meet in a list of that (kind x),
    in which only the code point at c can differ.
    """
    ways = F.explode(F.array(F.struct(F.lit("f").alias("way"), F.col("word").alias("read")), F.struct(F.lit("b").alias("way"), F.reverse("word").alias("read"))))
    sizes = F.expr("if(char_length(read) % 2 = 0, array(char_length(read) div 2, char_length(read) div 2 - 1), array(char_length(read) div 2))")
    rows = words.select("n", ways.alias("w")).select("n", "w.way", "w.read").withColumn("m", F.explode(sizes)).where("m > 0")
    rows = rows.select(_key(F.col("way"), "m", "m", "substring(read, 1, m)").alias("list"), F.col("read").alias("word"), "n", "way", "m")
    found = []
    while True:
        shared = F.expr("size(filter(sequence(1, char_length(least)), i -> substring(least, 1, i) = substring(most, 1, i)))")
        long = rows.groupBy("list").agg(F.count("*").alias("count"), F.min("word").alias("least"), F.max("word").alias("most")).where(F.col("count") > LIST)
        long = work.table(long.select("list", shared.alias("c")), "long")
        if long.isEmpty():
            return reduce(DataFrame.union, [x.select("list", "word", "n") for x in [*found, rows]])
        found.append(rows.join(long, "list", "left_anti"))
        cut = work.table(rows.join(long, "list"), "cut")
        further = cut.where("char_length(word) > c")
        found.append(further.select(_key(F.concat("way", F.lit("x")), "m", "c", "substring(word, 1, c) || substring(word, c + 2)").alias("list"), "word", "n"))
        found.append(cut.select(_key(F.concat("way", F.lit("x")), "m", "c", "word").alias("list"), "word", "n"))
        rows = further.select(_key(F.col("way"), "m", "c + 1", "substring(word, 1, c + 1)").alias("list"), "word", "n", "way", "m")


def one_edit_pairs(groups: np.ndarray, prefix: np.ndarray, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (query, target) of words of one group that differ by exactly one edit.

    Rows are sorted by group and word, and the words of a group share their first `prefix`
    code points and are longer. The edit matrices are filled level by level: neighbours in the sorted
    list that share d code points (their LCP) share the first d rows, which are computed once
    for the range of all words with that beginning. Rows are three cells wide, for one edit
    needs no more. A range is left as soon as its row has no cell of 0 or 1.
    """
    length = np.fromiter(map(len, words), np.int64, len(words))
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    begin = np.concatenate([[0], np.cumsum(length)[:-1]]).astype(np.int64)

    def code(rows: np.ndarray, place: np.ndarray | int) -> np.ndarray:
        there = (place >= 0) & (place < length[rows])
        return np.where(there, codes[np.where(there, begin[rows] + place, 0)], 0)

    lcp = np.full(len(words), -1, np.int64)
    active = np.flatnonzero(groups[1:] == groups[:-1]) + 1
    lcp[active], depth = 0, 0
    while len(active):
        active = active[(length[active] > depth) & (length[active - 1] > depth) & (code(active, depth) == code(active - 1, depth))]
        depth += 1
        lcp[active] = depth
    first, last = np.searchsorted(groups, groups, "left"), np.searchsorted(groups, groups, "right")
    found: list[tuple[np.ndarray, np.ndarray]] = []

    for block in range(0, len(words), QUERIES):
        waiting = np.arange(block, min(block + QUERIES, len(words)))
        waiting = waiting[last[waiting] - first[waiting] > 1]
        waiting = waiting[np.argsort(prefix[waiting], kind="stable")]
        begins = prefix[waiting]
        # of each (query, range of targets): the row's cells at query length depth - 1, depth, depth + 1
        q = s = e = np.empty(0, np.int64)
        cells = np.empty((0, 3), np.int8)
        deep, depth = np.arange(len(words)), 0
        while len(q) or len(waiting):
            if not len(q):
                depth = int(begins[0])
            n = int(np.searchsorted(begins, depth, "right"))
            if n:  # lists whose shared beginning ends here join in
                new, waiting, begins = waiting[:n], waiting[n:], begins[n:]
                q, s, e = np.concatenate([q, new]), np.concatenate([s, first[new]]), np.concatenate([e, last[new]])
                cells = np.concatenate([cells, np.tile(np.array([[1, 0, 1]], np.int8), (n, 1))])
            # ranges of targets that share depth + 1 code points, by the LCPs of neighbours
            deep = deep[length[deep] > depth]
            starts = np.flatnonzero(lcp[deep] <= depth)
            ends = np.append(starts[1:], len(deep))
            left, right = deep[starts], deep[starts] + (ends - starts)
            lo, hi = np.searchsorted(left, s), np.searchsorted(left, e)
            many = hi - lo
            each = np.repeat(np.arange(len(q)), many)
            child = np.arange(len(each)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo, many)
            q, old = q[each], cells[each]
            s, e = left[child], right[child]
            char, size = code(s, depth), length[q]
            cells = np.empty_like(old)
            cells[:, 0] = np.minimum(old[:, 0] + (code(q, depth - 1) != char), old[:, 1] + 1)
            cells[:, 1] = np.minimum(np.minimum(old[:, 1] + (code(q, depth) != char), old[:, 2] + 1), cells[:, 0] + 1)
            cells[:, 2] = np.minimum(old[:, 2] + (code(q, depth + 1) != char), cells[:, 1] + 1)
            for k in (1, 2):
                cells[size < depth + k, k] = 2
            np.minimum(cells, 2, out=cells)
            depth += 1
            over = np.flatnonzero((length[s] == depth) & (np.abs(size - depth) <= 1))
            hit = over[cells[over, (size[over] - depth + 1)] == 1]
            found.append((q[hit], s[hit]))
            # a range goes where no cell is below 2, or where it has only the query itself
            stays = (cells.min(1) < 2) & ~((e - s == 1) & (q == s))
            q, s, e, cells = q[stays], s[stays], e[stays], cells[stays]
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])


def near_pairs(words: DataFrame, work: Work) -> DataFrame:
    """(word, near, near_n) of all different words (word, n) one edit apart, both ways round, each once."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= HELD:
                rows = pd.concat(held, ignore_index=True)
                ended = rows["list"] != rows["list"].iloc[-1]
                if ended.any():
                    yield pairs(rows[ended])
                    rows = rows[~ended]
                held = [rows]
        if held:
            yield pairs(pd.concat(held, ignore_index=True))

    def pairs(rows: pd.DataFrame) -> pd.DataFrame:
        change = (rows["list"] != rows["list"].shift()).to_numpy()
        of = change.cumsum() - 1
        lists = [(kind[0], len(kind) > 1, int(m), int(shared)) for kind, m, shared in (x.split(":", 3)[:3] for x in rows["list"][change])]
        # a word of a longer list may be no longer than what it shares: these begin one place before
        prefix = np.array([shared - (exact or shared > m) for _, exact, m, shared in lists], np.int64)[of] if lists else np.empty(0, np.int64)
        words, n, out = rows["word"].tolist(), rows["n"].to_numpy(), []
        q, t = one_edit_pairs(of, prefix, words)
        for i, j in zip(q.tolist(), t.tolist()):
            way, exact, m, shared = lists[of[i]]
            a, b = words[i], words[j]
            if min(len(a), len(b)) // 2 != m or exact and a[shared : shared + 1] == b[shared : shared + 1]:
                continue
            if way == "b":
                a, b = a[::-1], b[::-1]
                if a[:m] == b[:m]:  # found by their beginnings
                    continue
            out.append((a, b, int(n[j])))
        return pd.DataFrame(out, columns=["word", "near", "near_n"])

    # by count, since a row's work says more than its size
    spark = words.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * words.count() // PER_TASK)
    lists = _lists(words, work).repartition(tasks, "list").sortWithinPartitions("list", "word")
    return lists.mapInPandas(scan, PAIRS)


def _followed(forms: DataFrame, work: Work) -> DataFrame:
    """(word, root): the forms (word, form) followed to the last, by joining ways to ways, so in log2 steps."""
    ways = work.table(forms.select("word", F.col("form").alias("root")), "ways")
    while True:
        on = ways.select(F.col("word").alias("root"), F.col("root").alias("further"))
        longer = work.table(ways.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("went_on")), "longer")
        ended = longer.where("went_on").isEmpty()
        work.drop("ways")
        if ended:
            return longer.select("word", "root")
        ways = work.table(longer.select("word", "root"), "ways")
        work.drop("longer")


def variants(words: DataFrame, times: int = 2) -> DataFrame:
    """A row per word of (word, n), which must be distinct: form, root, n_near and form_n.

    Words are near if one inserted, deleted or replaced code point tells them apart. A word's
    form is its most frequent near word (of equals the first in code-point order), if that is
    `times` as frequent or more; the root is where forms lead in the end, or the word itself.
    Counts double from form to form, so ways are short. No words give no rows; words of one
    code point have no near words; any length goes.
    """
    work = Work(words.sparkSession, "spelling")
    words = work.table(words.select("word", "n"), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    nearest = near_pairs(words, work).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    much = F.col("form_n") >= F.lit(times) * F.col("n")
    judged = words.join(nearest, "word", "left").withColumn("form_n", -F.col("best.less"))
    judged = judged.select("word", F.when(much, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(much, F.col("form_n")).alias("form_n"))
    judged = work.table(judged, "judged")
    roots = _followed(judged.where("form is not null"), work)
    return judged.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The spelling variants among the words of all documents; see noisy_runs, vocabulary and variants.

    Rows that repeat count each; null and empty texts add nothing; other columns are ignored,
    whatever their names; an empty table gives no rows.
    """
    return variants(vocabulary(noisy_runs(docs, id_column=id_column, text_column=text_column)))
