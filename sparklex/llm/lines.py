"""Line dedup: repeated runs of lines, by a suffix array over line ids, in DataFrame functions only.

The lines of all documents are one sequence of ids, with an end after each document. Prefix doubling ranks the suffixes by
their first 1, 2, 4, ... lines: the rank for twice the depth is that of the pair of ranks at a place and the depth further
on, named in sorted order. Suffixes that share a rank at some depth are an interval of the suffix array whose longest common
prefix is at least that deep: a repeated run. Suffixes whose rank is theirs alone are discarded, as no longer run repeats
there, so that rounds shrink, and they end when no run repeats. In each interval the first place stands, all others are
later copies. Of a place, the deepest interval that it is a later copy in counts; next places of which the first ones are next to each other, too, are
one maximal run, of so many lines as places and the depth less one, and the lines of these runs are deleted. A line of many words is a passage by itself: with min_words, later
copies of single lines that long are deleted, too.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparklex.llm.scratch import written

#: Lines of the shortest run that is deleted: a power of two.
MIN_RUN = 2
#: A line that counts has something else than ASCII white space; lines without go only with the run around them.
WORD = "[^\\x20\\x09-\\x0D]"
#: Words of the shortest line that is a passage by itself, where lines are deleted singly.
MIN_WORDS = 20
PLACE = ("id", "version", "i")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id and version (tells texts of one id apart) before the columns of docs, which become a struct, so that no names clash."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)).alias("id"), F.xxhash64(F.col(text_col)).alias("version"), F.split(F.col(text_col), "\n").alias("lines"), row)


def _wide(line: Column, min_words: int) -> Column:
    """Whether a line has so many words; possessive, so that each character is met once."""
    return line.rlike(f"\\A[\\x20\\x09-\\x0D]*+(?:{WORD}++[\\x20\\x09-\\x0D]++){{{min_words - 1}}}{WORD}")


def line_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int | None = None) -> DataFrame:
    """id, version, i (number among the document's lines with a word), at (among all lines), line (its digest).

    With min_words, wide, too: whether the line has so many words.
    """
    keyed = _keyed(docs, id_col, text_col).select("id", "version", "lines")
    counted = F.filter(F.transform("lines", lambda x, k: F.struct(k.alias("at"), F.when(x.rlike(WORD), F.unhex(F.md5(x))).alias("line"), *([_wide(x, min_words).alias("wide")] if min_words else []))), lambda s: s["line"].isNotNull())
    rows = keyed.select("id", "version", F.posexplode(counted).alias("i", "l"))
    return rows.select("id", "version", "i", F.col("l.at").alias("at"), F.col("l.line").alias("line"), *([F.col("l.wide").alias("wide")] if min_words else []))


def _named(rows: DataFrame, keys: list[str], depth: int) -> tuple[DataFrame, DataFrame]:
    """Names equal keys in their order: the intervals (depth, rank, keys, first place) of two or more rows, and these rows with rank and first; at and last are where their runs begin and end."""
    found = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min(F.struct(*PLACE)).alias("first")).where("n > 1")
    ordered = found.repartitionByRange(*keys).sortWithinPartitions(*keys)
    intervals = written(ordered.select(F.lit(depth).alias("depth"), F.monotonically_increasing_id().alias("rank"), *keys, "n", "first"), "lcp-intervals")
    ranked = rows.join(intervals.select(*keys, "rank", "first"), keys).select(*PLACE, "at", "last", "rank", "first", (F.struct(*PLACE) != F.col("first")).alias("copy"), *[c for c in rows.columns if c == "wide"])
    return intervals, written(ranked, "suffix-ranks")


def suffix_levels(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int | None = None) -> list[tuple[int, DataFrame, DataFrame]]:
    """For each depth with repeated runs: the depth in lines, the intervals and the ranked places (with min_words, those of depth 1 with wide)."""
    level, depth = _named(line_ids(docs, id_col, text_col, min_words).withColumn("last", F.col("at")), ["line"], 1), 1
    levels = []
    while not level[1].isEmpty():
        levels.append((depth, *level))
        ranked = level[1].select(*PLACE, "at", "last", "rank").distinct()
        after = ranked.select("id", "version", (F.col("i") - depth).alias("i"), "last", F.col("rank").alias("rank2"))
        pairs = ranked.drop("last").withColumnRenamed("rank", "rank1").join(after, list(PLACE))
        depth *= 2
        level = _named(pairs, ["rank1", "rank2"], depth)
    return levels


def maximal_runs(levels: list[tuple[int, DataFrame, DataFrame]], min_run: int) -> DataFrame | None:
    """id, version, begin, end (line numbers, both in the run), n (lines with a word) of each later copy of a maximal run; None without any.

    All of a document is in one partition, as big as its lines; nothing of other documents is.
    """
    parts = [r.where("copy").select(*PLACE, "at", "last", "first", F.lit(d).alias("depth")) for d, _, r in levels if d >= min_run]
    if not parts:
        return None
    places = reduce(DataFrame.unionByName, parts).repartition("id", "version")
    deepest = Window.partitionBy(*PLACE).orderBy(F.desc("depth"))
    source = ("id", "version", "depth", "first.id", "first.version", "shift")
    places = places.withColumn("n", F.row_number().over(deepest)).where("n = 1").withColumn("shift", F.col("i") - F.col("first.i"))
    along = Window.partitionBy(*source).orderBy("i")
    runs = places.withColumn("run", F.col("i") - F.row_number().over(along)).groupBy("id", "version", "depth", F.col("first.id").alias("from_id"), F.col("first.version").alias("from_version"), "shift", "run")
    return runs.agg(F.min("at").alias("begin"), F.max("last").alias("end"), (F.count("*") + F.max("depth") - 1).alias("n")).select("id", "version", "begin", "end", "n")


def _cut(docs: DataFrame, id_col: str, text_col: str, min_run: int, min_words: int | None) -> DataFrame:
    """row, lines, gone (numbers of the lines that go, null if none), deepest of each row of docs."""
    if min_run < 1 or min_run & (min_run - 1):
        raise ValueError("min_run isn't a power of two")
    if min_words is not None and min_words < 1:
        raise ValueError("min_words isn't positive")
    levels = suffix_levels(docs, id_col, text_col, min_words)
    keyed = _keyed(docs, id_col, text_col)
    runs = maximal_runs(levels, min_run)
    # single lines of min_words words or more; all of depth 1 go anyway if min_run is 1
    if min_words and levels and min_run > 1:
        alone = levels[0][2].where("copy AND wide").select("id", "version", F.col("at").alias("begin"), F.col("at").alias("end"), F.lit(1).cast("long").alias("n")).distinct()
        runs = alone if runs is None else runs.unionByName(alone)
    if runs is None:
        return keyed.withColumns({"gone": F.lit(None).cast("array<int>"), "deepest": F.lit(0)})
    gone = runs.groupBy("id", "version").agg(F.array_distinct(F.flatten(F.collect_list(F.sequence("begin", "end")))).alias("gone"), F.max("n").alias("deepest"))
    return keyed.join(gone, ["id", "version"], "left")


def _stay() -> Column:
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    return F.when(F.col("gone").isNull(), F.col("lines")).otherwise(F.transform(left, lambda k: F.get("lines", k)))


def report(docs: DataFrame, min_run: int = MIN_RUN, id_col: str = "doc_id", text_col: str = "text", min_words: int | None = None) -> DataFrame:
    """doc_id, text (that is left), n_lines, n_removed, deepest (lines of the longest maximal run with a later copy here) of each row.

    A run is min_run or more consecutive lines with a word (\\n-split, compared as they are); of equal runs, that with the
    smallest place (doc_id, then number of the line) stays, and the lines of all others go, with the lines without a word
    between them. With min_words, a line of so many words or more is a run by itself. A null text has no lines and stays null; an empty one has one line without a word. Null ids come last.
    Repeated rows (equal id and text) are one place: they aren't copies of each other.
    """
    cut = _cut(docs, id_col, text_col, min_run, min_words).withColumn("stay", _stay())
    n = F.when(F.col("lines").isNull(), 0).otherwise(F.size("lines"))
    return cut.select(
        F.col(f"row.`{id_col}`").cast("long").alias("doc_id"), F.array_join("stay", "\n").alias("text"), n.cast("long").alias("n_lines"),
        F.coalesce(F.size("lines") - F.size("stay"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce("deepest", F.lit(0)).cast("long").alias("deepest"),
    )


def deduplicated(docs: DataFrame, min_run: int = MIN_RUN, id_col: str = "doc_id", text_col: str = "text", min_words: int | None = None) -> DataFrame:
    """docs with later copies of repeated runs cut out of its texts; a document of which no line with a word is left goes.

    Documents that had no such line before stay as they were, null texts too. All columns stay.
    """
    cut = _cut(docs, id_col, text_col, min_run, min_words).withColumn("stay", _stay())
    empty = F.col("gone").isNotNull() & ~F.exists("stay", lambda x: x.rlike(WORD))
    columns = [F.when(F.col("gone").isNull(), F.col(f"row.`{c}`")).otherwise(F.array_join("stay", "\n")).alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    return cut.where(~empty).select(*columns)
