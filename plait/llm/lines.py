"""Line deduplication by a suffix array over line ids, built by distributed prefix doubling.

The corpus is the sequence of its lines that hold a word, each document ending in a mark of its own. A suffix starts at
a line. Labels of depth d order suffixes by their first d lines; labels of depth 2d come from the pairs of labels at a
line and d lines on, sorted over ranges of partitions and numbered in that order. Suffixes whose label stands once have
found their place and leave, so each round works on repeated runs only, and doubling ends when none is left.

Suffixes with one label at depth d lie in one interval of common prefixes of d lines or more. Between two powers of two
the intervals are found by halving: the members that go no further together, and the first member of each interval that
does, are split by the label of half the step beyond what they share, all depths at once. A suffix's longest common
prefix with an earlier one is the deepest interval of which it is not the first member, by (doc_id, hash of the text,
line); a run is maximal if the suffix one line before does not cover it. Lines of such runs are later copies and go.

Documents whose whole text stands in an earlier one are known by their hash and are runs from end to end, so they stay
out of the array; the first of them stands for all. Labels are counted after pre-aggregation, so a line that a third of
all documents hold is one row there; joins back are plain equi-joins of written tables, which Spark splits where a key is hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plait.llm import common


def _keyed(docs: DataFrame) -> DataFrame:
    """row (all columns), doc (doc_id and hash of the text), text, and a second hash of the text, of each row."""
    text = F.col("text").cast("string")
    doc = F.struct(F.col("doc_id").alias("doc_id"), F.xxhash64(text).alias("th")).alias("doc")
    return docs.select(F.struct(*docs.columns).alias("row"), doc, text.alias("text"), F.xxhash64(text, F.lit(1)).alias("again"))


def _worded(text: Column) -> Column:
    """struct(x, line) of each line with a word; line counts all lines."""
    return F.filter(F.transform(F.split(text, "\n"), lambda x, i: F.struct(x.alias("x"), i.alias("line"))), lambda s: s["x"].rlike(common.WORD))


def _is_long(x: Column, min_words: int) -> Column:
    return F.regexp_count(x, F.lit(common.WORD)) >= min_words


def _here() -> Column:
    return F.struct("doc", "i")


def later_texts(docs: DataFrame) -> DataFrame:
    """doc of each document whose whole text stands in one with a smaller doc_id."""
    keys = _keyed(docs.where("text is not null")).select("doc", "again")
    first = keys.groupBy(F.col("doc.th").alias("t"), F.col("again").alias("g")).agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most")
    met = keys.join(first, (F.col("doc.th") == F.col("t")) & (F.col("again") == F.col("g"))).where("doc > least")
    return common.written(met.select("doc").distinct(), "lines-copies")


def numbered(docs: DataFrame, copies: DataFrame, min_words: int) -> DataFrame:
    """doc, i (number among lines with a word), long, a and b (hashes) of each line with a word, of the documents that are no copies."""
    rows = _keyed(docs).select("doc", F.posexplode(_worded(F.col("text"))).alias("i", "s"))
    x = F.col("s.x")
    rows = rows.select("doc", "i", _is_long(x, min_words).alias("long"), F.xxhash64(x).alias("a"), F.xxhash64(x, F.lit(1)).alias("b"))
    return rows.join(copies, "doc", "left_anti").dropDuplicates(["doc", "i"])


def _relabelled(rows: DataFrame, name: str) -> DataFrame:
    """rows whose pair (a, b) stands more than once: its label, whether they come later than its first place, and are that."""
    classes = rows.groupBy("a", "b").agg(F.count("*").alias("n"), F.min(_here()).alias("first")).where("n > 1")
    order = classes.repartitionByRange(common.spread(rows.sparkSession), "a", "b").sortWithinPartitions("a", "b")
    labels = common.written(order.select(F.col("a").alias("la"), F.col("b").alias("lb"), "first", F.monotonically_increasing_id().alias("label")), f"{name}-labels")
    joined = rows.join(labels, (F.col("a") == F.col("la")) & (F.col("b") == F.col("lb")))
    out = common.written(joined.select("doc", "i", "long", "label", (_here() > F.col("first")).alias("later")), name)
    common.dropped(labels)
    return out


def levels(docs: DataFrame, copies: DataFrame, min_words: int = 4) -> list[DataFrame]:
    """doc, i, long, label, later of all suffixes that share their first 1, 2, 4, ... lines with others, until none does; one table at least."""
    base = common.written(numbered(docs, copies, min_words), "lines")
    found = [_relabelled(base, "lines-depth1")]
    common.dropped(base)
    while found[-1].limit(1).count():
        depth = 1 << len(found) - 1
        there = Window.partitionBy("doc").orderBy("i").rangeBetween(depth, depth)
        after = found[-1].withColumn("next", F.max("label").over(there)).where(F.col("next").isNotNull())
        found.append(_relabelled(after.select("doc", "i", "long", F.col("label").alias("a"), F.col("next").alias("b")), f"lines-depth{2 * depth}"))
        common.settle(docs.sparkSession)
    if len(found) > 1:
        common.dropped(found.pop())
    return found


def _splitting(tables: list[DataFrame]) -> DataFrame:
    """level, doc, i, depth, h and g (hashes of the class): of each depth's classes, what is not of one class beyond."""
    out = None
    for k, table in enumerate(tables[1:], 1):
        rest = table
        if k + 1 < len(tables):
            beyond = tables[k + 1].where("later").select("doc", "i")  # the first of a deeper class stays and stands for it
            rest = table.join(beyond, ["doc", "i"], "left_anti")
        part = rest.select(F.lit(k).alias("level"), "doc", "i", F.lit(1 << k).alias("depth"), F.xxhash64("label", F.lit(k)).alias("h"), F.xxhash64(F.lit(k), "label").alias("g"))
        out = part if out is None else out.unionByName(part)
    several = out.groupBy("h", "g").agg(F.count("*").alias("n")).where("n > 1").select("h", "g")
    return out.join(several, ["h", "g"], "left_semi")


def prefixes(tables: list[DataFrame]) -> DataFrame:
    """doc, i, n: the most lines from i on that also start at an earlier place, of the suffixes with any, from levels()."""
    found = [t.where("later").select("doc", "i", F.lit(1 << k).alias("n")) for k, t in enumerate(tables)]
    if len(tables) > 1:
        labels = None
        for k, t in enumerate(tables):
            part = t.select(F.lit(k).alias("k"), F.col("doc").alias("d"), F.col("i").alias("p"), "label")
            labels = part if labels is None else labels.unionByName(part)
        labels = common.written(labels, "lines-all-labels")
        now = common.written(_splitting(tables), "lines-splitting")
        for r in range(1, len(tables)):
            asked = now.where(F.col("level") >= r)
            met = asked.join(labels, (F.col("level") - r == F.col("k")) & (F.col("doc") == F.col("d")) & (F.col("i") + F.col("depth") == F.col("p")), "left")
            child = [F.when(F.col("label").isNotNull(), F.xxhash64("h", "g", "label", F.lit(r))).alias("ch"), F.when(F.col("label").isNotNull(), F.xxhash64("label", "g", F.lit(r), "h")).alias("cg")]
            met = common.written(met.select("level", "doc", "i", "depth", "h", "g", *child), "lines-met")
            grown = met.where("ch is not null").groupBy("ch", "cg").agg(F.count("*").alias("size"), F.min(_here()).alias("first")).where("size > 1")
            grown = common.written(grown.select(F.col("ch").alias("c1"), F.col("cg").alias("c2"), "first"), "lines-grown")
            both = met.join(grown, (F.col("ch") == F.col("c1")) & (F.col("cg") == F.col("c2")), "left")
            step = F.call_function("shiftleft", F.lit(1), F.col("level") - r)
            both = common.written(both.select("*", (F.col("depth") + step).alias("deeper"), (_here() > F.col("first")).alias("later")), "lines-both")
            found.append(both.where("later").select("doc", "i", F.col("deeper").alias("n")))
            deep = both.where("first is not null").select("level", "doc", "i", F.col("deeper").alias("depth"), F.col("ch").alias("h"), F.col("cg").alias("g"))
            stay = both.where("first is null or not later").select("level", "doc", "i", "depth", "h", "g")
            common.dropped(met, grown, now)
            now = common.written(deep.unionByName(stay).where(F.col("level") > r), "lines-splitting")
            common.settle(now.sparkSession)
    every = found[0]
    for part in found[1:]:
        every = every.unionByName(part)
    return every.groupBy("doc", "i").agg(F.max("n").alias("n"))


def maximal(longest: DataFrame) -> DataFrame:
    """The rows of prefixes() that the suffix one line before does not cover."""
    before = Window.partitionBy("doc").orderBy("i").rangeBetween(-1, -1)
    return longest.withColumn("covered", F.max("n").over(before) > F.col("n")).where(~F.coalesce("covered", F.lit(False))).drop("covered")


def repeated_runs(docs: DataFrame, min_lines: int = 2) -> DataFrame:
    """doc_id, th, first, n: the maximal runs of min_lines lines or more that also start at an earlier place.

    first counts lines with a word from 0; th is the hash of the text.
    """
    copies = later_texts(docs)
    runs = maximal(prefixes(levels(docs, copies))).select("doc", F.col("i").alias("first"), "n")
    sizes = _keyed(docs).select("doc", F.size(_worded(F.col("text"))).alias("n"))
    whole = sizes.join(copies, "doc", "left_semi").distinct().select("doc", F.lit(0).alias("first"), "n")
    return runs.unionByName(whole).where(F.col("n") >= min_lines).select("doc.doc_id", "doc.th", "first", "n")


def later_copies(docs: DataFrame, min_lines: int = 2, min_words: int = 4) -> DataFrame:
    """doc, lines, whole: where a document has later copies, by number among its lines with a word; whole: its text is a copy.

    These are lines of repeated runs of min_lines lines, or of one line of min_words words.
    """
    copies = later_texts(docs)
    tables = levels(docs, copies, min_words)
    runs = maximal(prefixes(tables)).where(F.col("n") >= min_lines)
    found = runs.select("doc", F.explode(F.sequence("i", F.col("i") + F.col("n") - 1)).alias("i"))
    found = found.unionByName(tables[0].where("later and long").select("doc", "i"))
    each = found.groupBy("doc").agg(F.sort_array(F.collect_set("i")).alias("lines"))
    each = each.select("doc", "lines", F.lit(False).alias("whole")).unionByName(copies.select("doc", F.array().cast("array<int>").alias("lines"), F.lit(True).alias("whole")))
    each = common.written(each, "lines-gone")
    common.dropped(copies, *tables)
    return each


def dedup_lines(docs: DataFrame, min_lines: int = 2, min_words: int = 4, drop_emptied: bool = True) -> DataFrame:
    """docs(doc_id, text, ...) without the lines of later copies, with __n_lines and __n_removed (of lines with a word).

    A line goes if it lies in a run of min_lines lines, or is a line of min_words words, that also starts at an earlier
    place, by (doc_id, hash of the text, line), null doc_ids first. Lines without a word stay and do not part runs. Rows
    equal in doc_id and text count as one document and fare alike. Documents that lose their last word go if drop_emptied;
    null and empty texts stay as they are. All columns of docs are kept, whatever their names; where they have the two
    names themselves, the counts stand last. An empty table gives no rows.
    """
    gone = later_copies(docs, min_lines, min_words)
    common.settle(docs.sparkSession)
    rows = _keyed(docs).select("row", "doc", "text", _worded(F.col("text")).alias("worded")).join(gone.hint("merge"), "doc", "left")
    own = F.transform(F.col("lines"), lambda i: F.get("worded", i)["line"])
    short = F.filter("worded", lambda s: _is_long(s["x"], min_words))
    copied = F.transform(F.when(F.size("worded") >= min_lines, F.col("worded")).otherwise(short), lambda s: s["line"])
    rows = rows.withColumn("out", F.coalesce(F.when(F.col("whole"), copied).otherwise(own), F.array().cast("array<int>")))
    split = F.split("text", "\n")
    kept = F.transform(F.array(split), lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("out")), lambda p: F.get(x, p)), "\n"))[0]
    rows = rows.withColumn("kept", F.when(F.size("out") == 0, F.col("text")).otherwise(kept))
    if drop_emptied:
        rows = rows.where((F.size("out") == 0) | (F.size("out") < F.size("worded")))
    columns = [F.col("kept").alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns]
    n_lines = F.greatest(F.coalesce(F.size("worded"), F.lit(0)), F.lit(0))
    return rows.select(*columns, n_lines.cast("long").alias("__n_lines"), F.size("out").cast("long").alias("__n_removed"))
