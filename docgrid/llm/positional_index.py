"""Benchmark decontamination with a distributed positional inverted index.

Test items are cut into windows of consecutive words. One pass over the corpus
counts the items' words; a second stores the postings (row, word, position) of
the words that are among the two rarest of some window, and with each posting
the words around it. A window is then sought from its rarest word: its list,
moved back by the word's offset in the window, is intersected with the list of
the second rarest word, moved likewise, and what is left is compared word by
word with the stored surroundings, which gives exact phrase matches. Lists that
meet with a bounded shift give proximity matches. Windows with a word that the
corpus lacks are never sought. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docgrid.llm import scratch
from docgrid.llm.scratch import ROW
from docgrid.llm.text import lower_ascii

WIDTH = 10
#: A word, after lower-casing A-Z: digits, a-z and all that isn't ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text in order; null has none."""
    return F.regexp_extract_all(lower_ascii(text), F.lit(WORD), F.lit(0))


class Windows:
    """Windows of test items: ``words`` (wid, words), ``owners`` (wid, item_id), ``terms`` (tid, term), all stored.

    An item of fewer words than a window, but not none, is one window. The
    windows of items with a null id are sought like all others, but have no
    owner, as a null can't be named in a result.
    """

    def __init__(self, items: DataFrame, item_id: str = "item_id", text: str = "text", width: int = WIDTH):
        self.width = width
        cut = items.select(F.col(item_id).cast("string").alias("item_id"), words(F.col(text)).alias("w")).where("size(w) > 0")
        size = F.least(F.lit(width), F.size("w"))
        slices = F.transform(F.sequence(F.lit(1), F.size("w") - size + 1), lambda i: F.slice(F.col("w"), i, F.least(F.lit(width), F.size("w"))))
        owned = scratch.keep(cut.select("item_id", F.explode(slices).alias("words")).distinct(), "owned")
        self.words = scratch.keep(owned.select("words").distinct().withColumn("wid", F.monotonically_increasing_id()), "windows")
        self.owners = scratch.keep(owned.where("item_id is not null").join(self.words, "words").select("wid", "item_id"), "owners")
        terms = self.words.select(F.explode("words").alias("term")).distinct()
        self.terms = scratch.keep(terms.withColumn("tid", F.monotonically_increasing_id()), "terms")


class Index:
    """Postings of the windows' rarest words in ``rows``, which need a stored ``ROW``.

    ``plan``: wid, words, t1, o1, t2, o2 - the rarest and second rarest word of
    each window that can occur, with their offsets; t2 is null in a window of
    one word repeated. ``postings``: ROW, tid, pos, and for words that are the
    rarest of some window from, around. ``heads``: ROW, n_words of every row.
    """

    def __init__(self, rows: DataFrame, windows: Windows, text: str = "text"):
        self.windows, width = windows, windows.width
        tokens = scratch.keep(rows.select(ROW, words(F.col(text)).alias("w")), "tokens")  # to take them from the texts costs more than to read them twice
        # the outer form: before a plain explode Spark filters by the array's size, and so takes the words twice
        seen = tokens.select(F.explode_outer("w").alias("term")).join(scratch.sized(windows.terms), "term")
        often = scratch.keep(seen.groupBy("tid").agg(F.count(F.lit(1)).alias("often")), "often")
        parts = windows.words.select("wid", "words", F.posexplode("words").alias("o", "term")).join(windows.terms, "term").join(often, "tid", "left")
        ranked = parts.groupBy("wid").agg(F.first("words").alias("words"), F.array_sort(F.collect_list(F.struct("often", "tid", "o"))).alias("r"))
        ranked = ranked.where(~F.exists("r", lambda x: x["often"].isNull())).withColumn("a", F.col("r")[0])
        ranked = ranked.withColumn("b", F.try_element_at(F.filter("r", lambda x: x["tid"] != F.col("a.tid")), F.lit(1)))
        plan = ranked.select("wid", "words", F.col("a.tid").alias("t1"), F.col("a.o").alias("o1"), F.col("b.tid").alias("t2"), F.col("b.o").alias("o2"))
        self.plan = scratch.keep(plan, "plan")
        roles = self.plan.select(F.col("t1").alias("tid"), F.lit(1).alias("rarest")).union(self.plan.where("t2 is not null").select("t2", F.lit(0)))
        roles = roles.groupBy("tid").agg(F.max("rarest").alias("rarest")).join(windows.terms, "tid")
        every = tokens.select(ROW, "w", F.posexplode_outer("w").alias("pos", "term")).join(scratch.sized(scratch.keep(roles, "roles")), "term", "left")
        every = every.where("tid is not null or pos is null or pos = 0")
        start = F.greatest(F.col("pos") - (width - 1), F.lit(0))
        near = F.when(F.col("rarest") == 1, F.slice("w", start + 1, F.lit(2 * width - 1)))
        head = F.when(F.coalesce("pos", F.lit(0)) == 0, F.size("w"))
        stored = scratch.keep(every.select(ROW, "tid", "pos", start.alias("from"), near.alias("around"), head.cast("long").alias("n_words")), "postings")
        scratch.let_go(tokens)
        self.heads = stored.where("n_words is not null").select(ROW, "n_words")
        self.postings = stored.where("tid is not null").select(ROW, "tid", "pos", "from", "around")

    def phrases(self) -> DataFrame:
        """(ROW, wid, start, size): every place where a window's words stand in order."""
        plan = scratch.sized(self.plan)
        lists = self.postings.where("around is not null").withColumnRenamed("tid", "t1")
        starts = lists.select(ROW, "t1", "pos").join(plan.select("t1", "o1", "t2", "o2", "wid"), "t1").withColumn("start", F.col("pos") - F.col("o1")).where("start >= 0")
        second = self.postings.select(ROW, F.col("tid").alias("t2"), F.col("pos").alias("p2"))
        met = starts.where("t2 is not null").withColumn("p2", F.col("start") + F.col("o2")).join(second, [ROW, "t2", "p2"], "left_semi")
        cols = [ROW, "pos", "wid", "start"]
        met = met.select(*cols).union(starts.where("t2 is null").select(*cols))
        told = met.join(lists.select(ROW, "pos", "t1", "from", "around"), [ROW, "pos"]).join(plan.select("wid", "words"), "wid")
        same = F.slice("around", F.col("start") - F.col("from") + 1, F.size("words")) == F.col("words")
        return told.where(same).select(ROW, "wid", "start", F.size("words").alias("size"))

    def proximities(self, slop: int) -> DataFrame:
        """(ROW, wid, start, shift): the two rarest words of a window stand at most ``slop`` words off their places."""
        one = self.postings.withColumnRenamed("tid", "t1").select(ROW, "t1", "pos")
        one = one.join(scratch.sized(self.plan).where("t2 is not null"), "t1")
        one = one.select(ROW, "wid", "t2", (F.col("pos") - F.col("o1")).alias("start"), (F.col("pos") - F.col("o1") + F.col("o2")).alias("want"))
        reach = slop + 1
        one = one.withColumn("cell", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda k: F.floor(F.col("want") / reach) + k)))
        two = self.postings.select(ROW, F.col("tid").alias("t2"), "pos", F.floor(F.col("pos") / reach).alias("cell"))
        pairs = one.join(two, [ROW, "t2", "cell"]).withColumn("shift", F.col("pos") - F.col("want"))
        return pairs.where(F.abs("shift") <= slop).select(ROW, "wid", "start", "shift")


def contamination(rows: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = WIDTH) -> DataFrame:
    """One row per row of ``rows``: ROW, n_words, n_hit, n_items, items_sha256, contaminated.

    ``n_hit`` counts words inside any occurrence of a window. Null texts have no
    words; without items or words nothing is hit, and items_sha256 is that of
    the empty text. Equal items with several ids are all named. Items with a null
    id count in ``n_hit`` and ``contaminated``, but not in ``n_items`` and
    ``items_sha256``; the SQL of op4_decontamination leaves them out of all four.
    """
    windows = Windows(items, item_id, item_text, width)
    index = Index(rows, windows, text)
    found = scratch.keep(index.phrases().distinct(), "found")
    in_row = Window.partitionBy(ROW).orderBy("start", "size")
    before = F.max(F.col("start") + F.col("size")).over(in_row.rowsBetween(Window.unboundedPreceding, -1))
    end = F.col("start") + F.col("size")
    fresh = F.greatest(F.lit(0), end - F.greatest(F.col("start"), F.coalesce(before, F.lit(0))))
    hit = found.select(ROW, "start", "size").distinct().select(ROW, fresh.alias("fresh")).groupBy(ROW).agg(F.sum("fresh").alias("n_hit"))
    named = found.select(ROW, "wid").distinct().join(scratch.sized(windows.owners), "wid").select(ROW, "item_id").distinct()
    named = named.groupBy(ROW).agg(F.count(F.lit(1)).alias("n_items"), F.array_join(F.array_sort(F.collect_list("item_id")), ",").alias("items"))
    return (
        index.heads.join(hit, ROW, "left")
        .join(named, ROW, "left")
        .select(
            ROW,
            "n_words",
            F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.coalesce("n_items", F.lit(0)).alias("n_items"),
            F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"),
            (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        )
    )


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the rows that hold a window of a test item."""
    rows = scratch.with_row_ids(docs, "docs")
    hit = scratch.settled(lambda: contamination(rows, items, text).where("contaminated").select(ROW), "contaminated")
    return scratch.without_rows(rows, hit, docs)
