"""Exact duplicates by deterministic block naming.

Every text is cut into blocks of a fixed number of bytes. Distinct blocks are
sorted and numbered, so that equal blocks, and only they, have equal integer
names. Then adjacent names are paired, distinct pairs are sorted and numbered
in turn, and so on until one name is left for a text: texts of as many levels
are equal exactly if these names are. Only DataFrame functions are used.

Block contents cross the network once, after a partial ``distinct``: that pass
proves which 64-bit hashes stand for a single content. Blocks whose hash stands
for several contents are told apart by the contents themselves. All further
sorts, joins and levels move integers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docgrid.llm import scratch
from docgrid.llm.scratch import ROW
from docgrid.llm.text import lower_ascii

BLOCK_BYTES = 4096


def _blocks(rows: DataFrame, text: str, size: int) -> DataFrame:
    """(ROW, n, sha, pos, block): the blocks of the normalised text; an empty text has one empty block."""
    cut = rows.select(ROW, lower_ascii(F.col(text)).cast("binary").alias("b"))
    cut = cut.select(ROW, "b", F.greatest(F.lit(1), F.ceil(F.octet_length("b") / size)).cast("int").alias("n"), F.sha2("b", 256).alias("sha"))
    parts = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.substring(F.col("b"), i * size + 1, F.lit(size)))
    return cut.select(ROW, "n", "sha", F.posexplode(parts).alias("pos", "block"))


def _numbered(keys: DataFrame, name: str) -> DataFrame:
    """Distinct keys, sorted, with integer names that ascend with them."""
    cols = keys.columns
    dealt = keys.distinct().repartitionByRange(*cols).sortWithinPartitions(*cols)
    return scratch.keep(dealt.withColumn("name", F.monotonically_increasing_id()), name)


def block_keys(rows: DataFrame, text: str = "text", size: int = BLOCK_BYTES) -> DataFrame:
    """Stored (ROW, n, pos, h, tie, sha) of every block; sha, of the whole text, stands at the first.

    Blocks have equal (h, tie) exactly if their contents are equal.
    """
    blocks = _blocks(rows, text, size).withColumn("h", F.xxhash64("block"))
    contents = scratch.keep(blocks.select("h", "block").distinct().select("h"), "contents")
    shared = scratch.keep(contents.groupBy("h").count().where("count > 1").select("h"), "shared")
    tie = F.lit(0)
    if not shared.isEmpty():
        ties = blocks.select("h", "block").join(shared, "h", "left_semi").distinct()
        ties = scratch.keep(ties.withColumn("t", F.dense_rank().over(Window.partitionBy("h").orderBy("block"))), "ties")
        blocks, tie = blocks.join(ties, ["h", "block"], "left"), F.coalesce("t", F.lit(0))
    return scratch.keep(blocks.select(ROW, "n", "pos", "h", tie.alias("tie"), F.when(F.col("pos") == 0, F.col("sha")).alias("sha")), "blocks")


def identities(blocks: DataFrame) -> DataFrame:
    """(ROW, level, name) from ``block_keys``: rows have equal (level, name) exactly if their texts are equal."""
    named = blocks.join(_numbered(blocks.select("h", "tie"), "names0"), ["h", "tie"])
    now = scratch.keep(named.select(ROW, "n", "pos", "name"), "level0")
    done = now.where("n = 1").select(ROW, F.lit(0).alias("level"), "name")
    left, level = now.agg(F.max("n")).first()[0] or 0, 0
    while left > 1:
        level, left = level + 1, (left + 1) // 2
        half = F.floor(F.col("pos") / 2).cast("int")
        side = lambda k: F.max(F.when(F.col("pos") % 2 == k, F.col("name")))
        pairs = (
            now.where("n > 1")
            .groupBy(ROW, half.alias("pos"))
            .agg(F.floor((F.max("n") + 1) / 2).cast("int").alias("n"), side(0).alias("a"), F.coalesce(side(1), F.lit(-1)).alias("b"))
        )
        pairs = scratch.keep(pairs, f"pairs{level}")
        named = pairs.join(_numbered(pairs.select("a", "b"), f"names{level}"), ["a", "b"])
        now = scratch.keep(named.select(ROW, "n", "pos", "name"), f"level{level}")
        done = done.unionByName(now.where("n = 1").select(ROW, F.lit(level).alias("level"), "name"))
    return done


def exact_groups(rows: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``rows``: ROW, doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest ``doc_id`` stays; a null id is the
    smallest. Where rows repeat an id, the one with the smallest ``ROW`` stays,
    so that exactly one row of every group is kept. An empty table gives an
    empty result.
    """
    blocks = block_keys(rows, text, size)
    digest = blocks.where("pos = 0").select(ROW, F.col("sha").alias("text_sha256"))
    ids = rows.select(ROW, F.col(doc_id).alias("doc_id")).join(digest, ROW).join(identities(blocks), ROW)
    ids = scratch.keep(ids, "ids")
    best = F.max(F.struct(F.col("doc_id"), (-F.col(ROW)).alias("r")))
    groups = scratch.keep(ids.groupBy("level", "name").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size")), "groups")
    groups = groups.select("level", "name", "group_size", F.col("best.doc_id").alias("keep_id"), (-F.col("best.r")).alias("keep_row"))
    return ids.join(groups, ["level", "name"]).select(
        ROW, "doc_id", "keep_id", "group_size", (F.col(ROW) == F.col("keep_row")).alias("kept"), "text_sha256"
    )


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows whose text equals that of a kept row (see ``exact_groups``)."""
    rows = scratch.with_row_ids(docs, "docs")
    copies = scratch.settled(lambda: exact_groups(rows, doc_id, text).where("not kept").select(ROW), "copies")
    return scratch.without_rows(rows, copies, docs)
