"""Operator inputs derived from whole driver tables, with integer arithmetic that SQL shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PAGE_WIDTH, PAGE_HEIGHT = 1240, 1754
RASTER_WIDTH = 40
#: Total order of lineitem rows: its order and line number alone aren't unique.
LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]
CODEC = {i: c for i, c in enumerate("abcdef", 1)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lines(spark: SparkSession, sf_dir: str, orders: int) -> DataFrame:
    """lineitem with page_id and ``s``, the row's number on its page."""
    items = table(spark, sf_dir, "lineitem").withColumn("page_id", F.floor(F.col("l_orderkey") / orders))
    return items.withColumn("s", F.row_number().over(Window.partitionBy("page_id").orderBy(*LINE_KEY)) - 1)


def page_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-column pages of ``PAGE_WIDTH`` x ``PAGE_HEIGHT``; by page number footnotes in both columns, none, or in the left alone.

    Rows are dealt to the columns in turn. Indents, widths, pitches and heights come from
    the rows' part and supplier numbers.
    """
    page = Window.partitionBy("page_id")
    a, b, c, r = F.col("l_partkey"), F.col("l_suppkey"), F.col("c"), F.col("r")
    made = _lines(spark, sf_dir, 8).select("page_id", "s", F.count(F.lit(1)).over(page).alias("n"), a, b)
    made = made.select("page_id", (F.col("s") % 2).alias("c"), F.floor(F.col("s") / 2).cast("int").alias("r"), "n", a, b)
    made = made.withColumn("m", F.floor((F.col("n") + 1 - c) / 2))
    note = (r >= F.col("m") - 4) & ((F.col("page_id") % 3 == 0) | ((F.col("page_id") % 3 == 2) & (c == 0)))
    made = made.withColumn("note", note.cast("int")).withColumn("ord", F.row_number().over(page.orderBy("c", "r")) - 1)
    x0 = 90 + 573 * c + a % 17 + F.col("note") * (b % 29)
    low = 1390 + 22 * (r - (F.col("m") - 4)) + a % 2
    y0 = F.when(F.col("note") == 1, low).otherwise(151 + 31 * r + b % 3)
    tall = F.when(F.col("note") == 1, 13 + b % 3).otherwise(22 + a % 4)
    made = made.withColumns({"x0": x0.cast("int"), "y0": y0.cast("int"), "x1": (x0 + 410 + (a * 7 + b) % 41).cast("int")})
    return made.withColumn("y1", (F.col("y0") + tall).cast("int")).select("page_id", "ord", "x0", "y0", "x1", "y1")


def headed_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_boxes, every fifth page with a running title and a rule below it."""
    boxes = page_boxes(spark, sf_dir)
    pages = boxes.select("page_id").distinct().where("page_id % 5 = 0")
    p = F.col("page_id")

    def head(order: int, y0, tall) -> DataFrame:  # noqa: ANN001
        made = [F.lit(order).alias("ord"), F.lit(33).alias("x0"), y0.cast("int").alias("y0"), (PAGE_WIDTH - 40 + p % 7).cast("int").alias("x1"), (y0 + tall).cast("int").alias("y1")]
        return pages.select("page_id", *made)

    return boxes.unionByName(head(-2, 30 + p % 9, F.lit(21))).unionByName(head(-1, 64 + p % 11, 5 + p % 4))


def layout_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, block_no, type, lines): every order as a block of 16 types, its rows as the block's lines."""
    rows = _lines(spark, sf_dir, 8).select("page_id", F.col("l_orderkey").alias("block_no"), "s", "l_partkey")
    x0, y0 = (F.col("l_partkey") % 50).cast("int"), (20 * F.col("s")).cast("int")
    line = F.struct("s", x0.alias("x0"), y0.alias("y0"), (x0 + 300).alias("x1"), (y0 + 15).alias("y1"))
    made = rows.groupBy("page_id", "block_no").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    return made.withColumn("type", (F.col("block_no") % 16).cast("int"))


def codecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(p_brand, codec): a JSON object a brand, from each type of its parts to the list of their sizes."""
    sizes = table(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.array_sort(F.collect_set("p_size")).alias("ids"))
    return sizes.groupBy("p_brand").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("p_type", "ids")))).alias("codec"))


def line_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, line_no, width, height) of every line."""
    return _lines(spark, sf_dir, 8).select("page_id", F.col("s").alias("line_no"), (40 + 20 * F.col("l_quantity").cast("int")).alias("width"), (16 + 2 * F.col("l_linenumber")).alias("height"))


def page_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of pages 40 wide: text bands of 5 of 8 rows, by page number with a gutter or a vertical rule."""
    px = _lines(spark, sf_dir, 256).select("page_id", (F.col("s") % RASTER_WIDTH).alias("x"), F.floor(F.col("s") / RASTER_WIDTH).cast("int").alias("y"), "l_partkey", "l_suppkey")
    rule = (F.col("page_id") % 3 == 1) & (F.col("x") == 24)
    gap = (F.col("page_id") % 3 == 2) & F.col("x").between(17, 22)
    text = (F.col("y") % 8 < 5) & ((F.col("l_partkey") + F.col("x")) % 3 != 0) & ~gap
    r = F.when(rule, 20).when(text, (F.col("l_suppkey") * 7) % 120).otherwise(230 + (F.col("x") + F.col("y")) % 20).cast("int")
    px = px.select("page_id", "x", "y", r.alias("r")).withColumn("width", F.lit(RASTER_WIDTH))
    px = px.withColumn("height", (F.max("y").over(Window.partitionBy("page_id")) + 1).cast("int"))
    return px.withColumns({"g": F.least(F.lit(255), F.col("r") + F.col("x") % 3).cast("int"), "b": F.col("r")})


def ink_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, y, ink) of zones 1200 wide: lines of 16 rows in 24, some joined by faint ink."""
    rows = _lines(spark, sf_dir, 64)
    y = F.col("s")
    faint = (F.col("page_id") % 2 == 0) & (F.floor(y / 24) % 5 == 1)
    ink = F.when(y % 24 < 16, 30 + F.col("l_quantity").cast("int") % 10).when(faint, 10).otherwise(0)
    return rows.select("page_id", y.alias("y"), ink.alias("ink"))


def logit_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, logits, classes, steps, valid_steps): every embedding as 8 classes by 8 steps."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("logits"), F.lit(8).alias("classes"), F.lit(8).alias("steps"), (4 + F.col("vec_id") % 5).cast("int").alias("valid_steps"))


def recognised_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, line_no, line): every line of every document, some with a hyphen mark at the end."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "line"))
    mark = F.when(F.length("line") % 3 == 0, F.lit("­")).when(F.length("line") % 7 == 0, F.lit("¬")).otherwise(F.lit(""))
    return lines.withColumn("line", F.concat("line", mark))


def ocr_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, ref, hyp): the printable ASCII of every line, and the same with typical confusions."""
    lines = table(spark, sf_dir, "documents").select("source", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "line"))
    lines = lines.select("source", "line_no", F.regexp_replace("line", "[^ -~]", "").alias("ref"))
    hyp = F.replace(F.col("ref"), F.lit("rn"), F.lit("m"))
    return lines.withColumn("hyp", F.when(F.col("line_no") % 2 == 0, F.replace(hyp, F.lit("e"), F.lit("c"))).otherwise(hyp))
