"""Queries over the operators on whole driver tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgrid import fixtures as fx
from docgrid.functions import scalars
from docgrid.operators import batching, crop, decode, metrics, order, rasters, segment, stats, text
from docgrid.options import PROFILES, Options
from docgrid.plans import recognise
from docgrid.sources import assets
from docgrid.sources.providers import StubRecogniser

WIDTHS = (256, 512, 1024, 2048)
RETRY = 0.18
CROP = (0.1, 0.05, 0.75, 0.9)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# -- the fixtures in SQL ---------------------------------------------------------------------------


def _numbered(orders: int, also: str = "") -> str:
    key = ", ".join(fx.LINE_KEY)
    return f"(SELECT l_orderkey // {orders} AS page_id, row_number() OVER (PARTITION BY l_orderkey // {orders} ORDER BY {key}) - 1 AS s{also} FROM lineitem)"


BOXES = f"""
b0 AS (SELECT page_id, s, count(*) OVER (PARTITION BY page_id) AS n, l_partkey AS a, l_suppkey AS b FROM {_numbered(8, ", l_partkey, l_suppkey")}),
b1 AS (SELECT page_id, s % 2 AS c, s // 2 AS r, (n + 1 - s % 2) // 2 AS m, a, b FROM b0),
b2 AS (SELECT *, CASE WHEN r >= m - 4 AND (page_id % 3 = 0 OR page_id % 3 = 2 AND c = 0) THEN 1 ELSE 0 END AS note FROM b1),
b3 AS (SELECT page_id, c, r, note, a, b, row_number() OVER (PARTITION BY page_id ORDER BY c, r) - 1 AS ord, 90 + 573 * c + a % 17 + note * (b % 29) AS x0,
  CASE WHEN note = 1 THEN 1390 + 22 * (r - (m - 4)) + a % 2 ELSE 151 + 31 * r + b % 3 END AS y0 FROM b2),
boxes AS (SELECT page_id, ord, x0, y0, x0 + 410 + (a * 7 + b) % 41 AS x1, y0 + CASE WHEN note = 1 THEN 13 + b % 3 ELSE 22 + a % 4 END AS y1 FROM b3)"""
RASTER = f"""
r0 AS (SELECT page_id, s % 40 AS x, s // 40 AS y, l_partkey, l_suppkey FROM {_numbered(256, ", l_partkey, l_suppkey")}),
r1 AS (SELECT page_id, x, y, 40 AS width, max(y) OVER (PARTITION BY page_id) + 1 AS height,
  CASE WHEN page_id % 3 = 1 AND x = 24 THEN 20
       WHEN y % 8 < 5 AND (l_partkey + x) % 3 <> 0 AND NOT (page_id % 3 = 2 AND x BETWEEN 17 AND 22) THEN (l_suppkey * 7) % 120
       ELSE 230 + (x + y) % 20 END AS r FROM r0),
px AS (SELECT page_id, x, y, width, height, r, least(255, r + x % 3) AS g, r AS b,
  CAST(floor((r + least(255, r + x % 3) + r) / 3.0e0 + 0.5e0) AS INTEGER) AS gray FROM r1)"""


def _otsu(name: str, hist: str, keep: str, value: str) -> str:
    """CTEs that end in ``name`` (page_id, t): the best split of ``hist`` (page_id, gray, n)."""
    return f"""
{name}_a AS (SELECT page_id, gray, n, sum(n) OVER w AS l, sum(n * gray) OVER w AS ls, sum(n) OVER (PARTITION BY page_id) AS total,
  sum(n * gray) OVER (PARTITION BY page_id) AS whole FROM {hist} WINDOW w AS (PARTITION BY page_id ORDER BY gray ROWS UNBOUNDED PRECEDING)),
{name}_b AS (SELECT page_id, gray, l, total, CASE WHEN l < total THEN CAST(ls AS DOUBLE) / l - CAST(whole - ls AS DOUBLE) / (total - l) END AS gap FROM {name}_a),
{name}_c AS (SELECT page_id, gray, gap * gap * l * (total - l) AS score FROM {name}_b),
{name}_d AS (SELECT page_id, gray, score, row_number() OVER (PARTITION BY page_id ORDER BY coalesce(score, -1) DESC, gray) AS k FROM {name}_c),
{name} AS (SELECT page_id, CASE WHEN {keep} THEN gray END AS t FROM {name}_d WHERE k = 1),
{name}_v AS (SELECT page_id, {value} FROM {name})"""


HIST = "hist AS (SELECT page_id, gray, count(*) AS n FROM px GROUP BY page_id, gray)"
SAMPLED = "sampled AS (SELECT page_id, gray, count(*) AS n FROM px WHERE (y * width + x) % 4 = 0 GROUP BY page_id, gray)"
OTSU = _otsu("ot", "hist", "score IS NOT NULL", "CAST(coalesce(t, 127) AS INTEGER) AS threshold")
DARK = SAMPLED + "," + _otsu("dk", "sampled", "score > 0", "CAST(CASE WHEN t > 160 THEN t ELSE 210 END AS INTEGER) AS dark")
DARK += ",\nd AS (SELECT px.*, dk_v.dark, (r + g + b) / 3.0e0 < dark AS is_dark, (r + g + b) / 3.0e0 < 160 AS is_black FROM px JOIN dk_v ON px.page_id = dk_v.page_id)"

LOGITS = """
e AS (SELECT vec_id, embedding AS l, 4 + vec_id % 5 AS valid FROM embeddings),
ct AS (SELECT vec_id, valid, l, unnest(range(0, 64)) AS i FROM e),
cell AS (SELECT vec_id, i // 8 AS c, i % 8 AS t, CASE WHEN isnan(l[i + 1]) THEN CAST('-inf' AS FLOAT) ELSE l[i + 1] END AS v FROM ct WHERE i % 8 < valid)"""


def _decoded(order_by: str, name: str = "dec") -> str:
    """CTEs that end in ``name`` (vec_id, text, confidence); ``order_by`` breaks ties and numbers the classes."""
    return f"""
{name}_b AS (SELECT vec_id, t, {order_by} AS best, v, row_number() OVER (PARTITION BY vec_id, t ORDER BY v DESC, {order_by}) AS k FROM cell),
{name}_s AS (SELECT vec_id, t, best, v, lag(best, 1, 0) OVER (PARTITION BY vec_id ORDER BY t) AS prev FROM {name}_b WHERE k = 1),
{name}_e AS (SELECT vec_id, t, v, CASE WHEN best BETWEEN 1 AND 6 THEN substr('abcdef', best, 1) ELSE '' END AS ch FROM {name}_s WHERE best <> 0 AND best <> prev),
{name}_g AS (SELECT vec_id, string_agg(ch, '' ORDER BY t) AS text, sum(CAST(v AS DOUBLE) ORDER BY t) / count(*) AS confidence FROM {name}_e GROUP BY vec_id),
{name} AS (SELECT e.vec_id, coalesce(text, '') AS text, coalesce(confidence, 0) AS confidence FROM e LEFT JOIN {name}_g ON e.vec_id = {name}_g.vec_id)"""


DECODED = LOGITS + "," + _decoded("c")
AGAIN = DECODED + "," + _decoded("7 - c", "rev")


# -- decoding and text -----------------------------------------------------------------------------


def _first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode.decode(fx.logit_lines(spark, sf_dir), fx.CODEC)


def _retried(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First results, the uncertain ones replaced by a second pass whose classes are in reverse order."""
    first = _first(spark, sf_dir)
    doubt = decode.uncertain(first, RETRY).select("vec_id")
    lines = fx.logit_lines(spark, sf_dir).join(doubt, "vec_id", "left_semi")
    rows = F.transform(F.sequence(F.lit(7), F.lit(0), F.lit(-1)), lambda c: F.slice("logits", c * 8 + 1, F.lit(8)))
    again = decode.decode(lines.withColumn("logits", F.flatten(rows)), fx.CODEC)
    return decode.overlay(first, again, ["vec_id"])


@query(f"WITH {DECODED} SELECT vec_id, text FROM dec")
def ctc_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _first(spark, sf_dir).select("vec_id", "text")


@query(f"WITH {DECODED} SELECT vec_id, round(confidence, 6) AS confidence FROM dec")
def ctc_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _first(spark, sf_dir).select("vec_id", F.round("confidence", 6).alias("confidence"))


@query(f"WITH {DECODED} SELECT vec_id, text, round(confidence, 6) AS confidence FROM dec")
def ctc_decode_in_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``ctc_decode`` and ``ctc_confidence``, with the best classes found in numpy where the logits are."""

    def run(batches):  # noqa: ANN001, ANN202
        for b in batches:
            logits = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, 8, 8)
            steps = decode.best_arrays(*decode.best_kernel(logits), b.column(2).to_numpy())
            yield pa.RecordBatch.from_arrays([b.column(0), steps], names=["vec_id", "steps"])

    lines = fx.logit_lines(spark, sf_dir).select("vec_id", "logits", "valid_steps")
    told = lines.mapInArrow(run, f"vec_id long, steps {decode.STEPS}").withColumn("scored", F.lit(True))
    return decode.decode_steps(told, fx.CODEC).withColumn("confidence", F.round("confidence", 6))


@query("""SELECT p_brand, p_size AS class, min(p_type) AS char, count(DISTINCT p_type) AS characters FROM part GROUP BY p_brand, p_size""")
def codec_from_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = assets.codec_rows(fx.codecs(spark, sf_dir))
    return rows.groupBy("p_brand", "class").agg(F.min("char").alias("char"), F.count(F.lit(1)).alias("characters"))


@query("SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS bytes, sha256(coalesce(text, '')) AS digest FROM documents")
def embedded_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bytes of assets that came as base64: every document's text, embedded so."""
    embedded = fx.table(spark, sf_dir, "documents").select("doc_id", F.base64(F.coalesce("text", F.lit("")).cast("binary")).alias("asset"))
    asset = embedded.select("doc_id", assets.unpacked(F.col("asset")).alias("asset"))
    return asset.select("doc_id", F.octet_length("asset").cast("long").alias("bytes"), F.sha2("asset", 256).alias("digest"))


@query(f"WITH {DECODED} SELECT vec_id, text, CAST(NULL AS DOUBLE) AS confidence FROM dec")
def decode_class_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = fx.logit_lines(spark, sf_dir)
    best = decode.best_classes(F.col("logits"), F.col("classes"), F.col("steps"), F.col("steps"))
    lines = lines.select("vec_id", "valid_steps", F.transform(best, lambda s: s["best"]).alias("class_ids"))
    return decode.decode_ids(lines, fx.CODEC).select("vec_id", "text", "confidence")


@query(f"""WITH {AGAIN}
SELECT dec.vec_id, CASE WHEN dec.confidence < 0.18e0 THEN rev.text ELSE dec.text END AS text,
  round(CASE WHEN dec.confidence < 0.18e0 THEN rev.confidence ELSE dec.confidence END, 6) AS confidence, dec.confidence < 0.18e0 AS retried
FROM dec JOIN rev ON dec.vec_id = rev.vec_id""")
def retry_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _retried(spark, sf_dir).select("vec_id", "text", F.round("confidence", 6).alias("confidence"), "retried")


@query(f"""WITH {AGAIN},
res AS (SELECT dec.confidence < 0.18e0 AS retried, CASE WHEN dec.confidence < 0.18e0 THEN rev.confidence ELSE dec.confidence END AS confidence
  FROM dec JOIN rev ON dec.vec_id = rev.vec_id),
med AS (SELECT confidence, row_number() OVER (ORDER BY confidence) - 1 AS k, count(*) OVER () AS n FROM res)
SELECT count(*) AS lines, count(*) FILTER (WHERE retried) AS retried,
  (SELECT round(confidence, 6) FROM med WHERE k = n // 2) AS confidence_median FROM res""")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.run_summary(_retried(spark, sf_dir)).withColumn("confidence_median", F.round("confidence_median", 6))


@query(r"""WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
x AS (SELECT doc_id, unnest(range(0, len(parts))) AS line_no, parts FROM l),
y AS (SELECT doc_id, line_no, parts[line_no + 1] AS line FROM x),
z AS (SELECT doc_id, line_no, line || CASE WHEN length(line) % 3 = 0 THEN chr(173) WHEN length(line) % 7 = 0 THEN chr(172) ELSE '' END AS line FROM y),
j AS (SELECT doc_id, count(*) AS line_count, string_agg(line, chr(10) ORDER BY line_no) AS text FROM z GROUP BY doc_id)
SELECT doc_id, line_count, replace(replace(replace(replace(replace(replace(text, chr(173) || chr(13) || chr(10), ''), chr(172) || chr(13) || chr(10), ''),
  chr(173) || chr(10), ''), chr(172) || chr(10), ''), chr(173), ''), chr(172), '') AS text FROM j""")
def page_text_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.page_text(fx.recognised_lines(spark, sf_dir), "doc_id", "line_no", "line")


@query(r"""WITH l AS (SELECT source, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
x AS (SELECT source, unnest(range(0, len(parts))) AS line_no, parts FROM l),
y AS (SELECT source, line_no, regexp_replace(parts[line_no + 1], '[^ -~]', '', 'g') AS ref FROM x),
z AS (SELECT source, ref, CASE WHEN line_no % 2 = 0 THEN replace(replace(ref, 'rn', 'm'), 'e', 'c') ELSE replace(ref, 'rn', 'm') END AS hyp FROM y),
a AS (SELECT source, CAST(sum(levenshtein(ref, hyp)) AS BIGINT) AS errors, CAST(sum(length(ref)) AS BIGINT) AS chars FROM z GROUP BY source)
SELECT source, errors, chars, round(CAST(errors AS DOUBLE) / nullif(chars, 0), 9) AS cer FROM a""")
def cer_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.character_error_rate(fx.ocr_pairs(spark, sf_dir), "source").withColumn("cer", F.round("cer", 9))


@query("""WITH a AS (SELECT event_type, count(*) AS pages, round(sum(value), 6) AS seconds FROM events GROUP BY event_type)
SELECT event_type, pages, seconds, round(pages / nullif(seconds, 0), 6) AS pages_per_second FROM a""")
def throughput_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.throughput(fx.table(spark, sf_dir, "events"), "event_type", "value")


# -- boxes and batches -----------------------------------------------------------------------------


@query(f"""WITH {BOXES},
q AS (SELECT page_id, ord, x0 / 2.0e0 AS x0, y0 / 2.0e0 AS y0, x1 / 2.0e0 AS x1, y1 / 2.0e0 AS y1 FROM boxes),
p AS (SELECT *, greatest(0, x0 - 10) AS x, greatest(0, y0 - 6) AS y FROM q)
SELECT page_id, ord, x, y, greatest(1, least({fx.PAGE_WIDTH // 2}, x1 + 11) - x) AS width, greatest(1, least({fx.PAGE_HEIGHT // 2}, y1 + 7) - y) AS height FROM p""")
def region_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = crop.rescale(fx.page_boxes(spark, sf_dir), 2.0)
    return crop.regions(boxes, fx.PAGE_WIDTH // 2, fx.PAGE_HEIGHT // 2).select("page_id", "ord", "x", "y", "width", "height")


@query(f"""WITH {BOXES}, p AS (SELECT page_id, max(x1) AS width, max(y1) AS height FROM boxes GROUP BY page_id)
SELECT page_id, 0.1e0 * width AS crop_x, 0.05e0 * height AS crop_y, 0.75e0 * width AS crop_w, 0.9e0 * height AS crop_h,
  CAST(floor(0.75e0 * width + 0.5e0) AS INTEGER) AS out_width, CAST(floor(0.9e0 * height + 0.5e0) AS INTEGER) AS out_height FROM p""")
def crop_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = fx.page_boxes(spark, sf_dir).groupBy("page_id").agg(F.max("x1").alias("width"), F.max("y1").alias("height"))
    return crop.apply_template(pages, CROP).drop("width", "height")


DIMS = f"dims AS (SELECT page_id, s AS line_no, 40 + 20 * CAST(l_quantity AS INTEGER) AS width, 16 + 2 * l_linenumber AS height FROM {_numbered(8, ', l_quantity, l_linenumber')})"
PREPARED = f"{DIMS}, prep AS (SELECT *, greatest(1, CAST(floor(width * 48.0e0 / height * 1.0e0 + 0.5e0) AS INTEGER)) + 32 AS prepared FROM dims)"
FIXED = "CASE WHEN w <= 256 THEN 256 WHEN w <= 512 THEN 512 WHEN w <= 1024 THEN 1024 WHEN w <= 2048 THEN 2048 ELSE w END AS batch_width"


@query(f"""WITH {DIMS}, f AS (SELECT * FROM (VALUES ('quality', 1.0e0), ('balanced', 0.85e0), ('turbo', 0.76e0), ('extreme', 0.7e0)) AS t(profile, scale)),
w AS (SELECT profile, page_id, greatest(1, CAST(floor(width * 48.0e0 / height * scale + 0.5e0) AS INTEGER)) + 32 AS prepared FROM dims, f)
SELECT profile, page_id, CAST(sum(prepared) AS BIGINT) AS total, max(prepared) AS widest FROM w GROUP BY profile, page_id""")
def line_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = fx.line_dims(spark, sf_dir)
    made = [F.struct(F.lit(n).alias("profile"), scalars.prepared_width(F.col("width"), F.col("height"), F.lit(s), 16).alias("prepared")) for n, s in PROFILES.items()]
    told = lines.select("page_id", F.inline(F.array(*made)))
    return told.groupBy("profile", "page_id").agg(F.sum("prepared").alias("total"), F.max("prepared").alias("widest"))


def _batches(plan: DataFrame, *keys: str) -> DataFrame:
    return plan.groupBy(*keys, "batch_no").agg(F.count(F.lit(1)).alias("n"), F.max("batch_width").alias("batch_width"), F.sum("page_id").alias("pages"))


def _batch_sql(partition: str, order_by: str, keys: str, bucket: str = "CAST(ceil(prepared / 24.0e0) AS INTEGER)") -> str:
    by = f"PARTITION BY {partition} " if partition else ""
    return f"""WITH {PREPARED}, b AS (SELECT *, {bucket} AS bucket FROM prep),
k AS (SELECT *, (row_number() OVER ({by}ORDER BY {order_by}) - 1) // 32 AS batch_no FROM b),
g AS (SELECT {keys}, batch_no, count(*) AS n, max(prepared) AS w, CAST(sum(page_id) AS BIGINT) AS pages FROM k GROUP BY {keys}, batch_no)
SELECT {keys}, batch_no, n, {FIXED}, pages FROM g"""


@query(_batch_sql("bucket", "page_id, line_no", "bucket"))
def batch_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _batches(batching.plan(fx.line_dims(spark, sf_dir), Options(widths=WIDTHS)), "bucket")


@query(_batch_sql("page_id, bucket", "line_no", "page_id, bucket").replace(", CAST(sum(page_id) AS BIGINT) AS pages", "").replace(", pages FROM g", " FROM g"))
def batch_plan_by_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _batches(batching.plan(fx.line_dims(spark, sf_dir), Options(widths=WIDTHS), across_pages=False), "page_id", "bucket").drop("pages")


@query(_batch_sql("", "prepared, page_id, line_no", "bucket", "0"))
def batch_plan_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _batches(batching.plan(fx.line_dims(spark, sf_dir), replace(Options(widths=WIDTHS), sort=True)), "bucket")


_ORDER_SQL = f"""WITH {BOXES},
c AS (SELECT *, (x0 + x1) / 2.0e0 AS mid FROM boxes),
side AS (SELECT *, CASE WHEN mid < {fx.PAGE_WIDTH} * 0.48e0 THEN 'l' WHEN mid > {fx.PAGE_WIDTH} * 0.52e0 THEN 'r' ELSE 'm' END AS sd FROM c),
srt AS (SELECT page_id, sd, y0, y1, y1 - y0 AS h, row_number() OVER (PARTITION BY page_id, sd ORDER BY y0, ord) - 1 AS i,
  count(*) OVER (PARTITION BY page_id, sd) AS n, lag(y1) OVER (PARTITION BY page_id, sd ORDER BY y0, ord) AS above FROM side WHERE sd <> 'm'),
body AS (SELECT page_id, sd, n, list_sort(list(h))[len(list(h)) // 2 + 1] AS bh FROM srt WHERE i < ceil(n * 0.65e0) GROUP BY page_id, sd, n),
tail AS (SELECT a.page_id, a.sd, a.i, list_sort(list(b.h))[len(list(b.h)) // 2 + 1] AS th FROM srt a JOIN srt b ON a.page_id = b.page_id AND a.sd = b.sd AND b.i >= a.i
  WHERE a.n >= 8 AND a.i >= ceil(a.n * 0.45e0) AND a.i < a.n - 2 GROUP BY a.page_id, a.sd, a.i),
ok AS (SELECT srt.page_id, srt.sd, srt.y0, row_number() OVER (PARTITION BY srt.page_id, srt.sd ORDER BY srt.i) AS k
  FROM srt JOIN tail ON srt.page_id = tail.page_id AND srt.sd = tail.sd AND srt.i = tail.i JOIN body ON srt.page_id = body.page_id AND srt.sd = body.sd
  WHERE srt.y0 > {fx.PAGE_HEIGHT} * 0.55e0 AND srt.y0 - srt.above >= greatest(12, bh * 0.75e0) AND th <= bh * 0.92e0),
start AS (SELECT page_id, max(CASE WHEN sd = 'l' THEN y0 END) AS fl, max(CASE WHEN sd = 'r' THEN y0 END) AS fr FROM ok WHERE k = 1 GROUP BY page_id),
page AS (SELECT side.page_id, count(*) AS n, count(*) FILTER (WHERE sd = 'l') AS nl, count(*) FILTER (WHERE sd = 'r') AS nr FROM side GROUP BY side.page_id),
moves AS (SELECT page.page_id, fl, fr FROM page JOIN start ON page.page_id = start.page_id WHERE n >= 16 AND nl >= 8 AND nr >= 8 AND abs(fl - fr) <= {fx.PAGE_HEIGHT} * 0.08e0),
foot AS (SELECT side.*, coalesce((sd = 'l' AND y0 >= fl) OR (sd = 'r' AND y0 >= fr), false) AS f FROM side LEFT JOIN moves ON side.page_id = moves.page_id)
SELECT page_id, ord, row_number() OVER (PARTITION BY page_id ORDER BY f, CASE WHEN f AND mid > {fx.PAGE_WIDTH / 2} THEN 1 ELSE 0 END, CASE WHEN f THEN y0 ELSE 0 END, CASE WHEN f THEN x0 ELSE 0 END, ord) - 1 AS position FROM foot"""


@query(_ORDER_SQL)
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.reading_order(fx.page_boxes(spark, sf_dir), fx.PAGE_WIDTH, fx.PAGE_HEIGHT).select("page_id", "ord", "position")


@query(f"""WITH {BOXES},
h AS (SELECT DISTINCT page_id FROM boxes WHERE page_id % 5 = 0),
lines AS (SELECT * FROM boxes UNION ALL SELECT page_id, -2, 33, 30 + page_id % 9, {fx.PAGE_WIDTH - 40} + page_id % 7, 51 + page_id % 9 FROM h
  UNION ALL SELECT page_id, -1, 33, 64 + page_id % 11, {fx.PAGE_WIDTH - 40} + page_id % 7, 69 + page_id % 11 + page_id % 4 FROM h),
typ AS (SELECT page_id, list_sort(list(y1 - y0))[count(*) // 2 + 1] AS t FROM lines GROUP BY page_id),
rule AS (SELECT page_id, y0 FROM (SELECT lines.page_id, y0, row_number() OVER (PARTITION BY lines.page_id ORDER BY ord) AS k FROM lines JOIN typ ON lines.page_id = typ.page_id
  WHERE y0 < {fx.PAGE_HEIGHT} * 0.1e0 AND x1 - x0 > {fx.PAGE_WIDTH} * 0.85e0 AND y1 - y0 < t * 0.55e0) WHERE k = 1)
SELECT lines.page_id, lines.ord, lines.y0 FROM lines LEFT JOIN rule ON lines.page_id = rule.page_id WHERE rule.y0 IS NULL OR lines.y0 > rule.y0""")
def header_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.without_running_header(fx.headed_boxes(spark, sf_dir), fx.PAGE_HEIGHT, fx.PAGE_WIDTH).select("page_id", "ord", "y0")


# -- pixels ----------------------------------------------------------------------------------------


@query(f"""WITH {RASTER}
SELECT page_id, CAST(sum(gray) AS BIGINT) AS gray, CAST(sum((77 * r + 150 * g + 29 * b) >> 8) AS BIGINT) AS luma,
  round(sum(CAST(CAST(1.0e0 - gray / 255.0e0 AS FLOAT) AS DOUBLE)), 4) AS ink, round(sum(CAST(CAST(1.0e0 - (r + g + b) / 765.0e0 AS FLOAT) AS DOUBLE)), 4) AS ink_batch,
  count(*) FILTER (WHERE ((77 * r + 150 * g + 29 * b) >> 8) < 128) AS dark_luma FROM px GROUP BY page_id""")
def gray_luma(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = stats.with_gray(fx.page_raster(spark, sf_dir))
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    luma = scalars.luma(r, g, b)
    sums = [F.sum("gray").alias("gray"), F.sum(luma).cast("long").alias("luma"), F.round(F.sum(scalars.ink(F.col("gray")).cast("double")), 4).alias("ink")]
    return px.groupBy("page_id").agg(*sums, F.round(F.sum(scalars.ink_unrounded(r, g, b).cast("double")), 4).alias("ink_batch"), F.count_if(luma < 128).alias("dark_luma"))


@query(f"WITH {RASTER}, {HIST} SELECT page_id, gray, n FROM hist")
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.histogram(fx.page_raster(spark, sf_dir))


@query(f"WITH {RASTER}, {SAMPLED} SELECT page_id, gray, n FROM sampled")
def histogram_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.histogram(fx.page_raster(spark, sf_dir), every=4)


@query(f"WITH {RASTER}, {HIST}, {OTSU} SELECT page_id, threshold FROM ot_v")
def otsu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.otsu(stats.histogram(fx.page_raster(spark, sf_dir)))


@query(f"WITH {RASTER}, {DARK} SELECT page_id, dark FROM dk_v")
def ink_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.ink_threshold(fx.page_raster(spark, sf_dir))


@query(f"""WITH {RASTER}, {HIST},
run AS (SELECT page_id, gray, sum(n) OVER (PARTITION BY page_id ORDER BY gray ROWS UNBOUNDED PRECEDING) AS seen, sum(n) OVER (PARTITION BY page_id) AS total FROM hist),
p AS (SELECT page_id, CAST(min(gray) FILTER (WHERE seen >= total * 0.05e0) AS INTEGER) AS low, CAST(min(gray) FILTER (WHERE seen >= total * 0.9e0) AS INTEGER) AS high FROM run GROUP BY page_id)
SELECT page_id, low, high, CASE WHEN high < 225 THEN 'sauvola' WHEN high - low < 105 THEN 'otsu' ELSE 'none' END AS mode FROM p""")
def percentiles_auto_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.auto_mode(stats.histogram(fx.page_raster(spark, sf_dir)))


@query(f"""WITH {RASTER},
a AS (SELECT *, sum(gray) OVER w AS s1, sum(gray * gray) OVER w AS s2, count(*) OVER w AS s0 FROM px WINDOW w AS (PARTITION BY page_id, y ORDER BY x ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING)),
b2 AS (SELECT page_id, y, gray, CAST(sum(s1) OVER w AS DOUBLE) AS s1, CAST(sum(s2) OVER w AS DOUBLE) AS s2, CAST(sum(s0) OVER w AS DOUBLE) AS s0 FROM a WINDOW w AS (PARTITION BY page_id, x ORDER BY y ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING)),
m AS (SELECT page_id, y, gray, s1 / s0 AS mean, greatest(0.0e0, s2 / s0 - (s1 / s0) * (s1 / s0)) AS v FROM b2)
SELECT page_id, y, count(*) FILTER (WHERE gray <= mean * (1.0e0 + 0.2e0 * (sqrt(v) / 128.0e0 - 1.0e0))) AS ink FROM m GROUP BY page_id, y""")
def sauvola_ink(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rasters.sauvola_rows(fx.page_raster(spark, sf_dir))


@query(f"""WITH {RASTER}, {HIST}, {OTSU},
i AS (SELECT px.page_id, x, y, CASE WHEN gray <= threshold THEN 1 ELSE 0 END AS ink FROM px JOIN ot_v ON px.page_id = ot_v.page_id),
s AS (SELECT *, max(ink) OVER (PARTITION BY page_id, y ORDER BY x ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS spread FROM i),
c AS (SELECT *, min(spread) OVER (PARTITION BY page_id, y ORDER BY x ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS closed FROM s)
SELECT page_id, y, CAST(sum(ink) AS BIGINT) AS ink, CAST(sum(closed) AS BIGINT) AS closed FROM c GROUP BY page_id, y""")
def closing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rasters.closing_rows(fx.page_raster(spark, sf_dir))


# -- segmentation ----------------------------------------------------------------------------------

PROFILE = "prof AS (SELECT page_id, y, count(*) FILTER (WHERE x % 2 = 0 AND is_dark) AS ink FROM d GROUP BY page_id, y)"


def _bands(profile: str, low: str, high: str) -> str:
    """CTEs that end in bands (page_id, s, e)."""
    return f"""
i1 AS (SELECT page_id, y, ink, y - row_number() OVER (PARTITION BY page_id ORDER BY y) AS isl FROM {profile} WHERE ink >= {low}),
f1 AS (SELECT page_id, isl, min(y) AS s, max(y) + 1 AS e FROM i1 GROUP BY page_id, isl HAVING max(y) + 1 - min(y) >= 4),
ty AS (SELECT page_id, list_sort(list(e - s))[count(*) // 2 + 1] AS t FROM f1 WHERE e - s < 100 GROUP BY page_id),
f2 AS (SELECT f1.*, e - s > coalesce(t, 40) * 1.65e0 AS tall FROM f1 LEFT JOIN ty ON f1.page_id = ty.page_id),
i2 AS (SELECT i1.page_id, i1.isl, i1.y, i1.y - row_number() OVER (PARTITION BY i1.page_id, i1.isl ORDER BY i1.y) AS isl2 FROM i1 JOIN f2 ON i1.page_id = f2.page_id AND i1.isl = f2.isl WHERE tall AND ink >= {high}),
bands AS (SELECT page_id, s, e FROM f2 WHERE NOT tall UNION ALL SELECT page_id, min(y), max(y) + 1 FROM i2 GROUP BY page_id, isl, isl2 HAVING max(y) + 1 - min(y) >= 4)"""


@query(f"WITH {RASTER}, {DARK}, {PROFILE} SELECT page_id, y, ink FROM prof")
def row_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = fx.page_raster(spark, sf_dir)
    return segment.row_profile(px, stats.ink_threshold(px))


@query(f"""WITH ip AS (SELECT page_id, s AS y, CASE WHEN s % 24 < 16 THEN 30 + CAST(l_quantity AS INTEGER) % 10 WHEN page_id % 2 = 0 AND (s // 24) % 5 = 1 THEN 10 ELSE 0 END AS ink
  FROM {_numbered(64, ", l_quantity")}),
{_bands("ip", "6", "20")}
SELECT page_id, s AS "start", e AS "end" FROM bands""")
def bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.bands(fx.ink_profile(spark, sf_dir), 1200)


@query(f"""WITH {RASTER},
v AS (SELECT page_id, x, count(*) FILTER (WHERE (r + g + b) / 3.0e0 < 160) AS ink FROM px WHERE x >= 22 AND x < 36 AND x % 2 = 0 AND y % 2 = 0 GROUP BY page_id, x),
k AS (SELECT page_id, x, ink, row_number() OVER (PARTITION BY page_id ORDER BY ink DESC, x) AS k FROM v WHERE ink > 0),
p AS (SELECT page_id, max(height) AS height FROM px GROUP BY page_id),
rl AS (SELECT p.page_id, height, coalesce(x, 0) AS x, coalesce(ink, 0) AS ink FROM p LEFT JOIN k ON p.page_id = k.page_id AND k.k = 1)
SELECT rl.page_id, rl.x, rl.ink, coalesce(min(px.y) FILTER (WHERE (r + g + b) / 3.0e0 < 160), rl.height) AS top, coalesce(max(px.y) FILTER (WHERE (r + g + b) / 3.0e0 < 160), 0) AS bottom
FROM rl JOIN px ON rl.page_id = px.page_id AND px.x = rl.x GROUP BY rl.page_id, rl.x, rl.ink, rl.height""")
def rule_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = fx.page_raster(spark, sf_dir)
    rule = segment.rule_column(px)
    return rule.join(segment.rule_extent(px, rule), "page_id")


@query(f"""WITH {RASTER}, {DARK},
ar AS (SELECT page_id, y, max(height) AS height, count(*) FILTER (WHERE x % 4 = 0 AND is_dark) AS ink FROM d WHERE y % 2 = 0 GROUP BY page_id, y),
ac AS (SELECT page_id, coalesce(min(y) FILTER (WHERE ink >= 4), (max(height) - 1) // 2 * 2) AS top, coalesce(max(y) FILTER (WHERE ink >= 4), (max(height) - 1) // 2 * 2) AS bottom FROM ar GROUP BY page_id),
cl AS (SELECT d.page_id, x, max(top) AS top, max(bottom) AS bottom, count(*) FILTER (WHERE is_dark AND y BETWEEN top AND bottom AND (y - top) % 4 = 0) AS ink
  FROM d JOIN ac ON d.page_id = ac.page_id WHERE x BETWEEN 10 AND 30 GROUP BY d.page_id, x),
bl AS (SELECT page_id, x, x - row_number() OVER (PARTITION BY page_id ORDER BY x) AS isl FROM cl WHERE ink <= (bottom - top + 1) / 80.0e0),
rn AS (SELECT page_id, min(x) AS s, least(max(x) + 1, 30) AS e FROM bl GROUP BY page_id, isl),
bs AS (SELECT page_id, s, e, row_number() OVER (PARTITION BY page_id ORDER BY e - s DESC, s) AS k FROM rn WHERE e > s)
SELECT ac.page_id, top, bottom, coalesce(s, 0) AS "start", coalesce(e, 0) AS "end", CASE WHEN e - s >= 0.6e0 THEN CAST(floor((s + e) / 2.0e0 + 0.5e0) AS INTEGER) END AS split
FROM ac LEFT JOIN bs ON ac.page_id = bs.page_id AND k = 1""")
def gutter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rasters.gutters(fx.page_raster(spark, sf_dir))


@query(f"""WITH {RASTER}, {DARK}, {PROFILE}, {_bands("prof", "4", "4")},
hx AS (SELECT page_id, y, min(x) AS lo, max(x) AS hi FROM d WHERE x % 2 = 0 AND is_dark GROUP BY page_id, y),
sp AS (SELECT bands.page_id, s, e, min(lo) AS lo, max(hi) AS hi FROM bands LEFT JOIN hx ON bands.page_id = hx.page_id AND hx.y >= greatest(0, s - 6) AND hx.y < e + 6 GROUP BY bands.page_id, s, e),
lr AS (SELECT *, greatest(0, coalesce(lo, 40) - 12) AS l, least(40, coalesce(hi, 0) + 14) AS r FROM sp)
SELECT page_id, s AS "start", e AS "end", l AS "left", greatest(r, l + 1) AS "right" FROM lr""")
def ink_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = fx.page_raster(spark, sf_dir)
    dark = stats.ink_threshold(px)
    return segment.ink_box(px, dark, segment.bands(segment.row_profile(px, dark), fx.RASTER_WIDTH))


TRIM = """
t AS (SELECT page_id, max(width) * 8 AS w, max(height) * 8 AS h, min(x) FILTER (WHERE r + g + b < 720) AS lx, max(x) FILTER (WHERE r + g + b < 720) AS hx,
  min(y) FILTER (WHERE r + g + b < 720) AS ly, max(y) FILTER (WHERE r + g + b < 720) AS hy FROM px GROUP BY page_id),
e AS (SELECT *, greatest(0, lx * 8 - 48) AS x0, greatest(0, ly * 8 - 48) AS y0, least(w, (hx + 1) * 8 + 48) AS x1, least(h, (hy + 1) * 8 + 48) AS y1 FROM t),
u AS (SELECT *, coalesce(hx > lx AND hy > ly AND (x1 - x0) * (y1 - y0) < w * h * 0.95e0, false) AS use FROM e),
trimmed AS (SELECT page_id, w, h, CASE WHEN use THEN x0 ELSE 0 END AS x0, CASE WHEN use THEN y0 ELSE 0 END AS y0, CASE WHEN use THEN x1 ELSE w END AS x1, CASE WHEN use THEN y1 ELSE h END AS y1 FROM u)"""


@query(f"WITH {RASTER}, {TRIM} SELECT page_id, x0, y0, x1, y1 FROM trimmed")
def trim_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.trim_box(fx.page_raster(spark, sf_dir))


#: What remains of a raster whose outer thirds are blank: pages that trimming pays for.
INSET = "inset AS (SELECT page_id, x, y, width, height, CASE WHEN x BETWEEN 13 AND 26 THEN r ELSE 255 END AS r, CASE WHEN x BETWEEN 13 AND 26 THEN g ELSE 255 END AS g, CASE WHEN x BETWEEN 13 AND 26 THEN b ELSE 255 END AS b FROM px)"


@query(f"""WITH {RASTER}, {INSET}, {TRIM.replace("FROM px", "FROM inset")}, {BOXES},
f AS (SELECT boxes.page_id AS part, ord, trimmed.page_id, w, h, boxes.x0 / 2.0e0 + trimmed.x0 AS x0, boxes.y0 / 2.0e0 + trimmed.y0 AS y0, boxes.x1 / 2.0e0 + trimmed.x0 AS x1, boxes.y1 / 2.0e0 + trimmed.y0 AS y1
  FROM boxes JOIN trimmed ON boxes.page_id // 32 = trimmed.page_id),
p AS (SELECT *, greatest(0, x0 - 10) AS x, greatest(0, y0 - 6) AS y FROM f)
SELECT page_id, part, ord, x, y, greatest(1, least(w, x1 + 11) - x) AS width, greatest(1, least(h, y1 + 7) - y) AS height FROM p""")
def trimmed_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes found on the trimmed parts of pages at twice their size, as regions of the whole pages."""
    inside = F.col("x").between(13, 26)
    px = fx.page_raster(spark, sf_dir).withColumns({c: F.when(inside, F.col(c)).otherwise(255) for c in ("r", "g", "b")})
    size = px.groupBy("page_id").agg((F.max("width") * segment.TRIM_FACTOR).alias("w"), (F.max("height") * segment.TRIM_FACTOR).alias("h"))
    boxes = fx.page_boxes(spark, sf_dir).withColumn("part", F.col("page_id")).withColumn("page_id", F.floor(F.col("page_id") / 32))
    placed = crop.from_trimmed(boxes, segment.trim_box(px), 2.0).join(size, "page_id")
    return crop.regions(placed, F.col("w"), F.col("h")).select("page_id", "part", "ord", "x", "y", "width", "height")


@query(f"""WITH k AS (SELECT page_id, l_orderkey, s, l_partkey FROM {_numbered(8, ", l_orderkey, l_partkey")} WHERE l_orderkey % 16 BETWEEN 1 AND 8)
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY l_orderkey, s) - 1 AS ord, CAST(l_partkey % 50 AS INTEGER) AS x0, CAST(20 * s AS INTEGER) AS y0,
  CAST(l_partkey % 50 + 300 AS INTEGER) AS x1, CAST(20 * s + 15 AS INTEGER) AS y1 FROM k""")
def block_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crop.text_lines(fx.layout_blocks(spark, sf_dir))


def raster_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixture's pages as rows of one raster each, missing pixels white, enlarged twice."""
    px = fx.page_raster(spark, sf_dir)
    place = (F.col("y").cast("long") * F.col("width") + F.col("x")) * F.lit(1 << 24)
    packed = place + F.col("r") * F.lit(1 << 16) + F.col("g") * F.lit(1 << 8) + F.col("b")
    rows = px.groupBy("page_id").agg(F.max("width").alias("width"), F.max("height").alias("height"), F.collect_list(packed).alias("cells"))

    def run(batches):  # noqa: ANN001, ANN202
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for page, w, h, cells in rasters.each_row(b):
                cells = cells.values.to_numpy()
                rgb = np.full((h.as_py() * w.as_py(), 3), 255, np.uint8)
                rgb[cells >> 24] = cells[:, None] >> np.array([16, 8, 0]) & 255
                rgb = rgb.reshape(h.as_py(), w.as_py(), 3).repeat(2, axis=0).repeat(2, axis=1)
                cols = ([str(page.as_py())], [rgb.shape[1]], [rgb.shape[0]], [rgb.tobytes()], [None])
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols, (pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.string()))], names=["page_id", "width", "height", "rgb", "error"])

    return rows.select("page_id", "width", "height", "cells").mapInArrow(run, "page_id string, width int, height int, rgb binary, error string")


#: Pages of the raster twice as large, missing pixels white.
ENLARGED = RASTER.replace("px AS (", "px0 AS (") + """,
large AS (SELECT page_id, width, height, unnest(range(2 * height)) AS y FROM (SELECT page_id, max(width) AS width, max(height) AS height FROM px0 GROUP BY page_id)),
cell AS (SELECT page_id, 2 * width AS width, 2 * height AS height, y, unnest(range(2 * width)) AS x FROM large),
px AS (SELECT cell.page_id, cell.x, cell.y, cell.width, cell.height, coalesce(r, 255) AS r, coalesce(g, 255) AS g, coalesce(b, 255) AS b, coalesce(gray, 255) AS gray
  FROM cell LEFT JOIN px0 ON cell.page_id = px0.page_id AND cell.x // 2 = px0.x AND cell.y // 2 = px0.y)"""

#: Zones of these pages: around a rule, beside a gutter, or one.
ZONES = """
p AS (SELECT page_id, max(width) AS w, max(height) AS h FROM px GROUP BY page_id),
rc AS (SELECT page_id, x, count(*) FILTER (WHERE is_black) AS ink FROM d WHERE x >= 44 AND x < 72 AND x % 2 = 0 AND y % 2 = 0 GROUP BY page_id, x),
rk AS (SELECT rc.page_id, x FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY ink DESC, x) AS k FROM rc) AS rc JOIN p ON rc.page_id = p.page_id WHERE k = 1 AND ink > 0 AND ink >= h * 0.18e0),
rl AS (SELECT rk.page_id, rk.x, min(y) AS top, max(y) AS bottom FROM rk JOIN d ON rk.page_id = d.page_id AND rk.x = d.x WHERE is_black GROUP BY rk.page_id, rk.x),
ar AS (SELECT page_id, y, count(*) FILTER (WHERE x % 4 = 0 AND is_dark) AS ink FROM d WHERE y % 2 = 0 GROUP BY page_id, y),
ac AS (SELECT ar.page_id, coalesce(min(y) FILTER (WHERE ink >= 4), (max(h) - 1) // 2 * 2) AS top, coalesce(max(y) FILTER (WHERE ink >= 4), (max(h) - 1) // 2 * 2) AS bottom FROM ar JOIN p ON ar.page_id = p.page_id GROUP BY ar.page_id),
cl AS (SELECT d.page_id, x, max(top) AS top, max(bottom) AS bottom, count(*) FILTER (WHERE is_dark AND y BETWEEN top AND bottom AND (y - top) % 4 = 0) AS ink
  FROM d JOIN ac ON d.page_id = ac.page_id WHERE x BETWEEN 20 AND 60 GROUP BY d.page_id, x),
bl AS (SELECT page_id, x, x - row_number() OVER (PARTITION BY page_id ORDER BY x) AS isl FROM cl WHERE ink <= (bottom - top + 1) / 80.0e0),
rn AS (SELECT page_id, min(x) AS s, least(max(x) + 1, 60) AS e FROM bl GROUP BY page_id, isl),
gt AS (SELECT page_id, CAST(floor((s + e) / 2.0e0 + 0.5e0) AS INTEGER) AS split FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY e - s DESC, s) AS k FROM rn WHERE e > s) WHERE k = 1 AND e - s >= 1.2e0),
zones AS (SELECT rl.page_id, 0 AS z, 0 AS x0, 0 AS y0, w AS zw, top AS zh FROM rl JOIN p ON rl.page_id = p.page_id
  UNION ALL SELECT page_id, 1, 0, top, x, bottom - top FROM rl UNION ALL SELECT rl.page_id, 2, x + 1, top, w - x - 1, bottom - top FROM rl JOIN p ON rl.page_id = p.page_id
  UNION ALL SELECT rl.page_id, 3, 0, bottom, w, h - bottom FROM rl JOIN p ON rl.page_id = p.page_id
  UNION ALL SELECT p.page_id, 0, 0, 0, coalesce(split, w), h FROM p LEFT JOIN gt ON p.page_id = gt.page_id WHERE p.page_id NOT IN (SELECT page_id FROM rl)
  UNION ALL SELECT p.page_id, 1, split, 0, w - split, h FROM p JOIN gt ON p.page_id = gt.page_id WHERE p.page_id NOT IN (SELECT page_id FROM rl))"""


@query(f"""WITH {ENLARGED}, {DARK}, {ZONES},
zr AS (SELECT zones.page_id, z, x0, y0, zw, zh, y - y0 AS y, count(*) FILTER (WHERE is_dark) AS ink, min(x - x0) FILTER (WHERE is_dark) AS lo, max(x - x0) FILTER (WHERE is_dark) AS hi
  FROM zones JOIN d ON zones.page_id = d.page_id AND d.x >= x0 AND d.x < x0 + zw AND d.y >= y0 AND d.y < y0 + zh WHERE (d.x - x0) % 2 = 0 GROUP BY ALL),
zi AS (SELECT *, y - row_number() OVER (PARTITION BY page_id, z ORDER BY y) AS isl FROM zr WHERE ink >= 4),
zb AS (SELECT page_id, z, x0, y0, zw, zh, min(y) AS s, max(y) + 1 AS e FROM zi GROUP BY page_id, z, x0, y0, zw, zh, isl HAVING max(y) + 1 - min(y) >= 4),
bx AS (SELECT zb.page_id, zb.z, zb.s, zb.e, zb.x0, zb.y0, zb.zw, zb.zh, greatest(0, min(lo) - 12) AS l, least(zb.zw, max(hi) + 14) AS r
  FROM zb JOIN zr ON zb.page_id = zr.page_id AND zb.z = zr.z AND zr.y >= zb.s - 6 AND zr.y < zb.e + 6 GROUP BY zb.page_id, zb.z, zb.s, zb.e, zb.x0, zb.y0, zb.zw, zb.zh),
ln AS (SELECT page_id, z, s, x0 + l AS x, y0 + s AS y, greatest(1, r - l) AS width, least(zh, e - s + 12) AS height FROM bx),
ty AS (SELECT page_id, list_sort(list(height))[count(*) // 2 + 1] AS t FROM ln GROUP BY page_id),
hd AS (SELECT page_id, y FROM (SELECT ln.page_id, y, row_number() OVER (PARTITION BY ln.page_id ORDER BY z, s) AS k FROM ln JOIN ty ON ln.page_id = ty.page_id JOIN p ON ln.page_id = p.page_id
  WHERE y < h * 0.1e0 AND width > w * 0.85e0 AND height < t * 0.55e0) WHERE k = 1),
lt AS (SELECT ln.*, row_number() OVER (PARTITION BY ln.page_id ORDER BY z, s) - 1 AS line_no FROM ln LEFT JOIN hd ON ln.page_id = hd.page_id WHERE hd.y IS NULL OR ln.y > hd.y)
SELECT CAST(lt.page_id AS VARCHAR) AS page_id, CAST(line_no AS INTEGER) AS line_no, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y,
  CAST(least(width, w - x) AS INTEGER) AS width, CAST(least(height, h - greatest(0, y - 6)) AS INTEGER) AS height FROM lt JOIN p ON lt.page_id = p.page_id""")
def fast_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recognise.prepare(raster_pages(spark, sf_dir), Options()).drop("rgb", "error", "transform")


@query()
def page_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = Options(pre="auto", retry=1.2, scale=0.76, retry_scale=1.0)
    return recognise.recognise(raster_pages(spark, sf_dir), options, StubRecogniser(), fx.CODEC)
