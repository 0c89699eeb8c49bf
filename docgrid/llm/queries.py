"""Queries over the operations of this package, with SQL where it can express them.

Every query applies its operation, with the parameters of use, to its whole
tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgrid.llm import block_names, chunked_bpe, filter_audit, html_blocks, licences, lm, oracles, periodic_runs, positional_index, repeats, scratch, simhash, subword_quality, toxicity, warc
from docgrid.llm.text import crc32_mod

#: Where the public tokenizer files are; a parameter, they are not part of the repository.
TOKENIZERS = "/opt/tokenizers"
WORD_BPE = f"{TOKENIZERS}/word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a WARC record, written and read back.

    A null html has an empty payload. Rows that repeat an id, null ids and ties have a record
    each (``warc.write``); an empty table gives no rows. Columns of other names aren't read.
    """
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose SimHash fingerprints differ in at most four bits.

    Null and empty texts have the fingerprint zero and are linked like any others. Repeated rows and
    ids are rows of their own; ties of a component go to its smallest id. Empty tables give no rows.
    """
    return simhash.near_components(table(spark, sf_dir, "documents"))


def op3_chunked_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document's ids and decoded text.

    A null text counts as empty. Rows are encoded one by one, so there are no ties, repeated rows have
    repeated results, and an empty table has none.
    """
    return chunked_bpe.encode(table(spark, sf_dir, "documents"), WORD_BPE, ["doc_id"])


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside windows of benchmark items.

    Null texts have no words. Repeated rows are rows of their own, equal items of several ids are all
    named; items with a null id hit but aren't named. Without documents the result is empty, without
    items nothing is hit.
    """
    rows = scratch.with_row_ids(table(spark, sf_dir, "documents").select("doc_id", "text"), "docs")
    found = positional_index.contamination(rows, table(spark, sf_dir, "benchmark"))
    return rows.select(scratch.ROW, "doc_id").join(found, scratch.ROW).drop(scratch.ROW)


def op5_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of every document by unigrams and by the log-bilinear model.

    A null text counts as empty and has its end alone. Repeated rows count in training as often as they
    stand there, and null ids as empty text in the choice of rows; an empty table gives no rows.
    """
    return lm.score(table(spark, sf_dir, "documents"))


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page.

    A null html counts as empty and has an empty text. Pages are read one by one: repeated rows and
    ids have repeated results, and an empty table has none.
    """
    return html_blocks.extract(table(spark, sf_dir, "pages"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of every document.

    Null and empty texts have the score of a text without hits. Equal texts have equal scores, so there
    are no ties; repeated rows stay, and an empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    held_out = (crc32_mod(F.col("doc_id"), 5) == 0).alias("held_out")
    return toxicity.score(docs, model).select("doc_id", held_out, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts, and the row of each that stays.

    A null text counts as empty. Null ids are the smallest; where rows repeat the largest id of a group one
    of them stays. An empty table gives no rows.
    """
    rows = scratch.with_row_ids(table(spark, sf_dir, "documents").select("doc_id", "text"), "docs")
    return block_names.exact_groups(rows).drop(scratch.ROW)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of every document.

    A null text counts as empty, and empty texts have a score of their own. Equal texts have equal scores;
    repeated rows stay, and an empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = subword_quality.fit(docs, table(spark, sf_dir, "labels"))
    held_out = (crc32_mod(F.col("doc_id"), 3) == 1).alias("held_out")
    return subword_quality.score(docs, model).select("doc_id", held_out, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences that every document names or holds.

    Null and empty texts have none. Ties of coefficients go to the first name; repeated rows have repeated
    results, and an empty table has none.
    """
    found = licences.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "licence", F.round("dice", 9).alias("dice"), "n_matches", F.array_join("licences", ",").alias("licences"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document's words, a tenth of the documents with planted ones.

    A null text has no words. Ties of the longest run go to the smallest start, then period. Rows are worked on
    one by one: repeated rows have repeated results, and an empty table has none.
    """
    docs = scratch.spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = periodic_runs.find_runs(docs.select("doc_id", periodic_runs.plant(F.col("text"), F.col("doc_id")).alias("text")), ["doc_id"])
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    start, period = (-F.col("b.s")).alias("start"), (-F.col("b.p")).alias("period")
    exponent = F.floor(1000 * F.col("b.length") / -F.col("b.p")).alias("exponent_milli")
    return found.select("doc_id", "n_runs", start, F.col("b.length").alias("length"), period, exponent, "runs_sha256", "collapsed_sha256")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each filter does in each order of the five, by language.

    A null text counts as empty, a null lang as the empty string. Repeated rows all count; of texts of the same
    smallest id none is a copy. An empty table has no parts, so no rows.
    """
    return filter_audit.audit_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that repeat an earlier string of 100.

    A null text counts as empty. Repeated ids are texts of their own, null ids come last; the order is that of
    ``repeats.numbered``. An empty table gives no rows.
    """
    found = repeats.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op3_chunked_bpe": op3_chunked_bpe,
    "op4_decontamination": op4_decontamination,
    "op5_log_bilinear": op5_log_bilinear,
    "op6_main_text": op6_main_text,
    "op7_toxicity": op7_toxicity,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_quality": op9_quality,
    "op10_licences": op10_licences,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_filter_audit": op12_filter_audit,
    "op13_repeats": op13_repeats,
}

_A_TO_Z = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_A_TO_Z}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_TEMPLATES = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in licences.TEMPLATES)
_PAIRS = "list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])"

ORACLE_SQL: dict[str, str] = {
    "op11_periodic_runs": oracles.PERIODIC_RUNS,
    "op12_filter_audit": oracles.FILTER_AUDIT,
    "op13_repeats": oracles.REPEATS,
    "op1_warc": """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS digest FROM pages),
s AS (SELECT *, octet_length(encode(html)) AS n FROM p),
g AS (SELECT digest, min(page_id) AS first FROM s WHERE n >= 100 GROUP BY digest)
SELECT s.page_id, CAST(s.n AS BIGINT) AS payload_bytes, s.digest AS payload_digest,
       CASE WHEN g.first <> s.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN g.first <> s.page_id THEN g.first END AS refers_to, s.url
FROM s LEFT JOIN g ON s.digest = g.digest
""",
    "op10_licences": rf"""
WITH t AS (SELECT row_number() OVER () AS t, * FROM (VALUES {_TEMPLATES}) AS x(name, body)),
tw AS (SELECT t, name, regexp_extract_all(lower(body), '[a-z0-9]+') AS w FROM t),
tp AS (SELECT DISTINCT t, name, unnest({_PAIRS}) AS p FROM tw),
tn AS (SELECT t, count(*) AS n FROM tp GROUP BY t),
d AS (SELECT doc_id, {_A_TO_Z} AS text FROM documents),
b AS (SELECT doc_id, text, regexp_split_to_array(text, '\n[ \t\r]*\n') AS parts FROM d),
seg AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s FROM d
        UNION ALL SELECT doc_id, s FROM (SELECT doc_id, unnest(parts) AS s FROM b) WHERE contains(s, chr(10))
        UNION ALL SELECT doc_id, text FROM b WHERE len(parts) > 1),
sw AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(s, '[a-z0-9]+') AS w FROM seg),
sp AS (SELECT DISTINCT k, doc_id, unnest({_PAIRS}) AS p FROM sw),
sn AS (SELECT k, count(*) AS n FROM sp GROUP BY k),
m AS (SELECT sp.k, sp.doc_id, tp.t, tp.name, count(*) AS c FROM sp JOIN tp ON sp.p = tp.p GROUP BY sp.k, sp.doc_id, tp.t, tp.name),
x AS (SELECT m.k, m.doc_id, m.name, 2.0::DOUBLE * m.c / (sn.n + tn.n) AS dice FROM m JOIN sn ON m.k = sn.k JOIN tn ON m.t = tn.t),
best AS (SELECT k, doc_id, name, dice FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY dice DESC, name) AS r FROM x WHERE dice >= 0.8::DOUBLE) WHERE r = 1),
top AS (SELECT doc_id, name, dice FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY dice DESC, name) AS r FROM best) WHERE r = 1),
many AS (SELECT doc_id, count(*) AS n_matches FROM best GROUP BY doc_id),
named AS (SELECT doc_id, string_agg(name, ',' ORDER BY name) AS licences FROM (SELECT DISTINCT doc_id, name FROM best) GROUP BY doc_id)
SELECT d.doc_id, top.name AS licence, round(top.dice, 9) AS dice, coalesce(many.n_matches, 0) AS n_matches, coalesce(named.licences, '') AS licences
FROM d LEFT JOIN top ON d.doc_id = top.doc_id LEFT JOIN many ON d.doc_id = many.doc_id LEFT JOIN named ON d.doc_id = named.doc_id
""",
    "op4_decontamination": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
iw AS (SELECT item_id, w, least(10, len(w)) AS n FROM i WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[k:k + n - 1], ' ') AS g
        FROM (SELECT item_id, n, w, unnest(range(1, len(w) - n + 2)) AS k FROM iw)),
sizes AS (SELECT DISTINCT n FROM win),
g AS (SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS g
      FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes)),
m AS (SELECT g.doc_id, g.k, g.n, win.item_id FROM g JOIN win ON g.g = win.g AND g.n = win.n),
hit AS (SELECT doc_id, count(*) AS n_hit FROM
        (SELECT DISTINCT doc_id, unnest(range(k, k + n)) AS p FROM m) GROUP BY doc_id),
item AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM
         (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(hit.n_hit, 0) AS n_hit,
       coalesce(item.n_items, 0) AS n_items, sha256(coalesce(item.items, '')) AS items_sha256,
       coalesce(hit.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN item ON d.doc_id = item.doc_id
""",
    "op8_exact_dedup": f"""
WITH d AS (SELECT doc_id, {_A_TO_Z} AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
""",
}
