"""Find documents that are a known licence text, and licence notices that stand on lines of their own.

Method. Canonical text: copyright lines removed, lower case, every run of characters other than letters and digits
read as one space, equivalent spellings made one. The SHA-256 of the canonical text of a whole document is
looked up, by a hash join, in the digests of known licences. Known texts are looked up in the lines of a document too:
every line's digest meets the digests of the known texts' lines, and a known text is found where all of its lines follow
one another. All of it is DataFrame expressions; texts are never shuffled, only matches are.

A copyright line opens with the word or the sign and goes on with the sign, a year, a placeholder, ``by`` or a name
in capitals, so it needs no year. Titles above a text, "All rights reserved" and numbered or plain lists are
rows of the known texts (``license_texts``). Empty lines count nowhere.

``known`` is a DataFrame (``license_id``, ``text``); its digests are broadcast up to ``BROADCAST_ROWS`` of them, and shuffled beyond.

Defined cases. A null or empty text, or one without letters and digits, has the digest of the empty text and matches
nothing. A known text with an empty canonical form is ignored; of several ids for one canonical text the
smallest counts. A notice counts once for each last line, however many known texts of its id end there. Repeated rows each
get the same answer, and rows that share an id but not the text their own. Columns beyond ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofid.llm.license_texts import DIGESTS, KNOWN
from chronofid.session import checkpointed

#: Known digests that are broadcast, about 100 bytes each.
BROADCAST_ROWS = 200_000

#: Equivalent spellings (fixed values), applied in this order to canonical text.
SPELLINGS = [
    ("licence", "license"), ("sub license", "sublicense"), ("non commercial", "noncommercial"), ("copyright holder", "copyright owner"), ("copyright owners", "copyright owner"),
    ("per cent", "percent"), ("artefact", "artifact"), ("authoris", "authoriz"), ("organis", "organiz"), ("recognis", "recogniz"),
    ("whilst", "while"), ("wilful", "willful"), ("judgement", "judgment"), ("favour", "favor"), ("https", "http"),
]

#: Words of licence texts that stand after "Copyright" in capitals without naming a holder (fixed values).
NOT_HOLDERS = "Copyright (Holder|Owner|Licen[cs]e|Notice|Law|Act|Office|Statement)"

#: A copyright line (fixed pattern).
COPYRIGHT_LINE = (
    r"^[^\p{L}\p{N}\n]*(?:(?:copyright|Copyright|COPYRIGHT)[ \t:,]*(?:©|\([cC]\)|[0-9]{4}|[\[<{]|by )|Copyright[ \t:,]+\p{Lu}|©|\([cC]\)[ \t]*[0-9]{4})[^\n]*"
)


def canonical_lines(text: Column) -> Column:
    """The canonical text, lines still apart, without empty lines."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), NOT_HOLDERS, "copyright $1")
    out = F.regexp_replace(out, "(?md)" + COPYRIGHT_LINE, "")
    out = F.regexp_replace(F.lower(out), r"[^\p{L}\p{N}\n]+", " ")
    for spelling, one in SPELLINGS:
        out = F.replace(out, F.lit(spelling), F.lit(one))
    return F.trim(F.regexp_replace(out, r" *\n[ \n]*", "\n"), F.lit(" \n"))


def canonical(lines: Column) -> Column:
    """The canonical text in one line, from ``canonical_lines``; spellings of two words may have stood on two lines."""
    out = F.replace(lines, F.lit("\n"), F.lit(" "))
    for spelling, one in SPELLINGS:
        if " " in spelling:
            out = F.replace(out, F.lit(spelling), F.lit(one))
    return out


def known_lines(known: DataFrame) -> DataFrame:
    """``license_id, lines`` of known texts that say something, lines told apart."""
    rows = known.select("license_id", canonical_lines(F.col("text")).alias("lines")).where(F.col("lines") != "")
    return rows.groupBy("lines").agg(F.min("license_id").alias("license_id"))


def digests(known: DataFrame) -> DataFrame:
    """``digest, license_id`` of known texts."""
    return known_lines(known).groupBy(F.sha2(canonical(F.col("lines")), 256).alias("digest")).agg(F.min("license_id").alias("license_id"))


def line_digests(known: DataFrame) -> DataFrame:
    """``line_digest, notice`` (licence id), ``known`` (the text it is a line of), ``part`` (its place from 0) and ``parts``."""
    lines = F.split("lines", "\n")
    each = known_lines(known).select(F.col("license_id").alias("notice"), F.xxhash64("lines").alias("known"), F.size(lines).alias("parts"), F.posexplode(lines).alias("part", "line"))
    return each.select(F.sha2("line", 256).alias("line_digest"), "notice", "known", "part", "parts")


def known_licenses(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(KNOWN, "license_id string, text string")


def _bounded(table: DataFrame) -> DataFrame:
    table = checkpointed(table)
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def license_scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``doc_id, digest, license_id`` (of the whole text, or null), ``n_notices`` and ``notices`` (ids, joined by comma)."""
    spark = docs.sparkSession
    texts = known_licenses(spark) if known is None else known
    whole = digests(texts)
    if known is None:
        whole = whole.unionByName(spark.createDataFrame(DIGESTS, "license_id string, digest string"))
    lines = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), canonical_lines(F.col("text")).alias("lines"))
    rows = lines.select("doc_id", "text_hash", F.sha2(canonical(F.col("lines")), 256).alias("digest"), F.split("lines", "\n").alias("lines"))
    # The outer form keeps Spark from evaluating the canonical text once more to test for empty arrays.
    each = rows.select("doc_id", "text_hash", "digest", F.posexplode_outer("lines").alias("at", "line")).withColumn("line_digest", F.sha2("line", 256))
    parts = checkpointed(line_digests(texts))
    looked = each.join(_bounded(parts.select("line_digest").distinct().withColumn("known_line", F.lit(True))), "line_digest", "left")
    # The first lines count the rows that agree in id and text; they are told apart again at the end.
    row = ["doc_id", "text_hash", "digest"]
    hits = looked.groupBy(*row).agg(
        F.count_if(F.col("at") == 0).alias("rows"), F.collect_set(F.when(F.col("known_line"), F.struct("at", "line_digest"))).alias("hits")
    )
    hit = hits.select(*row, "rows", F.explode_outer("hits").alias("hit")).select(*row, "rows", "hit.at", "hit.line_digest")
    runs = hit.join(_bounded(parts), "line_digest", "left").groupBy(*row, "rows", "notice", "known", "parts", (F.col("at") - F.col("part")).alias("start")).count()
    whole_run = F.when(F.col("count") == F.col("parts"), F.struct("notice", (F.col("start") + F.col("parts")).alias("end")))
    found = runs.groupBy(*row, "rows").agg(F.collect_set(whole_run).alias("runs"))
    notices = F.array_join(F.array_sort(F.array_distinct(F.col("runs.notice"))), ",").alias("notices")
    answers = found.select("doc_id", "digest", F.size("runs").cast("long").alias("n_notices"), notices, F.explode(F.sequence(F.lit(1), F.col("rows"))).alias("row"))
    return answers.join(_bounded(whole), "digest", "left").select("doc_id", "digest", "license_id", "n_notices", "notices")


def oracle_sql() -> str:
    """The same in DuckDB's SQL."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"

    def lines(column: str) -> str:
        out = f"regexp_replace(coalesce({column}, ''), {quoted(NOT_HOLDERS)}, 'copyright \\1', 'g')"
        out = f"regexp_replace({out}, {quoted('(?m)' + COPYRIGHT_LINE)}, '', 'g')"
        out = f"regexp_replace(lower({out}), '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g')"
        for spelling, one in SPELLINGS:
            out = f"replace({out}, {quoted(spelling)}, {quoted(one)})"
        return f"trim(regexp_replace({out}, ' *\\n[ \\n]*', chr(10), 'g'), ' ' || chr(10))"

    values = ", ".join(f"({quoted(i)}, {quoted(t)})" for i, t in KNOWN)
    fixed = "".join(f" UNION ALL SELECT {quoted(i)}, {quoted(d)}" for i, d in DIGESTS)
    whole = "replace(l, chr(10), ' ')"
    for spelling, one in SPELLINGS:
        if " " in spelling:
            whole = f"replace({whole}, {quoted(spelling)}, {quoted(one)})"
    whole = f"sha256({whole})"
    return f"""WITH t AS (SELECT l, min(license_id) AS license_id FROM (SELECT license_id, {lines('text')} AS l FROM (VALUES {values}) v(license_id, text)) a
  WHERE l <> '' GROUP BY l),
known AS (SELECT digest, min(license_id) AS license_id FROM (SELECT license_id, {whole} AS digest FROM t{fixed}) b GROUP BY digest),
p AS (SELECT l AS id, license_id, len(string_split(l, chr(10))) AS parts, unnest(string_split(l, chr(10))) AS line,
        generate_subscripts(string_split(l, chr(10)), 1) AS part FROM t),
d AS (SELECT doc_id, {lines('text')} AS l FROM documents),
e AS (SELECT doc_id, unnest(string_split(l, chr(10))) AS line, generate_subscripts(string_split(l, chr(10)), 1) AS pos FROM d),
r AS (SELECT doc_id, id, license_id, pos - part + parts AS ending FROM e JOIN p ON e.line = p.line GROUP BY doc_id, id, license_id, parts, pos - part HAVING count(*) = parts),
n AS (SELECT doc_id, count(DISTINCT (license_id, ending)) AS n_notices, array_to_string(list_sort(list(DISTINCT license_id)), ',') AS notices FROM r GROUP BY doc_id)
SELECT d.doc_id, {whole} AS digest, known.license_id, coalesce(n_notices, 0) AS n_notices, coalesce(notices, '') AS notices
FROM d LEFT JOIN known ON {whole} = known.digest LEFT JOIN n ON d.doc_id = n.doc_id"""
