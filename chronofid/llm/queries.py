"""One query per operator over the driver tables; SQL counterparts where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofid.llm import collocations, decontamination, licenses, line_dedup, merkle, mixing, ngram_join, preference, quality_rules, sharding, simhash, token_counts, toxicity
from chronofid.session import checkpointed

Query = Callable[[SparkSession, str], DataFrame]


class Catalogue:
    """Collects queries with their SQL; ``sql=None`` marks an operator SQL cannot express."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def register(query: Query) -> Query:
            self.queries[name] = query
            if sql is not None:
                self.sql[name] = sql
            return query

        return register


CATALOGUE = Catalogue()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@CATALOGUE.add("op6_quality_rules")
def op6_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    out = quality_rules.quality_rules(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


@CATALOGUE.add(
    "op7_line_dedup",
    r"""WITH l AS (
  SELECT doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents) s) u),
k AS (SELECT key, max(doc_id) AS keeper FROM l WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT l.*, k.key IS NOT NULL AND l.doc_id <> k.keeper AS gone FROM l LEFT JOIN k ON l.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id""",
)
def op7_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.line_digests(table(spark, folder, "documents"))


@CATALOGUE.add("op9_sharding")
def op9_sharding(spark: SparkSession, folder: str) -> DataFrame:
    out = sharding.shard_slots(table(spark, folder, "documents"), shards=40)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def scored(score: DataFrame, folds: int, fold: int) -> DataFrame:
    return score.select("doc_id", toxicity.held_out(folds, fold).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@CATALOGUE.add("op5_quality_classifier")
def op5_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    # Every text is read once, for learning and for its score.
    statistics = checkpointed(preference.described(docs))
    model = preference.fit_quality(docs, labels.where(~toxicity.held_out(3, 1)), statistics=statistics)
    return scored(preference.score_quality(docs, model, statistics), 3, 1)


@CATALOGUE.add("op10_toxicity")
def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    model = toxicity.fit_toxicity(docs, labels.where(~toxicity.held_out(5, 0)))
    return scored(toxicity.score_toxicity(docs, model), 5, 0)


@CATALOGUE.add("op1_token_counts")
def op1_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.token_counts(table(spark, folder, "documents"))


#: Expected token shares of the domains that ``labels`` tell apart.
TARGETS = {"clean": 0.90, "junk": 0.06, "toxic": 0.04}


def label_domains(labels: DataFrame) -> DataFrame:
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "junk").when(F.col("quality") == 1, "clean")
    return labels.select("doc_id", domain.alias("domain"))


@CATALOGUE.add("op4_mixing_sources")
def op4_mixing_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixing_rates(table(spark, folder, "documents"), label_domains(table(spark, folder, "labels")), TARGETS)


@CATALOGUE.add("op3_license_scan", licenses.oracle_sql())
def op3_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.license_scan(table(spark, folder, "documents"))


JACCARD_SQL = r"""WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
        ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 90 * (a.n + b.n - i)),
b AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r(doc_id, reached) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, b.y FROM r JOIN b ON r.reached = b.x),
c AS (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id
FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN c ON d.doc_id = c.doc_id"""


@CATALOGUE.add("op2_ngram_jaccard_join", JACCARD_SQL)
def op2_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, folder, "documents"), width=3, percent=90)


LEAKS_SQL = r"""WITH d AS (SELECT doc_id, string_split(t, ' ') AS ws FROM
        (SELECT doc_id, trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g')) AS t FROM documents) a WHERE t <> ''),
i AS (SELECT item_id, string_split(t, ' ') AS ws FROM
        (SELECT item_id, trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g')) AS t FROM benchmark) a WHERE t <> ''),
ds AS (SELECT doc_id, len(ws) AS size, k, array_to_string(ws[k:k + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS k FROM d) x),
s AS (SELECT item_id, len(ws) AS length, k, array_to_string(ws[k:k + 4], ' ') AS g FROM (SELECT item_id, ws, unnest(range(1, len(ws) - 3)) AS k FROM i) x),
hit AS (SELECT DISTINCT ds.doc_id, ds.size, ds.k, s.item_id, s.length FROM ds JOIN s ON ds.g = s.g),
c AS (SELECT doc_id, item_id FROM hit GROUP BY doc_id, item_id, size, length HAVING 180 * count(*) >= 80 * (least(size, length) + length - 8)),
w AS (SELECT DISTINCT doc_id, item_id, length, unnest(range(greatest(0, k - 1 - length + 5), least(k - 1, greatest(0, size - length)) + 1)) AS start
      FROM hit JOIN c USING (doc_id, item_id)),
wg AS (SELECT w.doc_id, w.item_id, w.start, ds.g, count(*) AS n FROM w JOIN ds ON ds.doc_id = w.doc_id AND ds.k > w.start AND ds.k <= w.start + w.length - 4
       GROUP BY ALL),
ig AS (SELECT item_id, g, count(*) AS n FROM s GROUP BY ALL),
o AS (SELECT wg.doc_id, wg.item_id, wg.start, sum(least(wg.n, ig.n)) AS i FROM wg JOIN ig ON wg.item_id = ig.item_id AND wg.g = ig.g GROUP BY ALL),
t AS (SELECT doc_id, item_id, start, sum(n) AS n FROM wg GROUP BY ALL),
f AS (SELECT o.doc_id, o.item_id, o.start, CAST(o.i AS DOUBLE) / CAST(t.n + c.n - o.i AS DOUBLE) AS similarity
      FROM o JOIN t ON o.doc_id = t.doc_id AND o.item_id = t.item_id AND o.start = t.start
      JOIN (SELECT item_id, sum(n) AS n FROM ig GROUP BY item_id) c ON o.item_id = c.item_id
      WHERE 100 * o.i >= 80 * (t.n + c.n - o.i))
SELECT doc_id, item_id, similarity, start FROM f QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) = 1"""


@CATALOGUE.add("op8_benchmark_decontamination", LEAKS_SQL)
def op8_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontamination.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select("doc_id", "item_id", "similarity", F.col("start").cast("long").alias("start"))


MERKLE_SQL = r"""WITH RECURSIVE d AS (
  SELECT doc_id, source, lang, CAST(n_chars AS VARCHAR) AS chars, text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lowered,
         xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
             lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)), lambda c, i: xor(c >> 1, 3988292384 * (c & 1)))), 4294967295) % 3 = 0 AS bad
  FROM documents),
f AS (SELECT *, concat(coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
             coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(chars) || ':' || chars, '-')) AS head FROM d),
h AS (SELECT doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
             CASE WHEN bad THEN sha256(head || coalesce(strlen(lowered) || ':' || lowered, '-')) ELSE sha256(head || coalesce(strlen(text) || ':' || text, '-')) END AS shown FROM f),
g AS (SELECT doc_id, coalesce('=' || lang, '') AS grp, leaf, shown, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
             count(*) OVER (PARTITION BY lang) AS n FROM h),
t(lvl, grp, pos, n, node) AS (
  SELECT 0, grp, pos, n, leaf FROM g
  UNION ALL SELECT lvl + 1, grp, pos // 8, (n + 7) // 8, sha256(string_agg(node, '' ORDER BY pos)) FROM t WHERE n > 1 GROUP BY lvl, grp, pos // 8, n),
s AS (SELECT grp, node, row_number() OVER (ORDER BY grp) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1),
u(lvl, pos, n, node) AS (
  SELECT 0, pos, n, node FROM s
  UNION ALL SELECT lvl + 1, pos // 8, (n + 7) // 8, sha256(string_agg(node, '' ORDER BY pos)) FROM u WHERE n > 1 GROUP BY lvl, pos // 8, n),
x AS (SELECT 0 AS tree, lvl, grp, pos, n, node FROM t UNION ALL SELECT 1, lvl, '', pos, n, node FROM u),
b AS (SELECT tree, lvl, grp, pos, n, coalesce(string_agg(node, '') OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
             coalesce(string_agg(node, '') OVER (r ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
      FROM x WINDOW r AS (PARTITION BY tree, lvl, grp, pos // 8 ORDER BY pos)),
v(doc_id, grp, lvl, pos, n, leaf, now, seen) AS (
  SELECT doc_id, grp, 0, pos, n, leaf, shown, '' FROM g
  UNION ALL SELECT v.doc_id, v.grp, v.lvl + 1, v.pos // 8, (v.n + 7) // 8, v.leaf, sha256(b.l || v.now || b.r), v.seen || b.l || b.r
    FROM v JOIN b ON b.tree = 0 AND b.lvl = v.lvl AND b.pos = v.pos AND b.grp = v.grp WHERE v.n > 1),
w(doc_id, grp, lvl, pos, n, leaf, now, seen) AS (
  SELECT v.doc_id, v.grp, 0, s.pos, s.n, v.leaf, v.now, v.seen FROM v JOIN s ON s.grp = v.grp WHERE v.n = 1
  UNION ALL SELECT w.doc_id, w.grp, w.lvl + 1, w.pos // 8, (w.n + 7) // 8, w.leaf, sha256(b.l || w.now || b.r), w.seen || b.l || b.r
    FROM w JOIN b ON b.tree = 1 AND b.lvl = w.lvl AND b.pos = w.pos WHERE w.n > 1)
SELECT w.doc_id, w.leaf, s.node AS subroot, u.node AS root, sha256(w.seen) AS proof_sha256, w.now AS folded_root, w.now = u.node AS verified
FROM w JOIN s ON s.grp = w.grp JOIN u ON u.n = 1 WHERE w.n = 1"""


@CATALOGUE.add("op12_merkle_manifest", MERKLE_SQL)
def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.lowered_where_three_divides(table(spark, folder, "documents"))


@CATALOGUE.add("op13_simhash_near_dedup")
def op13_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"), width=4)


COLLOCATIONS_SQL = r"""WITH p AS (
  SELECT lang, row_number() OVER () AS piece, piece AS body
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[.,;:!?\x0A-\x0D]')) AS piece FROM documents) x),
w AS (SELECT lang, list_filter(regexp_split_to_array(body, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
g AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase
      FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (VALUES (1), (2), (3), (4)) s(k) WHERE len(ws) >= k) x),
c AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM c WHERE k = 1 GROUP BY lang),
a AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM c WHERE k > 1 AND f >= 30),
s AS (SELECT lang, array_to_string(ws[i:j], ' ') AS phrase, max(a) AS longer
      FROM (SELECT lang, ws, k, a, i, unnest(range(i + 1, k + 1)) AS j FROM (SELECT *, unnest(range(1, k)) AS i FROM a WHERE k > 2) y) z
      WHERE j - i + 1 < k GROUP BY ALL),
o AS (SELECT a.* FROM a LEFT JOIN s ON a.lang = s.lang AND a.phrase = s.phrase WHERE s.longer IS NULL OR 100 * s.longer < 80 * a.a),
h AS (SELECT lang, phrase, a, cut, array_to_string(ws[1:cut], ' ') AS x, array_to_string(ws[cut + 1:k], ' ') AS y FROM (SELECT *, unnest(range(1, k)) AS cut FROM o) z),
q AS (SELECT h.lang, h.phrase, h.a, h.cut, l.f AS l, r.f AS r, CAST((2000000::HUGEINT * h.a) // (l.f + r.f) AS BIGINT) AS score
      FROM h JOIN c l ON l.lang = h.lang AND l.phrase = h.x JOIN c r ON r.lang = h.lang AND r.phrase = h.y
      QUALIFY row_number() OVER (PARTITION BY h.lang, h.phrase ORDER BY score, cut) = 1)
SELECT q.lang, row_number() OVER (PARTITION BY q.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score, CAST(cut AS INT) AS cut
FROM q JOIN n ON n.lang = q.lang QUALIFY rank <= 2000"""


@CATALOGUE.add("op11_phrase_collocations", COLLOCATIONS_SQL)
def op11_phrase_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents"), min_count=30, top=2000)
