"""The queries of this subpackage: ``opN_<name>`` over whole tables, and their DuckDB SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerfline.llm import exact_dedup, langid, line_dedup, mixing, near_dup, ngram_join, packing, periodic, pii, secret_scan, sentencepiece_fst, spelling, topk
from kerfline.llm.common import BLANK, table


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER w AND row_number() OVER (PARTITION BY text_sha256, doc_id) = 1 AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), chr(0))), 1, 4) AS INTEGER) % 128 AS slice FROM documents),
c AS (SELECT *, lpad(CAST(length(bin(size)) AS VARCHAR), 2, '0') || rpad(substr(bin(size), 2, 2), 2, '0') AS class FROM d),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM c GROUP BY source),
s1 AS (SELECT *, CAST([3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight, 2.0::DOUBLE * source_size AS cap FROM s0),
s2 AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
          / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s1),
s3 AS (SELECT *, max(level) OVER () AS top FROM s2),
s AS (SELECT source, source_size, least(cap, top * weight) AS target,
             CAST(CAST('0x' || substr(md5('mix' || coalesce(source, chr(0))), 1, 12) AS BIGINT) AS DOUBLE) / 281474976710656.0::DOUBLE AS start FROM s3),
r AS (SELECT c.*, row_number() OVER (PARTITION BY source ORDER BY class, slice, size, doc_id) AS k FROM c)
SELECT doc_id, size, source_size, target,
       CAST((floor(start + coalesce(target / nullif(source_size, 0), 0) * k) - floor(start + coalesce(target / nullif(source_size, 0), 0) * (k - 1))) * size AS BIGINT) AS taken
FROM r JOIN s ON r.source IS NOT DISTINCT FROM s.source
"""


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = langid.identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.col("found")
    return found.select(
        "doc_id", *(secret_scan.count_of(spans, k).alias(f"n_{k}") for k in ("assign", "access", "hex")),
        F.sha2(secret_scan.listed(secret_scan.base_only(spans)), 256).alias("base_sha256"),
        secret_scan.listed(spans).alias("spans"),
    )


def _op3_sql() -> str:
    rules = secret_scan.BASE_RULES + secret_scan.MORE_RULES
    quoted = [r.pattern.replace("'", "''") for r in rules]
    kinds = " UNION ALL ".join(
        f"SELECT rid, {n} AS rank, '{r.kind}' AS kind, {r.least} AS least, regexp_extract_all(text, '{q}', 0) AS whole, "
        f"regexp_extract_all(text, '{q}', {r.group}) AS part, string_split_regex(text, '{q}') AS gap FROM d"
        for n, (r, q) in enumerate(zip(rules, quoted, strict=True))
    )
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
k AS ({kinds}),
e AS (SELECT rid, rank, kind, least, generate_subscripts(whole, 1) AS i, unnest(whole) AS whole, unnest(part) AS part, unnest(gap[1:len(whole)]) AS gap FROM k),
p AS (SELECT *, CAST(sum(length(gap) + length(whole)) OVER (PARTITION BY rid, rank ORDER BY i) AS BIGINT) AS stop FROM e),
s AS (SELECT rid, rank, kind, stop - length(whole) AS start, kind || ':' || (stop - length(whole)) || ':' || stop AS span FROM p WHERE length(part) >= least),
a AS (SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
             string_agg(span, ',' ORDER BY start, rank) FILTER (rank < 3) AS base, string_agg(span, ',' ORDER BY start, rank) AS spans FROM s GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (rid)
"""


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.search(vectors, F.col("vec_id") % 50 == 0)


OP6_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.rid, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.rid <> c.rid AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_fst.encode(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.classes(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("node")


def op11_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.linked(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP11_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (
  SELECT rid, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS gram FROM d),
n AS (SELECT rid, count(*) AS n FROM g GROUP BY rid),
o AS (SELECT x.rid AS a, y.rid AS b, count(*) AS i FROM g x JOIN g y ON x.gram = y.gram AND x.rid <> y.rid GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n p ON p.rid = a JOIN n q ON q.rid = b WHERE 100 * i >= 80 * (p.n + q.n - i)),
reach AS (SELECT rid, rid AS other FROM d UNION SELECT reach.rid, l.b FROM reach JOIN l ON reach.other = l.a),
c AS (SELECT reach.rid, min(d.doc_id) AS component_id FROM reach JOIN d ON d.rid = reach.other GROUP BY reach.rid)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id FROM d JOIN c USING (rid) LEFT JOIN n USING (rid)
"""


def slipped(runs: DataFrame) -> DataFrame:
    """``runs(doc_id, run)`` with the slips of the contract: where 199 divides ``h = crc32(doc_id:run)`` the run's letter ``h % length`` is missing. A null id counts as empty."""
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    return runs.withColumn("h", h).select(F.expr("CASE WHEN h % 199 = 0 THEN concat(substr(run, 1, CAST(h % length(run) AS INT)), substr(run, CAST(h % length(run) AS INT) + 2)) ELSE run END").alias("run"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = spelling.runs_of(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=("doc_id",))
    return spelling.grouped(spelling.counted(slipped(runs)))


OP12_SQL = r"""
WITH RECURSIVE bits AS (
  SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS c FROM range(256) t(i)),
crc AS (SELECT list(c ORDER BY i) AS tbl FROM bits),
r AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]{6,}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
b AS (
  SELECT run, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''), lambda c: CASE WHEN ord(c) < 128 THEN [CAST(ord(c) AS BIGINT)] ELSE [195, CAST(ord(c) AS BIGINT) - 64] END)) AS bytes FROM r),
h AS (
  SELECT run, xor(list_reduce(list_concat([4294967295], bytes), lambda x, y: xor(x >> 8, tbl[(xor(x, y) & 255) + 1])), 4294967295) AS h FROM b, crc),
s AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM h),
w AS (SELECT word, count(*) AS n FROM s WHERE length(word) >= 6 GROUP BY word HAVING count(*) >= 5),
k AS (SELECT word, n, unnest(list_distinct(list_append(list_transform(range(1, length(word) + 1), lambda i: substr(word, 1, i - 1) || substr(word, i + 1)), word))) AS key FROM w),
p AS (
  SELECT DISTINCT a.word, b.word AS other, b.n AS m FROM k a JOIN k b ON a.key = b.key AND a.word <> b.word
  WHERE (abs(length(a.word) - length(b.word)) = 1 AND length(a.key) = least(length(a.word), length(b.word)))
     OR (length(a.word) = length(b.word) AND len(list_filter(range(1, length(a.word) + 1), lambda i: substr(a.word, i, 1) <> substr(b.word, i, 1))) = 1)),
f AS (SELECT word, count(*) AS n_near, max(m) AS form_n, arg_min(other, (-m, other)) AS form FROM p GROUP BY word),
g AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 5 * w.n THEN form END AS form, CASE WHEN form_n >= 5 * w.n THEN form_n END AS form_n FROM w LEFT JOIN f USING (word)),
way AS (SELECT word, word AS root FROM g UNION ALL SELECT way.word, g.form FROM way JOIN g ON way.root = g.word WHERE g.form IS NOT NULL)
SELECT g.word, g.form, way.root, g.n, g.n_near, g.form_n FROM g JOIN way USING (word) JOIN g AS last ON last.word = way.root AND last.form IS NULL
"""


def repeated(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` with the repetitions of the contract: where ``h = crc32(doc_id)`` ends in 0, words from ``a`` on repeat the ``p`` words there."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    some = docs.withColumn("g", F.floor(h / 10)).withColumn("words", F.when(h % 10 == 0, F.filter(F.split("text", f"[{BLANK}]+", -1), lambda w: w != "")))
    made = some.withColumn("n", F.size("words")).withColumn("a", F.expr("CASE WHEN n > 0 THEN g % n END")).withColumn("p", F.expr("1 + (n - a) DIV (3 + g % 8)"))
    text = F.expr("array_join(transform(sequence(0, n - 1), i -> words[CAST(CASE WHEN i >= a THEN a + (i - a) % p ELSE i END AS INT)]), ' ')")
    return made.select("doc_id", F.when(F.col("a").isNotNull(), text).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.find(repeated(table(spark, sf_dir, "documents").select("doc_id", "text"))).withColumn("best", periodic.greatest(F.col("runs")))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *(F.col("best")[c].alias(c) for c in ("start", "length", "period")),
        F.expr("1000 * best.length DIV best.period").alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def queries() -> dict:
    return {
        "op1_exact_dedup": op1_exact_dedup,
        "op2_language_id": op2_language_id,
        "op3_secret_scan": op3_secret_scan,
        "op4_pii": op4_pii,
        "op5_mixing": op5_mixing,
        "op6_topk": op6_topk,
        "op7_sentencepiece": op7_sentencepiece,
        "op8_packing": op8_packing,
        "op9_line_dedup": op9_line_dedup,
        "op10_near_dup": op10_near_dup,
        "op11_ngram_join": op11_ngram_join,
        "op12_spelling": op12_spelling,
        "op13_periodic_runs": op13_periodic_runs,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": OP1_SQL, "op3_secret_scan": _op3_sql(), "op5_mixing": OP5_SQL, "op6_topk": OP6_SQL, "op11_ngram_join": OP11_SQL, "op12_spelling": OP12_SQL}
