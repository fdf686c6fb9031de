"""All queries of the engine by name, with the same in SQL.

The tables of the driver hold invented prose, so the queries pass word lists and patterns that occur in them;
the defaults are tested on fixtures of their own.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sieveline.functions import text as tx
from sieveline.operators import audit, extract, framing, media, metrics, ml, relevance, similarity, splits
from sieveline.plans.workers import reachable
from sieveline.sources import records as src
from sieveline.sources import sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        @functools.wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            reachable(spark)
            return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# ---------------------------------------------------------------- parameters
TERMS = [("license", 300), ("worthless", 300), ("der", 150), ("que", 150), ("the", 70), ("of", 70), ("reation", 70), ("and the", 150)]
OFF_TOPIC = ["idiot", "scum", "les", "und"]
MARKS = [("insult", "idiot|moron|scum|worthless"), ("amount", "[0-9]+%?"), ("shout", "[!?]{2,}")]
STOP = ["the", "of", "and", "der", "que", "les"]
MARKER = "(?i)(?:stupid|trash|license|copyright)"
CHECKED_TERMS = ", ".join(f"('{t}', {w})" for t, w in TERMS)
SEED, SHARED_SHARE = 42, 0.02

# ---------------------------------------------------------------- SQL parts
UID = "substr(sha1(source || ':' || CAST(doc_id AS VARCHAR)), 1, 16)"


def norm_sql(column: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower(coalesce({column}, '')), '[^\\p{{L}}\\p{{N}}_\\s\\x{{0900}}-\\x{{097F}}]+', ' ', 'g'), '\\s+', ' ', 'g'))"


TITLE_SQL = "split_part(text, chr(10), 1)"
FIELDS_SQL = f"SELECT doc_id, source, {norm_sql(TITLE_SQL)} AS title, substr({norm_sql('text')}, 1, 6000) AS body FROM documents"
HIT = "(contains(' ' || {0} || ' ', ' ' || term || ' ') OR (length(term) > 6 AND contains({0}, term)))"
SCORE_SQL = f"""lex(term, w) AS (VALUES {CHECKED_TERMS}), neg(term) AS (VALUES {", ".join(f"('{t}')" for t in OFF_TOPIC)}),
f AS ({FIELDS_SQL}),
pos AS (SELECT doc_id, sum(CASE WHEN {HIT.format('title')} THEN w * 25 ELSE 0 END + CASE WHEN {HIT.format('body')} THEN w * 10 ELSE 0 END) AS p,
        count(*) FILTER (WHERE {HIT.format('title')} OR {HIT.format('body')}) AS n_hits FROM f, lex GROUP BY doc_id),
negs AS (SELECT doc_id, count(*) FILTER (WHERE contains(' ' || title || ' ', ' ' || term || ' ')) AS n FROM f, neg GROUP BY doc_id),
scored AS (SELECT doc_id, CAST(p - 2000 * n AS BIGINT) AS score_milli, n_hits, n AS n_off FROM pos JOIN negs USING (doc_id))"""
VERDICT_SQL = "CASE WHEN toxic = 1 THEN 'Partly false' WHEN quality = 0 THEN 'Unverified' ELSE 'Mostly TRUE' END"
LABEL_SQL = "CASE WHEN toxic = 1 THEN 'fake' WHEN quality = 0 THEN 'unknown' WHEN quality = 1 THEN 'real' END"
WORDS_SQL = f"list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9\\x{{0900}}-\\x{{097F}}]+'), lambda w: NOT list_contains({STOP}, w))"
SHINGLES_SQL = f"""w AS (SELECT doc_id, {WORDS_SQL} AS words FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(words) < 3 THEN words ELSE list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) END) AS items FROM w)"""
PAIRS_SQL = f"""{SHINGLES_SQL},
e AS (SELECT doc_id, unnest(items) AS item FROM s),
i AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM e x JOIN e y ON x.item = y.item AND x.doc_id < y.doc_id GROUP BY ALL),
pairs AS (SELECT a, b, common, len(sa.items) + len(sb.items) - common AS united FROM i JOIN s sa ON sa.doc_id = a JOIN s sb ON sb.doc_id = b WHERE common * 5 >= (len(sa.items) + len(sb.items) - common) * 3)"""
CLUSTERS_SQL = f"""{PAIRS_SQL},
both_ways AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
reach AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT b, root FROM reach JOIN both_ways ON node = a),
clusters AS (SELECT node AS doc_id, min(root) AS cluster FROM reach GROUP BY node)"""
STRATA_SQL = f"""labelled AS (SELECT d.doc_id, source, CAST(doc_id // 3 AS VARCHAR) AS cluster, coalesce({LABEL_SQL}, 'unknown') AS label FROM documents d LEFT JOIN labels l USING (doc_id)),
most_label AS (SELECT cluster, label FROM (SELECT cluster, label, count(*) AS n, min(doc_id) AS f FROM labelled GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY n DESC, f) = 1),
most_source AS (SELECT cluster, source FROM (SELECT cluster, source, count(*) AS n, min(doc_id) AS f FROM labelled GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY n DESC, f) = 1),
strata AS (SELECT cluster, label, source FROM most_label JOIN most_source USING (cluster))"""
SPLIT_SQL = f"""{STRATA_SQL},
ranked AS (SELECT *, row_number() OVER (PARTITION BY label, source ORDER BY md5('{SEED}:' || cluster), cluster) AS k, count(*) OVER (PARTITION BY label, source) AS n FROM strata),
parts AS (SELECT *, n * 700 // 1000 AS a, n * 150 // 1000 AS b, n * 150 // 1000 AS c, n * 700 % 1000 AS ra, n * 150 % 1000 AS rb FROM ranked),
quota AS (SELECT *, a + CASE WHEN (CASE WHEN rb > ra THEN 2 ELSE 0 END) < n - a - b - c THEN 1 ELSE 0 END AS qa,
          b + CASE WHEN (CASE WHEN ra >= rb THEN 1 ELSE 0 END) < n - a - b - c THEN 1 ELSE 0 END AS qb FROM parts),
split AS (SELECT cluster, label, source, CASE WHEN k <= qa THEN 'train' WHEN k <= qa + qb THEN 'val' ELSE 'test' END AS split FROM quota),
assigned AS (SELECT doc_id, labelled.cluster, labelled.label, labelled.source, split FROM labelled JOIN split USING (cluster))"""
TRUTH_SQL = "truth AS (SELECT doc_id, source, quality AS y_true, CAST(n_chars % 97 AS DOUBLE) / 97 AS score FROM documents JOIN labels USING (doc_id))"
COUNTS_SQL = "count(*) FILTER (WHERE y_true = 1 AND score >= 0.5) AS tp, count(*) FILTER (WHERE y_true = 0 AND score >= 0.5) AS fp, count(*) FILTER (WHERE y_true = 1 AND score < 0.5) AS fn, count(*) FILTER (WHERE y_true = 0 AND score < 0.5) AS tn"
CURVE_SQL = f"""{TRUTH_SQL}, g AS (SELECT score, sum(y_true) AS pos, count(*) AS n FROM truth GROUP BY score),
curve AS (SELECT score AS threshold, CAST(sum(pos) OVER w AS BIGINT) AS tp, CAST(sum(n - pos) OVER w AS BIGINT) AS fp, sum(pos) OVER () AS p, sum(n) OVER () AS n_all FROM g WINDOW w AS (ORDER BY score DESC))"""


# ---------------------------------------------------------------- Spark parts
def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents")


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "source", F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("body"))
    return relevance.score(docs, TERMS, OFF_TOPIC, [("title", 25), ("body", 10)])


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdict = F.when(F.col("toxic") == 1, "Partly false").when(F.col("quality") == 0, "Unverified").otherwise("Mostly TRUE")
    return read(spark, sf_dir, "labels").select("doc_id", "quality", "toxic", verdict.alias("verdict")).withColumn("label", relevance.verdict_label("verdict"))


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "source", F.floor(F.col("doc_id") / 3).cast("string").alias("cluster"))
    return docs.join(_labels(spark, sf_dir).select("doc_id", "label"), "doc_id", "left").withColumn("label", F.coalesce("label", F.lit("unknown")))


def _shingled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.with_shingles(_documents(spark, sf_dir).select("doc_id", "text"), "text", 3, STOP)


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.similar_pairs(_shingled(spark, sf_dir), "doc_id")


def _clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.components(_documents(spark, sf_dir).select("doc_id"), _pairs(spark, sf_dir), "doc_id")


def _assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _labelled(spark, sf_dir)
    split = splits.split_at_scale(splits.strata(rows, ordinal="doc_id"), seed=SEED)
    return rows.join(split.select("cluster", "split"), "cluster")


def _truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "source", ((F.col("n_chars") % 97).cast("double") / 97).alias("score"))
    return docs.join(read(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y_true")), "doc_id").withColumn("y_pred", (F.col("score") >= 0.5).cast("int"))


def _signatures(spark: SparkSession, sf_dir: str, vector: Column) -> DataFrame:
    """The signs of a vector of up to 64 components, the first at the top."""
    bits = F.aggregate(F.transform(vector, lambda x, i: F.when(x > 0, F.expr("1L")).otherwise(F.expr("0L"))), F.expr("0L"), lambda a, b: F.shiftleft(a, 1).bitwiseOR(b))
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), bits.alias("signature"))


def _segments(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The turns, and their places in the conversations."""
    turns = read(spark, sf_dir, "conversations")
    segments = media.positioned(turns, "conv_id", "turn", "text").select("conv_id", "left", "right", F.col("turn").cast("double").alias("start"), (F.col("turn") + 1).cast("double").alias("end"))
    return turns, segments


# ---------------------------------------------------------------- projections
@query(f"SELECT doc_id, {UID} AS uid FROM documents")
def uid_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", tx.uid("source", "doc_id").alias("uid"))


@query(f"SELECT doc_id, {norm_sql('text')} AS normalised FROM documents")
def normalise_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", tx.normalise("text").alias("normalised"))


@query("""WITH n AS (SELECT doc_id, len(regexp_extract_all(text, '[\\x{0900}-\\x{097F}]')) AS d, len(regexp_extract_all(text, '[A-Za-z]')) AS l, len(regexp_extract_all(text, '[0-9]')) AS g FROM documents)
SELECT doc_id, CASE WHEN d + l + g > 0 THEN round(d / (d + l + g), 3) ELSE 0 END AS devanagari, CASE WHEN d + l + g > 0 THEN round(l / (d + l + g), 3) ELSE 0 END AS latin, CASE WHEN d + l + g > 0 THEN round(g / (d + l + g), 3) ELSE 0 END AS digit FROM n""")
def script_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", tx.script_profile("text").alias("p")).select("doc_id", "p.*")


@query("""SELECT doc_id, length(t) < 200 OR len(regexp_extract_all(t, '[\\p{L}\\p{N}]')) / greatest(length(t), 1) < 0.8 AS garbage FROM (SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM documents)""")
def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", tx.looks_like_garbage("text", 200, 0.8).alias("garbage"))


@query("WITH t AS (SELECT doc_id, " + ", ".join(f"list_filter(regexp_extract_all(lower(text), '{p}'), lambda x: true) AS m{i}" for i, (_, p) in enumerate(MARKS)) + " FROM documents) " + " UNION ALL ".join(f"SELECT doc_id, '{name}' AS cue, CAST(least(5, len(list_distinct(m{i}))) AS BIGINT) AS n FROM t WHERE len(m{i}) > 0" for i, (name, _) in enumerate(MARKS)))
def text_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _documents(spark, sf_dir).select("doc_id", F.explode(tx.cues(F.lower("text"), MARKS)).alias("c"))
    return found.select("doc_id", "c.cue", F.size("c.matches").cast("long").alias("n"))


@query("SELECT conv_id, turn, left(concat_ws(' [SEP] ', nullif(trim(role), ''), nullif(trim(text), '')), 4000) AS assembled FROM conversations")
def assemble_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", tx.assemble(["role", "text"]).alias("assembled"))


@query("SELECT page_id, substr(sha256(url), 1, 24) AS cache_key, regexp_replace(regexp_replace(url, '#.*$', ''), '/+$', '') AS plain_url FROM pages")
def page_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", src.cache_key("url").alias("cache_key"), audit.plain_url("url").alias("plain_url"))


@query("SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title(?:\\s[^>]*)?>(.*?)</title>', 1), '<[^>]+>', '', 'g')) AS title, trim(regexp_replace(regexp_extract(html, '(?is)<h1(?:\\s[^>]*)?>(.*?)</h1>', 1), '<[^>]+>', '', 'g')) AS heading FROM pages")
def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", extract.tag_text("html", "title").alias("title"), extract.tag_text("html", "h1").alias("heading"))


@query("SELECT doc_id, CASE WHEN regexp_matches(text, '^[=+\\-@\\t\\r]') THEN '''' || text ELSE text END AS cell FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '=' || text WHEN doc_id % 3 = 1 THEN '-' || text ELSE text END AS text FROM documents)")
def guarded_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.when(F.col("doc_id") % 3 == 0, F.lit("=")).when(F.col("doc_id") % 3 == 1, F.lit("-")).otherwise(F.lit(""))
    return _documents(spark, sf_dir).select("doc_id", tx.guard_cell(F.concat(start, "text")).alias("cell"))


ROMAN = {"the": "TE", "of": "O", "que": "QU", "und": "UN"}
ROMAN_SQL = "coalesce(map {" + ", ".join(f"'{k}': '{v}'" for k, v in ROMAN.items()) + "}[lower(t)], t)"


@query(f"""SELECT doc_id, trim(regexp_replace(list_aggregate(list_transform(regexp_extract_all(text, '[A-Za-z\\x{{0900}}-\\x{{097F}}0-9]+|[^\\sA-Za-z\\x{{0900}}-\\x{{097F}}0-9]'), lambda t: {ROMAN_SQL}), 'string_agg', ' '), ' ([^\\p{{L}}\\p{{N}}_\\x{{0900}}-\\x{{097F}}])', '\\1', 'g')) AS converted FROM documents""")
def transliterated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", tx.transliterate("text", ROMAN).alias("converted"))


# ---------------------------------------------------------------- relevance and labels
@query(f"WITH {SCORE_SQL} SELECT doc_id, score_milli, n_hits, n_off, score_milli >= 4000 AS is_relevant FROM scored")
def relevance_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("doc_id", "score_milli", F.size("hits").cast("long").alias("n_hits"), F.size("off_topic_hits").cast("long").alias("n_off"), "is_relevant")


@query(f"""WITH {SCORE_SQL}, r AS (SELECT d.source, score_milli >= 4000 AS ok, coalesce({LABEL_SQL}, 'unknown') AS label FROM documents d JOIN scored USING (doc_id) LEFT JOIN labels USING (doc_id))
SELECT source, count(*) AS total, count(*) FILTER (WHERE ok) AS relevant, count(*) FILTER (WHERE label <> 'unknown') AS labelled, count(*) FILTER (WHERE ok AND label <> 'unknown') AS kept FROM r GROUP BY source""")
def source_yield(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scored(spark, sf_dir).join(_labels(spark, sf_dir).select("doc_id", "label"), "doc_id", "left").withColumn("label", F.coalesce("label", F.lit("unknown")))
    return relevance.source_yield(rows)


@query("SELECT source, lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY ROLLUP (source, lang)")
def yield_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).rollup("source", "lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query(f"SELECT doc_id, {VERDICT_SQL} AS verdict, {LABEL_SQL} AS label FROM labels")
def label_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labels(spark, sf_dir).select("doc_id", "verdict", "label")


@query("SELECT conv_id, turn, CASE WHEN regexp_matches(text, '(?i)^(yes,|the )|(is|of) the') THEN 'real' WHEN regexp_matches(text, '(?i)^(an|re)|(ouble|tion)\\.') THEN 'fake' ELSE 'unknown' END AS label FROM conversations")
def title_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", relevance.title_label("text", r"^(yes,|the )|(is|of) the", r"^(an|re)|(ouble|tion)\.").alias("label"))


@query(f"WITH c AS (SELECT {LABEL_SQL} AS label, count(*) AS n FROM labels GROUP BY 1) SELECT label, n, sum(n) OVER () / (count(*) OVER () * n) AS weight FROM c")
def label_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relevance.class_weights(_labels(spark, sf_dir))


@query(f"WITH m AS (SELECT doc_id, list_sort(list_distinct(list_transform(regexp_extract_all(text, '{MARKER}'), lambda x: lower(x)))) AS hits FROM documents) SELECT doc_id, array_to_string(hits, ',') AS markers FROM m WHERE len(hits) > 0")
def label_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _documents(spark, sf_dir).where(F.col("text").rlike(MARKER)).select("doc_id", audit.markers("text", MARKER).alias("hits"))
    return found.select("doc_id", F.array_join("hits", ",").alias("markers"))


# ---------------------------------------------------------------- near duplicates
@query(f"WITH {SHINGLES_SQL} SELECT doc_id, CAST(len(items) AS BIGINT) AS n, md5(array_to_string(list_sort(items), '|')) AS digest FROM s")
def shingle_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shingled(spark, sf_dir).select("doc_id", F.size("shingles").cast("long").alias("n"), F.md5(F.array_join(F.array_sort("shingles"), "|").cast("binary")).alias("digest"))


@query(f"WITH {PAIRS_SQL} SELECT a, b, CAST(common AS BIGINT) AS common, CAST(united AS BIGINT) AS united FROM pairs")
def near_dup_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("a", "b", F.col("common").cast("long").alias("common"), F.col("united").cast("long").alias("united"))


@query(f"WITH RECURSIVE {CLUSTERS_SQL} SELECT doc_id, cluster FROM clusters")
def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clusters(spark, sf_dir)


@query(f"WITH RECURSIVE {CLUSTERS_SQL}, z AS (SELECT cluster, count(*) AS n FROM clusters GROUP BY cluster) SELECT CAST(sum(n) AS BIGINT) AS records, count(*) AS clusters, max(n) AS largest, 1 - count(*) / sum(n) AS duplicate_rate FROM z")
def dedup_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.dedup_report(_clusters(spark, sf_dir))


@query(f"WITH RECURSIVE {CLUSTERS_SQL} SELECT cluster, doc_id FROM clusters JOIN documents USING (doc_id) QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY length(text) DESC, doc_id) = 1")
def canonical_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _clusters(spark, sf_dir).join(_documents(spark, sf_dir).select("doc_id", "text"), "doc_id")
    return similarity.canonical(rows, "cluster", "doc_id", "text").select("cluster", "doc_id")


@query(f"WITH lines AS (SELECT DISTINCT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT md5(line) AS line_key, count(DISTINCT doc_id) AS owners FROM lines WHERE line <> '' GROUP BY line HAVING count(DISTINCT doc_id) > greatest(2, CAST(floor((SELECT count(*) FROM documents) * {SHARED_SHARE}) AS BIGINT))")
def boilerplate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    n = docs.agg(F.floor(F.count(F.lit(1)) * SHARED_SHARE).alias("n"))
    lines = docs.select("doc_id", F.explode(F.array_distinct(F.split("text", "\n"))).alias("line")).where("line <> ''")
    owners = lines.groupBy("line").agg(F.count_distinct("doc_id").alias("owners"))
    return owners.join(F.broadcast(n)).where(F.col("owners") > F.greatest(F.lit(2), "n")).select(F.md5(F.col("line").cast("binary")).alias("line_key"), "owners")


@query("""WITH b AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS bits FROM embeddings)
SELECT x.vec_id AS a, y.vec_id AS b, CAST(list_sum(list_transform(list_zip(x.bits, y.bits), lambda z: CASE WHEN z[1] = z[2] THEN 0 ELSE 1 END)) AS INTEGER) AS distance FROM b x JOIN b y ON x.vec_id < y.vec_id WHERE distance <= 6""")
def signature_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.signature_pairs(_signatures(spark, sf_dir, F.col("embedding")), most=6)


@query("SELECT sha256(text) AS digest, count(DISTINCT doc_id) AS owners, min(doc_id) AS first FROM documents GROUP BY text HAVING count(DISTINCT doc_id) > 1")
def exact_dup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.exact_groups(_documents(spark, sf_dir).select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest")), key="doc_id")


@query(f"""WITH {PAIRS_SQL}, p AS (SELECT 1 - common / united AS distance, da.lang = db.lang AND da.source = db.source AS same FROM pairs JOIN documents da ON da.doc_id = a JOIN documents db ON db.doc_id = b),
t AS (SELECT i / 100 AS threshold FROM range(2, 51) x(i)),
r AS (SELECT threshold, count(*) FILTER (WHERE distance <= threshold AND same) / greatest(count(*) FILTER (WHERE same), 1) AS recall, count(*) FILTER (WHERE distance <= threshold AND NOT same) / greatest(count(*) FILTER (WHERE NOT same), 1) AS false_share FROM p, t GROUP BY threshold)
SELECT threshold, round(recall, 9) AS recall, round(false_share, 9) AS false_share, round(2 * recall - false_share, 9) AS utility FROM r""")
def threshold_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = _documents(spark, sf_dir).select("doc_id", "lang", "source")
    p = _pairs(spark, sf_dir).join(meta.select(F.col("doc_id").alias("a"), "lang", "source"), "a").join(meta.select(F.col("doc_id").alias("b"), F.col("lang").alias("lang_b"), F.col("source").alias("source_b")), "b")
    p = p.select((1 - F.col("common") / F.col("united")).alias("distance"), ((F.col("lang") == F.col("lang_b")) & (F.col("source") == F.col("source_b"))).alias("same"))
    return similarity.calibrate(p).select("threshold", *[F.round(c, 9).alias(c) for c in ("recall", "false_share", "utility")])


# ---------------------------------------------------------------- splits
@query(f"WITH {SPLIT_SQL} SELECT cluster, label, source, split FROM split")
def split_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.split_at_scale(splits.strata(_labelled(spark, sf_dir), ordinal="doc_id"), seed=SEED)


@query(f"WITH {SPLIT_SQL} SELECT split, label, count(*) AS n FROM assigned GROUP BY ALL")
def split_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.balance(_assigned(spark, sf_dir))


@query(f"WITH {SPLIT_SQL} SELECT source, count(*) FILTER (WHERE split = 'train') AS train, count(*) FILTER (WHERE split = 'val') AS val, count(*) FILTER (WHERE split = 'test') AS test FROM assigned GROUP BY source")
def split_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.balance_table(_assigned(spark, sf_dir), "source")


@query("SELECT source AS cluster, array_to_string(list_sort(list_distinct(list(CASE WHEN doc_id // 7 % 3 < 2 THEN 'train' ELSE 'test' END))), ',') AS splits FROM documents GROUP BY source HAVING count(DISTINCT CASE WHEN doc_id // 7 % 3 < 2 THEN 'train' ELSE 'test' END) > 1")
def leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _documents(spark, sf_dir).select(F.col("source").alias("cluster"), F.when(F.expr("doc_id div 7 % 3 < 2"), "train").otherwise("test").alias("split"))
    return splits.leaks(rows).select("cluster", F.array_join("splits", ",").alias("splits"))


@query(f"""WITH {SPLIT_SQL}, u AS (SELECT {UID} AS uid, split FROM assigned)
SELECT substr(sha256('[' || string_agg('["' || uid || '", "' || split || '"]', ', ' ORDER BY uid) || ']'), 1, 16) AS assignment_hash FROM u""")
def split_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.assignment_digest(_assigned(spark, sf_dir).select(tx.uid("source", "doc_id").alias("uid"), "split"))


@query(f"""WITH {SPLIT_SQL}, a AS (SELECT doc_id, CASE WHEN doc_id % 50 = 0 THEN 'dev' ELSE split END AS split FROM assigned WHERE doc_id % 20 <> 3), r AS (SELECT doc_id, cluster, label FROM labelled WHERE doc_id % 20 <> 7),
j AS (SELECT r.doc_id AS own, a.doc_id AS other, cluster, label, split FROM r FULL JOIN a ON r.doc_id = a.doc_id)
SELECT 'missing' AS "check", count(*) AS n FROM j WHERE own IS NOT NULL AND split IS NULL UNION ALL SELECT 'extra', count(*) FROM j WHERE own IS NULL UNION ALL SELECT 'invalid_split', count(*) FROM a WHERE split NOT IN ('train', 'val', 'test')
UNION ALL SELECT 'cluster_overlap', count(*) FROM (SELECT cluster FROM j WHERE own IS NOT NULL GROUP BY cluster HAVING count(DISTINCT split) > 1) UNION ALL SELECT 'single_class_split', count(*) FROM (SELECT split FROM j WHERE own IS NOT NULL AND split IS NOT NULL GROUP BY split HAVING count(DISTINCT label) < 2)""")
def split_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _assigned(spark, sf_dir)
    given = rows.where("doc_id % 20 <> 3").select("doc_id", F.when(F.col("doc_id") % 50 == 0, "dev").otherwise(F.col("split")).alias("split"))
    return audit.split_checks(rows.where("doc_id % 20 <> 7").select("doc_id", "cluster", "label"), given, "doc_id")


@query("WITH d AS (SELECT doc_id FROM documents), l AS (SELECT doc_id + 5 AS doc_id FROM labels) SELECT 'left' AS side, doc_id FROM d WHERE doc_id NOT IN (SELECT doc_id FROM l) UNION ALL SELECT 'right', doc_id FROM l WHERE doc_id NOT IN (SELECT doc_id FROM d)")
def coverage_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.coverage(_documents(spark, sf_dir), read(spark, sf_dir, "labels").select((F.col("doc_id") + 5).alias("doc_id")), "doc_id")


# ---------------------------------------------------------------- audits
def inputs_sql(raw: str, better: str, twice: str) -> str:
    """The tiers of the documents, with these bodies."""
    return f"""rows AS (SELECT {UID} AS uid, 'raw' AS tier, 'a' AS path, doc_id AS line, coalesce({LABEL_SQL}, 'unknown') AS label, '' AS verdict, 'https://e.org/' || doc_id || '/#x' AS url, {raw} AS body FROM documents LEFT JOIN labels USING (doc_id)
UNION ALL SELECT {UID}, 'enriched', 'b', doc_id, CASE WHEN doc_id % 5 = 0 THEN 'unknown' ELSE coalesce({LABEL_SQL}, 'unknown') END, CASE WHEN doc_id % 7 = 0 THEN 'Fake' ELSE '' END, 'https://e.org/' || CASE WHEN doc_id % 11 = 0 THEN -1 ELSE doc_id END, {better} FROM documents LEFT JOIN labels USING (doc_id) WHERE doc_id % 2 = 0
UNION ALL SELECT {UID}, 'enriched', 'c', doc_id, coalesce({LABEL_SQL}, 'unknown'), '', 'https://e.org/' || doc_id, {twice} FROM documents LEFT JOIN labels USING (doc_id) WHERE doc_id % 26 = 0)"""


#: The better tier appends a mark to the text, and of its second variants every other differs in the last character.
INPUTS_SQL = inputs_sql("text", "text || '#'", "text || CASE WHEN doc_id % 52 = 0 THEN '+' ELSE '#' END")


def _inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "source", "text").join(_labels(spark, sf_dir).select("doc_id", F.col("label").alias("own")), "doc_id", "left").withColumn("own", F.coalesce("own", F.lit("unknown")))
    uid, site = tx.uid("source", "doc_id").alias("uid"), F.lit("https://e.org/")

    def tier(rows: DataFrame, name: str, path: str, label: Column, verdict: Column, url: Column, end: Column) -> DataFrame:
        return rows.select(uid, F.lit(name).alias("tier"), F.lit(path).alias("path"), F.col("doc_id").alias("line"), label.alias("label"), verdict.alias("verdict"), url.alias("url"), F.concat("text", end).alias("body"))

    own, none, id_ = F.col("own"), F.lit(""), F.col("doc_id")
    raw = tier(docs, "raw", "a", own, none, F.concat(site, id_, F.lit("/#x")), none)
    better = tier(docs.where("doc_id % 2 = 0"), "enriched", "b", F.when(id_ % 5 == 0, "unknown").otherwise(own), F.when(id_ % 7 == 0, "Fake").otherwise(""), F.concat(site, F.when(id_ % 11 == 0, -1).otherwise(id_)), F.lit("#"))
    twice = tier(docs.where("doc_id % 26 = 0"), "enriched", "c", own, none, F.concat(site, id_), F.when(id_ % 52 == 0, "+").otherwise("#"))
    return raw.unionByName(better).unionByName(twice)


SELECTION_SQL = """m AS (SELECT *, regexp_replace(regexp_replace(url, '#.*$', ''), '/+$', '') AS plain, CASE WHEN verdict = 'Fake' THEN 'fake' END AS vl, CASE WHEN label <> 'unknown' THEN label END AS kl,
  max(tier = 'enriched') OVER (PARTITION BY uid) AS top FROM rows),
g AS (SELECT uid, count(DISTINCT plain) AS urls, count(DISTINCT CASE WHEN NOT top OR tier = 'enriched' THEN body END) AS bodies, count(DISTINCT kl) AS nk, count(*) AS variants,
  len(list_distinct(list_concat(coalesce(list(kl) FILTER (WHERE kl IS NOT NULL), []), coalesce(list(vl) FILTER (WHERE vl IS NOT NULL), [])))) AS ks, arg_min(label, (path, line)) FILTER (WHERE NOT top OR tier = 'enriched') AS wl, min((path, line)) FILTER (WHERE NOT top OR tier = 'enriched') AS win FROM m GROUP BY uid),
j AS (SELECT *, list_filter([CASE WHEN bodies > 1 THEN 'ambiguous_records_at_winning_tier' END, CASE WHEN ks > 1 THEN 'conflicting_labels_or_verdicts' END, CASE WHEN urls > 1 THEN 'conflicting_provenance_urls' END, CASE WHEN nk > 0 AND wl = 'unknown' THEN 'enrichment_would_discard_known_label' END], lambda x: x IS NOT NULL) AS reasons FROM g)"""
SELECT_SQL = f"{INPUTS_SQL}, {SELECTION_SQL}"


@query(f"WITH {SELECT_SQL} SELECT rows.uid, tier, label FROM rows JOIN j ON rows.uid = j.uid AND (path, line) = win WHERE len(reasons) = 0")
def selected_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.select_inputs(_inputs(spark, sf_dir), ["body"])[0].select("uid", "tier", "label")


@query(f"WITH {SELECT_SQL} SELECT uid, array_to_string(reasons, ',') AS reasons, variants FROM j WHERE len(reasons) > 0")
def input_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.select_inputs(_inputs(spark, sf_dir), ["body"])[1].select("uid", F.array_join("reasons", ",").alias("reasons"), "variants")


@query()
def audit_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _labelled(spark, sf_dir).join(_documents(spark, sf_dir).select("doc_id", "text"), "doc_id")
    image = F.struct(F.lit("").alias("url"), F.concat(F.lit("img/"), F.col("doc_id") % 400).alias("local_path"), F.when(F.col("doc_id") % 9 == 0, "annotated").otherwise("creative").alias("role"), F.lit("").alias("sha256"), F.col("text").alias("ocr_text"))
    records = rows.select(tx.uid("source", "doc_id").alias("uid"), "label", F.substring_index("text", "\n", 1).alias("title"), F.lit("").alias("claim_text"), F.array(image).alias("images"))
    files = spark.range(300).select(F.concat(F.lit("img/"), "id").alias("local_path"), F.sha2((F.col("id") % 290).cast("string"), 256).alias("digest"), (F.col("id") % 50).alias("bytes"))
    return audit.issue_counts(audit.audit_records(records, files))


# ---------------------------------------------------------------- metrics
@query(f"WITH {TRUTH_SQL} SELECT source, {COUNTS_SQL} FROM truth GROUP BY source")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion(_truth(spark, sf_dir), by=["source"])


@query(f"""WITH {TRUTH_SQL}, c AS (SELECT source, {COUNTS_SQL} FROM truth GROUP BY source)
SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS "precision", CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall, CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0::DOUBLE * tp / (2 * tp + fp + fn) ELSE 0.0 END AS f1,
(CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0::DOUBLE * tp / (2 * tp + fp + fn) ELSE 0.0 END + CASE WHEN 2 * tn + fp + fn > 0 THEN 2.0::DOUBLE * tn / (2 * tn + fp + fn) ELSE 0.0 END) / 2 AS macro_f1, (tp + tn) / (tp + fp + fn + tn) AS accuracy, greatest(tp + fn, fp + tn) / (tp + fp + fn + tn) AS majority_baseline FROM c""")
def metric_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.summary(metrics.confusion(_truth(spark, sf_dir), by=["source"]))


@query(f'WITH {CURVE_SQL} SELECT threshold, tp, fp, tp / (tp + fp) AS "precision", tp / p AS recall FROM curve')
def pr_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.pr_curve(_truth(spark, sf_dir))


@query(f"WITH {CURVE_SQL} SELECT round(sum((tp - coalesce(lag_tp, 0)) / p * tp / (tp + fp)), 9) AS pr_auc FROM (SELECT *, lag(tp) OVER (ORDER BY threshold DESC) AS lag_tp FROM curve)")
def pr_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.pr_auc(_truth(spark, sf_dir)).select(F.round("pr_auc", 9).alias("pr_auc"))


@query(f"""WITH {TRUTH_SQL}, r AS (SELECT y_true, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS rk FROM truth)
SELECT (sum(rk) FILTER (WHERE y_true = 1) - sum(y_true) * (sum(y_true) + 1) / 2) / (sum(y_true) * (count(*) - sum(y_true))) AS roc_auc FROM r""")
def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.roc_auc(_truth(spark, sf_dir))


@query(f"WITH {CURVE_SQL}, v AS (SELECT threshold, 2.0::DOUBLE * tp / (2 * tp + fp + (p - tp)) AS value FROM curve) SELECT threshold, value FROM v ORDER BY value DESC, threshold LIMIT 1")
def best_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.best_threshold(_truth(spark, sf_dir))


RUNS_SQL = "runs AS (SELECT lang AS arm, source AS seed, avg(n_chars % 101) / 100 AS value FROM documents GROUP BY ALL)"


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).groupBy(F.col("lang").alias("arm"), F.col("source").alias("seed")).agg((F.avg(F.col("n_chars") % 101) / 100).alias("value"))


@query(f"WITH {RUNS_SQL} SELECT arm, round(avg(value), 9) AS mean, round(coalesce(stddev_samp(value), 0), 9) AS std, count(*) AS runs FROM runs GROUP BY arm")
def seed_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.seed_aggregate(_runs(spark, sf_dir)).select("arm", F.round("mean", 9).alias("mean"), F.round("std", 9).alias("std"), "runs")


@query(f"WITH {RUNS_SQL}, t AS (SELECT arm, avg(value) AS mean FROM runs GROUP BY arm) SELECT arm, CASE WHEN arm <> 'en' THEN round(mean - (SELECT mean FROM t WHERE arm = 'en'), 9) END AS delta FROM t")
def ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.ablation(_runs(spark, sf_dir), "en").select("arm", F.round("delta", 9).alias("delta"))


@query("SELECT event_type, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, min(value) AS least, max(value) AS most FROM events GROUP BY event_type")
def latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.latency_summary(read(spark, sf_dir, "events"), by=["event_type"]).select("event_type", "p50", "p95", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "least", "most")


BUDGET = [("p50", "max", 60.0), ("p95", "max", 50.0), ("mean", "min", 10.0), ("params", "max", 50.0)]


@query("WITH b(name, direction, bound) AS (VALUES " + ", ".join(f"('{n}', '{d}', {v}::DOUBLE)" for n, d, v in BUDGET) + """), m AS (SELECT 'p50' AS name, quantile_cont(value, 0.5) AS value FROM events UNION ALL SELECT 'p95', quantile_cont(value, 0.95) FROM events UNION ALL SELECT 'mean', round(avg(value), 6) FROM events)
SELECT name, direction, bound, value, CASE WHEN direction = 'max' THEN bound - value ELSE value - bound END AS headroom, CASE WHEN value IS NULL THEN 'not measured' WHEN (direction = 'max' AND value <= bound) OR (direction = 'min' AND value >= bound) THEN 'ok' ELSE 'over' END AS status FROM b LEFT JOIN m USING (name)""")
def budget_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = metrics.latency_summary(read(spark, sf_dir, "events"))
    measured = whole.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.round(n, 6).alias("value") if n == "mean" else F.col(n).alias("value")) for n in ("p50", "p95", "mean")])).alias("x")).select("x.*")
    return metrics.budget_checks(measured, spark.createDataFrame(BUDGET, "name string, direction string, bound double"))


@query("""WITH f AS (SELECT doc_id, unnest([{'label': 'long', 't': n_chars > 1500, 'p': length(text) > 1400}, {'label': 'german', 't': lang = 'de', 'p': contains(text, 'der')}, {'label': 'junk', 't': contains(text, '|'), 'p': contains(text, '$')}]) AS x FROM documents),
c AS (SELECT x.label AS label, count(*) FILTER (WHERE x.t AND x.p) AS tp, count(*) FILTER (WHERE NOT x.t AND x.p) AS fp, count(*) FILTER (WHERE x.t AND NOT x.p) AS fn, count(*) FILTER (WHERE NOT x.t AND NOT x.p) AS tn FROM f GROUP BY 1)
SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS "precision", CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall, CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0::DOUBLE * tp / (2 * tp + fp + fn) ELSE 0.0 END AS f1, tp + fn AS support FROM c""")
def multilabel_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda **k: F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in k.items()]))
    text = F.col("text")
    docs = _documents(spark, sf_dir).select(pick(long=F.col("n_chars") > 1500, german=F.col("lang") == "de", junk=text.contains("|")).alias("labels"), pick(long=F.length(text) > 1400, german=text.contains("der"), junk=text.contains("$")).alias("predicted"))
    return metrics.multilabel(docs, labels=["long", "german", "junk"])


@query("SELECT source, list_sort(list(n_chars))[len(list(n_chars)) // 2 + 1] AS upper_median, count(*) AS n FROM documents GROUP BY source")
def upper_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).groupBy("source").agg(metrics.upper_median("n_chars").alias("upper_median"), F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- order, time and segments
@query("SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1")
def first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value", "ts")
    return media.first_seen(rows, ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@query("""WITH RECURSIVE e AS (SELECT DISTINCT user_id, epoch(ts) AS t FROM events), k AS (SELECT user_id, min(t) AS t FROM e GROUP BY user_id UNION ALL SELECT k.user_id, (SELECT min(e.t) FROM e WHERE e.user_id = k.user_id AND e.t + 0.000001 >= k.t + 86400) FROM k WHERE EXISTS (SELECT 1 FROM e WHERE e.user_id = k.user_id AND e.t + 0.000001 >= k.t + 86400))
SELECT user_id, count(*) AS kept, round(sum(t), 3) AS times FROM k GROUP BY user_id""")
def spaced_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t")).groupBy("user_id").agg(F.collect_list("t").alias("t"))
    kept = rows.select("user_id", media.spaced("t", 86400.0).alias("k"))
    return kept.select("user_id", F.size("k").cast("long").alias("kept"), F.round(F.aggregate("k", F.lit(0.0), lambda a, x: a + x), 3).alias("times"))


SEGMENTS_SQL = "s AS (SELECT conv_id, turn, coalesce(sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS l, l + length(text) AS r FROM conversations)"


@query(f"WITH {SEGMENTS_SQL}, f AS (SELECT conv_id, 100 * k AS a, 100 * k + 250 AS b FROM (SELECT conv_id, unnest(range(0, greatest(CAST(max(r) + 99 AS BIGINT) // 100, 1))) AS k FROM s GROUP BY conv_id)) SELECT f.conv_id, CAST(a AS BIGINT) AS from_char, CAST(b AS BIGINT) AS to_char, CAST(min(turn) AS DOUBLE) AS time_start, CAST(max(turn) + 1 AS DOUBLE) AS time_end FROM f JOIN s ON f.conv_id = s.conv_id AND l < b AND r > a GROUP BY ALL")
def segment_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings stand over the whole length of each conversation."""
    _, segments = _segments(spark, sf_dir)
    last = F.greatest(F.ceil(F.max("right") / 100) - 1, F.lit(0))
    findings = segments.groupBy("conv_id").agg(last.alias("last")).select("conv_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last") * 100, F.lit(100).cast("long"))).alias("from_char"))
    return media.overlapping(findings.withColumn("to_char", F.col("from_char") + 250), segments, "conv_id")


@query("WITH n AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS nth FROM documents WHERE lang IN ('en', 'de', 'fr', 'es')) SELECT lang, doc_id, CAST(nth AS INTEGER) AS nth, CASE lang WHEN 'en' THEN 1 WHEN 'de' THEN 2 WHEN 'fr' THEN 3 ELSE 4 END::BIGINT AS place FROM n")
def interleaved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.interleave(_documents(spark, sf_dir).select("lang", "doc_id"), "lang", "doc_id", ["en", "de", "fr", "es"])


@query("SELECT source, doc_id, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) <= 3")
def longest_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))
    return _documents(spark, sf_dir).select("source", "doc_id", "n_chars", rank.alias("r")).where("r <= 3").drop("r")


@query(f"SELECT doc_id FROM documents ORDER BY md5('{SEED}:' || doc_id), doc_id LIMIT 100")
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id").orderBy(splits.shuffle_key(SEED, F.col("doc_id").cast("string")), "doc_id").limit(100)


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND source IN ('src1', 'src2', 'src3')")
def resume_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    allowed = spark.createDataFrame([("src1",), ("src2",), ("src3",)], "source string")
    rest = _documents(spark, sf_dir).join(read(spark, sf_dir, "labels"), "doc_id", "left_anti")
    return rest.join(F.broadcast(allowed), "source", "left_semi").select("doc_id", "source")


# ---------------------------------------------------------------- TPC-H-like: balance and yield at scale
@query("SELECT n_name, c_mktsegment, count(*) AS orders, count(*) FILTER (WHERE o_orderstatus = 'F') AS closed, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL")
def market_yield(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", "o_totalprice")
    customer = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nation = read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name", "c_mktsegment").agg(F.count(F.lit(1)).alias("orders"), F.count_if(F.col("o_orderstatus") == "F").alias("closed"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS quantity FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def item_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.expr("timestamp_ntz '1998-09-02 00:00:00'"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").cast("long").alias("quantity"))


# ---------------------------------------------------------------- without SQL: tested on fixtures
@query()
def clean_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", extract.clean_html("html").alias("text"))


@query()
def page_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", extract.page_article("html", "url").alias("a")).select("page_id", "a.title", "a.author", "a.claim", "a.body", "a.body_scope", F.size("a.images").alias("n_images"))


@query()
def text_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.chunks(_documents(spark, sf_dir).select("doc_id", "text"), max_chars=1800)


@query()
def framing_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = framing.audit_long(_documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", F.explode_outer("findings").alias("f")).select("doc_id", "f.*")


@query()
def canonical_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", tx.canonical("text").alias("text"))


@query()
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _labelled(spark, sf_dir).select("doc_id", "source", "label", F.array("source", "label").alias("reasons"))
    return sinks.review_queue(rows)


@query()
def vector_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logistic regression on the given vectors: class 0 against the rest, by a fixed split."""
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "embedding", (F.col("label") == 0).cast("double").alias("label"))
    train, rest = rows.where("vec_id % 10 < 7"), rows.where("vec_id % 10 >= 7")
    fitted, others = ml.vector_features(train, [train, rest])
    model = ml.estimator("logistic", 1.0, fitted.count()).fit(ml.weighted(fitted))
    return ml.scored(model, others).select("vec_id", "label", F.round("score", 6).alias("score"))
