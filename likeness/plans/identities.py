"""Queries on the registry: filters, updates, set operations, names and checksums."""

from __future__ import annotations

from pyspark.sql import functions as F

from likeness.functions import text as T
from likeness.operators import gallery as G, order as O
from likeness.plans.catalogue import query
from likeness.runtime import table

c = F.col


def _people(spark, sf):
    return table(spark, sf, "customer").select(c("c_custkey").alias("id"), c("c_name").alias("name"), (c("c_acctbal") >= 0).alias("active"), "c_nationkey")


@query("SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal >= 0 GROUP BY n_name")
def identity_list_active(spark, sf):
    return G.active(_people(spark, sf)).join(table(spark, sf, "nation"), c("c_nationkey") == c("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("n"))


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def identity_semi(spark, sf):
    return G.enrolled(table(spark, sf, "customer").select("c_custkey"), table(spark, sf, "orders").select(c("o_custkey").alias("c_custkey")), "c_custkey")


@query("SELECT c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT c_custkey + 1000000, CASE WHEN c_custkey % 3 = 0 THEN c_name || ' (new)' ELSE c_name END FROM customer WHERE c_name <> CASE WHEN c_custkey % 3 = 0 THEN c_name || ' (new)' ELSE c_name END")
def identity_upsert_all(spark, sf):
    """Every customer is in the registry, and every one comes in again, every third under a new name."""
    p = _people(spark, sf).select("id", "name")
    return G.upsert(p, p.select((c("id") + 1000000).alias("id"), F.when(c("id") % 3 == 0, F.concat("name", F.lit(" (new)"))).otherwise(c("name")).alias("name")))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def identity_anti_all(spark, sf):
    return G.not_enrolled(table(spark, sf, "orders").select("o_orderkey"), table(spark, sf, "lineitem").select(c("l_orderkey").alias("o_orderkey")), "o_orderkey")


@query("SELECT c_custkey AS id, c_name AS name, c_acctbal >= 0 AND c_custkey % 7 <> 0 AS active FROM customer")
def identity_soft_delete(spark, sf):
    p = _people(spark, sf)
    return G.soft_delete(p, p.where(c("id") % 7 == 0)).select("id", "name", "active")


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN c_name || '*' ELSE c_name END AS name FROM customer")
def identity_rename(spark, sf):
    p = _people(spark, sf).select("id", "name", F.lit(None).cast("string").alias("external_id"), "active", F.lit(None).cast("timestamp").alias("updated_at"))
    changes = p.where(c("id") % 5 == 0).select("id", F.concat("name", F.lit("*")).alias("name"), F.lit(None).cast("string").alias("external_id"), F.lit(None).cast("boolean").alias("active"))
    blank = p.where(c("id") % 5 == 1).select("id", F.lit(" ").alias("name"), F.lit(None).cast("string").alias("external_id"), F.lit(None).cast("boolean").alias("active"))
    return G.updated(p, changes.unionByName(blank)).select("id", "name")


@query("SELECT c_custkey AS id FROM customer WHERE c_name = 'Customer#000000007'")
def identity_lookup(spark, sf):
    return _people(spark, sf).where(c("name") == "Customer#000000007").select("id").limit(1)


@query("SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey IN (SELECT c_nationkey FROM customer GROUP BY c_nationkey HAVING count(*) >= 6)")
def group_min_samples(spark, sf):
    return O.limited_groups(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), "c_custkey", "c_nationkey", 6)


@query("SELECT c_custkey, c_nationkey FROM (SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS rn, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer) WHERE n >= 2 AND rn <= 5")
def group_max_samples(spark, sf):
    return O.limited_groups(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), "c_custkey", "c_nationkey", 2, 5)


@query("SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey ORDER BY n DESC, c_nationkey LIMIT 10")
def identity_top_sizes(spark, sf):
    return table(spark, sf, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "c_nationkey").limit(10)


@query("SELECT c_custkey AS key, c_name AS name FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 <> 0 UNION ALL SELECT c_custkey, c_name || ' (CV)' FROM customer WHERE c_custkey % 2 <> 0 AND c_custkey % 3 = 0")
def result_concat(spark, sf):
    p = table(spark, sf, "customer").select(c("c_custkey").alias("key"), c("c_name").alias("name"))
    second = p.where((c("key") % 3 == 0) & (c("key") % 2 != 0)).select("key", F.concat("name", F.lit(" (CV)")).alias("name"), F.lit(2).alias("seq"))
    return G.last_wins(p.withColumn("seq", F.lit(1)).unionByName(second), "key", "seq").select("key", "name")


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 5 = 0 THEN 'TRAINING' WHEN n_nationkey % 5 = 1 THEN 'ERROR' WHEN n_nationkey % 5 = 2 THEN 'READY' WHEN n_nationkey > 10 THEN 'NEEDS_TRAINING' ELSE 'NOT_INITIALIZED' END AS state FROM nation")
def model_state(spark, sf):
    k = c("n_nationkey")
    return table(spark, sf, "nation").select("n_nationkey", G.model_state(k % 5 == 0, k % 5 == 1, k % 5 == 2, F.when(k > 10, 1).otherwise(0)).alias("state"))


@query("SELECT p_partkey, p_name, p_type AS algorithm, CAST(floor(p_retailprice * 1000) AS BIGINT) AS bytes, CASE WHEN floor(p_retailprice * 1000) < 1024 THEN printf('%d B', CAST(floor(p_retailprice * 1000) AS BIGINT)) WHEN floor(p_retailprice * 1000) < 1048576 THEN printf('%.1f KB', round(floor(p_retailprice * 1000) / 1024, 1)) ELSE printf('%.1f MB', round(floor(p_retailprice * 1000) / 1048576, 1)) END AS size_text FROM part WHERE p_type = (SELECT min(p_type) FROM part)")
def model_catalog(spark, sf):
    p = table(spark, sf, "part")
    n = F.floor(c("p_retailprice") * 1000).cast("long")
    least = p.agg(F.min("p_type").alias("algorithm"))
    return p.select("p_partkey", "p_name", c("p_type").alias("algorithm"), n.alias("bytes"), T.file_size(n).alias("size_text")).join(F.broadcast(least), "algorithm")


@query("SELECT p_partkey, round(CASE WHEN p_size % 7 = 0 THEN 1.0 ELSE p_retailprice / (p_size % 7) END, 6) AS ratio FROM part")
def compression_ratio(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.round(T.compression_ratio(c("p_size") % 7, c("p_retailprice")), 6).alias("ratio"))


@query("""SELECT doc_id, CASE WHEN contains(source || ',' || lang || chr(34), ',') THEN chr(34) || replace(source || ',' || lang || chr(34), chr(34), chr(34) || chr(34)) || chr(34) ELSE source END AS quoted FROM documents""")
def csv_quote(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.csv_quoted(F.concat("source", F.lit(","), "lang", F.lit('"'))).alias("quoted"))


@query("SELECT doc_id, regexp_extract(lang || '_' || source || '_' || doc_id || '.png', '^(.+)_[^_]*$', 1) AS flat, regexp_extract(lang || '_' || source || '_' || doc_id || '.png', '^(.+?)(?:_\\d+)?\\.[^.]+$', 1) AS by_pattern FROM documents")
def filename_label(spark, sf):
    name = F.concat_ws("_", "lang", "source", F.concat(c("doc_id").cast("string"), F.lit(".png")))
    return table(spark, sf, "documents").select("doc_id", T.flat_label(name).alias("flat"), T.regex_label(name).alias("by_pattern"))


@query("SELECT doc_id, CASE WHEN lang = 'en' THEN 'subject' || doc_id END AS label, lower(source) AS condition FROM documents")
def yale_names(spark, sf):
    name = F.concat(F.when(c("lang") == "en", F.when(c("doc_id") % 2 == 0, "subject").otherwise("Subject")).otherwise("x"), c("doc_id").cast("string"), F.lit("."), "source", F.lit(".pgm"))
    return table(spark, sf, "documents").select("doc_id", T.yale_label(name).alias("label"), T.yale_condition(name).alias("condition"))


@query("SELECT page_id, sha256(html) AS sha256, regexp_matches(lower(url), '\\.(jpg|jpeg|png|pgm|bmp|gif)$') AS is_image FROM pages")
def checksum_sha256(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.sha2("html", 256).alias("sha256"), T.is_image(c("url")).alias("is_image"))


@query(r"SELECT doc_id, CASE WHEN length(text) > 20 THEN left(text, 18) || '..' ELSE text END AS short, CAST(len(regexp_split_to_array(trim(text, ' '), '[ \t\n\x0B\f\r]+')) AS INTEGER) AS words FROM documents")
def text_truncate(spark, sf):
    """The text cut for display, and the words of the whole text."""
    return table(spark, sf, "documents").select("doc_id", T.truncated(c("text"), 20).alias("short"), F.size(T.words(c("text"))).alias("words"))


@query(r"SELECT doc_id, CAST(len(regexp_split_to_array(trim(text, ' '), '[ \t\n\x0B\f\r]+')) AS INTEGER) AS words FROM documents")
def text_words(spark, sf):
    """Words of the whole text."""
    return table(spark, sf, "documents").select("doc_id", F.size(T.words(c("text"))).alias("words"))


@query("SELECT DISTINCT p_type AS message, CASE WHEN contains(lower(p_type), 'no face') OR contains(lower(p_type), 'face not') THEN 'FACE_NOT_DETECTED' WHEN contains(lower(p_type), 'multiple face') THEN 'MULTIPLE_FACES' WHEN contains(lower(p_type), 'quality') THEN 'POOR_QUALITY' WHEN contains(lower(p_type), 'too small') OR contains(lower(p_type), 'dimension') THEN 'IMAGE_TOO_SMALL' WHEN contains(lower(p_type), 'too large') THEN 'IMAGE_TOO_LARGE' WHEN contains(lower(p_type), 'image') OR contains(lower(p_type), 'format') THEN 'INVALID_IMAGE_FORMAT' ELSE 'VALIDATION_ERROR' END AS code FROM part")
def error_codes(spark, sf):
    return table(spark, sf, "part").select(c("p_type").alias("message")).distinct().select("message", T.error_code(c("message")).alias("code"))


@query("SELECT n_nationkey, '{\"name\":\"' || n_name || '\",\"region\":' || n_regionkey || '}' AS json FROM nation")
def json_out(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", F.to_json(F.struct(c("n_name").alias("name"), c("n_regionkey").alias("region"))).alias("json"))
