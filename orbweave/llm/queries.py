"""The registered queries of this subpackage, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, filter_audit, html_extract, jaccard_join, language_id, packing, quality_classifier, quality_rules, ranked_search, sharding, substring_dedup, token_counts, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _remainder(n: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads, payloads = warc.archive(warc.records(table(spark, sf_dir, "pages")))
    got = warc.parsed(warc.restore(heads, payloads))
    return got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_texts(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = token_counts.count_tokens(table(spark, sf_dir, "documents"))
    return got.withColumn("over_limit", F.col("n_tokens") > 2048)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = decontaminate.find_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), span=decontaminate.SPAN)
    return got.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), F.size("near_items").cast("long").alias("n_near_items"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digests(substring_dedup.repeats(table(spark, sf_dir, "documents")))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality_rules.judge(docs, quality_rules.train(docs, labels))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    ranker = quality_classifier.train(docs, labels.withColumn("m", _remainder(5)), where="m <> 0")
    got = quality_classifier.select(docs, ranker, 0.25)
    return got.select("doc_id", (_remainder(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "selected")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = language_id.train(docs.where(_remainder(4) != 2))
    got = language_id.identify(docs, net)
    return got.select("doc_id", (_remainder(4) == 2).alias("held_out"), "lang_pred", "score")


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents")).drop("row")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_packing": op2_packing,
    "op3_token_counts": op3_token_counts,
    "op4_decontaminate": op4_decontaminate,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_quality_rules": op7_quality_rules,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_language_id": op9_language_id,
    "op10_html_extract": op10_html_extract,
    "op11_sharding": op11_sharding,
    "op12_filter_audit": op12_filter_audit,
    "op13_ranked_search": op13_ranked_search,
}

ORACLES: dict[str, str] = {
    "op1_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha256(html) AS payload_digest FROM p),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
        FROM f""",
    "op4_decontaminate": r"""
        WITH i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        iw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, w[k : k + least(len(w), 10) - 1] AS win FROM i, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS t(k) WHERE len(w) > 0),
        sizes AS (SELECT DISTINCT n FROM iw),
        dw AS (SELECT doc_id, n, k, w[k : k + n - 1] AS win FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS t(k)),
        hits AS (SELECT doc_id, dw.n, k, item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.win = iw.win),
        words AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM hits, unnest(range(k, k + n)) AS t(x) GROUP BY doc_id),
        items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hits GROUP BY doc_id),
        post AS (SELECT doc_id, x AS place, w[x] AS term FROM d, unnest(range(1, len(w) + 1)) AS t(x) WHERE w[x] IN (SELECT unnest(win) FROM iw)),
        wins AS (SELECT win, row_number() OVER () AS id FROM (SELECT DISTINCT win FROM iw)),
        terms AS (SELECT id, o, win[o] AS term FROM wins, unnest(range(1, len(win) + 1)) AS t(o)),
        need AS (SELECT id, count(DISTINCT term) AS n FROM terms GROUP BY id),
        freq AS (SELECT term, count(*) AS f FROM post GROUP BY term),
        rare AS (SELECT id, arg_min(term, f * 100 + o) AS term FROM terms JOIN freq USING (term) GROUP BY id),
        cand AS (SELECT id, doc_id, place FROM rare JOIN post USING (term)),
        met AS (SELECT c.id, c.doc_id, c.place, count(DISTINCT t.term) AS n FROM cand c JOIN terms t ON t.id = c.id JOIN post p ON p.doc_id = c.doc_id AND p.term = t.term AND abs(p.place - c.place) < 20 GROUP BY c.id, c.doc_id, c.place),
        close AS (SELECT m.doc_id, count(DISTINCT iw.item_id) AS n_near FROM (SELECT DISTINCT id, doc_id FROM met JOIN need USING (id, n)) m JOIN wins USING (id) JOIN iw USING (win) GROUP BY m.doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near_items
        FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN close USING (doc_id)""",
    "op5_jaccard_join": r"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, g FROM d, unnest(range(1, greatest(1, len(w) - 3) + 1)) AS t(k), LATERAL (SELECT array_to_string(w[k : k + 3], ' ') AS g) WHERE len(w) > 0),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
        l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
        r AS (SELECT doc_id AS x, doc_id AS y FROM n UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y),
        m AS (SELECT x AS doc_id, min(y) AS least FROM r GROUP BY x)
        SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(least, d.doc_id) AS component_id
        FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)""",
    "op6_substring_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        win AS (SELECT doc_id, k, hash(array_to_string(w[k : k + 34], ' ')) AS h, md5(array_to_string(w[k : k + 34], ' ')) AS m FROM d, unnest(range(1, len(w) - 33)) AS t(k)),
        rep AS (SELECT doc_id, k FROM (SELECT doc_id, k, count(*) OVER (PARTITION BY h, m) AS c FROM win) WHERE c > 1),
        gone AS (SELECT DISTINCT doc_id, x FROM rep, unnest(range(k, k + 35)) AS t(x)),
        g AS (SELECT doc_id, count(*) AS n, list(x) AS xs FROM gone GROUP BY doc_id),
        words AS (SELECT doc_id, x, w[x] AS word FROM d, unnest(range(1, len(w) + 1)) AS t(x)),
        kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY x) AS s FROM words ANTI JOIN gone USING (doc_id, x) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
        FROM d LEFT JOIN g USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op11_sharding": sharding.oracle(),
    "op12_filter_audit": filter_audit.ORACLE,
    "op13_ranked_search": ranked_search.ORACLE,
}
