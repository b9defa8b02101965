"""The pN_ queries of the llm subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfscan.session import load, written


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    from shelfscan.llm.mojibake import garbled

    return garbled(load(spark, d, "docs")).select("id")


def p1_restored(spark: SparkSession, d: str) -> DataFrame:
    from shelfscan.llm.mojibake import garbled

    return garbled(load(spark, d, "docs"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    from shelfscan.llm.components import group_ids

    return group_ids(load(spark, d, "near_pairs"), load(spark, d, "files").select("id"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    from shelfscan.llm.survivor import survivors

    return survivors(load(spark, d, "files"), load(spark, d, "roots"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    from shelfscan.llm.near import similar_pairs

    return similar_pairs(load(spark, d, "docs"), width=3, share=0.6)


def p4_classes(spark: SparkSession, d: str) -> DataFrame:
    """id, class_id, copies, links: the form without pairs, at five words and 0.8."""
    from shelfscan.llm.near import classes

    return classes(load(spark, d, "docs"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    from shelfscan.llm.neighbours import neighbour_pairs

    files = load(spark, d, "files")
    dhash = files.where(F.bit_count("dhash").between(9, 55)).select("id", F.col("dhash").alias("v"))
    simhash = files.where((F.col("chars") >= 600) & F.col("simhash").isNotNull()).select("id", F.col("simhash").alias("v"))
    images = neighbour_pairs(dhash, 5, 8).select(F.lit("dhash").alias("field"), "id_a", "id_b")
    return images.union(neighbour_pairs(simhash, 5, 3).select(F.lit("simhash").alias("field"), "id_a", "id_b"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    from shelfscan.llm.scans import scanned

    return scanned(load(spark, d, "docs")).select("id")


def p7_repaired(spark: SparkSession, d: str) -> DataFrame:
    from shelfscan.llm.scans import scanned

    return scanned(load(spark, d, "docs"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    from shelfscan.llm.encoding import token_ids

    return token_ids(load(spark, d, "documents"))


def p8_decoded(spark: SparkSession, d: str) -> DataFrame:
    """doc_id and the text that its ids stand for."""
    from shelfscan.llm.encoding import decoded, pieces, token_ids

    return decoded(token_ids(load(spark, d, "documents")), pieces(spark))


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    from shelfscan.llm.encoding import token_ids
    from shelfscan.llm.packing import containers

    sizes = written(token_ids(load(spark, d, "documents")).select("doc_id", F.size("ids").alias("n_tokens")))
    return containers(sizes)


def p9_fill(spark: SparkSession, d: str) -> DataFrame:
    """What the containers must hold to: every text with tokens is in them, each part once and in order, none above the capacity, no text divided without need,
    and nearly all room used."""
    from shelfscan.llm.packing import CAPACITY

    rows = written(p9_containers(spark, d))
    room = rows.groupBy("container_id").agg(F.sum("n_tokens").alias("n"))
    parts = rows.groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("parts"), F.countDistinct("part").alias("kinds"), F.max("part").alias("last"), F.max(F.col("first_token") + F.col("n_tokens")).alias("end"))
    whole = (F.col("parts") == F.ceil(F.col("n") / CAPACITY)) & (F.col("kinds") == F.col("parts")) & (F.col("last") == F.col("parts") - 1) & (F.col("end") == F.col("n"))
    a = parts.agg(F.count("*").alias("documents"), F.coalesce(F.min(whole), F.lit(True)).alias("whole"), F.lit(1).alias("k"))
    # one container a group of pieces may be left nearly empty
    full = F.sum("n") >= 0.97 * CAPACITY * (F.count("*") - 2)
    b = room.agg(F.coalesce(F.max("n") <= CAPACITY, F.lit(True)).alias("fits"), F.coalesce(full, F.lit(True)).alias("filled"), F.lit(1).alias("k"))
    return a.join(b, "k").drop("k")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    from shelfscan.llm.topics import subjects_of

    return subjects_of(load(spark, d, "documents"), load(spark, d, "doc_labels"), load(spark, d, "subjects"))


QUERIES = {
    "p1_found": p1_found, "p1_restored": p1_restored, "p2_found": p2_found, "p3_found": p3_found, "p4_found": p4_found, "p4_classes": p4_classes, "p6_found": p6_found, "p7_found": p7_found, "p7_repaired": p7_repaired, "p8_ids": p8_ids,
    "p8_decoded": p8_decoded, "p9_containers": p9_containers, "p9_fill": p9_fill, "p10_found": p10_found,
}

def _closest(field: str, where: str, bits: int) -> str:
    return f"""
        SELECT DISTINCT '{field}' AS field, least(id, o) AS id_a, greatest(id, o) AS id_b FROM (
          SELECT a.id, b.id AS o, bit_count(xor(a.{field}, b.{field})) AS bits, row_number() OVER (PARTITION BY a.id ORDER BY bit_count(xor(a.{field}, b.{field})), b.id) AS k
          FROM (SELECT * FROM files WHERE {where}) a JOIN (SELECT * FROM files WHERE {where}) b ON a.id <> b.id) WHERE k <= 5 AND bits <= {bits}"""


SQL = {
    "p4_found": r"""
        WITH w AS (SELECT id, regexp_extract_all(lower(body), '[\p{L}\p{N}_]{2,}') AS l FROM docs WHERE length(body) >= 200),
        s AS (SELECT DISTINCT id, unnest(list_transform(range(1, len(l) - 1), lambda i: l[i] || ' ' || l[i + 1] || ' ' || l[i + 2])) AS g FROM w WHERE len(l) > 2),
        n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
        p AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.id < b.id GROUP BY a.id, b.id)
        SELECT id_a, id_b FROM p JOIN n x ON x.id = id_a JOIN n y ON y.id = id_b WHERE 10 * c >= 6 * (x.n + y.n - c)""",
    "p4_classes": r"""
        WITH t AS (SELECT id, body, min(id) OVER (PARTITION BY body) AS class_id, count(*) OVER (PARTITION BY body) AS copies FROM docs WHERE length(body) >= 200),
        w AS (SELECT id, regexp_extract_all(lower(body), '[\p{L}\p{N}_]{2,}') AS l FROM t WHERE id = class_id),
        s AS (SELECT DISTINCT id, unnest(list_transform(range(1, len(l) - 3), lambda i: l[i] || ' ' || l[i + 1] || ' ' || l[i + 2] || ' ' || l[i + 3] || ' ' || l[i + 4])) AS g FROM w WHERE len(l) > 4),
        n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
        p AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.id <> b.id GROUP BY a.id, b.id),
        k AS (SELECT a AS class_id, count(*) AS links FROM p JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE 10 * c >= 8 * (x.n + y.n - c) GROUP BY a)
        SELECT id, class_id, copies, coalesce(links, 0) AS links FROM t LEFT JOIN k USING (class_id)""",
    "p6_found": _closest("dhash", "bit_count(dhash) BETWEEN 9 AND 55", 8) + " UNION ALL " + _closest("simhash", "simhash IS NOT NULL AND chars >= 600", 3),
    "p2_found": """
        WITH RECURSIVE e AS (
          SELECT DISTINCT least(id_a, id_b) a, greatest(id_a, id_b) b FROM near_pairs
          WHERE id_a <> id_b AND id_a IN (SELECT id FROM files) AND id_b IN (SELECT id FROM files)),
        u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
        r AS (SELECT DISTINCT a AS id, a AS g FROM u UNION SELECT u.b, r.g FROM r JOIN u ON r.id = u.a)
        SELECT id, min(g) AS group_id FROM r GROUP BY id""",
    "p3_found": r"""
        WITH f AS (
          SELECT lower(fhash) g, f.id, f.mtime, f.indexed, f.size,
                 EXISTS (SELECT 1 FROM roots r WHERE starts_with(f.path, r.path || CASE WHEN contains(r.path, '\') THEN '\' ELSE '/' END)) AS rooted
          FROM files f WHERE is_dir = 0 AND fhash IS NOT NULL),
        w AS (SELECT g, id, row_number() OVER (PARTITION BY g ORDER BY
                 CASE WHEN rooted THEN 0 ELSE 1 END, CASE WHEN size > 0 THEN 0 ELSE 1 END,
                 CASE WHEN mtime >= 315532800 AND mtime <= indexed THEN mtime END DESC NULLS LAST, id) n,
               min(id) OVER (PARTITION BY g) group_id, count(*) OVER (PARTITION BY g) c FROM f)
        SELECT group_id, id AS keep_id FROM w WHERE n = 1 AND c > 1""",
    "p9_fill": "SELECT count(*) AS documents, TRUE AS whole, TRUE AS fits, TRUE AS filled FROM documents WHERE text <> ''",
    "p8_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
