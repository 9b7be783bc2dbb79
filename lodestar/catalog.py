"""Named queries over the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import DbConfig
from .database import Database
from .functions.vector import cosine_similarity, dot_product, l2_norm, literal
from .operators.replay import assign_ids, last_of_each, replay
from .operators.search import apply_filter, top_k, top_k_batched, top_k_each
from .plans.filters import Filter
from .sources.objects import work_folder

#: Metadata of a vector: numbers, a string, a boolean, a key that is null or not, a key that most records lack.
METADATA = """concat('{"label":', label, ',"tag":"t', label, '","even":', if(label % 2 = 0, 'true', 'false'),
    ',"half":', cast(label / 2.0 as decimal(8,1)), ',"maybe":', if(vec_id % 7 = 0, 'null', '1'), if(vec_id % 10 = 0, concat(',"rare":', vec_id), ''), '}')"""


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings as records: id, vector, metadata."""
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.expr(METADATA).alias("metadata"))


def probe(spark: SparkSession, sf_dir: str, id: int = 0) -> list[float]:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").where(F.col("vec_id") == id).select("embedding").first()[0]


def shown(hits: DataFrame) -> DataFrame:
    return hits.select("id", F.round(F.col("score").cast("double"), 4).alias("score"))


def search(where: Filter | str | None = None, k: int | None = None, of: int | None = 0) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        q = probe(spark, sf_dir, of) if of is not None else [0.0] * 64
        return shown(top_k(embeddings(spark, sf_dir), q, *([] if k is None else [k]), where=where))

    return run


DOT = "list_reduce(list_transform(list_zip({a}, {b}), lambda z: z[1] * z[2]), lambda x, y: x + y)"


def search_sql(where: str = "true", k: int | None = 10, of: int | None = 0) -> str:
    """Scores in 32 bits from left to right, as the engine has them."""
    q = f"(SELECT embedding FROM embeddings WHERE vec_id = {of})" if of is not None else "list_transform(embedding, lambda x: 0::FLOAT)"
    limit = "" if k is None else f"LIMIT {k}"
    return f"""
        WITH e AS (SELECT vec_id, label, embedding, {q} AS q FROM embeddings WHERE {where}),
        d AS (SELECT vec_id, {DOT.format(a="embedding", b="q")} AS dot, CAST(sqrt({DOT.format(a="embedding", b="embedding")}) AS FLOAT) AS n, CAST(sqrt({DOT.format(a="q", b="q")}) AS FLOAT) AS qn FROM e),
        s AS (SELECT vec_id, CASE WHEN n * qn = 0 THEN 0::FLOAT ELSE CAST(dot / (n * qn) AS FLOAT) END AS s FROM d)
        SELECT vec_id AS id, round(CAST(s AS DOUBLE), 4) AS score FROM s ORDER BY s DESC, vec_id {limit}"""


#: Name, filter (text or tree), the same condition in SQL.
FILTERED = [
    ("topk_eq_number", "label = 3", "label = 3"),
    ("topk_eq_float", "half = 1.5", "label = 3"),
    ("topk_eq_string", 'tag = "t3"', "label = 3"),
    ("topk_eq_bool", "even = true", "label % 2 = 0"),
    ("topk_ne", "label != 3", "label <> 3"),
    ("topk_lt", "label < 3", "label < 3"),
    ("topk_gt", "label > 3", "label > 3"),
    ("topk_lte", "half <= 1.5", "label <= 3"),
    ("topk_gte", "label >= 3", "label >= 3"),
    ("topk_and3", 'label >= 2 AND label < 8 and even = false', "label >= 2 AND label < 8 AND label % 2 = 1"),
    ("topk_and_empty", Filter.all_of(), "true"),
    ("filter_missing_field", "rare >= 0", "vec_id % 10 = 0"),
    ("filter_ne_missing", "rare != 20", "vec_id % 10 = 0 AND vec_id <> 20"),
    ("filter_json_null", "maybe = null", "vec_id % 7 = 0"),
    ("filter_ne_null", "maybe != null", "vec_id % 7 <> 0"),
    ("filter_type_mismatch", 'label = "3"', "false"),
    ("filter_bool_is_no_number", "even >= 0", "false"),
    ("filter_string_ordering", 'tag < "zzz"', "false"),
]


def topk_late_materialization(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of the hits, complete."""
    hits = top_k(embeddings(spark, sf_dir), probe(spark, sf_dir), 10)
    return hits.select("id", F.round(F.col("score").cast("double"), 4).alias("score"), F.size("vector").cast("long").alias("dim"), F.variant_get(F.parse_json("metadata"), "$.label", "int").alias("label"))


def topk_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Any boolean column is a predicate."""
    return shown(top_k(embeddings(spark, sf_dir), probe(spark, sf_dir), 10, F.col("id") % 2 == 0))


def filter_deep_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An array literal, equal in structure and types."""
    rows = embeddings(spark, sf_dir).withColumn("metadata", F.expr("concat('{\"pair\":[', id % 3, ',', id % 2, ']}')"))
    return apply_filter(rows, Filter.eq("pair", [2, 1])).select("id")


def topk_batched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(top_k_batched(embeddings(spark, sf_dir), probe(spark, sf_dir), 10, "label < 5"))


def topk_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several probes at once: every vector whose id is divisible by 50."""
    e = embeddings(spark, sf_dir)
    probes = e.where("id % 50 = 0").select(F.col("id").alias("probe_id"), F.col("vector").alias("probe"))
    return top_k_each(e, probes, 3).select("probe_id", "id", F.round(F.col("score").cast("double"), 3).alias("score"))


def events_props_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumnRenamed("props", "metadata")
    return apply_filter(events, "k >= 10 AND k < 50").select("event_id", "user_id")


def documents_hybrid_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("metadata", F.to_json(F.struct("lang", "n_chars")))
    return apply_filter(docs, 'lang = "en" AND n_chars < 1000').select("doc_id", "lang", "n_chars")


def get_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings(spark, sf_dir).where("id = 42").select("id", "metadata")


def all_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings(spark, sf_dir).select("id", F.size("vector").cast("long").alias("dim"), "metadata")


METADATA_SQL = """concat('{"label":', label, ',"tag":"t', label, '","even":', CASE WHEN label % 2 = 0 THEN 'true' ELSE 'false' END, ',"half":', CAST(label / 2.0 AS DECIMAL(8,1)),
    ',"maybe":', CASE WHEN vec_id % 7 = 0 THEN 'null' ELSE '1' END, CASE WHEN vec_id % 10 = 0 THEN concat(',"rare":', vec_id) ELSE '' END, '}')"""


def vector_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Norm, dot product and 64-bit cosine with the vector of id 0."""
    q = literal(probe(spark, sf_dir))
    digits = lambda c: F.round(c.cast("double"), 4)
    v = F.col("vector")
    return embeddings(spark, sf_dir).select("id", digits(l2_norm(v)).alias("norm"), digits(dot_product(v, q)).alias("dot"), digits(cosine_similarity(v, q)).alias("cosine"))


def operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as an operation log: an error deletes its user, anything else puts it."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    gone = F.col("event_type") == "error"
    return events.select(
        F.col("event_id").alias("seq"),
        F.when(gone, "delete").otherwise("put").alias("op"),
        F.col("user_id").alias("id"),
        F.when(~gone, F.array(F.col("value").cast("float"))).alias("vector"),
        F.when(~gone, F.col("props")).alias("metadata"),
    )


def live(state: DataFrame) -> DataFrame:
    return state.select("id", "metadata", "pos")


def replay_upsert_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live(replay(operations(spark, sf_dir)))


def replay_snapshot_plus_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot of the first half and the whole log after the watermark."""
    ops = operations(spark, sf_dir)
    half = ops.agg(F.max("seq")).first()[0] // 2
    return live(replay(ops, replay(ops.where(F.col("seq") <= half)), half))


def replay_idempotent(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = operations(spark, sf_dir)
    return live(replay(ops.unionByName(ops)))


REPLAY_SQL = """
    WITH o AS (SELECT event_id AS seq, event_type = 'error' AS gone, user_id AS id, props FROM events),
    d AS (SELECT id, max(seq) FILTER (WHERE gone) AS last FROM o GROUP BY id),
    p AS (SELECT o.* FROM o JOIN d USING (id) WHERE NOT gone AND (last IS NULL OR seq > last))
    SELECT id, arg_max(props, seq) AS metadata, min(seq) AS pos FROM p GROUP BY id"""


def bulk_auto_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch in which every third row has an id of its own choice."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("ordinal"), F.when(F.col("vec_id") % 3 == 0, F.col("vec_id") * 2).alias("id"), "label")
    return assign_ids(rows, 1).select("ordinal", "id")


BULK_SQL = """
    WITH r AS (SELECT vec_id AS ordinal, CASE WHEN vec_id % 3 = 0 THEN vec_id * 2 END AS given FROM embeddings),
    a AS (SELECT *, coalesce(sum(CASE WHEN given IS NULL THEN 1 ELSE 0 END) OVER (ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS a FROM r)
    SELECT ordinal, coalesce(given, a + greatest(1, coalesce(max(given + 1 - a) OVER (ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1)))::BIGINT AS id FROM a"""


def bulk_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the rows of one id the last one stays."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("ordinal"), F.col("user_id").alias("id"), "event_type")
    return last_of_each(rows).select("id", "event_type")


def crc32_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.crc32(F.col("text").cast("binary")).alias("crc"))


def stored(spark: SparkSession, sf_dir: str) -> Database:
    """A database with the embeddings in it: bulk write, checkpoint, then deletes and a put in the log."""
    db = Database(spark, DbConfig(work_folder(spark, "db")))
    db.create_collection("items", 64)
    db.create_collection("empty", 3)
    db.upsert_df("items", embeddings(spark, sf_dir))
    db.checkpoint("items")
    for id in (0, 7, 11):
        db.delete("items", id)
    db.insert("items", 7, [0.0] * 64, {"label": 77})
    return db


def store_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search over snapshot and log together."""
    from .operators.search import Query

    db = stored(spark, sf_dir)
    return shown(db.query(Query("items", probe(spark, sf_dir)).top_k(10).filter("label < 5")))


def store_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = stored(spark, sf_dir)
    rows = [tuple(db.stats(n).values()) for n in db.list_collections()]
    return spark.createDataFrame(rows, "name string, dim int, records long, next_id long, wal_frames long, ops_since_snapshot long")


def db_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookups by id through the engine: in the snapshot, in the log, deleted, never there."""
    db = stored(spark, sf_dir)
    found = [db.get("items", id) for id in (0, 7, 11, 42, 43, -1)]
    rows = [(r["id"], len(r["vector"]), r["metadata"]) for r in found if r]
    return spark.createDataFrame(rows, "id long, dim int, metadata string")


def db_all_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full listing through the engine, with the places of records in storage: one put again after a delete comes last."""
    return stored(spark, sf_dir).all_records("items", pos=True).select("id", F.size("vector").alias("dim"), "metadata", "pos")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "topk_unfiltered": search(),
    "topk_default_k": search(),
    "topk_k_zero": search(k=0),
    "topk_k_gt_n": search(k=1_000_000),
    "topk_zero_probe": search(k=10, of=None),
    **{name: search(where) for name, where, _ in FILTERED},
    "topk_late_materialization": topk_late_materialization,
    "topk_closure": topk_closure,
    "topk_batched": topk_batched,
    "topk_each": topk_each,
    "filter_deep_equal": filter_deep_equal,
    "events_props_range": events_props_range,
    "documents_hybrid_filter": documents_hybrid_filter,
    "get_by_id": get_by_id,
    "all_records": all_records,
    "vector_functions": vector_functions,
    "replay_upsert_delete": replay_upsert_delete,
    "replay_snapshot_plus_log": replay_snapshot_plus_log,
    "replay_idempotent": replay_idempotent,
    "bulk_auto_ids": bulk_auto_ids,
    "bulk_last_wins": bulk_last_wins,
    "crc32_text": crc32_text,
    "store_search": store_search,
    "store_stats": store_stats,
    "db_get": db_get,
    "db_all_records": db_all_records,
}

ORACLE: dict[str, str] = {
    "topk_unfiltered": search_sql(),
    "topk_default_k": search_sql(),
    "topk_k_zero": search_sql(k=0),
    "topk_k_gt_n": search_sql(k=None),
    "topk_zero_probe": search_sql(of=None),
    **{name: search_sql(sql) for name, _, sql in FILTERED},
    "topk_late_materialization": f"SELECT id, score, len(embedding) AS dim, label FROM ({search_sql()}) JOIN embeddings ON vec_id = id",
    "topk_closure": search_sql("vec_id % 2 = 0"),
    "topk_batched": search_sql("label < 5"),
    "topk_each": """
        WITH s AS (SELECT p.vec_id AS probe_id, e.vec_id AS id, list_cosine_similarity(p.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS s
                   FROM (SELECT * FROM embeddings WHERE vec_id % 50 = 0) p, embeddings e),
        r AS (SELECT *, row_number() OVER (PARTITION BY probe_id ORDER BY s::FLOAT DESC, id) AS n FROM s)
        SELECT probe_id, id, round(CAST(s::FLOAT AS DOUBLE), 3) AS score FROM r WHERE n <= 3""",
    "filter_deep_equal": "SELECT vec_id AS id FROM embeddings WHERE vec_id % 3 = 2 AND vec_id % 2 = 1",
    "events_props_range": "SELECT event_id, user_id FROM events WHERE CAST(props->>'k' AS DOUBLE) >= 10 AND CAST(props->>'k' AS DOUBLE) < 50",
    "documents_hybrid_filter": "SELECT doc_id, lang, n_chars FROM documents WHERE lang = 'en' AND n_chars < 1000",
    "get_by_id": f"SELECT vec_id AS id, {METADATA_SQL} AS metadata FROM embeddings WHERE vec_id = 42",
    "all_records": f"SELECT vec_id AS id, len(embedding) AS dim, {METADATA_SQL} AS metadata FROM embeddings",
    "vector_functions": f"""
        WITH e AS (SELECT vec_id, embedding, (SELECT embedding FROM embeddings WHERE vec_id = 0) AS q FROM embeddings)
        SELECT vec_id AS id, round(CAST(CAST(sqrt({DOT.format(a="embedding", b="embedding")}) AS FLOAT) AS DOUBLE), 4) AS norm,
               round(CAST({DOT.format(a="embedding", b="q")} AS DOUBLE), 4) AS dot,
               round(CAST(CAST(list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]) AS FLOAT) AS DOUBLE), 4) AS cosine FROM e""",
    "replay_upsert_delete": REPLAY_SQL,
    "replay_snapshot_plus_log": REPLAY_SQL,
    "replay_idempotent": REPLAY_SQL,
    "bulk_auto_ids": BULK_SQL,
    "bulk_last_wins": "SELECT user_id AS id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id",
    "store_search": f"SELECT * FROM ({search_sql('label < 5 AND vec_id NOT IN (0, 7, 11)')})",
    "store_stats": """
        SELECT 'empty' AS name, 3::INT AS dim, 0::BIGINT AS records, 1::BIGINT AS next_id, 0::BIGINT AS wal_frames, 0::BIGINT AS ops_since_snapshot
        UNION ALL SELECT 'items', 64, count(*) - 2, max(vec_id) + 1, 4, 4 FROM embeddings""",
    "db_get": f"""
        SELECT vec_id AS id, 64::INT AS dim, CASE WHEN vec_id = 7 THEN '{{"label":77}}' ELSE {METADATA_SQL} END AS metadata
        FROM embeddings WHERE vec_id IN (7, 42, 43)""",
    "db_all_records": f"""
        WITH e AS (SELECT *, row_number() OVER (ORDER BY vec_id) - 1 AS place, count(*) OVER () AS n FROM embeddings)
        SELECT vec_id AS id, 64::INT AS dim, CASE WHEN vec_id = 7 THEN '{{"label":77}}' ELSE {METADATA_SQL} END AS metadata,
               CASE WHEN vec_id = 7 THEN n + 3 ELSE place END AS pos
        FROM e WHERE vec_id NOT IN (0, 11)""",
    "crc32_text": """
        WITH t AS (SELECT list(list_reduce(range(0, 8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END, i) ORDER BY i) AS t FROM range(256) r(i)),
        d AS (SELECT doc_id, hex(encode(text)) AS h FROM documents),
        b AS (SELECT doc_id, list_transform(range(0, length(h), 2), lambda k: CAST('0x' || h[k + 1 : k + 2] AS BIGINT)) AS b FROM d)
        SELECT doc_id, xor(4294967295, list_reduce(b, lambda c, x: xor(c // 256, t[(xor(c % 256, x) + 1)]), 4294967295)) AS crc FROM b, t""",
}
