"""Exact vector search and the embedding life-cycle (rows I1-I9, A24)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2)), F.lit(0.0), lambda s, x: s + x))


def k_nearest(V: DataFrame, query: list[float], k: int = 50) -> DataFrame:
    """The k vectors (vec_id, embedding) nearest to one query; each task keeps only its best k."""
    q = F.array(*(F.lit(float(x)) for x in query))
    out = V.withColumn("cosine", F.round(cosine(F.col("embedding"), q), 6)).withColumn("l2", F.round(l2(F.col("embedding"), q), 6))
    return out.select("vec_id", "cosine", "l2").orderBy(F.desc("cosine"), "vec_id").limit(k)


def k_nearest_of_set(V: DataFrame, queries: DataFrame, k: int = 10, block: int = 256) -> DataFrame:
    """For a stated query set (query_id, embedding): blocks of queries against all rows; each task hands on its best k of each."""
    import numpy as np
    import pandas as pd

    rows = queries.select("query_id", "embedding").orderBy("query_id").collect()  # the stated set
    spark, out = V.sparkSession, None
    for begin in range(0, len(rows), block):
        part = rows[begin : begin + block]
        held = spark.sparkContext.broadcast((np.array([r[0] for r in part]), np.array([r[1] for r in part], np.float64)))

        def run(batches, held=held):
            ids, q = held.value
            best_s, best_v = np.full((len(ids), 0), 0.0), np.full((len(ids), 0), 0)
            for batch in batches:
                x = np.stack(batch["embedding"].to_numpy()).astype(np.float64)
                score = np.round((q @ x.T) / np.outer(np.sqrt((q**2).sum(1)), np.sqrt((x**2).sum(1))), 6)
                best_s, best_v = np.hstack([best_s, score]), np.hstack([best_v, np.broadcast_to(batch["vec_id"].to_numpy(), score.shape)])
                order = np.lexsort((best_v, -best_s), axis=1)[:, :k]
                best_s, best_v = np.take_along_axis(best_s, order, 1), np.take_along_axis(best_v, order, 1)
            yield pd.DataFrame({"query_id": np.repeat(ids, best_v.shape[1]), "vec_id": best_v.ravel(), "cosine": best_s.ravel()})

        found = V.select("vec_id", "embedding").mapInPandas(run, "query_id long, vec_id long, cosine double")
        out = found if out is None else out.unionByName(found)
    ranked = out.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("cosine")).alias("d"), "vec_id"))), 1, k).alias("x"))
    return ranked.select("query_id", F.posexplode("x").alias("rank", "x")).select("query_id", (F.col("rank") + 1).alias("rank"), "x.vec_id", (-F.col("x.d")).alias("cosine"))


def adaptive_k(n: int) -> int:
    """I4: how many candidates an index of that size asks for."""
    return next((k for most, k in ((1_000, 50), (10_000, 100), (50_000, 150), (200_000, 200)) if n <= most), 300)


def filter_reason(env: str, types: list[str], mention_test: bool) -> Column:
    """The first filter that drops a candidate, null if it stays."""
    name = F.lower("name")
    out = F.when(F.col("file_path").contains("/worktrees/"), "worktree").when(F.col("env") != env, "env")
    out = out if mention_test else out.when(name.contains("test") | F.lower("file_path").contains("test"), "test")
    return out.when(~F.col("element_type").isin(*types), "type")


def recall(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """The mean share of the true k nearest that were found; both have query_id, vec_id."""
    hit = truth.join(found.select("query_id", "vec_id").distinct(), ["query_id", "vec_id"], "left_semi").groupBy("query_id").agg((F.count("*") / k).alias("r"))
    return truth.select("query_id").distinct().join(hit, "query_id", "left").agg(F.avg(F.coalesce("r", F.lit(0.0))).alias("recall"))


def text_blob(E: DataFrame) -> DataFrame:
    """The whole text that is embedded, and its hash."""
    blob = F.concat_ws("\n", F.concat_ws(" ", "element_type", "name"), "file_path", F.concat(F.lit("parent "), "parent_qualified"), "metadata")
    return E.select("qualified_name", blob.alias("blob")).withColumn("content_hash", F.sha2("blob", 256))


def embedded(rows: DataFrame, text: str, dim: int = 64, name: str = "embedding") -> DataFrame:
    """``rows`` with a vector of each text: the sums of its words' signed hashes, scaled to length 1 (without words, zeros).

    A batch's distinct words are hashed once; their signs are added up by numpy.
    """
    import numpy as np
    import pyarrow as pa
    import xxhash
    from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

    def run(batches):
        for batch in batches:
            words = [(t or "").lower().split() for t in batch.column(text).to_pylist()]
            row = np.repeat(np.arange(len(words)), [len(w) for w in words])
            code: dict[str, int] = {}
            number = np.array([code.setdefault(w, len(code)) for own in words for w in own], np.int64)
            hashes = np.array([xxhash.xxh64_intdigest(w) for w in code], np.uint64)[number]
            place = row * dim + (hashes % np.uint64(dim)).astype(np.int64)
            x = np.bincount(place, np.where(hashes >> np.uint64(63), 1.0, -1.0), len(words) * dim).reshape(-1, dim)
            norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
            flat = (x / np.where(norm == 0, 1, norm)).astype(np.float32).ravel()
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(words) + 1) * dim, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*batch.columns, vectors], [*batch.schema.names, name])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField(name, ArrayType(FloatType()))]))


def refresh(blobs: DataFrame, state: DataFrame) -> DataFrame:
    """I8: embed what is not fresh."""
    from .joins import stale_items

    todo = stale_items(blobs.select("qualified_name", "content_hash", "blob"), state)
    return embedded(todo.select("qualified_name", "content_hash", "blob"), "blob").select("qualified_name", "content_hash", "embedding", F.lit("fresh").alias("state"))


def composite_score(functions: DataFrame, query: list[float]) -> DataFrame:
    """Cosine of the query and each function's vector."""
    return functions.withColumn("score", F.round(cosine(F.col("embedding"), F.array(*(F.lit(float(x)) for x in query))), 6))
