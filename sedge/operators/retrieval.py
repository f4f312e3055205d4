"""Ranked retrieval: lexical and vector arms, fusion, diversity, interleaving, slots, pages."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sedge.functions import scores as s
from sedge.functions import text as t

# Fixed values.
BM25_TOKEN = "[a-z0-9]+(?:'[a-z]+)?"
BM25_STOP_WORDS = (
    "a an the and or but if then of to in on at by for with from as is are was were be been being it its this that these those there here we you they he she i me my our your their his her them do does did done have has had"
    " having not no nor so than too very can will would should could may might must shall into onto over under about above below between during before after also"
).split()
# Ends of fixed values.

#: Vectors of a query block that go to every task at once; the block's bytes are bounded by it.
QUERY_BLOCK = 2048


def lexical_terms(text: Column) -> Column:
    """Terms in order, repeats included: words of more than one character that aren't stop words, cut by the light stemmer."""
    found = F.regexp_extract_all(F.lower(text), F.lit(f"({BM25_TOKEN})"), 1)
    return F.transform(F.filter(found, lambda w: (F.length(w) > 1) & ~w.isin(BM25_STOP_WORDS)), t.stem)


def postings(docs: DataFrame, id_col: str, text_col: str, wanted: DataFrame | None = None) -> DataFrame:
    """id, term, tf, length; of the terms in wanted (term), if given. Terms that nobody wants leave before anything is shuffled."""
    rows = docs.select(F.col(id_col).alias("id"), lexical_terms(F.col(text_col)).alias("terms"))
    flat = rows.select("id", F.size("terms").alias("length"), F.explode_outer("terms").alias("term")).where("term is not null")  # terms are computed once
    if wanted is not None:
        flat = flat.join(wanted.select("term").distinct(), "term", "left_semi")
    return flat.groupBy("id", "term").agg(F.count("*").alias("tf"), F.first("length").alias("length"))


def top_per(df: DataFrame, by: str, k: int, *order: Column) -> DataFrame:
    """The first k rows of each group, with their one-based rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= k)


def bm25(queries: DataFrame, docs: DataFrame, k: int = 10, query_id: str = "item_id", doc_id: str = "doc_id", query_text: str = "text", doc_text: str = "text") -> DataFrame:
    """query, id, score, rank: the best k documents of each query; ties go to the smaller id.

    Postings are cut to the queries' terms before they are shuffled. Document frequencies are counted over rows that keep all
    columns of a posting, so both uses of the postings are one exchange and texts are read once.
    """
    wanted = queries.select(F.col(query_id).alias("query"), F.explode(F.array_distinct(lexical_terms(F.col(query_text)))).alias("term"))
    found = postings(docs, doc_id, doc_text, wanted)
    n = docs.select(F.count("*").cast("double").alias("n"))
    df = found.groupBy("term").agg(F.count_if((F.col("tf") > 0) & (F.col("length") > 0)).cast("double").alias("df")).crossJoin(F.broadcast(n))  # one row
    weighted = found.join(df, "term").select("id", "term", (s.idf(F.col("n"), F.col("df")) * s.bm25_weight(F.col("tf"), F.col("length"))).alias("w"))
    hits = weighted.join(wanted, "term").groupBy("query", "id").agg(F.round(F.sum("w"), 6).alias("score"))
    return top_per(hits, "query", k, F.desc("score"), F.asc("id"))


def shared_words(queries: DataFrame, docs: DataFrame, k: int = 10, query_id: str = "item_id", doc_id: str = "doc_id") -> DataFrame:
    """query, id, score, rank by the summed weight of the words that both have; texts are read once, as in bm25."""
    wanted = queries.select(F.col(query_id).alias("query"), F.explode(t.tokens(F.col("text"))).alias("word"))
    words = docs.select(F.col(doc_id).alias("id"), F.explode_outer(t.tokens(F.col("text"))).alias("word")).join(wanted.select("word").distinct(), "word", "left_semi")
    said = words.groupBy("id", "word").agg(F.count("*").alias("times"))  # 1, but for ids that repeat
    n = docs.select(F.count("*").cast("double").alias("n"))
    df = said.groupBy("word").agg(F.sum("times").cast("double").alias("df")).crossJoin(F.broadcast(n))
    weight = s.query_idf(F.col("n"), F.col("df")) * F.col("times")
    hits = said.join(df, "word").join(wanted, "word").groupBy("query", "id").agg(F.round(F.sum(weight), 6).alias("score"))
    return top_per(hits, "query", k, F.desc("score"), F.asc("id"))


def fuse(arms: list[tuple[DataFrame, float, str]], k: int = s.RRF_K, limit: int | None = None) -> DataFrame:
    """query, id, score, retrievers, rank: reciprocal-rank fusion of arms (query, id, rank), each with a weight and a name."""
    rows = None
    for df, weight, name in arms:
        part = df.select("query", "id", (F.lit(weight) / (F.lit(k) + F.col("rank"))).alias("part"), F.lit(name).alias("retriever"))
        rows = part if rows is None else rows.union(part)
    fused = rows.groupBy("query", "id").agg(F.round(F.sum("part"), 9).alias("score"), F.array_join(F.array_sort(F.collect_set("retriever")), "+").alias("retrievers"))
    ranked = fused.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc("id"))))
    return ranked if limit is None else ranked.where(F.col("rank") <= limit)


def cosine_top(queries: DataFrame, vectors: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", include_self: bool = False) -> DataFrame:
    """query, id, score, rank: exact nearest neighbours by cosine.

    Rows without an id, a vector or a number in it are left out on both sides; vectors of different widths are an error.

    Queries go out in blocks of a fixed number of vectors; each task keeps its best k of a block's queries, so one
    pass over the vectors and k rows a task and query are all that a block costs.
    """
    spark = vectors.sparkSession
    wide = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull()))
    rows, blocks = wide(vectors), []
    asked = wide(queries)
    many = -(-asked.count() // QUERY_BLOCK)
    for at in range(many):
        block = asked.where(F.pmod(F.xxhash64("id"), F.lit(many)) == at).collect()  # about QUERY_BLOCK vectors
        if not block:
            continue
        ids, q = np.array([r.id for r in block]), np.array([r.v for r in block])
        held = spark.sparkContext.broadcast((ids, q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)))

        def run(batches, held=held):
            ids, q = held.value
            best_id, best = np.zeros((len(ids), 0), np.int64), np.zeros((len(ids), 0))
            for batch in batches:
                if not batch.num_rows:
                    continue
                own = batch.column(0).to_numpy()
                v = batch.column(1).flatten().to_numpy().reshape(len(own), -1)
                near = np.round(q @ (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)).T, 6)
                if not include_self:
                    near[ids[:, None] == own[None, :]] = -2
                best, best_id = np.hstack([best, near]), np.hstack([best_id, np.broadcast_to(own, near.shape)])
                order = np.lexsort((best_id, -best), axis=1)[:, :k]
                best, best_id = np.take_along_axis(best, order, 1), np.take_along_axis(best_id, order, 1)
            keep = (best > -2).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, best.shape[1])[keep]), pa.array(best_id.ravel()[keep]), pa.array(best.ravel()[keep])], ["query", "id", "score"])

        blocks.append(rows.mapInArrow(run, "query long, id long, score double"))
    if not blocks:
        return spark.createDataFrame([], "query long, id long, score double, rank int")
    found = blocks[0]
    for b in blocks[1:]:
        found = found.union(b)
    return top_per(found, "query", k, F.desc("score"), F.asc("id"))


def max_sim(queries: DataFrame, docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """query, id, score: late interaction over given pairs; for each query vector its best document vector, summed.

    queries: query, vectors; docs: id, vectors (arrays of arrays); pairs: query, id. Never a scan of all documents.
    """
    both = pairs.join(queries.withColumnRenamed("vectors", "qv"), "query").join(docs.withColumnRenamed("vectors", "dv"), "id")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda u, x: u + x)
    best = F.transform("qv", lambda q: F.array_max(F.transform("dv", lambda d: dot(q, d))))
    return both.select("query", "id", F.round(F.aggregate(best, F.lit(0.0), lambda u, x: u + x), 6).alias("score"))


def arm_ranks(hits: DataFrame) -> DataFrame:
    """One-based rank of each id in each (query, arm) by position, its first occurrence counting."""
    first = hits.groupBy("query", "arm", "id").agg(F.min("position").alias("position"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("query", "arm").orderBy("position", "id")))


def interleave(ranked: DataFrame, by: str, kind: str, *order: Column) -> DataFrame:
    """Lists of kinds merged by rank: all firsts, then all seconds, kinds in order."""
    own = ranked.withColumn("kind_rank", F.row_number().over(Window.partitionBy(by, kind).orderBy(*order)))
    return own.withColumn("position", F.row_number().over(Window.partitionBy(by).orderBy("kind_rank", kind)))


def diverse_head(ranked: DataFrame, by: str, group: str, limit: int, per_group: int) -> DataFrame:
    """The first `limit` of each list (by, rank): at most per_group of a group first, what is over the cap fills up the rest."""
    own = ranked.withColumn("of_group", F.row_number().over(Window.partitionBy(by, group).orderBy("rank")))
    tier = F.when(F.col(group).isNotNull() & (F.col("of_group") > per_group), 1).otherwise(0)
    placed = own.withColumn("position", F.row_number().over(Window.partitionBy(by).orderBy(tier, "rank")))
    return placed.where(F.col("position") <= limit).drop("of_group")


def latest_per_slot(facts: DataFrame, slot: list[str], at: str, key: str, value: Column) -> DataFrame:
    """facts with earlier_value and replaced_by: older statements of a slot with another value than the newest one."""
    newest = Window.partitionBy(*slot).orderBy(F.desc(at), F.desc(key))
    head = facts.withColumn("_v", value).withColumn("_newest", F.first("_v").over(newest)).withColumn("_by", F.first(key).over(newest))
    earlier = ~F.col("_v").eqNullSafe(F.col("_newest"))
    return head.withColumn("earlier_value", earlier).withColumn("replaced_by", F.when(earlier, F.col("_by"))).drop("_v", "_newest", "_by")


def session_best(fused: DataFrame, depth: int = 50) -> DataFrame:
    """fused (query, id, session, score) with the best score of the session among the query's first `depth`."""
    top = fused.withColumn("_r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc("id"))))
    best = F.max(F.when(F.col("_r") <= depth, F.col("score"))).over(Window.partitionBy("query", "session"))
    return top.withColumn("session_best", F.coalesce(best, F.lit(0.0))).drop("_r")


def evidence_cap(ranked: DataFrame, by: str, limit: int, counted: Column) -> DataFrame:
    """Rows in rank order until `limit` counted ones are in; the others ride free while it lasts."""
    seen = F.sum(counted.cast("int")).over(Window.partitionBy(by).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn("_n", seen).where(F.col("_n") <= limit).drop("_n")


def keyset_page(rows: DataFrame, keys: list[str], after: tuple | None, limit: int) -> DataFrame:
    """The page that follows a row's key values, newest first, and one row more that tells whether another follows."""
    if after is not None:
        rows = rows.where(F.struct(*keys) < F.struct(*(F.lit(x).cast(rows.schema[k].dataType).alias(k) for k, x in zip(keys, after))))
    return rows.orderBy(*(F.desc(k) for k in keys)).limit(limit + 1)


def ndcg(ranked: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """query, ndcg, recall of ranked (query, id, rank) against relevant (query, id, gain)."""
    ideal = relevant.withColumn("_r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("gain"), F.asc("id")))).groupBy("query").agg(F.sum(F.when(F.col("_r") <= k, F.col("gain") / F.log2(F.col("_r") + 1.0))).alias("ideal"), F.count("*").alias("n"))
    got = ranked.where(F.col("rank") <= k).join(relevant, ["query", "id"]).groupBy("query").agg(F.sum(F.col("gain") / F.log2(F.col("rank") + 1.0)).alias("dcg"), F.count("*").alias("hits"))
    return ideal.join(got, "query", "left").select("query", F.round(F.coalesce(F.col("dcg") / F.col("ideal"), F.lit(0.0)), 6).alias("ndcg"), F.round(F.coalesce(F.col("hits") / F.col("n"), F.lit(0.0)), 6).alias("recall"))
