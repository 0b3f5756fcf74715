"""Exact ranking of hits: hybrid scores, sections first, bounded refinement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions.text import finite
from gleanery.operators.rows import top_k
from gleanery.sources.tables import checkpoint

# Weights of vector, keyword and table score; with role and section scores for sectioned documents.
FLAT = (0.7, 0.2, 0.1)
SECTIONED = (0.5, 0.15, 0.1, 0.15, 0.1)


def checked(weights: tuple[float, ...]) -> tuple[float, ...]:
    """Weights that are finite, in 0..1 and sum to 1."""
    if not all(isinstance(w, int | float) and 0 <= w <= 1 for w in weights) or abs(sum(weights) - 1) > 1e-6:
        raise ValueError(f"weights must lie in 0..1 and sum to 1: {weights}")
    return weights


def hybrid(vector: Column, keyword: Column, boost: Column, weights: tuple[float, float, float] = FLAT) -> Column:
    """Weighted sum of three scores; null and non-finite ones count 0."""
    a, b, c = checked(weights)
    v, k, t = (F.coalesce(finite(x), F.lit(0.0)) for x in (vector, keyword, boost))
    return v * a + k * b + t * c


def vector_topk(queries: DataFrame, items: DataFrame, scope: str, query_id: str, item_id: str, vector: str, k: int, block: int = 50_000, query_block: int = 10_000) -> DataFrame:
    """The k items nearest to each query within its scope, by cosine in double arithmetic: exact, of all items.

    Each scope's items are dealt into blocks of about ``block`` and its queries into blocks of
    about ``query_block``, as many as its own numbers ask for (both are counted first), so a
    scope of a third of all rows is many tasks of bounded size and a small one is a single
    task; each pair of blocks is one matrix product that keeps k per query. A window picks
    the k best of the blocks. Null vectors are left out; a vector without length has cosine 0.
    """
    q = queries.where(F.col(vector).isNotNull()).select(F.col(scope).alias("_s"), F.col(query_id).cast("bigint").alias("query_id"), F.col(vector).cast("array<double>").alias("_v"))
    i = items.where(F.col(vector).isNotNull()).select(F.col(scope).alias("_s"), F.col(item_id).cast("bigint").alias("item_id"), F.col(vector).cast("array<double>").alias("_v"))
    blocks = lambda df, n, name: df.groupBy("_s").agg(F.ceil(F.count("*") / n).cast("int").alias(name))
    sizes = blocks(q, query_block, "_gq").join(blocks(i, block, "_gi"), "_s")  # scopes with both; one row each
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    own = lambda c, g: F.pmod(F.xxhash64(c), F.col(g)).cast("int")
    q = q.join(sizes, "_s").select("_s", own("query_id", "_gq").alias("_bq"), upto("_gi").alias("_bi"), "query_id", "_v")
    i = i.join(sizes, "_s").select("_s", upto("_gq").alias("_bq"), own("item_id", "_gi").alias("_bi"), "item_id", "_v")

    def nearest(left, right):
        import numpy as np
        import pyarrow as pa

        def matrix(t):
            v = t.column("_v").combine_chunks()
            m = np.asarray(v.flatten()).reshape(len(v), -1)
            n = np.sqrt((m * m).sum(axis=1, keepdims=True))
            return m / np.where(n > 0, n, 1.0)

        ids, found, scores = np.asarray(right.column("item_id")), [], []
        own = np.asarray(left.column("query_id"))
        if len(own) and len(ids):
            vectors, rows = matrix(right), matrix(left)
            for a in range(0, len(own), 256):
                s = np.round(rows[a : a + 256] @ vectors.T, 9)
                for r, x in zip(own[a : a + 256], s):
                    x[ids == r] = -np.inf
                    top = np.lexsort((ids, -x))[:k] if len(x) <= 4 * k else (lambda c: c[np.lexsort((ids[c], -x[c]))][:k])(np.flatnonzero(x >= np.partition(x, -k)[-k]))  # noqa: B023
                    top = top[np.isfinite(x[top])]
                    found += [(r, ids[j]) for j in top]
                    scores += x[top].tolist()
        return pa.table({"query_id": pa.array([f[0] for f in found], pa.int64()), "item_id": pa.array([f[1] for f in found], pa.int64()), "score": pa.array(scores, pa.float64())})

    best = q.groupBy("_s", "_bq", "_bi").cogroup(i.groupBy("_s", "_bq", "_bi")).applyInArrow(nearest, "query_id bigint, item_id bigint, score double")
    return top_k(best, ["query_id"], k, F.col("score").desc(), F.col("item_id"))


def select_sections(hits: DataFrame, keys: list[str], section: str, score: str, order: Column, k: int, least: float) -> DataFrame:
    """Sections to search: that of the best hit, and of the next hits among the first k that score ``least`` or more; blanks go, each once."""
    best = top_k(hits, keys, k, F.col(score).desc(), order, name="_rank")
    return best.where((F.col("_rank") == 1) | (F.col(score) >= least)).where(F.col(section).isNotNull() & (F.col(section) != "")).select(*keys, section).distinct()


def two_stage(hits: DataFrame, chunks: DataFrame, descendants: DataFrame, query: str, score: str, item: str, section_k: int = 3, least: float = 0.25, k: int = 5) -> DataFrame:
    """Two-stage ranking of hits: sections by their summaries, then the hits in those sections and below, else all hits of the query.

    ``chunks``: chunk_id, document_url, section_id, chunk_role. ``descendants``: document_url,
    ancestor, descendant. Every step is a join by equality or a window per query.
    """
    rows = hits.join(chunks, "chunk_id")
    summaries = rows.where("chunk_role = 'section_summary'")
    routed = select_sections(summaries, [query, "document_url"], "section_id", score, F.col(item), section_k, least).withColumnRenamed("section_id", "ancestor")
    wide = routed.join(descendants, ["document_url", "ancestor"]).select(query, "document_url", F.col("descendant").alias("section_id")).distinct()
    found = rows.join(wide, [query, "document_url", "section_id"], "left_semi")
    missing = rows.join(found.select(query, "document_url").distinct(), [query, "document_url"], "left_anti")
    both = found.withColumn("stage", F.lit("section")).unionByName(missing.withColumn("stage", F.lit("document")))
    return top_k(both, [query], k, F.col(score).desc(), F.col(item)).select(query, "rank", item, "stage")


def sectioned(hits: DataFrame, descendants: DataFrame, query: str, item: str, k: int = 5, section_k: int = 3, least: float = 0.25, weights: tuple[float, ...] = SECTIONED) -> DataFrame:
    """Two-stage ranking within documents: (query, document_url, rank, item, score, stage).

    ``hits``: query, item, document_url, section_id, chunk_role and the scores v, k and b (vector,
    keyword, table). Of each query and document the summaries choose sections; each of
    these and of those below gives 2 k candidates by vector score; a document without any
    gives 2 k of its own. They are ranked by the weighted sum of the three scores and
    the bonus of their role (a tenth for summaries, a twentieth for tables). Ties go to the
    smaller item.
    """
    keys = [query, "document_url"]
    best = [F.col("v").desc(), F.col(item)]
    chosen = select_sections(hits.where("chunk_role = 'section_summary'"), keys, "section_id", "v", F.col(item), section_k, least)
    wide = chosen.withColumnRenamed("section_id", "ancestor").join(descendants, ["document_url", "ancestor"]).select(*keys, F.col("descendant").alias("section_id")).distinct()
    inside = top_k(hits.join(wide, [*keys, "section_id"], "left_semi"), [*keys, "section_id"], 2 * k, *best, name="_p").drop("_p")
    outside = top_k(hits.join(inside.select(*keys).distinct(), keys, "left_anti"), keys, 2 * k, *best, name="_p").drop("_p")
    both = inside.withColumn("stage", F.lit("section")).unionByName(outside.withColumn("stage", F.lit("document")))
    a, b, c, d, e = checked(weights)
    bonus = F.when(F.col("chunk_role") == "section_summary", 0.1 * d).when(F.col("chunk_role") == "table", 0.05 * e).otherwise(0.0)
    scored = both.withColumn("score", F.round(F.col("v") * a + F.col("k") * b + F.col("b") * c + bonus, 6))
    return top_k(scored, keys, k, F.col("score").desc(), F.col(item)).select(*keys, "rank", item, "score", "stage")


def refine(queries: DataFrame, query_id: str, text: str, search, least: float, rounds: int, suffixes: tuple[str, ...]) -> DataFrame:
    """Search, score and refine up to ``rounds`` times; only queries below ``least`` go on, each keeps its best round.

    ``search`` takes (query_id, text) rows and gives (query_id, quality). The rounds are a
    small fixed number, the state between them is one row per query, at the shared
    checkpoint. A later round replaces an earlier one only if it is strictly better.
    """
    open_rows, done = queries.select(F.col(query_id).alias("query_id"), F.col(text).alias("query")), None
    for k in range(rounds):
        scored = checkpoint(open_rows.join(search(open_rows), "query_id", "left").select("query_id", "query", F.coalesce("quality", F.lit(0.0)).alias("quality"), F.lit(k).alias("round")))
        done = scored if done is None else done.unionByName(scored)
        suffix = F.split(F.lit(suffixes[k % len(suffixes)]), " ")
        have = F.split(F.lower("query"), " ")
        open_rows = scored.where(F.col("quality") < least).select("query_id", F.concat_ws(" ", "query", F.array_join(F.array_except(suffix, have), " ")).alias("query"))
    best = F.max_by(F.struct("query", "quality", "round"), F.struct(F.col("quality"), -F.col("round")))
    return done.groupBy("query_id").agg(best.alias("b"), F.count("*").alias("rounds")).select("query_id", "b.query", "b.quality", F.col("b.round").alias("best_round"), "rounds")
