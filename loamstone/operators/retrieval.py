"""Ranked retrieval: BM25 postings, dense similarity, weighted reciprocal-rank fusion and noisy-or confidence.

Queries are rows (query_id, sub_ix, text, weight, vec), so many queries run in one plan. Top-k searches score a block of queries inside the tasks
that read the rows, and only what may be among the best leaves a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..functions import text as T
from ..session import saved
from . import tables as B

K1, LENGTH, RRF_K, POOL = 1.5, 0.75, 60, 30
#: queries of a block, and terms up to which an index is cut down to those of its queries
QUERY_BLOCK, MOST_TERMS = 512, 20_000
#: words or hits, and scores, that a task works on at once, whatever the rows of an Arrow batch hold
WORDS, CELLS = 1 << 18, 1_000_000


def normalised_queries(queries: DataFrame) -> DataFrame:
    """Blank texts go, negative weights are 0."""
    return queries.where(F.trim("text") != "").withColumn("weight", F.greatest(F.col("weight").cast("double"), F.lit(0.0)))


def history_queries(turns: DataFrame, most: int = 5, decay: float = 0.6, chat: str = "chat_id") -> DataFrame:
    """(chat, sub_ix, text, weight) from user turns (chat, id, text): the newest weighs 1, older ones decay; repeats of the newest are left out."""
    back = Window.partitionBy(chat).orderBy(F.desc("id"))
    newest = turns.withColumn("_n", F.row_number().over(back)).where(F.col("_n") <= most)
    current = newest.withColumn("_now", F.first("text").over(back)).where((F.col("_n") == 1) | (F.trim("text") != F.trim("_now")))
    ix = F.row_number().over(back) - 1
    return current.where(F.trim("text") != "").select(chat, ix.alias("sub_ix"), "text", F.pow(F.lit(decay), ix).alias("weight"))


def query_terms(queries: DataFrame) -> DataFrame:
    return queries.select(F.explode(T.tokens(F.col("text"))).alias("term")).distinct()


def indexed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", queries: DataFrame | None = None) -> DataFrame:
    """A lexical index (id, length, hits array<struct<term, tf>>), a row per document, as a table that is written once and used for statistics and scores alike.

    With ``queries``, of at most MOST_TERMS terms in all, only their terms are kept. Nothing is shuffled.
    """
    terms = None
    if queries is not None:
        found = [r.term for r in query_terms(queries).limit(MOST_TERMS + 1).collect()]  # of bounded number
        terms = pa.array(sorted(found), pa.string()) if len(found) <= MOST_TERMS else None
    own = docs.select(F.col(id_col).alias("id"), T.tokens(F.col(text_col)).alias("words"))
    kind = own.schema["id"].dataType.simpleString()
    return saved(own.mapInArrow(_counted(terms), f"id {kind}, length long, hits array<struct<term:string,tf:long>>"))


def _slices(whole: pa.RecordBatch, lists: pa.Array, most: int) -> Iterator[pa.RecordBatch]:
    """A batch in slices whose lists hold at most ``most`` values, or one row."""
    ends, at = np.cumsum(pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False), dtype=np.int64), 0
    while at < len(ends):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield whole.slice(at, end - at)
        at = end


def _counted(terms: pa.Array | None, most: int = WORDS):
    """(id, length, hits) of words: counts of each different word of a row, in the order of words; of ``terms`` (sorted) only, if they are given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _slices(whole, whole.column("words"), most)):
            lists = batch.column("words")
            sizes = pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat, doc, known = lists.flatten(), np.repeat(np.arange(len(lists)), sizes), terms
            if known is None:
                coded = flat.dictionary_encode()
                order = pc.sort_indices(coded.dictionary).to_numpy()
                rank = np.empty(len(order), np.int64)
                rank[order] = np.arange(len(order))
                known, number = coded.dictionary.take(pa.array(order)), rank[coded.indices.to_numpy(zero_copy_only=False)] if len(order) else np.zeros(0, np.int64)
            else:
                number = pc.fill_null(pc.index_in(flat, known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                doc, number = doc[number >= 0], number[number >= 0]
            cell, tf = np.unique(doc * max(1, len(known)) + number, return_counts=True)
            at = np.searchsorted(cell, np.arange(len(lists) + 1) * max(1, len(known)))
            hits = pa.StructArray.from_arrays([known.take(pa.array(cell % max(1, len(known)))), pa.array(tf.astype(np.int64))], ["term", "tf"])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes), pa.ListArray.from_arrays(pa.array(at, pa.int32()), hits)], names=["id", "length", "hits"])

    return run


def postings(index: DataFrame) -> DataFrame:
    """(id, length, term, tf) of an index."""
    return index.select("id", "length", F.explode("hits").alias("x")).select("id", "length", "x.term", "x.tf")


def statistics(index: DataFrame) -> DataFrame:
    """One row: documents and mean length."""
    return index.agg(F.count("*").alias("n"), F.avg("length").alias("avgdl"))


def weighted_terms(index: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, sub_ix, term, idf, avgdl); a query's repeated term counts once."""
    terms = queries.select("query_id", "sub_ix", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term"))
    df = postings(index).groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return terms.join(df, "term").crossJoin(F.broadcast(statistics(index))).select("query_id", "sub_ix", "term", idf.alias("idf"), "avgdl")  # statistics are one row


def bm25(index: DataFrame, queries: DataFrame, k1: float = K1, b: float = LENGTH) -> DataFrame:
    """(query_id, sub_ix, id, score) of all documents that share a term with a query."""
    weight = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("avgdl")))
    return postings(index).join(weighted_terms(index, queries), "term").groupBy("query_id", "sub_ix", "id").agg(F.sum(weight).alias("score"))


def dense(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", floor: float | None = None, pool: int | None = None, result_col: str | None = None) -> DataFrame:
    """(query_id, sub_ix, id, score) by cosine, strictly above ``floor``; zero vectors score 0, rows without a vector, or with one of another length, are left out.

    The queries meet all vectors in blocks of QUERY_BLOCK queries, each a broadcast of bounded size and a pass over the vectors, which are not shuffled.
    With ``pool``, tasks pass on what may be among the pool's best of a query, and ``ranked`` merges it. With ``result_col``, of rows that are one result only those that may be its best are
    passed on, and the pool counts results.
    """
    own = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"), *([F.col(result_col).cast("string").alias("result")] if result_col else []))
    asked = queries.where("vec is not null").select("query_id", "sub_ix", F.col("vec").cast("array<double>").alias("v"))
    return _in_blocks(own, asked, _dense_block, _dense_scores, pool, floor)


def bm25_top(index: DataFrame, queries: DataFrame, pool: int, rows: DataFrame | None = None) -> DataFrame:
    """``bm25`` as far as it may be among the pool's best of a query; scored inside the tasks that read the index, which is not shuffled.

    ``rows`` are those of the index that may be found (all by default); statistics are of the whole index.
    """
    asked = weighted_terms(index, queries).groupBy("query_id", "sub_ix").agg(F.collect_list(F.struct("term", "idf", "avgdl")).alias("terms"))
    return _in_blocks(index if rows is None else rows, asked, _lexical_block, _lexical_scores, pool, 0.0)


def _in_blocks(own: DataFrame, asked: DataFrame, packed: Callable, scores: Callable, pool: int | None, floor: float | None) -> DataFrame:
    spark, blocks = own.sparkSession, max(1, -(-asked.count() // QUERY_BLOCK))
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    schema = f"query_id {kind(asked, 'query_id')}, sub_ix {kind(asked, 'sub_ix')}, id {kind(own, 'id')}, score double"
    out = spark.createDataFrame([], schema)
    block = F.pmod(F.xxhash64("query_id", "sub_ix"), F.lit(blocks))
    for k in range(blocks):
        rows = asked.where(block == k).toArrow().combine_chunks()  # about QUERY_BLOCK queries
        if rows.num_rows:
            out = out.unionByName(own.mapInArrow(_best_of(spark.sparkContext.broadcast((rows.select(["query_id", "sub_ix"]), *packed(rows))), scores, pool, floor), schema))
    return out


def _best_of(block: Broadcast, scores: Callable, pool: int | None, floor: float | None, most: int = CELLS):
    """Scores of batches of rows against a block of queries; the pool's last of any batch is the bar for what follows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, *own = block.value
        bar = np.full(asked.num_rows, -np.inf)
        step = max(1, most // asked.num_rows, min(4 * most // asked.num_rows, 4 * (pool or 0)))  # more rows than the pool, so that the bar rises
        for whole in (part for batch in batches for part in (_slices(batch, batch.column("hits"), WORDS) if "hits" in batch.schema.names else (batch,))):
            for at in range(0, whole.num_rows, step):
                ids, found = scores(whole.slice(at, step), *own)
                keep = found > floor if floor is not None else np.ones(found.shape, bool)
                best = found
                if "result" in whole.schema.names and len(found):
                    code = _codes(whole.slice(at, step), ids)
                    order = np.argsort(code, kind="stable")
                    best = np.maximum.reduceat(found[order], np.searchsorted(code[order], np.arange(code.max() + 1)), axis=0)
                    keep &= found >= best[code] - 2e-6
                if pool is not None:
                    if len(best) > pool:
                        bar = np.maximum(bar, np.partition(best, -pool, axis=0)[-pool])
                    keep &= found >= bar - 2e-6  # what is this close to the last may tie with it once a caller rounds
                row, query = np.nonzero(keep)
                pairs = asked.take(pa.array(query))
                yield pa.RecordBatch.from_arrays([*(c.combine_chunks() for c in pairs.columns), ids.take(pa.array(row)), pa.array(found[row, query])], names=["query_id", "sub_ix", "id", "score"])

    return run


def _codes(batch: pa.RecordBatch, ids: pa.Array) -> np.ndarray:
    """The numbers of the results of the rows that were scored; a row without a result is one of its own."""
    rows = batch.filter(pc.is_in(batch.column("id"), ids)) if len(ids) < batch.num_rows else batch
    results = rows.column("result")
    code = results.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    missing = np.isnan(code.astype(float))
    code = np.where(missing, 0, code).astype(np.int64)
    code[missing] = code.max(initial=-1) + 1 + np.arange(missing.sum())
    return np.unique(code, return_inverse=True)[1]


def _units(column: pa.Array, size: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(rows, vectors of length 1) of a column of vectors: those of ``size`` numbers, or of as many as the first; zero stays zero."""
    sizes = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    size = size or int(sizes.max(initial=0))
    rows = np.flatnonzero(sizes == size)
    flat = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), size)
    norm = np.sqrt((flat * flat).sum(1, keepdims=True))
    return rows, flat / np.where(norm > 0, norm, 1.0)


def _dense_block(asked: pa.Table) -> tuple[np.ndarray]:
    column = asked.column("v").combine_chunks()
    rows, units = _units(column)
    out = np.full((len(column), units.shape[1]), np.nan)  # a query of another length is near to nothing
    out[rows] = units
    return (out,)


def _dense_scores(batch: pa.RecordBatch, asked: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    rows, units = _units(batch.column(1), asked.shape[1])
    return batch.column(0).take(pa.array(rows)), np.nan_to_num(units @ asked.T, nan=-np.inf)


def _lexical_block(asked: pa.Table) -> tuple:
    """The distinct terms, for each the queries that have it and its weight there, and the mean length of a document."""
    lists = asked.column("terms").combine_chunks()
    flat, query = lists.flatten(), np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
    terms = flat.field("term").dictionary_encode()
    number = terms.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(number, kind="stable")
    first = np.searchsorted(number[order], np.arange(len(terms.dictionary) + 1))
    mean = flat.field("avgdl").to_numpy(zero_copy_only=False)
    return terms.dictionary, first, query[order], flat.field("idf").to_numpy(zero_copy_only=False)[order], len(lists), float(mean[0]) if len(mean) else 1.0


def _lexical_scores(batch: pa.RecordBatch, terms: pa.Array, first: np.ndarray, query: np.ndarray, idf: np.ndarray, queries: int, mean: float) -> tuple[pa.Array, np.ndarray]:
    lists = batch.column(2)
    flat, doc = lists.flatten(), np.repeat(np.arange(len(lists)), pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False))
    number = pc.fill_null(pc.index_in(flat.field("term"), terms), -1).to_numpy(zero_copy_only=False)
    some = np.flatnonzero(number >= 0)
    tf, length = flat.field("tf").to_numpy(zero_copy_only=False)[some], batch.column(1).to_numpy(zero_copy_only=False)
    weight = tf * (K1 + 1) / (tf + K1 * (1 - LENGTH + LENGTH * length[doc[some]] / mean))
    size = first[number[some] + 1] - first[number[some]]
    at = np.arange(size.sum()) + np.repeat(first[number[some]] - (np.cumsum(size) - size), size)
    cell = np.repeat(doc[some], size) * queries + query[at]
    return batch.column(0), np.bincount(cell, np.repeat(weight, size) * idf[at], len(lists) * queries).reshape(len(lists), queries)


def ranked(scores: DataFrame, pool: int = POOL, result: Column | None = None) -> DataFrame:
    """The pool's best of each list with ranks from 0; rows of one result (aliases) count once, at their best."""
    keys = ["query_id", "sub_ix"]
    if result is not None:
        scores = scores.withColumn("result_id", result)
        best = Window.partitionBy(*keys, "result_id").orderBy(F.desc("score"), "id")
        scores = scores.withColumn("_b", F.row_number().over(best)).where("_b <= 1").drop("_b")
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    # the row number itself is limited, so that each task cuts its part of a list before the shuffle
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= pool).withColumn("rank", F.col("rank") - 1)


def fused(lexical: DataFrame, dense_: DataFrame, queries: DataFrame, rrf_k: int = RRF_K, floor: float | None = None) -> DataFrame:
    """(query_id, id, score, confidence, relevance) from ranked lists (query_id, sub_ix, id, score, rank).

    score is the weighted reciprocal-rank sum; confidence joins the hits as independent evidence; relevance is the share of the best possible score.
    """
    lists = lexical.withColumn("channel", F.lit("lexical")).unionByName(dense_.withColumn("channel", F.lit("dense")), allowMissingColumns=True)
    asked = queries.where("weight > 0").select("query_id", "sub_ix", "weight")
    whole = asked.groupBy("query_id").agg(F.sum("weight").alias("total"), F.max("weight").alias("most"))
    best = Window.partitionBy("query_id", "sub_ix", "channel")
    clip = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    similar = clip(F.col("score")) if floor is None else clip((F.col("score") - floor) / (1 - floor))
    own = F.when(F.col("channel") == "lexical", F.col("score") / F.max("score").over(best)).otherwise(similar)
    hits = lists.withColumn("_own", own).join(asked, ["query_id", "sub_ix"]).join(whole, "query_id")
    confidence = 1 - F.product(1 - clip(F.col("_own") * F.col("weight") / F.col("most")))
    out = hits.groupBy("query_id", "id").agg(F.sum(F.col("weight") / (rrf_k + F.col("rank") + 1)).alias("score"), confidence.alias("confidence"), F.first("total").alias("total"))
    return out.withColumn("relevance", clip(F.col("score") / (F.col("total") * 2 / (rrf_k + 1)))).drop("total")


def top(scores: DataFrame, k: int, per: list[str] | None = None, by: str = "score", tie: str = "id") -> DataFrame:
    order = Window.partitionBy(*(per or ["query_id"])).orderBy(F.desc(by), tie)
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hybrid(docs: DataFrame, vectors: DataFrame, queries: DataFrame, k: int = 5, where: Column | None = None, allowed: DataFrame | None = None, floor: float | None = None, stats_scope: str = "global", digits: int | None = None) -> DataFrame:
    """Fused top k. Filters apply before either list is cut; with ``stats_scope='subset'`` the lexical statistics are those of the filtered rows.

    docs (id, text, ...), vectors (id, vec). The pool of each list is at least POOL and three times k. With ``digits`` scores are rounded before they are ranked.
    """
    pool = max(POOL, 3 * k)
    rounded = lambda df: df if digits is None else df.withColumn("score", F.round("score", digits))
    chosen = docs.where(where) if where is not None else docs
    chosen = chosen.join(allowed.select("id"), "id", "left_semi") if allowed is not None else chosen
    counted = chosen if stats_scope == "subset" or allowed is not None else docs
    queries = normalised_queries(queries)
    index = indexed(counted, "id", queries=queries)
    found = None if counted is chosen else index.join(chosen.select("id"), "id", "left_semi")
    lexical = ranked(rounded(bm25_top(index, queries, pool, found)), pool)
    near = ranked(rounded(dense(vectors.join(chosen.select("id"), "id", "left_semi"), queries, "id", "vec", floor, pool)), pool)
    return top(rounded(fused(lexical, near, queries, floor=floor)), k)


def substring_ranked(df: DataFrame, query: str, text_col: str = "text") -> DataFrame:
    """Rows that hold the query as a substring, case aside, with the number of occurrences."""
    return df.withColumn("score", T.substring_hits(F.col(text_col), query)).where("score > 0")


def row_relevance(hits: DataFrame) -> DataFrame:
    """(row_id, relevance): the best normalised relevance of each row; without one, the score over the best score. Ids that are no integers go."""
    hits = hits.crossJoin(F.broadcast(hits.agg(F.max("score").alias("_best"))))  # one row
    share = F.coalesce("relevance", F.when(F.col("_best") > 0, F.col("score") / F.col("_best")).otherwise(0.0))
    return hits.withColumn("_r", share).withColumn("row_id", F.col("result_id").try_cast("long")).where("row_id is not null").groupBy("row_id").agg(F.max("_r").alias("relevance"))


def batches_by_limits(df: DataFrame, group: str, order: str, tokens: str, most_items: int, most_tokens: int) -> DataFrame:
    """``df`` with a batch number from 0: items in order, a new batch when items or tokens would pass a limit; an oversized item is alone."""

    def step(state: tuple[int, int, int], n: int) -> tuple[tuple[int, int, int], int]:
        batch, items, total = state
        if items and (items + 1 > most_items or total + n > most_tokens):
            batch, items, total = batch + 1, 0, 0
        return (batch, items + 1, total + n), batch

    return B.walked(df, group, [order], tokens, "batch", LongType(), (0, 0, 0), step)


def remembered_chunks(docs: DataFrame, vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, id, text, score, confidence, relevance, rank): chunks of a corpus as they are found, without ageing."""
    return hybrid(docs, vectors, queries, k).join(docs.select("id", "text"), "id")


def each_memory(found: dict[str, DataFrame], limit: int, memory: str | None = None) -> DataFrame:
    """The best of each memory (id, score), or of one, within 1 to 20 rows; memories are not ranked against each other."""
    n = max(1, min(20, limit))
    parts = [df.select(F.lit(name).alias("memory"), "id", "score") for name, df in found.items() if memory in (None, name)]
    if not parts:
        raise ValueError("no such memory")
    every = parts[0]
    for df in parts[1:]:
        every = every.unionByName(df)
    return top(every, n, ["memory"])


def best_per_row(hits: DataFrame, row: str = "row_id") -> DataFrame:
    """(row, score): the best score of each row over its hits."""
    return hits.groupBy(row).agg(F.max("score").alias("score"))


def candidates(hits: DataFrame, excluded: DataFrame, pool: int) -> DataFrame:
    """Hits (query_id, id, score) to compare an incoming row with: the pool's best of each, once each, without the excluded (query_id, id)."""
    own = hits.groupBy("query_id", "id").agg(F.max("score").alias("score")).join(excluded, ["query_id", "id"], "left_anti")
    return top(own, pool)


def searched_events(events: DataFrame, scores: DataFrame | None, limit: int = 10, *, low: float | None = None, before: float | None = None, user: str | None = None) -> DataFrame:
    """Events within the bounds: with scores (id, score) the best, without a query in order of time, those without a time last."""
    own = events if user is None else events.where(F.col("user_id") == user)
    own = own.where(F.col("occurred_at") >= low) if low is not None else own
    own = own.where(F.col("occurred_at") < before) if before is not None else own
    if scores is None:
        return own.orderBy(F.asc_nulls_last("occurred_at"), "id").limit(limit)
    return own.join(scores.select("id", "score"), "id").orderBy(F.desc("score"), "id").limit(limit)
