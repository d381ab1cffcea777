"""Exact dedup by two passes with a Bloom filter that counts to two.

The first pass names every text by the SHA-256 of its normalised form and counts, in blocks of a filter, how often the places of each name are hit:
never, once, or more often. Names whose places have all been hit twice may be repeated. The second pass looks every row up: only rows that may be
repeated are shuffled, and grouped by the name itself; the rest pass straight through as groups of one. Texts are never shuffled.

A name lies in one block. Tasks send the places they hit, blocks add up where they meet, and what was hit twice is broadcast: at most FILTER_BITS
bits. A table of more rows than that is looked up in several passes over its names (about 50 bytes a row), each with the blocks of a part of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from . import textbytes as tb
from .io import free_name, met, saved

#: places of the filter for each row, and places that a name hits: about 1.7 % of unique rows are looked at again
BITS, HASHES = 10, 3
#: places of a block, and bits of the filter that is broadcast at a time (128 MB)
BLOCK, FILTER_BITS = 1 << 16, 1 << 30


def normalised(text: Column) -> Column:
    """A-Z lower-cased; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _places(names: pa.Array, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """(block, HASHES places in it) of 64-bit names."""
    x = tb.mix(np.asarray(names).view(np.uint64))
    block = ((x >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)
    y = tb.mix(x + tb.BASE)
    return block, np.stack([(y >> np.uint64(16 * k)).astype(np.uint16) for k in range(HASHES)], 1)


def _cells(block: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Places of the whole filter; one that a name hits twice counts once."""
    places = np.sort(places, axis=1)
    again = np.zeros(places.shape, bool)
    again[:, 1:] = places[:, 1:] == places[:, :-1]
    return (block[:, None] * BLOCK + places)[~again]


def _hit(blocks: int):
    """(block, once, twice): the places that the rows of a task hit, for each batch of 200,000 rows or so."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, n = [], 0
        for batch in batches:
            names.append(batch.column(0))
            n += batch.num_rows
            if n >= 200_000:
                yield counted(names)
                names, n = [], 0
        if n:
            yield counted(names)

    def counted(names: list[pa.Array]) -> pa.RecordBatch:
        cell, n = np.unique(_cells(*_places(pa.concat_arrays(names), blocks)), return_counts=True)
        block, first = np.unique(cell // BLOCK, return_index=True)
        place, twice = (cell % BLOCK).astype("<u2"), n > 1
        cut = lambda x: np.split(x, first[1:])
        once = [p[~t].tobytes() for p, t in zip(cut(place), cut(twice), strict=True)]
        more = [p[t].tobytes() for p, t in zip(cut(place), cut(twice), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(block), pa.array(once, pa.binary()), pa.array(more, pa.binary())], names=["block", "once", "twice"])

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, bits): the places that all rows together hit twice, of the blocks of a task."""
    counts: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, once, twice in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own = counts.setdefault(block, np.zeros(BLOCK, np.uint8))
            for places, by in ((once, 1), (twice, 2)):
                at = np.frombuffer(places, "<u2")
                own[at] = np.minimum(own[at] + by, 2)
    for block, own in counts.items():
        if (own == 2).any():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([np.packbits(own == 2).tobytes()], pa.binary())], names=["block", "bits"])


def _marked(twice: Broadcast, blocks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, bits = twice.value
        for batch in batches:
            block, places = _places(batch.column("name"), blocks)
            at = np.searchsorted(number, block)
            known = at < len(number)
            known[known] = number[at[known]] == block[known]
            maybe, place = known.copy(), places[known].astype(np.int64)
            hit = bits[at[known][:, None], place >> 3] >> (7 - (place & 7)).astype(np.uint8) & 1
            maybe[known] = hit.all(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(maybe)], names=[*batch.schema.names, "maybe"])

    return run


def possibly_repeated(names: DataFrame, n: int, filter_bits: int = FILTER_BITS) -> DataFrame:
    """``names`` (name long, ...), a table of n rows, with ``maybe``: false only for rows whose name no other row has."""
    spark = names.sparkSession
    blocks = max(1, -(-n * BITS // BLOCK))
    hits = names.select("name").mapInArrow(_hit(blocks), "block long, once binary, twice binary")
    twice = saved(hits.repartition("block").mapInArrow(_summed, "block long, bits binary"))
    step, out = max(1, filter_bits // BLOCK), None
    schema = StructType([*names.schema.fields, StructField("maybe", BooleanType())])
    for first in range(0, blocks, step):
        found = twice.where(F.col("block").between(first, first + step - 1)).toArrow().combine_chunks().sort_by("block")  # filter_bits at most
        number = found.column("block").to_numpy()
        bits = np.frombuffer(b"".join(found.column("bits").to_pylist()), np.uint8).reshape(len(number), BLOCK // 8)
        own = names if blocks <= step else names.mapInArrow(_of_blocks(blocks, first, first + step), names.schema)
        part = own.mapInArrow(_marked(spark.sparkContext.broadcast((number, bits)), blocks), schema)
        out = part if out is None else out.unionByName(part)
    return out


def _of_blocks(blocks: int, low: int, before: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block, _ = _places(batch.column("name"), blocks)
            yield batch.filter(pa.array((block >= low) & (block < before)))

    return run


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normal=normalised, filter_bits: int = FILTER_BITS) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256), a row for each row of ``docs``.

    Texts are equal when their normalised forms have the same SHA-256; a null text is an empty one, and all empty texts are equal. Of equal texts the row
    with the largest id stays; a null id is less than any; of rows that repeat the largest id, one stays. Other columns are ignored. An empty table
    gives no rows.
    """
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.sha2(normal(F.col(text_col)), 256).alias("text_sha256"))
    # a row's number in the written table tells repeated rows apart
    own = saved(own.withColumn("row", F.monotonically_increasing_id()).withColumn("name", F.xxhash64("text_sha256")))
    n = own.count()
    marked = saved(possibly_repeated(own, n, filter_bits))
    again = marked.where("maybe").drop("maybe", "name")
    best = F.max(F.struct(F.col("id").isNotNull().alias("known"), F.col("id"), (-F.col("row")).alias("row")))
    groups = again.groupBy("text_sha256").agg(best.alias("best"), F.count("*").alias("group_size"))
    groups = saved(groups.select("text_sha256", F.col("best.id").alias("keep_id"), (-F.col("best.row")).alias("keep_row"), "group_size"))
    shared = met(again, groups, ["text_sha256"], n, "group_size").withColumn("kept", F.col("row") == F.col("keep_row"))
    alone = marked.where("not maybe").select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    return alone.unionByName(shared.select("id", "keep_id", "group_size", "kept", "text_sha256")).withColumnRenamed("id", id_col)


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normal=normalised) -> DataFrame:
    """The rows of ``docs`` that stay, all columns as they are: of equal texts one row with the largest id.

    Copies are few ids: rows that may be repeated are found as in ``exact_duplicates``, and only they meet by text; all others stay in their tasks.
    """
    sha, name = free_name(docs, "_sha"), free_name(docs, "_name")
    keyed = docs.withColumn(sha, F.sha2(normal(F.col(text_col)), 256)).withColumn(name, F.xxhash64(sha))
    names = saved(keyed.select(F.col(name).alias("name")))
    n = names.count()
    marked = saved(possibly_repeated(names, n).where("maybe").groupBy("name").agg(F.count("*").alias("n")).where("n > 1"))
    repeated = marked.select(F.col("name").alias(name), F.col("n").alias("_n_of_name"))
    first = keyed.join(repeated.select(name), name, "left_semi").groupBy(sha).agg(F.max_by(F.struct(*docs.columns), F.struct(F.col(id_col).isNotNull(), F.col(id_col))).alias("_kept")).select("_kept.*")
    return keyed.join(repeated.select(name), name, "left_anti").select(docs.columns).unionByName(first)
