"""Packing by power-of-two decomposition: each document becomes pieces of binary lengths, and equal lengths share a bucket.

A document of n tokens gives n // longest pieces of ``longest`` tokens and one piece for each binary digit of the rest,
longest first. A sequence is one piece: it never crosses documents, holds no padding, and sequences of one bucket (one
length) make batches of equal shape. Nothing is shuffled: each task cuts and numbers the documents that it reads.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from . import tokens as tk

LONGEST = 1024


def piece_lengths(n: int, longest: int = LONGEST) -> list[int]:
    """The binary pieces of n tokens, longest first."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << k for k in range(longest.bit_length() - 2, -1, -1) if rest >> k & 1]


def document_ids(column: pa.Array, path: str, end_id: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, token ids of all, borders between documents) for each chunk; every document ends in end_id."""
    table = tk.loaded("ids", lambda: tk.PieceTable(tk.library_ids(path)), path)
    special = tk.special_pattern(path)
    for i, j, raw, offsets in tb.pieces(column):
        marked = _special_rows(raw, offsets, special)
        starts = tk.piece_starts(raw, offsets)
        rank = table.ranks(raw, starts, np.append(starts[1:], len(raw)))
        lengths = table.lengths[rank].astype(np.int64)
        ids = tk.gathered(table.items, table.starts[rank], lengths)
        sums = np.concatenate([[0], np.cumsum(lengths)])
        borders = sums[np.searchsorted(starts, offsets)]
        if len(marked):
            each = np.split(ids, borders[1:-1])
            tokenizer = tk.loaded("tokenizer", lambda: _tokenizer(path), path)
            for k in marked:
                each[k] = np.array(tokenizer.encode(raw[offsets[k] : offsets[k + 1]].tobytes().decode("utf-8", "replace"), add_special_tokens=False).ids, np.uint32)
            ids = np.concatenate(each)
            borders = np.concatenate([[0], np.cumsum([len(x) for x in each])])
        ids = np.insert(ids, borders[1:], end_id)
        yield i, j, ids, borders + np.arange(j - i + 1)


def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _special_rows(raw: np.ndarray, offsets: np.ndarray, special: re.Pattern[bytes] | None) -> np.ndarray:
    """Rows that hold a special token's string, which the library takes whole."""
    text = raw.tobytes()
    if special is None or not special.search(text):
        return np.zeros(0, np.int64)
    return np.array([k for k, (a, b) in enumerate(zip(offsets[:-1], offsets[1:])) if special.search(text, a, b)], np.int64)


def _packed(path: str, longest: int, end_id: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, ids, borders in document_ids(batch.column(1), path, end_id):
                lengths = [piece_lengths(n, longest) for n in np.diff(borders).tolist()]
                counts = np.fromiter(map(len, lengths), np.int64, len(lengths))
                length = np.fromiter((x for each in lengths for x in each), np.int64)
                at = np.cumsum(length) - length
                view = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(view[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), length.tolist(), strict=True)]
                row = np.repeat(np.arange(j - i), counts)
                columns = {
                    "id": batch.column(0).slice(i, j - i).take(pa.array(row)),
                    "start": pa.array(at - borders[row]),
                    "length": pa.array(length),
                    "ids_crc32": pa.array(crc, pa.int64()),
                    "doc_tokens": pa.array(np.diff(borders)[row]),
                }
                if with_ids:
                    columns["ids"] = pa.ListArray.from_arrays(pa.array(np.append(at, len(ids)), pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", longest: int = LONGEST, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with ``with_ids`` the token ids.

    ``longest`` is a power of two. ids are those of the tokenizer file at ``path`` without added special tokens, then end_id. A null
    or empty text is one piece that holds end_id alone. ids repeated in ``docs``, and null ids, are documents of their own; other
    columns are ignored. A file that ``tokens.checked`` refuses is an error. sequence_id is unique within one written result (a stage that reads its input in other splits numbers anew) and offset is 0: a sequence is one piece, padded by nothing. Write the
    result with ``partitionBy("length")`` to have the buckets as folders.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    schema = "id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    pieces = texts.mapInArrow(_packed(tk.checked(path), longest, end_id, with_ids), schema)
    return pieces.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long")).withColumnRenamed("id", id_col)
