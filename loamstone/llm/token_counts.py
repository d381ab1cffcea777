"""Token counts by finite-state transducers.

The pattern that cuts a text into pieces runs as a transducer over character classes, and a second transducer over bytes, whose transitions are
annotated with the tokens they emit, counts what the merges make of the pieces (``tokens.CutTransducer``, ``tokens.CountTransducer``). Both run all
chunks of a batch side by side: the chunks' state maps, and with them the counts, compose by a prefix scan. No tokenizer library is called.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from . import tokens as tk

LIMIT = 512


def _without_special(raw: np.ndarray, offsets: np.ndarray, special: re.Pattern[bytes] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts cut at special strings, each of which is one token: bytes, offsets, rows of the parts, special tokens by row."""
    n, text = len(offsets) - 1, raw.tobytes()
    taken = np.zeros(n, np.int64)
    if special is None or not special.search(text):
        return raw, offsets, np.arange(n), taken
    parts: list[bytes] = []
    rows: list[int] = []
    for k in range(n):
        each = special.split(text[offsets[k] : offsets[k + 1]])
        taken[k] = len(each) - 1
        parts += each
        rows += [k] * len(each)
    cut = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    return np.frombuffer(b"".join(parts), np.uint8), cut, np.array(rows), taken


def _counted(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = tk.loaded("cutter", tk.CutTransducer)
        counter = tk.loaded("counter", lambda: tk.CountTransducer(path), path)
        special = tk.special_pattern(path)
        for batch in batches:
            for i, j, whole, borders in tb.pieces(batch.column(1)):
                raw, offsets, rows, total = _without_special(whole, borders, special)
                sums = counter.totals(raw, cutter.starts(raw, offsets))
                np.add.at(total, rows, np.diff(sums[offsets]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(borders)), pa.array(total)], names=["id", "n_bytes", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit), a row for each row of ``docs``.

    ``path`` names a byte-level BPE file in the format of the ``tokenizers`` library, as ``tokens.checked`` describes it; another is an error. A null text counts as empty: 0 bytes, 0 tokens.
    Repeated and null ids are rows of their own, texts of any length count whole, other columns are ignored.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    counts = texts.mapInArrow(_counted(tk.checked(path)), "id long, n_bytes long, n_tokens long")
    return counts.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
