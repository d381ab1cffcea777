"""MinHash near-duplicate detection: one-permutation hashing, optimal densification, banded buckets, star-shaped candidates.

A text's set holds the 64-bit hashes of its distinct word shingles (ASCII lower case, words ``[^\\x20\\x09-\\x0D]+``). One
permutation deals the set over ``bins`` bins; an empty bin borrows from a filled one by a fixed random order of the bins,
which differs from bin to bin (densification after Shrivastava, 2017). ``rows`` neighbouring bins make a band, and texts
that agree in a band share a bucket.

Equal sets are folded into one representative first, so groups of copies of any size cost one row. In each bucket the
members link to one hub, the member that meets most others over all of its buckets, and each link is confirmed on the full sets.
What stars alone would miss is then looked for among members of one bucket that are still in different components: those outside the
bucket's largest component meet each other and all of its rest, on full sets, in pairs of blocks of bounded size, which give one link for each two
components, not one for each pair of texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .components import components
from .io import released, saved

BINS, ROWS = 128, 4


def _orders(bins: int) -> np.ndarray:
    """For each bin the order in which it looks for a filled one: fixed, and different for each bin."""
    return np.argsort(np.random.default_rng(20_170_714).random((bins, bins)), axis=1)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles; with fewer words, of the whole sequence."""
    starts, ends, words = tb.word_bounds(raw, offsets)
    hashes = tb.span_hashes(tb.lowered(raw), starts, ends)
    whole = np.zeros(max(0, len(hashes) - size + 1), np.uint64)
    for k in range(size):
        whole = tb.mix(whole + hashes[k : k + len(whole)] * np.uint64(2 * k + 3))
    for i, j in zip(words[:-1].tolist(), words[1:].tolist(), strict=True):
        if j - i >= size:
            x = np.sort(whole[i : j - size + 1])
            yield x[np.concatenate(([True], x[1:] != x[:-1]))]
        elif j > i:
            x = np.array([j - i], np.uint64)
            for h in hashes[i:j]:
                x = tb.mix(x * np.uint64(31) + h)
            yield x
        else:
            yield np.zeros(0, np.uint64)


def signature(x: np.ndarray, orders: np.ndarray) -> np.ndarray:
    """The densified one-permutation signature of a sorted set that is not empty."""
    bins = len(orders)
    step = np.uint64((1 << 64) // bins)
    at = np.searchsorted(x, np.arange(bins, dtype=np.uint64) * step)
    filled = np.diff(np.append(at, len(x))) > 0
    out = x[np.minimum(at, len(x) - 1)]
    if not filled.all():
        empty = np.flatnonzero(~filled)
        order = orders[empty]
        out[empty] = out[order[np.arange(len(empty)), filled[order].argmax(1)]]
    return out


def _signed(size: int, bins: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders = _orders(bins)
        salt = tb.mix(np.arange(1, bins // rows + 1, dtype=np.uint64))
        for batch in batches:
            for i, j, raw, offsets in tb.pieces(batch.column(1)):
                counts, digests, sigs = [], [], []
                for x in shingle_sets(raw, offsets, size):
                    counts.append(len(x))
                    digests.append((x.sum(dtype=np.uint64), tb.mix(x ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)))
                    sigs.append(signature(x, orders) if len(x) else np.zeros(bins, np.uint64))
                if not counts:
                    continue
                digest, sig = np.array(digests, np.uint64), np.array(sigs)
                band = np.broadcast_to(salt, (len(sig), len(salt))).copy()
                for k in range(rows):
                    band = tb.mix(band * np.uint64(31) + sig[:, k::rows])
                some = np.array(counts) > 0
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i),
                        pa.array(counts, pa.int64()),
                        pa.array(tb.signed(np.ascontiguousarray(digest[:, 0]))),
                        pa.array(tb.signed(np.ascontiguousarray(digest[:, 1]))),
                        pa.array([tb.signed(b) if s else None for b, s in zip(band, some, strict=True)], pa.list_(pa.int64())),
                    ],
                    names=["id", "n", "d1", "d2", "bands"],
                )

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, raw, offsets in tb.pieces(batch.column(1)):
                sets = [tb.signed(x) for x in shingle_sets(raw, offsets, size)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(sets, pa.list_(pa.int64()))], names=["id", "x"])

    return run


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (src, dst) of ``pairs`` whose full sets reach ``percent``."""
    a, b = sets.select(F.col("id").alias("src"), F.col("x").alias("xs")), sets.select(F.col("id").alias("dst"), F.col("x").alias("xd"))
    both = pairs.join(a, "src").join(b, "dst")
    shared = F.size(F.array_intersect("xs", "xd"))
    return both.where(100 * shared >= percent * (F.size("xs") + F.size("xd") - shared)).select("src", "dst")


BLOCK, BLOCK_SHINGLES = 256, 400_000


def _shared(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of ``a`` with all of ``b``, by a product of 0/1 matrices over the shingles that repeat."""
    sizes = np.array([len(x) for x in [*a, *b]])
    every, place = np.unique(np.concatenate([*a, *b]), return_inverse=True)
    number = np.cumsum(np.bincount(place, minlength=len(every)) > 1) - 1
    often = np.bincount(place, minlength=len(every))[place] > 1
    row, column = np.repeat(np.arange(len(sizes)), sizes)[often], number[place[often]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(a), len(b)), np.float32)
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        i, j = np.searchsorted(column, (first, first + 4096))
        m = np.zeros((len(sizes), 4096), np.float32)
        m[row[i:j], column[i:j] - first] = 1
        out += m[: len(a)] @ m[len(a) :].T
    return out


def _linking(percent: int):
    """Links between different components in a block, or between two blocks: one for each two components that have any."""

    def run(table: pa.Table) -> pa.Table:
        ids, group, side = (table.column(c).to_numpy() for c in ("id", "component", "side"))
        home = table.column("home").to_numpy()
        sets = [x.values.to_numpy() for x in table.column("x")]
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        links = np.zeros((2, 0), np.int64)
        if len(left) and len(right):
            shared = _shared([sets[k] for k in left], [sets[k] for k in right])
            n = np.array([len(x) for x in sets], np.float64)
            good = (100 * shared >= percent * (n[left][:, None] + n[right] - shared)) & (group[left][:, None] != group[right])
            good &= (home[left][:, None] == 0) | (home[left][:, None] != home[right])
            i, j = np.nonzero(good)
            i, j = left[i], right[j]
            pair = np.stack([np.maximum(group[i], group[j]), np.minimum(group[i], group[j])])
            _, one = np.unique(pair, axis=1, return_index=True)
            links = np.stack([ids[i[one]], ids[j[one]]])
        return pa.table({"src": pa.array(links[0], pa.int64()), "dst": pa.array(links[1], pa.int64())})

    return run


def _blocks_of(members: DataFrame, key: list[str], sets: DataFrame, percent: int) -> DataFrame:
    """Links among members (key.., id, component, home, n) of one key that are in different components, by pairs of blocks.

    Most members of a key are in one component and are not compared with each other: those outside of it, the strays, meet each other and all
    of the rest. A block has about BLOCK rows and BLOCK_SHINGLES shingles at most, so no group grows with a key. The sets join last, once.
    """
    counted = saved(members.groupBy(*key, "component").agg(F.count("*").alias("c"), F.sum("n").alias("s")))
    blocks = lambda of: F.coalesce(F.ceil(F.greatest(F.sum(F.when(of, F.col("c"))) / BLOCK, F.sum(F.when(of, F.col("s"))) / BLOCK_SHINGLES)), F.lit(0)).cast("long")
    main = counted.groupBy(*key).agg(F.max_by("component", F.struct("c", "component")).alias("main"))
    sizes = saved(counted.join(main, key).groupBy(*key, "main").agg(blocks(F.col("component") == F.col("main")).alias("rest"), blocks(F.col("component") != F.col("main")).alias("strays")))
    dealt = members.join(sizes, key).withColumn("stray", F.col("component") != F.col("main"))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("id"), F.when(F.col("stray"), F.col("strays")).otherwise(F.col("rest"))))
    # blocks of strays have the numbers from 0, the others those after them; each meets the blocks of strays, a stray also the rest
    own = F.when(F.col("stray"), F.col("own")).otherwise(F.col("own") + F.col("strays"))
    others = F.sequence(F.lit(0).cast("long"), F.when(F.col("stray"), F.col("strays") + F.col("rest")).otherwise(F.col("strays")) - 1)
    dealt = dealt.withColumn("own", own).withColumn("other", F.explode(others))
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    dealt = dealt.select(*key, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), side.alias("side"), "id", "component", "home")
    return dealt.join(sets, "id").groupBy(*key, "i", "j").applyInArrow(_linking(percent), "src long, dst long")


def _left_apart(buckets: DataFrame, homes: DataFrame, sets: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Links between members of one bucket that are still in different components.

    Most members of a bucket have one home, the most famous hub among all of their buckets; they are compared once, by home.
    Members of one bucket with different homes are compared by bucket.
    """
    known = homes.join(labels.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    known = saved(known.select("rep", "home", "component", "n"))
    mixed = saved(known.groupBy("home").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("home"))
    by_home = known.join(mixed, "home").select(F.lit("home").alias("kind"), F.col("home").alias("key"), F.col("rep").alias("id"), "component", F.lit(0).cast("long").alias("home"), "n")
    spread = buckets.join(known, "rep")
    across = saved(spread.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("home").alias("a"), F.max("home").alias("z")).where("lo < hi and a < z").select("band"))
    # home + 1: 0 is for rows that are compared whatever their home
    by_band = spread.join(across, "band").select(F.lit("band").alias("kind"), F.col("band").alias("key"), F.col("rep").alias("id"), "component", (F.col("home") + 1).alias("home"), "n")
    members = saved(by_home.unionByName(by_band))
    if members.isEmpty():  # all buckets are of one component
        return members.select(F.col("id").alias("src"), F.col("id").alias("dst"))
    return _blocks_of(members, ["kind", "key"], sets, percent).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, bins: int = BINS, rows: int = ROWS) -> DataFrame:
    """(id, n_shingles, component_id, kept), a row for each row of ``docs``.

    Texts link when 100 * |intersection| >= percent * |union| of their shingle sets; component_id is the smallest id reachable
    over links, the own one included. A null or empty text has an empty set, links with nothing and is kept. A row with a null
    id is linked with nothing and kept (component_id null). Rows that repeat an id count as one document: all of them get
    its component, and they are kept or go together. Other columns are ignored.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    schema = "id long, n long, d1 long, d2 long, bands array<long>"
    signed = saved(texts.mapInArrow(_signed(shingle, bins, rows), schema))
    some = signed.where("n > 0 and id is not null")
    classes = saved(some.groupBy("n", "d1", "d2").agg(F.min("id").alias("rep"), F.first("bands").alias("bands")))
    spread = classes.select("rep", "n", F.explode("bands").alias("band"))
    # counts and hubs are tables of their own, so that the joins back have plain exchanges and a hot bucket can be split
    sizes = saved(spread.groupBy("band").agg(F.count("*").alias("c")).where("c > 1"))
    buckets = saved(spread.join(sizes, "band"))
    # the hub of a bucket is the member that shares most buckets with most others
    fame = buckets.groupBy("rep").agg(F.sum("c").alias("fame"))
    famed = buckets.select("band", "rep").join(fame, "rep")
    hubs = saved(famed.groupBy("band").agg(F.min(F.struct(-F.col("fame"), F.col("rep").alias("hub"))).alias("best")))
    starred = saved(buckets.select("band", "rep", "n").join(hubs, "band"))
    homes = saved(starred.groupBy("rep", "n").agg(F.min("best").alias("best")).select("rep", "n", F.col("best.hub").alias("home")))
    hub = F.col("best.hub")
    pairs = starred.where(F.col("rep") != hub).select(F.greatest("rep", hub).alias("src"), F.least("rep", hub).alias("dst")).distinct()
    wanted = homes.select(F.col("rep").alias("id"))
    sets = saved(texts.join(wanted, "id", "left_semi").dropDuplicates(["id", "text"]).mapInArrow(_sets(shingle), "id long, x array<long>"))
    members = some.join(classes, ["n", "d1", "d2"]).where("id <> rep").select(F.col("id").alias("src"), F.col("rep").alias("dst")).distinct()
    stars = saved(confirmed(pairs, sets, percent).distinct())
    labels = components(stars)
    apart = saved(_left_apart(starred.select("band", "rep"), homes, sets, labels, percent))
    # the stars count by what they join, which is short of chains already
    links = saved(labels.select(F.col("id").alias("src"), F.col("component").alias("dst")).unionByName(apart).unionByName(members))
    released(sizes, buckets, hubs, starred, homes, sets, stars, apart, classes)
    final = components(links)
    out = signed.select("id", "n").join(final, "id", "left")
    component = F.coalesce("component", "id")
    return out.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"),
    )
