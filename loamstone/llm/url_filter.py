"""URL rules by a sort-merge range join.

A canonical key is the host with its labels reversed, each closed by a dot (``blog.example.net`` -> ``net.example.blog.``), so a rule's
host and all of its subdomains are one interval of keys, and intervals nest. URLs are dealt over ranges of (key, salt): a host that
holds a third of all rows spans several ranges. A rule is copied to the ranges that its interval meets. In each range
one sweep over the sorted keys keeps a stack of the rules whose intervals are open, and judges every URL by that stack alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: the split points of the ranges come from at most about this many keys, chosen by a hash; they decide balance, not results
SAMPLE_KEYS = 20_000


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): after the first ``://`` up to ``/``, ``?``, ``#`` or the end with A-Z lower-cased; then up to ``?``, ``#`` or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "(?s)^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "(?s)^[^?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def host_key(host: Column) -> Column:
    return F.when(host == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(host, "\\.", -1)), "."), F.lit(".")))


def _swept(default: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, open_ = None, []  # the range; (end of the interval, {length: {path: (blocks, rule, verdict)}}), outermost first
        for batch in batches:
            rows, rules, verdicts = [], [], []
            columns = (batch.column(n).to_pylist() for n in ("range", "key", "is_url", "path", "rule", "verdict"))
            for k, (range_, key, is_url, path, rule, verdict) in enumerate(zip(*columns, strict=True)):
                if range_ != here:
                    here, open_ = range_, []
                while open_ and not open_[-1][0] > key:
                    open_.pop()
                if not is_url:
                    end = key[:-1] + "/"  # the sign after the dot
                    if not open_ or open_[-1][0] != end:
                        open_.append((end, {}))
                    own = open_[-1][1].setdefault(len(path), {})  # rules of one host by the length of their paths, so a url looks up its own beginnings
                    own[path] = max(own.get(path, (False, "", "")), (verdict == "block", rule, verdict))
                    continue
                fits = [(len(x[1]), *x) for _, own in open_ for n, by_path in own.items() if (x := by_path.get(path[:n]))]
                best = max(fits, default=None)
                rows.append(k)
                rules.append(best[2] if best else None)
                verdicts.append(best[3] if best else default)
            own = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([own.column("id"), own.column("host"), own.column("path"), pa.array(rules, pa.string()), pa.array(verdicts, pa.string())], names=["id", "host", "path", "rule", "verdict"])

    return run


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", ranges: int | None = None) -> DataFrame:
    """(id, host, path, rule, verdict), a row for each row of ``pages``.

    ``rules`` has verdict (allow or block), host and path. A rule fits its host and all subdomains if the url's path starts with the
    rule's; of the fitting ones the longest (host and path together) wins, of equally long ones block. Without a fitting rule, rule
    is null and the verdict is ``default``. A null url, or one without ``://``, has an empty host and path. Repeated rules act as one, rules with a null
    host are ignored, a null path is empty. Repeated and null ids are rows of their own; other columns are ignored.
    """
    spark = pages.sparkSession
    host, path = url_parts(F.col(url_col))
    urls = pages.select(F.col(id_col).cast("long").alias("id"), host.alias("host"), path.alias("path"))
    urls = urls.withColumn("key", host_key(F.col("host"))).withColumn("salt", F.lpad(F.hex(F.xxhash64("id", "path")), 16, "0"))
    wanted = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = pages.count()  # of the files' own counts, without a column
    one_in = max(1, n // SAMPLE_KEYS)
    sample = urls.where(F.pmod(F.xxhash64("id", "path", F.lit(7)), F.lit(one_in)) == 0).select(F.concat("key", F.lit("\x00"), "salt").alias("k")).limit(4 * SAMPLE_KEYS)
    found = sorted(r.k for r in sample.collect())  # of bounded size
    splits = sorted({found[len(found) * k // wanted] for k in range(1, wanted)}) if found else []
    lists = F.array(*map(F.lit, splits)) if splits else F.array().cast("array<string>")
    # the number of splits up to a key, by halving: a step for each binary digit
    steps = F.array(*[F.lit(1 << b) for b in range(len(splits).bit_length() - 1, -1, -1)])
    place = lambda k: F.aggregate(steps, F.lit(0), lambda n, s: F.when(F.coalesce(F.get(lists, n + s - 1) <= k, F.lit(False)), n + s).otherwise(n)) if splits else F.lit(0)
    urls = urls.select(place(F.concat("key", F.lit("\x00"), "salt")).alias("range"), "key", F.lit(True).alias("is_url"), "id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    own = rules.where("host is not null").select(F.translate("host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").distinct()
    own = own.withColumn("key", host_key(F.col("host")))
    last = F.concat(F.expr("left(key, length(key) - 1)"), F.lit("/"))
    own = own.withColumn("range", F.explode(F.sequence(place(F.col("key")), place(last))))
    own = own.select("range", "key", F.lit(False).alias("is_url"), F.lit(None).cast("long").alias("id"), "host", "path", F.concat("host", "path").alias("rule"), "verdict")
    dealt = urls.unionByName(own).repartition(wanted, "range").sortWithinPartitions("range", "key", "is_url", "path")
    out = dealt.mapInArrow(_swept(default), "id long, host string, path string, rule string, verdict string")
    return out.withColumnRenamed("id", id_col)
