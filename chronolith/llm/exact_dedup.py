"""Exact deduplication over a log-structured digest index, with DataFrame operations only.

The documents' entries (id, digest) go to MEMTABLES memtables by scan task. A memtable is flushed as a sorted run: the
smallest and largest identifier and the number of rows of each of its digests, in hash buckets sorted by digest; copies
collapse before they travel, so a hot group leaves one entry per task. Compaction merges the runs pairwise, level by
level, each merge a sort-merge join of buckets without a shuffle, until one run is left. That run has a blocked Bloom
filter over its repeated digests. Every entry probes the filter: those that it rejects are single and done, and only
those that pass are looked up in the run. Documents that hit a repeated digest are verified byte by byte; groups in which
a digest collides are split by their text.

Defined results: a null text counts as empty; very long texts are read whole; rows with a null identifier belong to their
group, but are never the keeper unless the whole group has null identifiers; rows that tie on identifier and text are the
same document and get the same verdict; rows of one identifier with different texts are different documents; an empty
table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import string
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, new_path, shuffle_partitions, written

#: A digest is heavy from this share of the rows on, so there are at most 1000 heavy digests, which may be broadcast.
HEAVY_SHARE = 1000
#: Repeated digests are broadcast up to this number (32 bytes each), and shuffled beyond it.
BROADCAST_DIGESTS = 500_000
#: Runs that a flush makes, and the fields of an entry of a run.
MEMTABLES = 4
_RUN = ("smallest", "largest", "n")
#: Blocks of a filter have as many bits as Spark's bitmaps; bits for each key, bits that a key sets, broadcast blocks (4 KB each).
BLOCK_BITS, KEY_BITS, PROBES, BROADCAST_BLOCKS = 32_768, 12, 4, 8_192


def normalised(text: Column) -> Column:
    """The text with A-Z lower-cased and nothing else changed; null is empty."""
    text = F.coalesce(text, F.lit(""))
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def sha256_bytes(text: Column) -> Column:
    return F.unhex(F.sha2(F.encode(text, "UTF-8"), 256))


class BloomFilter:
    """A blocked Bloom filter over the digests of a run: a row of bits per block."""

    def __init__(self, keys: DataFrame, digest: str = "digest"):
        self.n = keys.count()
        self.blocks = max(1, -(-self.n * KEY_BITS // BLOCK_BITS))
        bits = keys.select(self._block(F.col(digest)).alias("block"), F.explode(self._places(F.col(digest))).alias("place"))
        self.rows = written(bits.groupBy("block").agg(F.bitmap_construct_agg(F.col("place")).alias("bits")), "digest-filter")

    def _block(self, digest: Column) -> Column:
        return F.pmod(F.xxhash64(digest), F.lit(self.blocks))

    def _places(self, digest: Column) -> Column:
        return F.array(*(F.pmod(F.xxhash64(digest, F.lit(k)), F.lit(BLOCK_BITS)) for k in range(1, PROBES + 1)))

    def passed(self, rows: DataFrame, digest: str, as_: str) -> DataFrame:
        """The rows with a column that says whether their digest may be in the run."""
        block, bits = fresh(rows, "filter_block"), fresh(rows, "filter_bits")
        blocks = self.rows.select(F.col("block").alias(block), F.col("bits").alias(bits))
        if self.blocks <= BROADCAST_BLOCKS:
            blocks = F.broadcast(blocks)
        found = rows.withColumn(block, self._block(F.col(digest))).join(blocks, block, "left")
        byte = lambda p: F.conv(F.hex(F.substring(F.col(bits), F.shiftright(p, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        is_set = lambda p: F.getbit(byte(p), F.pmod(p, F.lit(8)).cast("int")) == 1
        return found.withColumn(as_, F.col(bits).isNotNull() & F.forall(self._places(F.col(digest)), is_set)).drop(block, bits)


class DigestLog:
    """The log of a table's digests: entries, sorted runs and their compaction, in the shared folder."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column]):
        self.spark, self.buckets, self.tables = docs.sparkSession, shuffle_partitions(docs.sparkSession), []
        rows = docs.select(F.col(id_col).alias("id"), digest(normalised(F.col(text_col))).alias("digest"))
        self.entries = written(rows.withColumn("memtable", F.pmod(F.spark_partition_id(), F.lit(MEMTABLES))), "digest-entries")

    def _run(self, df: DataFrame, *partitions: str) -> DataFrame:
        """A table of sorted runs: a file per bucket, its digests ascending."""
        name = f"digest_run_{uuid.uuid4().hex}"
        writer = df.write.bucketBy(self.buckets, "digest").sortBy("digest")
        (writer.partitionBy(*partitions) if partitions else writer).saveAsTable(name, path=new_path(self.spark, "digest-run"), format="parquet")
        self.tables.append(name)
        return self.spark.table(name)

    def flush(self) -> list[DataFrame]:
        """A sorted run of each memtable, all in one job."""
        each = self.entries.groupBy("memtable", "digest").agg(F.min("id").alias("smallest"), F.max("id").alias("largest"), F.count(F.lit(1)).alias("n"))
        runs = self._run(each.repartition(self.buckets, "digest"), "memtable")
        return [runs.where(F.col("memtable") == k).drop("memtable") for k in range(MEMTABLES)]

    def merged(self, one: DataFrame, other: DataFrame) -> DataFrame:
        """The sort-merge join of two runs, whose buckets meet where they are."""
        a, b = (run.select("digest", *(F.col(c).alias(f"{side}_{c}") for c in _RUN)) for side, run in (("a", one), ("b", other)))
        rows = a.hint("merge").join(b.hint("merge"), "digest", "full")
        n = F.coalesce("a_n", F.lit(0)) + F.coalesce("b_n", F.lit(0))
        return self._run(rows.select("digest", F.least("a_smallest", "b_smallest").alias("smallest"), F.greatest("a_largest", "b_largest").alias("largest"), n.alias("n")))

    def compacted(self) -> DataFrame:
        """One run of all memtables."""
        runs = self.flush()
        while len(runs) > 1:
            runs = [self.merged(*runs[k : k + 2]) if k + 1 < len(runs) else runs[k] for k in range(0, len(runs), 2)]
        return runs[0]

    def close(self) -> None:
        for name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.tables.clear()


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", digest: Callable[[Column], Column] = sha256_bytes) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, digest. `keep` is smallest or largest (identifier)."""
    log = DigestLog(docs, id_col, text_col, digest)
    repeated = written(log.compacted().where("n > 1").select("digest", F.col(keep).alias("keep_id"), F.col("n").alias("group_size")), "digest-repeated")
    log.close()
    entries = BloomFilter(repeated).passed(log.entries.select("id", "digest"), "digest", "maybe")
    total = log.entries.count()
    single = entries.where(~F.col("maybe")).select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "digest")
    probed = entries.where("maybe").drop("maybe")
    split = _collisions(docs, id_col, text_col, keep, digest, repeated)
    if split is not None:
        bad = split.select("digest").distinct()
        repeated = repeated.join(bad, "digest", "left_anti")
        probed = probed.join(bad, "digest", "left_anti")
    heavy = F.broadcast(repeated.where(F.col("group_size") > max(1, total // HEAVY_SHARE)))  # at most HEAVY_SHARE rows
    light = repeated.where(F.col("group_size") <= max(1, total // HEAVY_SHARE))
    hot = probed.join(heavy, "digest")
    rest = probed.join(heavy, "digest", "left_anti").join(light, "digest", "left")
    out = single.unionByName(hot.select("id", "keep_id", "group_size", "digest"))
    # Of those that passed the filter, a few are single.
    out = out.unionByName(rest.select("id", F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"), "digest"))
    if split is not None:
        out = out.unionByName(split.select("id", "keep_id", "group_size", "digest"))
    return out.select("id", "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest")


def _collisions(docs: DataFrame, id_col: str, text_col: str, keep: str, digest: Callable[[Column], Column], repeated: DataFrame) -> DataFrame | None:
    """Byte verification of all hits: rows of digests that stand for several texts, grouped by text; None if none do."""
    keys = repeated.select("digest")
    if repeated.count() <= BROADCAST_DIGESTS:
        keys = F.broadcast(keys)
    text = normalised(F.col(text_col))
    hits = docs.select(F.col(id_col).alias("id"), text.alias("text")).select("id", "text", digest(F.col("text")).alias("digest")).join(keys, "digest", "left_semi")
    # Copies collapse in the map-side aggregate, so that a hot group leaves one row per task.
    bad = hits.groupBy("digest").agg(F.min("text").alias("low"), F.max("text").alias("high")).where("low <> high").select("digest")
    bad = written(bad, "digest-collisions")
    if bad.isEmpty():
        return None
    rows = hits.join(bad, "digest", "left_semi")
    one = rows.groupBy("digest", "text").agg((F.min if keep == "smallest" else F.max)("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return rows.join(one, ["digest", "text"])


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """The documents less the copies, by identifier and text; columns stay as they are. Rows with a null identifier stay."""
    gone, digest, dropped_digest = fresh(docs, "dropped_id"), fresh(docs, "text_digest"), fresh(docs, "dropped_digest")
    dropped = exact_groups(docs, id_col, text_col, keep).where("not kept and id is not null")
    dropped = written(dropped.select(F.col("id").alias(gone), F.col("digest").alias(dropped_digest)).distinct(), "dropped")
    if dropped.count() <= BROADCAST_DIGESTS:  # 40 bytes each; else a shuffled join
        dropped = F.broadcast(dropped)
    rows = docs.withColumn(digest, sha256_bytes(normalised(F.col(text_col))))
    return rows.join(dropped, (rows[id_col] == dropped[gone]) & (rows[digest] == dropped[dropped_digest]), "left_anti").select(docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    out = exact_groups(table(spark, sf_dir, "documents"), keep="largest")
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""
