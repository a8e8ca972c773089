"""N-gram Jaccard self-join with prefix filters under several global token orders, and the components of its links.

A document's set holds the 64-bit hashes of its distinct n-word shingles; equal sets are one node. A pair with Jaccard
similarity t shares, under ANY global order of the tokens, a token among the first |x| - ceil(t|x|) + 1 of both sets.

1. Counting. Tasks pack tokens into blocks and send each block's tokens to hash buckets; a bucket counts in how many
   sets a token is and sends repeated tokens back to their blocks. A set with fewer than ceil(t|x|) repeated tokens has no
   partner and leaves. Single tokens never travel again: they stand first in every order and cannot match.
2. Stars. Under the first order (rarest token first) an inverted index lists the sets that share a prefix token. Each
   set is held against one pivot, the fullest common set of most of its lists, so a group of k near copies costs k
   verifications. Only pairs that share a prefix token under two further orders too (rarity classes with keyed hashes)
   are verified; links make components.
3. Rest. Only pairs across components remain. At the first prefix token that two sets share, everything they have in
   common comes at or after it, so with the list's pivot p the overlap is at most min(|x & p|, |y & p|) + min(|x - p|,
   |y - p|) from there on; pairs that cannot reach t go. What is left must also share prefix tokens under the further
   orders, and is then verified. No pair of linked sets is lost, and none is capped.
4. Number of links. Every link is within a component, so each component's sets meet in cells of two blocks of sets, large
   components cut by size and hash. Pairs of a cell that share a prefix token under all three orders are verified, and
   every set gets the number of rows that it is linked with, its own copies included.

Defined results: without words or text the set is empty, n_shingles is 0 and the document is linked with nothing; with
fewer than n words the whole sequence is one shingle; very long texts count whole; a null identifier stays null and never
names a component; identifiers may be numbers or texts, and rows of one identifier with different texts are documents of
their own; repeated rows are linked; an empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, ready, release_memory, shuffle_partitions, table, tidied, written
from .components import components

SHINGLE, PERCENT = 5, 75
#: Tokens that a task packs at a time, and hash buckets for each shuffle partition.
BLOCK_TOKENS, BUCKETS_PER_PARTITION = 1_000_000, 3
#: Compressed bytes of input for each hash bucket, where that makes more buckets (about three times as much in memory).
BUCKET_BYTES = 16 << 20
#: Sets and tokens in a block of a component; columns of a cell's matrices at a time.
BLOCK_SETS, CELL_TOKENS, CELL_COLUMNS = 512, 500_000, 4096
#: Copies of one set are heavy from this share of the rows on: at most so many sets, which may be broadcast.
HEAVY_SHARE = 1000
_LOW = np.uint64((1 << 56) - 1)
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Keys of the second and third order.
_ORDER_KEYS = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def token_sets(texts: list[str | None], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, hashes): the distinct shingle hashes of text k, ascending, at offsets[k]:offsets[k + 1]."""
    words = [t.encode("utf-8").lower().split() if t else [] for t in texts]
    counts = np.array([len(w) for w in words], dtype=np.int64)
    codes = {w: xxhash.xxh3_64_intdigest(w) for w in set().union(*words)}
    get = codes.__getitem__
    h = np.fromiter((get(w) for ws in words for w in ws), np.uint64, int(counts.sum()))
    doc = np.repeat(np.arange(len(texts)), counts)
    ends = np.cumsum(counts)
    # A window starts wherever `size` words follow; of a shorter text, at its first word.
    reach = np.minimum(counts, size)
    place = np.arange(len(h))
    start = place + reach[doc] <= ends[doc]
    short = counts[doc] < size
    start &= ~short | (place == (ends - counts)[doc])
    at = place[start]
    own = doc[start]
    acc = np.full(len(at), 0x51_7C_C1_B7, np.uint64)
    for k in range(size):
        step = k < reach[own]
        acc = np.where(step, _mixed((acc + h[np.minimum(at + k, max(0, len(h) - 1))]) * _ODD) if len(h) else acc, acc)
    acc = _mixed(acc + reach[own].astype(np.uint64))
    order = np.lexsort((acc, own))
    acc, own = acc[order], own[order]
    first = np.ones(len(acc), bool)
    first[1:] = (acc[1:] != acc[:-1]) | (own[1:] != own[:-1])
    acc, own = acc[first], own[first]
    return np.concatenate([[0], np.cumsum(np.bincount(own, minlength=len(texts)))]), acc


_ARROW = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}


def _schemas(fields: str) -> Callable[[pa.DataType], pa.Schema]:
    """The Arrow schema of the fields for a type of `id`."""
    pairs = [f.split() for f in fields.split(", ")]
    return lambda kind: pa.schema([(name, kind if name == "id" else _ARROW[t]) for name, t in pairs])


#: What blocks send to buckets, buckets to blocks, and the sets; ID stands for the type of the identifiers, key for the row's text.
_PACKED = "bucket int, block long, id ID, key long, place int, digest binary, n long, counts binary, tokens binary"
_SENT = "block long, id ID, key long, place int, digest binary, n long, docs binary, tokens binary, dfs binary"
_SETS = "id ID, key long, digest binary, n long, tokens binary, dfs binary"
_packed_schema, _sent_schema, _sets_schema = map(_schemas, (_PACKED, _SENT, _SETS))


def _rows(schema: pa.Schema, size: int, **columns) -> pa.RecordBatch:
    """A batch in which columns that are not given are null."""
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in schema], schema=schema)


def _pack(batches: Iterator[pa.RecordBatch], size: int, buckets: int, block_tokens: int) -> Iterator[pa.RecordBatch]:
    """A row per document (its block, place in the block, digest, set size) and a row per block and bucket (its tokens)."""
    task, made = TaskContext.get().partitionId(), 0
    schema = _packed_schema(pa.int64())
    seen: dict[bytes, int] = {}
    sets: list[np.ndarray] = []
    total = 0

    def block() -> int:
        return (task << 24) + made

    def packed() -> Iterator[pa.RecordBatch]:
        m = len(sets)
        tokens, doc = np.concatenate(sets), np.repeat(np.arange(m), [len(s) for s in sets])
        to = ((tokens >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        cuts = np.concatenate([[0], np.cumsum(np.bincount(to, minlength=buckets))])
        tokens, doc = tokens[order], doc[order]
        for lo in range(0, buckets, 64):
            rows = [(b, np.bincount(doc[cuts[b] : cuts[b + 1]], minlength=m).astype("<u4").tobytes(), tokens[cuts[b] : cuts[b + 1]].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7].tobytes()) for b in range(lo, min(buckets, lo + 64)) if cuts[b] < cuts[b + 1]]
            if rows:
                b, counts, parts = zip(*rows, strict=True)
                yield _rows(schema, len(b), bucket=b, block=[block()] * len(b), counts=counts, tokens=parts)

    for batch in batches:
        schema = _packed_schema(batch.schema.field(0).type)
        offsets, tokens = token_sets(batch.column(1).to_pylist(), size)
        places, digests = [], []
        for k in range(batch.num_rows):
            own = tokens[offsets[k] : offsets[k + 1]]
            digest = hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None
            if digest is not None and digest not in seen:
                seen[digest] = len(sets)
                sets.append(own)
                total += len(own)
                places.append(seen[digest])
            else:  # a copy within the block, or an empty set
                places.append(None)
            digests.append(digest)
        yield _rows(schema, batch.num_rows, bucket=[xxhash.xxh32_intdigest(str(block())) % buckets] * batch.num_rows, block=[block()] * batch.num_rows, id=batch.column(0), key=batch.column(2), place=places, digest=digests, n=np.diff(offsets))
        if total >= block_tokens:
            yield from packed()
            seen, sets, total, made = {}, [], 0, made + 1
    if sets:
        yield from packed()


def _count(group: pa.Table) -> pa.Table:
    """Of one bucket: the tokens that several sets have, sent back to each block with the number of sets."""
    whole = group.column("tokens").is_null()
    docs = group.filter(whole).select(["block", "id", "key", "place", "digest", "n"])
    schema = _sent_schema(group.schema.field("id").type)
    out = [_rows(schema, docs.num_rows, **{c: docs.column(c).combine_chunks() for c in docs.column_names})]
    rows = group.filter(pc.invert(whole))
    if rows.num_rows:
        top = np.uint64(group.column("bucket")[0].as_py() % 256) << np.uint64(56)
        parts, docs_of = [], []
        for counts, packed in zip(rows.column("counts"), rows.column("tokens"), strict=True):
            raw = np.frombuffer(packed.as_buffer(), np.uint8).reshape(-1, 7)
            full = np.zeros((len(raw), 8), np.uint8)
            full[:, :7] = raw
            parts.append(full.view("<u8").ravel())
            each = np.frombuffer(counts.as_buffer(), "<u4")
            docs_of.append(np.repeat(np.arange(len(each), dtype=np.uint32), each))
        tokens = np.concatenate(parts)
        order = np.argsort(tokens, kind="stable")
        ranked = tokens[order]
        new = np.ones(len(ranked), bool)
        new[1:] = ranked[1:] != ranked[:-1]
        group_of = np.cumsum(new) - 1
        df = np.empty(len(tokens), np.uint32)
        df[order] = np.bincount(group_of)[group_of]
        at = 0
        found = []
        for block, part, own in zip(rows.column("block").to_pylist(), parts, docs_of, strict=True):
            own_df = df[at : at + len(part)]
            at += len(part)
            keep = own_df > 1
            if keep.any():
                found.append((block, own[keep].tobytes(), (part[keep] | top).astype("<u8").tobytes(), own_df[keep].tobytes()))
        if found:
            block, docs_, tokens_, dfs = zip(*found, strict=True)
            out.append(_rows(schema, len(found), block=block, docs=docs_, tokens=tokens_, dfs=dfs))
    return pa.Table.from_batches(out, schema=schema)


def _needed(n, percent: int):
    """The least overlap of a set of n tokens with any partner: ceil(n * percent / 100)."""
    return -(-n * percent // 100)


def _gather(group: pa.Table, percent: int) -> pa.Table:
    """Of one block: each document, with its repeated tokens, rarest first, if it has enough of them for a partner."""
    docs = group.filter(group.column("tokens").is_null())
    rows = group.filter(group.column("tokens").is_valid())
    cat = lambda c, t: np.concatenate([np.frombuffer(x.as_buffer(), t) for x in rows.column(c)]) if rows.num_rows else np.zeros(0, t)
    of, tokens, dfs = cat("docs", "<u4").astype(np.int64), cat("tokens", "<u8"), cat("dfs", "<u4")
    places, sizes = docs.column("place").to_pylist(), docs.column("n").to_pylist()
    m = max([0, *(p + 1 for p in places if p is not None)])
    have = np.bincount(of, minlength=m)
    size_at = np.zeros(m, np.int64)
    for p, n in zip(places, sizes, strict=True):
        if p is not None:
            size_at[p] = n
    good = have[:m] >= _needed(size_at, percent) if m else np.zeros(0, bool)
    keep = good[of] if m else np.zeros(0, bool)
    of, tokens, dfs = of[keep], tokens[keep], dfs[keep]
    order = np.lexsort((tokens, dfs, of))
    of, tokens, dfs = of[order], tokens[order], dfs[order]
    cuts = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=m))])
    some = [p is not None and bool(good[p]) for p in places]
    cut = lambda x: [x[cuts[p] : cuts[p + 1]].tobytes() if ok else None for p, ok in zip(places, some, strict=True)]
    return pa.Table.from_batches([_rows(_sets_schema(group.schema.field("id").type), docs.num_rows, id=docs.column("id").combine_chunks(), key=docs.column("key").combine_chunks(), digest=docs.column("digest").combine_chunks(), n=sizes, tokens=cut(tokens), dfs=cut(dfs))])


def _prefix(n: int, have: int, percent: int) -> int:
    """How many of the repeated tokens are in the prefix; the n - have single ones stand before them."""
    return n - _needed(n, percent) + 1 - (n - have)


def _list(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Postings: a row per prefix token under the first order."""
    for batch in batches:
        digests, sizes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        parts, owner, full = [], [], []
        for k, (n, tokens, dfs) in enumerate(zip(sizes, batch.column(2), batch.column(3), strict=True)):
            own, df = np.frombuffer(tokens.as_buffer(), "<u8"), np.frombuffer(dfs.as_buffer(), "<u4")
            part = own[: _prefix(n, len(own), percent)]
            parts.append(part)
            owner.append(np.full(len(part), k))
            full.append(float(np.log2(df).sum() / n))
        if parts:
            owner = np.concatenate(owner)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(parts).astype("<i8") if len(owner) else [], pa.int64()), pa.array(digests, pa.binary()).take(pa.array(owner)), pa.array(np.array(full)[owner])], names=["token", "digest", "fullness"])


def _sorted_in(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which of x are in the ascending y."""
    if not len(y):
        return np.zeros(len(x), bool)
    return y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x


def _linked(overlap, n, m, percent: int):
    return 100 * overlap >= percent * (n + m - overlap)


def _under(tokens: np.ndarray, dfs: np.ndarray, prefix: int, key: np.uint64) -> np.ndarray:
    """The prefix under another order, ascending by token."""
    order = np.lexsort((_mixed(tokens * key), np.log2(dfs).astype(int)))
    return np.sort(tokens[order[:prefix]])


class _Opened:
    """Sets of a batch by digest: ascending tokens, and the prefixes under the further orders when they are asked for."""

    def __init__(self, percent: int):
        self.percent, self.memo = percent, {}

    def __call__(self, digest: bytes, n: int, tokens: pa.Scalar, dfs: pa.Scalar) -> tuple[np.ndarray, Callable[[], list[np.ndarray]]]:
        if digest not in self.memo:
            own, df = np.frombuffer(tokens.as_buffer(), "<u8"), np.frombuffer(dfs.as_buffer(), "<u4")
            self.memo[digest] = np.sort(own), lru_cache(1)(lambda: [_under(own, df, _prefix(n, len(own), self.percent), key) for key in _ORDER_KEYS])
        return self.memo[digest]


def _shares(one: tuple, other: tuple) -> bool:
    """Whether two opened sets share a prefix token under each further order."""
    return all(_sorted_in(p, q).any() for p, q in zip(one[1](), other[1](), strict=True))


def _stars(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """A row per prefix token: common and further tokens with the pivot from there on, and whether they are linked."""
    names = ["token", "digest", "n", "pivot", "common", "further", "linked"]
    for batch in batches:
        columns: list[list] = [[], [], []]
        owner, linked, opened = [], [], _Opened(percent)
        digests, sizes, pivots, pivot_sizes = (batch.column(j).to_pylist() for j in (0, 1, 4, 5))
        for k, (digest, n, pivot, m) in enumerate(zip(digests, sizes, pivots, pivot_sizes, strict=True)):
            own = np.frombuffer(batch.column(2)[k].as_buffer(), "<u8")
            x, y = opened(digest, n, batch.column(2)[k], batch.column(3)[k]), opened(pivot, m, batch.column(6)[k], batch.column(7)[k])
            both = _sorted_in(own, y[0])
            # The pair comes from a list of the first order; it is verified if the further orders let it pass.
            linked.append(pivot != digest and _shares(x, y) and bool(_linked(int(both.sum()), n, m, percent)))
            p = _prefix(n, len(own), percent)
            columns[0].append(own[:p].astype("<i8"))
            columns[1].append(np.cumsum(both[::-1])[::-1][:p])
            columns[2].append(np.cumsum(~both[::-1])[::-1][:p])
            owner.append(np.full(p, k))
        if owner:
            at = pa.array(np.concatenate(owner))
            cat = lambda j, t: pa.array(np.concatenate(columns[j]), t)
            yield pa.RecordBatch.from_arrays([cat(0, pa.int64()), pa.array(digests, pa.binary()).take(at), pa.array(sizes, pa.int64()).take(at), pa.array(pivots, pa.binary()).take(at), cat(1, pa.int64()), cat(2, pa.int64()), pa.array(linked).take(at)], names=names)


def _verify(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Of candidates of the first order, those that share a prefix token under each further order and are linked."""
    for batch in batches:
        keep, opened = [], _Opened(percent)
        c = [batch.column(j) for j in range(8)]
        for k in range(batch.num_rows):
            n, m = c[2][k].as_py(), c[5][k].as_py()
            x, y = opened(c[0][k].as_py(), n, c[3][k], c[4][k]), opened(c[1][k].as_py(), m, c[6][k], c[7][k])
            keep.append(_shares(x, y) and bool(_linked(int(_sorted_in(x[0], y[0]).sum()), n, m, percent)))
        yield pa.RecordBatch.from_arrays([c[0].filter(pa.array(keep, pa.bool_())), c[1].filter(pa.array(keep, pa.bool_()))], names=["a", "b"])


def _shared(xs: list[np.ndarray], ys: list[np.ndarray]) -> np.ndarray:
    """How many tokens each of xs has in common with each of ys."""
    out = np.zeros((len(xs), len(ys)), np.float32)
    x, y = np.concatenate(xs), np.concatenate(ys)
    common = np.intersect1d(x, y)
    if not len(common):
        return out
    places = []
    for tokens, parts in ((x, xs), (y, ys)):
        owner, kept = np.repeat(np.arange(len(parts)), [len(p) for p in parts]), _sorted_in(tokens, common)
        at = np.searchsorted(common, tokens[kept])
        order = np.argsort(at, kind="stable")
        places.append((owner[kept][order], at[order]))
    for lo in range(0, len(common), CELL_COLUMNS):
        width = min(CELL_COLUMNS, len(common) - lo)
        sides = []
        for (owner, at), size in zip(places, out.shape, strict=True):
            cut = slice(*np.searchsorted(at, [lo, lo + width]))
            side = np.zeros((size, width), np.float32)
            side[owner[cut], at[cut] - lo] = 1
            sides.append(side)
        out += sides[0] @ sides[1].T
    return out


def _cell(xs: list[tuple], ys: list[tuple] | None, percent: int) -> Iterator[tuple[bytes, int]]:
    """(digest, linked rows) of sets (digest, rows, n, tokens, dfs); within xs if ys is None."""
    same, ys = ys is None, xs if ys is None else ys
    if not xs or not ys or same and len(xs) < 2:
        return
    orders: list[list[list[np.ndarray]]] = [[], [], []]
    for k, side in enumerate((xs,) if same else (xs, ys)):
        for found in orders:
            found.append([])
        for _, _, n, tokens, dfs in side:
            p = _prefix(n, len(tokens), percent)
            for found, prefix in zip(orders, (tokens[:p], *(_under(tokens, dfs, p, key) for key in _ORDER_KEYS)), strict=True):
                found[k].append(prefix)
    near = np.ones((len(xs), len(ys)), bool)
    if same:
        np.fill_diagonal(near, False)
    for found in orders:
        if near.any():
            near &= _shared(found[0], found[-1]) > 0
    if near.any():
        n, m = (np.array([s[2] for s in side], np.int64) for side in (xs, ys))
        near &= _linked(_shared([s[3] for s in xs], [s[3] for s in ys]).astype(np.int64), n[:, None], m[None, :], percent)
    for side, other, links in ((xs, ys, near),) if same else ((xs, ys, near), (ys, xs, near.T)):
        for own, total in zip(side, (links @ np.array([s[1] for s in other], np.int64)).tolist(), strict=True):
            if total:
                yield own[0], total


def _cells(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by cell."""
    key, xs, ys, out = None, [], [], []

    def packed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([d for d, _ in out], pa.binary()), pa.array([t for _, t in out], pa.int64())], names=["digest", "links"])

    def done() -> None:
        if key is not None:
            out.extend(_cell(xs, None if key[1:3] == key[3:5] else ys, percent))

    for batch in batches:
        c = [column.to_pylist() for column in batch.columns[:9]]
        for k in range(batch.num_rows):
            here = tuple(column[k] for column in c[:5])
            if here != key:
                done()
                key, xs, ys = here, [], []
            own = (c[6][k], c[7][k], c[8][k], np.frombuffer(batch.column(9)[k].as_py(), "<u8"), np.frombuffer(batch.column(10)[k].as_py(), "<u4"))
            (ys if c[5][k] else xs).append(own)
        if len(out) > 10_000:
            yield packed()
            out.clear()
    done()
    yield packed()


def _counted(nodes: DataFrame, label: DataFrame, copies: DataFrame, percent: int) -> DataFrame:
    """(digest, links): with how many rows of other sets each set is linked."""
    sizes = nodes.select("digest", "n", F.expr("length(tokens) / 8").alias("have"))
    member = written(label.withColumnRenamed("node", "digest").join(copies.select("digest", "rows"), "digest").join(sizes, "digest"), "jaccard-members")
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_SETS, F.sum("have") / CELL_TOKENS))
    # Sizes of linked sets differ by 100 / percent at most, so bands that are wider than that meet only their neighbours.
    small = member.groupBy("root").agg((blocks == 1).alias("small"))
    banded = member.join(small, "root").withColumn("band", F.when(F.col("small"), 0).otherwise(F.floor(F.log(102.0 / percent, F.col("n")))).cast("int"))
    bands = written(banded.groupBy("root", "band").agg(blocks.cast("int").alias("blocks")), "jaccard-bands")
    above = bands.select("root", (F.col("band") - 1).alias("band"), F.col("blocks").alias("above"))
    below = bands.select("root", (F.col("band") + 1).alias("band"), F.col("blocks").alias("below"))
    placed = banded.join(bands.join(above, ["root", "band"], "left").join(below, ["root", "band"], "left"), ["root", "band"])
    placed = placed.withColumn("block", F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int"))
    band, block = F.col("band"), F.col("block")

    def cells(number: str, cell: Callable[[Column], tuple]) -> Column:
        others = F.filter(F.sequence(F.lit(0), F.coalesce(number, F.lit(0))), lambda k: k < F.coalesce(number, F.lit(0)))
        return F.transform(others, lambda k: F.struct(*(v.alias(f) for v, f in zip(cell(k), ("low", "i", "high", "j", "second"), strict=True))))

    own = cells("blocks", lambda k: (band, F.least(block, k), band, F.greatest(block, k), block > k))
    up = cells("above", lambda k: (band, block, band + 1, k, F.lit(False)))
    down = cells("below", lambda k: (band - 1, k, band, block, F.lit(True)))
    rows = placed.select("root", F.explode(F.concat(own, up, down)).alias("c"), "digest", "rows").select("root", "c.*", "digest", "rows").join(nodes, "digest")
    keys = ["root", "low", "i", "high", "j"]
    rows = rows.select(*keys, "second", "digest", "rows", "n", "tokens", "dfs").repartition(*keys).sortWithinPartitions(*keys)
    return rows.mapInArrow(tidied(partial(_cells, percent=percent)), "digest binary, links long").groupBy("digest").agg(F.sum("links").alias("links"))


def _buckets(docs: DataFrame) -> int:
    """Hash buckets by the session's partitions, and more where the input's size asks for them."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(BUCKETS_PER_PARTITION * shuffle_partitions(docs.sparkSession), size // BUCKET_BYTES if size < 1 << 56 else 0)


def linked_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT, block_tokens: int = BLOCK_TOKENS, count_links: bool = True) -> DataFrame:
    """One row per document: id, key (of its text), n_shingles, component_id (the smallest id that links reach), first
    (whether it is its component's smallest by id and key), digest, and n_links (with how many other rows it is linked)
    unless that is not asked for."""
    ready(docs.sparkSession)
    rows, buckets, kind = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("key")), _buckets(docs), docs.schema[id_col].dataType.simpleString()
    typed = lambda fields: fields.replace("ID", kind)
    packed = rows.mapInArrow(tidied(partial(_pack, size=size, buckets=buckets, block_tokens=block_tokens)), typed(_PACKED))

    def count(group: pa.Table) -> pa.Table:
        release_memory()  # of the group before
        return _count(group)

    def gather(group: pa.Table) -> pa.Table:
        release_memory()
        return _gather(group, percent)

    sent = packed.groupBy("bucket").applyInArrow(count, typed(_SENT))
    sets = written(sent.groupBy("block").applyInArrow(gather, typed(_SETS)), "jaccard-sets")

    nodes = written(sets.where("tokens is not null").groupBy("digest").agg(F.first("n").alias("n"), F.first("tokens").alias("tokens"), F.first("dfs").alias("dfs")), "jaccard-nodes")
    links = _links(nodes, percent)
    label = components(links, "a", "b")  # node, root
    return _named(sets, label, (lambda copies: _counted(nodes, label, copies, percent)) if count_links else None)


def _links(nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs of digests that connect all sets that links connect."""
    postings = nodes.mapInArrow(tidied(partial(_list, percent=percent)), "token long, digest binary, fullness double")
    pivots = postings.groupBy("token").agg(F.max(F.struct("fullness", "digest")).alias("top"), F.count(F.lit(1)).alias("listed")).where("listed > 1").select("token", "top")
    votes = postings.join(pivots, "token").groupBy("digest", F.col("top.digest").alias("pivot"), F.col("top.fullness").alias("fullness")).agg(F.count(F.lit(1)).alias("lists"))
    choice = votes.groupBy("digest").agg(F.max(F.struct("lists", "fullness", "pivot")).alias("best")).select("digest", "best.pivot")
    stars = written(_against(nodes, choice, percent), "jaccard-stars")

    # Lists in which all sets are linked to one pivot are done. In the others, each set is also held against the list's
    # most frequent pivot, so that all of a list's sets are known relative to one set. Long lists shrink by pivot first.
    near = F.when(F.col("linked"), F.col("pivot")).otherwise(F.col("digest"))
    by_pivot = stars.groupBy("token", "pivot").agg(F.count(F.lit(1)).alias("sets"), F.min(near).alias("low"), F.max(near).alias("high"))
    open_ = by_pivot.groupBy("token").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.max(F.struct("sets", "pivot")).alias("top")).where("low <> high")
    lists = written(stars.withColumnRenamed("pivot", "own").join(open_.select("token", "top.pivot"), "token"), "jaccard-lists")
    others = written(_against(nodes, lists.where("own <> pivot").select("digest", "pivot").distinct(), percent), "jaccard-stars")
    links = stars.where("linked").select("digest", "pivot").unionByName(others.where("linked").select("digest", "pivot"))
    first = written(links.select(F.col("digest").alias("a"), F.col("pivot").alias("b")).distinct(), "jaccard-links")

    # Only lists with sets of several components can add a link; the sets outside the list's main component probe it.
    root = components(first, "a", "b")
    columns = ["token", "digest", "n", "common", "further"]
    entries = lists.where("own = pivot").select(columns).unionByName(lists.where("own <> pivot").select("token", "digest", "pivot").join(others, ["token", "digest", "pivot"]).select(columns))
    entries = entries.join(root.withColumnRenamed("node", "digest"), "digest", "left").withColumn("root", F.coalesce("root", "digest"))
    entries = written(entries, "jaccard-entries")
    mixed = entries.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.max_by("root", F.struct("common", "n")).alias("main")).where("low <> high").select("token", "main")
    probed = written(entries.join(mixed, "token"), "jaccard-probed")  # so that the join below can split long lists
    x = probed.where("root <> main").select("token", *(F.col(c).alias(f"x_{c}") for c in ("digest", "n", "common", "further", "root")))
    y = probed.select("token", "main", *(F.col(c).alias(f"y_{c}") for c in ("digest", "n", "common", "further", "root")))
    most = F.least("x_common", "y_common") + F.least("x_further", "y_further")
    reach = 100 * most >= percent * (F.col("x_n") + F.col("y_n") - most)  # also bounds the ratio of the sizes
    once = (F.col("y_root") == F.col("main")) | (F.col("x_digest") < F.col("y_digest"))
    found = x.join(y, "token").where((F.col("x_root") != F.col("y_root")) & once & reach)
    found = written(found.select(F.least("x_digest", "y_digest").alias("a"), F.greatest("x_digest", "y_digest").alias("b")).distinct(), "jaccard-candidates")
    a = nodes.select(F.col("digest").alias("a"), F.col("n").alias("a_n"), F.col("tokens").alias("a_tokens"), F.col("dfs").alias("a_dfs"))
    b = nodes.select(F.col("digest").alias("b"), F.col("n").alias("b_n"), F.col("tokens").alias("b_tokens"), F.col("dfs").alias("b_dfs"))
    second = found.join(a, "a").join(b, "b").select("a", "b", "a_n", "a_tokens", "a_dfs", "b_n", "b_tokens", "b_dfs").mapInArrow(tidied(partial(_verify, percent=percent)), "a binary, b binary")
    return written(first.unionByName(second), "jaccard-links")


def _against(nodes: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Each set of the pairs (digest, pivot) held against the pivot, from each of its prefix tokens on."""
    left = nodes.join(pairs, "digest")
    right = nodes.select(F.col("digest").alias("pivot"), *(F.col(c).alias(f"pivot_{c}") for c in ("n", "tokens", "dfs")))
    rows = left.join(right, "pivot").select("digest", "n", "tokens", "dfs", "pivot", "pivot_n", "pivot_tokens", "pivot_dfs")
    return rows.mapInArrow(tidied(partial(_stars, percent=percent)), "token long, digest binary, n long, pivot binary, common long, further long, linked boolean")


def _named(sets: DataFrame, label: DataFrame, counted: Callable[[DataFrame], DataFrame] | None) -> DataFrame:
    """The component and number of links of each row, by its set; heavy sets are broadcast, so that a hot group is not one task's."""
    docs = sets.select("id", "key", "digest", F.col("n").alias("n_shingles"))
    named_by = F.when(F.col("id").isNotNull(), F.struct("id", "key"))
    copies = docs.where("digest is not null").groupBy("digest").agg(F.min(named_by).alias("least"), F.count(F.lit(1)).alias("rows"))
    rooted = copies.join(label.withColumnRenamed("node", "digest"), "digest", "left").withColumn("root", F.coalesce("root", "digest"))
    rooted = written(rooted, "jaccard-roots")
    least = rooted.groupBy("root").agg(F.min("least").alias("least"), F.sum("rows").alias("members")).where("members > 1").select("root", F.col("least.id").alias("component_id"), F.col("least.key").alias("least_key"))
    named = rooted.join(least, "root").select("digest", "component_id", "least_key", "rows")
    more = []
    if counted:
        named = named.join(counted(rooted), "digest", "left").withColumn("n_links", F.coalesce("links", F.lit(0)) + F.col("rows") - 1).drop("links")
        more = [F.coalesce("n_links", F.lit(0)).alias("n_links")]
    named = written(named, "jaccard-named")
    limit = max(1, rooted.agg(F.sum("rows")).first()[0] or 0) // HEAVY_SHARE
    heavy = F.broadcast(named.where(F.col("rows") > limit).drop("rows"))  # at most HEAVY_SHARE rows
    light = named.where(F.col("rows") <= limit).drop("rows")
    hot = docs.join(heavy, "digest")
    rest = docs.join(heavy, "digest", "left_anti").join(light, "digest", "left")
    every = hot.unionByName(rest)
    first = F.col("component_id").isNull() | F.col("id").isNull() | (F.col("id") == F.col("component_id")) & (F.col("key") == F.col("least_key"))
    return every.select("id", "key", "n_shingles", F.coalesce("component_id", "id").alias("component_id"), first.alias("first"), "digest", *more)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that are the first of their component, by identifier and text; columns stay as they are.

    Rows with a null identifier stay, and so do repeated rows of a document that stays.
    """
    gone, key, gone_key = fresh(docs, "linked_id"), fresh(docs, "text_key"), fresh(docs, "linked_key")
    dropped = linked_groups(docs, id_col, text_col, count_links=False).where("not first").select(F.col("id").alias(gone), F.col("key").alias(gone_key)).distinct()
    dropped = written(dropped, "jaccard-dropped")
    if dropped.count() <= 500_000:  # 16 bytes each; else a shuffled join
        dropped = F.broadcast(dropped)
    rows = docs.withColumn(key, F.xxhash64(text_col))
    return rows.join(dropped, (rows[id_col] == dropped[gone]) & (rows[key] == dropped[gone_key]), "left_anti").select(docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    """The columns that the SQL has; n_links is counted and written on the way."""
    return linked_groups(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
l AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id
  JOIN n p ON p.doc_id = a.doc_id JOIN n q ON q.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, p.n, q.n HAVING 100 * count(*) >= 75 * (p.n + q.n - count(*))),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, min(r.y)) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN r ON r.x = w.doc_id GROUP BY w.doc_id, n.n
"""
