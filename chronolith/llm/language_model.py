"""Scoring with a bigram model in a trie of Elias-Fano levels.

Training counts words by hash, then pairs of word numbers, packed by task and added up in hash shards; every pair is kept.
Each shard writes its part of the trie to the shared folder. Level one holds the words by hash: the leading bits are
implied by a pointer per few words, 32 more bits tell them apart, counts take a byte with longer ones aside, and back-off
weights are quantised. Level two holds, for the contexts of the shard, Elias-Fano pointers to their successors, the
successors themselves, made monotone by adding context rank x vocabulary, and 8-bit quantised log-probabilities. Scoring
memory-maps the levels and looks up each distinct pair of a block by an Elias-Fano search for its context and then, relative
to that, for the successor; a search reads one block of the upper part and a few lower parts, however large the level is. Every shard
has a file, also an empty one, so a file that is not there is an error and never reads as "no such pair".

p(w | c) = max(n(cw) - D, 0) / n(c) + b(c) p(w), where b(c) is the mass left over and p(w) = (n(w) + 1) / (N + V + 1). The
first word of a text has no context. Contexts with a large share of all words are spread over the shards by pair (those
with over `hot` words, a quarter of a shard's share unless given).

Defined results: a null or empty text is the end token alone; a null identifier counts as the empty string for the fold;
repeated rows get equal scores; with no training text all words are unknown and the model is uniform over one unknown
word; an empty table gives an empty result. Very long texts are scored whole, in pieces. Extra columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import chain, count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import elias_fano
from .common import new_path, ready, shuffle_partitions, table, tidied
from .store import get_arrays, put_arrays

END = b"\n"  # no word holds it
DISCOUNT = 0.75
#: Tokens that a task counts or scores at a time.
BLOCK_TOKENS = 1_000_000
#: Lowest back-off weight as log10, at the top of 16 bits.
_BACKOFF_FLOOR = -6.0
_MIX = np.uint64(0x9E3779B97F4A7C15)


def held_out(id_col: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(7)) == 2


def _tokens(texts: list[str | None], most: int) -> Iterator[tuple[np.ndarray, list[list[bytes]]]]:
    """(documents, their tokens), blocks of about `most` tokens; a document may go on in the next block."""
    docs, parts, total = [], [], 0
    for k, text in enumerate(texts):
        words = [*(text.encode("utf-8").lower().split() if text else []), END]
        for at in range(0, len(words), most):
            part = words[max(0, at - 1) : at + most]  # from the context on
            docs.append((k, at > 0))
            parts.append(part)
            total += len(part)
            if total >= most:
                yield np.array(docs), parts
                docs, parts, total = [], [], 0
    if parts:
        yield np.array(docs), parts


def _hashed(parts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct word hashes, ascending; number of each token among them; first place of each part)."""
    numbers: defaultdict[bytes, int] = defaultdict(count().__next__)
    sizes = np.array([len(p) for p in parts])
    which = np.fromiter(map(numbers.__getitem__, chain.from_iterable(parts)), np.int64, int(sizes.sum()))
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, numbers), np.uint64, len(numbers))
    distinct, rank = np.unique(h, return_inverse=True)
    return distinct, rank[which], np.concatenate([[0], np.cumsum(sizes)[:-1]])


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch], column: int, most: int) -> Iterator[tuple[np.ndarray, list[list[bytes]]]]:
    """Tokens of batches gathered until a block is full; documents are numbered over the block's batches by the caller."""
    texts: list[str | None] = []
    size = 0
    for batch in batches:
        for t in batch.column(column).to_pylist():
            texts.append(t)
            size += len(t or "") // 6
            if size >= most:
                yield from _tokens(texts, most)
                texts, size = [], 0
    if texts:
        yield from _tokens(texts, most)


# -- level one ------------------------------------------------------------------------------------------------------


def _count_words(batches: Iterator[pa.RecordBatch], buckets: int, most: int) -> Iterator[pa.RecordBatch]:
    for docs, parts in _blocks(batches, 0, most):
        distinct, which, first = _hashed(parts)
        counts = np.bincount(which, minlength=len(distinct))
        carried = first[docs[:, 1].astype(bool)]  # contexts that the block before has counted
        np.subtract.at(counts, which[carried], 1)
        to = _bucket(distinct, buckets)
        cuts = np.searchsorted(to, np.arange(buckets + 1))
        rows = [(b, distinct[lo:hi].tobytes(), counts[lo:hi].astype("<u4").tobytes()) for b, lo, hi in zip(range(buckets), cuts, cuts[1:], strict=False) if lo < hi]
        b, h, c = zip(*rows, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(h, pa.binary()), pa.array(c, pa.binary())], names=["bucket", "hashes", "counts"])


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = np.concatenate(keys), np.concatenate(counts).astype(np.int64)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else np.zeros(0, np.int64)


def _views(column: pa.ChunkedArray, kind: str) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), kind) for x in column]


def _write_words(group: pa.Table, root: str) -> pa.Table:
    b = group.column("bucket")[0].as_py()
    hashes, counts = _summed(_views(group.column("hashes"), "<u8"), _views(group.column("counts"), "<u4"))
    hashes, counts = hashes[counts > 0], counts[counts > 0]
    put_arrays(f"{root}/words-{b}", _level_one(hashes, counts))
    return pa.table({"bucket": pa.array([b], pa.int32()), "words": pa.array([len(hashes)], pa.int64()), "tokens": pa.array([int(counts.sum())], pa.int64()), "most": pa.array([int(counts.max(initial=0))], pa.int64())})


#: Words that share the leading bits of a hash, on average, and the count that stands for one in the table aside.
_SHARING, _LONG_COUNT = 4, 255


def _leading(hashes: np.ndarray, width: int) -> np.ndarray:
    """The leading bits as places that grow with the hash, and the 32 bits after them."""
    return (hashes >> np.uint64(64 - width)).astype(np.int64), (hashes << np.uint64(width) >> np.uint64(32)).astype(np.uint32)


def _level_one(hashes: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
    """The words of one bucket, ascending by hash: about 6 bytes each with its count."""
    lead = int(hashes[0] >> np.uint64(32)) if len(hashes) else 0
    span = (int(hashes[-1] >> np.uint64(32)) if len(hashes) else 0) - lead + 1
    # Leading bits such that a value of them has _SHARING words on average over the bucket's span of the hashes.
    width = int(np.clip(32 - (max(1, span * _SHARING // max(1, len(hashes)))).bit_length() + 1, 1, 32))
    head, low = _leading(hashes, width)
    base = int(head[0]) if len(head) else 0
    pointers = np.searchsorted(head - base, np.arange((int(head[-1]) if len(head) else 0) - base + 2))
    long = np.flatnonzero(counts >= _LONG_COUNT)
    return {"meta": np.array([width, base], np.int64), "pointers": pointers.astype(np.uint32), "low": low, "counts": np.minimum(counts, _LONG_COUNT).astype(np.uint8), "long": long.astype(np.uint32), "long_counts": counts[long].astype(np.int64)}


def _find_words(level: dict[str, np.ndarray], hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place (-1: not there) and count of each hash."""
    width, base = level["meta"].tolist()
    head, low = _leading(hashes, width)
    head -= base
    inside = (head >= 0) & (head < len(level["pointers"]) - 1)
    head = np.where(inside, head, 0)
    at, end = level["pointers"][head].astype(np.int64), np.where(inside, level["pointers"][head + 1], 0).astype(np.int64)
    place, open_ = np.full(len(hashes), -1, np.int64), np.arange(len(hashes))
    while len(open_ := open_[at[open_] < end[open_]]):
        same = level["low"][at[open_]] == low[open_]
        place[open_[same]] = at[open_[same]]
        open_ = open_[~same]
        at[open_] += 1
    counts = np.where(place >= 0, level["counts"][place], 0).astype(np.int64) if len(level["counts"]) else np.zeros(len(hashes), np.int64)
    many = np.flatnonzero(counts == _LONG_COUNT)
    counts[many] = level["long_counts"][np.searchsorted(level["long"], place[many])]
    return place, counts


_opened = lru_cache(maxsize=1024)(get_arrays)


class _Model:
    """The levels as a worker sees them."""

    def __init__(self, root: str, bases: list[int], buckets: int, shards: int, tokens: int, block_tokens: int = BLOCK_TOKENS, hot: int | None = None):
        self.root, self.bases, self.buckets, self.shards = root, bases, buckets, shards
        self.tokens, self.vocabulary = tokens, bases[-1]
        self.block_tokens = block_tokens
        self.hot = max(1000, tokens // (4 * shards)) if hot is None else hot

    def words(self, distinct: np.ndarray, backoff: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of ascending hashes: number (-1: unknown), count, log10 of the back-off weight."""
        ids, counts, weights = np.full(len(distinct), -1, np.int64), np.zeros(len(distinct), np.int64), np.zeros(len(distinct))
        cuts = np.searchsorted(_bucket(distinct, self.buckets), np.arange(self.buckets + 1))
        for b in range(self.buckets):
            lo, hi = cuts[b], cuts[b + 1]
            if lo == hi or self.bases[b] == self.bases[b + 1]:
                continue
            at, counts[lo:hi] = _find_words(_opened(f"{self.root}/words-{b}")[0], distinct[lo:hi])
            ids[lo:hi] = np.where(at >= 0, at + self.bases[b], -1)
            if backoff:
                weights[lo:hi] = np.where(at >= 0, _opened(f"{self.root}/backoff-{b}")[0]["weights"][at] * (_BACKOFF_FLOOR / 65535), 0.0)
        return ids, counts, weights

    def shard(self, contexts: np.ndarray, words: np.ndarray, counts: np.ndarray) -> np.ndarray:
        h = np.where(counts > self.hot, contexts.astype(np.uint64) * _MIX + words.astype(np.uint64), contexts.astype(np.uint64))
        h = (h ^ (h >> np.uint64(31))) * _MIX
        return _bucket(h ^ (h >> np.uint64(29)), self.shards)

    def pairs(self, contexts: np.ndarray, words: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """log10 p(word | context) of distinct pairs in ascending order; nan where the trie has none."""
        out = np.full(len(contexts), np.nan)
        to = self.shard(contexts, words, counts)
        order = np.argsort(to, kind="stable")
        cuts = np.searchsorted(to[order], np.arange(self.shards + 1))
        for s in range(self.shards):
            mine = order[cuts[s] : cuts[s + 1]]
            if len(mine):
                out[mine] = _successors(*_opened(f"{self.root}/pairs-{s}"), contexts[mine], words[mine])
        return out


def _successors(arrays: dict[str, np.ndarray], meta: dict, contexts: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Context-relative successor search."""
    out = np.full(len(contexts), np.nan)
    if not meta["pairs"]:
        return out
    level = _levels(arrays, meta)
    rank = level["contexts"].find(contexts)
    known = np.flatnonzero(rank >= 0)
    place = level["successors"].find(rank[known] * meta["vocabulary"] + words[known])
    hit = place >= 0
    out[known[hit]] = meta["low"] + arrays["codes"][place[hit]] * meta["step"]
    return out


def _levels(arrays: dict[str, np.ndarray], meta: dict) -> dict[str, elias_fano.Sequence]:
    n, pairs, size = meta["contexts"], meta["pairs"], meta["vocabulary"]
    shape = {"contexts": (n, size), "pointers": (n + 1, pairs + 1), "successors": (pairs, n * size)}
    return {name: elias_fano.Sequence({k: arrays[f"{name}.{k}"] for k in ("low", "high", "ones")}, *x) for name, x in shape.items()}


def successors(arrays: dict[str, np.ndarray], meta: dict, context: int) -> tuple[np.ndarray, np.ndarray]:
    """The words that follow a context in this shard, by number, and their log10 probabilities without back-off."""
    level = _levels(arrays, meta) if meta["pairs"] else None
    rank = int(level["contexts"].find(np.array([context]))[0]) if level else -1
    if rank < 0:
        return np.zeros(0, np.int64), np.zeros(0)
    first, last = level["pointers"].at(np.array([rank, rank + 1])).tolist()
    return level["successors"].at(np.arange(first, last)) - rank * meta["vocabulary"], meta["low"] + arrays["codes"][first:last] * meta["step"]


# -- level two ------------------------------------------------------------------------------------------------------


def _paired(model: _Model, parts: list[list[bytes]], backoff: bool) -> tuple:
    distinct, which, first = _hashed(parts)
    ids, counts, weights = model.words(distinct, backoff)
    inner = np.ones(len(which), bool)
    inner[first] = False
    return ids, counts, weights, which, first, np.flatnonzero(inner)


def _count_pairs(batches: Iterator[pa.RecordBatch], make) -> Iterator[pa.RecordBatch]:
    model = make()
    for _, parts in _blocks(batches, 0, model.block_tokens):
        ids, counts, _, which, _, inner = _paired(model, parts, False)
        c, w = which[inner - 1], which[inner]
        # Words are numbered by hash, as the block numbers them.
        keys, n = np.unique(c << 32 | w, return_counts=True)
        c, w = keys >> 32, keys & 0xFFFFFFFF
        own, c, w = counts[c], ids[c], ids[w]
        to = model.shard(c, w, own)
        order = np.argsort(to, kind="stable")
        cuts = np.searchsorted(to[order], np.arange(model.shards + 1))
        for lo in range(0, model.shards, 64):
            rows = []
            for s in range(lo, min(model.shards, lo + 64)):
                mine = order[cuts[s] : cuts[s + 1]]
                if len(mine):
                    heads, at = np.unique(c[mine], return_index=True)
                    rows.append((s, heads.astype("<u4").tobytes(), np.diff(np.append(at, len(mine))).astype("<u4").tobytes(), w[mine].astype("<u4").tobytes(), np.minimum(n[mine], 0xFFFFFFFF).astype("<u4").tobytes(), own[mine][at].astype("<i8").tobytes()))
            if rows:
                s, *columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(s, pa.int32()), *(pa.array(x, pa.binary()) for x in columns)], names=["shard", "heads", "sizes", "words", "counts", "totals"])


def _write_pairs(group: pa.Table, root: str, vocabulary: int, tokens: int) -> pa.Table:
    """Writes the shard's part of level two; returns the discounted mass that it keeps of each context."""
    s = group.column("shard")[0].as_py()
    heads, sizes, words, counts, totals = (_views(group.column(c), k) for c, k in (("heads", "<u4"), ("sizes", "<u4"), ("words", "<u4"), ("counts", "<u4"), ("totals", "<i8")))
    keys = [np.repeat(h.astype(np.uint64), k) << np.uint64(32) | w for h, k, w in zip(heads, sizes, words, strict=True)]
    keys, n = _summed(keys, counts)
    if not len(keys):
        put_arrays(f"{root}/pairs-{s}", {"codes": np.zeros(0, np.uint8)}, contexts=0, pairs=0, vocabulary=vocabulary, low=0.0, step=1.0)
        return pa.table({"contexts": pa.array([], pa.binary()), "masses": pa.array([], pa.binary())})
    c, w = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
    every, at = np.unique(np.concatenate(heads), return_index=True)
    total = np.concatenate(totals)[at]
    contexts, first = np.unique(c, return_index=True)
    pointers = np.append(first, len(c))
    rank = np.repeat(np.arange(len(contexts)), np.diff(pointers))
    share = (n - DISCOUNT) / total[np.searchsorted(every, c)]
    masses = np.add.reduceat(share, first)
    logs = np.log10(share)
    low = float(logs.min())
    step = max(1e-9, -low / 255)
    arrays = {"codes": np.clip(np.rint((logs - low) / step), 0, 255).astype(np.uint8)}
    for name, values, universe in (("contexts", contexts, vocabulary), ("pointers", pointers, len(c) + 1), ("successors", rank * vocabulary + w, len(contexts) * vocabulary)):
        arrays |= {f"{name}.{k}": v for k, v in elias_fano.encode(values, universe).items()}
    put_arrays(f"{root}/pairs-{s}", arrays, contexts=len(contexts), pairs=len(c), vocabulary=vocabulary, low=low, step=step)
    return pa.table({"contexts": pa.array([contexts.astype("<i8").tobytes()], pa.binary()), "masses": pa.array([masses.astype("<f8").tobytes()], pa.binary())})


def _by_bucket(batches: Iterator[pa.RecordBatch], bases: list[int]) -> Iterator[pa.RecordBatch]:
    edges = np.array(bases)
    for batch in batches:
        for contexts, masses in zip(_views(batch.column(0), "<i8"), _views(batch.column(1), "<f8"), strict=True):
            cuts = np.searchsorted(contexts, edges)
            rows = [(b, contexts[lo:hi].tobytes(), masses[lo:hi].tobytes()) for b, lo, hi in zip(range(len(bases) - 1), cuts, cuts[1:], strict=False) if lo < hi]
            if not rows:
                continue
            b, *columns = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), *(pa.array(x, pa.binary()) for x in columns)], names=["bucket", "contexts", "masses"])


def _write_backoff(group: pa.Table, root: str, bases: list[int]) -> pa.Table:
    b = group.column("bucket")[0].as_py()
    kept = np.zeros(bases[b + 1] - bases[b])
    for contexts, masses in zip(_views(group.column("contexts"), "<i8"), _views(group.column("masses"), "<f8"), strict=True):
        kept[contexts - bases[b]] += masses  # contexts are distinct within a shard
    left = np.log10(np.maximum(1 - kept, 10.0**_BACKOFF_FLOOR))
    put_arrays(f"{root}/backoff-{b}", {"weights": np.rint(left / _BACKOFF_FLOOR * 65535).astype(np.uint16)})
    return pa.table({"bucket": pa.array([b], pa.int32())})


def train(docs: DataFrame, text_col: str = "text", block_tokens: int = BLOCK_TOKENS, hot: int | None = None):
    """Builds the trie of the documents in the shared folder; returns a function that opens it on a worker."""
    spark = docs.sparkSession
    ready(spark)
    root, buckets = new_path(spark, "lm"), shuffle_partitions(spark)
    texts = docs.select(F.col(text_col).alias("text"))
    words = texts.mapInArrow(tidied(partial(_count_words, buckets=buckets, most=block_tokens)), "bucket int, hashes binary, counts binary")
    found = {r["bucket"]: r for r in words.groupBy("bucket").applyInArrow(lambda group: _write_words(group, root), "bucket int, words long, tokens long, most long").collect()}
    sizes = [found[b]["words"] if b in found else 0 for b in range(buckets)]
    bases = [0, *np.cumsum(sizes).tolist()]
    tokens = sum(r["tokens"] for r in found.values())
    if bases[-1] >= 1 << 32:
        raise ValueError("the trie numbers words with 32 bits")
    make = partial(_Model, root, bases, buckets, buckets, tokens, block_tokens, hot)
    if tokens:
        vocabulary = bases[-1]
        pairs = texts.mapInArrow(tidied(partial(_count_pairs, make=make)), "shard int, heads binary, sizes binary, words binary, counts binary, totals binary")
        # A row without a pair for each shard, and below for each bucket, so that all have a file.
        pairs = pairs.unionByName(spark.range(0, buckets, 1, 1).select(F.col("id").cast("int").alias("shard"), *(F.lit(b"").alias(c) for c in ("heads", "sizes", "words", "counts", "totals"))))
        masses = pairs.groupBy("shard").applyInArrow(lambda group: _write_pairs(group, root, vocabulary, tokens), "contexts binary, masses binary")
        rows = masses.mapInArrow(tidied(partial(_by_bucket, bases=bases)), "bucket int, contexts binary, masses binary")
        rows = rows.unionByName(spark.range(0, buckets, 1, 1).select(F.col("id").cast("int").alias("bucket"), F.lit(b"").alias("contexts"), F.lit(b"").alias("masses")))
        rows.groupBy("bucket").applyInArrow(lambda group: _write_backoff(group, root, bases), "bucket int").collect()
    return make


# -- scoring --------------------------------------------------------------------------------------------------------


def _score_texts(texts: list[str | None], model: _Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: tokens, known tokens, base score, score."""
    out = np.zeros((4, len(texts)))
    scale = np.log10(model.tokens + model.vocabulary + 1)
    for docs, parts in _tokens(texts, model.block_tokens):
        ids, counts, weights, which, first, inner = _paired(model, parts, True)
        unigram = np.log10(counts + 1.0) - scale
        logs = unigram[which].copy()
        c, w = which[inner - 1], which[inner]
        logs[inner] += weights[c]
        often = np.flatnonzero((counts[c] > 0) & (counts[w] > 0))
        if len(often):
            keys, back = np.unique(c[often] << 32 | w[often], return_inverse=True)
            kc, kw = keys >> 32, keys & 0xFFFFFFFF
            found = model.pairs(ids[kc], ids[kw], counts[kc])
            both = np.log10(10.0**found + 10.0 ** (weights[kc] + unigram[kw]))[back]
            seen = ~np.isnan(both)
            logs[inner[often[seen]]] = both[seen]
        fresh = np.ones(len(which))
        fresh[first[docs[:, 1].astype(bool)]] = 0  # contexts carried over
        of = docs[:, 0]
        for row, values in enumerate((fresh, fresh * (counts[which] > 0), fresh * unigram[which], fresh * logs)):
            np.add.at(out[row], of, np.add.reduceat(values, first))
    return out[0].astype(np.int64), out[1].astype(np.int64), out[2], out[3]


def _score(batches: Iterator[pa.RecordBatch], make) -> Iterator[pa.RecordBatch]:
    model = make()
    kept: list[pa.RecordBatch] = []
    size = 0

    def done() -> pa.RecordBatch:
        rows = pa.Table.from_batches(kept).combine_chunks()
        n, known, base, score = _score_texts(rows.column("text").to_pylist(), model)
        columns = [rows.column("id").combine_chunks(), rows.column("held_out").combine_chunks(), pa.array(n), pa.array(known), pa.array(np.full(len(n), model.tokens)), pa.array(base), pa.array(score)]
        return pa.RecordBatch.from_arrays([x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in columns], names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    for batch in batches:
        kept.append(batch)
        size += batch.nbytes // 6
        if size >= model.block_tokens:
            yield done()
            kept, size = [], 0
    if kept:
        yield done()


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    make = train(docs.where(~held_out(F.col(id_col))), text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(tidied(partial(_score, make=make)), f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def query(spark, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
