"""Best-fit packing by length-histogram planning.

Documents become token ids, cut into pieces of at most `capacity`; only (document, piece, length, checksum) goes on. The
driver gets the histogram of the lengths (at most `capacity` rows) and plans best-fit decreasing over counts: a step
places all pieces of one length into all sequences of one remaining room at once. A piece's rank within its length then
picks its slot of the plan. Ranks come from the running sums of counts by (length, task) and the rank within the task,
so no length is sorted in one task.

Defined results: a null or empty text is the end id alone; a null identifier stays null; repeated rows are packed each
on its own; an empty table gives an empty result. Extra columns are ignored. Very long texts are cut, never shortened.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ready, table, tidied, written

CAPACITY = 4096
END_ID = 1
#: Words in a generation of a worker's cache, which has two, and the longest word that is cached, in bytes.
CACHE_WORDS, CACHE_WORD_BYTES = 500_000, 64
#: A control character that stands between words that are encoded together, on its own between spaces.
_MARK = "\x01"
_CACHE: dict[str, tuple[object, int | None, list[dict[bytes, bytes]]]] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _opened(path: str) -> tuple[object, int | None, list[dict[bytes, bytes]]]:
    if path not in _CACHE:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        marks = tokenizer.encode(_MARK, add_special_tokens=False).ids
        _CACHE[path] = tokenizer, marks[0] if len(marks) == 1 else None, [{}, {}]
    return _CACHE[path]


def _encoded(words: list[bytes], tokenizer, mark: int | None) -> list[bytes]:
    """The packed ids of words without white space, each as if it stood alone."""
    plain = [mark is not None and b"\x01" not in w and b"<|" not in w for w in words]
    joined = f" {_MARK} ".join(w.decode("utf-8") for w, ok in zip(words, plain, strict=True) if ok)
    ids = np.asarray(tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, dtype="<u4")
    ends = np.append(np.flatnonzero(ids == mark) if mark is not None else [], len(ids)).astype(int).tolist()
    packed, at, out = ids.tobytes(), 0, []
    cuts = iter(ends)
    for w, ok in zip(words, plain, strict=True):
        if ok:
            end = next(cuts)
            out.append(packed[4 * at : 4 * end])
            at = end + 1
        else:
            out.append(np.asarray(tokenizer.encode(w.decode("utf-8"), add_special_tokens=False).ids, dtype="<u4").tobytes())
    return out


def packed_ids(texts: list[str | None], path: str, cache_words: int = CACHE_WORDS) -> list[bytes]:
    """The ids of each text as little-endian unsigned 32-bit integers.

    The tokenizer drops white space and never joins across it, so words between ASCII white space are encoded on their
    own, each distinct word once. When the young generation of the cache is full it becomes the old one; words that come
    up again move back, so frequent ones stay.
    """
    tokenizer, mark, generations = _opened(path)
    if len(generations[0]) > cache_words:
        generations[:] = {}, generations[0]
    cache, old = generations
    words = [(t or "").encode("utf-8").split() for t in texts]
    distinct = [w for w in set().union(*words) if w not in cache]
    cache.update((w, old[w]) for w in distinct if w in old)
    missing = [w for w in distinct if w not in cache]
    long: dict[bytes, bytes] = {}
    for at in range(0, len(missing), 500):
        some = missing[at : at + 500]
        for w, ids in zip(some, _encoded(some, tokenizer, mark), strict=True):
            (cache if len(w) <= CACHE_WORD_BYTES else long)[w] = ids
    if long:
        return [b"".join([cache[w] if w in cache else long[w] for w in ws]) for ws in words]
    get = cache.__getitem__
    return [b"".join(map(get, ws)) for ws in words]


def _cut(batches: Iterator[pa.RecordBatch], path: str, capacity: int, end_id: int, cache_words: int) -> Iterator[pa.RecordBatch]:
    end, task, width = np.uint32(end_id).tobytes(), TaskContext.get().partitionId(), 4 * capacity
    ranks = np.zeros(capacity + 1, np.int64)
    for batch in batches:
        rows, texts = [], batch.column(1).to_pylist()
        for k, ids in enumerate(packed_ids(texts, path, cache_words)):
            ids += end
            for n, at in enumerate(range(0, len(ids), width)):
                piece = ids[at : at + width]
                size = len(piece) // 4
                rows.append((k, n, at // 4, size, zlib.crc32(piece), ranks[size]))
                ranks[size] += 1
        columns = list(zip(*rows, strict=True)) or [()] * 6
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(columns[0], pa.int64())), pa.array(columns[1], pa.int32()), *(pa.array(columns[j], pa.int64()) for j in (2, 3, 4)), pa.array([task] * len(rows), pa.int32()), pa.array(columns[5], pa.int64())],
            names=["id", "piece", "start", "length", "ids_crc32", "task", "rank"],
        )


def plan(histogram: dict[int, int], capacity: int) -> np.ndarray:
    """Best-fit decreasing over counts. Rows: length, first rank, sequence of it, pieces in each sequence, offset.

    Ranks first..(next row's first - 1) of the length go to consecutive sequences.
    """
    out, opened = [], 0
    rooms: list[int] = []  # sorted; rooms that some sequence has left
    held: dict[int, list[tuple[int, int]]] = {}  # room -> runs of sequences (first, count)

    def put(room: int, run: tuple[int, int]) -> None:
        if room not in held:
            held[room] = []
            insort(rooms, room)
        held[room].append(run)

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, count = held[room].pop()
                if not held[room]:
                    del held[room]
                    rooms.pop(at)
                # Best fit returns to a sequence as long as it has room for one more piece.
                each = min(room // length, left)
                used = min(count, left // each)
                if count > used:
                    put(room, (first + used, count - used))
            else:
                room, first, each = capacity, opened, min(capacity // length, left)
                used = left // each
                opened += used
            out.append((length, rank, first, each, capacity - room))
            if room > each * length:
                put(room - each * length, (first, used))
            rank += used * each
            left -= used * each
    return np.array(sorted(out), dtype=np.int64).reshape(-1, 5)


def _place(batches: Iterator[pa.RecordBatch], steps, capacity: int) -> Iterator[pa.RecordBatch]:
    rows = steps.value
    span = int(rows[:, 1].max(initial=0)) + 2
    for batch in batches:
        names = batch.schema.names
        length, rank = (batch.column(names.index(n)).to_numpy(zero_copy_only=False) for n in ("length", "rank"))
        # Rows are sorted by (length, first rank); compare both as one number, with ranks beyond the last step's clipped.
        at = np.searchsorted(rows[:, 0] * span + rows[:, 1], length * span + np.minimum(rank, span - 1), side="right") - 1
        _, first, sequence, each, offset = rows[at].T
        k = rank - first
        out = {"sequence_id": sequence + k // each, "offset": offset + k % each * length}
        yield pa.RecordBatch.from_arrays([*(batch.column(names.index(n)) for n in names[:5]), *map(pa.array, out.values())], names=[*names[:5], *out])


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, cache_words: int = CACHE_WORDS) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset. A smaller cache only costs time."""
    ready(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    cut = partial(_cut, path=tokenizer or default_tokenizer(), capacity=capacity, end_id=end_id, cache_words=cache_words)
    fields = f"id {kind}, piece int, start long, length long, ids_crc32 long"
    pieces = written(docs.select(id_col, text_col).mapInArrow(tidied(cut), f"{fields}, task int, rank long"), "pieces")
    counts = pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = pieces.join(counts.select("length", "task", before.alias("before")), ["length", "task"]).select("id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"))
    steps = docs.sparkSession.sparkContext.broadcast(plan(histogram, capacity))
    return ranked.mapInArrow(tidied(partial(_place, steps=steps, capacity=capacity)), f"{fields}, sequence_id long, offset long")


def query(spark, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
