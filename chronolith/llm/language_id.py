"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training adds up n-gram counts by language in numpy, one bounded vector per language and task; the smoothed
log-probability matrix (languages x BUCKETS, float32) is broadcast, and batches are scored by gathering its columns at
the n-grams' buckets and adding them up by document.

Defined results: a null text or one without a letter is `und` with score 0; so is every text when no labelled text has a
letter. A null identifier counts as the empty string for the fold. Very long texts are scored whole, in pieces. Of
languages that tie the first by name is taken. Repeated rows get equal results, an empty table an empty one; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, ready, table, tidied

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
SMOOTHING = 0.1
#: Languages in a block of the matrix (16 MB), which is one broadcast; batches go over all blocks.
BLOCK_LANGUAGES = 128
#: Labelled rows that training samples for each language at most (on average; the sample is drawn by a hash of the id).
ROWS_PER_LANGUAGE = 4000
UNKNOWN = "und"
_PIECE = 1 << 20
_LETTER: list[np.ndarray] = []


def _folded(text: str) -> np.ndarray:
    """Code points of the lower-cased text, with 0 for all but letters."""
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000))
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.where(_LETTER[0][points], points, 0).astype(np.uint32)


def _pieces(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(documents, first places, n-grams that begin, code points), about _PIECE code points at a time; n-grams at a cut appear once."""
    look = max(ORDERS) - 1
    docs, parts, total = [], [], 0
    for k, text in enumerate(texts):
        points = _folded(text) if text else np.zeros(0, np.uint32)
        if not points.any():
            continue
        for at in range(0, len(points), _PIECE):
            # The next piece starts with its own n-grams; those that begin here end in `look` further code points.
            part = points[at : at + _PIECE + look]
            docs.append((k, min(_PIECE, len(points) - at)))
            parts.append(part)
            total += len(part)
            if total >= _PIECE:
                yield _packed(docs, parts)
                docs, parts, total = [], [], 0
    if parts:
        yield _packed(docs, parts)


def _packed(docs: list[tuple[int, int]], parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(p) for p in parts])
    return np.array([k for k, _ in docs]), np.concatenate([[0], np.cumsum(sizes)[:-1]]), np.array([n for _, n in docs]), np.concatenate(parts)


def _buckets(starts: np.ndarray, counts: np.ndarray, points: np.ndarray) -> Iterator[np.ndarray]:
    """For each order, the bucket of the n-gram at each place; BUCKETS where none starts or it has no letter."""
    ends = np.append(starts[1:], len(points))
    place = np.arange(len(points))
    room = np.repeat(ends, ends - starts) - place
    own = place - np.repeat(starts, ends - starts) < np.repeat(counts, ends - starts)
    h = np.zeros(len(points), np.uint64)
    letter = np.zeros(len(points), bool)
    for n in range(1, max(ORDERS) + 1):
        shifted = np.zeros(len(points), np.uint64)
        shifted[: len(points) - n + 1] = points[n - 1 :]
        letter |= shifted > 0
        h = (h ^ (shifted + np.uint64(n))) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        if n in ORDERS:
            yield np.where(own & (room >= n) & letter, (h >> np.uint64(20)) % np.uint64(BUCKETS), BUCKETS).astype(np.int32)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per language of the task: the language and its packed bucket counts."""
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for docs, starts, counts, points in _pieces(texts):
            codes, names = np.unique([langs[k] for k in docs], return_inverse=True)
            of = np.repeat(names, np.diff(np.append(starts, len(points))))
            for ids in _buckets(starts, counts, points):
                both = np.bincount(of * (BUCKETS + 1) + ids, minlength=len(codes) * (BUCKETS + 1)).reshape(len(codes), -1)
                for code, row in zip(codes, both, strict=True):
                    sums[str(code)] = sums.get(str(code), 0) + row[:BUCKETS]
    if sums:
        yield pa.RecordBatch.from_pydict({"lang": list(sums), "counts": [v.astype(np.int64).tobytes() for v in sums.values()]})


def _add(group: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x, np.int64) for x in group.column("counts").to_pylist())
    return pa.table({"lang": [group.column("lang")[0].as_py()], "counts": pa.array([total.tobytes()], pa.binary())})


def train(labelled: DataFrame, id_col: str, text_col: str, lang_col: str) -> tuple[list[str], np.ndarray]:
    """Languages and their log-probabilities: a row per language, a column per bucket."""
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    seen = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("count"))
    limits = F.broadcast(seen.select("lang", F.least(F.lit(1.0), ROWS_PER_LANGUAGE / F.col("count")).alias("share")))  # a row per language
    # By text too, so that rows without an identifier are drawn each on its own.
    draw = F.pmod(F.xxhash64(F.coalesce("id", F.lit("")), F.when(F.col("id").isNull(), F.col("text"))), F.lit(1_000_000))
    drawn = rows.join(limits, "lang").where(draw < F.col("share") * 1_000_000).select("text", "lang")
    parts = drawn.mapInArrow(tidied(_count), "lang string, counts binary")
    found = sorted(parts.groupBy("lang").applyInArrow(_add, "lang string, counts binary").collect(), key=lambda r: r["lang"])
    if not found:
        return [], np.zeros((0, BUCKETS + 1), np.float32)
    out = np.zeros((len(found), BUCKETS + 1), np.float32)
    for row, r in zip(out, found, strict=True):
        counts = np.frombuffer(r["counts"], np.int64) + SMOOTHING
        row[:BUCKETS] = np.log(counts) - np.log(counts.sum())
    return [r["lang"] for r in found], out


def _broadcast(spark, matrix: np.ndarray) -> list:
    """The matrix in blocks of languages."""
    return [spark.sparkContext.broadcast(matrix[k : k + BLOCK_LANGUAGES]) for k in range(0, len(matrix), BLOCK_LANGUAGES)]


def _scorer(langs: list[str], blocks: list):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = [row for block in blocks for row in block.value]
        for batch in batches:
            texts = batch.column(batch.schema.names.index("_text")).to_pylist()
            sums, some, grams = np.zeros((len(langs), len(texts))), np.zeros(len(texts), bool), np.zeros(len(texts))
            if langs:
                for docs, starts, counts, points in _pieces(texts):
                    some[docs] = True
                    for ids in _buckets(starts, counts, points):
                        np.add.at(grams, docs, np.add.reduceat(ids < BUCKETS, starts, dtype=np.int64))
                        for k in range(len(langs)):
                            np.add.at(sums[k], docs, np.add.reduceat(m[k][ids], starts, dtype=np.float64))
            best = sums.argmax(axis=0) if langs else np.zeros(len(texts), int)
            top = sums.max(axis=0) if langs else np.zeros(len(texts))
            odds = 1 / np.exp(sums - top).sum(axis=0) if langs else np.zeros(len(texts))
            keep = [n for n in batch.schema.names if n != "_text"]
            pred = [langs[k] if ok else UNKNOWN for k, ok in zip(best, some, strict=True)]
            evidence = np.where(some, top / np.maximum(grams, 1) + np.log(BUCKETS), 0.0)
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.names.index(n)) for n in keep), pa.array(pred, pa.string()), pa.array(np.where(some, odds, 0.0)), pa.array(evidence)], names=[*keep, "lang_pred", "score", "evidence"])

    return score


def held_out(id_col: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def predicted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: id, held_out, lang_pred, score (the posterior), evidence (see `accepted`)."""
    ready(docs.sparkSession)
    langs, matrix = train(docs.where(~held_out(F.col(id_col))), id_col, text_col, lang_col)
    logs = _broadcast(docs.sparkSession, matrix)
    rows = docs.select(F.col(id_col).alias("id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("_text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(tidied(_scorer(langs, logs)), f"id {kind}, held_out boolean, lang_pred string, score double, evidence double")


def accepted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least_evidence: float = 0.0) -> DataFrame:
    """The documents whose language is recognised; a null language is filled in. Other columns stay as they are.

    The posterior of the best language is near 1 for any longer text, of whatever kind. The evidence does not saturate: the
    mean log-likelihood ratio of an n-gram between the best language and a uniform one. Texts that are no likelier in any
    learned language than as random n-grams are not recognised.
    """
    ready(docs.sparkSession)
    langs, matrix = train(docs.where(~held_out(F.col(id_col))), id_col, text_col, lang_col)
    pred, evidence = fresh(docs, "lang_pred"), fresh(docs, "evidence")
    run = _scorer(langs, _broadcast(docs.sparkSession, matrix))

    def score_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(batch.schema.names.index(text_col))
            (out,) = run([pa.RecordBatch.from_arrays([text], names=["_text"])])
            yield pa.RecordBatch.from_arrays([*batch.columns, out.column(0), out.column(2)], names=[*batch.schema.names, pred, evidence])

    schema = docs.limit(0).withColumn(pred, F.lit("")).withColumn(evidence, F.lit(0.0)).schema
    rows = docs.mapInArrow(tidied(score_rows), schema)
    good = rows.where((F.col(pred) != UNKNOWN) & (F.col(evidence) > least_evidence))
    return good.withColumn(lang_col, F.coalesce(lang_col, pred)).select(docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    return predicted(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
