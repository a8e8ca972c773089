"""SentencePiece BPE encoding with seeded merge dropout, and exact decoding.

The vocabulary and scores come from a public model file; the merges are done here. A text's symbols are its characters;
an agenda holds the merges of neighbours, best score first and leftmost among equals. Each candidate that comes up is
skipped if its keyed hash falls below the dropout rate, and comes back only if a neighbour changes, so segmentations vary
by seed, document and place, and the same seed always gives the same ids. At rate 0 the ids equal the model's own.

Merges stay within stretches of spaces and what follows them, and a line feed or a literal U+2581 stands alone; a model
with pieces that say otherwise is refused. Each occurrence of a stretch has a key of its own, hashed from seed, document
and place. The agendas of many stretches run side by side: a step takes the best candidate of each row of a matrix. The
candidates of the path without any skip are held per stretch, so that one vectorised pass draws them for all
occurrences, and only occurrences with a skip run an agenda of their own. What is held is a cache: an occurrence's
segmentation depends on its key alone.

Defined results: a null or empty text has no ids and decodes to the empty text; the model is one with byte fallback,
identity normalisation and a dummy space in front; characters outside the vocabulary, and U+2581 itself, become bytes;
very long texts are encoded whole. Among equal scores the leftmost merge comes first. Repeated rows get equal ids, an
empty table an empty result; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready, table, tidied

SEED, DROPOUT = 20240601, 0.1
#: Stretches that a worker holds, the longest one that is held or goes into a matrix, in characters, and rows of a matrix.
CACHE_STRETCHES, SHORT, ROWS = 1_200_000, 40, 16_384
_SPACE = "▁"
_STRETCH = re.compile(r"[^ ]+| +[^ ]*")
_BARRIER = re.compile(f"([\n{_SPACE}])")
_MASK = (1 << 64) - 1
_NONE = (1 << 31) - 1
#: Bits of a symbol: a piece, or beyond the pieces a character.
_SYMBOL = 21
_OPEN: dict[tuple, Codec] = {}


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@dataclass
class Codec:
    path: str
    seed: int = SEED
    dropout: float = DROPOUT
    ids: dict[str, int] = field(default_factory=dict)
    rank: dict[str, int] = field(default_factory=dict)
    packed_id: dict[str, bytes] = field(default_factory=dict)
    surface: list[bytes] = field(default_factory=list)
    byte: list[bytes] = field(default_factory=list)

    def __post_init__(self) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=self.path)
        self.byte = [b""] * 256
        scores = []
        for k in range(model.get_piece_size()):
            piece = model.id_to_piece(k)
            self.surface.append(b"")
            if model.is_byte(k):
                value = int(piece[3:5], 16)
                self.surface[k], self.byte[value] = bytes([value]), np.uint32(k).tobytes()
            elif not (model.is_control(k) or model.is_unknown(k) or model.is_unused(k)):
                if "\n" in piece or _SPACE in piece.lstrip(_SPACE):
                    raise ValueError(f"piece {piece!r} crosses a space or a line feed; stretches can't be merged on their own")
                self.surface[k] = piece.replace(_SPACE, " ").encode("utf-8")
                self.ids[piece], self.packed_id[piece] = k, np.uint32(k).tobytes()
                scores.append((-model.get_score(k), piece))
        place = {cost: r for r, cost in enumerate(sorted({cost for cost, _ in scores}))}  # equal scores share a rank
        self.rank = {piece: place[cost] for cost, piece in scores if len(piece) > 1}
        self.limit = int(self.dropout * 2**32)
        self._tabulate()
        self.forget()

    def _tabulate(self) -> None:
        """Symbols of characters, and for each pair of symbols that makes a piece its rank and the piece."""
        n = len(self.surface)
        self.symbol = np.arange(n, n + 0x110000, dtype=np.int32)
        for piece, k in self.ids.items():
            if len(piece) == 1:
                self.symbol[ord(piece)] = k
        part = lambda x: int(self.symbol[ord(x)]) if len(x) == 1 else self.ids.get(x)
        found = {}
        for piece, r in self.rank.items():
            for k in range(1, len(piece)):
                left, right = part(piece[:k]), part(piece[k:])
                if left is not None and right is not None:
                    found[left << _SYMBOL | right] = (r, self.ids[piece])
        self.pairs = np.array(sorted(found), np.int64)
        values = np.array([found[x] for x in self.pairs.tolist()], np.int32).reshape(-1, 2)
        self.pair_rank, self.pair_piece = values[:, 0].copy(), values[:, 1].copy()

    def _looked_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (_NONE: no piece) and piece of pairs; a negative symbol is none."""
        keys = left.astype(np.int64) << _SYMBOL | right
        at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
        return np.where((self.pairs[at] == keys) & (right >= 0), self.pair_rank[at], _NONE), self.pair_piece[at]

    def forget(self) -> None:
        """Empties the caches. Of the n-th stretch held: plain ids, and first place and number of its plain path's candidates."""
        self.index: dict[str, int] = {}
        self.plain: list[bytes] = []
        self.first, self.count = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.candidates, self.used = np.zeros(4096, np.uint64), 0

    def _skips(self, key: int, candidate: int) -> bool:
        """Whether a candidate, (begin of its left symbol << 32) ^ end of its right one, is dropped."""
        h = (key ^ candidate) * 0xBF58476D1CE4E5B9 & _MASK
        return (h ^ h >> 29) * 0x9E3779B97F4A7C15 >> 32 & 0xFFFFFFFF < self.limit

    def _all_skips(self, keys: np.ndarray, candidates: np.ndarray) -> np.ndarray:
        h = (keys ^ candidates) * np.uint64(0xBF58476D1CE4E5B9)
        return ((h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32) < np.uint64(self.limit)

    def _packed(self, parts: list[str]) -> bytes:
        ids = self.ids
        return b"".join([self.packed_id[p] if p in ids else self._bytes(p) for p in parts])

    def _bytes(self, text: str) -> bytes:
        return b"".join([self.byte[b] for b in text.encode("utf-8", "surrogatepass")])

    def _agendas(self, stretches: list[str], keys: np.ndarray | None) -> tuple[list[bytes], list[np.ndarray]]:
        """The packed ids of each stretch, none of more than SHORT characters, and the candidates that it took, in order;
        no candidate is dropped without keys."""
        order = sorted(range(len(stretches)), key=lambda k: len(stretches[k]))
        packed: list[bytes] = [b""] * len(stretches)
        paths: list[np.ndarray] = [np.zeros(0, np.uint64)] * len(stretches)
        for lo in range(0, len(order), ROWS):
            some = order[lo : lo + ROWS]
            ids, taken = self._matrix([stretches[k] for k in some], None if keys is None else keys[some])
            for k, x, c in zip(some, ids, taken, strict=True):
                packed[k], paths[k] = x, c
        return packed, paths

    def _matrix(self, stretches: list[str], keys: np.ndarray | None) -> tuple[list[bytes], list[np.ndarray]]:
        """A row per stretch; a symbol stands at its first character's place, and so does the pair that it begins."""
        n, sizes = len(stretches), np.array(list(map(len, stretches)), np.int64)
        points = np.frombuffer("".join(stretches).replace(" ", _SPACE).encode("utf-32-le", "surrogatepass"), "<u4")
        width = int(sizes.max()) + 1
        symbols = np.full((n, width), -1, np.int32)
        symbols[np.arange(width) < sizes[:, None]] = self.symbol[points]
        rank, piece = np.full((n, width), _NONE, np.int32), np.zeros((n, width), np.int32)
        rank[:, :-1], piece[:, :-1] = self._looked_up(symbols[:, :-1], symbols[:, 1:])
        end, before = (np.tile(np.arange(width, dtype=np.int64) + d, (n, 1)).ravel() for d in (1, -1))
        table, symbols, rank, piece = rank, symbols.ravel(), rank.ravel(), piece.ravel()
        rows, steps = np.arange(n), []
        while len(rows):
            place = table[rows].argmin(axis=1)
            left = rows * width + place
            ok = rank[left] != _NONE
            rows, place, left = rows[ok], place[ok], left[ok]
            base = left - place
            right = base + end[left]
            stop = end[right]
            candidate = place.astype(np.uint64) << np.uint64(32) ^ stop.astype(np.uint64)
            if keys is None:
                steps.append((rows, candidate))
            else:
                skip = self._all_skips(keys[rows], candidate)
                rank[left[skip]] = _NONE
                keep = ~skip
                place, left, base, right, stop = place[keep], left[keep], base[keep], right[keep], stop[keep]
            symbols[left], end[left] = piece[left], stop
            symbols[right], rank[right] = -1, _NONE
            after = base + stop
            inner = stop < width - 1
            before[after[inner]] = place[inner]
            rank[left], piece[left] = self._looked_up(symbols[left], np.where(inner, symbols[after - ~inner], -1))
            some = before[left] >= 0
            left, base = left[some], base[some]
            other = base + before[left]
            rank[other], piece[other] = self._looked_up(symbols[other], symbols[left])
        alive = symbols.reshape(n, width) >= 0
        final, cuts = symbols[alive.ravel()], np.concatenate([[0], np.cumsum(alive.sum(axis=1))])
        data, at = final.astype("<u4").tobytes(), (4 * cuts).tolist()
        packed = [data[a:b] for a, b in zip(at, at[1:], strict=False)]
        beyond = final >= len(self.surface)
        for k in np.unique(np.searchsorted(cuts, np.flatnonzero(beyond), side="right") - 1).tolist():
            packed[k] = b"".join([np.uint32(x).tobytes() if x < len(self.surface) else self._bytes(chr(x - len(self.surface))) for x in final[cuts[k] : cuts[k + 1]].tolist()])
        if not steps:
            return packed, [np.zeros(0, np.uint64)] * n
        owner, taken = (np.concatenate(x) for x in zip(*steps, strict=True))
        order = np.argsort(owner, kind="stable")
        return packed, np.split(taken[order], np.cumsum(np.bincount(owner, minlength=n))[:-1])

    def _heap(self, text: str, key: int | None) -> list[str]:
        n, rank = len(text), self.rank
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))  # first places of the neighbours
        alive = [True] * n
        agenda: list[tuple[int, int, int, int]] = []

        def propose(left: int, right: int) -> None:
            if left >= 0 and right < n and (r := rank.get(text[left : after[right]])) is not None:
                heapq.heappush(agenda, (r, left, right, after[right]))

        for i in range(n - 1):
            propose(i, i + 1)
        while agenda:
            _, left, right, end = heapq.heappop(agenda)
            if not (alive[left] and alive[right] and after[left] == right and after[right] == end):
                continue
            if key is not None and self._skips(key, left << 32 ^ end):
                continue
            alive[right] = False
            after[left] = end
            if end < n:
                before[end] = left
            propose(before[left], left)
            propose(left, end)
        return [text[i : after[i]] for i in range(n) if alive[i]]

    def _hold(self, stretches: list[str]) -> None:
        """Holds the plain ids and the plain path's candidates of the stretches."""
        packed, paths = self._agendas(stretches, None)
        k, n = len(self.plain), len(stretches)
        counts = np.array(list(map(len, paths)), np.int64)
        for name, size in (("first", k + n), ("count", k + n), ("candidates", self.used + int(counts.sum()))):
            x = getattr(self, name)
            if size > len(x):
                setattr(self, name, np.concatenate([x, np.zeros(size, x.dtype)]))
        self.first[k : k + n], self.count[k : k + n] = self.used + np.cumsum(counts) - counts, counts
        self.candidates[self.used : self.used + int(counts.sum())] = np.concatenate(paths)
        self.used += int(counts.sum())
        self.plain += packed
        self.index.update(zip(stretches, range(k, k + n), strict=True))

    def encode(self, text: str | None, key: str = "") -> bytes:
        """Packed ids (little-endian unsigned 32-bit) of a text; `key` names the document."""
        return self.encode_all([text], [key])[0]

    def encode_all(self, texts: list[str | None], names: list[str]) -> list[bytes]:
        """The packed ids of each text."""
        words: list[str] = []
        sizes = [0]
        for text in texts:
            for n, line in enumerate(_BARRIER.split(" " + text)) if text else ():
                if n % 2:
                    words.append(line)
                elif "  " in line or line.endswith(" "):
                    words += _STRETCH.findall(line)
                elif line:
                    head, *rest = line.split(" ")
                    words += [head] * bool(head) + [" " + w for w in rest]
            sizes.append(len(words))
        if not words:
            return [b""] * len(texts)
        counts = np.diff(sizes)
        bases = np.array([xxhash.xxh3_64_intdigest(k.encode("utf-8", "surrogatepass"), self.seed & _MASK) for k in names], np.uint64)
        places = np.arange(1, len(words) + 1) - np.repeat(sizes[:-1], counts)
        keys = places.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.repeat(bases, counts)
        keys = (keys ^ (keys >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        apart = {j: self._apart(w, int(keys[j])) for j, w in enumerate(words) if len(w) > SHORT or w == "\n" or w == _SPACE}
        for j in apart:
            words[j] = ""
        at = list(map(self.index.get, words))
        if None in at:
            self._hold(list(dict.fromkeys(w for w, k in zip(words, at, strict=True) if k is None)))
            at = list(map(self.index.__getitem__, words))
        out = list(map(self.plain.__getitem__, at))
        if self.limit:
            held = np.array(at)
            count = self.count[held]
            of = np.repeat(np.arange(len(words)), count)
            candidates = self.candidates[np.arange(len(of)) + (self.first[held] - np.cumsum(count) + count)[of]]
            varied = np.unique(of[self._all_skips(keys[of], candidates)])
            packed, _ = self._agendas([words[j] for j in varied.tolist()], keys[varied])
            for j, x in zip(varied.tolist(), packed, strict=True):
                out[j] = x
        for j, x in apart.items():
            out[j] = x
        return [b"".join(out[a:b]) for a, b in zip(sizes, sizes[1:], strict=False)]

    def _apart(self, stretch: str, key: int) -> bytes:
        """Of a stretch that is not held."""
        if stretch in ("\n", _SPACE):
            return self._bytes(stretch)
        return self._packed(self._heap(stretch.replace(" ", _SPACE), key if self.limit else None))

    def trim(self) -> None:
        if len(self.plain) > CACHE_STRETCHES:
            self.forget()

    def decode(self, packed: bytes) -> str:
        data = b"".join(map(self.surface.__getitem__, np.frombuffer(packed, "<u4").tolist()))
        return data[1:].decode("utf-8", "surrogatepass") if data else ""


def _codec(path: str, seed: int, dropout: float) -> Codec:
    if (path, seed, dropout) not in _OPEN:
        _OPEN[path, seed, dropout] = Codec(path, seed, dropout)
    return _OPEN[path, seed, dropout]


def _encode(batches: Iterator[pa.RecordBatch], path: str, seed: int, dropout: float) -> Iterator[pa.RecordBatch]:
    codec = _codec(path, seed, dropout)
    for batch in batches:
        codec.trim()
        keys = ["" if k is None else str(k) for k in batch.column(0).to_pylist()]
        packed = codec.encode_all(batch.column(1).to_pylist(), keys)
        ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(p) // 4 for p in packed])]), pa.int32()), pa.array(np.frombuffer(b"".join(packed), "<u4").astype("<i4"), pa.int32()))
        yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["id", "ids"])


def _digest(batches: Iterator[pa.RecordBatch], path: str, seed: int, dropout: float) -> Iterator[pa.RecordBatch]:
    codec = _codec(path, seed, dropout)
    for batch in batches:
        codec.trim()
        keys = ["" if k is None else str(k) for k in batch.column(0).to_pylist()]
        texts = [t or "" for t in batch.column(1).to_pylist()]
        packed = codec.encode_all(texts, keys)
        same = [codec.decode(p) == t for p, t in zip(packed, texts, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(p) // 4 for p in packed], pa.int64()), pa.array([zlib.crc32(p) for p in packed], pa.int64()), pa.array(same, pa.bool_())], names=["id", "n_tokens", "ids_crc32", "round_trip"])


def _decode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    codec = _codec(path, SEED, 0.0)
    for batch in batches:
        texts = [codec.decode(np.asarray(ids or [], "<u4").tobytes()) for ids in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, seed: int = SEED, dropout: float = DROPOUT) -> DataFrame:
    """One row per document: id, ids."""
    ready(docs.sparkSession)
    run = partial(_encode, path=model or default_model(), seed=seed, dropout=dropout)
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(tidied(run), f"id {docs.schema[id_col].dataType.simpleString()}, ids array<int>")


def decoded(rows: DataFrame, id_col: str = "id", ids_col: str = "ids", model: str | None = None) -> DataFrame:
    """One row per row of ids: id, text."""
    ready(rows.sparkSession)
    run = partial(_decode, path=model or default_model())
    return rows.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(tidied(run), f"id {rows.schema[id_col].dataType.simpleString()}, text string")


def digested(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, seed: int = SEED, dropout: float = DROPOUT) -> DataFrame:
    """One row per document: id, n_tokens, ids_crc32 (of the ids as unsigned 32-bit), round_trip (decoded equals text)."""
    ready(docs.sparkSession)
    run = partial(_digest, path=model or default_model(), seed=seed, dropout=dropout)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(tidied(run), f"id {kind}, n_tokens long, ids_crc32 long, round_trip boolean")


def query(spark, sf_dir: str) -> DataFrame:
    return digested(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
