"""Personal data by weak supervision.

Strict patterns give base spans and looser ones give further candidates. Five labelers (strict pattern, checksum or
format, gazetteer, words before the span, characters around it) vote on each candidate. Expectation-maximisation over
the counts of vote patterns, kept per kind and so bounded, estimates how reliable each labeler is; its posteriors train a
logistic span classifier on votes and shape. Base spans stay; further candidates stay if the classifier accepts them and
they overlap nothing that stays.

Defined results: a null or empty text has no spans; offsets are code points of the whole text, ends exclusive; repeated
rows get equal results; an empty table gives an empty result and an untrained model that accepts no further span. Extra
columns are ignored, or kept by `masked`.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready, table, tidied, written

KINDS = ("email", "ip", "card", "phone")

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match starts where a run of digits does: a failure there fails at every later digit of the run.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

#: Looser patterns, by kind.
_LOOSE = {
    "email": re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\s?[\[({]\s?at\s?[\])}]\s?[A-Za-z0-9-]{1,63}(?:\s?[\[({]\s?dot\s?[\])}]\s?[A-Za-z0-9-]{1,63}|\.[A-Za-z0-9-]{1,63})+", re.IGNORECASE),
    "ip": re.compile(r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:){4,7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])"),
    "card": re.compile(r"(?<![0-9A-Za-z+.-])[0-9](?:[ .-]?[0-9]){12,18}(?![0-9A-Za-z])"),
    "phone": re.compile(r"(?<![0-9A-Za-z+.-])(?:\([0-9]{2,4}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3,4}[ .-][0-9]{4}(?![0-9A-Za-z])"),
}

# Gazetteers.
_TLDS = set("com org net edu gov mil int info biz io co uk de fr es it nl eu ch at be se no dk fi pl pt cz ru cn jp in br ca au us example test invalid local".split())
_CARD_PREFIXES = ("4", "51", "52", "53", "54", "55", "34", "37", "36", "38", "6011", "62", "64", "65", "35", "2221", "2720")
_COUNTRY_CODES = set("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98 351 352 353 354 358 370 371 372 380 420 421".split())
# Words before a span that speak for or against a kind.
_FOR = {
    "email": re.compile(r"\b(?:e-?mails?|mail|contact|write|reach|correo|courriel|kontakt)\b", re.IGNORECASE),
    "ip": re.compile(r"\b(?:ip|ipv4|ipv6|host|server|address|client|login|adresse|direcci[oó]n)\b", re.IGNORECASE),
    "card": re.compile(r"\b(?:card|visa|mastercard|amex|credit|debit|payment|karte|carte|tarjeta)\b", re.IGNORECASE),
    "phone": re.compile(r"\b(?:tel|phone|call|fax|mobile|cell|telefon|t[eé]l[eé]phone|tel[eé]fono|ring)\b", re.IGNORECASE),
}
_AGAINST = re.compile(r"\b(?:isbn|issn|doi|version|order|invoice|sku|part|serial|build|token|key|id|hash|sum|page)\b[\s:.#=\"']*$", re.IGNORECASE)
_CONTEXT = 40

N_LABELERS = 5


def _luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(d // 5 + d * 2 % 10 for d in map(int, digits[-2::-2]))
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end), by kind and start."""
    out = []
    floor = 0
    at = text.find("@")
    while at >= 0:
        run = len(_LOCAL.match(text[floor:at][::-1])[0])
        if run and (m := _DOMAIN.match(text, at + 1)):
            out.append((0, at - run, m.end()))
            floor = m.end()
        else:
            floor = at + 1
        at = text.find("@", floor)
    for m in _IP.finditer(text):
        if all(len(x) <= 3 and int(x or "0") <= 255 for x in (y.lstrip("0") for y in m[0].split("."))):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and _luhn(digits):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((3, m.start(), m.end()))
    return out


def _check(kind: str, span: str) -> int:
    """The checksum or format labeler."""
    digits = re.sub(r"[^0-9]", "", span)
    if kind == "card":
        return 1 if 13 <= len(digits) <= 19 and _luhn(digits) else -1
    if kind == "phone":
        return 1 if 8 <= len(digits) <= 15 else -1
    if kind == "ip":
        return 1 if ":" in span or not re.match(r"(?:0\.|127\.|22[4-9]\.|2[3-5][0-9]\.)", span) else -1
    return 1 if re.search(r"[A-Za-z]", span) else -1


def _listed(kind: str, span: str) -> int:
    """The gazetteer labeler."""
    digits = re.sub(r"[^0-9]", "", span)
    if kind == "card":
        return 1 if digits.startswith(_CARD_PREFIXES) else -1
    if kind == "phone":
        return 1 if span.startswith("+") and any(digits[:n] in _COUNTRY_CODES for n in (1, 2, 3)) else 0
    if kind == "ip":
        return 0
    return 1 if re.split(r"[^A-Za-z]+", span.rstrip(")]}"))[-1].lower() in _TLDS else 0


def votes(text: str, kind: int, start: int, end: int, strict: bool) -> tuple[int, ...]:
    name, span, before = KINDS[kind], text[start:end], text[max(0, start - _CONTEXT) : start]
    context = -1 if _AGAINST.search(before) else 1 if _FOR[name].search(before) else 0
    around = text[start - 1 : start] + text[end : end + 1]
    edge = -1 if re.search(r"[A-Za-z0-9_/=#]", around) else 0 if around.strip() else 1
    return (1 if strict else 0, _check(name, span), _listed(name, span), context, edge)


def _shape(span: str) -> int:
    """Bucketed shape: share of digits (0-3), separators (0-3), length (0-3), as one small number."""
    digits = sum(c.isdigit() for c in span)
    seps = sum(not c.isalnum() for c in span)
    return (min(3, 4 * digits // max(1, len(span)))) * 16 + min(3, seps // 2) * 4 + min(3, len(span) // 8)


def candidates(text: str) -> list[tuple[int, int, int, bool, int, int]]:
    """(kind, start, end, base, vote pattern, shape) by kind and start; vote patterns in base 3."""
    base = base_spans(text)
    found = [(k, s, e, True) for k, s, e in base]
    taken = _Taken((s, e) for _, s, e in base)
    if re.search(r"[0-9@]|\bat\b", text, re.IGNORECASE):
        for k, name in enumerate(KINDS):
            for m in _LOOSE[name].finditer(text):
                if not taken.meets(m.start(), m.end()):
                    found.append((k, m.start(), m.end(), False))
    out = []
    for k, s, e, strict in sorted(found):
        code = 0
        for v in votes(text, k, s, e, strict):
            code = code * 3 + v + 1
        out.append((k, s, e, strict, code, _shape(text[s:e])))
    return out


class _Taken:
    """Places that spans cover, as sorted disjoint intervals."""

    def __init__(self, spans: Iterable[tuple[int, int]] = ()):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for s, e in sorted(spans):
            if self.ends and s < self.ends[-1]:
                self.ends[-1] = max(e, self.ends[-1])
            else:
                self.starts.append(s)
                self.ends.append(e)

    def meets(self, start: int, end: int) -> bool:
        at = bisect_left(self.starts, end)
        return at > 0 and self.ends[at - 1] > start

    def add(self, start: int, end: int) -> None:
        """Of a span that meets none."""
        at = bisect_left(self.starts, start)
        self.starts.insert(at, start)
        self.ends.insert(at, end)


@dataclass(frozen=True)
class Model:
    """Logistic weights by kind, and the labelers' estimated reliabilities (for reports)."""

    weights: np.ndarray
    reliability: np.ndarray
    threshold: float = 0.6

    def accepts(self, kind: int, code: int, shape: int) -> bool:
        return float(_features(np.array([code]), np.array([shape]))[0] @ self.weights[kind]) > np.log(self.threshold / (1 - self.threshold))


def _unpacked(codes: np.ndarray) -> np.ndarray:
    return np.stack([codes // 3 ** (N_LABELERS - 1 - j) % 3 for j in range(N_LABELERS)], axis=1)


def _features(codes: np.ndarray, shapes: np.ndarray) -> np.ndarray:
    marks = [(_unpacked(codes) == v).astype(float) for v in (0, 2)]
    parts = [np.eye(4)[shapes // d % 4] for d in (16, 4, 1)]
    return np.hstack([np.ones((len(codes), 1)), *marks, *parts])


def expectation_maximisation(codes: np.ndarray, counts: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors of the vote patterns and P(vote | class) of the labelers, for one kind."""
    marks = _unpacked(codes)
    agree = (marks - 1).sum(axis=1)
    p = 1 / (1 + np.exp(-agree.astype(float)))
    # Dirichlet prior: a labeler that speaks is more often right than wrong.
    prior = np.array([[3.0, 2.0, 1.0], [1.0, 2.0, 3.0]])
    for _ in range(rounds):
        weight = np.stack([(1 - p) * counts, p * counts])
        table_ = np.stack([[prior[c] + np.bincount(marks[:, j], weight[c], 3) for j in range(N_LABELERS)] for c in (0, 1)])
        table_ /= table_.sum(axis=2, keepdims=True)
        share = (weight.sum(axis=1) + 1) / (counts.sum() + 2)
        logs = [np.log(share[c]) + sum(np.log(table_[c, j, marks[:, j]]) for j in range(N_LABELERS)) for c in (0, 1)]
        p = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))
    return p, table_


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Weighted ridge logistic regression by Newton's method; y are soft labels."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (n * p * (1 - p))[:, None]) + ridge * np.eye(len(w)), x.T @ (n * (y - p)) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(counted: list[tuple[int, int, int, int]]) -> Model:
    """From (kind, vote pattern, shape, count), at most 4 * 243 * 64 rows."""
    rows = np.array(sorted(counted), dtype=np.int64).reshape(-1, 4)
    weights, trust = np.zeros((len(KINDS), 1 + 2 * N_LABELERS + 12)), np.zeros((len(KINDS), 2, N_LABELERS, 3))
    weights[:, 0] = -30.0
    for k in range(len(KINDS)):
        own = rows[rows[:, 0] == k]
        if len(own):
            codes, which = np.unique(own[:, 1], return_inverse=True)
            p, trust[k] = expectation_maximisation(codes, np.bincount(which, own[:, 3]))
            weights[k] = _logistic(_features(own[:, 1], own[:, 2]), p[which], own[:, 3].astype(float))
    return Model(weights, trust)


def chosen(found: list[tuple], model: Model) -> list[tuple[int, int, int]]:
    """Base spans and the accepted further ones, by kind and start."""
    keep = [(k, s, e) for k, s, e, base, _, _ in found if base]
    taken = _Taken((s, e) for _, s, e in keep)
    for k, s, e, base, code, shape in found:
        if not base and model.accepts(k, code, shape) and not taken.meets(s, e):
            keep.append((k, s, e))
            taken.add(s, e)
    return sorted(keep)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


_FOUND = "array<struct<kind:int,start:int,end:int,base:boolean,code:int,shape:int>>"


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("code", pa.int32()), ("shape", pa.int32())]))
    for batch in batches:
        rows = [[dict(zip(("kind", "start", "end", "base", "code", "shape"), c, strict=True)) for c in candidates(t or "")] for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], names=["id", "found"])


def extracted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id and its candidates."""
    ready(docs.sparkSession)
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(tidied(_find), f"id {docs.schema[id_col].dataType.simpleString()}, found {_FOUND}")


def trained(found: DataFrame) -> Model:
    counted = found.select(F.explode("found").alias("c")).groupBy("c.kind", "c.code", "c.shape").count().collect()
    return fit([tuple(r) for r in counted])


def _decide(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: dict[str, list] = {f"n_{k}": [] for k in KINDS} | {"base_sha256": [], "spans": []}
        for row in batch.column(1).to_pylist():
            found = [tuple(c.values()) for c in row]
            base = [c[:3] for c in found if c[3]]
            for k, name in enumerate(KINDS):
                out[f"n_{name}"].append(sum(c[0] == k for c in base))
            out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
            out["spans"].append(joined(chosen(found, model)))
        kinds = [pa.int64()] * len(KINDS) + [pa.string()] * 2
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True))], names=["id", *out])


def detected(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, counts and checksum of the base spans, all spans."""
    found = written(extracted(docs, id_col, text_col), "pii-candidates")
    kind = docs.schema[id_col].dataType.simpleString()
    return found.mapInArrow(tidied(partial(_decide, model=trained(found))), f"id {kind}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string")


def mask(text: str, model: Model) -> str:
    """The text with each span replaced by its kind in brackets."""
    out, at = [], 0
    for s, e, k in sorted((s, e, k) for k, s, e in chosen(candidates(text), model)):
        if e > at:  # spans of different kinds may overlap
            out += [text[at:s], f"[{KINDS[k].upper()}]" if s >= at else ""]
            at = e
    return "".join([*out, text[at:]])


def masked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with masked texts; null texts stay null, other columns as they are."""
    model = trained(written(extracted(docs, id_col, text_col), "pii-candidates"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.names.index(text_col)
            texts = [t if t is None else mask(t, model) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return docs.mapInArrow(tidied(run), docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    return detected(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
