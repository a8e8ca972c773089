"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

Defined results: a null or empty text has no words and fails the base rule; words are maximal runs of anything but ASCII
white space; a text without letters has no share of capitals and passes that rule; very long texts are measured whole; a
repeated row is judged twice, alike; an empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 5
#: Low bits of a sort key that hold the position of a window; the others hold bits of its hash.
POSITION_BITS = 31

# Frequent function words of the languages that the stop-word rule knows.
STOP_WORDS = (
    "a also an and are as at be been but by can for from had has have he her his i in is it its not of on or our she so that the their there they this to was we were what when which who will with would you "
    "aber als am auch auf aus bei bin bis das dass dem den der des die du durch ein eine einem einen einer es für hat ich im ist mit nach nicht noch nur oder sich sie sind so und von vor war wie wird zu zum zur "
    "au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur mais ne nous on ou par pas plus pour qu que qui sa se ses son sont sur un une vous y à été "
    "al como con de del el ella en entre era es esta este fue ha hay la las lo los más me mi muy no o para pero por que se ser si sin su sus también un una y ya"
)


@dataclass(frozen=True)
class Threshold:
    """A text fails if `measure` lies outside low..high and it has at least `least_words` words."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None
    least_words: int = 0


#: The production table. Ratios are per word, per line with a word, or per code point in words.
THRESHOLDS = (
    Threshold("mean word length", "mean_word_chars", 1.5, 15.0),
    Threshold("symbols per word", "symbol_ratio", None, 0.3),
    Threshold("longest word", "max_word_chars", None, 1000),
    Threshold("duplicate lines", "dup_line_ratio", None, 0.3, 20),
    Threshold("letters", "letter_ratio", 0.5, None, 20),
    Threshold("capital letters", "capital_ratio", None, 0.6, 20),
    Threshold("stop words", "stop_word_ratio", 0.01, None, 60),
)


def _once(value: Column, use) -> Column:
    """`use(value)` with the value evaluated once: as a lambda variable the optimizer cannot copy it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _repeat_words(words: Column) -> Column:
    """The number of words in windows of WINDOW words that are found twice or more.

    Texts whose windows all have distinct 64-bit hashes have none. In others, windows are sorted by (part of their hash,
    position) as plain longs; positions whose hash part has a neighbour are candidates, and only these compare their
    words. The words covered are summed over the gaps of the found positions.
    """
    low = (1 << POSITION_BITS) - 1

    def hashes(ws: Column) -> Column:
        return _once(F.transform(ws, lambda w: F.xxhash64(w)), lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(WINDOW)))))

    def candidates(hs: Column) -> Column:
        keys = F.transform(hs, lambda x, i: x.bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long")))
        high = lambda x: F.shiftright(x, POSITION_BITS)
        return _once(F.sort_array(keys), lambda s: F.transform(F.filter(s, lambda x, i: ((i > 0) & (high(F.get(s, i - 1)) == high(x))) | (high(F.get(s, i + 1)) == high(x)).eqNullSafe(True)), lambda x: x.bitwiseAND(F.lit(low)).cast("int")))

    def found(ws: Column, at: Column) -> Column:
        windows = F.transform(at, lambda i: F.struct(F.array_join(F.slice(ws, i + 1, WINDOW), " ").alias("w"), i.alias("i")))
        same = lambda x, y: (x["w"] == y["w"]).eqNullSafe(True)
        return _once(F.array_sort(windows), lambda s: F.transform(F.filter(s, lambda x, i: ((i > 0) & same(F.get(s, i - 1), x)) | same(F.get(s, i + 1), x)), lambda x: x["i"]))

    def covered(at: Column) -> Column:
        return _once(F.sort_array(at), lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW))).cast("long")), F.lit(0).cast("long"), lambda n, x: n + x))

    none = F.lit(0).cast("long")

    def count(ws: Column) -> Column:
        return _once(hashes(ws), lambda hs: F.when(F.size(F.array_distinct(hs)) == F.size(hs), none).otherwise(_once(candidates(hs), lambda at: covered(found(ws, at)))))

    return F.when(F.size(words) < WINDOW, none).otherwise(_once(words, count))


def measures(text: Column) -> dict[str, Column]:
    """Columns by name; all are built-in expressions over the text."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    stop = sorted(set(STOP_WORDS.split()))
    return {
        "words": words,
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "max_word_chars": F.coalesce(F.array_max(F.transform(words, F.length)), F.lit(0)).cast("long"),
        "n_symbols": F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_letters": F.length(F.regexp_replace(text, r"[^\p{L}]+", "")).cast("long"),
        "n_capitals": F.length(F.regexp_replace(text, r"[^\p{Lu}]+", "")).cast("long"),
        "n_stop_words": F.size(F.filter(words, lambda w: F.lower(w).isin(stop))).cast("long"),
    }


#: Ratios, as SQL over the measures; null, which no rule fails, where there is nothing to divide by.
RATIOS = {
    "mean_word_chars": "try_divide(word_chars, n_words)",
    "symbol_ratio": "try_divide(n_symbols, n_words)",
    "max_word_chars": "max_word_chars",
    "dup_line_ratio": "try_divide(n_dup_lines, n_lines)",
    "letter_ratio": "try_divide(n_letters, word_chars)",
    "capital_ratio": "try_divide(n_capitals, n_letters)",
    "stop_word_ratio": "try_divide(n_stop_words, n_words)",
}


def compiled(rules: tuple[Threshold, ...]) -> Column:
    """The names of the rules that a row of measures fails, as one array expression."""

    def fails(r: Threshold) -> Column:
        x = F.expr(RATIOS[r.measure])
        out = [x < r.low] * (r.low is not None) + [x > r.high] * (r.high is not None)
        return F.when((F.col("n_words") >= max(1, r.least_words)) & reduce(lambda a, b: a | b, out), F.lit(r.name))

    return F.array_compact(F.array(*map(fails, rules)))


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Threshold, ...] = THRESHOLDS) -> DataFrame:
    """One row per document: id, base counts, base_failed, kept, failed (names of the rules)."""
    m = measures(F.col("text"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).select("id", *(c.alias(k) for k, c in m.items()))
    rows = rows.withColumn("n_repeat_words", _repeat_words(F.col("words"))).drop("words")
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    rows = rows.withColumn("base_failed", base).withColumn("failed", compiled(rules))
    return rows.select("id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.size("failed") == 0)).alias("kept"), "failed")


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return judged(table(spark, sf_dir, "documents")).drop("failed").withColumnRenamed("id", "doc_id")


_STOP_SQL = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS.split())))

ORACLE = rf"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2, i + 3, i + 4]) AS p FROM r) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
         coalesce(c.n, 0) AS n_repeat_words, coalesce(list_max(list_transform(ws, lambda x: length(x))), 0) AS max_word_chars,
         length(regexp_replace(t, '[^\p{{L}}]+', '', 'g')) AS n_letters, length(regexp_replace(t, '[^\p{{Lu}}]+', '', 'g')) AS n_capitals,
         len(list_filter(ws, lambda x: lower(x) IN ({_STOP_SQL}))) AS n_stop_words
  FROM w LEFT JOIN c ON w.doc_id = c.doc_id),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT (
  word_chars / n_words NOT BETWEEN 1.5 AND 15.0 OR n_symbols / n_words > 0.3 OR max_word_chars > 1000
  OR (n_words >= 20 AND (coalesce(n_dup_lines / nullif(n_lines, 0), 0) > 0.3 OR n_letters / word_chars < 0.5 OR coalesce(n_capitals / nullif(n_letters, 0), 0) > 0.6))
  OR (n_words >= 60 AND n_stop_words / n_words < 0.01)) AS kept
FROM b
"""
