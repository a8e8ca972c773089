"""URL filtering: fixed host and path rules first, then association rules that Spark's FP-growth mines from labels.

URLs become sets of tokens (host suffixes, path segments, file extension, query keys). Tokens of labelled rows that are too
rare for a rule go, and tokens that are always seen together become one item, so that a URL shape with many fixed parts
does not make all their subsets. The item sets, with the bad label as one more item, go through FP-growth. A rule that
implies the label needs a least support, a confidence of MIN_LIFT times the share of bad rows, and to be that far above
it that chance would do so once in a hundred times: a fixed confidence would never fire where few rows are bad and always
where most are. A rule that owes this to a longer and surer one, because the rest of its rows would not pass, goes in
favour of that one; of what is left, rules that contain the antecedent of another one go. Each rule is filed in an inverted index under the
item that is in the fewest rules; an item set looks its items up and checks the found rules for containment; equal token
sets are matched once.

Defined results: a null URL or one without `://` has an empty host and path and no token, so it is allowed unless a fixed
rule has an empty host; of fixed rules that fit the longest wins, and two of one length can't fit one URL unless they are
equal; any one mined rule blocks, so ties between them do not matter; null labels do not train; a page with several
labels is bad if any is; with no labels there are no mined rules. Very long URLs are read whole. Repeated rows get equal
results, an empty table an empty one; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions, table, written
from .exact_dedup import normalised

BLOCK, ALLOW = "block", "allow"
_BAD = "label=bad"
#: The production thresholds of mined rules: share of the rows and rows that are bad and hold the antecedent, confidence over
#: the share of bad rows, and standard deviations above it.
MIN_SUPPORT, MIN_ROWS, MIN_LIFT, LEAST_Z = 0.002, 20, 1.25, 2.33
#: Mined rules are broadcast up to this number (about 300 bytes each), and shuffled beyond it.
BROADCAST_RULES = 50_000


@dataclass(frozen=True)
class UrlRule:
    """Fits the host and its subdomains where the path starts with `path`."""

    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The production rules.
RULES = (
    UrlRule("com", "/en/", BLOCK),
    UrlRule("example.com", "/en/7", ALLOW),
    UrlRule("net", "/de/", ALLOW),
    UrlRule("example.net", "/de/8", BLOCK),
    UrlRule("org", "/es/", BLOCK),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return normalised(host), F.coalesce(path, F.lit(""))


def fixed_rule(host: Column, path: Column, rules: tuple[UrlRule, ...]) -> Column:
    """The longest rule that fits, as a struct of rule and verdict; null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens of a URL, sorted; numbers in them count as one symbol."""
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    suffixes = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels), F.lit(1))), lambda i: F.concat(F.lit("host="), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    parts = F.filter(F.split(F.regexp_replace(path, "[0-9]+", "0"), "/"), lambda x: x != "")
    segments = F.transform(parts, lambda x: F.concat(F.lit("path="), x))
    ending = F.regexp_extract(path, r"\.([A-Za-z0-9]{1,5})$", 1)
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^?#]*\?([^#]*)", 1)
    keys = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("key="), F.substring_index(x, "=", 1)))
    every = F.concat(F.when(host != "", suffixes).otherwise(F.array().cast("array<string>")), segments, F.when(ending != "", F.array(F.concat(F.lit("end="), ending))).otherwise(F.array().cast("array<string>")), keys)
    return F.array_sort(F.array_distinct(every))


def token_items(rows: DataFrame, least: float) -> DataFrame:
    """(token, item) of the tokens in `least` bad rows or more; tokens of exactly the same rows are one item, the first by name.

    `rows` has id, tokens and bad. Sets of rows are compared by size, sum and exclusive or of hashed identifiers.
    """
    each = rows.select("id", "bad", F.explode("tokens").alias("token"))
    h = F.xxhash64("id")
    used = each.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("n_bad"), F.bit_xor(h).alias("x"), F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))).alias("s"))
    used = written(used.where(F.col("n_bad") >= least), "url-tokens")
    same = used.groupBy("n", "n_bad", "x", "s").agg(F.min("token").alias("item"))
    return written(used.join(same, ["n", "n_bad", "x", "s"]).select("token", "item"), "url-items")


def with_items(rows: DataFrame, items: DataFrame) -> DataFrame:
    """Distinct token sets (column tokens) with their items, sorted; sets without an item are left out."""
    n = items.count()
    one = rows.select("tokens").distinct()
    found = one.select("tokens", F.explode("tokens").alias("token")).join(F.broadcast(items) if n <= BROADCAST_RULES else items, "token")
    return found.groupBy("tokens").agg(F.array_sort(F.collect_set("item")).alias("items"))  # as many as a URL has parts


def mined_rules(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_rows: int = MIN_ROWS, min_lift: float = MIN_LIFT, least_z: float = LEAST_Z) -> tuple[DataFrame, DataFrame]:
    """Rules (antecedent, support, confidence) that imply the block label, and the items (token, item) that they are made
    of, from rows of (id, tokens, bad).

    The antecedent must be in bad rows that are a share of `min_support` of all, and `min_rows` of them.
    """
    rows = written(labelled.where(F.size("tokens") > 0), "url-transactions")
    n, bad = rows.agg(F.count(F.lit(1)), F.count_if("bad")).first()
    spark = rows.sparkSession
    if not bad:
        return spark.createDataFrame([], "antecedent array<string>, support double, confidence double"), spark.createDataFrame([], "token string, item string")
    least, share = max(min_support * n, min_rows), bad / n
    items = token_items(rows, least)
    sets = rows.join(with_items(rows, items), "tokens")
    label = F.when(F.col("bad"), F.array(F.lit(_BAD))).otherwise(F.array().cast("array<string>"))
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, least / n), minConfidence=min(1.0, min_lift * share), numPartitions=shuffle_partitions(spark)).fit(sets.select(F.concat("items", label).alias("items")))
    # FP-growth gives shares of the sets that it was given; rows without an item hold no rule.
    given = sets.count()
    found = model.associationRules.where(F.element_at("consequent", 1) == _BAD)
    counts = F.round(F.col("support") * given).cast("long"), F.round(F.col("support") * given / F.col("confidence")).cast("long")
    found = found.select(F.array_sort("antecedent").alias("antecedent"), *(c.alias(name) for c, name in zip(counts, ("bad", "rows"), strict=True)))
    strong = lambda bad, rows: (bad / rows >= min_lift * share) & (F.lit(share == 1) | ((bad / rows - share) / F.sqrt(share * (1 - share) / rows) >= least_z))
    found = written(found.where((F.col("bad") >= least) & strong(F.col("bad"), F.col("rows"))), "url-rules")
    rest = F.col("rows") - F.col("long_rows")
    owed = (F.col("long_bad") * F.col("rows") > F.col("bad") * F.col("long_rows")) & ~F.coalesce(F.when(rest > 0, strong(F.col("bad") - F.col("long_bad"), F.nullif(rest, F.lit(0)))), F.lit(False))
    own = written(found.join(_contained(found).where(owed).select("antecedent").distinct(), "antecedent", "left_anti"), "url-rules")
    least_ones = own.join(_contained(own).select(F.col("long").alias("antecedent")).distinct(), "antecedent", "left_anti")
    return written(least_ones.select("antecedent", (F.col("bad") / n).alias("support"), (F.col("bad") / F.col("rows")).alias("confidence")), "url-rules"), items


def _contained(rules: DataFrame) -> DataFrame:
    """Each rule (antecedent, bad, rows) with each one that holds its antecedent and more (long, long_bad, long_rows), by the index."""
    short = inverted_index(rules).join(rules, "antecedent")
    long = rules.select(F.col("antecedent").alias("long"), F.col("bad").alias("long_bad"), F.col("rows").alias("long_rows"), F.explode("antecedent").alias("token"))
    return long.join(short, "token").where((F.size("antecedent") < F.size("long")) & (F.size(F.array_except("antecedent", "long")) == 0))


def inverted_index(rules: DataFrame) -> DataFrame:
    """(token, antecedent): each rule under the one of its tokens that is in the fewest rules."""
    each = rules.select("antecedent", F.explode("antecedent").alias("token"))
    used = each.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    best = each.join(used, "token").groupBy("antecedent").agg(F.min(F.struct("n", "token")).alias("best"))
    return best.select("best.token", "antecedent")


def blocked_sets(sets: DataFrame, rules: DataFrame, items: DataFrame) -> DataFrame:
    """The token sets (column tokens) whose items contain the antecedent of a rule."""
    index = written(inverted_index(rules), "url-index")
    n = index.count()
    if n <= BROADCAST_RULES:
        index = F.broadcast(index)
    used = items.join(index.select(F.explode("antecedent").alias("item")).distinct(), "item", "left_semi")
    hits = with_items(sets, written(used, "url-used-items"))
    hits = hits.select("tokens", "items", F.explode("items").alias("token")).join(index, "token")
    return hits.where(F.size(F.array_except("antecedent", "items")) == 0).select("tokens").distinct()


def judged(pages: DataFrame, labels: DataFrame, id_col: str = "page_id", url_col: str = "url", label_id: str = "doc_id", rules: tuple[UrlRule, ...] = RULES, **mining) -> DataFrame:
    """One row per page: id, host, path, rule, verdict, tokens. `labels` has quality (0: bad) and toxic (1: bad)."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).select("id", "url", host.alias("host"), path.alias("path"))
    rows = rows.select("id", "host", "path", fixed_rule(F.col("host"), F.col("path"), rules).alias("fixed"), tokens(F.col("url"), F.col("host"), F.col("path")).alias("tokens"))
    bad = labels.groupBy(F.col(label_id).alias("id")).agg(F.max(((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")).alias("bad")).where("bad is not null")
    mined, items = mined_rules(rows.join(bad, "id").select("id", "tokens", (F.col("bad") == 1).alias("bad")), **mining)
    sets = blocked_sets(rows.where("fixed is null"), mined, items)
    sets = written(sets.withColumn("mined", F.lit(BLOCK)), "url-blocked")
    if sets.count() <= BROADCAST_RULES:
        sets = F.broadcast(sets)
    out = rows.join(sets, "tokens", "left")
    return out.select("id", "host", "path", F.col("fixed.rule").alias("rule"), F.coalesce("fixed.verdict", "mined", F.lit(ALLOW)).alias("verdict"), "tokens")


def query(spark, sf_dir: str) -> DataFrame:
    out = judged(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))
    return out.drop("tokens").withColumnRenamed("id", "page_id")


def _suffixes(host: str) -> str:
    return f"list_transform(range(1, len(string_split({host}, '.')) + 1), lambda i: 'host=' || array_to_string(list_filter(string_split({host}, '.'), lambda x: x <> '')[i:], '.'))"


_STRONG = f"({{b}} / {{a}} >= {MIN_LIFT} * share AND (share = 1 OR ({{b}} / {{a}} - share) / sqrt(share * (1 - share) / {{a}}) >= {LEAST_Z}))"

#: Rules by enumeration of all subsets of a URL's tokens.
ORACLE = rf"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url, CASE WHEN contains(url, '://') THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, url, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(rule_host, rule_path, rule, rule_verdict) AS (VALUES {", ".join(f"('{r.host}', '{r.path}', '{r.text}', '{r.verdict}')" for r in RULES)}),
fixed AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(rule_verdict, length(rule)) AS verdict FROM h JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id),
parts AS (SELECT *, list_filter(string_split(regexp_replace(path, '[0-9]+', '0', 'g'), '/'), lambda x: x <> '') AS ps, regexp_extract(path, '\.([A-Za-z0-9]{{1,5}})$', 1) AS ending, regexp_extract(url, '^[^?#]*\?([^#]*)', 1) AS q FROM h),
lists AS (SELECT page_id, list_distinct(CASE WHEN host <> '' THEN {_suffixes("host")} ELSE [] END || list_transform(ps, lambda x: 'path=' || x) || CASE WHEN ending <> '' THEN ['end=' || ending] ELSE [] END
  || list_transform(list_filter(string_split(q, '&'), lambda x: x <> ''), lambda x: 'key=' || string_split(x, '=')[1])) AS tokens FROM parts),
bad AS (SELECT doc_id AS page_id, max((quality = 0 OR toxic = 1)::INT) AS bad FROM labels GROUP BY doc_id),
n AS (SELECT count(*) AS n, sum(bad) / count(*) AS share FROM lists JOIN bad USING (page_id) WHERE bad IS NOT NULL AND len(tokens) > 0),
combos AS (SELECT page_id, list_filter(ts, lambda x, i: (m >> (i - 1)) & 1 = 1) AS c FROM (SELECT page_id, list_sort(tokens) AS ts, unnest(range(1, 1 << len(tokens))) AS m FROM lists)),
counted AS (SELECT c, sum(bad) AS b, count(*) AS a FROM combos JOIN bad USING (page_id) WHERE bad IS NOT NULL GROUP BY c),
strong AS (SELECT c, b, a, share FROM counted, n WHERE b >= greatest({MIN_SUPPORT} * n, {MIN_ROWS}) AND {_STRONG.format(b="b", a="a")}),
good AS (SELECT c FROM strong s WHERE NOT EXISTS (
  SELECT 1 FROM strong l WHERE len(l.c) > len(s.c) AND list_has_all(l.c, s.c) AND l.b * s.a > s.b * l.a AND NOT coalesce({_STRONG.format(b="(s.b - l.b)", a="nullif(s.a - l.a, 0)").replace("share", "s.share")}, FALSE))),
hit AS (SELECT DISTINCT page_id FROM combos JOIN good USING (c))
SELECT h.page_id, h.host, h.path, f.rule, coalesce(f.verdict, CASE WHEN hit.page_id IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM h LEFT JOIN fixed f ON f.page_id = h.page_id LEFT JOIN hit ON hit.page_id = h.page_id
"""
