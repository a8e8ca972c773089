from __future__ import annotations

import math
import random
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolith.llm import elias_fano, jaccard_join, language_model, store, url_filter
from chronolith.llm.components import components

from ..helpers import SF, duck, rows_of
from . import cases

# -- Jaccard join


def plain_components(rows, percent=75, size=5):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            root[find(a)] = find(b)
    least: dict[int, int] = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return Counter((i, len(sets[k]), least.get(find(k), i)) for k, (i, _) in enumerate(rows))


def got_components(spark, rows, **kw):
    out = jaccard_join.linked_groups(cases.table(spark, rows), **kw).collect()
    return Counter((r["id"], r["n_shingles"], r["component_id"]) for r in out)


def edited(text, rnd, share):
    words = text.split()
    for k in range(len(words)):
        if rnd.random() < share:
            words[k] = rnd.choice([f"new{rnd.randrange(10**6)}", "", words[k] + " extra"])
    return " ".join(words)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components_equal_all_pairs(spark, seed):
    """Near copies about the threshold, in chains and stars, with shared passages; small blocks split them over buckets."""
    rnd = random.Random(seed)
    passage = cases.prose(500, 30)
    texts = []
    for b in range(12):
        base = cases.prose(seed * 100 + b, rnd.randrange(8, 120))
        texts += [base] + [edited(base, rnd, rnd.choice([0.01, 0.03, 0.05])) for _ in range(rnd.randrange(12))]
        chain = base
        for _ in range(4):
            chain = edited(chain, rnd, 0.02)
            texts.append(chain)
        texts.append(base + " " + passage)
    texts += [passage + " " + cases.prose(900 + k, 12) for k in range(10)] + [f"{cases.prose(k, 3)} {passage}" for k in range(10)]
    rnd.shuffle(texts)
    rows = [(k + 1, t) for k, t in enumerate(texts)]
    assert got_components(spark, rows, block_tokens=300) == plain_components(rows)


def plain_links(rows, percent=75, size=5):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    near = lambda a, b: 100 * len(a & b) >= percent * len(a | b)
    return Counter((i, sum(k != j and bool(sets[k]) and bool(sets[j]) and near(sets[k], sets[j]) for j in range(len(rows)))) for k, (i, _) in enumerate(rows))


@pytest.mark.parametrize(("block", "percent", "size"), [(512, 75, 5), (3, 75, 5), (4, 50, 3)])
def test_every_link_is_counted(spark, monkeypatch, block, percent, size):
    """Groups of mutually near texts, chains and copies, in one cell and in cells of few sets."""
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", block)
    rnd = random.Random(4)
    texts = []
    for b in range(6):
        chain = base = cases.prose(700 + b, 60 + 20 * b)
        texts += [base] * 2 + [edited(base, rnd, 0.01) for _ in range(8)]
        for _ in range(12):
            chain += " " + cases.prose(rnd.randrange(10**6), rnd.randrange(2, 12))
            texts += [chain] * rnd.randrange(1, 3)
    rows = [(k + 1, t) for k, t in enumerate(texts)] + [(1000 + i if i else None, t) for i, t in cases.TEXTS]
    want = plain_links(rows, percent, size)
    got = jaccard_join.linked_groups(cases.table(spark, rows), size=size, percent=percent).collect()
    assert Counter((r["id"], r["n_links"]) for r in got) == want
    assert sum(n * c for (_, n), c in want.items()) > 2 * len(rows)


def test_components_of_awkward_rows(spark):
    assert got_components(spark, cases.TEXTS) == plain_components(cases.TEXTS)
    assert got_components(spark, []) == Counter()


def test_other_thresholds_and_sizes(spark):
    rnd = random.Random(8)
    rows = [(k, edited(cases.prose(k % 5, 40), rnd, 0.06)) for k in range(60)]
    for percent, size in ((50, 3), (90, 2)):
        assert got_components(spark, rows, percent=percent, size=size) == plain_components(rows, percent, size)


def test_short_texts_link_only_with_their_equals(spark):
    rows = [(1, "a b"), (2, "A  b"), (3, "a b c d e"), (4, "b a"), (5, "a b c d")]
    assert got_components(spark, rows) == plain_components(rows)


def test_one_of_each(spark):
    docs = cases.table(spark)
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns
    want = {c for (i, _, c) in plain_components(cases.TEXTS) if i is not None}
    assert {r["doc_id"] for r in kept.collect() if r["doc_id"] is not None} == want


def test_one_identifier_with_different_texts(spark):
    t, u = cases.prose(1, 60), cases.prose(2, 60)
    rows = [(3, t), (5, t + " x"), (5, u), (7, t), (7, t + " y"), (8, "a b"), (8, "A b"), (8, "A b")]
    kept = Counter(map(tuple, jaccard_join.one_of_each(spark.createDataFrame(rows, cases.SCHEMA)).collect()))
    assert Counter({(3, t): 1, (5, u): 1}) <= kept and sum(n for (i, _), n in kept.items() if i == 8) in (1, 2) and kept.total() - kept[8, "a b"] - kept[8, "A b"] == 2


def test_text_identifiers(spark):
    rows = [(f"d{k}", t) for k, (_, t) in enumerate(cases.TEXTS)]
    got = jaccard_join.linked_groups(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert Counter((r["id"], r["n_shingles"], r["component_id"]) for r in got) == plain_components(rows)


def test_jaccard_query_equals_sql(spark):
    assert rows_of(jaccard_join.query(spark, SF).toPandas()) == rows_of(duck().execute(jaccard_join.ORACLE).df())


def test_connected_components(spark):
    rnd = random.Random(6)
    edges = [(rnd.randrange(80), rnd.randrange(80)) for _ in range(60)] + [(100 + k, 101 + k) for k in range(40)] + [(200, 200)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a int, b int"), "a", "b").collect()}
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {x: r for x, r in root.items() if any(x in e and e[0] != e[1] for e in edges)}
    assert components(spark.createDataFrame([], "a int, b int"), "a", "b").count() == 0


# -- Elias-Fano and the store


@pytest.mark.parametrize(("n", "universe"), [(0, 10), (1, 1), (1, 1000), (1000, 500), (5000, 10**6), (20_000, 10**13), (3000, 3000)])
def test_elias_fano(tmp_path, n, universe):
    rnd = np.random.default_rng(1)
    values = np.sort(rnd.integers(0, universe, n)).astype(np.int64)
    store.put_arrays(f"file://{tmp_path}/a b/x", elias_fano.encode(values, universe), n=n)
    arrays, meta = store.get_arrays(f"file://{tmp_path}/a b/x")
    s = elias_fano.Sequence(arrays, meta["n"], universe)
    places = rnd.integers(0, n, 500) if n else np.zeros(0, int)
    assert (s.all() == values).all() and (s.at(places) == values[places]).all()
    single = np.unique(values)
    s = elias_fano.Sequence(elias_fano.encode(single, universe), len(single), universe)
    wanted = np.concatenate([single, rng_values := rnd.integers(0, universe, 500), np.array([0, universe - 1, universe, -1])])
    where = {v: k for k, v in enumerate(single.tolist())}
    assert s.find(wanted).tolist() == [where.get(v, -1) for v in wanted.tolist()] and len(rng_values) == 500
    if n >= 5000:
        assert sum(x.nbytes for x in arrays.values()) * 8 / n < 2.2 + math.log2(universe / n) + 1


# -- language model


def plain_scores(rows, discount=0.75):
    tokens = lambda t: [*(t or "").encode().lower().split(), b"\n"]
    out = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 7 == 2
    one, two = Counter(), Counter()
    for i, t in rows:
        if not out(i):
            w = tokens(t)
            one.update(w)
            two.update(zip(w, w[1:], strict=False))
    total, words = sum(one.values()), len(one)
    kept = Counter()
    for (c, _), n in two.items():
        kept[c] += (n - discount) / one[c]
    single = lambda w: (one[w] + 1) / (total + words + 1)
    for i, t in rows:
        w = tokens(t)
        score = math.log10(single(w[0]))
        for c, x in zip(w, w[1:], strict=False):
            score += math.log10((max(0, two[c, x] - discount) / one[c] if two[c, x] else 0) + max(1e-6, 1 - kept[c]) * single(x))
        yield i, out(i), len(w), sum(one[x] > 0 for x in w), total, sum(math.log10(single(x)) for x in w), score


def check_scores(spark, rows):
    got = sorted(language_model.scored(cases.table(spark, rows)).collect(), key=lambda r: (r["id"] is None, r["id"] or 0, r["n_tokens"]))
    want = sorted(plain_scores(rows), key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert tuple(g)[:5] == w[:5]
        assert g["base_score"] == pytest.approx(w[5], rel=1e-9)
        assert abs(g["score"] - w[6]) <= 0.02 * w[2] + 1e-6, (g, w)


def test_scores(spark):
    check_scores(spark, cases.TEXTS + [(100 + k, cases.prose(k % 20, 50)) for k in range(80)])


def test_scores_in_small_blocks_with_spread_contexts(spark):
    """Documents go over several blocks, and nearly every context is spread over the shards."""
    rows = [(k, cases.prose(k % 20, 130)) for k in range(60)]
    make = language_model.train(cases.table(spark, rows).where(~language_model.held_out(F.col("doc_id"))), block_tokens=37, hot=3)
    n, known, base, score = language_model._score_texts([t for _, t in rows], make())
    for k, w in enumerate(plain_scores(rows)):
        assert (n[k], known[k]) == (w[2], w[3]) and base[k] == pytest.approx(w[5], rel=1e-9) and abs(score[k] - w[6]) <= 0.02 * w[2]


def test_the_trie_lists_what_follows(spark):
    rows = [(k, cases.prose(k % 7, 60)) for k in range(30)]
    model = language_model.train(spark.createDataFrame(rows, cases.SCHEMA))()
    pairs, ones = Counter(), Counter()
    for _, t in rows:
        w = [*t.encode().lower().split(), b"\n"]
        ones.update(w)
        pairs.update(zip(w, w[1:], strict=False))
    numbers, _, _ = model.words(np.sort(np.array([language_model.xxhash.xxh3_64_intdigest(w) for w in ones], np.uint64)))
    number = dict(zip(sorted(ones, key=language_model.xxhash.xxh3_64_intdigest), numbers.tolist(), strict=True))
    name = {k: w for w, k in number.items()}
    got = {}
    for s in range(model.shards):
        arrays, meta = language_model._opened(f"{model.root}/pairs-{s}")
        for c in ones:
            for w, log in zip(*(x.tolist() for x in language_model.successors(arrays, meta, number[c])), strict=True):
                got[c, name[w]] = log
    assert set(got) == set(pairs)
    assert all(abs(got[c, w] - math.log10((n - 0.75) / ones[c])) < 0.02 for (c, w), n in pairs.items())


def test_a_missing_shard_is_an_error(spark, tmp_path):
    import os

    rows = [(k, cases.prose(k, 80)) for k in range(40)]
    make = language_model.train(spark.createDataFrame(rows, cases.SCHEMA))
    texts = [t for _, t in rows]
    language_model._score_texts(texts, make())
    root = make().root.removeprefix("file:")
    names = {n.split("-")[0] for n in os.listdir(root)}
    assert names == {"words", "pairs", "backoff"}
    for name in names:
        gone = next(f"{root}/{n}" for n in sorted(os.listdir(root)) if n.startswith(name))
        os.rename(gone, f"{tmp_path}/gone")
        language_model._opened.cache_clear()
        with pytest.raises(FileNotFoundError):
            language_model._score_texts(texts, make())
        os.rename(f"{tmp_path}/gone", gone)
    language_model._opened.cache_clear()


@pytest.mark.parametrize("n", [0, 1, 2, 50, 5000])
@pytest.mark.parametrize("shift", [0, 7])
def test_level_one_finds_its_words(n, shift):
    rnd = np.random.default_rng(n)
    hashes = np.unique(rnd.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) >> np.uint64(shift))
    counts = rnd.zipf(1.7, len(hashes)) % 100_000 + 1
    level = language_model._level_one(hashes, counts)
    others = rnd.integers(0, 1 << 63, 500, dtype=np.uint64)
    place, found = language_model._find_words(level, np.concatenate([hashes, others]))
    assert (place[: len(hashes)] == np.arange(len(hashes))).all() and (found[: len(hashes)] == counts).all()
    assert (place[len(hashes) :] < 0).all() and (found[len(hashes) :] == 0).all()
    if n >= 5000:
        assert sum(x.nbytes for x in level.values()) < 9 * n


def test_scores_without_training_text(spark):
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2][:3]
    rows = language_model.scored(cases.table(spark, [(i, "some words") for i in held])).collect()
    assert all((r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) == (3, 0, 0, 0.0, 0.0) for r in rows)
    assert language_model.scored(cases.empty(spark)).count() == 0


def test_known_passages_score_better(spark):
    rows = [(k, cases.prose(1, 60)) for k in range(40)] + [(1000 + k, cases.prose(50 + k, 60)) for k in range(40)]
    got = {r["id"]: r["score"] / r["n_tokens"] for r in language_model.scored(cases.table(spark, rows)).collect()}
    assert min(got[k] for k in range(40)) > max(got[1000 + k] for k in range(40))


# -- URL filter

URLS = [
    "http://a.example.com/en/7x", "https://EXAMPLE.com/en/8?q=1", "http://example.net/de/8", "http://x.net/de/#f", "http://notexample.net/de/85", "http://o.org/es/", "http://org/es/x", "http://com?/en/", "nothing", None, "", "://h/p", "http://u/a://b/c",
    "ftp://Ünï.com/en/1#x?y", "http://example.com", "http://h.org/es",
]


def plain_verdict(url):
    at = (url or "").find("://")
    rest = url[at + 3 :] if at >= 0 else ""
    end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host, tail = rest[:end], rest[end:]
    path = tail[: min((tail.find(c) for c in "?#" if c in tail), default=len(tail))]
    host = host.encode().lower().decode()
    fit = [r for r in url_filter.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fit, key=lambda r: len(r.text), default=None)
    return host, path, best and best.text, best and best.verdict


def pages(spark, urls):
    return spark.createDataFrame([(k, u, "h", "v") for k, u in enumerate(urls)], "page_id long, url string, host string, verdict string")


LABELS = "doc_id long, quality int, toxic int"


def test_fixed_rules(spark):
    got = url_filter.judged(pages(spark, URLS), spark.createDataFrame([], LABELS)).collect()
    assert len(got) == len(URLS)
    for r in got:
        host, path, rule, verdict = plain_verdict(URLS[r["id"]])
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict or "allow")
    assert url_filter.judged(pages(spark, []), spark.createDataFrame([], LABELS)).count() == 0


def plain_rules(rows, longest):
    """By enumeration of all token sets."""
    share = sum(b for _, b in rows) / len(rows)
    need = max(url_filter.MIN_SUPPORT * len(rows), url_filter.MIN_ROWS)
    sets, bad = Counter(), Counter()
    for tokens, b in rows:
        for n in range(1, longest + 1):
            for c in combinations(sorted(tokens), n):
                sets[c] += 1
                bad[c] += b
    strong = lambda b, a: a > 0 and b / a >= url_filter.MIN_LIFT * share and (b / a - share) / math.sqrt(share * (1 - share) / a) >= url_filter.LEAST_Z
    good = {c for c in sets if bad[c] >= need and strong(bad[c], sets[c])}
    owed = {c for c in good for d in good if set(c) < set(d) and bad[d] * sets[c] > bad[c] * sets[d] and not strong(bad[c] - bad[d], sets[c] - sets[d])}
    return {c for c in good - owed if not any(set(d) < set(c) for d in good - owed)}


def test_rules_of_deep_segments_and_many_tokens(spark):
    five = ["p", "q", "r", "s", "t"]
    urls = ["http://a.info/en/shop/casino/x"] * 30 + ["http://a.info/en/shop/books/x"] * 30 + ["http://b.org/" + "/".join(five)] * 30
    urls += ["http://b.org/" + "/".join(x for x in five if x != gone) for gone in five] * 30
    bad = [k < 30 or 60 <= k < 90 for k in range(len(urls))]
    got = url_filter.judged(pages(spark, urls), spark.createDataFrame([(k, int(not b), 0) for k, b in enumerate(bad)], LABELS)).collect()
    assert {r["id"]: r["verdict"] == "block" for r in got} == dict(enumerate(bad))


def test_mined_rules_equal_enumeration(spark):
    rnd = random.Random(5)
    urls, labels = [], []
    for k in range(900):
        host = rnd.choice(["spam.info", "a.info", "b.info", "www.b.info"])
        url = f"http://{host}/{rnd.choice(['win', 'news', 'shop'])}/{rnd.randrange(100)}{rnd.choice(['', '.html', '.php'])}{rnd.choice(['', '?ref=1', '?id=2&ref=3'])}"
        bad = "spam" in host or ("shop" in url and ".php" in url)
        urls.append(url)
        labels.append((k, int(not bad), 0) if rnd.random() < 0.5 else (k, 1, int(bad)))
    labels += [(k, None, None) for k in range(5)] + [(10**6, 0, 0)]
    df = pages(spark, urls + [None, "http://spam.info/x"])
    got = url_filter.judged(df, spark.createDataFrame(labels[:700], LABELS)).collect()
    tokens = {r["id"]: set(r["tokens"]) for r in got}
    rules = plain_rules([(tokens[k], (1 - q) | t) for k, q, t in labels[:700] if tokens[k]], 9)
    assert rules and any(len(r) > 1 for r in rules)
    for r in got:
        assert r["rule"] is None and r["verdict"] == ("block" if any(set(x) <= tokens[r["id"]] for x in rules) else "allow")
    assert got[-1]["id"] is not None and {r["id"]: r["verdict"] for r in got}[901] == "block"


def test_tokens_of_the_same_rows_are_one_item(spark):
    """Ten query keys that always come together make one item and no 2^10 sets; a page with any of them is blocked."""
    keys = "&".join(f"k{j}=1" for j in range(16))
    urls = [f"http://a.info/x?{keys}"] * 40 + ["http://a.info/x?ref=1"] * 60 + ["http://b.info/y?k3=5", "http://b.info/y"]
    labels = [(k, int(k >= 40), 0) for k in range(100)]
    got = {r["id"]: r["verdict"] for r in url_filter.judged(pages(spark, urls), spark.createDataFrame(labels, LABELS)).collect()}
    assert got[0] == "block" and got[50] == "allow" and got[100] == "block" and got[101] == "allow"
    rows = url_filter.judged(pages(spark, urls), spark.createDataFrame(labels, LABELS)).join(spark.createDataFrame([(k, not q) for k, q, _ in labels], "id long, bad boolean"), "id").select("id", "tokens", "bad")
    rules, items = url_filter.mined_rules(rows)
    assert rules.count() == 1 and items.select("item").distinct().count() == 3


def test_mined_verdicts_equal_sql(spark, tmp_path):
    """The query's SQL over a table in which labels depend on the URL, with repeated rows, nulls and long URLs."""
    import duckdb
    import pandas as pd

    rnd = random.Random(11)
    urls = [f"http://{rnd.choice(['spam', 'www', 'm'])}.{rnd.choice('abc')}.info/{rnd.choice(['win', 'news'])}/{rnd.randrange(100)}{rnd.choice(['', '.html'])}{rnd.choice(['', '?ref=1'])}" for _ in range(400)]
    urls += [None, "", "http://example.com/en/8", urls[0], urls[0], "http://spam.a.info/" + "x" * 20_000]
    labels = [(k, int(not ((urls[k] or "").startswith("http://spam") and rnd.random() < 0.7)), int(rnd.random() < 0.1)) for k in range(0, 400, 2)]
    pd.DataFrame({"page_id": range(len(urls)), "url": urls, "html": ""}).to_parquet(tmp_path / "pages.parquet")
    pd.DataFrame(labels, columns=["doc_id", "quality", "toxic"]).to_parquet(tmp_path / "labels.parquet")
    con = duckdb.connect()
    for t in ("pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    want = con.execute(url_filter.ORACLE).df()
    assert rows_of(url_filter.query(spark, str(tmp_path)).toPandas()) == rows_of(want)
    assert 30 < (want["verdict"] == "block").sum() < 300
