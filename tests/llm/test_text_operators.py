from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolith.llm import exact_dedup, html_extract, language_id, packing, pii, quality, sentencepiece_codec
from chronolith.llm.common import table as read

from ..helpers import SF, duck, rows_of
from . import cases

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


# -- exact dedup


def plain_groups(rows, keep):
    groups: dict[str, list] = {}
    for i, t in rows:
        groups.setdefault(cases.lowered(t), []).append(i)
    pick = lambda ids: (min if keep == "smallest" else max)([i for i in ids if i is not None], default=None)
    return Counter((i, pick(groups[cases.lowered(t)]), len(groups[cases.lowered(t)])) for i, t in rows)


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("bits", [None, 1])
def test_exact_groups(spark, keep, bits):
    """With a digest of one byte nearly all digests collide, and bytes tell the texts apart."""
    digest = exact_dedup.sha256_bytes if bits is None else lambda t: F.substring(exact_dedup.sha256_bytes(t), 1, 1)
    got = exact_dedup.exact_groups(cases.table(spark), keep=keep, digest=digest).collect()
    assert Counter((r["id"], r["keep_id"], r["group_size"]) for r in got) == plain_groups(cases.TEXTS, keep)
    assert all(r["kept"] == (r["id"] == r["keep_id"]) for r in got)


def test_exact_groups_under_a_hot_group(spark):
    rows = [(k, "same text") for k in range(3000)] + [(k, f"text {k}") for k in range(3000, 3500)]
    got = exact_dedup.exact_groups(spark.createDataFrame(rows, cases.SCHEMA).repartition(7))
    assert got.where("kept").count() == 501 and got.agg(F.max("group_size")).first()[0] == 3000


def test_drop_copies(spark):
    kept = exact_dedup.drop_copies(cases.table(spark), keep="largest")
    assert kept.columns == cases.table(spark).columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == [3, 5, 6, 7, 8, 9, 10, 11, 12, 12, 13, 14, 15, 16, 17]
    assert exact_dedup.drop_copies(cases.empty(spark)).count() == 0
    assert exact_dedup.exact_groups(cases.empty(spark)).count() == 0


def test_one_identifier_with_different_texts(spark):
    rows = [(5, "a"), (7, "a"), (5, "b"), (8, "c"), (8, "C"), (None, "c"), (None, "c")]
    kept = exact_dedup.drop_copies(spark.createDataFrame(rows, cases.SCHEMA), keep="largest").collect()
    assert Counter(map(tuple, kept)) == Counter([(7, "a"), (5, "b"), (8, "c"), (8, "C"), (None, "c"), (None, "c")])


def test_runs_are_merged_and_probed(spark):
    rows = [(k, f"text {k % 700}") for k in range(1000)]
    docs = spark.createDataFrame(rows, cases.SCHEMA).repartition(9)
    log = exact_dedup.DigestLog(docs, "doc_id", "text", exact_dedup.sha256_bytes)
    runs = log.flush()
    assert len(runs) == exact_dedup.MEMTABLES and sum(r.count() > 0 for r in runs) > 1
    merge = log.merged(runs[0], runs[1])
    assert merge.agg(F.sum("n")).first()[0] == runs[0].agg(F.sum("n")).first()[0] + runs[1].agg(F.sum("n")).first()[0]
    one = log.compacted()
    assert Counter(map(tuple, one.select("smallest", "largest", "n").collect())) == Counter((k, k + 700 if k < 300 else k, 2 if k < 300 else 1) for k in range(700))
    bloom = exact_dedup.BloomFilter(one.where("n > 1"))
    passed = bloom.passed(log.entries.join(one.select("digest", "n"), "digest"), "digest", "maybe").groupBy("n").agg(F.avg(F.col("maybe").cast("int")).alias("share"))
    share = {r["n"]: r["share"] for r in passed.collect()}
    assert share[2] == 1.0 and share[1] < 0.05
    log.close()


def test_merging_runs_needs_no_shuffle(spark):
    docs = spark.createDataFrame([(k, f"text {k % 70}") for k in range(100)], cases.SCHEMA).repartition(9)
    log = exact_dedup.DigestLog(docs, "doc_id", "text", exact_dedup.sha256_bytes)
    a, b, *_ = log.flush()
    plan = a.hint("merge").join(b.hint("merge"), "digest", "full")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    log.close()


# -- quality rules


def plain_measures(text):
    words = SPACE.findall(text or "")
    lines = [x for x in (text or "").split("\n") if SPACE.search(x)]
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = {p for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for p in range(i, i + 5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def test_quality_measures(spark):
    rnd = random.Random(1)
    odd = [(100 + k, "".join(rnd.choice(["a ", "b ", "c\n", "d\t", "#", " é "]) for _ in range(rnd.randrange(120)))) for k in range(150)]
    rows = cases.TEXTS + odd
    got = quality.judged(cases.table(spark, rows)).collect()
    want = Counter((i, *plain_measures(t)) for i, t in rows)
    assert Counter((r["id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got) == want
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert not (r["kept"] and r["base_failed"]) and r["kept"] == (not r["base_failed"] and not r["failed"])
    assert quality.judged(cases.empty(spark)).count() == 0


def test_quality_verdicts(spark):
    clean, junk = cases.prose(5, 150), " ".join(f"{w}###" for w in cases.prose(6, 150).split())
    got = {r["id"]: (r["kept"], r["failed"]) for r in quality.judged(cases.table(spark, [(1, clean), (2, junk), (3, clean.upper())])).collect()}
    assert got[1] == (True, []) and "symbols per word" in got[2][1] and "capital letters" in got[3][1]


def test_quality_of_texts_without_letters(spark):
    rows = [(1, " ".join(map(str, range(30)))), (2, "12 " * 40), (3, "!? " * 25)]
    got = {r["id"]: r for r in quality.judged(cases.table(spark, rows)).collect()}
    assert all("letters" in r["failed"] and "capital letters" not in r["failed"] and not r["kept"] for r in got.values())


@pytest.mark.parametrize("module", [exact_dedup, quality])
def test_native_queries_equal_sql(spark, module):
    assert rows_of(module.query(spark, SF).toPandas()) == rows_of(duck().execute(module.ORACLE).df())


# -- personal data

EMAIL, IP, CARD, PHONE = (re.compile(p) for p in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"))


def plain_spans(t):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    luhn = lambda d: sum(int(x) if k % 2 == 0 else sum(map(int, str(2 * int(x)))) for k, x in enumerate(reversed(d))) % 10 == 0
    return (
        [("email", m.start(), m.end()) for m in EMAIL.finditer(t)]
        + [("ip", m.start(), m.end()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
        + [("card", m.start(), m.end()) for m in CARD.finditer(t) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))]
        + [("phone", m.start(), m.end()) for m in PHONE.finditer(t) if 8 <= len(digits(m)) <= 15]
    )


def test_base_spans_on_random_texts():
    rnd = random.Random(7)
    parts = ["a", "b.c", "@", "@x.org", ".", "-", "+1 (555) 123-4567", "10.0.0.1", "256.1.1.1", "4111111111111111", "4111 1111 1111 1111", "1.2.3.4.5", " ", "é", "00000000000000000000000001.2.3.4", "+", "9", "\n", "5555-5555-5555-4444"]
    for _ in range(4000):
        t = "".join(rnd.choice(parts) for _ in range(rnd.randrange(14)))
        assert [(pii.KINDS[k], s, e) for k, s, e in pii.base_spans(t)] == plain_spans(t), t


def test_base_spans_are_fast_on_long_runs():
    for t in ("1" * 300_000, "a" * 300_000 + " @", "1.2." * 80_000, "@" * 300_000, "+1 " * 100_000):
        pii.candidates(t)


def test_pii_rows_and_masking(spark):
    rows = [(1, "Mail me: ann@example.com or call +1 (555) 123-4567."), (2, None), (3, ""), (None, "host 10.0.0.1 card 4111 1111 1111 1111"), (4, "nothing here, just words 12 and 345"), (1, "Mail me: ann@example.com or call +1 (555) 123-4567.")]
    got = pii.detected(cases.table(spark, rows)).collect()
    for r in got:
        spans = [tuple(x.split(":")) for x in r["spans"].split(",") if x]
        text = next((t for i, t in rows if i == r["id"]), None) or ""
        base = plain_spans(text)
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in base).encode()).hexdigest()
        assert {(k, str(s), str(e)) for k, s, e in base} <= set(spans)
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(b[0] == k for b in base) for k in pii.KINDS]
    masked = pii.masked(cases.table(spark, rows))
    assert masked.columns == cases.table(spark).columns
    texts = {r["doc_id"]: r["text"] for r in masked.collect()}
    assert texts[1] == "Mail me: [EMAIL] or call [PHONE]." and texts[2] is None and texts[4] == rows[4][1]
    assert pii.detected(cases.empty(spark)).count() == 0 and pii.masked(cases.empty(spark)).count() == 0


def test_reliability_estimates():
    """Labelers that agree are trusted, one that contradicts them is not."""
    counts = Counter()
    rnd = random.Random(2)
    for _ in range(5000):
        true = rnd.random() < 0.4
        say = lambda right: (1 if true else -1) * (1 if rnd.random() < right else -1)  # noqa: B023, E731
        code = 0
        for v in (0, say(0.95), say(0.9), say(0.3), say(0.85)):
            code = code * 3 + v + 1
        counts[code] += 1
    codes = np.array(sorted(counts))
    _, table = pii.expectation_maximisation(codes, np.array([counts[c] for c in codes]))
    assert table[1, 1, 2] > 0.9 and table[1, 2, 2] > 0.8 and table[1, 3, 2] < 0.4


# -- language


def labelled(spark, n=240):
    rnd = random.Random(3)
    stock = {"en": "the of and house river morning", "de": "der und nicht häuser straße schön", "fr": "les des où été maison rivière"}
    rows = []
    for k in range(n):
        lang = rnd.choice(sorted(stock))
        rows.append((k, " ".join(rnd.choice(stock[lang].split()) for _ in range(12)), lang))
    rows += [(1000, None, "en"), (1001, "", "en"), (1002, "12 34 !!", "en"), (1003, "river house " * 200_000, None), (None, "der und", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), rows


def test_language_predictions(spark):
    docs, rows = labelled(spark)
    got = {r["id"]: r for r in language_id.predicted(docs).collect()}
    want = {i: g for i, _, g in rows}
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str("" if i is None else i).encode()) % 4 == 2) and 0 <= r["score"] <= 1
        if i is not None and i < 1000:
            assert r["lang_pred"] == want[i]
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (1000, 1001, 1002))
    assert got[1003]["lang_pred"] == "en" and got[None]["lang_pred"] == "de"


def plain_bayes(rows):
    """Multinomial naive Bayes written out: language and evidence of each text."""
    hashed: dict[tuple, int] = {}

    def bucket(gram):
        if gram not in hashed:
            h = 0
            for n, point in enumerate(gram, 1):
                h = (h ^ (point + n)) * 0x9E3779B97F4A7C15 & (1 << 64) - 1
                h ^= h >> 29
            hashed[gram] = (h >> 20) % language_id.BUCKETS
        return hashed[gram]

    def grams(text):
        points = [ord(c) if c.isalpha() else 0 for c in (text or "").lower()]
        return Counter(bucket(tuple(points[i : i + n])) for n in (1, 2, 3) for i in range(len(points) - n + 1) if any(points[i : i + n]))

    learned: dict[str, Counter] = {}
    for i, t, g in rows:
        if g is not None and t is not None and zlib.crc32(str("" if i is None else i).encode()) % 4 != 2 and grams(t):
            learned.setdefault(g, Counter()).update(grams(t))
    logs = {g: (c, np.log(c.total() + language_id.SMOOTHING * language_id.BUCKETS)) for g, c in learned.items()}
    for _, t, _ in rows:
        own = grams(t)
        sums = {g: sum(n * (np.log(c[b] + language_id.SMOOTHING) - total) for b, n in own.items()) for g, (c, total) in sorted(logs.items())}
        best = max(sums, key=sums.get) if own else "und"
        yield best, 1 / sum(np.exp(x - sums[best]) for x in sums.values()) if own else 0.0, sums[best] / own.total() + np.log(language_id.BUCKETS) if own else 0.0


def test_language_equals_plain_bayes(spark):
    rnd = random.Random(5)
    _, rows = labelled(spark, 120)
    rows = [r for r in rows if r[0] != 1003] + [(2000 + k, "".join(rnd.choice("абвгдежзиклмн ") for _ in range(60)), None) for k in range(5)] + [(3000, rows[0][1], rows[0][2])] * 2 + [(3001, "x", "en"), (3002, "Ünï code ΣΣ", "xx")]
    docs = spark.createDataFrame([(*r, "s", 1) for r in rows], "doc_id long, text string, lang string, score string, evidence int").repartition(3)
    want = Counter((i, g, round(float(p), 4), round(float(e), 3)) for (i, _, _), (g, p, e) in zip(rows, plain_bayes(rows), strict=True))
    got = Counter((r["id"], r["lang_pred"], round(r["score"], 4), round(r["evidence"], 3)) for r in language_id.predicted(docs).collect())
    assert got == want
    kept = language_id.accepted(docs)
    assert kept.columns == docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(i for i, g, _, e in want.elements() if g != "und" and e > 0)
    assert not any(2000 <= (r["doc_id"] or 0) < 2005 for r in kept.collect())


def test_more_languages_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(language_id, "BLOCK_LANGUAGES", 7)
    rows = [(k, f"{chr(0x4E00 + k % 40) * 9} word", f"l{k % 40}") for k in range(400)]
    got = language_id.predicted(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert all(r["lang_pred"] == f"l{r['id'] % 40}" for r in got)


def test_language_never_uses_labels_of_the_scored(spark):
    docs, _ = labelled(spark)
    wrong = docs.withColumn("lang", F.when(language_id.held_out(F.col("doc_id")), "xx").otherwise(F.col("lang")))
    assert sorted(map(repr, language_id.predicted(docs).collect())) == sorted(map(repr, language_id.predicted(wrong).collect()))


def test_language_pieces_count_as_a_whole(monkeypatch):
    texts = [cases.LONG[:5000], "", "ab", "é" * 700]

    def total():
        out = {}
        for docs, starts, _, points in list(language_id._pieces(texts)):
            pass
        for docs, starts, counts, points in language_id._pieces(texts):
            for n, ids in enumerate(language_id._buckets(starts, counts, points)):
                own = np.repeat(docs, np.diff(np.append(starts, len(points))))
                for d in set(docs.tolist()):
                    out.setdefault((d, n), Counter()).update(x for x in ids[own == d].tolist() if x < language_id.BUCKETS)
        return out

    whole = total()
    monkeypatch.setattr(language_id, "_PIECE", 97)
    assert total() == whole


def test_language_acceptance(spark):
    docs = cases.table(spark)
    kept = language_id.accepted(docs)
    assert kept.columns == docs.columns
    assert not {4, 5, 6, 17} & {r["doc_id"] for r in kept.collect()}
    assert language_id.accepted(cases.empty(spark)).count() == 0 and language_id.predicted(cases.empty(spark)).count() == 0


# -- packing


def test_packing(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    rows = packing.packed(cases.table(spark), capacity=64).collect()
    want = Counter()
    for i, t in cases.TEXTS:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        want.update((i, n, s, len(ids[s : s + 64]), zlib.crc32(np.array(ids[s : s + 64], "<u4").tobytes())) for n, s in enumerate(range(0, len(ids), 64)))
    assert Counter((r["id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    sequences: dict[int, list] = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.packed(cases.empty(spark)).count() == 0


def test_plan_is_best_fit_decreasing():
    rnd = random.Random(9)
    for _ in range(60):
        lengths = [rnd.randrange(1, 33) for _ in range(rnd.randrange(1, 200))]
        rooms: list[int] = []
        for n in sorted(lengths, reverse=True):
            fits = [r for r in rooms if r >= n]
            if fits:
                rooms[rooms.index(min(fits))] -= n
            else:
                rooms.append(32 - n)
        steps = packing.plan(Counter(lengths), 32)
        counts = Counter(lengths)
        used: dict[int, list] = {}
        for k, (n, first, sequence, each, offset) in enumerate(steps):
            last = steps[k + 1][1] if k + 1 < len(steps) and steps[k + 1][0] == n else counts[n]
            for rank in range(first, last):
                used.setdefault(sequence + (rank - first) // each, []).append((offset + (rank - first) % each * n, n))
        assert len(used) == len(rooms) and sum(map(len, used.values())) == len(lengths)
        for pieces in used.values():
            at = 0
            for offset, n in sorted(pieces):
                assert offset == at
                at += n
            assert at <= 32


def test_words_are_encoded_as_in_the_text():
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    tokenizer, rnd = Tokenizer.from_file(path), random.Random(1)
    texts = ["".join(rnd.choice("aB'sé́ ,.!1²٣\n\t\x01<|>ΣςİıßﬁK가 ") for _ in range(rnd.randrange(40))) for _ in range(2000)] + ["<|endoftext|> x<|startoftext|>y", "x" * 3000]
    for t, packed in zip(texts, packing.packed_ids(texts, path), strict=True):
        assert np.frombuffer(packed, "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids


# -- SentencePiece


def odd_texts():
    rnd = random.Random(2)
    return ["", "   ", " a", "\n", "a\n\nb", "x" * 300, "▁", "a▁ ▁b", "日本語\x00", " " * 50 + "abc" + " " * 37] + ["".join(rnd.choice("aB'sé́ ,.!1²\n\t  <|>Σİ가theing▁") for _ in range(rnd.randrange(80))) for _ in range(800)] + [t for _, t in cases.TEXTS if t]


def test_codec_without_dropout_equals_the_library():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.default_model())
    codec = sentencepiece_codec.Codec(sentencepiece_codec.default_model(), dropout=0.0)
    for t in odd_texts():
        packed = codec.encode(t)
        assert codec.decode(packed) == t
        if "▁" not in t:
            assert np.frombuffer(packed, "<u4").tolist() == model.encode(t)


def test_codec_with_dropout():
    make = lambda **kw: sentencepiece_codec.Codec(sentencepiece_codec.default_model(), **kw)
    one, same, other = make(dropout=0.2), make(dropout=0.2), make(dropout=0.2, seed=5)
    text = cases.prose(4, 300)
    for t in odd_texts():
        assert one.decode(one.encode(t, "k")) == t
    assert one.encode(text, "1") == same.encode(text, "1")
    assert len({one.encode(text, "1"), one.encode(text, "2"), other.encode(text, "1"), make(dropout=0.0).encode(text, "1")}) == 4
    assert len(make(dropout=1.0).encode("plain")) == 4 * 6
    word = "▁" + "thereforeandtherein" * 2
    for key in range(50):
        assert agenda(one, word, key) == one._heap(word, key)


def agenda(codec, word, key):
    """The pieces that a row of the matrix comes to."""
    (packed,), _ = codec._agendas([word], np.array([key], np.uint64))
    return [codec.surface[k].decode().replace(" ", "▁") for k in np.frombuffer(packed, "<u4").tolist()]


def plain_dropout(codec, text, key):
    """The agenda written out as a list of all pairs, looked through anew for every candidate."""
    parts, dropped = [(text[k], k, k + 1) for k in range(len(text))], set()
    while True:
        pairs = [(codec.rank[a[0] + b[0]], a[1], k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a[0] + b[0] in codec.rank and (a[1], a[2], b[2]) not in dropped]
        if not pairs:
            return [p for p, _, _ in parts]
        k = min(pairs)[2]
        a, b = parts[k : k + 2]
        if codec._skips(key, a[1] << 32 ^ b[2]):
            dropped.add((a[1], a[2], b[2]))
        else:
            parts[k : k + 2] = [(a[0] + b[0], a[1], b[2])]


def test_dropout_equals_a_plain_agenda():
    codec = sentencepiece_codec.Codec(sentencepiece_codec.default_model(), dropout=0.3)
    for word in ("▁organisation", "▁international", "▁aaaaaaaa", "▁thereforetherein", "▁▁▁x", "▁été"):
        for key in range(200):
            want = plain_dropout(codec, word, key)
            assert agenda(codec, word, key) == want == codec._heap(word, key)


def test_every_occurrence_has_its_own_draw():
    """What the caches give is what the agenda alone gives, and a word takes many segmentations over documents and places."""
    import xxhash

    codec = sentencepiece_codec.Codec(sentencepiece_codec.default_model())
    found = Counter()
    for doc in range(40):
        text = " ".join(["organisation"] * 50)
        packed = codec.encode(text, str(doc))
        base = xxhash.xxh3_64_intdigest(str(doc).encode(), codec.seed)
        want = []
        for place in range(1, 51):
            key = place * 0x9E3779B97F4A7C15 + base & sentencepiece_codec._MASK
            key = (key ^ key >> 31) * 0xBF58476D1CE4E5B9 & sentencepiece_codec._MASK
            want.append(codec._packed(plain_dropout(codec, "▁organisation", key)))
            found[want[-1]] += 1
        assert packed == b"".join(want)
    assert len(found) > 40


def test_codec_frames(spark):
    docs = cases.table(spark)
    ids = sentencepiece_codec.encoded(docs)
    back = {(r["id"], r["text"]) for r in sentencepiece_codec.decoded(ids).collect()}
    assert back == {(i, t or "") for i, t in cases.TEXTS}
    got = sentencepiece_codec.digested(docs).collect()
    assert len(got) == len(cases.TEXTS) and all(r["round_trip"] for r in got)
    assert sentencepiece_codec.digested(cases.empty(spark)).count() == 0


# -- HTML

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a = "<p>no</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/x">Menu</a></li></ul></nav><div class="cookie-notice">We use cookies.</div>
<article><h1>Head &amp; tail</h1><p>First <b>bo</b>ld<br>line&nbsp;two &lt;x&gt; &copy</p><aside>side</aside><p>Second
paragraph.<form><input value=1>Name</form><div class="ad">Buy!</div><!-- <p>hidden</p> --></p></article>
<section id="comments"><p>Nice post</p></section><footer>foot</footer></body></html>"""


def test_html_article():
    assert html_extract.main_text(PAGE) == "Head & tail First bold line two <x> © Second paragraph."


def test_html_without_article():
    good = "The river of the morning is in the house and it was to be seen that the light of the day had come to them all, as it has in the past and will be again for all of us who are here. " * 2
    page = f"<body><div><a href=/>Home</a> <a href=/b>More links here for all</a></div><h2>A short one</h2><p>{good}</p><p>Also brief.</p><p>{good}</p><ul><li><a href=1>Link one</a><li><a href=2>Link two</a></ul><p>Orphan end</p></body>"
    text = html_extract.main_text(page)
    assert good.strip() in text and "Also brief." in text and "Link one" not in text and "Home" not in text


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ('<article><p>long text <span class="share">x</span> more</p></article>', "long text more"),
        ('<article><div>long text <span class="ad">x<div>y</div></span> more</div></article>', "long text more"),
        ('<article><p style="overflow:hidden">a</p><p><b data-id="toc" title=\'class="ad"\'>b</b></p><p data-x="role=menu hidden">c</p></article>', "a b c"),
        ('<article><div class="content no-sidebar"><p class="with-comments">a</p></div><p class="main-nav">b</p><p class="x AD-slot">c</p><p hidden>d</p></article>', "a"),
        ("<article hidden>a</article><main><p>b</main>", "b"),
        ("<article>" + "<p>x<section>" * 30 + "<nav>y</nav>z</article>", "x " * 30 + "z"),
        ("<div class=ad>" + "<div>" * 300 + "x" + "</ad>" * 300 + "</div>" * 301 + "<article>a</article>", "a"),
        ("<article><nav>" + "<div>" * 300 + "x</nav>b</article>", "b"),
    ],
)
def test_html_names(page, want):
    assert html_extract.main_text(page) == want


def test_html_two_passes_beside_an_article():
    good = "The river of the morning is in the house and it was to be seen that the light of the day had come to them all, as it has in the past and will be again for all of us who are here. " * 2
    links = "<p>" + "<a href=/x>More of the links that are here for all</a>, and " * 4 + "</p>"
    text = html_extract.main_text(f"<body><article><h3><a href=/t>Teaser title</a></h3></article><div>{good}</div><div>Zq xv kj wq pl mn. {'Qwx zvk ' * 20}</div><div>{good}</div></body>")
    assert text == f"{good.strip()} {good.strip()}"
    text = html_extract.main_text(f"<body><article><h1>Title</h1><p>{good}</p>{links}<p>{'Qwx zvk ' * 12}</p>{links}<p>{good}</p></article></body>")
    assert text == f"Title {good.strip()} {good.strip()}"


class PlainReader(HTMLParser):
    """The words of an article, less the parts that are boilerplate by tag or by class."""

    def __init__(self):
        super().__init__()
        self.open, self.words = [], []

    def handle_starttag(self, tag, attrs):
        if tag not in ("br", "meta", "link", "img", "input", "hr"):
            self.open.append((tag, dict(attrs).get("class")))

    def handle_endtag(self, tag):
        if any(t == tag for t, _ in self.open):
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data):
        tags = [t for t, _ in self.open]
        if "article" in tags and not {"nav", "aside", "footer", "header", "form", "script", "style"} & set(tags) and not any(c in ("ad", "notice", "share", "comments") for _, c in self.open):
            self.words += data.split()


def plain_words(page):
    reader = PlainReader()
    reader.feed(page or "")
    return Counter(reader.words)


@pytest.mark.parametrize("sf_dir", [SF, "/root/testdata/sf0.01"])
def test_html_recall_and_precision(spark, sf_dir):
    """Word by word against a plain reading of the article; `<b>` that is never closed does no harm."""
    rows = read(spark, sf_dir, "pages").select("page_id", "html").collect()
    got = {r["id"]: Counter(r["text"].split()) for r in html_extract.extracted(read(spark, sf_dir, "pages")).collect()}
    want = {r["page_id"]: plain_words(r["html"]) for r in rows}
    both = sum((got[k] & want[k]).total() for k in want)
    assert both >= 0.99 * sum(c.total() for c in want.values()) and both >= 0.99 * sum(c.total() for c in got.values())


def plain_classes(classes):
    """The second pass, block by block."""
    decided = [k for k, c in enumerate(classes) if c in (html_extract.GOOD, html_extract.BAD)]
    out = []
    for k, c in enumerate(classes):
        left, right = max((d for d in decided if d < k), default=None), min((d for d in decided if d > k), default=None)
        sides = [d is not None and classes[d] == html_extract.GOOD for d in (left, right)]
        far = [len(classes) if left is None else k - left, 2 * len(classes) - k if right is None else right - k]
        out.append(c == html_extract.GOOD if k in decided else sides[0] if sides[0] == sides[1] else c == html_extract.NEAR or sides[far[0] > far[1]])
    return out


def test_html_second_pass_by_brute_force():
    rnd = random.Random(3)
    kinds = [html_extract.GOOD, html_extract.BAD, html_extract.NEAR, html_extract.BRIEF]
    for _ in range(3000):
        classes = [rnd.choice(kinds[rnd.randrange(2) * 2 :]) for _ in range(rnd.randrange(12))]
        assert html_extract.second_pass(classes) == plain_classes(classes), classes


@pytest.mark.parametrize("cut", range(0, len(PAGE), 7))
def test_html_cut_off_anywhere(cut):
    text = html_extract.main_text(PAGE[:cut])
    assert "<p" not in text and "Menu" not in text


def test_html_second_pass():
    g, b, near, short = html_extract.GOOD, html_extract.BAD, html_extract.NEAR, html_extract.BRIEF
    assert html_extract.second_pass([g, short, g]) == [True, True, True]
    assert html_extract.second_pass([b, short, near, b]) == [False] * 4
    assert html_extract.second_pass([b, near, g]) == [False, True, True]
    assert html_extract.second_pass([g, short, short, short, b]) == [True, True, True, False, False]
    assert html_extract.second_pass([]) == []


def test_html_rows(spark):
    rows = [(1, "u", PAGE, 1), (1, "u", PAGE, 1), (2, None, None, 2), (None, "w", "", 3), (3, "x", "plain text only", 4), (4, "y", "<article>" + "<div>" * 3000 + "deep" + "a" * 200_000, 5)]
    got = html_extract.extracted(spark.createDataFrame(rows, "page_id long, url string, html string, id long")).collect()
    assert len(got) == 6 and all(r["n_chars"] == len(r["text"]) for r in got)
    assert {r["id"]: r["text"] for r in got}[2] == "" and {r["id"]: r["n_chars"] for r in got}[4] == 200_004
    assert html_extract.extracted(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_queries_keep_every_row(spark):
    from chronolith.llm.queries import QUERIES

    pages, docs = read(spark, SF, "pages").count(), read(spark, SF, "documents").count()
    for name, query in QUERIES.items():
        n = query(spark, SF).count()
        assert n == (pages if name.split("_")[0] in ("op2", "op4") else n if name.startswith("op10") else docs), name
