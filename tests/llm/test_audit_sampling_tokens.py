"""Source divergence, importance resampling and token counts against plain versions of their definitions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from verbena.llm import divergence, importance, token_counts

SCHEMA = "doc_id long, text string, lang string, source string"
TERM, WORD = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+"), re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# --- source divergence


def brute_divergence(rows, min_docs=30, top=50, scale=10**9):
    df, n, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        key = (lang or "", source or "")
        groups.add(key)
        terms = TERM.findall(low(text))
        df[key[0]].update(set(terms))
        n[key].update(terms)
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, c in df[lang].items() if c >= min_docs]
        own = sorted(s for g, s in groups if g == lang)
        p = {}
        for s in [*own, None]:
            c = {t: n[lang, s][t] if s is not None else sum(n[lang, x][t] for x in own) for t in kept}
            p[s] = {t: 1 + scale * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}
        for s in own:
            pairs = [(sum(abs(p[s][t] - p[x][t]) for t in kept), x) for x in own if x != s]
            terms = [(p[s][t] - p[None][t], t) for t in kept if n[lang, s][t] and p[s][t] > p[None][t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                ordered = sorted(found, key=lambda f: (-f[0], f[1].encode()))[:most]
                out += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(ordered, 1)]
    return sorted(out)


def groups_of_texts(seed, n=400):
    r = random.Random(seed)
    words = [f"{a}{b}" for a in "abcdefgh" for b in ("la", "mö", "RÉ", "zz")]
    rows = [(i, " ".join(r.choice(words[: 8 + 8 * (i % 4)]) + r.choice([" ", ",", "3", "'"]) for _ in range(r.randint(0, 40))), r.choice(["en", "de", None, ""]), f"s{min(r.randint(0, 40), 9)}") for i in range(n)]
    return rows + [(None, None, None, None), (7, "", "xx", "only"), (7, "Ala", "yy", "a"), (8, "", "yy", "b"), (9, "1 2", "en", "silent")]


@pytest.mark.parametrize("p", [divergence.Params(), divergence.Params(chunk_terms=3, block_groups=2, flush_entries=10), divergence.Params(min_docs=1, top_terms=3, least_blocks=1, broadcast_groups=0)])
def test_divergence_against_its_definition(spark, p):
    rows = groups_of_texts(3)
    x = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA + ", term string").repartition(3)
    got = sorted(tuple(r) for r in divergence.divergence(x, p=p).select("lang", "source", "part", "item", "value", "rank").collect())
    assert got == brute_divergence(rows, p.min_docs, p.top_terms)


def test_divergence_of_nothing_and_of_huge_counts(spark):
    assert divergence.divergence(spark.createDataFrame([], SCHEMA)).count() == 0
    p = divergence.Params()
    n = np.array([0, 3, 10**10, 4 * 10**15])
    want = [1 + p.scale * (int(c) + 5) // (9 * 10**15 + 5 * 11) for c in n]
    assert divergence.shares(n, 9 * 10**15, 11, p).tolist() == want
    x = spark.createDataFrame([(int(c),) for c in n], "n long").selectExpr("n", "9000000000000000L AS total", "11L AS kept")
    assert [r[0] for r in x.select(divergence.share(x.n, x.total, x.kept, p)).collect()] == want


def test_long_texts_are_cut_between_words():
    text = b"ab " * 1000 + b"c" * 500
    assert b"".join(divergence.pieces(text, 64)) == text
    assert [w for part in divergence.pieces(text, 64) for w in part.split()] == text.split()


# --- importance resampling


def features(text):
    w = WORD.findall(low(text))
    return len(w), Counter(zlib.crc32(f.encode()) % 10_000 for f in w + [" ".join(x) for x in zip(w, w[1:])])


def brute_resample(rows, target):
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(features(text)[1])
    for text in target:
        t.update(features(text)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    out, able = [], []
    for doc_id, text in rows:
        n, f = features(text)
        total = sum(f.values())
        gain = sum(c * math.floor(1000 * math.log((t[b] + 1) * (big_s + 10_000) / ((s[b] + 1) * (big_t + 10_000)))) for b, c in f.items())
        weight = gain // total if total else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc_id, total, weight, score, None])
        if n >= 20:
            able.append(out[-1])
    able.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for k, r in enumerate(able[: 25 * len(able) // 100], 1):
        r[4] = k
    return sorted(map(tuple, out), key=str)


@pytest.mark.parametrize("p", [importance.Params(), importance.Params(block_entries=50, block_docs=3)])
def test_resampling_against_its_definition(spark, p):
    r = random.Random(5)
    words = "the Tree é9 river stone x1 light house green walk under bright song ünder".split()
    rows = [(i // 2 * 2, " ".join(r.choice(words) + r.choice(["", "s", ".", " 7"]) for _ in range(r.randint(0, 60)))) for i in range(300)]
    rows += [(None, None), (None, "tree " * 30), (900, "copy of one " * 20), (900, "copy of one " * 20), (901, "")]
    target = ["tree river tree river stone", None, "light Light house"]
    docs = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, rank int").repartition(4)
    items = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    got = importance.resample(docs, items, p=p)
    assert [t for _, t in got.dtypes] == ["bigint"] * 5
    assert sorted((tuple(x) for x in got.collect()), key=str) == brute_resample(rows, target)


def test_resampling_of_nothing(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert importance.resample(docs, items).count() == 0
    one = importance.resample(spark.createDataFrame([(1, "a b " * 12)], "doc_id long, text string"), items).collect()
    assert len(one) == 1 and one[0]["n_features"] == 47 and one[0]["rank"] is None  # floor(25 * 1 / 100) are drawn


def test_features_of_a_long_text_run_across_parts():
    text = ("Ab c1 " * 300_000).encode()
    n, row = importance.features(text, 10_000)
    assert n == 600_000 and row.sum() == 1_199_999 and {int(row[zlib.crc32(f) % 10_000]) for f in (b"ab", b"c1", b"ab c1")} == {300_000}


# --- token counts


def library_count(text):
    t, _ = token_counts.tokenizer(token_counts.Params().vocabulary)
    return len(t.encode(text or "", add_special_tokens=False))


def odd_texts(seed):
    r = random.Random(seed)
    bits = ["the", " river", "  ", "\n", "\n\n ", "'ll", "'s", "it's", "12", " 345", "a1b2", "é", "中文字", "，", "!?", "...", "<|endoftext|>", "<|endof", "text|>", "\x1c", "\x85", " ", "　", "​", "👍🏽", "x" * 50, "\t", "Σς", "ab'Re", "́"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 60))) for _ in range(60)]
    texts += ["".join(r.choice(bits) for _ in range(2000)) for _ in range(6)]
    return [None, "", " ", "a" * 5000, " " * 3000, "<|endoftext|>" * 200, "中" * 2500, *texts, texts[-1], texts[-1]]


@pytest.mark.parametrize("p", [token_counts.Params(huge_chars=300, overlap_chars=40), token_counts.Params(huge_chars=64, overlap_chars=20, cache_pieces=10)])
def test_counts_are_those_of_the_library(spark, p):
    texts = odd_texts(11)
    x = spark.createDataFrame([(None if i == 5 else i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int").repartition(3)
    got = sorted((tuple(r) for r in token_counts.count_tokens(x, p=p).collect()), key=str)
    want = [(None if i == 5 else i, len((t or "").encode()), library_count(t)) for i, t in enumerate(texts)]
    assert got == sorted(((*w, w[2] > 1024) for w in want), key=str)
    assert token_counts.count_tokens(x.limit(0), p=p).count() == 0


def test_overlaps_widen_until_neighbours_agree(spark):
    """Letters alone have no stable place, so only a chunk of the whole text is sure of its tokens."""
    p = token_counts.Params(huge_chars=200, overlap_chars=30)
    texts = ["abcde" * 300 + " and more" * 100, "one two three " * 200]
    x = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "key string, text string")
    assert {r["key"]: r["n_tokens"] for r in token_counts.spliced_counts(x, p).collect()} == {str(i): library_count(t) for i, t in enumerate(texts)}


def test_stable_places_hold_in_any_context():
    """Cut at a stable place, a text has the tokens of its two parts."""
    _, added = token_counts.tokenizer(token_counts.Params().vocabulary)
    seen = 0
    for text in odd_texts(13)[7:30]:
        for x in token_counts.stable_places(text, 0, len(text), added):
            assert library_count(text[:x]) + library_count(text[x:]) == library_count(text)
            seen += 1
    assert seen > 200
    assert token_counts.stable_places("a b", 0, 3, added) == [1] and token_counts.stable_places("x <|endoftext|>1", 3, 15, added) == []


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        token_counts.tokenizer("word_bpe_49k.json")
