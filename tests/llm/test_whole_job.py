"""Nothing is left out: long words, last chunks, repeated ids, large records, unclosed blocks; and the pipeline as a whole."""

import base64
import random
import time
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pytest

import corpus_pipeline
from verbena.llm import attention_lm, compression, decontam, licenses, packing, quotation, secrets, simhash, toxicity, warc

from test_llm_operators import KEY, brute_fingerprint, docs, openssh, prose


@pytest.fixture(scope="module")
def chars():
    letters = "^?abcdefghijklmnopqrstuvwxyz"
    counts = np.zeros((28, 28, 28))
    for w in "idiot clown the and stone river light trash house a i".split():
        s = "^" + w + "^"
        for i in range(1, len(s)):
            counts[letters.index(s[i - 2]) if i > 1 else 0, letters.index(s[i - 1]), letters.index(s[i])] += 50
    return toxicity.CharModel.fit(letters, counts)


def path_score(letters, m, costs):
    """Log-probability of letters and edges one after the other, edges in a row taken as one."""
    total, x, y = -costs, 0, 0
    for ch in letters + "^":
        z = m.place(ch)
        if y or z:
            total += float(m.logp[x if y else 0, y, z])
        x, y = y, z
    return total


@pytest.mark.parametrize("observed", ["1d10t", "idiooot", "c|0wn", "1d-10t", "st0ne", "*1+", "a'b.c", "!!!d10t"])
def test_viterbi_equals_enumeration(chars, observed):
    steps = toxicity.lattice(observed)
    every = {}
    for path in product(*steps):
        letters = "".join(x for x, _ in path)
        every[letters] = max(every.get(letters, -1e9), path_score(letters, chars, 1.5 * sum(u for _, u in path)))
    text, score = toxicity.viterbi(steps, chars, 1.5)
    assert score == pytest.approx(max(every.values())) and every[text] == pytest.approx(score)


def test_words_of_any_length_and_inner_marks_are_decoded(chars):
    r = toxicity.Restorer(chars, toxicity.Params())
    for k in (5, 9, 4000):
        assert toxicity.restore("1d10t" * k, r) == ["idiot" * k]
    for hidden in ("1d10t's", "1d10t-l1ght", "id.iot", "\"i d i o t\"", "(i.d.i.o.t)", "(1d10t)"):
        assert "idiot" in " ".join(toxicity.restore(f"the {hidden} stone", r))


def test_every_byte_is_in_a_chunk():
    known = [bytes(random.Random(i).choices(b"etaoinshrdlu", k=2 + i % 7)) for i in range(400)]  # words that come again, or they would be noise themselves
    noise, words = base64.b64encode(random.Random(2).randbytes(9000)), b" ".join(random.Random(1).choices(known, k=4000))
    sizes = lambda b: [len(b[max(0, i) : i + 10]) for i in range(0, len(b), 10)]
    for n in (11, 19, 20, 21, 40):
        parts = compression.chunk_ratios(words[:n], 10, lambda b: b)
        assert sum(k for k, _ in parts) == n and [k for k, _ in parts] == sizes(words[:n]) and all(x == 1 for _, x in parts)
    import zstandard

    compress = zstandard.ZstdCompressor(level=3).compress
    judge = lambda b: compression.measure(b.decode(), compression.Bands(), compress)[-1]
    assert judge(words[:5000] + noise[:8000]) == "incompressible" and judge(words[:8000] + noise[:3000]) == "kept"
    assert judge(words[:3000] + b"na " * 3000) == "repetitive" and judge(words[:3000]) == "kept" and judge(noise[:300]) == "incompressible"


def test_boundaries_are_optimal_for_long_texts(spark):
    lengths = [5000, 5001, 5003, 70_001, 70_002, 70_003, 9, 9, 10]
    rows = spark.createDataFrame([(n,) for n in lengths], "n long")
    got, counts = packing.length_histogram(rows, "n")
    assert packing.optimal_boundaries(got, counts, 3) == [10, 5003, 70_003]


def test_blocks_of_all_kinds_and_unclosed_ones():
    pem = lambda label, b, head="": f"-----BEGIN {label}-----\n{head}{base64.encodebytes(b).decode()}-----END {label}-----"
    kinds = lambda text: [(k, text[a:z]) for k, a, z in secrets.scan(text) if k == "pem"]
    good = [pem("OPENSSH PRIVATE KEY", openssh(9)), pem("RSA PRIVATE KEY", bytes(64), "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00\n\n"), pem("RSA PRIVATE KEY", KEY)]
    for g in good:
        assert kinds(f"x {g} y") == [("pem", g)]
        assert kinds("-----BEGIN RSA PRIVATE KEY-----\nlost\n" + g + "\n-----END PRIVATE KEY-----") == [("pem", g)]
    assert kinds(" ".join(good)) == [("pem", g) for g in good]
    assert not kinds(pem("RSA PRIVATE KEY", bytes(63), "DEK-Info: x\n")) and not kinds(pem("OPENSSH PRIVATE KEY", KEY))
    began = time.time()
    assert not kinds("-----BEGIN RSA PRIVATE KEY-----\n" * 8000)
    assert not kinds("-----BEGIN RSA PRIVATE KEY-----\n" * 8000 + "-----END RSA PRIVATE KEY-----\n" * 8000)
    assert time.time() - began < 2


def test_empty_tables_and_clashing_names(spark):
    none = docs(spark).limit(0)
    assert secrets.digest(secrets.find_secrets(none)).count() == 0
    assert compression.verdicts(compression.compression_bands(none)).count() == 0
    assert toxicity.score(none, spark.createDataFrame([], "doc_id long, toxic int")).count() == 0
    pages = spark.createDataFrame([(1, "u", "<p>", "r", 5)], "page_id long, url string, html string, type string, n int")
    assert warc.archive_pages(pages).first()["record_type"] == "response"


def test_rows_of_one_id_are_taken_together(spark):
    items = spark.createDataFrame([(1, prose(50, 24)), (2, prose(51, 200))], "item_id long, text string")
    item = prose(50, 24).split()
    rows = [(7, " ".join(item[:14])), (7, " ".join(item[10:])), (8, " ".join(item[:14])), (9, None)]
    got = decontam.contaminated_pairs(docs(spark, *rows), items).collect()
    assert [(r["doc_id"], r["item_id"], r["n_shared"]) for r in got] == [(7, 1, 20)]


def test_containment_equals_brute_force(spark):
    r = random.Random(3)
    phrase = "all of these items share one and the same long phrase of words"
    texts = [prose(200 + i, r.choice((5, 8, 20, 70))) + (" " + phrase if i % 2 else "") for i in range(40)]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    rows = [(i, " ".join([prose(900 + i, 30), *(" ".join(w for w in t.split() if r.random() > 0.02) for t in r.sample(texts, 2)), prose(800 + i, 5)])) for i in range(30)]
    rows += [(100 + i, f"{phrase} {prose(700 + i, 9)}") for i in range(10)]
    cut = lambda t: {tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))}
    want = {(d, i) for d, t in rows for i, x in enumerate(texts) if len(cut(t) & cut(x)) >= 0.8 * len(cut(x)) - 1e-9}
    for p in (decontam.Params(), decontam.Params(common_items=0, spare=1)):
        assert {(x["doc_id"], x["item_id"]) for x in decontam.contaminated_pairs(docs(spark, *rows), items, p=p).collect()} == want
    assert want


def test_groups_of_bits_follow_the_number_of_fingerprints(spark):
    assert [simhash.choose_blocks(n, 4, 8) for n in (0, 1 << 24, (1 << 24) + 1, 1 << 30, 1 << 34, 1 << 40)] == [6, 6, 7, 7, 8, 10]
    r = np.random.default_rng(1)
    fps = [int(x) for x in r.integers(0, 1 << 62, 40)]
    fps += [f ^ 0b10011 for f in fps[:9]]
    ids = spark.createDataFrame(list(enumerate(fps)), "id long, fp long")
    for blocks in (None, 5, 7, 8):
        for rows in (0, 100):
            got = {x["fp"]: x["class_id"] for x in simhash.fingerprint_classes(ids, simhash.Params(blocks=blocks, broadcast_rows=rows)).collect()}
            assert [got[f] for f in fps] == [*range(40), *range(9)]


def test_large_records_lie_apart_and_digests_are_held(spark, tmp_path):
    rows = [(i, f"u{i}", ("x" * 3000 if i % 3 else "y") + str(i // 4)) for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.archive_pages(pages, p=warc.Params(small_bytes=2000, file_bytes=10_000), path=str(tmp_path / "w")).collect()
    first = {}
    for i, _, html in rows:
        first.setdefault(html, i)
    assert {(r["page_id"], r["record_type"], r["refers_to"]) for r in got} == {(i, "response", None) if first[h] == i else (i, "revisit", first[h]) for i, _, h in rows}
    assert len(got) == 40 and {x.name for x in (tmp_path / "w/captures").iterdir()} == {"small", "large"}
    bad = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Payload-Digest: sha1:AAAA\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad/part-0.warc").write_bytes(bad.encode())
    with pytest.raises(Exception, match="does not have its digest"):
        warc.read_records(spark, str(tmp_path / "bad")).collect()


def test_pipeline_against_brute_force(spark, tmp_path):
    """Each stage's rows from its predecessor's by the plainest means: labels that are easy to learn, pairs, sets and lists."""
    clean = {i: prose(i, 60) for i in range(1, 80)}
    item = prose(500, 30)
    clean[60] = clean[3]
    clean[61] = clean[4] + " more"
    clean[62] = f"{clean[62]} {item} {clean[63]}"
    clean[64] = clean[64] + " password=abcdef99 end"
    toxic = {i: prose(i, 60) + " 1d10t clown" for i in range(100, 140)}
    rows = [(i, t, "en", "s", len(t)) for i, t in (clean | toxic).items()] + [(200, None, None, None, None), (201, "", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i >= 100)) for i in clean | toxic], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    left = {i: t for i, t, *_ in rows if i not in toxic}
    fps, root = {i: brute_fingerprint(t) for i, t in left.items()}, {i: i for i in left}
    for _ in left:
        for a in left:
            for b in left:
                if bin(fps[a] ^ fps[b]).count("1") <= 4:
                    root[a] = root[b] = min(root[a], root[b])
        if all(root[root[a]] == root[a] for a in left):
            break
    left = {i: t for i, t in left.items() if root[i] == i}
    cut = lambda t: {tuple((t or "").split()[i : i + 5]) for i in range(len((t or "").split()) - 4)}
    left = {i: t for i, t in left.items() if len(cut(t) & cut(item)) < 0.8 * len(cut(item))}
    left = {i: secrets.redact(t) for i, t in left.items()}
    assert 60 not in left and 62 not in left and "<SECRET>" in left[64] and {200, 201} & set(left) == {200}
    counts = packing.piece_counts(packing.Params().vocabulary)
    assert {r["doc_id"]: r["n_tokens"] for r in got} == {i: len(counts.encode(t or "")) for i, t in left.items()}
    lengths = Counter(r["n_tokens"] for r in got)
    bounds = packing.optimal_boundaries(np.array(sorted(lengths)), np.array([lengths[n] for n in sorted(lengths)]), 16)
    assert all(r["bucket"] == min(b for b in bounds if b >= r["n_tokens"]) for r in got)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        empty = spark.read.parquet(str(tmp_path / "documents.parquet")).limit(0)
        assert stage(spark, empty, str(tmp_path)).columns == empty.columns, name


def brute_threads(rows):
    """Replies by the plainest reading of the rules: earlier message with most first-level quotes, then a walk down each tree."""
    parsed = [quotation.parse(t) for *_, t in rows]
    reply = {}
    for i, (conv, turn, _, _) in enumerate(rows):
        votes = Counter()
        for level, _, h in parsed[i][2]:
            said = [(rows[j][1], j) for j in range(len(rows)) if rows[j][0] == conv and rows[j][1] is not None and h in parsed[j][1]]
            if turn is not None and said and min(said)[0] < turn and level == 1:
                votes[min(said)[1]] += 1
        if votes:
            reply[i] = max(votes, key=lambda j: (votes[j], rows[j][1], j))
    place = {}

    def walk(i, root):
        place[i] = (rows[root][1], sum(1 for r in place.values() if r[2] == root), root)
        for j in sorted((j for j in reply if reply[j] == i), key=lambda j: (rows[j][1], j)):
            walk(j, root)

    for i in range(len(rows)):
        if i not in reply:
            walk(i, i)
    return {i: (place[i][0], place[i][1], rows[reply[i]][1] if i in reply else None, parsed[i][0]) for i in range(len(rows))}


def test_reply_order_equals_a_walk(spark):
    r = random.Random(8)
    rows = []
    for conv in range(6):
        for turn in range(r.choice((1, 3, 40))):
            said = f"message {conv} {turn} says {r.randrange(99999)}"
            quoted = "".join(f"{'> ' * (1 + (r.random() < 0.2))}{rows[-1 - r.randrange(min(turn, 5))][3].split(chr(10))[-1].upper()}\n" for _ in range(r.choice((0, 1, 1, 2)))) if turn else ""
            rows.append((conv, turn, "u", quoted + said))
    rows += [(9, t, "u", "root" if t == 0 else f"> root\nreply {t}") for t in (0, 5000, 3, 600, 512, 511, 70_000)] + [(9, 3, "u", "> root\nreply 3 again"), (9, None, "u", "> root"), (None, 0, "u", "a"), (None, 1, "u", "> a\nb")]
    rows += [(10, t, "u", f"link {t}" if t == 0 else f"> link {t - 1}\nlink {t}") for t in range(70)]
    m = spark.createDataFrame([(*x, "y") for x in rows], "conv_id long, turn long, role string, text string, position string").coalesce(1)
    want = Counter((rows[i][0], rows[i][1], a, b, c, text) for i, (a, b, c, text) in brute_threads(rows).items())
    got = quotation.link_quotes(m).collect()
    assert Counter((x["conv_id"], x["turn"], x["thread_turn"], x["position"], x["reply_to"], x["text"]) for x in got) == want
    chain = [x["position"] for x in got if x["conv_id"] == 10]
    assert chain == list(range(70)) and max(x["depth"] for x in got) == 69
    long = spark.createDataFrame([(1, 0, "u", "word " * 30_000), (1, 1, "u", "> " + "word " * 30_000 + "\nyes")], "conv_id long, turn long, role string, text string")
    assert [x["n_linked"] for x in quotation.link_quotes(long).collect()] == [0, 1]


def test_licence_scans_at_the_edges(spark):
    from verbena.llm.license_texts import TEMPLATES

    mit, line = TEMPLATES["MIT"], TEMPLATES["MIT-reference"]
    assert licenses.scan_licenses(docs(spark).limit(0)).count() == 0
    rows = [(1, line), (1, line), (2, f"{mit}\n\n{prose(1, 40)}\n\n{mit}"), (3, "\n".join([prose(2, 20_000), line, prose(3, 20_000)]))]
    got = Counter((r["doc_id"], r["license"]) for r in licenses.scan_licenses(docs(spark, *rows)).collect())
    assert got == {(1, "MIT-reference"): 2, (2, "MIT"): 2, (3, "MIT-reference"): 1}


@pytest.mark.parametrize("gap", [1, 2, 3, 5, 8])
def test_no_line_between_others_is_lost(gap):
    from verbena.llm.license_texts import TEMPLATES

    s = licenses.scanner(TEMPLATES, licenses.Params())
    text = f"\n{' '.join('abcdefgh'[:gap])}\n".join(["All rights reserved"] * 30)
    assert sum(h[0] == "All-rights-reserved" for h in s.scan(text)) == 30


def aligned(template, words):
    """The best score of aligning the whole template with any stretch of words: match 2, change or gap -1."""
    m, n = len(template), len(words)
    best = [[0] * (n + 1) for _ in range(m + 1)]
    for i in range(1, m + 1):
        best[i][0] = -i
        for j in range(1, n + 1):
            best[i][j] = max(best[i - 1][j - 1] + (2 if template[i - 1] == words[j - 1] else -1), best[i - 1][j] - 1, best[i][j - 1] - 1)
    return max(best[m])


def test_alignment_equals_the_full_table():
    r = random.Random(6)
    for _ in range(60):
        template = [r.randrange(1, 9) for _ in range(r.randrange(3, 25))]
        copy = [w for t in template if r.random() > 0.1 for w in ([t] if r.random() > 0.1 else [t, 9])]
        words = [0] * r.randrange(6) + copy + [0] * 6
        wide = len(template) + len(words)
        pairs = licenses.align(template, words, 0, wide)
        assert all(template[a] == words[b] for a, b in pairs) and pairs == sorted(pairs)
        inside = pairs[-1][1] - pairs[0][1] + 1 - len(pairs) if pairs else 0
        lost = len(template) - len(pairs)
        assert aligned(template, words) <= 2 * len(pairs) - max(inside, 0) and aligned(template, words) >= 2 * len(pairs) - inside - lost


def test_attention_beats_bigrams_and_the_base(spark):
    """Each text keeps to one topic, but every second word tells nothing of it: only what attention looks back to does."""
    r = random.Random(1)
    topics = [[f"{a}{b}" for b in "ban dor fil gam".split()] for a in ("ra", "te", "no", "mu")]
    texts = {i: " ".join(f"{r.choice(t)} and" for t in [r.choice(topics)] for _ in range(30)) for i in range(600)}
    p = attention_lm.Params(head=60, dim=16, batch=8, rate=2e-2)
    rows = docs(spark, *texts.items()).repartition(4)
    model, _ = attention_lm.fit(rows, p=p)
    held = [t for i, t in texts.items() if zlib.crc32(str(i).encode()) % 10 == 0]
    train = [t for i, t in texts.items() if zlib.crc32(str(i).encode()) % 10]
    ids, n = attention_lm.word_ids(p.vocabulary), len(model.net.group)
    after = lambda y: (np.r_[n - 1, y[:-1]], y)
    y, tails, *_ = attention_lm.Coded.of(held).pieces(model.classes, model.tail, n - 1, ids)
    seen = np.zeros((n, n))
    np.add.at(seen, after(attention_lm.Coded.of(train).pieces(model.classes, model.tail, n - 1, ids)[0]), 1)
    one = (seen.sum(axis=0) + 0.1) / (seen.sum() + 0.1 * n)
    bigram = np.log(((seen + 5 * one) / (seen.sum(axis=1, keepdims=True) + 5))[after(y)]).sum() + tails.sum()
    attention = attention_lm.spelled(attention_lm.Coded.of(held), model, ids).sum()
    assert attention > bigram * 0.8  # natural logs, below zero
    got = [x for x in attention_lm.score(rows, p=p).collect() if x["held_out"]]
    assert sum(x["score"] for x in got) > sum(x["base_score"] for x in got)


def test_partitions_without_rows(spark):
    """Every operator over more partitions than rows."""
    rows = docs(spark, (1, prose(1, 30)), (2, prose(2, 30)), (3, "")).repartition(7)
    p = attention_lm.Params(head=30, dim=8)
    assert attention_lm.score(rows, p=p).count() == 3
    assert toxicity.score(rows, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int").repartition(5)).count() == 3
    assert packing.pack(rows).count() == 3 and simhash.near_duplicates(rows).count() == 3
    assert compression.verdicts(compression.compression_bands(rows)).count() == 3 and secrets.digest(secrets.find_secrets(rows)).count() == 3
    assert licenses.scan_licenses(rows).count() == 0
