import itertools
import random

import pytest
from gguf_writer import written

from verbena import session
from verbena.contracts import ContractError
from verbena.functions import tokenizers as K

BYTES = K.byte_characters()
RANKED = [*BYTES, "bc", "ab", "abc", "aa", "aaaa", "12", "123", "<|b|>", "<|e|>", "<|x|>", "<|x|>long"]
MERGES = ["b c", "a b", "a bc", "a a", "aa aa", "1 2", "12 3"]
SCORED = ["<pad>", "<eos>", "<bos>", "<unk>", "a", "b", "c", "ab", "bc", "abc", K.BLANK, "z", "é", "<0x61>", "zz", "za", *(f"<0x{b:02X}>" for b in range(256))]


def ranked(**changed):
    types = [1] * 263 + [3] * 4
    base = {
        "general.architecture": (8, "lfm2"), "tokenizer.ggml.model": (8, "gpt2"), "tokenizer.ggml.pre": (8, "lfm2"), "tokenizer.ggml.tokens": (9, (8, RANKED)), "tokenizer.ggml.token_type": (9, (5, types)),
        "tokenizer.ggml.merges": (9, (8, MERGES)), "tokenizer.ggml.bos_token_id": (4, 263), "tokenizer.ggml.eos_token_id": (4, 264),
    } | changed
    return written(values=[(k, *v) for k, v in base.items() if v])


def scored(**changed):
    types, scores = [3, 3, 3, 3] + [1] * 12 + [6] * 256, [0.0] * 272
    scores[7], scores[8], scores[9], scores[14] = 1.0, 2.0, 3.0, -0.0
    base = {
        "general.architecture": (8, "gemma-embedding"), "tokenizer.ggml.model": (8, "llama"), "tokenizer.ggml.tokens": (9, (8, SCORED)), "tokenizer.ggml.token_type": (9, (5, types)), "tokenizer.ggml.scores": (9, (6, scores)),
        "tokenizer.ggml.bos_token_id": (4, 2), "tokenizer.ggml.eos_token_id": (4, 1), "tokenizer.ggml.unknown_token_id": (4, 3),
    } | changed
    return written(values=[(k, *v) for k, v in base.items() if v])


@pytest.fixture
def files(tmp_path):
    def put(name, data):
        (tmp_path / name).write_bytes(data)
        return str(tmp_path / name)

    return put


def test_ranked_merges(files):
    v = K.vocabulary(files("r.gguf", ranked()))
    cases = {("abc", True): [263, 258], ("abc", False): [258], ("aaaaaa", False): [260, 259], ("1234 12345", False): [262, 52, 32, 262, 52, 53], ("a<|x|>longb<|x|>", False): [97, 266, 98, 265], ("", False): [], ("", True): [263]}
    for (text, special), ids in cases.items():
        assert v.encode(text, special) == ids
    assert v.decode([263, 258, 264]) == "<|b|>abc<|e|>" and v.decode([]) == ""
    for text in ("café 😀 漢 العربية é", "a\0b", " x  y\n\n z\t"):
        assert v.decode(v.encode(text, False)) == text
    assert v.decode([226, 130, 97, 237, 160, 128]).encode().hex() == "efbfbd61efbfbdefbfbdefbfbd"
    assert len(v.encode("a" * 20_000, False)) == 5_000


def test_scored_merges(files):
    v = K.vocabulary(files("s.gguf", scored()))
    for text, special, ids in (("abc", True, [2, 9, 1]), ("abc", False, [9]), ("zza", False, [11, 15]), (" ab", False, [10, 7]), ("😀", False, [256, 175, 168, 144]), ("", True, [2, 1])):
        assert v.encode(text, special) == ids
    assert v.decode([13]) == "<0x61>" and v.decode([2, 10, 7, 256, 175, 168, 144, 1]) == " ab😀"
    no = K.vocabulary(files("n.gguf", scored(**{"tokenizer.ggml.add_bos_token": (7, False), "tokenizer.ggml.add_eos_token": (7, False)})))
    assert no.encode("abc", True) == [9]


def test_merging_equals_the_plain_rule():
    """Again and again the least pair, the leftmost of equals."""
    r = random.Random(2)
    for _ in range(200):
        rules = {(a, b): ((r.randrange(4),), a + b) for a, b in itertools.product(("a", "b", "ab", "ba", "aa", "bb"), repeat=2) if r.random() < 0.4}
        text = [r.choice("ab") for _ in range(r.randrange(12))]
        want = list(text)
        while found := sorted((rules[want[i], want[i + 1]][0], i) for i in range(len(want) - 1) if (want[i], want[i + 1]) in rules):
            i = found[0][1]
            want[i : i + 2] = [rules[want[i], want[i + 1]][1]]
        assert K.merged(list(text), lambda a, b: rules.get((a, b))) == want


@pytest.mark.parametrize(
    "data, message",
    [
        (ranked(**{"tokenizer.ggml.token_type": None}), "missing tokenizer.ggml.token_type"), (ranked(**{"tokenizer.ggml.token_type": (9, (5, [1]))}), "tokenizer.ggml.token_type"), (ranked(**{"tokenizer.ggml.bos_token_id": (4, 999)}), "bos_token_id outside"),
        (ranked(**{"tokenizer.ggml.merges": (9, (8, ["q zz"]))}), "merge operands outside"), (ranked(**{"tokenizer.ggml.merges": (9, (8, ["b a"]))}), "makes is no token"), (ranked(**{"tokenizer.ggml.merges": (9, (8, ["ab"]))}), "is not two parts"),
        (scored(**{"tokenizer.ggml.scores": (9, (6, [float("nan")] * 272))}), "non-finite"), (ranked(**{"tokenizer.ggml.pre": (8, "other")}), "unsupported"), (scored(**{"tokenizer.ggml.tokens": (9, (8, ["", *SCORED[1:]]))}), "invalid UTF-8 token"),
        (written(), "unsupported"),
    ],
)
def test_broken_vocabularies(files, data, message):
    with pytest.raises(ContractError, match=message):
        K.vocabulary(files("x.gguf", data))


def test_functions_in_sql(spark, files):
    session.load(spark)
    r, s = files("r.gguf", ranked()), files("s.gguf", scored())
    q = f"SELECT semantic_tokenize(IF(id % 2 = 0, '{r}', '{s}'), IF(id % 3 = 0, '', 'abc'), id % 4 = 0) AS ids, id FROM range(600)"
    for row in spark.sql(q).collect():
        i = row["id"]
        assert row["ids"] == ([263] * (i % 4 == 0) + [258] * (i % 3 > 0) if i % 2 == 0 else [9] * (i % 3 > 0))
    one = lambda e: spark.sql(f"SELECT {e} AS x").first()["x"]
    assert one(f"semantic_detokenize('{r}', array(263, 258))") == "<|b|>abc"
    assert one(f"semantic_tokenize('{r}', NULL, true)") is None and one("semantic_tokenize(CAST(NULL AS STRING), 'a', true)") is None and one(f"semantic_detokenize('{r}', CAST(NULL AS ARRAY<INT>))") is None
    for bad, message in (("array(-1)", "outside"), ("array(267)", "outside"), ("array(CAST(NULL AS INT))", "NULL token id")):
        with pytest.raises(Exception, match=message):
            one(f"semantic_detokenize('{r}', {bad})")
    # Ids meet their pieces in the container's own vocabulary.
    joined = spark.sql(f"SELECT t.pos, v.value FROM (SELECT posexplode(semantic_tokenize('{r}', 'abc aa', false)) AS (pos, id)) t JOIN gguf_metadata_array('{r}', 'tokenizer.ggml.tokens') v ON v.array_index = t.id ORDER BY pos").collect()
    assert [x["value"] for x in joined] == ["abc", "Ġ", "aa"]
    assert one("semantic_maxsim(array(array(1, 0), array(0, 1)), array(array(.5, .5), array(1, 0)))") == 1.5 and one("semantic_maxsim(NULL, array(array(1.0)))") is None
    with pytest.raises(Exception, match="rectangular"):
        one("semantic_maxsim(array(array(1, 0), array(0)), array(array(1, 0)))")
    assert session.connect(extension=False).version == spark.version
