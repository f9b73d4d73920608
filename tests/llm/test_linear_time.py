"""Long texts made to be slow take no longer than their length asks for; and forms in which keys are found."""

import base64
import json
import math
import random
import time

import pytest

from verbena.llm import quotation, secrets

from test_llm_operators import KEY


def took(f, *args):
    began = time.process_time()
    f(*args)
    return time.process_time() - began


def wrapped(n):
    """Lines of base64 that each begin as a long sequence does."""
    line = base64.b64encode(bytes([0x30, 0x83, 0x0F, 0xFF, 0xFF]) + bytes(range(1, 44))).decode()
    return "\n".join([line] * (n // (len(line) + 1)))


def chained(n):
    """The same, each with a version after the header, so that more has to be read."""
    line = base64.b64encode(bytes([0x30, 0x83, 0x0F, 0xFF, 0xFF, 2, 1, 0]) + bytes(range(1, 41))).decode()
    return "\n".join([line] * (n // (len(line) + 1)))


@pytest.mark.parametrize("text", [wrapped(1_000_000), chained(1_000_000), "b3BlbnNzaC1rZXktdjEA" + "A" * 44 + "\n" + ("b3BlbnNzaC1rZXktdjEA" + "A" * 44 + "\n") * 14_000, "ey" + "a" * 500_000 + ".ey" * 100_000, "30:" * 300_000, ("30:82:01:" * 6 + "\n") * 20_000])
def test_a_megabyte_of_candidates_takes_a_second(text):
    assert took(secrets.scan, text) < 2.5  # of this machine's seconds, which vary


def test_introduction_lines_take_linear_time():
    for line in ("am " + "schrieb " * 100_000, "on " + "wrote " * 150_000, "am " + "schrieb:" * 100_000, "on " + " " * 900_000 + ":"):
        assert took(quotation.parse, line + "\n> quoted\n") < 1.5


def test_introduction_lines():
    good = ("On Monday x wrote:", "  on wrote :  ", "Am 3. Mai schrieb Anna:", "AM x SCHRIEB:", "Le lundi Z a écrit:", "el lunes escribió :", "On a: b wrote:", "am Schriebsel:")
    bad = ("On Monday x wrote", "on xwrote:", "on_ wrote:", "wrote:", "am beschrieb:", "le écrit:", "On wrote: x:", "", ":", "el escribió")
    assert all(map(quotation.introduces, good)) and not any(map(quotation.introduces, bad))


def forms(b64):
    lines = [b64[i : i + 64] for i in range(0, len(b64), 64)]
    yield "plain", b64
    yield "wrapped", "\n".join(lines)
    yield "written out", "\\n".join(lines)
    yield "written out with returns", "\\r\\n".join(lines)
    yield "indented", "\n    ".join(lines)
    yield "quoted", "\r\n> > ".join(lines)
    yield "after a hyphen", "x-" + b64
    yield "after a written line end", "key:\\n" + b64


def test_forms_of_base64_keys():
    key = base64.b64encode(KEY).decode()
    for name, form in forms(key):
        text = f'see "{form}" and more'
        (found,) = [f for f in secrets.scan(text) if f[0] == "der"]
        assert text[found[1] : found[2]].startswith(key[:20]) and text[found[2]] == '"', name
        assert key not in secrets.redact(text)


def test_two_keys_in_one_run_of_lines():
    key = base64.b64encode(KEY).decode()
    text = "\n".join([key, key])
    assert [f[:2] for f in secrets.scan(text) if f[0] == "der"] == [("der", 0), ("der", len(key) + 1)]
    assert [f for f in secrets.scan("M" * 70 + "\n" + key) if f[0] == "der"] == [("der", 71, 71 + len(key))]


def test_keys_in_hex_with_colons():
    pairs = [f"{b:02x}" for b in KEY]
    for text in (":".join(pairs), ":\n    ".join(":".join(pairs[i : i + 15]) for i in range(0, len(pairs), 15)), ":".join(pairs).upper()):
        assert ("der", 4, 4 + len(text)) in secrets.scan(f"key {text} end")
    assert not [f for f in secrets.scan(":".join(["30", "82", "01"] * 30)) if f[0] == "der"]


def test_pem_blocks_in_quoted_mail():
    key = base64.b64encode(KEY).decode()
    body = "\n".join("> " + key[i : i + 64] for i in range(0, len(key), 64))
    text = f"He wrote:\n> -----BEGIN PRIVATE KEY-----\n{body}\n> -----END PRIVATE KEY-----\n"
    assert [f[0] for f in secrets.scan(text)] == ["pem"]


def test_tokens_with_empty_payloads():
    part = lambda x: base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=")
    signature = base64.urlsafe_b64encode(random.Random(1).randbytes(32)).decode().rstrip("=")
    for header in ({"alg": "HS256"}, {"typ": "JWT", "alg": "HS256"}):
        text = f"x {part(header)}.{part({})}.{signature} y"
        assert [f for f in secrets.scan(text) if f[0] == "jwt"] == [("jwt", 2, len(text) - 2)]


def test_hidden_words_behind_more_separators_and_in_other_scripts(spark):
    from verbena.llm import toxicity

    words = "idiot clown the and stone river light trash house".split()
    signs = "".join(chr(0x4E00 + i) for i in range(3000))  # many letters that are more frequent than those of the words
    texts = [(" ".join(words * 40),), *((" ".join(signs[i : i + 60 : 3] for i in range(0, 2940, 7)),) for _ in range(9))]
    m = toxicity.char_model(spark.createDataFrame(texts, "text string"))
    assert len(m.letters) == 96 and set("aeioutsgbclz") <= set(m.letters) and len(m.rare) > 2000
    assert abs(sum(map(math.exp, m.rare.values())) - 1) < 0.01
    r = toxicity.Restorer(m, toxicity.Params())
    for hidden in ("i/d/i/o/t", "i,d,i,o,t", "i   d   i   o   t", "id​i‍ot", "1­d10t", "1 / d / 1 / 0 / t"):
        assert "idiot" in toxicity.restore(f"the {hidden} stone", r), hidden
    assert toxicity.restore("the stone 1, 2 and 3", r)[:2] == ["the", "stone"]
    assert toxicity.log_prob(next(iter(m.rare)), m) > toxicity.log_prob("ก", m)
