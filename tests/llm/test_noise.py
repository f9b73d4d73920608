"""Noise of every alphabet goes, prose stays."""

import base64
import random

import pytest
import zstandard

from verbena.llm import compression

ALPHABETS = {"hex": "0123456789abcdef", "letters": "abcdefghijklmnopqrstuvwxyz", "digits": "0123456789", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"}


def verdict(text):
    return compression.measure(text, compression.Bands(), zstandard.ZstdCompressor(level=3).compress)[-1]


def laid_out(s, how, r):
    if how == "changing":
        out, at = [], 0
        while at < len(s):
            k = r.randint(3, 9)
            out.append(s[at : at + k])
            at += k
        return " ".join(out)
    k, sep = {"lines": (64, "\n"), "words": (8, " "), "pairs": (2, " ")}[how]
    return sep.join(s[i : i + k] for i in range(0, len(s), k))


@pytest.mark.parametrize("kind", ALPHABETS)
@pytest.mark.parametrize("how", ["lines", "words", "pairs", "changing"])
def test_noise_of_4_to_60_kilobytes_is_rejected(kind, how):
    r = random.Random(f"{kind}{how}")
    for n in (4200, 9000, 60_000):
        assert verdict(laid_out("".join(r.choice(ALPHABETS[kind]) for _ in range(n)), how, r)) == "incompressible"


@pytest.mark.parametrize("kind,least", [("base64", 520), ("base32", 1100), ("letters", 2100)])
def test_shorter_noise_is_rejected_from_where_it_can_be_told(kind, least):
    r = random.Random(kind)
    for n in (least, 2 * least):
        assert verdict(laid_out("".join(r.choice(ALPHABETS[kind]) for _ in range(n)), "lines", r)) == "incompressible"


def test_prose_with_some_noise_stays_and_noise_with_some_prose_goes():
    r = random.Random(4)
    syllables = [a + b for a in "bdfglmnprst" for b in ("a", "en", "o", "ri", "ut")]
    words = ["".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(3000)]
    text = lambda n: " ".join(words[int(3000 * r.random() ** 3)] for _ in range(n))
    some = base64.b64encode(r.randbytes(3000)).decode()
    assert verdict(text(1500)) == verdict(text(1500) + "\n" + some[:1500] + "\n" + text(1500)) == "kept"
    assert verdict(some + "\n" + text(100)) == "incompressible"
