"""What ``op5_attention_scores`` spends beside its arithmetic."""

import random
import resource
import subprocess
import sys
from pathlib import Path

from verbena.llm import attention_lm
from verbena.llm.common import words_lower

ODD = "ab \t\n\x0b\x0c\r\x1c\x85\xa0 　'sZÀé​9.-😀"


def test_words_are_coded_and_cut_as_one_by_one():
    """Few calls of the tokenizer for many words, with the ids of each word alone; white space beyond ASCII at a word's ends, too."""
    r = random.Random(1)
    texts = [None, "", " ", "\n a  b ", "it's IT'S don't"] + ["".join(r.choice(ODD) for _ in range(r.randrange(80))) for _ in range(300)]
    texts += [" ".join("".join(r.choice("stone river") for _ in range(r.randrange(1, 9))) for _ in range(200)).replace("  ", " ") for _ in range(20)]
    coded = attention_lm.Coded.of(texts)
    assert [coded.words[i] for i in coded.code] == [w for t in texts for w in [*words_lower(t), attention_lm.END]]
    assert coded.length.tolist() == [len(words_lower(t)) + 1 for t in texts]

    ids = attention_lm.WordIds(attention_lm.Params.vocabulary)
    alone, calls = ids.encode, []
    ids.encode = lambda text: calls.append(text) or alone(text)
    plain = [w for w in coded.words[1:] if w.decode().isascii() and w.decode().isprintable()]
    flat, size = ids.cut(plain)
    assert len(plain) > 1000 and len(calls) == 1
    flat, size = ids.cut(coded.words[1:])
    want = [alone(" " + w.decode()) for w in coded.words[1:]]
    assert size.tolist() == [len(w) for w in want] and flat.tolist() == [i for w in want for i in w]
    calls.clear()
    assert ids.cut(coded.words[1:])[0].tolist() == flat.tolist() and not calls


FAULTS = """
import resource, numpy as np
from verbena.llm import attention_lm
p, r = attention_lm.Params(head=62, width=48), np.random.default_rng(0)
net = attention_lm.Network.start(r.integers(1, 9, (64, 64)).astype(float), p)
x = r.integers(0, 64, (192, 49))
getattr(attention_lm, "keep_memory", lambda: None)()
for k in range(6):
    if k == 2:
        before = resource.getrusage(resource.RUSAGE_SELF).ru_minflt
    net.gradients(x[:, :-1], x[:, 1:])
print((resource.getrusage(resource.RUSAGE_SELF).ru_minflt - before) // 4)
"""


def test_training_steps_reuse_their_memory():
    """Pages that a training step asks the system for; some 4,700 where arrays are given back after each step."""
    assert resource.getpagesize() == 4096
    out = subprocess.run([sys.executable, "-c", FAULTS], capture_output=True, text=True, check=True, cwd=Path(__file__).resolve().parents[2])
    assert int(out.stdout) < 500
