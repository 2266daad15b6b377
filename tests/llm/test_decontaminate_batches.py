"""Windows of many texts at once are those of each text alone."""

import random

import numpy as np

from evidence_engine.llm import decontaminate as dc


def test_hits_of_texts_together_are_those_of_each():
    rng = random.Random(3)
    words = [f"w{k}" for k in range(9)] + ["Name", "12", "--", "km"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n)).encode()
    texts = [text(rng.choice([0, 1, 5, 9, 14, 30])) for _ in range(200)] + [None, b"", b"-- --"]
    tokens = dc.Tokens()
    items = [dc.Item(k, text(n), tokens) for k, n in enumerate([3, 8, 14, 20, 5])]
    # An item made of the end of one text and the beginning of the next is in neither.
    a, b = text(12), text(12)
    items.append(dc.Item(9, a[-20:] + b" " + b[:20], tokens))
    texts = [a, b, *texts, items and b" ".join([text(6), text(9)])]
    shapes = {2 * size + kind for x in items for kind, size in ((0, x.size), (1, x.raw_size))}
    wanted = dc._Filter(np.unique(np.concatenate([np.r_[x.hashes, x.raw_hashes] for x in items]).astype(np.uint64)), sorted(shapes))
    each = [wanted.hits(t or b"", tokens).tolist() for t in texts]
    assert [h.tolist() for h in wanted.hits_of(texts, tokens)] == each and any(each)
