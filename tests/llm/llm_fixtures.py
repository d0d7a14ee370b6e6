"""Texts for the tests of the operators."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
rng = random.Random(5)
VOCAB = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(400)]


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(VOCAB) for _ in range(n))


def edge_texts() -> list[tuple]:
    """Nulls, blanks, copies, near copies, repeated rows, a very long text, odd characters."""
    base = prose(1, 120)
    words = base.split()
    near = " ".join(w if i % 40 else "changed" for i, w in enumerate(words))
    far = " ".join(w if i % 3 else "other" for i, w in enumerate(words))
    shared = prose(2, 30)
    rows = [
        (1, base), (2, base), (3, near), (4, far), (5, None), (6, ""), (7, " \n\t "), (8, "One"), (9, "one"), (10, prose(3, 6000)),
        (11, prose(4, 60) + " " + shared + " " + prose(5, 60)), (12, prose(6, 40) + "\n" + shared), (13, shared), (13, shared), (14, base),
        (None, base), (15, "x y z\x1c w éÉ \U0001f600"), (16, "a b " * 80), (17, prose(7, 3000) + "\n" + prose(7, 3000)),
    ]
    return [(i, t, "en", f"src{k % 3}" if k != 4 else None, len(t or "")) for k, (i, t) in enumerate(rows)]
