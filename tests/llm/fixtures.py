"""Documents with every awkward case: nulls, empty and long texts, ties, repeated rows."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, pack long, bucket string"


def words(rng: random.Random, n: int, vocabulary: int = 400) -> list[str]:
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def documents(seed: int = 1, n: int = 40) -> list[tuple]:
    rng = random.Random(seed)
    shared = words(rng, 60)
    texts: list[str | None] = [None, "", " \n\t ", "one", "größe über\x0bcafé  x", "a  b   c \n d", " lead", "trail "]
    for i in range(n):
        own = words(rng, rng.randrange(1, 200))
        if i % 4 == 0:
            at = rng.randrange(len(own) + 1)
            own = own[:at] + shared[rng.randrange(10) :] + own[at:]
        texts.append(rng.choice([" ", "\n", "  "]).join(own))
    texts += [texts[10], texts[10], texts[12] + "!", " ".join(words(rng, 20_000)), "x" * 50_000]
    rows = [(i, t, "en", "src0", None if t is None else len(t), 1, "clash") for i, t in enumerate(texts)]
    return [*rows, rows[9], rows[9], (None, texts[11], None, None, None, None, None), (None, None, None, None, None, None, None)]
