"""Small document tables with the hard cases, and their rows."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, uid string, rank int, keys string, comp string"
WORDS = "the of and onan tion hereé Über was blend not river stone paper light under over".split()


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + str(rng.randrange(60)) for _ in range(n))


def rows(seed: int = 5) -> list[tuple]:
    """Nulls, empties, copies, near copies, a long text, a shared passage and repeated rows."""
    rng = random.Random(seed)
    passage = sentence(rng, 60)
    base = sentence(rng, 120)
    texts: list[str | None] = [None, "", " \n\t ", "one", "Three short words", base, base, base.upper()]
    for i in range(6):
        words = base.split()
        words[10 * i + 3] = f"edit{i}"
        texts.append(" ".join(words))
    for _ in range(6):
        texts.append(sentence(rng, 40) + "\n" + passage + "\n" + sentence(rng, 30))
    texts += [sentence(rng, 200).replace(" ", "\n", 9) for _ in range(10)]
    texts.append("\n".join([sentence(rng, 12)] * 9))
    texts.append("x" * 30_000 + " " + sentence(rng, 3000))
    texts.append("a b c d e f g h " * 40)
    out = [(i, t, "en" if i % 3 else None, f"s{i % 2}" if i % 7 else None, len(t or ""), "u", 1, None, "c")
           for i, t in enumerate(texts)]
    out.append(out[5])  # a row that is there twice
    out.append((None, base, None, None, None, None, None, None, None))
    out.append((None, None, None, None, None, None, None, None, None))
    rng.shuffle(out)
    return out
