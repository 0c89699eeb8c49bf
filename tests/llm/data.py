"""Small tables with the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing names."""

from __future__ import annotations

import random

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, name string, n long, pos long, h long, kept string"


def words(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(["Alpha", "beta", "gamma", "DELTA", "épsilon", "zeta", "eta", "theta", "iota", "kappa", "lambda,", "mu."]) + rng.choice(["", "s", "x", "ing"]) for _ in range(n))


def documents(seed: int = 5) -> list[tuple]:
    rng = random.Random(seed)
    texts: list[str | None] = [None, "", " \t\n", "One", "one", "ONE", "É", "é", "one two three", "a" * 5000 + " b", words(rng, 3000)]
    base = [words(rng, rng.randint(5, 400)) for _ in range(20)]
    texts += base + [t.upper() for t in base[:5]] + [base[0]] * 6
    for t in base[5:10]:  # near copies: a word changed
        w = t.split(" ")
        w[len(w) // 2] = "changed"
        texts.append(" ".join(w))
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    rows += [(3, base[1]), (3, base[1]), (None, base[2]), (None, None)]  # repeated ids and rows, null ids
    return [(i, t, "en", "src0", len(t or ""), "x", 1, 2, 3, "y") for i, t in rows]
