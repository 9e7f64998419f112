"""Small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

from __future__ import annotations

import random
import re

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, kept string, spans int, n_words string"


def words(text, lower=False):
    return WORD.findall((text or "").translate(LOWER) if lower else text or "")


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice("alpha beta gamma delta Ünder épée 12 zeta, eta. Theta\n").strip() or "x"
                    if rng.random() < 0.1 else f"w{rng.randrange(4000)}" for _ in range(n))


def near(text: str, seed: int, changed: int) -> str:
    rng, parts = random.Random(seed), text.split(" ")
    for _ in range(changed):
        parts[rng.randrange(len(parts))] = f"n{rng.randrange(10**6)}"
    return " ".join(parts)


def texts() -> list:
    base, passage = prose(1, 300), prose(2, 60)
    made = [None, "", " \t\n\v\f\r ", "one", "one two three", "one two three", "Ünïcode\x00nul é.\x1c x"]
    made += [base, base, base.upper(), base + "\n"]
    made += [near(base, k, k % 9) for k in range(30)]
    made += [prose(100 + k, 40 + 7 * k) + " " + passage for k in range(25)]
    made += [passage, passage + " more", prose(5, 9000), "same " * 400, "a. b, c.\na. b, c.\n" * 9]
    made += ["x" * 50_000, "### $$$ %%% " * 30]
    return made


def rows() -> list[tuple]:
    """The last rows repeat an id, once with the same text and once with another; one id is null."""
    made = [(k, t, "en", "clash", 7, "y") for k, t in enumerate(texts())]
    return [*made, made[8], (3, prose(77, 30), None, None, None, None), (None, prose(78, 30), "en", "", 1, "")]


def documents(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA)


def components(sets: dict, percent: int) -> dict:
    """Smallest id reachable over links of all pairs, by brute force."""
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and any(
                x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]
            ):
                low, high = sorted((find(a), find(b)))
                parent[high] = low
    return {i: find(i) for i in ids}
