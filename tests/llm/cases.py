"""Rows with everything that an operator must bear: nulls, empty and long texts, ties, repeats, clashing columns."""

from __future__ import annotations

import random
import re

import xxhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component_id long, kept boolean, block int, node long, digest string, score double, slot int, shard string, carried string, salt int"
WORDS = [f"{a}{b}" for a in ("ka", "lo", "mi", "ru", "té", "ßo") for b in ("na", "ri", "so", "tu", "vé")]


def sentence(dice: random.Random, n: int) -> str:
    return " ".join(dice.choice(WORDS) + dice.choice(["", "", "", ".", ","]) for _ in range(n))


def texts(seed: int = 1) -> list[tuple[int | None, str | None]]:
    dice = random.Random(seed)
    base = [sentence(dice, dice.randint(8, 120)) + "\n" + sentence(dice, 30) for _ in range(20)]
    near = []
    for k in range(6):
        words = base[0].split(" ")
        words[(7 * k + 3) % len(words)] = f"changed{k}"
        near.append(" ".join(words))
    shared = sentence(dice, 60)
    block = "\n".join(sentence(dice, 9) for _ in range(6))
    mixed = [f"{sentence(dice, 20)}\n{shared}\n{sentence(dice, 12)}" for _ in range(4)] + [f"{sentence(dice, 15)}\n{block}\n{sentence(dice, 14)}" for _ in range(4)]
    long = "\n".join(sentence(dice, 50) for _ in range(400))
    some = base + near + [base[1], base[1], base[2].upper()] + mixed + [long, long + " end"]
    some += ["", None, " \n\t", "one", "one two three", "one two three", "x" * 3000, "a b c d e", "  spaced \t out \r\n text  here now ", "\n\n\n", "<|endoftext|> é b 😀 end"]
    rows: list[tuple[int | None, str | None]] = list(enumerate(some))
    rows += [(None, base[3]), (None, "only here without an id, five words and more"), (None, near[1] + " tail"), (5, base[5]), (7, "another text under an id that is taken already")]
    dice.shuffle(rows)
    return rows


def frame(spark, rows=None):
    rows = texts() if rows is None else rows
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, True, 2, 3, "d", 0.5, 4, "x", "c", 5) for i, t in rows], SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def signed(value: int) -> int:
    return value - 2**64 if value >= 2**63 else value


def plain_chunks(text: str, divisor: int = 3) -> list[tuple[str, bool]]:
    """A text's chunks of lines by the rule itself, and whether each has two lines with words: XXH64 with the seed 42 of
    each line modulo 1,048,573; a chunk ends where that of h[i] + 31 * h[i - 1] is 0 modulo the divisor."""
    lines = text.split("\n")
    hashes = [signed(xxhash.xxh64_intdigest(x.encode(), 42)) % 1_048_573 for x in lines]
    chunks, begin = [], 0
    for i in range(len(lines)):
        rolling = (hashes[i] + 31 * hashes[i - 1]).to_bytes(8, "little") if i else b""
        if i == len(lines) - 1 or (i and signed(xxhash.xxh64_intdigest(rolling, 42)) % divisor == 0):
            own = lines[begin : i + 1]
            chunks.append(("\n".join(own), sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) for x in own) >= 2))
            begin = i + 1
    return chunks
