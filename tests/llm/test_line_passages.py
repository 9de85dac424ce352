"""Planted passages of two to six whole lines, and all pairs of lines against brute force."""

from __future__ import annotations

import hashlib
import os
import random
import re
from collections import Counter

import pytest

from tessera.llm import line_chunks

from .cases import empty, frame, plain_chunks, sentence, texts

WORDED = re.compile(r"[^\x20\x09-\x0D]")


def planted(seed=3):
    """Rows, and for the second and third documents that hold a passage its lines."""
    dice = random.Random(seed)
    rows, repeats = [], {}
    for size in range(2, 7):
        for _ in range(8):
            passage = [sentence(dice, 9) for _ in range(size)]
            for copy in range(3):
                own = [sentence(dice, 8) for _ in range(7)]
                at = dice.randint(1, 6)
                rows.append((len(rows), "\n".join(own[:at] + passage + own[at:])))
                if copy:
                    repeats[len(rows) - 1] = (own, passage)
    return rows, repeats


def recall(spark, pairs):
    rows, repeats = planted()
    left = {r.doc_id: r.kept_text.split("\n") for r in line_chunks.dedup_line_chunks(frame(spark, rows), pairs=pairs).collect()}
    gone = sum(x not in left[i] for i, (_, passage) in repeats.items() for x in passage)
    return gone / sum(len(p) for _, p in repeats.values()), rows, repeats, left


def test_planted_passages_go_whole_and_nothing_else(spark):
    share, rows, repeats, left = recall(spark, True)
    print(f"recall of planted lines {share:.3f}, by chunks alone {recall(spark, False)[0]:.3f}")
    assert share == 1.0
    for i, text in rows:
        assert left[i] == (repeats[i][0] if i in repeats else text.split("\n"))


def brute(rows):
    cut = {t: [c for c, _ in plain_chunks(t)] for t in {t or "" for _, t in rows}}
    ranked = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, hashlib.sha256((r[1] or "").encode()).hexdigest()))
    chunk_seen, pair_seen, out = {}, {}, Counter()
    for i, t in ranked:
        lines, gone, of, at = (t or "").split("\n"), set(), [], 0
        for k, c in enumerate(cut[t or ""]):
            n = c.count("\n") + 1
            if sum(bool(WORDED.search(x)) for x in c.split("\n")) >= 2 and chunk_seen.setdefault(c, (i, t, k)) != (i, t, k):
                gone.update(range(at, at + n))
            of += [k] * n
            at += n
        worded = [k for k, x in enumerate(lines) if WORDED.search(x)]
        for k, (a, b) in enumerate(zip(worded, worded[1:])):
            first = pair_seen.setdefault("\n".join(lines[a : b + 1]), (i, t, k))
            if first not in ((i, t, k), (i, t, k - 1)):
                gone.update(range(a, b + 1))
        out[i, len(cut[t or ""]), len({of[k] for k in gone}), "\n".join(x for k, x in enumerate(lines) if k not in gone)] += 1
    return out


def test_pairs_equal_brute_force(spark):
    more = [(800, "one a\n\ntwo b\nown c"), (801, "x y\none a\n\ntwo b"), (802, "one a\ntwo b"), (803, "\n".join(["same"] * 5)), (804, "same\nsame\nsame"), (805, "\n\nq r\ns t\n\n"), (806, "\nq r\ns t\n\n\n"), (807, "é ü\r\n ß\r\né ü\r\n ß\r\n")]
    rows = texts() + more
    got = Counter((r.doc_id, r.n_chunks, r.n_removed, r.kept_text) for r in line_chunks.dedup_line_chunks(frame(spark, rows), pairs=True).collect())
    assert got == brute(rows)
    for i, text in ((803, "same\nsame"), (804, ""), (802, "one a\ntwo b")):
        assert [k[3] for k in got if k[0] == i] == [text]
    kept = {x for k in got for x in k[3].split("\n")}
    assert {x for _, t in rows for x in (t or "").split("\n") if WORDED.search(x)} <= kept
    assert line_chunks.dedup_line_chunks(empty(spark), pairs=True).count() == 0


def test_the_query_takes_pairs(spark, tmp_path):
    rows, repeats = planted()
    frame(spark, rows).select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    left = {r.doc_id: r.kept_text.split("\n") for r in line_chunks.op10_line_chunk_dedup(spark, str(tmp_path)).collect()}
    assert all(left[i] == own for i, (own, _) in repeats.items())
    assert line_chunks.without_repeated_chunks(frame(spark, [(1, "a b\nc d"), (2, "\n\na b\nc d\n\n")]), pairs=True).count() == 1


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the provided tables aren't here")
def test_the_query_equals_brute_force_over_the_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = Counter((r.doc_id, r.n_chunks, r.n_removed, r.kept_text) for r in line_chunks.op10_line_chunk_dedup(spark, "/root/testdata/sf0.001").collect())
    assert got == brute(rows)
