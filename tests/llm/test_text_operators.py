from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.llm import components, decontaminate, line_chunks, minhash, packing, shingles, substring, suffixes

from .cases import empty, frame, plain_chunks, texts

SPACES = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text):
    words = SPACES.findall((text or "").translate(LOW))
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} or ({tuple(words)} if words else set())


# packing


def test_packing_gives_back_all_ids(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    slow = Tokenizer.from_file(path)
    slow.encode_special_tokens = True
    rows = packing.pack(frame(spark), path, public_tokenizers.PATTERN).collect()
    want = Counter()
    for doc_id, text in texts():
        ids = slow.encode(text or "", add_special_tokens=False).ids + [0]
        want[doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    pieces = defaultdict(list)
    for r in rows:
        pieces[r.sequence_id].append(r)
        assert r.length > 0 and r.offset + r.length <= r.sequence_length <= 1024
    for own in pieces.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == list(np.cumsum([0, *(r.length for r in own)])[:-1])
        assert sum(r.length for r in own) == own[0].sequence_length
    # pieces of one document cover its ids once
    assert sum(r.length for r in rows) == sum(n for (_, n, _), k in want.items() for _ in range(k))
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r.doc_id, r.doc_tokens].append(r)
    for doc_id, text in texts():
        ids = slow.encode(text or "", add_special_tokens=False).ids + [0]
        mine = by_doc[doc_id, len(ids)]
        crc = {(r.start, r.length): r.ids_crc32 for r in mine}
        if sum(n for (i, m, _), n in want.items() if (i, m) == (doc_id, len(ids))) == 1:
            assert sum(r.length for r in mine) == len(ids)
            for (start, length), value in crc.items():
                assert value == zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())
    assert packing.pack(empty(spark), path, public_tokenizers.PATTERN).count() == 0


def test_classes_fill_and_little_is_padded():
    dice = np.random.default_rng(2)
    packer, texts_ = packing.Packer(1024, 3), {}
    for i in range(4000):
        size = int(dice.choice([dice.integers(1, 40), dice.integers(40, 900), dice.integers(900, 5000)]))
        texts_[i] = np.arange(size, dtype="<u4") + np.uint32(7 * i)
        packer.add(i, texts_[i])
    packer.finish()
    batch = packer.batch().to_pylist()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in batch:
        by_doc[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"]))
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"], r["sequence_length"]))
    for i, ids in texts_.items():
        at = 0
        for start, length, crc in sorted(by_doc[i]):
            assert start == at and crc == zlib.crc32(ids[start : start + length].tobytes())
            at += length
        assert at == len(ids)
    for own in by_sequence.values():
        at = 0
        for offset, length, total in sorted(own):
            assert offset == at and total <= 1024
            at += length
        assert at == own[0][2]
    held = [own[0][2] for own in by_sequence.values()]
    padding = sum(1024 - n for n in held if n & (n - 1))
    assert padding < 0.01 * sum(held)
    short = [r for r in batch if r["length"] < packing.LEAST and r["length"] not in (r["doc_tokens"], r["doc_tokens"] % 1024)]
    assert len(short) < 0.01 * len(batch) and len(batch) < 1.6 * sum(len(t) // 1024 + 1 for t in texts_.values())


def test_long_texts_are_encoded_in_parts_alike(monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    slow = Tokenizer.from_file(path)
    slow.encode_special_tokens = True
    encode = packing.Encoder(path, public_tokenizers.PATTERN)
    monkeypatch.setattr(packing, "PART", 50)
    for _, text in texts():
        assert encode(text or "").tolist() == slow.encode(text or "", add_special_tokens=False).ids


# near duplicates


def brute_components(rows):
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 75 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(i)].append(doc_id)
    # an empty set reaches its own row alone
    return [min(least[root(i)], default=None) if sets[i] else rows[i][0] for i in range(len(rows))], [len(s) for s in sets]


def test_near_duplicates_equal_brute_force(spark):
    got = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(frame(spark)).collect())
    comps, sizes = brute_components(texts())
    assert got == Counter((i, n, c, i == c) for (i, _), n, c in zip(texts(), sizes, comps))
    assert minhash.near_duplicates(empty(spark)).count() == 0
    left = minhash.without_near_duplicates(frame(spark))
    assert left.columns == frame(spark).columns
    # each row goes for its own text, also where another row has its id
    assert Counter(r.doc_id for r in left.collect()) == Counter(i for (i, _), c in zip(texts(), comps) if i is None or i == c)


def test_links_that_stars_miss_are_settled(spark):
    # a chain: each document like the next one only; the first is the centre of the buckets that all share
    words = [f"w{k}" for k in range(400)]
    rows = [(k, " ".join(words[12 * k : 12 * k + 120])) for k in range(20)]
    comps, _ = brute_components(rows)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(frame(spark, rows)).collect()}
    assert got == {i: c for (i, _), c in zip(rows, comps)}


def test_block_links_find_what_is_similar():
    import pandas as pd

    sets = [shingles.shingle_set(" ".join(f"w{k}" for k in range(a, a + 100))) for a in (0, 3, 50, 53)]
    rows = [{"side": side, "i": 0, "j": 0, "node": n, "component": n, "own": s.astype("<u8").tobytes()} for n, s in enumerate(sets) for side in (0, 1)]
    found = {tuple(sorted(p)) for p in minhash.block_links(pd.DataFrame(rows)).itertuples(index=False, name=None)}
    assert found == {(0, 1), (2, 3)}


def test_long_words_and_parts_hash_alike(monkeypatch):
    plain = [shingles.word_hashes((t or "").encode())[0].tolist() for _, t in texts()]
    monkeypatch.setattr(shingles, "PART", 37)
    assert [shingles.word_hashes((t or "").encode())[0].tolist() for _, t in texts()] == plain


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, k) for k in range(101, 130)] + [(200, 200), (131, 130)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 130)} | {130: 130, 131: 130}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_no_pair_of_small_sets_is_lost(spark):
    """Of any two small sets that are similar enough, the rarest shingles share a bucket, whatever the bands do."""
    dice = np.random.default_rng(8)
    sets = [{"one"}, {"one"} | {"two"}, set(range(8)), set(range(6))]
    for k in range(120):
        own = {f"w{k}x{j}" if j % 3 else f"common{j}" for j in range(4 + k)}
        sets += [own, own - set(sorted(own)[: len(own) // 8]) | {f"new{j}" for j in range(len(own) // 8)}]
    number = {x: int(v) for x, v in zip(sorted({str(x) for s in sets for x in s}), dice.integers(-(2**62), 2**62, 100_000))}
    rows = [(i, len(s), sorted(number[str(x)] for x in s)) for i, s in enumerate(sets)]
    keys = defaultdict(set)
    for r in minhash.rare_keys(spark.createDataFrame(rows, "node long, n long, small array<long>")).collect():
        keys[r.node].add(r.key)
    similar = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    assert len(similar) > 50 and all(keys[i] & keys[j] for i, j in similar)


# substrings


def brute_substrings(rows):
    first = {}
    for i, t in rows:
        raw = (t or "").encode()
        for s in range(len(raw) - 49):
            key = float("inf") if i is None else i
            first[raw[s : s + 50]] = min(key, first.get(raw[s : s + 50], float("inf")))
    out = Counter()
    for i, t in rows:
        raw, gone = (t or "").encode(), set()
        for s in range(len(raw) - 49):
            if first[raw[s : s + 50]] < (float("inf") if i is None else i):
                gone.update(range(s, s + 50))
        kept = bytes(b for k, b in enumerate(raw) if k not in gone)
        runs = sum(1 for k in gone if k - 1 not in gone)
        out[i, len(raw), len(gone), runs, hashlib.sha256(kept).hexdigest()] += 1
    return out


@pytest.mark.parametrize("block", [1 << 12, 8 << 20])
def test_substrings_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(suffixes, "BLOCK_BYTES", block)
    rows = suffixes.dedup_substrings(frame(spark)).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows) == brute_substrings(texts())
    assert all(sum(s.end - s.begin for s in r.spans) == r.n_removed and len(r.spans) == r.n_spans for r in rows)
    assert suffixes.dedup_substrings(empty(spark)).count() == 0


def test_the_cover_is_perfect_and_packing_is_exact():
    assert {(a - b) % suffixes.MODULUS for a in suffixes.COVER for b in suffixes.COVER} == set(range(suffixes.MODULUS))
    for values in ([], [0], [5, 5, 2**63, 2**64 - 1]):
        assert suffixes.unpacked(suffixes.packed(np.array(values, np.uint64))).tolist() == values
    assert suffixes.unsmall(suffixes.small(np.array([3, 0, 2**31]))).tolist() == [3, 0, 2**31]


# lines


def brute_units(rows, least):
    """Per row: units, removed ones, text left. Pieces of a line end after a run of end marks."""
    plain = lambda x: re.sub("[ \t\n\r\x0b\x0c]+", " ", x).strip(" ").lower()
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, hashlib.sha256((r[1] or "").encode()).digest()))
    seen, out = {}, Counter()

    def first(norm, at):
        return seen.setdefault(norm, at) == at

    for i, t in rows:
        units = removed = 0
        left = []
        for k, line in enumerate((t or "").split("\n")):
            if not plain(line):
                left.append(line)
                continue
            units += 1
            pieces = [x for x in re.split(r"(?<=[.!?])(?![.!?])", line) if x]
            stays = first(plain(line), (i, t, k, 0))
            own = [(x, plain(x)) for x in pieces]
            gone = []
            for j, (x, norm) in enumerate(own, 1):
                if least and len(own) > 1 and len(norm.split(" ")) >= least:
                    units += 1
                    if not first(norm, (i, t, k, j)):
                        gone.append(j)
            if stays:
                removed += len(gone)
                left.append("".join(x for j, (x, _) in enumerate(own, 1) if j not in gone))
            else:
                removed += 1
        out[i, units, removed, "\n".join(left)] += 1
    return out


@pytest.mark.parametrize("least", [None, 1, 5])
def test_units_equal_brute_force(spark, least):
    extra = [(90 + k, t) for k, t in enumerate(["One two three four five. Six. One two three four five!", "x y. one  TWO three four five. tail of it here now.\n\nA. b? c", "tail of it here now. A. b? c", "a. b? c", "..!", "...", "a. b? c\na. b? c"])]
    rows = texts() + extra
    found = substring.dedup_units(frame(spark, rows), least_words=least).collect()
    assert Counter((r.doc_id, r.n_units, r.n_removed, r.kept_text) for r in found) == brute_units(rows, least)
    whole = defaultdict(set)
    for i, t in rows:
        whole[i].add(t or "")
    for r in found:
        assert r.removed_chars == sum(s.end - s.begin for s in r.removed)
        edges = [0, *(x for s in r.removed for x in (s.begin, s.end)), None]
        left = ["".join(t[a:b] for a, b in zip(edges[::2], edges[1::2])) for t in whole[r.doc_id]]
        assert substring.normal(r.kept_text) in map(substring.normal, left)
    assert substring.dedup_units(empty(spark)).count() == 0


def test_passages_inside_lines_lose_their_sentences(spark):
    passage = "The first sentence is of the passage. The second one belongs to it as well, of course! And is this the third of them? The fourth one ends it for good."
    rows = [(1, f"Quite another beginning here. {passage} Then the text goes on."), (2, f"Begins in its own way, {passage} And ends so."), (3, "Nothing is shared by this text, not one sentence.")]
    got = {r.doc_id: r for r in substring.dedup_units(frame(spark, rows)).collect()}
    assert [got[k].n_removed for k in (1, 2, 3)] == [0, 3, 0]
    assert [rows[1][1][s.begin : s.end].strip() for s in got[2].removed] == re.split(r"(?<=[.!?]) ", passage)[1:]


def test_paragraphs_keep_offsets(spark):
    rows = [(1, "first para\nline\n\nSecond  para"), (2, "own\n\nsecond PARA\n\nend")]
    got = {r.doc_id: r for r in substring.dedup_units(frame(spark, rows), "paragraph").collect()}
    assert got[1].n_removed == 0 and got[2].n_removed == 1
    assert [rows[1][1][s.begin : s.end] for s in got[2].removed] == ["second PARA"]
    assert got[2].kept_text == "own\n\nend"


def chunks_of(spark, text):
    from pyspark.sql import functions as F

    row = spark.createDataFrame([(text,)], "t string").select(line_chunks.chunks(F.col("t"), 3).alias("c")).first()
    return [(c.chunk, c.multi) for c in row.c]


def test_line_chunks_equal_brute_force(spark):
    rows = sorted(texts(), key=lambda r: (r[0] is None, r[0] or 0, hashlib.sha256((r[1] or "").encode()).hexdigest()))
    cut = {t: plain_chunks(t) for t in {t or "" for _, t in rows}}
    some = sorted(cut, key=len)[-6:]
    assert [chunks_of(spark, t) for t in some] == [cut[t] for t in some]
    assert all("\n".join(c for c, _ in own) == t for t, own in cut.items())
    seen, want = {}, Counter()
    for i, t in rows:
        own = cut[t or ""]
        keep = [not multi or seen.setdefault(c, (i, t, k)) == (i, t, k) for k, (c, multi) in enumerate(own)]
        want[i, len(own), keep.count(False), "\n".join(c for (c, _), y in zip(own, keep) if y)] += 1
    got = Counter((r.doc_id, r.n_chunks, r.n_removed, r.kept_text) for r in line_chunks.dedup_line_chunks(frame(spark)).collect())
    assert got == want and any(n for (_, _, n, _) in want)
    assert line_chunks.dedup_line_chunks(empty(spark)).count() == 0


def test_boundaries_resist_shifts(spark):
    block = "\n".join(f"line {k} of a block that repeats" for k in range(40))
    a, b = chunks_of(spark, block), chunks_of(spark, "another line\nand one more\n" + block)
    assert len({c for c, _ in a} & {c for c, _ in b}) >= len(a) - 1


def test_documents_without_repeated_chunks_keep_their_columns(spark):
    docs = frame(spark)
    left = line_chunks.without_repeated_chunks(docs, chars_col="n_chars")
    assert left.schema.simpleString() == docs.schema.simpleString()
    assert all(r.n_chars == len(r.text or "") for r in left.collect())
    clash = docs.withColumnsRenamed({"lang": "_null", "source": "_null_null"})
    assert line_chunks.without_repeated_chunks(clash, pairs=True).schema.simpleString() == clash.schema.simpleString()


# decontamination


def brute_leaks(rows, items):
    out = Counter()
    low = lambda t: SPACES.findall((t or "").translate(LOW))
    grams = lambda w, n: [tuple(w[k : k + min(5, n)]) for k in range(len(w) - min(5, n) + 1)]
    for i, t in rows:
        words = low(t)
        for item, passage in items:
            own = low(passage)
            if not own or not words:
                continue
            a, b = grams(own, len(own)), grams(words, len(own))
            wide = min(len(a), len(b))
            if not wide:
                continue
            best = 0.0
            for s in range(len(b) - wide + 1):
                x, y = Counter(b[s : s + wide]), Counter(a)
                best = max(best, sum((x & y).values()) / sum((x | y).values()))
            if best >= 0.75:
                out[i, item, round(best, 9)] += 1
    return out


def test_leaks_equal_brute_force(spark):
    rows = texts()
    known = {i: t for i, t in rows if t and i is not None}
    words = known[4].split()
    items = [(1, " ".join(words[2:30])), (2, known[0]), (3, "one two three"), (4, None), (5, ""), (6, "nothing like this stands in any of the texts at all"), (7, "ONE"), (None, " ".join(words[5:40]).replace(words[20], "other"))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contaminated(frame(spark), bench).collect()
    assert Counter((r.doc_id, r.item_id, round(r.similarity, 9)) for r in got) == brute_leaks(rows, items)
    hit = next(r for r in got if r.item_id == 1 and r.doc_id == 4)
    assert known[4][hit.begin : hit.end].split() == words[2:30]
    clean = decontaminate.without_contaminated(frame(spark), bench)
    bad = {(i, t) for i, t in rows if any(k[0] == i for k in brute_leaks([(i, t)], items))}
    assert Counter((r.doc_id, r.text) for r in clean.collect()) == Counter(r for r in rows if r not in bad)
    assert decontaminate.contaminated(empty(spark), bench).count() == 0
    assert decontaminate.contaminated(frame(spark), bench.where("item_id < 0")).count() == 0


def test_the_index_finds_all_within_the_radius_and_little_else(monkeypatch):
    dice = np.random.default_rng(3)
    items = decontaminate.Sized(9, list(range(300)), [np.unique(dice.integers(1, 2**63, 5, dtype=np.uint64)) for _ in range(300)])
    bits = dice.integers(0, 2, (500, decontaminate.BITS)).astype(bool)
    for k in range(400):  # 0 to 99 bits from an item
        bits[k] = items.bits[k % 300]
        flipped = dice.choice(decontaminate.BITS, k % 100, replace=False)
        bits[k, flipped] = ~bits[k, flipped]
    near = (bits[:, None, :] != items.bits[None, :, :]).sum(2) <= decontaminate.RADIUS
    for most in (1 << 21, 1000):
        monkeypatch.setattr(decontaminate, "MOST_VOTES", most)
        assert sorted(items.near(bits)) == sorted(zip(*(x.tolist() for x in np.nonzero(near))))
    votes = decontaminate.block_table(bits[400:]) @ items.index.T
    assert (votes >= decontaminate.BLOCKS - decontaminate.RADIUS).mean() < 0.001


def test_likenesses_of_texts_together_are_those_of_each():
    raws = [(t or "").encode() for _, t in texts()]
    together = suffixes.likenesses(raws).tolist()
    for raw, like in zip(raws, together):
        words = shingles.word_hashes(raw)[0]
        own = shingles.windows(words) if len(words) >= 5 else words
        assert like == (int(own.min()) >> 1 if len(own) else 2**63 - 1) == int(suffixes.likenesses([raw])[0])
