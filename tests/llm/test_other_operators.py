from __future__ import annotations

import base64
import hashlib
import itertools
import json
import math
import os
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import quality, sharding, toxicity, warc
from tessera.llm.common import new_folder

from .cases import empty, frame, texts

# sharding


def test_the_table_is_balanced_and_stable():
    shards = [f"s{k}" for k in range(11)]
    owner = sharding.filled(shards, 5003)
    share = Counter(owner)
    assert max(share.values()) - min(share.values()) <= 1
    fewer = sharding.filled(shards[:-1], 5003)
    moved = sum(a != b for a, b in zip(owner, fewer) if a != 10)
    assert moved < 0.25 * 5003
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            sharding.filled(bad, 5003)
    with pytest.raises(ValueError):
        sharding.filled(shards, 5004)


def test_every_row_gets_its_shard(spark):
    docs = frame(spark)
    rows = sharding.assign_shards(docs, "doc_id", ["a", "b", "c"], 101).collect()
    owner = sharding.filled(["a", "b", "c"], 101)
    assert len(rows) == len(texts())
    for r in rows:
        slot = int(hashlib.md5(str("" if r.doc_id is None else r.doc_id).encode()).hexdigest()[:15], 16) % 101
        assert (r.slot, r.shard) == (slot, "abc"[owner[slot]])
    assert sharding.assign_shards(empty(spark), "doc_id", ["a"], 101).count() == 0


# archives


def pages():
    rows = [(k, f"http://example.org/{k % 3}", f"<p>page {k // 4}</p>") for k in range(40)]
    rows += [(50, None, None), (51, "u\r\nWARC-Type: x", ""), (52, "", "é😀" * 2000), (7, rows[7][1], rows[7][2]), (None, "n", "no id"), (None, "n", "no id"), (None, "m", rows[0][2]), (-5, "neg", "negative"), (2**62, "big", "negative")]
    return rows


def expected(rows):
    """Roles of the rows in the archive's order."""
    plain = [(i, u, (h or "").encode()) for i, u, h in rows]
    size = Counter(p for _, _, p in plain)
    top = {}
    for i, _, p in plain:
        top[p] = i if p not in top or top[p] is None or (i is not None and i > top[p]) else top[p]
    taken, out = set(), Counter()
    for i, _, p in plain:
        response = size[p] == 1 or (i == top[p] and p not in taken)
        taken |= {p} if response else set()
        digest = base64.b32encode(hashlib.sha1(p).digest()).decode()
        out[i, len(p), digest, "response" if response else "revisit", None if response else top[p]] += 1
    return out


def test_archives_give_back_what_was_written(spark):
    rows = pages()
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, kind int, digest string").repartition(4)
    folder = new_folder(spark, "archive")
    warc.write_warc(table, folder, max_bytes=700)
    got = warc.read_warc(spark, folder).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == expected(rows)
    assert all(bytes(r.payload) == next((h or "").encode() for i, _, h in rows if i == r.page_id) for r in got if r.payload is not None and r.page_id is not None)
    path = folder.removeprefix("file://")
    told = json.load(open(f"{path}/manifest.json"))["files"]
    names = sorted(n for n in os.listdir(path) if not n.startswith("."))
    assert names == sorted(["manifest.json", *(f["name"] for f in told)]) and len(told) > 4
    assert all(hashlib.sha256(open(f"{path}/{f['name']}", "rb").read()).hexdigest() == f["sha256"] for f in told)
    again = new_folder(spark, "archive")
    warc.write_warc(table, again, max_bytes=700)
    assert json.load(open(f"{again.removeprefix('file://')}/manifest.json"))["files"] == told


def test_files_without_the_manifest_are_not_read_and_damage_shows(spark):
    table = spark.createDataFrame([(1, "u", "text")], "page_id long, url string, html string")
    folder = new_folder(spark, "archive")
    warc.write_warc(table, folder)
    path = folder.removeprefix("file://")
    name = json.load(open(f"{path}/manifest.json"))["files"][0]["name"]
    with open(f"{path}/_temporary-9-{name}", "wb") as out:
        out.write(b"rubbish")
    assert warc.read_warc(spark, folder).count() == 1
    record = warc.record_bytes(1, "u", b"text", warc.base32_sha1(b"other"), None, False)
    with pytest.raises(ValueError):
        warc.parsed(record)


def test_an_empty_table_makes_an_empty_archive(spark):
    folder = new_folder(spark, "archive")
    warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), folder)
    assert warc.read_warc(spark, folder).count() == 0


# toxicity


def brute_marginals(field, levels):
    near = [max([levels[t - 1] if t else 0, levels[t + 1] if t + 1 < len(levels) else 0]) for t in range(len(levels))]
    total, on = 0.0, np.zeros(len(levels))
    for tags in itertools.product((0, 1), repeat=len(levels)):
        score = sum(field.own[l, y] + field.near[n, y] for l, n, y in zip(levels, near, tags)) + sum(field.step[a, b] for a, b in zip(tags, tags[1:]))
        total += math.exp(score)
        on += math.exp(score) * np.array(tags)
    return on / total


def test_marginals_equal_enumeration():
    dice = np.random.default_rng(0)
    n = toxicity.N_LEVELS
    field = toxicity.Field(dice.normal(size=(n, 2)), dice.normal(size=(n, 2)), dice.normal(size=(2, 2)))
    chains = [dice.integers(0, n, size).tolist() for size in (1, 2, 3, 5, 8, 8)] + [[0] * 6]
    for chain, p in zip(chains, toxicity.Tagger(field)(chains)):
        assert np.allclose(p, brute_marginals(field, chain))


def labelled(spark):
    dice = np.random.default_rng(4)
    words = [f"w{k}" for k in range(300)]
    rows, labels = [], []
    for k in range(600):
        own = list(dice.choice(words, 30))
        toxic = int(k % 5 == 0)
        if toxic:
            own[7] = "Grobian!"
            own[19] = f"schuft{k % 9}"
        rows.append((k, " ".join(own[:15]) + "\n" + " ".join(own[15:])))
        labels.append((k, 1, toxic))
    return rows, spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_documents_are_told_apart_and_spans_show_why(spark):
    rows, docs, labels = labelled(spark)
    train = labels.where(~toxicity.held_out("doc_id"))
    got = {r.doc_id: r for r in toxicity.score_documents(docs, train).collect()}
    assert [k for k in got if got[k].score >= 0.7] == [k for k in got if k % 5 == 0]
    spans = [rows[5][1][s.begin : s.end] for s in got[5].spans]
    assert "Grobian" in spans
    left = toxicity.without_toxic(docs, train)
    assert sorted(r.doc_id for r in left.collect()) == [k for k in range(600) if k % 5]


def test_scores_are_defined_for_every_row(spark):
    _, docs, labels = labelled(spark)
    level, field = {"ka-": 1, "kana": 3}, toxicity.Field.zero()
    tagged = toxicity.tag_documents(frame(spark), level, field).collect()
    assert len(tagged) == len(texts()) and all(0 <= r.most <= 1 for r in tagged)
    blank = next(r for r in tagged if r.n_tokens == 0)
    assert (blank.most, blank.expected, blank.spans) == (0.0, 0.0, [])
    none = labels.where("toxic > 1")
    assert {r.score for r in toxicity.score_documents(frame(spark), none).collect()} == {0.0}
    assert {r.score for r in toxicity.score_documents(docs, labels.where("toxic = 1")).collect()} == {1.0}
    assert toxicity.score_documents(empty(spark), labels).count() == 0
    assert toxicity.without_toxic(frame(spark), none).columns == frame(spark).columns


def brute_evidence(rows, toxic, folds):
    """Level of each mark with enough evidence, from documents counted one by one."""
    seen = {0: Counter(), 1: Counter()}
    for i, text in rows:
        if i in toxic and toxic[i][1] in folds:
            words = {w.lower() for w in re.findall(r"[^\W_]+(?:[*@$!'’-][^\W_]+)*", text or "")}
            seen[toxic[i][0]].update({m for w in words for m in [w, *(w[:k] + "-" for k in range(4, 9) if len(w) > k)]})
    n = {y: sum(1 for t, f in toxic.values() if t == y and f in folds) for y in (0, 1)}
    out = {}
    for mark, a in seen[1].items():
        if a >= 3:
            c = seen[0][mark]
            odds = math.log((a + 0.5) / (n[1] + 1)) - math.log((c + 0.5) / (n[0] + 1)) - math.sqrt(1 / (a + 0.5) + 1 / (c + 0.5))
            if odds >= 2.5:
                out[mark] = sum(odds >= x for x in (2.5, 3.5, 4.5, 5.5))
    return out


def test_evidence_comes_from_all_labelled_documents_and_from_other_folds(spark):
    rows, docs, labels = labelled(spark)
    sample = toxicity.labelled_sample(docs, labels)
    told = {r.doc_id: (r.toxic, r.fold) for r in sample.collect()}
    assert len(told) == 600 and {f for _, f in told.values()} == set(range(toxicity.FOLDS))
    level, without = toxicity.evidence_levels(sample)
    assert level == brute_evidence(rows, told, set(range(toxicity.FOLDS)))
    for k, own in enumerate(without):
        assert own == brute_evidence(rows, told, set(range(toxicity.FOLDS)) - {k})
    groups = toxicity.labelled_chains(sample, without)
    assert sum(g.weights.sum() for g in groups) == 1200 and sum(g.sizes @ g.weights for g in groups) == 600 * 30


def brute_log_likelihood(field, levels, tags):
    near = [max([levels[t - 1] if t else 0, levels[t + 1] if t + 1 < len(levels) else 0]) for t in range(len(levels))]
    score = lambda y: sum(field.own[l, a] + field.near[n, a] for l, n, a in zip(levels, near, y)) + sum(field.step[a, b] for a, b in zip(y, y[1:]))
    return score(tags) - math.log(sum(math.exp(score(y)) for y in itertools.product((0, 1), repeat=len(levels))))


def test_bounds_of_what_is_fitted_are_parameters(spark):
    rows, docs, labels = labelled(spark)
    sample = toxicity.labelled_sample(docs, labels)
    level, without = toxicity.evidence_levels(sample)
    few, _ = toxicity.evidence_levels(sample, most=2)
    rare, _ = toxicity.evidence_levels(sample, least_toxic=len(rows) + 1)
    assert set(few) < set(level) and len(few) <= 2 and rare == {}
    n = sum(len(g.sizes) for g in toxicity.labelled_chains(sample, without))
    assert sum(len(g.sizes) for g in toxicity.labelled_chains(sample, without, n)) == n
    with pytest.raises(ValueError, match="different chains"):
        toxicity.labelled_chains(sample, without, n - 1)


def test_the_field_is_the_most_likely_one():
    dice = np.random.default_rng(6)
    groups = []
    for size in (3, 5):
        levels = dice.integers(0, toxicity.N_LEVELS, (12, size))
        tags = (levels + dice.integers(0, 3, levels.shape) >= 4).astype(float)
        groups.append(toxicity.Chains(levels, np.full(12, size), tags, dice.integers(1, 4, 12).astype(float)))
    field = toxicity.fit_field(groups, rounds=200)

    def loss(f):
        total = sum(w * brute_log_likelihood(f, c.tolist(), t.astype(int).tolist()) for g in groups for c, t, w in zip(g.levels, g.tags, g.weights))
        n = sum(g.sizes @ g.weights for g in groups)
        return -total / n + 0.5e-4 * sum((part**2).sum() for part in (f.own, f.near, f.step))

    least = loss(field)
    for _ in range(30):
        other = toxicity.Field(*(part + dice.normal(size=part.shape) * 0.05 for part in (field.own, field.near, field.step)))
        assert loss(other) > least


def plain_score(text, model):
    """A document's score by plain forward and backward sums over each chain, without scaling."""
    p = []
    for line in (text or "").split("\n"):
        tokens = [t.lower() for t in re.findall(r"[^\W_]+(?:[*@$!'’-][^\W_]+)*", line)]
        for i in range(0, len(tokens), 64):
            own = [max(model.level.get(m, 0) for m in [w, *(w[:k] + "-" for k in range(4, 9) if len(w) > k)]) for w in tokens[i : i + 64]]
            near = [max(own[t - 1] if t else 0, own[t + 1] if t + 1 < len(own) else 0) for t in range(len(own))]
            score = [np.exp(model.field.own[a] + model.field.near[b]) for a, b in zip(own, near)]
            step, forward, backward = np.exp(model.field.step), [score[0]], [np.ones(2)]
            for x in score[1:]:
                forward.append(forward[-1] @ step * x)
            for x in score[:0:-1]:
                backward.insert(0, step @ (x * backward[0]))
            p += [(f * b)[1] / (f * b).sum() for f, b in zip(forward, backward)]
    x = [max(p, default=0.0), math.log1p(sum(p)), sum(p) / max(len(p), 1), math.log1p(sum(q >= 0.5 for q in p)), 1.0]
    return 1 / (1 + math.exp(-float(np.dot(x, model.weights))))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the provided tables aren't here")
def test_the_toxicity_query_equals_plain_sums_over_the_whole_table(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    known = spark.createDataFrame([r for r in labels.collect() if not out(r.doc_id)], labels.schema)
    model = toxicity.fit(docs, known)
    want = {r.doc_id: plain_score(r.text, model) for r in docs.collect()}
    got = toxicity.op8_toxicity(spark, sf_dir).collect()
    assert len(got) == len(want)
    for r in got:
        assert r.score == pytest.approx(want[r.doc_id], abs=1e-9)
        assert r.held_out == out(r.doc_id) and (r.predicted == 1) == (r.score >= 0.7) and 0 <= r.score <= 1


# quality


def brute_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    hit = {k + j for k in range(len(words) - 4) if grams[tuple(words[k : k + 5])] > 1 for j in range(5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def test_statistics_equal_brute_force(spark):
    more = [(900, "a b c d e a b c d e f"), (901, "x x x x x x x"), (902, "#a|b <c> & $%*\n#a|b <c> & $%*"), (903, "é ü z \x1c y")]
    rows = texts() + more
    got = Counter((r.doc_id, *(r[c] for c in quality.BASE)) for r in quality.text_statistics(frame(spark, rows)).collect())
    assert got == Counter((i, *brute_statistics(t)) for i, t in rows)
    assert quality.text_statistics(empty(spark)).count() == 0


def test_a_list_is_learned_pruned_and_applied_in_order(spark):
    dice = np.random.default_rng(2)
    n = 3000
    x = {name: dice.integers(0, 100, n).astype(float) for name in [*quality.STATISTICS, *quality.RATIOS]}
    bad = (x["n_symbols"] >= 80) & (x["n_upper"] < 40)
    rules = quality.learn(x, bad)
    hit = np.zeros(n, bool)
    for rule, precision in rules:
        hit |= quality.covered(rule, x, n)
        assert precision >= 0.85
    assert (hit & bad).sum() >= 0.95 * bad.sum() and (hit & ~bad).sum() <= 0.02 * n
    assert quality.learn(x, np.zeros(n, bool)) == []
    rows = spark.createDataFrame([(1, *[90] * 8), (2, *[10] * 8)], ", ".join(f"{c} long" for c in ["doc_id", *quality.STATISTICS]))
    told = [([quality.Test("n_words", True, 50.0)], 1.0), ([quality.Test("mean_word", True, 0.5)], 1.0)]
    got = {r.doc_id: (r.rule, r.base_failed, r.kept) for r in quality.apply_rules(rows, told).collect()}
    assert got == {1: (1, True, False), 2: (2, True, False)}
    assert {r.rule for r in quality.apply_rules(rows, []).collect()} == {0}


def test_labels_without_rows_give_no_rules(spark):
    stats = quality.text_statistics(frame(spark))
    labels = spark.createDataFrame([(1, None, None), (None, 0, 0)], "doc_id long, quality int, toxic int")
    x, bad = quality.labelled_sample(stats, labels)
    assert len(bad) == 0 and quality.learn(x, bad) == []
    assert quality.apply_rules(stats, []).where(F.col("kept").isNull()).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="the provided tables aren't here")
def test_the_quality_query_equals_plain_rules_over_the_whole_table(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    rules = quality.learn(*quality.labelled_sample(quality.text_statistics(docs), labels))
    stats = {r.doc_id: r.asDict() for r in quality.text_statistics(docs).collect()}
    texts_ = {r.doc_id: r.text for r in docs.collect()}

    def value(name, r):
        most = lambda n: max(r[n], 1)
        ratios = {
            "mean_word": r["word_chars"] / most("n_words"), "symbols_a_word": r["n_symbols"] / most("n_words"), "dup_lines_a_line": r["n_dup_lines"] / most("n_lines"),
            "repeat_words_a_word": r["n_repeat_words"] / most("n_words"), "words_a_line": r["n_words"] / most("n_lines"),
            "punctuation_a_word": r["n_punctuation"] / most("n_words"), "upper_a_word": r["n_upper"] / most("n_words"),
        }
        return ratios.get(name, r.get(name))

    got = quality.op9_quality_rules(spark, sf_dir).collect()
    assert len(got) == len(texts_) and rules
    for r in got:
        own = stats[r.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_statistics(texts_[r.doc_id])
        failed = r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words
        first = next((k for k, (rule, _) in enumerate(rules, 1) if all((value(t.name, own) >= t.limit) == t.at_least for t in rule)), 0)
        assert (r.base_failed, r.rule, r.kept) == (failed, first, not failed and first == 0)


def test_shards_bear_clashing_names_and_hot_keys(spark):
    docs = frame(spark)
    named = sharding.assign_shards(docs, "shard", ["a", "b", "c"], 101)
    assert sorted(named.columns) == sorted(docs.columns) and named.count() == docs.count()
    assert len({r.slot for r in named.collect()}) == 1
    spread = sharding.assign_shards(docs, "shard", ["a", "b", "c"], 101, spread_col="text")
    assert len({r.shard for r in spread.collect()}) == 3
    assert len({(r.text, r.shard) for r in spread.collect()}) == len({r.text for r in spread.collect()})
    assert sharding.assign_shards(empty(spark), "doc_id", ["a"], 101).count() == 0
