from __future__ import annotations

from collections import Counter

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tessera.llm import toxicity
from tessera.llm.common import written

from .cases import texts
from .test_line_passages import brute as brute_passages
from .test_other_operators import labelled, plain_score
from .test_text_operators import brute_components, brute_leaks


def test_stages_keep_the_columns_and_drop_what_they_should(spark, tmp_path):
    rows, _, labels = labelled(spark)
    leak = " ".join(f"bench{k}" for k in range(25))
    more = [(1001, rows[1][1]), (1002, rows[2][1].replace("\n", " ") + " end"), (1003, "start of it " + leak + " and the rest"), (1004, None), (1005, "")]
    shared = "\n".join(f"shared line {k} of many" for k in range(9))
    more += [(1006, "one text here\n" + shared + "\nits end"), (1007, "another text there\n" + shared + "\nand its end")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows + more], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now, after = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        now = written(stage(spark, now, str(tmp_path)), "stage")
        after[name] = now
        if name != "packing":
            assert now.schema.simpleString() == docs.schema.simpleString()
    ids = {n: {r.doc_id for r in d.select("doc_id").collect()} for n, d in after.items()}
    assert ids["toxicity"] == {i for i, _ in rows + more if i >= 1000 or i % 5}
    assert ids["toxicity"] - ids["line dedup"] <= {1001}
    cut = {r.doc_id: r.text for r in after["line dedup"].collect()}
    assert "shared line 4" in cut[1006] and "shared line 4" not in cut[1007] and cut[1007].startswith("another text there")
    assert cut[1004] is None and cut[1005] == ""
    assert 1002 in ids["line dedup"] and 1002 not in ids["near-duplicate removal"] and 2 in ids["near-duplicate removal"]
    assert ids["near-duplicate removal"] - ids["decontamination"] == {1003}
    assert ids["packing"] == ids["decontamination"]


def table(spark, tmp_path, rows, labels, items):
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, score double, node long, _null string"
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), True, 0.5, 1, "x") for i, t in rows], schema)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return docs


def test_the_chain_equals_plain_versions_of_its_stages(spark, tmp_path):
    """Nulls, empty and long texts, ties, repeats and clashing columns through all five stages, each held against its
    brute-force version on what that of the stage before kept."""
    plain, _, labels = labelled(spark)
    rows = plain[:200] + [(i if i is None else 2000 + i, t) for i, t in texts()]
    items = [(1, " ".join(texts(9)[3][1].split()[:20])), (2, None), (3, rows[30][1].split("\n")[0])]
    docs = table(spark, tmp_path, rows, labels, items)
    known = labels.where(~toxicity.held_out("doc_id"))
    model = toxicity.fit(docs, known)
    after = [[(i, t) for i, t in rows if plain_score(t, model) < 0.7]]
    cut = brute_passages(after[0])
    texts_left = []
    for (i, _, removed, left), n in cut.items():
        texts_left += [(i, left, removed)] * n
    null_rows = [(i, t) for i, t in after[0] if t is None]
    kept = [(i, left) for i, left, removed in texts_left if left.strip(" \t\n\r\x0b\x0c") or not removed]
    for i, _ in null_rows:
        kept.remove((i, ""))
        kept.append((i, None))
    after.append(kept)
    comps, _ = brute_components(after[1])
    after.append([r for r, c in zip(after[1], comps) if r[0] is None or r[0] == c])
    after.append([(i, t) for i, t in after[2] if not brute_leaks([(i, t)], items)])
    now = docs
    for (name, stage), want in zip(corpus_pipeline.STAGES, after):
        now = written(stage(spark, now, str(tmp_path)), "stage")
        assert now.schema.simpleString() == docs.schema.simpleString()
        key = lambda r: repr(tuple(r))
        assert sorted(((r.doc_id, r.text) for r in now.collect()), key=key) == sorted(want, key=key), name
        assert all(r.n_chars == len(r.text or "") for r in now.collect())
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    sizes = Counter((i, len(slow.encode(t or "", add_special_tokens=False).ids) + 1) for i, t in after[3])
    assert Counter({k: n * k[1] for k, n in sizes.items()}) == sum((Counter({(r.doc_id, r.doc_tokens): r.length}) for r in packed), Counter())


def test_empty_tables_go_through(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    table(spark, tmp_path, [], none, [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
