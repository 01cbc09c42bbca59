"""The whole pipeline against plain forms of its stages."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lakeleaf.llm import langid
from tests.llm.test_simhash import plain_components, plain_fingerprint
from tests.llm.test_text_ops import plain_matches, plain_secrets

NAMES = "doc_id long, text string, lang string, source string, n_chars long, component string, _row int"


@pytest.fixture(scope="module")
def corpus(spark, rows, tmp_path_factory):
    rng = random.Random(3)
    items = [(k, " ".join(rng.choice("zelbo fintal murpo dreska volin tharb ankeso brillo gantz wolpe syndra kelt".split()) + str(k) for _ in range(14))) for k in range(4)]
    prose = lambda n: " ".join(rng.choice("the of and to in that with for thing over under ation overthe ofthing".split()) + rng.choice(["", "ing", "s"]) for _ in range(n))
    more = [(400 + k, f"{prose(30)} {items[k % 4][1] if k % 3 == 0 else prose(5)} {prose(30)}", "en") for k in range(24)]
    more += [(500 + k, f"{prose(40)} password=hunter2{k}xyz and {'0a' * 15} {prose(9)}", "en") for k in range(6)]
    every = [*rows, *more, (401, more[1][1], "en"), (401, more[2][1] + " another", "en"), (None, prose(50), None), (None, prose(50), "en"), (None, None, "en")]
    folder = tmp_path_factory.mktemp("corpus")
    docs = spark.createDataFrame([(i, t, lang, "s", len(t or ""), "x", 1) for i, t, lang in every], NAMES).repartition(4)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return every, items, str(folder)


def test_pipeline_against_brute_force(spark, corpus):
    tokenizers = pytest.importorskip("tokenizers")
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    import corpus_pipeline

    _, items, folder = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = [(r.doc_id, r.text) for r in langid.predict(docs, langid.fit(docs)).collect() if not r.rejected]
    assert len(kept) > 60 and all(t for _, t in kept)
    # one document of each group, that of the smallest id; the plain form gives every row its group's
    ids, prints = [i for i, _ in kept], [plain_fingerprint(t) for _, t in kept]
    groups = Counter(c for _, _, c in plain_components(ids, prints) if c is not None)
    tokens = tokenizers.Tokenizer.from_file(path)

    def masked(t):
        out, at = [], 0
        for a, _, z in plain_secrets(t):
            if a >= at:
                out += [t[at:a], "[REDACTED]"]
            at = max(at, z)
        return "".join(out) + t[at:]

    pieces = corpus_pipeline.run(spark, folder).collect()
    whole = Counter()
    for r in pieces:
        whole[r.doc_id, r.doc_tokens] += r.length
    # a document of a kept id, clean of items, masked, tokenised: its ids are there, whole
    by_id = {}
    for i, t in kept:
        by_id.setdefault(i, []).append(t)
    wanted = {}
    for i in groups:
        clean = [t for t in by_id[i] if not plain_matches([(i, t)], items)]
        ready = [np.array([*tokens.encode(masked(t), add_special_tokens=False).ids, 0], "<u4") for t in clean]
        wanted[i] = (ready, len(clean) == len(by_id[i]))
    found = {i for i, _ in whole}
    assert {i for i, (_, clean) in wanted.items() if clean} <= found - {None} <= {i for i, (ready, _) in wanted.items() if ready}
    for r in pieces:
        if r.doc_id is not None:
            assert any(len(x) == r.doc_tokens and zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for x in wanted[r.doc_id][0])
    assert all(n % size == 0 for (_, size), n in whole.items()) and len([i for i, _ in whole if i is not None]) == len(found - {None})
    assert any(re.search("password", t) for _, t in kept) and len(groups) > len(found)


def test_pipeline_of_empty_tables(spark, corpus, tmp_path):
    pytest.importorskip("tokenizers")
    import corpus_pipeline

    spark.read.parquet(f"{corpus[2]}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{corpus[2]}/benchmark.parquet").limit(0).write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
