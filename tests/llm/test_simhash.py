import random

import pytest
import xxhash

from lakeleaf.llm import simhash
from lakeleaf.llm.common import connected_components


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 4]), 42) for k in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def union(n, near):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(n):
        for j in range(i):
            if near(i, j):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def plain_components(ids, prints):
    """Rows link by near fingerprints or an equal doc_id; null ids are no ids."""
    roots = union(len(ids), lambda i, j: ids[i] is not None and ids[i] == ids[j] or (prints[i] ^ prints[j]).bit_count() <= 4)
    least = {}
    for i, r in zip(ids, roots):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    return sorted(((i, f"{p:016x}", least.get(r)) for i, p, r in zip(ids, prints, roots)), key=repr)


def test_components(docs, rows):
    prints = [plain_fingerprint(t) for _, t, _ in rows]
    expected = plain_components([i for i, _, _ in rows], prints)
    for hot in (128, 2):
        got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.components(docs, hot=hot).collect()), key=repr)
        assert got == expected


def test_repeated_and_null_ids(spark):
    a, b, c = ("alpha beta gamma delta epsilon", "one two three four five six", "uno dos tres cuatro cinco")
    rows = [(3, a), (7, a), (7, b), (None, b), (None, c), (None, c), (None, "x y z"), (9, None), (None, ""), (8, "p q r s t"), (8, "u v w x y"), (8, "k l m n o")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    expected = plain_components([i for i, _ in rows], [plain_fingerprint(t) for _, t in rows])
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.components(df).collect()), key=repr) == expected
    kept = sorted(((r.doc_id, r.text) for r in simhash.keep_one(df).collect()), key=repr)
    assert len(kept) == 5 and (3, a) in kept and (None, c) in kept and (None, "x y z") in kept and (9, None) in kept and sum(i == 8 for i, _ in kept) == 1


@pytest.mark.parametrize("hot", [2, 16, 128])
def test_links_of_crowded_keys(spark, hot):
    rng = random.Random(hot)
    prints = set()
    for _ in range(6):  # crowds around a centre, and chains that leave it
        centre = rng.getrandbits(64)
        for _ in range(60):
            x = centre
            for b in rng.sample(range(64), rng.randrange(9)):
                x ^= 1 << b
            prints.add(x)
    prints = sorted(prints | {rng.getrandbits(64) for _ in range(100)} | {rng.getrandbits(10) | 5 << 40 for _ in range(100)})
    signed = [x - 2**64 if x >= 2**63 else x for x in prints]
    roots = union(len(prints), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 4)
    pairs = simhash.link_pairs(spark.createDataFrame([(x,) for x in signed], "fp long"), hot=hot)
    group = {r.node: r.component for r in connected_components(pairs).collect()}
    least = {}
    for x, r in zip(signed, roots):
        least[r] = min(least.get(r, x), x)
    assert {x: group.get(x, x) for x in signed} == {x: least[r] for x, r in zip(signed, roots)}


def test_keep_one_returns_whole_rows(docs):
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    got = [r.doc_id for r in kept.collect()]
    assert len(got) == len(set(got)) and set(got) == {r.component_id for r in simhash.components(docs).collect()}


@pytest.mark.parametrize("local", [0, 10**6])
def test_component_ways_agree(spark, local):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(500, 540)] + [(3, 3)]
    roots = union(541, lambda i, j: (i, j) in pairs) if (pairs := {(max(e), min(e)) for e in edges}) else None
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), local=local).collect()}
    assert got == {x: roots[x] for x in nodes}


def test_empty(empty):
    assert simhash.components(empty).collect() == []
    with pytest.raises(ValueError):
        simhash.link_pairs(empty, links=3)
