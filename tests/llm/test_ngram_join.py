"""Shingle links on small tables against all pairs."""

import random
import re

import pyarrow as pa

from turnspark.llm import ngram_join as nj
from turnspark.shipping import ship_package

rng = random.Random(11)
VOCABULARY = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(500)]


def sentence(n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def edited(text, share):
    words = text.split()
    for i in rng.sample(range(len(words)), max(1, int(share * len(words)))):
        words[i] = rng.choice(VOCABULARY)
    return " ".join(words)


def shingles(text):
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(table))
    if not words:
        return frozenset()
    return frozenset(" ".join(words[i : i + 5]) for i in range(max(len(words) - 4, 1)))


def similar(x, y):
    return bool(x) and bool(y) and 100 * len(x & y) >= 80 * len(x | y)


def component_ids(rows):
    """(doc_id, number of shingles, smallest doc_id reachable) by all pairs."""
    sets = [shingles(t) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if similar(sets[i], sets[j]):
                root[top(i)] = top(j)
    least = {}
    for i, row in enumerate(rows):
        if row[0] is not None:
            least[top(i)] = min(least.get(top(i), row[0]), row[0])
    return sorted(((r[0], len(sets[i]), least.get(top(i))) for i, r in enumerate(rows)), key=repr)


SCHEMA = "doc_id long, text string, file string, place string, n string, cls string, member string"
BASE = sentence(120)
SPREAD = sentence(60)
TEXTS = [
    None, "", " \n\t ", "one", "ONE", "a b c d", "A b\nc\td", "a b c d e", BASE, BASE.upper(), edited(BASE, 0.01), edited(BASE, 0.03),
    sentence(9000), "é ü ß 漢字 words here", *(edited(BASE, s / 200) for s in range(1, 30)), *(SPREAD + " " + sentence(12) for _ in range(20)),
    *(sentence(rng.randint(1, 40)) for _ in range(20)),
]
ROWS = [(i, t, "f", "p", "n", "c", "m") for i, t in enumerate(TEXTS)]
ROWS += [ROWS[8], ROWS[8], (None, BASE, *ROWS[0][2:]), (None, None, *ROWS[0][2:]), (None, sentence(9), *ROWS[0][2:])]


def found(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect()), key=repr)


def test_components_of_odd_rows(spark):
    ship_package(spark)
    docs = spark.createDataFrame(ROWS, SCHEMA)
    assert found(nj.linked_documents(docs)) == component_ids(ROWS)
    assert nj.linked_documents(docs.limit(0)).count() == 0


def test_chains_of_edits(spark, monkeypatch):
    """Links over many groups, each opened by many tasks."""
    ship_package(spark)
    monkeypatch.setattr(nj, "QUERIES", 2)
    text, rows = sentence(80), []
    for i in range(150):
        rows.append((1000 - i, text))
        text = edited(text, 0.03) if i % 10 else sentence(rng.randint(5, 120))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(nj.linked_documents(docs)) == component_ids(rows)


def test_near_copies_of_one_text_in_a_third_of_the_rows(spark):
    ship_package(spark)
    texts = [edited(BASE, rng.choice([0.01, 0.02, 0.04])) for _ in range(200)] + [BASE] * 200 + [sentence(100) for _ in range(400)]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    assert found(nj.linked_documents(docs)) == component_ids(rows)


def test_all_pairs_of_different_sets(spark):
    ship_package(spark)
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    pairs, membership = nj.similar_pairs(spark.createDataFrame(rows, "doc_id long, text string"))
    of = {}
    for r in membership.collect():
        of.setdefault(r["cls"], []).append(r["doc_id"])
    got = {frozenset((min(of[r["cls"]]), min(of[r["cls2"]]))) for r in pairs.collect()}
    sets = {}
    for i, t in rows:
        if shingles(t):
            sets.setdefault(shingles(t), i)
    want = {frozenset((sets[x], sets[y])) for x in sets for y in sets if x != y and similar(x, y)}
    assert got == want and len(want) > 10


def test_shingle_sets_are_those_of_the_text():
    texts = [None, "", "a", "a b c d e f", "x x x x x x x", sentence(50)]
    offsets, hashes = nj.shingle_sets(pa.array([t and t.encode() for t in texts], pa.binary()))
    assert [b - a for a, b in zip(offsets, offsets[1:])] == [len(shingles(t)) for t in texts]
    assert len(set(hashes.tolist())) == len(frozenset().union(*map(shingles, texts)))


def test_a_group_is_ruled_out_by_its_union():
    import numpy as np

    sets = [np.arange(0, 10, dtype=np.uint64), np.arange(5, 15, dtype=np.uint64)]
    group = nj.Group([64, 65], sets)
    assert group.similar(sets[0], 80) == [0] and group.similar(np.arange(5, 13, dtype=np.uint64), 80) == [1]
    assert group.similar(np.arange(3, 13, dtype=np.uint64), 80) == []  # the union holds all of it, no member does
    assert group.similar(np.arange(40, 50, dtype=np.uint64), 80) == []


def test_runs_across_batches():
    import numpy as np

    token = np.array([1, 2, 2, *[3] * 200, 4, 5, 5])
    rows = [token, np.arange(len(token)), np.full(len(token), 9), np.zeros(len(token), dtype=np.int64)]
    for size in (1, 7, 500):
        batches = [pa.RecordBatch.from_arrays([pa.array(r[i : i + size]) for r in rows], names=["token", "member", "n", "place"])
                   for i in range(0, len(token), size)]
        out = pa.Table.from_batches(list(nj._shared(iter(batches)))).to_pylist()
        assert [r["member"] for r in out] == [i for i, t in enumerate(token) if t not in (1, 4)]
        assert [r["far"] for r in out if r["token"] == 3] == [False] * nj.LONG + [True] * (200 - nj.LONG)
        assert not any(r["far"] for r in out if r["token"] != 3)
