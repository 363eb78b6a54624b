"""Vector codes against plain loops over integers."""

import hashlib
import math
import random

import numpy as np

from turnspark.llm import vector_codes as vc
from turnspark.shipping import ship_package

rng = random.Random(2)
SCHEMA = "vec_id long, embedding array<float>, label int, code string, error string, at string"


def expected(rows):
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1])
    kept = [r for r in kept if len(r[1]) == width]
    ints = [[max(-vc.FARTHEST, min(vc.FARTHEST, math.floor(256 * float(np.float32(x))))) for x in r[1]] for r in kept]
    cuts = [width * p // 16 for p in range(17)]
    parts = [[tuple(v[a:b]) for a, b in zip(cuts, cuts[1:])] for v in ints]
    books = [[parts[i][p] for i in range(min(64, len(parts)))] for p in range(16)]

    def near(p, part):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), i) for i, e in enumerate(books[p]))

    for _ in range(2):
        for p in range(16):
            groups = {}
            for v in parts:
                groups.setdefault(near(p, v[p])[1], []).append(v[p])
            moved = {e: tuple(sum(c) // len(g) for c in zip(*g)) for e, g in groups.items()}
            books[p] = [moved.get(e, old) for e, old in enumerate(books[p])]
    digest = hashlib.sha256(",".join(str(x) for p in books for e in p for x in e).encode()).hexdigest()
    out = []
    for r, v in zip(kept, parts):
        best = [near(p, v[p]) for p in range(16)]
        out.append((r[0], r[2], "".join(f"{e:02x}" for _, e in best), sum(d for d, _ in best)))
    sums = {}
    for _, label, _, error in out:
        sums[label] = sums.get(label, 0) + error
    return sorted(((i, c, e, sums[label], digest) for i, label, c, e in out), key=repr)


def found(spark, rows):
    ship_package(spark)
    got = vc.compressed(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    return sorted(((r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in got), key=repr)


def vectors(n, width=32, steps=40):
    return [[rng.randint(-steps, steps) / 256 + rng.random() / 300 for _ in range(width)] for _ in range(n)]


def test_odd_rows(spark):
    data = vectors(120)
    rows = [(i * 3, v, rng.choice([0, 1, 2, None]), "c", "e", "a") for i, v in enumerate(data)]
    rows += [rows[5], rows[70], (None, data[9], None, "c", "e", "a"), (900, None, 1, "c", "e", "a")]
    rows += [(901, [*data[0][:-1], x], 1, "c", "e", "a") for x in (None, float("nan"), float("inf"), float("-inf"))]
    rows += [(902, [0.5], 1, "c", "e", "a"), (903, [], 1, "c", "e", "a"), (904, [3e38] * 32, 1, "c", "e", "a")]
    assert found(spark, rows) == expected(rows)


def test_ties_few_rows_and_equal_vectors(spark):
    rows = [(i, [0.0, 1 / 256] * 16, None, None, None, None) for i in range(5)]
    rows += [(10, [1 / 256, 0.0] * 16, 3, None, None, None)]
    assert found(spark, rows) == expected(rows)


def test_hot_label_and_hot_vector(spark):
    data = vectors(300)
    rows = [(i, data[0] if i % 3 == 0 else data[i], 7 if i % 2 else i, None, None, None) for i in range(300)]
    assert found(spark, rows) == expected(rows)


def test_no_vector(spark):
    assert found(spark, []) == [] and found(spark, [(1, None, 1, None, None, None)]) == []


def test_width_that_does_not_divide(spark):
    rows = [(i, v, 1, None, None, None) for i, v in enumerate(vectors(90, 20))]
    assert found(spark, rows) == expected(rows)


def test_dictionaries_give_the_distances():
    books = vc.Codebooks((0, 2, 5), tuple(np.array([[rng.randint(-9, 9) for _ in range(w)] for _ in range(7)]) for w in (2, 3)))
    values = np.array([[rng.randint(-9, 9) for _ in range(5)] for _ in range(3000)])
    chosen, far = vc.nearest(values, books)
    for p, (a, b) in enumerate(((0, 2), (2, 5))):
        plain = ((values[:, None, a:b] - books.entries[p][None]) ** 2).sum(axis=2)
        assert (chosen[:, p] == plain.argmin(axis=1)).all() and (far[:, p] == plain.min(axis=1)).all()


def test_a_code_decodes_to_its_entries():
    books = vc.Codebooks((0, 1, 2), (np.array([[0], [256]]), np.array([[-128], [3]])))
    assert books.decode(bytes([1, 0])).tolist() == [1 + 0.5 / 256, -0.5 + 0.5 / 256]
