"""Duplicates, comparison, validation, label files and the score store."""

import difflib
import math
import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from turnspark.operators import compare as cp
from turnspark.operators import duplicates as du
from turnspark.operators import near as nr
from turnspark.sources import labels as lb
from turnspark.sources import scores as st
from turnspark.sources.trials import load_trials
from turnspark.sources.turns import read_turns


def train(spark, rows):
    return spark.createDataFrame(
        [(100 + i, i, t, y) for i, (t, y) in enumerate(rows)],
        "id long, pos long, text string, label int",
    )


def test(spark, texts):
    return spark.createDataFrame(
        [(i, i, t) for i, t in enumerate(texts)], "id long, pos long, text string"
    )


test.__test__ = False


def base(spark, labels):
    return spark.createDataFrame(
        [(i, y, 0.25) for i, y in enumerate(labels)], "id long, label int, prob double"
    )


def test_exact_transfer_golden(spark):
    tr = train(spark, [("A ", 1), ("a", 0), ("B", 1), ("c", 1)])
    te = test(spark, ["a", " b", "zzz", "C"])
    bs = base(spark, [0, 0, 0, 1])
    report = {r["test_id"]: r for r in du.exact_duplicate_transfer(tr, te, bs).collect()}
    assert set(report) == {0, 1, 3}
    assert not report[0]["unanimous"] and not report[0]["applied"] and report[0]["n_train"] == 2
    assert report[1]["new_label"] == 1 and report[1]["applied"]
    assert not report[3]["applied"]
    members = du.matched_members(tr, te).collect()
    assert sorted(r["train_id"] for r in members) == [100, 101, 102, 103]
    summary = du.transfer_summary(du.exact_duplicate_transfer(tr, te, bs)).first()
    assert summary.asDict() == {
        "exact_matches": 3, "conflicts": 1, "override_candidates": 1, "applied_overrides": 1,
    }


def test_overrides_touch_nothing_else(spark):
    over = spark.createDataFrame(
        [(1, 1, "exact"), (1, 0, "near"), (2, 1, "exact")], "id long, new_label int, match_type string"
    )
    got = {r["id"]: r["label"] for r in du.apply_overrides(base(spark, [0, 1, 0, 1]), over).collect()}
    assert got == {0: 0, 1: 0, 2: 1, 3: 1}


def brute_near(train_rows, test_texts, k, r):
    """Dense cosine over all pairs, then the ratio gate, with copies ranked one by one."""

    def grams(text):
        out = []
        for word in text.split():
            padded = f" {word} "
            for n in (3, 4, 5):
                if len(padded) <= n:
                    out.append(padded)
                    break
                out += [padded[i : i + n] for i in range(len(padded) - n + 1)]
        return Counter(out)

    docs = [grams(t) for t, _ in train_rows]
    df = Counter(g for d in docs for g in d)
    idf = {g: math.log((1 + len(docs)) / (1 + n)) + 1 for g, n in df.items()}

    def unit(d):
        raw = {g: c * idf[g] for g, c in d.items() if g in idf}
        norm = math.sqrt(sum(v * v for v in raw.values())) or 1.0
        return {g: v / norm for g, v in raw.items()}

    units = [unit(d) for d in docs]
    out = {}
    for i, text in enumerate(test_texts):
        if not text:
            continue
        mine = unit(grams(text))
        cos = [round(sum(v * u.get(g, 0.0) for g, v in mine.items()), 12) for u in units]
        order = sorted(range(len(docs)), key=lambda j: (-cos[j], -j))[:k]
        best = None
        for j in order:
            other = train_rows[j][0]
            if other == text:
                continue
            ratio = difflib.SequenceMatcher(None, text, other, autojunk=False).ratio()
            if ratio >= r and (best is None or ratio > best[0]):
                best = (ratio, j)
        if best:
            out[i] = (100 + best[1], best[0])
    return out


def near_fixture():
    import random

    rng = random.Random(11)
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa", "lambda", "zeta", "eta"]

    def text(n):
        return " ".join(rng.choice(words) for _ in range(n))

    def edit(t, n):
        chars = list(t)
        for _ in range(n):
            at = rng.randrange(len(chars))
            if rng.random() < 0.5:
                chars.pop(at)
            else:
                chars.insert(at, rng.choice("abcxyz"))
        return " ".join("".join(chars).split())

    originals = [text(rng.randint(4, 60)) for _ in range(25)]
    train_rows = [(t, i % 2) for i, t in enumerate(originals)]
    train_rows += [(edit(t, rng.randint(1, 3)), 1) for t in originals for _ in range(rng.randint(0, 7))]
    train_rows += [(originals[0], 1)] * 6
    tests = [edit(t, rng.randint(0, 4)) for t in originals] + [originals[0], "", "ab"]
    return train_rows, tests


@pytest.mark.parametrize("r", [0.99, 0.95, 0.85])
def test_near_matches_equal_brute_force(spark, r):
    train_rows, tests = near_fixture()
    want = brute_near(train_rows, tests, 5, r)
    got = nr.near_matches(train(spark, train_rows), test(spark, tests), 5, r).collect()
    assert {x["test_id"] for x in got} == set(want)
    for x in got:
        assert x["similarity"] == pytest.approx(want[x["test_id"]][1])
    assert r == 0.99 or len(want) > 5


def test_near_report(spark):
    text = "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf again"
    tr = train(spark, [(text, 1), ("unrelated words here", 0)])
    te = test(spark, [text + "s", text + "x", "nothing"])
    rows = nr.near_duplicate_transfer(tr, te, base(spark, [0, 1, 0])).collect()
    assert {(r["test_id"], r["train_id"], r["applied"]) for r in rows} == {(0, 100, True), (1, 100, False)}
    assert nr.near_duplicate_transfer(tr, te, base(spark, [0, 1, 0]), max_rows=1).count() == 1


def ratio(a, b):
    return difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()


def test_ratio_equals_standard_library():
    import random

    rng = random.Random(5)
    for _ in range(300):
        a = "".join(rng.choice("ab c😀") for _ in range(rng.randint(0, 40)))
        b = "".join(rng.choice("ab c😀") for _ in range(rng.randint(0, 40)))
        assert nr.similarity_ratio(a, b, 0.0) == pytest.approx(ratio(a, b))


def numbered(spark, rows, schema="pos long, id string, label string"):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], schema)


def test_validate_finds_every_violation(spark):
    sub = numbered(spark, [("a", "1"), ("c", "2"), ("b", None), ("b", "0.5"), ("x", "0")])
    want = numbered(spark, [("a",), ("b",), ("c",), ("d",)], "pos long, id string")
    got = {(r["rule"], r["id"]) for r in cp.validate_labels(sub, want, (0, 1)).collect()}
    assert got == {
        ("missing_id", "d"), ("unexpected_id", "x"), ("duplicate_id", "b"),
        ("wrong_position", "c"), ("wrong_position", "b"), ("null_label", "b"),
        ("not_an_integer", "b"), ("outside_domain", "c"), ("row_count", ""),
    }
    good = numbered(spark, [("a", "1"), ("b", "0")])
    assert cp.validate_labels(good, good.select("pos", "id"), (0, 1)).count() == 0
    with pytest.raises(ValueError):
        cp.check_columns(good.select("label", "id"))


def test_compare_and_same_split(spark):
    cands = spark.createDataFrame([("c", 1, 0), ("c", 2, 1)], "candidate string, id long, label int")
    refs = spark.createDataFrame([("r", 1, 0), ("r", 2, 0)], "reference string, id long, label int")
    got = {r["reference"]: r for r in cp.compare_labels(cands, refs, ["r", "gone"]).collect()}
    assert got["r"]["hamming"] == 1 and got["gone"]["hamming"] is None
    assert [r["id"] for r in cp.changed_rows(cands, refs).collect()] == [2]
    assert cp.row_comparison(cands, None).count() == 2
    a = spark.createDataFrame([(0, 5), (1, 6)], "pos long, id long")
    b = spark.createDataFrame([(0, 6), (1, 5)], "pos long, id long")
    assert cp.same_split(a, a).first()["same"] and not cp.same_split(a, b).first()["same"]


def test_label_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    (tmp_path / "a" / "good.csv").write_text("id,label\n1,0\n2,1\n3,1\n")
    (tmp_path / "a" / "bad.csv").write_text("id,labels\n2,0\n1,7\n")
    (tmp_path / "a" / "broken.csv").write_text("nothing here\n\nx,y,z\n")
    (tmp_path / "b" / "good.csv").write_text("id,label\n1,1\n2,1\n3,1\n")
    expected = spark.createDataFrame([(0, 1), (1, 2), (2, 3)], "pos long, id long")
    audit = {
        os.path.basename(r["file"]): r
        for r in lb.audit_labels(spark, str(tmp_path / "a"), expected, (0, 1)).collect()
    }
    assert audit["good.csv"]["status"] == "OK" and audit["good.csv"]["class1"] == 2
    assert audit["bad.csv"]["status"] == "INVALID" and audit["bad.csv"]["bad_labels"] == 1
    assert audit["bad.csv"]["wrong_positions"] == 2 and audit["bad.csv"]["missing_ids"] == 1
    assert audit["broken.csv"]["status"] == "INVALID"
    assert audit["good.csv"]["bytes"] == 21
    assert lb.list_artifacts(spark, str(tmp_path)).count() == 4
    roots = [str(tmp_path / "a"), str(tmp_path / "b")]
    refs = lb.load_references(spark, roots, ["good.csv", "absent.csv"]).orderBy("pos").collect()
    assert [(r["reference"], r["id"], r["label"]) for r in refs] == [
        ("good.csv", "1", 0), ("good.csv", "2", 1), ("good.csv", "3", 1),
    ]


def test_label_parts_are_one_table(spark, tmp_path):
    rows = spark.range(1000).selectExpr("id AS pos", "5000 - id AS id", "CAST(id % 2 AS INT) AS label")
    lb.write_labels(rows.repartition(7), str(tmp_path / "runs" / "good"))
    lb.write_labels(rows.where("pos <> 500"), str(tmp_path / "runs" / "short"))
    lb.write_labels(rows.withColumn("label", F.lit(1)), str(tmp_path / "other" / "good"))
    (tmp_path / "runs" / "single.csv").write_text("id,label\n5000,0\n")
    got = lb.read_label_files(spark, str(tmp_path / "runs" / "good")).where("not is_first")
    assert [(r["pos"], r["id"]) for r in got.orderBy("pos").collect()] == [
        (i, str(5000 - i)) for i in range(1000)
    ]
    audit = {
        os.path.basename(r["file"]): r
        for r in lb.audit_labels(spark, str(tmp_path / "runs"), rows.select("pos", "id"), (0, 1)).collect()
    }
    assert len(audit) == 3 and audit["good"]["status"] == "OK" and audit["good"]["n_rows"] == 1000
    assert audit["short"]["missing_ids"] == 1 and audit["short"]["wrong_positions"] == 499
    assert audit["single.csv"]["missing_ids"] == 999
    roots = [str(tmp_path / name) for name in ("none", "other", "runs")]
    refs = lb.load_references(spark, roots, ["good", "short", "gone"])
    assert {(r["reference"], r["n"], r["ones"]) for r in refs.groupBy("reference").agg(
        F.count("*").alias("n"), F.sum("label").alias("ones")).collect()
    } == {("good", 1000, 1000), ("short", 999, 500)}
    assert lb.load_references(spark, roots[:1], ["good"]).count() == 0


def test_write_labels_keeps_order(spark, tmp_path):
    df = spark.createDataFrame([(i, 99 - i, i % 2) for i in range(100)], "pos long, id long, label int")
    lb.write_labels(df.repartition(5), str(tmp_path / "out"))
    lines = []
    for name in sorted(p for p in os.listdir(tmp_path / "out") if p.startswith("part-")):
        part = (tmp_path / "out" / name).read_text().splitlines()
        assert part[0] == "id,label"
        lines += part[1:]
    assert lines == [f"{99 - i},{i % 2}" for i in range(100)]


def test_score_store(spark, tmp_path):
    rows = [("e", 1, "valid", i, i, i % 2, 0.2 + 0.6 * (i % 2)) for i in range(10)]
    rows += [("e", 1, "test", i, i, None, 0.5) for i in range(4)]
    schema = "experiment string, seed int, split string, pos long, id long, label int, prob double"
    path = str(tmp_path / "scores")
    wanted = spark.createDataFrame([("e", 1, "valid"), ("e", 2, "valid")], "experiment string, seed int, split string")
    assert st.missing_work(spark, wanted, path).count() == 2
    st.save_scores(spark.createDataFrame(rows, schema), path)
    st.save_scores(spark.createDataFrame(rows[:10], schema).withColumn("seed", F.lit(3)), path)
    assert [r["seed"] for r in st.missing_work(spark, wanted, path).collect()] == [2]
    got = {r["seed"]: r for r in st.seed_metrics(st.load_scores(spark, path)).collect()}
    assert got[1]["raw_macro_f1"] == 1.0 and got[1]["threshold"] == pytest.approx(0.3)
    assert (got[1]["valid_count"], got[1]["test_count"], got[3]["test_count"]) == (10, 4, 0)


def test_read_turns(spark, tmp_path):
    (tmp_path / "t.csv").write_text('id,text,label\n1,"a, ""b""",0\n2,,1\n')
    df = read_turns(spark, [str(tmp_path / "no.csv"), str(tmp_path / "t.csv")])
    assert [r["text"] for r in df.orderBy("id").collect()] == ['a, "b"', None]
    (tmp_path / "m.csv").write_text('id,text,label\n1,"a\nb",0\n')
    assert read_turns(spark, [str(tmp_path / "m.csv")], multi_line=True).first()["text"] == "a\nb"
    with pytest.raises(FileNotFoundError):
        read_turns(spark, [str(tmp_path / "no.csv")])


def test_load_trials_checks(spark):
    df = spark.createDataFrame([(1, 0, [[1.0, 2.0]])], "subject int, y int, x array<array<double>>")
    assert load_trials(df, [1], order=[F.col("subject")]).first()["trial"] == 0
    with pytest.raises(ValueError):
        load_trials(df, [1, 2], order=[F.col("subject")])
    with pytest.raises(KeyError):
        load_trials(df.drop("y"))


@pytest.mark.parametrize("r", [0.95, 0.99])
def test_near_candidates_share_more_than_a_passage(spark, r):
    """Prefixes of two texts that reach the ratio share the tokens asked for; texts with a passage in common do not meet."""
    import random

    rng, q = random.Random(3), nr.run_length(r)
    letters = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    passage = letters(150)
    texts = [passage + letters(600) for _ in range(6)]
    changed = texts[0][:300] + "x" + texts[0][301:]
    frame = spark.createDataFrame(list(enumerate(texts)), "no long, text string")
    other = spark.createDataFrame([(9, changed)], "no long, text string")
    assert [tuple(x) for x in nr.candidate_pairs(frame, other, r).collect()] == [(9, 0)]
    counters = nr.run_counters(frame, q)
    mine, its = (set(nr.prefix_tokens(t, counters, r, q).tolist()) for t in (texts[0], changed))
    assert len(mine & its) >= nr.least_met(len(changed), r, q) > 1
    assert nr.shares_enough(texts[0], changed, r) and not nr.shares_enough(texts[0], texts[1], r)
