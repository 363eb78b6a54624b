"""The trie of conversation prefixes against dictionaries of whole paths."""

import hashlib
import random
import re
import zlib

from turnspark.llm import prefix_trie as pt
from turnspark.shipping import ship_package

rng = random.Random(3)


def lines_of(rows):
    """Rebuilt conversations by id, each a list of (role, text)."""
    by = {}
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()
            by.setdefault(conv, []).append(((turn is not None, turn or 0, digest), (role, text)))
    own = {c: [x for _, x in sorted(v)] for c, v in by.items()}
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - c % 20, [])[:h] + own[c][h:]
    return out


def expected(rows):
    lines = lines_of(rows)
    members = {}
    for c, line in lines.items():
        for d in range(len(line) + 1):
            members.setdefault(tuple(line[:d]), []).append(c)
    out = []
    for path, convs in members.items():
        below = [p for p in members if p[: len(path)] == path]
        children = [p for p in below if len(p) == len(path) + 1]
        leaves = [p for p in below if not any(q[:-1] == p for q in members if q)]
        saved = sum((len(members[p]) - 1) * len(re.findall("[^\x20\x09-\x0d]+", p[-1][1])) for p in below if p)
        ends = ",".join(str(c) for c in sorted(convs) if len(lines[c]) == len(path))
        parent = min(members[path[:-1]]) if path else None
        digest = hashlib.sha256(ends.encode()).hexdigest()
        out.append((min(convs), len(path), parent, len(convs), len(children), len(leaves), saved, digest))
    return sorted(out, key=repr)


COLUMNS = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()


def found(spark, rows, schema="conv_id long, turn long, role string, text string"):
    ship_package(spark)
    table = spark.createDataFrame(rows, schema)
    nodes = pt.prefix_trie(pt.rebuilt(pt.numbered_turns(table)))
    return sorted((tuple(r[c] for c in COLUMNS) for r in nodes.collect()), key=repr)


def test_random_conversations(spark):
    """Few different turns, so that paths meet and part; ids over several shards and below zero's neighbourhood."""
    ids = [*range(60), 1020, 1023, 1024, 1031, 5_000_000_000, 5_000_000_013, 2**40 + 7]
    rows = []
    for c in ids:
        for t in range(rng.randint(1, 7)):
            rows.append((c, t, rng.choice(["user", "bot"]), rng.choice(["a b", "c", "long one here"])))
    rng.shuffle(rows)
    assert found(spark, rows) == expected(rows)


def test_odd_rows(spark):
    rows = [
        (1, None, "u", "x y"), (1, 0, None, None), (1, 0, "u", " \t"), (1, 0, "u", "x"), (1, 0, "u", "x"),  # ties and repeats
        (None, 0, "u", "lost"), (7, 0, "u", ""), (7, 1, "", "u"), (8, -3, "é", "漢 字"), (27, 5, "u", "x y"), (41, 1, "1:u", "x"),
        (48, 0, "u", "word " * 20_000),
    ]
    extra = [(*r, "p", "q", "r") for r in rows]
    assert found(spark, extra, "conv_id long, turn long, role string, text string, path string, shard string, pos string") == expected(rows)
    assert found(spark, [], "conv_id long, turn long, role string, text string") == []


def test_one_conversation_in_a_third_of_the_ids(spark):
    """The copies fall into several shards, their ends into one hash."""
    rows = []
    for c in range(0, 4000):
        same = c % 3 == 0
        for t in range(4):
            rows.append((c, t, "u", f"same {t}" if same else f"{c % 700} {t}"))
    got, want = found(spark, rows), {}
    lines = lines_of(rows)
    for c, line in lines.items():
        for d in range(len(line) + 1):
            want.setdefault(tuple(line[:d]), []).append(c)
    assert sorted(r[3] for r in got) == sorted(len(v) for v in want.values())
    ends = [hashlib.sha256(",".join(str(c) for c in v if len(lines[c]) == len(p)).encode()).hexdigest() for p, v in want.items()]
    assert sorted(r[7] for r in got) == sorted(ends)


def test_a_long_conversation(spark):
    rows = [(3, t, "u", f"{t}") for t in range(5000)] + [(4, t, "u", f"{t}") for t in range(2500)]
    got = found(spark, rows)
    lines = lines_of(rows)
    assert max(r[1] for r in got) == len(lines[3]) and sum(r[3] for r in got) == sum(len(x) + 1 for x in lines.values())


def test_children_come_from_intersections():
    index = pt.Index([[0, 1], [0, 2], [5], []])
    assert index.children(0b1111, 0) == [(0, 0b0011), (5, 0b0100)]
    assert index.children(0b0011, 1) == [(1, 0b01), (2, 0b10)] and index.children(0b0100, 1) == []
    assert [n[4] for n in pt.nodes([[0, 1], [0, 2], [5], []])] == [0b1000, 0, 1, 2, 4]
