"""Operators of the training-text package on small tables: odd rows, ties, repeats, empty tables, brute force."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest

from turnspark.llm import decontaminate, langid, license_scan, line_dedup, packing, quality_rules, sharding, simhash, url_filter, warc, words
from turnspark.shipping import ship_package

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, file string, place string, row string"
rng = random.Random(5)
VOCABULARY = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(400)]


def sentence(n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


SHARED = sentence(30)
TEXTS = [
    None, "", " \n\t ", "one", "Word word WORD", "a b c d", SHARED, SHARED + "\n" + sentence(40),
    SHARED.replace(SHARED.split()[3], "changed", 1), sentence(60) + "\n" + SHARED, "x " * 40, "Released under the MIT License.\nMIT license",
    sentence(9000), "é ü ß 漢字 words", "\n\n" + sentence(12), sentence(12) + "\n" + sentence(12),
]
ROWS = [(i, t, "xx" if i % 2 else None, "s", 0, "f", "p", "r") for i, t in enumerate(TEXTS)]
ROWS += [ROWS[6], ROWS[9], (None, SHARED, None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    ship_package(spark)
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def test_fingerprints_and_components(spark, docs, none):
    got = simhash.near_duplicates(docs).collect()
    prints = [simhash.fingerprint(t.encode() if t is not None else None) for _, t, *_ in ROWS]
    assert sorted(r["fp"] & (1 << 64) - 1 for r in got) == sorted(prints)
    root = list(range(len(ROWS)))
    for _ in ROWS:
        for i in range(len(ROWS)):
            for j in range(len(ROWS)):
                if (prints[i] ^ prints[j]).bit_count() <= 4:
                    root[i] = root[j] = min(root[i], root[j])
    want = {}
    for i, row in enumerate(ROWS):
        if row[0] is not None:
            want[root[i]] = min(want.get(root[i], row[0]), row[0])
    assert sorted((r["component_id"] for r in got)) == sorted(want[x] for x in root)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(root))
    assert simhash.near_duplicates(none).count() == 0


def test_segment_keys_meet_up_to_four_errors():
    one = np.array([rng.getrandbits(64) for _ in range(300)], dtype=np.uint64)
    for errors in range(5):
        flips = [sum(1 << b for b in rng.sample(range(64), errors)) for _ in one]
        both = np.concatenate([one, one ^ np.array(flips, dtype=np.uint64)]).view(np.int64)
        rows, keys = simhash.segment_keys(both)
        held = [set() for _ in both]
        for row, key in zip(rows.tolist(), keys.tolist()):
            held[row].add(key)
        assert all(held[i] & held[i + len(one)] for i in range(len(one)))


@pytest.mark.parametrize("limits", [(64, 8, 4096), (2, 1, 3)])
def test_repeated_lines(docs, none, monkeypatch, limits):
    for name, value in zip(("WIDE", "MANY", "FAR"), limits):
        monkeypatch.setattr(line_dedup, name, value)
    order = sorted((r[0] is None, r[0] or 0, k) for k, r in enumerate(ROWS))
    seen, want = [], {}
    for _, _, k in order:
        gone = []
        for number, line in enumerate((ROWS[k][1] or "").lower().split("\n")):
            one = frozenset(line.split())
            if len(line.split()) >= line_dedup.MIN_WORDS:
                if any(len(one & x) >= 0.8 * len(one | x) for x in seen):
                    gone.append(number)
                seen.append(one)
        want.setdefault(ROWS[k][0], []).append(gone)
    got = {}
    for r in line_dedup.line_report(docs).collect():
        got.setdefault(r["doc_id"], []).append(list(r["removed"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    cut = line_dedup.drop_repeated_lines(docs)
    assert cut.columns == docs.columns and cut.count() == len(ROWS)
    assert line_dedup.line_report(none).count() == 0


def test_repeated_short_lines(spark):
    ship_package(spark)
    one = random.Random(3)
    menu = ["Home", "home", "About us", "us about", "Read more", "Terms of use", "a b c d", "A  b\tc d", "a b c d e", "b", "b b b b b b", "", " \t"]
    some = ["\n".join(" ".join(one.choice("abcdefg") for _ in range(one.randint(0, 9))) for _ in range(4)) for _ in range(60)]
    texts = ["\n".join(menu), "\n".join(reversed(menu)), *some, "Home\nsomething else"]
    seen, want = [], []
    for text in texts:
        gone = []
        for number, line in enumerate(text.lower().split("\n")):
            words = frozenset(line.split())
            if words:
                if any(len(words & x) >= 0.8 * len(words | x) for x in seen):
                    gone.append(number)
                seen.append(words)
        want.append(gone)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [list(r["removed"]) for r in line_dedup.line_report(rows).orderBy("doc_id").collect()] == want


def test_words_with_one_token_value_are_told():
    line, hashes = np.array([0, 0, 1, 1, 2, 2]), np.array([5, 5, 5, 6, 5, 7], dtype=np.uint64)
    assert line_dedup._merged(line, hashes, np.array([1, 1, 2])).tolist() == [False, True, False]


def test_leaks(spark, docs, none):
    item = sentence(40)
    half = item.split()
    near = " ".join(w if i % 6 else "other" for i, w in enumerate(half))
    bench = spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string")
    more = docs.union(spark.createDataFrame([(90, sentence(50) + " " + item.upper() + " " + sentence(70), *[None] * 6), (91, sentence(20) + near, *[None] * 6)], SCHEMA))
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(more, bench).collect()}
    assert found == {(90, 1), (91, 1)}
    assert decontaminate.drop_leaks(more, bench).count() == len(ROWS)
    assert decontaminate.leaks(none, bench).count() == 0
    assert decontaminate.leaks(docs, bench.limit(0)).count() == 0


own = random.Random(11)  # the others' draws stay as they are


def prose(n):
    return " ".join(own.choice(VOCABULARY) for _ in range(n))


def leaked(spark, texts, items):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return sorted((r["doc_id"], r["item_id"]) for r in decontaminate.leaks(rows, bench).collect())


def test_leaks_of_an_item_in_a_third_of_the_rows(spark):
    ship_package(spark)
    item, other = prose(40), prose(40)
    texts = [prose(8) + " " + item + " " + prose(8) if i % 3 == 0 else prose(56) for i in range(90)]
    assert leaked(spark, texts, [item, other]) == [(i, 0) for i in range(0, 90, 3)]


def test_two_leaks_among_a_dozen_passages(spark):
    ship_package(spark)
    item = prose(40)
    assert leaked(spark, [prose(10) + " " + item if i in (4, 9) else prose(50) for i in range(12)], [item]) == [(4, 0), (9, 0)]


def test_leaks_of_a_long_item(spark):
    ship_package(spark)
    item = " ".join(f"w{i}" for i in range(1000))
    near = " ".join("other" if i % 6 == 0 else w for i, w in enumerate(item.split()))
    texts = [prose(200), prose(70) + " " + item + " " + prose(300), near, prose(1500)]
    assert leaked(spark, texts, [item, prose(40)]) == [(1, 0), (2, 0)]


def test_a_common_item_is_found_among_rare_words(spark):
    ship_package(spark)
    item, rare = prose(40), [" ".join(f"q{k}x{i}" for i in range(24)) for k in range(30)]
    texts = [rare[k] + " " + item + " " + rare[k] for k in range(30)]
    found = leaked(spark, texts, [item, *(r + " tail" for r in rare)])
    assert [d for d, i in found if i == 0] == list(range(30))


def test_passages_keep_every_word():
    for n in (1, 64, 65, 96, 97, 1000):
        parts = decontaminate._passages(np.arange(n))
        assert len(parts) == decontaminate.n_passages(n) and np.concatenate(parts).tolist() == list(range(n))


def test_subsequence():
    for _ in range(200):
        a, b = ([rng.randint(0, 4) for _ in range(rng.randint(0, 12))] for _ in "ab")
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert decontaminate.subsequence(a, b) == table[-1][-1]


def test_language(spark, docs, none):
    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = [(i, " ".join(rng.choice(v) for _ in range(30)), lang) for i in range(200) for lang, v in (("aa", ["the", "water", "house"]), ("bb", ["das", "wasser", "haus"]))]
    rows += [(1000, None, "aa"), (1001, "12 !", "bb"), (1002, "", None), (1003, "½ ²", "aa")]
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), path).collect()
    for (doc_id, text, lang), r in zip(rows, got):
        assert r["held_out"] == (zlib.crc32(str(doc_id).encode()) % 5 == 0) and 0 <= r["score"] <= 1
        assert r["lang_pred"] == ("und" if doc_id >= 1000 else lang)
    assert langid.identify(none, path).count() == 0
    assert langid.keep_identified(docs, path).columns == docs.columns


def test_signs_are_no_letters():
    assert langid.words_of("½ ²") == [] and langid.words_of("x² Ab½c") == ["▁x", "▁ab", "▁c"]


def test_forward_sums_all_segmentations():
    lattice = langid.Lattice(["a", "b", "ab", "ba", "aba"])
    probs = np.array([[0.3, 0.2, 0.2, 0.1, 0.15, 0.05, 0.0]])

    def total(word):
        names = {"a": 0.3, "ab": 0.2, "b": 0.2, "ba": 0.1, "aba": 0.15}
        return 1.0 if not word else sum(names.get(word[:n], 0.05 if n == 1 else 0) * total(word[n:]) for n in range(1, len(word) + 1))

    order = sorted(["a", "b", "ab", "ba", "aba"])
    probs[0, :5] = [{"a": 0.3, "ab": 0.2, "b": 0.2, "ba": 0.1, "aba": 0.15}[p] for p in order]
    lattice = langid.Lattice(order)
    some = ["abab", "abcba", "b", "aabaab"]
    assert np.allclose(np.exp(lattice.log_scores(some, probs)[:, 0]), [total(w) for w in some])


def test_long_runs_are_summed_whole():
    order = sorted(["a", "b", "ab", "ba", "aba", "bbab"])
    lattice = langid.Lattice(order)
    probs = np.array([[0.3, 0.2, 0.15, 0.1, 0.1, 0.1, 0.05, 0.0], [0.1, 0.1, 0.3, 0.2, 0.2, 0.05, 0.05, 0.0]])
    some = ["".join(rng.choice("abbac") for _ in range(n)) for n in (langid.LONG, langid.LONG + 1, 3 * langid.LONG)]

    def total(word, p):
        sums = [1.0]
        for end in range(1, len(word) + 1):
            sums.append(sum(sums[end - n] * (p[order.index(w)] if w in order else p[6] if n == 1 else 0) for n in range(1, min(4, end) + 1) for w in [word[end - n : end]]))
        return np.log(sums[-1])

    assert np.allclose(lattice.log_scores(some, probs), [[total(w, p) for p in probs] for w in some])
    # counts of long runs by positions equal those of the block sums, and do not depend on the stretch
    whole = lattice.expected(some[:1], np.ones(1), probs[0])
    assert np.allclose(lattice.run_expected(some[0], probs[0]), whole)
    longest = lattice.run_expected(some[2], probs[0])
    old, langid.STRETCH = langid.STRETCH, 7
    try:
        assert np.allclose(lattice.run_expected(some[2], probs[0]), longest)
        assert np.allclose(lattice.log_scores(some, probs), [[total(w, p) for p in probs] for w in some])
    finally:
        langid.STRETCH = old
    assert np.isfinite(lattice.log_scores(["ab" * 50_000], probs)).all()


def test_score_turns_strangers_away(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    words = ["the", "water", "house", "river", "with", "under", "morning", "people"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(30)), "en") for i in range(300)]
    rows += [(1000, "xkqzv jjqw pqrx zzkt bvvx qwrtp", None), (1001, "Привет мир как дела сегодня", None), (1002, "日本語の文章です", None)]
    kept = langid.keep_identified(spark.createDataFrame(rows, "doc_id long, text string, lang string"), path, least=0.5).collect()
    assert sorted(r["doc_id"] for r in kept) == list(range(300))


def test_every_letter_piece_is_used():
    pieces = langid.public_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    assert max(map(len, pieces)) > 10 and all(p.removeprefix(langid.START).isalpha() for p in pieces)


def test_packing(docs, none):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = packing.packed_documents(docs, path).collect()
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    ids = [tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for _, t, *_ in ROWS]
    want = sorted((k, len(x[k : k + 4096]), zlib.crc32(np.array(x[k : k + 4096], "<u4").tobytes())) for x in ids for k in range(0, len(x), 4096))
    assert sorted((r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    held = {}
    for r in rows:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in held.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 4096
    assert len(held) == -(-sum(map(len, ids)) // 4096)
    assert packing.packed_documents(none, path).count() == 0


def test_genetic_algorithm_keeps_items_and_capacity():
    sizes = [rng.randint(20, 60) for _ in range(120)]
    genome = packing.evolve(sizes, 100, 1, [])
    fills = np.bincount(genome, weights=sizes)
    assert len(genome) == 120 and fills.max() <= 100
    plain = packing.Packing(sizes, 100)
    plain.best_fit(list(range(120)))
    assert len(set(genome)) <= len(plain.bins)


def test_packing_tokenises_letters_once(monkeypatch):
    """Words that differ in case and marks share the ids of their letters, and the ids are those of the whole word."""
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        source = f.read()
    (plain, closes), asked = packing._tokenizer(source), []

    class Counted:
        def encode_batch_fast(self, texts, **how):
            asked.extend(t for text in texts for t in text.split())
            return plain.encode_batch_fast(texts, **how)

        def encode(self, text, **how):
            return plain.encode(text, **how)

    monkeypatch.setattr(packing, "_KNOWN", {})
    monkeypatch.setattr(packing, "_TOKENIZER", [Counted(), closes])
    texts = ["Rivers. rivers, RIVERS rivers### Été été. don't don' 's. a1 \u0130x ab<|endoftext|> ab\u0301. <| x-y 漢字."]
    got = packing.packed_ids([t.encode() for t in texts], source)
    want = [np.array([i for w in t.split() for i in plain.encode(w, add_special_tokens=False).ids], dtype="<u4").tobytes() for t in texts]
    assert got == want
    assert asked.count("rivers") == 1 and asked.count("été") == 1 and not any(t.startswith("R") for t in asked)


def test_sharding(docs, none):
    rows = sharding.assigned(docs).collect()
    assert sorted(r["size"] for r in rows) == sorted(len((t or "").encode()) + 8 for _, t, *_ in ROWS)
    assert len({r["shard"] for r in rows if r["size"] == 8}) == 1
    for shard in {r["shard"] for r in rows}:
        slots = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    assert sharding.assigned(none).count() == 0


def test_star_links_of_a_dense_group(spark):
    """One row for a fingerprint and a star, however many buckets hold them; far stars give none."""
    fps = [0, 1, 2, 4, 8]
    shared = spark.createDataFrame([(k, f, 0, 1, 2, -1) for k in range(30) for f in fps], "key long, fp long, l1 long, l2 long, l3 long, l4 long")
    rows = [tuple(r) for r in simhash.star_links(shared).collect()]
    assert sorted(rows) == sorted((f, x) for f in fps for x in (0, 1, 2) if f != x)


def test_differencing():
    sizes = [[rng.randint(1, 10_000)] for _ in range(500)]
    sums, slots = sharding.difference(sizes, 24)
    assert max(sums) - min(sums) <= 10
    assert sums == np.bincount([s[0] for s in slots], weights=[s[0] for s in sizes], minlength=24).tolist()


def test_differencing_goes_on_where_the_ends_cannot_trade():
    for seed in (1290, 2967, 6468):
        own = random.Random(seed)
        sums, _ = sharding.difference([[own.randint(1, 10_000)] for _ in range(500)], 24)
        assert max(sums) - min(sums) <= 10


def test_quality(spark, docs, none):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(10)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality_rules.judged(docs, labels).collect()
    want = []
    for doc_id, text, *_ in ROWS:
        found = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        windows = [tuple(found[i : i + 5]) for i in range(len(found) - 4)]
        marked = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 5)} if len(found) < 1000 else set()
        want.append((len(found), len(marked), len(found) < 10 or 100 * len(marked) > 20 * len(found)))
    assert sorted((r["n_words"], r["n_repeat_words"], r["base_failed"]) for r in got) == sorted(want)
    assert all(not (r["kept"] and r["base_failed"]) for r in got)
    assert quality_rules.judged(none, labels).count() == 0
    assert quality_rules.judged(docs, labels.limit(0)).where("not kept and not base_failed").count() == 0


def test_rules_are_learned(spark):
    rows = [(i, f"{'$' * (i % 2) * 9} " + sentence(30)) for i in range(400)]
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(400)], "doc_id long, quality int")
    got = quality_rules.judged(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    assert got.where("kept <> (doc_id % 2 = 0)").count() == 0


def test_warc(spark, docs):
    rows = [(1, "u", "x"), (2, None, "x"), (3, "v", None), (4, "w", ""), (None, "w", "y"), (5, "z", "q\r\n\r\nWARC/1.1 é" * 3000), (5, "z", "q")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.round_trip(pages).collect()}
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    revisits = {1: 2, 3: 4}
    assert got == {(i, len((t or "").encode()), digest(t), "revisit" if i in revisits else "response", revisits.get(i)) for i, _, t in rows}
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_filters_never_match_null():
    from pyspark.sql.datasource import EqualTo, In

    reader = warc._Reader("file:/nowhere", warc.StructType([]), False)
    assert list(reader.pushFilters([In(("page_id",), (1, None)), EqualTo(("url",), "u")])) == []
    assert reader.wanted == {"page_id": {1}, "url": {"u"}}


def test_urls(spark):
    urls = ["http://a.example.net/en/1", "https://X.NET/de", "http://example.com/de/3?x=1", "http://b.org/fr/", "http://b.org/fr", None, "no", "http://q.io#f"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labelled = spark.createDataFrame([("http://a.io/1", 0), ("http://b.io/2", 1), (None, None)], "url string, label int")
    got = [tuple(r)[1:5] for r in url_filter.judge(pages, labelled).orderBy("page_id").collect()]
    assert [g[2] for g in got] == ["example.net/en/", "net/", "example.com/de/", "org/fr/", None, None, None, None]
    assert got[0][:2] == ("a.example.net", "/en/1") and got[1][:2] == ("x.net", "/de") and got[5][:2] == ("", "") and got[7][:2] == ("q.io", "")
    assert [g[3] for g in got[:4]] == ["allow", "block", "block", "allow"]
    assert {r["verdict"] for r in url_filter.judge(pages, labelled.limit(0)).where("rule is null").collect()} == {"allow"}


def test_suffixes_of_all_labelled_urls(spark):
    rows = [(f"http://{chr(97 + k // 26)}{chr(97 + k % 26)}.io/{i}", k % 2) for k in range(40) for i in range(10)]
    labelled = spark.createDataFrame(rows, "url string, label int")
    suffixes, *_ = url_filter.fit(labelled, sample=50)
    assert suffixes.count() == 40
    assert {round(r["suffix_share"], 6) for r in suffixes.collect()} == {round(10 / 30, 6), round(20 / 30, 6)}


def test_an_unseen_suffix_counts_as_the_mean(spark):
    rows = [(f"http://{'aa' if i % 5 else 'bb'}.io/{i}", int(i % 5 > 0)) for i in range(100, 300)]
    labelled = spark.createDataFrame(rows, "url string, label int")
    pages = spark.createDataFrame([(1, "http://aa.io/150"), (2, "http://bb.io/150"), (3, "http://cc.io/150")], "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(pages, labelled).collect()}
    assert got == {1: "block", 2: "allow", 3: "block"}


def test_licences(docs, none):
    got = {r["n_words"]: r for r in license_scan.scan(docs).collect()}
    row = got[7]
    assert (row["n_base"], row["first_word"], row["last_word"], row["base_labels"], row["labels"]) == (2, 3, 5, "mit", "mit")
    assert 200 < len(license_scan.signature_rules())
    found = license_scan.detections(b" licensed under the apache license version 2 0 ", license_scan.signature_rules())
    assert [r.label for _, _, r in found] == ["apache-2.0"]
    assert license_scan.scan(none).count() == 0


def test_parse(monkeypatch):
    import pyarrow as pa

    for size in (1 << 21, 11):
        monkeypatch.setattr(words, "CHUNK_BYTES", size)
        texts = [None, b"", b"aB c\n\nD", b"\n", b"x" * 30 + b"\ny z"]
        got = [(int(p.line_text[i]), int(p.line_number[i]), p.low[p.line_start[i] : p.line_end[i]]) for p in words.parse(pa.array(texts, pa.binary())) for i in range(len(p.line_start))]
        assert got == [(t, n, x) for t, text in enumerate(texts) for n, x in enumerate((text or b"").lower().split(b"\n"))]
