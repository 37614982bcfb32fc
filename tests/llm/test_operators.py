"""Each operator against a brute-force version, on a table of odd cases."""

import base64
import collections
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from graphloom.llm import byte_bpe, common, components, fingerprint, license_scan, log_suffix, packing, pivots, quality, repeats, simhash, suffix_tree, wavelet, word_bpe

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, ranges string, score string"
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def corpus():
    """Texts with copies, shared passages, periods, odd characters and nothing."""
    dice = random.Random(3)
    words = ["".join(dice.choice("abcdeéßñ") for _ in range(dice.randint(1, 9))) for _ in range(400)]

    def prose(n):
        return " ".join(dice.choice(words) for _ in range(n))

    shared = prose(90)
    texts = [None, "", "   \n\t ", "x", "Ünïcode “quotes” 日本語 it's 3.14", "spam " * 300, "ab" * 900, prose(2500)]
    texts += [prose(dice.randint(1, 150)) for _ in range(12)]
    texts += [prose(40) + " " + shared + " " + prose(30) for _ in range(5)]
    texts += [texts[-1], texts[-1], texts[10]]
    base = prose(200).split()
    for i in range(4):
        near = list(base)
        near[50 * i] = "edited"
        texts.append(" ".join(near))
    texts += ["Released under the MIT License.", "Licensed under the Apache Licence, Version 2.0", "released underthe MIT  licence! cc-by-nc CC BY NC", "all commit license no notice"]
    return list(enumerate(texts))


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None, "clash", "clash", "clash") for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def data(rows):
    return [(i, (t or "").encode()) for i, t in rows]


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


# -- 1 ------------------------------------------------------------------------


def test_license_scan(docs, rows, empty):
    got = by_id(license_scan.scan(docs))
    for i, t in data(rows):
        words = [w for w in t.translate(license_scan.FOLD).decode().split(" ") if w]
        places = sorted((j, label) for p, label in license_scan.BASE.items() for j in range(len(words)) if words[j : j + len(p.split())] == p.split())
        r = got[i]
        assert (r["n_words"], r["n_base"]) == (len(words), len(places))
        assert (r["first_word"], r["last_word"]) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert r["base_labels"] == ",".join(sorted({p for _, p in places}))
        assert set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1
    n = len(rows)
    assert got[n - 4]["labels"] == "mit" and got[n - 4]["score"] == 1
    assert "apache" in got[n - 3]["labels"] and got[n - 3]["spans"][0]["edits"] == 1
    assert got[n - 1]["labels"] == ""
    assert license_scan.scan(empty).collect() == []


def test_seeds_miss_no_fuzzy_match():
    import regex

    dice, scanner = random.Random(5), license_scan.Scanner()
    for notice in license_scan.NOTICES:
        k = license_scan.edits_allowed(notice)
        for _ in range(20):
            t = list(notice)
            for _ in range(dice.randint(0, k)):
                at = dice.randrange(1, len(t) - 1)
                dice.choice([lambda: t.pop(at), lambda: t.insert(at, "q"), lambda: t.__setitem__(at, "q")])()
            folded = f" aaa {''.join(t)} bbb "
            if regex.search(rf"(?b) (?:{regex.escape(notice, special_only=True)}){{e<={k}}} ", folded):
                assert scanner.spans(folded), (notice, folded)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("under the mit licenses", [("mit", 1)]),
        ("gnu lesser general public licenses", [("lgpl", 1)]),
        ("sublicensed under the apache license", [("apache", 3)]),
        ("xgnu lesser general public licenses", [("lgpl", 2)]),
        ("undr the mit license under the mit license", [("mit", 1), ("mit", 0)]),
        ("under the mit license undr the mit license under the mit licenses", [("mit", 0), ("mit", 1), ("mit", 1)]),
        ("commit license under the summit license", []),
        ("resublicensed under the apache licenses", []),
    ],
)
def test_notices_edited_at_their_ends_and_close_together(text, want):
    got = sorted(license_scan.Scanner().spans(f" {text} "), key=lambda x: x[1])
    assert [(license_scan.NOTICES[n], e) for n, _, _, e in got] == want
    for _, a, b, _ in got:
        assert f" {text} "[a - 1] == " " == f" {text} "[b]


def test_spans_are_the_nearest_runs_of_words():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
        return row[-1]

    dice, scanner = random.Random(6), license_scan.Scanner()
    for notice in license_scan.NOTICES:
        k = license_scan.edits_allowed(notice)
        for _ in range(15):
            t = list(notice)
            for _ in range(dice.randint(0, k + 1)):
                at = dice.randrange(len(t) + 1)
                t[at : at + dice.randint(0, 1)] = dice.choice(["", "q", "s"])
            words = f"aa {''.join(t)} bb".split()
            folded = f" {' '.join(words)} "
            ends = [i for i, c in enumerate(folded) if c == " "]
            best = min(distance(notice, folded[a + 1 : b]) for a in ends for b in ends if a < b)
            got = [e for n, _, _, e in scanner.spans(folded) if n == notice]
            nearer = [e for n, _, _, e in scanner.spans(folded) if n != notice and e < best]
            assert nearer or got == ([best] if best <= k else []), (notice, folded)


def test_many_notices_in_one_text():
    import time

    scanner, took = license_scan.Scanner(), []
    for many in (2000, 16_000):
        words = " ".join(f"undr the mit license w{i} under the mit license" for i in range(many))
        began = time.process_time()
        spans = scanner.spans(f" {words} ")
        took.append(time.process_time() - began)
        assert [e for _, _, _, e in sorted(spans, key=lambda x: x[1])] == [1, 0] * many
    assert took[1] < 24 * took[0]  # 8 in proportion, 64 with the square


# -- 2 ------------------------------------------------------------------------


def test_byte_bpe(docs, rows, empty):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BYTE_BPE, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = by_id(byte_bpe.encode(docs, BYTE_BPE, public_tokenizers.PATTERN))
    short = by_id(byte_bpe.encode(docs, BYTE_BPE, public_tokenizers.PATTERN, digest=True))
    back = by_id(byte_bpe.decode(byte_bpe.encode(docs, BYTE_BPE, public_tokenizers.PATTERN), BYTE_BPE, public_tokenizers.PATTERN))
    for i, t in data(rows):
        ids = np.array(library.encode_ordinary(t.decode()), "<u4").tobytes()
        assert got[i]["ids"] == ids and got[i]["decoded"] == t == back[i]["decoded"]
        assert (short[i]["n_tokens"], short[i]["ids_sha256"], short[i]["decoded_sha256"]) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(t).hexdigest())
    assert byte_bpe.encode(empty, BYTE_BPE, public_tokenizers.PATTERN).collect() == []


def test_white_space_and_odd_characters_split_alike():
    import tiktoken

    coder, dice = byte_bpe.Encoder(BYTE_BPE, public_tokenizers.PATTERN), random.Random(1)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})
    texts = ["".join(dice.choice(" \n\t ab'sé　\x1c\x85.1²×日") for _ in range(30)) for _ in range(800)] + ["q" * 3000, "<|endoftext|>"]
    for t, ids in zip(texts, coder.encode([t.encode() for t in texts]), strict=True):
        assert ids.tolist() == library.encode_ordinary(t), t
    whole = b"unbelievable"
    assert byte_bpe.merge(whole, coder.ranks) == library.encode_ordinary(whole.decode())


def test_higher_order_functions_merge_alike(spark):
    ranks = byte_bpe.read_ranks(BYTE_BPE)
    words = ["the", " hello", "thndwhble", "é", "日本", "a", "x1"]
    df = spark.createDataFrame([(w,) for w in words * 2], "word string")
    coded = byte_bpe.encode_words(df, ranks)
    assert {r["word"]: list(r["ids"]) for r in coded.collect()} == {w: byte_bpe.merge(w.encode(), ranks) for w in words}
    assert {r["word"]: bytes(r["decoded"]) for r in byte_bpe.decode_words(coded, ranks).collect()} == {w: w.encode() for w in words}


# -- 3 and the word tokenizer -------------------------------------------------------


def library_ids(rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORD_BPE)
    t.encode_special_tokens = True
    return {i: t.encode(x.decode(), add_special_tokens=False).ids for i, x in data(rows)}


def test_word_tokenizer():
    texts = ["İstanbul ΣΑΣ x\u0085y", "H̱ Å K", "<|endoftext|>foo", "it's we'll DON'T 3.14", "½²ª ẞ straße ﬁ", "a" * 500, "", "ÀÉ×÷ ñ b"]
    want = library_ids(list(enumerate(texts)))
    for i, ids in enumerate(word_bpe.WordEncoder(WORD_BPE).encode([t.encode() for t in texts])):
        assert ids.tolist() == want[i]


def test_wavelet(docs, rows, empty):
    files = wavelet.write(docs, WORD_BPE)
    want, start = library_ids(rows), 0
    got, full = by_id(wavelet.digest(files)), by_id(wavelet.read(files))
    for i, _ in rows:
        ids = np.array([*want[i], 1], "<u4").tobytes()
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids) // 4, zlib.crc32(ids))
        assert full[i]["ids"] == ids
        start += len(ids) // 4
    assert wavelet.digest(wavelet.write(empty, WORD_BPE)).collect() == []


@pytest.mark.parametrize("largest", [wavelet.LARGEST, 500])
def test_questions_to_wavelet_shards(docs, rows, largest):
    files = wavelet.write(docs, WORD_BPE, shards=3, largest=largest)
    ids = library_ids(rows)
    whole, where = [], []
    for i, _ in rows:
        where += [(i, k) for k in range(len(ids[i]) + 1)]
        whole += [*ids[i], 1]
    asked = [*range(0, len(whole), 97), len(whole) - 1, len(whole), -1]
    assert {r["place"]: r["token"] for r in wavelet.access(files, asked).collect()} == {at: whole[at] for at in asked if 0 <= at < len(whole)}
    for token in (1, whole[5], collections.Counter(whole).most_common(2)[1][0], 48_000):
        places = [at for at, t in enumerate(whole) if t == token]
        got = sorted(wavelet.occurrences(files, token).collect(), key=lambda r: r["place"])
        assert [r["place"] for r in got] == places and [(r["doc_id"], r["offset"]) for r in got] == [where[at] for at in places]
        assert wavelet.count(files, token).first()["n"] == len(places)
        for until in (0, 100, len(whole) // 2):
            assert wavelet.count(files, token, until).first()["n"] == sum(at < until for at in places)


@pytest.mark.parametrize("n,alphabet", [(0, 1), (1, 1), (64, 1), (1000, 7), (4097, 300)])
def test_wavelet_matrix(n, alphabet):
    ids = np.random.default_rng(n).integers(0, alphabet, n).astype(np.uint32) * 3
    m = wavelet.WaveletMatrix.from_bytes(wavelet.WaveletMatrix.build(ids).to_bytes())
    assert (m.tokens() == ids).all()
    for at in range(0, n, 37):
        assert m.access(at) == ids[at]
    for token in {0, 3, 2, int(ids[n // 2]) if n else 0}:
        assert m.occurrences(token).tolist() == np.flatnonzero(ids == token).tolist()
        assert m.count(token) == (ids == token).sum() and m.count(token, n // 2) == (ids[: n // 2] == token).sum()


# -- 4 and 9 --------------------------------------------------------------------


def removed_bytes(rows, length):
    seen = collections.Counter(t[i : i + length] for _, t in rows for i in range(len(t) - length + 1))
    for d, t in rows:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        yield d, (len(t), sum(gone), sum(g and not p for g, p in zip(gone, b"\0" + gone, strict=False)), hashlib.sha256(kept).hexdigest())


@pytest.mark.parametrize("options", [{"length": 400}, {"length": 60, "gram": 20}, {"length": 60, "gram": 20, "hot": 1}])
def test_log_suffix_arrays(docs, rows, empty, options):
    got = by_id(log_suffix.digest(docs, **options))
    for d, want in removed_bytes(data(rows), options["length"]):
        assert tuple(got[d])[1:] == want, d
    assert log_suffix.digest(empty, **options).collect() == []


def test_logarithmic_index():
    dice = np.random.default_rng(1)
    index, before = log_suffix.LogarithmicIndex(), collections.Counter()
    for n in range(40):
        keys = dice.integers(0, 3000, 100).astype(np.uint64)
        places = np.stack([np.full(100, n), np.zeros(100, int), np.arange(100)], axis=1)
        flags, older = index.add(keys, places)
        now = collections.Counter(keys.tolist())
        assert flags.tolist() == [before[k] + now[k] > 1 for k in keys.tolist()]
        assert len(older) == sum(before[k] == 1 for k in now)
        before += now
    sizes = [len(x.keys).bit_length() for x in index.levels]
    assert sizes == sorted(set(sizes), reverse=True)


def test_family_of_three_batches_over_two_calls(spark, rows, tmp_path):
    """Each batch meets what was added before, also by another object."""
    size, dice = {"length": 60, "gram": 20}, random.Random(2)
    deal = [dice.randrange(3) for _ in rows]
    batches = [[r for r, k in zip(rows, deal, strict=True) if k == n] for n in range(3)]
    family, added = log_suffix.Family(spark, str(tmp_path / "family"), **size), []
    for n, batch in enumerate(batches):
        if n == 2:
            family = log_suffix.Family(spark, str(tmp_path / "family"), **size)
        before = {d: w for d, w in removed_bytes(data(added), 60)}
        added = added + batch
        want = {d: w for d, w in removed_bytes(data(added), 60)}
        got = by_id(family.add(spark.createDataFrame(batch, "doc_id long, text string")))
        got = {d: (r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for d, r in got.items()}
        assert {d for d, _ in batch} | {d for d in before if before[d] != want[d]} <= set(got)
        assert all(got[d] == want[d] for d in got)
        assert {d: r["n_removed"] for d, r in by_id(family.documents()).items()} == {d: w[1] for d, w in want.items()}
        sizes = [n.bit_length() for _, n in family.levels]
        assert sizes == sorted(set(sizes), reverse=True)
    assert log_suffix.Family(spark, str(tmp_path / "none"), **size).add(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def kept_words(rows, length):
    first = {}
    for d, t in rows:
        w = t.split()
        for i in range(len(w) - length + 1):
            first.setdefault(tuple(w[i : i + length]), (d, i))
    for d, t in rows:
        w = t.split()
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if first[tuple(w[i : i + length])] < (d, i):
                gone[i : i + length] = [True] * length
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        yield d, (len(w), sum(gone), hashlib.sha256(kept).hexdigest())


@pytest.mark.parametrize("options", [{"length": 20}, {"length": 8, "gram": 3}, {"length": 8, "gram": 3, "hot": 1}])
def test_suffix_trees(docs, rows, empty, options):
    got = by_id(suffix_tree.digest(docs, **options))
    for d, want in kept_words(data(rows), options["length"]):
        assert tuple(got[d])[1:] == want, d
    assert suffix_tree.digest(empty, **options).collect() == []


def test_repeats_across_batches(spark, docs, rows):
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        got = by_id(suffix_tree.digest(docs, length=8, gram=3))
        for d, want in kept_words(data(rows), 8):
            assert tuple(got[d])[1:] == want, d
        got = by_id(log_suffix.digest(docs, length=60, gram=20))
        for d, want in removed_bytes(data(rows), 60):
            assert tuple(got[d])[1:] == want, d
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


@pytest.mark.parametrize("batch", ["10000", "7"])
def test_hot_passages_are_settled_in_parts(spark, monkeypatch, batch):
    """A passage of many texts, within others that differ: equal to brute force, and a
    part leaves one row (two for bytes) of a window to be compared with other parts."""
    dice, passage = random.Random(4), " ".join(f"p{i}" for i in range(30))
    rows = [(d, " ".join(f"x{dice.randrange(10**6)}" for _ in range(dice.randrange(9))) + f" {passage} " + " ".join(f"y{dice.randrange(10**6)}" for _ in range(dice.randrange(9)))) for d in range(200)]
    docs, first, save = spark.createDataFrame(rows, "doc_id long, text string").repartition(5), [], repeats.saved
    monkeypatch.setattr(repeats, "saved", lambda df, name: first.append(save(df, name)) or first[-1] if name == "first" else save(df, name))
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = by_id(suffix_tree.digest(docs, hot=3))
        assert all(tuple(got[d])[1:] == want for d, want in kept_words(data(rows), 20))
        got = by_id(log_suffix.digest(docs, length=60, gram=20, hot=3))
        assert all(tuple(got[d])[1:] == want for d, want in removed_bytes(data(rows), 60))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    for df in first:
        left = df.filter("slice is not null")
        assert 0 < left.count() and left.groupBy("g", "band").count().agg({"count": "max"}).first()[0] < 150


def test_keys_of_hot_groups_hold_all_that_their_windows_share():
    dice = np.random.default_rng(3)
    x = dice.integers(0, 2**64, 400, dtype=np.uint64)
    x[200:230] = x[100:130]  # windows equal, and their surroundings not
    for offset in range(0, 16):
        least = offset // 4 * 4
        key = [repeats.common_key(x, at + offset, least, 4, 20, 5) for at in (105, 205, 305)]
        assert key[0] == key[1] != key[2]
    assert repeats.ranks(np.array([5, 3, 5, 5, 3], np.uint64)).tolist() == [0, 0, 1, 2, 1]
    assert repeats.ranks(np.zeros(0, np.uint64)).tolist() == []


def test_repeated_rows_and_null_ids(spark):
    text = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(1, text), (1, text), (2, text), (None, "w1 w2")], "doc_id long, text string")
    assert sorted(r["n_removed"] for r in suffix_tree.digest(df).collect()) == [0, 0, 0, 30]
    df = spark.createDataFrame([(1, "z" * 10 + "y" * 399), (1, "z" * 10 + "y" * 399), (None, "a")], "doc_id long, text string")
    assert sorted(r["n_removed"] for r in log_suffix.digest(df).collect()) == [0, 409, 409]


# -- 5 ------------------------------------------------------------------------------


def groups(keys, near):
    root = {k: k for k in keys}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in keys:
        for b in keys:
            if a < b and near(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


def signed_bits(t, size):
    words = t.lower().split()
    shingles = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("hot", [256, 1])
def test_simhash(docs, rows, empty, hot):
    fp = {i: signed_bits(t, 3) for i, t in data(rows)}
    want = groups(list(fp), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 2)
    got = by_id(simhash.near_duplicates(docs, hot=hot))
    assert {i: (r["fingerprint"], r["component_id"]) for i, r in got.items()} == {i: (f"{fp[i]:016x}", want[i]) for i in fp}
    assert simhash.near_duplicates(empty).collect() == []


def test_close_fingerprints_link(spark):
    dice = random.Random(9)
    base = dice.getrandbits(63)
    fps = [base ^ (1 << dice.randrange(63)) ^ (1 << dice.randrange(63)) for _ in range(40)] + [dice.getrandbits(63) for _ in range(40)]
    fps = list(dict.fromkeys(fps))
    nodes = spark.createDataFrame([(f, i) for i, f in enumerate(fps)], "fp long, node long")
    want = groups(range(len(fps)), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)
    for hot in (1, 10, 1000):
        found = {r["node"]: r["root"] for r in components.components(simhash.links(nodes, 2, hot)).collect()}
        assert {i: found.get(i, i) for i in range(len(fps))} == want


def test_similar_finds_near_copies_and_no_others(docs, rows):
    sets = {i: frozenset(simhash.shingle_hashes(t, 5).tolist()) for i, t in data(rows)}
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar(docs).collect()}
    for a in sets:
        for b in sets:
            if a < b:
                j = len(sets[a] & sets[b]) / len(sets[a] | sets[b]) if sets[a] | sets[b] else 1
                if j >= 0.9:
                    assert got[a] == got[b], (a, b, j)
                if j <= 0.5:
                    assert got[a] != got[b], (a, b, j)
    for many in (4,):  # buckets in parts and in tiles
        assert {r["doc_id"]: r["component_id"] for r in simhash.similar(docs, many=many).collect()} == got
    kept = [r["doc_id"] for r in simhash.representatives(docs).collect()]
    assert sorted(kept) == sorted(set(got.values()))


def test_similar_finds_every_pair_from_the_threshold_on(spark):
    dice, rows = random.Random(21), []
    for i in range(60):
        base = [f"w{dice.randrange(10**6)}" for _ in range(304)]
        for k, many in enumerate((0, 6, 8)):  # words edited: similarity 1, about 0.82, about 0.76
            t = list(base)
            for at in dice.sample(range(5, 295, 12), many):
                t[at] = f"x{dice.randrange(10**6)}"
            rows.append((3 * i + k, " ".join(t)))
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for base in range(0, len(rows), 3):
        sets = [set(simhash.shingle_hashes(rows[base + k][1].encode(), 5).tolist()) for k in (0, 1, 2)]
        js = [len(sets[0] & x) / len(sets[0] | x) for x in sets[1:]]
        assert 0.8 <= js[0] < 0.83 and 0.7 < js[1] < 0.8
        assert got[base + 1] == got[base] and got[base + 2] == base + 2


def test_pairs_leaders_and_nearest_rows_of_a_bucket():
    dice = np.random.default_rng(4)
    base = dice.integers(0, 2**63, (3, simhash.SKETCH), dtype=np.uint64)
    rows = base[dice.integers(0, 3, 300)] ^ (np.uint64(1) << dice.integers(0, 64, (300, simhash.SKETCH), dtype=np.uint64))
    limit = simhash.far_bits(0.8)
    assert limit == 64
    far = np.bitwise_count(rows[:, None] ^ rows[None]).sum(2)
    near = {(x, y) for x in range(300) for y in range(x + 1, 300) if far[x, y] <= limit}
    want = groups(range(300), lambda a, b: far[a, b] <= limit)

    def same(found):
        return {tuple(sorted(x)) for x in zip(*(c.tolist() for c in found), strict=True)}

    assert same(simhash.all_pairs(rows, np.array([0, 4, 6, 300]), limit)) == {(x, y) for x, y in near if (x < 4) == (y < 4) and (x < 6) == (y < 6)}
    for times in (1, 3):  # a bucket that fits a matrix, and a larger one
        many = np.tile(rows, (times, 1))
        for order in (np.arange(300 * times), dice.permutation(300 * times)):
            linked = {(x % 300, y % 300) for x, y in zip(*(c.tolist() for c in simhash.leaders(many, order, limit)), strict=True)}
            assert all(x == y or (min(x, y), max(x, y)) in near for x, y in linked)
            assert groups(range(300), lambda x, y: (x, y) in linked or (y, x) in linked) == want
    root = np.arange(300) // 3
    got = same(simhash.nearest_of_groups(rows, root, limit))
    best = {}
    for x, y in near:
        if root[x] != root[y]:
            pair = (min(root[x], root[y]), max(root[x], root[y]))
            best[pair] = min(best.get(pair, 999), far[x, y])
    assert len(got) == len(best) and all(far[x, y] == best[min(root[x], root[y]), max(root[x], root[y])] for x, y in got)


def test_keys_widen_with_the_number_of_texts():
    small = simhash.block_bits(1000)
    assert small.shape == (96, 16) and sorted(small.ravel().tolist()) == list(range(1536))
    large = simhash.block_bits(1 << 32)
    assert large.shape[1] == 24 and all(len(set(x)) == 24 for x in large.tolist())
    for bits in (small, large):
        assert (1 - simhash.agreement(0.8) ** bits.shape[1]) ** len(bits) <= 0.001


def test_a_large_group_of_near_copies_is_found_whole(spark):
    dice, rows = random.Random(3), []
    base = [f"w{dice.randrange(10**6)}" for _ in range(400)]
    for i in range(400):  # pairs are about 0.8 alike: some links are there and some aren't
        t = list(base)
        for at in dice.sample(range(5, 395, 12), 4 + i % 3):
            t[at] = f"x{dice.randrange(10**6)}"
        rows.append((i, " ".join(t)))
    sets = [set(simhash.shingle_hashes(t.encode(), 5).tolist()) for _, t in rows]
    want = groups(range(400), lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for many in (100, 4096):
        assert {r["doc_id"]: r["component_id"] for r in simhash.similar(df, many=many).collect()} == want


def test_no_pair_is_lost_in_a_crowd_that_is_nearly_alike(spark):
    # 150 texts that are about 0.72 alike each have a twin about 0.83 alike: in their many
    # common buckets the leader is another text, too far from either
    dice, rows = random.Random(6), []
    base = [f"w{dice.randrange(10**6)}" for _ in range(304)]
    for i in range(150):
        t = list(base)
        for at in dice.sample(range(5, 295, 12), 5):
            t[at] = f"x{dice.randrange(10**6)}"
        rows.append((2 * i, " ".join(t)))
        for at in dice.sample([x for x in range(5, 295, 12) if t[x] == base[x]], 5):
            t[at] = f"x{dice.randrange(10**6)}"
        rows.append((2 * i + 1, " ".join(t)))
    sets = [set(simhash.shingle_hashes(t.encode(), 5).tolist()) for _, t in rows]
    want = groups(range(300), lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8)
    assert len(set(want.values())) > 100
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for many in (16, 4096):  # members of prefixes that too many share, and none
        assert {r["doc_id"]: r["component_id"] for r in simhash.similar(df, many=many).collect()} == want


def test_sets_that_are_alike_meet_in_their_prefixes():
    dice = np.random.default_rng(12)
    sets = []
    for _ in range(60):
        base = np.unique(dice.integers(0, 2**64, int(dice.integers(1, 60)), dtype=np.uint64))
        for edits in (0, 1, 2, 6):
            sets.append(np.unique(np.concatenate([base[edits:], dice.integers(0, 2**64, int(dice.integers(0, edits + 1)), dtype=np.uint64)])))
    sets = [h for h in sets if len(h)]
    alike = {(x, y) for x in range(len(sets)) for y in range(x + 1, len(sets)) if simhash.jaccard(sets[x], sets[y]) >= 0.8}
    assert any(simhash.jaccard(sets[x], sets[y]) == 0.8 for x, y in alike)
    every = np.unique(np.concatenate(sets))
    for common in (every[:0], every[::2], every):
        rank = dice.permutation(len(common))
        rows = sorted((int(k), len(h), p, i) for i, h in enumerate(sets) for p, k in enumerate(simhash.prefix(h, 0.8, common, rank)))
        key, n, at, row = (np.array(c) for c in zip(*rows, strict=True))
        bucket = np.unique(key.astype(np.uint64), return_inverse=True)[1]
        for own in (np.ones(len(row), bool), row % 2 == 0):
            x, y = simhash.crossing(bucket, n, at, row, own, 0.8)
            met = {(min(i, j), max(i, j)) for i, j in zip(row[x].tolist(), row[y].tolist(), strict=True)}
            assert {(x, y) for x, y in alike if own.all() or x % 2 == 0 or y % 2 == 0} <= met
        assert not len(simhash.crossing(bucket, n, at, row * 0, own, 0.8)[0])
    widths = {len(simhash.parity(h)) for h in sets}
    assert len(widths) > 1
    for x in range(0, len(sets), 3):
        for y in range(len(sets)):
            assert simhash.apart(simhash.parity(sets[x]), simhash.parity(sets[y])) <= len(np.setxor1d(sets[x], sets[y]))


def test_representatives_keep_a_row_of_each_group_whatever_the_ids(spark):
    dice = random.Random(8)
    texts = [" ".join(f"w{dice.randrange(10**6)}" for _ in range(60)) for _ in range(30)]
    rows = [(None, t) for t in texts[:12]] + [(7, t) for t in texts[12:20]] + list(enumerate(texts[20:], 100))
    rows += [(None, texts[0]), (7, texts[12]), (7, texts[12]), (500, texts[13]), (None, texts[21]), (None, None), (None, ""), (3, " ")]
    kept = simhash.representatives(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert kept.columns == ["doc_id", "text"]
    want = [(None, t) for t in texts[:12]] + [(7, t) for t in texts[12:20]] + [(100 + i, t) for i, t in enumerate(texts[20:]) if i != 1] + [(None, texts[21])]
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert sorted((x for x in got if (x[1] or "").strip()), key=str) == sorted(want, key=str)
    assert [i for i, t in got if not (t or "").strip()] == [None]


def test_components_of_a_chain(spark):
    edges = spark.range(1, 60).selectExpr("id AS a", "id - 1 AS b")
    assert {r["root"] for r in components.components(edges).collect()} == {0}
    assert components.components(edges.limit(0)).collect() == []


# -- 6 ----------------------------------------------------------------------------------


def test_packing(docs, rows, empty):
    ids = {i: [*x, 0] for i, x in library_ids(rows).items()}
    for capacity in (2048, 64):
        got = packing.pack(docs, WORD_BPE, capacity=capacity).collect()
        want = {(i, k // capacity): x[k : k + capacity] for i, x in ids.items() for k in range(0, len(x), capacity)}
        assert len(got) == len(want)
        bins = collections.defaultdict(list)
        for r in got:
            part = want[r["doc_id"], r["piece"]]
            assert (r["start"], r["length"], r["ids_crc32"]) == (r["piece"] * capacity, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
            bins[r["sequence_id"]].append((r["offset"], r["length"]))
        for parts in bins.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= capacity
        assert len(bins) <= -(-sum(map(len, ids.values())) // capacity) * 1.05 + 1
    assert packing.pack(empty, WORD_BPE).collect() == []


def test_search_beats_best_fit_decreasing():
    dice = random.Random(5)
    for least, most in ((300, 1100), (500, 1000)):
        size = [dice.randint(least, most) for _ in range(1000)]
        plain = packing.best_fit(sorted(range(1000), key=lambda i: -size[i]), size, 2048, [], [])
        of = packing.evolve(size, 2048, [], 1, 4, 12)
        fill = collections.Counter()
        for b, s in zip(of, size, strict=True):
            fill[b] += s
        assert max(fill.values()) <= 2048 and -(-sum(size) // 2048) <= len(fill) < len(plain.bins)


def test_repeated_rows_are_dealt_to_all_shards(spark):
    df = spark.createDataFrame([(None, "same text") for _ in range(600)], "doc_id long, text string").repartition(3)
    got = packing.pack(df, WORD_BPE, shard=50).collect()
    assert len(got) == 600 and len({r["sequence_id"] >> 32 for r in got}) > 6
    assert len({(r["sequence_id"], r["offset"]) for r in got}) == 600


def test_crossover_keeps_all_pieces():
    dice = random.Random(2)
    size = [dice.randint(1, 100) for _ in range(200)]
    order = sorted(range(200), key=lambda i: -size[i])
    a = packing.best_fit(order, size, 128, [], [])
    b = packing.best_fit(dice.sample(range(200), 200), size, 128, [], [])
    child = packing.crossover(a, b, size, 128, dice)
    assert sorted(i for x in child.bins for i in x) == list(range(200))
    assert all(sum(size[i] for i in x) + f == 128 for x, f in zip(child.bins, child.free, strict=True))
    of = packing.evolve(size, 128, [], 1, 4, 6)
    assert len(set(of)) <= len(a.bins) and len(of) == 200


# -- 7 --------------------------------------------------------------------------------------


def sketch(t):
    import re

    w = [x.encode() for x in re.split("[ \t-\r]+", t) if x]
    hashes = set()
    for i in range(max(1, len(w) - 4) if w else 0):
        h = 42
        for x in w[i : i + 5]:
            h = xxhash.xxh64_intdigest(x, h)
        hashes.add(h - 2**64 if h >> 63 else h)
    return sorted({x for x in hashes if x < -(2**63) + 2**62} | ({min(hashes)} if hashes else set()))


def digits(hashes):
    return "".join(f"{h % 2**64:016x}" for h in hashes)


def like(a, b):
    return len(set(a) & set(b)) / len(set(a) | set(b)) if a or b else 1.0


@pytest.mark.parametrize("ranges", [None, 1, 7])
def test_fingerprints(docs, rows, empty, ranges, monkeypatch):
    if ranges:
        real = fingerprint.with_next
        monkeypatch.setattr(fingerprint, "with_next", lambda d: real(d, ranges))
    got = by_id(fingerprint.compare_edited(docs))
    texts = [t or "" for _, t in rows]
    for i, t in enumerate(texts):
        after = texts[(i + 1) % len(texts)]
        k = len(t) // 4
        edited = t[: len(t) - k] + after[:k]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r["fingerprint"] == digits(sketch(t)) and r["edited_fingerprint"] == digits(sketch(edited))
        assert r["near_edited"] == pytest.approx(like(sketch(t), sketch(edited))) and r["near_next"] == pytest.approx(like(sketch(t), sketch(after)))
    assert fingerprint.compare_edited(empty).collect() == []


def test_containment_and_merging(spark):
    words = [f"w{i}" for i in range(4000)]
    parts = {"all": words, "some": words[1000:1800], "first": words[:2004], "rest": words[2000:], "none": []}
    df = spark.createDataFrame([tuple(" ".join(p) for p in parts.values())], ", ".join(f"`{n}` string" for n in parts))
    df = df.select(*[fingerprint.sketch(F.col(f"`{n}`")).alias(n) for n in parts])
    r = df.select(fingerprint.containment(F.col("some"), F.col("all")).alias("in"), fingerprint.containment(F.col("all"), F.col("some")).alias("of"), *[fingerprint.merge(F.col(a), F.col(b)).alias(a + b) for a, b in (("first", "rest"), ("all", "some"), ("some", "none"), ("none", "none"))], *[F.col(n) for n in parts]).first()
    assert r["in"] > 0.98 and abs(r["of"] - 0.2) < 0.05
    # first and rest share four words, so every run of five words is in one of them
    assert list(r["allsome"]) == sorted(set(r["all"]) | set(r["some"])) and set(r["all"]) <= set(r["firstrest"])
    assert list(r["firstrest"]) == sorted(set(r["first"]) | set(r["rest"])) and list(r["somenone"]) == list(r["some"]) and list(r["nonenone"]) == []


# -- 8 -----------------------------------------------------------------------------------------


def test_quality(spark):
    dice = random.Random(4)
    words = ["".join(dice.choice("abcdefgh") for _ in range(dice.randint(2, 8))) for _ in range(300)]
    rows = []
    for i in range(400):
        n = dice.randint(20, 60)
        clean = [dice.choice(words) for _ in range(n)]
        bad = [w + dice.choice(["***", "$$$", "%%%"]) for w in clean]
        rows.append((i, " ".join(bad if i % 2 else clean), 1 - i % 2))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(None, None), (1000, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows] + [(None, 1, 0), (5, None, 0), (7, 9, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(docs, labels, epochs=4).collect()
    assert len(got) == 402
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in [*range(400), 1000] if zlib.crc32(str(i).encode()) % 5 == 0}
    own = [r for r in held if r["doc_id"] < 400]
    assert sum(r["predicted"] == 1 - r["doc_id"] % 2 for r in own) >= 0.95 * len(own)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    assert {r["score"] for r in quality.classify(docs.limit(3), labels.limit(0)).collect()} == {0.5}
    assert quality.classify(docs.limit(0), labels.limit(0)).collect() == []


def test_gradient_is_that_of_the_log_loss():
    dice = np.random.default_rng(5)
    text = bytes(dice.integers(97, 123, 40_000).astype(np.uint8))  # several slabs, many chunks
    s = quality.symbols(text)
    for label in (0, 1):
        net = quality.Network()
        grads = [np.zeros_like(w) for w in net.weights()]
        net.gradient(s, label, grads)

        def loss():
            p = net.score(text)
            return -np.log(p if label else 1 - p)

        for w, g in zip(net.weights(), grads, strict=True):
            flat, slope = w.reshape(-1), g.reshape(-1)
            for at in np.argsort(-abs(slope))[:6].tolist():
                old, step = flat[at], 2e-3
                flat[at] = old + step
                up = loss()
                flat[at] = old - step
                down = loss()
                flat[at] = old
                assert (up - down) / (2 * step) == pytest.approx(slope[at], rel=0.1, abs=2e-3)


def test_scores_are_those_of_a_plain_forward_pass():
    net, dice = quality.Network(), np.random.default_rng(6)
    for n in (0, 3, 5, 64, 300, quality.SLAB + 700):
        text = bytes(dice.integers(97, 101, n).astype(np.uint8))
        s = quality.symbols(text)
        z = np.array([sum(net.table[j][s[i + j]] for j in range(quality.WIDTH)) for i in range(len(s) - quality.WIDTH + 1)])
        size, step = quality.BLOCK * quality.CHUNK, quality.BLOCK * quality.STRIDE
        tops = [np.maximum(z[a : a + size].max(0) + net.bias, 0) for a in range(0, max(1, len(z)), step) if a == 0 or a + size - step < len(z)]
        x = np.concatenate([np.mean(tops, 0), np.max(tops, 0)]) @ net.out + net.base[0]
        assert net.score(text) == pytest.approx(1 / (1 + np.exp(-x)), abs=1e-5)


def test_training_takes_whole_texts_within_its_bounds(spark, monkeypatch):
    got = []
    monkeypatch.setattr(quality, "fit", lambda texts, labels, **options: got.append(sorted(zip(texts, labels, strict=True))) or None)
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5]
    long = "long " * 40_000
    docs = spark.createDataFrame([(i, long if i == ids[0] else f"text {i}") for i in ids] + [(ids[1], "other")] * 50, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, quality int")
    for options, some in (({}, len(ids)), ({"sample": 10}, 10), ({"sample_bytes": 1000}, len(ids) - 1)):
        quality.train(docs, labels, **options)
        texts = [t for t, _ in got[-1]]
        assert len(texts) == some and all(t in (long.encode(), b"other") or t.startswith(b"text ") for t in texts)
        assert (long.encode() in texts) == (not options) or "sample" in options


def test_network_sees_the_whole_text():
    net = quality.Network()
    plain, mark = b"a" * 100_000, b"zqzqz"
    assert net.score(plain) != net.score(plain[:-50] + mark + plain[-45:])
    assert net.score(b"") == net.score(b"\0\0")


# -- 10 ---------------------------------------------------------------------------------------------


def test_pairs_of_a_crowd_come_a_few_at_a_time():
    many = 1500
    bucket, n, at, own = np.zeros(many, np.int64), np.full(many, 50), np.zeros(many, np.int64), np.ones(many, bool)
    parts = list(simhash.crossings(bucket, n, at, np.arange(many), own, 0.8, most=1000))
    assert max(len(a) for a, _ in parts) < 1000 + many
    assert len({(x, y) for a, b in parts for x, y in zip(a.tolist(), b.tolist(), strict=True)}) == many * (many - 1) // 2
    assert sum(len(a) for a, _ in parts) == many * (many - 1) // 2


def test_a_task_gives_back_what_others_left_in_its_worker():
    for keep in (True, False):
        word_bpe.word_encoder(WORD_BPE)
        before = word_bpe.word_encoder.cache_info().currsize
        run = common.lean(lambda batches: (2 * x for x in batches), keep)
        assert before and list(run(iter([1, 2]))) == [2, 4]
        assert word_bpe.word_encoder.cache_info().currsize == before * keep


def test_few_tasks_write_a_small_table(spark, tmp_path, monkeypatch):
    """A file costs several processes, so 64 tasks write no 64 files of a few rows."""
    dice = random.Random(2)
    words = [str(i) for i in range(900)]
    texts = [" ".join(dice.choices(words, k=30)) for _ in range(60)]
    texts += [t + " end" for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(common, "shared_dir", lambda _: f"file://{tmp_path}")
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "64")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = {r["doc_id"]: r["component_id"] for r in simhash.similar(df).collect()}
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert got == {i: i % 60 for i in range(120)}
    made = [(p.name.split("-")[0], len(list(p.glob("*.parquet")))) for p in tmp_path.iterdir()]
    assert {"nodes", "pairs", "texts", "links", "groups"} <= {name for name, _ in made}
    assert [x for x in made if x[1] > 1 and x[0] != "simhash"] == []


def test_pivot_index(spark):
    dice = np.random.default_rng(8)
    rows = []
    for label in (1, 2):
        for _ in range(12):
            centre = dice.normal(size=16)
            rows += [(centre + dice.normal(size=16) * 0.03, label) for _ in range(dice.integers(1, 9))]
    same = [1.0] + [0.0] * 15
    rows += [(np.array(same), 1)] * 3 + [(np.array(same) * 2, 1), (np.array(same), None), (np.zeros(16), 1), (np.array([np.nan] * 16), 1), (np.array([np.inf] * 16), 1)]
    table = [(i, [float(v) for v in x], l) for i, (x, l) in enumerate(rows)] + [(900, None, 1), (901, [None] * 16, 1), (902, [1.0, 0.0], 1), (903, [2.0, 0.0], 1)]
    df = spark.createDataFrame(table, "vec_id long, embedding array<double>, label int")

    def fine(x, l):
        return l is not None and x is not None and all(v is not None and np.isfinite(v) for v in x) and any(x)

    ok = {i: (np.array(x), l) for i, x, l in table if fine(x, l)}

    def near(a, b):
        (x, l), (y, m) = ok[a], ok[b]
        return l == m and len(x) == len(y) and float(x @ y) / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= 0.98

    links = {a: sum(a != b and near(a, b) for b in ok) for a in ok}
    want = groups(list(ok), near)
    for most in (512, 2):
        got = {r["vec_id"]: r for r in pivots.near_duplicates(df, most=most).collect()}
        assert len(got) == len(table)
        assert sum(r["n_links"] for r in got.values()) >= 0.9 * sum(links.values())
        for i, r in got.items():
            assert r["n_links"] <= links.get(i, 0) and r["kept"] == (r["component_id"] == i)
            assert want.get(i, i) <= r["component_id"] <= i
    assert got[900]["n_links"] == 0 and got[903]["component_id"] == 902
    assert pivots.near_duplicates(df.limit(0)).collect() == []


def test_pivots_grow_with_the_label_and_stay_apart():
    dice = np.random.default_rng(3)
    loose = pivots._unit(dice.normal(size=(300, 24)))
    dense = pivots._unit(loose[0] + dice.normal(size=(300, 24)) * 0.01)
    refs = pivots.spread(np.concatenate([dense, loose[1:]]), 20, 400, 0.92)
    assert 200 < len(refs) <= 300
    likeness = refs @ refs.T
    np.fill_diagonal(likeness, 0)
    assert likeness.max() < 0.92
    assert len(pivots.spread(dense, 20, 400, 0.92)) == 20
    near = pivots.nearest(loose, refs, 4)
    assert [set(r) for r in near.tolist()] == [set(r) for r in np.argsort(-(loose @ refs.T), axis=1)[:, :4].tolist()]


@pytest.mark.parametrize("options", [{}, {"pivots": 8, "growth": 4.0}, {"depth": 6, "shared": 3}, {"own": 1}, {"most": 16}])
def test_pivot_links_count_once(spark, options):
    dice = np.random.default_rng(4)
    centres = dice.normal(size=(260, 24))
    rows = [(c + dice.normal(size=24) * 0.05, i % 7 > 4) for i, c in enumerate(centres) for _ in range(1 + i % 5)]
    df = spark.createDataFrame([(i, [float(v) for v in x], str(l)) for i, (x, l) in enumerate(rows)], "vec_id long, embedding array<double>, label string")
    unit = pivots._unit(np.array([x for x, _ in rows]))
    label = np.array([l for _, l in rows])
    close = (unit @ unit.T >= 0.98) & (label[:, None] == label[None])
    np.fill_diagonal(close, False)
    got = {r["vec_id"]: r["n_links"] for r in pivots.near_duplicates(df, **options).collect()}
    assert all(got[i] <= c for i, c in enumerate(close.sum(1).tolist()))
    assert close.sum() > 500 and sum(got.values()) >= 0.95 * close.sum()


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.1"])
def test_pivot_recall(spark, folder):
    import os

    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    df = spark.read.parquet(f"{folder}/embeddings.parquet")
    rows = [(r["vec_id"], np.array(r["embedding"], float), r["label"]) for r in df.collect()]
    unit = np.stack([x / np.linalg.norm(x) for _, x, _ in rows])
    label = np.array([l for *_, l in rows])
    close = (unit @ unit.T >= 0.98) & (label[:, None] == label[None])
    np.fill_diagonal(close, False)
    got = {r["vec_id"]: r["n_links"] for r in pivots.near_duplicates(df).collect()}
    assert sum(got.values()) >= 0.9 * close.sum()
    assert all(got[i] <= c for (i, *_), c in zip(rows, close.sum(1).tolist(), strict=True))
