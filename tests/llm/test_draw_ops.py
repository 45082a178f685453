"""Merkle manifest, minimum-bin-slack packing and importance resampling against brute force, with odd inputs."""

import collections
import hashlib
import itertools
import math
import pickle
import random
import re
import string
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrarow.llm import merkle, numbering, resample, slack_pack

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, tree string, leaf string, nth string, at string, part string, key string"
ODD = [None, "", " \n\t ", "a", "One TWO three four", "é ü Ñ 漢字 \U0001f600", "x" * 5000, "Word " * 3000, "\x00\x1c odd   text", "<|endoftext|> a"]


def frame(spark, rows):
    """Documents of (doc_id, text, lang), with clashing extra columns."""
    return spark.createDataFrame([(i, t, lang, "s" if i else None, None if t is None else len(t), *"tlnapk") for i, t, lang in rows], SCHEMA)


def odd_rows():
    rows = [(i, t, (None, "en", "", "zz", "é")[i % 5]) for i, t in enumerate(ODD * 3)]
    return rows + rows[:4] + [(None, "no id", "en"), (None, None, None), (3, "other Text", "zz"), (7, "A lone one", "solo")]


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# numbers of rows


def test_numbers_within_a_hot_group(spark):
    rows = spark.range(4000).select((F.col("id") % 7 != 0).alias("g"), (F.col("id") * 37 % 11).alias("v"), "id")
    got = numbering.numbered(rows, ["g"], [F.desc("v"), "id"], "test").orderBy("g", "nth").collect()
    want = sorted(((i % 7 != 0, -(i * 37 % 11), i) for i in range(4000)))
    assert [(r.g, -r.v, r.id) for r in got] == want
    n = collections.Counter(r.g for r in got)
    assert all(r.of == n[r.g] for r in got) and [r.nth for r in got] == [*range(n[False]), *range(n[True])]


# Merkle manifest


def plain_tree(leaves):
    """Root, and for each leaf the list of its runs' (others on the left, on the right)."""
    paths, level, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        for p, i in zip(paths, at):
            run = i // 8 * 8
            p.append((level[run:i], level[i + 1 : run + 8]))
        level = [H(*level[i : i + 8]) for i in range(0, len(level), 8)]
        at = [i // 8 for i in at]
    return level[0], paths


def plain_manifest(rows):
    """The rows of op11 for dicts of documents."""
    cell = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    of_doc = lambda d, text: H(*map(cell, (d["doc_id"], d["source"], d["lang"], d["n_chars"], text)))
    lower = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
    trees = collections.defaultdict(list)
    for d in rows:
        leaf = of_doc(d, d["text"])
        hit = d["doc_id"] is not None and zlib.crc32(str(d["doc_id"]).encode()) % 3 == 0 and d["text"] is not None
        trees[d["lang"]].append((d["doc_id"], leaf, of_doc(d, d["text"].translate(lower)) if hit else leaf))
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    made = {}
    for lang in langs:
        own = sorted(trees[lang], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        made[lang] = own, *plain_tree([x[1] for x in own])
    root, tops = plain_tree([made[x][1] for x in langs])
    out = []
    for lang, top in zip(langs, tops):
        own, sub, paths = made[lang]
        for (doc_id, leaf, given), path in zip(own, paths):
            h = given
            for left, right in path + top:
                h = H(*left, h, *right)
            out.append((doc_id, leaf, sub, root, H(*(x for run in path + top for side in run for x in side)), h, h == root))
    return sorted(out, key=str)


def op11(df, level=None):
    rows = merkle.manifest(merkle.document_leaves(df), ["doc_id"], level)
    return rows.withColumn("folded_root", merkle.folded(F.coalesce("tampered", "leaf"), F.col("proof"))).select("doc_id", "leaf", "subroot", "root", merkle.siblings(F.col("proof")).alias("proof"), "folded_root", (F.col("folded_root") == F.col("root")).alias("ok"))


@pytest.mark.parametrize("level", [None, 1, 2])
def test_manifest_against_brute_force(spark, level):
    df = frame(spark, odd_rows() + [(100 + i, f"Text {i}", "en") for i in range(150)])
    got = sorted((tuple(r) for r in op11(df, level).collect()), key=str)
    want = plain_manifest([r.asDict() for r in df.collect()])
    assert got == want
    assert {x[-1] for x in want} == {True, False}


@pytest.mark.parametrize("n", [1, 8, 9, 64, 65])
def test_manifest_of_one_tree(spark, n):
    df = frame(spark, [(i, f"T{i}", "en") for i in range(n)])
    assert sorted((tuple(r) for r in op11(df, 1).collect()), key=str) == plain_manifest([r.asDict() for r in df.collect()])


def test_manifest_of_many_groups_and_of_none(spark):
    df = frame(spark, [(i, "t", f"l{i % 90}") for i in range(200)])
    assert sorted((tuple(r) for r in op11(df, 1).collect()), key=str) == plain_manifest([r.asDict() for r in df.collect()])
    assert op11(frame(spark, [])).collect() == []


def test_forests_are_a_monoid():
    r = random.Random(4)
    sizes = {"a": 700, "b": 65, "c": 9}
    leaves = [(t, n, i, H(t, str(i))) for t, n in sizes.items() for i in range(n)]
    whole = merkle.Forest(2)
    for t, n, i, h in leaves:
        whole.add(t, n, 0, i, h)
    assert not whole.open
    for t, n in sizes.items():
        top = max(at for tree, at, _ in whole.kept if tree == t)
        assert whole.kept[t, top, 0] == plain_tree([H(t, str(i)) for i in range(n)])[0]
    for _ in range(5):
        r.shuffle(leaves)
        parts = [merkle.Forest(2) for _ in range(7)]
        for k, (t, n, i, h) in enumerate(leaves):
            parts[k % 7].add(t, n, 0, i, h)
        while len(parts) > 1:  # any bracketing
            i = r.randrange(len(parts) - 1)
            parts[i : i + 2] = [pickle.loads(pickle.dumps(parts[i])).merge(pickle.loads(pickle.dumps(parts[i + 1])))]
        assert parts[0].kept == whole.kept and not parts[0].open


def test_forest_of_a_contiguous_run_is_small():
    forest = merkle.Forest(9)
    for i in range(3, 50_000):
        forest.add("t", 10**9, 0, i, "0" * 64)
    assert sum(map(len, forest.open.values())) <= 14 * 6


def test_chunks_stay_bounded():
    for n in (1, 10**6, 10**9, 10**12):
        level = merkle.chunk_level(n)
        assert n / 8**level <= merkle.CHUNKS and (level == merkle.LEAST_LEVEL or n / 8 ** (level - 1) > merkle.CHUNKS)


# packing


def test_byte_tokenizer_equals_the_model():
    tok = slack_pack.ByteTokenizer(slack_pack.default_vocabulary())
    r = random.Random(2)
    alphabet = ["a", "B", "é", "1", ".", ",", "'", "'t", " ", " ", "\n", "\t", "\r", "漢", " ", "<|endoftext|>", "  ", "\x1c", "\U0001f600", "é"]
    texts = [t or "" for t in ODD] + ["".join(r.choices(alphabet, k=r.randint(0, 14))) for _ in range(3000)] + ["a b\nc\n\nd \n e  f\n", "\n a", "a\n"]
    for text in texts * 2:
        assert np.frombuffer(tok.encode(text), tok.dtype).tolist() == tok.model.encode(text, add_special_tokens=False).ids, text


def test_remembered_words_are_bounded(monkeypatch):
    monkeypatch.setattr(slack_pack, "MAX_CACHE", 50)
    tok = slack_pack.ByteTokenizer(slack_pack.default_vocabulary())
    for i in range(300):
        text = " ".join(f"w{j}" for j in range(i, i + 20))
        assert np.frombuffer(tok.encode(text), tok.dtype).tolist() == tok.model.encode(text, add_special_tokens=False).ids
        assert len(tok.known) <= 50 + 20 and len(tok.known.old) <= 50 + 20


def test_fullest_combination_against_all():
    r = random.Random(3)
    for _ in range(200):
        room = r.randint(0, 30)
        counts = np.zeros(32, np.int64)
        for _ in range(r.randint(0, 7)):
            counts[r.randint(1, 31)] += 1
        items = [i for i, n in enumerate(counts.tolist()) for _ in range(n)]
        best = max(s for k in range(len(items) + 1) for c in itertools.combinations(items, k) if (s := sum(c)) <= room)
        found = slack_pack.fullest(counts, room)
        assert sum(i * n for i, n in found.items()) == best and all(n <= counts[i] for i, n in found.items())


def test_plan_places_every_piece_once_in_few_bins():
    r = np.random.default_rng(5)
    for scale in (1, 50, 10**6):
        counts = np.zeros(129, np.int64)
        counts[1:] = r.integers(0, 4, 128) * scale
        bins_of = slack_pack.plan(counts, 128)
        again, total = np.zeros_like(counts), 0
        for bins, lengths in bins_of:
            assert sum(i * n for i, n in lengths.items()) <= 128
            total += bins
            for i, n in lengths.items():
                again[i] += bins * n
        assert (again == counts).all() and len(bins_of) < 2000
        assert total <= math.ceil((np.arange(129) * counts).sum() / 128) * 1.06 + 1
    places = slack_pack.Places(slack_pack.plan(np.array([0, 3, 0, 5, 2]), 4))
    spans = collections.defaultdict(list)
    for length, n in ((1, 3), (3, 5), (4, 2)):
        for s, o in zip(*places.find(np.full(n, length), np.arange(n))):
            spans[s].append((o, length))
    for own in spans.values():
        assert [o for o, _ in sorted(own)] == [0, *np.cumsum([x for _, x in sorted(own)])][:-1]
    assert sorted(spans) == list(range(places.sequences))


def test_packed_sequences_are_whole(spark):
    df = frame(spark, odd_rows() + [(100 + i, "some words here " * (i % 90), None) for i in range(300)]).repartition(5)
    tok = slack_pack.tokenizer(slack_pack.default_vocabulary())
    packed = slack_pack.pack(df, seq_len=64)
    pieces = [r.asDict() for r in packed.collect()]
    want = collections.Counter()
    for r in df.collect():
        ids = tok.model.encode(r.text or "", add_special_tokens=False).ids + [2]
        first, start = len(ids) % 64 or 64, 0
        for k, end in enumerate(range(first, len(ids) + 1, 64)):
            own = np.array(ids[start:end], "<u4")
            want[r.doc_id, k, start, end - start, zlib.crc32(own.tobytes())] += 1
            start = end
    assert collections.Counter((p["doc_id"], p["piece"], p["start"], p["length"], p["ids_crc32"]) for p in pieces) == want
    by = collections.defaultdict(list)
    for p in pieces:
        by[p["sequence_id"]].append((p["offset"], bytes(p["ids"])))
    assert len(by) <= math.ceil(sum(p["length"] for p in pieces) / 64) + 2
    for r in slack_pack.sequences(packed).collect():
        own = sorted(by.pop(r.sequence_id))
        assert b"".join(x for _, x in own) == bytes(r.ids) and r.length * 2 == len(r.ids) <= 128
        assert [o for o, _ in own] == [p.offset for p in r.pieces] == [0, *np.cumsum([len(x) // 2 for _, x in own])][:-1]
    assert not by
    assert slack_pack.pack(frame(spark, [])).collect() == []


# resampling


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)))


def plain_features(text, longest, buckets):
    w = plain_words(text)
    return [zlib.crc32(" ".join(w[i : i + m]).encode()) % buckets for m in range(1, longest + 1) for i in range(len(w) - m + 1)]


@pytest.mark.parametrize("longest", [1, 2, 4])
def test_features_against_brute_force(longest):
    r = random.Random(6)
    texts = ODD + [" ".join(r.choices(["a", "B", "c!d", "é", "x-1"], k=r.randint(0, 40))) for _ in range(60)]
    text, bucket, n_words = resample.features(texts, longest, 97)
    got = collections.defaultdict(list)
    for t, b in zip(text.tolist(), bucket.tolist()):
        got[t].append(b)
    assert n_words.tolist() == [len(plain_words(t)) for t in texts]
    for i, t in enumerate(texts):
        assert sorted(got[i]) == sorted(plain_features(t, longest, 97))


def test_suffix_array_is_sorted_with_its_prefixes():
    ids, bounds, _ = resample.word_ids(["b a b a", "", "a b a c a b a", "b a"])
    order, prefix = resample.suffix_array(ids, bounds, 3)
    end = {p: int(bounds[np.searchsorted(bounds, p, "right")]) for p in range(len(ids))}
    suffixes = [tuple(ids[p : min(p + 3, end[p])].tolist()) for p in order.tolist()]
    assert suffixes == sorted(suffixes) and sorted(order.tolist()) == list(range(len(ids)))
    for a, b, n in zip(suffixes, suffixes[1:], prefix[1:].tolist()):
        assert n == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


@pytest.mark.parametrize("longest", [1, 2])
def test_resampling_against_brute_force(spark, longest):
    r = random.Random(8)
    rows = odd_rows() + [(100 + i, " ".join(r.choices(string.ascii_letters, k=r.randint(10, 60))), "en") for i in range(200)]
    rows += rows[-30:]
    target = spark.createDataFrame([(None,), ("",), ("a B c a b",)] + [(" ".join("xyz"),)] * 5, "text string")
    got = resample.resample(frame(spark, rows), target, longest=longest, buckets=50).collect()
    s, t = np.zeros(50, int), np.zeros(50, int)
    for _, text, _ in rows:
        np.add.at(s, plain_features(text, longest, 50), 1)
    for row in target.collect():
        np.add.at(t, plain_features(row.text, longest, 50), 1)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.sum() + 50) / ((s[b] + 1) * (t.sum() + 50)))) for b in range(50)]
    want = []
    for doc_id, text, _ in rows:
        f = plain_features(text, longest, 50)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        want.append((doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(plain_words(text)) >= 20))
    order = sorted((x for x in want if x[-1]), key=lambda x: (-x[3], x[0] is None, x[0] or 0, x[1], x[2]))
    drawn = [(*x[:4], i + 1) for i, x in enumerate(order[: len(order) * 10 // 100])]
    assert sorted((tuple(x) for x in got if x["rank"]), key=lambda x: x[-1]) == drawn
    assert collections.Counter(tuple(x)[:4] for x in got) == collections.Counter(x[:4] for x in want)


def test_resampling_empty_tables(spark):
    none = spark.createDataFrame([], "text string")
    assert resample.resample(frame(spark, []), none).collect() == []
    assert resample.resample(frame(spark, odd_rows()), none).count() == len(odd_rows())
