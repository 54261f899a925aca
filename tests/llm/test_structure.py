"""Shards, phrases and the trie of conversations against brute force on small tables."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

import __spark_entry__ as entry
from tasador.llm import phrases, sharding, turntrie

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TURNS = "conv_id long, turn long, role string, text string"
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def test_every_operator_is_registered():
    names = [n for n in entry.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()


# shards


def shards_of(spark, rows, **options):
    return sharding.shard_documents(spark.createDataFrame(rows, DOCS), **options).collect()


def check_shards(rows, found, shards):
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in found) == want
    for s in range(shards):
        slots = sorted(r.slot for r in found if r.shard == s)
        assert slots == list(range(len(slots)))
    assert all(0 <= r.shard < shards and r.law == "bytes" and r.grown_shard is None for r in found)
    return [sum(r["size"] for r in found if r.shard == s) for s in range(shards)]


def test_shards_are_even_and_keep_copies_together(spark, monkeypatch):
    rng = random.Random(5)
    texts = ["".join(rng.choices("abcdé ", k=rng.randint(0, 300))) for _ in range(900)]
    texts += [t for t in texts[:200] for _ in range(rng.randint(1, 4))]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    monkeypatch.setattr(sharding, "LAST_ITEMS", 60)  # the stretches of buckets are used, too
    found = shards_of(spark, rows, shards=7)
    loads = check_shards(rows, found, 7)
    assert max(loads) - min(loads) < 300
    where = defaultdict(set)
    for r in found:
        where[r.text_crc32, r["size"]].add(r.shard)
    split = [k for k, s in where.items() if len(s) > 1]
    assert not [k for k in split if k[1] > 8], "copies fit, so none is apart"


def test_a_third_of_all_rows_may_be_one_text(spark, monkeypatch):
    monkeypatch.setattr(sharding, "LAST_ITEMS", 50)
    rows = [(i, "the same text" if i % 3 == 0 else f"text {i}", None, None, None) for i in range(1500)]
    found = shards_of(spark, rows, shards=12)
    loads = check_shards(rows, found, 12)
    assert max(loads) - min(loads) <= 2 * 21
    assert len({r.shard for r in found if r.doc_id % 3 == 0}) <= 8


def test_shards_of_odd_rows(spark):
    rows = [(None, None, None, None, None), (1, "", None, None, None), (1, "", None, None, None), (1, "x" * 100_000, "en", "a", 3)]
    rows += [(2, "same", "en", "a", 1)] * 40
    check_shards(rows, shards_of(spark, rows, shards=3), 3)
    assert shards_of(spark, []) == []
    clash = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS shard", "2 AS slot", "3 AS node", "4 AS size", "5 AS _block")
    check_shards(rows, sharding.shard_documents(clash, shards=3).collect(), 3)


def test_nodes_of_several_groups_follow_most_of_their_neighbours(spark):
    # two cliques of pairs, one weak pair between them
    rng = random.Random(2)
    members, group = [], 0
    for side in (0, 20):
        for a in range(20):
            for b in range(a):
                group += 1
                members += [(side + a, group, 1), (side + b, group, 1)]
    members += [(0, 0, 1), (20, 0, 1)]
    rng.shuffle(members)
    found = sharding.propagate(spark.createDataFrame(members, "node long, group long, size long"), capacity=24, shards=4).collect()
    place = {r.node: r.shard for r in found}
    assert len(place) == 40
    cut = sum(len({place[n] for n, g, _ in members if g == k}) > 1 for k in range(group + 1))
    start = {n: hash_shard(spark, n, 4) for n in place}
    cut_before = sum(len({start[n] for n, g, _ in members if g == k}) > 1 for k in range(group + 1))
    assert cut < cut_before
    assert max(Counter(place.values()).values()) <= 24


def hash_shard(spark, node, shards):
    return spark.sql(f"SELECT pmod(xxhash64(CAST({node} AS BIGINT)), {shards})").first()[0]


# phrases


def brute_phrases(rows, fewest, best):
    f, n, pieces = Counter(), Counter(), []
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for p in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", p)
            n[lang] += len(w)
            pieces.append((lang, w))
    for lang, w in pieces:
        for i in range(len(w)):
            for j in range(i + 1, min(len(w), i + 5) + 1):
                f[lang, tuple(w[i:j])] += 1
    candidates = {k: v for k, v in f.items() if v >= fewest and len(k[1]) > 1}
    inside = set()
    for (lang, g), v in candidates.items():
        parts = {g[i:j] for i in range(len(g)) for j in range(i + 2, len(g) + 1)} - {g}
        inside |= {(lang, p) for p in parts if 100 * v >= 100 * f[lang, p]}
    listed = defaultdict(list)
    for (lang, g), a in candidates.items():
        if (lang, g) not in inside:
            score, k = min((1000 * a * n[lang] // (f[lang, g[:k]] * f[lang, g[k:]]), k) for k in range(1, len(g)))
            listed[lang].append((-score, -a, " ".join(g).encode(), f[lang, g[:k]], f[lang, g[k:]]))
    return sorted(
        (lang, i + 1, p.decode(), -a, left, right, n[lang], -s)
        for lang, rows in listed.items()
        for i, (s, a, p, left, right) in enumerate(sorted(rows)[:best])
    )


def phrases_of(spark, rows, fewest, best=2000):
    docs = spark.createDataFrame([(i, t, lang, "s", 1) for i, (lang, t) in enumerate(rows)], DOCS)
    return sorted(tuple(r) for r in phrases.collocations(docs, fewest, best).collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_phrases_equal_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(phrases, "CHUNK_BYTES", 500)  # phrases are put together from many chunks
    rng = random.Random(seed)
    words = ["A", "b", "cc", "É", "日", "x\x00y", "d's", "E"]
    marks = [" ", " ", " ", "\t", "  ", ", ", ".", "\r\n", "\x0b", "!? "]
    rows = [
        (rng.choice(["en", "de", None, "und"]), "".join(x for _ in range(rng.randint(0, 60)) for x in (rng.choices(words, range(8, 0, -1))[0], rng.choice(marks))))
        for _ in range(120)
    ]
    rows += [(None, None), ("en", ""), ("en", " \t "), ("fr", "a"), ("en", "b b b b b b b b"), *[("en", "the very same passage here")] * 30]
    for fewest, best in ((6, 2000), (2, 15)):
        assert phrases_of(spark, rows, fewest, best) == brute_phrases(rows, fewest, best)


def test_phrases_of_hot_and_long_texts(spark):
    rows = [("en", "hot pair " * 3000 + "end. " + "z" * 50_000), *[("en", "hot pair")] * 50, ("en", "pair hot cold")]
    assert phrases_of(spark, rows, 40) == brute_phrases(rows, 40, 2000)
    assert phrases_of(spark, [], 2) == [] and phrases_of(spark, [(None, None)], 1) == []
    clash = spark.createDataFrame([("en", "a b a b")], "lang string, text string").selectExpr("*", "1 AS w1", "2 AS f", "3 AS k", "4 AS rank")
    assert sorted(tuple(r) for r in phrases.collocations(clash, 2).collect()) == brute_phrases([("en", "a b a b")], 2, 9)


def test_words_with_one_id_are_told_apart(spark, monkeypatch):
    real, calls = phrases._Tokens.hashes, []

    def weak(self, seed):
        calls.append(seed)
        return real(self, seed) & phrases.np.uint64(3) if seed == 1 else real(self, seed)

    rows = [("en", " ".join(random.Random(9).choices("abcdefgh", k=400)))]
    texts = [t.encode() for _, t in rows]
    monkeypatch.setattr(phrases._Tokens, "hashes", weak)
    tokens = phrases._Tokens(texts, ["en"], 1)
    assert len(set(tokens.ids.tolist())) < 8
    first, _ = phrases._counted([tokens.ids, tokens.hashes(7)])
    assert len(first) == 8, "words with one id are rows of their own, so the table shows the clash"


# conversations


def brute_trie(rows):
    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            turns[c].append((t is not None, t or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v, key=lambda x: x[:2])] for c, v in turns.items()}
    rebuilt = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = tuple(own.get(c - c % 5, [])[:h] + mine[h:])
    members, children = defaultdict(list), Counter()
    for c, s in rebuilt.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    for path in members:
        children[path[:-1]] += bool(path)
    leaves, saved = Counter(), Counter()
    for path, m in members.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += not children[path]
            saved[path[:d]] += (len(m) - 1) * len(path[-1][1].encode()) if path else 0
    ends = {p: ",".join(str(c) for c in sorted(m) if rebuilt[c] == p) for p, m in members.items()}
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), children[p], leaves[p], saved[p], hashlib.sha256(ends[p].encode()).hexdigest())
        for p, m in members.items()
    )


def trie_of(spark, rows, width):
    found = turntrie.prefix_trie(spark.createDataFrame(rows, TURNS), width).collect()
    return sorted(tuple(-1 if x is None else x for x in r) for r in found)


@pytest.mark.parametrize("width", [512, 2])
def test_trie_equals_brute_force(spark, width):
    rng = random.Random(4)
    rows = [
        (c, t if t or c % 7 else None, rng.choice(["user", None, "bot"]), rng.choice(["", "é", "yes", None, "no"]))
        for c in range(0, 260)
        if c % 11
        for t in range(rng.choice([1, 1, 2, 3, 5, 11, 14]))
    ]
    rows += [(c, t, "user", "same start" if t == 0 else "and on") for c in range(1000, 1300) for t in range(2)]
    rows += [(None, 1, "user", "no conversation"), (9001, 3, None, None)]
    assert trie_of(spark, rows, width) == brute_trie(rows)


def test_trie_of_long_repeated_and_no_conversations(spark):
    rows = [(5, t, "user", f"t{t}") for t in range(700)] + [(6, t, "user", f"t{t}") for t in range(650)]
    rows += [(5, 1, "user", "t1")] * 3 + [(7, 0, "user", "x" * 100_000)]
    assert trie_of(spark, rows, 256) == brute_trie(rows)
    assert trie_of(spark, [], 512) == []
    clash = spark.createDataFrame([(1, 0, "a", "b")], TURNS).selectExpr("*", "1 AS at", "2 AS depth", "3 AS size", "4 AS _block", "5 AS k1")
    assert len(turntrie.prefix_trie(clash).collect()) == len(brute_trie([(1, 0, "a", "b")]))
