"""Operators 11, 12 and 13 against brute force, registered SQL (operator 5 too), edge rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from compare import duck, frame_hash

from auctionlens.llm import pivotal, simhash, turntrie
from auctionlens.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TOKEN = re.compile(r"[^\x20\x09-\x0d]+")


@pytest.mark.parametrize("name", ["op5_near_duplicates", "op11_prefix_trie", "op12_spelling_variants"])
def test_registered_queries_equal_their_sql(spark, name):
    got, want = queries()[name](spark, SF).toPandas(), duck(SF).execute(oracle_sql()[name]).fetchdf()
    assert len(got) > 50
    assert frame_hash(got) == frame_hash(want)


# --- operator 11 ----------------------------------------------------------


def _sequences(rows, share=20):
    by = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            by[c].append((t is not None, t or 0, role or "", text or ""))
    by = {c: [x[2:] for x in sorted(v)] for c, v in by.items()}
    if not share:
        return by
    out = {}
    for c, own in by.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % share) * (1 if c >= 0 else -1)
        out[c] = by.get(base, [])[:h] + own[h:]
    return out


def _trie(paths):
    members = defaultdict(list)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[tuple(p[:d])].append(c)
    saved, leaves, kids = Counter(), Counter(), Counter()
    for node in members:
        if node:
            kids[node[:-1]] += 1
    for node, m in members.items():
        words = len(TOKEN.findall(node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            saved[node[:d]] += (len(m) - 1) * words
            leaves[node[:d]] += kids[node] == 0
    out = set()
    for node, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(paths[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out.add((min(m), len(node), parent, len(m), kids[node], leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def _turns(spark, rows):
    """Turns with further columns of clashing names."""
    return spark.createDataFrame([(*r, 1, "x", 0.5) for r in rows], "conv_id bigint, turn bigint, role string, text string, depth int, k1 string, w double")


def _conversations(seed, n):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-30, 400), n):
        for t in range(rng.choice([1, 2, 3, 5, 9, 14])):
            rows.append((c, t, rng.choice(["user", "bot", None]), rng.choice(["a", "a b", "a  b\tc", "", None, "Ä é"]) if t < 5 else "same end"))
    return rows + [(None, 0, "user", "nobody's"), (None, None, None, None), (7, 0, "user", "a"), (7, 0, "user", "a"), (8, None, "user", "null first"), (8, 0, "user", "a")]


@pytest.mark.parametrize("width", [2, 3, 8])
def test_trie_equals_brute_force(spark, width):
    rows = _conversations(width, 120)
    got = turntrie.trie(turntrie.rebuilt(turntrie.turn_ids(_turns(spark, rows))), width).collect()
    assert {tuple(r) for r in got} == _trie(_sequences(rows))
    assert len(got) == len({(r["conv_id"], r["depth"]) for r in got})


def test_trie_of_one_hot_conversation_and_a_very_long_one(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(200) for t in range(3)]
    rows += [(1000, t, "user", f"turn {t}") for t in range(300)] + [(1001, 0, "user", "word " * 50_000)]
    got = turntrie.prefix_trie(_turns(spark, rows)).collect()
    assert {tuple(r) for r in got} == _trie(_sequences(rows, share=0))


def test_trie_edge_tables(spark):
    assert turntrie.prefix_trie(_turns(spark, [])).count() == 0
    assert turntrie.prefix_trie(_turns(spark, [(None, 1, "user", "x")])).count() == 0
    # conversation 2 takes two turns from conversation 0, which is absent, and has no third
    rows = [(2, 0, "u", "x"), (22, 5, None, None)]
    got = turntrie.trie(turntrie.rebuilt(turntrie.turn_ids(_turns(spark, rows)))).collect()
    assert {tuple(r) for r in got} == _trie(_sequences(rows))


def test_endings_beyond_one_id_range(spark):
    ids = [*range(-5, 5), *range(1 << 16, (1 << 16) + 5), 1 << 40]
    rows = [(c, 0, "u", "same") for c in ids]
    (leaf,) = [r for r in turntrie.prefix_trie(_turns(spark, rows)).collect() if r["depth"] == 1]
    assert leaf["ends_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


# --- operator 12 ----------------------------------------------------------


def _near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def _variants(n):
    near = {w: [v for v in n if _near(w, v)] for w in n}
    form = {}
    for w in n:
        top = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = top if top and n[top] >= 10 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return out


def _edited(rng, w, letters):
    i = rng.randrange(len(w))
    return rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice(letters) + w[i:], w[:i] + rng.choice(letters) + w[i + 1 :]])


@pytest.mark.parametrize("letters", ["ab", "abcdé", "abcdefghijklmnopqrstuvwxyzàÿß"])
def test_variants_equal_brute_force(spark, letters):
    rng = random.Random(len(letters))
    words = {"".join(rng.choice(letters) for _ in range(rng.choice([7, 7, 8, 9, 12, 20]))) for _ in range(150)}
    words |= {_edited(rng, w, letters) for w in words for _ in range(3)}
    words |= {_edited(rng, w, letters) for w in words}
    n = {w: rng.choice([2, 3, 25, 40, 300, 4000, 50_000]) for w in words if len(w) >= 7}
    got = pivotal.variants(spark.createDataFrame(list(n.items()), "word string, n bigint")).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert {tuple(r) for r in got} == _variants(n)


def test_pivots_are_the_cheapest_disjoint_pair_of_the_prefix():
    rng = np.random.default_rng(3)
    cost = rng.integers(1, 9, (300, 8))
    order = np.array([np.lexsort((np.arange(8), c)).argsort() for c in cost])
    prefix, last, one, two = pivotal.pivots(order, cost)
    for i in range(300):
        inside = np.flatnonzero(order[i] <= np.sort(order[i])[2])
        assert prefix[i].nonzero()[0].tolist() == inside.tolist() and last[i] == np.sort(order[i])[2]
        best = min(cost[i, a] + cost[i, b] for a in inside for b in inside if b >= a + 2)
        assert two[i] >= one[i] + 2 and {one[i], two[i]} <= set(inside) and cost[i, one[i]] + cost[i, two[i]] == best


def _words(docs):
    n = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            at = h % len(run)
            n[run[:at] + run[at + 1 :] if h % 31 == 0 else run] += 1
    return {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}


def test_counted_words_and_edge_rows(spark):
    rng = random.Random(5)
    pool = ["Sommerabend", "SOMMERABEND", "été", "Übermut", "übermut", "naïveté", "÷×÷×÷×÷", "abcdef", "abcdefg", "ABCDEFG", "x" * 4000]
    docs = [(i, "1".join(rng.choices(pool, k=rng.randrange(40)))) for i in range(300)]
    docs += [(1, docs[1][1]), (None, "abcdefg abcdefg"), (None, None), (901, ""), (902, "0 1 ?!"), (903, "sommerabend " * 30_000)]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id bigint, text string, n int, word string")
    n = _words(docs)
    assert {tuple(r) for r in pivotal.counted(df).collect()} == set(n.items())
    got = pivotal.variants(pivotal.counted(df)).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert {tuple(r) for r in got} == _variants(n)
    assert pivotal.variants(pivotal.counted(df.limit(0))).count() == 0
    with pytest.raises(ValueError):
        pivotal.counted(df, least=5)


# --- operator 13 ----------------------------------------------------------


def _fingerprint(text, k):
    w = TOKEN.findall((text or "").translate(LOWER))
    if not w:
        return 0
    k = min(k, len(w))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(len(w) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _groups(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def _simhash_groups(rows):
    f = [(i, fp) for i, fp in rows if i is not None]
    v = np.array([x for _, x in f], np.uint64)
    links = [(f[a][0], f[b][0]) for a in range(len(f)) for b in np.flatnonzero(np.bitwise_count(v[a] ^ v[:a]) <= 2)]
    return _groups({i for i, _ in f}, links)


def test_simhash_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    fp = {r["doc_id"]: _fingerprint(r["text"], 3) for r in docs}
    want = _simhash_groups(list(fp.items()))
    got = queries()["op13_simhash_duplicates"](spark, SF).collect()
    assert {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in got} == {(i, format(x, "016x"), want[i]) for i, x in fp.items()}
    assert len(got) == len(docs) and len(set(want.values())) < len(docs)


def test_simhash_edge_rows(spark):
    long = " ".join(f"w{i % 997}" for i in range(50_000))
    docs = [(9, None), (3, ""), (5, " \t\n"), (7, "One"), (8, "one"), (6, "One two"), (None, "One"), (None, None), (10, long), (11, long), (11, "other words in here"), (12, "Other words  in here"), (12, "Other words  in here")]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id bigint, text string, fp int, component_id string")
    got = simhash.near_duplicates(df, k=3).collect()
    rows = [(i, _fingerprint(t, 3)) for i, t in docs]
    want = _simhash_groups(rows)
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == Counter((i, format(x, "016x"), want.get(i)) for i, x in rows)
    assert want[12] == 10 and want[9] == 3  # by the id that has both texts; by the empty texts
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    assert sorted(r["doc_id"] for r in simhash.keep(df.filter("doc_id is not null"), k=3).collect()) == [3, 6, 7, 10]


def test_long_posting_lists_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 3, dtype=np.uint64)
    fps = {int(x) for x in rng.integers(0, 1 << 63, 200, dtype=np.uint64)}
    for b, (lo, hi) in zip(base, [(0, 8), (16, 40), (56, 48)], strict=True):  # one ball in two bytes, one in two far bytes, one in more
        fps |= {int(b ^ (np.uint64(x & 0xFF) << np.uint64(lo)) ^ (np.uint64(x >> 8) << np.uint64(hi))) for x in rng.integers(0, 1 << 16, 1500).tolist()}
    fps |= {int(base[0]) ^ (1 << int(a)) ^ (1 << int(b)) ^ (1 << int(c)) for a, b, c in rng.integers(0, 64, (1500, 3))}
    rows = [(i, x) for i, x in enumerate(sorted(fps))]
    df = spark.createDataFrame([(i, x - (1 << 64) if x >> 63 else x) for i, x in rows], "id bigint, fp bigint")
    links = [tuple(r) for r in simhash.links(df).collect()]
    assert _groups({i for i, _ in rows}, links) == _simhash_groups(rows)
    assert len(links) < 40 * len(rows)


def test_list_components_agree():
    rng = np.random.default_rng(8)
    fp = np.unique(np.uint64(0xABCDEF0123456789) ^ (rng.integers(0, 1 << 16, 400).astype(np.uint64) << np.uint64(24)))
    assert (simhash.tallied(fp) == simhash.flipped(fp)).all()
