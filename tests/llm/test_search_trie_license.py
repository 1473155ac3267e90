"""Prefix trie, license scan and lexical search against brute force on small messy tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from funnelworks.llm import lexscan, licensescan, prefixtrie
from funnelworks.llm.ship import ship

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
# Extra columns carry names that the operators use themselves.
DOCS = "doc_id bigint, text string, id int, t string, term string, score int, `at` int, spans string"


def words(text: str | None) -> list[str]:
    return WORDS.findall((text or "").translate(FOLD))


# Prefix trie.

def conversations() -> list[tuple]:
    rng = random.Random(11)
    rows = []
    for c in [*range(0, 30), *range(100, 140), *range(205, 211), 300, 1234567890123]:
        for turn in range(rng.choice([1, 1, 2, 3, 5, 9])):
            role = rng.choice(["user", "assistant", None])
            rows.append((c, turn if rng.random() < 0.9 else None, role, rng.choice(["hi", "ho", "ñé日", "", None, "long " * 30])))
    rows += [(150 + k, 0, "user", "hi") for k in range(40)]  # copies
    rows += [rows[3], rows[3], (None, 1, "user", "lost"), (7, 4, "user", "x"), (7, 4, "assistant", "x")]
    return rows


def trie(rows: list[tuple]) -> set[tuple]:
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    said = {c: [x[2:] for x in sorted(xs)] for c, xs in own.items()}
    whole = {}
    for c in said:
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = said.get(c - c % 100, [])[:h] + said[c][h:]
    members = defaultdict(list)
    for c, xs in whole.items():
        for d in range(len(xs) + 1):
            members[tuple(xs[:d])].append(c)
    children = Counter(n[:-1] for n in members if n)
    leaves: Counter = Counter()
    saved: Counter = Counter()
    for n, cs in members.items():
        for d in range(len(n) + 1):
            leaves[n[:d]] += children[n] == 0
            saved[n[:d]] += (len(cs) - 1) * len(n[-1][1]) if n else 0
    return {(min(cs), len(n), min(members[n[:-1]]) if n else None, len(cs), children[n], leaves[n], saved[n],
             hashlib.sha256(",".join(str(c) for c in sorted(cs) if len(whole[c]) == len(n)).encode()).hexdigest()) for n, cs in members.items()}


@pytest.mark.parametrize("fanout", [2, 7, 4096])
def test_trie_totals_at_any_number_of_tiers(spark, fanout):
    ship(spark)
    schema = "conv_id bigint, turn int, role string, text string, conv int, key string, pos int"
    frame = spark.createDataFrame([(*r, 1, "k", 2) for r in conversations()], schema).repartition(3)
    nodes = prefixtrie.prefix_trie(prefixtrie.rebuilt(prefixtrie.turn_table(frame)), fanout)
    out = [tuple(r) for r in nodes.collect()]
    expected = trie(conversations())
    assert len(out) == len(expected) and set(out) == expected
    assert max(r[1] for r in out) > 5 and any(r[4] > 7 for r in out)


def test_trie_of_nothing(spark):
    none = spark.createDataFrame([], "conv_id bigint, turn int, role string, text string")
    assert prefixtrie.prefix_trie(prefixtrie.rebuilt(prefixtrie.turn_table(none))).count() == 0


def test_long_lists_of_ends_are_joined_in_order(spark, monkeypatch):
    on_path = spark.range(5000).select((F.col("id") * 7 % 5000).alias("conv"), F.lit(b"k").alias("key"), F.lit(True).alias("is_end"))
    monkeypatch.setattr(prefixtrie, "TEXT_BYTES", 100)  # the number of rows per range is left to Spark
    got = prefixtrie.ends(on_path.repartition(4)).collect()
    assert [r["ends_sha256"] for r in got] == [hashlib.sha256(",".join(map(str, range(5000))).encode()).hexdigest()]


def test_queue_spills_and_keeps_order():
    rng = random.Random(1)
    queue, held, out = prefixtrie.SpillingQueue(limit=8), [], []
    for k in range(3000):
        if held and rng.random() < 0.4:
            held.sort()
            assert queue.head() == held[0]
            assert queue.pop() == held.pop(0)
        else:
            m = (rng.randrange(50), bytes([rng.randrange(256)]), k)
            queue.push(m)
            held.append(m)
        assert len(queue.heap) <= 8
    while queue.head() is not None:
        out.append(queue.pop())
    assert out == sorted(held) and len(queue.runs) == 0


def test_forward_is_the_same_with_a_spilling_queue():
    rng = random.Random(2)
    up = {bytes([0, 0, 0]): None}
    depth = {bytes([0, 0, 0]): 0}
    for k in range(1, 600):
        p = rng.choice(list(up))
        key = bytes([k // 256, k % 256, 1])
        up[key], depth[key] = p, depth[p] + 1
    root = bytes([0, 0, 0])
    rows = [(root, depth[k], k, up[k], 3, 0, 0, 0) for k in sorted(up, key=lambda k: (-depth[k], k))]
    few, many = list(prefixtrie.forward(iter(rows), 4)), list(prefixtrie.forward(iter(rows)))
    assert few == many and few[-1][0] == root and few[-1][3] == 3 * 600


# License scan.

def licensed() -> list[tuple]:
    notice = licensescan.TEMPLATES[5].text
    cut = notice.split()
    texts = [
        None, "", "...", "Released under the MIT License.", "mit  LICENSE mit license", "MIT-licence", "gnu general public license " * 3,
        "Licensed under CC BY-NC 4.0.", "cc-by", "xcc by", "ÀPACHE License", "An Apache\nLicense, Version 2.0 é", notice, notice.upper(),
        " ".join(cut[:20] + ["indeed", "so"] + cut[20:]), " ".join(cut[:9] + cut[12:]), " ".join(reversed(cut)), " ".join(cut[:12]),
        "word " * 3000 + notice + " word" * 3000 + " apache license", notice + " " + notice, "cc", "by cc by cc by", "of the " * 500 + notice,
    ]
    rows = list(enumerate(texts)) + [(12, notice), (12, notice), (None, "mit license"), (13, "other text of id 13: cc by")]
    return rows


def judged(text: str | None) -> tuple:
    w = words(text)
    places, labels, best = [], set(), 0.0
    for t in licensescan.TEMPLATES:
        p = t.words
        if t.phrase:
            found = [i for i in range(len(w) - len(p) + 1) if w[i:i + len(p)] == p]
            places += [(i, t.label) for i in found]
            continue
        grams = [p[i:i + t.k] for i in range(len(p) - t.k + 1)]
        met = defaultdict(set)
        for i in range(len(w) - t.k + 1):
            for at, g in enumerate(grams):
                if w[i:i + t.k] == g:
                    met[i - at].add(at)
        for d in met:
            share = len(set().union(*(met[x] for x in met if abs(x - d) <= licensescan.BAND))) / len(grams)
            if share >= licensescan.SHARE:
                labels.add(t.label)
                best = max(best, share)
    base = sorted({x for _, x in places})
    return (len(w), len(places), min(places)[0] if places else None, max(places)[0] if places else None, ",".join(base),
            ",".join(sorted(labels | set(base))), 1.0 if places else best)


def test_licenses_against_brute_force(spark):
    rows = licensed()
    frame = spark.createDataFrame([(*r, 1, "t", "x", 2, 3, "s") for r in rows], DOCS).repartition(3)
    out = licensescan.scan(frame).collect()
    got = Counter()
    for r in out:
        base = [s for s in r["spans"] if s["phrase"]]
        starts = [s["start"] for s in base]
        got[r["id"], (r["n_words"], len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted({s["label"] for s in base})),
                      ",".join(sorted({s["label"] for s in r["spans"]})), max((s["share"] for s in r["spans"]), default=0.0))] += 1
    assert got == Counter((k, judged(t)) for k, t in rows)


def test_spans_lie_where_the_notice_is(spark):
    notice = licensescan.TEMPLATES[5]
    n = len(notice.words)
    text = "some words before " + notice.text + " and after " + notice.text
    got = licensescan.scan(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()
    assert [(s["start"], s["stop"]) for s in got["spans"] if s["label"] == notice.label] == [(3, 3 + n), (5 + n, 5 + 2 * n)]


def test_licenses_of_an_empty_table(spark):
    assert licensescan.scan(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


# Lexical search.

def ranked(docs: list[tuple], items: list[tuple], k: int) -> dict:
    terms: dict = defaultdict(set)
    for i, t in items:
        terms[i] |= set(words(t))
    tf = [(d, Counter(words(t))) for d, t in docs]
    n_docs = sum(bool(c) for _, c in tf)
    total = sum(sum(c.values()) for _, c in tf)
    df = Counter(x for _, c in tf for x in c)
    w = {x: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) for x in df}
    out = {}
    for i, ts in terms.items():
        scores = []
        for d, c in tf:
            m = 50 + 50 * sum(c.values()) * n_docs // total
            s = sum(w[x] * (1_000_000_000 * c[x] // (1000 * c[x] + 20 * m)) for x in ts if x in c)
            if s > 0:
                scores.append((-s, d is None, d or 0))
        if scores:
            out[i] = [(None if none else d, -s) for s, none, d in sorted(scores)[:k]]
    return out


def searched() -> tuple[list[tuple], list[tuple]]:
    rng = random.Random(5)
    vocabulary = "the a of é日 ñ x1 Straße naïve THE cat dog bird fish tree".split() + [f"w{k}" for k in range(60)]
    docs = [(k, " ".join(rng.choices(vocabulary, k=rng.randrange(1, 40))) + rng.choice([".", "!\n", ""])) for k in range(300)]
    docs += [(300, None), (301, ""), (302, "-- "), (303, "the " * 2000), (None, docs[0][1]), docs[1], docs[1], (304, "cat,cat;CAT dogcat cat2")]
    docs += [(400 + k, docs[2][1]) for k in range(40)]  # more equal scores than ranks
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.randrange(1, 8)))) for k in range(25)]
    return docs, items + [(50, None), (51, ""), (52, "unheard of"), (53, "nowhere"), (None, "cat é日"), (3, "bird w7"), (54, "w1 w1 W1")]


@pytest.mark.parametrize("block_bytes", [lexscan.BLOCK_BYTES, 60])
def test_search_against_brute_force(spark, block_bytes):
    ship(spark)
    docs, items = searched()
    frame = spark.createDataFrame([(*r, 1, "t", "x", 2, 3, "s") for r in docs], DOCS).repartition(4)
    asked = spark.createDataFrame([(*r, 1, "x") for r in items], "item_id bigint, text string, item int, term string")
    rows = lexscan.rank(frame, asked, k=10, block_bytes=block_bytes).collect()
    got: dict = defaultdict(list)
    for r in sorted(rows, key=lambda r: r["rank"]):
        got[r["item"]].append((r["id"], r["score"]))
        assert r["rank"] == len(got[r["item"]])
    assert got == ranked(docs, items, 10)


def test_long_texts_are_counted_in_pieces(monkeypatch):
    docs, _ = searched()
    texts = [(t or "").encode() for _, t in docs] + [b"cat" * 50, b"", "é日".encode() * 40 + b" cat"]
    block = lexscan.Block("here", ["cat", "é日", "the", "w1"], np.zeros(5, int), np.zeros(0, int), [])
    built = lexscan.automaton(block)
    for piece in (40, 10_000_000):
        monkeypatch.setattr(lexscan, "PIECE", piece)
        got = {}
        for a, b, n, doc, term, tf in lexscan.term_counts(built, 4, texts):
            for k in range(a, b):
                got[k] = (int(n[k - a]), {block.terms[t]: int(c) for d, t, c in zip(doc, term, tf) if d == k - a})
        for k, t in enumerate(texts):
            c = Counter(words(t.decode()))
            assert got[k] == (sum(c.values()), {x: c[x] for x in block.terms if x in c})


def test_best_is_the_same_after_many_prunings():
    import pyarrow as pa

    rng = np.random.default_rng(3)
    scores = rng.integers(0, 6, (3, 400))
    best = lexscan.Best(3, 5)
    best.most = 7
    for d in range(0, 400, 23):
        best.add(scores[:, d:d + 23], pa.array(np.arange(d, min(d + 23, 400))))
    table = best.prune().to_pylist()
    for i in range(3):
        expected = sorted(((-int(s), d) for d, s in enumerate(scores[i]) if s > 0))[:5]
        assert [(-r["score"], r["id"]) for r in table if r["item"] == i] == expected


def test_search_in_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "cat")], "item_id bigint, text string")
    assert lexscan.rank(none, items).count() == 0
    assert lexscan.rank(spark.createDataFrame([(1, "cat")], "doc_id bigint, text string"), items.limit(0)).count() == 0
