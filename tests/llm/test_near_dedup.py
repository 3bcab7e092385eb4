"""Near duplicates and top-k against brute force, with nulls, empty tables, ties and repeated rows."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from warpline.llm import cover_tree, embedding_dedup, similar_texts, simhash_dedup
from warpline.llm.common import Scratch, among, connected_components


def groups(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {n: find(n) for n in nodes}


def plain_print(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_text_print_matches_definition():
    rng = random.Random(3)
    texts = [None, "", " \t\n", "one", "One TWO", "É a b c d", "a\x0bb\x0cc d", "x " * 3000] + [" ".join(rng.choice("abcdé") * rng.randint(1, 4) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    for text in texts:
        for width in (3, 5):
            assert simhash_dedup.text_print(text, width) & (2**64 - 1) == plain_print(text, width)


def test_every_close_pair_meets_at_an_anchor():
    rng = np.random.default_rng(1)
    prints = rng.integers(-(2**63), 2**63, 400, dtype=np.int64)
    near = prints.copy()
    for i in range(len(near)):
        for bit in rng.choice(64, 2, replace=False):
            near[i] ^= np.int64(np.uint64(1 << int(bit)).astype(np.int64))
    rows, homes = simhash_dedup.anchors(prints, False)
    assert (rows == np.arange(len(prints))).all()
    rows, replicas = simhash_dedup.anchors(near, True)
    for i in range(len(prints)):
        assert homes[i] in replicas[rows == i]


def test_simhash_groups(spark):
    rng = random.Random(5)
    base = [" ".join(rng.choice(["ab", "cd", "ef", "gh", "ij"]) for _ in range(rng.randint(3, 40))) for _ in range(60)]
    texts = base + [t.upper() for t in base[:20]] + [t + "  \n" for t in base[:10]] + [b + " zz" for b in base] + [None, "", "  ", "x" * 50_000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, base[3]), (None, base[4]), (None, "alone here now")]
    docs = spark.createDataFrame([(i, t, "a", "b") for i, t in rows], "doc_id long, text string, print string, component_id string")
    got = simhash_dedup.simhash_groups(docs).collect()
    assert len(got) == len(rows)
    prints = {plain_print(t, 3) for _, t in rows}
    linked = groups(prints, [(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 2])
    least = {}
    for i, t in rows:
        if i is not None:
            g = linked[plain_print(t, 3)]
            least[g] = min(i, least.get(g, i))
    expected = sorted((str(i), f"{plain_print(t, 3):016x}", str(least.get(linked[plain_print(t, 3)]))) for i, t in rows)
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == expected


def test_one_of_each_group_keeps_one(spark):
    docs = spark.createDataFrame([(2, "a b c d e f g"), (1, "A b c d e f g"), (1, "A b c d e f g"), (5, "quite another text of words"), (None, "nobody knows the id"), (None, "nobody knows the id")], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.text) for r in similar_texts.one_of_each_group(docs).collect())
    assert got == [("1", "A b c d e f g"), ("5", "quite another text of words"), ("None", "nobody knows the id")]


def edited(rng, words, share):
    words = list(words)
    for k in range(len(words)):
        if rng.random() < share:
            words[k] = f"w{rng.randrange(5000)}"
    return " ".join(words)


@pytest.mark.parametrize("block", [4, 512])
def test_similar_groups_against_all_pairs(spark, block, monkeypatch):
    """No group joins what all pairs do not, and nearly all pairs at 0.8 or more are found, however small the blocks are."""
    monkeypatch.setattr(similar_texts, "BLOCK", block)
    rng = random.Random(block)
    texts = []
    for _ in range(12):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(30, 300))]
        texts += [edited(rng, words, rng.choice([0, 0.005, 0.01, 0.02, 0.05])) for _ in range(rng.randint(2, 25))]
    texts += [texts[0].upper(), texts[0].replace(" ", "\n"), None, "", " ", "one two", "One  two", "x " * 3000]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, root int")
    got = {r.id: r.group for r in similar_texts.similar_groups(docs).collect()}
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := (t or "").lower().split()) else frozenset() for t in texts]
    jaccard = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    links = [(a, b) for a in range(len(texts)) for b in range(a) if jaccard(sets[a], sets[b]) >= 0.8]
    truth = groups(range(len(texts)), links)
    assert len(got) == len(texts) and all(truth[a] == truth[b] for a in got for b in got if got[a] == got[b])
    found = [got[a] == got[b] for a, b in links]
    differing = [got[a] == got[b] for a, b in links if sets[a] != sets[b]]
    assert len(differing) > 100 and sum(differing) >= 0.95 * len(differing) and sum(found) >= 0.95 * len(found)
    assert all(got[a] == got[b] for a, b in links if jaccard(sets[a], sets[b]) >= 0.95)


def test_whole_batches_of_blocks():
    """Blocks are put together across batches and cut nowhere else."""
    table = pa.table({"key": [1, 1, 1, 2, 2, 3, 3, 3, 3], "i": [0] * 9, "j": [0, 0, 1, 0, 0, 0, 0, 0, 0], "v": list(range(9))})
    for size in (1, 2, 3, 4, 9):
        parts = list(similar_texts._grouped(iter(table.to_batches(max_chunksize=size)), "key"))
        assert [v for p in parts for v in p.column("v").to_pylist()] == list(range(9))
        seen = [set(zip(p.column("key").to_pylist(), p.column("j").to_pylist(), strict=True)) for p in parts]
        assert sum(map(len, seen)) == len(set().union(*seen)) == 4


def test_among_keeps_what_is_wanted(spark):
    rows, wanted = spark.range(5000).selectExpr("id", "id % 7 as cell"), spark.range(0, 5000, 50).selectExpr("id as want")
    got = {r.id for r in among(rows, F.col("id"), wanted, F.col("want")).collect()}
    assert set(range(0, 5000, 50)) <= got and len(got) < 150


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash_dedup.simhash_groups(docs).collect() == []
    assert similar_texts.one_of_each_group(docs).collect() == []
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embedding_dedup.embedding_groups(vectors).collect() == []
    assert cover_tree.top_products(vectors, F.col("vec_id") % 20 == 0).collect() == []


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(200, 100), (100, 100), (300, 301), (301, 300)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(chain, "a long, b long"), Scratch(spark, "t")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 200: 100, 300: 300, 301: 300}


def vectors_with_groups(n=300, dim=16):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(n):
        centre = np.random.default_rng(i // 6).normal(size=dim)
        rows.append((i, [float(x) for x in (centre + 0.25 * rng.normal(size=dim))], int(i // 6 % 3)))
    rows += [(1000 + k, rows[0][1], rows[0][2]) for k in range(5)] + [(2000, [2 * x for x in rows[0][1]], rows[0][2]), (2001, rows[0][1], None)]
    rows += [(3000, None, 1), (3001, [], 1), (3002, [0.0] * dim, 1), (3003, [None] + [1.0] * (dim - 1), 1), (3004, [math.nan] + [1.0] * (dim - 1), 1), (3005, [math.inf] * dim, 1), (3006, [1.0, 2.0], 1), (3007, [1.0, 2.1], 1)]
    return rows + [(7, rows[9][1], rows[9][2])]


@pytest.mark.parametrize("block", [8, 2048])
def test_embedding_groups_against_all_pairs(spark, block):
    rows = vectors_with_groups()
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, node string")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.embedding_groups(frame, block=block).collect())
    ok = {k for k, (_, v, g) in enumerate(rows) if g is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}

    def close(a, b):
        (_, v, g), (_, w, h) = rows[a], rows[b]
        return a in ok and b in ok and g == h and len(v) == len(w) and np.dot(v, w) / (np.linalg.norm(v) * np.linalg.norm(w)) >= 0.93

    links = [(a, b) for a in range(len(rows)) for b in range(a) if close(a, b)]
    group = groups(range(len(rows)), links)
    least = {}
    for k, (i, _, _) in enumerate(rows):
        least[group[k]] = min(i, least.get(group[k], i))
    counts = [sum(k in pair for pair in links) for k in range(len(rows))]
    assert max(counts) > 8
    assert got == sorted((i, counts[k], least[group[k]], i == least[group[k]]) for k, (i, _, _) in enumerate(rows))


@pytest.mark.parametrize("scale", [1.0, 1e6])
def test_top_products_against_all_pairs(spark, scale):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x * scale) for x in rng.normal(size=6).round(2)]) for i in range(120)]
    rows += [(200 + k, rows[11][1]) for k in range(30)] + [(400, None), (401, [math.nan] * 6), (402, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (None, rows[0][1]), (20, rows[20][1]), (420, [])]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, rank int")
    got = sorted(map(tuple, cover_tree.top_products(frame, F.col("vec_id") % 20 == 0, k=5, chunk=40, group=4).collect()))
    whole = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    assert len(whole) > len({i for i, _ in whole})
    expected = []
    for own, (q, point) in enumerate(whole):
        if q % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(point, v, strict=True)), i) for other, (i, v) in enumerate(whole) if other != own)[:5]
            expected += [(q, rank, i, -s) for rank, (s, i) in enumerate(best, 1)]
    assert got == sorted(expected)


def test_cover_tree_prunes_and_stays_exact():
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(12, 8)) * 300
    points = np.floor(np.concatenate([c + rng.normal(size=(200, 8)) * 3 for c in centres]))
    ids = np.arange(len(points))
    run = cover_tree.Search(points[::50], ids[::50], 7)
    run.add(points, ids, ids)
    for row, q in enumerate(range(0, len(points), 50)):
        s = points @ points[q]
        best = sorted((-s[i], i) for i in ids if i != q)[:7]
        assert [(-a, b) for a, b in zip(run.scores[row], run.found[row], strict=True)] == best


def test_large_keys_lose_no_link(spark, monkeypatch):
    """Groups do not depend on the size of blocks: two groups of near copies that share keys, and texts apart from all."""
    rng = np.random.default_rng(11)
    words = [f"w{i}" for i in range(4000)]
    bases = [list(rng.choice(words, 60)) for _ in range(3)]
    texts = [" ".join(b) for b in bases]
    for i in range(90):
        copy = list(bases[i % 2])
        copy[int(rng.integers(60))] = f"x{i}"
        texts.append(" ".join(copy))
    texts += [" ".join(rng.choice(words, 60)) for _ in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = []
    for block in (512, 4):
        monkeypatch.setattr(similar_texts, "BLOCK", block)
        groups = {}
        for r in similar_texts.similar_groups(docs).collect():
            groups.setdefault(r.group, set()).add(r.id)
        found.append(sorted(map(sorted, groups.values())))
    assert found[0] == found[1]
    assert {len(g) for g in found[0]} == {46, 1} and sum(len(g) == 46 for g in found[0]) == 2


def test_replicas_are_never_broadcast(spark):
    prints = Scratch(spark, "prints").save(spark.range(1000).select(F.xxhash64("id").alias("print")), "prints")
    plan = simhash_dedup.print_links(prints)._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_keys_shared_by_chance_are_not_joined(spark, monkeypatch):
    def joined(*_):
        raise AssertionError("rows of small keys are joined")

    monkeypatch.setattr(similar_texts, "_dealt", joined)
    rows = [(1, 1, 0, 0, 7), (2, 2, 1, 0, 7), (3, 3, -1, -1, 7), (4, 4, 0, 0, 8)]
    keyed = spark.createDataFrame(rows, "s1 long, s2 long, f1 long, f2 long, key long")
    found = similar_texts._coarse_groups(keyed, Scratch(spark, "keys")).collect()
    node = lambda n: f"{n:016X}".lower() * 2
    assert sorted(map(tuple, found)) == [(node(1), node(1)), (node(2), node(1))]
