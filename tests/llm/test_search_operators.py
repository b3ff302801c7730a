"""Exact top-k search, SimHash near-dedup, substring dedup, and the pipeline against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lithos.llm import simhash, substring, topk
from lithos.llm.queries import oracle_sql


def _brute_top(rows, k):
    kept = [(i, np.floor(64 * np.array(v, float)).astype(int)) for i, v in rows]
    out = []
    for q, a in kept:
        if q % 20 == 0:
            scored = sorted((-int(a @ b), i) for i, b in kept if i != q)[:k]
            out += [(q, n, i, -s) for n, (s, i) in enumerate(scored, 1)]
    return sorted(out)


@pytest.mark.parametrize("n", [1, 15, 300])
def test_topk(spark, n):
    rng = np.random.default_rng(n)
    rows = [(i, (rng.integers(-3, 4, 6) / 8).tolist()) for i in range(n)]  # many ties
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, rank int, Score string")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.search(table).collect())
    assert got == _brute_top(rows, 20)


def _by_oracle(table):
    import duckdb

    db = duckdb.connect()
    db.register("embeddings", table.toArrow())
    return sorted(db.sql(oracle_sql()["op4_topk"]).fetchall())


def test_topk_edges(spark):
    bad = [(None, [1.0, 2.0]), (20, None), (60, [1.0, None]), (80, [float("nan"), 1.0]), (100, [float("inf"), 1.0])]
    good = [(0, [0.5, -1.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0]), (3, [0.0, 0.0]), (40, []), (41, []), (120, [4e7, 1.0]), (140, [-1e6, 3e5]), (7, [0.25])]
    again = [(0, [0.5, -1.0]), (0, [2.0, 2.0]), (2, [1.0, 1.0]), *[(160, [0.125, 0.5])] * 30]
    table = spark.createDataFrame(bad + good + again, "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.search(table).collect())
    assert got == _by_oracle(table)
    assert (40, 1, 41, 0) in got and any(q == 120 for q, *_ in got) and any(v == 120 for _, _, v, _ in got)
    assert sum(q == 160 for q, *_ in got) == 30 * 20
    assert topk.search(table.limit(0)).count() == 0


def test_topk_beyond_64_bits(spark):
    table = spark.createDataFrame([(0, [1e300, -1e17]), (1, [1e300, 1.0]), (2, [-1e300, 1.0]), (3, [1e16, 0.0])], "vec_id long, embedding array<double>")
    got = [(r.vec_id, r.score) for r in topk.search(table).orderBy("rank").collect()]
    assert got == [(1, 2**63 - 1), (3, 2**63 - 1), (2, -(2**63))]


def test_bit_sliced_scores():
    rng = np.random.default_rng(0)
    for top in (50, 1 << 40, 1 << 63):
        values = rng.integers(-top, top, (700, 9), dtype=np.int64)
        low, slices = topk.build(np.arange(700), values)
        for q in (values[3], np.zeros(9, int), rng.integers(-127, 128, 9)):
            total, constant = topk.scores(q, low, slices, 11)
            assert topk._values(total, np.arange(700), constant) == [sum(a * b for a, b in zip(q.tolist(), v, strict=True)) for v in values.tolist()]


def _print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _components(prints, budget):
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(prints)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= budget:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_trie_join_equals_all_pairs():
    random.seed(4)
    groups, values = [0], []
    for _ in range(20):
        base = random.getrandbits(64)
        own = sorted({base ^ sum(1 << random.randrange(12) for _ in range(random.randrange(4))) for _ in range(40)})
        values += own
        groups.append(len(values))
    v, g = np.array(values, np.uint64), np.array(groups)
    got = set(zip(*(x.tolist() for x in simhash.trie_pairs(v, g)), strict=True))
    want = {(i, j) for a, b in zip(groups, groups[1:], strict=False) for i in range(a, b) for j in range(i + 1, b) if (values[i] ^ values[j]).bit_count() <= 2}
    assert got == want


@pytest.mark.parametrize("hot", [2, 1024])
def test_links_connect_what_the_budget_connects(spark, hot):
    random.seed(hot)
    near = {random.getrandbits(64) for _ in range(30)}
    base = random.getrandbits(64)
    for _ in range(150):
        base ^= sum(1 << random.randrange(64) for _ in range(random.choice([1, 2, 3])))  # chains of small steps
        near.add(base & (1 << 64) - 1)
    prints = {p - (1 << 64) if p >> 63 else p: p for p in near}
    rows = spark.createDataFrame([(p,) for p in prints], "fp long")
    found = {r.node: r.component for r in simhash.components(simhash.links(rows, hot=hot)).collect()}
    want = _components(prints, 2)
    assert {i: found.get(i, i) for i in prints} == want
    assert len(set(want.values())) < len(want) - 20


@pytest.mark.parametrize("few", [0, simhash.FEW])
def test_components_hold_every_node(spark, few):
    """The smallest node of a component is a row too, by stars and by one task."""
    rng = random.Random(3)
    edges = [(rng.randrange(-150, 150), rng.randrange(-150, 150)) for _ in range(160)] + [(1000 + i, 1001 + i) for i in range(40)]
    root = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in root:
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    found = [(r.node, r.component) for r in simhash.components(spark.createDataFrame(edges, "a long, b long"), few).collect()]
    assert len(found) == len(root) and dict(found) == root
    assert simhash.components(spark.createDataFrame([], "a long, b long"), few).count() == 0


def test_simhash_component_of_any_order(docs):
    """The smallest doc_id counts whichever of the linked fingerprints it has."""
    texts = [" ".join(f"w{k}x{i}" for i in range(400)) for k in range(12)]
    rows = [(x, t + " and" * (x % 2)) for k, t in enumerate(texts) for x in (2 * k, 2 * k + 101)]
    for rows in (rows, [(-i, t) for i, t in rows]):
        prints = {i: _print(t) for i, t in rows}
        want = _components(prints, 2)
        assert {r.doc_id: r.component_id for r in simhash.classify(docs(rows)).collect()} == want
        assert any(prints[i] != prints[j] for i, j in want.items())


def test_simhash(spark, odd, empty):
    found = simhash.classify(odd).collect()
    assert len(found) == odd.count()
    by_id = {r.doc_id: r for r in odd.collect() if r.doc_id is not None}
    prints = {i: _print(r.text) for i, r in by_id.items()}
    comps = _components(prints, 2)
    for r in found:
        if r.doc_id is not None:
            assert (r.fingerprint, r.component_id) == (f"{prints[r.doc_id]:016x}", comps[r.doc_id])
        else:
            assert r.component_id in (0, 8)
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(set(comps.values()))
    assert simhash.classify(empty).count() == 0 and simhash.keep_one(empty).count() == 0
    lone = odd.filter("doc_id IS NULL")
    assert {r.component_id for r in simhash.classify(lone).collect()} == {None}


def test_simhash_takes_every_id(docs):
    ids = [(1 << 62) + 5, (1 << 62) + 9, (1 << 63) - 1, -(1 << 63), -3]
    found = {r.doc_id: r.component_id for r in simhash.classify(docs([(i, f"one text {k // 2} of two copies") for k, i in enumerate(ids)])).collect()}
    assert found == {ids[0]: ids[0], ids[1]: ids[0], ids[2]: ids[3], ids[3]: ids[3], ids[4]: ids[4]}
    kept = simhash.keep_one(docs([(i, "the very same text") for i in ids[:2]]))
    assert [r.doc_id for r in kept.collect()] == [ids[0]]


def _brute_substring(rows, size):
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, w in words:
        for k in range(len(w) - size + 1):
            if i is not None:
                key = tuple(w[k : k + size])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in words:
        gone = set()
        for k in range(len(w) - size + 1):
            if i is not None and first[tuple(w[k : k + size])] < i:
                gone.update(range(k, k + size))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def _digest(df, size=13):
    return sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring.digest(df, size).collect()], key=repr)


def test_substring(spark, odd, empty):
    assert _digest(odd) == _brute_substring([(r.doc_id, r.text) for r in odd.collect()], 13)
    assert substring.digest(empty).count() == 0


def test_substring_on_shared_passages(spark, docs, monkeypatch):
    random.seed(9)
    passages = [" ".join(random.choices("abcdefgh", k=20)) for _ in range(5)]
    rows = [(i, " ".join(random.choices(passages + [f"own{i} word{i}"] * 5, k=8)) + random.choice(["", " ", "\n"])) for i in range(120)]
    monkeypatch.setattr(substring, "GROUP_BYTES", 2000)
    for size in (1, 3, 13):
        assert _digest(docs(rows), size) == _brute_substring(rows, size)


def test_words_of_like_polynomials_are_told_apart(docs):
    """A Thue-Morse word and its complement collide in every polynomial hash modulo 2^64."""
    word = "".join("ab"[i.bit_count() % 2] for i in range(2048))
    rows = [(1, " ".join(["w"] * 12 + [word])), (2, " ".join(["w"] * 12 + [word.translate(str.maketrans("ab", "ba"))])), (3, " ".join(["w"] * 12 + [word]))]
    assert _digest(docs(rows)) == _brute_substring(rows, 13)
    assert [r[2] for r in _digest(docs(rows))] == [0, 0, 13]


def test_remove_keeps_columns(spark, docs, odd, empty):
    shared = " ".join(f"w{i}" for i in range(15))
    rows = docs([(1, f"a\n{shared}\nb"), (2, f"c  d\n{shared}  e"), (3, shared), (4, None)])
    out = {r.doc_id: r for r in substring.remove(rows).collect()}
    assert (out[1].text, out[2].text, out[3].text, out[4].text) == (f"a\n{shared}\nb", "c  d e", "", None)
    assert out[2].n_chars == 6 and out[2].asDict().keys() == set(rows.columns)
    assert substring.remove(odd).columns == odd.columns and substring.remove(odd).count() == odd.count()
    assert substring.remove(empty).count() == 0


def test_pipeline_near_dedup_reaches_similarity_of_four_fifths(spark):
    """Five-word Jaccard similarity 0.8 or more goes, less stays, in small groups and in one large group."""
    import corpus_pipeline

    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(5000)]
    texts = []
    for _ in range(30):
        base = rng.choices(vocabulary, k=200)
        texts.append(base)
        for edits in (1, 2, 3, 4, 5, 6):
            copy = list(base)
            for at in rng.sample(range(200), edits):
                copy[at] = "new" + str(rng.random())
            texts.append(copy)
    base = rng.choices(vocabulary, k=200)
    for i in range(60):
        texts.append([*base[:100], f"only{i}", *base[101:]])
    sets = [{tuple(t[i : i + 5]) for i in range(196)} for t in texts]
    root = list(range(len(texts)))
    for j in range(len(texts)):
        for i in range(j):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    rows = [(i, " ".join(t), "en", "s", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = dict(corpus_pipeline.STAGES)["simhash"](spark, docs, "")
    assert out.columns == docs.columns
    assert {r.doc_id for r in out.collect()} == set(root)


def _near_groups(texts):
    """The smallest id that each id reaches over pairs whose sets of five-word shingles are alike by 4/5."""
    sets = {}
    for i, t in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_near_dedup_edges(spark, odd, empty):
    from lithos.llm import near

    found = near.classify(odd).collect()
    assert len(found) == odd.count()
    want = _near_groups({r.doc_id: r.text for r in odd.collect() if r.doc_id is not None})
    assert all(r.component_id == want[r.doc_id] for r in found if r.doc_id is not None)
    kept = near.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(set(want.values()))
    assert near.keep_one(empty).count() == 0


@pytest.mark.parametrize("limits", [{}, {"small": 1, "part": 40, "block": 16}])
def test_near_dedup_leaves_out_no_pair_of_a_large_group(spark, limits):
    """Of a large group every two documents that are near and meet in a lane are connected, and no others."""
    from lithos.llm import near

    rng = random.Random(11)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    texts = []
    for i in range(700):  # runs of edits at a few places: many pairs lie just below 0.8
        copy = list(base)
        for _ in range(rng.choice([1, 2, 3, 4])):
            at = rng.randrange(150)
            copy[at : at + 3] = [f"e{at}y{rng.randrange(4)}"] * 3
        texts.append(" ".join(copy))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    sets = [near.shingles(t) for t in texts]
    raw = np.stack([near.fingerprint(s) for s in sets])
    lanes = raw[:, : 3 * near.LANES].reshape(len(raw), near.LANES, 3).astype(np.int32) @ np.array([1, 1 << 8, 1 << 16], np.int32)
    root, true = list(range(len(texts))), list(range(len(texts)))
    for j in range(len(texts)):
        met = (np.bitwise_count(lanes[:j] ^ lanes[j]) <= 1).any(axis=1) & (np.bitwise_count(raw[:j, 3 * near.LANES :] ^ raw[j, 3 * near.LANES :]).sum(axis=1) <= near.CHECK)
        for i in range(j):
            if near.near(sets[i], sets[j]):
                for r in (root, true) if met[i] else (true,):
                    low, high = sorted((r[i], r[j]))
                    r[:] = [low if x == high else x for x in r]
    assert len(texts) // 20 < len(set(root))
    found = {r.doc_id: r.component_id for r in near.classify(docs, **limits).collect()}
    assert all(found[i] == found[low] for i, low in enumerate(root))
    assert all(true[i] == true[low] for i, low in found.items())


def test_near_dedup_rows_grow_with_the_group_and_not_its_pairs(spark):
    """Like documents that are not near: at most one row a bucket and class, and every near pair among them is found."""
    from lithos.llm import near

    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    rows = {}
    for n in (200, 800):
        texts = []
        for i in range(n):  # some 0.75 alike, a third of them 0.8 and more
            copy = list(base)
            for at in rng.sample(range(0, 150, 15), 2):
                copy[at] = f"e{i}y{at}"
            texts.append(" ".join(copy))
        docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
        prints = near._prints(docs).select("node", "fp").dropDuplicates(["node"])
        rows[n] = near.links(prints).count()
        assert rows[n] <= 2 * near.LANES * (n - 1)
        sets = [near.shingles(t) for t in texts]
        label = list(range(n))
        for j in range(n):
            for i in range(j):
                if label[i] != label[j] and near.near(sets[i], sets[j]):
                    low, high = sorted((label[i], label[j]))
                    label = [low if x == high else x for x in label]
        assert {r.doc_id: r.component_id for r in near.classify(docs).collect()} == dict(enumerate(label))
    assert rows[800] <= 5 * rows[200]


def test_pipeline_stage_by_stage(spark):
    """Each stage on its own input: what must go goes, what is clean stays."""
    import corpus_pipeline
    from lithos.llm.common import materialize

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    leak = 'The of and were that token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" with which from this.'
    more = [(10**6, "12345 67890", None, "s", 11), (10**6 + 1, None, None, "s", None), (10**6 + 2, leak, "en", "s", len(leak))]
    docs = docs.unionByName(spark.createDataFrame(more, docs.schema))
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        out = materialize(stage(spark, docs, "/root/testdata/sf0.001"), name)
        assert out.columns == docs.columns
        kept[name] = (before, {r.doc_id: r.text for r in out.collect()})
        docs = out
    before, after = kept["language_id"]
    assert before.keys() - after.keys() == {10**6, 10**6 + 1}
    before, after = kept["simhash"]
    # one of each group of five-word Jaccard similarity 0.8 or more stays, what has no near copy does
    first = {i: low for i, low in _near_groups(before).items()}
    assert set(first.values()) <= set(after)
    gone = len(before) - len(set(first.values()))
    assert gone and len(after) - len(set(first.values())) <= 0.02 * gone
    before, after = kept["substring_dedup"]
    want = {i: (n - m, sha) for i, n, m, sha in _brute_substring(list(before.items()), 13)}
    for i, text in after.items():
        words = text.split()
        assert want[i] == (len(words), hashlib.sha256(" ".join(re.findall(r"[^\x20\x09-\x0D]+", text)).encode()).hexdigest())
    before, after = kept["secret_scan"]
    assert before.keys() == after.keys()
    secret = re.compile(r'token = "[0-9a-f]{40}"')
    assert secret.search(before[10**6 + 2]) and not any(secret.search(t) for t in after.values())
    assert all(after[i] == t for i, t in before.items() if not secret.search(t))
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, "")
    assert pieces.agg(F.countDistinct("doc_id")).first()[0] == len(after)
    whole = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert {r[0] for r in whole.select("doc_id").distinct().collect()} == after.keys() - {10**6 + 2}
