import random
from collections import defaultdict

import xxhash

from tablescribe.llm import simhash
from tablescribe.llm.common import components


def slow(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def union(nodes, pairs):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_fingerprints_and_components(docs, texts):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(texts)
    prints = {}
    for i, t in texts:
        prints.setdefault(i, []).append(slow(t))
    for r in got:
        assert int(r["fingerprint"], 16) in prints[r["doc_id"]] and len(r["fingerprint"]) == 16
    flat = [(i, f) for i, fs in prints.items() for f in fs]
    values = {f for _, f in flat}
    root = union(values, [(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 2])
    least = defaultdict(list)
    for i, f in flat:
        if i is not None:
            least[root[f]].append(i)
    for r in got:
        ids = least[root[int(r["fingerprint"], 16)]]
        assert r["component_id"] == (min(ids) if ids else None)


def test_links_are_all_pairs_within_the_distance(spark):
    r = random.Random(3)
    values = set()
    for _ in range(60):
        v = r.getrandbits(64)
        for _ in range(5):
            values.add(v)
            for _ in range(r.randint(1, 4)):
                v ^= 1 << r.randrange(64)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    for most in (1, 2, 3):
        want = sorted(tuple(sorted((signed(a), signed(b)))) for a in values for b in values if a < b and (a ^ b).bit_count() <= most)
        got = simhash.links(spark.createDataFrame([(signed(v),) for v in values], "fp long"), most).collect()
        assert sorted((x["a"], x["b"]) for x in got) == want


def jaccard(a, b, k=5):
    sets = []
    for t in (a, b):
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    return 1.0 if sets[0] == sets[1] else len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def edited(r, words, text, n):
    w = text.split()
    for _ in range(n):
        w[r.randrange(len(w))] = r.choice(words)
    return " ".join(w)


def test_keep_one_keeps_one_row_of_each_group_of_near_copies(spark, nothing, texts, words):
    r, rows = random.Random(9), list(texts)
    for i in range(25):  # near copies on either side of the limit
        base = " ".join(r.choice(words) for _ in range(200))
        rows += [(1000 + 10 * i, base)] + [(1001 + 10 * i + k, edited(r, words, base, n)) for k, n in enumerate((1, 2, 3, 8, 16))]
    base = " ".join(r.choice(words) for _ in range(150))
    rows += [(3000 + i, edited(r, words, base, 2)) for i in range(60)]  # one large group
    docs = spark.createDataFrame([(i, t, 1, "x", 5) for i, t in rows], "doc_id long, text string, __row int, row string, node long")
    near = [(a, b) for a in range(len(rows)) for b in range(a) if jaccard(rows[a][1], rows[b][1]) >= 0.8]
    root = union(range(len(rows)), near)
    groups = defaultdict(list)
    for k, (i, t) in enumerate(rows):
        groups[root[k]].append((i is not None, i or 0, t))
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    got = kept.collect()
    want = [min(g[:2] for g in v) for v in groups.values()]
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in got) == sorted(want)
    assert simhash.keep_one(nothing).count() == 0 and simhash.near_duplicates(nothing).count() == 0


def test_nodes_together_by_chance_leave_before_rows_are_laid_out(spark):
    far, near = 0, (1 << 20) - 1  # 20 of the first 64 bits apart
    rows = [(1, far, 7), (2, -1, 7), (3, far, 8), (4, near, 8), (5, far, 9), (6, -1, 9), (7, 5, 9), (8, far, 10)]
    got = simhash.shared_keys(spark.createDataFrame(rows, "node long, h0 long, key long"), 0.8).collect()
    assert sorted((r["key"], r["node"]) for r in got) == [(8, 3), (8, 4), (9, 5), (9, 6), (9, 7)]  # two alone must be near, three may hold a pair


def test_leaders_are_few_near_and_of_other_groups(spark):
    r = random.Random(4)
    base = [r.getrandbits(62) for _ in range(simhash._HEAD)]
    head = {n: [x ^ (1 << r.randrange(62)) for x in base] for n in range(40)} | {99: [~x for x in base]}
    rows = [(n, key << 24, *h, n % 2) for n, h in head.items() for key in range(0, 20, 2)]
    members = spark.createDataFrame(rows, "node long, key long, " + "".join(f"h{i} long, " for i in range(simhash._HEAD)) + "group long")
    got = [(x["a"], x["b"]) for x in simhash.nearest_leaders(members, 0, 2, 0.8).collect()]
    most = {a: sum(1 for x, _ in got if x == a) for a, _ in got}
    assert got and len(set(got)) == len(got) and max(most.values()) <= simhash._LEADERS and all(a % 2 != b % 2 and 99 not in (a, b) for a, b in got)
    assert not simhash.nearest_leaders(members, 1, 2, 0.8).collect()  # the other round's chains hold nothing here


def test_near_copies_pass_to_python_in_small_batches(spark, monkeypatch):
    seen, held = [], simhash.written
    monkeypatch.setattr(simhash, "written", lambda df, name="table": seen.append(df.sparkSession.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) or held(df, name))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    docs = spark.createDataFrame([(i, f"a b c d e f {i % 2}") for i in range(8)], "doc_id long, text string")
    assert simhash.keep_one(docs).count() == 2
    assert seen[0] == "1000" and spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_chains_find_pairs_at_the_limit():
    """The share of pairs at a similarity of 0.8 with a common chain, and within the Hamming bound."""
    r, hits, near, n = random.Random(2), 0, 0, 300
    for _ in range(n):
        same = [r.getrandbits(40) for _ in range(160)]
        a, b = (" ".join(str(x) for x in same + [r.getrandbits(40) for _ in range(20)]) for _ in range(2))
        fa, fb = (simhash.long_fingerprint(t, 1, 44) for t in (a, b))
        bits = [int(x) ^ int(y) for x, y in zip(fa.view("uint64"), fb.view("uint64"))]
        apart = [sum(bits[p // 64] >> p % 64 & 1 for p in range(k * 12, k * 12 + 12)) for k in range(234)]
        common = any(apart[k] == 0 == apart[(k + 1) % 234] for k in range(234))
        assert common == bool(set(simhash.chain_keys(fa[None])[0].tolist()) & set(simhash.chain_keys(fb[None])[0].tolist()))
        hits += common
        near += sum(x.bit_count() for x in bits) <= simhash.bits_apart(0.8, 44)
    assert hits >= 0.97 * n and near >= 0.99 * n


def test_components_of_a_path_a_star_and_a_ring(spark):
    pairs = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 160)] + [(200 + i, 200 + (i + 1) % 9) for i in range(9)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(51)} | {i: 100 for i in range(100, 160)} | {i: 200 for i in range(200, 209)}
