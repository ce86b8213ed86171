"""Substring, embedding, SimHash and line dedup against brute force."""

import hashlib
import math
import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from corpusloom.llm import components, embeddings, linededup, queries, simhash, substring

SF = "/root/testdata/sf0.001"


class Union(dict):
    def find(self, x):
        self.setdefault(x, x)
        while self[x] != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        if a != b:
            self[max(a, b)] = min(a, b)


# --- substrings ---


def brute_substrings(rows, size=13):
    words = [(i if i is not None else math.inf, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in sorted(words, key=lambda x: x[0]):
        for a in range(len(w) - size + 1):
            first.setdefault(tuple(w[a : a + size]), i)
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for a in range(len(w) - size + 1):
            if first[tuple(w[a : a + size])] < i:
                gone[a : a + size] = [True] * size
        out.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()))
    return sorted(out)


def substrings(df, size=13):
    return sorted((r.doc_id if r.doc_id is not None else math.inf, r.n_words, r.n_removed, r.kept) for r in substring.dedup(df, size=size).collect())


def test_substrings(spark, odd, empty, sample):
    assert substrings(sample[0]) == brute_substrings(sample[1].items())
    assert substrings(odd) == brute_substrings((r.doc_id, r.text) for r in odd.select("doc_id", "text").collect())
    assert substrings(empty) == []
    random.seed(2)
    rows = [(i, " ".join(random.choice("abc") for _ in range(random.randint(0, 60)))) for i in range(150)]
    assert substrings(spark.createDataFrame(rows, "doc_id long, text string")) == brute_substrings(rows)
    assert substrings(spark.createDataFrame(rows, "doc_id long, text string"), size=4) == brute_substrings(rows, 4)


def test_a_passage_that_all_documents_share(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    rows = [(i, f"own{i} " * (i % 9) + passage + f" end{i}") for i in range(400)]
    assert substrings(spark.createDataFrame(rows, "doc_id long, text string")) == brute_substrings(rows)


# --- components ---


def test_components(spark):
    random.seed(1)
    pairs = [(random.randrange(400), random.randrange(400)) for _ in range(260)] + [(1000, k) for k in range(1001, 1700)] + [(k, k + 1) for k in range(3000, 3200)] + [(5, 5), (None, 4)]
    found = Union()
    for a, b in pairs:
        if a is not None and a != b:
            found.join(a, b)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {k: found.find(k) for k in [*found]}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- embeddings ---


def brute_vectors(rows, least=0.98):
    found, degree = Union(), {}
    ok = [(k, i, np.array(v, float), lab) for k, (i, v, lab) in enumerate(rows) if v is not None and lab is not None and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v)]
    for x in range(len(ok)):
        for y in range(x):
            _, i, v, a = ok[x]
            _, j, w, b = ok[y]
            if a == b and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= least:
                found.join(i, j)
                degree[ok[x][0]] = degree.get(ok[x][0], 0) + 1
                degree[ok[y][0]] = degree.get(ok[y][0], 0) + 1
    return sorted((i, degree.get(k, 0), found.find(i)) for k, (i, _, _) in enumerate(rows))


def test_embeddings(spark):
    rng = np.random.default_rng(0)
    centres = rng.standard_normal((12, 32))
    rows = [(i, (centres[i % 12] + rng.standard_normal(32) * rng.choice([0.03, 0.12, 3.0])).tolist(), int(i % 2)) for i in range(500)]
    rows += [(600 + i, rows[0][1], 0) for i in range(150)]  # copies
    rows += [(800, None, 1), (801, [0.0] * 32, 1), (802, [float("nan")] + [1.0] * 31, 1), (803, [None] + [1.0] * 31, 1), (804, rows[0][1], None), (805, [1.0, 2.0], 1), (806, [1.0, 2.0], 1), (807, [float("inf")] * 32, 1), (808, [], 1)]
    df = spark.createDataFrame([(i, v, lab, "x") for i, v, lab in rows], "vec_id long, embedding array<double>, label int, rep string")
    got = embeddings.dedup(df).collect()
    want = brute_vectors(rows)
    pairs = sum(n for _, n, _ in want)
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == want and pairs > 1000
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert embeddings.dedup(df.where("false")).count() == 0


def test_embeddings_of_a_crowded_label(spark):
    rng = np.random.default_rng(3)
    common = rng.standard_normal(32)
    far = 0.8**0.5 * common / np.linalg.norm(common) + 0.2**0.5 * (lambda y: y / np.linalg.norm(y, axis=1, keepdims=True))(rng.standard_normal((6000, 32)))
    other = rng.standard_normal((6000, 32))
    other -= (other * far).sum(axis=1, keepdims=True) * far / (far * far).sum(axis=1, keepdims=True)
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    near = 0.983 * far / np.linalg.norm(far, axis=1, keepdims=True) + math.sqrt(1 - 0.983**2) * other
    x = np.concatenate([far, near])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    want = (x @ x.T >= 0.98).sum() - len(x)
    got = embeddings.dedup(df).collect()
    assert sum(r.n_links for r in got) >= 0.999 * want


def test_windows_reach_over_range_borders(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((2500, 6))
    reps = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "rep long, vec array<double>, label long")
    parts, got = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in (1, 16):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            links = embeddings.candidate_links(reps, 0.98, passes=3, window=16)
            got.append({(r.node, r.component) for r in components.components(links).collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    assert got[0] == got[1] and len(got[0]) > 100


def test_link_counts_of_large_components(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal(16) + rng.standard_normal((300, 16)) * 0.15
    members = spark.createDataFrame([(i, 1, v.tolist(), 1 + i % 3, 0, 300) for i, v in enumerate(x)], "rep long, label long, vec array<double>, weight long, component long, n_members long")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (u @ u.T >= 0.98) & ~np.eye(300, dtype=bool)
    want = {i: int(n) for i, n in enumerate(near @ (1 + np.arange(300) % 3))}
    for block in (64, 1024):
        assert {r.rep: r.n for r in embeddings.link_counts(members, 0.98, block).collect()} == want


# --- SimHash ---


def brute_fingerprint(text, n=3):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_simhash(spark, odd, empty, sample):
    for rows, df in (([*sample[1].items()], sample[0]), ([(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()], odd)):
        fps = [(i, brute_fingerprint(t)) for i, t in rows]
        found = Union()
        for i, a in fps:
            for j, b in fps:
                if i is not None and j is not None and bin(a ^ b).count("1") <= 3:
                    found.join(i, j)
        got = simhash.dedup(df).collect()
        assert sorted((r.doc_id is None, r.doc_id or 0, r.fp % (1 << 64)) for r in got) == sorted((i is None, i or 0, f) for i, f in fps)
        assert all(r.component_id == found.find(r.doc_id) for r in got if r.doc_id is not None)
    assert simhash.dedup(empty).count() == 0


def test_trees_find_all_pairs_in_any_number_of_shards():
    rng = np.random.default_rng(1)
    centres = rng.integers(0, 2**63, 200, dtype=np.uint64)
    points = centres[rng.integers(0, 200, 2000)]
    for _ in range(4):
        points = points ^ np.where(rng.random(2000) < 0.5, np.uint64(1) << rng.integers(0, 64, 2000, dtype=np.uint64), np.uint64(0))
    points = np.unique(points)
    want = Union()
    for i in range(len(points)):
        for j in np.flatnonzero(np.bitwise_count(points ^ points[i]) <= 3).tolist():
            want.join(i, j)
    for shards in (1, 2, 7, 20):
        tree, got = simhash.TopTree(points[::3], shards, 3), Union()
        for _, at, home in tree.route(points):
            for x, y, _ in simhash.pairs_within(points[at], home, 3):
                for i, j in zip(at[x].tolist(), at[y].tolist(), strict=True):
                    got.join(i, j)
        assert all(got.find(i) == want.find(i) for i in range(len(points))), shards


def test_near_copies_by_shingle_sets(spark, odd, sample):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    df, texts = sample
    random.seed(3)
    rows = [(i, t) for i, t in texts.items() if len(t.split()) > 60][:60]
    for i, t in [*rows]:
        w = t.split()
        for _ in range(max(1, len(w) // 120)):
            w[random.randrange(len(w))] = "changed"
        rows.append((10_000 + i, " ".join(w)))
    sets = {i: shingles(t) for i, t in rows}
    kept = {r.doc_id for r in simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    alike = lambda a, b: len(sets[a] & sets[b]) / max(1, len(sets[a] | sets[b])) if sets[a] or sets[b] else 1.0
    found = Union()
    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if alike(a, b) >= 0.8:
                found.join(a, b)
    assert kept == {i for i in ids if found.find(i) == i}
    left = {(r.doc_id, r.text) for r in simhash.drop_near_copies(odd).select("doc_id", "text").collect()}
    assert (9, "same text here") not in left and (8, "same text here") in left and (None, "no id at all") in left


# --- lines ---


def distance_within(a, b, t):
    while a and b and a[0] == b[0]:
        a, b = a[1:], b[1:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    if abs(len(a) - len(b)) > t:
        return t + 1
    if not a or not b:
        return len(a) + len(b)
    return 1 if t == 0 else 1 + min(distance_within(a[1:], b[1:], t - 1), distance_within(a[1:], b, t - 1), distance_within(a, b[1:], t - 1))


def brute_lines(rows, threshold=2):
    """(n_lines, n_near, removed) of each row: (id, text)."""
    key = lambda i, t, p: (i is not None, i or 0, row_hash(t), p)
    places = {}
    for i, t in rows:
        for p, line in enumerate(t.split("\n") if t is not None else []):
            if line.strip(" \t\r"):
                places.setdefault(line, []).append(key(i, t, p))
    first = {line: min(at) for line, at in places.items()}
    allowed = lambda a, b: min(threshold, min(len(a), len(b)) // linededup.CHARS_PER_EDIT)
    near = {a for a in first if any(first[b] < first[a] and abs(len(a) - len(b)) <= (k := allowed(a, b)) and k and distance_within(a, b, k) <= k for b in first if b != a)}
    out = []
    for i, t in rows:
        lines = t.split("\n") if t is not None else []
        gone = [p for p, x in enumerate(lines) if x in first and (x in near or first[x] < key(i, t, p))]
        out.append((i, len(lines), sum(lines[p] in near for p in gone), gone))
    return out


def row_hash(text):
    h = xxhash.xxh64_intdigest((text or "").encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, *r[1:]))


def lines(df, **more):
    return in_order((r.doc_id, r.n_lines, r.n_near, r.removed) for r in linededup.dedup(df, **more).collect())


def cut(rows, **more):
    return in_order((i, "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone) if t is not None else None) for (i, t), (_, _, _, gone) in zip(rows, brute_lines(rows, **more), strict=True))


def test_lines(spark, odd, empty):
    random.seed(7)
    base = ["".join(random.choice("abä ") for _ in range(random.randint(3, 50))) for _ in range(40)]

    def changed(s):
        s = list(s)
        for _ in range(random.randint(0, 3)):
            p = random.randrange(len(s))
            s[p : p + random.randint(0, 1)] = random.choice(["", "x", "😀"])
        return "".join(s)

    rows = [(i if i % 9 else None if i % 2 else 4, "\n".join(changed(random.choice(base)) for _ in range(random.randint(0, 8)))) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for threshold in (1, 2, 3):
        assert lines(df, threshold=threshold) == in_order(brute_lines(rows, threshold)), threshold
    odds = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    assert lines(odd) == in_order(brute_lines(odds))
    assert lines(empty) == []
    got = in_order((r.doc_id, r.text) for r in linededup.clean(df).collect())
    assert got == cut(rows)
    clash = odd.withColumns({"_id": F.lit(1), "removed": F.lit(2), "_removed": F.lit(3), "row": F.lit(4), "first": F.lit(5)})
    assert linededup.clean(clash).columns == clash.columns
    assert in_order((r.doc_id, r.text) for r in linededup.clean(clash).collect()) == cut(odds)


def test_lines_of_rows_that_repeat_an_id_stay_apart(spark):
    rows = [(7, "a line that is a copy\nzzz"), (7, "a line that is its own\nyyy"), (3, "a line that is a copy\nshort dup"), (9, "short dup"), (7, "a line that is its own\nyyy")]
    got = linededup.clean(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert in_order((r.doc_id, r.text) for r in got) == in_order([(7, "zzz"), (7, rows[1][1]), (7, rows[1][1]), (3, rows[2][1]), (9, "")])


def test_a_large_group_of_near_lines(spark):
    random.seed(3)
    base = "".join(random.choice("abcdefgh ") for _ in range(90))
    far = "".join(random.choice("abcdefgh ") for _ in range(90))
    rows = []
    for i in range(5000):
        s = list(base[:45] + far[45:] if i % 5 == 4 else base)
        for _ in range(random.choice([1, 1, 2, 9])):
            s[random.randrange(len(s))] = random.choice("ijklmnop")
        rows.append((i, "".join(s)))
    got = {r.doc_id for r in linededup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).where("size(removed) > 0").collect()}
    codes = np.array([[ord(c) for c in t] for _, t in rows], np.int32)
    want = {i for i in range(1, 5000) if ((codes[:i] != codes[i]).sum(axis=1) <= 2).any()}  # substitutions alone, so that no shift is nearer
    assert got == want and 1000 < len(want) < 4999


def test_queries_hold_their_contracts(spark, sample):
    texts = sample[1]
    kept = {i: k for i, _, _, k in brute_substrings(texts.items())}
    for r in queries.op3_substrings(spark, SF).collect():
        assert r.kept_sha256 == hashlib.sha256(kept[r.doc_id].encode()).hexdigest()
    for r in queries.op6_simhash(spark, SF).collect():
        assert int(r.fingerprint, 16) == brute_fingerprint(texts[r.doc_id]) and len(r.fingerprint) == 16
    want = {i: (n, near, len(gone)) for i, n, near, gone in brute_lines([*texts.items()])}
    assert {r.doc_id: (r.n_lines, r.n_near, r.n_removed) for r in queries.op10_lines(spark, SF).collect()} == want


def near_kept(spark, rows):
    """(ids that drop_near_copies keeps, ids that brute force keeps): five words, 0.8."""
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in ((i, t.split()) for i, t in rows)}
    found = Union()
    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                found.join(a, b)
    got = simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    return {r.doc_id for r in got.collect()}, {i for i in sets if found.find(i) == i}


def test_near_copies_around_the_similarity(spark):
    rng, rows = random.Random(5), []
    for c in range(12):
        text = [f"c{c}w{k}" for k in range(204)]
        for v in range(10):
            w = [*text]
            for p in rng.sample(range(2, 200, 5), rng.randint(2, 5)):  # each changes five shingles of 200
                w[p] = f"v{v}p{p}"
            rows.append((100 * c + v, " ".join(w)))
    got, want = near_kept(spark, rows)
    assert got == want


def test_near_copies_of_few_words(spark):
    rows = []
    for k, words in enumerate([8] * 150 + [16] * 50 + [24] * 30):
        text = " ".join(f"k{k}w{j}" for j in range(words))
        more = " ".join(f"k{k}m{j}" for j in range((words - 4) // 4))
        rows += [(2 * k, text), (2 * k + 1, f"{text} {more}")]
    got, want = near_kept(spark, rows)
    assert got == want and len(want) == len(rows) // 2


def test_the_radius_holds_for_pairs_of_just_the_similarity():
    radii = simhash.wide_radii(0.8)
    rng = np.random.default_rng(4)
    for n, m, both in ((4, 5, 4), (12, 15, 12), (90, 90, 80), (800, 1000, 800)):
        beyond = 0
        for _ in range(300):
            ones = rng.integers(0, 2, (n + m - both, 64 * simhash.WIDE_WORDS))
            x, y = 2 * ones[:n].sum(axis=0) > n, 2 * ones[n - both :].sum(axis=0) > m
            beyond += int((x != y).sum() > (radii[n, m - n] if n <= simhash.MANY else radii[0, 0]))
        assert beyond == 0, (n, m)
