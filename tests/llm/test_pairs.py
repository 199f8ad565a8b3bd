"""Near duplicates, repeated strings, phrases and neighbours against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallybook.llm import components, lsh_forest, phrases, posting_lists, suffixes

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def brute_classes(rows, threshold=0.8):
    sets = [shingles(t) for _, t in rows]
    links, parent = [0] * len(rows), list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= threshold:
                links[i] += 1
                links[j] += 1
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return links, [root(i) for i in range(len(rows))]


def near_copies(seed, n, base=3):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    roots = [[rnd.choice(vocabulary) for _ in range(rnd.randint(40, 120))] for _ in range(base)]
    out = []
    for i in range(n):
        text = list(rnd.choice(roots))
        for _ in range(rnd.choice([0, 0, 1, 2, 5])):
            text[rnd.randrange(len(text))] = rnd.choice(vocabulary)
        out.append((i, " ".join(text)))
    return out


@pytest.mark.parametrize("block", [512, 7])
def test_jaccard_join(spark, docs_of, block):
    rows = near_copies(3, 60) + [(100, None), (101, ""), (102, "  .,"), (103, "two words"), (104, "Two WORDS!"), (105, "x " * 3000), (106, "x " * 2500)]
    rows += [(107, rows[0][1])]
    got = {r.doc_id: r for r in lsh_forest.jaccard_classes(docs_of(rows), lsh_forest.Forest(block=block)).collect()}
    links, roots = brute_classes(rows)
    ids = [i for i, _ in rows]
    assert {i: got[i].n_links for i in ids} == dict(zip(ids, links))
    assert {i: got[i].class_id for i in ids} == {i: ids[r] for i, r in zip(ids, roots)}


def test_prefixes_are_shortened_until_the_recall():
    def recall(lengths):
        return 1 - np.prod([1 - 0.8**n for n in lengths])

    lengths = lsh_forest.Forest().shortened({})
    assert recall(lengths) >= 0.9999 and max(lengths) - min(lengths) <= 1
    longer = [n + (i == lengths.index(min(lengths))) for i, n in enumerate(lengths)]
    assert recall(longer) < 0.9999
    crowded = lsh_forest.Forest().shortened({(0, n): 10**6 for n in range(1, 7)} | {(1, n): n for n in range(1, 7)})
    assert crowded[0] == 6 and recall(crowded) >= 0.9999
    with pytest.raises(ValueError):
        lsh_forest.Forest(trees=1).shortened({})


@pytest.mark.parametrize("partitions", [1, 5])
def test_sorted_tries_hold_every_shared_prefix(spark, partitions):
    p = lsh_forest.Forest(trees=2, depth=3)
    rnd = random.Random(partitions)
    paths = {(uid, tree): tuple(rnd.choice([1, 256, 513]) for _ in range(3)) for uid in range(120) for tree in range(2)}
    rows = [(uid, tree, bytearray(np.array(path, ">u2").tobytes())) for (uid, tree), path in paths.items()]
    leaves = spark.createDataFrame(rows, "uid long, tree int, path binary")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    joins = lsh_forest.trie_joins(leaves, p).collect()
    spark.conf.set("spark.sql.shuffle.partitions", before)
    for n in (1, 2, 3):
        group = {k: k for k in paths}

        def root(k):
            while group[k] != k:
                k = group[k]
            return k

        for r in joins:
            if r.levels >= n:
                a, b = (r.uid, r.tree), (r.heads[n - 1], r.tree)
                assert paths[a][:n] == paths[b][:n]
                group[root(a)] = root(b)
        prefixes = {(tree, path[:n]) for (_, tree), path in paths.items()}
        assert len({root(k) for k in paths}) == len(prefixes)


def test_one_of_each_class(spark, docs_of):
    rows = near_copies(5, 40)
    docs = docs_of(rows + [rows[0], (None, rows[1][1]), (None, None), (None, None), (90, None), (91, "")])
    kept = lsh_forest.one_of_each(docs)
    assert kept.columns == docs.columns
    out = [(r.doc_id, r.text) for r in kept.collect()]
    _, roots = brute_classes(rows)
    named = {i for i, t in out if i is not None and t}
    assert named | {1} == {rows[r][0] for r in set(roots)} | {1} and len(out) == len(set(out))
    assert {(None, None), (90, None), (91, "")} <= set(out)
    assert lsh_forest.one_of_each(docs.limit(0)).count() == 0


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7)]
    got = {r.id: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)}


def brute_cover(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in raw for i in range(len(d) - length + 1))
    masks = []
    for d in raw:
        mask = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                mask[i : i + length] = True
        masks.append(mask)
    return masks


@pytest.mark.parametrize("seed,length,broadcast,part", [(1, 40, 0, 7), (2, 48, 1 << 20, 60_000), (3, 64, 0, 60_000), (4, 400, 1 << 20, 20)])
def test_repeated_strings(spark, docs_of, seed, length, broadcast, part):
    """Small tables sent to the tasks or joined by shuffle, few and many parts of the merge."""
    rnd = random.Random(seed)
    base = ["".join(rnd.choice("abcdéß ") for _ in range(rnd.randint(length // 2, 4 * length))) for _ in range(5)] + ["a" * 2 * length]
    texts = [None, "", "short"]
    for _ in range(40):
        text = ""
        for _ in range(rnd.randint(0, 4)):
            x = rnd.choice(base)
            i = rnd.randint(0, len(x))
            text += x[i : rnd.randint(i, len(x))] + "".join(rnd.choice("xyzuvw") for _ in range(rnd.randint(0, 30)))
        texts.append(text)
    texts += texts[-3:] * 2
    docs = docs_of(list(enumerate(texts)))
    got = {r.doc_id: r for r in suffixes.cut_repeats(docs, suffixes.Repeats(length=length, part=part, run=9, broadcast=broadcast)).collect()}
    assert len(got) == len(texts)
    for i, mask in enumerate(brute_cover(texts, length)):
        mine = np.zeros(len(mask), bool)
        for s in got[i].spans:
            assert s.first < s.last
            mine[s.first : s.last] = True
        assert (mine == mask).all(), i
        edges = int(np.diff(np.concatenate([[0], mask.astype(int)])).clip(0).sum())
        assert len(got[i].spans) == edges
        assert bytes(got[i].kept) == bytes(b for b, m in zip((texts[i] or "").encode(), mask) if not m)
    assert suffixes.cut_repeats(docs.limit(0)).count() == 0


def test_runs_merge_in_order():
    rnd = random.Random(0)
    entries = sorted({(bytes(rnd.choice(b"ab") for _ in range(rnd.randint(0, 12))), b"l", bytes(16), False) for _ in range(200)})
    parts = [entries[i::5] for i in range(5)] + [entries[:3]]
    merged = list(suffixes.merge_runs([suffixes.read_run(suffixes.pack_run(p)) for p in parts]))
    assert [m[1] for m in merged] == sorted(e[0] for p in parts for e in p)
    for before, after in zip(merged, merged[1:]):
        assert after[0] == suffixes.lcp(before[1], after[1], 0)


def test_one_passage_in_many_surroundings(spark):
    """Every document holds the passage between words of its own; every span is found, whatever stands around it."""
    passage = "".join(random.Random(0).choices("abcdefgh ", k=450))
    rows = [(i, f"{i * 7919:08d} before {i} {passage} after {i} {i * 104729:08d}") for i in range(10_000)]
    out = suffixes.cut_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(8))
    at, first, last = F.instr("text", passage[:40]) - 1, F.col("spans")[0]["first"], F.col("spans")[0]["last"]
    good = (F.size("spans") == 1) & (first <= at) & (last >= at + 450) & (last - first <= 470) & (F.length("kept") == F.length("text") - last + first)
    assert out.agg(F.count("*"), F.count_if(good)).first()[:] == (10_000, 10_000)


def test_many_spans_in_one_long_text(spark):
    """A long text of many repeated passages is cut in linear time, and intermediates of the run are gone."""
    rnd = random.Random(1)
    passages = ["".join(rnd.choice("abcdefgh ß") for _ in range(300)) for _ in range(60)]
    text = "".join(rnd.choice(passages) + "".join(rnd.choice("XYZ") for _ in range(12)) for _ in range(4000))
    (row,) = suffixes.cut_repeats(spark.createDataFrame([(1, text)], "doc_id long, text string"), suffixes.Repeats(length=200)).collect()
    raw, kept, at = text.encode(), b"", 0
    for s in row["spans"]:
        kept += raw[at : s["first"]]
        at = s["last"]
    assert len(row["spans"]) > 1000 and bytes(row["kept"]) == kept + raw[at:]


def brute_hits(text, items, window=13):
    w = words(text)
    hit, found = set(), set()
    for item, t in items:
        v = words(t)
        n = min(window, len(v))
        grams = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if v else set()
        for i in range(len(w) - n + 1 if v else 0):
            if tuple(w[i : i + n]) in grams:
                hit |= set(range(i, i + n))
                found.add(item)
    return len(w), len(hit), len(found)


def test_phrases(spark, docs_of):
    rnd = random.Random(8)
    vocabulary = [f"t{i}" for i in range(12)]
    items = [(i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.choice([1, 2, 5, 13, 14, 20])))) for i in range(12)]
    items += [(50, None), (51, ""), (52, "the the the the the the the the the the the the the the the"), (0, items[0][1])]
    rows = [(1, None), (2, ""), (3, "THE " * 40), (None, items[3][1]), (5, items[4][1])]
    for i in range(30):
        parts = []
        for _ in range(3):
            parts += [rnd.choice(vocabulary) for _ in range(rnd.randint(0, 9))] + [rnd.choice(items)[1] or "zz"]
        rows.append((10 + i, " ".join(parts)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r.n_words, r.n_hit, r.n_items) for r in phrases.summarise(*phrases.search(docs_of(rows), bench)).collect())
    assert got == sorted(brute_hits(t, [x for x in items if x[1]]) for _, t in rows)
    assert phrases.summarise(*phrases.search(docs_of(rows).limit(0), bench)).count() == 0
    none = phrases.summarise(*phrases.search(docs_of(rows), bench.limit(0))).agg(F.sum("n_hit")).first()[0]
    assert none == 0


def test_phrases_of_repeated_rows_and_long_texts(spark, docs_of):
    item = " ".join(f"w{i}" for i in range(14))
    long = " ".join(f"filler{i % 977}" for i in range(60000))
    rows = [(1, f"{long} {item} {long}"), (2, item), (2, item), (None, item.upper()), (None, None), (3, f"{item} {item}"), (4, " ".join(item.split()[:12]))]
    bench = spark.createDataFrame([("b", item), ("b", item), ("c", item), (None, item), ("d", None), ("e", "")], "item_id string, text string")
    got = sorted(((r.doc_id or 0, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in phrases.summarise(*phrases.search(docs_of(rows), bench)).collect()))
    assert got == [(0, 0, 0, 0, False), (0, 14, 14, 2, True), (1, 120014, 14, 2, False), (2, 14, 14, 2, True), (2, 14, 14, 2, True), (3, 28, 28, 2, True), (4, 12, 0, 0, False)]


def test_proximity(spark, docs_of):
    items = spark.createDataFrame([(1, "red fox"), (2, "blue blue whale")], "item_id long, text string")
    docs = docs_of([(1, "the red and quick fox"), (2, "fox " + "pad " * 9 + "red"), (3, "a whale so blue"), (4, None)])
    got = sorted((r.doc_id, r.item_id, r.first, r.last) for r in phrases.proximity(docs, items, within=5).collect())
    assert got == [(1, 1, 1, 4), (3, 2, 1, 3)]


@pytest.mark.parametrize("kind", ["clusters", "even"])
def test_centroid_graph_finds_what_a_scan_finds(kind):
    """Nearest centroid found for 95 % or more of the vectors, with fewer distances than a scan of all centroids."""
    rng = np.random.default_rng(5)
    dim, n = (32, 3000) if kind == "clusters" else (8, 3000)
    middles = rng.normal(0, 1, (60, dim))
    make = (lambda m: middles[rng.integers(0, 60, m)] + rng.normal(0, 0.4, (m, dim))) if kind == "clusters" else (lambda m: rng.normal(0, 1, (m, dim)))
    centroids, vectors = make(n), make(500)
    graph = posting_lists.build_graph(centroids, 24, rng)
    counted = []
    ids, d = posting_lists.search_graph(graph, vectors, 32, counted)
    exact = np.sqrt(posting_lists.squared(vectors, centroids))
    assert (ids[:, 0] == exact.argmin(axis=1)).mean() >= 0.95
    assert sum(counted) < 0.5 * exact.size
    assert all(len(set(r.tolist())) == 32 for r in ids) and np.allclose(d, np.take_along_axis(exact, ids, axis=1))
    assert (np.diff(d, axis=1) >= 0).all()


def brute_nearest(rows, k=10):
    points = {i: np.array(v, np.float64) for i, v in rows if v is not None and None not in v and np.isfinite(v).all() and np.any(v) and len(v) == 8}
    ids = np.array(sorted(points))
    x = np.array([points[i] for i in ids])
    out = {}
    for i in ids[ids % 100 == 0]:
        d = np.sqrt(((x - points[i]) ** 2).sum(axis=1))
        d[ids == i] = np.inf
        out[i] = [(int(ids[j]), d[j]) for j in np.lexsort((ids, d))[:k] if np.isfinite(d[j])]
    return out


@pytest.mark.parametrize("block", [50, 3])
def test_neighbours(spark, block):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 8)) * 3
    rows = [(i, [float(np.float32(v)) for v in centres[i % 6] + rng.normal(size=8)]) for i in range(3000)]
    rows += [(i, rows[0][1]) for i in range(3000, 4100)]  # one very common vector
    rows += [(5000, None), (5100, [0.0] * 8), (5200, [float("nan")] * 8), (5300, [1.0] * 7 + [None]), (5400, [1.0] * 3), (5500, [float("inf")] * 8)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("vid", F.lit(1)).withColumn("list", F.lit(2))
    got = {}
    for r in posting_lists.nearest(vectors, F.col("vec_id") % 100 == 0, p=posting_lists.Lists(list_size=100, block=block)).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = brute_nearest(rows)
    assert set(got) == set(want)
    hits = 0
    for q, near in got.items():
        near.sort()
        assert [r for r, _, _ in near] == list(range(1, 11)) and all(v != q for _, v, _ in near)
        assert [(s, v) for _, v, s in near] == sorted((s, v) for _, v, s in near)
        hits += len({v for _, v, _ in near} & {v for v, _ in want[q]})
    assert hits >= 0.9 * 10 * len(want)
    few = spark.createDataFrame(rows[:4], vectors.drop("vid", "list").schema)
    assert [(r.query_id, r.rank) for r in posting_lists.nearest(few, F.col("vec_id") == 0).orderBy("rank").collect()] == [(0, 1), (0, 2), (0, 3)]
    assert posting_lists.nearest(few.limit(0), F.col("vec_id") == 0).count() == 0
