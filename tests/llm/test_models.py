"""Classifiers, mixing, chat, reputation, sharding and the pipeline on small fixtures."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from tallybook.llm import chat, labelled, line_crf, lsh_forest, mixing, phrases, placement, queries, reputation, severity
from tallybook.llm.common import table
from tallybook.llm.textbatch import pieces

SF_DIR = "/root/testdata/sf0.01"


def arrays(texts):
    return next(iter([(d, o) for _, _, d, o in pieces(pa.array(texts), 1 << 30)]))


# Quality ------------------------------------------------------------------------------------------------------------


def brute_marginals(odds, moves):
    """Marginals of a two-state chain by listing all its paths."""
    n = len(odds)
    total, good = 0.0, np.zeros(n)
    for path in range(2**n):
        y = [(path >> t) & 1 for t in range(n)]
        weight = np.exp(sum(o for o, s in zip(odds, y) if s) + sum(moves[a][b] for a, b in zip(y, y[1:])))
        total += weight
        good += weight * np.array(y)
    return good / total


def test_chain_marginals_match_all_paths():
    rng = np.random.default_rng(1)
    first = np.array([0, 6, 7, 12])
    odds, moves = rng.normal(size=12) * 2, rng.normal(size=(2, 2))
    forward, backward = line_crf.messages(odds, first, moves)
    got = line_crf.sigmoid(forward + backward)
    want = np.concatenate([brute_marginals(odds[a:b], moves) for a, b in zip(first[:-1], first[1:])])
    assert np.allclose(got, want)


def test_lines_of_odd_texts():
    texts = ["", "one line", "a\n\nb\n", "\n", "x" * 100_000, "ÉÀ\nÉÀ"]
    data, offsets = arrays(texts)
    features, size, first = line_crf.line_features(data, offsets)
    assert np.diff(first).tolist() == [1, 1, 4, 2, 1, 2] and len(features) == 11 and np.isfinite(features).all()
    assert size.tolist() == [1, 9, 2, 1, 2, 1, 1, 1, 100_001, 5, 5]
    alone = [line_crf.line_features(*arrays([t]))[0] for t in texts]
    assert np.allclose(np.concatenate(alone), features)


def test_quality_held_out(spark):
    got = {r.doc_id: r for r in queries.QUERIES["op2_line_crf"](spark, "/root/testdata/sf0.1").collect()}
    truth = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    assert len(got) == 10_000 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    unseen = [i for i in truth if got[i].held_out]
    for label in (0, 1):
        of = [i for i in unseen if truth[i] == label]
        assert np.mean([got[i].predicted == label for i in of]) > 0.95


def test_scores_without_labels_and_of_odd_rows(spark, docs_of):
    docs = docs_of([(1, None), (2, ""), (2, ""), (None, "x\ny"), (4, "word " * 50_000)])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for column in (line_crf.quality(line_crf.train(docs, labels), F.col("text")), severity.severity(severity.train(docs, labels), F.col("text"))["severity"]):
        scores = [r[0] for r in docs.select(column).collect()]
        assert len(scores) == 5 and all(np.isfinite(s) for s in scores)
    few = spark.createDataFrame([(2, 1, 0), (4, 0, 1), (None, 0, 1), (9, None, None)], labels.schema)
    assert docs.select(line_crf.quality(line_crf.train(docs, few), F.col("text"))).count() == 5
    assert docs.select(severity.severity(severity.train(docs, few), F.col("text"))).count() == 5


def test_drawing_leaves_out_what_is_held_out(spark, docs_of):
    docs = docs_of([(i, f"t{i}") for i in range(60)])
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    rows, weights = labelled.draw(docs, labels, "quality", 10)
    drawn = [r.doc_id for r in rows.collect()]
    assert len(drawn) == 20 and all(zlib.crc32(str(i).encode()) % 3 != 1 for i in drawn)
    usable = [i for i in range(60) if zlib.crc32(str(i).encode()) % 3 != 1]
    assert weights == {c: sum(i % 2 == c for i in usable) / 10 for c in (0, 1)}


# Severity -----------------------------------------------------------------------------------------------------------


def test_severity_held_out(spark):
    got = {r.doc_id: r for r in queries.QUERIES["op9_severity"](spark, "/root/testdata/sf0.1").collect()}
    truth = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    unseen = [i for i in truth if got[i].held_out]
    assert np.mean([got[i].toxic for i in unseen if truth[i]]) > 0.8
    assert np.mean([got[i].toxic for i in unseen if not truth[i]]) < 0.01
    assert all(0 <= r.severity <= 2 for r in got.values())


def test_ordinal_fit_orders_grades():
    rng = np.random.default_rng(3)
    grade = rng.integers(0, 3, 600)
    rows = [np.unique(np.concatenate([rng.integers(1000, 5000, 20), np.arange(1, 1 + 3 * g)])).astype(np.uint32) for g in grade]
    model = severity.fit(rows, grade, np.ones(600), severity.Fit())
    assert model.cuts[0] < model.cuts[1] and set(model.features[model.weights > 0.3]) <= set(range(1, 7))
    z = np.array([model.weights[np.isin(model.features, r)].sum() for r in rows])
    chance, _ = severity.grade_chances(z, model.cuts)
    assert np.allclose(chance.sum(axis=1), 1) and (chance.argmax(axis=1) == grade).mean() > 0.95


def plain_worth(rows, grade, weight, features, theta, cuts, ridge):
    """Penalised log likelihood of the cumulative-link model, a document at a time."""
    total = -ridge / 2 * sum(t * t for t in theta)
    for r, g, w in zip(rows, grade, weight):
        z = sum(t for f, t in zip(features, theta) if f in r)
        below = [0.0] + [1 / (1 + math.exp(-(c - z))) for c in cuts] + [1.0]
        total += w * math.log(max(below[g + 1] - below[g], 1e-9))
    return total


def test_ordinal_fit_is_the_maximum_of_the_plain_likelihood():
    rng = np.random.default_rng(11)
    grade = rng.integers(0, 3, 240)
    rows = [np.unique(np.concatenate([rng.integers(50, 70, 6), np.flatnonzero(rng.random(8) < 0.15 + 0.3 * g) + 1])).astype(np.uint32) for g in grade]
    weight = np.where(grade == 0, 3.0, 1.0)
    p = severity.Fit()
    model = severity.fit(rows, grade, weight, p)
    held = [set(r.tolist()) for r in rows]
    features, theta, cuts = model.features.tolist(), model.weights.tolist(), model.cuts.tolist()

    def worth(x):
        return plain_worth(held, grade, weight, features, x[: len(theta)], x[len(theta) :], p.ridge)

    best = np.array(theta + cuts)
    top, step = worth(best), 1e-4
    for i in range(len(best)):
        move = np.zeros(len(best))
        move[i] = step
        slope = (worth(best + move) - worth(best - move)) / (2 * step)
        assert abs(slope) < 0.25  # of 400 weighted documents: steps end at a relative gain of 1e-6
    assert all(worth(best + rng.normal(0, 0.1, len(best))) < top for _ in range(20))


# Mixing -------------------------------------------------------------------------------------------------------------


def test_rates_meet_targets_and_are_nonnegative(spark):
    rng = np.random.default_rng(5)
    tokens, chance = rng.integers(0, 500, 400).astype(float), rng.dirichlet([0.3, 0.3, 0.3], 400)
    members = spark.createDataFrame([(float(t), [float(x) for x in c]) for t, c in zip(tokens, chance)], "tokens double, posterior array<double>")
    for targets in ({"a": 0.2, "b": 0.3, "c": 0.5}, {"a": 0.0, "b": 0.05, "c": 0.95}):
        moves = mixing.fit_rates(members, targets)
        rates = np.array([r[0] for r in members.select(mixing.rate(F.col("posterior"), moves)).collect()])
        plain = np.ones(400)
        inverse = np.linalg.pinv((tokens[:, None] * chance).T @ chance)
        aim = np.array(list(targets.values())) * tokens.sum()
        for _ in range(len(moves)):  # the same steps on one machine
            plain = np.maximum(0, plain - chance @ (inverse @ ((plain * tokens) @ chance - aim)))
        assert (rates >= 0).all() and np.allclose(rates, plain)
        got = (rates * tokens) @ chance / tokens.sum()
        shares, met = mixing.reached(members, targets, moves)
        assert np.allclose(list(shares.values()), got) and met == (np.abs(got - np.array(list(targets.values()))).max() <= 1e-6)
        if min(targets.values()):
            assert np.abs(got - np.array(list(targets.values()))).max() < 1e-2
    assert mixing.fit_rates(members.limit(0), {"a": 1.0}) == [] and mixing.reached(members.limit(0), {"a": 1.0}, []) == ({}, False)


def test_rates_are_a_least_squares_optimum(spark):
    """Targets that can be met are met, so the squared error has its least value, zero; and mixed texts share their rate's weight."""
    rng = np.random.default_rng(6)
    tokens = rng.integers(1, 300, 300).astype(float)
    chance = np.concatenate([rng.dirichlet([0.2, 0.2, 0.2], 250), np.full((50, 3), 1 / 3)])
    members = spark.createDataFrame([(float(t), [float(x) for x in c]) for t, c in zip(tokens, chance)], "tokens double, posterior array<double>")
    targets = {"a": 0.25, "b": 0.35, "c": 0.4}
    moves = mixing.fit_rates(members, targets)
    shares, met = mixing.reached(members, targets, moves)
    assert met and np.allclose(list(shares.values()), list(targets.values()), atol=1e-6)
    rates = np.array([r[0] for r in members.select(mixing.rate(F.col("posterior"), moves)).collect()])
    # among all rates that meet the targets, those found stay near 1: no plain least-norm solution cut at zero does better by much
    system = (tokens[:, None] * chance).T
    least = np.linalg.lstsq(system * 1 / np.sqrt(tokens), np.array(list(targets.values())) * tokens.sum() - system @ np.ones(300), rcond=None)[0] / np.sqrt(tokens)
    assert (rates >= 0).all() and (tokens * (rates - 1) ** 2).sum() <= 1.1 * (tokens * least**2).sum() + 1e-6


def test_soft_mixing_of_documents(spark, docs_of):
    out = queries.QUERIES["op1_soft_mixing"](spark, SF_DIR).toPandas()
    assert len(out) == 1000 and np.allclose(out[[f"p_{d}" for d in queries.TARGETS]].sum(axis=1), 1)
    for domain, share in queries.TARGETS.items():
        assert abs((out[f"p_{domain}"] * out.tokens * out.rate).sum() / out.tokens.sum() - share) < 1e-3
    assert ((out.copies - out.rate).abs() < 1).all()
    docs = docs_of([(1, None), (2, ""), (3, "the cat and the dog"), (3, "the cat and the dog"), (None, "le chat")])
    known = spark.createDataFrame([("the dog and the cat", "en"), ("le chien et le chat", "fr"), ("x", "other"), (None, "en"), ("y", None)], "text string, domain string")
    mixed = mixing.resample(docs, known, {"en": 0.3, "fr": 0.7})
    assert mixed.columns == docs.columns and mixing.resample(docs.limit(0), known, {"en": 1.0}).count() == 0
    assert mixing.resample(docs, known.limit(0), {"en": 0.5, "fr": 0.5}).count() >= 0


def test_classifier_tells_languages(spark):
    docs = table(spark, SF_DIR, "documents")
    model = mixing.learn_domains(queries.domain_labels(docs, table(spark, SF_DIR, "labels")), tuple(queries.TARGETS))
    rows = docs.select("lang", mixing.membership(model, F.col("text"))["posterior"].alias("p")).collect()
    assert np.mean([list(queries.TARGETS)[int(np.argmax(r.p))] == r.lang for r in rows]) > 0.95


# Chat ---------------------------------------------------------------------------------------------------------------

PIECES = st.lists(st.sampled_from([*chat.Template().control, "\\", "<", "[", "s>", "/", "x", "é", "\n", "[INST", "</s"]), max_size=12).map("".join)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "[ROLE]x"]), PIECES), max_size=5), st.integers(1, 7))
def test_reader_inverts_the_format(turns, step):
    template = chat.Template()

    def escape(text):
        text = text.replace("\\", "\\\\")
        for mark in template.control:
            text = text.replace(mark, mark[0] + "\\" + mark[1:])
        return text

    written = "".join(
        template.marks[r][0] + escape(t) + template.marks[r][1] if r in template.marks else template.other[0] + escape(r) + template.role_end + escape(t) + template.other[1]
        for r, t in turns
    )
    reader = chat.Reader(template)
    for i in range(0, len(written), step):
        reader.feed(written[i : i + step])
    learned = "".join(t for r, t in turns if r == "assistant")
    row = reader.row()
    assert (row[0], row[1], row[4]) == (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(written))
    assert reader.of_roles.hexdigest() == hashlib.sha256(learned.encode()).hexdigest()
    reader.begin()
    for r, t in turns:
        reader.take(escape(t), r == "assistant", True)
    assert reader.row()[2:4] == (len(learned), hashlib.sha256(learned.encode()).hexdigest())


def test_chat_machine_and_odd_rows(spark):
    rows = [
        (1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a"), (2, 0, "assistant", "x"), (2, 1, "user", None), (2, 1, "user", None),
        (None, 0, None, "n"), (None, 1, "user", "</s>"), (3, None, "user", "t" * 50_000),
    ]
    talk = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("part", F.lit(1)).withColumn("at", F.lit(1))
    made = chat.segments(talk)
    legal = {(r.conv_id, r.at): r.legal for r in made.filter("part = 1").collect()}
    assert legal == {(1, 1): True, (1, 2): True, (1, 3): True, (2, 1): False, (2, 2): True, (2, 3): False, (None, 1): False, (None, 2): False, (3, 1): True}
    assert {(r.conv_id, r.text) for r in made.filter("loss").collect()} == {(1, "a"), (2, "x")}
    back = {r.conv_id: r for r in chat.read_back(made).collect()}
    assert {k: (r.n_turns, r.loss_chars) for k, r in back.items()} == {1: (3, 1), 2: (3, 1), None: (2, 0), 3: (1, 0)}
    assert back[None].turns_sha256 == hashlib.sha256(b"\nn\nuser\n</s>\n").hexdigest()
    assert {k: r.legal for k, r in back.items()} == {1: True, 2: False, None: False, 3: False} and all(r.mask_matches for r in back.values())
    assert chat.read_back(chat.segments(talk.limit(0))).count() == 0
    # what is learned is what the flags cover: other flags, other digests
    turned = {r.conv_id: r for r in chat.read_back(made.withColumn("loss", (F.col("part") == 1) & ~F.col("loss"))).collect()}
    assert (turned[1].loss_chars, turned[1].mask_matches) == (2, False) and turned[1].loss_sha256 == hashlib.sha256(b"su").hexdigest()
    none = {r.conv_id: r for r in chat.read_back(made.withColumn("loss", F.lit(False))).collect()}
    assert (none[1].loss_chars, none[1].mask_matches, none[1].turns_sha256) == (0, False, back[1].turns_sha256) and none[3].mask_matches


# Reputation, sharding -----------------------------------------------------------------------------------------------


def test_urls_rules_and_reputation(spark):
    urls = [None, "", "no scheme/x", "HTTP://A.Example.NET/en/1?q#f", "x://example.net", "http://b.example.com/de/#a?b", "http://c.org/fr/x", "http://d.org?/fr/"]
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)] + [(100 + i, "http://bad.site/x", True) for i in range(60)] + [(200 + i, "http://good.site/x", False) for i in range(60)],
                                  "page_id long, url string, bad boolean").withColumn("host", F.lit("clash")).withColumn("verdict", F.lit("clash"))
    got = {r.page_id: r for r in reputation.judge(pages, queries.URL_RULES).collect()}
    parts = [("", ""), ("", ""), ("", ""), ("a.example.net", "/en/1"), ("example.net", ""), ("b.example.com", "/de/"), ("c.org", "/fr/x"), ("d.org", "")]
    assert [(got[i].host, got[i].path) for i in range(8)] == parts
    assert [got[i].rule for i in range(8)] == [None, None, None, "example.net/en/", None, "example.com/de/", "org/fr/", None]
    assert got[100].verdict == "block" and got[200].verdict == "allow"
    assert got[100].bound > 0.5 > got[200].bound and got[100].mean > got[100].bound
    assert reputation.judge(pages.limit(0), queries.URL_RULES).count() == 0


def test_reputation_blocks_as_in_sql(spark, tmp_path):
    """Hosts that are worse than others are blocked by the posterior bound alone; repeated pages and long urls; listed suffixes."""
    import duckdb

    from oracle_check import compare

    hosts = ["a.bad.com", "b.bad.com", "shop.co.uk", "www.news.co.uk", "x.good.org", "y.good.org", "net", "z.mixed.com", "co.uk"]
    share = {"a.bad.com": 0.9, "b.bad.com": 0.7, "shop.co.uk": 0.6, "z.mixed.com": 0.2}
    rng = np.random.default_rng(3)
    pages, labels = [], []
    for h in hosts:
        for _ in range(40):
            n = len(pages)
            pages.append((n, f"http://{h}/doc/{n}" + "?q" * (5000 if n % 90 == 0 else 0), ""))
            if n % 3:
                labels.append((n, int(rng.random() >= share.get(h, 0.05)), 0))
    pages += [pages[5], pages[5], (None, None, None)]
    for name, rows, schema in (("pages", pages, "page_id long, url string, html string"), ("labels", labels + [labels[0], (None, 1, 0), (4, None, 0)], "doc_id long, quality int, toxic int")):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    con = duckdb.connect()
    for name in ("pages", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    made = queries.QUERIES["op4_host_reputation"](spark, str(tmp_path))
    assert compare(made, con, queries.ORACLES["op4_host_reputation"]) is None
    blocked = {r.host for r in made.filter("verdict = 'block' AND rule IS NULL").collect()}
    assert {"a.bad.com", "b.bad.com"} <= blocked and not blocked & {"x.good.org", "y.good.org"}


def test_lookup_table_by_turns():
    shards, slots = [f"s{i}" for i in range(7)], 101
    table_ = placement.lookup_table(shards, slots)
    counts = Counter(table_)
    assert max(counts.values()) - min(counts.values()) <= 1
    orders = []
    for name in shards:
        digest = hashlib.md5(name.encode()).hexdigest()
        offset, skip = int(digest[:8], 16) % slots, int(digest[8:16], 16) % (slots - 1) + 1
        orders.append([(offset + j * skip) % slots for j in range(slots)])
    owner = {}
    while len(owner) < slots:
        for i, order in enumerate(orders):
            if len(owner) < slots:
                owner[next(s for s in order if s not in owner)] = i
    assert table_ == [owner[s] for s in range(slots)]
    fewer = placement.lookup_table(shards[:-1], slots)
    moved = sum(a != b for a, b in zip(table_, fewer) if a != 6)
    assert moved < 0.3 * slots
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            placement.lookup_table(bad, slots)
    with pytest.raises(ValueError):
        placement.lookup_table(shards, 100)


def test_placement_of_odd_rows(spark, docs_of, tmp_path):
    docs = docs_of([(1, "a"), (1, "a"), (None, "x"), (None, None), (2, "")])
    placed = placement.place(docs, placement.document_key(), ["a", "b"], 11)
    assert placed.count() == 5 and placed.filter("doc_id = 1").select("shard").distinct().count() == 1
    assert set(r.shard for r in placed.collect()) <= {"a", "b"}
    placement.write_shards(placed, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5
    assert placement.place(docs.limit(0), placement.document_key(), ["a"], 11).count() == 0


# Pipeline -----------------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark):
    docs = table(spark, SF_DIR, "documents")
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, SF_DIR)
        assert after.columns == (columns if name != "shard" else [*columns, "slot", "shard"])
        rows = after.collect()
        old = {r.doc_id: r.text for r in before.collect()}
        assert all(old[r.doc_id] == r.text for r in rows)
        if name == "near_duplicates":
            texts = [(r.doc_id, r.text) for r in rows]
            left = lsh_forest.jaccard_classes(after).filter("n_links > 0").count()
            assert left == 0 and len(texts) < len(old)
        if name == "decontaminate":
            assert phrases.summarise(*phrases.search(after, table(spark, SF_DIR, "benchmark"))).filter("contaminated").count() == 0
        before = spark.createDataFrame(rows, after.schema)
    ran = corpus_pipeline.run(spark, SF_DIR)
    assert sorted((r.doc_id, r.shard) for r in ran.collect()) == sorted((r.doc_id, r.shard) for r in rows)


def test_pipeline_without_documents(spark):
    docs = table(spark, SF_DIR, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF_DIR)
    assert docs.count() == 0


def test_pipeline_stages_on_odd_rows(spark):
    """Nulls in any column, empty and very long texts, repeated rows and clashing names: each stage's stated result."""
    small = "/root/testdata/sf0.001"
    docs, bench = table(spark, small, "documents"), table(spark, small, "benchmark")
    phrase = next(r.text for r in bench.orderBy("item_id").collect() if len(phrases_words(r.text)) >= 13)
    long = " ".join(f"word{i} of a long text," for i in range(40000))
    odd = [(None, None, None, None, None), (None, "", None, None, None), (None, "", None, None, None), (10**9, None, "en", None, 0),
           (10**9 + 1, long, "en", "s", len(long)), (10**9 + 2, phrase, None, None, None), (10**9 + 3, phrase + " and a word", "en", "s", 1),
           (10**9 + 4, " .,;", "en", "s", 4), (None, "a short text without an id", None, "s", None), (None, "a short text without an id", None, "s", None)]
    rows = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    names = ("key", "keep", "uid", "score", "rate", "copies", "tokens", "posterior", "label", "domain", "item", "class_id", "n", "m", "slot", "shard")
    rows = rows.withColumns({c: F.lit(c) for c in names})
    rows = spark.createDataFrame(rows.collect(), rows.schema)

    def out_of(name):
        stage = dict(corpus_pipeline.STAGES)[name]
        made = stage(spark, rows, small)
        assert made.columns == rows.columns and stage(spark, rows.limit(0), small).count() == 0
        return made.select("doc_id", "text").collect(), made

    given = Counter((r.doc_id, r.text) for r in rows.collect())
    for name in ("quality", "decontaminate"):
        got = Counter((r.doc_id, r.text) for r in out_of(name)[0])
        assert all(given[k] == n for k, n in got.items())  # equal rows stay or go together
        assert (None, "") not in got if (None, None) not in got else (None, "") in got
        if name == "decontaminate":
            assert not {(10**9 + 2, phrase), (10**9 + 3, phrase + " and a word")} & set(got)
            assert {(None, None), (None, ""), (10**9, None), (10**9 + 1, long), (10**9 + 4, " .,;")} <= set(got)
    got = Counter((r.doc_id, r.text) for r in out_of("near_duplicates")[0])
    assert max(got.values()) == 1 and {(10**9 + 1, long), (10**9 + 4, " .,;"), (10**9, None)} <= set(got)
    assert sum(k[1] == "a short text without an id" for k in got) == 1
    got = Counter((r.doc_id, r.text) for r in out_of("mix")[0])
    assert set(got) <= set(given) and all(n % given[k] == 0 for k, n in got.items())
    placed, made = out_of("shard")
    assert Counter((r.doc_id, r.text) for r in placed) == given
    shards = {}
    for r in made.select("doc_id", "text", "shard", "slot").collect():
        assert shards.setdefault((r.doc_id, r.text), (r.shard, r.slot)) == (r.shard, r.slot) and r.shard != "shard"


def phrases_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())
