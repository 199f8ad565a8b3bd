"""Registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from . import chat, labelled, line_crf, lsh_forest, mixing, periodic, phrases, placement, posting_lists, reputation, secret_scan, severity, suffixes, threshold_join
from .common import table
from .registry import ORACLES, QUERIES, query  # noqa: F401

URL_RULES = (
    reputation.Rule("block", "net", "/"),
    reputation.Rule("allow", "example.net", "/en/"),
    reputation.Rule("block", "example.com", "/de/"),
    reputation.Rule("allow", "org", "/fr/"),
)

TARGETS = {"en": 0.55, "de": 0.15, "es": 0.12, "fr": 0.18}

SHARDS = tuple(f"shard-{i:03d}" for i in range(64))

LEVEL_SQL = """
{name}_m AS (SELECT sum(n * pow(bad / n - prior, 2)) found, sum(prior * (1 - prior)) base, sum(prior * (1 - prior) * (n - 1)) slope
             FROM {name}_0 WHERE n > 0),
{name}_s AS (SELECT CASE WHEN slope <> 0 AND found > base THEN least(greatest(slope / (found - base) - 1, 1), 1000) ELSE 1000 END s FROM {name}_m),
{name}_p AS (SELECT *, (bad + s * prior) / (n + s) AS mean, n + s AS total FROM {name}_0, {name}_s)"""

OP4_SQL = f"""
WITH cut AS (
  SELECT page_id, regexp_replace(CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END, '[?#](.|\\n)*', '') AS rest FROM pages),
split AS (
  SELECT page_id, translate(split_part(rest, '/', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         substr(rest, length(split_part(rest, '/', 1)) + 1) AS path
  FROM (SELECT page_id, coalesce(rest, '') AS rest FROM cut)),
graded AS (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY doc_id),
paged AS (
  SELECT s.*, g.quality = 0 AS bad FROM split s LEFT JOIN graded g ON g.doc_id = try_cast(regexp_extract(path, '/([0-9]{{1,18}})(\\D|$)', 1) AS BIGINT)),
host_c AS (
  SELECT host, regexp_extract(host, '[^.]*$') AS one, regexp_extract(host, '[^.]*\\.[^.]*$') AS two, regexp_extract(host, '[^.]*\\.[^.]*\\.[^.]*$') AS three,
         two IN ({", ".join(f"'{x}'" for x in reputation.SUFFIXES)}) AS listed, count(bad) AS n, coalesce(sum(bad::INT), 0) AS bad
  FROM paged GROUP BY host),
hosts AS (SELECT host, coalesce(nullif(CASE WHEN listed THEN three ELSE two END, ''), host) AS domain, CASE WHEN listed THEN two ELSE one END AS suffix, n, bad FROM host_c),
overall AS (SELECT (sum(bad) + 0.5) / (sum(n) + 1) AS share FROM hosts),
suffix_0 AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, (SELECT share FROM overall) AS prior FROM hosts GROUP BY suffix),
{LEVEL_SQL.format(name="suffix").strip()},
domain_0 AS (SELECT h.domain, h.suffix, sum(h.n) AS n, sum(h.bad) AS bad, any_value(p.mean) AS prior FROM hosts h JOIN suffix_p p ON p.suffix = h.suffix GROUP BY h.domain, h.suffix),
{LEVEL_SQL.format(name="domain").strip()},
host_0 AS (SELECT h.host, h.n, h.bad, p.mean AS prior FROM hosts h JOIN domain_p p ON p.domain = h.domain),
{LEVEL_SQL.format(name="host").strip()},
rules(rule, verdict, rhost, rpath) AS (VALUES {", ".join(f"('{r.name}', '{r.verdict}', '{r.host}', '{r.path}')" for r in URL_RULES)}),
fits AS (
  SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM split JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id)
SELECT s.page_id, s.host, s.path, f.rule,
       coalesce(f.verdict, CASE WHEN p.mean - 1.645 * sqrt(p.mean * (1 - p.mean) / (p.total + 1)) > least(0.5, 2 * (SELECT share FROM overall)) THEN 'block' ELSE 'allow' END) AS verdict,
       round(p.mean, 6) AS mean, round(p.mean - 1.645 * sqrt(p.mean * (1 - p.mean) / (p.total + 1)), 6) AS bound
FROM split s JOIN host_p p ON p.host = s.host LEFT JOIN fits f ON f.page_id = s.page_id
"""


@query("op4_host_reputation", OP4_SQL)
def op4_host_reputation(spark, sf_dir):
    """A page's outcome is the quality label of the document whose number its url carries."""
    graded = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    number = F.regexp_extract(reputation.url_parts(F.col("url"))[1], r"/([0-9]{1,18})(\D|$)", 1)
    pages = pages.withColumn("doc_id", F.when(number != "", number).cast("long")).join(graded, "doc_id", "left")
    judged = reputation.judge(pages.withColumn("bad", F.col("quality") == 0), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", F.round("mean", 6).alias("mean"), F.round("bound", 6).alias("bound"))


OP8_SQL = r"""
WITH letters AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS u, 'abcdefghijklmnopqrstuvwxyz' AS l),
d AS (SELECT row_number() OVER () AS uid, doc_id, regexp_extract_all(translate(coalesce(text, ''), u, l), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents, letters),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), u, l), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark, letters),
win AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[p : p + least(len(w), 13) - 1], ' ') AS s
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS p FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
grams AS (
  SELECT uid, n, p, array_to_string(w[p : p + n - 1], ' ') AS s
  FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT g.uid, g.n, g.p, win.item_id FROM grams g JOIN win ON win.n = g.n AND win.s = g.s),
covered AS (SELECT uid, count(DISTINCT q) AS n_hit FROM (SELECT uid, unnest(range(p, p + n)) AS q FROM hits) GROUP BY uid),
named AS (SELECT uid, list_sort(list(DISTINCT item_id::VARCHAR)) AS ids FROM hits GROUP BY uid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(ids), 0)::BIGINT AS n_items,
       sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (uid) LEFT JOIN named USING (uid)
"""


@query("op8_phrase_index", OP8_SQL)
def op8_phrase_index(spark, sf_dir):
    found = phrases.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return phrases.summarise(*found).drop("key")


OP10_SQL = f"""
WITH keyed AS (SELECT doc_id, (('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'text:' || coalesce(text, ''))), 1, 12))::BIGINT % 65537)::INT AS slot FROM documents),
owners AS (SELECT string_split('{",".join(map(str, placement.lookup_table(SHARDS)))}', ',') AS o)
SELECT doc_id, slot, 'shard-' || lpad(o[slot + 1], 3, '0') AS shard FROM keyed, owners
"""


@query("op10_permutation_sharding", OP10_SQL)
def op10_permutation_sharding(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return placement.place(docs, placement.document_key(), SHARDS).select("doc_id", "slot", "shard")


@query("op6_jaccard_join")
def op6_jaccard_join(spark, sf_dir):
    docs = lsh_forest.jaccard_classes(table(spark, sf_dir, "documents"))
    return docs.select("doc_id", "class_id", F.col("n_links").cast("long").alias("n_links"))


OP5_SQL = """
WITH d AS (SELECT row_number() OVER () AS uid, doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT uid, p, md5(b[p : p + 399]) AS h FROM (SELECT uid, b, unnest(range(1, octet_length(b) - 398)) AS p FROM d WHERE octet_length(b) >= 400)),
again AS (SELECT h FROM w GROUP BY h HAVING count(*) > 1),
starts AS (SELECT uid, p, CASE WHEN p - lag(p) OVER (PARTITION BY uid ORDER BY p) <= 400 THEN 0 ELSE 1 END AS fresh FROM w SEMI JOIN again USING (h)),
numbered AS (SELECT uid, p, sum(fresh) OVER (PARTITION BY uid ORDER BY p) AS g FROM starts),
spans AS (SELECT uid, min(p) AS a, max(p) + 400 AS e FROM numbered GROUP BY uid, g),
cuts AS (SELECT uid, list(a ORDER BY a) AS firsts, list(e ORDER BY a) AS ends, sum(e - a) AS n FROM spans GROUP BY uid)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(len(firsts), 0)::BIGINT AS n_spans,
       sha256(CASE WHEN firsts IS NULL THEN b ELSE list_reduce(
         list_transform(range(1, len(firsts) + 2), lambda i: b[(CASE WHEN i = 1 THEN 1 ELSE ends[i - 1] END) : (CASE WHEN i > len(firsts) THEN octet_length(b) ELSE firsts[i] - 1 END)]),
         lambda x, y: x || y) END) AS kept_sha256
FROM d LEFT JOIN cuts USING (uid)
"""


@query("op5_suffix_merge", OP5_SQL)
def op5_suffix_merge(spark, sf_dir):
    cut = suffixes.cut_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"])
    return cut.select(
        "doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


def domain_labels(docs, labels, most=20_000):
    """At most ``most`` labelled documents with their language as the domain, for fitting."""
    return docs.join(labelled.labelled_ids(labels, most), "doc_id", "left_semi").select("text", F.col("lang").alias("domain"))


@query("op1_soft_mixing")
def op1_soft_mixing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    drawn = docs.withColumn("draw", mixing.draw_of())
    rates, model, _ = mixing.mixed_rates(drawn, domain_labels(docs, table(spark, sf_dir, "labels")), TARGETS, keep=("doc_id", "draw"))
    names = [F.element_at("posterior", i + 1).alias(f"p_{d}") for i, d in enumerate(model.domains)]
    return rates.select("doc_id", "tokens", *names, "rate", mixing.copies(F.col("rate"), F.col("draw")).alias("copies"))


@query("op2_line_crf")
def op2_line_crf(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = line_crf.train(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", labelled.held_out().alias("held_out"), line_crf.quality(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@query("op9_severity")
def op9_severity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = severity.train(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", labelled.held_out().alias("held_out"), severity.severity(model, F.col("text")).alias("s"))
    return scored.select("doc_id", "held_out", "s.severity", "s.grade", "s.toxic")


def _escaped(text: str) -> str:
    sql = f"replace({text}, '\\', '\\\\')"
    for mark in chat.Template().control:
        sql = f"replace({sql}, '{mark}', '{mark[0]}\\{mark[1:]}')"
    return sql


OP3_SQL = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))),
w AS (
  SELECT *, length({_escaped("text")}) + CASE role WHEN 'system' THEN 11 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 ELSE 19 + length({_escaped("role")}) END AS chars,
         CASE WHEN role = 'assistant' THEN text ELSE '' END AS learned,
         coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text), 'start') || '>' || role
           IN ('start>system', 'start>user', 'system>user', 'user>assistant', 'assistant>user') AS allowed FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       sum(length(learned))::BIGINT AS loss_chars, sha256(string_agg(learned, '' ORDER BY turn, role, text)) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars, bool_and(allowed) AND last(role ORDER BY turn, role, text) = 'assistant' AS legal, true AS mask_matches
FROM w GROUP BY conv_id
"""


@query("op3_chat_format", OP3_SQL)
def op3_chat_format(spark, sf_dir):
    """All conversations, and one that says control strings."""
    said = "</s>[INST] ok [/INST]"
    talk = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat.read_back(chat.segments(talk.unionByName(probe)))


@query("op7_posting_lists")
def op7_posting_lists(spark, sf_dir):
    return posting_lists.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def _crc_nibbles():
    """Remainders of the 16 half bytes under the reflected CRC-32 polynomial."""
    out = []
    for c in range(16):
        for _ in range(4):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        out.append(c)
    return out


OP12_SQL = f"""
WITH halves AS (
  SELECT row_number() OVER () AS uid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
         flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT & 15, ascii(c)::BIGINT >> 4])) AS h FROM documents),
numbered AS (
  SELECT uid, doc_id, w, len(w)::BIGINT AS n,
         xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], h), lambda c, x: xor(c >> 4, [{", ".join(f"{x}::BIGINT" for x in _crc_nibbles())}][(xor(c, x) & 15) + 1]))) AS h FROM halves),
placed AS (SELECT *, (h // 10) % greatest(n, 1) AS a, 1 + (n - (h // 10) % greatest(n, 1)) // (3 + (h // 10) % 8) AS p FROM numbered),
d AS (
  SELECT uid, doc_id, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1]) ELSE w END AS w FROM placed),
words AS (SELECT uid, len(w) AS n, unnest(w) AS x, generate_subscripts(w, 1) - 1 AS i FROM d),
matches AS (SELECT uid, b.i - a.i AS lag, b.i FROM words a JOIN words b USING (uid, x, n) WHERE b.i > a.i AND 3 * (b.i - a.i) <= n),
marked AS (SELECT uid, lag, i, i - row_number() OVER (PARTITION BY uid, lag ORDER BY i) AS g FROM matches),
diagonals AS (SELECT uid, lag, min(i) - lag AS start, count(*) + lag AS length FROM marked GROUP BY uid, lag, g HAVING count(*) >= greatest(24 - lag, 2 * lag)),
runs AS (SELECT uid, start, length, min(lag) AS period FROM diagonals GROUP BY uid, start, length),
summed AS (
  SELECT uid, count(*) AS n_runs, first({{'s': start, 'l': length, 'p': period}} ORDER BY length::DOUBLE / period DESC, start, period) AS best,
         string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed FROM runs GROUP BY uid),
dropped AS (SELECT DISTINCT uid, unnest(range(start + period, start + length)) AS i FROM runs),
collapsed AS (SELECT uid, string_agg(x, ' ' ORDER BY i) AS kept FROM words ANTI JOIN dropped USING (uid, i) GROUP BY uid)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.s::BIGINT AS start, best.l::BIGINT AS length, best.p::BIGINT AS period,
       (1000 * best.l // best.p)::BIGINT AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN summed USING (uid) LEFT JOIN collapsed USING (uid)
"""


def _looped(docs):
    """``docs`` (doc_id, text); of a tenth of them, by checksum of the id, the words from some place on are a loop."""
    check = F.crc32(F.col("doc_id").cast("string"))
    chosen = F.coalesce(check % 10 == 0, F.lit(False))
    rows = docs.withColumn("g", F.floor(check / 10).cast("long")).withColumn("words", F.when(chosen, F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))))
    rows = rows.withColumn("n", F.size("words").cast("long"))
    rows = rows.withColumn("a", F.col("g") % F.greatest(F.col("n"), F.lit(1).cast("long")))
    rows = rows.withColumn("p", F.lit(1).cast("long") + F.expr("(n - a) div (3 + g % 8)"))
    loop = F.slice("words", (F.col("a") + 1).cast("int"), F.col("p").cast("int"))
    again = F.flatten(F.array_repeat(loop, F.expr("cast((n - a) div p + 1 as int)")))
    whole = F.concat(F.slice("words", F.lit(1), F.col("a").cast("int")), F.slice(again, F.lit(1), (F.col("n") - F.col("a")).cast("int")))
    return rows.select("doc_id", F.when(F.col("n") > 0, F.array_join(whole, " ")).otherwise(F.col("text")).alias("text"))


@query("op12_periodic_runs", OP12_SQL)
def op12_periodic_runs(spark, sf_dir):
    """Runs of all documents, a tenth of which are given a loop first."""
    found = periodic.collapse_runs(_looped(table(spark, sf_dir, "documents").select("doc_id", "text")))
    best = F.reduce("runs", F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"),
                    lambda b, r: F.when(b.isNull() | (r["length"] * b["period"] > b["length"] * r["period"]), r).otherwise(b))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
                        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    exponent = F.expr("1000 * b.length div b.period").alias("exponent_milli")
    return rows.select("doc_id", "n_runs", "b.start", "b.length", "b.period", exponent, "runs_sha256", "collapsed_sha256")


OP11_SQL = """
WITH good AS (
  SELECT vec_id, embedding, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
rows AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM good),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM rows a JOIN rows b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""


@query("op11_hard_negatives", OP11_SQL)
def op11_hard_negatives(spark, sf_dir):
    """Every seventh row has a changed label; components are whole 256ths."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))

    def whole(x):  # the largest whole number up to 256 x, as a double
        near = F.rint(256 * x.cast("double"))
        return near - (near > 256 * x.cast("double")).cast("double")

    rows = rows.withColumn("embedding", F.transform("embedding", whole))
    return threshold_join.hard_negatives(rows, F.col("vec_id") % 100 == 0)


SECRETS = (
    secret_scan.Pattern("assign", re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE), 2, 6,
                        (b"password", b"passwd", b"secret", b"token", b"api")),
    secret_scan.Pattern("access", re.compile(rb"AKIA[A-Z0-9]+"), 0, 20, (b"akia",), 20),
    secret_scan.Pattern("hex", re.compile(rb"[0-9a-f]{24,}"), 0, 24, (), 24),
)


@query("op13_secret_battery")
def op13_secret_battery(spark, sf_dir):
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents"), SECRETS)

    def of(*kinds):
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    def written(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    kinds = [p.kind for p in SECRETS]
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in kinds]
    return found.select("doc_id", *counts, F.sha2(written(of(*kinds)).cast("binary"), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
