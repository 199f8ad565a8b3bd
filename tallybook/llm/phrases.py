"""Exact phrase and proximity search of test items in a corpus through a positional inverted index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import lower_ascii, sized, stored

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LENGTH = ""  # the posting under this term, which no word can equal, holds a document's number of words as its position


def words(text: Column) -> Column:
    """Words of a text after lower-casing A-Z; null has none."""
    return F.coalesce(F.regexp_extract_all(lower_ascii(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def item_terms(items: DataFrame) -> DataFrame:
    """(item, item_id, n_item, ipos, term) of every word of the distinct items; ``item`` names an id and text together."""
    distinct = items.select("item_id", F.coalesce("text", F.lit("")).alias("text")).distinct()
    split = distinct.select(F.md5(F.concat_ws("\n", F.coalesce(F.col("item_id").cast("string"), F.lit("null")), "text")).alias("item"), "item_id", words(F.col("text")).alias("words"))
    return split.select("item", "item_id", F.size("words").alias("n_item"), F.posexplode("words").alias("ipos", "term"))


def vocabulary_of(terms: DataFrame) -> DataFrame:
    """The distinct words of all items and ``LENGTH``, marked for broadcast if their number allows."""
    ends = terms.sparkSession.range(1).select(F.lit(LENGTH).alias("term"))
    return sized(stored(terms.select("term").distinct().union(ends), "vocabulary"), 128)


def positional_index(docs: DataFrame, vocabulary: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Stored postings (uid, term, pos) of the words in ``vocabulary`` (of ``vocabulary_of``), and one ``LENGTH`` posting a document with its id.

    Documents meet the vocabulary where they are read, so words outside it are never moved. The index is written once;
    ``uid`` tells documents with equal or null ids apart.
    """
    keyed = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("doc_id"), words(F.col("text")).alias("words"), F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("key"))
    flat = keyed.select("uid", "doc_id", "key", F.posexplode(F.concat("words", F.array(F.lit(LENGTH)))).alias("pos", "term"))
    known = flat.join(vocabulary, "term", "left_semi")
    ends = F.col("term") == LENGTH
    return stored(known.select("uid", "term", "pos", F.when(ends, F.col("doc_id")).alias("doc_id"), F.when(ends, F.col("key")).alias("key")), "postings")


def rarest_terms(terms: DataFrame, index: DataFrame, window: int) -> DataFrame:
    """Item words to search first: in every window its two rarest positions, by the number of corpus postings.

    A window of one word has one. (item, ipos, term, n_item, best): best marks the rarest of some window.
    """
    counts = index.groupBy("term").agg(F.count("*").alias("df"))
    known = terms.join(counts, "term", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    order = Window.partitionBy("item").orderBy("ipos")
    span = order.rowsBetween(0, window - 1)
    one = known.withColumn("first", F.min(F.struct("df", "ipos")).over(span))
    listed = one.withColumn("ranked", F.array_sort(F.collect_list(F.struct("df", "ipos")).over(span)))
    starts = listed.filter(F.col("ipos") <= F.greatest(F.col("n_item") - window, F.lit(0)))
    picked = starts.select("item", F.posexplode(F.slice("ranked", 1, 2)).alias("rank", "pick"))
    picked = picked.groupBy("item", F.col("pick.ipos").alias("ipos")).agg((F.min("rank") == 0).alias("best"))
    return terms.join(picked, ["item", "ipos"]).select("item", "ipos", "term", "n_item", "best")


def alignments(index: DataFrame, anchors: DataFrame, window: int) -> DataFrame:
    """(item, uid, start): where an item would begin in a document, if its rarest words stand at the right distance.

    Lists of the searched words are shifted by their position in the item and intersected: an alignment needs two of
    them within a window, one for items of one word.
    """
    lists = index.join(anchors, "term").select("item", "uid", (F.col("pos") - F.col("ipos")).alias("start"), "ipos", "n_item", "best")
    near = lists.groupBy("item", "uid", "start").agg(
        F.count("*").alias("hits"), F.max("best").alias("best"), F.min("n_item").alias("n_item")
    )
    return near.filter(F.col("best") & ((F.col("hits") >= 2) | (F.col("n_item") == 1))).select("item", "uid", "start")


def phrase_runs(index: DataFrame, terms: DataFrame, found: DataFrame, window: int) -> DataFrame:
    """(uid, item, first, last): maximal runs of document words that equal item words in order and hold a window.

    All offset-adjusted lists of the aligned items are intersected: the expected (document, word, position) triples
    meet the stored postings, and consecutive matches are joined to runs.
    """
    expected = found.join(terms, "item").select("item", "uid", "start", "ipos", "n_item", "term", (F.col("start") + F.col("ipos")).alias("pos"))
    there = index.filter(F.col("term") != LENGTH).select("uid", "term", "pos")
    there = there.join(sized(found.select("uid").distinct(), 64), "uid", "left_semi")
    matched = expected.join(there, ["uid", "pos", "term"])
    order = Window.partitionBy("uid", "item", "start").orderBy("ipos")
    runs = matched.withColumn("island", F.col("ipos") - F.row_number().over(order)).groupBy("uid", "item", "start", "island")
    runs = runs.agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.first("n_item").alias("n_item"))
    return runs.filter(F.col("last") - F.col("first") + 1 >= F.least(F.lit(window), F.col("n_item"))).select("uid", "item", "first", "last")


def search(docs: DataFrame, items: DataFrame, window: int = 13, id_col: str = "doc_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, runs, items): every document's length, all phrase runs, and the item names, for ``summarise``.

    Exact: a window of ``window`` consecutive item words (the whole item, if shorter) occurs in a document if and only
    if a run covers it. Null texts have no words; items without words are never found; equal items count once.
    """
    terms = stored(item_terms(items), "terms")
    index = positional_index(docs, vocabulary_of(terms), id_col)
    anchors = stored(rarest_terms(terms, index, window), "anchors")
    found = stored(alignments(index, sized(anchors, 128), window), "alignments")
    runs = stored(phrase_runs(index, terms, found, window), "runs")
    lengths = index.filter(F.col("term") == LENGTH).select("uid", "doc_id", "key", F.col("pos").cast("long").alias("n_words"))
    return lengths, runs, terms.select("item", "item_id").distinct()


def summarise(lengths: DataFrame, runs: DataFrame, names: DataFrame) -> DataFrame:
    """Per document: doc_id, key, n_words, n_hit (words inside a window), n_items, items_sha256, contaminated.

    Contaminated: words are hit, and they are a twentieth of the document at least.
    """
    hit = runs.select("uid", F.explode(F.sequence("first", "last")).alias("pos")).distinct().groupBy("uid").agg(F.count("*").alias("n_hit"))
    ids = runs.select("uid", "item").distinct().join(names, "item").groupBy("uid").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("ids"))
    joined = lengths.join(hit.join(ids, "uid"), "uid", "left")
    n_hit, listed = F.coalesce("n_hit", F.lit(0)).cast("long"), F.coalesce("ids", F.array().cast("array<string>"))
    return joined.select(
        "doc_id", "key", "n_words", n_hit.alias("n_hit"), F.size(listed).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", listed), 256).alias("items_sha256"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def proximity(docs: DataFrame, items: DataFrame, within: int, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, item_id, first, last): document spans of at most ``within`` words that hold every distinct word of an item.

    Per document and item the postings of the item's words are walked in order; a span ends at each posting and begins
    at the latest earlier posting by which all words have been seen. Items longer than ``within`` are never found.
    """
    terms = stored(item_terms(items), "terms")
    distinct = terms.select("item", "item_id", "term").distinct()
    needed = distinct.groupBy("item").agg(F.count("*").alias("needed"))
    index = positional_index(docs, vocabulary_of(distinct), id_col)
    rare = index.groupBy("term").agg(F.count("*").alias("df"))
    first_term = distinct.join(rare, "term").groupBy("item").agg(F.min_by("term", F.struct("df", "term")).alias("term"))
    pairs = index.join(first_term, "term").select("uid", "item").distinct()
    lists = pairs.join(distinct, "item").join(index.select("uid", "term", "pos"), ["uid", "term"]).join(needed, "item")
    near = Window.partitionBy("uid", "item").orderBy("pos").rangeBetween(-(within - 1), 0)
    seen = lists.withColumn("last_of", F.collect_list(F.struct("pos", "term")).over(near)).withColumn("terms", F.size(F.array_distinct(F.transform("last_of", lambda x: x["term"]))))
    spans = seen.filter(F.col("terms") == F.col("needed"))
    latest = F.array_min(F.transform(F.array_distinct(F.transform("last_of", lambda x: x["term"])), lambda t: F.array_max(F.transform(F.filter("last_of", lambda x: x["term"] == t), lambda x: x["pos"]))))
    lengths = index.filter(F.col("term") == LENGTH).select("uid", "doc_id")
    return spans.select("uid", "item_id", latest.alias("first"), F.col("pos").alias("last")).join(lengths, "uid").select("doc_id", "item_id", "first", "last")
