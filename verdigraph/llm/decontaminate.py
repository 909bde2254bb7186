"""Benchmark decontamination by a distributed positional inverted index. DataFrame functions only.

The index holds one posting (row, term, position) for each training word that a benchmark item has.
A phrase is found by intersecting offset-adjusted posting lists, from its rarest term on: a posting at
position p of the term at offset o says that the phrase could start at p - o. The lists of the other
terms then confirm or reject those starts, exactly (phrase) or up to ``slop`` words off (proximity).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verdigraph.runtime import discard, durable, table

WINDOW = 13
#: A document is contaminated from one hit word in this many on.
ONE_IN = 20
#: Rows up to which a side is broadcast; it is counted first, and joined by shuffle beyond.
BROADCAST_ROWS = 200_000
#: The same for rows of two numbers.
BROADCAST_MARKS = 1_000_000

WORD = r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Stands after the last word of every document in the index; no word is empty.
END = ""


def words(text: Column) -> Column:
    """Lower-cased (A-Z only) words of a text; none for null."""
    text = F.coalesce(text, F.lit(""))
    # Where every character is one byte, lower() changes A-Z only, and faster.
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))
    return F.regexp_extract_all(low, F.lit(WORD), F.lit(1))


def _small(df: DataFrame, count: int) -> DataFrame:
    return F.broadcast(df) if count <= BROADCAST_ROWS else df


@dataclass
class Phrases:
    """Distinct windows of the items: terms (wid, off, term, len) and items (wid, item)."""

    terms: DataFrame
    items: DataFrame
    vocabulary: DataFrame
    #: Tables to delete when the matches are no longer read.
    written: list[DataFrame] = field(default_factory=list)

    @staticmethod
    def of(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> Phrases:
        """Every run of ``window`` words of an item; an item with fewer, but not none, is one window."""
        w = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), words(F.col(text_col)).alias("words")).where(F.size("words") > 0)
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - window + 1))
        cut = w.select("item", F.explode(F.transform(starts, lambda s: F.slice("words", s, window))).alias("phrase"))
        cut = durable(cut.select(F.xxhash64("phrase").alias("wid"), "item", "phrase"), "phrases")
        terms = cut.select("wid", "phrase").dropDuplicates(["wid"]).select("wid", F.size("phrase").alias("len"), F.posexplode("phrase").alias("off", "word"))
        vocabulary = durable(terms.select("word").distinct().select("word", F.xxhash64("word").alias("term")), "vocabulary")
        return Phrases(terms.select("wid", "off", "len", F.xxhash64("word").alias("term")), cut.select("wid", "item").distinct(), vocabulary, [cut])


def build_index(docs: DataFrame, vocabulary: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row long, doc_id, term long, pos int): a posting for each word in ``vocabulary``.

    ``row`` tells rows apart, also those with equal or null ids; it is fixed as the index is written.
    One posting more a document, with a null term, has its number of words as position.
    """
    end = docs.sparkSession.createDataFrame([(END, None)], "word string, term long")
    known = vocabulary.unionByName(end)
    each = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), words(F.col(text_col)).alias("words"))
    each = each.select("row", "doc_id", F.posexplode(F.array_append("words", F.lit(END))).alias("pos", "word"))
    return durable(each.join(_small(known, vocabulary.count()), "word").select("row", "doc_id", "term", "pos"), "postings")


def _confirm(starts: DataFrame, terms: DataFrame, postings: DataFrame, slop: int) -> DataFrame:
    """The (row, wid, start) at which every one of ``terms`` (wid, off, term, need) has a posting."""
    wanted = starts.join(terms, "wid").select("row", "wid", "start", "off", "term", "need", (F.col("start") + F.col("off")).alias("pos"))
    if slop:
        wanted = wanted.withColumn("pos", F.explode(F.sequence(F.col("pos") - slop, F.col("pos") + slop)))
    met = wanted.join(postings, ["row", "term", "pos"])
    if slop:
        met = met.select("row", "wid", "start", "off", "need").distinct()
    return met.groupBy("row", "wid", "start", "need").agg(F.count(F.lit(1)).alias("n")).where("n = need").select("row", "wid", "start")


def matches(index: DataFrame, phrases: Phrases, slop: int = 0) -> DataFrame:
    """(row, wid, start, len): every place where a phrase occurs.

    With ``slop`` 0 these are the exact phrases. Otherwise each term but the rarest, which fixes the
    start, may stand up to ``slop`` words from its place in the phrase (proximity).
    """
    postings = index.where(F.col("term").isNotNull()).select("row", "term", "pos")
    counts = postings.groupBy("term").agg(F.count(F.lit(1)).alias("found"))
    by_wid = Window.partitionBy("wid")
    ranked = phrases.terms.join(counts, "term").withColumn("rank", F.row_number().over(by_wid.orderBy("found", "off"))).withColumn("have", F.count(F.lit(1)).over(by_wid))
    ranked = durable(ranked.where("have = len").drop("have"), "ranked")  # a term without postings rules its phrases out
    phrases.written.append(ranked)
    rarest = ranked.where("rank = 1").select("wid", "term", "off")
    n_phrases = rarest.count()
    starts = postings.join(_small(rarest, n_phrases), "term").select("row", "wid", (F.col("pos") - F.col("off")).alias("start")).where(F.col("start") >= -slop)
    second = ranked.where("rank = 2").select("wid", "off", "term", F.lit(1).alias("need"))
    alone = ranked.where("len = 1").select("wid")
    if slop:
        starts = durable(starts, "starts")
    else:
        # The two rarest lists, both short, meet first.
        other = postings.join(_small(second, n_phrases), "term").select("row", "wid", (F.col("pos") - F.col("off")).alias("start"))
        starts = durable(starts.join(other, ["row", "wid", "start"]).unionByName(starts.join(_small(alone, n_phrases), "wid", "left_semi")), "starts")
    phrases.written.append(starts)
    rest = ranked.where("rank > 1" if slop else "rank > 2").select("wid", "off", "term", (F.col("len") - (1 if slop else 2)).alias("need"))
    rows = durable(starts.select("row").distinct(), "rows")
    phrases.written.append(rows)
    few = postings.join(_small(rows, rows.count()), "row", "left_semi")
    lengths = ranked.select("wid", "len").distinct()
    whole = lengths.where("len = 1" if slop else "len <= 2").select("wid")
    met = _confirm(starts, rest, few, slop).unionByName(starts.join(whole, "wid", "left_semi"))
    return met.distinct().join(lengths, "wid").select("row", "wid", "start", "len")


def documents_hit(index: DataFrame, phrases: Phrases, found: DataFrame) -> DataFrame:
    """One line a document row: row, doc_id, n_words, n_hit, n_items, items array<string>, contaminated."""
    found = durable(found, "matches")
    phrases.written.append(found)
    before = Window.partitionBy("row").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    spans = found.groupBy("row", "start").agg(F.max(F.col("start") + F.col("len")).alias("stop"))
    spans = spans.withColumn("reached", F.coalesce(F.max("stop").over(before), F.lit(0)))
    hit = spans.groupBy("row").agg(F.sum(F.greatest(F.lit(0), F.col("stop") - F.greatest("start", "reached"))).alias("n_hit"))
    items = found.select("row", "wid").distinct().join(phrases.items, "wid").groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    every = index.where(F.col("term").isNull()).select("row", "doc_id", F.col("pos").cast("long").alias("n_words"))
    out = every.join(hit, "row", "left").join(items, "row", "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    listed = F.coalesce("items", F.array().cast("array<string>"))
    return out.select("row", "doc_id", "n_words", n_hit.alias("n_hit"), F.size(listed).cast("long").alias("n_items"), listed.alias("items"), ((n_hit > 0) & (ONE_IN * n_hit >= F.col("n_words"))).alias("contaminated"))


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``documents_hit`` for ``docs`` (doc_id, text) against ``items`` (item_id, text).

    Null and empty texts have no words and are never hit; items without words have no windows; equal
    items both count; a null item_id is listed as the empty string; repeated rows stay apart. Without
    items or documents the columns are the same, with no hits or no rows.
    """
    phrases = Phrases.of(items)
    index = build_index(docs, phrases.vocabulary)
    return documents_hit(index, phrases, matches(index, phrases))


def keep_clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that are not contaminated.

    A row is told by its doc_id and text together (128 bits), so repeated rows share one fate; a null id
    or text counts as an empty one.
    """
    phrases = Phrases.of(items)
    known = F.coalesce(docs["doc_id"].cast("string"), F.lit("")), F.coalesce(docs["text"], F.lit(""))
    mark = F.struct(F.xxhash64(*known).alias("h"), F.xxhash64(F.lit(1), *known).alias("i"))
    index = build_index(docs.select(mark.alias("doc_id"), "text"), phrases.vocabulary)
    found = matches(index, phrases)
    hit = documents_hit(index, phrases, found).where("contaminated")
    dirty = durable(hit.select(F.col("doc_id.h").alias("h"), F.col("doc_id.i").alias("i")).distinct(), "contaminated")
    # Sent whole where it is small enough: else every text would move for the few that go.
    sent = F.broadcast(dirty) if dirty.count() <= BROADCAST_MARKS else dirty
    for df in (index, phrases.vocabulary, *phrases.written):
        discard(df)
    return docs.join(sent, (mark["h"] == dirty["h"]) & (mark["i"] == dirty["i"]), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


ORACLE = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '{WORD[1:-1]}') AS w FROM documents
), b AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '{WORD[1:-1]}') AS w FROM benchmark
), bs AS (
  SELECT item, w, unnest(range(1, greatest(1, len(w) - {WINDOW - 1}) + 1)) AS s FROM b WHERE len(w) > 0
), win AS (
  SELECT DISTINCT item, least({WINDOW}, len(w)) AS n, array_to_string(list_slice(w, s, s + {WINDOW - 1}), ' ') AS k FROM bs
), lens AS (
  SELECT DISTINCT n FROM win
), ds AS (
  SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, lens WHERE len(w) >= n
), occ AS (
  SELECT DISTINCT rid, s, win.n AS n, item FROM (SELECT rid, n, s, array_to_string(list_slice(w, s, s + n - 1), ' ') AS k FROM ds) x JOIN win ON x.n = win.n AND x.k = win.k
), hit AS (
  SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(s, s + n)) AS p FROM occ) GROUP BY rid
), it AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM occ) GROUP BY rid
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND {ONE_IN} * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN it USING (rid)
"""
