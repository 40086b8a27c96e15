"""Benchmark decontamination over a positional inverted index, in DataFrame expressions only.

1. The corpus frequency of every benchmark term is counted (map-side combined).
2. Each window of an item names its two rarest terms as anchors; a window with
   a term the corpus lacks can't occur and is dropped.
3. Postings (term, document, position) of the anchor terms are stored.
4. Postings meet the item positions of their term; the difference of the two
   positions is the alignment. Lists are intersected by grouping on (document,
   item, alignment): a window survives where both its anchors are present.
5. Survivors are compared word by word with the document.

A third of the documents may hold one passage: its anchors then give a handful
of rows for each such document, and no pair of documents is ever formed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import lower_ascii, materialize

#: What stands between words; splitting at it costs an eighth of collecting the words as matches.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Terms, anchors or alignments that are broadcast; more are shuffled.
BROADCAST_ROWS = 100_000


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), GAP, -1), "")


def _small(df: DataFrame, bound: int) -> DataFrame:
    return F.broadcast(df) if df.limit(bound + 1).count() <= bound else df


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """_d and _h identify a text; rows that repeat both are the same document and get the same answer. _row: the row itself."""
    return docs.select(F.col(doc_id).alias("_d"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_h"), words_of(F.col(text)).alias("_w"), F.struct(*docs.columns).alias("_row"))


def item_table(items: DataFrame, item_id: str = "item_id", text: str = "text", n: int = 10) -> DataFrame:
    """(iid, item_id, words, starts, len): an item of fewer than ``n`` words is one window; one without words is left out."""
    w = items.select(F.col(item_id).alias("item_id"), words_of(F.col(text)).alias("words")).distinct().filter(F.size("words") > 0)
    w = w.withColumn("len", F.least(F.lit(n), F.size("words"))).withColumn("starts", F.sequence(F.lit(0), F.size("words") - F.col("len")))
    return materialize(w.withColumn("iid", F.monotonically_increasing_id()), "items")


def postings(docs: DataFrame, terms: DataFrame, doc_id: str = "doc_id", text: str = "text", bound: int = BROADCAST_ROWS) -> DataFrame:
    """Stored positional postings (term, _d, _h, pos) of the given terms."""
    # The words are given to posexplode as an expression: as a column Spark would compute them again to filter empty arrays.
    tokens = docs.select(F.col(doc_id).alias("_d"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_h"), F.posexplode(words_of(F.col(text))).alias("pos", "term"))
    return materialize(tokens.join(_small(terms, bound), "term", "left_semi"), "postings")


def term_counts(docs: DataFrame, terms: DataFrame, text: str = "text", bound: int = BROADCAST_ROWS) -> DataFrame:
    tokens = docs.select(F.explode(words_of(F.col(text))).alias("term")).join(_small(terms, bound), "term", "left_semi")
    return materialize(tokens.groupBy("term").agg(F.count(F.lit(1)).alias("n")), "term-counts")


def _planned(items: DataFrame, counts: DataFrame) -> DataFrame:
    """(iid, wins): the windows that can occur, each with the item positions of its two rarest terms."""
    at = items.select("iid", F.posexplode("words").alias("ipos", "term")).join(counts, "term")
    freq = at.groupBy("iid").agg(F.map_from_entries(F.collect_list(F.struct("ipos", "n"))).alias("freq"))
    each = items.join(freq, "iid").select("iid", "len", "freq", F.explode("starts").alias("s"))
    ranks = F.transform(F.sequence(F.col("s"), F.col("s") + F.col("len") - 1), lambda p: F.struct(F.coalesce(F.element_at("freq", p), F.lit(0).cast("long")).alias("n"), p.alias("p")))
    each = each.withColumn("r", F.array_sort(ranks)).filter(F.col("r")[0]["n"] > 0)
    win = F.struct("s", F.col("r")[0]["p"].alias("a"), F.coalesce(F.try_element_at("r", F.lit(2))["p"], F.col("r")[0]["p"]).alias("b"))
    return each.groupBy("iid").agg(F.collect_list(win).alias("wins"))


def find_contamination(docs: DataFrame, items: DataFrame, n: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", bound: int = BROADCAST_ROWS, rows: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit (words inside any occurrence of a window), ``items`` (sorted ids as strings) and ``spans`` (item_id, start, end in words, end exclusive).

    Null and empty texts have no words and no hits. Items without words match
    nothing; items with a null id hit words but aren't listed. Rows that repeat
    a doc_id are answered by their own texts. Repeated items count once. Extra
    columns are ignored, whatever their names; ``rows`` adds the whole row of
    ``docs`` as ``_row``.
    """
    table = item_table(items, item_id, item_text, n)
    vocabulary = materialize(table.select(F.explode("words").alias("term")).distinct(), "vocabulary")
    counts = term_counts(docs, vocabulary, text, bound)
    plan = materialize(table.join(_planned(table, counts), "iid").select("iid", "item_id", "words", "len", "wins"), "windows")
    places = plan.select("iid", "words", F.explode(F.array_distinct(F.flatten(F.transform("wins", lambda w: F.array(w["a"], w["b"]))))).alias("ipos"))
    anchors = materialize(places.select("iid", "ipos", F.element_at("words", F.col("ipos") + 1).alias("term")), "anchors")
    index = postings(docs, anchors.select("term").distinct(), doc_id, text, bound)
    met = index.join(_small(anchors, bound), "term").select("_d", "_h", "iid", (F.col("pos") - F.col("ipos")).alias("shift"), "ipos")
    aligned = met.groupBy("_d", "_h", "iid", "shift").agg(F.collect_set("ipos").alias("m"))
    alive = F.transform(F.filter("wins", lambda w: F.array_contains("m", w["a"]) & F.array_contains("m", w["b"]) & (w["s"] + F.col("shift") >= 0)), lambda w: w["s"])
    aligned = aligned.join(_small(plan, bound), "iid").withColumn("starts", alive).filter(F.size("starts") > 0)
    per = materialize(aligned.groupBy("_d", "_h").agg(F.collect_list(F.struct("item_id", "shift", "len", "words", "starts")).alias("al")), "alignments")

    base = _keyed(docs, doc_id, text)
    # A row here holds every alignment of a document, so the bound is in alignments.
    few = per.select(F.sum(F.size("al"))).first()[0] or 0
    hit = F.broadcast(per) if few <= bound else per
    hit = hit.select(F.col("_d").alias("_d2"), F.col("_h").alias("_h2"), "al")
    both = base.join(hit, F.col("_d").eqNullSafe(F.col("_d2")) & (F.col("_h") == F.col("_h2")), "left")
    same = lambda a, s: F.slice("_w", s + a["shift"] + 1, a["len"]) == F.slice(a["words"], s + 1, a["len"])
    spans = F.flatten(
        F.transform(
            "al",
            lambda a: F.transform(
                F.filter(a["starts"], lambda s: same(a, s)),
                lambda s: F.struct((s + a["shift"]).alias("start"), (s + a["shift"] + a["len"]).alias("end"), a["item_id"].alias("item_id")),
            ),
        )
    )
    none = F.array().cast(f"array<struct<start:int,end:int,item_id:{dict(plan.dtypes)['item_id']}>>")
    own = ["_row"] * rows
    out = both.select(*own, F.col("_d").alias(doc_id), F.size("_w").cast("long").alias("n_words"), F.when(F.col("al").isNull(), none).otherwise(F.sort_array(spans)).alias("spans"))
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("upto")),
        lambda acc, x: F.struct(
            (acc["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(x["start"], acc["upto"]))).cast("long").alias("n"),
            F.greatest(acc["upto"], x["end"]).alias("upto"),
        ),
        lambda acc: acc["n"],
    )
    ids = F.array_sort(F.array_distinct(F.filter(F.transform("spans", lambda x: x["item_id"].cast("string")), lambda x: x.isNotNull())))
    return out.select(*own, doc_id, "n_words", covered.alias("n_hit"), ids.alias("items"), "spans")


def drop_contaminated(docs: DataFrame, items: DataFrame, n: int = 10) -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no window of any item."""
    return find_contamination(docs, items, n, rows=True).filter("n_hit = 0").select("_row.*")


def find_proximity(docs: DataFrame, items: DataFrame, within: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", bound: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, item_id, pos): positions of an item's rarest word that have every other word of the item at most ``within`` words away.

    Same treatment of nulls, repeats and extra columns as ``find_contamination``.
    """
    table = item_table(items, item_id, item_text)
    terms = materialize(table.select("iid", "item_id", F.explode(F.array_distinct("words")).alias("term")), "terms")
    counts = term_counts(docs, terms.select("term").distinct(), text, bound)
    asked = terms.join(counts, "term", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    order = Window.partitionBy("iid").orderBy("n", "term")
    asked = materialize(asked.select("*", F.row_number().over(order).alias("rank"), F.count(F.lit(1)).over(Window.partitionBy("iid")).alias("size"), F.min("n").over(Window.partitionBy("iid")).alias("least")).filter("least > 0"), "asked")
    index = postings(docs, asked.select("term").distinct(), doc_id, text, bound)
    met = index.join(_small(asked, bound), "term")
    rare = met.filter("rank = 1").select("_d", "_h", "iid", "item_id", "size", F.col("pos").alias("p"))
    other = met.filter("rank > 1").select(F.col("_d").alias("_d2"), F.col("_h").alias("_h2"), F.col("iid").alias("iid2"), "rank", "pos", F.explode(F.array(*[F.floor(F.col("pos") / (within + 1)) + k for k in (-1, 0, 1)])).alias("cell"))
    near = rare.withColumn("cell", F.floor(F.col("p") / (within + 1))).join(other.withColumnRenamed("cell", "cell2"), F.col("_d").eqNullSafe(F.col("_d2")) & (F.col("_h") == F.col("_h2")) & (F.col("iid") == F.col("iid2")) & (F.col("cell") == F.col("cell2")), "left")
    near = near.groupBy("_d", "_h", "iid", "item_id", "size", "p").agg(F.count_distinct(F.when(F.abs(F.col("pos") - F.col("p")) <= within, F.col("rank"))).alias("k"))
    return near.filter(F.col("k") == F.col("size") - 1).select(F.col("_d").alias(doc_id), F.col("item_id").alias("item_id"), F.col("p").cast("long").alias("pos"))


def op1_decontaminate(spark, sf_dir):
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    out = find_contamination(docs, items)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT item_id, array_to_string(list_slice(w, s, s + least(10, len(w)) - 1), ' ') AS win, least(10, len(w)) AS n
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s FROM b WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, s, n, array_to_string(list_slice(w, s, s + n - 1), ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, ns WHERE len(w) >= n)),
hit AS (SELECT DISTINCT doc_id, s, dw.n, item_id FROM dw JOIN bw USING (win, n)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS ids FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(ids), 0) AS BIGINT) AS n_items,
  sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
