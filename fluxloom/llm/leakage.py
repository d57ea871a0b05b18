"""Evaluation texts leaking into training text (problem 9).

The corpus becomes a stored positional inverted index: a posting (term, document, position) per word, written once in
sorted segments. Test items are looked up in it: of every five words of an item the postings of the rarest term are
shifted by the term's place in the item and intersected with those of the next rarest, and so on, so that documents
that agree on all five at one shift remain. Agreeing stretches that follow each other are exact phrases; documents
without one go on to a proximity match over the posting lists. Texts are read once, to build the index.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fluxloom.llm.words import words
from fluxloom.session import broadcast_if_small, cut

#: Words of the stretches that are looked up. A text of 30 words with every seventh wrong keeps one of this length.
GRAM = 5


def postings(docs: DataFrame) -> DataFrame:
    """term (64-bit hash), doc_id, pos of every word of every text. NULL ids and NULL or empty texts have no postings."""
    hashed = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("h"))
    return hashed.select("doc_id", F.posexplode("h").alias("pos", "term")).select("term", "doc_id", "pos")


class PostingIndex:
    """Postings stored in a shared folder, in segments of whole documents that are sorted by term.

    A segment is what one task tokenised: building needs no shuffle, and later documents are appended as new segments.
    """

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path

    def add(self, docs: DataFrame) -> PostingIndex:
        """Index the documents (doc_id, text); a doc_id stands for one text, however often its row is repeated."""
        postings(docs).sortWithinPartitions("term", "doc_id", "pos").write.mode("append").parquet(self.path)
        return self

    def read(self) -> DataFrame:
        return self.spark.read.schema("term long, doc_id long, pos int").parquet(self.path)

    def counts(self, terms: DataFrame) -> DataFrame:
        """term, df: number of postings of each of ``terms``."""
        return self.read().join(broadcast_if_small(terms.select("term").distinct()), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, ipos, term of every word of every test item."""
    rows = items.where(F.col("item_id").isNotNull()).select("item_id", F.posexplode(F.transform(words(F.col("text")), lambda w: F.xxhash64(w))).alias("ipos", "term"))
    return rows.distinct()


def grams(terms: DataFrame, counts: DataFrame) -> DataFrame:
    """gram_id, item_id, at (first place), q: the GRAM terms with their places, rarest first, of every stretch of an item
    whose terms all occur in the corpus."""
    known = terms.join(counts, "term")
    order = W.partitionBy("item_id").orderBy("ipos")
    window = order.rowsBetween(0, GRAM - 1)
    held = known.select(
        "item_id", F.col("ipos").alias("at"), F.max("ipos").over(window).alias("last"), F.sort_array(F.collect_list(F.struct("df", F.col("ipos").alias("place"), "term")).over(window)).alias("q")
    )
    whole = held.where((F.size("q") == GRAM) & (F.col("last") == F.col("at") + GRAM - 1))
    return whole.select(F.xxhash64("item_id", "at").alias("gram_id"), "item_id", "at", F.transform("q", lambda x: F.struct(x["term"].alias("term"), (x["place"] - F.col("at")).alias("off"))).alias("q"))


def phrase_hits(index: PostingIndex, items: DataFrame) -> DataFrame:
    """item_id, doc_id, at, start: the stretch of GRAM words at ``at`` of the item stands at ``start`` of the document.

    Lists are intersected from the rarest term on: the rarest term's postings, shifted, stay where the index holds the
    posting of the second rarest that they call for, and what is left must find the other three. Both joins are on
    (term, document, position), which no frequent term or document can skew; AQE broadcasts the side that proves small.
    """
    terms = cut(item_terms(items))
    looked_up = cut(grams(terms, cut(index.counts(terms))))
    stored = index.read()
    known = broadcast_if_small(looked_up)
    rarest, second, others = F.col("q")[0], F.col("q")[1], F.slice("q", 3, GRAM - 2)
    place = (F.col("start") + F.col("x.off")).alias("pos")

    def supported(called: DataFrame, asked: DataFrame) -> DataFrame:
        lists = stored.join(broadcast_if_small(cut(asked.distinct())), "term", "left_semi")
        return called.join(lists, ["term", "doc_id", "pos"], "left_semi")

    first = stored.join(broadcast_if_small(looked_up.select("gram_id", rarest["term"].alias("term"), rarest["off"].alias("off"))), "term")
    first = first.select("gram_id", "doc_id", (F.col("pos") - F.col("off")).alias("start")).where(F.col("start") >= 0).distinct()
    called = first.join(known, "gram_id").withColumn("x", second).select("gram_id", "doc_id", "start", F.col("x.term").alias("term"), place)
    two = supported(called, looked_up.select(second["term"].alias("term"))).select("gram_id", "doc_id", "start")
    called = two.join(known, "gram_id").select("gram_id", "doc_id", "start", F.explode(others).alias("x")).select("gram_id", "doc_id", "start", F.col("x.term").alias("term"), place)
    rest = supported(called, looked_up.select(F.explode(F.transform(others, lambda x: x["term"])).alias("term")))
    whole = rest.groupBy("gram_id", "doc_id", "start").agg(F.count("*").alias("n")).where(F.col("n") == GRAM - 2)
    return whole.join(known, "gram_id").select("item_id", "doc_id", "at", "start")


def joined_runs(hits: DataFrame) -> DataFrame:
    """item_id, doc_id, shift, lo, hi of the maximal runs: stretches of one shift that overlap or touch are one phrase."""
    spans = hits.select("item_id", "doc_id", (F.col("start") - F.col("at")).alias("shift"), F.col("at").alias("lo"), (F.col("at") + GRAM - 1).alias("hi")).distinct()
    order = W.partitionBy("item_id", "doc_id", "shift").orderBy("lo")
    before = F.max("hi").over(order.rowsBetween(W.unboundedPreceding, -1))
    marked = spans.withColumn("new", (F.coalesce(before, F.lit(-2)) < F.col("lo") - 1).cast("int"))
    marked = marked.withColumn("run", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return marked.groupBy("item_id", "doc_id", "shift", "run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("run")


#: Cost of a wrong, left-out or added word in an alignment: so low that a kept word beyond three wrong ones still counts.
_WRONG = 0.3


def _align(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Places of equal words of the best local alignment of two word sequences."""
    n, m = len(a), len(b)
    h = np.zeros((n + 1, m + 1))
    steps = np.arange(1, m + 1)
    for i in range(1, n + 1):
        row = np.maximum(0.0, np.maximum(h[i - 1, :-1] + np.where(b == a[i - 1], 1.0, -_WRONG), h[i - 1, 1:] - _WRONG))
        h[i, 1:] = np.maximum(row, np.maximum.accumulate(row + _WRONG * steps) - _WRONG * steps)
    i, j = (int(x) for x in np.unravel_index(h.argmax(), h.shape))
    places = []
    while i > 0 and j > 0 and h[i, j] > 0:
        hit = a[i - 1] == b[j - 1]
        if abs(h[i, j] - h[i - 1, j - 1] - (1.0 if hit else -_WRONG)) < 1e-9:
            if hit:
                places.append((i - 1, j - 1))
            i, j = i - 1, j - 1
        elif abs(h[i, j] - h[i - 1, j] + _WRONG) < 1e-9:
            i -= 1
        else:
            j -= 1
    return places[::-1]


def near_share(item: np.ndarray, doc: np.ndarray, stretch: int) -> float:
    """Share of words kept, in order, in the best stretch of ``stretch`` or more words of the item.

    A stretch reaches from one kept word to another, on the item's or the document's side, whichever is longer; one that
    shows fewer than ``stretch`` words counts as if its ends had been replaced, which cannot be seen.
    """
    p = np.array(_align(item, doc))
    if len(item) < stretch or len(p) < stretch // 2:
        return 0.0
    best = 0.0
    for k in range(len(p)):  # stretches that begin with the k-th kept word
        span = np.maximum(p[k:, 0] - p[k, 0], p[k:, 1] - p[k, 1]) + 1
        best = max(best, float((np.arange(1, len(p) - k + 1) / np.maximum(span, stretch)).max()))
    return best


def _proximity(stretch: int):
    """Per (item, document): the best share over the regions of the document where words of the item were found."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            shares = []
            for item, found in zip(batch["item"], batch["found"]):
                n, best = len(item), 0.0
                pos, term = (np.array([f[c] for f in found], np.int64) for c in ("pos", "term"))
                for part in np.split(np.arange(len(pos)), np.flatnonzero(np.diff(pos) > n) + 1):
                    # words that are none of the item's are left out of the lists: any other value stands for them
                    region = np.zeros(pos[part[-1]] - pos[part[0]] + 1, np.int64)
                    region[pos[part] - pos[part[0]]] = term[part]
                    best = max(best, near_share(np.asarray(item), region, stretch))
                shares.append(best)
            yield pd.DataFrame({"item_id": batch["item_id"], "doc_id": batch["doc_id"], "share": shares})

    return run


def near_shares(index: PostingIndex, items: DataFrame, pairs: DataFrame, stretch: int) -> DataFrame:
    """item_id, doc_id, share of ``pairs`` (item_id, doc_id, spots: places of agreement), from the posting lists alone.

    Of each document only the postings of the item's terms within two item lengths of a spot are collected, so a pair
    holds at most a document's words; pairs are spread over tasks.
    """
    terms = cut(item_terms(items))
    whole = terms.groupBy("item_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ipos", "term"))), lambda x: x["term"]).alias("item"))
    lists = index.read().join(broadcast_if_small(terms.select("term").distinct()), "term", "left_semi").join(broadcast_if_small(cut(pairs.select("doc_id").distinct())), "doc_id", "left_semi")
    known = broadcast_if_small(cut(whole.select("item_id", "item")))
    rows = lists.join(pairs, "doc_id").join(known, "item_id").where(F.array_contains("item", F.col("term")) & F.exists("spots", lambda s: F.abs(s - F.col("pos")) <= 2 * F.size("item")))
    found = rows.groupBy("item_id", "doc_id").agg(F.sort_array(F.collect_set(F.struct("pos", "term"))).alias("found")).join(known, "item_id")
    return found.select("item_id", "doc_id", "item", "found").mapInPandas(_proximity(stretch), "item_id long, doc_id long, share double")


def leaked_items(index: PostingIndex, items: DataFrame, phrase: int = 12, stretch: int = 30, share: float = 0.84) -> DataFrame:
    """item_id, doc_id, how: ``exact`` (``phrase`` or more successive words) or ``near`` (proximity match).

    ``items`` has item_id and text. A near match is a stretch of ``stretch`` item words or more, in order, of which at
    least ``share`` are kept (about one in seven replaced or left out). Items that share a passage all count. NULL,
    blank and short texts match nothing. Empty tables give no rows.
    """
    runs = cut(joined_runs(phrase_hits(index, items)))
    # of L words with w wrong at most 4 w stand in runs shorter than GRAM, so the longer runs hold this many words at least
    least = (share - (GRAM - 1) * (1 - share)) * stretch
    exact = runs.where(F.col("hi") - F.col("lo") + 1 >= phrase).select("item_id", "doc_id").distinct()
    spots = runs.groupBy("item_id", "doc_id").agg(F.sum(F.col("hi") - F.col("lo") + 1).alias("cover"), F.collect_set(F.col("shift") + F.col("lo")).alias("spots"))
    rest = cut(spots.where(F.col("cover") >= least).drop("cover").join(exact, ["item_id", "doc_id"], "left_anti"))
    near = near_shares(index, items, rest, stretch).where(F.col("share") >= share).select("item_id", "doc_id")
    return exact.withColumn("how", F.lit("exact")).unionByName(near.withColumn("how", F.lit("near")))
