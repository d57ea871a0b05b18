"""Filling fixed-capacity containers with items (problem 8).

Hierarchical multi-length packing: documents are routed to the smallest context-size tier that holds them, the windows
of each tier are packed by best fit in shards of bounded size, gaps in long windows are filled from shorter tiers, what
poorly filled windows hold is packed once more across shards, and windows are dealt into step groups of equal load.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fluxloom.session import broadcast_if_small, cut

PLACED = "doc_id long, piece int, token_start int, n_tokens int, tier int, window string, slot int, used int"


def default_tokenizer() -> str:
    """Path of the byte-level BPE vocabulary of the installed public tokenizers."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return tokenizer


def token_pieces(docs: DataFrame, capacity: int, tokenizer: str | None = None) -> DataFrame:
    """doc_id, piece, token_start, n_tokens: one piece per text, more only where a text exceeds ``capacity`` tokens.

    Whole texts are tokenized, in parallel and without moving them. NULL and empty texts have no tokens and no piece.
    """
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok = _tokenizer(path)
        for batch in batches:
            rows = []
            for a in range(0, len(batch), 256):
                part = batch.iloc[a : a + 256]
                for doc, enc in zip(part["doc_id"], tok.encode_batch(part["text"].tolist(), add_special_tokens=False)):
                    n = len(enc.ids)
                    rows += [(doc, k, s, min(capacity, n - s)) for k, s in enumerate(range(0, n, capacity))]
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "token_start", "n_tokens"])

    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull() & (F.length("text") > 0))
    return texts.mapInPandas(run, "doc_id long, piece int, token_start int, n_tokens int")


class _Bins:
    """Windows of one capacity, found by remaining room (best fit)."""

    def __init__(self, capacity: int):
        self.capacity, self.items, self.room = capacity, [], []

    def fit(self, item: int, size: int) -> bool:
        at = bisect_left(self.room, (size, -1))
        if at == len(self.room):
            return False
        left, k = self.room.pop(at)
        self.items[k].append(item)
        insort(self.room, (left - size, k))
        return True

    def open(self, item: int, size: int) -> None:
        self.items.append([item])
        insort(self.room, (self.capacity - size, len(self.items) - 1))


def pack_tiers(sizes: np.ndarray, tiers: tuple[int, ...]) -> list[tuple[int, list[int]]]:
    """Windows (tier capacity, item numbers) that hold all items, long tiers first.

    Items of a tier are packed largest first by best fit; before a shorter tier opens windows of its own its items are
    offered to the gaps of all longer windows.
    """
    bins: list[_Bins] = []
    order = np.argsort(-sizes, kind="stable")
    bounds = sorted(tiers)
    home = np.searchsorted(bounds, sizes)
    for t in range(len(bounds) - 1, -1, -1):
        own = _Bins(bounds[t])
        for i in order[home[order] == t]:
            size = int(sizes[i])
            if not any(b.fit(int(i), size) for b in bins) and not own.fit(int(i), size):
                own.open(int(i), size)
        bins.append(own)
    return [(b.capacity, items) for b in bins for items in b.items]


def step_groups(windows: DataFrame, step_tokens: int, slices: int = 512, part_rows: int = 200_000) -> DataFrame:
    """``windows`` (tier, window, used) with step: groups of ``step_tokens`` capacity per tier, of nearly equal load.

    All windows of a tier are ranked by load, over the whole table: ranges of the load are cut by a histogram of at most
    ``slices`` fill levels, ranks within a range come from a window over it. Dealing to and fro along the ranks levels
    the groups.
    """
    level = F.floor(F.col("used") * slices / (F.col("tier") + 1)).cast("int")
    # full windows are the commonest: a level is numbered in parts, so no task ranks a whole level
    part = F.pmod(F.xxhash64("window"), F.lit(-(-windows.count() // part_rows) or 1)).cast("int")
    rows = windows.withColumn("level", level).withColumn("part", part)
    counts = rows.groupBy("tier", "level", "part").agg(F.count("*").alias("n"))  # tiers x levels x parts rows
    down = W.partitionBy("tier").orderBy(F.desc("level"), "part")
    starts = counts.withColumn("before", F.sum("n").over(down) - F.col("n")).withColumn("all", F.sum("n").over(W.partitionBy("tier")))
    place = F.row_number().over(W.partitionBy("tier", "level", "part").orderBy(F.desc("used"), "window")) - 1
    ranked = rows.join(broadcast_if_small(cut(starts.drop("n"))), ["tier", "level", "part"]).withColumn("rank", F.col("before") + place)
    groups = F.greatest(F.lit(1), F.ceil(F.col("all") * F.col("tier") / step_tokens))
    lap, at = F.floor(F.col("rank") / groups), F.col("rank") % groups
    return ranked.select("tier", "window", F.concat_ws("-", F.col("tier"), F.when(lap % 2 == 0, at).otherwise(groups - 1 - at).cast("long")).alias("step"))


def _pack_shard(tiers: tuple[int, ...], round_: int):
    def run(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values(["n_tokens", "doc_id", "piece"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        sizes = shard["n_tokens"].to_numpy()
        windows = pack_tiers(sizes, tiers)
        used = np.array([sizes[w].sum() for _, w in windows])
        name = f"{round_}-{shard['shard'].iloc[0]}"
        rows = [(i, c, f"{name}-{k}", slot, int(used[k])) for k, (c, items) in enumerate(windows) for slot, i in enumerate(items)]
        out = pd.DataFrame(rows, columns=["i", "tier", "window", "slot", "used"])
        return pd.concat([shard.loc[out["i"], ["doc_id", "piece", "token_start", "n_tokens"]].reset_index(drop=True), out.drop(columns="i")], axis=1)

    return run


def pack(pieces: DataFrame, tiers: tuple[int, ...] = (512, 1024, 2048), shard_items: int = 8192, full: float = 0.97, step_tokens: int = 16384) -> DataFrame:
    """Every piece with its window: doc_id, piece, token_start, n_tokens, tier, window, slot, used, step.

    ``pieces`` must not exceed the largest tier. Shards are cut by a hash of the piece, hold about ``shard_items``
    items whatever the table's size and are packed independently; windows filled below ``full`` are opened again and
    their items packed in a second round of few shards. Step groups are dealt over all windows. The sum of n_tokens of a window never exceeds its tier.
    Repeated rows are items of their own. An empty table gives no rows.
    """
    pieces = cut(pieces)

    def rounds(items: DataFrame, k: int) -> DataFrame:
        shards = max(4 if k == 1 else 1, -(-items.count() // shard_items))
        spread = items.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", F.lit(k)), F.lit(shards)).cast("int"))
        return cut(spread.groupBy("shard").applyInPandas(_pack_shard(tuple(tiers), k), PLACED))

    first = rounds(pieces, 1)
    loose = F.col("used") < full * F.col("tier")
    again = rounds(first.where(loose).select("doc_id", "piece", "token_start", "n_tokens"), 2)
    placed = cut(first.where(~loose).unionByName(again))
    steps = step_groups(placed.where(F.col("slot") == 0).select("tier", "window", "used"), step_tokens)
    return placed.join(steps, ["tier", "window"]).select(*pieces.columns, "tier", "window", "slot", "used", "step")


def fill_report(placed: DataFrame) -> DataFrame:
    """tier, windows, items, tokens and fill (share of the capacity used) per tier and for all tiers (tier 0)."""
    windows = placed.groupBy("tier", "window").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("items"))
    each = windows.select(F.explode(F.array("tier", F.lit(0))).alias("t"), F.col("tier").alias("room"), "tokens", "items")
    out = each.groupBy(F.col("t").alias("tier")).agg(F.count("*").alias("windows"), F.sum("items").alias("items"), F.sum("tokens").alias("tokens"), F.sum("room").alias("room"))
    return out.select("tier", "windows", "items", "tokens", F.round(F.col("tokens") / F.col("room"), 4).alias("fill"))
