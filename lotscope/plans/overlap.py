"""Rows that share most tokens with a row, for token sets of any size and tokens of any frequency.

Tokens that many rows hold are *common*, the others *rare*. Rows that share a rare token meet in its short list and are
counted there. For common tokens alone it is enough to know how many a row shares: rows with equal common tokens are one
set, of which the first few rows stand for all, and sets meet sets in blocks, where only the best rows of each set leave the
task. A frequent token therefore never expands into pairs of rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotscope.plans.lineage import cut_lineage
from lotscope.plans.ranked import top_k


def _split(df: DataFrame, common: DataFrame) -> DataFrame:
    """Each row with its common tokens, sorted, and its rare ones."""
    words = df.select("idx", "year", F.explode("toks").alias("token")).join(common, "token", "left")
    pick = lambda is_common: F.sort_array(F.collect_list(F.when(F.col("common").isNotNull() == is_common, F.col("token"))))
    return words.groupBy("idx", "year").agg(pick(True).alias("common"), pick(False).alias("rare"))


def _incidence(sets, columns: dict) -> np.ndarray:
    out = np.zeros((len(sets), len(columns)), np.float32)
    for row, tokens in enumerate(sets):
        out[row, [columns[t] for t in tokens if t in columns]] = 1
    return out


def _best_of_blocks(k: int):
    def best(asked: pd.DataFrame, pool: pd.DataFrame) -> pd.DataFrame:
        rows, sets = [], list(asked["common"])
        if len(sets) and len(pool):
            columns = {t: i for i, t in enumerate(sorted({t for s in sets for t in s} & {t for s in pool["common"] for t in s}))}
            shared = (_incidence(sets, columns) @ _incidence(pool["common"], columns).T).astype(np.int32)
            flat = sorted((p["peer"], p["peer_year"], at) for at, peers in enumerate(pool["peers"]) for p in peers)
            peer, year, home = (np.array(c) for c in zip(*flat))
            for tokens, score in zip(sets, shared[:, home]):
                order = np.argsort(-score, kind="stable")
                order = order[: np.count_nonzero(score)]
                by_year = np.argsort(year[order], kind="stable")
                years = year[order][by_year]
                nth = np.empty(len(order), np.int64)
                nth[by_year] = np.arange(len(order)) - np.searchsorted(years, years)
                rows += [(tokens, int(peer[i]), int(year[i]), int(score[i])) for i in order[nth < k][: 2 * k]]
        return pd.DataFrame(rows, columns=["common", "peer", "peer_year", "shared"])
    return best


def most_shared(pool: DataFrame, asked: DataFrame, k: int, rare: int = 64, block: int = 1024) -> DataFrame:
    """(idx, peer, shared, rank): the ``k`` rows of ``pool`` in other years that share most tokens, the smaller idx on ties.

    Both sides: (idx long, year int, toks array<string>), a token once per row and idx unique. A rare token stands in at
    most ``rare`` rows of the pool. Rows without tokens have no peers. Excluding one year never needs more than the first
    2k rows of a list that holds at most k rows of each year.
    """
    common = pool.select(F.explode("toks").alias("token")).groupBy("token").count().where(F.col("count") > rare) \
        .select("token", F.lit(True).alias("common"))
    same = asked is pool
    pool = _split(pool, common)
    asked = pool if same else _split(asked, common)

    left = asked.select("idx", "year", "common", F.explode("rare").alias("token"))
    right = pool.select(F.col("idx").alias("peer"), F.col("year").alias("peer_year"), F.col("common").alias("peer_common"), F.explode("rare").alias("token"))
    both = F.size(F.array_intersect("common", "peer_common"))
    pairs = left.join(right, "token").where("year <> peer_year").groupBy("idx", "peer").agg((F.count(F.lit(1)) + F.max(both)).cast("int").alias("shared"))

    def leading(rows, key, order):
        return top_k(top_k(rows, [key, "peer_year"], order, k).drop("rank"), [key], order, 2 * k).drop("rank")

    held = pool.where("size(common) > 0").select("common", F.col("idx").cast("long").alias("peer"), F.col("year").cast("int").alias("peer_year"))
    sets = cut_lineage(leading(held, "common", [F.asc("peer")]).groupBy("common").agg(F.collect_list(F.struct("peer", "peer_year")).alias("peers")))
    wanted = cut_lineage(asked.where("size(common) > 0").select("common").distinct())
    blocks = lambda df: df.count() // block + 1
    n_sets, n_wanted = blocks(sets), blocks(wanted)

    def spread(df, mine, n, other, n_other):
        return df.withColumns({mine: F.pmod(F.xxhash64("common"), F.lit(n)).cast("int"), other: F.explode(F.sequence(F.lit(0), F.lit(n_other - 1)))})
    best = spread(wanted, "a", n_wanted, "b", n_sets).groupBy("a", "b").cogroup(spread(sets, "b", n_sets, "a", n_wanted).groupBy("a", "b")).applyInPandas(
        _best_of_blocks(k), "common array<string>, peer long, peer_year int, shared int")
    best = leading(best, "common", [F.desc("shared"), F.asc("peer")])
    of_sets = asked.join(best, "common").where("year <> peer_year").select("idx", "peer", "shared")
    # a pair with a rare token is in both lists if its common part is good enough: the larger count is the whole one
    total = pairs.unionByName(of_sets).groupBy("idx", "peer").agg(F.max("shared").alias("shared"))
    return top_k(total, ["idx"], [F.desc("shared"), F.asc("peer")], k)
