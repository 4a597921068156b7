"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Sources are cut into blocks of documents by a hash. A source's target fixes how often its blocks are taken: whole passes over
all of them, then a permuted run of blocks, of which the last is cut at a document. These exact quotas are split among output shards by a
binary tree: at each node the left half's share of every source is one multivariate-hypergeometric draw. Each shard so
owns disjoint runs of every source's permuted blocks, and shuffles what it holds by itself.

The driver sees one row a source and one a block, and these rows are broadcast. Both are bounded whatever the input's size: more than `most_sources` sources are
an error, which is raised before any of them is gathered, and there are at most `most_blocks` blocks besides one for each source.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, text_of

_WORD = r"[^\x20\x09-\x0D]+"


def _targets(sizes: list[int], weights: list[float], total: float, most: float) -> list[float]:
    """Shares of `total` by weight, none above `most` times its size; the excess goes to the others by weight until none is above."""
    target, free, left = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0], float(total)
    while free:
        unit = left / sum(weights[i] for i in free)
        full = [i for i in free if weights[i] * unit > most * sizes[i]]
        if not full:
            for i in free:
                target[i] = weights[i] * unit
            break
        for i in full:
            target[i] = float(most * sizes[i])
            left -= target[i]
        free = [i for i in free if i not in set(full)]
    return target


def split_tree(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """A row for each shard, a column for each source: exact block quotas whose columns sum to `quotas`; row sums differ by little."""
    if shards == 1:
        return quotas[None, :]
    left = shards // 2
    take = round(int(quotas.sum()) * left / shards)
    drawn = rng.multivariate_hypergeometric(quotas, take, method="marginals") if take else np.zeros_like(quotas)
    return np.vstack([split_tree(drawn, left, rng), split_tree(quotas - drawn, shards - left, rng)])


class Mixer:
    """Mixes documents so that sources meet target weights.

    Weights repeat over the sources in code-point order, null last. All sources together give `share` times all sizes (words); a
    source's target stops at `most` times its size. Null texts have size 0 and are taken for no words. Repeated rows count each; they fall in
    one block. Ids may be null. Everything follows from the seed and the rows, so reruns agree.

    A drawn shard of more than `piece_words` words is several tasks, each with a run of the shard's hashed order.
    """

    def __init__(self, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, shards: int = 16, block_words: int = 20_000, most_blocks: int = 100_000, most_sources: int = 100_000, piece_words: int = 5_000_000, seed: int = 11):
        self.weights, self.share, self.most, self.shards = weights, share, most, shards
        self.block_words, self.most_blocks, self.most_sources, self.piece_words, self.seed = block_words, most_blocks, most_sources, piece_words, seed

    def plan(self, docs: DataFrame) -> tuple[DataFrame, list[dict]]:
        """`docs` with __size and __block, and for each source its size, target, blocks."""
        sized = docs.withColumn("__size", F.regexp_count(text_of(), F.lit(_WORD)).cast("long"))
        found = [(r[0], r[1] or 0) for r in sized.groupBy(F.col("source").alias("__s")).agg(F.sum("__size")).limit(self.most_sources + 1).collect()]
        if len(found) > self.most_sources:
            raise ValueError(f"more than {self.most_sources} sources; weigh groups of them, a domain's hosts for instance")
        found.sort(key=lambda r: (r[0] is None, (r[0] or "").encode("utf-8", "surrogatepass")))
        sizes = [n for _, n in found]
        targets = _targets(sizes, [self.weights[i % len(self.weights)] for i in range(len(found))], self.share * sum(sizes), self.most)
        step = max(self.block_words, sum(sizes) // self.most_blocks + 1)
        return sized, [{"source": s, "order": i, "source_size": n, "target": t, "blocks": max(1, n // step)} for i, ((s, n), t) in enumerate(zip(found, targets, strict=True))]

    def mix(self, docs: DataFrame) -> DataFrame:
        """`docs` with __size, __source_size, __target, __passes (times the document is taken), __shards (one for each time)."""
        return self._mix(docs)[0]

    def _mix(self, docs: DataFrame) -> tuple[DataFrame, float]:
        """The same, and the words of all targets."""
        spark = docs.sparkSession
        scratch = Scratch(spark, "mix")
        sized, sources = self.plan(docs)
        known = spark.createDataFrame([(x["order"], x["source"], x["source_size"], x["target"], x["blocks"]) for x in sources], "__order int, __s string, __source_size long, __target double, __blocks long")
        blocked = sized.join(F.broadcast(known), F.col("source").eqNullSafe(F.col("__s")))  # a row a source; the plan holds no more than most_blocks
        place = F.xxhash64(F.lit(self.seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.xxhash64(text_of()))
        blocked = blocked.withColumn("__place", place).withColumn("__block", F.pmod(F.xxhash64("__place"), F.col("__blocks")))
        counts = {(r[0], r[1]): r[2] for r in blocked.groupBy("__order", "__block").agg(F.sum("__size")).collect()}
        per: dict[int, dict[int, int]] = {}
        for (o, b), n in counts.items():
            per.setdefault(o, {})[b] = n
        rng = np.random.default_rng(self.seed)
        runs, cuts = [], []  # a run: the blocks one source takes, in permuted order, pass by pass
        for x in sources:
            own = per.get(x["order"], {})
            names = np.array(sorted(own))
            passes = int(x["target"] // x["source_size"]) if x["source_size"] else 0
            run = [(int(b), p) for p in range(passes) for b in rng.permutation(names)]
            rest = x["target"] - passes * x["source_size"]
            for b in rng.permutation(names):
                if rest <= 0:
                    break
                if own[b] <= rest:
                    run.append((int(b), passes))
                    rest -= own[b]
                else:  # the block that crosses the target gives some of its documents
                    run.append((int(b), passes))
                    cuts.append((x["order"], int(b), passes, float(rest)))
                    break
            runs.append(run)
        quotas = np.array([len(r) for r in runs] or [0], dtype=np.int64)
        parts = split_tree(quotas, self.shards, rng)
        taken = []
        for o, run in enumerate(runs):
            at = 0
            for shard in range(self.shards):
                taken += [(o, b, p, shard) for b, p in run[at : at + int(parts[shard, o])]]
                at += int(parts[shard, o])
        cut = {(o, b, p): rest for o, b, p, rest in cuts}
        rows = [(o, b, p, s, cut.get((o, b, p))) for o, b, p, s in taken]
        draws = spark.createDataFrame(rows, "__order int, __block long, p int, shard int, rest double").groupBy("__order", "__block").agg(F.sort_array(F.collect_list(F.struct("p", "shard"))).alias("__draws"), F.max("rest").alias("__rest"), F.max(F.when(F.col("rest").isNotNull(), F.col("p"))).alias("__cut"))
        joined = blocked.join(F.broadcast(draws), ["__order", "__block"], "left")  # at most most_blocks rows
        # In a block that is cut, documents go in hash order while they fit; one block a source.
        order = Window.partitionBy("__order", "__block").orderBy("__place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        inside = joined.filter("__rest is not null")
        cutting = scratch.put(inside.groupBy("__order", "__block", "__place").agg(F.sum("__size").alias("w"), F.first("__rest").alias("r")).withColumn("before", F.sum("w").over(order) - F.col("w")), "cut")
        over = cutting.filter("before + w / 2 > r").select("__order", "__block", "__place", F.lit(True).alias("__over"))
        marked = joined.filter("__rest is null").withColumn("__over", F.lit(None).cast("boolean")).unionByName(inside.join(over, ["__order", "__block", "__place"], "left"))
        shards = F.expr("transform(filter(__draws, d -> not coalesce(__over, false) or d.p <> __cut), d -> d.shard)")
        marked = marked.withColumn("__shards", F.coalesce(shards, F.expr("cast(array() as array<int>)"))).withColumn("__passes", F.size("__shards"))
        return marked.select(*docs.columns, "__size", "__source_size", "__target", "__passes", "__shards", "__place"), sum(x["target"] for x in sources)

    def report(self, docs: DataFrame) -> DataFrame:
        """(doc_id, size, source_size, target, taken), a row for each row of `docs`."""
        return self.mix(docs.select("doc_id", "text", "source")).select("doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), (F.col("__size") * F.col("__passes")).alias("taken"))

    def draw(self, docs: DataFrame) -> DataFrame:
        """The mix itself: a row for each time a document is taken, with its `shard` (in the place of any column of that name), each shard in a hashed order of its own."""
        mixed, total = self._mix(docs.drop("shard"))
        mixed = mixed.select(*[c for c in docs.columns if c != "shard"], "__place", F.posexplode("__shards").alias("__time", "shard"))
        pieces = max(1, math.ceil(total / self.shards / self.piece_words))
        order = F.xxhash64("__place", "__time", "shard")
        placed = mixed.withColumn("__order", F.shiftrightunsigned(order, 1)).withColumn("__piece", F.shiftright(F.shiftrightunsigned(order, 48) * pieces, 16))
        return placed.repartition(self.shards * pieces, "shard", "__piece").sortWithinPartitions("shard", "__order").drop("__place", "__time", "__order", "__piece")
