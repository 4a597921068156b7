"""Near-duplicate groups: many universal hash minima with banding, signature verification, star components.

Steps, none of which gathers a group in one task or lists all pairs of a group:

1. One pass in Arrow batches gives each text its set size, a digest of its whole shingle set, its minima and band keys. Texts of
   one set share a class, whose least doc_id stands for it.
2. In each band bucket one member, the one that meets most others over all its buckets, is the pivot; the others are paired with
   it. Pairs whose sizes or signatures exclude the similarity go (the signature bound lies five standard errors below it); the
   rest are verified on the full sets. Pairs: at most `bands` a class.
3. Connected components. A bucket whose members lie in one component needs nothing more.
4. For the other buckets the rest of their links is found exactly. Components that share a bucket form a region. A class with too many
   shingles that no other class of its region has can link with none, and drops out. Of the rest, classes outside the largest
   component are queries against all others, within the whole region, within each of its buckets, or among the classes that share one of
   their rarest shingles (the prefix of a set, which two linked sets can't help sharing), whichever takes fewer comparisons. Prefixes are made
   only for regions of which the other two ways would copy each set many times: buckets of texts on one template, unlike otherwise.
   Queries go in blocks of bounded size spread over tasks by inverted lists.
5. Connected components of all links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SMALL_ROWS, Scratch, attach
from .components import connected_components
from .shingles import MinHasher, set_digest, shingle_set, word_hashes


class NearDedup:
    """Near-duplicate search over `k`-word shingles at a Jaccard similarity of `percent` / 100 or more.

    With the 20 bands of 4 minima a pair at exactly 0.8 shares no bucket with probability 3e-5, one at 0.9 with 1e-9.
    Null and blank texts have the empty set and link with nothing. doc_id is a whole number, unique but for repeated rows; of rows that share a
    doc_id and differ in their sets, the set with the least digest, empty ones left out, is the document's, and each row has its own size. Rows with a null doc_id take no part: null component, kept. Columns besides doc_id and text don't matter.
    """

    def __init__(self, k: int = 5, percent: int = 80, bands: int = 20, rows: int = 4, block: int = 400, copies: int = 8):
        self.k, self.percent, self.block, self.copies = k, percent, block, copies
        self.hasher = MinHasher(bands, rows)
        m, j = bands * rows, percent / 100
        self.agree = max(1, int(m * j - 5 * (m * j * (1 - j)) ** 0.5))  # of m minima

    def signatures(self, docs: DataFrame) -> DataFrame:
        """(doc_id, n, digest, sig, keys) for each row; digest, sig and keys are null for the empty set."""
        k, hasher = self.k, self.hasher

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n, digests, sigs, keys = [], [], [], []
                for text in batch.column(1):
                    s = shingle_set(word_hashes(text.as_py()), k)
                    n.append(len(s))
                    if len(s):
                        minima = hasher.minima(s)
                        digests.append(set_digest(s))
                        sigs.append(minima.astype(np.uint8).tobytes())
                        keys.append(hasher.band_keys(minima))
                    else:
                        digests.append(None), sigs.append(None), keys.append(None)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(sigs, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "n", "digest", "sig", "keys"])

        return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(each, "doc_id long, n long, digest binary, sig binary, keys array<long>")

    def shingles(self, docs: DataFrame) -> DataFrame:
        """(id, digest, tokens): the sorted hashes of the whole shingle set, and their digest."""
        k = self.k

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sets = [shingle_set(word_hashes(t.as_py()), k) for t in batch.column(1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(set_digest, sets), pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["id", "digest", "tokens"])

        return docs.mapInArrow(each, "id long, digest binary, tokens array<long>")

    def linked(self, common: str, a: str, b: str) -> str:
        return f"100 * {common} >= {self.percent} * ({a} + {b} - {common})"

    def components(self, docs: DataFrame) -> DataFrame:
        """(doc_id, n_shingles, component_id, kept), a row for each row of `docs`."""
        spark: SparkSession = docs.sparkSession
        scratch = Scratch(spark, "near")
        seen = scratch.put(self.signatures(docs), "signatures")
        seen = self._one_set_an_id(seen, scratch)
        full = seen.filter("doc_id is not null and digest is not null")
        classes = full.groupBy("digest").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("copies"))
        classes = scratch.put(classes, "classes")

        # Step 2: buckets of classes, pivots, verified pairs.
        reps = full.filter("keys is not null").join(classes.select("digest", F.col("id").alias("doc_id")), ["digest", "doc_id"], "left_semi")
        reps = reps.select(F.col("doc_id").alias("id"), "digest", F.col("n").cast("int").alias("n"), "sig", "keys")
        entries = reps.select("id", "n", F.explode("keys").alias("key"))
        shared = scratch.put(entries.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "shared")
        total = shared.agg(F.sum("size")).first()[0] or 0
        members = scratch.put(attach(entries, shared, "key", "size", total, SMALL_ROWS), "members")
        rank = members.groupBy("id").agg(F.sum("size").alias("rank"))
        ranked = members.join(rank, "id")
        pivots = ranked.groupBy("key").agg(F.max(F.struct("rank", F.negative("id").alias("minus"), "n")).alias("p")).select("key", F.negative("p.minus").alias("pivot"), F.col("p.n").alias("pivot_n"))
        pivots = scratch.put(pivots.join(shared.withColumnRenamed("size", "members"), "key"), "pivots")
        near = attach(members, pivots, "key", "members", total, SMALL_ROWS).filter("id <> pivot")
        pairs = scratch.put(near.select("id", "n", "pivot", "pivot_n").distinct(), "pairs")
        active = scratch.put(pairs.select("id").union(pairs.select("pivot")).distinct(), "active")
        sets = reps.join(active, "id", "left_semi").select("id", "digest", "sig")
        texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).join(active, "id", "left_semi")
        tokens = self.shingles(texts).join(sets.dropDuplicates(["id"]), ["id", "digest"])
        tokens = scratch.put(tokens.dropDuplicates(["id"]).select("id", F.size("tokens").alias("n"), "sig", "tokens"), "sets")
        links = scratch.put(self._verified(pairs, tokens), "links")
        parts = connected_components(links, scratch)

        # Steps 3 and 4: what the pivots leave open.
        comp = lambda side: F.coalesce(F.col(f"{side}.component"), F.col(f"t.{'id' if side == 'x' else 'pivot'}"))
        open_ = pairs.alias("t").join(parts.alias("x"), F.col("t.id") == F.col("x.id"), "left").join(parts.alias("y"), F.col("t.pivot") == F.col("y.id"), "left").select(comp("x").alias("a"), comp("y").alias("b"))
        open_ = scratch.put(open_.filter("a <> b").distinct(), "open")
        more = None if open_.isEmpty() else self._rest(open_, members, parts, tokens, total, scratch)
        if more is not None:
            parts = connected_components(links.unionByName(more), scratch)

        # Step 5: back to the rows.
        final = classes.join(parts, "id", "left").select("digest", "copies", F.coalesce("component", "id").alias("component_id"))
        final = scratch.put(final, "classes")
        scratch.keep(seen, final)
        total = final.agg(F.sum("copies")).first()[0] or 0
        done = attach(full.select("doc_id", "n", "digest"), final, "digest", "copies", total).select("doc_id", "n", "component_id")
        rest = seen.filter("doc_id is null or digest is null").select("doc_id", "n", F.col("doc_id").alias("component_id"))
        return done.unionByName(rest).select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))

    @staticmethod
    def _one_set_an_id(seen: DataFrame, scratch: Scratch) -> DataFrame:
        """`seen`, in which rows of an id that has several sets all bear the least digest, and only rows with that set their signature."""
        clash = seen.filter("doc_id is not null").groupBy("doc_id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi"), F.count_if(F.col("digest").isNull()).alias("empty"))
        clash = scratch.put(clash.filter("lo <> hi or lo is not null and empty > 0").select("doc_id", "lo"), "clashes")
        if clash.isEmpty():
            return seen
        own = F.col("lo").isNull() | F.col("digest").eqNullSafe(F.col("lo"))
        marked = seen.join(clash, "doc_id", "left")
        return scratch.put(marked.select("doc_id", "n", F.coalesce("lo", "digest").alias("digest"), F.when(own, F.col("sig")).alias("sig"), F.when(own, F.col("keys")).alias("keys")), "signatures")

    def _verified(self, pairs: DataFrame, tokens: DataFrame) -> DataFrame:
        """Of (id, n, pivot, pivot_n), the pairs that are links, as (a, b). Popular pivots are dealt out over salts."""
        fits = pairs.filter(f"100 * least(n, pivot_n) >= {self.percent} * greatest(n, pivot_n)")
        salts = fits.groupBy("pivot").agg((F.count(F.lit(1)) / self.block).cast("int").alias("last"))
        left = fits.join(salts, "pivot").select("id", "pivot", F.pmod(F.hash("id"), F.col("last") + 1).alias("salt")).join(tokens, "id")
        right = salts.join(tokens.select(F.col("id").alias("pivot"), F.col("n").alias("pivot_n"), F.col("sig").alias("pivot_sig"), F.col("tokens").alias("pivot_tokens")), "pivot").select("*", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("salt"))
        both = left.join(right, ["pivot", "salt"])
        agree = F.size(F.filter(F.sequence(F.lit(1), F.length("sig")), lambda i: F.substring("sig", i, F.lit(1)) == F.substring("pivot_sig", i, F.lit(1)))) >= self.agree
        common = F.size(F.array_intersect("tokens", "pivot_tokens")).cast("long")
        return both.filter(agree).withColumn("common", common).filter(self.linked("common", "n", "pivot_n")).select(F.col("id").alias("a"), F.col("pivot").alias("b"))

    @staticmethod
    def _tops(rows: DataFrame) -> DataFrame:
        """(region, kind, unit, all, top, comps, cost) of the units of `rows` in which several components meet: rows, largest component, what comparing takes."""
        sizes = rows.groupBy("region", "kind", "unit", "comp").agg(F.count(F.lit(1)).alias("size"))
        tops = sizes.groupBy("region", "kind", "unit").agg(F.sum("size").alias("all"), F.max(F.struct("size", "comp")).alias("top"), F.count(F.lit(1)).alias("comps")).filter("comps > 1")
        return tops.withColumn("cost", F.expr("all * (all - top.size + 64.0)"))

    def _prefixes(self, sets: DataFrame, scratch: Scratch) -> DataFrame:
        """(region, id, key): of each set of `sets` (region, id, n, tokens) the rarest tokens, so many that two linked sets of a region share one.

        A set of n tokens links only with sets that hold ceil(n * percent / 100) of them; by one order of all tokens, the first n less that number
        and one more suffice. Tokens that one set alone has come first in that order and can be shared with none.
        """
        each = scratch.put(sets.select("region", "id", "n", F.explode("tokens").alias("token")).select("region", "id", "n", F.xxhash64("region", "token").alias("key")), "tokens")
        df = scratch.put(each.groupBy("key").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"), "df")
        total = df.agg(F.sum("df")).first()[0] or 0
        ordered = attach(each, df, "key", "df", total, SMALL_ROWS).groupBy("region", "id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "key"))).alias("t"))
        first = ordered.withColumn("p", F.expr(f"cast(size(t) - ({self.percent} * n + 99) div 100 + 1 as int)")).filter("p > 0")
        return first.select("region", "id", F.explode(F.expr("slice(t, 1, p)")).alias("e")).select("region", "id", "e.key").distinct()

    def _rest(self, open_: DataFrame, members: DataFrame, parts: DataFrame, tokens: DataFrame, total: int, scratch: Scratch) -> DataFrame:
        """Links between components that meet in a bucket, exactly. `open_`: pairs of components; `total`: rows of `members`."""
        regions = connected_components(open_, scratch).select(F.col("id").alias("comp"), F.col("component").alias("region"))
        placed = scratch.put(members.select("key", "id").join(parts, "id", "left").select("key", "id", F.coalesce("component", "id").alias("comp")), "placed")
        buckets = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("size")).filter("lo <> hi").select("key", "size")
        placed = scratch.put(attach(placed, buckets, "key", "size", total, SMALL_ROWS).drop("size"), "open")

        owners = scratch.put(placed.select("id", "comp").distinct(), "owners")
        comps = owners.groupBy("comp").agg(F.count(F.lit(1)).alias("size")).join(regions, "comp")
        within = attach(owners, comps, "comp", "size", total, SMALL_ROWS).select("id", "region")
        sets = scratch.put(tokens.select("id", "n", "tokens").join(within, "id"), "region")
        owned = sets.select("region", "id", F.explode("tokens").alias("token")).groupBy("region", "token").agg(F.count(F.lit(1)).alias("df"), F.min("id").alias("id")).filter("df = 1").groupBy("id").agg(F.count(F.lit(1)).alias("own"))
        left = sets.join(owned, "id", "left").withColumn("own", F.coalesce("own", F.lit(0))).filter(f"100 * (n - own) >= {self.percent} * n")
        left = scratch.put(left.select("id", "region", "n", "tokens"), "left")

        inside = left.select("id", "region")
        rows = placed.join(inside, "id").select("region", "id", "comp", F.lit(1).alias("kind"), F.xxhash64(F.lit(1), "key").alias("unit"))
        rows = scratch.put(rows.unionByName(owners.join(inside, "id").select("region", "id", "comp", F.lit(0).alias("kind"), F.xxhash64(F.lit(0), "region").alias("unit"))), "rows")
        tops = scratch.put(self._tops(rows), "tops")
        costs = tops.groupBy("region").agg(F.sum(F.expr("if(kind = 0, cost, 0)")).alias("whole"), F.sum(F.expr("if(kind = 1, cost, 0)")).alias("parts"), F.max(F.expr("if(kind = 0, all, 0)")).alias("classes"))
        costs = scratch.put(costs.withColumn("rare", F.lit(None).cast("double")), "costs")
        dear = costs.filter(f"least(whole, parts) > {self.copies * self.block} * classes")
        if not dear.isEmpty():
            prefixes = self._prefixes(attach(left, dear.select("region", "classes"), "region", "classes", total), scratch)
            rare = scratch.put(prefixes.join(owners, "id").select("region", "id", "comp", F.lit(2).alias("kind"), F.xxhash64(F.lit(2), "key").alias("unit")), "rare")
            more = scratch.put(self._tops(rare), "tops")
            spent = dear.drop("rare").join(more.groupBy("region").agg(F.sum("cost").alias("rare")), "region", "left").fillna(0.0, "rare")
            costs = costs.join(dear.select("region"), "region", "left_anti").unionByName(spent)
            rows, tops = rows.unionByName(rare), tops.unionByName(more)
        kinds = costs.select("region", F.expr(f"case when whole <= greatest(least(parts, coalesce(rare, parts)), {self.block**2}) then 0 when rare < parts then 2 else 1 end").alias("kind"))
        tops = tops.join(kinds, ["region", "kind"]).select("unit", "all", F.col("top.comp").alias("top"), F.expr(f"cast(all div {self.block} as int)").alias("last_b"), F.expr(f"cast((all - top.size) div {self.block} as int)").alias("last_q"))
        rows = scratch.put(attach(rows.select("unit", "id", "comp"), scratch.put(tops, "tops"), "unit", "all", total, SMALL_ROWS), "rows")
        sets = left.select("id", "n", "tokens")
        blocks = rows.withColumn("vb", F.pmod(F.hash("id"), F.col("last_b") + 1)).select("unit", "vb", F.explode(F.expr("sequence(0, last_q)")).alias("qb"), "id", "comp").join(sets, "id")
        queries = rows.filter("comp <> top").withColumn("qb", F.pmod(F.hash("id"), F.col("last_q") + 1)).select("unit", F.explode(F.expr("sequence(0, last_b)")).alias("vb"), "qb", "id", "comp").join(sets, "id")
        queries = queries.select("unit", "vb", "qb", "id", "comp", "n", "tokens").toDF("q_unit", "q_vb", "q_qb", "q_id", "q_comp", "q_n", "q_tokens")
        percent = self.percent

        def compare(q, v):
            import pandas as pd

            found = []
            if len(q) and len(v):
                ids, comps, n = (v[c].to_numpy() for c in ("id", "comp", "n"))
                flat = np.concatenate([np.asarray(t) for t in v["tokens"]])
                of = np.repeat(np.arange(len(v)), [len(t) for t in v["tokens"]])
                order = np.argsort(flat, kind="stable")
                flat, of = flat[order], of[order]
                for qid, qcomp, qn, qtokens in zip(q["q_id"], q["q_comp"], q["q_n"], q["q_tokens"], strict=True):
                    t = np.asarray(qtokens)
                    lo, hi = np.searchsorted(flat, t, "left"), np.searchsorted(flat, t, "right")
                    at = np.concatenate([of[i:j] for i, j in zip(lo, hi, strict=True)])
                    common = np.bincount(at, minlength=len(ids))
                    good = (comps != qcomp) & (100 * common >= percent * (n + qn - common))
                    _, first = np.unique(comps[good], return_index=True)
                    found += [(int(qid), int(x)) for x in ids[good][first]]
            return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

        return scratch.put(queries.groupBy("q_unit", "q_qb", "q_vb").cogroup(blocks.groupBy("unit", "qb", "vb")).applyInPandas(compare, "a long, b long"), "more")


def near_dedup(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Components of near-duplicate documents; see NearDedup."""
    return NearDedup(k=k, percent=percent).components(docs)


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs` without those that near_dedup drops; all columns stay."""
    gone = near_dedup(docs, k, percent).filter(~F.col("kept")).select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone["__gone"], "left_anti")
