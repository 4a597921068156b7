"""Benchmark decontamination as a prefix-filtered set join over word shingles. DataFrame operations only.

A window is a run of `window` consecutive item words, or the whole of a shorter item. Its shingles (three words, or all of a shorter
window) are ordered by how rare they are in the corpus. As containment must be exact, the necessary prefix is the one rarest shingle:
a document that holds the window holds that shingle too. Documents are joined on it; the shingle's place in the window gives the
only possible start; the words from there on, as far as the window is long, are then compared with the window's.

The texts are read once: that scan leaves a row for each document and one for each of its shingles that some window has. Rarity, the
join on rarest shingles and the comparison all work on these rows, whose number is that of the shared words, not of the words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, attach, lower_ascii, text_of

_BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SHINGLE = 3
#: What the window table may hold to be broadcast: rows, and characters of text.
_MOST_ROWS, _MOST_CHARS = 500_000, 64_000_000
#: Rows of a shingle that meet windows in one task, where the join is shuffled.
_SALTED = 100_000
#: Places of the shingles of each width lie apart by more than any text is long.
_APART = 1 << 32


def words(text: Column) -> Column:
    """Words of a text: runs of letters, digits and non-ASCII characters, A-Z lower-cased."""
    return F.array_remove(F.split(lower_ascii(text), _BREAKS), "")


def _mark(text: Column) -> Column:
    """128 bits that tell apart the texts of rows with equal ids."""
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))


def _keyed(docs: DataFrame, widths: list[int], keys: DataFrame | None) -> DataFrame:
    """(doc_id, mark, n, pos, key, gram): a row for each shingle of each width, its hash and words, and one with null key for each row of `docs`.

    With `keys` (small, a column `key`) only shingles among them. It has no union, so that the join with broadcast rows and what follows it
    run in one generated stage with the rows made here: the array of words is then read where it lies and isn't copied for every
    shingle of a long text.
    """
    texts = docs.select("doc_id", _mark(text_of()).alias("mark"), words(text_of()).alias("words")).withColumn("n", F.size("words"))
    placed = texts.select("*", F.posexplode(F.concat("words", F.array(F.lit(None).cast("string")))).alias("at", "w"))
    key = lambda width: F.when(F.col("at") + width <= F.col("n"), F.xxhash64("w", *[F.get("words", F.col("at") + i) for i in range(1, width)]))
    if len(widths) == 1:
        rows = placed.select("*", F.lit(0).alias("kind"), key(widths[0]).alias("key"))
    else:
        rows = placed.select("*", F.posexplode(F.array(*[key(w) for w in widths])).alias("kind", "key"))
    own = F.col("key").isNull() & F.col("w").isNull() & (F.col("kind") == 0)
    if keys is not None:
        rows = rows.join(F.broadcast(keys.select("key", F.lit(True).alias("__in"))), "key", "left").filter(F.col("__in") | own)
    else:
        rows = rows.filter(F.col("key").isNotNull() | own)
    gram = F.concat_ws(" ", F.slice("words", F.col("at") + 1, F.get(F.lit(widths), F.col("kind"))))
    return rows.select("doc_id", "mark", "n", (F.col("at") + F.col("kind") * F.lit(_APART)).alias("pos"), "key", F.when(F.col("key").isNotNull(), gram).alias("gram"))


class Decontaminator:
    """Finds benchmark windows in documents.

    The windows and their rarest shingles are broadcast only while they number at most 500,000 and hold at most 64 million
    characters, which is checked; beyond that the joins are shuffled by shingle, and those of frequent shingles split. Null texts have no words. Null item ids read as ''.
    Repeated items and equal windows count once. Columns besides doc_id, text (documents) and item_id, text (items) don't matter.
    """

    def __init__(self, items: DataFrame, window: int = 10):
        self.items, self.window = items, window

    def _windows(self, scratch: Scratch) -> DataFrame:
        """(wid, k, width, words, items), one row a window; wid is a 128-bit digest of its words."""
        items = self.items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(text_of()).alias("iw")).filter("size(iw) > 0").distinct()
        cut = items.select("item", "iw", F.least(F.size("iw"), F.lit(self.window)).alias("k"))
        cut = cut.select("item", "k", F.explode(F.expr("transform(sequence(1, size(iw) - k + 1), i -> slice(iw, i, k))")).alias("words"))
        windows = cut.groupBy("words", "k").agg(F.collect_set("item").alias("items"))
        return scratch.put(windows.select(F.md5(F.concat_ws(" ", "words")).alias("wid"), "k", F.least(F.lit(_SHINGLE), F.col("k")).alias("width"), "words", "items"), "windows")

    def _found(self, docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
        """The windows, and (doc_id, mark, n, copies, spans, wids) for each distinct pair of id and text; spans and wids are empty without a hit."""
        windows = self._windows(scratch)
        got = windows.agg(F.collect_set("width"), F.count(F.lit(1)), F.sum(F.expr("aggregate(words, 0, (s, x) -> s + length(x) + 1)"))).first()
        widths, few = sorted(got[0]), got[1] <= _MOST_ROWS and (got[2] or 0) <= _MOST_CHARS
        if not widths:
            none = F.expr("cast(array() as array<struct<start:int,end:int>>)"), F.expr("cast(array() as array<string>)")
            each = docs.select("doc_id", _mark(text_of()).alias("mark"), F.size(words(text_of())).alias("n"))
            return windows, scratch.put(each.groupBy("doc_id", "mark", "n").agg(F.count(F.lit(1)).alias("copies")).select("*", none[0].alias("spans"), none[1].alias("wids")), "found")

        places = windows.select("wid", "k", "width", "words", F.explode(F.expr("sequence(0, k - width)")).alias("offset"))
        of = lambda width: F.xxhash64(*[F.get("words", F.col("offset") + i) for i in range(width)])
        places = places.select("wid", "offset", F.when(F.col("width") == 1, of(1)).when(F.col("width") == 2, of(2)).otherwise(of(3)).alias("key"))
        keys = places.select("key").distinct()
        if few:
            rows = _keyed(docs, widths, keys)
        else:
            every = _keyed(docs, widths, None)
            shared = scratch.put(every.filter("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("size")).join(keys, "key"), "shared")
            total = shared.agg(F.sum("size")).first()[0] or 0
            rows = attach(every.filter("key is not null"), shared, "key", "size", total).drop("size").unionByName(every.filter("key is null"))
        rows = scratch.put(rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("copies")), "rows")  # equal rows would pile up at one id

        shingles, own = rows.filter("key is not null"), rows.filter("key is null").select("doc_id", "mark", "n", "copies")
        rarity = shingles.groupBy("key").agg(F.count(F.lit(1)).alias("df"))
        # A window with a shingle that no document has occurs nowhere.
        prefix = places.join(rarity, "key", "left").groupBy("wid").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "offset", "key")).alias("p")).filter("p.df > 0")
        prefix = prefix.join(windows.select("wid", "k", "width", F.concat_ws(" ", "words").alias("words")), "wid").select("wid", "k", "width", "words", "p.offset", "p.key", "p.df")
        prefix = scratch.put(prefix, "prefix")

        reach = max(self.window - _SHINGLE, 0)
        around = Window.partitionBy("doc_id", "mark").orderBy("pos").rangeBetween(-reach, reach)
        seen = shingles.withColumn("near", F.collect_set(F.struct("pos", "gram")).over(around)).drop("gram", "copies", "n")
        if few:
            met = seen.join(F.broadcast(prefix), "key")
        else:
            last = (F.col("df") / _SALTED).cast("int")
            marked = seen.join(prefix.groupBy("key").agg(F.max("df").alias("df")), "key").withColumn("salt", F.pmod(F.xxhash64("doc_id", "mark", "pos"), last + 1)).drop("df")
            met = marked.join(prefix.select("*", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))).alias("salt")), ["key", "salt"])
        met = met.withColumn("first", F.col("pos") - F.col("offset")).withColumn("run", F.expr("array_sort(filter(near, x -> x.pos >= first and x.pos <= first + k - width))"))
        same = F.expr("concat_ws(' ', transform(slice(run, 1, size(run) - 1), x -> substring_index(x.gram, ' ', 1)), element_at(run, -1).gram)") == F.col("words")
        real = met.filter(F.expr("size(run) = k - width + 1")).filter(same)
        start = (F.col("first") % _APART).cast("int")
        real = real.select("doc_id", "mark", F.struct(start.alias("start"), (start + F.col("k")).alias("end")).alias("span"), "wid")
        both = real.unionByName(own, allowMissingColumns=True)
        found = both.groupBy("doc_id", "mark").agg(F.max("n").alias("n"), F.max("copies").alias("copies"), F.array_sort(F.collect_set("span")).alias("spans"), F.array_sort(F.collect_set("wid")).alias("wids"))
        return windows, scratch.put(found, "found")

    @staticmethod
    def _named(found: DataFrame, windows: DataFrame, scratch: Scratch) -> DataFrame:
        """(wids, size, item_ids): for each distinct set of windows how many rows of `found` have it, and the sorted items; looked up once a set."""
        sets = found.filter("size(wids) > 0").groupBy("wids").agg(F.count(F.lit(1)).alias("size"))
        items = sets.select("*", F.explode("wids").alias("wid")).join(windows.select("wid", F.explode("items").alias("item")), "wid")
        return scratch.put(items.groupBy("wids", "size").agg(F.array_sort(F.collect_set("item")).alias("item_ids")), "sets")

    def hits(self, docs: DataFrame) -> DataFrame:
        """(doc_id, spans, item_ids) for each distinct pair of id and text with a hit; spans hold start and end in words."""
        scratch = Scratch(docs.sparkSession, "leaks")
        windows, found = self._found(docs, scratch)
        return found.join(self._named(found, windows, scratch), "wids").select("doc_id", "spans", "item_ids")

    def report(self, docs: DataFrame) -> DataFrame:
        """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated), a row for each row of `docs`."""
        scratch = Scratch(docs.sparkSession, "leaks")
        windows, found = self._found(docs, scratch)
        digest = lambda ids: F.sha2(F.array_join(ids, ","), 256)
        named = self._named(found, windows, scratch).select("wids", "size", F.size("item_ids").alias("n_items"), digest("item_ids").alias("items_sha256"))
        total = named.agg(F.sum("size")).first()[0] or 0
        hit = attach(found.filter("size(wids) > 0"), named, "wids", "size", total).drop("size")
        rest = found.filter("size(wids) = 0").select("*", F.lit(0).alias("n_items"), F.sha2(F.lit(""), 256).alias("items_sha256"))
        covered = "aggregate(spans, named_struct('till', 0, 'hit', 0L), (a, s) -> named_struct('till', greatest(a.till, s.end), 'hit', a.hit + greatest(0, s.end - greatest(a.till, s.start))), a -> a.hit)"
        each = hit.unionByName(rest).withColumn("n_hit", F.expr(covered)).select("*", F.explode(F.expr("sequence(1L, copies)")).alias("copy"))
        return each.select("doc_id", F.col("n").cast("long").alias("n_words"), "n_hit", F.col("n_items").cast("long").alias("n_items"), "items_sha256", (F.col("n_hit") > 0).alias("contaminated"))

    def clean(self, docs: DataFrame) -> DataFrame:
        """The rows of `docs` without a hit; all columns stay."""
        hits = self._found(docs, Scratch(docs.sparkSession, "leaks"))[1].filter("size(wids) > 0").select(F.col("doc_id").alias("__d"), F.col("mark").alias("__m"))
        return docs.join(hits, docs["doc_id"].eqNullSafe(hits["__d"]) & (_mark(text_of()) == hits["__m"]), "left_anti")
