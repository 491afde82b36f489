"""Operator 9: document fingerprints from closed syncmers, in SQL functions only.

The symbols are words (runs without white space), hashed to 64 bits. A window of ``K`` words is chosen when, of the
inner windows of ``S`` words in it, the one with the smallest hash is the first or the last. Whether a window is chosen
depends on its own words alone, so an edit elsewhere moves no anchor. A fingerprint is the hashes of all chosen windows
in order of place, in decimal, beside their places (the index of the first word); likeness matches two of them in that
order. Texts of fewer than K words have their whole sequence as the one window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ranking import ranked
from .common import materialize, table

K, S = 4, 2
#: Segments of neighbouring doc_ids, cut at quantiles in two levels of 32; buckets are even parts of them, without a limit.
SEGMENTS = 1024
_LOWEST = -(1 << 63)
BROADCAST_ROWS = 1_000_000


def let(value: Column, use) -> Column:
    """use(value), with value computed once: as the variable of a lambda it is not written into its uses."""
    return F.transform(F.array(value), use)[0]


def upto(n: Column) -> Column:
    """0 .. n - 1; empty below 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def window_hash(words: Column, start: Column, size: int) -> Column:
    return F.xxhash64(*[F.get(words, start + i) for i in range(size)])


def closed_syncmers(words: Column, k: int, s: int) -> Column:
    """The chosen windows in order of place, each as place << 31 | hash of 31 bits."""
    inner = k - s + 1
    coded = lambda p, h: F.shiftleft(p.cast("long"), 31).bitwiseOR(h.bitwiseAND(F.lit(0x7FFFFFFF)))

    def chosen(h: Column) -> Column:
        at = F.filter(upto(F.size(words) - (k - 1)), lambda p: F.array_min(F.slice(h, p + 1, F.lit(inner))).isin(F.get(h, p), F.get(h, p + (inner - 1))))
        return F.transform(at, lambda p: coded(p, window_hash(words, p, k)))

    found = let(F.transform(upto(F.size(words) - (s - 1)), lambda i: window_hash(words, i, s)), chosen)
    whole = F.when(F.size(words) > 0, F.array(coded(F.lit(0), F.aggregate(words, F.lit(0).cast("long"), lambda a, w: F.xxhash64(a, w))))).otherwise(F.array().cast("array<bigint>"))
    return F.when(F.size(words) >= k, found).otherwise(whole)


def fingerprint(text: Column, k: int = K, s: int = S) -> Column:
    """All chosen windows of a text, see closed_syncmers; empty for texts without words."""
    words = F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     "), " "), "")
    return let(F.transform(words, lambda w: F.xxhash64(w)), lambda u: closed_syncmers(u, k, s))


def hashes(fp: Column) -> Column:
    return F.transform(fp, lambda x: x.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int"))


def places(fp: Column) -> Column:
    return F.transform(fp, lambda x: F.shiftright(x, 31).cast("int"))


def _occurrences(a: Column, side: int) -> Column:
    """(hash, how often it was there before, side, index) of each element, by hash."""
    rows = F.sort_array(F.transform(a, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def numbered(r: Column) -> Column:
        starts = F.filter(upto(F.size(r)), lambda j: (j == 0) | (F.get(r, j)["h"] != F.get(r, j - 1)["h"]))
        one = lambda x, n: F.struct(x["h"].alias("h"), n.alias("n"), F.lit(side).alias("side"), x["i"].alias("i"))
        group = lambda b, g, all_: F.transform(F.slice(r, b + 1, F.coalesce(F.get(all_, g + 1), F.size(r)) - b), one)
        return let(starts, lambda all_: F.flatten(F.transform(all_, lambda b, g: group(b, g, all_))))

    return let(rows, numbered)


#: Steps of a search in an ordered array, largest first: arrays have fewer elements than twice the first.
_STEPS = [1 << i for i in range(26, -1, -1)]


def _how_many(x: Column, holds) -> Column:
    """For how many elements of ``x``, of which the first ones alone do, ``holds`` is true; by halving."""
    steps = F.array(*map(F.lit, _STEPS))
    return F.aggregate(steps, F.lit(0), lambda at, n: F.when(at + n <= F.size(x), F.when(holds(F.get(x, at + n - 1)), at + n).otherwise(at)).otherwise(at))


def _heaviest_rising(x: Column) -> Column:
    """The weight of the heaviest sequence of elements (v, w), in order, of which v rises.

    Kept are ends of sequences that no other one with as much weight ends before, in order of both; where an element goes,
    and up to where it makes others needless, is found by halving.
    """

    def step(ends: Column, e: Column) -> Column:
        def put(p: Column) -> Column:
            total = F.coalesce(F.get(ends, p - 1)["w"], F.lit(0)) + e["w"]
            one = lambda t: F.array(F.struct(e["v"].alias("v"), t.alias("w")))
            rest = lambda t: let(_how_many(ends, lambda o: o["w"] <= t), lambda q: F.slice(ends, q + 1, F.size(ends)))
            return F.when(p == F.size(ends), F.concat(ends, one(total))).otherwise(let(total, lambda t: F.concat(F.slice(ends, F.lit(1), p), one(t), rest(t))))

        return let(_how_many(ends, lambda o: o["v"] < e["v"]), put)

    none = F.array().cast("array<struct<v:int,w:int>>")
    return F.coalesce(let(F.aggregate(x, none, step), lambda ends: F.get(ends, F.size(ends) - 1)["w"]), F.lit(0))


def _longest_rising(x: Column) -> Column:
    """The length of the longest rising subsequence of distinct numbers.

    With every number replaced by its rank, neighbours whose rank goes up by one make a run. No other number lies between
    those of a run, in place or in rank, so a longest sequence has it whole or not at all, and runs with their lengths as
    weights stand for all numbers: what was moved counts, not what is the same.
    """
    ranks = F.transform(F.sort_array(F.transform(x, lambda v, i: F.struct(v.alias("v"), i.alias("i")))), lambda q, r: F.struct(q["i"].alias("i"), r.alias("r")))
    ranked = F.transform(F.sort_array(ranks), lambda q: q["r"])

    def runs(r: Column) -> Column:
        starts = F.filter(upto(F.size(r)), lambda j: (j == 0) | (F.get(r, j) != F.get(r, j - 1) + 1))
        return let(starts, lambda s: F.transform(s, lambda b, g: F.struct(F.get(r, b).alias("v"), (F.coalesce(F.get(s, g + 1), F.size(r)) - b).alias("w"))))

    return _heaviest_rising(let(ranked, runs))


def _in_order(a: Column, b: Column) -> Column:
    """How many equal elements (the n-th of a value with the n-th) come in the same order in both."""
    both = F.sort_array(F.concat(_occurrences(a, 0), _occurrences(b, 1)))

    def matched(m: Column) -> Column:
        same = lambda x, y: (x["h"] == y["h"]) & (x["n"] == y["n"])
        at = F.filter(upto(F.size(m) - 1), lambda j: same(F.get(m, j), F.get(m, j + 1)))
        pairs = F.sort_array(F.transform(at, lambda j: F.struct(F.get(m, j)["i"].alias("a"), F.get(m, j + 1)["i"].alias("b"))))
        return _longest_rising(F.transform(pairs, lambda q: q["b"]))

    return let(both, matched)


def likeness(a: Column, b: Column) -> Column:
    """Anchors that match in order of place, over those of both without the matches; 1 for two empty ones.

    What both begin with matches as it is; the rest is matched by value and order, where it has values in common.
    """
    n = lambda x: F.size(x)
    shorter = F.least(n(a), n(b))
    first = F.array_position(F.zip_with(F.slice(a, F.lit(1), shorter), F.slice(b, F.lit(1), shorter), lambda x, y: x == y), F.lit(False))
    begun = F.when(first > 0, first - 1).otherwise(shorter).cast("int")
    rest = lambda x, p: F.slice(x, p + 1, n(x))
    more = lambda x, y: F.when(F.arrays_overlap(x, y), _in_order(x, y)).otherwise(F.lit(0))
    total = let(begun, lambda p: p + let(rest(a, p), lambda x: let(rest(b, p), lambda y: more(x, y))))
    share = let(total, lambda t: t / (n(a) + n(b) - t))
    return F.when((n(a) == 0) & (n(b) == 0), F.lit(1.0)).otherwise(share)


def _if_small(df: DataFrame) -> DataFrame:
    """``df``, marked to be sent to all executors if it has at most BROADCAST_ROWS rows; else it is joined by a shuffle."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def bucketed(docs: DataFrame, buckets: int) -> DataFrame:
    """``docs`` (place, tie and others) with bucket, which never falls along place and then tie.

    Quantiles of place cut at most ``SEGMENTS`` segments, each of them evenly into as many parts as the number of buckets
    asks for, so buckets grow with the rows. A place with more rows than a bucket should hold is cut by tie, a hash.
    """
    segments = max(1, min(buckets, SEGMENTS))
    parts = -(-buckets // segments)
    at = [i / segments for i in range(1, segments)]
    cuts = sorted({int(c) for c in docs.approxQuantile("place", at, 1 / (4 * segments))}) if at else []
    ends = docs.agg(F.min("place"), F.max("place"), F.count(F.lit(1))).first()
    if ends[0] is None:
        return docs.withColumns({"bucket": F.lit(0).cast("long"), "part": F.lit(0).cast("long")})
    bounds = [ends[0], *[c for c in cuts if c > ends[0]], min(ends[1] + 1, (1 << 63) - 1)]
    longs = lambda x: F.array(*map(F.lit, x)).cast("array<bigint>")
    fine, step = longs(bounds[1:-1]), 32
    block = F.size(F.filter(longs(bounds[32:-1:32]), lambda c: c <= F.col("place"))) if len(bounds) > 33 else F.lit(0)
    segment = let(block * step, lambda b: b + F.size(F.filter(F.slice(fine, b + 1, F.lit(step)), lambda c: c <= F.col("place")))) if len(bounds) > 2 else F.lit(0)
    # In decimals: places reach over all longs.
    wide = lambda c: c.cast("decimal(20,0)")
    low, width = (lambda g: wide(F.get(longs(bounds), g))), (lambda g: wide(F.get(longs(bounds), g + 1)) - wide(F.get(longs(bounds), g)))
    share = lambda g: F.coalesce(F.floor((wide(F.col("place")) - low(g)) * F.lit(parts).cast("decimal(10,0)") / F.nullif(width(g), F.lit(0).cast("decimal(21,0)"))), F.lit(0))
    docs = docs.withColumn("bucket", let(segment, lambda g: g.cast("long") * parts + F.least(share(g).cast("long"), F.lit(parts - 1).cast("long"))))
    most = max(1, ends[2] // buckets)
    hot = docs.groupBy("bucket", "place").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 2 * most)  # at most buckets / 2 of them
    hot = materialize(hot.groupBy("bucket").agg(F.collect_list(F.struct("place", F.ceil(F.col("n") / most).cast("long").alias("slices"))).alias("hot")), "hot-places")
    met = docs.join(_if_small(hot), "bucket", "left")
    # A bucket with hot places has, in order, what lies before the first, its slices, what lies up to the second, and so on.
    before = F.size(F.filter("hot", lambda h: h["place"] < F.col("place")))
    own = F.get(F.filter("hot", lambda h: h["place"] == F.col("place")), F.lit(0))["slices"]
    part = F.floor((wide(F.col("tie")) + F.lit(str(1 << 63)).cast("decimal(20,0)")) * own.cast("decimal(12,0)") / F.lit(str(1 << 64)).cast("decimal(20,0)")).cast("long")
    zone = (2 * before + own.isNotNull().cast("int")).cast("long")
    return met.withColumn("part", F.when(F.col("hot").isNull(), F.lit(0).cast("long")).otherwise(zone * (1 << 32) + F.coalesce(part, F.lit(0).cast("long")))).drop("hot")


def with_next(docs: DataFrame, order: Column, buckets: int, add) -> DataFrame:
    """Each row with the text and fp of the next one as ``next_*``, descending by ``order``; after the last: the first.

    Rows go to buckets of neighbouring values of ``order``, and a bucket's first row is copied to the end of the one
    before; so no window spans more than a bucket. Texts move once; ``add`` computes what else is needed where they lie.
    """
    docs = bucketed(docs.withColumns({"place": order, "tie": F.xxhash64("text")}), buckets)
    tops = ranked(docs.groupBy("bucket", "part").agg(F.max(F.struct("place", "tie")).alias("top")), ["bucket", "part"], "rank", 0)
    n = tops.count()
    to = tops.select((F.col("rank") - 1 + F.when(F.col("rank") == 0, n).otherwise(0)).alias("rank"), F.col("bucket").alias("to_bucket"), F.col("part").alias("to_part"))
    ends = materialize(tops.join(to, "rank").select("bucket", "part", F.col("top.place").alias("top_place"), F.col("top.tie").alias("top_tie"), "to_bucket", "to_part"), "bucket-tops")
    own = F.struct("bucket", "part", F.lit(0).alias("copy"))
    there = F.struct(F.col("to_bucket").alias("bucket"), F.col("to_part").alias("part"), F.lit(1).alias("copy"))
    first = (F.col("place") == F.col("top_place")) & (F.col("tie") == F.col("top_tie"))
    met = docs.join(_if_small(ends), ["bucket", "part"])
    rows = met.withColumn("at", F.explode(F.when(first, F.array(own, there)).otherwise(F.array(own)))).select("doc_id", "text", "place", "tie", "at.*")
    rows = add(rows.repartition("bucket", "part"))
    line = Window.partitionBy("bucket", "part").orderBy("copy", F.desc("place"), F.desc("tie"))
    for c in ("text", "fp"):
        rows = rows.withColumn(f"next_{c}", F.lead(c).over(line))
    return rows.filter("copy = 0").drop("copy", "bucket", "part", "place", "tie")


def fingerprints(docs: DataFrame, rows_per_bucket: int = 2000) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, places and edited_places.

    The edited text has the last third of its characters replaced by the first as many of the next document's text.
    Null text counts as empty, and an empty text has an empty fingerprint; an empty table gives no rows; a single row
    is its own next one; rows that repeat a doc_id are ordered by a hash of the text, descending; null doc_ids come last;
    long texts count whole; other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n = docs.count()
    buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), n // rows_per_bucket) if n > 1000 else 1
    met = with_next(rows, F.coalesce("doc_id", F.lit(_LOWEST)), buckets, lambda r: r.withColumn("fp", fingerprint(F.col("text"))))
    third = F.floor(F.length("text") / 3).cast("int")
    met = met.select("doc_id", F.length("text").cast("long").alias("n_chars"), "fp", "next_fp", F.concat(F.col("text").substr(F.lit(1), F.length("text") - third), F.col("next_text").substr(F.lit(1), third)).alias("edited"))
    met = met.withColumn("edited_sha256", F.sha2("edited", 256)).withColumn("edited_fp", fingerprint(F.col("edited")))
    met = met.withColumns({"a": hashes(F.col("fp")), "e": hashes(F.col("edited_fp")), "b": hashes(F.col("next_fp"))})
    joined = lambda x: F.array_join(x.cast("array<string>"), " ")
    return met.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        joined(F.col("a")).alias("fingerprint"),
        joined(F.col("e")).alias("edited_fingerprint"),
        let(F.col("a"), lambda a: let(F.col("e"), lambda e: likeness(a, e))).alias("near_edited"),
        let(F.col("a"), lambda a: let(F.col("b"), lambda b: likeness(a, b))).alias("near_next"),
        joined(places(F.col("fp"))).alias("places"),
        joined(places(F.col("edited_fp"))).alias("edited_places"),
    )


def op9_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, with both likenesses."""
    return fingerprints(table(spark, sf_dir, "documents"))
