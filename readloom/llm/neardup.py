"""Operator 8: near duplicates by a multi-index Hamming join of b-bit MinHash signatures.

A document's set of word shingles is hashed to a signature of ``CHUNKS * WIDTH`` symbols of 16 bits; two sets of
similarity J agree on a symbol with a chance of J (and a little). A signature is split into chunks. By the pigeonhole
principle, two signatures that differ in at most ``2 * CHUNKS - 1`` symbols have a chunk with at most one error, so
every chunk is stored under each of its forms with one symbol left out: whatever differs in one symbol shares a form.
All pairs within the distance meet; with 12 chunks of 4 a pair at similarity 0.8 is beyond it about twice in a
million, and pairs above less often.

Documents with equal sets are one class. Every class first meets the smallest class that shares a form with it; pairs
within the distance are confirmed on the full sets, and links make components. What is left are classes that share a form
with a class of another component. Where texts share a template that can be any two of them, though few pairs are near,
so the crowd of a form is split by what near sets must share: with shingles in one order, frequent ones last, two sets of
the similarity have a shingle in common among the first ninth of the smaller and the first fifth of the larger one. Only
classes that share such a shingle are compared, in tiles of bounded size: first signatures alone, where a tile returns a
forest that ties together what is within the distance; then, for classes in such a forest, full sets, where a tile returns
the links that join components. So no link is lost, copies are never expanded into pairs, no group meets in one task, and
texts move only where a pair is within the distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.grouping import by_group
from .common import materialize, returned, table
from .components import components
from .wordhash import mixed, parts, run_hashes, word_hashes

CHUNKS, WIDTH = 12, 4
SYMBOLS = CHUNKS * WIDTH
DISTANCE = 2 * CHUNKS - 1
#: Classes of a side of a tile: of signatures alone, and with texts. A class goes to as many tiles as its unit fills.
SIGNATURE_TILE, TILE = 1024, 512
#: Kinds of tiles: the largest component of a unit against the others, and those against each other.
TOP, REST = 0, 1
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Texts whose sets a task keeps while it confirms pairs.
KEPT_SETS = 2000
#: Pairs with one class that meet its text in a task.
HUB_PAIRS = 256
#: Texts that the order of shingles is drawn from, and frequent shingles that it knows. Any order gives the same links.
SAMPLE_TEXTS, FREQUENT = 20_000, 500_000
#: A table of at most so many ids is sent to all executors; a larger one is joined by a shuffle.
BROADCAST_IDS = 1_000_000
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def shingle_sets(column: pa.Array, size: int) -> list[np.ndarray]:
    """By row, the sorted distinct hashes of a text's word shingles; with fewer words, of the whole sequence; else none.

    Words are runs without ASCII white space; only A-Z are lower-cased.
    """
    words, first = word_hashes(column, lower=True)
    codes = run_hashes(words, size)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        out.append(np.unique(codes[a : b - size + 1]) if b - a >= size else run_hashes(words[a:b], b - a) if b > a else codes[:0])
    return out


_SEEDS = mixed(np.arange(1, SYMBOLS + 1, dtype=np.uint64) * _ODD)


def signature(s: np.ndarray) -> np.ndarray:
    """The low 16 bits of the smallest hash under each seed."""
    low = np.full(SYMBOLS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 1024):
        part = s[i : i + 1024]
        low = np.minimum(low, ((part[None, :] ^ _SEEDS[:, None]) * _MIX[0] ^ ((part[None, :] ^ _SEEDS[:, None]) >> np.uint64(32)) * _MIX[1]).min(axis=1))
    return (mixed(low) & np.uint64(0xFFFF)).astype("<u2")


def forms(signatures: np.ndarray) -> np.ndarray:
    """By row, the forms of all chunks with one symbol left out: its place, then the three symbols that stay."""
    sig = signatures.reshape(len(signatures), CHUNKS, WIDTH).astype(np.int64)
    out = []
    for gone in range(WIDTH):
        code = np.arange(CHUNKS, dtype=np.int64)[None, :] * WIDTH + gone
        for i in range(WIDTH):
            if i != gone:
                code = (code << 16) | sig[:, :, i]
        out.append(code)
    return np.concatenate(out, axis=1)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if not len(a) or not len(b):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def prefixes(s: np.ndarray, frequent: np.ndarray, times: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Of a set of shingles, those of which it has one in common with every larger set of the similarity (that has it among
    both these and the next), and the next, of which it has one in common with smaller sets.

    Shingles come in order of their times among ``frequent`` ones (0 for others), then of their hash. A common part of at
    least c shingles has one among the first n - c + 1 of either set.
    """
    n = len(s)
    at = np.minimum(np.searchsorted(frequent, s), max(len(frequent) - 1, 0))
    often = np.where(frequent[at] == s, times[at], 0) if len(frequent) else np.zeros(n, np.int64)
    order = s[np.lexsort((s, often))]
    inner, outer = n + 1 + -2 * percent * n // (100 + percent), n + 1 + -percent * n // 100
    return order[:inner], order[inner:outer]


class Within:
    """Joins whatever is within the distance."""

    def __init__(self, rep: list[int]):
        self.rep = rep

    def node(self, x: int) -> int:
        return self.rep[x]

    def __call__(self, x: int, y: int) -> bool:
        return True


class OnFullSets:
    """Joins components by links, confirmed on full sets, of which a bounded number is kept."""

    def __init__(self, root: list[int], text: list[str], shingle: int, percent: int):
        self.root, self.text, self.shingle, self.percent, self.sets = root, text, shingle, percent, {}

    def node(self, x: int) -> int:
        return self.root[x]

    def set_of(self, x: int) -> np.ndarray:
        if x not in self.sets:
            if len(self.sets) > KEPT_SETS:
                self.sets.clear()
            self.sets[x] = shingle_sets(pa.array([self.text[x]]), self.shingle)[0]
        return self.sets[x]

    def __call__(self, x: int, y: int) -> bool:
        return linked(self.set_of(x), self.set_of(y), self.percent)


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept (doc_id = component_id) of every row.

    Null and empty texts, and texts without words, have no shingles and are linked with nothing; an empty table gives
    no rows; long texts count whole; rows that repeat a doc_id are each judged by their text; rows with a null doc_id
    are linked with nothing and have null in both last columns; other columns are not read.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for part in parts(batches, 1):
            sets = shingle_sets(part.column(1), shingle)
            digests = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            h1, h2 = ([int.from_bytes(d[i : i + 8], "little", signed=True) for d in digests] for i in (0, 8))
            sig = [signature(s).tobytes() if len(s) else b"" for s in sets]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(sig, pa.binary())], names=["doc_id", "n_shingles", "h1", "h2", "sig"])

    def shared_forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.array(batch.column(0), np.int64)
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u2").reshape(len(ids), SYMBOLS)
            for i in range(0, len(ids), 2000):
                keys = forms(sig[i : i + 2000])
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(ids[i : i + 2000], keys.shape[1]))], names=["form", "rep"])

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(a, salt, b, text), the texts of a before those of each b of it: the pairs that are links."""
        now, sets = None, []
        for batch in batches:
            for part in parts([batch], 3):
                found = []
                for key, b, s in zip(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True), part.column(2).to_pylist(), shingle_sets(part.column(3), shingle), strict=True):
                    if key != now:
                        now, sets = key, []
                    if b is None:
                        sets.append(s)
                    elif any(linked(x, s, percent) for x in sets):
                        found.append((key[0], b))
                yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    rows = materialize(source.mapInArrow(returned(sign), "doc_id long, n_shingles long, h1 long, h2 long, sig binary"), "signatures")
    known = rows.filter((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    classes = materialize(known.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n")), "classes")
    held = classes.select("rep", "sig").mapInArrow(returned(shared_forms), "form long, rep long")
    buckets = materialize(held.groupBy("form").agg(F.min("rep").alias("hub"), F.max("rep").alias("far"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "buckets")
    crowds = materialize(held.join(buckets.filter("n > 2").select("form", "hub", "n"), "form"), "crowds")
    # First each class meets the smallest class of any form it has: one pair a class.
    stars = buckets.filter("n = 2").select("hub", F.col("far").alias("rep")).unionByName(crowds.select("hub", "rep"))
    pairs = stars.filter("hub != rep").groupBy(F.col("rep").alias("b")).agg(F.min("hub").alias("a")).select("a", "b")

    def near(pairs: DataFrame) -> DataFrame:
        """The pairs within the distance whose sizes allow the similarity."""
        side = lambda x: classes.select(F.col("rep").alias(x), F.col("sig").alias(f"sig_{x}"), F.col("n").alias(f"n_{x}"))
        met = pairs.filter("a != b").distinct().join(side("a"), "a").join(side("b"), "b")

        def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                m = [np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u2").reshape(-1, SYMBOLS) for i in (2, 3)]
                keep = pa.array((m[0] != m[1]).sum(axis=1) <= DISTANCE)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

        return met.filter(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")).select("a", "b", "sig_a", "sig_b").mapInArrow(returned(within), "a long, b long")

    def texts_of(ids: DataFrame, tag: str) -> DataFrame:
        ids = materialize(ids.distinct(), f"{tag}-ids")
        ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
        return materialize(source.join(ids, "doc_id", "left_semi"), f"{tag}-texts")

    def confirmed(pairs: DataFrame, tag: str) -> DataFrame:
        """The pairs (a, b) that are links. The text of an a with many pairs goes to several tasks, once to each."""
        pairs = materialize(near(pairs), f"{tag}-pairs")
        salts = materialize(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / HUB_PAIRS).cast("int").alias("salts")), f"{tag}-salts")
        wanted = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id")))
        texts = texts_of(wanted, tag)
        few = F.broadcast(salts) if salts.count() <= BROADCAST_IDS else salts
        of_b = pairs.join(few, "a").select("a", F.pmod(F.xxhash64("b"), "salts").cast("int").alias("salt"), "b").join(texts.withColumnRenamed("doc_id", "b"), "b")
        of_a = salts.select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")).join(texts.withColumnRenamed("doc_id", "a"), "a")
        met = of_b.select("a", "salt", "b", "text").unionByName(of_a.select("a", "salt", F.lit(None).cast("long").alias("b"), "text"))
        met = met.repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
        return materialize(met.mapInArrow(returned(confirm), "a long, b long"), f"{tag}-links").distinct()

    def across(part: dict[str, np.ndarray], link) -> dict[str, np.ndarray]:
        """The pairs in one tile, from different components and within the distance, that ``link`` accepts (by place), as
        far as they join what is not joined in it. Of a pair, the first one by size must be ``inner``."""
        rep, root, size, own, large, inner = (part[c] for c in ("rep", "root", "size", "own", "large", "inner"))
        sig = np.frombuffer(b"".join(part["sig"]), "<u2").reshape(-1, SYMBOLS)
        up: dict[int, int] = {}

        def top(x: int) -> int:
            while up.get(x, x) != x:
                x = up[x]
            return x

        a, b = [], []
        top_cell = part["kind"][0] == TOP
        side = large if top_cell else own
        two = top_cell or part["i"][0] != part["j"][0]
        for x in np.nonzero(inner[:-1])[0].tolist():
            fit = (root[x + 1 :] != root[x]) & (100 * np.minimum(size[x + 1 :], size[x]) >= percent * np.maximum(size[x + 1 :], size[x]))
            if two:
                fit &= side[x + 1 :] != side[x]
            hit = np.nonzero(fit)[0] + x + 1
            if len(hit):
                hit = hit[(sig[hit] != sig[x]).sum(axis=1) <= DISTANCE]
            for y in hit.tolist():
                rx, ry = top(link.node(x)), top(link.node(y))
                if rx != ry and link(x, y):
                    up[max(rx, ry)] = min(rx, ry)
                    a.append(rep[x])
                    b.append(rep[y])
        return {"a": np.array(a, np.int64), "b": np.array(b, np.int64)}

    def unlike(part: dict[str, np.ndarray], *columns: str) -> dict[str, np.ndarray]:
        """The rows of a sorted tile that differ from the one before in one of the columns."""
        new = np.ones(len(part["rep"]), bool)
        new[1:] = np.logical_or.reduce([part[c][1:] != part[c][:-1] for c in columns])
        return part if new.all() else {c: v[new] for c, v in part.items()}

    def near_tile(part: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        """A forest of the classes within the distance of each other: any two of them are joined in it."""
        part = unlike(part, "rep", "cls")
        return across(part, Within(part["rep"].tolist()))

    def tile(part: pd.DataFrame) -> pd.DataFrame:
        """The links between components in one tile."""
        part = part.drop_duplicates(["rep", "text"]).sort_values(["size", "rep"])
        return pd.DataFrame(across({c: part[c].to_numpy() for c in part}, OnFullSets(part["root"].tolist(), part["text"].tolist(), shingle, percent)))

    def in_cells(mine: DataFrame, tile: int) -> DataFrame:
        """``mine`` (unit, root, rep and others) in every cell where a class of its unit is met.

        The largest component of a unit is never compared with itself: it is cut into tiles that all others visit.
        """
        crowd = mine.groupBy("unit", "root").agg(F.count(F.lit(1)).alias("n"))
        crowd = materialize(crowd.groupBy("unit").agg(F.max(F.struct("n", "root")).alias("top"), F.sum("n").alias("all")).select("unit", F.col("top.root").alias("top_root"), F.col("top.n").alias("n_top"), F.col("all")), "crowd")
        last = lambda n: F.greatest(F.ceil(n / tile).cast("long"), F.lit(1).cast("long")) - 1
        met = mine.join(crowd, "unit").withColumn("large", F.col("root") == F.col("top_root"))
        met = met.withColumns({"last_top": last(F.col("n_top")), "last_rest": last(F.col("all") - F.col("n_top"))})
        met = met.withColumn("own", F.pmod(F.xxhash64("rep"), F.when(F.col("large"), F.col("last_top")).otherwise(F.col("last_rest")) + 1))
        zero = F.lit(0).cast("long")
        cell = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"))
        to_rest = F.transform(F.sequence(zero, F.col("last_rest")), lambda t: cell(TOP, F.col("own"), t))
        to_top = F.transform(F.sequence(zero, F.col("last_top")), lambda t: cell(TOP, t, F.col("own")))
        to_own = F.transform(F.sequence(zero, F.col("last_rest")), lambda t: cell(REST, F.least(F.col("own"), t), F.greatest(F.col("own"), t)))
        cells = F.when(F.col("large"), to_rest).otherwise(F.concat(to_top, to_own))
        return met.withColumn("cell", F.explode(cells)).select(*mine.columns, "own", "large", "cell.*")

    def with_prefixes(mine: DataFrame) -> DataFrame:
        """(cls, rep, root, size, sig, head, tail) of the classes whose rep is in ``mine`` (rep, root), with both parts of
        ``prefixes``; cls is the first half of the digest of the set."""
        some = mine.select(F.col("rep").alias("doc_id")).distinct()
        n = some.count()
        few = F.broadcast(some) if n <= BROADCAST_IDS else some
        texts = source.join(few, "doc_id", "left_semi")
        step = max(1, -(-n // SAMPLE_TEXTS))
        sample = source.join(F.broadcast(some.filter(F.pmod(F.xxhash64("doc_id"), F.lit(step)) == 0)), "doc_id", "left_semi")  # about SAMPLE_TEXTS

        def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in parts(batches, 1):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*shingle_sets(part.column(1), shingle), np.empty(0, np.uint64)]).view(np.int64))], names=["h"])

        often = sample.mapInArrow(returned(shingles), "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 2").orderBy(F.desc("n"), "h").limit(FREQUENT).toArrow()
        codes, times = often.column("h").to_numpy().view(np.uint64), often.column("n").to_numpy()
        order = np.argsort(codes)
        known = docs.sparkSession.sparkContext.broadcast((codes[order], times[order]))

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import xxhash

            for part in parts(batches, 1):
                sets = shingle_sets(part.column(1), shingle)
                digests = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                h1, h2 = ([int.from_bytes(d[i : i + 8], "little", signed=True) for d in digests] for i in (0, 8))
                both = [prefixes(s, *known.value, percent) for s in sets]
                lists = [pa.array([p[i].view(np.int64) for p in both], pa.list_(pa.int64())) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), *lists], names=["rep", "h1", "h2", "head", "tail"])

        found = texts.mapInArrow(returned(cut), "rep long, h1 long, h2 long, head array<long>, tail array<long>").join(classes.select("h1", "h2", "rep", "sig", F.col("n").alias("size")), ["h1", "h2", "rep"])
        return materialize(found.dropDuplicates(["h1", "h2"]).join(mine.distinct(), "rep").select(F.col("h1").alias("cls"), "rep", "root", "size", "sig", "head", "tail"), "prefixes")

    links = confirmed(pairs, "star")
    roots = materialize(components(links), "roots")

    # Classes that share a form with a class of another component.
    root = lambda x: roots.select(F.col("node").alias(x), F.col("root").alias(f"{x}_root"))
    placed = buckets.filter("n = 2").select("hub", F.col("far").alias("rep")).join(root("rep"), "rep", "left").join(root("hub"), "hub", "left")
    placed = placed.withColumns({"rep_root": F.coalesce("rep_root", "rep"), "hub_root": F.coalesce("hub_root", "hub")}).filter("rep_root != hub_root")
    rooted = crowds.select("form", "rep").join(root("rep"), "rep", "left").withColumn("root", F.coalesce("rep_root", "rep"))
    mixed_forms = materialize(rooted.groupBy("form").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low != high").select("form"), "mixed-forms")
    mine = rooted.join(mixed_forms, "form").select("rep", "root").unionByName(placed.select("rep", F.col("rep_root").alias("root"))).unionByName(placed.select(F.col("hub").alias("rep"), F.col("hub_root").alias("root")))
    mine = materialize(mine.distinct(), "apart-classes")
    if not mine.isEmpty():
        # Of these, the ones that share a shingle which near sets must share.
        held = with_prefixes(mine)
        cut = lambda c, inner: held.select("cls", "root", F.lit(inner).alias("inner"), F.explode(c).alias("unit"))
        tokens = cut("head", True).unionByName(cut("tail", False))
        crew = [F.bit_xor(F.xxhash64(F.lit(seed), "cls", "inner")).alias(f"crew{seed}") for seed in (1, 2)]
        live = tokens.groupBy("unit").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.bool_or("inner").alias("some"), F.count(F.lit(1)).alias("n"), *crew)
        # Of shingles that the same classes have, one is enough.
        live = materialize(live.filter("low != high and some").groupBy("n", "crew1", "crew2").agg(F.min("unit").alias("unit")).select("unit"), "live-shingles")
        few = F.broadcast(live) if live.count() <= BROADCAST_IDS else live
        crowd = materialize(tokens.join(few, "unit").select("unit", "cls", "inner").join(held.select("cls", "rep", "root", "size", "sig"), "cls"), "token-classes")
        # Dealt by cell: units are uneven, and the join before would leave each of them in one task. The number of
        # partitions is fixed, as a cell has few bytes for the work it is.
        width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        cells = ["unit", "kind", "i", "j"]
        forest = materialize(by_group(in_cells(crowd, SIGNATURE_TILE), cells, ["size", "rep", "cls"], near_tile, "a long, b long", width), "near-forest")
        nearer = components(forest).select(F.col("node").alias("rep"), F.col("root").alias("unit"))
        closer = materialize(held.select("cls", "rep", "root", "size", "sig", F.lit(True).alias("inner")).join(nearer, "rep"), "near-classes")
        texts = texts_of(closer.select(F.col("rep").alias("doc_id")), "apart")
        # With texts, a tile comes to Python by itself: a batch of rows of many tiles would be as large as their texts.
        spread = in_cells(closer, TILE).join(texts.withColumnRenamed("doc_id", "rep"), "rep").repartition(*cells)
        more = materialize(spread.groupBy(*cells).applyInPandas(tile, "a long, b long"), "rest-links")
        roots = materialize(components(links.unionByName(more)), "roots")

    ends = materialize(classes.select("h1", "h2", "rep").join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("h1", "h2", F.coalesce("root", "rep").alias("component_id")), "class-roots")
    placed = rows.select("doc_id", "n_shingles", "h1", "h2").join(ends, ["h1", "h2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return placed.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id") == F.col("component_id"))


def op8_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of all documents by four-word shingles at a similarity of 0.8."""
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=4, percent=80)
