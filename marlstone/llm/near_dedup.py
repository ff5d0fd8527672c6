"""Near-duplicate detection: consistent weighted sampling over TF-IDF word shingles."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import bit_of, bitmap_of, filter_bits, marked, matched_rows, small_batches, staged, text_key
from .words import Words, chunks, find_words, mixed, run_hashes

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 12, 3  # a pair at the threshold meets in a band with probability 0.9998
RAREST = 1e-3  # share of texts; a shingle in fewer weighs as one in so many
CANDIDATES = 1 << 22  # counters of hashed shingles in a task, and bits of the bitmap of those that may be in more
PART_BYTES = 1 << 18  # of text worked on at once, so that tasks' arrays stay small
TOLD = 0.75  # of the share that makes a shingle common
HELD = 1 << 19  # marked shingles that a task merges at a time
PIVOTS = 6  # of a bucket, before texts are compared with all that may be alike
COUNTERS = 1 << 20  # for the order of shingles from rare to frequent


def shingles(words: Words, length: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, 48-bit key and count of each text's distinct shingles, by text and key. A text of fewer words than
    ``length``, but not none, has one shingle of all of them."""
    n = np.diff(words.first)
    runs = run_hashes(words.hashes, length)
    owner = np.repeat(np.arange(len(n)), n)[: len(runs)]
    whole = np.arange(len(runs)) + length <= words.first[owner + 1]
    owner, keys = owner[whole], runs[whole]
    short = np.flatnonzero((n > 0) & (n < length))
    if len(short):
        few = np.array([run_hashes(words.hashes[words.first[d] : words.first[d + 1]], int(n[d]))[0] for d in short], np.uint64)
        owner, keys = np.concatenate((owner, short)), np.concatenate((keys, mixed(few + np.uint64(1))))
    packed = np.sort((owner.astype(np.uint64) << np.uint64(48)) | (keys >> np.uint64(16)))
    new = np.ones(len(packed), bool)
    new[1:] = packed[1:] != packed[:-1]
    at = np.flatnonzero(new)
    packed, counts = packed[at], np.diff(at, append=len(packed))
    return (packed >> np.uint64(48)).astype(np.int64), packed & np.uint64((1 << 48) - 1), counts


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (mixed(keys) % np.uint64(buckets)).astype(np.int64)


def _parts(texts: pa.Array) -> Iterator[tuple[int, int]]:
    for lo, hi in chunks(texts, PART_BYTES):
        for a in range(lo, hi, 1 << 15):
            yield a, min(hi, a + (1 << 15))


@dataclass
class Weights:
    """Inverse document frequencies: those of common shingles, by sorted key, and that of all others."""

    keys: np.ndarray
    values: np.ndarray
    rare: float

    def of(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), self.rare, np.float32)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            known = self.keys[at] == keys
            out[known] = self.values[at[known]]
        return out


def inverse_frequencies(docs: DataFrame, text_col: str = "text", shingle: int = SHINGLE, rarest: float = RAREST) -> Weights:
    """log(1 + texts / texts with the shingle), where a shingle in less than ``rarest`` of all texts counts as one in
    that share of them: so two texts' weights depend on how common their shingles are, not on the table's size.

    Frequencies are exact, over all rows. Tasks first count their shingles by hash, in a fixed number of counters, and tell
    of those that reach ``TOLD`` of the share ``rarest`` of their texts, and by how much. What isn't told of is less than that
    in each task, so a counter may only reach the share of all texts if what is told sums to (1 - ``TOLD``) of it or
    more; a task of few texts thus can't make all of its own look common. Such counters mark a bitmap. Then
    marked shingles are counted over all texts, each task merging its own. At most
    (mean distinct shingles of a text) / ``rarest`` can be common, which bounds what comes back to the driver
    and is broadcast, at any size of the table.
    """
    texts = docs.select(F.col(text_col).alias("text"))
    total = docs.count()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, int]]:
        for batch in batches:
            for lo, hi in _parts(batch.column(0)):
                _, keys, _ = shingles(find_words(batch.column(0).slice(lo, hi - lo)), shingle)
                yield keys, hi - lo

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(CANDIDATES, np.int32), 0
        for keys, more in pieces(batches):
            np.add.at(seen, _bucket(keys, CANDIDATES), 1)
            n += more
        told = TOLD * rarest * n
        at = np.flatnonzero(seen >= max(1, told * (1 - 1e-9)))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at] - told)], ["bit", "above"])

    # where a table has many small files, a task reads several, so that few texts don't make much look common
    wide = texts.coalesce(max(1, int(total * rarest / 8)))
    told = wide.mapInArrow(local, "bit long, above double").groupBy("bit").agg(F.sum("above").alias("above"))
    shared = docs.sparkSession.sparkContext.broadcast(bitmap_of(told.filter(F.col("above") >= (1 - TOLD) * rarest * total * (1 - 1e-6)).select("bit")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def merged(held: list[np.ndarray]) -> pa.RecordBatch:
            found, times = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64)), pa.array(times.astype(np.int64))], ["key", "n"])

        held, size = [], 0
        for keys, _ in pieces(batches):
            held.append(keys[marked(shared.value, _bucket(keys, CANDIDATES))])
            size += len(held[-1])
            if size >= HELD:
                yield merged(held)
                held, size = [], 0
        if held:
            yield merged(held)

    counted = texts.mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= rarest * total).toArrow()
    keys = counted["key"].to_numpy().astype(np.uint64)
    order = np.argsort(keys)
    return Weights(keys[order], np.log1p(total / counted["n"].to_numpy()[order]).astype(np.float32), float(np.log1p(1 / rarest)))


def sampled(owner: np.ndarray, keys: np.ndarray, weights: np.ndarray, size: int) -> np.ndarray:
    """Improved consistent weighted sampling (Ioffe 2010): ``size`` samples, a row per text that occurs in
    ``owner``; two texts agree in a sample with probability equal to their weighted Jaccard similarity."""
    firsts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    lengths = np.diff(firsts, append=len(owner))
    log_weight = np.log(weights.astype(np.float32))
    out = np.zeros((len(firsts), size), np.uint64)
    unit = np.float32(2**-32)
    for k in range(size):
        one = mixed(keys ^ np.uint64((0x9E3779B97F4A7C15 * (2 * k + 1)) & (2**64 - 1)))
        two = mixed(one)
        u = [((x >> np.uint64(32)).astype(np.float32) + np.float32(0.5)) * unit for x in (one, one << np.uint64(32), two, two << np.uint64(32))]
        beta = ((one + two) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(40)).astype(np.float32) * np.float32(2**-24)
        r = -np.log(u[0]) - np.log(u[1]) + np.float32(1e-12)
        level = np.floor(log_weight / r + beta)
        cost = np.log(-np.log(u[2]) - np.log(u[3]) + np.float32(1e-12)) - r * (level - beta + 1)
        least = np.minimum.reduceat(cost, firsts)
        at = np.flatnonzero(cost == np.repeat(least, lengths))
        at = at[np.searchsorted(at, firsts)]  # the first of equals, by key
        out[:, k] = mixed(keys[at] + mixed(level[at].astype(np.int64).astype(np.uint64)))
    return out


def digests(words: Words) -> list[np.ndarray]:
    """Twice 64 bits of the word sequence of each text that has words."""
    n = np.diff(words.first)
    full = np.flatnonzero(n > 0)
    inside = np.arange(len(words.hashes)) - np.repeat(words.first[:-1], n)
    out = []
    for salt in (0x1234567, 0x89ABCDEF):
        each = mixed(words.hashes ^ mixed((inside + salt).astype(np.uint64)))
        whole = np.add.reduceat(each, words.first[:-1][full]) if len(full) else np.zeros(0, np.uint64)
        out.append(mixed(whole).astype(np.int64))
    return out


def signatures(
    docs: DataFrame, idf, id_col: str, text_col: str, shingle: int, bands: int, rows: int
) -> DataFrame:
    """``doc_id, text_key, d1, d2, bands``: the text's SHA-256, 128 bits of its word sequence, and a hash for each
    band; the latter null for a text without words."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = idf.value
        for batch in batches:
            for lo, hi in _parts(batch.column(2)):
                words = find_words(batch.column(2).slice(lo, hi - lo))
                full = np.flatnonzero(np.diff(words.first) > 0)
                owner, keys, counts = shingles(words, shingle)
                banded = np.zeros((len(full), bands), np.int64)
                if len(full):
                    samples = sampled(owner, keys, counts * weight.of(keys), bands * rows)
                    for b in range(bands):
                        mix = np.zeros(len(full), np.uint64)
                        for k in range(rows):
                            mix = mixed(mix * np.uint64(31) + samples[:, b * rows + k])
                        banded[:, b] = mix.astype(np.int64)
                place = np.full(hi - lo, -1)
                place[full] = np.arange(len(full))
                take = pa.array(place, mask=place < 0)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(full) + 1) * bands, pa.int32()), pa.array(banded.ravel()))
                yield pa.RecordBatch.from_arrays([
                    *(batch.column(c).slice(lo, hi - lo) for c in (0, 1)), *(pa.array(x, pa.int64()).take(take) for x in digests(words)), lists.take(take),
                ], ["doc_id", "text_key", "d1", "d2", "bands"])

    rows_ = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key(F.col(text_col)).alias("text_key"), F.col(text_col).alias("text"))
    return rows_.mapInArrow(sign, "doc_id long, text_key binary, d1 long, d2 long, bands array<long>")


def shingle_vectors(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """``id, keys, counts``: sorted shingle keys and counts of the texts in ``wanted`` (``id, doc_id, d1, d2``).

    A bitmap of a text's document ids tells tasks which texts may be wanted; the join by word sequence settles it.
    """
    bits = filter_bits(wanted.count())
    shared = docs.sparkSession.sparkContext.broadcast(bitmap_of(wanted.select(bit_of(F.col("doc_id"), bits))))

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.filter(pa.array(marked(shared.value, batch.column(1).to_numpy()))).column(0)
            for lo, hi in _parts(texts):
                words = find_words(texts.slice(lo, hi - lo))
                full = np.flatnonzero(np.diff(words.first) > 0)
                owner, keys, counts = shingles(words, shingle)
                edges = [(np.searchsorted(owner, d), np.searchsorted(owner, d, "right")) for d in full]
                counts = counts.astype(np.uint32)
                yield pa.RecordBatch.from_arrays([
                    *(pa.array(x, pa.int64()) for x in digests(words)),
                    pa.array([keys[a:b].tobytes() for a, b in edges], pa.binary()),
                    pa.array([counts[a:b].tobytes() if (counts[a:b] > 1).any() else b"" for a, b in edges], pa.binary()),
                ], ["d1", "d2", "keys", "counts"])

    rows = docs.filter(F.col(id_col).isNotNull()).select(F.col(text_col).alias("text"), bit_of(F.col(id_col).cast("long"), bits).alias("bit"))
    found = rows.mapInArrow(take, "d1 long, d2 long, keys binary, counts binary").join(wanted.select("id", "d1", "d2"), ["d1", "d2"])
    return found.select("id", "keys", "counts").dropDuplicates(["id"])


def similarities(pairs: DataFrame, vectors: DataFrame, idf) -> DataFrame:
    """``a, b, similarity``: the weighted Jaccard similarity of each pair."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = idf.value

        def vector(keys, counts) -> tuple[np.ndarray, np.ndarray]:
            k = np.frombuffer(keys.as_buffer(), np.uint64)
            n = np.frombuffer(counts.as_buffer(), np.uint32) if len(counts.as_buffer()) else 1
            return k, weight.of(k).astype(np.float64) * n

        for batch in batches:
            out = np.zeros(batch.num_rows)
            for i in range(batch.num_rows):
                (k1, w1), (k2, w2) = (vector(batch.column(c)[i], batch.column(c + 1)[i]) for c in (2, 4))
                _, x, y = np.intersect1d(k1, k2, assume_unique=True, return_indices=True)
                common = np.minimum(w1[x], w2[y]).sum()
                out[i] = common / max(w1.sum() + w2.sum() - common, 1e-12)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out)], ["a", "b", "similarity"])

    left = vectors.select(F.col("id").alias("a"), F.col("keys").alias("k1"), F.col("counts").alias("c1"))
    right = vectors.select(F.col("id").alias("b"), F.col("keys").alias("k2"), F.col("counts").alias("c2"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "k1", "c1", "k2", "c2")
    return both.mapInArrow(compare, "a long, b long, similarity double")


def _hashed_counts(vectors: DataFrame, counters: int) -> np.ndarray:
    """In how many of ``vectors`` a shingle of each of ``counters`` classes occurs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(counters, np.int64)
        for batch in batches:
            for k in range(batch.num_rows):
                np.add.at(seen, _bucket(np.frombuffer(batch.column(0)[k].as_buffer(), np.uint64), counters), 1)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(seen[at])], ["bucket", "n"])

    counted = vectors.select("keys").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(counters, np.int32)
    out[counted["bucket"].to_numpy()] = counted["n"].to_numpy()
    return out


def prefix_pairs(vectors: DataFrame, few: DataFrame, idf, threshold: float, counters: int = COUNTERS) -> DataFrame:
    """``a, b``: all pairs of a text in ``few`` and one of ``vectors`` of another class (``root``) that may reach
    ``threshold``.

    Prefix filtering, exact under any order of shingles. If two texts of total weights V and W reach threshold t,
    their common weight is at least t (V + W) / (1 + t). So in an order from rare to frequent, both have that
    much weight left at the first shingle they share: texts meet on a shingle only where each has enough left.
    The texts in ``few`` come with each class of total weight that a partner may have; a text whose own edits
    weigh too much for a class doesn't meet it on what a group has in common, however large the group is.
    """
    rare = vectors.sparkSession.sparkContext.broadcast(_hashed_counts(vectors, counters))
    part, step = threshold / (1 + threshold), 0.03
    reach = int(np.ceil(np.log(1 / threshold) / step)) + 1

    def tokens(spread: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            weight = idf.value
            for batch in batches:
                for i in range(batch.num_rows):
                    keys = np.frombuffer(batch.column(1)[i].as_buffer(), np.uint64)
                    counts = batch.column(2)[i].as_buffer()
                    w = weight.of(keys).astype(np.float64) * (np.frombuffer(counts, np.uint32) if len(counts) else 1)
                    total = w.sum()
                    order = np.lexsort((keys, rare.value[_bucket(keys, len(rare.value))]))
                    left = total - np.concatenate(([0.0], np.cumsum(w[order])[:-1]))
                    own = int(np.floor(np.log(total) / step))
                    bins = np.arange(own - reach, own + reach + 1) if spread else np.array([own])
                    least = part * (total + (np.exp(bins * step) if spread else np.array([threshold * total])))
                    at, which = np.nonzero(left[:, None] >= least[None, :] * (1 - 1e-9))
                    yield pa.RecordBatch.from_arrays([
                        pa.array(keys[order][at].astype(np.int64)), pa.array(bins[which], pa.int32()), pa.array(np.full(len(at), batch.column(0)[i].as_py()), pa.int64()),
                        pa.array(np.full(len(at), total)), pa.array(left[at]), pa.array(np.full(len(at), batch.column(3)[i].as_py()), pa.int64()),
                    ], ["key", "bin", "id", "total", "left", "root"])

        return run

    schema = "key long, bin int, id long, total double, left double, root long"
    all_ = vectors.select("id", "keys", "counts", "root").mapInArrow(tokens(False), schema)
    some = vectors.join(few, "id", "left_semi").select("id", "keys", "counts", "root").mapInArrow(tokens(True), schema)
    x, y = all_.alias("x"), some.alias("y")
    need = part * (F.col("x.total") + F.col("y.total")) * (1 - 1e-9)
    on = (F.col("x.key") == F.col("y.key")) & (F.col("x.bin") == F.col("y.bin")) & (F.col("x.root") != F.col("y.root")) & (F.least("x.left", "y.left") >= need)
    return x.join(y, on).select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """``id, root``: the least id of each linked id's component, by alternating large and small stars, each a
    grouped minimum and a join. Every step is staged in the shared folder."""
    edges = staged(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = staged(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
        mark = now


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD,
    shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS,
) -> DataFrame:
    """The class of each row: ``doc_id, class_id, kept, text_key`` (SHA-256 of the text). A class is what chains of links join, a link being a
    weighted Jaccard similarity of ``threshold`` or more between TF-IDF weighted shingles of ``shingle`` words.
    ``class_id`` is the class's least id, whose row is the one to keep. Where links are sought between classes only,
    not all links inside a class are looked at, so that there is no count of them.

    1. Document frequencies of all rows give the weights (:func:`inverse_frequencies`).
    2. Each text gets ``bands`` hashes of ``rows`` weighted samples. Texts of the same words are one from here on.
    3. In each band's bucket, members are compared with a pivot, the one that meets most texts in all bands; those
       that aren't of its class then are compared with the next ``PIVOTS - 1`` ones. Who still isn't is compared
       with every text of another class that may reach the threshold, which :func:`prefix_pairs` finds. So a
       bucket of copies of one text costs a few comparisons for each member, and pairs are sought one by one
       only between classes.
    4. Candidate pairs get the exact similarity from both texts' shingles; links are joined to components.

    Shuffled are ids, hashes and candidate texts' shingles, never texts; the driver gets common shingles and
    bitmaps, of bounded size, and counts. Hot buckets and hubs meet in grouped minima, which tasks merge first, and
    in plain shuffle joins, which adaptive execution splits. Staged tables are in the shared folder.

    A null id has a null class and stays. A null text or one without words is alone in its class, as is one of
    fewer words than ``shingle`` unless another has the same words. Rows are told by id and text: an id's other
    texts are in classes of their own. Of a class, the row of least id, and then of least ``text_key``, is kept;
    rows that repeat both are kept or dropped together. An empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    idf = spark.sparkContext.broadcast(inverse_frequencies(docs, text_col, shingle))
    signed = staged(signatures(docs, idf, id_col, text_col, shingle, bands, rows), "signatures")
    texts = signed.filter("d1 IS NOT NULL AND doc_id IS NOT NULL")
    first = F.min(F.struct("doc_id", "text_key"))
    distinct = texts.groupBy("d1", "d2").agg(first.alias("first"), F.first("bands").alias("bands"))
    distinct = staged(distinct.withColumn("id", F.monotonically_increasing_id()), "texts")
    entries = distinct.select("id", F.posexplode("bands").alias("band", "hash"))
    sizes = entries.groupBy("band", "hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    entries = staged(entries.join(sizes, ["band", "hash"]), "entries")
    met_most = entries.groupBy("id").agg(F.struct(F.sum("n").alias("met"), F.xxhash64(F.lit(17), "id").alias("tie"), "id").alias("rank"))
    wanted = distinct.join(met_most, "id", "left_semi").select("id", F.col("first.doc_id").alias("doc_id"), "d1", "d2")
    vectors = staged(shingle_vectors(docs, staged(wanted, "wanted"), id_col, text_col, shingle), "vectors")
    entries = staged(entries.join(met_most, "id").select("band", "hash", "id", "rank"), "ranked")

    def linked(pairs: DataFrame) -> DataFrame:
        return staged(similarities(pairs, vectors, idf).filter(F.col("similarity") >= threshold), "links")

    def classes(links: DataFrame) -> DataFrame:
        return staged(components(links), "classes")

    def classed(df: DataFrame, found: DataFrame, name: str, out: str) -> DataFrame:
        return df.join(found.select(F.col("id").alias(name), F.col("root").alias(out)), name, "left").withColumn(out, F.coalesce(out, name))

    best = entries.groupBy("band", "hash").agg(F.max("rank").alias("p")).select("band", "hash", F.col("p.id").alias("pivot"))
    met = staged(entries.join(best, ["band", "hash"]).filter("id <> pivot").select("id", "pivot").distinct(), "met")
    links = linked(met.select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).distinct())
    found = classes(links)
    # those that aren't of their pivot's class yet meet the next pivots
    place = F.row_number().over(Window.partitionBy("band", "hash").orderBy(F.desc("rank")))
    next_ = entries.withColumn("_n", place).filter((F.col("_n") > 1) & (F.col("_n") <= PIVOTS)).select("band", "hash", F.col("id").alias("pivot"))
    again = classed(classed(entries.join(next_, ["band", "hash"]).filter("id <> pivot").select("id", "pivot").distinct(), found, "id", "r1"), found, "pivot", "r2")
    links = links.unionByName(linked(again.filter("r1 <> r2").select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).distinct()))
    found = classes(links)
    # whoever isn't yet is compared with all that may be alike
    rest = staged(classed(classed(met, found, "id", "r1"), found, "pivot", "r2").filter("r1 <> r2").select("id").distinct(), "rest")
    if not rest.isEmpty():
        links = links.unionByName(linked(prefix_pairs(classed(vectors, found, "id", "root"), rest, idf, threshold)))
        found = classes(links)
    rooted = distinct.select("d1", "d2", "id", "first").join(found, "id", "left").withColumn("root", F.coalesce("root", "id"))
    of_class = rooted.groupBy("root").agg(F.min("first").alias("best"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    rooted = rooted.join(of_class, "root", "left").select("d1", "d2", F.coalesce("best", "first").alias("best"))
    grouped = signed.join(rooted, ["d1", "d2"], "left")
    class_id = F.when(F.col("doc_id").isNotNull(), F.coalesce("best.doc_id", "doc_id"))
    # without a class: no id, or no words
    kept = F.coalesce((F.col("best.doc_id") == F.col("doc_id")) & (F.col("best.text_key") == F.col("text_key")), F.lit(True))
    return grouped.select("doc_id", class_id.alias("class_id"), kept.alias("kept"), "text_key")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all columns, that :func:`near_duplicates` keeps; only rows whose id and text are those of
    a dropped one go. Repeated rows, nulls and empty tables are as there."""
    found = staged(near_duplicates(docs, id_col, text_col, **options).filter(~F.col("kept")), "near-copies")
    return matched_rows(docs, found, id_col, text_key(F.col(text_col)), "left_anti")
