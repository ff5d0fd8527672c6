"""Quality filter: interpolated modified Kneser-Ney models of trusted text, one for each language.

The models are of characters, with n-gram counts as tables sharded by language and n-gram, so that they grow with the
text. Documents are scored by joins too: the different n-grams of a block of documents are looked up once, and their
probabilities come back to the block. Texts are never shuffled; they are staged in buckets by block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import staged, staged_by
from .words import chunks, mixed, text_bytes

ORDER = 4  # characters of an n-gram
BLOCK_BYTES = 16 << 20  # of text in a block; a longer text is one by itself
PART_BYTES = 1 << 19  # of text that are looked at at a time, or one longer text
LOW, HIGH = 0.01, 0.99  # quantiles of a language's trusted texts
SPACE, ODD = 32, 0xFFFD  # white space of any kind and length; NUL
LOG_BITS, LOG_UNIT = 31, 1 << 24  # an answer ends with a negative logarithm: up to 128, in steps of 2**-24
_IS_SPACE = np.zeros(0x3002, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = True
BLOCK = "block long, fold int, doc_ids array<long>, langs array<string>, sizes array<long>, texts binary"


def text_blocks(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """Rows of documents put together, with compressed texts, staged in buckets by ``block``. All of a block are in one
    ``fold``, 0 or 1 by a hash of the id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def empty() -> tuple:
            return [], [], [], [], zstandard.ZstdCompressor(level=9).compressobj()

        made, held = 0, [empty(), empty()]

        def block(fold: int) -> pa.RecordBatch:
            nonlocal made
            made += 1
            ids, langs, sizes, texts, packer = held[fold]
            held[fold] = empty()
            return pa.RecordBatch.from_arrays([
                pa.array([(TaskContext.get().partitionId() << 32) + made], pa.int64()), pa.array([fold], pa.int32()), pa.array([ids], pa.list_(pa.int64())), pa.array([langs], pa.list_(pa.string())),
                pa.array([sizes], pa.list_(pa.int64())), pa.array([b"".join(texts) + packer.flush()], pa.binary()),
            ], ["block", "fold", "doc_ids", "langs", "sizes", "texts"])

        for batch in batches:
            for fold in (0, 1):
                own = batch.filter(pc.equal(batch.column(3), fold))
                for lo, hi in chunks(own.column(2)):
                    raw, offsets = text_bytes(own.column(2).slice(lo, hi - lo))
                    if held[fold][2] and sum(held[fold][2]) + len(raw) > BLOCK_BYTES:
                        yield block(fold)
                    ids, langs, sizes, texts, packer = held[fold]
                    ids += own.column(0).slice(lo, hi - lo).to_pylist()
                    langs += own.column(1).slice(lo, hi - lo).to_pylist()
                    sizes += np.diff(offsets).tolist()
                    texts.append(packer.compress(raw.tobytes()))
        for fold in (0, 1):
            if held[fold][2]:
                yield block(fold)

    id_ = F.col(id_col).cast("long")
    rows = docs.select(id_, F.col(lang_col).cast("string"), F.col(text_col), F.pmod(F.xxhash64(F.lit(7), id_), F.lit(2)).cast("int"))
    return staged_by(rows.mapInArrow(run, BLOCK), "blocks", "block")


def symbols(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts whose UTF-8 bytes lie between ``offsets``, and where each text begins. White space of
    any length is one space."""
    first = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))[offsets]
    found = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32).copy()
    found[found == 0] = ODD
    found[_IS_SPACE[np.minimum(found, len(_IS_SPACE) - 1)]] = SPACE
    stay = found != SPACE
    stay[1:] |= stay[:-1].copy()  # the first space of several
    stay[first[:-1][np.diff(first) > 0]] = True
    return found[stay], np.concatenate(([0], np.cumsum(stay)))[first]


def grams(found: np.ndarray, first: np.ndarray, order: int) -> list[np.ndarray]:
    """The ``order`` symbols that end at each symbol, an array for each, those before a text being spaces."""
    out = []
    for back in range(order - 1, -1, -1):
        own = np.full(len(found), SPACE, np.uint32)
        own[back:] = found[: max(0, len(found) - back)]
        for k in range(back):
            own[first[:-1][np.diff(first) > k] + k] = SPACE
        out.append(own)
    return out


def _parts(row: dict, wanted: np.ndarray | None, order: int) -> Iterator[tuple]:
    """Of a block's texts in parts of bounded size: indices of the texts, keys of language and n-gram for each symbol,
    the n-grams' symbols (:func:`grams`), and where each text begins. ``wanted`` selects texts; those of null language are left out."""
    sizes = np.array(row["sizes"], np.int64)
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompressobj().decompress(row["texts"]), np.uint8) if sizes.sum() else np.zeros(0, np.uint8)
    edges = np.concatenate(([0], np.cumsum(sizes)))
    known = np.array([x is not None for x in row["langs"]], bool)
    if wanted is not None:
        known &= wanted
    languages = {x: k for k, x in enumerate(sorted({x for x in row["langs"] if x is not None}))}
    number = np.array([languages.get(x, 0) for x in row["langs"]], np.uint64)
    lo = 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(edges, edges[lo] + PART_BYTES, "right")) - 1)
        mine = lo + np.flatnonzero(known[lo:hi])
        if len(mine):
            inside = np.repeat(known[lo:hi], sizes[lo:hi])
            found, first = symbols(raw[edges[lo] : edges[hi]][inside], np.concatenate(([0], np.cumsum(sizes[mine]))))
            own = grams(found, first, order)
            key = np.repeat(number[mine], np.diff(first))
            for k in range(order):
                key = key * np.uint64(0x9E3779B97F4A7C15) + own[k]
            yield mine, mixed(key), own, first
        lo = hi


def _distinct(row: dict, wanted: np.ndarray | None, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys of a block's different pairs of language and n-gram, an index of a text of that language, the n-gram, and
    how often it occurs."""
    parts = []
    for mine, key, own, first in _parts(row, wanted, order):
        if len(key):
            number, keys = pd.factorize(key)  # hashed, not sorted
            at = np.zeros(len(keys), np.int64)
            at[number] = np.arange(len(key))
            parts.append((keys, mine[np.searchsorted(first, at, "right") - 1], np.stack([x[at] for x in own], 1), np.bincount(number)))
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros((0, order), np.uint32), np.zeros(0, np.int64)
    keys, text, own, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    by_key = np.argsort(keys, kind="stable")
    new = np.flatnonzero(np.concatenate(([True], np.diff(keys[by_key]) != 0)))
    at = by_key[new]
    return keys[at], text[at], own[at], np.add.reduceat(n[by_key], new)


def _strings(own: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(own).view(f"<U{own.shape[1]}").ravel() if len(own) else [], pa.string())


def _models(row: dict, fold: int) -> pa.Array:
    return pa.array([None if x is None else f"{fold}:{x}" for x in row["langs"]], pa.string())


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield {name: batch.column(c)[k].as_py() for c, name in enumerate(batch.schema.names)}


def asked_grams(blocks: DataFrame, order: int) -> DataFrame:
    """``block, place, lang, gram``: each block's different n-grams, ``place`` being their rank by key. ``lang`` names the
    model that scores them: the language's, from the other fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            _, text, own, _ = _distinct(row, None, order)
            langs = _models(row, 1 - row["fold"]).dictionary_encode()
            for lo in range(0, len(text), 1 << 16):
                mine = text[lo : lo + (1 << 16)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(mine), row["block"], np.int64)), pa.array(np.arange(lo, lo + len(mine)), pa.int32()), langs.take(pa.array(mine)).dictionary_decode(), _strings(own[lo : lo + (1 << 16)]),
                ], ["block", "place", "lang", "gram"])

    return blocks.select("block", "fold", "langs", "sizes", "texts").mapInArrow(run, "block long, place int, lang string, gram string")


def gram_counts(blocks: DataFrame, learned: DataFrame, order: int) -> DataFrame:
    """``lang, gram, n`` over the texts in ``learned`` (``block, learn``: places of texts); blocks merge their own.
    ``lang`` names the model: the language's, of the block's fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            wanted = np.zeros(len(row["sizes"]), bool)
            wanted[row["learn"]] = True
            _, text, own, n = _distinct(row, wanted, order)
            langs = _models(row, row["fold"])
            yield pa.RecordBatch.from_arrays([langs.take(pa.array(text)), _strings(own), pa.array(n, pa.int64())], ["lang", "gram", "n"])

    rows = blocks.join(learned, "block").select("fold", "langs", "sizes", "texts", "learn")
    return rows.mapInArrow(run, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _start(gram: Column, length: int) -> Column:
    return F.substring(gram, 1, length) if length else F.lit("")


def estimate(counts: DataFrame, order: int = ORDER) -> dict[int, tuple[DataFrame, DataFrame]]:
    """For sizes 1 to ``order``: probabilities of seen n-grams, ``lang, gram, p``, and what unseen ones of a context take
    from the next lower order, ``lang, context, rest``. Below size 1 all characters, and one more for those never
    seen, are equally likely.

    Counts of an order are joined to totals of their contexts and to the probabilities of the next lower order,
    all sharded by language and n-gram. Lower orders count the different characters before an n-gram. Discounts are
    Chen and Goodman's, from each order's counts of counts, or 1/2, 1 and 3/2 where there are too few.
    """
    tables = {order: staged(counts, f"counts{order}")}
    for size in range(order - 1, 0, -1):
        lower = tables[size + 1].groupBy("lang", F.substring("gram", 2, size).alias("gram")).agg(F.count(F.lit(1)).alias("n"))
        tables[size] = staged(lower, f"counts{size}")
    out: dict[int, tuple[DataFrame, DataFrame]] = {}
    for size in range(1, order + 1):
        own = tables[size].withColumn("context", _start(F.col("gram"), size - 1))
        some = [F.sum(F.when(F.col("n") == k, 1).otherwise(0)).cast("double").alias(f"n{k}") for k in (1, 2, 3, 4)]
        d = own.groupBy("lang").agg(*some, (1 / (F.count(F.lit(1)) + 1)).alias("uniform"))
        y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
        enough = (F.col("n1") > 0) & (F.col("n2") > 0) & (F.col("n3") > 0)
        for k in (1, 2, 3):
            value = k - (k + 1) * y * F.try_divide(F.col(f"n{k + 1}"), F.col(f"n{k}"))
            d = d.withColumn(f"d{k}", F.when(enough, F.least(F.greatest(value, F.lit(0.1)), F.lit(float(k)))).otherwise(F.lit(k / 2)))
        own = own.join(F.broadcast(d.select("lang", "d1", "d2", "d3", "uniform")), "lang")  # a row a language
        less = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        own = own.withColumn("less", F.least(less, F.col("n").cast("double")))
        context = own.groupBy("lang", "context").agg(F.sum("n").alias("total"), (F.sum("less") / F.sum("n")).alias("rest"), F.first("uniform").alias("uniform"))
        own = own.drop("uniform").join(context, ["lang", "context"])
        if size == 1:
            own = own.withColumn("q", F.col("uniform"))
        else:
            lower = out[size - 1][0].select("lang", F.col("gram").alias("_low"), F.col("p").alias("q"))
            own = own.withColumn("_low", F.substring("gram", 2, size - 1)).join(lower, ["lang", "_low"])
        p = own.select("lang", "gram", ((F.col("n") - F.col("less")) / F.col("total") + F.col("rest") * F.col("q")).alias("p"))
        out[size] = staged(p, f"p{size}"), staged(context.select("lang", "context", "rest", "uniform"), f"rest{size}")
    return out


def resolved(asked: DataFrame, model: dict[int, tuple[DataFrame, DataFrame]], size: int) -> DataFrame:
    """``lang, gram, p`` for the different n-grams in ``asked``: their own probability, or what their context leaves to
    the n-gram without its first character. Only n-grams that weren't seen go on to the next lower order."""
    seen, rests = model[size]
    tried = staged(asked.join(seen, ["lang", "gram"], "left"), f"asked{size}")
    found = tried.filter("p IS NOT NULL")
    unseen = tried.filter("p IS NULL").drop("p").withColumn("context", _start(F.col("gram"), size - 1))
    if size == 1:
        # a row a language
        return found.unionByName(unseen.join(F.broadcast(rests), ["lang", "context"]).select("lang", "gram", (F.col("rest") * F.col("uniform")).alias("p")))
    unseen = unseen.join(rests.select("lang", "context", "rest"), ["lang", "context"], "left").withColumn("_low", F.substring("gram", 2, size - 1))
    lower = resolved(unseen.select("lang", F.col("_low").alias("gram")).distinct(), model, size - 1)
    lower = lower.select("lang", F.col("gram").alias("_low"), F.col("p").alias("q"))
    return found.unionByName(unseen.join(lower, ["lang", "_low"]).select("lang", "gram", (F.coalesce("rest", F.lit(1.0)) * F.col("q")).alias("p")))


def perplexities(blocks: DataFrame, model: dict[int, tuple[DataFrame, DataFrame]], order: int = ORDER) -> DataFrame:
    """``doc_id, lang, symbols, perplexity`` of each document; null perplexity for a null language or one without a
    model, and for an empty text. Each block's n-grams are joined to the model and their logarithms sent back to it."""
    tried = asked_grams(blocks, order).join(model[order][0], ["lang", "gram"], "left")
    own = lambda name: F.when(F.col("p").isNull(), F.col(name)).alias(name)
    log = F.round(F.log("p") * -LOG_UNIT).cast("long")
    log = F.when(log < 1 << LOG_BITS, log).when(log.isNotNull(), (1 << LOG_BITS) - 1).cast("int").alias("log")
    tried = staged(tried.select("block", "place", own("lang"), own("gram"), log), "tried")
    unseen = tried.filter("log IS NULL").drop("log")
    lower = resolved(unseen.select("lang", "gram").distinct(), model, order)
    answers = tried.filter("log IS NOT NULL").select("block", "place", "log").unionByName(unseen.join(lower, ["lang", "gram"]).select("block", "place", log))
    answers = answers.select("block", (F.col("place").cast("long") * (1 << LOG_BITS) + F.col("log")).alias("answer"))
    answers = answers.groupBy("block").agg(F.collect_list("answer").alias("answers"))  # at most one for each symbol of the block

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(c)[k].as_py() for c, name in enumerate(batch.schema.names) if name != "answers"}
                parts = []
                for mine, key, _, first in _parts(row, None, order):
                    number, different = pd.factorize(key)
                    parts.append((mine, first, number.astype(np.min_scalar_type(len(different))), different))
                keys = np.unique(np.concatenate([x[3] for x in parts])) if parts else np.zeros(0, np.uint64)
                logs = np.full(len(keys), np.nan)
                if (answer := batch.column(batch.num_columns - 1)[k].values) is not None:
                    answer = answer.to_numpy(zero_copy_only=False)
                    logs[answer >> LOG_BITS] = (answer & ((1 << LOG_BITS) - 1)) / -LOG_UNIT
                n, mean = np.zeros(len(row["sizes"]), np.int64), np.full(len(row["sizes"]), np.nan)
                for mine, first, number, different in parts:
                    own = logs[np.searchsorted(keys, different)][number]
                    sums = np.concatenate(([0.0], np.cumsum(np.nan_to_num(own))))
                    unknown = np.concatenate(([0], np.cumsum(np.isnan(own))))
                    n[mine] = np.diff(first)
                    fine = (unknown[first[1:]] == unknown[first[:-1]]) & (n[mine] > 0)
                    mean[mine[fine]] = ((sums[first[1:]] - sums[first[:-1]]) / np.maximum(n[mine], 1))[fine]
                yield pa.RecordBatch.from_arrays([
                    pa.array(row["doc_ids"], pa.int64()), pa.array(row["langs"], pa.string()), pa.array(n), pa.array(np.exp(-mean), mask=np.isnan(mean)),
                ], ["doc_id", "lang", "symbols", "perplexity"])

    rows = blocks.join(answers, "block", "left").select("doc_ids", "langs", "sizes", "texts", "answers")
    return rows.mapInArrow(score, "doc_id long, lang string, symbols long, perplexity double")


def quality(
    docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    low: float = LOW, high: float = HIGH, order: int = ORDER,
) -> DataFrame:
    """``doc_id, lang, symbols, perplexity, low, high, kept`` for each row of ``docs``.

    ``trusted`` has the ids (``id_col``) of trusted rows. Rows are in two folds by a hash of their id. The trusted texts
    of a fold train a model of each language, which scores the rows of the other one: no text is judged by a model
    that has seen it. The ``low`` and ``high`` quantiles of the trusted texts' perplexities are the language's limits.
    A text outside of them goes, of whatever length: above is text unlike the trusted, below is text that repeats itself.

    Kept in any case, as there is nothing to judge them by: rows of null language or of a language without trusted
    text in the other fold, null texts and empty ones. A null id is never trusted. Repeated rows count each; equal
    perplexities are on the same side. Empty tables give no rows, or keep all. A long text is a block by itself.
    """
    ids = staged(trusted.select(F.col(id_col).cast("long").alias("doc_id")).filter("doc_id IS NOT NULL").distinct(), "trusted")
    blocks = text_blocks(docs, id_col, text_col, lang_col)
    members = blocks.select("block", F.posexplode("doc_ids").alias("place", "doc_id"))
    learned = members.join(ids, "doc_id").groupBy("block").agg(F.collect_list("place").alias("learn"))
    model = estimate(gram_counts(blocks, learned, order), order)
    scored = staged(perplexities(blocks, model, order), "perplexities")
    limits = (
        scored.filter("perplexity IS NOT NULL").join(ids, "doc_id", "left_semi").groupBy("lang")
        .agg(F.percentile_approx("perplexity", F.array(F.lit(low), F.lit(high)), 100_000).alias("q"))
        .select("lang", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))
    )
    judged = scored.join(F.broadcast(limits), "lang", "left")  # a row a language
    fine = F.coalesce(F.col("perplexity").between(F.col("low"), F.col("high")), F.lit(True))
    return judged.select("doc_id", "lang", "symbols", "perplexity", "low", "high", fine.alias("kept"))
