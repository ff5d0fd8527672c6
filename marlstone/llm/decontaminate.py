"""Benchmark decontamination on a distributed positional inverted index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bitmap_of, filter_bits, marked, matched_rows, staged, staged_by, text_key
from .words import chunks, find_words

WINDOW = 10
BLOCK_WORDS = 1 << 20  # words of an index block; a longer document is a block of its own
SLOP = 2
AT_ONCE = 1 << 20  # candidate places that a task looks at together

INDEX = "block string, doc_ids array<long>, text_keys array<binary>, n_words binary, terms binary, counts binary, gaps binary"
FOUND = "doc_id long, text_key binary, n_words long, hits array<array<long>>, items array<string>, near_items array<string>"


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """A positional inverted index of all texts in the shared folder, as rows of about ``block_words`` words.

    A block holds the postings of some documents: its terms in the order of their hashes, each term's number of
    postings, and the postings as gaps between positions. Positions count words through the block's documents.
    """

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, keys, lengths, hashes = [], [], [], []
        task, made = TaskContext.get().partitionId(), 0

        def block() -> pa.RecordBatch:
            nonlocal made
            made += 1
            words = np.concatenate(hashes)
            order = np.argsort(words, kind="stable")
            ranked = words[order]
            new = np.ones(len(words), bool)
            new[1:] = ranked[1:] != ranked[:-1]
            firsts = np.flatnonzero(new)
            gaps = np.diff(order, prepend=0)
            gaps[firsts] = order[firsts]
            columns = [
                pa.array([f"{task}-{made}"]),
                pa.array([[x for part in ids for x in part]], pa.list_(pa.int64())),
                pa.array([[x for part in keys for x in part]], pa.list_(pa.binary())),
                *(pa.array([x.tobytes()], pa.binary()) for x in (
                    np.concatenate(lengths).astype(np.uint32), ranked[firsts], np.diff(firsts, append=len(words)).astype(np.uint32), gaps.astype(np.uint32)
                )),
            ]
            ids.clear(), keys.clear(), lengths.clear(), hashes.clear()
            return pa.RecordBatch.from_arrays(columns, ["block", "doc_ids", "text_keys", "n_words", "terms", "counts", "gaps"])

        held = 0
        for batch in batches:
            for lo, hi in chunks(batch.column(2)):
                words = find_words(batch.column(2).slice(lo, hi - lo))
                if held and held + len(words.hashes) > block_words:
                    yield block()
                    held = 0
                ids.append(batch.column(0).slice(lo, hi - lo).to_pylist())
                keys.append(batch.column(1).slice(lo, hi - lo).to_pylist())
                lengths.append(np.diff(words.first))
                hashes.append(words.hashes)
                held += len(words.hashes)
        if ids:
            yield block()

    rows = docs.select(F.col(id_col).cast("long"), text_key(F.col(text_col)), F.col(text_col))
    return staged_by(rows.mapInArrow(index, INDEX), "postings", "block")


def item_windows(items: DataFrame, item_col: str, text_col: str, window: int) -> DataFrame:
    """``key, terms, items``: each different run of ``window`` words of the test items, or of all words of a shorter
    one, as word hashes, with the items (as strings) that have it. ``key`` is a hash of the run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in chunks(batch.column(1)):
                words = find_words(batch.column(1).slice(lo, hi - lo))
                terms = words.hashes.astype(np.int64)
                at, size, owner = [], [], []
                for k, (a, b) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)):
                    starts = range(a, max(a + 1, b - window + 1) if b > a else a)
                    at += starts
                    size += [min(window, b - a)] * len(starts)
                    owner += [k] * len(starts)
                runs = [terms[a : a + n] for a, n in zip(at, size, strict=True)]
                yield pa.RecordBatch.from_arrays([
                    pa.array([r.tobytes() for r in runs], pa.binary()), pa.array(runs, pa.list_(pa.int64())), batch.column(0).slice(lo, hi - lo).take(pa.array(owner, pa.int64())),
                ], ["run", "terms", "item"])

    rows = items.filter(F.col(item_col).isNotNull()).select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    found = rows.mapInArrow(run, "run binary, terms array<long>, item string")
    return found.groupBy("run").agg(F.first("terms").alias("terms"), F.array_sort(F.collect_set("item")).alias("items"))


def asked_windows(index: DataFrame, windows: DataFrame) -> DataFrame:
    """``block, asked``: the windows to look for in each block, as structs (terms, lead, items).

    The index's own lists tell how often each term of the windows occurs in all texts. A window with a term that
    doesn't occur at all is dropped; each other one is asked of the blocks that have its rarest term, its lead.
    """
    bits = filter_bits(10 * windows.count())
    terms = windows.select("run", F.posexplode("terms").alias("place", "term"))
    shared = index.sparkSession.sparkContext.broadcast(bitmap_of(terms.select(F.pmod("term", F.lit(bits)))))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                own = np.frombuffer(batch.column(1)[row].as_buffer(), np.int64)
                hit = marked(shared.value, own % bits)
                counts = np.frombuffer(batch.column(2)[row].as_buffer(), np.uint32)[hit]
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[row].as_py()] * len(counts), pa.string()), pa.array(own[hit]), pa.array(counts.astype(np.int64))], ["block", "term", "n"])

    by_block = index.select("block", "terms", "counts").mapInArrow(listed, "block string, term long, n long")
    often = by_block.groupBy("term").agg(F.sum("n").alias("n"))
    leads = terms.join(often, "term", "left").groupBy("run").agg(
        F.bool_and(F.col("n").isNotNull()).alias("whole"), F.min(F.struct("n", "place", "term")).alias("lead")
    ).filter("whole")
    asked = leads.join(windows, "run").select(F.col("lead.term").alias("term"), F.struct("terms", F.col("lead.place").alias("lead"), "items").alias("window"))
    return by_block.select("block", "term").join(asked, "term").groupBy("block").agg(F.collect_list("window").alias("asked"))


def search_index(index: DataFrame, asked: DataFrame, slop: int = SLOP) -> DataFrame:
    """Phrase and proximity matches, a row per document: ``doc_id, text_key, n_words, hits, items, near_items``.

    ``hits`` are ranges [start, end) of words inside exact matches; ``items`` have an exact match; ``near_items``
    have none, but a window of theirs can be laid over the document so that each of its terms stands within
    ``slop`` words of its place.

    In each block, the positions of a window's lead, less its offset (for proximity, and up to ``slop`` words to
    either side), are the candidates; the lists of the other terms are intersected with the shifted candidates.
    Candidates are looked at ``AT_ONCE`` at a time.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                n_words, own, counts, gaps = (np.frombuffer(batch.column(k)[row].as_buffer(), t) for k, t in ((2, np.uint32), (3, np.int64), (4, np.uint32), (5, np.uint32)))
                yield found(batch.column(0)[row].as_py(), batch.column(1)[row].as_py(), n_words.astype(np.int64), own.view(np.uint64), counts.astype(np.int64), gaps, batch.column(6)[row].as_py() or [])

    def found(ids, keys, n_words, own, counts, gaps, windows):
        ends = np.cumsum(n_words)
        low = ends - n_words
        total = int(ends[-1]) if len(ends) else 0
        spans, exact_items, near_items = ([[] for _ in ids], [set() for _ in ids], [set() for _ in ids]) if windows else ([[]] * len(ids), [()] * len(ids), [()] * len(ids))
        asked = [np.array(w["terms"], np.int64).view(np.uint64) for w in windows]
        terms = np.unique(np.concatenate(asked)) if windows else own[:0]
        at = np.minimum(np.searchsorted(own, terms), max(0, len(own) - 1))
        size = np.where(own[at] == terms, counts[at], 0) if len(own) else np.zeros(len(terms), np.int64)
        # the lists of those terms, as one sorted array of (term, position)
        stride = total + 2 * slop + 16
        lists = np.flatnonzero(size)
        n = size[lists]
        places = np.zeros(len(terms), np.int64)
        places[lists] = np.cumsum(n) - n
        begins = np.cumsum(counts) - counts
        steps = gaps[np.repeat(begins[at[lists]] - places[lists], n) + np.arange(n.sum())].astype(np.int64)
        sums = np.cumsum(steps)
        flat = sums - np.repeat(sums[places[lists]] - steps[places[lists]], n)
        keyed = np.repeat(lists, n) * stride + flat
        grid = [np.searchsorted(terms, w) for w in asked]
        grid = [(g, w["lead"], w["items"]) for g, w in zip(grid, windows, strict=True) if (size[g] > 0).all()]
        shifts = np.arange(-slop, slop + 1)
        for g, lead, items in grid:
            anchors = flat[places[g[lead]] : places[g[lead]] + size[g[lead]]]
            others = [k for k in np.argsort(size[g], kind="stable") if k != lead]
            for lo in range(0, len(anchors), max(1, AT_ONCE // len(shifts))):
                anchor = anchors[lo : lo + max(1, AT_ONCE // len(shifts))]
                home = np.searchsorted(ends, anchor, "right")
                start = anchor - lead
                live = np.flatnonzero((start >= low[home]) & (start + len(g) <= ends[home]))
                for k in others:
                    goal = g[k] * stride + start[live] + k
                    live = live[keyed[np.minimum(np.searchsorted(keyed, goal), len(keyed) - 1)] == goal]
                for k in live:
                    s = int(start[k] - low[home[k]])
                    spans[home[k]].append((s, s + len(g)))
                    exact_items[home[k]].update(items)
                if slop:
                    home = np.repeat(home, len(shifts))
                    start = (start[:, None] + shifts[None, :]).ravel()
                    live = np.arange(len(start))
                    for k in others:
                        goal, mine = start[live] + k, home[live]
                        first = g[k] * stride + np.maximum(goal - slop, low[mine])
                        hit = keyed[np.minimum(np.searchsorted(keyed, first), len(keyed) - 1)]
                        live = live[(hit >= first) & (hit <= g[k] * stride + np.minimum(goal + slop, ends[mine] - 1))]
                    for d in np.unique(home[live]):
                        near_items[d].update(items)
        return pa.RecordBatch.from_arrays([
            pa.array(ids, pa.int64()), pa.array(keys, pa.binary()), pa.array(n_words),
            pa.array([merged(x) for x in spans], pa.list_(pa.list_(pa.int64()))),
            pa.array([sorted(x) for x in exact_items], pa.list_(pa.string())),
            pa.array([sorted(set(x) - set(y)) for x, y in zip(near_items, exact_items, strict=True)], pa.list_(pa.string())),
        ], ["doc_id", "text_key", "n_words", "hits", "items", "near_items"])

    joined = index.join(asked, "block", "left").select("doc_ids", "text_keys", "n_words", "terms", "counts", "gaps", "asked")
    return joined.mapInArrow(search, FOUND)


def merged(spans) -> list[list[int]]:
    out: list[list[int]] = []
    for s, e in sorted(set(spans)):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def contamination(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    window: int = WINDOW, slop: int = SLOP, block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """Where windows of test items occur in documents: ``doc_id, text_key, n_words, hits, items, near_items``, a row per
    document (see :func:`search_index`; ``text_key`` is the text's SHA-256).

    A window is ``window`` consecutive words of an item, or all of them if it has fewer. The index is built once
    in the shared folder, in buckets by block; windows are made in tasks, joined to the blocks that have their
    rarest term, and brought to them. So neither documents nor items go through the driver, and of documents
    nothing is shuffled. Bitmaps of at most 16 MB are broadcast.

    Nulls and texts without words: such a document has no words and no hits, such an item has no windows and is
    never found; items without id are skipped. Repeated items count by distinct id. Rows repeating a document id
    are documents of their own. Empty tables give no rows, or rows without hits.
    """
    index = build_index(docs, id_col, text_col, block_words)
    windows = staged(item_windows(items, item_col, item_text_col, window), "windows")
    return search_index(index, asked_windows(index, windows), slop)


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all columns, without those that hold an item's window. Rows are told by id and text, so
    that an id's other texts stay."""
    found = staged(contamination(docs, items, id_col, text_col, slop=0, **options).filter(F.size("hits") > 0).select("doc_id", "text_key"), "contaminated")
    return matched_rows(docs, found, id_col, text_key(F.col(text_col)), "left_anti")


def contaminated_words(found: DataFrame) -> DataFrame:
    """The counts of :func:`contamination`: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near_items``."""
    length = F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + x[1] - x[0])
    return found.select(
        "doc_id", "n_words", length.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"),
        F.size("near_items").cast("long").alias("n_near_items"),
    )
