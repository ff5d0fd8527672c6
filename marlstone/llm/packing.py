"""Mixture-controlled packing of tokenised documents into fixed windows."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import before, hash_bucket, phase, share_bucket, staged
from .words import LOWER, chunks, text_bytes

WINDOW = 4096
QUANTUM = 256
END = 2
CHUNK_BYTES = 2 << 20  # of text tokenised at once
CACHED_WORDS = 450_000  # of a worker; later words are encoded anew each time
_tokenizers: dict[str, Words] = {}
_GAP = "\x01"  # stands alone between encoded words: one piece, one id
_TAIL = ".,!?;:"
# Fixed value: how a tokenizer must split texts so that words may be encoded one by one.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


class Words:
    """A tokenizer whose pieces never cross white space, applied word by word with a cache.

    For vocabularies that lower-case, drop white space and split before punctuation that follows a letter, the ids
    of a text are those of its words put together. Texts with the marks of special tokens are encoded whole, and
    all texts are where the tokenizer's own settings don't say that it works like this (``by_word``). Ids are kept
    as 16-bit numbers; a larger vocabulary is an error.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("a vocabulary of more than 65,536 ids")
        self.by_word = splits_words(json.loads(self.tokenizer.to_str()))
        self.gap = self.tokenizer.encode(_GAP, add_special_tokens=False).ids if self.by_word else []
        self.cache: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {"": b""}

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, np.uint16).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_new(self, words: list[str]) -> dict[str, bytes]:
        out, (gap,) = {}, self.gap
        for i in range(0, len(words), 4000):
            part = words[i : i + 4000]
            ids = np.array(self.tokenizer.encode_batch_fast([f" {_GAP} ".join(part)], add_special_tokens=False)[0].ids, np.uint16)
            cuts = np.flatnonzero(ids == gap)
            if len(cuts) == len(part) - 1:
                raw = ids.tobytes()
                out |= {w: raw[2 * s : 2 * e] for w, s, e in zip(part, [0, *(cuts + 1).tolist()], [*cuts.tolist(), len(ids)], strict=True)}
            else:  # a word holds the separator itself
                out |= dict(zip(part, self.whole(part), strict=True))
        return out

    def of_words(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words, as little-endian 16-bit numbers."""
        split = []
        for w in words:
            core = w.rstrip(_TAIL)
            # punctuation after an ASCII letter always begins a piece of its own
            split.append((core, w[len(core) :]) if len(core) < len(w) and "a" <= core[-1:] <= "z" else (w, ""))
        new = {c for c, _ in split if c not in self.cache}
        fresh = self.encode_new(list(new))
        if tails := {t for _, t in split if t not in self.tails}:
            self.tails |= self.encode_new(list(tails))
        cache, tails = self.cache, self.tails
        found = [(cache.get(c) or fresh.get(c, b"")) + tails[t] for c, t in split]
        if len(cache) < CACHED_WORDS:
            cache.update(fresh)
        if len(tails) > 10_000:
            self.tails = {"": b""}
        return found

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text."""
        if not self.by_word:
            return [np.frombuffer(x, np.uint16) for x in self.whole([x or "" for x in texts.to_pylist()])]
        raw, offsets = text_bytes(texts)
        special = np.array(pc.match_substring(texts, "<|").fill_null(False).to_pylist(), bool)
        black = ~SPACE[raw]
        cut = np.zeros(len(raw) + 1, bool)
        cut[offsets] = True
        first = black.copy()
        first[1:] &= ~black[:-1] | cut[1:-1]
        starts = np.flatnonzero(first)
        edges = np.cumsum(black)  # where words end among the bytes that are left
        places = np.append((edges[starts] - 1), edges[-1] if len(edges) else 0).astype(np.int64)
        left = LOWER[raw[black]]
        flat = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(places), pa.py_buffer(left)).dictionary_encode()
        ids = self.of_words(flat.dictionary.to_pylist())
        sizes = np.fromiter((len(x) // 2 for x in ids), np.int64, len(ids))
        pool = np.frombuffer(b"".join(ids), np.uint16)
        begins = np.cumsum(sizes) - sizes
        codes = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        n = sizes[codes]
        ends = np.cumsum(n)
        out = pool[np.repeat(begins[codes] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)]
        edges = np.concatenate(([0], ends))[np.searchsorted(starts, offsets)]
        each = [out[edges[k] : edges[k + 1]] for k in range(len(texts))]
        for k, x in zip(np.flatnonzero(special), self.whole([texts[int(k)].as_py() for k in np.flatnonzero(special)]) if special.any() else [], strict=True):
            each[k] = np.frombuffer(x, np.uint16)
        return each


def splits_words(settings: dict) -> bool:
    """Whether a tokenizer's settings are those under which :class:`Words` may encode word by word."""
    parts = (settings.get("normalizer") or {}).get("normalizers", [])
    split = ((settings.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    return (
        {x["type"] for x in parts} == {"NFC", "Replace", "Lowercase"} and all(x["content"] == " " and x["pattern"] == {"Regex": r"\s+"} for x in parts if x["type"] == "Replace")
        and split.get("type") == "Split" and split["pattern"] == {"Regex": SPLIT} and split["behavior"] == "Removed" and split["invert"]
        and all(x["content"].startswith("<|") for x in settings["added_tokens"])
    )


def words_of(path: str) -> Words:
    if path not in _tokenizers:
        _tokenizers[path] = Words(path)
    return _tokenizers[path]


def tokenize(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", end: int = END) -> DataFrame:
    """``doc_id, source, ids, doc_tokens``: ids as little-endian 16-bit numbers, with ``end`` after each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_of(path)
        for batch in batches:
            for lo, hi in chunks(batch.column(2), CHUNK_BYTES):
                ids = words.encode(batch.column(2).slice(lo, hi - lo))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo),
                    pa.array([np.append(x, np.uint16(end)).tobytes() for x in ids], pa.binary()),
                    pa.array([len(x) + 1 for x in ids], pa.int64()),
                ], ["doc_id", "source", "ids", "doc_tokens"])

    source = F.col(source_col).cast("string") if source_col in docs.columns else F.lit(None).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), source.alias("source"), F.col(text_col).alias("text")).mapInArrow(
        run, "doc_id long, source string, ids binary, doc_tokens long"
    )


def packed(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    window: int = WINDOW, quantum: int = QUANTUM, end: int = END, shares: dict[str, float] | None = None,
) -> DataFrame:
    """Pieces of all documents in sequences of ``window`` tokens: ``doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, source``.

    Deficit round-robin over one queue for each source. A queue is its documents in seeded random order, as one
    stream of tokens, served in quanta of ``quantum`` tokens (a document's end cuts a quantum). A source with
    share ``w`` is due its token ``t`` at time ``t / w``; quanta are put in order of the time at which a seeded
    point of theirs, the same in all quanta of a source, is due. That is the order in which a round-robin that
    adds ``w`` to each queue's credit serves them, queues starting with seeded credits of less than a quantum
    (so that many small sources don't come up all at once) and carrying what is left on without end. So at every token of the whole output, and in every window, each source
    that has tokens left is within one quantum of its share, whichever task works on it. Sources that run out
    leave their share to the others.

    ``shares`` are target proportions of all tokens, by source. Sources that it doesn't name share what is left of 1,
    each by its part of their tokens; names without documents are skipped. A share of 0 (also that of unnamed
    sources where nothing is left for them) is served after all others. Negative shares and sums over 1 are errors.
    By default shares are the sources' own parts of all tokens, so that all end together and every window has them.

    The stream of quanta is cut at every ``window`` tokens: sequences are full but for the last one.

    Positions are running totals (:func:`before`) by (source, bucket) and then by due time; tokens are computed
    once and staged in the shared folder. Nulls: a null text is one end token; rows of null source are a
    source of their own; a null id is kept. Repeated rows are packed each. An empty table gives no rows.
    """
    rows = tokenize(docs, path, id_col, text_col, source_col, end).withColumn("row", F.monotonically_increasing_id())
    tokens = staged(rows, "tokens")
    queue = tokens.select(
        "row", "doc_id", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-")).alias("_from"), "source", "doc_tokens",
        F.xxhash64(F.lit(11), "doc_id").alias("_hash"),
    ).withColumn("_bucket", hash_bucket(F.col("_hash")))
    queue = before(queue, ["_from"], "_bucket", ["_hash", "doc_id", "row"], "doc_tokens", "_first", "_total")
    # a document's tokens, cut where the queue's quanta end
    spans = F.sequence(F.expr(f"_first div {quantum}"), F.expr(f"(_first + doc_tokens - 1) div {quantum}"))
    cut = queue.withColumn("_quantum", F.explode(spans))
    low, high = F.greatest(F.col("_quantum") * quantum, F.col("_first")), F.least((F.col("_quantum") + 1) * quantum, F.col("_first") + F.col("doc_tokens"))
    whole = F.least(F.lit(quantum), F.col("_total") - F.col("_quantum") * quantum)
    part = (F.col("_quantum") * quantum + phase(F.col("_from")) * whole) / F.col("_total")  # of the queue, before the quantum's point
    late, due, progress = _times(tokens, shares, part)
    cut = cut.select("row", "_from", "_quantum", (low - F.col("_first")).alias("start"), (high - low).alias("length"), late.alias("_late"), due.alias("_due"), share_bucket(progress).alias("_bucket"), "_first")
    placed = before(cut, [], "_bucket", ["_late", "_due", "_from", "_quantum", "_first", "start"], "length", "_at", "_all")
    sequences = F.sequence(F.expr(f"_at div {window}"), F.expr(f"(_at + length - 1) div {window}"))
    placed = placed.withColumn("sequence_id", F.explode(sequences))
    s, e = F.greatest(F.col("sequence_id") * window, F.col("_at")), F.least((F.col("sequence_id") + 1) * window, F.col("_at") + F.col("length"))
    pieces = placed.select(
        "row",
        F.struct(
            (F.col("start") + s - F.col("_at")).alias("start"), (e - s).alias("length"), "sequence_id", (s - F.col("sequence_id") * window).alias("offset")
        ).alias("piece"),
    )
    by_row = pieces.groupBy("row").agg(F.collect_list("piece").alias("pieces"))  # a document's own pieces
    return _summed(tokens.join(by_row, "row"))


def _times(tokens: DataFrame, shares: dict[str, float] | None, part: Column) -> tuple[Column, Column, Column]:
    """Whether a source is served after all others, when a token is due that has ``part`` of its source before it, and
    about which part of the output then is before it, which rises with both.

    Time is counted in tokens of the output: a source of share ``w`` is due ``w`` at each. Where it has ``n`` tokens in all,
    ``min(n, w t)`` of them are due by ``t``; the sum of that over sources is the progress. Only totals of the sources
    that ``shares`` names, and one of all others, are needed.
    """
    if not shares:
        return F.lit(0), part, part
    if min(shares.values()) < 0 or sum(shares.values()) > 1 + 1e-9:
        raise ValueError("shares are at least 0, and at most 1 in all")
    name = F.when(F.col("source").isin(list(shares)), F.col("source"))
    totals = {r["name"]: r["n"] for r in tokens.groupBy(name.alias("name")).agg(F.sum("doc_tokens").alias("n")).collect()}  # of names in shares
    left = max(0.0, 1 - sum(shares.values()))
    own = {x: (float(w), totals[x]) for x, w in shares.items() if x in totals} | ({None: (left if left > 1e-9 else 0.0, totals[None])} if None in totals else {})
    served, late = {x: v for x, v in own.items() if v[0] > 0}, sum(n for w, n in own.values() if not w)
    all_ = max(1, sum(n for _, n in own.values()))

    def of(value) -> Column:
        """A number for each source."""
        out = F.lit(value(None) if None in own else 0.0)
        for x in own:
            if x is not None:
                out = F.when(F.col("source") == x, F.lit(value(x))).otherwise(out)
        return out

    due = part * of(lambda x: own[x][1] / own[x][0] if own[x][0] else float(late))
    progress = sum((F.least(F.lit(float(n)), due * w) for w, n in served.values()), F.lit(0.0))
    is_late = of(lambda x: 0.0 if own[x][0] else 1.0)
    return is_late, due, F.when(is_late > 0, F.lit(float(all_ - late)) + due).otherwise(progress) / all_


def _summed(rows: DataFrame) -> DataFrame:
    """A row for each piece, with the CRC-32 of its ids as little-endian 32-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pieces = batch.column(4)
            flat = pieces.flatten()
            start, length, sequence, offset = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(4))
            n = pc.list_value_length(pieces).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(batch.num_rows), n)
            crc = np.zeros(len(row), np.int64)
            k = 0
            for r in range(batch.num_rows):
                ids = np.frombuffer(batch.column(2)[r].as_buffer(), np.uint16).astype("<u4")
                view = memoryview(ids).cast("B")
                for k in range(k, k + n[r]):
                    crc[k] = zlib.crc32(view[4 * start[k] : 4 * (start[k] + length[k])])
                k += 1 if n[r] else 0
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(take), *(pa.array(x, pa.int64()) for x in (start, length, crc)), batch.column(3).take(take),
                *(pa.array(x, pa.int64()) for x in (sequence, offset)), batch.column(1).take(take),
            ], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"])

    return rows.select("doc_id", "source", "ids", "doc_tokens", "pieces").mapInArrow(
        run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"
    )
