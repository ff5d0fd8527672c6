"""Language identification by error-correcting output codes over byte n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import small_batches
from .words import CHUNK_BYTES, LOWER, chunks, text_bytes

ORDERS = (1, 2, 3)
DIMENSIONS = 1 << 15
ROWS_PER_LANGUAGE = 2000  # labelled rows that are learned from, for each language, about
MOST_LANGUAGES = 200  # that are learned, those of most labelled rows
TEXTS_AT_ONCE = 16  # whose counts, DIMENSIONS each, are held at a time
AMBIGUOUS = 0.2  # between the scores of the best and the second language
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_FOLD = LOWER.copy()
_FOLD[:128][~((_FOLD[:128] >= 97) & (_FOLD[:128] <= 122))] = 32
_ODD = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits, 1 or -1
    weights: np.ndarray  # dimensions x bits: log-odds of an n-gram for each bit
    trust: np.ndarray  # languages x bits: weights of the losses


def codewords(n: int) -> np.ndarray:
    """A Hadamard code: any two words differ in half of the columns, less those that were constant."""
    size = 1 << max(1, (2 * n - 1).bit_length())
    rows, columns = np.arange(1, n + 1)[:, None], np.arange(1, size)[None, :]
    both = rows & columns
    parity = np.zeros_like(both)
    while both.any():
        parity ^= both & 1
        both >>= 1
    code = 1 - 2 * parity
    return code[:, np.abs(code.sum(0)) < n] if n > 1 else code[:, :0]


def features(texts: pa.Array, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """n-gram counts, a row per text, and whether a text has a letter. Letters are lower-cased (A-Z); what
    isn't a letter counts as one space, however long."""
    raw, offsets = text_bytes(texts)
    data = _FOLD[raw]
    doc = np.repeat(np.arange(len(texts)), np.diff(offsets))
    stay = data != 32
    stay[1:] |= data[:-1] != 32
    data, doc = data[stay].astype(np.uint32), doc[stay]
    counts = np.zeros(len(texts) * dimensions, np.float32)
    rolled = np.zeros(len(data), np.uint32)
    for n in ORDERS:
        m = len(data) - n + 1
        if m <= 0:
            break
        rolled = rolled[:m] * _ODD[0] + (data[n - 1 : n - 1 + m] + np.uint32(n)) * _ODD[n % 3]
        mixed = rolled ^ (rolled >> np.uint32(15))
        mixed *= np.uint32(0x2C1B3C6D)
        code = (mixed >> np.uint32(12)) % np.uint32(dimensions)
        same = doc[:m] == doc[n - 1 : n - 1 + m]
        where = doc[:m][same] * dimensions + code[same]
        counts += np.bincount(where, minlength=len(counts)).astype(np.float32)
    plain = np.zeros(len(texts), bool)
    plain[np.unique(doc[(data >= 97) & (data <= 122)])] = True
    for k in np.flatnonzero(~plain & (np.diff(offsets) > 0)):
        plain[k] = bool(_LETTER.search(texts[int(k)].as_py() or ""))
    return counts.reshape(len(texts), dimensions), plain


def _parts(texts: pa.Array) -> Iterator[tuple[int, int]]:
    for lo, hi in chunks(texts, CHUNK_BYTES):
        for a in range(lo, hi, TEXTS_AT_ONCE):
            yield a, min(hi, a + TEXTS_AT_ONCE)


def margins(counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Log-odds of each bit, on the scale of the square root of the number of n-grams."""
    return np.clip(counts @ weights / np.sqrt(np.maximum(counts.sum(1), 1))[:, None], -30, 30)


def decode(margin: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The codeword of least weighted logistic loss, its score, and that of the second."""
    loss = np.logaddexp(0, -margin[:, None, :] * model.code[None, :, :])
    total = (loss * model.trust[None, :, :]).sum(2)
    likely = np.exp(total.min(1, keepdims=True) - total)
    likely /= likely.sum(1, keepdims=True)
    best = likely.argmax(1)
    ordered = np.sort(likely, 1)
    return best, ordered[:, -1], ordered[:, -2] if likely.shape[1] > 1 else np.zeros(len(likely))


def bit_weights(counts: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Log-odds of each n-gram for each bit of ``code``, from counts by language."""
    odds = (counts + 0.01) / (counts + 0.01).sum(1, keepdims=True)
    bits = [np.log(odds[code[:, b] > 0].mean(0) / odds[code[:, b] < 0].mean(0)) for b in range(code.shape[1])]
    return np.stack(bits, 1).astype(np.float32) if bits else np.zeros((counts.shape[1], 0), np.float32)


def train(
    labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    rows_per_language: int = ROWS_PER_LANGUAGE, dimensions: int = DIMENSIONS, most_languages: int = MOST_LANGUAGES,
) -> Model | None:
    """A model from a sample of ``labelled``, rows with an id, a text and a language.

    Learned are the ``most_languages`` languages of most rows (of equal ones the first by name), each from about
    ``rows_per_language`` rows: those whose id's hash is below the share of the language's rows that gives so many.
    Both are bounds of what is learned from, whatever the size of the table. Rows that repeat an id are in or out
    together.

    One binary naive Bayes classifier for each bit of the code, on n-gram counts that are summed on Spark. The losses
    are weighted by the accuracy, for each language, of classifiers that three quarters of the sample have trained, on
    the fourth. None if no row is labelled.
    """
    small_batches(labelled.sparkSession)
    rows = labelled.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).dropna()
    most = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(most_languages)
    share = {r["lang"]: min(1.0, rows_per_language / r["n"]) for r in most.collect()}  # at most most_languages rows
    if not share:
        return None
    # as an Arrow table: a list of rows would start Python workers of another kind beside those of the stages
    shares = labelled.sparkSession.createDataFrame(pa.table({"lang": pa.array(share, pa.string()), "share": pa.array(share.values(), pa.float64())}))
    part = (F.pmod(F.xxhash64(F.lit(9), "id"), F.lit(1 << 30)) + 0.5) / (1 << 30)
    fourth = F.pmod(F.xxhash64(F.lit(10), "id"), F.lit(4)) == 0
    sample = rows.join(F.broadcast(shares), "lang").filter(part < F.col("share")).select("lang", "text", fourth.alias("fourth"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, bool], np.ndarray] = {}
        for batch in batches:
            for lo, hi in _parts(batch.column(1)):
                counts, _ = features(batch.column(1).slice(lo, hi - lo), dimensions)
                keys = list(zip(batch.column(0).slice(lo, hi - lo).to_pylist(), batch.column(2).slice(lo, hi - lo).to_pylist(), strict=True))
                for key in set(keys):
                    # a text weighs as much as any other, not by its length
                    own = counts[[k == key for k in keys]]
                    own = np.round((own * 1000 / np.maximum(own.sum(1, keepdims=True), 1)).astype(np.float64) * 1000).sum(0)
                    held[key] = held.get(key, 0) + own
        for (lang, fourth), own in held.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array([fourth] * len(at), pa.bool_()), pa.array(at, pa.int32()), pa.array(own[at].astype(np.int64))], ["lang", "fourth", "feature", "n"])

    summed = sample.mapInArrow(count, "lang string, fourth boolean, feature int, n long").groupBy("lang", "fourth", "feature").agg(F.sum("n").alias("n"))
    found = summed.toPandas()  # at most 2 x languages x dimensions rows
    languages = sorted(found["lang"].unique())
    if not languages:
        return None
    dense = np.zeros((2, len(languages), dimensions))
    dense[found["fourth"].astype(int), found["lang"].map({x: k for k, x in enumerate(languages)}), found["feature"]] = found["n"] / 1e6
    code = codewords(len(languages))
    most_of_it = np.where(dense[0].any(1, keepdims=True), dense[0], dense[1])  # a language may have few rows
    model = Model(languages, code, bit_weights(dense.sum(0), code), np.ones(code.shape))
    shared = labelled.sparkSession.sparkContext.broadcast(Model(languages, code, bit_weights(most_of_it, code), model.trust))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {x: k for k, x in enumerate(shared.value.languages)}
        right, seen = np.zeros(shared.value.code.shape), np.zeros(len(place))
        for batch in batches:
            for lo, hi in _parts(batch.column(1)):
                counts, _ = features(batch.column(1).slice(lo, hi - lo), dimensions)
                lang = np.array([place.get(x, -1) for x in batch.column(0).slice(lo, hi - lo).to_pylist()])
                counts, lang = counts[lang >= 0], lang[lang >= 0]  # texts without n-grams may be all of a language
                np.add.at(right, lang, margins(counts, shared.value.weights) * shared.value.code[lang] > 0)
                np.add.at(seen, lang, 1)
        k, b = np.indices(right.shape)
        yield pa.RecordBatch.from_arrays([pa.array(x.ravel(), pa.int64()) for x in (k, b, right.astype(int), seen[k].astype(int))], ["lang", "bit", "right", "seen"])

    judged = sample.filter("fourth").select("lang", "text").mapInArrow(judge, "lang long, bit long, right long, seen long").groupBy("lang", "bit").agg(F.sum("right"), F.sum("seen")).collect()
    for k, b, right, seen in judged:  # languages x bits rows
        model.trust[k, b] = (right + 1) / (seen + 2)
    model.trust *= code.shape[1] / model.trust.sum(1, keepdims=True) if code.shape[1] else 1
    return model


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", ambiguous: float = AMBIGUOUS) -> DataFrame:
    """``doc_id, lang_pred, score, ambiguous`` for each row: the nearest codeword's language, its score from 0 to
    1, and whether the second one's score comes within ``ambiguous`` of it.

    A null text, one without a letter (in Unicode's sense: digits, fractions and numerals are none), and any text where there is no model are ``und``, with score 0 and not
    ambiguous. With one learned language every other text is that language's. Of codewords at equal distance the
    language first by name is taken, with equal scores, so that the text is ambiguous. Repeated rows get the same
    result each; a null id is kept; an empty table gives no rows; whole texts are read, however long.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in _parts(batch.column(1)):
                names, score, unsure = _judged(batch.column(1).slice(lo, hi - lo), shared.value, ambiguous)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(unsure)], ["doc_id", "lang_pred", "score", "ambiguous"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double, ambiguous boolean")


def _judged(texts: pa.Array, model: Model | None, ambiguous: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(texts)
    names = np.array([*(model.languages if model else []), UNKNOWN], object)
    best, score, unsure = np.full(n, len(names) - 1), np.zeros(n), np.zeros(n, bool)
    if model:
        counts, letters = features(texts, model.weights.shape[0])
        found, first, second = decode(margins(counts, model.weights), model)
        best, score, unsure = np.where(letters, found, best), np.where(letters, first, 0), letters & (first - second < ambiguous)
    return names[best], score, unsure


def rows_with_language(docs: DataFrame, model: Model | None, text_col: str = "text", ambiguous: float = AMBIGUOUS) -> DataFrame:
    """The rows of ``docs``, all columns, whose language is told without ambiguity. Rows are filtered where they are
    read; without a model none is told."""
    small_batches(docs.sparkSession)
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = np.zeros(batch.num_rows, bool)
            for lo, hi in _parts(batch.column(at)):
                names, _, unsure = _judged(batch.column(at).slice(lo, hi - lo), shared.value, ambiguous)
                told[lo:hi] = (names != UNKNOWN) & ~unsure
            yield batch.filter(pa.array(told))

    return docs.mapInArrow(run, docs.schema)


def known_labels(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows to learn from: those with an id that aren't :func:`held_out`."""
    return docs.filter(F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))


def held_out(column: Column) -> Column:
    """Whether a row is left for measuring: a fifth, by the CRC-32 of its id as text. False for a null id."""
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train_and_predict(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """:func:`predict` for all of ``docs``, learned from their rows that have an id and a language and aren't
    :func:`held_out`: ``doc_id, held_out, lang_pred, score, ambiguous``. An empty table gives no rows."""
    model = train(known_labels(docs, id_col), id_col, text_col, lang_col)
    found = predict(docs, model, id_col, text_col)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")
