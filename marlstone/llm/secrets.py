"""Secret scans: fixed patterns, and character Markov models that tell random strings from identifiers."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Kinds in order, their patterns, the group whose length counts, and that length.
KINDS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
)
#: Runs that have no hit of 16 characters can't pass, and are many; the pattern skips them.
SCANNED = {"hex": r"[0-9a-f]{16,}"}
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
SAMPLES = 6000  # labelled strings of each class that :func:`labelled_strings` makes
THRESHOLD = 20.0  # nats by which the random model must be the likelier one
SHORTEST = 16  # characters of a random stretch
SPANS = "array<struct<start: int, rank: int, end: int, kind: string, text: string>>"
WORDS = (
    "account action address alert archive array author backup balance batch binary block branch bucket buffer builder button cache "
    "callback camera channel client cluster column command commit config content context control country currency customer data "
    "default delete device directory document download driver element employee endpoint engine error event example export feature "
    "filter folder format function gateway global graph group handler header history image import index input instance integer "
    "invoice item journal kernel label language layout level library license link list local location logger machine manager "
    "message method metric model module monitor network number object offset operator option order output package parameter "
    "partition password path payment person pipeline policy process product profile project property provider query queue reader "
    "record region register release remote report request resource response result retry router sample schedule schema search "
    "section sequence server service session setting shipping signal snapshot source status storage stream string summary support "
    "switch system table target template thread ticket timeout token tracker transaction transfer translation update upload user "
    "utility value vector version view virtual volume warehouse window worker workflow writer "
    "aber nicht werden zwischen einfach verwaltung gesellschaft wirtschaft lichkeit ungen bericht "
    "avec cette quelque toujours gouvernement entreprise naissance beaucoup journee "
    "porque siempre cuando trabajo ciudad empresa desarrollo nacional pregunta"
).split()

ROWS = ("qwertyuiop-asdfghjkl", "zxcvbnm-asdfghjkl", "qwertzuiop-yxcvbnm", "azertyuiop-qsdfghjklm", "abcdefghijklmnopqrstuvwxyz", "1234567890-0987654321")  # of keys


@dataclass
class MarkovRatio:
    """Log-likelihood ratios of character pairs, random over ordinary, by ``ALPHABET`` position."""

    weights: list[float]

    def column(self) -> Column:
        return F.split(F.lit(",".join(f"{w:.6f}" for w in self.weights)), ",").cast("array<double>")


def labelled_strings(spark: SparkSession, n: int = SAMPLES) -> DataFrame:
    """``text, label``: ``n`` random strings (1: digests and keys in hexadecimal, base 64 and base 62) and ``n``
    ordinary ones (0: identifiers in several styles, paths, words run together, long numbers, times, rows of keys), with four runs of each
    character."""
    i = F.col("id").cast("string")
    digest = F.sha2(F.concat(F.lit("k"), i), 512)
    b64 = F.base64(F.unhex(digest))
    forms = [F.substring(digest, 1, 40), F.upper(F.substring(digest, 1, 40)), F.substring(b64, 1, 44), F.translate(b64, "+/=", "-_"), F.translate(F.substring(b64, 1, 36), "+/=", "xQ7")]

    def pick(values: list[Column], salt: str) -> Column:
        return F.element_at(F.array(*values), (F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(len(values))) + 1).cast("int"))

    words = F.split(F.lit(" ".join(WORDS)), " ")
    w = [F.element_at(words, (F.pmod(F.xxhash64(F.lit(f"w{k}"), "id"), F.lit(len(WORDS))) + 1).cast("int")) for k in range(4)]
    up = [F.initcap(x) for x in w]
    two = F.lpad(F.pmod(F.xxhash64(F.lit("d"), "id"), F.lit(100)).cast("string"), 2, "0")
    number = F.lpad(F.pmod(F.xxhash64(F.lit("n"), "id"), F.lit(10**15)).cast("string"), 20, "4")
    ordinary = [
        F.concat_ws("_", *w), F.concat(w[0], *up[1:]), F.concat(*up), F.concat_ws("-", *w), F.upper(F.concat_ws("_", *w)), F.concat_ws("/", *w),
        F.concat(*w), F.upper(F.concat(*w)), F.concat_ws("_", *w[:3], two), number, F.concat_ws("/", F.lit("2024"), two, *w[:3]),
        F.date_format(F.timestamp_seconds(F.pmod(F.xxhash64(F.lit("t"), "id"), F.lit(2_000_000_000))), "yyyy-MM-dd'T'HH-mm-ss-SSS"), F.concat_ws("-", F.concat_ws("_", w[0], two), w[1], number),
        F.concat(F.element_at(F.array(*map(F.lit, ROWS)), (F.pmod(F.xxhash64(F.lit("q"), "id"), F.lit(len(ROWS))) + 1).cast("int")), F.lit("-"), w[0]),
    ]
    ids = spark.range(n)
    each = spark.range(4 * len(ALPHABET)).select(F.repeat(F.element_at(F.split(F.lit(ALPHABET), ""), (F.pmod("id", F.lit(len(ALPHABET))) + 1).cast("int")), F.lit(30)).alias("text"), F.lit(0).alias("label"))
    return each.unionByName(ids.select(pick(forms, "r").alias("text"), F.lit(1).alias("label"))).unionByName(ids.select(pick(ordinary, "o").alias("text"), F.lit(0).alias("label")))


def train(samples: DataFrame, text_col: str = "text", label_col: str = "label", smoothing: float = 0.5) -> MarkovRatio:
    """Two first-order Markov models from labelled strings; strings of null text or label are left out.

    Pairs are counted on Spark; at most two counts for each pair of the alphabet come back.
    """
    chars = F.split(F.col(text_col), "")
    strings = samples.select(F.col(label_col).cast("int").alias("label"), chars.alias("c")).filter("label IN (0, 1) AND size(c) > 1")
    pairs = strings.select("label", F.explode(F.expr("arrays_zip(slice(c, 1, size(c) - 1), slice(c, 2, size(c) - 1))")).alias("p"))
    pairs = pairs.select("label", F.col("p").getField("0").alias("a"), F.col("p").getField("1").alias("b"))
    known = F.split(F.lit(ALPHABET), "")
    rows = pairs.filter(F.array_contains(known, F.col("a")) & F.array_contains(known, F.col("b"))).groupBy("label", "a", "b").count().collect()
    n = len(ALPHABET)
    counts = [[[smoothing] * n for _ in range(n)] for _ in range(2)]
    for label, a, b, k in rows:
        counts[label][ALPHABET.index(a)][ALPHABET.index(b)] += k
    logs = [[[math.log(x / sum(row)) for x in row] for row in own] for own in counts]
    return MarkovRatio([logs[1][a][b] - logs[0][a][b] for a in range(n) for b in range(n)])


def _found(text: Column, pattern: str, group: int, length: int, kind: str, order: int) -> Column:
    """Spans of the leftmost non-overlapping matches whose ``group`` has ``length`` characters or more, as structs
    (start, order, end, kind, text), from the lengths of the matches and of what stands between them."""
    matches, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    sizes = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("g"), matches.alias("m"), F.slice(between, 1, F.size(between) - 1).alias("b"))
    walked = F.aggregate(
        sizes, F.struct(F.lit(0).alias("at"), F.expr("CAST(array() AS array<struct<start: int, rank: int, end: int, kind: string, text: string>>)").alias("found")),
        lambda a, x: F.struct(
            (a["at"] + F.length(x["b"]) + F.length(x["m"])).alias("at"),
            F.when(
                F.length(x["g"]) >= length,
                F.concat(a["found"], F.array(F.struct(
                    (a["at"] + F.length(x["b"])).alias("start"), F.lit(order).alias("rank"),
                    (a["at"] + F.length(x["b"]) + F.length(x["m"])).alias("end"), F.lit(kind).alias("kind"), x["m"].alias("text"),
                ))),
            ).otherwise(a["found"]).alias("found"),
        ),
        lambda a: a["found"],
    )
    # most texts have no match; they are read once
    return F.when(text.rlike(pattern), walked).otherwise(F.expr("CAST(array() AS array<struct<start: int, rank: int, end: int, kind: string, text: string>>)"))


def _pieces(run: Column, base: Column, length: int = 20) -> Column:
    """What base matches, sorted by start, leave of a run: pieces of ``length`` or more, as spans."""

    def piece(lo: Column, hi: Column) -> Column:
        own = F.struct(lo.alias("start"), run["rank"].alias("rank"), hi.alias("end"), run["kind"].alias("kind"), run["text"].substr(lo - run["start"] + 1, hi - lo).alias("text"))
        return F.when(hi - lo >= length, F.array(own)).otherwise(F.lit(None).cast(SPANS))

    add = lambda found, new: F.concat(found, F.coalesce(new, F.expr(f"CAST(array() AS {SPANS})")))
    return F.aggregate(
        F.filter(base, lambda b: (b["start"] < run["end"]) & (run["start"] < b["end"])),
        F.struct(run["start"].alias("at"), F.expr(f"CAST(array() AS {SPANS})").alias("found")),
        lambda s, b: F.struct(F.greatest(s["at"], b["end"]).alias("at"), add(s["found"], piece(s["at"], b["start"])).alias("found")),
        lambda s: add(s["found"], piece(s["at"], run["end"])),
    )


def _stretches(ratios: Column, threshold: float) -> Column:
    """The stretches of a piece whose sum of ``ratios``, one for each pair of characters, is ``threshold`` or more, as
    structs (a, b) of first and last character from 1. A stretch starts where the sum was last 0 and ends where it
    is greatest; it is over when the sum has since fallen by ``threshold`` or to 0."""

    def step(s: Column, x: Column) -> Column:
        fresh = s["sum"] <= 0
        now = F.when(fresh, x).otherwise(s["sum"] + x)
        higher, over = now > s["best"], now <= F.greatest(F.lit(0.0), s["best"] - threshold)
        return F.struct(
            (s["i"] + 1).alias("i"), F.when(over, 0.0).otherwise(now).alias("sum"), F.when(fresh, s["i"]).otherwise(s["start"]).alias("start"),
            F.when(over, 0.0).otherwise(F.greatest(s["best"], now)).alias("best"),
            F.when(higher, F.when(fresh, s["i"]).otherwise(s["start"])).otherwise(s["a"]).alias("a"), F.when(higher, s["i"] + 1).otherwise(s["b"]).alias("b"),
            F.when(over, ended(s)).otherwise(s["found"]).alias("found"),
        )

    def ended(s: Column) -> Column:
        return F.when(s["best"] >= threshold, F.concat(s["found"], F.array(F.struct(s["a"].alias("a"), s["b"].alias("b"))))).otherwise(s["found"])

    zero = F.expr("struct(1 AS i, 0D AS sum, 1 AS start, 0D AS best, 0 AS a, 0 AS b, CAST(array() AS array<struct<a: int, b: int>>) AS found)")
    return F.aggregate(ratios, zero, step, ended)


def _widened(piece: Column, stretches: Column) -> Column:
    """``stretches`` of a piece as spans, without ``/``, ``_``, ``-`` and ``=`` at their ends, then out to the next
    character that isn't a letter or digit, with ``=`` after them; those that then overlap are one."""

    def bare(x: Column) -> Column:
        own = piece["text"].substr(x["a"], x["b"] - x["a"] + 1)
        before, after = (F.length(F.regexp_extract(own, pattern, 0)) for pattern in ("^[/_=-]*", "[/_=-]*$"))
        return F.struct((x["a"] + before).alias("a"), (x["b"] - after).alias("b"))

    def ends(x: Column) -> Column:
        left = F.length(F.regexp_extract(piece["text"].substr(F.lit(1), x["a"] - 1), "[A-Za-z0-9]*$", 0))
        right = F.length(F.regexp_extract(piece["text"].substr(x["b"] + 1, F.length(piece["text"])), "^[A-Za-z0-9]*=*", 0))
        return F.struct((x["a"] - left).alias("a"), (x["b"] + right).alias("b"))

    last = lambda s: F.try_element_at(s, F.lit(-1))
    joined = F.aggregate(
        F.transform(F.transform(stretches, bare), ends), F.expr("CAST(array() AS array<struct<a: int, b: int>>)"),
        lambda s, x: F.when(
            (F.size(s) > 0) & (x["a"] <= last(s)["b"]),
            F.concat(F.slice(s, 1, F.size(s) - 1), F.array(F.struct(last(s)["a"].alias("a"), F.greatest(last(s)["b"], x["b"]).alias("b")))),
        ).otherwise(F.concat(s, F.array(x))),
    )
    return F.transform(
        F.filter(joined, lambda x: x["b"] - x["a"] + 1 >= SHORTEST),
        lambda x: F.struct(
            (piece["start"] + x["a"] - 1).alias("start"), piece["rank"].alias("rank"), (piece["start"] + x["b"]).alias("end"),
            piece["kind"].alias("kind"), piece["text"].substr(x["a"], x["b"] - x["a"] + 1).alias("text"),
        ),
    )


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def find_secrets(docs: DataFrame, model: MarkovRatio, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Secrets of each text: ``doc_id, base, random``, arrays of (start, rank, end, kind, text), by start.

    ``base`` are matches of ``KINDS``. Runs of key characters are cut at base matches; ``random`` are the
    stretches within pieces of 20 or more that the random model makes likelier than the ordinary one by
    ``threshold`` nats, whatever ordinary text they are joined to, out to the next character that isn't a letter
    or digit; those of fewer than ``SHORTEST`` characters don't count. Starts and ends count code points. Built-in functions alone; every row is worked on where it is read, without a shuffle.

    Nulls: a null text counts as empty, without spans; a null id is kept. Repeated rows are scanned each. An
    empty table gives no rows. The work for a text is in proportion to its length, and to the square of its
    number of matches.
    """
    n = len(ALPHABET)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    kinds = [_found(F.col("_text"), SCANNED.get(kind, pattern), group, length, kind, k) for k, (kind, pattern, group, length) in enumerate(KINDS)]
    rows = rows.select("doc_id", F.array_sort(F.concat(*kinds)).alias("base"), _found(F.col("_text"), CANDIDATE, 0, 20, "random", len(KINDS)).alias("_runs"))
    rows = rows.withColumn("_runs", F.when(F.size("_runs") > 0, F.flatten(F.transform("_runs", lambda c: _pieces(c, F.col("base"))))).otherwise(F.col("_runs")))
    coded = F.transform("_runs", lambda c: F.struct(c.alias("c"), F.transform(F.split(c["text"], ""), lambda x: F.position(x, F.lit(ALPHABET))).alias("k")))
    weights = model.column()
    ratios = lambda c: F.transform(
        F.sequence(F.lit(1), F.length(c["c"]["text"]) - 1),
        lambda i: F.element_at(weights, ((F.element_at(c["k"], i) - 1) * n + F.element_at(c["k"], i + 1)).cast("int")),
    )
    likely = F.when(F.size("_runs") > 0, F.flatten(F.transform(coded, lambda c: _widened(c["c"], _stretches(ratios(c), threshold))))).otherwise(F.col("_runs"))
    return rows.select("doc_id", "base", likely.alias("random"))


def secret_counts(found: DataFrame) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random`` of :func:`find_secrets`."""
    kinds = F.transform("base", lambda x: x["kind"])
    counts = [(F.size("base") - F.size(F.array_remove(kinds, kind))).cast("long").alias(f"n_{kind}") for kind, *_ in KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(_written(F.col("base")), 256).alias("base_sha256"),
        _written(F.array_sort(F.concat("base", "random"))).alias("spans"), F.size("random").cast("long").alias("n_random"),
    )
