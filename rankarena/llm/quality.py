"""Quality classifier: an interpolated modified Kneser-Ney model of byte n-grams, trained on trusted texts.

Counts are tables. The highest order has raw counts of the trusted texts; each lower order counts the different left
extensions of an n-gram in the order above. For every n-gram that any document has, its probability is built from the
lowest order up by joins with counts and contexts, all keyed by n-gram and so spread over shards. Documents are dealt
into shards of bounded size; a shard asks for the n-grams it has, once each, and sums their log probabilities into
a perplexity for each document. What is repeated looks likely to the model, so a second measure stands beside it: the
repetition of a document, its bytes by different n-grams in windows of ``WINDOW`` bytes. A document is rejected if either
is over its threshold.

A quarter of the trusted texts, by hash, is left out of training; thresholds come from those: a quantile of each
language, read from histograms of logarithms. A language with few of them uses all languages'. A short text says little, so
an odd word in it weighs more than in a long one. By classes of length, from a few bytes up, the threshold is therefore at
least what nearly all held-out texts of such lengths stay under (a quantile, too). A class with few of them borrows from
neighbouring lengths.

Defined results: a null or empty text has neither measure and is not rejected; a null language is a language of its own.
An identifier is trusted if it is labelled and all its labels are good; rows that share it are trusted together. Without
trusted texts nothing is rejected. Input columns of any name are kept in ``row``.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankarena.llm.batches import lean, lean_cogroup, lean_group, pieces, text_bytes
from rankarena.sources.scratch import written

ORDER = 5
#: Bytes of text that are scored together.
SHARD_BYTES = 16 << 20
#: Shards that a task scores, one after another: a hash deals a few to each task more evenly than one.
SHARDS_PER_TASK = 2
QUANTILE = 0.99
#: Of held-out trusted texts of like length, so many are not over a threshold; short texts vary more than long ones.
SHORT_QUANTILE = 0.999
#: Classes of length, each of up to twice the bytes of the one before.
CLASSES = 40
#: Bytes within which repeated n-grams are counted.
WINDOW = 256
#: Held-out trusted texts that a language needs for a threshold of its own, and a class of length for its allowance.
LEAST_TEXTS = 50
CALIBRATION_FOLDS = 4
#: Trusted identifiers are sent to all tasks up to this many (16 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Measures and the columns of their thresholds.
MEASURES = {"perplexity": "threshold", "repetition": "repetition_threshold"}
_BINS = 1000.0
_PENDING = 1 << 21
_PIECE_BODIES = 1 << 18
_WINDOWS = 1 << 11


def grams_of(data: np.ndarray, offsets: np.ndarray, order: int = ORDER) -> np.ndarray:
    """For each byte the n-gram that ends there, as one number; before a text there are zeros."""
    grams = np.zeros(len(data), np.int64)
    place = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    for back in range(min(order, len(data))):
        earlier = data[: len(data) - back].astype(np.int64) << (8 * back)
        grams[back:] |= np.where(place[back:] >= back, earlier, 0)
    return grams


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compress the last column, ``text``; what is shuffled shrinks more than by the shuffle's own compression."""
    for batch in batches:
        pack = zstandard.ZstdCompressor(level=3).compress
        bodies = [None if t is None else pack(t) for t in batch.column("text").cast(pa.large_binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(bodies, pa.binary())], [*batch.schema.names[:-1], "body"])


def unpacked(table: pa.Table) -> Iterator[pa.Array]:
    """The texts of ``body``, some rows at a time."""
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in table.select(["body"]).to_batches():
        for piece in pieces(batch, "body", _PIECE_BODIES):
            texts = [None if b is None else unpack(b) for b in piece.column("body").to_pylist()]
            yield pa.array(texts, pa.binary()).cast(pa.string())


def repetition(places: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each text its bytes by different n-grams, counted anew in each window; ``places`` are numbers of n-grams."""
    sizes = np.diff(offsets)
    windows = -(-sizes // WINDOW)
    begins = np.repeat(offsets[:-1] - (np.cumsum(windows) - windows) * WINDOW, windows) + np.arange(windows.sum()) * WINDOW
    held = np.minimum(np.repeat(offsets[1:], windows) - begins, WINDOW)
    different = np.zeros(len(begins), np.int64)
    for start in range(0, len(begins), _WINDOWS):
        part = slice(start, start + _WINDOWS)
        at = begins[part, None] + np.arange(WINDOW)
        # A row for each window; a short one is filled up with -1. Sorted, a row changes where a new n-gram comes.
        row = np.where(np.arange(WINDOW) < held[part, None], places[np.minimum(at, len(places) - 1)], -1).astype(np.int32)
        row.sort(axis=1)
        different[part] = (row[:, 1:] != row[:, :-1]).sum(axis=1) + (held[part] == WINDOW)
    owners = np.repeat(np.arange(len(sizes)), windows)
    with np.errstate(invalid="ignore", divide="ignore"):
        return sizes / np.bincount(owners, different, len(sizes))


class Counter:
    """Counts of numbers; what is added is merged from time to time."""

    def __init__(self) -> None:
        self.keys, self.counts, self.waiting = np.zeros(0, np.int64), np.zeros(0, np.int64), []

    def add(self, keys: np.ndarray) -> None:
        self.waiting.append(np.unique(keys, return_counts=True))
        if sum(len(k) for k, _ in self.waiting) > _PENDING:
            self.merge()

    def merge(self) -> None:
        keys = np.concatenate([self.keys, *(k for k, _ in self.waiting)])
        counts = np.concatenate([self.counts, *(c for _, c in self.waiting)])
        self.keys, place = np.unique(keys, return_inverse=True)
        self.counts = np.bincount(place, counts, len(self.keys)).astype(np.int64)
        self.waiting = []


def gram_counts(docs: DataFrame, *, text_col: str = "text", order: int = ORDER) -> DataFrame:
    """(g, c): partial counts of the n-grams of all texts, several rows an n-gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Counter()
        for batch in batches:
            for piece in pieces(batch, "text"):
                found.add(grams_of(*text_bytes(piece.column("text")), order))
        found.merge()
        for start in range(0, len(found.keys), 1 << 17):
            part = slice(start, start + (1 << 17))
            yield pa.RecordBatch.from_arrays([pa.array(found.keys[part]), pa.array(found.counts[part])], ["g", "c"])

    return docs.select(F.col(text_col).alias("text")).where("text <> ''").mapInArrow(lean(run), "g bigint, c bigint")


def model_levels(trusted: DataFrame, *, order: int = ORDER) -> DataFrame:
    """(k, g, c): counts by order; raw ones for the highest and left extensions for the others."""
    level = written(gram_counts(trusted, order=order).groupBy("g").agg(F.sum("c").alias("c")), "ngram-counts")
    levels = level.select(F.lit(order).alias("k"), "g", "c")
    for k in range(order - 1, 0, -1):
        shorter = F.col("g").bitwiseAND((1 << 8 * k) - 1)
        level = level.groupBy(shorter.alias("g")).agg(F.count(F.lit(1)).alias("c"))
        levels = levels.unionByName(level.select(F.lit(k).alias("k"), "g", "c"))
    return written(levels, "ngram-levels")


def discounts(levels: DataFrame) -> dict[int, tuple[float, float, float]]:
    """The three discounts of each order, from how many n-grams are seen once to four times."""
    seen = levels.groupBy("k").agg(*[F.count(F.when(F.col("c") == n, 1)).alias(f"n{n}") for n in (1, 2, 3, 4)]).collect()
    found = {}
    for row in seen:
        n = [row["n1"], row["n2"], row["n3"], row["n4"]]
        if all(n):
            y = n[0] / (n[0] + 2 * n[1])
            raw = [m - (m + 1) * y * n[m] / n[m - 1] for m in (1, 2, 3)]
            found[row["k"]] = tuple(min(max(d, 0.05), m - 0.05) for m, d in zip((1, 2, 3), raw, strict=True))
        else:
            found[row["k"]] = (0.5, 0.75, 0.75)
    return found


def log_probabilities(grams: DataFrame, levels: DataFrame, *, order: int = ORDER) -> DataFrame:
    """(g, logp) for different n-grams ``g`` of the highest order."""
    cut = discounts(levels)
    wanted = {order: grams.select("g")}
    for k in range(order - 1, 0, -1):
        wanted[k] = wanted[k + 1].select(F.col("g").bitwiseAND((1 << 8 * k) - 1).alias("g")).distinct()
    below: DataFrame | None = None
    for k in range(1, order + 1):
        counts = levels.where(F.col("k") == k).select("g", "c")
        d = cut.get(k, (0.5, 0.75, 0.75))
        discount = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        contexts = counts.groupBy(F.shiftrightunsigned("g", 8).alias("h")).agg(
            F.sum("c").alias("total"), F.sum(discount).alias("left")
        )
        asked = wanted[k].withColumn("h", F.shiftrightunsigned("g", 8))
        shorter = F.col("g").bitwiseAND((1 << 8 * (k - 1)) - 1)
        if below is None:
            asked = asked.withColumn("lower", F.lit(1.0 / 256))
        else:
            asked = asked.withColumn("s", shorter).join(below.select(F.col("g").alias("s"), F.col("p").alias("lower")), "s")
        own = F.coalesce(F.col("c") - discount, F.lit(0.0))
        p = F.when(F.col("total").isNull(), F.col("lower")).otherwise((own + F.col("left") * F.col("lower")) / F.col("total"))
        below = asked.join(counts, "g", "left").join(contexts, "h", "left").select("g", p.alias("p"))
    return below.select("g", F.log("p").cast("float").alias("logp"))


def with_trust(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """``row`` and ``trusted``: whether the identifier is labelled and all of its labels are good."""
    good = labels.groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).alias("_good")).where("_good = 1 AND _id IS NOT NULL")
    good = good.select("_id", F.lit(True).alias("_trusted"))
    if good.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        good = F.broadcast(good)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    joined = rows.join(good, F.col(f"row.`{id_col}`") == F.col("_id"), "left")
    return joined.select("row", F.coalesce("_trusted", F.lit(False)).alias("trusted"))


def perplexities(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    label_col: str = "quality", keep_text: bool = True, order: int = ORDER, shard_bytes: int = SHARD_BYTES
) -> DataFrame:
    """For each row: ``row`` (all columns but the text), ``text``, ``lang``, ``bytes``, ``perplexity``,
    ``repetition``, ``calibrates``.

    The perplexity is one of bytes. Without ``keep_text`` the text is null.
    """
    base = with_trust(docs, labels, id_col=id_col, label_col=label_col).select(
        "*", F.col(f"row.`{text_col}`").alias("text"), F.col(f"row.`{lang_col}`").cast("string").alias("lang")
    )
    left_out = F.pmod(F.xxhash64("text", F.lit("calibration")), F.lit(CALIBRATION_FOLDS)) == 0
    levels = model_levels(base.where(F.col("trusted") & ~left_out).select("text"), order=order)
    grams = gram_counts(docs, text_col=f"`{text_col}`", order=order).groupBy("g").agg(F.count(F.lit(1)).alias("_n"))
    logs = written(log_probabilities(written(grams, "ngrams"), levels, order=order), "ngram-logs")

    total = docs.agg(F.sum(F.octet_length(f"`{text_col}`"))).first()[0] or 0
    shards = 1 + total // shard_bytes
    rows = base.select(
        F.pmod(F.xxhash64(F.col(f"row.`{id_col}`"), F.col("text")), F.lit(shards)).alias("shard"),
        F.struct(*[F.col(f"row.`{c}`") for c in docs.columns if c != text_col]).alias("row"),
        "lang",
        (F.col("trusted") & left_out).alias("calibrates"),
        "text",
    )
    row_type = rows.schema["row"].dataType.simpleString()
    dealt = rows.mapInArrow(lean(packed), f"shard bigint, row {row_type}, lang string, calibrates boolean, body binary")
    dealt = dealt.repartition(1 + int(shards) // SHARDS_PER_TASK, "shard")

    def ask(table: pa.Table) -> pa.Table:
        found = Counter()
        for texts in unpacked(table):
            found.add(grams_of(*text_bytes(texts), order))
        found.merge()
        shard = pa.repeat(table.column("shard")[0], len(found.keys))
        return pa.Table.from_arrays([shard, pa.array(found.keys)], ["shard", "g"])

    asked = dealt.groupBy("shard").applyInArrow(lean_group(ask), "shard bigint, g bigint")
    answers = asked.join(logs, "g").select("shard", "g", "logp")

    def score(table: pa.Table, known: pa.Table) -> pa.Table:
        keys, logp = known.column("g").to_numpy(), known.column("logp").to_numpy().astype(np.float64)
        by_key = np.argsort(keys)
        keys, logp = keys[by_key], logp[by_key]
        found, repeats, sizes, kept = [np.zeros(0)], [np.zeros(0)], [np.zeros(0, np.int64)], []
        for texts in unpacked(table):
            kept.append(texts)
            data, offsets = text_bytes(texts)
            sizes.append(np.diff(offsets))
            different, places = np.unique(grams_of(data, offsets, order), return_inverse=True)
            sums = np.concatenate(([0.0], np.cumsum(logp[np.searchsorted(keys, different)][places])))
            repeats.append(repetition(places, offsets))
            with np.errstate(invalid="ignore", divide="ignore"):
                found.append(np.exp(-np.diff(sums[offsets]) / sizes[-1]))
        values, repeated = np.concatenate(found), np.concatenate(repeats)
        texts = pa.chunked_array(kept, pa.string()) if keep_text else pa.nulls(len(values), pa.string())
        return pa.Table.from_arrays(
            [table.column("row"), texts, table.column("lang"), pa.array(np.concatenate(sizes)),
             pa.array(values, mask=np.isnan(values)), pa.array(repeated, mask=np.isnan(repeated)), table.column("calibrates")],
            ["row", "text", "lang", "bytes", "perplexity", "repetition", "calibrates"],
        )

    out_type = f"row {row_type}, text string, lang string, bytes bigint, perplexity double, repetition double, calibrates boolean"
    return dealt.groupBy("shard").cogroup(answers.groupBy("shard")).applyInArrow(lean_cogroup(score), out_type)


def thresholds(scored: DataFrame, *, measure: str = "perplexity", quantile: float = QUANTILE, least: int = LEAST_TEXTS) -> DataFrame:
    """(lang, center, threshold) for each language with texts enough, and under a second flag those for the others."""
    bins = (
        scored.where(F.col("calibrates") & F.col(measure).isNotNull())
        .select("lang", F.floor(F.log(measure) * _BINS).alias("bin"))
        .cube("lang", "bin")
        .agg(F.count(F.lit(1)).alias("n"), F.grouping("lang").alias("all_langs"), F.grouping("bin").alias("all_bins"))
        .where("all_bins = 0")
    )
    # A histogram: its size depends on the width of its bins, not on the rows.
    upto = Window.partitionBy("all_langs", "lang").orderBy("bin")
    whole = Window.partitionBy("all_langs", "lang")
    reached = bins.select("all_langs", "lang", "bin", F.sum("n").over(upto).alias("below"), F.sum("n").over(whole).alias("texts"))

    def edge(share: float) -> Column:
        return F.exp((F.min(F.when(F.col("below") >= share * F.col("texts"), F.col("bin"))) + 1) / _BINS)

    return reached.groupBy("all_langs", "lang").agg(
        edge(0.5).alias("center"), edge(quantile).alias("threshold"), F.max("texts").alias("texts")
    ).where((F.col("all_langs") == 1) | (F.col("texts") >= least))


def length_class() -> Column:
    """Texts of up to twice as many bytes are of one class."""
    return F.floor(F.log2(F.greatest("bytes", F.lit(1)))).cast("int")


def allowances(scored: DataFrame, *, measure: str, quantile: float = SHORT_QUANTILE, least: int = LEAST_TEXTS) -> list[float]:
    """By class of length, how far (as a logarithm) good texts of such lengths go over their language's ``center``.

    A class with few of them borrows from its neighbours. A mean over fewer bytes varies more, as the square root of their
    number, so what is borrowed from longer texts is scaled up.
    """
    excess = F.floor((F.log(measure) - F.log("center")) * _BINS)
    # A histogram again.
    bins = scored.where("calibrates").select(length_class().alias("k"), excess.alias("bin")).where("bin IS NOT NULL").groupBy("k", "bin").count().collect()
    classes, edges, counts = np.array([(r["k"], r["bin"] + 1, r["count"]) for r in bins], np.int64).reshape(-1, 3).T
    found = []
    for k in range(CLASSES):
        wide = 0
        while counts[np.abs(classes - k) <= wide].sum() < least and wide < CLASSES:
            wide += 1
        near = np.abs(classes - k) <= wide
        over = edges[near] * 2.0 ** (np.maximum(classes[near] - k, 0) / 2)
        order = np.argsort(over)
        upto = np.cumsum(counts[near][order])
        found.append(max(0.0, float(over[order][np.searchsorted(upto, quantile * upto[-1])]) / _BINS) if len(upto) else 0.0)
    return found


def judged(scored: DataFrame, *, quantile: float = QUANTILE, short_quantile: float = SHORT_QUANTILE, least: int = LEAST_TEXTS) -> DataFrame:
    """``scored`` with a threshold for each measure, and ``kept``. ``scored`` is read several times and should be a written table."""
    found, kept = scored, F.lit(True)
    for measure, name in MEASURES.items():
        limits = written(thresholds(scored, measure=measure, quantile=quantile, least=least), "thresholds")
        own = limits.where("all_langs = 0").select(F.col("lang").alias("_lang"), F.struct("center", "threshold").alias("_own"))
        # One row; without trusted texts none, and nothing is over the threshold then.
        rest = limits.where("all_langs = 1").select(F.struct("center", "threshold").alias("_rest"))
        met = found.join(own, F.col("lang").eqNullSafe(F.col("_lang")), "left").join(F.broadcast(rest), F.lit(True), "left")
        met = met.select(*found.columns, F.coalesce("_own", "_rest").alias("_limit"))
        over = allowances(met.select("*", "_limit.center"), measure=measure, quantile=short_quantile, least=least)
        allowed = F.get(F.array(*[F.lit(v) for v in over]), F.least(length_class(), F.lit(CLASSES - 1)))
        limit = F.greatest(F.col("_limit.threshold"), F.col("_limit.center") * F.exp(allowed))
        found = met.select(*found.columns, limit.alias(name))
        kept &= F.coalesce(F.col(measure) <= F.col(name), F.lit(True))
    return found.withColumn("kept", kept)


def classify(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One narrow row per row of ``docs``: identifier, language, both measures with their thresholds, and ``kept``."""
    narrow = docs.select(id_col, lang_col, text_col)
    scored = perplexities(narrow, labels, id_col=id_col, text_col=text_col, lang_col=lang_col, keep_text=False)
    scored = written(scored.drop("text"), "perplexities")
    columns = [c for pair in MEASURES.items() for c in pair]
    return judged(scored).select(F.col(f"row.`{id_col}`").alias(id_col), "lang", *columns, "kept")


def accepted(docs: DataFrame, labels: DataFrame, *, text_col: str = "text", **columns: str) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with their columns."""
    scored = written(perplexities(docs, labels, text_col=text_col, **columns), "perplexities")
    stay = judged(scored).where("kept")
    return stay.select(*[(F.col("text") if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
