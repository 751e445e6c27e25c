"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads windows of ``WINDOW_BYTES`` bytes in both directions, gives every position a distribution over the
learned languages, and a document the mean over all of its positions. It is trained in numpy by backpropagation through
time on a bounded sample of labelled rows (``sample_per_lang`` texts a language, chosen by a hash of the text, and an
excerpt of ``excerpt_chars`` characters of each); predictions read whole texts, window by window, in Arrow batches.

Defined results: a null text, an empty one and one without letters is ``und`` with score 0, as is every text if no row
is labelled. Rows without a language are not learned from. Rows without an identifier count as held out. Of equal
probabilities the first language in alphabetical order wins. Equal texts get equal predictions.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankarena.llm.batches import pieces, text_bytes
from rankarena.sources.scratch import written

UNDETERMINED = "und"
WINDOW_BYTES = 128
HIDDEN = 12
#: Bounds of what is learned from.
SAMPLE_PER_LANG = 400
EXCERPT_CHARS = 256
SAMPLED = 200_000
EPOCHS = 12
HELD_OUT_FOLDS = 5
_BATCH = 128
_COLUMNS = 2048
Params = dict[str, np.ndarray]


@dataclass
class Model:
    langs: list[str]
    params: Params


def new_params(langs: int, hidden: int, rng: np.random.Generator) -> Params:
    def made(*shape: int) -> np.ndarray:
        return (rng.standard_normal(shape) / np.sqrt(shape[-1])).astype(np.float32)

    params = {}
    for way in "fb":
        params[f"{way}E"] = (0.3 * rng.standard_normal((3 * hidden, 256))).astype(np.float32)
        params[f"{way}U"] = made(3 * hidden, hidden)
    return params | {"O": made(langs, 2 * hidden), "c": np.zeros((langs, 1), np.float32)}


def _step(table: np.ndarray, u: np.ndarray, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The next state, its gates (keep above, reset below) and its candidate; one column for each window.

    ``table`` has the input weights of each byte as a row. Sigmoids are written as tanh.
    """
    n = len(h)
    given = np.ascontiguousarray(table[x].T)
    gates = u[: 2 * n] @ h
    gates += given[: 2 * n]
    gates *= 0.5
    np.tanh(gates, out=gates)
    gates *= 0.5
    gates += 0.5
    candidate = u[2 * n :] @ (gates[n:] * h)
    candidate += given[2 * n :]
    np.tanh(candidate, out=candidate)
    after = h - candidate
    after *= gates[:n]
    after += candidate
    return after, gates, candidate


def _softmax(logits: np.ndarray) -> np.ndarray:
    logits -= logits.max(axis=0)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=0)
    return logits


def position_probabilities(params: Params, x: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(position, languages by windows) from the last position to the first; ``x`` is positions by windows."""
    hidden = params["fU"].shape[1]
    tables = {way: np.ascontiguousarray(params[f"{way}E"].T) for way in "fb"}
    state = np.zeros((hidden, x.shape[1]), params["fU"].dtype)
    forward = []
    for column in x:
        state, _, _ = _step(tables["f"], params["fU"], column, state)
        forward.append(state)
    state = np.zeros_like(state)
    left, right = np.ascontiguousarray(params["O"][:, :hidden]), np.ascontiguousarray(params["O"][:, hidden:])
    for t in range(len(x) - 1, -1, -1):
        state, _, _ = _step(tables["b"], params["bU"], x[t], state)
        yield t, _softmax(left @ forward[t] + right @ state + params["c"])


def loss_and_gradients(params: Params, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, Params]:
    """Mean cross entropy over the positions in ``mask``, and its gradients by backpropagation through time."""
    steps, width = x.shape
    hidden = params["fU"].shape[1]
    states, gates, candidates = {}, {}, {}
    for way in "fb":
        table = np.ascontiguousarray(params[f"{way}E"].T)
        state = np.zeros((hidden, width), params["fU"].dtype)
        states[way], gates[way], candidates[way] = {-1: state}, {}, {}
        for k in range(steps):
            t = k if way == "f" else steps - 1 - k
            state, gates[way][k], candidates[way][k] = _step(table, params[f"{way}U"], x[t], state)
            states[way][k] = state
    total = max(1.0, float(mask.sum()))
    out = {name: np.zeros_like(value) for name, value in params.items()}
    to_state = {"f": {}, "b": {}}
    loss = 0.0
    for t in range(steps):
        both = np.concatenate((states["f"][t], states["b"][steps - 1 - t]))
        error = _softmax(params["O"] @ both + params["c"])
        loss -= float((np.log(error[y, np.arange(width)] + 1e-12) * mask[t]).sum())
        error[y, np.arange(width)] -= 1
        error *= mask[t] / total
        out["O"] += error @ both.T
        out["c"] += error.sum(axis=1, keepdims=True)
        back = params["O"].T @ error
        to_state["f"][t], to_state["b"][steps - 1 - t] = back[:hidden], back[hidden:]
    for way in "fb":
        u = params[f"{way}U"]
        carried = np.zeros((hidden, width), u.dtype)
        by_byte = np.zeros((256, 3 * hidden), u.dtype)
        for k in range(steps - 1, -1, -1):
            carried = carried + to_state[way][k]
            before, keep, reset = states[way][k - 1], gates[way][k][:hidden], gates[way][k][hidden:]
            candidate = candidates[way][k]
            d_candidate = carried * (1 - keep) * (1 - candidate**2)
            d_keep = carried * (before - candidate) * keep * (1 - keep)
            through = u[2 * hidden :].T @ d_candidate
            d_reset = through * before * reset * (1 - reset)
            d_gates = np.concatenate((d_keep, d_reset))
            out[f"{way}U"][2 * hidden :] += d_candidate @ (reset * before).T
            out[f"{way}U"][: 2 * hidden] += d_gates @ before.T
            np.add.at(by_byte, x[k if way == "f" else steps - 1 - k], np.concatenate((d_gates, d_candidate)).T)
            carried = carried * keep + through * reset + u[: 2 * hidden].T @ d_gates
        out[f"{way}E"] += by_byte.T
    return loss / total, out


def windows_of(data: np.ndarray, offsets: np.ndarray, size: int = WINDOW_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of each row as columns of bytes (0 beyond its end), their lengths, and the row of each."""
    lengths = np.diff(offsets)
    count = -(-lengths // size)
    row = np.repeat(np.arange(len(lengths)), count)
    start = offsets[row] + (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)) * size
    held = np.minimum(offsets[row + 1] - start, size)
    at = start + np.arange(size)[:, None]
    inside = np.arange(size)[:, None] < held
    x = np.where(inside, data[np.minimum(at, max(len(data) - 1, 0))], 0).astype(np.uint8) if len(data) else np.zeros((size, 0), np.uint8)
    return x, held, row


def fit(samples: list[tuple[str, str]], *, hidden: int = HIDDEN, epochs: int = EPOCHS, seed: int = 7) -> Model:
    """Train on (language, text) pairs."""
    samples = sorted(samples)
    langs = sorted({lang for lang, _ in samples})
    rng = np.random.default_rng(seed)
    params = new_params(max(len(langs), 1), hidden, rng)
    if len(langs) < 2:
        return Model(langs, params)
    x, held, row = windows_of(*text_bytes(pa.array([text for _, text in samples], pa.string())))
    place = {lang: k for k, lang in enumerate(langs)}
    y = np.array([place[lang] for lang, _ in samples])[row]
    first, second = ({name: np.zeros_like(value) for name, value in params.items()} for _ in range(2))
    step, steps = 0, epochs * -(-x.shape[1] // _BATCH)
    for _ in range(epochs):
        order = rng.permutation(x.shape[1])
        for start in range(0, len(order), _BATCH):
            chosen = order[start : start + _BATCH]
            # Some windows are cut short, the way short texts are.
            cut = np.where(rng.random(len(chosen)) < 0.3, rng.integers(4, WINDOW_BYTES, len(chosen)), WINDOW_BYTES)
            mask = np.arange(WINDOW_BYTES)[:, None] < np.minimum(held[chosen], cut)
            batch = np.where(mask, x[:, chosen], 0).astype(np.uint8)
            _, gradients = loss_and_gradients(params, batch, mask.astype(np.float32), y[chosen])
            step += 1
            rate = 0.02 * (1 - step / (steps + 1))
            size = np.sqrt(sum(float((g**2).sum()) for g in gradients.values()))
            for name, gradient in gradients.items():
                gradient *= min(1.0, 1.0 / (size + 1e-9))
                first[name] += 0.1 * (gradient - first[name])
                second[name] += 0.01 * (gradient**2 - second[name])
                params[name] -= rate * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-8)
    return Model(langs, params)


def pooled(model: Model, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row: mean probabilities over its positions, and how many positions each language labels."""
    rows, langs = len(offsets) - 1, len(model.langs)
    x, held, row = windows_of(data, offsets)
    sums, labels = np.zeros((rows, langs)), np.zeros((rows, langs), np.int64)
    for start in range(0, x.shape[1], _COLUMNS):
        part, size = x[:, start : start + _COLUMNS], held[start : start + _COLUMNS]
        total = np.zeros((langs, part.shape[1]), np.float32)
        label = np.zeros((langs, part.shape[1]), np.int32)
        for t, probability in position_probabilities(model.params, part):
            inside = size > t
            best = probability >= probability.max(axis=0)
            label += best & inside
            probability *= inside
            total += probability
        np.add.at(sums, row[start : start + _COLUMNS], total.T)
        np.add.at(labels, row[start : start + _COLUMNS], label.T)
    return sums / np.maximum(np.diff(offsets), 1)[:, None], labels


def training_sample(docs: DataFrame, *, text_col: str, lang_col: str, sample_per_lang: int, excerpt_chars: int) -> list[tuple[str, str]]:
    """(language, excerpt) of about ``sample_per_lang`` different texts a language, or all that it has.

    Different texts are counted by a sketch that is off by a few hundredths, so a language of many copies has its share, too.
    The sample is bounded by ``SAMPLED`` texts: where there are too many languages for that, each has fewer texts.
    """
    rows = docs.select(
        F.col(f"`{lang_col}`").alias("lang"), F.xxhash64(f"`{text_col}`", F.lit("sample")).alias("key"), F.col(f"`{text_col}`").alias("text")
    ).where("lang IS NOT NULL AND text IS NOT NULL")
    counts = written(rows.groupBy("lang").agg(F.approx_count_distinct("key", 0.02).alias("texts")), "languages")
    langs = counts.count()
    if not langs:
        return []
    wanted = min(sample_per_lang, max(1, SAMPLED // langs))
    # A little more than wanted, as hashes fall unevenly; then the smallest hashes.
    share = F.least(F.lit(1.0), (wanted + 4 * F.sqrt(F.lit(wanted)) + 8) / F.col("texts"))
    start = 1 + F.pmod(F.xxhash64("text", F.lit("start")), F.greatest(F.length("text") - excerpt_chars, F.lit(1)))
    near = rows.join(counts, "lang").where(F.pmod("key", F.lit(1 << 30)) < share * (1 << 30))
    once = near.groupBy("lang", "key").agg(F.min(F.substring("text", start, F.lit(excerpt_chars))).alias("excerpt"))
    smallest = Window.partitionBy("lang").orderBy(F.pmod("key", F.lit(1 << 30)), "key")
    chosen = once.withColumn("place", F.row_number().over(smallest)).where(F.col("place") <= wanted)
    return [(r["lang"], r["excerpt"]) for r in chosen.orderBy("lang", "place").select("lang", "excerpt").collect()]


def held_out(id_col: str):  # noqa: ANN201
    """A fifth of the rows, by the checksum of their identifier as text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % HELD_OUT_FOLDS == 0


def predict(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """For each row: ``row`` (all columns but the text), ``lang_pred``, ``score``, and by language ``probabilities`` and ``positions``."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    rows = docs.select(
        F.struct(*(rest or [F.lit(None).alias("none")])).alias("row"),
        F.col(f"`{text_col}`").alias("text"),
        F.coalesce(F.col(f"`{text_col}`").rlike(r"\p{L}"), F.lit(False)).alias("letters"),
    )
    names = pa.array(model.langs, pa.string())

    def by_lang(values: np.ndarray, kind: pa.DataType) -> pa.MapArray:
        cuts = pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1])
        return pa.MapArray.from_arrays(cuts, pa.concat_arrays([names] * len(values)), pa.array(values.ravel(), kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                known = piece.column("letters").to_numpy(zero_copy_only=False) & bool(model.langs)
                if model.langs:
                    mean, labels = pooled(model, *text_bytes(piece.column("text")))
                else:
                    mean, labels = np.zeros((len(known), 1)), np.zeros((len(known), 0), np.int64)
                best = mean.argmax(axis=1)
                langs = [model.langs[k] if ok else UNDETERMINED for k, ok in zip(best, known, strict=True)]
                score = np.where(known, np.clip(mean[np.arange(len(mean)), best], 0, 1), 0.0)
                shown = mean if model.langs else mean[:, :0]
                yield pa.RecordBatch.from_arrays(
                    [piece.column("row"), pa.array(langs), pa.array(score), by_lang(shown, pa.float64()), by_lang(labels, pa.int64())],
                    ["row", "lang_pred", "score", "probabilities", "positions"],
                )

    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(
        run, f"row {kind}, lang_pred string, score double, probabilities map<string, double>, positions map<string, bigint>"
    )


def identify(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    sample_per_lang: int = SAMPLE_PER_LANG, excerpt_chars: int = EXCERPT_CHARS
) -> DataFrame:
    """Learn from the rows that are not held out, and predict for all."""
    learned = docs.where(~held_out(id_col))
    sample = training_sample(learned, text_col=text_col, lang_col=lang_col, sample_per_lang=sample_per_lang, excerpt_chars=excerpt_chars)
    rows = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return predict(rows, fit(sample)).select(
        F.col("row.id").alias(id_col), "row.held_out", "lang_pred", "score", "probabilities", "positions"
    )
