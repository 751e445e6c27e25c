"""The quality classifier against a plain Kneser-Ney model, plain quantiles and plain repetition."""

import collections
import math
import random

import numpy as np
import pytest
from test_operators import frame, mixed_texts

from rankarena.llm import quality


class PlainKneserNey:
    """Interpolated modified Kneser-Ney over bytes, with zero bytes before a text."""

    def __init__(self, texts, order):
        self.order, self.counts = order, {}
        raw = collections.Counter(g for t in texts for g in self.grams(t))
        self.counts[order] = raw
        for k in range(order - 1, 0, -1):
            self.counts[k] = collections.Counter(g[1:] for g in self.counts[k + 1])
        self.cut = {}
        for k, counts in self.counts.items():
            n = [sum(c == m for c in counts.values()) for m in (1, 2, 3, 4)]
            if all(n):
                y = n[0] / (n[0] + 2 * n[1])
                raw = [m - (m + 1) * y * n[m] / n[m - 1] for m in (1, 2, 3)]
                self.cut[k] = [min(max(d, 0.05), m - 0.05) for m, d in zip((1, 2, 3), raw, strict=True)]
            else:
                self.cut[k] = [0.5, 0.75, 0.75]
        self.after = {k: collections.defaultdict(dict) for k in self.counts}
        for k, counts in self.counts.items():
            for g, c in counts.items():
                self.after[k][g[:-1]][g[-1]] = c

    def grams(self, text):
        body = bytes(self.order - 1) + text.encode()
        return [body[i : i + self.order] for i in range(len(text.encode()))]

    def p(self, gram):
        k = len(gram)
        if not k:
            return 1 / 256
        seen = self.after[k].get(gram[:-1])
        if not seen:
            return self.p(gram[1:])

        def discount(c):
            return self.cut[k][min(c, 3) - 1]

        c = seen.get(gram[-1], 0)
        left = sum(discount(v) for v in seen.values())
        return ((c - discount(c) if c else 0) + left * self.p(gram[1:])) / sum(seen.values())

    def perplexity(self, text):
        grams = self.grams(text)
        return math.exp(-sum(math.log(self.p(g)) for g in grams) / len(grams))


def plain_repetition(text, order):
    body = bytes(order - 1) + text.encode()
    size = len(text.encode())
    grams = [body[i : i + order] for i in range(size)]
    return size / sum(len(set(grams[w : w + quality.WINDOW])) for w in range(0, size, quality.WINDOW))


@pytest.mark.parametrize(("order", "shard"), [(5, 1 << 20), (3, 900)])
def test_measures_equal_a_plain_model(spark, order, shard):
    rng = random.Random(5)
    texts = [t if t is None or t.strip("\n ") or not t else "?" for t in mixed_texts(7, 60)] + ["aé" * 400, "日本 " * 30, rng.choice("xyz") * 300]
    docs = frame(spark, texts)
    labels = spark.createDataFrame([(k, 1) for k in range(3, 50)] + [(4, 0), (70, 1)], "doc_id bigint, quality int")
    rows = quality.perplexities(docs, labels, order=order, shard_bytes=shard).collect()
    by_id = {r["row"]["doc_id"]: r for r in rows}
    assert len(rows) == len(texts)
    trusted = [k for k in range(3, 50) if k != 4]
    held = {k for k in trusted if by_id[k]["calibrates"]}
    assert 0 < len(held) < len(trusted) and not any(by_id[k]["calibrates"] for k in range(len(texts)) if k not in trusted)
    model = PlainKneserNey([texts[k] for k in trusted if k not in held], order)
    for k, text in enumerate(texts):
        r = by_id[k]
        assert r["text"] == text and r["row"]["row"] == "y"
        if text:
            assert r["perplexity"] == pytest.approx(model.perplexity(text), rel=1e-5)
            assert r["repetition"] == pytest.approx(plain_repetition(text, order))
        else:
            assert r["perplexity"] is None and r["repetition"] is None


def test_probabilities_sum_to_one(spark):
    texts = ["abracadabra", "abrac", "cadabra abra"] * 3
    levels = quality.model_levels(frame(spark, texts), order=3)
    model = PlainKneserNey(texts, 3)
    context = ord("a") << 16 | ord("b") << 8
    grams = spark.createDataFrame([(context | w,) for w in range(256)], "g bigint")
    logs = {r["g"] & 255: r["logp"] for r in quality.log_probabilities(grams, levels, order=3).collect()}
    assert len(logs) == 256 and abs(sum(np.exp(v) for v in logs.values()) - 1) < 1e-5
    assert all(v == pytest.approx(math.log(model.p(bytes([97, 98, w]))), rel=1e-5) for w, v in logs.items())


def test_thresholds_are_quantiles_of_languages_and_lengths(spark):
    """Against plain sorting, up to the width of a bin."""
    rng = random.Random(6)
    rows = [(lang, rng.choice([3, 20, 300, 5000]), rng.random() < 0.9) for lang in ["en"] * 900 + ["fr"] * 300 + ["xx"] * 5 + [None] * 80 for _ in range(1)]
    rows = [(lang, n, math.exp(rng.gauss(1.5, 0.02 + 1 / math.sqrt(n))), 1.0 + rng.random() / n, c) for lang, n, c in rows]
    scored = spark.createDataFrame(rows, "lang string, bytes bigint, perplexity double, repetition double, calibrates boolean")
    found = quality.judged(scored).collect()

    def upper(values, q):
        values = sorted(values)
        return values[max(math.ceil(q * len(values)), 1) - 1]

    for at, name in ((2, "threshold"), (3, "repetition_threshold")):
        held = [r for r in rows if r[4]]
        of = collections.defaultdict(list)
        for r in held:
            of[r[0]].append(math.log(r[at]))
        of = {lang: v if len(v) >= quality.LEAST_TEXTS else [math.log(r[at]) for r in held] for lang, v in of.items()}
        limit, center = ({lang: upper(v, q) for lang, v in of.items()} for q in (0.99, 0.5))
        excess = collections.defaultdict(list)
        for r in held:
            excess[int(math.log2(r[1]))].append(math.log(r[at]) - center[r[0]])
        for r in found:
            allowed = max(0, upper(excess[int(math.log2(r["bytes"]))], 0.999))
            assert math.log(r[name]) == pytest.approx(max(limit[r["lang"]], center[r["lang"]] + allowed), abs=0.0035)
            assert r["kept"] == (r["perplexity"] <= r["threshold"] and r["repetition"] <= r["repetition_threshold"])


def test_noise_is_rejected_at_any_length(spark):
    rng = random.Random(8)
    words = ["the", "river", "runs", "down", "to", "sea", "and", "rests"]
    clean = [" ".join(rng.sample(words, k=8) + rng.choices(words, k=40)) for _ in range(150)] + [" ".join(rng.sample(words, k=1 + k % 4)) for k in range(120)]
    noise = ["".join(rng.choices("#%&*QXZ$", k=300)) for _ in range(10)] + ["#%", "#%&*", "#%&*QXZ$", "QXZ$ &*#%&*QX"]
    docs = frame(spark, [*clean, *noise, None, ""])
    labels = spark.createDataFrame([(k, 1) for k in range(270) if k % 5] + [(3, 0)], "doc_id bigint, quality int")
    kept = {r["doc_id"]: r["kept"] for r in quality.classify(docs, labels).collect()}
    # Good texts of a word or two are hard to tell from noise; some are lost.
    assert all(kept[k] for k in range(150)) and sum(kept[k] for k in range(150, 270)) >= 108
    assert kept[284] and kept[285] and not any(kept[k] for k in range(270, 284))
    accepted = quality.accepted(docs, labels)
    assert accepted.columns == docs.columns and sorted(r["doc_id"] for r in accepted.collect()) == sorted(k for k in kept if kept[k])
    assert all(r["kept"] for r in quality.classify(docs, labels.limit(0)).collect())
    assert quality.classify(docs.limit(0), labels).collect() == []


def test_repeated_words_are_rejected(spark):
    rng = random.Random(9)
    clean = [" ".join(rng.choices([a + b for a in ("ri", "se", "an", "mo", "tu") for b in ("ver", "ast", "den", "il", "or")], k=60)) for _ in range(120)]
    docs = frame(spark, [*clean, *[" ".join([clean[k].split()[0]] * 60) for k in range(5)], "#%&*QXZ$" * 2 + "!?=+<>^~"])
    labels = spark.createDataFrame([(k, 1) for k in range(120)], "doc_id bigint, quality int")
    kept = {r["doc_id"]: r["kept"] for r in quality.classify(docs, labels).collect()}
    assert not any(kept[k] for k in range(120, 126)) and sum(kept[k] for k in range(120)) >= 118


def test_repeated_rows_and_a_language_without_held_out_texts(spark):
    texts = [t for t in mixed_texts(2, 40) if t]
    docs = frame(spark, texts + texts, [*["en"] * len(texts), *["zz"] * len(texts)]).unionByName(frame(spark, texts[:4]))
    labels = spark.createDataFrame([(k, 1) for k in range(len(texts))] * 2, "doc_id bigint, quality int")
    found = quality.classify(docs, labels).collect()
    assert len(found) == 2 * len(texts) + 4
    again = [r for r in found if r["doc_id"] < 4 and r["lang"] == "en"]
    assert len(again) == 8 and all(sum(a == b for b in again) == 2 for a in again)
    assert len({r["threshold"] for r in found if r["perplexity"] and r["lang"] == "zz"}) >= 1
