"""Toxicity by a bidirectional gated recurrent network with attention pooling over character and word inputs.

A word's input is the vector of the word, if the training sample holds it often enough, beside the mean sum of
its character n-grams. Two gated recurrent layers read a window in either direction, attention pools their states, and a
logistic unit scores the window. A document's score is a calibrated mix of its highest window and the mean over all of
them. All of it is trained in numpy, on a bounded sample of labelled rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm.common import frugal, release_memory, small_batches, text_slices, unused

#: Words of a window, and from one window's start to the next's.
WINDOW, STRIDE = 96, 72
#: Labelled rows of each class that the model is fitted on, at most, and windows of one row in a training pass.
SAMPLE_ROWS, SAMPLE_WINDOWS = 900, 6
#: Words that have a vector of their own are in so many sample rows at least; the most frequent so many of them.
LEAST_ROWS, VOCABULARY = 5, 20_000
#: Lengths of the character n-grams, the buckets they are hashed to, and the weight of each in a word's input.
GRAMS, BUCKETS, GRAM_WEIGHT = (3, 6), 1 << 15, 0.25
UNITS, WORD_DIM, CHAR_DIM, ATTENTION = 8, 8, 8, 8
EPOCHS, BATCH, RATE = 14, 128, 0.01
SEED = 17
#: Windows scored at once, and words whose n-grams are summed at once.
WINDOW_BATCH, WORD_BATCH = 2048, 8192
_PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def normal(word: bytes) -> bytes:
    return word.lower().strip(_PUNCTUATION)


def grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words' character (byte) n-grams of both lengths, end to end, and where each word's begin.

    A word stands between marks, so that n-grams at its ends are told from others; it has at least one n-gram.
    """
    parts = [_grams(words[start : start + WORD_BATCH]) for start in range(0, len(words), WORD_BATCH)]
    if not parts:
        return np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64)
    before = np.cumsum([0, *(len(bucket) for bucket, _ in parts)])
    return np.concatenate([bucket for bucket, _ in parts]), np.concatenate([begins + base for (_, begins), base in zip(parts, before)])


def _grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b"".join(b"^" + (w or b" ") + b"$" for w in words), dtype=np.uint8).astype(np.uint64)
    sizes = np.array([max(1, len(w)) + 2 for w in words], dtype=np.int64)
    ends = np.repeat(np.cumsum(sizes), sizes)
    at = np.arange(len(data))
    word = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
    code, found = data.copy(), []
    for length in range(2, max(GRAMS) + 1):
        code[: len(data) - length + 1] = code[: len(data) - length + 1] * np.uint64(1000003) + data[length - 1 :]
        if length in GRAMS:
            whole = at + length <= ends
            found.append((word[whole], ((code[whole] + np.uint64(length)) * np.uint64(11400714819323198485) >> np.uint64(40)).astype(np.int32) % BUCKETS))
    word, bucket = (np.concatenate(x) for x in zip(*found))
    by = np.argsort(word, kind="stable")
    return bucket[by], np.searchsorted(word[by], np.arange(len(words)))


def window_starts(count: int) -> np.ndarray:
    """Where a text's windows begin; the last one ends with the text."""
    if count <= WINDOW:
        return np.zeros(1, dtype=np.int64)
    return np.append(np.arange(0, count - WINDOW, STRIDE), count - WINDOW)


def _squash(x: np.ndarray) -> np.ndarray:
    return np.tanh(x * np.float32(0.5)) * np.float32(0.5) + np.float32(0.5)


#: What a document's score takes from its windows' logits before calibration: the highest, the mean probability (as
#: log-odds), the logarithm of their number, and one.
PRIOR = np.array([0.5, 0.5, 0.0, 0.0])


def document_features(logits: np.ndarray, owner: np.ndarray, documents: int) -> np.ndarray:
    """One row per document from all its windows; each document has a window at least."""
    highest = np.full(documents, -np.inf)
    np.maximum.at(highest, owner, logits.astype(np.float64))
    count = np.bincount(owner, minlength=documents)
    mean = np.clip(np.bincount(owner, _squash(logits).astype(np.float64), documents) / count, 1e-5, 1 - 1e-5)
    return np.stack([np.clip(highest, -12, 12), np.log(mean / (1 - mean)), np.log(count), np.ones(documents)], axis=1)


@dataclass
class Model:
    vocabulary: dict[bytes, int]
    weights: dict[str, np.ndarray]
    theta: np.ndarray | None = None

    def inputs(self, words: list[bytes]) -> np.ndarray:
        """The input vector of each normalised word."""
        out = np.empty((len(words), WORD_DIM + CHAR_DIM), dtype=np.float32)
        for start in range(0, len(words), WORD_BATCH):
            part = words[start : start + WORD_BATCH]
            chars, starts = _grams(part)
            out[start : start + len(part), WORD_DIM:] = np.add.reduceat(self.weights["char"][chars], starts, axis=0) * np.float32(GRAM_WEIGHT)
            out[start : start + len(part), :WORD_DIM] = self.weights["word"][[self.vocabulary.get(w, 0) for w in part]]
        return out

    def logits(self, inputs: np.ndarray, windows: np.ndarray) -> np.ndarray:
        """Each window's logit; ``windows`` holds rows of ``inputs``, -1 beyond the text's end."""
        w = self.weights
        tables = [np.vstack([inputs @ w[f"x{d}"] + w[f"b{d}"], np.zeros((1, 3 * UNITS), dtype=np.float32)]) for d in "fb"]
        out = np.empty(len(windows), dtype=np.float32)
        for start in range(0, len(windows), WINDOW_BATCH):
            part = windows[start : start + WINDOW_BATCH]
            length = int((part >= 0).sum(axis=1).max(initial=1))
            states = np.empty((length, len(part), 2 * UNITS), dtype=np.float32)
            for d, (table, name) in enumerate(zip(tables, "fb")):
                recurrent, state = w[f"u{name}"], np.zeros((len(part), UNITS), dtype=np.float32)
                for t in range(length) if name == "f" else reversed(range(length)):
                    there = part[:, t]
                    x, m = table[there], state @ recurrent
                    gates = _squash(x[:, : 2 * UNITS] + m[:, : 2 * UNITS])
                    z = gates[:, :UNITS]
                    new = np.tanh(x[:, 2 * UNITS :] + gates[:, UNITS:] * m[:, 2 * UNITS :])
                    new += z * (state - new)
                    if (there < 0).any():
                        new = np.where((there >= 0)[:, None], new, state)
                    state = new
                    states[t, :, d * UNITS : (d + 1) * UNITS] = state
            energy = np.tanh(states @ w["a"] + w["ab"]) @ w["v"]
            energy = np.where(part[:, :length].T >= 0, energy, np.float32(-1e9))
            share = np.exp(energy - energy.max(axis=0))
            share /= share.sum(axis=0)
            out[start : start + len(part)] = np.einsum("tn,tnh->nh", share, states) @ w["o"] + w["ob"]
        return out

    def scores(self, features: np.ndarray) -> np.ndarray:
        """The calibrated scores of documents from ``document_features``."""
        return 1 / (1 + np.exp(-np.clip(features @ (PRIOR if self.theta is None else self.theta), -500, 500)))


def _split(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct normalised words, all texts' words as places among them, and the texts' bounds."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    words = lists.flatten()
    real = pc.not_equal(words, "")
    kept = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
    bounds = lists.offsets.to_numpy().astype(np.int64)
    bounds = kept[bounds - bounds[0]]
    coded = words.filter(real).dictionary_encode()
    normals: dict[bytes, int] = {}
    to_normal = np.array([normals.setdefault(normal(w), len(normals)) for w in coded.dictionary.cast(pa.large_binary()).to_pylist()], dtype=np.int64)
    return list(normals), to_normal[coded.indices.to_numpy()] if len(coded) else np.zeros(0, dtype=np.int64), bounds


def _windows(places: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All windows of all texts, as rows of places with -1 beyond the end, and each window's text."""
    counts = np.diff(bounds)
    starts = [window_starts(int(c)) for c in counts]
    owner = np.repeat(np.arange(len(counts)), [len(s) for s in starts])
    at = np.concatenate(starts)[:, None] + np.arange(WINDOW) if len(starts) else np.zeros((0, WINDOW), dtype=np.int64)
    inside = at < counts[owner][:, None]
    at += bounds[:-1][owner][:, None]
    at[~inside] = len(places)
    return np.append(places, -1).astype(np.int32)[at], owner


def score_texts(model: Model, texts: pa.Array) -> np.ndarray:
    """The score of each text, from all its windows; a text without words is one empty window."""
    if not len(texts):
        return np.zeros(0)
    words, places, bounds = _split(texts)
    windows, owner = _windows(places, bounds)
    inputs = model.inputs(words) if words else np.zeros((1, WORD_DIM + CHAR_DIM), dtype=np.float32)
    return model.scores(document_features(model.logits(inputs, windows), owner, len(texts)))


def _gradients(model: Model, words: np.ndarray, mask: np.ndarray, chars: tuple[np.ndarray, np.ndarray], own: np.ndarray, target: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Loss and gradients on one batch: ``words`` (windows x steps) into the batch's word types, whose rows in the
    word table are ``own`` and whose n-grams are ``chars``."""
    w, n, steps = model.weights, len(words), words.shape[1]
    buckets, begins = chars
    types = np.concatenate([w["word"][own], np.add.reduceat(w["char"][buckets], begins, axis=0) * np.float32(GRAM_WEIGHT)], axis=1)
    x = types[words]
    states = np.zeros((steps, n, 2 * UNITS), dtype=np.float32)
    saved: dict[str, list] = {"f": [], "b": []}
    for d, name in enumerate("fb"):
        state, proj = np.zeros((n, UNITS), dtype=np.float32), x @ w[f"x{name}"] + w[f"b{name}"]
        for t in range(steps) if name == "f" else reversed(range(steps)):
            m = state @ w[f"u{name}"]
            gates = _squash(proj[:, t, : 2 * UNITS] + m[:, : 2 * UNITS])
            z, r = gates[:, :UNITS], gates[:, UNITS:]
            new = np.tanh(proj[:, t, 2 * UNITS :] + r * m[:, 2 * UNITS :])
            live = mask[:, t : t + 1]
            after = live * (new + z * (state - new)) + (1 - live) * state
            saved[name].append((t, state, z, r, new, m[:, 2 * UNITS :], live))
            state = after
            states[t, :, d * UNITS : (d + 1) * UNITS] = state
    hidden = np.tanh(states @ w["a"] + w["ab"])
    energy = np.where(mask.T > 0, hidden @ w["v"], np.float32(-1e9))
    share = np.exp(energy - energy.max(axis=0))
    share /= share.sum(axis=0)
    pooled = np.einsum("tn,tnh->nh", share, states)
    logit = pooled @ w["o"] + w["ob"]
    loss = float(np.mean(np.logaddexp(0, logit) - target * logit))

    g = {k: np.zeros_like(v) for k, v in w.items()}
    d_logit = ((_squash(logit) - target) / n).astype(np.float32)
    g["o"], g["ob"] = pooled.T @ d_logit, d_logit.sum(keepdims=True)
    d_pooled = d_logit[:, None] * w["o"]
    d_share = np.einsum("nh,tnh->tn", d_pooled, states)
    d_energy = share * (d_share - (share * d_share).sum(axis=0))
    g["v"] = np.einsum("tn,tna->a", d_energy, hidden)
    d_hidden = d_energy[:, :, None] * w["v"] * (1 - hidden**2)
    g["a"], g["ab"] = np.einsum("tnh,tna->ha", states, d_hidden), d_hidden.sum(axis=(0, 1))
    d_states = share[:, :, None] * d_pooled + d_hidden @ w["a"].T
    d_x = np.zeros_like(x)
    for d, name in enumerate("fb"):
        d_state, d_proj = np.zeros((n, UNITS), dtype=np.float32), np.zeros((n, steps, 3 * UNITS), dtype=np.float32)
        for t, state, z, r, new, m, live in reversed(saved[name]):
            total = d_state + d_states[t, :, d * UNITS : (d + 1) * UNITS]
            d_after = live * total
            d_new = d_after * (1 - z) * (1 - new**2)
            d_z = d_after * (state - new) * z * (1 - z)
            d_r = d_new * m * r * (1 - r)
            d_proj[:, t] = np.concatenate([d_z, d_r, d_new], axis=1)
            d_m = np.concatenate([d_z, d_r, d_new * r], axis=1)
            g[f"u{name}"] += state.T @ d_m
            d_state = (1 - live) * total + d_after * z + d_m @ w[f"u{name}"].T
        g[f"x{name}"] += np.einsum("nti,ntj->ij", x, d_proj)
        g[f"b{name}"] += d_proj.sum(axis=(0, 1))
        d_x += d_proj @ w[f"x{name}"].T
    d_types = np.zeros_like(types)
    np.add.at(d_types, words.ravel(), d_x.reshape(-1, d_x.shape[2]))
    np.add.at(g["word"], own, d_types[:, :WORD_DIM])
    np.add.at(g["char"], buckets, np.repeat(d_types[:, WORD_DIM:] * np.float32(GRAM_WEIGHT), np.diff(np.append(begins, len(buckets))), axis=0))
    return loss, g


def train(texts: list[str | None], labels: list[int]) -> Model:
    """Fit a model on whole texts. Each pass takes the highest window of a toxic text and some windows of any other."""
    rng = np.random.default_rng(SEED)
    y = np.asarray(labels, dtype=np.float32)
    words, places, bounds = _split(pa.array(texts, pa.string()))
    windows, owner = _windows(places, bounds)
    rows = [np.unique(places[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
    held, bad = Counter(), Counter()
    for row, label in zip(rows, y):
        held.update(row.tolist())
        if label:
            bad.update(row.tolist())
    chosen = sorted((i for i, c in held.items() if c >= LEAST_ROWS), key=lambda i: (-held[i], words[i]))[:VOCABULARY]
    vocabulary = {words[i]: k + 1 for k, i in enumerate(chosen)}
    n_bad, n_good = max(1, int(y.sum())), max(1, int(len(y) - y.sum()))

    def init(*shape: int) -> np.ndarray:
        return rng.normal(0, 0.3 if len(shape) > 1 else 0.1, shape).astype(np.float32)

    w = {"word": init(len(chosen) + 1, WORD_DIM) * 0.2, "char": init(BUCKETS, CHAR_DIM) * 0.3}
    for name in "fb":
        w |= {f"x{name}": init(WORD_DIM + CHAR_DIM, 3 * UNITS), f"u{name}": init(UNITS, 3 * UNITS), f"b{name}": np.zeros(3 * UNITS, dtype=np.float32)}
    w |= {"a": init(2 * UNITS, ATTENTION), "ab": np.zeros(ATTENTION, dtype=np.float32), "v": init(ATTENTION), "o": init(2 * UNITS), "ob": np.zeros(1, dtype=np.float32)}
    evidence = np.zeros(len(words), dtype=np.float32)  # a word's log-odds start its vector
    for k, i in enumerate(chosen):
        odds = np.log((bad[i] + 0.5) / (n_bad + 1)) - np.log((held[i] - bad[i] + 0.5) / (n_good + 1))
        evidence[i] = np.clip(odds, -2, 4)
        w["word"][k + 1, 0] = evidence[i] / 2
    model = Model(vocabulary, w)

    buckets, begins = grams(words)
    sizes = np.diff(np.append(begins, len(buckets)))
    gram_held, gram_bad = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for row, label in zip(rows, y):
        own = np.unique(np.concatenate([buckets[begins[i] : begins[i] + sizes[i]] for i in row])) if len(row) else row
        gram_held[own] += 1
        gram_bad[own] += label
    del rows
    gram_odds = np.log((gram_bad + 1) / (n_bad + 2)) - np.log((gram_held - gram_bad + 1) / (n_good + 2))
    gram_odds = np.where(gram_held >= LEAST_ROWS, np.clip(gram_odds, -2, 4), 0).astype(np.float32)
    w["char"][:, 0] = gram_odds / 2
    if words:
        evidence = np.maximum(evidence, np.maximum.reduceat(gram_odds[buckets], begins))

    by_owner = np.searchsorted(owner, np.arange(len(texts) + 1))
    highest = np.array([np.maximum(evidence[v[v >= 0]], 0).sum() for v in windows], dtype=np.float32)
    place = np.fromiter((vocabulary.get(word, 0) for word in words), dtype=np.int64, count=len(words))
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in w.items()}
    step = 0
    for epoch in range(EPOCHS):
        if epoch in (3, 7, 11) and words:
            highest = model.logits(model.inputs(words), windows)
        picks = []
        for i in range(len(texts)):
            own = np.arange(by_owner[i], by_owner[i + 1])
            if y[i]:
                picks.append(own[[int(np.argmax(highest[own]))]])
            elif len(own) > SAMPLE_WINDOWS:
                hard = own[[int(np.argmax(highest[own]))]]
                picks.append(np.append(rng.choice(own, SAMPLE_WINDOWS - 1, replace=False), hard))
            else:
                picks.append(own)
        picked = rng.permutation(np.concatenate(picks)) if picks else np.zeros(0, dtype=np.int64)
        for start in range(0, len(picked), BATCH):
            batch = picked[start : start + BATCH]
            part = windows[batch]
            mask = (part >= 0).astype(np.float32)
            if not mask.any():
                continue
            types, local = np.unique(np.maximum(part, 0), return_inverse=True)
            counts = sizes[types]
            firsts = np.cumsum(counts) - counts
            chars = buckets[np.arange(counts.sum()) + np.repeat(begins[types] - firsts, counts)]
            _, g = _gradients(model, local.reshape(part.shape), mask, (chars, firsts), place[types], y[owner[batch]])
            step += 1
            for k, v in g.items():
                v = v + np.float32(1e-5) * w[k]
                first, second = moment[k]
                first += np.float32(0.1) * (v - first)
                second += np.float32(0.01) * (v * v - second)
                w[k] -= np.float32(RATE * min(1, 2 - 2 * epoch / EPOCHS)) * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + np.float32(1e-6))
    if words and len(texts):
        model.theta = _calibrate(document_features(model.logits(model.inputs(words), windows), owner, len(texts)), y.astype(np.float64))
    return model


def _calibrate(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic weights of the document's features, held near the prior."""
    theta, strength = PRIOR.copy(), np.array([2.0, 2.0, 2.0, 0.5])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        slope = x.T @ (p - y) + strength * (theta - PRIOR)
        curve = (x * (p * (1 - p))[:, None]).T @ x + np.diag(strength)
        theta = theta - np.clip(np.linalg.solve(curve, slope), -1, 1)
    return theta


def held_out(doc_id) -> bool:
    """Rows whose labels no model may learn: crc32 of the id as text leaves 1 when divided by 3."""
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def fit(docs: DataFrame, labels: DataFrame, *, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on at most ``sample_rows`` labelled rows of each class, those of the least hashes among rows not held out.

    Rows with a null id or label are left out. Without labels the model is as good as untrained.
    """
    usable = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).where(
        F.col("doc_id").isNotNull() & F.col("label").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    )
    order = [F.xxhash64(F.lit(SEED), "doc_id"), F.col("doc_id")]
    some = usable.where("label = 1").orderBy(*order).limit(sample_rows).unionByName(usable.where("label = 0").orderBy(*order).limit(sample_rows))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(some), "doc_id").select("doc_id", "text", "label")
    found = sorted(((r.doc_id, r.label, r.text or "", r.text) for r in rows.collect()), key=lambda r: r[:3])
    model = train([r[3] for r in found], [r[1] for r in found])
    del found
    release_memory()  # the driver goes on to other work
    return model


def score_documents(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] | None = None, score_col: str = "score") -> DataFrame:
    """``doc_id`` (or the columns ``keep``) and ``score_col`` of every document, over all windows of its whole text.

    A null or empty text is one empty window and has a score like any other. Repeated rows and null ids stay. An empty
    table gives no rows.
    """
    own = [F.col(c) for c in keep] if keep is not None else [F.col(id_col).alias("doc_id")]
    text = unused("_text", [*(keep or ["doc_id"]), score_col])
    rows = docs.select(*own, F.col(text_col).alias(text))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, text, 1 << 20):
                scores = pa.array(score_texts(sent.value, part.column(part.num_columns - 1)))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], scores], [*part.schema.names[:-1], score_col])

    schema = T.StructType([*rows.schema.fields[:-1], T.StructField(score_col, T.DoubleType())])
    small_batches(rows.sparkSession)
    return rows.mapInArrow(frugal(run), schema)
