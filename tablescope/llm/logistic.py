"""Ridge logistic regression by Newton steps, and style features of texts; shared by the classifiers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tablescope.llm.tokens import Words

STYLE = (
    "log_words", "upper", "digit", "symbol", "exclaim", "bar", "punctuation", "word_length", "repeats", "blank_lines",
)
_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "symbol": b"#*$%&<>=~^@+_\\{}[]",
    "exclaim": b"!?",
    "bar": b"|",
    "punctuation": b".,;:()'\"-/",
}


def class_counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """How many bytes of each class every text holds, and ``n`` bytes in all."""
    texts = pa.concat_arrays([texts.cast(pa.large_binary())])
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data or b"", dtype=np.uint8)[bounds[0] : bounds[-1]]
    at = bounds - bounds[0]
    out = {"n": np.diff(at)}
    table = np.zeros(256, dtype=np.uint8)
    for i, members in enumerate(_CLASSES.values(), 1):
        table[list(members)] = i
    kinds = table[raw]
    for i, name in enumerate(_CLASSES, 1):
        places = np.flatnonzero(kinds == i)
        out[name] = np.diff(np.searchsorted(places, at))
    out["blank_lines"] = np.diff(np.searchsorted(np.flatnonzero(raw == 10), at))
    return out


def style(texts: pa.Array, words: Words | None = None) -> np.ndarray:
    """One row of ``STYLE`` features for each text, on scales near one; an empty text has zeros."""
    words = words or Words(texts)
    c = class_counts(texts)
    n = np.maximum(c["n"], 1)
    n_words = np.diff(words.bounds)
    same = np.flatnonzero(words.index[1:] == words.index[:-1]) + 1
    inner = same[~np.isin(same, words.bounds)]
    repeats = np.diff(np.searchsorted(inner, words.bounds))
    share = {k: np.log1p(200 * c[k] / n) for k in (*_CLASSES, "blank_lines")}
    share |= {
        "log_words": np.log1p(n_words) / 5,
        "word_length": np.log1p(n / np.maximum(n_words, 1)),
        "repeats": np.log1p(50 * repeats / np.maximum(n_words, 1)),
    }
    return np.stack([np.where(c["n"] > 0, share[k], 0.0) for k in STYLE], axis=1)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def with_bias(x: np.ndarray) -> np.ndarray:
    return np.concatenate([x, np.ones((len(x), 1))], axis=1)


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 15) -> np.ndarray:
    """Weights with the bias last. With one class only, the bias alone says how rare the other one must be."""
    n, p = x.shape
    w = np.zeros(p + 1)
    positive = float(y.sum())
    w[-1] = np.log((positive + 0.5) / (n - positive + 1))  # without any row below one half
    if positive in (0, n):
        return w
    xb, penalty = with_bias(x), np.full(p + 1, ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        q = sigmoid(xb @ w)
        gradient = xb.T @ (q - y) + penalty * w
        curve = (xb * (q * (1 - q))[:, None]).T @ xb + np.diag(penalty)
        step = np.linalg.solve(curve, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def predict(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return sigmoid(with_bias(x) @ w)


def counts_of(terms: dict[str, int], texts: pa.Array, words: Words, n_terms: int) -> np.ndarray:
    """log(1 + occurrences) of the given terms; a word counts without the marks around it."""
    place = np.fromiter((terms.get(w.strip(".,;:!?\"'()"), -1) for w in words.distinct), np.int64, len(words.distinct))
    found = place[words.index] if len(words.index) else np.zeros(0, np.int64)
    at = np.flatnonzero(found >= 0)
    row = np.searchsorted(words.bounds, at, side="right") - 1
    flat = np.bincount(row * n_terms + found[at], minlength=len(texts) * n_terms)
    return np.log1p(flat.reshape(len(texts), n_terms))


def lower(texts: pa.Array) -> pa.Array:
    return pc.utf8_lower(texts)
