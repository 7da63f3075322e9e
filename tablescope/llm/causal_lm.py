"""Scores of whole texts under a causal self-attention model over subword ids, beside a unigram base.

The model. Ids are grouped into ``CLASSES`` classes: the most frequent ids have one each, the others share classes of
about equal weight; ``GROUP`` neighbouring classes form a group. One layer of causal self-attention with relative positions, a
layer of rectified units, and a direct path from the last class predict the group of the next id, then its class within the
group; the id within its class follows the counts of all training documents. The direct path begins with the counts of class pairs
in all training documents. The probability of a text is the product over its ids and one closing id.

Training. Attention learns in numpy from all windows of all training documents. It begins with rounds over the windows of one
in ``TRAIN_SHARE`` training documents, chosen by a hash, and of about ``LEAST_DOCS`` at least. The windows are dealt to
``ROUNDS`` rounds; in each, tasks of about ``TRAINER_WINDOWS`` windows go on from the same weights, and the mean of theirs, by
windows, begins the next round. From there each task takes every window of its part of the training documents once, and the
mean of these weights, by windows, is the model. A window may reach over several texts; attention then stays within the text
of each place.

Scoring. A window holds ``CONTEXT`` ids and moves by ``STRIDE``: windows overlap, the last ``STRIDE`` ids of each are
scored in it, so each id is scored once with at least ``CONTEXT - STRIDE`` ids before it where the text has them. Windows
run over all texts of a batch; a mask keeps attention inside the text and before the id.

The base: log10((c + 0.5) / (N + 0.5 (V + 1))) for each word and one end, c, N and V counted in training texts. The
counts of the most frequent words, ``FREQUENT_WORDS`` at most, go to every task; the other words of all texts are joined
to their counts by word, so no table of all words is held anywhere.

NULL texts are empty: one token, the end. Documents whose key is NULL belong to training. Repeated rows count and are
scored as often as they occur. Without training documents every count is zero. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescope.llm.shared import as_text, slices, written
from tablescope.llm.tokens import END_ID, N_IDS, Words, word_ids

HELD_OUT = (5, 1)
CLASSES, OWN_CLASS = 256, 224
CONTEXT, STRIDE = 16, 8
WIDTH, HIDDEN = 24, 32
GROUP = 16
GROUPS = CLASSES // GROUP
TRAIN_SHARE, LEAST_DOCS = 64, 1_000
ROUNDS, TRAINER_WINDOWS = 4, 65_536
STEPS, LEAST_STEPS, BATCH = 400, 100, 512
#: size of the steps over all windows, which begin where the rounds end
LATE_RATE = 0.0015
#: trainers whose weights are added up in one place
TOGETHER = 64
FREQUENT_WORDS = 262_144
START_CLASS = CLASSES


def held_out(key: str) -> Column:
    """Whether the checksum of the key leaves the remainder that marks held-out documents."""
    mod, rest = HELD_OUT
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % mod == rest


@dataclass
class Classes:
    """Class of each id, and the logarithm of its probability within the class."""

    of_id: np.ndarray
    within: np.ndarray
    log_share: np.ndarray

    @staticmethod
    def from_counts(counts: np.ndarray) -> Classes:
        order = np.argsort(-counts, kind="stable")
        weight = counts + 0.5
        of_id = np.empty(len(counts), dtype=np.int64)
        of_id[order[:OWN_CLASS]] = np.arange(OWN_CLASS)
        rest = order[OWN_CLASS:]
        upto = np.cumsum(weight[rest])
        of_id[rest] = OWN_CLASS + np.minimum(
            (upto * (CLASSES - OWN_CLASS) / upto[-1]).astype(np.int64), CLASSES - OWN_CLASS - 1
        )
        total = np.bincount(of_id, weights=weight, minlength=CLASSES)
        share = np.maximum(total, 1e-300) / total.sum()
        return Classes(of_id, np.log(weight / total[of_id]).astype(np.float32), np.log(share + 1e-9).astype(np.float32))


class Attention:
    """Weights of the model, their training, and the tables that scoring uses."""

    def __init__(self, log_share: np.ndarray, seed: int = 5):
        rng = np.random.default_rng(seed)
        near = lambda *shape: (rng.standard_normal(shape) * shape[0] ** -0.5).astype(np.float32)
        self.w = {
            "e": near(CLASSES + 1, WIDTH) * 3, "q": near(WIDTH, WIDTH), "k": near(WIDTH, WIDTH), "v": near(WIDTH, WIDTH),
            "r": np.zeros(CONTEXT, np.float32), "a": near(WIDTH, HIDDEN), "b": np.zeros(HIDDEN, np.float32),
            "c": near(HIDDEN, WIDTH) * 0.3, "u": near(WIDTH, CLASSES) * 0.1, "s": log_share.astype(np.float32),
            "d": np.zeros((CLASSES + 1, CLASSES), np.float32), "gu": near(WIDTH, GROUPS) * 0.1,
            "gs": np.logaddexp.reduce(log_share.reshape(GROUPS, GROUP), axis=1).astype(np.float32),
            "gd": np.zeros((CLASSES + 1, GROUPS), np.float32),
        }
        # distance of key j from query i of a window, and whether the key comes first
        i, j = np.arange(CONTEXT - STRIDE, CONTEXT)[:, None], np.arange(CONTEXT)[None, :]
        self.causal = j <= i
        self.distance = np.where(self.causal, i - j, 0)

    def gradients(self, keys: np.ndarray, marks: np.ndarray, target: np.ndarray) -> tuple[float, dict]:
        """Mean loss over the queries of some windows, and its slope for every weight; ``target`` < 0 is padding.

        ``marks`` differ where places belong to different texts.
        """
        w, scale = self.w, WIDTH**-0.5
        kind, width, n_windows = w["e"].dtype, CLASSES + 1, len(keys)
        last = keys[:, CONTEXT - STRIDE :]
        # what a pair of classes contributes to attention is looked up, and so are the values
        at_q, at_k, values = w["e"] @ w["q"], w["e"] @ w["k"], w["e"] @ w["v"]
        pair = (last * width)[:, :, None] + keys[:, None, :]
        weight = (at_q * kind.type(scale)) @ at_k.T
        np.clip(weight, -30, 30, out=weight)
        p = np.take(np.exp(weight, out=weight), pair)
        p *= np.where(self.causal, np.exp(np.clip(w["r"][self.distance], -30, 30)), 0).astype(kind)
        mixed = np.flatnonzero((marks[:, :1] != marks).any(axis=1))
        if len(mixed):
            owner = marks[mixed]
            p[mixed] *= owner[:, None, :] == owner[:, CONTEXT - STRIDE :, None]
        p /= (p @ np.ones(CONTEXT, kind))[..., None]
        v = np.take(values, keys, axis=0)
        last, target = last.ravel(), target.ravel()
        used = target >= 0
        n = max(int(np.count_nonzero(used)), 1)
        # from here on places are in the order of their groups, then of their last classes: the classes of each group are
        # one small product, and what belongs to one group and last class lies together
        place = np.maximum(target, 0) // GROUP * width + last
        order = np.argsort(place.astype(np.uint16), kind="stable")
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        place, last, target = np.take(place, order), np.take(last, order), np.take(target, order)
        group, inner = np.divmod(np.maximum(target, 0), GROUP)
        edges = np.searchsorted(group, np.arange(GROUPS + 1)).tolist()
        starts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))

        found = (p @ v).reshape(-1, WIDTH)
        h = np.take(found, order, axis=0)
        h += np.take(w["e"], last, axis=0)
        act = h @ w["a"]
        act += w["b"]
        np.maximum(act, 0, out=act)
        z = act @ w["c"]
        z += h
        u = np.ascontiguousarray(w["u"].reshape(WIDTH, GROUPS, GROUP).transpose(1, 0, 2))
        direct = (w["d"] + w["s"]).reshape(width, GROUPS, GROUP)
        logits = np.empty((2, len(z), GROUP), kind)  # of the group, and of the class within it
        np.matmul(z, w["gu"], out=logits[0])
        logits[0] += np.take(w["gd"] + w["gs"], last, axis=0)
        logits[1] = np.take(direct.reshape(-1, GROUP), last * GROUPS + group, axis=0)
        parts = [(one, slice(edges[one], edges[one + 1])) for one in range(GROUPS) if edges[one] < edges[one + 1]]
        for one, part in parts:
            logits[1, part] += z[part] @ u[one]
        out = np.exp(logits)
        total = out @ np.ones(GROUP, kind)
        if not (np.isfinite(total).all() and total.all()):  # out of range: again, relative to the largest
            out = np.exp(logits - logits.max(axis=2, keepdims=True))
            total = out @ np.ones(GROUP, kind)
        at = np.concatenate([group, inner])
        at += np.arange(0, out.size, GROUP)
        flat, share = out.reshape(-1), ((target >= 0) / n).astype(kind)
        loss = -float((np.log(np.take(flat, at).reshape(2, -1) / total + 1e-30) * share).sum())
        out *= (share / total)[..., None]
        flat[at] -= np.concatenate([share, share])
        d_coarse, d_fine = out

        each = np.ones(len(z), kind)
        g = {"gu": z.T @ d_coarse, "gs": each @ d_coarse}
        dz = d_coarse @ w["gu"].T
        slope_u = np.zeros_like(u)
        for one, part in parts:
            slope_u[one] = z[part].T @ d_fine[part]
            dz[part] += d_fine[part] @ u[one].T
        g["u"] = slope_u.transpose(1, 0, 2).reshape(w["u"].shape)
        dpre = dz @ w["c"].T
        dpre *= act > 0
        g |= {"c": act.T @ dz, "a": h.T @ dpre, "b": each @ dpre}
        dz += dpre @ w["a"].T
        by_place = np.zeros((width * GROUPS, GROUP), kind)
        by_place[last[starts] * GROUPS + group[starts]] = np.add.reduceat(d_fine, starts, axis=0)
        g["d"] = by_place.reshape(w["d"].shape)
        g["s"] = np.ones(width, kind) @ g["d"]
        by_last = sums_by(last, np.concatenate([d_coarse, dz], axis=1), width)
        g["gd"], g["e"] = by_last[:, :GROUP], by_last[:, GROUP:]

        dh = np.take(dz, back, axis=0)
        level = np.einsum("ij,ij->i", dh, found).reshape(n_windows, STRIDE, 1)
        dh = dh.reshape(n_windows, STRIDE, WIDTH)
        ds = dh @ v.transpose(0, 2, 1)
        ds -= level
        ds *= p
        g["r"] = np.bincount(self.distance.ravel(), weights=(ds.sum(axis=0) * self.causal).ravel(), minlength=CONTEXT)
        g["r"] = g["r"].astype(kind)
        by_pair = np.bincount(pair.ravel(), weights=ds.ravel(), minlength=width * width).reshape(width, width)
        by_pair = (by_pair * scale).astype(kind)
        d_values = sums_by(keys.ravel(), (p.transpose(0, 2, 1) @ dh).reshape(-1, WIDTH), width)
        dq, dk = by_pair @ at_k, by_pair.T @ at_q
        g |= {"q": w["e"].T @ dq, "k": w["e"].T @ dk, "v": w["e"].T @ d_values}
        g["e"] = g["e"] + dq @ w["q"].T + dk @ w["k"].T + d_values @ w["v"].T
        return loss, g

    def start_direct(self, pairs: np.ndarray, prior: float = 5.0) -> None:
        """The direct path begins where the counts of class pairs put it."""
        share = np.exp(self.w["s"] - np.logaddexp.reduce(self.w["s"]))
        given = (pairs + prior * share) / (pairs.sum(axis=1, keepdims=True) + prior)
        self.w["d"] = np.log(given / share).astype(np.float32)
        grouped = given.reshape(len(given), GROUPS, GROUP).sum(axis=2)
        self.w["gd"] = np.log(grouped / share.reshape(GROUPS, GROUP).sum(axis=1)).astype(np.float32)

    def train(self, keys, marks, target, steps: int = STEPS, batch: int = BATCH, rate: float = 0.006) -> list[float]:
        """Adam over batches of windows, no window again before all had their turn; the losses."""
        rng, losses, adam = np.random.default_rng(3), [], Adam(self)
        order = np.empty(0, dtype=np.int64)
        for step in range(1, steps + 1 if len(keys) else 0):
            while len(order) < min(batch, len(keys)):
                order = np.concatenate([order, rng.permutation(len(keys))])
            at, order = order[:batch], order[batch:]
            now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            losses.append(adam.step(keys[at], marks[at], target[at], now))
        return losses

    def packed(self, factor: float = 1.0) -> np.ndarray:
        return np.concatenate([factor * p.ravel().astype(float) for p in self.w.values()])

    def unpack(self, values: np.ndarray) -> None:
        at = 0
        for n, p in self.w.items():
            self.w[n] = values[at : at + p.size].reshape(p.shape).astype(np.float32)
            at += p.size

    def tables(self) -> dict[str, np.ndarray]:
        """One layer over classes: what a pair of classes contributes to attention is known beforehand."""
        w = self.w
        pair = (w["e"] @ w["q"]) @ (w["e"] @ w["k"]).T * WIDTH**-0.5
        place = np.where(self.causal, np.exp(np.clip(w["r"][self.distance], -30, 30)), 0)
        return {
            "pair": np.exp(np.clip(pair, -30, 30)).astype(np.float32), "place": place.astype(np.float32),
            "v": np.hstack([w["e"] @ w["v"], np.ones((len(w["e"]), 1), np.float32)]), "d": (w["d"] + w["s"]).reshape(-1, GROUP), "gd": w["gd"] + w["gs"],
            "u": np.ascontiguousarray(w["u"].reshape(WIDTH, GROUPS, GROUP).transpose(1, 0, 2)),
            **{n: w[n] for n in ("e", "a", "b", "c", "gu")},
        }


class Adam:
    """Steps of a model's weights down the slopes of one batch after another."""

    def __init__(self, model: Attention):
        self.model, self.steps = model, 0
        self.m, self.v = np.zeros((2, sum(p.size for p in model.w.values())), np.float32)

    def step(self, keys: np.ndarray, marks: np.ndarray, target: np.ndarray, rate: float) -> float:
        loss, slopes = self.model.gradients(keys, marks, target)
        self.steps += 1
        m, v, at = self.m, self.v, 0
        g = np.concatenate([slopes[n].ravel() for n in self.model.w])
        m *= 0.9
        m += 0.1 * g
        g *= g
        g *= 0.01
        v *= 0.99
        v += g
        size = np.sqrt(np.divide(v, 1 - 0.99**self.steps, out=g), out=g)
        size += 1e-8
        move = np.divide(m, size, out=size)
        move *= rate / (1 - 0.9**self.steps)
        for p in self.model.w.values():
            p -= move[at : at + p.size].reshape(p.shape)
            at += p.size
        return loss


def sums_by(at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of each number below ``n``."""
    out = np.zeros((n, rows.shape[1]), rows.dtype)
    order = np.argsort(at.astype(np.uint16), kind="stable")
    counts = np.bincount(at, minlength=n)
    found = np.flatnonzero(counts)
    out[found] = np.add.reduceat(np.take(rows, order, axis=0), (np.cumsum(counts) - counts)[found], axis=0)
    return out


def count_pairs(last: np.ndarray, target: np.ndarray) -> np.ndarray:
    """How often each class follows each class or a start; ``target`` < 0 is padding."""
    used = target >= 0
    found = np.bincount(last[used] * CLASSES + target[used], minlength=(CLASSES + 1) * CLASSES)
    return found.reshape(CLASSES + 1, CLASSES)


def streams(ids: np.ndarray, bounds: np.ndarray, of_id: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts of a batch one after another: the classes read, the ids to predict, and the text of each place."""
    sizes = np.diff(bounds) + 1
    text = np.repeat(np.arange(len(sizes)), sizes)
    ends = np.cumsum(sizes) - 1
    to_come = np.full(int(sizes.sum()), END_ID, dtype=np.int64)
    inner = np.ones(len(to_come), dtype=bool)
    inner[ends] = False
    to_come[inner] = ids
    read = np.empty(len(to_come), dtype=np.int64)
    read[1:] = of_id[to_come[:-1]]
    read[ends + 1 - sizes] = START_CLASS
    return read, to_come, text


def windows(read: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes and texts of overlapping windows; text -1 stands before the first and after the last place."""
    n = -(-len(read) // STRIDE) * STRIDE
    back = CONTEXT - STRIDE
    keys, texts = np.zeros(back + n, dtype=read.dtype), np.full(back + n, -1)
    keys[back : back + len(read)], texts[back : back + len(read)] = read, text
    view = np.lib.stride_tricks.sliding_window_view
    return view(keys, CONTEXT)[::STRIDE], view(texts, CONTEXT)[::STRIDE]


def log_probabilities(t: dict, classes: Classes, ids: np.ndarray, bounds: np.ndarray, chunk: int = 1_024) -> np.ndarray:
    """Natural logarithm of the probability of each text of a batch.

    Places of a chunk are sorted by the group of their id, so that each group's classes are one small product.
    """
    read, to_come, text = streams(ids, bounds, classes.of_id)
    keys, texts = windows(read, text)
    mixed = texts[:, 0] != texts[:, -1]  # windows over more than one text, the only ones to be masked by text
    out = np.empty(len(read), dtype=np.float32)
    pair, width = t["pair"].ravel(), CLASSES + 1
    group, inner = (classes.of_id // GROUP).astype(np.uint8)[to_come], (classes.of_id % GROUP).astype(np.uint8)[to_come]
    for a in range(0, len(keys), chunk):
        k = np.ascontiguousarray(keys[a : a + chunk])
        q = np.ascontiguousarray(k[:, CONTEXT - STRIDE :])
        s = np.take(pair, q[:, :, None] * width + k[:, None, :])
        s *= t["place"]
        at = np.flatnonzero(mixed[a : a + chunk])
        if len(at):
            owner = texts[a + at]
            s[at] *= owner[:, CONTEXT - STRIDE :, None] == owner[:, None, :]
        h = s @ np.take(t["v"], k, axis=0)  # the last column of v is 1, so that of h is the sum of the weights
        h = h.reshape(-1, WIDTH + 1)
        lo, hi = a * STRIDE, min(len(read), a * STRIDE + len(h))
        n, last = hi - lo, q.reshape(-1)[: hi - lo]
        z = h[:n, :WIDTH] / h[:n, WIDTH:]
        z += np.take(t["e"], last, axis=0)
        inside = z @ t["a"]
        inside += t["b"]
        np.maximum(inside, 0, out=inside)
        z += inside @ t["c"]
        g = group[lo:hi]
        coarse = z @ t["gu"]
        coarse += np.take(t["gd"], last, axis=0)
        order = np.argsort(g, kind="stable")
        sorted_z, edges = np.take(z, order, axis=0), np.concatenate([[0], np.cumsum(np.bincount(g, minlength=GROUPS))]).tolist()
        fine = np.take(t["d"], (last * GROUPS + g)[order], axis=0)
        for one in range(GROUPS):
            fine[edges[one] : edges[one + 1]] += sorted_z[edges[one] : edges[one + 1]] @ t["u"][one]
        out[lo:hi] = log_chosen(coarse, g)
        out[lo:hi][order] += log_chosen(fine, inner[lo:hi][order])
    out += classes.within[to_come]
    return np.bincount(text, weights=out, minlength=len(bounds) - 1)


def log_chosen(logits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Logarithm of the probability of one entry of each row."""
    chosen = np.take(logits, np.arange(len(at)) * logits.shape[1] + at)
    total = np.exp(logits) @ np.ones(logits.shape[1], logits.dtype)
    if not (np.isfinite(total).all() and total.all()):  # out of range: again, relative to the largest
        top = logits.max(axis=1, keepdims=True)
        return chosen - top[:, 0] - np.log(np.exp(logits - top).sum(axis=1))
    return chosen - np.log(total)


def word_counts(docs: DataFrame, text: str = "text", hold: int = 1_000_000) -> DataFrame:
    """Rows (word, c) of all lower-cased words; tasks add up first, ``hold`` words at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, n = [], 0

        def added() -> pa.Table:
            return pa.concat_tables(kept).group_by("word", use_threads=False).aggregate([("c", "sum")])

        def rows() -> Iterator[pa.RecordBatch]:
            for part in added().to_batches():
                yield pa.RecordBatch.from_arrays([part.column("word").cast(pa.string()), part.column("c_sum")], names=["word", "c"])

        for batch in slices(batches, "text"):
            words = Words(pc.ascii_lower(batch.column("text")))
            counts = pa.array(np.bincount(words.index, minlength=len(words.names)))
            kept.append(pa.table([words.names, counts], names=["word", "c"]))
            n += len(counts)
            if n > hold:
                once = added()
                kept, n = [once.rename_columns({"c_sum": "c"})], once.num_rows
                if n > hold // 2:
                    yield from rows()
                    kept, n = [], 0
        if kept:
            yield from rows()
            kept = []
        pa.default_memory_pool().release_unused()  # the worker goes on with other steps

    counted = docs.select(as_text(text).alias("text")).mapInArrow(run, "word string, c bigint")
    return counted.where("c > 0").groupBy("word").agg(F.sum("c").alias("c"))


def stored_ids(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a batch of texts one after another, and where each text begins; they are stored in 16 bits."""
    cells = batch.column("ids").to_pylist()
    sizes = np.fromiter(map(len, cells), np.int64, len(cells)) // 2
    return np.frombuffer(b"".join(cells), "<u2").astype(np.int64), np.concatenate([[0], np.cumsum(sizes)])


def id_counts(train: DataFrame) -> np.ndarray:
    """How often every id of the vocabulary occurs; as many numbers as the vocabulary has ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(N_IDS, dtype=np.int64)
        for batch in slices(batches, "ids", 2_000_000):
            total += np.bincount(stored_ids(batch)[0], minlength=N_IDS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["id", "n"])

    out = np.zeros(N_IDS)
    found = train.select("ids").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
    for r in found.collect():
        out[r.id] = r.n
    return out


def pair_counts(train: DataFrame, classes: Classes) -> np.ndarray:
    """Class pairs of all training texts, starts and ends included; added up inside the tasks first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((CLASSES + 1) * CLASSES, dtype=np.int64)
        for batch in slices(batches, "ids", 2_000_000):
            read, to_come, _ = streams(*stored_ids(batch), classes.of_id)
            total += count_pairs(read, classes.of_id[to_come]).ravel()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["pair", "n"])

    out = np.zeros((CLASSES + 1) * CLASSES, dtype=np.int64)
    found = train.select("ids").mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    for r in found.collect():
        out[r.pair] = r.n
    return out.reshape(CLASSES + 1, CLASSES)


def training_windows(train: DataFrame, n_docs: int, classes: Classes) -> DataFrame:
    """All windows of the share of the training texts that the rounds begin with, as bytes: classes, marks of the texts, classes to predict."""
    million = 1_000_003
    share = max(1 / TRAIN_SHARE, min(1.0, LEAST_DOCS / max(n_docs, 1)))
    chosen = train.where(F.pmod(F.xxhash64("doc_id", "ids"), F.lit(million)) < F.lit(round(share * million)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "ids", 1_000_000):
            read, to_come, text = streams(*stored_ids(batch), classes.of_id)
            keys, texts = windows(read, text)
            target = np.full(len(keys) * STRIDE, -1)
            target[: len(read)] = classes.of_id[to_come]
            marks = np.clip(texts - texts[:, CONTEXT - STRIDE, None], -99, 99)
            rows = np.concatenate([keys, marks, target.reshape(-1, STRIDE)], axis=1).astype("<i2")
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in rows], pa.binary())], names=["row"])

    return chosen.select("ids").mapInArrow(run, "row binary")


def mean_weights(parts: DataFrame, n: int) -> np.ndarray | None:
    """The mean of trainers' weights by their windows; more than ``TOGETHER`` are added up in several steps."""
    def add(rows: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(b) for b in rows.column("weights").to_pylist())
        part = pa.array([rows.column("part")[0].as_py() // TOGETHER])
        windows = pa.array([sum(rows.column("windows").to_pylist())])
        return pa.table({"part": part, "windows": windows, "weights": pa.array([total.tobytes()], pa.binary())})

    while n > TOGETHER:
        parts = parts.groupBy(F.expr(f"part DIV {TOGETHER}")).applyInArrow(add, parts.schema)
        n = -(-n // TOGETHER)
    found = sorted(parts.collect(), key=lambda r: r.part)
    return sum(np.frombuffer(bytes(r.weights)) for r in found) / sum(r.windows for r in found) if found else None


def fit_attention(sample: DataFrame, log_share: np.ndarray, steps: int, pairs: np.ndarray) -> Attention:
    """The model after ``ROUNDS`` rounds, in each of which tasks train on windows of their own from common weights."""
    model = Attention(log_share)
    model.start_direct(pairs)
    n = sample.count()
    trainers = max(1, -(-n // (ROUNDS * TRAINER_WINDOWS)))
    dealt = sample.select(
        "row", F.pmod(F.xxhash64("row"), F.lit(ROUNDS)).alias("round"), F.pmod(F.xxhash64("row", F.lit(1)), F.lit(trainers)).alias("trainer")
    )

    def training(start: np.ndarray):
        def run(windows: pa.Table) -> pa.Table:
            rows = sorted(windows.column("row").to_pylist())
            table = np.frombuffer(b"".join(rows), "<i2").reshape(-1, 2 * CONTEXT + STRIDE).astype(np.int64)
            own = Attention(log_share)
            own.unpack(start)
            keys, marks, target = np.split(table, [CONTEXT, 2 * CONTEXT], axis=1)
            own.train(keys, marks, target, min(steps, max(LEAST_STEPS, -(-len(table) // BATCH))))
            packed = pa.array([own.packed(len(table)).tobytes()], pa.binary())
            part = pa.array([windows.column("trainer")[0].as_py()], pa.int64())
            return pa.table({"part": part, "windows": pa.array([len(table)]), "weights": packed})

        return run

    for turn in range(ROUNDS):
        part = dealt.where(F.col("round") == turn).groupBy("trainer")
        schema = "part bigint, windows bigint, weights binary"
        found = mean_weights(part.applyInArrow(training(model.packed()), schema), trainers)
        if found is not None:
            model.unpack(found)
    return model


def trained_on_all(train: DataFrame, model: Attention, classes: Classes) -> DataFrame:
    """Weights ``(part, windows, weights)`` of each task after one turn of all windows of its texts, from common ones.

    Each window is learnt from once. Windows are made from the stored ids slice by slice, in an order of their own.
    """
    start, log_share = train.sparkSession.sparkContext.broadcast(model.packed()), classes.log_share

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Attention(log_share)
        own.unpack(start.value)
        adam, rng, n = Adam(own), np.random.default_rng(3), 0
        for batch in slices(batches, "ids", 2_000_000):
            read, to_come, text = streams(*stored_ids(batch), classes.of_id)
            keys, texts = windows(read, text)
            target = np.full(len(keys) * STRIDE, -1)
            target[: len(read)] = classes.of_id[to_come]
            target = target.reshape(-1, STRIDE)
            for at in np.array_split(rng.permutation(len(keys)), -(-len(keys) // BATCH)):
                adam.step(keys[at], texts[at], target[at], LATE_RATE)
            n += len(keys)
        if n:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([TaskContext.get().partitionId()]), pa.array([n]),
                    pa.array([own.packed(n).tobytes()], pa.binary()),
                ],
                names=["part", "windows", "weights"],
            )

    return train.select("ids").mapInArrow(run, "part bigint, windows bigint, weights binary")


def learn_from_all(train: DataFrame, model: Attention, classes: Classes) -> Attention:
    """The model goes on over all windows of all training texts."""
    parts = written(trained_on_all(train, model, classes), "weights")
    top = parts.agg(F.max("part")).first()[0]
    if top is not None:
        model.unpack(mean_weights(parts, top + 1))
    return model


ENCODED = "uid bigint, doc_id {kind}, held_out boolean, n_tokens bigint, n_often bigint, often_score double"


def encode_texts(rows: DataFrame, known, n_train: int, divisor: float, kind: str, vocabulary: str | None) -> DataFrame:
    """Each text's ids, the base score of its frequent words (``known``, a broadcast) and end, and its other words."""
    end_score = float(np.log10((n_train + 0.5) / divisor))
    end_known = int(n_train > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, uid, often = word_ids(vocabulary), TaskContext.get().partitionId() << 33, known.value
        for batch in slices(batches, "text", 2_000_000):
            texts = pc.ascii_lower(batch.column("text"))
            words = Words(texts)
            value = np.array(list(map(often.get, words.distinct)), dtype=float)  # nan where it is None
            each = value[words.index]
            rare = np.isnan(each)
            upto = np.concatenate([[0], np.cumsum(np.where(rare, 0, each))])
            n_often = np.diff(np.concatenate([[0], np.cumsum(~rare)])[words.bounds])
            place = np.concatenate([[0], np.cumsum(rare)])[words.bounds]
            names = words.names.take(pa.array(words.index[rare])).cast(pa.string())
            ids, bounds = encoder.of_texts(texts, words)
            data = ids.astype("<u2").tobytes()
            cells = [data[a:b] for a, b in zip((2 * bounds[:-1]).tolist(), (2 * bounds[1:]).tolist())]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(uid + np.arange(batch.num_rows)), batch.column("key"), batch.column("held_out"),
                    pa.array(np.diff(words.bounds) + 1), pa.array(n_often + end_known),
                    pa.array(np.diff(upto[words.bounds]) + end_score),
                    pa.ListArray.from_arrays(pa.array(place, pa.int32()), names), pa.array(cells, pa.binary()),
                ],
                names=["uid", "doc_id", "held_out", "n_tokens", "n_often", "often_score", "rare", "ids"],
            )
            uid += batch.num_rows

    return rows.mapInArrow(run, ENCODED.format(kind=kind) + ", rare array<string>, ids binary")


def score_texts(
    docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None, steps: int = STEPS,
    frequent_words: int = FREQUENT_WORDS,
) -> DataFrame:
    """Rows (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one for each document."""
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), as_text(text).alias("text"), held_out(key).alias("held_out"))
    train = rows.where(~F.col("held_out"))
    n_train = train.select("key").count()
    counts = written(word_counts(train), "word-counts")
    totals = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    n, v = (totals.n or 0) + n_train, totals.v + (n_train > 0)
    divisor = n + 0.5 * (v + 1)

    # words counted 2**b times and more, b the least with which they stay within the bound
    sizes = counts.groupBy(F.floor(F.log2("c")).alias("b")).count().orderBy(F.desc("b")).collect()
    total, least = 0, None
    for r in sizes:
        if total + r["count"] > frequent_words:
            break
        total, least = total + r["count"], 2**r.b
    often = counts.where(F.col("c") >= least).collect() if least else []
    known = spark.sparkContext.broadcast({r.word: float(np.log10((r.c + 0.5) / divisor)) for r in often})
    encoded = written(encode_texts(rows, known, n_train, divisor, kind, vocabulary), "encoded")

    learnt = encoded.where(~F.col("held_out")).select("doc_id", "ids")
    per_id = id_counts(learnt)
    per_id[END_ID] += n_train
    classes = Classes.from_counts(per_id)
    sample = written(training_windows(learnt, n_train, classes), "windows")
    model = fit_attention(sample, classes.log_share, steps, pair_counts(learnt, classes))
    model = learn_from_all(learnt, model, classes)
    shared = spark.sparkContext.broadcast((model.tables(), classes))
    through = ["uid", "doc_id", "held_out", "n_tokens", "n_often", "often_score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, groups = shared.value
        for batch in slices(batches, "ids", 2_000_000):
            scores = log_probabilities(tables, groups, *stored_ids(batch)) / np.log(10)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in through), pa.array(scores)], names=[*through, "score"]
            )

    scored = encoded.select(*through, "ids").mapInArrow(run, ENCODED.format(kind=kind) + ", score double")
    rest = (
        encoded.select("uid", F.explode("rare").alias("word"))
        .join(counts, "word", "left")
        .groupBy("uid")
        .agg(
            F.sum(F.log10((F.coalesce("c", F.lit(0)) + 0.5) / F.lit(divisor))).alias("rare_score"),
            F.count("c").alias("n_rare"),
        )
    )
    return scored.join(rest, "uid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_often") + F.coalesce("n_rare", F.lit(0))).alias("n_known"),
        F.lit(int(n)).cast("bigint").alias("train_tokens"),
        (F.col("often_score") + F.coalesce("rare_score", F.lit(0.0))).alias("base_score"), "score",
    )
