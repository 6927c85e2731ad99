"""Document quality from a linear-chain conditional random field over lines.

Every non-empty line is good or bad. The field's states see the line's own features, those of the lines before and
after it, and the state before. It is fitted to labelled documents, whose lines first take the document's label; then
lines of bad documents that look good are relabelled and the field is fitted again. A document's quality is the mean of
the forward-backward marginals of its lines, weighted by their lengths, put on the scale of the labels by a logistic
curve. Only the text of a document enters its score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T
from .shared import steady

U = np.uint64
BREAK = np.arange(256) == 10
#: Classes of bytes: 0 lower-case letter or part of a longer character, 1 upper case, 2 digit, 3 space, 4 sentence marks, 5 bars, 6 exclamation, 7 other symbols.
KIND = np.full(256, 7, np.uint8)
KIND[97:123] = KIND[128:] = 0
KIND[65:91], KIND[48:58], KIND[[9, 11, 12, 13, 32]], KIND[[ord(c) for c in ".,;:'\"()-?/"]], KIND[ord("|")], KIND[ord("!")] = 1, 2, 3, 4, 5, 6
FEATURES = 14


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of each non-empty line of some texts, their lengths in bytes, and where each text's lines begin."""
    starts, ends = T.cut(data, offsets, BREAK)
    begin = np.searchsorted(starts, offsets)
    length = (ends - starts).astype(np.float64)
    if not len(starts):
        return np.zeros((0, FEATURES)), length, begin
    kind = KIND[data]
    counts = []
    for k in range(8):
        total = np.zeros(len(data) + 1, np.int32)
        np.cumsum(kind == k, out=total[1:])
        counts.append((total[ends] - total[starts]).astype(np.float64))
    lower, upper, digit, space, mark, bar, loud, symbol = counts
    low = T.LOWER[data]
    first, last = T.cut(low, offsets, T.SPACE)
    hashed = T.hashes(low, first, last)
    line = np.searchsorted(starts, first, "right") - 1
    per = lambda w: np.bincount(line, w, len(starts))
    words = np.maximum(np.bincount(line, minlength=len(starts)), 1).astype(np.float64)
    again = np.zeros(len(hashed), bool)
    again[1:] = (hashed[1:] == hashed[:-1]) & (line[1:] == line[:-1])
    known = np.ones(len(hashed), bool)
    text = np.searchsorted(offsets, first, "right")
    with np.errstate(over="ignore"):
        before = np.roll(T.mix(hashed + U(1)), 1)
        before[:1], before[1:][text[1:] != text[:-1]] = 0, 0  # a text's first word follows no other text's last one
        pair = T.mix(hashed ^ before ^ (text.astype(U) * U(0x9E3779B97F4A7C15)))
    known[np.unique(pair, return_index=True)[1]] = False
    solid = np.maximum(length - space, 1)
    tail = kind[ends - 1]
    x = np.stack([
        np.log1p(length), (length - space) / words, per(last - first <= 3) / words, upper / np.maximum(upper + lower, 1), digit / solid, mark / solid,
        bar / words, loud / words, symbol / solid, per(again) / words, per(known) / words, (tail == 4).astype(np.float64),
        per(kind[last - 1] >= 6) / words, np.log1p(words),
    ], 1)
    return x, length, begin


class Field:
    """The fitted field. Weights are of the score of good against bad."""

    def __init__(self, x: np.ndarray):
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        self.cuts = np.quantile(x, [0.1, 0.35, 0.65, 0.9], 0)
        self.w, self.move = None, np.zeros((2, 2))
        self.curve = (1.0, 0.0)

    def seen(self, x: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """What the states of each line see: its own features as values and steps, and its neighbours' values."""
        z = np.clip((x - self.mean) / self.scale, -4, 4)
        before, after = np.zeros_like(z), np.zeros_like(z)
        before[1:], after[:-1] = z[:-1], z[1:]
        full = begin[:-1][np.diff(begin) > 0]
        edge = np.zeros((len(z), 2))
        edge[full, 0] = 1
        edge[np.append(full[1:], len(z)) - 1 if len(full) else [], 1] = 1
        before[edge[:, 0] > 0], after[edge[:, 1] > 0] = 0, 0
        return np.concatenate([z, before, after, edge, np.ones((len(z), 1)), *(x > c for c in self.cuts)], 1)

    def marginals(self, score: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """P(good) of each line, expected moves between states of each text, and each text's log partition sum.

        Forward-backward over all texts at once; texts leave as their lines end, so the work is in all lines.
        """
        n = np.diff(begin)
        order = np.argsort(-n, kind="stable")
        n, at = n[order], begin[:-1][order]
        alive = np.searchsorted(-n, -np.arange(1, (n[0] if len(n) else 0) + 1), "right")
        e = np.stack([np.zeros(len(score)), score], 1)
        forward, scale = np.zeros((len(score), 2)), np.zeros(len(score))
        m = self.move
        for t, k in enumerate(alive):
            i = at[:k] + t
            a = e[i] if t == 0 else np.logaddexp(forward[i - 1, :1] + m[0], forward[i - 1, 1:] + m[1]) + e[i]
            scale[i] = np.logaddexp(a[:, 0], a[:, 1])
            forward[i] = a - scale[i][:, None]
        back = np.zeros((len(score), 2))
        moves = np.zeros((len(n), 2, 2))
        for t in range(len(alive) - 2, -1, -1):
            k = alive[t + 1]
            i = at[:k] + t
            ahead = e[i + 1] + back[i + 1]
            back[i] = np.logaddexp(ahead[:, :1] + m[:, 0], ahead[:, 1:] + m[:, 1])
            joint = forward[i][:, :, None] + m[None] + ahead[:, None, :]
            joint -= joint.max((1, 2), keepdims=True)
            joint = np.exp(joint)
            moves[:k] += joint / joint.sum((1, 2), keepdims=True)
            back[i] -= back[i].max(1, keepdims=True)
        both = forward + back
        good = 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -60, 60)))
        total = np.add.reduceat(np.append(scale, 0.0), np.minimum(begin[:-1], len(scale))) * (np.diff(begin) > 0)
        return good, moves, total

    def fit(self, seen: np.ndarray, begin: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int, ridge: float = 3.0) -> None:
        """Gradient steps (Adam) on the penalised likelihood; weight is for each text."""
        per_line = np.repeat(weight, np.diff(begin))
        inner = np.ones(len(y), bool)
        inner[begin[:-1][np.diff(begin) > 0]] = False
        now = np.flatnonzero(inner)
        held = np.zeros((2, 2))
        np.add.at(held, (y[now - 1], y[now]), per_line[now])
        order = np.argsort(-np.diff(begin), kind="stable")
        w = np.zeros(seen.shape[1]) if self.w is None else self.w
        theta = np.concatenate([w, self.move.reshape(-1)])
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        size = weight.sum()
        for k in range(1, steps + 1):
            self.w, self.move = theta[:-4], theta[-4:].reshape(2, 2)
            good, moves, _ = self.marginals(seen @ self.w, begin)
            g = np.concatenate([seen.T @ ((y - good) * per_line), (held - (moves * weight[order][:, None, None]).sum(0)).reshape(-1)]) - ridge * theta
            g /= size
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            theta = theta + 0.15 * (1 - k / (steps + 1)) * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-9)
        self.w, self.move = theta[:-4], theta[-4:].reshape(2, 2)

    def share(self, x: np.ndarray, length: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Length-weighted mean marginal of each text (0 without lines), and P(good) of each line.

        Every sum is over one line's or one text's own values in their order, so a text's share is the same in any batch.
        """
        good = self.marginals(np.einsum("ij,j->i", self.seen(x, begin), self.w), begin)[0] if len(x) else np.zeros(0)
        return _per_text(good * length, begin) / np.maximum(_per_text(length, begin), 1), good

    def score(self, share: np.ndarray) -> np.ndarray:
        a, b = self.curve
        s = np.clip(share, 1e-4, 1 - 1e-4)
        return 1 / (1 + np.exp(-(a * np.log(s / (1 - s)) + b)))


def _per_text(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The sum of each text's values, 0 for a text without any."""
    return np.add.reduceat(np.append(values, 0.0), np.minimum(begin[:-1], len(values))) * (np.diff(begin) > 0)


def train(docs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, steps: int) -> Field:
    """docs: features and lengths of each document's lines."""
    x = np.concatenate([d[0] for d in docs])
    length = np.concatenate([d[1] for d in docs])
    begin = np.concatenate([[0], np.cumsum([len(d[0]) for d in docs])])
    field = Field(x)
    seen = field.seen(x, begin)
    weight = np.where(labels == 1, 0.5 / max(labels.mean(), 1e-3), 0.5 / max(1 - labels.mean(), 1e-3))
    weight = weight / np.sqrt(np.maximum(np.diff(begin), 1))
    y = np.repeat(labels, np.diff(begin))
    field.fit(seen, begin, y, weight, steps)
    good = 1 / (1 + np.exp(-np.clip(seen @ field.w, -60, 60)))  # by the line alone
    worst = np.minimum.reduceat(good, begin[:-1])
    y = np.where((y == 0) & (good > 0.8) & (good > np.repeat(worst, np.diff(begin))), 1, y)
    field.fit(seen, begin, y, weight, steps // 2)
    share = np.clip(field.share(x, length, begin)[0], 1e-4, 1 - 1e-4)
    u = np.log(share / (1 - share))
    a, b = 1.0, 0.0
    for _ in range(50):  # a logistic curve, slightly damped
        p = 1 / (1 + np.exp(-np.clip(a * u + b, -60, 60)))
        r, h = labels - p, p * (1 - p) + 1e-6
        d = np.linalg.solve(np.array([[(h * u * u).sum() + 1e-2, (h * u).sum()], [(h * u).sum(), h.sum() + 1e-2]]), np.array([(r * u).sum() - 1e-2 * (a - 1), r.sum()]))
        a, b = a + np.clip(d[0], -1, 1), b + np.clip(d[1], -1, 1)
    field.curve = (max(float(a), 0.05), float(b))
    return field


def _featured(most: int):
    def run(batches):
        for batch in batches:
            flat, lens, quality = [], [], []
            at = batch.column(1).to_pylist()
            for first, last, data, offsets in T.slices(batch.column(0)):
                x, length, begin = line_features(data, offsets)
                for i in range(last - first):
                    if 0 < begin[i + 1] - begin[i] <= most:
                        flat.append(x[begin[i] : begin[i + 1]].astype(np.float64).tobytes())
                        lens.append(length[begin[i] : begin[i + 1]].tobytes())
                        quality.append(at[first + i])
            yield pa.RecordBatch.from_arrays([pa.array(flat, pa.binary()), pa.array(lens, pa.binary()), pa.array(quality, pa.int32())], ["x", "length", "quality"])

    return run


def _scored(field: Field):
    def run(batches):
        for batch in batches:
            share, lines, bad = [], [], []
            for _, _, data, offsets in T.slices(batch.column(0).field("text").cast(pa.string()), 1 << 19):
                x, length, begin = line_features(data, offsets)
                s, good = field.share(x, length, begin)
                share.append(s)
                lines.append(np.diff(begin))
                bad.append(np.diff(np.concatenate([[0], np.cumsum(good < 0.5)])[begin]))
            share, lines, bad = (np.concatenate(v) if v else np.zeros(0) for v in (share, lines, bad))
            score = np.where(lines > 0, np.round(field.score(share), 9), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64()), pa.array(lines.astype(np.int64)), pa.array(bad.astype(np.int64))], ["row", "score", "n_lines", "n_bad_lines"])

    return run


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = 3000, most_lines: int = 500, steps: int = 60, all_lines: int = 200_000) -> Field | None:
    """Fits the field to at most `sample` labelled documents, chosen by a hash of their ids among those whose crc32(id)
    mod 5 is not 0. Documents of over `most_lines` lines, and those that follow once the sample has `all_lines` lines, are scored but not learned from.
    None if there is no label of either kind.

    labels: doc_id, quality (0 or 1); other values, nulls and ids labelled both ways are not used.
    """
    steady(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)")
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).where("quality = other").select("doc_id", "quality")
    known = known.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # At most `sample` rows of two numbers are broadcast, and as many feature rows come back.
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(known), "doc_id")
    rows = own.select("text", "quality").mapInArrow(_featured(most_lines), "x binary, length binary, quality int").orderBy(F.md5("x")).limit(sample).collect()
    lines = np.cumsum([len(r.length) // 8 for r in rows])
    rows = [r for r, n in zip(rows, lines.tolist(), strict=True) if n <= all_lines]
    y = np.array([r.quality for r in rows], np.int64)
    if len(set(y.tolist())) < 2:
        return None
    return train([(np.frombuffer(r.x).reshape(-1, FEATURES), np.frombuffer(r.length)) for r in rows], y, steps)


def score_quality(docs: DataFrame, field: Field | None, cut: float = 0.3) -> DataFrame:
    """Adds score, predicted (1 if score >= cut), n_lines and n_bad_lines to docs (doc_id, text and any other columns).

    A null or empty text, or one of line breaks only, has no lines and scores 0. Without a field (no labels to learn
    from) every text with a line scores 0.5. Repeated rows score alike. Columns of docs by these four names are replaced.
    """
    steady(docs.sparkSession)
    docs = docs.drop("score", "predicted", "n_lines", "n_bad_lines")
    if field is None:
        lines = F.coalesce(F.regexp_count(F.col("text"), F.lit("[^\n]+")).cast("long"), F.lit(0).cast("long"))
        return docs.withColumns({"n_lines": lines, "score": F.when(lines > 0, 0.5).otherwise(0.0), "predicted": F.when(lines > 0, F.lit(int(cut <= 0.5))).otherwise(0), "n_bad_lines": F.lit(0).cast("long")})
    kept = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    kind = docs.select(kept.alias("row")).schema["row"].dataType.simpleString()
    scored = docs.select(kept.alias("row")).mapInArrow(_scored(field), f"row {kind}, score double, n_lines long, n_bad_lines long")
    return scored.select("row.*", "score", F.when(F.col("score") >= cut, 1).otherwise(0).alias("predicted"), "n_lines", "n_bad_lines")


def line_quality(docs: DataFrame, labels: DataFrame, cut: float = 0.3, **fit) -> DataFrame:
    """Returns a row for each row of docs: doc_id, held_out (crc32(id) mod 5 is 0; false for a null id), score, predicted, n_lines, n_bad_lines."""
    field = fit_quality(docs, labels, **fit)
    out = score_quality(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), field, cut)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", "predicted", "n_lines", "n_bad_lines")
