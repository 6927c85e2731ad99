"""Personal data found by weak supervision.

Base patterns give spans that always stay. Wider patterns propose candidates; labelers of three sorts (regular
expressions, gazetteers, context words) vote on each candidate for, against or not at all. Expectation-maximisation
over the counts of vote patterns estimates each labeler's reliability without any labels, and a logistic span
classifier is trained on the resulting probabilities from features that also see what no labeler votes on. Candidates
that it accepts, and that overlap no base span, are added. Vote and feature patterns are counted where the rows are, so
only a table bounded by their number of combinations reaches the driver.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import steady

KINDS = ("email", "ip", "card", "phone", "id", "account")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: Candidates beyond the base patterns: kind and pattern. Each is anchored on a letter or digit that can't extend it to the left.
WIDER = (
    ("email", re.compile(r"(?<![\w.+-])[A-Za-z0-9_+-]{1,64}(?:\.[A-Za-z0-9_+-]{1,64}){0,4} ?(?:\[at\]|\(at\)|\{at\}| at ) ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|\[dot\]|\(dot\)|\{dot\}| dot ) ?[A-Za-z0-9-]{2,63}){1,4}(?![\w-])")),
    ("phone", re.compile(r"(?<![\w+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![\w-])")),
    ("id", re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])")),
    ("account", re.compile(r"(?<![\w-])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\w-])")),
)
#: Without one of these a text has no candidate.
NUMBERS = re.compile(r"[0-9]{3}|[A-Z]{2}[0-9]{2}")
SPELLED = re.compile(r"[\[({]at[\])}]| dot ")
#: Gazetteers and context words.
ENDINGS = frozenset("com org net edu gov io info biz de fr es uk eu us co".split())
AREAS = frozenset(f"{a}{b}{c}" for a in "23456789" for b in "012345678" for c in "0123456789")
COUNTRIES = frozenset("AT BE CH CZ DE DK ES FI FR GB GR HU IE IT LU NL NO PL PT RO SE SI SK".split())
WORDS = {
    "email": re.compile(r"e-?mail|contact|write|reach|mail to|courriel|correo", re.I),
    "phone": re.compile(r"phone|call|tel|fax|mobile|reach|dial|whatsapp|anruf|appel|llam", re.I),
    "id": re.compile(r"ssn|social security|security number|tax id|taxpayer", re.I),
    "account": re.compile(r"iban|account|bank|konto|compte|cuenta", re.I),
}
AGAINST = re.compile(r"invoice|order|version|isbn|item|part no|serial|ticket|page|figure|table", re.I)
AROUND = 40
#: Votes: pattern check, gazetteer, context before, context after, against.
LABELERS, FEATURES = 5, 5 + len(KINDS) + 3


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base spans, in order. Linear in the text: no run is scanned again from a later start."""
    out, past, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > past and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, 0, m.end()))
            past = m.end()
        at = text.find("@", max(past, at + 1))
    for m in DOTTED.finditer(text):
        parts, here = m[0].split("."), m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = here + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in four):
                out.append((here, 1, end))
            here = end + 1
    for m in DIGITS.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= sum(map(str.isdigit, m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    out.sort()
    return out


def candidates(text: str) -> list[tuple[int, int, int, tuple[int, ...]]]:
    """(start, kind, end, features) of the wider patterns' matches. The first five features are votes (1, 0, -1)."""
    out = []
    if not NUMBERS.search(text) and not ("at" in text and SPELLED.search(text)):
        return out
    for name, pattern in WIDER:
        if name == "email" and not SPELLED.search(text):
            continue
        for m in pattern.finditer(text):
            got, before, after = m[0], text[max(0, m.start() - AROUND) : m.start()], text[m.end() : m.end() + AROUND]
            digits = re.sub(r"[^0-9]", "", got)
            if name == "email":
                if not SPELLED.search(got):
                    continue  # "at" between words of a sentence
                check = 1 if re.search(r"[\[({]at[\])}]", got) else 0
                known = 1 if re.split(r"[^A-Za-z]+", got)[-1].lower() in ENDINGS else -1
            elif name == "phone":
                check = -1 if len(set(digits)) < 3 else 1 if got[0] == "(" else 0
                known = 1 if digits[:3] in AREAS else -1
            elif name == "id":
                check = -1 if digits[:3] in ("000", "666") or digits[0] == "9" or digits[3:5] == "00" or digits[5:] == "0000" else 1
                known = 0
            else:
                flat = got.replace(" ", "")
                moved = "".join(str(int(c, 36)) for c in flat[4:] + flat[:4])
                check = 1 if int(moved) % 97 == 1 else -1
                known = 1 if flat[:2] in COUNTRIES else -1
            votes = (check, known, 1 if WORDS[name].search(before) else 0, 1 if WORDS[name].search(after) else 0, -1 if AGAINST.search(before) else 0)
            kind = KINDS.index(name)
            more = (int(before[-1:] in ":=<"), int("\n" in before[-2:] or not before), int(len(digits) > 9))
            out.append((m.start(), kind, m.end(), votes + tuple(int(k == kind) for k in range(len(KINDS))) + more))
    return out


def _patterns(batches):
    counts: dict[tuple, int] = {}
    for batch in batches:
        for text in batch.column(0):
            for c in candidates(text.as_py() or ""):
                counts[c[3]] = counts.get(c[3], 0) + 1
    yield pa.RecordBatch.from_arrays([pa.array([list(k) for k in counts], pa.list_(pa.int32())), pa.array(list(counts.values()), pa.int64())], ["features", "n"])


def reliabilities(votes: np.ndarray, n: np.ndarray, steps: int = 100) -> tuple[np.ndarray, float, np.ndarray]:
    """EM for votes (patterns by labelers, 1, 0, -1) seen n times, under conditional independence.

    Returns P(vote | truth) as (labelers, 2, 3), the share of true spans, and P(true) of each pattern. Starts from
    labelers that are right four times in five; a few pseudo-counts keep that sense where there are few candidates.
    """
    m = votes.shape[1]
    prior = np.tile(np.array([[0.3, 0.6, 0.1], [0.1, 0.6, 0.3]]), (m, 1, 1))
    given, share = prior.copy(), 0.5
    which = votes + 1
    for _ in range(steps):
        log = np.log(given)
        like = np.stack([sum(log[j, t, which[:, j]] for j in range(m)) for t in (0, 1)], 1) + np.log([1 - share, share])
        true = 1 / (1 + np.exp(np.clip(like[:, 0] - like[:, 1], -50, 50)))
        share = float(np.clip((n @ true + 5) / (n.sum() + 10), 0.02, 0.98))
        for j in range(m):
            for v in range(3):
                on = which[:, j] == v
                given[j, 1, v], given[j, 0, v] = n[on] @ true[on], n[on] @ (1 - true[on])
            given[j] += 10 * prior[j]
            given[j] /= given[j].sum(1, keepdims=True)
    return given, share, true


def classifier(x: np.ndarray, n: np.ndarray, target: np.ndarray, steps: int = 50) -> np.ndarray:
    """Weights (last one constant) of a logistic regression on probabilistic labels, by damped Newton steps."""
    x = np.concatenate([x, np.ones((len(x), 1))], 1).astype(np.float64)
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        h = (x * (n * p * (1 - p))[:, None]).T @ x + np.eye(len(w))
        w = w + np.clip(np.linalg.solve(h, x.T @ (n * (target - p)) - w), -2, 2)
    return w


def _found(weights: np.ndarray | None, cut: float):
    def run(batches):
        for batch in batches:
            counts = np.zeros((len(batch), len(KINDS)), np.int64)
            base, spans = [], []
            for i, text in enumerate(batch.column(1)):
                text = text.as_py() or ""
                own = base_spans(text)
                for s in own:
                    counts[i, s[1]] += 1
                more, added = candidates(text) if weights is not None else (), []
                if more:
                    score = np.array([m[3] for m in more]) @ weights[:-1] + weights[-1]
                    for (start, kind, end, _), z in zip(more, score.tolist(), strict=True):
                        if 1 / (1 + np.exp(-z)) >= cut and not any(start < e and s < end for s, _, e in own) and not any(start < e and s < end for s, _, e in added):
                            added.append((start, kind, end))
                write = lambda found: ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found)
                base.append(hashlib.sha256(write(own).encode()).hexdigest())
                spans.append(write(sorted(own + added)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(counts[:, k]) for k in range(4)), pa.array(base), pa.array(spans)], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return run


def find_personal_data(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", cut: float = 0.5) -> DataFrame:
    """Returns a row for each row of docs: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans.

    spans lists all spans, kind:start:end by start and comma-joined, in code points with the end exclusive; base_sha256 is
    the digest of the base ones written so. Kinds beyond the base ones are id (national numbers) and account. A null text
    counts as empty and has none. Ids may be null or repeat; every row has its result. Other columns are ignored. Without any
    candidate in the table nothing is trained or added. Rows are not shuffled.
    """
    steady(docs.sparkSession)
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    seen = rows.select("text").mapInArrow(_patterns, "features array<int>, n long").groupBy("features").agg(F.sum("n").alias("n")).orderBy("features").collect()
    weights = None
    if seen:
        x, n = np.array([r.features for r in seen]), np.array([r.n for r in seen], float)
        weights = classifier(x, n, reliabilities(x[:, :LABELERS], n)[2])
    return rows.mapInArrow(_found(weights, cut), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
