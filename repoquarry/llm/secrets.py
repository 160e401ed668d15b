"""Secret scans: fixed patterns, and a character convolutional network over every further candidate.

The network sees a candidate with the text around it. It is trained in numpy on a sample of labelled
findings: what the patterns accept are positives; addresses, dates and ordinary words are negatives;
other candidates have no label. All labelled findings that it was not trained on are scored; their
histogram gives the calibration and the threshold, which excludes nearly all negatives but never goes
above the one that still reaches the wanted recall. Findings of the patterns always stay; the network adds spans.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repoquarry.llm.sums import summed
from repoquarry.sources.shared import materialize

KINDS = ("assign", "access", "hex", "network")
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_LEAST_VALUE, _LEAST_ACCESS = 12, 18
# Further candidates: runs of such characters with a digit among them.
_RUN = re.compile(r"[A-Za-z0-9+/_=.@-]{12,}")
_LONG_WORD = re.compile(r"[^\s\d]{12,}")
# Candidates that are known to be something else: mail and IP addresses, dates, names and pages of hosts in plain words.
_HOST = r"(?:[a-z]+(?:-[a-z]+)*\d{0,4}\.)+[a-z]{2,}"
_KNOWN = re.compile(
    rf"(?:[a-z]+(?:[._-][a-z]+)*[._-]?\d{{0,4}}@{_HOST}|\d{{1,3}}(?:\.\d{{1,3}}){{3}}|\d{{4}}[-/.]\d\d[-/.]\d\d(?:T\d\d)?"
    rf"|(?://)?{_HOST}(?:/(?:[a-z]+(?:[._-][a-z]+)*(?:[._-]?\d{{1,4}})?|\d{{1,4}}))*/?)[.=-]*",
    re.A,
)
# What the network sees: text before, beginning and end of the candidate, text after. Longer candidates are
# also seen piece by piece, pieces beginning so many characters apart.
BEFORE, HEAD, TAIL, AFTER = 24, 32, 16, 24
WINDOW = BEFORE + HEAD + TAIL + AFTER
STEP = 24
_OTHER, _NOTHING, _SYMBOLS = 128, 129, 130
# Findings the network is trained on at most, of either label; a fifth of all, by hash, is never trained on.
MOST_FINDINGS = 4000
HELD_OUT = 5
# Scores are counted in so many steps a unit, up to this size.
_FINE, _LARGEST = 64, 64
RECALL = 0.98
# Share of held-back negatives that the threshold must exclude where the recall allows it.
QUIET = 0.999
_EMBEDDING, _KERNEL, _FILTERS = 12, 5, 24
_SEED = 5


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the patterns' findings, leftmost and non-overlapping per kind."""
    out = [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if len(m[2]) >= _LEAST_VALUE]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text) if m.end() - m.start() >= _LEAST_ACCESS]
    # A run of 16 or more is the whole run, as shorter ones are dropped anyway.
    out += [(m.start(), m.end(), 2) for m in _HEX.finditer(text)]
    return sorted(out)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Runs with a digit, and values too short for the patterns, that touch no finding of the patterns."""
    found = [m.span() for m in _RUN.finditer(text) if not m[0].isalpha() and any(map(str.isdigit, m[0]))]
    found += [m.span(2) for m in _ASSIGN.finditer(text) if 6 <= len(m[2]) < _LEAST_VALUE]
    out: list[tuple[int, int]] = []
    taken = iter([*base, (len(text) + 1, len(text) + 1, 0)])
    start, end, _ = next(taken)
    for a, b in sorted(found):
        while end <= a and start <= len(text):
            start, end, _ = next(taken)
        if b > start or (out and a < out[-1][1]):
            continue
        out.append((a, b))
    return out


def _part(text: str) -> bytes:
    return bytes(c if (c := ord(x)) < 128 else _OTHER for x in text)


def window(text: str, start: int, end: int) -> bytes:
    """The fixed number of symbols the network sees of a candidate and its surroundings."""
    blank = bytes([_NOTHING])
    body = _part(text[start : min(end, start + HEAD)])
    tail = _part(text[max(start + HEAD, end - TAIL) : end])
    return (
        _part(text[max(0, start - BEFORE) : start]).rjust(BEFORE, blank)
        + body.ljust(HEAD, blank)
        + tail.rjust(TAIL, blank)
        + _part(text[end : end + AFTER]).ljust(AFTER, blank)
    )


def views(text: str, start: int, end: int) -> list[bytes]:
    """The windows of a candidate: the whole, and pieces that together show each character of a longer one."""
    wide = HEAD + TAIL
    # The last piece ends with the candidate: shorter ones would be shown with a gap.
    pieces = [min(a, end - wide) for a in range(start, end - wide + STEP, STEP)] if end - start > wide else []
    return [window(text, start, end), *(window(text, a, a + wide) for a in pieces)]


class Network:
    """Embedding, one convolution with ReLU, maxima over the parts of the window, logistic output."""

    parts = ((0, BEFORE), (BEFORE, BEFORE + HEAD + TAIL), (BEFORE + HEAD + TAIL, WINDOW - _KERNEL + 1))

    def __init__(self) -> None:
        draw = np.random.default_rng(_SEED)
        wide = _KERNEL * _EMBEDDING
        self.weights = [
            draw.standard_normal((_SYMBOLS, _EMBEDDING)) * 0.5,
            draw.standard_normal((wide, _FILTERS)) * np.sqrt(2 / wide),
            np.zeros(_FILTERS),
            draw.standard_normal(len(self.parts) * _FILTERS) * 0.1,
            np.zeros(1),
        ]

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, tuple]:
        embedding, kernel, shift, out, bias = self.weights
        places = WINDOW - _KERNEL + 1
        seen = embedding[x]
        columns = np.concatenate([seen[:, k : k + places] for k in range(_KERNEL)], axis=2)
        response = np.maximum(columns @ kernel + shift, 0)
        best = [a + response[:, a:b].argmax(axis=1) for a, b in self.parts]
        pooled = np.concatenate([np.take_along_axis(response, i[:, None], 1)[:, 0] for i in best], axis=1)
        return pooled @ out + bias[0], (columns, best, pooled)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self.forward(x[i : i + 512])[0] for i in range(0, len(x), 512)] or [np.zeros(0)])

    def scores(self, seen: list[bytes]) -> np.ndarray:
        """The highest logit of each candidate's windows, which are joined."""
        sizes = np.array([len(w) // WINDOW for w in seen])
        x = np.frombuffer(b"".join(seen), dtype=np.uint8).reshape(-1, WINDOW)
        return np.maximum.reduceat(self.logits(x), np.cumsum(sizes) - sizes) if len(seen) else np.zeros(0)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        logit, (columns, best, pooled) = self.forward(x)
        embedding, kernel, _, out, _ = self.weights
        slope = (1 / (1 + np.exp(-np.clip(logit, -50, 50))) - y) / len(y)
        down = slope[:, None] * out * (pooled > 0)
        d_kernel, d_shift, d_embedding = np.zeros_like(kernel), np.zeros(_FILTERS), np.zeros_like(embedding)
        rows = np.arange(len(x))[:, None]
        for p, places in enumerate(best):
            part = down[:, p * _FILTERS : (p + 1) * _FILTERS]
            used = columns[rows, places]
            d_kernel += np.einsum("nfw,nf->wf", used, part)
            d_shift += part.sum(axis=0)
            back = part[:, :, None] * kernel.T[None]
            symbols = x[rows[:, :, None], places[:, :, None] + np.arange(_KERNEL)]
            np.add.at(d_embedding, symbols, back.reshape(*symbols.shape, _EMBEDDING))
        return [d_embedding, d_kernel, d_shift, pooled.T @ slope, np.array([slope.sum()])]

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 6, rate: float = 0.005) -> None:
        draw = np.random.default_rng(_SEED + 1)
        moments = [[np.zeros_like(w), np.zeros_like(w)] for w in self.weights]
        step = 0
        for _ in range(epochs):
            order = draw.permutation(len(x))
            for i in range(0, len(x), 128):
                step += 1
                batch = order[i : i + 128]
                for w, g, m in zip(self.weights, self.gradients(x[batch], y[batch]), moments):
                    m[0] = 0.9 * m[0] + 0.1 * g
                    m[1] = 0.999 * m[1] + 0.001 * g * g
                    w -= rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8)


@dataclass
class Detector:
    """The trained network, its calibration (slope, shift), and the threshold; without a network nothing is added."""

    network: Network | None
    slope: float = 1.0
    shift: float = 0.0
    threshold: float = 1.0
    # Of the labelled findings that were not trained on: how many, the recall, and the share of negatives excluded.
    scored: tuple[int, int] = (0, 0)
    recall: float = 0.0
    quiet: float = 0.0

    def probabilities(self, seen: list[bytes]) -> np.ndarray:
        return _logistic(self.slope * self.network.scores(seen) + self.shift)

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """All findings of each text by start, then kind."""
        found = [base_spans(text) for text in texts]
        if self.network is None:
            return found
        more = [(i, a, b) for i, text in enumerate(texts) for a, b in candidates(text, found[i])]
        for k in range(0, len(more), 4096):
            part = more[k : k + 4096]
            sure = self.probabilities([b"".join(views(texts[i], a, b)) for i, a, b in part]) >= self.threshold
            for (i, a, b), yes in zip(part, sure):
                if yes:
                    found[i].append((a, b, 3))
        return [sorted(spans, key=lambda s: (s[0], s[2])) for spans in found]


def _logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def calibration(logits: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve through held-back findings, with smoothed targets."""
    positive, number = weight[y == 1].sum(), weight.sum()
    target = np.where(y == 1, (positive + 1) / (positive + 2), 1 / (number - positive + 2))
    scale = max(1e-6, np.abs(logits).max())
    x = np.stack([logits / scale, np.ones_like(logits)], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = _logistic(x @ w)
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        w += np.linalg.solve(curve, x.T @ (weight * (target - p)) - 1e-3 * w)
    return max(1e-6, w[0] / scale), w[1]


def labels(text: str) -> list[tuple[int, int, int]]:
    """(label, start, end) of the patterns' findings, of candidates known to be something else, and of a long word."""
    base = base_spans(text)
    # Other candidates are what the network is to judge and have no label, nor have values too short for the
    # patterns; what follows a colon may be a password before a host.
    short = {m.span(2) for m in _ASSIGN.finditer(text)}
    runs = candidates(text, base)
    plain = ((a, b) for a, b in runs if (a, b) not in short and _KNOWN.fullmatch(text, a, b))
    known = [(a, b) for a, b in plain if text[a : a + 2] == "//" or text[max(0, a - 1) : a] != ":"]
    # A word of its own: no part of a finding or candidate.
    taken = [*((a, b) for a, b, _ in base), *runs]
    words = (m.span() for m in _LONG_WORD.finditer(text))
    free = next(((a, b) for a, b in words if all(b <= c or a >= d for c, d in taken)), None)
    return [*((1, a, b) for a, b, _ in base), *((0, a, b) for a, b in known), *([(0, *free)] if free else [])]


def labelled_findings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text) to (place in a fixed order, label, joined windows) of labelled findings."""
    for batch in batches:
        rows = [(k, views(text, a, b)) for text in batch.column(0).to_pylist() for k, a, b in labels(text)]
        order = [int.from_bytes(hashlib.blake2b(w[0], digest_size=8).digest(), "little", signed=True) for _, w in rows]
        yield pa.RecordBatch.from_arrays(
            [pa.array(order, pa.int64()), pa.array([r[0] for r in rows], pa.int32()), pa.array([b"".join(r[1]) for r in rows], pa.binary())],
            ["place", "label", "windows"],
        )


def histogram(found: DataFrame, network: Network, last: list[int]) -> np.ndarray:
    """Numbers of negatives and positives by score, of all findings that are held out or come after the ``last`` trained."""

    def counted(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros((2 * _FINE * _LARGEST, 2))
        for batch in batches:
            place, label = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            chosen = np.flatnonzero((place % HELD_OUT == 0) | (place > np.array(last)[label]))
            for k in range(0, len(chosen), 4096):
                part = chosen[k : k + 4096]
                scores = network.scores(batch.column(2).take(pa.array(part)).to_pylist())
                step = np.clip(np.floor((scores + _LARGEST) * _FINE), 0, len(total) - 1).astype(np.int64)
                np.add.at(total, (step, label[part]), 1)
        return total

    counts = summed(found, counted, 2)
    return counts if len(counts) else np.zeros((2 * _FINE * _LARGEST, 2))


def detector_of(network: Network, counts: np.ndarray) -> Detector:
    """Calibration and threshold from the scores of all findings that were not trained on."""
    edges = np.arange(len(counts) + 1) / _FINE - _LARGEST
    step, label = np.nonzero(counts)
    slope, shift = calibration((edges[:-1] + 0.5 / _FINE)[step], label, counts[step, label])
    other, found = counts.sum(axis=0)
    # Positives from each edge on, negatives below it.
    above = np.append(np.cumsum(counts[::-1, 1])[::-1], 0)
    below = np.append(0, np.cumsum(counts[:, 0]))
    reached = int(np.flatnonzero(above >= RECALL * found)[-1])
    quiet = int(np.flatnonzero(below >= QUIET * other)[0])
    even = int(np.searchsorted(edges, -shift / slope))
    # As low as nearly no negative allows, never above what the recall asks for.
    at = min(reached, max(even, quiet))
    threshold = float(_logistic(slope * edges[at] + shift))
    return Detector(network, slope, shift, threshold, (int(found), int(other)), above[at] / found, below[at] / other)


def fit_detector(docs: DataFrame) -> Detector:
    """Trains on at most ``MOST_FINDINGS`` distinct findings of either label, the first by a hash of the window.

    The findings of all documents compete for these places; one in ``HELD_OUT`` by hash is kept from
    them. All others, each as often as it occurs, are scored for the calibration and the threshold.
    Without findings of both labels there is nothing to learn and nothing is added.
    """
    texts = docs.select(F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    found = materialize(texts.mapInArrow(labelled_findings, "place bigint, label int, windows binary"), "findings")
    first = found.where(F.col("place") % HELD_OUT != 0).select("place", "label", F.substring("windows", 1, WINDOW).alias("window"))
    # One row per place and label; limits are cut in every task first.
    kept = [first.where(F.col("label") == k).distinct().orderBy("place", "window").limit(MOST_FINDINGS) for k in (0, 1)]
    rows = kept[0].unionByName(kept[1]).collect()
    rows.sort(key=lambda r: (r.place, r.label, bytes(r.window)))
    places = [[r.place for r in rows if r.label == k] for k in (0, 1)]
    if min(map(len, places)) < 5:
        return Detector(None)
    x = np.frombuffer(b"".join(bytes(r.window) for r in rows), dtype=np.uint8).reshape(-1, WINDOW)
    network = Network()
    network.train(x, np.array([r.label for r in rows], dtype=float))
    last = [max(p) if len(p) == MOST_FINDINGS else np.iinfo(np.int64).max for p in places]
    counts = histogram(found, network, last)
    return detector_of(network, counts) if counts.sum(axis=0).min() >= 5 else Detector(None)


def _joined(spans: list[tuple[int, int, int]], last: int) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans if k <= last)


def scan(docs: DataFrame, detector: Detector) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_network) of every whole text; a narrow job.

    Places are code points, ends exclusive. Null texts count as empty: no findings, the digest of
    nothing, empty spans. Repeated rows are scanned each, other columns do not matter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = detector.spans([t or "" for t in batch.column(1).to_pylist()])
            counts = [pa.array([sum(k == kind for *_, k in s) for s in found], pa.int64()) for kind in range(4)]
            digests = [hashlib.sha256(_joined(s, 2).encode()).hexdigest() for s in found]
            spans = [_joined(s, 3) for s in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *counts[:3], pa.array(digests, pa.string()), pa.array(spans, pa.string()), counts[3]],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_network"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_network bigint"
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def redacted(text: str, spans: list[tuple[int, int, int]], mark: str = "[SECRET]") -> str:
    """The text with every finding, overlapping ones together, replaced by ``mark``."""
    out, at = [], 0
    for a, b, _ in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, detector: Detector) -> DataFrame:
    """``docs`` with the same rows and columns, findings replaced in ``text`` and ``n_chars`` counted anew there."""
    place, counted = docs.columns.index("text"), docs.columns.index("n_chars")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lengths = batch.column(place).to_pylist(), batch.column(counted).to_pylist()
            for i, spans in enumerate(detector.spans([t or "" for t in texts])):
                if spans:
                    texts[i] = redacted(texts[i], spans)
                    lengths[i] = len(texts[i])
            columns = list(batch.columns)
            columns[place] = pa.array(texts, batch.schema.field(place).type)
            columns[counted] = pa.array(lengths, batch.schema.field(counted).type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
