"""Quality rules by labelling the sequence of lines.

Each line of a text is content or boilerplate. A linear-chain conditional random field over
features of the lines decides: its Viterbi path is the labelling, and the share of a
document's words in content lines decides whether the document stays.

The field is fitted on a bounded sample of labelled documents (``sample``), in one task. Only
documents have labels, so the lines' labels are found in turns with the weights: at first
all lines of a bad document count as boilerplate, then those that the field so far takes for
content may change, but for the line of each bad document that is least like content.

Counts of words, symbols, repeated lines and repeated windows of words are taken over whole
texts and give the base rules. Defined results: a null or blank text has no words and fails
the base rules; a text is split at \\n only; a sample without both labels leaves all lines
content. Rows with equal or null ids are judged one by one. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SAMPLE_BYTES, bounded, mix64, slices, small_batches, text_bytes, texts, tidied, up_to, word_hashes, word_spans

SAMPLE, ROUNDS, TURNS = 6000, 120, 3
SHARE = 0.5  #: least share of words in content lines
SYMBOLS = "#*$%&|<>"  # fixed values
BLANKS = " \t\n\r\x0b\x0c"
WINDOW = 5

STEPS = {  # lower bounds of the bins of each feature of a line
    "symbols": (1e-9, 0.02, 0.08), "upper": (0.1, 0.3, 0.6), "digits": (1e-9, 0.1, 0.3), "words": (3, 6, 15, 40),
    "stops": (1e-9, 0.05, 0.2), "word_length": (2.5, 4, 7, 12), "marks": (0.05, 0.12, 0.25), "repeated": (1e-9, 0.2, 0.5), "seen": (0.5,),
}
WIDTH = 1 + sum(len(s) + 1 for s in STEPS.values())


class Batch:
    """Counts of a column of texts, by row and by line."""

    def __init__(self, column):
        body, bounds = text_bytes(column)
        self.n = n = len(bounds) - 1
        starts, ends = word_spans(body, bounds)
        h = word_hashes(body, starts, ends, False)
        row = np.searchsorted(bounds, starts, "right") - 1
        self.n_words = np.bincount(row, minlength=n)

        def running(member: np.ndarray) -> np.ndarray:
            return np.concatenate(([0], np.cumsum(member[body])))

        kinds = {k: np.zeros(256, bool) for k in ("points", "blank", "symbols", "upper", "digits", "stops", "marks")}
        kinds["points"][:128] = kinds["points"][192:] = True
        kinds["blank"][[ord(c) for c in BLANKS]] = True
        kinds["symbols"][[ord(c) for c in SYMBOLS]] = True
        kinds["upper"][65:91] = True
        kinds["digits"][48:58] = True
        kinds["stops"][[ord(c) for c in ".!?;:"]] = True
        kinds["marks"][[c for c in range(33, 127) if not chr(c).isalnum()]] = True
        total = {k: running(v) for k, v in kinds.items()}

        def between(kind: str, edge: np.ndarray) -> np.ndarray:
            return np.diff(total[kind][edge])

        self.n_symbols = between("symbols", bounds)
        self.word_chars = between("points", bounds) - between("blank", bounds)

        # words in windows that occur twice in their text
        repeated = np.zeros(len(h), bool)
        if len(h) >= WINDOW:
            g = h[: len(h) - WINDOW + 1].copy()
            for i in range(1, WINDOW):
                g = mix64(g * np.uint64(0x9E3779B97F4A7C15) + h[i : i + len(g)])
            at = np.flatnonzero(row[: len(g)] == row[WINDOW - 1 :])
            key = g[at] ^ mix64(row[at].astype(np.uint64) + np.uint64(1))
            order = np.argsort(key)
            same = key[order][1:] == key[order][:-1]
            many = np.zeros(len(at), bool)
            many[order[1:][same]] = many[order[:-1][same]] = True
            for i in range(WINDOW):
                repeated[at[many] + i] = True
        self.n_repeat_words = np.bincount(row[repeated], minlength=n)

        # lines: bounds of rows and behind every \n
        breaks = np.flatnonzero(body == 10) + 1
        edge = np.sort(np.concatenate((bounds, breaks[~np.isin(breaks, bounds)])))
        edge = edge[np.concatenate(([True], edge[1:] != edge[:-1]))]
        line = np.searchsorted(edge, starts, "right") - 1
        m = len(edge) - 1
        count = np.bincount(line, minlength=m)
        size = np.maximum(between("points", edge), 1)
        self.line_words = count
        self.line_row = np.searchsorted(bounds, edge[:-1], "right") - 1
        seen = self._seen(column, edge, bounds)
        self.n_dup_lines = np.bincount(self.line_row[seen & (count > 0)], minlength=n)
        value = {k: between(k, edge) / size for k in ("symbols", "upper", "digits", "stops", "marks")}
        value |= {"words": count, "word_length": (size - between("blank", edge)) / np.maximum(count, 1), "repeated": np.bincount(line[repeated], minlength=m) / np.maximum(count, 1), "seen": seen}
        base, columns = 1, [np.zeros(m, np.int64)]
        for k, steps in STEPS.items():
            columns.append(base + np.searchsorted(np.array(steps), value[k], "right"))
            base += len(steps) + 1
        self.features = np.stack(columns, axis=1)
        live = count > 0  # blank lines have no label
        self.features, self.line_row, self.line_words = self.features[live], self.line_row[live], count[live]

    def _seen(self, column, edge: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Whether a line equals an earlier one of its row; by bytes, without the \\n."""
        at, out = {int(e): i for i, e in enumerate(edge[:-1])}, np.zeros(len(edge) - 1, bool)
        for text, lo in zip(column.to_pylist(), bounds[:-1].tolist()):
            if not text or "\n" not in text:
                continue
            known: set[bytes] = set()
            for x in text.encode().split(b"\n"):
                if x in known and x:
                    out[at[lo]] = True
                known.add(x)
                lo += len(x) + 1
        return out

    def failed(self) -> np.ndarray:
        return (self.n_words < 10) | (100 * self.n_repeat_words > 20 * self.n_words)


def padded(batch_row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of lines sorted by row: the rows that have lines, the first line of each and their number."""
    rows, first, count = np.unique(batch_row, return_index=True, return_counts=True)
    return rows, first, count


def viterbi(scores: np.ndarray, jump: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The best labels of sequences of lines (1: boilerplate), all sequences in step."""
    out = np.zeros(len(scores), np.int64)
    order = np.argsort(-count, kind="stable")
    first, count = first[order], count[order]
    back = np.zeros((len(scores), 2), np.int8)
    best = np.zeros((len(scores), 2))
    for t in range(int(count.max()) if len(count) else 0):
        i = first[: np.searchsorted(-count, -t, "left")] + t
        if t:
            step = best[i - 1][:, :, None] + jump[None]
            back[i] = step.argmax(axis=1)
            best[i] = step.max(axis=1) + scores[i]
        else:
            best[i] = scores[i]
    last = first + count - 1
    out[last] = best[last].argmax(axis=1) if len(last) else 0
    for t in range(int(count.max()) - 1 if len(count) else 0, 0, -1):
        i = first[: np.searchsorted(-count, -t, "left")] + t
        out[i - 1] = back[i, out[i]]
    return out


def marginals(scores: np.ndarray, jump: np.ndarray, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each line's probabilities of the labels, and the expected number of each pair of neighbours."""
    order = np.argsort(-count, kind="stable")
    first, count = first[order], count[order]
    a, b, pairs = scores.copy(), np.zeros_like(scores), np.zeros((2, 2))
    steps = [first[: np.searchsorted(-count, -t, "left")] + t for t in range(int(count.max()))]
    for i in steps[1:]:
        x = a[i - 1][:, :, None] + jump[None]
        a[i] += np.logaddexp(x[:, 0], x[:, 1])
    for i in reversed(steps[1:]):
        x = jump[None] + (scores[i] + b[i])[:, None, :]
        b[i - 1] = np.logaddexp(x[:, :, 0], x[:, :, 1])
    p = a + b
    total = np.logaddexp(p[:, 0], p[:, 1])
    p = np.exp(p - total[:, None])
    for i in steps[1:]:
        x = a[i - 1][:, :, None] + jump[None] + (scores[i] + b[i])[:, None, :] - total[i][:, None, None]
        pairs += np.exp(x).sum(axis=0)
    return p, pairs


def fit(features: np.ndarray, row: np.ndarray, good: np.ndarray, rounds: int, turns: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights by feature and label, and scores of neighbouring labels. ``good``: by row."""
    weights, jump = np.zeros((WIDTH, 2)), np.zeros((2, 2))
    if not len(row) or good.all() or not good.any():
        return weights, jump
    _, first, count = padded(row)
    bad_line = ~good[row]
    label = bad_line.astype(np.int64)
    for _ in range(turns):
        one = np.eye(2)[label]
        inside = np.ones(len(row), bool)
        inside[first] = False
        seen_pairs = np.zeros((2, 2))
        np.add.at(seen_pairs, (label[np.flatnonzero(inside) - 1], label[inside]), 1)
        # bad documents are few: each label counts alike
        theta, m, v = np.concatenate((weights.ravel(), jump.ravel())), 0.0, 0.0
        for t in range(1, rounds + 1):
            w, j = theta[:-4].reshape(WIDTH, 2), theta[-4:].reshape(2, 2)
            p, pairs = marginals(w[features].sum(axis=1), j, first, count)
            g = np.zeros((WIDTH, 2))
            for k in range(2):
                g[:, k] = np.bincount(features.ravel(), np.repeat(p[:, k] - one[:, k], features.shape[1]), WIDTH)
            slope = np.concatenate((g.ravel(), (pairs - seen_pairs).ravel())) / len(row) + 1e-4 * theta
            m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope * slope
            theta = theta - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        weights, jump = theta[:-4].reshape(WIDTH, 2), theta[-4:].reshape(2, 2)
        scores = weights[features].sum(axis=1)
        p, _ = marginals(scores, jump, first, count)
        label = (bad_line & (p[:, 1] >= 0.5)).astype(np.int64)
        worst = np.lexsort((-p[:, 1], row))[np.cumsum(count) - count]
        label[worst] |= bad_line[worst]
    return weights, jump


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, rounds: int = ROUNDS, turns: int = TURNS) -> tuple[np.ndarray, np.ndarray]:
    """Fit on at most ``sample`` labelled documents, half of each label as far as there are any."""
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    order = [F.xxhash64(F.col("doc_id"), F.lit("sample")), F.col("doc_id")]
    picked = known.where("quality = 0").orderBy(*order).limit(sample // 2).unionByName(known.where("quality <> 0").orderBy(*order).limit(sample // 2))
    small_batches(docs.sparkSession)
    # at most ``sample`` pairs of numbers
    rows = bounded(texts(docs).join(F.broadcast(picked), "doc_id").select("doc_id", "text", "quality"), sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, row, good, n = [np.zeros((0, len(STEPS) + 1), np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)], 0
        for batch in up_to(batches, 1, SAMPLE_BYTES):
            b = Batch(batch.column(1))
            ok = batch.column(2).to_numpy(zero_copy_only=False) != 0
            use = (~b.failed())[b.line_row]  # those that fail the base rules teach the field nothing
            features.append(b.features[use])
            row.append(b.line_row[use] + n)
            good.append(ok)
            n += b.n
        w, j = fit(np.concatenate(features), np.concatenate(row), np.concatenate(good), rounds, turns)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((w.ravel(), j.ravel()))), pa.array(np.arange(w.size + 4))], names=["w", "i"])

    theta = np.array([r.w for r in sorted(rows.mapInArrow(tidied(run), "w double, i bigint").collect(), key=lambda r: r.i)])
    return (theta[:-4].reshape(WIDTH, 2), theta[-4:].reshape(2, 2)) if len(theta) else (np.zeros((WIDTH, 2)), np.zeros((2, 2)))


def judged(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], share: float = SHARE, keep_labels: bool = True) -> DataFrame:
    """doc_id, the counts, base_failed, content_share, kept, and with ``keep_labels`` boilerplate: by line with a word."""
    weights, jump = model
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for whole in batches for x in slices(whole, 1)):
            b = Batch(batch.column(1))
            _, first, count = padded(b.line_row)
            label = viterbi(weights[b.features].sum(axis=1), jump, first, count)
            content = np.bincount(b.line_row, b.line_words * (1 - label), b.n) / np.maximum(b.n_words, 1)
            failed = b.failed()
            columns = [batch.column(0), *(pa.array(getattr(b, c).astype(np.int64)) for c in counts), pa.array(failed), pa.array(content), pa.array(~failed & (content >= share))]
            if keep_labels:
                columns.append(pa.ListArray.from_arrays(pa.array(np.searchsorted(b.line_row, np.arange(b.n + 1)), pa.int32()), pa.array(label == 1)))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *counts, "base_failed", "content_share", "kept", *(["boilerplate"] if keep_labels else [])])

    rows = texts(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(tidied(run), "doc_id bigint, " + ", ".join(f"{c} bigint" for c in counts) + ", base_failed boolean, content_share double, kept boolean" + ", boilerplate array<boolean>" * keep_labels)


def quality(docs: DataFrame, labels: DataFrame, share: float = SHARE) -> DataFrame:
    """Counts and verdict of every document, by a field fitted on the labelled ones."""
    return judged(docs, train(docs, labels), share, keep_labels=False)
