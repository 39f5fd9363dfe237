"""Language identification with a bidirectional gated recurrent network over bytes.

A text is read in windows of ``WINDOW`` bytes, forwards and backwards; every position gets probabilities of all languages
from both states, and the document's are their mean over all its bytes. The network is fitted on the driver by
backpropagation through time over a bounded sample: at most ``per_class`` documents a language, chosen by the hash of
their ids, and ``cuts`` pieces of ``PIECE`` bytes from each, evenly spaced over the whole text. Predictions read every
byte of every text.

Defined results: a null text, or one without a letter, is ``und`` with score 0; without a single labelled row every
text is; rows without a label are not learned from; repeated rows and null ids are rows like any other; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

from tastegrid.llm import gru
from tastegrid.llm.common import fresh, slices

WINDOW = 192
PIECE = 64
BATCH = 1024  # windows read at once
UNKNOWN = "und"


def remainder(key: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % n


def _pieces(docs: DataFrame, label: str, text: str, cuts: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, found = [], []
            for name, value in zip(batch.column(0), batch.column(1)):
                data = value.as_py().encode()
                at = np.unique(np.linspace(0, max(0, len(data) - PIECE), cuts).astype(int))
                found += [data[i : i + PIECE] for i in at.tolist()]
                names += [name.as_py()] * len(at)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(found, pa.binary())], names=["label", "piece"])

    return docs.select(F.col(label).cast("string"), text).mapInArrow(run, "label string, piece binary")


def sample(train: DataFrame, key: str, text: str, label: str, per_class: int, cuts: int) -> list:
    """``(label, piece)`` rows of at most about ``per_class`` documents a label."""
    rows = train.where(F.col(label).isNotNull() & F.col(text).isNotNull() & F.col(text).rlike(r"\p{L}"))
    counts = {r[0]: r[1] for r in train.where(F.col(label).isNotNull()).groupBy(F.col(label).cast("string")).count().collect()}
    place = F.pmod(F.xxhash64(F.lit("sample"), F.col(key), F.length(text)), F.lit(1 << 20))
    share = F.lit(0)
    for name, n in sorted(counts.items()):
        share = F.when(F.col(label).cast("string") == name, F.lit(min(1 << 20, -(-(1 << 20) * per_class // n)))).otherwise(share)
    bound = 2 * per_class * max(1, len(counts))
    return _pieces(rows.where(place < share).select(label, text).limit(bound), label, text, cuts).collect()


class Network:
    """The two layers and the readout; ``labels`` are the languages in order of the readout's rows."""

    def __init__(self, labels: list[str], hidden: int, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.labels, self.hidden = labels, hidden
        self.ahead, self.behind = gru.initial(256, hidden, rng), gru.initial(256, hidden, rng)
        self.out = {
            "ahead": (rng.normal(size=(len(labels), hidden)) * 0.1).astype(np.float32),
            "behind": (rng.normal(size=(len(labels), hidden)) * 0.1).astype(np.float32),
            "bias": np.zeros((len(labels), 1), np.float32),
        }

    def weights(self) -> dict[str, np.ndarray]:
        groups = {"a": self.ahead, "b": self.behind, "o": self.out}
        return {f"{g}.{k}": v for g, group in groups.items() for k, v in group.items()}

    def probabilities(self, symbols: np.ndarray, keep: bool = False):
        """``(T, labels, batch)`` for ``symbols (T, batch)``."""
        start = np.zeros((self.hidden, symbols.shape[1]), np.float32)
        ahead = gru.forward(self.ahead, symbols, start, keep)
        behind = gru.forward(self.behind, symbols[::-1], start, keep)
        a, b = (ahead[0], behind[0]) if keep else (ahead, behind)
        p = np.matmul(self.out["ahead"], a)
        p += np.matmul(self.out["behind"], b[::-1])
        p += self.out["bias"]
        p -= p.max(1, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(1, keepdims=True)
        return (p, ahead, behind) if keep else p

    def gradients(self, symbols: np.ndarray, targets: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy of all positions; ``targets (batch,)``."""
        p, (a, kept_a), (b, kept_b) = self.probabilities(symbols, keep=True)
        d = p / p.shape[0] / p.shape[2]
        d[:, targets, np.arange(p.shape[2])] -= 1 / p.shape[0] / p.shape[2]
        grads = {"o.ahead": np.einsum("tcb,thb->ch", d, a), "o.behind": np.einsum("tcb,thb->ch", d, b[::-1])}
        grads["o.bias"] = d.sum((0, 2))[:, None]
        back_a = gru.backward(self.ahead, symbols, kept_a, np.matmul(self.out["ahead"].T, d))
        back_b = gru.backward(self.behind, symbols[::-1], kept_b, np.matmul(self.out["behind"].T, d)[::-1])
        return grads | {f"a.{k}": v for k, v in back_a.items()} | {f"b.{k}": v for k, v in back_b.items()}


def fit(rows: list, hidden: int = 10, rounds: int = 220, batch: int = 256, rate: float = 0.02, seed: int = 3) -> Network:
    """Train on ``(label, piece)`` rows; every label fills an equal share of each batch."""
    labels = sorted({r[0] for r in rows})
    net, rng = Network(labels, hidden, seed), np.random.default_rng(seed)
    if len(labels) < 2:
        return net
    by = [np.array([np.frombuffer(r[1].ljust(PIECE, b" "), np.uint8) for r in sorted(rows) if r[0] == name]) for name in labels]
    step = gru.Adam(net.weights(), rate)
    for i in range(rounds):
        step.rate = rate * (1 - i / rounds) + rate / 50
        targets = rng.integers(0, len(labels), batch)
        symbols = np.stack([by[c][rng.integers(0, len(by[c]))] for c in targets]).T
        step.update(net.gradients(np.ascontiguousarray(symbols, dtype=np.int64), targets))
    return net


def _read(net: Network, texts: list[bytes]) -> np.ndarray:
    """Mean probabilities ``(texts, labels)`` over all bytes of each text (no text is empty)."""
    cut, owner, skip = [], [], []
    for i, data in enumerate(texts):
        for at in range(0, len(data), WINDOW):
            if at + WINDOW <= len(data) or not at:
                cut.append(data[at : at + WINDOW].ljust(WINDOW, b" "))
                skip.append((0, min(WINDOW, len(data) - at)))
            else:  # the last window ends with the text and reads anew only what is left
                cut.append(data[-WINDOW:])
                skip.append((WINDOW - (len(data) - at), WINDOW))
            owner.append(i)
    total = np.zeros((len(texts), len(net.labels)))
    symbols = np.frombuffer(b"".join(cut), np.uint8).reshape(-1, WINDOW)
    ends, owner = np.array(skip), np.array(owner)
    place = np.arange(WINDOW)[:, None]
    for at in range(0, len(symbols), BATCH):
        part = np.ascontiguousarray(symbols[at : at + BATCH].T)
        p = net.probabilities(part)
        used = (place >= ends[at : at + BATCH, 0]) & (place < ends[at : at + BATCH, 1])
        np.add.at(total, owner[at : at + BATCH], np.einsum("tcb,tb->bc", p, used.astype(np.float32)))
    return total / np.array([len(t) for t in texts])[:, None]


_LETTER = regex.compile(r"\p{L}")


def judge(net: Network | None, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Language and probability of each text."""
    names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    at = [i for i, t in enumerate(texts) if t and _LETTER.search(t)] if net and net.labels else []
    if at:
        found = _read(net, [texts[i].encode() for i in at])
        for i, best, p in zip(at, found.argmax(1).tolist(), found.max(1).tolist()):
            names[i], scores[i] = net.labels[best], round(min(1.0, p), 6)
    return names, scores


def train(docs: DataFrame, key: str, text: str, label: str, held_out: Column, per_class: int = 600, cuts: int = 8) -> Network:
    rows = docs.select(key, text, label).where(~held_out)
    return fit(sample(rows, key, text, label, per_class, cuts))


def predict(docs: DataFrame, net: Network, text: str, keep: list[str], names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns ``keep`` of every row, its language and that one's probability."""
    whole_text = fresh(docs, "_whole")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in slices(batch.select([0, batch.num_columns - 1])):
                found, scores = judge(net, part.column(1).to_pylist())
                rows = batch.slice(at, part.num_rows)
                at += part.num_rows
                yield pa.RecordBatch.from_arrays(
                    [*(rows.column(i) for i in range(len(keep))), pa.array(found, pa.string()), pa.array(scores, pa.float64())],
                    names=[*keep, *names],
                )

    schema = docs.select(*keep).schema.add(names[0], "string").add(names[1], "double")
    return docs.select(*keep, F.col(text).alias(whole_text)).mapInArrow(run, schema)


def identified(
    docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", least: float = 0.35
) -> DataFrame:
    """The rows whose language is told with a probability of ``least`` or more, with all columns of ``docs``.

    ``und`` rows go. The bar is low, as it only has to catch texts that no language claims.
    """
    net = train(docs, key, text, label, remainder(F.col(key), 4) == 2)
    names = fresh(docs, "_lang"), fresh(docs, "_score")
    judged = predict(docs, net, text, docs.columns, names)
    return judged.where((F.col(names[0]) != UNKNOWN) & (F.col(names[1]) >= least)).drop(*names)


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang") -> DataFrame:
    """``(key, held_out, lang_pred, score)``; a quarter of the rows, by hash of the id, is never learned from."""
    held = remainder(F.col(key), 4) == 2
    net = train(docs, key, text, label, held)
    return predict(docs.select(key, held.alias("held_out"), text), net, text, [key, "held_out"])
