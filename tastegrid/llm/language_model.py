"""Document log-likelihood by a gated recurrent language model over words.

The corpus side is counted in full: words of all training documents, in Spark. The most frequent ``vocabulary - 2`` words,
the end mark and "any other word" are the model's symbols, in frequency classes of ``per_class`` symbols: the output is
``P(class | state) * P(symbol | class, state)``. A word outside the vocabulary has the probability of "any other word"
times its smoothed share of the counts of all such words; all unseen words are one entry there, as in the base score.

Weights start from a fit on the driver over a bounded sample (``sample_tokens``). Then every task reads its share
of the training documents once with truncated backpropagation, carrying the state from window to window, and the
tasks' weights are averaged, weighted by their tokens. Scoring carries the state through each whole document.

Words are runs without ASCII white space after lower-casing A-Z. Counts of the ``HEAD`` most frequent words go to every
task; the rest are looked up by a join, so no task needs all counts. Defined results: a null text is empty and has
one token, its end; repeated rows and null ids are rows like any other; with no training row all counts are zero
and the model is as it was initialised; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import log, log10

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tastegrid.llm import gru
from tastegrid.llm.common import slices
from tastegrid.operators.staging import stage

END = b""  # no word is empty
HEAD = 65_536  # most words whose counts every task holds
WIDTH = 512  # documents that learn side by side
SPAN = 32  # steps of one backpropagation window
SLICE = 1024  # tokens whose class probabilities are computed at a time
STEP_TOKENS = 2048  # tokens behind one update of the weights
FLUSH = 200_000  # distinct words a task holds before it passes their counts on
BUFFER = 1 << 21  # tokens read before their documents are batched by length


def words(text: str | None) -> list[bytes]:
    return text.encode().lower().split() if text else []


def count_words(docs: DataFrame, text: str) -> DataFrame:
    """``(word, c)``; the end mark is the empty word. Tasks add up before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def passed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.binary()).cast(pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "c"]
            )

        for batch in batches:
            for value in batch.column(0):
                held.update(words(value.as_py()))
                held[END] += 1
                if len(held) >= FLUSH:
                    yield passed()
                    held.clear()
        if held:
            yield passed()

    return docs.select(text).mapInArrow(run, "word string, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


class Model:
    """The recurrent layer and the factored output. Symbol 0 is the end mark, symbol 1 any other word."""

    def __init__(self, counts: np.ndarray, hidden: int, per_class: int, seed: int):
        self.hidden, self.k = hidden, per_class
        self.n = len(counts)
        self.classes = -(-self.n // per_class)
        rng = np.random.default_rng(seed)
        order = np.argsort(-counts, kind="stable")  # classes hold symbols of like frequency
        self.slot = np.empty(self.n, np.int64)
        self.slot[order] = np.arange(self.n)
        padded = np.zeros(self.classes * per_class)
        padded[: self.n] = counts[order] + 0.5
        grid = padded.reshape(self.classes, per_class)
        # with zero states the model is the unigram distribution; empty slots get no probability
        with np.errstate(divide="ignore"):
            inner = np.where(grid > 0, np.log(np.maximum(grid, 1e-30) / grid.sum(1, keepdims=True)), -1e4)
            outer = np.log(grid.sum(1) / grid.sum())
        self.weights = {f"g.{k}": v for k, v in gru.initial(self.n, hidden, rng).items()} | {
            "class.w": np.zeros((self.classes, hidden), np.float32),
            "class.b": outer.astype(np.float32),
            "word.w": np.zeros((self.classes, per_class, hidden), np.float32),
            "word.b": inner.astype(np.float32),
        }

    @property
    def layer(self) -> dict[str, np.ndarray]:
        return {"table": self.weights["g.table"], "back": self.weights["g.back"]}

    def vector(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.weights.values()])

    def load(self, vector: np.ndarray) -> None:
        at = 0
        for v in self.weights.values():
            v[...] = vector[at : at + v.size].reshape(v.shape)
            at += v.size

    def output(self, states: np.ndarray, slots: np.ndarray, grads: bool = False):
        """Natural log-probability of each slot given its state ``(hidden, tokens)``; with ``grads`` also those of the
        mean negative log-likelihood."""
        w, n = self.weights, states.shape[1]
        group, at = slots // self.k, slots % self.k
        logs = np.empty(n)
        if grads:
            out = {k: np.zeros_like(w[k]) for k in ("class.w", "class.b", "word.w", "word.b")}
            d_states = np.empty_like(states)
        for lo in range(0, n, SLICE):  # what a slice needs stays in the cache
            part, chosen = states[:, lo : lo + SLICE], group[lo : lo + SLICE]
            here = np.arange(len(chosen))
            top = w["class.w"] @ part
            top += w["class.b"][:, None]
            top -= top.max(0)
            np.exp(top, out=top)
            total = top.sum(0)
            logs[lo : lo + SLICE] = np.log(top[chosen, here] / total)
            if grads:
                top /= total
                top[chosen, here] -= 1
                top /= n
                out["class.w"] += top @ part.T
                out["class.b"] += top.sum(1)
                d_states[:, lo : lo + SLICE] = w["class.w"].T @ top
        order = np.argsort(group.astype(np.int16) if self.classes < 1 << 15 else group, kind="stable")
        bounds = np.searchsorted(group[order], np.arange(self.classes + 1))
        for c in np.flatnonzero(np.diff(bounds)).tolist():
            rows = order[bounds[c] : bounds[c + 1]]
            part = states[:, rows]
            inner = w["word.w"][c] @ part
            inner += w["word.b"][c][:, None]
            inner -= inner.max(0)
            np.exp(inner, out=inner)
            total = inner.sum(0)
            local, spot = at[rows], np.arange(len(rows))
            logs[rows] += np.log(inner[local, spot] / total)
            if grads:
                inner /= total
                inner[local, spot] -= 1
                inner /= n
                out["word.w"][c] = inner @ part.T
                out["word.b"][c] = inner.sum(1)
                d_states[:, rows] += w["word.w"][c].T @ inner
        return (logs, out, d_states) if grads else logs

    def run(self, docs: list[np.ndarray], step: gru.Adam | None = None, width: int = WIDTH) -> np.ndarray:
        """Log-likelihood of each document of symbols (its end included). With ``step`` the weights learn after
        every window. Documents of like length run side by side; each one's state is carried to its end."""
        total = np.zeros(len(docs))
        order = sorted(range(len(docs)), key=lambda i: -len(docs[i]))
        width = width if step else 8 * width
        starts = np.arange(0, len(order), width)
        if step:  # long and short documents take turns
            starts = np.random.default_rng(len(docs)).permutation(starts)
        for first in starts.tolist():
            group = order[first : first + width]
            sizes = np.array([len(docs[i]) for i in group])
            state = np.zeros((self.hidden, len(group)), np.float32)
            came = np.zeros(len(group), np.int64)  # a document begins after an end mark
            for at in range(0, int(sizes[0]), SPAN):
                live = int(np.searchsorted(-sizes, -at, side="left"))
                steps = min(SPAN, int(sizes[0]) - at)
                target = np.zeros((steps, live), np.int64)
                for j in range(live):
                    piece = docs[group[j]][at : at + steps]
                    target[: len(piece), j] = piece
                given = np.concatenate((came[None, :live], target[:-1]))
                valid = np.arange(at, at + steps)[:, None] < sizes[None, :live]
                found = gru.forward(self.layer, given, state[:, :live], keep=step is not None)
                states, kept = found if step else (found, None)
                chosen = states.transpose(1, 0, 2)[:, valid]
                slots = self.slot[target[valid]]
                if step:
                    logs, out, d_chosen = self.output(chosen, slots, grads=True)
                    d_states = np.zeros((self.hidden, steps, live), np.float32)
                    d_states[:, valid] = d_chosen
                    back = gru.backward(self.layer, given, kept, d_states.transpose(1, 0, 2))
                    step.gather(out | {f"g.{k}": v for k, v in back.items()}, chosen.shape[1], STEP_TOKENS)
                else:
                    logs = self.output(chosen, slots)
                owner = np.broadcast_to(np.array(group[:live]), valid.shape)[valid]
                total += np.bincount(owner, weights=logs, minlength=len(docs))
                state, came = states[-1], target[-1]
        if step:
            step.flush(STEP_TOKENS)
        return total


def symbol_type(vocabulary: int) -> str:
    return "<i2" if vocabulary <= 1 << 15 else "<i4"


class _Places(dict):
    """Word to its place in the head; -1 for all others."""

    def __missing__(self, word: bytes) -> int:
        return -1


class Counts:
    """What every task knows of the corpus: totals, the head's counts and the vocabulary."""

    def __init__(self, head: list, total: int, distinct: int, vocabulary: int):
        found = {r[0].encode(): r[1] for r in head}
        end = self.end = found.pop(END, 0)
        ranked = sorted(found.items(), key=lambda x: (-x[1], x[0]))
        inside = min(len(ranked), vocabulary - 2)
        self.total, self.distinct = total, distinct
        self.place = _Places({w: i for i, (w, _) in enumerate(ranked)})
        counts = np.array([c for _, c in ranked], np.float64)
        # the last entry stands for words outside the head
        self.symbol = np.ones(len(ranked) + 1, symbol_type(vocabulary))
        self.symbol[:inside] = np.arange(2, inside + 2)
        self.log = np.append(np.log10(counts + 0.5), 0.0)
        self.rest = total - int(counts[:inside].sum()) - end  # tokens outside the vocabulary
        outside = distinct - inside - (1 if end else 0)
        self.base_log = log10(total + 0.5 * (distinct + 1))
        self.rest_log = log10(self.rest + 0.5 * (outside + 1))
        self.start = np.array([end, self.rest, *counts[:inside]], np.float64)

    def places(self, found: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.place.__getitem__, found), np.int32, len(found))


def head_words(counts: DataFrame, most: int) -> list:
    """``(word, c)`` of the end mark and of the most frequent words.

    The words are those of at least the least count, on a ladder of counts, that at most ``most`` words reach; so the
    driver never receives more than that, whatever the number of partitions.
    """
    ladder, t = [], 1
    while t < 1 << 50:
        ladder.append(t)
        t = max(t + 1, int(t * 1.4))
    real = counts.where("word != ''")
    reach = real.agg(*(F.count_if(F.col("c") >= t) for t in ladder)).first()
    least = next((t for t, n in zip(ladder, reach) if n <= most), ladder[-1])
    return counts.where((F.col("word") == "") | (F.col("c") >= least)).collect()


def symbolised(docs: DataFrame, held_out: Column, key: str, text: str, known: Counts) -> DataFrame:
    """One row per document: its symbols as bytes, the number of words in the head, the sum of their count logs, of those
    outside the vocabulary, their number, and the other words with their numbers; ``place`` orders the sample."""
    kind, key_type = docs.schema[key].dataType.simpleString(), to_arrow_type(docs.schema[key].dataType)
    kinds = [pa.int64(), pa.binary(), pa.int64(), pa.float64(), pa.float64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            for part in slices(batch):
                out: list[list] = [[] for _ in range(6)]
                tail_words, tail_n, tail_ends = [], [], [0]
                for value in part.column(1):
                    found = words(value.as_py())
                    at = known.places(found)
                    ids, logs = known.symbol[at], known.log[at]
                    outside = np.flatnonzero(at < 0)
                    tail = Counter(found[i] for i in outside.tolist())
                    rest = ids == 1
                    values = (
                        row, np.append(ids, ids.dtype.type(0)).tobytes(), len(found) - len(outside), float(logs.sum()),
                        float(logs[rest].sum()), int(rest.sum()),
                    )
                    for column, v in zip(out, values):
                        column.append(v)
                    tail_words.extend(tail)
                    tail_n.extend(tail.values())
                    tail_ends.append(len(tail_n))
                    row += 1
                texts = pa.array(tail_words, pa.binary()).cast(pa.string())
                entries = pa.StructArray.from_arrays([texts, pa.array(tail_n, pa.int64())], names=["word", "n"])
                tails = pa.ListArray.from_arrays(pa.array(tail_ends, pa.int32()), entries)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).cast(key_type), *(part.column(i) for i in (2, 3)), *(pa.array(c, t) for c, t in zip(out, kinds)), tails],
                    names=[key, "held_out", "place", "row", "symbols", "n_head", "head_sum", "rest_sum", "n_rest", "tail"],
                )

    place = F.pmod(F.xxhash64(F.lit("lm"), F.col(key), F.length(text)), F.lit(1 << 20))
    rows = docs.select(key, F.col(text).alias("text"), held_out.alias("held_out"), place.alias("place"))
    return rows.mapInArrow(
        run,
        f"`{key}` {kind}, held_out boolean, place bigint, row bigint, symbols binary, n_head bigint, head_sum double, rest_sum double, "
        "n_rest bigint, tail array<struct<word:string,n:bigint>>",
    )


def buffers(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[tuple[pa.Table, list[np.ndarray]]]:
    """Rows and the symbols in their first column, in runs of about ``BUFFER`` tokens."""
    held, docs, size = [], [], 0
    for batch in batches:
        for part in slices(batch, column=0):
            docs += [np.frombuffer(v.as_buffer(), kind) for v in part.column(0)]
            held.append(part.select(part.schema.names[1:]))
            size += sum(map(len, docs[-part.num_rows :]))
            if size >= BUFFER:
                yield pa.Table.from_batches(held), docs
                held, docs, size = [], [], 0
    if held:
        yield pa.Table.from_batches(held), docs


def _averaged(model: Model, parts: DataFrame, fold: int = 16) -> np.ndarray:
    """The mean of the ``(tokens, weights)`` rows, weighted by tokens, added up in rounds of ``fold`` rows a task."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, total = 0, None
        for batch in batches:
            for n, data in zip(batch.column(0), batch.column(1)):
                vector = np.frombuffer(data.as_py(), np.float32) * np.float64(n.as_py())
                tokens, total = tokens + n.as_py(), vector if total is None else total + vector
        if tokens:
            mean = (total / tokens).astype(np.float32).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([tokens], pa.int64()), pa.array([mean], pa.binary())], names=["tokens", "weights"])

    rows = parts.count()
    while rows > fold:
        parts = stage(parts.repartition(-(-rows // fold)).mapInArrow(add, "tokens bigint, weights binary"), "lm-weights")
        rows = parts.count()
    found = parts.collect()
    tokens = sum(r[0] for r in found)
    return sum(np.frombuffer(r[1], np.float32) * (r[0] / tokens) for r in found) if tokens else model.vector()


def fit(train: DataFrame, known: Counts, hidden: int, per_class: int, vocabulary: int, sample_tokens: int, rate: float, seed: int = 5) -> Model:
    """A model of the symbols of ``train``. Its weights depend on how the rows are dealt over tasks, as each task's are
    averaged once."""
    model, kind = Model(known.start, hidden, per_class, seed), symbol_type(vocabulary)
    # the sample: pieces of at most 256 words from documents chosen by hash, one of the pieces of each
    wanted = sample_tokens // 256
    share = min(1 << 20, -(-(1 << 20) * 2 * wanted // max(1, known.end)))

    def piece(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for p, value in zip(batch.column(0), batch.column(1)):
                found = np.frombuffer(value.as_buffer(), kind)
                at = 256 * (p.as_py() % max(1, len(found) // 256))
                out.append(found[at : at + 256].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["place", "symbols"])

    chosen = train.select("place", "symbols").where(F.col("place") < share)
    pieces = chosen.mapInArrow(piece, "place bigint, symbols binary").limit(wanted).collect()
    if pieces:
        step = gru.Adam(model.weights, rate)
        docs = [np.frombuffer(s, kind) for _, s in sorted((r[0], bytes(r[1])) for r in pieces)]
        model.run(docs, step, width=64)
        step.rate = rate / 2
        model.run(docs, step, width=64)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(known.start, hidden, per_class, seed)
        own.load(start)
        step, seen = gru.Adam(own.weights, rate / 4), 0
        for _, docs in buffers(batches, kind):
            own.run(docs, step)
            seen += sum(map(len, docs))
        if seen:
            yield pa.RecordBatch.from_arrays(
                [pa.array([seen], pa.int64()), pa.array([own.vector().tobytes()], pa.binary())], names=["tokens", "weights"]
            )

    start = model.vector()
    model.load(_averaged(model, stage(train.select("symbols").mapInArrow(learn, "tokens bigint, weights binary"), "lm-weights")))
    return model


def scores(
    docs: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text", vocabulary: int = 2048, hidden: int = 12,
    per_class: int = 32, sample_tokens: int = 200_000, rate: float = 0.01,
) -> DataFrame:
    """``(key, held_out, n_tokens, n_known, train_tokens, base_score, score)``, one row per row of ``docs``."""
    counts = stage(count_words(docs.where(~held_out), text), "lm-counts")
    totals = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    known, symbols = Counts(head_words(counts, HEAD), totals[0], totals[1], vocabulary), symbol_type(vocabulary)
    # every text is cut into words twice, to count them and to write its symbols
    coded = stage(symbolised(docs, held_out, key, text, known), "lm-symbols")
    vector = fit(coded.where(~F.col("held_out")), known, hidden, per_class, vocabulary, sample_tokens, rate).vector()
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(known.start, hidden, per_class, 0)
        own.load(vector)
        end_log = log10(known.end + 0.5)
        for rows, found in buffers(batches, symbols):
            p = own.run(found) / log(10)
            n_head, head_sum, rest_sum, n_rest = (rows[c].to_numpy() for c in ("n_head", "head_sum", "rest_sum", "n_rest"))
            made = [np.array(list(map(len, found)), np.int64), n_head + (known.end > 0), head_sum + end_log, p + rest_sum - n_rest * known.rest_log]
            table = rows.select([key, "held_out", "row"])
            for name, values in zip(("n_tokens", "n_known", "head_sum", "model_sum"), made):
                table = table.append_column(name, pa.array(values))
            yield from table.combine_chunks().to_batches()

    placed = coded.select("symbols", key, "held_out", "row", "n_head", "head_sum", "rest_sum", "n_rest")
    schema = f"`{key}` {kind}, held_out boolean, row bigint, n_tokens bigint, n_known bigint, head_sum double, model_sum double"
    passed = placed.mapInArrow(run, schema)
    # words whose count only the table of counts has travel to it
    tail = coded.select("row", F.inline("tail")).join(counts, "word", "left")
    log_c = F.log10(F.coalesce("c", F.lit(0)) + 0.5) * F.col("n")
    sums = tail.groupBy("row").agg(F.sum(log_c).alias("tail_sum"), F.sum(F.when(F.col("c").isNotNull(), F.col("n"))).alias("tail_known"))
    more = F.coalesce("tail_sum", F.lit(0.0))
    return passed.join(sums, "row", "left").select(
        key,
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        F.lit(known.total).cast("long").alias("train_tokens"),
        (F.col("head_sum") + more - F.col("n_tokens") * known.base_log).alias("base_score"),
        (F.col("model_sum") + more).alias("score"),
    )
