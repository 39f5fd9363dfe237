"""Byte-level BPE as a deterministic automaton over token labels.

The automaton accepts exactly the token sequences that the merge list makes. It starts as one state that every byte
loops on. Each merge ``(u, v) -> uv``, in order, is a gadget: where an arc ``u`` leads to a state that has an arc
``v``, an arc ``uv`` is added past both, and the ``u`` arc is turned to a copy of that state without its ``v`` arc.
All arcs of one label lead to the same state, so a state is the set of labels cut from it together with the
merge that cut each of them, and the table needs no row per (state, label).

Encoding runs a pre-split word through the table: of the vocabulary labels that end at a byte, exactly one has an
arc from the state reached at its start. Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from hashlib import sha256
from struct import pack
from unicodedata import category

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers.pre_tokenizers import ByteLevel

from tastegrid.llm.common import slices

# The pre-split pattern of byte-level vocabularies; white space is the Unicode property.
SPLIT = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
HELD_WORDS = 200_000  # words whose ids a worker keeps in each of its two stores


def byte_letters() -> list[str]:
    """The letter that stands for each byte in vocabulary files: itself if visible, else the next one from U+0100."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, spare = [], 0x100
    for b in range(256):
        out.append(chr(b) if b in visible else chr(spare))
        spare += b not in visible
    return out


def unknown_letters() -> str:
    """Letters and numbers of ``regex`` that the tokenizers library's older Unicode tables do not have."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    late = [c for m in regex.finditer(r"[\p{L}\p{N}]+", every) for c in m[0] if category(c) == "Cn"]
    known: set[str] = set()
    for lead in "a1":
        text = " ".join(lead + c for c in late)
        known |= {text[e - 1] for _, (b, e) in ByteLevel(add_prefix_space=False).pre_tokenize_str(text) if text[b:e].strip()[:-1] == lead}
    return "".join(c for c in late if c not in known)


class Splitter:
    """Cuts a text into the words that are encoded one by one."""

    def __init__(self) -> None:
        self._usual = regex.compile(SPLIT)
        late = unknown_letters()
        cut = f"[{regex.escape(late, special_only=False)}]" if late else None
        self._late = frozenset(late)
        self._careful = regex.compile(
            "(?V1)" + SPLIT.replace(r"[^\p{White_Space}\p{L}\p{N}]", f"[{{O}}||{cut}]")
            .replace("{O}", r"[^\p{White_Space}\p{L}\p{N}]")
            .replace(r"?\p{L}+", rf"?[\p{{L}}--{cut}]+").replace(r"?\p{N}+", rf"?[\p{{N}}--{cut}]+")
        ) if cut else None

    def __call__(self, text: str) -> list[str]:
        if not text.isascii() and not self._late.isdisjoint(text):
            return self._careful.findall(text)
        return self._usual.findall(text)


class Automaton:
    """Compiled merges of a byte-level BPE vocabulary file."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model, letters = spec["model"], byte_letters()
        kind = (spec["pre_tokenizer"] or {}).get("type"), model["type"], spec["normalizer"], model.get("ignore_merges", False)
        if kind != ("ByteLevel", "BPE", None, False) or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError(f"not a plain byte-level BPE vocabulary: {path}")
        back = {c: b for b, c in enumerate(letters)}
        vocab = model["vocab"]
        self.labels: dict[int, bytes] = {i: bytes(back[c] for c in t) for t, i in vocab.items()}
        self.special: dict[str, int] = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.labels |= {i: t.encode() for t, i in self.special.items()}
        self._compile([tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]], vocab, letters)
        self._ends = ahocorasick.Automaton()
        for i in self.left:
            self._ends.add_word(self.labels[i].decode("latin-1"), (len(self.labels[i]), i, self._spine(i)))
        self._ends.make_automaton()

    def _compile(self, merges, vocab, letters) -> None:
        # left[t]: the first half of a merged label, None for a byte; made[t]: the merge that made it
        self.left: dict[int, int | None] = {vocab[c]: None for c in letters}
        self.made: dict[int, int] = {}
        self.spines: dict[int, tuple[tuple[int, int], ...]] = {}
        start: dict[int, int] = {}  # a state: label cut from it -> the merge that cut it
        self.start = start
        self.after: dict[int, dict[int, int]] = dict.fromkeys(self.left, start)
        for step, (a, b) in enumerate(merges):
            u, v, uv = vocab[a], vocab[b], vocab[a + b]
            if u not in self.left or v not in self.left or uv in self.left or not self.has_arc(self.after[u], v):
                continue
            beyond = self.after[v]
            self.after[u] = {**self.after[u], v: step}
            self.left[uv], self.made[uv], self.after[uv] = u, step, beyond

    def has_arc(self, state: dict[int, int], label: int) -> bool:
        """Whether ``state`` has an arc ``label``: neither it nor, when it was made, its first half had been cut."""
        return all(state.get(part, bound) >= bound for part, bound in self._spine(label))

    def _spine(self, label: int) -> tuple[tuple[int, int], ...]:
        """The label and its first halves down to a byte, each with the merge before which a cut of it counts."""
        found = self.spines.get(label)
        if found is None:
            first, never = self.left[label], 1 << 60
            rest = () if first is None else tuple((p, min(b, self.made[label] + 1)) for p, b in self._spine(first))
            found = self.spines[label] = ((label, never), *rest)
        return found

    def word(self, data: bytes) -> list[int]:
        """Ids of one pre-split word."""
        n = len(data)
        came: list[tuple[int, int] | None] = [None] * (n + 1)  # by end: start and label of the arc
        states: list[dict[int, int] | None] = [self.start] + [None] * n
        for end, (size, label, spine) in self._ends.iter(data.decode("latin-1")):
            end += 1
            before = states[end - size]
            if before is None or states[end] is not None:
                continue
            for part, bound in spine if before else ():
                if before.get(part, bound) < bound:
                    break
            else:
                came[end], states[end] = (end - size, label), self.after[label]
        out, at = [], n
        while at:
            at, label = came[at]
            out.append(label)
        return out[::-1]


class Encoder:
    """Whole texts to ids and back, with a bounded store of words."""

    def __init__(self, path: str, held: int = HELD_WORDS):
        self.machine = Automaton(path)
        self.held = held
        self._split = Splitter()
        special = sorted(self.machine.special, key=len, reverse=True)
        self._special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self._words: dict[str, bytes] = {}
        self._chunks = Chunks(self.plain, held)

    def plain(self, text: str) -> bytes:
        """Little-endian 32-bit ids of a text that is split by the pattern, special strings as themselves."""
        if any(s in text for s in self.machine.special):
            m = self._special.search(text)
            return self.plain(text[: m.start()]) + self._raw([self.machine.special[m[0]]]) + self.plain(text[m.end() :])
        words = self._split(text)
        if len(words) == 1:  # the caller stores it
            return self._raw(self.machine.word(text.encode()))
        out = []
        for word in words:
            got = self._words.get(word)
            if got is None:
                if len(self._words) >= self.held:
                    self._words.clear()
                got = self._words[word] = self._raw(self.machine.word(word.encode()))
            out.append(got)
        return b"".join(out)

    @staticmethod
    def _raw(ids: list[int]) -> bytes:
        return pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        return self._chunks.encode(text)

    def decode(self, ids: bytes) -> str:
        labels = self.machine.labels
        return b"".join(map(labels.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


class _Unsafe(Exception):
    pass


class Chunks(dict):
    """Encoded pieces between single spaces, by piece; a piece stands for itself with one space before it.

    Pre-split words never go on past a space that has no white space around it, so the pieces between such spaces
    encode on their own. A text with other white space next to a space is encoded whole. A full store becomes the older
    one, from which pieces that come again are taken back, so frequent pieces stay.
    """

    def __init__(self, encode, held: int):
        self._encode, self._held = encode, held
        self._marks: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        got = self._older.get(piece)
        if got is None:
            if not piece or piece[0].isspace() or piece[-1].isspace():
                raise _Unsafe
            body = piece.rstrip(".,;:!?")
            if len(body) < len(piece) and body.isalpha():  # letters and closing marks are words of their own
                got = self[body] + self._mark(piece[len(body) :])
                if len(piece) > 6:  # short ones come again and again; long ones would crowd the store
                    return got
            else:
                got = self._encode(" " + piece)
        if len(self) >= self._held:
            self._older = dict(self)
            self.clear()
        self[piece] = got
        return got

    def _mark(self, mark: str) -> bytes:
        got = self._marks.get(mark)
        if got is None:
            got = self._encode(mark)
            if len(self._marks) < 10_000:
                self._marks[mark] = got
        return got

    def encode(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        if rest and (not first or first[-1].isspace()):
            return self._encode(text)
        try:
            return self._encode(first) + b"".join(map(self.__getitem__, rest))
        except _Unsafe:
            return self._encode(text)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of a vocabulary file, compiled once per worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def round_trip(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, n_tokens, ids_sha256, decoded_sha256)`` of every whole text.

    A null text counts as empty: no tokens, and the digests of nothing. Each row stands for itself, so repeated rows
    and null keys need no care. Memory is that of one Arrow batch and of the bounded stores of words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(path)
        for batch in batches:
            for part in slices(batch):
                sizes, marks, backs = [], [], []
                for value in part.column(1):
                    ids = tool.encode(value.as_py() or "")
                    sizes.append(len(ids) // 4)
                    marks.append(sha256(ids).hexdigest())
                    backs.append(sha256(tool.decode(ids).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes, pa.int64()), pa.array(marks), pa.array(backs)],
                    names=[key, "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def ids(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, ids, decoded)``: the ids of every whole text as an array, and the text they decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(path)
        for batch in batches:
            for part in slices(batch):
                found = [tool.encode(v.as_py() or "") for v in part.column(1)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in found], pa.list_(pa.int32())),
                        pa.array([tool.decode(x) for x in found], pa.string()),
                    ],
                    names=[key, "ids", "decoded"],
                )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>, decoded string")
