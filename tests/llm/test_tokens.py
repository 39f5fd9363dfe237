"""Token files, token counts and the BPE automaton against the tokenizers' own libraries."""

import random
from hashlib import sha256
from zlib import crc32

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from conftest import SMALL
from tastegrid.llm import bpe, token_counts, token_files

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "n_tokens int, doc_id long, text string, start long"
ODD = [
    None, "", " ", "a", "a  b", "\n\n x", "x \n", "don't stop", "é ß 漢字", "😀😀 ok", "a<|endoftext|> b", "<|endoftext|>", "▁ ▁a", "tab\tx",
    "\x00\x1c\x85", "word " * 50, "nospaces" * 400, "aaaa" * 300, "a" * 3001, "￿ ໠ ꟛ", "The the THE",
]


@pytest.fixture(scope="module")
def odd(frame):
    rows = [(7, i, t, 1) for i, t in enumerate(ODD)] + [(7, 3, "a", 1), (7, None, "null key", 1), (7, 5, "other text", 1)]
    return frame(rows, SCHEMA)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BYTES)


def texts():
    return pd.read_parquet(f"{SMALL}/documents.parquet")["text"].tolist()


def test_automaton_is_the_library(library):
    tool, rnd = bpe.Encoder(BYTES, held=500), random.Random(5)
    parts = [*"ab 1\n\t'é漢😀", "  ", "'s", "<|endoftext|>", "the", "İ", "́", "‍", "!!", "\x85", "᠎", "ing", "\x1c"]
    mixed = ["".join(rnd.choices(parts, k=rnd.randint(0, 12))) for _ in range(4000)]
    for t in [*texts(), *(t or "" for t in ODD), *mixed]:
        ids = library.encode(t, add_special_tokens=False).ids
        got = tool.encode(t)
        assert np.frombuffer(got, "<u4").tolist() == ids, t
        assert tool.decode(got) == library.decode(ids, skip_special_tokens=False)


def test_gadgets_accept_exactly_one_path(library):
    """Of all ways to spell a word in labels, the automaton accepts the merged one only."""
    machine = bpe.Automaton(BYTES)
    spelled = {v: k for k, v in machine.labels.items() if k in machine.left}

    def paths(word, state):
        if not word:
            yield []
        for n in range(1, len(word) + 1):
            label = spelled.get(word[:n])
            if label is not None and machine.has_arc(state, label):
                for rest in paths(word[n:], machine.after[label]):
                    yield [label, *rest]

    for word in ["hello", " thinking", "aaaaaaa", " tionsh", "ßé", "banana"]:
        assert list(paths(word.encode(), machine.start)) == [library.encode(word, add_special_tokens=False).ids]


def test_round_trip_rows(odd, library, frame):
    got = bpe.round_trip(odd, BYTES).toPandas()
    assert len(got) == len(ODD) + 3
    want = []
    for r in odd.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want.append((r.doc_id, len(ids), sha256(np.array(ids, "<u4").tobytes()).hexdigest(), sha256(back.encode()).hexdigest()))
    key = lambda x: (str(x[0]), *x[1:])
    rows = [(None if pd.isna(a) else int(a), b, c, d) for a, b, c, d in got.itertuples(index=False)]
    assert sorted(rows, key=key) == sorted(want, key=key)
    assert bpe.round_trip(frame([], SCHEMA), BYTES).count() == 0
    whole = bpe.ids(odd, BYTES).toPandas()
    assert set(whole["decoded"]) == {(r.text or "") for r in odd.collect()}


def test_elias_fano():
    rnd = np.random.default_rng(1)
    for n, top in [(1, 0), (1, 9), (2, 1), (500, 3), (1000, 10**6), (64, 64), (65, 2**31)]:
        values = np.sort(rnd.integers(0, top + 1, n))
        ef = token_files.EliasFano(*token_files.EliasFano.build(values).parts())
        assert ef.select(0, n).tolist() == values.tolist()
        for i in {0, n // 2, n - 1}:
            assert ef.select(i)[0] == values[i]
            assert ef.select(i, n - i).tolist() == values[i:].tolist()
    assert token_files.EliasFano.build(np.array([], np.int64)).select(0, 0).tolist() == []
    big = token_files.EliasFano.build(np.arange(0, 10**6, 100))
    assert 8 * (len(big.lower) + len(big.upper) + 4 * len(big.pointers)) < 10_000 * 12


def test_packer_is_the_library(library):
    tool, rnd = token_files.Packer(BYTES, 0), random.Random(6)
    parts = [*"ab é漢ßªİ\n'", "  ", "'s", "<|endoftext|>", " the", "ing", ".", "ꟛ", "1", "ء"]
    for t in [*texts(), *(t or "" for t in ODD), *("".join(rnd.choices(parts, k=rnd.randint(0, 9))) for _ in range(4000))]:
        assert np.frombuffer(tool.encode(t), "<u2").tolist() == library.encode(t, add_special_tokens=False).ids, t


@pytest.mark.parametrize("segment", [1 << 20, 37])
def test_token_files(spark, odd, library, tmp_path, monkeypatch, frame, segment):
    monkeypatch.setattr(token_files, "SEGMENT_TOKENS", segment)  # tests run in threads of this process only for the plan
    token_files.write(odd, BYTES, str(tmp_path / "files"))
    got = token_files.read(spark, str(tmp_path / "files")).toPandas().sort_values("start")
    rows = sorted(odd.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or ""))
    at, want = 0, []
    for r in rows:
        ids = np.array(library.encode(r.text or "", add_special_tokens=False).ids + [0], "<u4")
        want.append((r.doc_id, at, len(ids), crc32(ids.tobytes())))
        at += len(ids)
    assert [(None if pd.isna(a) else int(a), *x) for a, *x in got.itertuples(index=False)] == want
    token_files.write(frame([], SCHEMA), BYTES, str(tmp_path / "none"))
    assert token_files.read(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("huge, chunk, overlap", [(65_536, 32_768, 512), (50, 40, 6), (300, 64, 1), (10, 3000, 20)])
def test_token_counts(odd, spark, frame, huge, chunk, overlap):
    model = SentencePieceProcessor(model_file=PIECES)
    docs = odd.select("doc_id", "text", "start").union(spark.read.parquet(f"{SMALL}/documents.parquet").selectExpr("doc_id + 1000", "text", "1L"))
    got = token_counts.count(docs, PIECES, huge=huge, chunk=chunk, overlap=overlap, limit=900).toPandas()
    want = sorted(
        (str(r.doc_id), len((r.text or "").encode()), n := len(model.encode(r.text or "")), n > 900) for r in docs.collect()
    )
    assert sorted((str(None if pd.isna(a) else int(a)), *x) for a, *x in got.itertuples(index=False)) == want
    assert token_counts.count(frame([], SCHEMA), PIECES).count() == 0
