import hashlib
import json
import time
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import bpe, bpe_codec, packing, token_counts, token_files

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = {WORD: Tokenizer.from_file(WORD), BYTE: Tokenizer.from_file(BYTE)}
ODD = [
    None, "", " ", "  a", "a  b", "a \n b\n\n c  ", "Don't they'll I'VE", "<|endoftext|>hi <|startoftext|> x<|endoftext|>", "ΣΑΣ Σ", "é ½ ²x Ⅷa 漢字かな 🎉🎉 a\x1cb\x1d \x1f c",
    "x" * 700, "ab" * 400 + "é" * 77, "İstanbul", " a b", "foo\n  bar \tbaz", "__init__ a_b 12345 ١٢", "\x85x\x85 y", "a​b ﻿", "'s 's'S 'll", " \n", "\n ", "a\n ", "a\0b \0", "same", "same",
]


ENCODERS = {(path, automaton): bpe.TextEncoder(path, automaton) for path in (WORD, BYTE) for automaton in (False, True)}


@lru_cache(maxsize=None)
def want(path, text):
    return LIBRARY[path].encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def docs(spark):
    # columns whose names the operators use themselves, and a long text
    rows = [(i, t, "key", i, "part") for i, t in enumerate([*ODD, "word and another one. " * 20_000])]
    return spark.createDataFrame(rows, "doc_id long, text string, key string, n long, part string").repartition(3)


@pytest.mark.parametrize("path", [WORD, BYTE])
@pytest.mark.parametrize("automaton", [False, True])
def test_encoders_equal_the_library(path, automaton):
    texts = [t or "" for t in ODD]
    ids, bound = ENCODERS[path, automaton].encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(bound, bound[1:])] == [want(path, t) for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("abcdeèßñ thing'sll 123\n\t _-.,!<|>ΣİÅ漢🎉́ "), max_size=60))
def test_encoders_equal_the_library_on_any_text(text):
    for (path, _), encoder in ENCODERS.items():
        assert encoder.encode([text])[0].tolist() == want(path, text)


def test_gadgets_decide_arcs():
    """The automaton has an arc exactly where two tokens stay apart when encoded together."""
    v = bpe.vocabulary(BYTE)
    machine, merger = bpe.MergeAutomaton(v), bpe.PairMerger(v)
    back = {c: b for b, c in enumerate(bpe.byte_symbols())}
    rng = np.random.default_rng(1)
    pairs = rng.integers(0, 50_000, (3000, 2))
    words = [bytes(back[c] for i in p for c in v.labels[i]) for p in pairs]
    ids, size = merger.encode(words)
    end = np.cumsum(size)
    apart = [n == 2 and ids[e - 2 : e].tolist() == p.tolist() for n, e, p in zip(size, end, pairs, strict=True)]
    assert machine.arc(pairs[:, 0].astype(np.int32), pairs[:, 1].astype(np.int32)).tolist() == apart


@pytest.mark.parametrize("seed", range(6))
def test_gadgets_applied_one_after_another(tmp_path, seed):
    """Arcs, steps and words of the automaton equal those of the explicit one, whose gadgets are applied in turn."""
    rng = np.random.default_rng(seed)
    shown = bpe.byte_symbols()
    ids, merges, tokens = {c: i for i, c in enumerate(shown)}, [], ["a", "b", "c"]
    while len(merges) < 24:
        a, b = (tokens[i] for i in rng.integers(0, len(tokens), 2))
        if a + b not in ids:
            ids[a + b] = len(ids)
            merges.append([a, b])
            tokens.append(a + b)
    file = tmp_path / "small.json"
    file.write_text(json.dumps({"model": {"vocab": ids, "merges": merges, "end_of_word_suffix": None}, "added_tokens": []}))
    v = bpe.Vocabulary(str(file))
    machine, merger = bpe.MergeAutomaton(v), bpe.PairMerger(v)
    arcs = bpe.apply_gadgets(list(range(256)), [(ids[a], ids[b], ids[a + b]) for a, b in merges])
    own = [ids[t] for t in tokens if ids[t] in arcs[0]]  # some merges never find their parts side by side
    s, t = (x.ravel().astype(np.int32) for x in np.meshgrid(own, own))
    want = [b in arcs[arcs[0][a]] for a, b in zip(s.tolist(), t.tolist(), strict=True)]
    assert machine.arc(s, t).tolist() == machine.step(s, t).tolist() == machine.step(s, t).tolist() == want
    assert [machine._arc_of_one(a, b) for a, b in zip(s.tolist(), t.tolist(), strict=True)] == want
    assert not all(want)
    text = {i: k for k, i in ids.items()}
    for n in (1, 5, 30, 90):
        word = "".join(rng.choice(list("abc"), n))
        at, path = {0: (0, [])}, None  # places reached: state and labels
        for i in range(n):
            state, labels = at.get(i, (None, []))
            for label, to in arcs[state].items() if state is not None else ():
                if word.startswith(text[label], i):
                    assert i + len(text[label]) < n or path is None  # one path leads to the end
                    at[i + len(text[label])] = to, [*labels, label]
                    path = at[n][1] if n in at else None
        assert machine.encode([word.encode()])[0].tolist() == merger.encode([word.encode()])[0].tolist() == path


def test_steps_share_a_full_table(monkeypatch):
    monkeypatch.setattr(bpe, "ARCS", 1 << 4)
    texts = ["the quick brown fox jumps over lazy dogs " * 3, "unbelievable tokenization of internationalization"]
    assert bpe.TextEncoder(BYTE, automaton=True).encode(texts)[0].tolist() == [i for t in texts for i in want(BYTE, t)]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_a_word_of_a_megabyte(path):
    text = "".join(np.random.default_rng(3).choice(list("abcdefghijklmnopqrstuvwxyz"), 1_000_000))
    expected = want(path, text)
    for automaton in (False, True):
        begun = time.time()
        assert ENCODERS[path, automaton].encode([text])[0].tolist() == expected
        assert time.time() - begun < 60
    assert bpe.PieceCounter(path).count([text]).tolist() == [len(expected)]


def test_frequencies_of_pretokens():
    counter = bpe.PieceCounter(BYTE)
    texts = ["a b a b a", "", "don't a<|endoftext|>", "b"]
    names = lambda: list(counter.pretoken)
    rows = list(zip(*(x.tolist() for x in counter.frequencies(texts)), strict=True))
    assert {(t, names()[p]): n for t, p, n in rows if t == 0} == {(0, "a"): 1, (0, " a"): 2, (0, " b"): 2}
    assert len(rows) == len({r[:2] for r in rows})
    assert counter.count(texts).tolist() == [len(want(BYTE, t)) for t in texts]


def test_round_trip_digests(docs):
    for r in bpe_codec.round_trip_digests(docs, WORD).collect():
        ids = want(WORD, docs.where(f"doc_id = {r.doc_id}").first().text)
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4")).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(LIBRARY[WORD].decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_encode_decode(docs):
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in bpe_codec.decode(bpe_codec.encode(docs, WORD), WORD).collect():
        assert r.text == LIBRARY[WORD].decode(want(WORD, texts[r.doc_id]), skip_special_tokens=False)


def test_counts(docs):
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in token_counts.count_tokens(docs, BYTE).collect():
        n = len(want(BYTE, texts[r.doc_id]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((texts[r.doc_id] or "").encode()), n, n > 512)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**17), max_size=900), st.integers(50, 100))
def test_blocks_round_trip(ids, percentile):
    ids = np.array(ids, np.uint32)
    assert token_files.unpack_blocks(*token_files.pack_blocks(ids, percentile))[: len(ids)].tolist() == ids.tolist() if len(ids) else token_files.pack_blocks(ids) == (b"",) * 4


def test_outliers_are_patched():
    ids = np.concatenate((np.arange(250), [49_000] * 4, np.arange(700))).astype(np.uint32)
    index, packed, places, highs = token_files.pack_blocks(ids)
    assert len(places) >= 4 and len(packed) < 2 * len(ids)
    assert token_files.unpack_blocks(index, packed, places, highs)[: len(ids)].tolist() == ids.tolist()


def test_token_files(docs):
    texts, at = {r.doc_id: r.text for r in docs.collect()}, 0
    for r in sorted(token_files.write_and_read(docs, WORD, 1).collect()):
        ids = [*want(WORD, texts[r.doc_id]), 1]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4")))
        at += len(ids)


def test_segments_follow_each_other(docs, monkeypatch):
    monkeypatch.setattr(token_files, "SEGMENT", 64)
    assert token_files.segments(docs, WORD, 1).count() > 3
    test_token_files(docs)


def check_packing(docs, out, width):
    texts, sequences, pieces = {r.doc_id: r.text for r in docs.collect()}, defaultdict(list), defaultdict(list)
    for r in out:
        ids = np.array([*want(BYTE, texts[r.doc_id]), 0], "<u4")
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length])
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append((r.start, r.length))
    for places in [*sequences.values(), *pieces.values()]:
        at = 0
        for begin, n in sorted(places):
            assert begin == at
            at += n
    assert all(sum(n for _, n in x) <= width for x in sequences.values())
    assert sorted(sequences) == list(range(len(sequences))) and sorted(pieces) == sorted(texts)


def test_packing(docs):
    check_packing(docs, packing.pack_documents(docs, BYTE, 0, 128).collect(), 128)


def test_shortest_pack_first():
    patterns = packing.shortest_pack_first({10: 5, 6: 2, 4: 3, 3: 1}, 10)
    used = defaultdict(int)
    for n, p in patterns:
        assert sum(p) <= 10
        for x in p:
            used[x] += n
    assert dict(used) == {10: 5, 6: 2, 4: 3, 3: 1} and sum(n for n, _ in patterns) == 8


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert bpe_codec.round_trip_digests(none, WORD).count() == token_counts.count_tokens(none, BYTE).count() == 0
    assert token_files.write_and_read(none, WORD, 1).count() == packing.pack_documents(none, BYTE, 0).count() == 0
