import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import alignment
from tidemark.llm.bpe import byte_symbols

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    None, "", " ", "   ", "a", " a", "a ", "a  ", "one two  three", "tabs\tand\nlines \n  here", "\n \n", "ﬁ Å é 日本 𠮷 🙂", "a▁b c", "▁", "<s>x</s> <|endoftext|> <0x41>", "nul\x00 x\x1c y",
    "don't WON'T 12345 $$$ ###", "x" * 3000, "word " * 5000, "no break space 　wide", "same text of copies", "same text of copies", "same text of copies", "cr\r\nlf \r\n end",
]


def brute(texts):
    """Row by row with both libraries: counts, links and groups of each text."""
    a_tok, b_tok = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_tok.encode_special_tokens = True
    byte = {c: b for b, c in enumerate(byte_symbols())}
    names = {i: t for t, i in a_tok.get_vocab().items()}
    piece = lambda i: bytes([int(b_tok.id_to_piece(i)[3:5], 16)]) if b_tok.is_byte(i) else b_tok.id_to_piece(i).replace("▁", " ").encode()
    out, count = [], Counter()
    for t in texts:
        a, b = (a_tok.encode(" " + t, add_special_tokens=False).ids, b_tok.encode(t)) if t else ([], [])
        x, y = [bytes(byte[c] for c in names[i]) for i in a], [piece(i) for i in b]
        if not t or not b"".join(x) == b"".join(y) == (" " + t).encode():
            out.append(None)
            continue
        spans = []
        for tokens in (x, y):
            at, own = 0, []
            for token in tokens:
                own.append((at, at + len(token)))
                at += len(token)
            spans.append(own)
        links, k = [], 0
        for i, (lo, hi) in enumerate(spans[0]):
            while spans[1][k][1] <= lo:
                k += 1
            j = k
            while j < len(b) and spans[1][j][0] < hi:
                links.append((a[i], b[j]))
                j += 1
        both = {e for _, e in spans[0]} & {e for _, e in spans[1]}
        groups, ga, gb = defaultdict(lambda: ([], [])), 0, 0
        for tokens, span, side in ((a, spans[0], 0), (b, spans[1], 1)):
            n = 0
            for i, (_, end) in zip(tokens, span, strict=True):
                groups[n][side].append(i)
                n += end in both
        text = ";".join(f"{','.join(map(str, groups[n][0]))}|{','.join(map(str, groups[n][1]))}" for n in sorted(groups))
        count.update(links)
        out.append((len(a), len(b), len(groups), links, text))
    most = defaultdict(int)
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    return [(0, 0, 0, 0, 0, 0, "") if r is None else (*r[:3], len(r[3]), sum(count[x] == most[x[1]] for x in r[3]), sum(count[x] for x in r[3]), r[4]) for r in out], count, most


def rows(df):
    return [(r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups) for r in sorted(df.collect(), key=lambda r: r.doc_id)]


def test_alignment_equals_both_libraries(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").withColumns({"key": F.lit("k"), "digest": F.lit(1), "n_a": F.lit(7), "block": F.lit("b")}).repartition(3)
    want, count, most = brute(TEXTS)
    assert rows(alignment.align(docs, A, B, digest=False)) == want
    digests = [hashlib.sha256(w[6].encode()).hexdigest() if w[6] else "" for w in want]
    assert [r[6] for r in rows(alignment.align(docs, A, B))] == digests
    pairs = alignment.pair_counts(alignment.aligned_blocks(docs, A, B)).collect()
    assert {(r.a_id, r.b_id): (r["count"], r.best) for r in pairs} == {k: (n, n == most[k[1]]) for k, n in count.items()}


def test_small_blocks_give_the_same(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want, _, _ = brute([r.text for r in docs.orderBy("doc_id").collect()])
    monkeypatch.setattr(alignment, "BLOCK_STRETCHES", 50)
    assert rows(alignment.align(docs, A, B, digest=False)) == want


def test_rare_texts_are_joined_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(alignment, "HOT_SHARE", 1)
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    assert rows(alignment.align(docs, A, B, digest=False)) == brute(TEXTS)[0]


def test_alignment_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align(none, A, B).collect() == []
    odd = spark.createDataFrame([(None, "a b"), (None, None), (1, ""), (1, "a b")], "doc_id long, text string")
    got = sorted((r.doc_id is None, r.n_a, r.n_b) for r in alignment.align(odd, A, B).collect())
    assert got == [(False, 0, 0), (False, 2, 2), (True, 0, 0), (True, 2, 2)]


def test_other_models_are_refused():
    with pytest.raises(ValueError):
        alignment.Tokenizers(public_tokenizers.path("word_bpe_49k.json"), B)
