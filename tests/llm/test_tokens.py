"""Packing, byte-level BPE and token counts against the libraries."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
import tiktoken
from messy import ROWS, empty, messy
from tokenizers import Tokenizer

from tidemill.llm import bpe, packing, token_counts
from tidemill.llm.tokens import words

RANKS = P.path("byte_bpe_multi_50k.tiktoken")


def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def sha(data):
    return hashlib.sha256(data).hexdigest()


def bpe_truth(rows):
    encoding = library()
    for doc_id, text in rows:
        ids = encoding.encode_ordinary(text or "")
        yield (doc_id or -1, len(ids), sha(",".join(map(str, ids)).encode()),
               sha((text or "").encode()))


def as_rows(df):
    return sorted((r[0] or -1, *r[1:]) for r in df.collect())


def test_parts_join_to_the_text():
    for _, text in ROWS:
        assert " ".join(words(text or "")) == (text or "")


@pytest.mark.parametrize(("chunk", "overlap"), [(65_536, 1024), (200, 40), (60, 5)])
def test_bpe_is_the_library_s(spark, chunk, overlap):
    got = bpe.encode_all(messy(spark), RANKS, P.PATTERN, chunk, overlap)
    assert as_rows(got) == sorted(bpe_truth(ROWS))


def test_bpe_of_runs_longer_than_the_overlap(spark):
    rng = random.Random(4)
    rows = [(1, "a" * 500 + " b"), (2, " " * 300 + "x" * 7 + "\n" * 200 + "'stop 's"),
            (3, "".join(rng.choice("ab1 \n\t'.s é") for _ in range(3000)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = bpe.encode_all(docs, RANKS, P.PATTERN, 64, 8)
    assert as_rows(got) == sorted(bpe_truth(rows))


@pytest.mark.parametrize("chunk", [65_536, 90])
def test_ids_come_out_and_go_in(spark, chunk):
    encoding = library()
    encoded = bpe.encode_documents(messy(spark), RANKS, P.PATTERN, chunk, 30)
    assert sorted((r.doc_id or -1, r.ids) for r in encoded.collect()) == sorted(
        (i or -1, encoding.encode_ordinary(t or "")) for i, t in ROWS
    )
    raw = bpe.decode_documents(encoded, RANKS, P.PATTERN).collect()
    assert sorted((r.doc_id or -1, bytes(r.raw)) for r in raw) == sorted(
        (i or -1, (t or "").encode()) for i, t in ROWS
    )
    lists = spark.createDataFrame([(1, None), (2, []), (3, [65, 300])], "doc_id long, ids array<int>")
    found = {r.doc_id: bytes(r.raw) for r in bpe.decode_documents(lists, RANKS, P.PATTERN).collect()}
    assert found == {1: b"", 2: b"", 3: encoding.decode_bytes([65, 300])}
    unknown = spark.createDataFrame([(1, [10**6])], "doc_id long, ids array<int>")
    with pytest.raises(Exception, match="KeyError"):
        bpe.decode_documents(unknown, RANKS, P.PATTERN).collect()


def test_bpe_of_a_text_of_many_chunks(spark):
    text = " ".join(f"word{i} and 日本 {i % 7}\n" for i in range(60_000))
    docs = spark.createDataFrame([(1, text), (2, "x" * 300_000)], "doc_id long, text string")
    got = bpe.encode_all(docs, RANKS, P.PATTERN)
    assert as_rows(got) == sorted(bpe_truth([(1, text), (2, "x" * 300_000)]))


def test_bpe_of_nothing(spark):
    nothing = bpe.encode_documents(empty(spark), RANKS, P.PATTERN)
    assert bpe.decode_documents(nothing, RANKS, P.PATTERN).count() == 0
    assert bpe.encode_all(empty(spark), RANKS, P.PATTERN).count() == 0


def test_token_counts_are_the_library_s(spark):
    path = P.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    truth = sorted(
        (i or -1, len((t or "").encode()), len(model.encode(t or ""))) for i, t in ROWS
    )
    assert as_rows(token_counts.token_counts(messy(spark), path)) == truth
    assert as_rows(token_counts.token_counts(messy(spark), path, batch_bytes=50)) == truth
    assert token_counts.token_counts(empty(spark), path).count() == 0


def test_token_counts_of_odd_texts(spark):
    path = P.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice(" ▁ab\n\tthe<s>é日") for _ in range(rng.randrange(60))))
            for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs, path).collect()}
    assert got == {i: len(model.encode(t)) for i, t in rows}


def check_packing(rows, texts, longest=1024):
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ids = sorted(
        [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for _, t in texts
    )
    # pieces tile the documents
    by_doc = {}
    for r in rows:
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    tiles = []
    for (_, total), own in by_doc.items():
        covered = sum(r.length for r in own)
        assert covered % total == 0
        tiles += [total] * (covered // total)
    assert sorted(tiles) == sorted(map(len, ids))
    # and the sequences
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append(r)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= longest and at & (at - 1) == 0
        assert {r.tier for r in own} == {at} and len({r.step_group for r in own}) == 1
    return sequences


def test_packing(spark):
    got = packing.pack_documents(messy(spark), P.path("byte_bpe_50k.json")).collect()
    check_packing(got, ROWS)
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for i, t in ROWS}
    for r in got:
        if r.doc_id is not None:
            part = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")
            assert r.ids_crc32 == zlib.crc32(part.tobytes())
    with_ids = packing.pack_documents(messy(spark), P.path("byte_bpe_50k.json"), with_ids=True)
    assert with_ids.count() == len(got)
    for r in with_ids.collect():
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and len(r.ids) == r.length
    assert packing.pack_documents(empty(spark), P.path("byte_bpe_50k.json")).count() == 0


def test_packing_in_small_rounds(spark):
    got = packing.pack_documents(
        messy(spark), P.path("byte_bpe_50k.json"), (256, 64), pack_tokens=900, step_tokens=512
    ).collect()
    check_packing(got, ROWS, 256)


def test_pack_fills_windows_and_balances_steps():
    rng = random.Random(1)
    sizes = [rng.randrange(1, 3000) for _ in range(500)]
    windows = packing.pack(sizes)
    assert sum(w.size for w in windows) == sum(sizes)
    assert all(sum(p[2] for p in w.parts) == w.size for w in windows)
    covered = {}
    for w in windows:
        for doc, start, length in w.parts:
            covered.setdefault(doc, []).append((start, length))
    for doc, parts in covered.items():
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at == sizes[doc]
    groups = packing.step_groups(windows)
    work, tokens = {}, {}
    for w, g in zip(windows, groups, strict=True):
        if w.size == 1024:
            work[g] = work.get(g, 0) + w.work()
            tokens[g] = tokens.get(g, 0) + w.size
    assert max(work.values()) < 1.4 * min(work.values())
    assert max(tokens.values()) - min(tokens.values()) <= 1024
    assert packing.pack([]) == [] and packing.step_groups([]) == []


def test_special_strings_follow_the_library(spark):
    rows = [(1, "x <|endoftext|> y<|endoftext|>z"), (2, "plain")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = packing.pack_documents(docs, P.path("byte_bpe_50k.json")).collect()
    check_packing(got, rows)
