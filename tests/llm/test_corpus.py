"""Token alignment, languages and source divergence against brute force."""

import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter
from fractions import Fraction
from math import floor

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from messy import ROWS, empty, messy, prose
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from tidemill.llm import alignment, divergence, language
from tidemill.llm.packing import byte_letters

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


# -- alignment --------------------------------------------------------------


def tokens(rows):
    """Ids and bytes of each text's tokens, by the libraries."""
    a, b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    byte_of = {letter: byte for byte, letter in byte_letters().items()}
    for doc_id, text in rows:
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        bytes_a = [bytes(byte_of[c] for c in a.id_to_token(i)) for i in ids_a]
        pieces = [b.id_to_piece(i) for i in ids_b]
        bytes_b = [
            bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()
            for p in pieces
        ]
        if text and not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            ids_a = ids_b = bytes_a = bytes_b = []
        yield doc_id, ids_a, bytes_a, ids_b, bytes_b


def alignment_truth(rows):
    docs, corpus = [], Counter()
    for doc_id, ids_a, bytes_a, ids_b, bytes_b in tokens(rows):
        ends_a = np.cumsum([len(x) for x in bytes_a], dtype=int).tolist()
        ends_b = np.cumsum([len(x) for x in bytes_b], dtype=int).tolist()
        pairs, cuts = [], sorted(set(ends_a) & set(ends_b))
        for i, end in enumerate(ends_a):
            begin = end - len(bytes_a[i])
            for j, other in enumerate(ends_b):
                if begin < other and other - len(bytes_b[j]) < end:
                    pairs.append((ids_a[i], ids_b[j]))
        written, low = [], 0
        for cut in cuts:
            sides = [
                ",".join(str(k) for k, e in zip(ids, ends, strict=True) if low < e <= cut)
                for ids, ends in ((ids_a, ends_a), (ids_b, ends_b))
            ]
            written.append("|".join(sides))
            low = cut
        corpus.update(pairs)
        sha = hashlib.sha256(";".join(written).encode()).hexdigest() if ids_a else ""
        docs.append((doc_id, len(ids_a), len(ids_b), len(cuts), pairs, sha))
    most = {}
    for (_, b), n in corpus.items():
        most[b] = max(most.get(b, 0), n)
    return sorted(
        (
            doc_id or -1, n_a, n_b, n_groups, len(pairs),
            sum(corpus[p] == most[p[1]] for p in pairs), sum(corpus[p] for p in pairs), sha,
        )
        for doc_id, n_a, n_b, n_groups, pairs, sha in docs
    )


def scored(docs, **options):
    digests = alignment.align_digests(docs, A, B)
    apart = alignment.alignment_digests(alignment.align_documents(docs, A, B))
    assert sorted(map(str, digests.collect())) == sorted(map(str, apart.collect()))
    return sorted(
        (r.doc_id or -1, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256)
        for r in alignment.with_pair_sums(digests, **options).collect()
    )


ODD = [
    *[(i, t) for i, t in ROWS if t is None or len(t) < 5000],
    (201, "▁"), (202, "a ▁b"), (203, "<|endoftext|> <s> <unk> <0x41> </s>x"), (204, " lead"),
    (205, "trail  "), (206, "\t\n "), (207, "日本語のテキスト" * 30), (208, "naïve café œuvre 🎉🎉"),
    (209, "a\x00b \x7f\x80"), (210, "unbelievable internationalisation 1234567 3.14159"),
]


def test_alignment_is_that_of_all_overlaps(spark):
    docs = spark.createDataFrame([(*r, "x") for r in ODD], "doc_id long, text string, row string")
    truth = alignment_truth(ODD)
    assert scored(docs.repartition(3)) == truth
    assert scored(docs, broadcast_rows=200) == truth
    assert scored(docs, broadcast_rows=0) == truth


def test_alignment_of_random_texts(spark):
    rng = random.Random(5)
    letters = "abcdeé  .,日\n'1ABC<s>▁🎉"
    rows = [(i, "".join(rng.choice(letters) for _ in range(rng.randrange(80)))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert scored(docs) == alignment_truth(rows)


def test_alignment_gives_ids_and_links(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "hello alignment, welcome"), (2, None)], "doc_id long, text string")
    whole, none = sorted(alignment.align_documents(docs, A, B).collect())
    (_, ids_a, bytes_a, ids_b, bytes_b), _ = tokens([(1, "hello alignment, welcome"), (2, None)])
    assert (whole.a_ids, whole.b_ids) == (ids_a, ids_b)
    assert none.a_ids == none.b_ids == none.link_a == none.link_b == []
    for i, j in zip(whole.link_a, whole.link_b, strict=True):
        assert bytes_a[i] in bytes_b[j] or bytes_b[j] in bytes_a[i]
    monkeypatch.setattr(alignment, "SEGMENT", 2)
    both = alignment.Tokenizers(A, B)
    (cut,) = both.aligned(["hello alignment, welcome to all of it"])
    monkeypatch.setattr(alignment, "SEGMENT", 100)
    monkeypatch.setattr(alignment, "REMEMBER", 0)
    (whole,) = alignment.Tokenizers(A, B).aligned(["hello alignment, welcome to all of it"])
    assert all((x == y).all() for x, y in zip(cut, whole, strict=True))


def test_ids_by_ranks_are_the_library_s():
    rng, both = random.Random(8), alignment.Tokenizers(A, B)
    letters = "abcdefeinstÀéßÿÖAB019.,;:!?'\"()/\n-"
    assert both.a_ranks is not None
    for _ in range(5000):
        part = "".join(rng.choice(letters) for _ in range(rng.randrange(1, 15)))
        assert both.ids_of_a([part]) == [both.a.encode(" " + part, add_special_tokens=False).ids]


def test_run_skipping_on_end_arrays():
    rng = random.Random(9)
    for _ in range(300):
        last = rng.randrange(1, 60)
        ends = [sorted({*rng.sample(range(1, last + 1), rng.randrange(1, last + 1)), last}) for _ in "ab"]
        if rng.random() < 0.3:
            ends[1] = list(ends[0])
        got = list(zip(*alignment.align(*ends), strict=True))
        spans = [list(zip([0, *e], e, strict=False)) for e in ends]
        assert got == [
            (i, j) for i, (a, b) in enumerate(spans[0]) for j, (c, d) in enumerate(spans[1]) if a < d and c < b
        ]


def test_alignment_of_nothing(spark):
    assert scored(empty(spark)) == []


# -- languages --------------------------------------------------------------


def in_languages(spark):
    """Messy rows with a language for some of them, and columns of clashing names."""
    return messy(spark).withColumns(
        {
            "lang": F.when(F.col("doc_id") % 3 == 0, "xx").when(F.col("doc_id") % 3 == 1, "yy"),
            "source": F.concat(F.lit("s"), (F.col("doc_id") % 4).cast("string")),
            "score": F.lit("clash"), "lang_pred": F.lit(1), "lettered": F.lit(2), "__hash": F.lit(3),
        }
    )


def normalised(text):
    out = bytearray()
    for byte in text.encode():
        if byte >= 128 or chr(byte).isalpha():
            out.append(byte | 32 if byte < 128 else byte)
        elif out and out[-1] != 32:
            out.append(32)
    return bytes(out)


def parsed(text, known, run):
    """Phrases of ``text`` by looking each up in the labelled text."""
    n = 0
    for start in range(0, len(text), run):
        part, at = text[start : start + run], 0
        while at < len(part):
            end = at + 1
            while end < len(part) and part[at : end + 1] in known:
                end += 1
            n, at = n + 1, end
    return n


def test_phrases_are_longest_matches(spark):
    docs = in_languages(spark)
    model = language.learn(docs, train_rows=20, excerpt=60)
    excerpts = {}
    for r in language.training_rows(docs, 20, 60).collect():
        excerpts.setdefault(r.lang, []).append(normalised(r.excerpt))
    known = {lang: b"\n".join(rows) for lang, rows in excerpts.items()}
    assert model.langs == ["xx", "yy"]
    assert model.sizes.tolist() == [sum(map(len, excerpts[lang])) for lang in model.langs]
    got = {}
    for r in language.predict(docs, model, run=50).collect():
        got.setdefault(r.doc_id, []).append(r)
    for doc_id, text in ROWS:
        if text is not None and len(text) > 5000:
            continue
        clean = normalised(text or "")
        counts = [parsed(clean, known[lang], 50) for lang in model.langs]
        assert any(r.phrases == counts and r.n_bytes == len(clean) for r in got[doc_id])
        row = next(r for r in got[doc_id] if r.phrases == counts)
        if text is None or not re.search(r"[^\W\d_]", text):
            assert (row.lang_pred, row.score) == ("und", 0.0)
        else:
            costs = [c * np.log2(n + 2) for c, n in zip(counts, model.sizes, strict=True)]
            assert row.lang_pred == model.langs[int(np.argmin(costs))]
            assert 0 <= row.score <= 1 and row.score == pytest.approx(1 - min(costs) / max(costs))


def test_automaton_reads_exactly_the_substrings():
    rng = random.Random(2)
    for _ in range(20):
        text = bytes(rng.choice(b"abc\n") for _ in range(rng.randrange(1, 60)))
        moves = language.suffix_automaton(text)
        base, owner, target = language.displaced(moves)
        for state, own in enumerate(moves):
            for byte in range(256):
                slot = base[state] + byte
                there = slot < len(owner) and owner[slot] == state
                assert there == (byte in own) and (not there or target[slot] == own[byte])
        for _ in range(50):
            word = bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 6)))
            state = 0
            for byte in word:
                state = moves[state].get(byte) if state is not None else None
            assert (state is not None) == (word in text)


def test_training_rows_are_bounded_and_distinct(spark):
    copies = spark.range(20_000).select(F.lit("xx").alias("lang"), F.lit("one text").alias("text"))
    others = spark.range(3000).select(
        F.when(F.col("id") % 2 == 0, "xx").alias("lang"), F.concat_ws(" ", F.lit("n"), F.col("id")).alias("text")
    )
    rows = language.training_rows(copies.union(others).repartition(7), 50, 10)
    taken = [tuple(r) for r in rows.collect()]
    assert 45 <= len(taken) <= 50 and {lang for lang, _ in taken} == {"xx"}
    assert len(set(taken)) > 40
    again = language.training_rows(others.union(copies).repartition(3), 50, 10)
    assert sorted(taken) == sorted(tuple(r) for r in again.collect())


def test_languages_of_nothing(spark):
    docs = empty(spark).withColumn("lang", F.lit(None).cast("string"))
    model = language.learn(docs)
    assert model.langs == [] and language.predict(docs, model).count() == 0
    some = language.predict(messy(spark), model).collect()
    assert len(some) == len(ROWS) and {(r.lang_pred, r.score) for r in some} == {("und", 0.0)}
    one = language.learn(messy(spark).withColumn("lang", F.lit("only")))
    assert {(r.lang_pred, r.score) for r in language.predict(messy(spark), one).collect()} == {
        ("only", 1.0), ("und", 0.0)
    }


def test_held_out_languages_are_found(spark, sf_dir):
    from tidemill.llm.queries import QUERIES

    got = {r.doc_id: r for r in QUERIES["op12_language_id"].run(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(got) == len(docs)
    right = [got[r.doc_id].lang_pred == r.lang for r in docs if got[r.doc_id].held_out]
    assert len(right) > 100 and sum(right) >= 0.98 * len(right)
    for r in docs:
        assert got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)


# -- divergence -------------------------------------------------------------


def divergence_truth(rows, least, top):
    docs = [
        (lang or "", source or "", [
            m.translate(LOWER) for m in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")
        ])
        for text, lang, source in rows
    ]
    out = []
    for lang in {d[0] for d in docs}:
        df, whole, by_source = Counter(), Counter(), {}
        for _, source, terms in (d for d in docs if d[0] == lang):
            df.update(set(terms))
            whole.update(terms)
            by_source.setdefault(source, Counter()).update(terms)
        kept = [t for t in df if df[t] >= least]

        def rated(counts, kept=kept):
            total = sum(counts[t] for t in kept) + len(kept)
            return {t: 1 + floor(Fraction(10**9 * (counts[t] + 1), total)) for t in kept}

        q = rated(whole)
        ps = {source: rated(counts) for source, counts in by_source.items()}
        for source, p in ps.items():
            pairs = [
                (o, sum((p[t] - r[t]) ** 2 // r[t] for t in kept)) for o, r in ps.items() if o != source
            ]
            terms = [
                (t, (p[t] - q[t]) ** 2 // q[t]) for t in kept if by_source[source][t] and p[t] > q[t]
            ]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, source, part, i, v, n) for n, (i, v) in enumerate(items[:most], 1)]
    return sorted(out)


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize(("least", "top"), [(3, 200), (1, 7), (10**6, 200)])
def test_divergence_of_messy_rows(spark, least, top):
    docs = in_languages(spark)
    rows = [(r.text, r.lang, r.source) for r in docs.collect()]
    got = divergence.divergence(docs, least, top)
    assert sorted(map(tuple, got.collect())) == divergence_truth(rows, least, top)


def test_counting_terms_takes_little_memory():
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randrange(1, 12))) for _ in range(20_000)]
    texts = [" ".join(rng.choices(words, k=2000)) for _ in range(1500)]
    batch = pa.RecordBatch.from_pydict({"text": texts, "lang": ["en"] * 1500, "source": ["a", "b", "c"] * 500})
    assert batch.nbytes > 16 << 20
    tracemalloc.start()
    try:
        found = sum(b.num_rows for b in divergence._counted(divergence.SHARD_BYTES)(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert found and peak < 128 << 20


def test_divergence_of_sources_that_share_little(spark):
    rows = [
        (f"{'É' if i % 5 else 'e'}toile common{i % 3} only{i % 7} ABCDEFGH abcdefgh abcdefghi", f"l{i % 2}", f"s{i % 7}")
        for i in range(60)
    ] + [("12 34", "l0", "empty"), (None, None, None), ("alone", "l3", "x"), ("", "", "y")]
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    assert sorted(map(tuple, divergence.divergence(docs).collect())) == divergence_truth(rows, 3, 200)
    nothing = docs.where("false")
    assert divergence.divergence(nothing).count() == 0


def test_pointer_sort_is_a_sort_of_terms(monkeypatch):
    monkeypatch.setattr(divergence, "SMALL", 8)
    rng = random.Random(3)
    stems = ["a", "abcdefgh", "abcdefghi", "abcdefghijklmnopqrst", "zé", "日本語日本語", "b" * 40]
    texts = [" ".join(rng.choice(stems) + rng.choice(["", "x", "yy"]) for _ in range(rng.randrange(60))) for _ in range(30)]
    texts += ["", "  ", prose(4, 50)]
    raw = [t.encode() for t in texts]
    data, starts, lengths, rows = divergence.pointers(
        np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    )
    spelt = [data[s : s + n].tobytes() for s, n in zip(starts, lengths, strict=True)]
    words = [re.findall(rb"[A-Za-z\x80-\xff]+", t) for t in raw]
    assert spelt == [w.lower() for ws in words for w in ws]
    assert rows.tolist() == [i for i, ws in enumerate(words) for _ in ws]
    order, begins = divergence.term_runs(data, starts, lengths)
    in_order = [spelt[i] for i in order]
    assert order.tolist() == sorted(range(len(spelt)), key=lambda i: (spelt[i], i))
    assert begins.tolist() == [i for i, t in enumerate(in_order) if i == 0 or in_order[i - 1] != t]
