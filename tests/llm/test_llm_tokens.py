"""Byte-level BPE and token counts beside the public libraries."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from hypothesis import given, settings, strategies as st
from samples import clashing, empty_table, odd_rows, odd_table, rows_of

from leakscan.llm import bpe, token_count

TOKENS = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
PATTERN = public_tokenizers.PATTERN
REFERENCE = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={t: i for i, t in enumerate(TOKENS)}, special_tokens={})
ENCODER = bpe.Encoder(TOKENS, PATTERN)
PIECES = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
VOCABULARY = token_count.read_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
COUNTER = token_count.Counter(VOCABULARY, token_count.prove(VOCABULARY))


def unpacked(ids):
    return np.frombuffer(ids, "<u4").tolist()


@settings(max_examples=400, deadline=None)
@given(st.text(st.characters(max_codepoint=0x3000, exclude_categories=("Cs", "Cn")), max_size=60))
def test_ids_are_the_library_s(text):
    assert unpacked(ENCODER.encode(text)) == REFERENCE.encode_ordinary(text)


def test_long_and_repetitive_pre_tokens():
    rnd = random.Random(2)
    for text in ("a" * 5000, "ab" * 3000, "the" * 2000, " " * 3000, "".join(rnd.choice("etaoin") for _ in range(8000)), "é漢😀" * 500):
        assert unpacked(ENCODER.encode(text)) == REFERENCE.encode_ordinary(text)


def test_a_full_machine_reads_on():
    small = bpe.Transducer(ENCODER.machine.merges, limit=20)
    for word in ("hello", "entwicklung", "überraschung", "aeiouaeiou" * 10, "hello there", "é漢😀"):
        assert unpacked(small.run(word.encode())) == REFERENCE._encode_single_piece(word.encode())


def test_an_encoder_keeps_no_more_than_its_limits():
    few, rnd = bpe.Encoder(TOKENS, PATTERN, 30, 200), random.Random(5)
    for _ in range(60):
        text = " ".join("".join(rnd.choice("etaoinshr") for _ in range(rnd.randint(1, 12))) for _ in range(20))
        assert unpacked(few.encode(text)) == REFERENCE.encode_ordinary(text)
        assert len(few) <= 30 + 20 and len(few.machine.moves) <= 200


def test_output_is_late_by_less_than_the_longest_token():
    machine, state, out, longest = ENCODER.machine, 0, 0, max(map(len, TOKENS))
    for read, byte in enumerate(b"internationalisation" * 20, 1):
        state, ids = machine.moves.get(state << 8 | byte) or machine._move(state, byte)
        out += sum(len(TOKENS[i]) for i in unpacked(ids))
        assert read - out <= longest


def test_adjacent_is_what_merging_gives():
    merges, rnd = ENCODER.machine.merges, random.Random(4)
    for _ in range(3000):
        a, b = rnd.randrange(len(TOKENS)), rnd.randrange(len(TOKENS))
        assert merges.adjacent(a, b) == (merges._merged(TOKENS[a] + TOKENS[b], len(TOKENS)) == [a, b])


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=40), st.integers(1, 5))
def test_streamed_chunks_end_between_characters(data, chunk):
    single = {bytes([i]): i for i in range(256)}
    tokens = [bytes([i]) for i in range(256)]
    ids = np.array([single[bytes([b])] for b in data], "<u4").tobytes()
    parts = list(bpe.decode_stream(tokens, ids, chunk))
    assert b"".join(parts) == data
    assert "".join(p.decode(errors="replace") for p in parts) == data.decode(errors="replace")


def test_digests_of_odd_rows(spark):
    got = rows_of(bpe.digests(clashing(odd_table(spark)).drop("ids", "decoded"), TOKENS, PATTERN, ["doc_id"]))

    def row(key, text):
        ids = REFERENCE.encode_ordinary(text or "")
        return key, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()

    assert got == sorted((row(r[0], r[1]) for r in odd_rows()), key=repr)
    assert bpe.digests(empty_table(spark), TOKENS, PATTERN, ["doc_id"]).count() == 0


def test_encode_then_decode(spark):
    docs = odd_table(spark)
    back = bpe.decode(bpe.encode(docs, TOKENS, PATTERN, ["doc_id"]), TOKENS, ["doc_id"])
    assert rows_of(back.selectExpr("doc_id", "decode(decoded, 'UTF-8') AS t")) == sorted(((r[0], r[1] or "") for r in odd_rows()), key=repr)


def test_unfit_vocabularies_are_refused():
    with pytest.raises(ValueError):
        bpe.Merges([b"a", b"b"])
    with pytest.raises(ValueError):
        bpe.Merges([bytes([i]) for i in range(256)] + [b"abc"])


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=60))
def test_counts_are_the_library_s(text):
    assert COUNTER.count(text) == len(PIECES.encode(text))


def test_counts_of_runs_and_long_words():
    for text in ("", " ", "   ", " " * 4000, "▁a ▁", "<s> </s> <unk> <0x0A>", "thethe" * 4000, "\n\n\t x  y ", "x" * 3000, "漢" * 300, "ﬁ①\0"):
        assert COUNTER.count(text) == len(PIECES.encode(text)), text[:20]


def test_proven_pieces_are_single_tokens():
    rnd = random.Random(3)
    proven = sorted(p for p in token_count.prove(VOCABULARY) if p[0] == token_count.MARK)
    for piece in rnd.sample(proven, 500):
        assert len(PIECES.encode(piece[1:])) == 1 or piece[1:] == ""


def test_short_and_long_merging_agree():
    rnd, merger = random.Random(5), token_count.Merger(VOCABULARY)
    for _ in range(300):
        word = "▁" + "".join(rnd.choice("theandingabcé") for _ in range(rnd.randint(1, 60)))
        assert merger._short(list(word)) == merger._long(word)


def test_token_count_of_odd_rows(spark):
    got = rows_of(token_count.count_tokens(odd_table(spark), VOCABULARY, ["doc_id"]))
    want = [(r[0], len((r[1] or "").encode()), n := len(PIECES.encode(r[1] or "")), n > 4096) for r in odd_rows()]
    assert got == sorted(want, key=repr) and any(r[3] for r in got)
    assert token_count.count_tokens(empty_table(spark), VOCABULARY, ["doc_id"]).count() == 0
    with pytest.raises(ValueError):
        token_count.count_tokens(odd_table(spark), VOCABULARY, ["n_tokens"])
