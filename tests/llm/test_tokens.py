"""Encoding, packing: against the libraries on whole texts."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from atrium.llm import packing, registry, sentence_pieces

from tests.llm.conftest import ODD_TEXTS


@pytest.fixture(scope="module")
def pieces():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=registry.vocabulary_file("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(registry.vocabulary_file("byte_bpe_50k.json"))


def expected_pieces(processor, text):
    ids = processor.encode(text or "", add_bos=True, add_eos=True)
    raw = b"".join(i.to_bytes(4, "little") for i in ids)
    return len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(processor.decode(ids).encode()).hexdigest()


def test_pieces_equal_the_library_on_whole_texts(spark, folder, documents, pieces):
    got = {r.doc_id: tuple(r)[1:] for r in registry.op7_distinct_chunk_pieces(spark, folder).collect()}
    assert got == {i: expected_pieces(pieces, t) for i, t in documents}


def test_pieces_of_odd_texts(odd, empty, pieces):
    model = registry.vocabulary_file("piece_bpe_32k.model")
    got = Counter(tuple(r) for r in sentence_pieces.encode_digests(odd, model).collect())
    assert got == Counter((i, *expected_pieces(pieces, t)) for i, t in ODD_TEXTS)
    assert sentence_pieces.encode_digests(empty, model).count() == 0
    full = {r.doc_id: r for r in sentence_pieces.encode_texts(odd, model).collect()}
    assert full[9].ids == pieces.encode(dict(ODD_TEXTS)[9], add_bos=True, add_eos=True)
    assert full[9].decoded == pieces.decode(full[9].ids)


def test_table_that_overflows_gives_the_same(pieces):
    codec = sentence_pieces.PieceCodec(registry.vocabulary_file("piece_bpe_32k.model"))
    codec.table.limit = 3
    for texts in (["a b c d e", "f  g"], ["a q b", " x", None, "y "], ["a b"]):
        ids, at, decoded = codec.encode(pa.array(texts))
        for k, t in enumerate(texts):
            assert ids[at[k] : at[k + 1]].tolist() == pieces.encode(t or "")
            assert decoded[k].decode() == (t or "")


def test_pieces_of_random_texts(pieces):
    """Markers in the text, runs of them and of spaces, controls, ligatures: ids and decoded texts of the library."""
    rng = np.random.default_rng(4)
    bits = ["a", "the", "▁", "▁▁", " ", "  ", "\n", "\t", "\x00", "\x01", "ﬁ", "　", "\u00a0", "e\u0301", "½", "<s>", "</s>", "<0x41>", "é", "\U0001f600", "\u200b", "b"]
    texts = ["a▁ \n", "▁ ", "▁", " ▁", "▁▁ a", *("".join(rng.choice(bits, rng.integers(0, 10))) for _ in range(12_000))]
    codec = sentence_pieces.PieceCodec(registry.vocabulary_file("piece_bpe_32k.model"))
    assert codec.by_chunk
    for start in range(0, len(texts), 997):
        part = texts[start : start + 997]
        ids, at, decoded = codec.encode(pa.array(part))
        for k, t in enumerate(part):
            want = pieces.encode(t)
            assert ids[at[k] : at[k + 1]].tolist() == want, repr(t)
            assert decoded[k].decode() == pieces.decode(want), repr(t)


class _Rewriting:
    """A processor of a model that normalises texts."""

    def __init__(self, processor):
        self.processor = processor

    def __getattr__(self, name):
        return getattr(self.processor, name)

    def normalize(self, text):
        import unicodedata

        return self.processor.normalize(unicodedata.normalize("NFKC", text))


def test_model_that_rewrites_texts_is_used_on_whole_texts(pieces):
    assert not sentence_pieces.pieces_keep_to_words(_Rewriting(pieces))


def test_vocabulary_whose_pieces_cross_words_is_used_on_whole_texts(pieces):
    codec = sentence_pieces.PieceCodec(registry.vocabulary_file("piece_bpe_32k.model"))
    assert codec.by_chunk
    codec.by_chunk = False
    ids, at, decoded = codec.encode(pa.array(["one two", None]))
    assert ids[at[0] : at[1]].tolist() == pieces.encode("one two") and decoded == [b"one two", b""]


def check_packing(rows, texts, tokenizer, length=2048):
    ids = {}
    for doc_id, text in texts:
        ids.setdefault(doc_id, [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1])
    repeats = Counter(i for i, _ in texts)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r.doc_tokens == len(ids[r.doc_id])
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.length == len(part) > 0
        assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
        by_doc[r.doc_id].append((r.start, r.length))
        by_sequence[r.sequence_id].append((r.offset, r.length))
    assert set(by_doc) == set(ids)
    for doc_id, parts in by_doc.items():
        covered = Counter(k for s, n in parts for k in range(s, s + n))
        assert covered == Counter({k: repeats[doc_id] for k in range(len(ids[doc_id]))})
    padding = 0
    for parts in by_sequence.values():
        end = 0
        for offset, n in sorted(parts):
            assert offset == end
            end += n
        assert end <= length
        padding += 0 if end & (end - 1) == 0 else length - end
    assert padding == 0


def test_packing_covers_every_token_once(spark, folder, documents, tokenizer):
    rows = registry.op3_cost_balanced_packing(spark, folder).collect()
    check_packing(rows, documents, tokenizer)


def test_packing_of_odd_texts(odd, empty, tokenizer):
    file = registry.vocabulary_file("byte_bpe_50k.json")
    check_packing(packing.pack_documents(odd, file, digest=True).collect(), ODD_TEXTS, tokenizer)
    assert packing.pack_documents(empty, file).count() == 0


def test_costs_are_balanced():
    config = packing.PackConfig(length=64, quadratic=1 / 64)
    rng = np.random.default_rng(5)
    sizes = rng.integers(1, 40, 300).tolist()
    placed, count = packing.pack(sizes, config)
    used, cost = Counter(), Counter()
    for _, _, n, s, _ in placed:
        used[s] += n
        cost[s] += n + n * n / 64
    assert len(used) == count and sum(used.values()) == sum(sizes)
    full = [cost[s] for s in used if used[s] == 64]
    shuffled, fresh, room = Counter(), 0, 64
    for n in rng.permutation(sizes).tolist():  # first come, first served
        while n:
            take = min(n, room)
            shuffled[fresh] += take + take * take / 64
            n, room = n - take, room - take
            if not room:
                fresh, room = fresh + 1, 64
    assert np.std(full) < 0.7 * np.std([shuffled[k] for k in range(fresh)])


def plain_pack(sizes, config):
    """Looks at every sequence for every piece: pieces placed whole as (piece, sequence), and those left over."""
    rooms = packing.capacities(sum(sizes), config.length)
    cost, placed, left = [0.0] * len(rooms), {}, []
    for p in sorted(range(len(sizes)), key=lambda p: (-sizes[p], p)):
        fits = [s for s in range(len(rooms)) if rooms[s] >= sizes[p]]
        if fits:
            placed[p] = s = min(fits, key=lambda s: (cost[s], s))
            rooms[s] -= sizes[p]
            cost[s] += config.linear * sizes[p] + config.quadratic * sizes[p] ** 2
        else:
            left.append(p)
    return placed, left


def test_lowest_cost_sequence_with_room_is_found_among_all():
    rng = np.random.default_rng(6)
    config = packing.PackConfig()
    # the small piece comes after hundreds of sequences that are cheaper but too full
    cases = [rng.integers(1, 2048, 1000).tolist(), [1500] * 300 + [600] * 10 + [1], rng.integers(1, 30, 500).tolist(), [2047], []]
    for sizes in cases:
        placed, left = plain_pack(sizes, config)
        rows, _ = packing.pack(sizes, config)
        whole = {p: s for p, start, tokens, s, _ in rows if tokens == sizes[p]}
        assert all(whole[p] == s for p, s in placed.items())
        assert {p for p, *_ in rows} - set(placed) == set(left)
        assert sum(n for _, _, n, _, _ in rows) == sum(sizes)


def test_sequence_sizes():
    assert packing.capacities(0, 2048) == []
    assert packing.capacities(2048 * 2 + 5, 2048) == [2048, 2048, 4, 1]


def test_chunks_do_not_change_the_ids(tokenizer):
    """Texts of awkward neighbours, alone and side by side in a batch."""
    rng = np.random.default_rng(8)
    bits = ["a", "Word", " ", "  ", "\n", "\n\n", "\t", ".", ",", "'s", "'", "’", "é", "ß", "×", "÷", "ñ", "12", "　", " ", " ", "|", "!!", "<|endoftext|>", "\x1c", "\x85", "中", "\U0001f600", "_", "-", "'ll", "\r\n", "ǆ", "λ"]
    texts = ["".join(rng.choice(bits, rng.integers(0, 12))) for _ in range(6000)]
    tokens = packing.TextTokens(registry.vocabulary_file("byte_bpe_50k.json"))
    ids, at = tokens.ids(pa.array(texts))
    for k, t in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == tokenizer.encode(t, add_special_tokens=False).ids, repr(t)
