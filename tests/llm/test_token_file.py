"""Token files against the library and an exact round trip."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

P = pytest.importorskip("public_tokenizers")

from quern.llm import token_file as T  # noqa: E402
from quern.llm.bpe import PieceEncoder  # noqa: E402

PARTS = ["a", "The", "é", " ", "  ", "\n", "\t", " ", "12", "'s", "!?", "\x00", "\x85", "　", "<|endoftext|>", "🙂", "word", "\r\n", "\x1c"]


def texts():
    rng = random.Random(6)
    return [None, "", " ", "\n", "x " * 30_000] + ["".join(rng.choice(PARTS) for _ in range(rng.randint(1, 40))) for _ in range(2000)]


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def test_pieces_equal_whole_texts():
    tok, mine = library(), PieceEncoder(P.path("byte_bpe_50k.json"), cache_entries=50)
    for t, got in zip(texts(), mine.encode_many(texts())):
        assert np.frombuffer(got, mine.dtype).tolist() == tok.encode(t or "", add_special_tokens=False).ids, t


def test_round_trip(spark):
    rows = [(i * 7919 % 2503, t, "s") for i, t in enumerate(texts())] + [(None, "null id", ""), (3, "same", ""), (3, "same", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(5)
    path = P.path("byte_bpe_50k.json")
    manifest = T.write_token_files(docs, path, length=64, per_batch=4)
    got = sorted(map(tuple, T.read_token_files(manifest).select("doc_id", "start", "n_tokens", "ids_crc32").collect()), key=lambda r: r[1])
    tok, at, want = library(), 0, []
    for doc, text, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = tok.encode(text or "", add_special_tokens=False).ids + [0]
        want.append((doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want
    for row in manifest.collect():
        with pa.memory_map(row.data.removeprefix("file://")) as f:
            batches = list(pa.ipc.open_stream(f))
        assert all(b.num_rows == 4 for b in batches[:-1]) and all(b.schema.field("ids").type == pa.list_(pa.uint16(), 64) for b in batches)
        assert sum(b.column("mask").values.true_count for b in batches) == row.n_tokens


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert T.token_ids(docs, P.path("byte_bpe_50k.json")).collect() == []


def test_sequences_are_views_of_the_file(spark):
    docs = spark.createDataFrame([(i, f"some words {i} " * 40) for i in range(50)], "doc_id long, text string").coalesce(1)
    row = T.write_token_files(docs, P.path("byte_bpe_50k.json"), length=64, per_batch=4).first()
    found = T.open_sequences(row.data)
    assert len(found) == row.n_sequences
    tok = library()
    whole = [i for d in range(50) for i in tok.encode(f"some words {d} " * 40, add_special_tokens=False).ids + [0]]
    allocated = pa.total_allocated_bytes()
    for i in (0, 3, 4, len(found) - 1, 1):
        ids, mask = found[i]
        n = mask.true_count
        assert ids[:n].tolist() == whole[64 * i : 64 * i + 64] and len(ids) == len(mask) == 64
        # Views: the values lie in the mapped file, nothing is allocated for them.
        buffer = found.batches[i // 4].column("ids").values.buffers()[1]
        assert not ids.flags.owndata and buffer.address <= ids.ctypes.data < buffer.address + buffer.size
    assert pa.total_allocated_bytes() == allocated
    with pytest.raises(IndexError):
        found[len(found)]


def test_a_tokenizer_of_another_kind_encodes_whole_texts():
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    mine, tok = PieceEncoder(path), Tokenizer.from_file(path)
    assert not mine.cuts
    for t, got in zip(texts()[:200], mine.encode_many(texts()[:200])):
        assert np.frombuffer(got, mine.dtype).tolist() == tok.encode(t or "", add_special_tokens=False).ids


def test_very_long_text():
    tok, mine = library(), PieceEncoder(P.path("byte_bpe_50k.json"))
    rng = random.Random(7)
    long = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(900_000))
    got = list(mine.encode_many(["a", long, None, "b  c"]))
    assert [len(x) > 0 for x in got] == [True, True, False, True]
    assert np.frombuffer(got[1], mine.dtype).tolist() == tok.encode(long, add_special_tokens=False).ids
