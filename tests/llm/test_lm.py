"""Language model scores: the unigram part by brute force, the attention part by its own rules."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("public_tokenizers")

from quern.llm import attention, lm  # noqa: E402


def brute(rows):
    def tokens(t):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        for c in "\t\n\x0b\x0c\r":
            low = low.replace(c, " ")
        return [w for w in low.split(" ") if w] + ["</end>"]

    held = [d is None or zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in rows]
    count = Counter(w for (_, t), h in zip(rows, held) if not h for w in tokens(t))
    n, v = sum(count.values()), len(count)
    return [(d, h, len(tokens(t)), sum(count[w] > 0 for w in tokens(t)), n, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in tokens(t))) for (d, t), h in zip(rows, held)]


def rows():
    rng = random.Random(1)
    say = lambda k: " ".join(rng.choice(["The", "of", "été", "x y", "NEW\nline", "🙂"]) + (str(rng.randint(0, 40)) if rng.random() < 0.3 else "") for _ in range(k))
    return [(i, say(rng.randint(0, 60))) for i in range(120)] + [(None, "the end"), (500, None), (501, ""), (7, "the same"), (7, "the same"), (502, "long " * 30_000)]


def key(r):
    return (str(r[0]), r[2], r[5])


def test_base_and_model(spark, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK_CHARS", 3000)
    data = rows()
    docs = spark.createDataFrame([(*r, "x") for r in data], "doc_id long, text string, block string").repartition(3)
    got = sorted(map(tuple, lm.score(docs).collect()), key=key)
    for a, b in zip(got, sorted(brute(data), key=key), strict=True):
        assert a[:5] == b[:5] and math.isclose(a[5], b[5], rel_tol=1e-9)
        assert a[6] < 0
    again = sorted(map(tuple, lm.score(docs.repartition(2)).collect()), key=key)
    assert np.allclose([r[6] for r in got], [r[6] for r in again], rtol=1e-5)


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(None, "a b"), (None, None)], "doc_id long, text string")
    assert sorted(r[2:6] for r in lm.score(docs).collect()) == [(1, 0, 0, 0.0), (3, 0, 0, 0.0)]
    assert lm.score(docs.limit(0)).collect() == []


def model(size=6000, steps=30):
    """More ids than have classes of their own, so that all kinds of classes occur."""
    rng = np.random.default_rng(2)
    counts = rng.integers(0, 50, size).astype(float)
    texts = [rng.integers(0, size, n) for n in (0, 1, 31, 32, 33, 55, 56, 57, 300)]
    windows = rng.integers(0, size, (20, attention.WINDOW + 1))
    windows[3, 5:] = -1
    new = attention.Model.new(attention.Vocabulary.of(counts), counts, size - 1)
    return new.trained(np.concatenate([windows] * -(-steps * attention.BATCH // len(windows))), attention.RATE, 1), texts


def test_probabilities_sum_to_one():
    m, _ = model()
    h = np.random.default_rng(3).normal(size=(4, attention.WIDTH)).astype(np.float32)
    for row in h:
        p = m._log_probability(np.repeat(row[None], 6000, axis=0), np.arange(6000))
        assert math.isclose((10.0**p).sum(), 1, rel_tol=1e-4)


def test_windows_score_each_id_once_and_causally():
    m, texts = model()
    whole = m.score(texts)
    for t, s in zip(texts, whole):
        assert math.isclose(m.score([t])[0], s, rel_tol=1e-5)
        # By hand: each id in the last window that has room for it.
        stream = np.concatenate([[m.end], t, [m.end]]).astype(np.int64)
        total = 0.0
        for i in range(len(t) + 1):
            k = 0 if i < attention.WINDOW else (i - attention.WINDOW) // attention.STRIDE + 1
            start = k * attention.STRIDE
            symbols = np.zeros((1, attention.WINDOW), np.int64)
            symbols[0, : i - start + 1] = m.vocabulary.symbols[stream[start : i + 1]]
            h, _ = m._forward(symbols)
            total += m._log_probability(h[i - start : i - start + 1], stream[i + 1 : i + 2])[0]
        assert math.isclose(total, s, rel_tol=1e-4)


def test_gradients():
    m, _ = model(steps=1)
    rng = np.random.default_rng(4)
    frequent = np.flatnonzero(m.vocabulary.members >= 0)
    inputs = rng.choice(frequent, (2, attention.WINDOW))
    targets = rng.choice(np.concatenate([frequent[:40], np.flatnonzero(m.vocabulary.members < 0)[:9]]), (2, attention.WINDOW))
    targets[1, 20:] = -1
    symbols = m.vocabulary.symbols[inputs]
    for n in m.weights:
        m.weights[n] = m.weights[n].astype(np.float64)

    def loss():
        h, _ = m._forward(symbols)
        known = targets.reshape(-1) >= 0
        return -np.mean((m._log_probability(h[known], targets.reshape(-1)[known]) - m.vocabulary.within[targets.reshape(-1)[known]]) * math.log(10))

    for n, g in m.gradients(symbols, targets).items():
        assert g.shape == m.weights[n].shape
        for at in np.argwhere(np.abs(g) > 0.3 * np.abs(g).max())[:2]:
            at, w = tuple(at), m.weights[n]
            old, e = w[at], 1e-6
            w[at] = old + e
            up = loss()
            w[at] = old - e
            down = loss()
            w[at] = old
            assert math.isclose((up - down) / (2 * e), g[at], rel_tol=2e-2, abs_tol=2e-5), n


def test_changes_are_averaged_by_windows(spark):
    m, _ = model(steps=1)
    n = len(m.packed())
    rows = [(k, (np.full(n, v, np.float32)).tobytes()) for k, v in ((1, 3.0), (2, 0.0), (1, 9.0))]
    mean = lm._averaged(spark.createDataFrame(rows, "n long, change binary").repartition(40), 40)
    assert np.allclose(mean, 3.0)
    moved = m.moved(mean)
    assert all(np.allclose(moved.weights[k], m.weights[k] + 3) for k in m.weights)


def test_windows_come_from_all_documents(spark):
    """Every document gives whole runs, one in four and one at least, and each id of a run is predicted once."""
    texts = {i: " ".join(f"w{i}x{k}" for k in range(n)) for i, n in enumerate([400] * 60 + list(range(1, 40)) + [63, 64, 65, 128, 129, 255, 256, 257, 3000])}
    docs = spark.createDataFrame([*texts.items(), (200, None), (None, "a")], "doc_id long, text string")
    found = lm.training_windows(docs, lm.default_ranks()).collect()
    encoder = lm.shared_word_encoder(lm.default_ranks())
    windows = [np.frombuffer(r.ids, encoder.dtype).tolist() for r in found]
    assert all(2 <= len(x) <= attention.WINDOW + 1 for x in windows) and {r.round for r in found} == set(range(lm.ROUNDS))
    left = Counter(tuple(x) for x in windows)
    left.subtract([(encoder.end, encoder.end), (encoder.end, *encoder.encode(["a"])[0].tolist(), encoder.end)])
    for text in texts.values():
        words = text.split()
        runs = [words[k : k + lm.RUN] for k in range(0, len(words), lm.RUN)]
        said = [[*([encoder.end] if k == 0 else []), *encoder.encode(x)[0].tolist(), *([encoder.end] if k == len(runs) - 1 else [])] for k, x in enumerate(runs)]
        cut = [[tuple(x[k : k + attention.WINDOW + 1]) for k in range(0, len(x) - 1, attention.WINDOW)] for x in said]
        drawn = [k for k, x in enumerate(cut) if all(left[w] > 0 for w in x)]
        assert drawn == list(range(drawn[0], len(runs), lm.ONE_IN)) and drawn[0] < lm.ONE_IN
        left.subtract(w for k in drawn for w in cut[k])
    assert not any(left.values())


def test_every_id_of_every_text_is_predicted_once(spark):
    """Nothing is drawn: windows of a text follow each other from the end before it to the end behind it."""
    texts = [None, "", "a", *(" ".join(f"v{i}x{k}" for k in range(n)) for i, n in enumerate((1, 31, 32, 64, 65, 300, 5000)))]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    encoder = lm.shared_word_encoder(lm.default_ranks())
    left = Counter(np.frombuffer(r.ids, encoder.dtype).tobytes() for r in lm.training_windows(docs, lm.default_ranks()).collect())
    for text in texts:
        ids = np.concatenate([[encoder.end], encoder.encode((text or "").split())[0], [encoder.end]]).astype(encoder.dtype)
        cut = [ids[k : k + attention.WINDOW + 1] for k in range(0, len(ids) - 1, attention.WINDOW)]
        assert sum(len(x) - 1 for x in cut) == len(ids) - 1
        left.subtract(x.tobytes() for x in cut)
    assert not any(left.values())


def test_model_beats_an_interpolated_bigram(spark):
    """On held-out documents, per subword, by a tenth and more, though the bigram's weight is the best for them."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    scores = {r.doc_id: r.score for r in lm.score(docs).collect()}
    encoder = lm.shared_word_encoder(lm.default_ranks())
    streams: dict[bool, list[np.ndarray]] = {True: [], False: []}
    total = 0.0
    for r in docs.select("doc_id", "text").collect():
        words, _ = lm.words_of(pa.array([r.text], pa.string()))
        held = zlib.crc32(str(r.doc_id).encode()) % 7 == 2
        streams[held].append(np.concatenate([[encoder.end], encoder.encode(words.to_pylist())[0].astype(np.int64), [encoder.end]]))
        total += scores[r.doc_id] if held else 0
    ids = sum(len(x) - 1 for x in streams[True])
    size = encoder.vocab_size
    single = np.bincount(np.concatenate([x[1:] for x in streams[False]]), minlength=size) + 1.0
    single /= single.sum()
    pairs = Counter(int(k) for x in streams[False] for k in x[:-1] * size + x[1:])
    first = np.bincount(np.concatenate([x[:-1] for x in streams[False]]), minlength=size)
    a, b = (np.concatenate([x[s] for x in streams[True]]) for s in (slice(0, -1), slice(1, None)))
    both = np.array([pairs[int(k)] for k in a * size + b])
    bigram = min(2 ** -np.mean(np.log2((both + k * single[b]) / (first[a] + k))) for k in (5, 10, 20, 40, 80, 160, 320))
    attentive = 10 ** (-total / ids)
    assert attentive < 0.9 * bigram, (attentive, bigram)


def test_words_are_encoded_by_themselves():
    encoder = lm.shared_word_encoder(lm.default_ranks())
    words = ["a", "don't", "été", "x" * 300, "12345abc", "a\xa0b", "\u2003", "\xa0x", "🙂🙂", "\x1f", "<|endoftext|>", "it's."] * 3
    for some in (words, [w for w in words if w.isascii() and w != "\x1f"]):
        ids, times = encoder.encode(some, group=5)
        alone = [encoder.encode([w])[0].tolist() for w in some]
        assert [x.tolist() for x in np.split(ids, np.cumsum(times)[:-1])] == alone
        assert [encoder.tok.decode_bytes(x).decode() for x in alone] == [" " + w for w in some]
    assert [len(x) for x in encoder.encode([])] == [0, 0]


def test_documents_are_read_once_in_bounded_blocks(spark, monkeypatch):
    """One pass gives words, documents and windows; copies of one row make more blocks and no larger ones."""
    monkeypatch.setattr(lm, "BLOCK_CHARS", 4000)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        texts = [(1, "the same text again")] * 600 + [(i, f"w{i} and The rest w{i % 7}") for i in range(2, 90)] + [(None, None), (91, ""), (92, " \n")]
        docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("held_out", lm.held_out(lm.F.col("doc_id")))
        coded = lm.read_once(docs, 3, lm.default_ranks()).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    encoder = lm.shared_word_encoder(lm.default_ranks())
    words, ids, found, chars = {}, {}, [], Counter()
    for r in coded:
        if r.kind == lm.WORDS:
            words[r.block, r.place] = r.word
        elif r.kind == lm.DOCUMENTS and r.ids is not None:
            times = np.frombuffer(r.times, "<i4")
            ids |= {(r.block, k): x.tolist() for k, x in enumerate(np.split(np.frombuffer(r.ids, encoder.dtype), np.cumsum(times)[:-1]))}
    for r in coded:
        if r.kind == lm.DOCUMENTS and r.ids is None:
            said = [words[r.block, k] for k in np.frombuffer(r.places, "<i4").tolist()]
            assert [ids[r.block, k] for k in np.frombuffer(r.places, "<i4").tolist()] == [encoder.encode([w])[0].tolist() for w in said]
            found.append((r.doc_id, said))
            chars[r.block] += sum(map(len, said))
    assert sorted(found, key=str) == sorted(((d, (t or "").lower().split()) for d, t in texts), key=str)
    assert len(chars) > 4 and max(chars.values()) <= 4000
    windows = Counter(r.ids for r in coded if r.kind == lm.WINDOWS)
    assert windows == Counter(r.ids for r in lm.training_windows(docs.where("not held_out"), lm.default_ranks()).collect())
    learned = Counter(k for x, n in windows.items() for k in np.frombuffer(x, encoder.dtype)[1:].tolist() * n if k != encoder.end)
    numbers = Counter()
    for r in coded:
        if r.kind == lm.SUBWORDS:
            numbers[r.place] += r.n
    assert numbers == learned


def test_powers_are_near_and_sum_up():
    """Linear between whole exponents: at most 6.2 % above the power of two, exact at whole ones, and never negative or infinite."""
    x = np.concatenate([np.linspace(-90, 55, 5001), [-1e6, 1e6]]).astype(np.float32)
    _, unit, one = attention._bits(x.dtype)
    got = attention._powers(x * np.float32(unit) + np.float32(one))
    assert np.isfinite(got).all() and (got > 0).all()
    ratio = got[:-2] / np.exp2(x[:-2].astype(np.float64))
    assert 0.999 < ratio.min() and ratio.max() < 1.0625
    assert np.array_equal(attention._slopes(got), np.exp2(np.floor(np.log2(got.astype(np.float64)))).astype(np.float32))
