"""WARC index, sharding, mixing, packing, audio and nearest neighbours against
brute force or round trips, and the pipeline."""

from __future__ import annotations

import base64
import gzip
import hashlib
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import ann, audio, mixing, packing, sharding, warc
from tidemark.llm.common import fresh_path

DOCS = "doc_id long, text string"


def clashing(df):
    for name in ("digest", "first", "revisit", "key", "shard", "slot", "size", "rank", "part", "nth", "media", "list", "payload", "draw", "at"):
        df = df.withColumn(name, F.lit("clash"))
    return df


def test_warc(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 3)
    rnd = random.Random(1)
    bodies = [None, "", "<p>é</p>", "x" * 50_000, *[f"<b>{rnd.random()}</b>" for _ in range(12)]]
    rows = [(i, rnd.choice(["http://a.Example.com/x?y=1#z", "https://b.example.com:8080", None, "b.example.com/ü \n"]), rnd.choice(bodies)) for i in range(60)]
    rows += [(None, "http://n.example.com/", "<p>é</p>"), (None, None, "only null ids"), rows[5], rows[5]]
    found = warc.archive_and_read(clashing(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4))).collect()
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    expected = []
    for i, _, h in rows:
        body = (h or "").encode()
        low = first.get(h or "")
        response = low is None or low == i
        expected.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if response else "revisit", None if response else low))
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, expected))


def test_warc_keys_and_records(spark):
    assert warc.url_key("https://user@Www.Example.com:443/a b?c#d") == "com,example,www)/a%20b?c"
    assert warc.url_key("example.org") == "org,example)/" and warc.url_key(None) == "-"
    keys = [warc.capture_key("http://a.b/", i) for i in (-5, 0, 7, 10**12)]
    assert keys == sorted(keys)
    data = warc.member(warc.record(3, "http://a.b/", b"body", warc.b32(hashlib.sha1(b"body").digest()), None, False))
    assert warc.parse(data) == {"type": "response", "bytes": 4, "digest": warc.b32(hashlib.sha1(b"body").digest()), "refers_to": None}
    broken = gzip.compress(gzip.decompress(data).replace(b"body\r\n", b"bodx\r\n"))
    with pytest.raises(ValueError, match="digest"):
        warc.parse(broken)
    assert warc.archive_and_read(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def slow_jump(key, n):
    key = int(sharding.mixed_keys(np.array([key], np.int64))[0])
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * sharding.STEP + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_sharding(spark):
    rows = [(i * 37 - 500, f"t{i % 11}" * (i % 5)) for i in range(400)] + [(None, None), (None, "a"), (7, "same"), (7, "same"), (7, "same")]
    found = sharding.shard_rows(clashing(spark.createDataFrame(rows, DOCS).repartition(5)), shards=9).collect()
    assert len(found) == len(rows)
    slots = defaultdict(list)
    for r in found:
        key = sharding.NULL_KEY if r["doc_id"] is None else r["doc_id"]
        assert r["shard"] == slow_jump(key, 9) and r["grown_shard"] == slow_jump(key, 10)
        assert r["grown_shard"] in (r["shard"], 9)
        slots[r["shard"]].append((r["slot"], r["doc_id"] is None, r["doc_id"] or 0))
    for own in slots.values():
        own.sort()
        assert [s for s, *_ in own] == list(range(len(own)))
        assert [x[1:] for x in own] == sorted(x[1:] for x in own)
    assert sorted((r["size"], r["text_crc32"]) for r in found) == sorted((len(t or "") + 16, zlib.crc32((t or "").encode())) for _, t in rows)
    assert sharding.shard_rows(spark.createDataFrame([], DOCS)).count() == 0


def test_jump_moves_few():
    ids = np.arange(20_000)
    a, b = sharding.jump(ids, 40), sharding.jump(ids, 41)
    assert set(b[a != b]) == {40} and 300 < (a != b).sum() < 700 and np.bincount(a).min() > 380


MIX = f"{DOCS}, source string, lang string, n_chars long"


def mix_rows():
    rnd = random.Random(4)
    rows = [(i, " ".join(["w"] * rnd.randint(0, 40)), rnd.choice(["a", "a", "a", "b", "c", None]), "x", 1) for i in range(500)]
    return rows + [(900, None, "b", None, None), (901, "", "empty", None, None), rows[3], (None, "w w w", "c", None, None), (902, "  w w", "b", None, 2)]


def water(sizes, weights, share, most):
    total, full = sum(sizes), set()
    while True:
        rest = share * total - sum(most * sizes[i] for i in full)
        free = [i for i in range(len(sizes)) if i not in full]
        level = rest / sum(weights[i] for i in free) if free else 0
        new = {i for i in free if weights[i] * level >= most * sizes[i]}
        if not new:
            return [most * s if i in full else weights[i] * level for i, s in enumerate(sizes)]
        full |= new


@pytest.mark.parametrize(("bins", "last"), [(1024, 10_000), (4, 3)])
def test_mixing(spark, monkeypatch, bins, last):
    monkeypatch.setattr(mixing, "BINS", bins)
    monkeypatch.setattr(mixing, "LAST_ROWS", last)
    docs = clashing(spark.createDataFrame(mix_rows(), MIX).repartition(3))
    found = mixing.mix(docs).collect()
    assert len(found) == len(mix_rows())
    by = defaultdict(list)
    for r in found:
        by[r["source"]].append(r)
        assert r["taken"] == r["copies"] * r["size"] and r["taken"] <= 2 * r["size"]
    order = sorted(s for s in by if s is not None) + [None]
    sizes = [sum(r["size"] for r in by[s]) for s in order]
    targets = water(sizes, [(5, 2, 1)[i % 3] for i in range(len(order))], 1.5, 2)
    for s, size, target in zip(order, sizes, targets, strict=True):
        assert by[s][0]["source_size"] == size and by[s][0]["target"] == pytest.approx(target)
        assert abs(sum(r["taken"] for r in by[s]) - target) <= 20 + 40
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(repr, map(tuple, again))) == sorted(map(repr, map(tuple, found)))


def test_mixed_documents(spark):
    docs = clashing(spark.createDataFrame(mix_rows(), MIX)).withColumn("_id", F.lit(1)).withColumn("row", F.lit(2))
    copies = {(r["doc_id"], r["source"], r["size"]): r["copies"] for r in mixing.mix(docs).collect()}
    made = mixing.mixed_documents(docs)
    assert made.columns == docs.columns
    assert made.count() == sum(r["copies"] for r in mixing.mix(docs).collect()) and copies
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mixed_documents(docs.limit(0)).count() == 0


@pytest.mark.parametrize("equal", [100_000, 7])
def test_mixing_of_equal_rows(spark, monkeypatch, equal):
    """Equal rows are drawn apart, so that a source of them meets its target."""
    monkeypatch.setattr(mixing, "EQUAL_ROWS", equal)
    docs = spark.createDataFrame([(5, "a b c d e f g h", "s")] * 200, "doc_id long, text string, source string").repartition(3)
    found = mixing.mix(docs).collect()
    assert len(found) == 200 and abs(sum(r["taken"] for r in found) - 2400) <= 4
    assert mixing.mixed_documents(docs).count() == sum(r["copies"] for r in found)


def test_mixing_prefers_longer_documents(spark):
    """The extra copies go to longer documents more often."""
    rows = [(i, " ".join(["w"] * (4 if i % 2 else 64)), "s") for i in range(2000)] + [(5000, "long " * 2000, "t")]
    found = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).filter("source = 's'").collect()
    extra = {n: sum(r["copies"] - 1 for r in found if r["size"] == n) / 1000 for n in (4, 64)}
    assert extra[64] > 2 * extra[4] > 0


def tokenizer_file():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def check_plan(counts, capacity):
    places, items = packing.Places(packing.best_plan(dict(counts), capacity)), defaultdict(list)
    for n, c in counts.items():
        sequence, offset = places(np.full(c, n), np.arange(c))
        for s, o in zip(sequence.tolist(), offset.tolist(), strict=True):
            items[s].append((o, n))
    for own in items.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= capacity
    return len(items)


def test_plans_beat_best_fit():
    rng = np.random.default_rng(1)
    counts = dict(Counter(rng.integers(1000, 2501, 20_000).tolist()))
    used = lambda rows: max(first + -(-n // per) for _, _, n, per, first, _ in rows)
    assert used(packing.best_plan(dict(counts))) < used(packing.plan(dict(counts), small=1))


def test_plans():
    rnd = random.Random(9)
    for _ in range(60):
        capacity = rnd.randint(4, 80)
        counts = {n: rnd.randint(1, 40) for n in {rnd.randint(1, capacity) for _ in range(rnd.randint(1, 12))}}
        used, total = check_plan(counts, capacity), sum(n * c for n, c in counts.items())
        large = sum(c for n, c in counts.items() if 2 * n > capacity)
        assert max(-(-total // capacity), large) <= used <= 2 * max(-(-total // capacity), large) + 1
    counts = defaultdict(int)
    for _ in range(20_000):
        counts[min(4096, int(rnd.lognormvariate(6.3, 1.1)) + 1)] += 1
    assert check_plan(dict(counts), 4096) <= 1.01 * sum(n * c for n, c in counts.items()) / 4096 + 1
    assert packing.best_plan({}, 4096) == [] and check_plan({4096: 3}, 4096) == 3


def test_packing(spark):
    from tokenizers import Tokenizer

    path = tokenizer_file()
    rnd = random.Random(2)
    texts = [None, "", " \n", "Don't <|endoftext|> it's!! 12 é é İI \x1cx y", "the same", "the same", *[" ".join(rnd.choice(["alpha", "Beta,", "gamma--delta", "ünïcode", "42"]) for _ in range(rnd.randint(1, 300))) for _ in range(60)]]
    rows = [(i if i % 8 else None, t) for i, t in enumerate(texts)]
    found = packing.pack(clashing(spark.createDataFrame(rows, DOCS).repartition(3)), path, capacity=128).collect()
    tokenizer = Tokenizer.from_file(path)
    expected = []
    for d, t in rows:
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        expected += [(d, i, s, len(ids[s : s + 128]), zlib.crc32(ids[s : s + 128].tobytes())) for i, s in enumerate(range(0, len(ids), 128))]
    assert sorted(map(repr, (tuple(r)[:5] for r in found))) == sorted(map(repr, expected))
    own = defaultdict(list)
    for r in found:
        own[r["sequence_id"]].append((r["offset"], r["length"]))
    for x in own.values():
        at = 0
        for o, n in sorted(x):
            assert o == at
            at += n
        assert at <= 128
    assert packing.pack(spark.createDataFrame([], DOCS), path).count() == 0


def test_tokens_forget_and_stay_right():
    from tokenizers import Tokenizer

    path = tokenizer_file()
    tokens, tokenizer = packing.Tokens(path, words=50), Tokenizer.from_file(path)
    rnd = random.Random(6)
    for _ in range(12):
        texts = [" ".join("".join(rnd.choice("abé1.,'") for _ in range(rnd.randint(1, 6))) for _ in range(30)) for _ in range(5)]
        for t, ids in zip(texts, tokens([x.encode() for x in texts]), strict=True):
            assert ids.tolist() == [*tokenizer.encode(t, add_special_tokens=False).ids, 1]


def test_audio(spark):
    rows = [(0, None), (1, ""), (2, "é" * 96), (3, "same text " * 200), (4, "same text " * 200), (None, "x" * 193), (5, "quiet" * 30_000)]
    found = audio.audio_features(clashing(spark.createDataFrame(rows, DOCS).repartition(3))).collect()
    assert len(found) == len(rows)
    by = {r["doc_id"]: r for r in found}
    for d, t in rows:
        body, r = (t or "").encode(), by[d]
        full = body.ljust(max(192, -(-len(body) // 192) * 192), b" ")
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(body), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-16:]))
        assert r["media_bytes"] == len(full) + 44 and r["media_sha256"] == hashlib.sha256(audio.to_wav(full)).hexdigest()
    assert by[3]["feature"] == by[4]["feature"] != by[2]["feature"]
    media = audio.store_media(spark.createDataFrame(rows, DOCS))
    folder = fresh_path(spark, "test-tensors")
    stored = audio.store_tensors(media, folder)
    one = audio.segment_tensors(stored.filter("doc_id = 3"), folder).orderBy("nth").collect()
    # the stored form is Arrow's own tensor type, and holds the frames
    mels, spans, rate = audio.features(("same text " * 200).encode().ljust(2112, b" "))
    made = list(audio.tensors(mels, spans, rate))
    assert [(r["start_s"], r["end_s"], r["frames"]) for r in one] == [x[:3] for x in made]
    assert all(np.array_equal(np.array(r["values"], np.float16), x[3].reshape(-1)) for r, x in zip(one, made, strict=True))
    assert by[3]["feature"] == audio.digest(made, len(spans))
    name = stored.first()["file"]
    fs, root = audio.file_system(folder)
    kind = pa.ipc.open_file(fs.open_input_file(f"{root}/{name}")).schema.field("values").type
    assert isinstance(kind, pa.FixedShapeTensorType) and kind.shape == [audio.TENSOR_FRAMES, audio.MELS]
    assert all(len(r["values"]) == audio.TENSOR_FRAMES * audio.MELS and r["end_s"] > r["start_s"] for r in one)
    assert audio.audio_features(spark.createDataFrame([], DOCS)).count() == 0


def test_audio_of_the_last_bytes():
    """Every byte of a long text is in its features, to the last."""
    text = bytes(97 + i * 7 % 26 for i in range(960))

    def digest(samples):
        mels, spans, rate = audio.features(samples)
        return audio.digest(audio.tensors(mels, spans, rate), len(spans))

    made = digest(text)
    for at in (1, 2, 8, 40, 90):
        other = bytearray(text)
        other[-at] ^= 0x55
        assert digest(bytes(other)) != made


def test_log_mel_matches_its_definition():
    """Frames by a plain discrete Fourier transform and triangles, one by one."""
    rng = np.random.default_rng(9)
    x = rng.standard_normal(audio.FRAME * 3 + 77).astype(np.float32)
    rate, n = audio.RATE * audio.UP // audio.DOWN, audio.FRAME
    found, energy = audio.log_mel(x, rate)
    padded = np.concatenate([x, np.zeros(-(len(x) - n) % audio.HOP)])
    assert len(found) == (len(padded) - n) // audio.HOP + 1
    hann = [0.5 - 0.5 * np.cos(2 * np.pi * i / (n - 1)) for i in range(n)]
    low, high = 2595 * np.log10(1 + 20 / 700), 2595 * np.log10(1 + rate / 2 / 700)
    edges = [700 * (10 ** ((low + (high - low) * i / (audio.MELS + 1)) / 2595) - 1) for i in range(audio.MELS + 2)]
    for f in range(len(found)):
        frame = padded[f * audio.HOP : f * audio.HOP + n] * hann
        assert energy[f] == pytest.approx(np.log(sum(frame**2) + 1e-6), abs=1e-4)
        bins = np.arange(audio.FFT // 2 + 1)
        power = [abs(sum(frame * np.exp(-2j * np.pi * k * np.arange(n) / audio.FFT))) ** 2 for k in bins]
        for m in range(0, audio.MELS, 7):
            a, b, c = edges[m : m + 3]
            total = 0.0
            for k, p in zip(bins, power, strict=True):
                hz = k * rate / audio.FFT
                total += p * max(0.0, min((hz - a) / (b - a), (c - hz) / (c - b)))
            assert found[f, m] == pytest.approx(np.log(total + 1e-6), abs=2e-3)


def test_long_audio_is_resampled_alike_in_chunks(monkeypatch):
    samples = bytes(np.random.default_rng(1).integers(0, 256, 5000, np.uint8))
    whole, _, _ = audio.features(samples)
    monkeypatch.setattr(audio, "CHUNK", 603)
    parts, _, _ = audio.features(samples)
    assert whole.shape == parts.shape and np.abs(whole - parts).max() < 1e-3


def test_audio_parts():
    samples = bytes(range(256)) * 3
    assert audio.from_wav(audio.to_wav(samples + b"x")) == (samples + b"x", audio.RATE)
    assert struct.unpack_from("<H", audio.to_wav(samples), 34)[0] == 8
    x = np.sin(np.arange(4000) * 0.05).astype(np.float32)
    for up, down in ((1, 2), (2, 3), (3, 2)):
        y = audio.resample(x, up, down)
        bank = audio.polyphase(up, down)
        stuffed = np.zeros(len(x) * up)
        stuffed[::up] = x
        full = np.convolve(stuffed, bank[:, ::-1].T.reshape(-1))
        assert min(np.abs(full[d : d + len(y) * down : down][: len(y) - 50] - y[: len(y) - 50]).max() for d in range(bank.size)) < 1e-4
    assert audio.segments(np.array([0, 0, 0, 2, 0.7, 0.6, 0.2, 0, 0.9, 1.5, 0])) == [(3, 6), (9, 10)]
    assert audio.tensor_array([np.zeros((audio.TENSOR_FRAMES, audio.MELS), np.float32)]).type.shape == [audio.TENSOR_FRAMES, audio.MELS]


def brute_nearest(rows, every, k):
    used = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, q in used:
        if i % every == 0:
            out[i] = sorted(((-float(q @ x), j) for j, x in used if j != i))[:k]
    return out


def vectors(n, dims=16, seed=0):
    rng = np.random.default_rng(seed)
    return [(i, [float(x) for x in rng.standard_normal(dims).astype(np.float32)]) for i in range(n)]


VECTORS = "vec_id long, embedding array<float>"


def test_nearest(spark, monkeypatch):
    monkeypatch.setattr(ann, "LIST_ROWS", 500)
    monkeypatch.setattr(ann, "QUERY_ROWS", 16)
    rows = vectors(3000)
    rows += [(5000 + i, rows[40][1]) for i in range(700)] + [(6000, None), (6001, [0.0] * 16), (6002, [float("nan")] * 16), (6003, [None] + [1.0] * 15), (None, rows[1][1]), (6004, [1.0])]
    found = defaultdict(list)
    for r in ann.nearest(clashing(spark.createDataFrame(rows, VECTORS).repartition(4)), every=20, k=20).collect():
        found[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    expected = brute_nearest([(i, v) for i, v in rows if v is None or len(v) == 16], 20, 20)
    assert set(found) == set(expected)
    hit = 0
    for q, best in expected.items():
        own = sorted(found[q])
        assert [r for r, *_ in own] == list(range(1, 21))
        assert [(-s, v) for _, v, s in own] == sorted((-s, v) for _, v, s in own)
        least = -best[-1][0]
        hit += sum(s >= least - 1e-9 for *_, s in own)
    assert hit >= 0.9 * 20 * len(expected)
    # of 701 equal vectors the smallest ids come first
    assert [v for _, v, _ in sorted(found[40])] == [5000 + i for i in range(20)]


def test_nearest_of_few(spark):
    rows = vectors(7)
    found = ann.nearest(spark.createDataFrame(rows, VECTORS), every=3, k=20).collect()
    expected = brute_nearest(rows, 3, 20)
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in found) == sorted((q, n + 1, j) for q, best in expected.items() for n, (_, j) in enumerate(best))
    assert ann.nearest(spark.createDataFrame([], VECTORS)).count() == 0


def test_pipeline_keeps_one_of_each_component(spark, tmp_path):
    """Ids that repeat in different components, and rows without an id."""
    pipeline = pytest.importorskip("corpus_pipeline")
    rnd = random.Random(4)
    a, b, c, d, e = (" ".join(f"{n}{rnd.randrange(1000)}" for _ in range(60)) for n in "abcde")
    rows = [(1, a), (1, b), (2, c), (3, c), (3, d), (None, e), (None, e), (None, e + " more"), (None, a), (4, a), (5, b), (6, b), (6, b), (7, None), (7, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = pipeline.one_of_each(spark, docs, str(tmp_path)).collect()
    assert sorted((r["text"] or "")[:1] for r in kept) == ["", "", "a", "b", "c", "d", "e"]
    assert sorted((r["doc_id"], r["text"]) for r in kept if r["text"] and r["doc_id"]) == [(1, a), (1, b), (2, c), (3, d)]


def brute_mix(rows, weights=(5, 2, 1), share=1.5, most=2):
    """(doc_id, text, source) rows, each as often as it is taken, by plain sums
    over sorted lists."""
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    by = defaultdict(list)
    for r in rows:
        by[r[2]].append(r)
    order = sorted(s for s in by if s is not None) + [None] * (None in by)
    sizes = [sum(words(t) for _, t, _ in by[s]) for s in order]
    targets = water(sizes, [weights[i % 3] for i in range(len(order))], share, most)
    out = []
    for source, size, target in zip(order, sizes, targets, strict=True):
        ratio = target / size if size else 0.0
        p, rest, seen, drawn = ratio - int(ratio), target - int(ratio) * size, Counter(), []
        for d, t, _ in by[source]:
            out += [(d, t, source)] * int(ratio)
            first = hashlib.md5(f"20:{'' if d is None else d}:{t or ''}".encode()).hexdigest()
            u = (int(hashlib.md5(f"{first}:{seen[d, t]}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            seen[d, t] += 1
            if 0 < p < 1 and words(t):
                drawn.append((u / (1 - u) / (p / (1 - p) * words(t) ** 0.5), (d, t, source)))
        drawn.sort(key=lambda x: x[0])
        off = [abs(sum(words(x[1][1]) for x in drawn[:n]) - rest) for n in range(len(drawn) + 1)]
        out += [x for _, x in drawn[: off.index(min(off))]]
    return out


def test_pipeline(spark, tmp_path):
    """run() against all stages done by plain loops, on a small table."""
    from tokenizers import Tokenizer

    from tests.llm.test_text_operators import shingle_set
    from tidemark.llm import language_id, pii

    pipeline = pytest.importorskip("corpus_pipeline")
    rnd = random.Random(8)
    words = {"en": "the house stands near a river under tall trees".split(), "de": "das haus steht am fluss unter hohen bäumen dort".split()}
    make = lambda lang: " ".join(rnd.choice(words[lang]) + str(rnd.choice(["", "", rnd.choice("xyz")])) for _ in range(rnd.randint(20, 80)))
    rows = []
    for i in range(120):
        lang = rnd.choice(["en", "de"])
        text = make(lang) + (f" mail me{i}@host.example.com" if i % 9 == 0 else "")
        rows.append((i, text, lang, rnd.choice(["s0", "s1", None]), len(text)))
    rows += [(200 + i, r[1], *r[2:]) for i, r in enumerate(rows[:10])] + [(300, None, "en", "s0", 0), (301, "99 !! 11", "en", "s0", 8), (302, rows[20][1] + " again", "en", "s1", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    assert [name for name, _ in pipeline.STAGES] == ["language ID", "n-gram Jaccard join", "PII", "mixing sources to target weights", "best-fit packing"]

    learned = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    model = language_id.Classifier(language_id.learn(spark.createDataFrame(learned, schema)))
    docs = [r for r in rows if model.best(r[1])[2]]
    assert 120 <= len(docs) <= 131
    # each document goes if it is similar to one before it in its component
    sets, group = [shingle_set(r[1]) for r in docs], list(range(len(docs)))
    for _ in docs:
        for i in range(len(docs)):
            for j in range(i):
                if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                    group[i] = group[j] = min(group[i], group[j])
    docs = [r for i, r in enumerate(docs) if group[i] == i]
    assert not {r[0] for r in docs} & {200, 201, 209, 302}
    new = {r["doc_id"]: r["text"] for r in pii.replace(spark.createDataFrame(docs, schema)).collect()}
    assert all(("@" in r[1]) == (new[r[0]] != r[1]) and f"me{r[0]}@host" not in new[r[0]] for r in docs)
    mixed = brute_mix([(r[0], new[r[0]], r[3]) for r in docs])
    tokenizer = Tokenizer.from_file(tokenizer_file())
    expected = Counter()
    for d, t, _ in mixed:
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], "<u4")
        for n, at in enumerate(range(0, len(ids), 4096)):
            expected[d, n, at, len(ids[at : at + 4096]), zlib.crc32(ids[at : at + 4096].tobytes())] += 1
    found = pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(tuple(r)[:5] for r in found) == expected
    places = defaultdict(list)
    for r in found:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in places.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 4096
    assert len(places) <= -(-sum(n for *_, n, _ in expected.elements()) // 4096) + 1

    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for i, (_, stage) in enumerate(pipeline.STAGES[:4]):
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/stage{i}")
        now = spark.read.parquet(f"{tmp_path}/stage{i}")
        assert now.columns == pipeline.COLUMNS


def test_pipeline_of_nothing(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_repeated_and_long_rows_of_sharding_and_language(spark):
    """Repeated rows keep a row each, very long texts are taken whole."""
    from tidemark.llm import language_id

    long = "word " * 400_000
    rows = [(1, "same words here", "en"), (1, "same words here", "en"), (2, long, "en"), (3, None, None), (None, "ein wort", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sharded = sharding.shard_rows(docs, shards=3).collect()
    assert len(sharded) == 5 and sorted(r["size"] for r in sharded) == [16, 24, 31, 31, len(long) + 16]
    assert {r["text_crc32"] for r in sharded if r["doc_id"] == 2} == {zlib.crc32(long.encode())}
    found = language_id.identify(docs).collect()
    assert len(found) == 5 and len({tuple(r) for r in found if r["doc_id"] == 1}) == 1


def test_tokens_forget_in_little_memory():
    """Words are forgotten without an object for each one's ids."""
    import tracemalloc

    tokens = packing.Tokens(tokenizer_file(), words=10)
    tokens([b" ".join(b"w%dx" % i for i in range(40_000))])
    n = tokens.learned
    tracemalloc.start()
    tokens.forget()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert tokens.learned <= n // 2 + 2 and peak < 128 * n
