import hashlib
import zlib

import numpy as np
import pyarrow as pa

from llm import audio


def test_resampling_equals_the_full_filter():
    x = np.random.default_rng(0).normal(size=1001).astype(np.float32)
    for up, down in ((1, 2), (3, 2), (1, 3), (2, 1)):
        h = audio._filter(up, down)
        z = np.zeros(len(x) * up, np.float32)
        z[::up] = x
        full = np.convolve(z, h)[len(h) // 2 :][: len(z) : down]
        got = audio.resample(x, up, down)
        assert len(got) == -(-len(x) * up // down) and np.abs(got - full[: len(got)]).max() < 1e-5


def test_hysteresis_starts_high_and_ends_low():
    e = np.array([0, 0, 2, 0, 0, -3, 0, 0.2, 0, -3, 3, 3, -3.0])
    assert audio.segments(e).tolist() == [[2, 5], [10, 12]]
    assert audio.segments(np.zeros(4)).tolist() == []


def test_payload_comes_back_and_equal_texts_agree(spark, docs_of):
    texts = ["", None, "a", "é" * 288, "x" * 577, "long text " * 4000, "a"]
    media = audio.store_media(docs_of(list(enumerate(texts))))
    got = {r["id"]: r for r in audio.digests(audio.media_features(media)).collect()}
    for i, text in enumerate(texts):
        raw = (text or "").encode()
        want = audio.payload(raw)
        assert len(want) % 576 == 0 and want[len(raw) :] == b"\xff" * (len(want) - len(raw)) and len(want) - len(raw) < 576 + (not raw)
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-32:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(audio.wav(want)), hashlib.sha256(audio.wav(want)).hexdigest())
    assert got[2]["feature"] == got[6]["feature"] and got[0]["feature"] == got[1]["feature"] != got[3]["feature"]
    assert audio.digests(audio.media_features(audio.store_media(docs_of([])))).count() == 0


def test_stored_tensors_have_a_fixed_shape_and_time_spans(docs_of):
    rows = audio.media_features(audio.store_media(docs_of([(1, "some words in a row " * 900), (2, None)])))
    for r in rows.collect():
        assert pa.ipc.open_stream(r["tensors"]).schema.field("patch").type == pa.fixed_shape_tensor(pa.float16(), [audio.PATCH, audio.MELS])
        patches, times = audio.from_stream(r["tensors"])
        assert patches.shape == (len(times), audio.PATCH, audio.MELS) and (len(times) > 1) == (r["id"] == 1)
        ends = [end for _, end, _ in times]
        assert ends == sorted(ends) and all(a < b for a, b, _ in times) and all(s["start"] < s["end"] for s in r["spans"])
        text = "some words in a row " * 900 if r["id"] == 1 else ""
        raw, want, spans_of_patches, spans = audio.analyse(audio.wav(audio.payload(text.encode())))
        assert (patches == want).all() and times == spans_of_patches and [(s["start"], s["end"]) for s in r["spans"]] == spans
