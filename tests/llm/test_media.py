from __future__ import annotations

import hashlib
import io
import zlib

import numpy as np
import pytest

from weftwork.llm import media, queries

RNG = np.random.default_rng(5)


def plain(kind, image):
    height, width, channels = image.shape
    top = "" if kind == 1 else "255\n"
    return f"P{kind}\n# a comment\n{width} {height}\n{top}".encode() + " ".join(map(str, image.ravel())).encode()


def test_netpbm_forms():
    grey, colour = RNG.integers(0, 256, (5, 7, 1)), RNG.integers(0, 256, (4, 3, 3))
    assert (media.decode_image(media.encode_pgm(grey[:, :, 0])) == grey).all()
    assert (media.decode_image(plain(2, grey)) == grey).all()
    assert (media.decode_image(plain(3, colour)) == colour).all()
    assert (media.decode_image(b"P6 3 4 255\n" + colour.astype(np.uint8).tobytes()) == colour).all()
    bits = RNG.integers(0, 2, (5, 11, 1))
    assert (media.decode_image(plain(1, bits)) == (1 - bits) * 255).all()
    assert (media.decode_image(b"P4 11 5\n" + np.packbits(bits[:, :, 0], axis=1).tobytes()) == (1 - bits) * 255).all()
    wide = RNG.integers(0, 1001, (2, 2, 1))
    assert (media.decode_image(b"P5 2 2 1000\n" + wide.astype(">u2").tobytes()) == wide * 255 // 1000).all()


def test_bmp_forms():
    colour = RNG.integers(0, 256, (5, 3, 3)).astype(np.uint8)
    data = media.encode_bmp(colour)
    assert (media.decode_image(data) == colour).all()
    flipped = bytearray(data)
    flipped[22:26] = (-5).to_bytes(4, "little", signed=True)
    assert (media.decode_image(bytes(flipped)) == colour[::-1]).all()
    palette = RNG.integers(0, 256, (16, 4)).astype(np.uint8)
    head = bytearray(media.encode_bmp(np.zeros((2, 3, 3), np.uint8))[:54])
    head[10:14], head[28:30] = (54 + 64).to_bytes(4, "little"), (4).to_bytes(2, "little")
    rows = bytes([0x12, 0x30, 0, 0, 0x45, 0x60, 0, 0])
    want = palette[np.array([[4, 5, 6], [1, 2, 3]])][:, :, 2::-1]
    assert (media.decode_image(bytes(head) + palette.tobytes() + rows) == want).all()


@pytest.mark.parametrize("data", [b"", b"P5", b"P5 2 2 255\n\x00", b"P9 1 1 1\n0", b"BM", b"BM" + b"\0" * 60, b"P5 2 x", b"P2 1 1 0\n0", b"GIF89a", b"P2 1 1 255 99999999999999999999999", b"P2 1 1 255 300", b"P2 1 1 255 -1", b"P1 2 1 7 2", b"P5 1 1 100\n\xff", b"P5 99999999999 99999999999 255\n\x00"])
def test_broken_images_say_why(data):
    assert media._decoded(data)[6] and media._decoded(data)[3] is None


def test_area_resize_against_sums():
    image = RNG.integers(0, 256, (17, 13)).astype(float)
    fine = np.kron(image, np.ones((4, 6)))  # 68 x 78 cells, so that 4 x 6 pixels of the result have whole edges
    want = fine.reshape(4, 17, 6, 13).mean(axis=(1, 3))
    assert np.allclose(media.area_resize(image, 4, 6), want)
    assert np.allclose(media.area_resize(image, 17, 13), image)


def test_round_trip_of_texts(docs):
    stored = media.store_texts(docs)
    for r in media.decode(stored).join(docs.select("doc_id", "text").distinct(), "doc_id").collect():
        payload = (r["text"] or "").encode()
        payload += b"\xff" * ((-len(payload)) % 576 or (0 if payload else 576))
        assert r["samples"] == payload and r["problem"] is None and r["channels"] == (3 if zlib.crc32((r["text"] or "").encode()) % 2 else 1)
        tile = np.load(io.BytesIO(r["tile_npy"]))
        assert tile.shape == (8, 9) and media.difference_hash(tile) == r["dhash"]


def test_query_digests(spark, tmp_path, docs):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.op5_media(spark, str(tmp_path)).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len({len(payload) for payload in (r["tile_npy"] for r in rows)}) == 1 and {np.load(io.BytesIO(r["tile_npy"])).shape for r in rows} == {(8, 9)}
    assert {zlib.crc32((t or "").encode()) % 2 for t in texts.values()} == {0, 1}  # both formats are stored
    assert len(rows) == docs.count()
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        payload = raw + b"\xff" * ((-len(raw)) % 576 or (0 if raw else 576))
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-32:])


def test_null_empty_and_clashing(spark, empty, clashing, docs):
    odd = spark.createDataFrame([(1, None), (2, b"junk")], "doc_id long, media binary")
    rows = {r["doc_id"]: r for r in media.decode(odd.withColumn("dhash", media.F.lit("x"))).collect()}
    assert rows[1]["problem"] is None and rows[1]["dhash"] is None and rows[2]["problem"]
    assert media.store_texts(empty).count() == 0
    assert media.decode(media.store_texts(clashing)).count() == docs.count()
