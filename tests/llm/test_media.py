"""Media columns: round trips of the formats, area means against brute force, and the query's digests."""

import hashlib
import io
import zlib
from fractions import Fraction

import numpy as np
import pytest

from tabularium.llm import media

SCHEMA = "doc_id long, text string, media string, key string"


@pytest.mark.parametrize("shape", [(1, 64), (3, 5), (7, 64), (2, 1)])
def test_grey_round_trips(shape):
    image = np.random.default_rng(1).integers(0, 256, shape, dtype=np.uint8)
    for encode in (media.encode_pgm, media.encode_bmp):
        assert (media.decode(encode(image)) == image).all()


def test_other_netpbm_kinds():
    assert media.decode(b"P1\n# c\n3 2\n101\n0 1 1").tolist() == [[1, 0, 1], [0, 1, 1]]
    assert media.decode(b"P4 9 1\n" + bytes([0b10000001, 0b10000000])).tolist() == [[1, 0, 0, 0, 0, 0, 0, 1, 1]]
    assert media.decode(b"P2\n2 2 # x\n9\n1 2\n3 4").tolist() == [[1, 2], [3, 4]]
    assert media.decode(b"P3 1 1 255 1 2 3").tolist() == [[[1, 2, 3]]]
    assert media.decode(b"P6 1 1 255\n\x01\x02\x03").tolist() == [[[1, 2, 3]]]
    assert media.decode(b"P5 2 1 65535\n\x01\x00\x00\x02").tolist() == [[256, 2]]
    with pytest.raises(ValueError):
        media.decode(b"GIF89a")


def test_colour_bmp():
    head = lambda bits, size, h: b"BM" + bytes(8) + (54).to_bytes(4, "little") + (40).to_bytes(4, "little") + (2).to_bytes(4, "little") + h.to_bytes(4, "little", signed=True) + b"\x01\x00" + bytes([bits, 0]) + bytes(24)
    rows = bytes([1, 2, 3, 4, 5, 6, 0, 0]) + bytes([7, 8, 9, 10, 11, 12, 0, 0])
    assert media.decode(head(24, 16, 2) + rows).tolist() == [[[9, 8, 7], [12, 11, 10]], [[3, 2, 1], [6, 5, 4]]]
    assert media.decode(head(24, 16, -2) + rows).tolist() == [[[3, 2, 1], [6, 5, 4]], [[9, 8, 7], [12, 11, 10]]]


@pytest.mark.parametrize(("shape", "out"), [((5, 7), (2, 3)), ((2, 3), (5, 7)), ((4, 4), (2, 2)), ((1, 64), (8, 9))])
def test_area_means_against_exact_fractions(shape, out):
    image = np.random.default_rng(2).integers(0, 256, shape)
    got = media.area_resize(image, *out)
    for y in range(out[0]):
        for x in range(out[1]):
            top, bottom, left, right = (Fraction(a * s, o) for a, s, o in ((y, shape[0], out[0]), (y + 1, shape[0], out[0]), (x, shape[1], out[1]), (x + 1, shape[1], out[1])))
            total = sum(
                int(image[r, c]) * max(Fraction(0), min(bottom, Fraction(r + 1)) - max(top, Fraction(r))) * max(Fraction(0), min(right, Fraction(c + 1)) - max(left, Fraction(c))) for r in range(shape[0]) for c in range(shape[1])
            )
            assert got[y, x] == pytest.approx(float(total / ((bottom - top) * (right - left))))


def test_query_digests(spark):
    texts = [None, "", "a", "é" * 40, "x" * 64, "y" * 100_000, "a"]
    rows = [(k, t, "m", "k") for k, t in enumerate(texts)]
    stored = media.stored_media(spark.createDataFrame(rows, SCHEMA))
    got = {r["key"]: r for r in media.media_features(stored).collect()}
    for k, t in enumerate(texts):
        data = (t or "").encode()
        payload = data + bytes(-len(data) % 64 or (0 if data else 64))
        image = b"P5\n64 %d\n255\n" % (len(payload) // 64) + payload
        r = got[k]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r["tail_crc32"], r["media_bytes"], r["media_sha256"]) == (zlib.crc32(payload[-64:]), len(image), hashlib.sha256(image).hexdigest())
    assert got[2]["feature"] == got[6]["feature"] and got[0]["feature"] == got[1]["feature"]


def test_tiles_are_npy(spark):
    stored = media.stored_media(spark.createDataFrame([(1, "z" * 64 * 300, "", "")], SCHEMA))
    tiles = sorted(media.media_tiles(stored).collect(), key=lambda r: r["tile_row"])
    assert [(t["tile_row"], t["tile_column"]) for t in tiles] == [(0, 0), (1, 0)]
    assert (np.load(io.BytesIO(tiles[0]["npy"])) == ord("z")).all()


def test_empty_table(spark):
    assert media.media_features(media.stored_media(spark.createDataFrame([], SCHEMA))).collect() == []
