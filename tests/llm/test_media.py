"""Media containers: several tracks, 64-bit sizes, listed sample sizes, damaged files."""

import hashlib
import random
import struct
import zlib

from atril.llm import media

def track(offsets: list[int], runs: list[tuple], sizes: list[int] | int, n: int, keys: list[int] | None, codec: bytes = b"mp4a", wide: bool = False, version: int = 0) -> bytes:
    u4 = lambda *v: struct.pack(f">{len(v)}I", *v)
    listed = [] if isinstance(sizes, int) else sizes
    tables = [
        media.full(b"stsd", u4(1), media.box(codec, bytes(8))),
        media.full(b"stts", u4(1, n, 10)),
        *([] if keys is None else [media.full(b"stss", u4(len(keys), *keys))]),
        media.full(b"stsc", u4(len(runs), *(x for r in runs for x in r))),
        media.full(b"stsz", u4(0 if listed else sizes, n, *listed)),
        media.full(b"co64", u4(len(offsets)), struct.pack(f">{len(offsets)}Q", *offsets)) if wide else media.full(b"stco", u4(len(offsets), *offsets)),
    ]
    times = struct.pack(">QQIQ", 0, 0, 90, 7) if version else u4(0, 0, 90, 7)
    return media.box(b"trak", media.box(b"mdia", media.full(b"mdhd", times, bytes(4), version=version), media.box(b"minf", media.box(b"stbl", *tables))))


def test_tracks_are_not_mixed():
    one, two = track([100], [(1, 4, 1)], 5, 4, None), track([200, 300], [(1, 2, 1)], [1, 2, 3, 4], 4, [3], b"avc1", wide=True, version=1)
    first, second = media.tracks(media.box(b"moov", one, two))
    assert first["codec"] == media.demux(media.box(b"moov", one, two))["codec"] == "mp4a"
    assert first["keyframes"].tolist() == [0, 1, 2, 3] and first["offset"].tolist() == [100, 105, 110, 115] and (first["timescale"], first["duration"]) == (90, 7)
    assert second["codec"] == "avc1" and second["keyframes"].tolist() == [2] and second["offset"].tolist() == [200, 201, 300, 303] and second["size"].tolist() == [1, 2, 3, 4] and second["duration"] == 7


def test_runs_of_chunks():
    got = media.demux(media.box(b"moov", track([10, 50, 90, 200], [(1, 2, 1), (3, 1, 1), (4, 3, 1)], 4, 8, [1, 5])))
    assert got["offset"].tolist() == [10, 14, 50, 54, 90, 200, 204, 208] and got["keyframes"].tolist() == [0, 4]


def test_wide_boxes():
    inner = track([100], [(1, 1, 1)], 5, 1, None)
    wide = struct.pack(">I4sQ", 1, b"moov", len(inner) + 16) + inner
    assert media.demux(wide)["samples"] == 1 and media.demux(struct.pack(">I4s", 0, b"moov") + inner)["samples"] == 1


def test_damaged_counts_make_nothing_large():
    whole = bytearray(media.mux(media.padded(b"word " * 300)))
    for kind in (b"stsz", b"stss", b"stsc", b"stco", b"stts"):
        at = whole.index(kind) + 8
        for skip in (0, 4):
            bad = bytearray(whole)
            bad[at + skip : at + skip + 4] = b"\xff\xff\xff\xff"
            info = media.demux(bytes(bad))
            assert info["samples"] <= 8 and len(info["offset"]) == len(info["size"]) == info["samples"] and len(media.payload_of(bytes(bad), info)) <= len(bad)
    most = 0xFFFFFFFF
    everything = bytearray(media.box(b"moov", track([0], [(1, most, 1)], 1, most, None)))
    assert media.demux(bytes(everything))["samples"] <= len(everything)
    rng = random.Random(6)
    for _ in range(1500):
        bad = bytearray(whole)
        for _ in range(rng.randint(1, 6)):
            bad[rng.randrange(len(bad))] = rng.randrange(256)
        cut = bytes(bad[: rng.choice([len(bad), rng.randrange(len(bad))])])
        assert media.demux(cut)["samples"] < 1 << 16
    nested = b""
    for _ in range(3000):
        nested = media.box(b"moov", nested)
    assert media.demux(nested)["codec"] is None


def test_durations_of_over_32_bits():
    table = media.mux(b"x" * 192)
    assert b"mdhd\0" in table
    wide = media.box(b"moov", track([8], [(1, 1, 1)], 5, 1, None, version=1))
    assert media.demux(wide)["duration"] == 7


def test_columns_against_brute_force(spark):
    texts = [None, "", "a", "é" * 100, "x" * 192, "long " * 30_000, "a"]
    rows = [(k, t, "clash", 1) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, media string, n_bytes int")
    got = {r.doc_id: r for r in media.describe(media.store(docs)).collect()}
    for k, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b" " * (-len(raw) % 192 or 192 * (not raw))
        stored, r = media.mux(payload), got[k]
        at, n = stored.index(payload), len(payload) // 192
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (r.media_bytes, r.media_sha256, r.codec, r.duration_s) == (len(stored), hashlib.sha256(stored).hexdigest(), "raw ", len(payload) / 8000)
        assert [(x.offset, x.length) for x in r.keyframes] == [(at + 192 * j, 192) for j in range(0, n, 16)]
    assert got[2].feature == got[6].feature != got[3].feature
    assert all(r.feature for r in got.values())
