import io
import json
import struct
import tarfile

import numpy as np
import pytest

from atril.sources import archives, audio, jsonl
from atril.sources.jsonl import DataUnavailableError


def wav(x, rate, bits=16):
    """A WAV file of frames x channels between -1 and 1."""
    data = np.rint(x * (2 ** (bits - 1) - 1)).astype("<i4").ravel()
    raw = b"".join(int(v).to_bytes(bits // 8, "little", signed=True) for v in data)
    head = struct.pack("<HHIIHH", 1, x.shape[1], rate, 0, x.shape[1] * bits // 8, bits)
    chunk = b"LIST" + struct.pack("<I", 3) + b"abc\0"
    return b"RIFF\0\0\0\0WAVEfmt " + struct.pack("<I", 16) + head + chunk + b"data" + struct.pack("<I", len(raw)) + raw


def tone(rate, hz=440, seconds=0.5):
    return 0.5 * np.sin(2 * np.pi * hz * np.arange(int(rate * seconds)) / rate)


@pytest.mark.parametrize("rate", [8000, 16000, 44100, 48000])
def test_resampling(rate):
    got = audio.load_16k(wav(np.stack([tone(rate)] * 2, 1), rate))
    assert len(got) == 8000 and np.abs(got - tone(16000))[200:-200].max() < 2e-3


def test_a_tone_beyond_the_new_rate_goes():
    assert np.abs(audio.resampled(tone(48000, hz=12000), 48000))[200:-200].max() < 2e-3


@pytest.mark.parametrize("bits", [16, 24, 32])
def test_sample_sizes(bits):
    assert np.abs(audio.load_16k(wav(tone(16000)[:, None], 16000, bits)) - tone(16000)).max() < 1e-4


def test_write_and_clip(tmp_path):
    pcm = audio.write_wav_16k(wav(tone(16000)[:, None], 16000), tmp_path / "a" / "x.wav")
    assert [p.name for p in (tmp_path / "a").iterdir()] == ["x.wav"]
    assert np.array_equal(np.rint(audio.load_16k((tmp_path / "a" / "x.wav").read_bytes()) * 2**15), pcm)
    back, _ = audio.samples(audio.to_wav(np.array([2.0, -2.0, 0.0])))
    assert back[:, 0].tolist() == [1 - 2**-15, -1.0, 0.0]


def test_other_audio_and_none():
    with pytest.raises(DataUnavailableError):
        audio.load_16k(b"fLaC")
    assert len(audio.load_16k(wav(np.zeros((0, 1)), 8000))) == 0


def test_decoded_frame(spark):
    rows = spark.createDataFrame([("a", bytearray(wav(tone(8000)[:, None], 8000))), ("b", None)], "path string, content binary")
    got = {r["path"]: r for r in audio.decoded(rows).collect()}
    assert got["a"]["duration_s"] == 0.5 and len(got["a"]["wav"]) == 44 + 16000
    assert got["b"]["wav"] is None and got["b"]["duration_s"] is None


def test_tar(spark, tmp_path):
    with tarfile.open(tmp_path / "x.tar.gz", "w:gz") as tar:
        for name, content in (("d/a.wav", b"one"), ("d/b.wav", b"two"), ("e/a.wav", b"again"), ("c.wav", b"")):
            info = tarfile.TarInfo(name)
            info.size = len(content)
            tar.addfile(info, io.BytesIO(content))
    got = lambda wanted: {r["name"]: bytes(r["content"]) for r in archives.read_tar(spark, str(tmp_path), wanted).collect()}
    assert got(None) == {"a.wav": b"one", "b.wav": b"two", "c.wav": b""}
    assert got({"a.wav", "zz"}) == {"a.wav": b"one"} and got(set()) == {}


def test_first_tsv(spark, tmp_path):
    (tmp_path / "x.tsv").write_text('1\ta\tfirst "one\n2\ta\tsecond\n3\tb\n4\tc\tñ\n')
    assert {r["key"]: r["value"] for r in archives.first_tsv(spark, str(tmp_path / "x.tsv"), 1, 2).collect()} == {"a": 'first "one', "c": "ñ"}


def test_folders(spark, tmp_path):
    for model in ("m", "n"):
        (tmp_path / model).mkdir()
        (tmp_path / model / "real.jsonl").write_text('{"clip_id": "1"}\n\n{"clip_id": "2"}\n')
        (tmp_path / model / "other.jsonl").write_text('{"clip_id": "1"}\n')
    for name, text in (("a", json.dumps({"label": "A", "model_id": "x", "model": "r1"}, indent=2)), ("b", "[]"), ("c", "{"), ("d", json.dumps({"label": "D", "model": "r2"}))):
        (tmp_path / "m" / f"{name}.run.json").write_text(text)
    got = archives.discovered(spark, str(tmp_path), ["real"]).collect()
    assert sorted((r["model"], r["subset"], r["line_no"]) for r in got) == [("m", "real", 1), ("m", "real", 3), ("n", "real", 1), ("n", "real", 3)]
    want = {"type": "local-run", "runner": "r2", "label": "A", "model_id": "x"}
    assert archives.run_infos(spark, str(tmp_path)) == {"m": want}
    assert archives.run_infos(spark, str(tmp_path), ("m",))["m"]["runner"] == "m"


def test_lines_of_split_files(spark, tmp_path):
    rows = [f'{{"clip_id": "c{k}", "hyp": "{"x" * (k % 50)}"}}' if k % 7 else "" for k in range(3000)]
    rows[500], rows[501], rows[502] = "[1]", '{"cut', "\ufffd"
    (tmp_path / "a.jsonl").write_text("\n".join(rows))
    (tmp_path / "b.jsonl").write_bytes(b'{"clip_id": "z"}\n{"clip_id": "\xff"}\r\n  \n{"clip_id": "y", "hyp": "\xef\xbf\xbd"}\n')
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        got = {(r.file.rsplit("/", 1)[-1], r.line_no): (r.value, r.valid) for r in jsonl.lines(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert {n: v for (f, n), v in got.items() if f == "a.jsonl"} == {k + 1: (x, k not in (500, 501, 502)) for k, x in enumerate(rows) if x.strip()}
    assert {n: v for (f, n), (_, v) in got.items() if f == "b.jsonl"} == {1: True, 2: False, 4: True}
