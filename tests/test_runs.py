"""Run loop, registry, hosted runner, streaming folds, subsets and downloads."""

import http.server
import json
import struct
import sys
import threading
import time

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from atril.functions import columns
from atril.operators import http_runner, registry, runs
from atril.sources import audio, download, jsonl, subsets
from atril.streaming import turns


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers do not have this module


class Fake(runs.Runner):
    name, batch_size, backoff_s, env_vars = "fake", 3, (0.0, 0.0), ()

    def warmup(self):
        pass

    def transcribe(self, row):
        if row["clip_id"] == "c4":
            raise runs.FatalError("token SECRETO was refused " + "x" * 900)
        return f"texto {len(row['audio'])}"

    def transcribe_batch(self, rows):
        if any(r["clip_id"] == "c2" for r in rows):
            raise RuntimeError("a batch fails")
        return super().transcribe_batch(rows)

    def secrets(self):
        return ["SECRETO"]


def clips(spark, n=8):
    return spark.createDataFrame([(f"c{k}", [0.0] * k) for k in range(n)], "clip_id string, audio array<float>")


def test_a_run_goes_on(spark, tmp_path):
    path, said = tmp_path / "r" / "fake.jsonl", []
    runs.run_file(Fake(), clips(spark, 5), path, "s", said.append)
    rows = {r["clip_id"]: r for r in jsonl.read_lines(path)}
    assert rows["c2"]["hyp"] == "texto 2" and "error" not in rows["c2"] and rows["c4"]["hyp"] == "" and len(rows["c4"]["error"]) == 500 and "***" in rows["c4"]["error"] and "SECRETO" not in path.read_text()
    about = json.loads((tmp_path / "r" / "fake.run.json").read_text())
    assert about["model"] == "fake" and about["n_clips"] == 5 and about["n_errors_last_run"] == 1 and about["subset"] == "s"
    with path.open("a") as out:
        out.write('{"clip_id": "c3", "hy')
    runs.run_file(Fake(), clips(spark, 8), path, "s", said.append)
    again = jsonl.read_lines(path)
    assert sorted(r["clip_id"] for r in again) == [f"c{k}" for k in range(8)] and any("incomplete" in x for x in said)
    path.write_text('{"clip_id": "c0", "hyp": "a"}\nbroken\n{"clip_id": "c1", "hyp": "b"}\n')
    with pytest.raises(jsonl.MalformedFileError, match="line 2"):
        runs.run_file(Fake(), clips(spark, 3), path, "s", said.append)


def test_nothing_left_and_missing_environment(spark, tmp_path, monkeypatch):
    path = tmp_path / "x.jsonl"
    jsonl.write_lines(path, [{"clip_id": f"c{k}", "hyp": "é"} for k in range(2)])
    assert runs.run_file(Fake(), clips(spark, 2), path, "s", lambda m: None) == path and not (tmp_path / "x.run.json").exists() and "é" in path.read_text()
    needs = Fake()
    needs.env_vars = ("ATRIL_TEST_KEY",)
    monkeypatch.delenv("ATRIL_TEST_KEY", raising=False)
    with pytest.raises(RuntimeError, match="ATRIL_TEST_KEY"):
        runs.run_file(needs, clips(spark, 4), path, "s", lambda m: None)


def test_retries():
    waits, left = [], [runs.RetryableError("a"), runs.RetryableError("b")]

    def attempt():
        if left:
            raise left.pop()
        return "done"

    assert runs.with_retries(attempt, sleep=waits.append) == "done" and 2 <= waits[0] <= 3 and 4 <= waits[1] <= 5
    calls = []
    with pytest.raises(runs.FatalError):
        runs.with_retries(lambda: calls.append(1) or (_ for _ in ()).throw(runs.FatalError("no")), (0.0,))
    assert len(calls) == 1
    with pytest.raises(runs.RetryableError):
        runs.with_retries(lambda: calls.append(1) or (_ for _ in ()).throw(runs.RetryableError("no")), (0.0, 0.0))
    assert len(calls) == 4 and isinstance(runs.status_error(429, ""), runs.RetryableError) and isinstance(runs.status_error(404, ""), runs.FatalError)


def test_registry(spark):
    assert list(registry.REGISTRY) == sorted(registry.REGISTRY) and len(registry.LOCAL_NAMES) == 11 and len(registry.REMOTE_NAMES) == 4
    with pytest.raises(RuntimeError, match="twice"):
        registry.joined({"a": 1, "b": 2}, {"b": 3})
    with pytest.raises(KeyError, match="unknown model"):
        registry.get(registry.REGISTRY, "nobody")
    with pytest.raises(ImportError, match="'whisper'"):
        registry.get(registry.REGISTRY, "whisper_large_v3")
    assert registry.get(registry.REGISTRY, "echo").transcribe({"audio": [0.0] * 3}) == "texto 3"
    rows = registry.flagged(spark.createDataFrame([("openai_compatible",), ("echo",), (None,), ("x",)], "runner string")).collect()
    assert {r.runner: (r.registered, r.experimental) for r in rows} == {"openai_compatible": (True, True), "echo": (True, False), None: (False, False), "x": (False, False)}


@pytest.fixture
def server():
    seen, replies = [], []

    class Handler(http.server.BaseHTTPRequestHandler):
        def answer(self):
            seen.append((self.path, dict(self.headers), self.rfile.read(int(self.headers.get("Content-Length") or 0))))
            status, headers, body = replies.pop(0)
            self.send_response(status)
            for k, v in headers.items():
                self.send_header(k, v)
            self.end_headers()
            self.wfile.write(body)

        do_GET = do_POST = answer

        def log_message(self, *_):
            pass

    made = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=made.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{made.server_port}", seen, replies
    made.shutdown()


def test_hosted_runner(server, monkeypatch):
    address, seen, replies = server
    monkeypatch.setenv(http_runner.KEY, "SECRETO")
    runner = http_runner.HttpRunner(base_url=address + "/v1/", model="m", backoff_s=(0.0,))
    runner.load()
    said = lambda: runs.with_retries(lambda: runner.transcribe({"audio": np.zeros(160, np.float32)}), runner.backoff_s)
    replies += [(503, {}, b"busy"), (200, {"Content-Type": "application/json"}, b'{"text": " hola "}')]
    assert said() == "hola" and len(seen) == 2 and seen[0][0] == "/v1/audio/transcriptions" and seen[0][1]["Authorization"] == "Bearer SECRETO"
    assert b'name="model"\r\n\r\nm\r\n' in seen[0][2] and b"RIFF" in seen[0][2] and b'filename="audio.wav"' in seen[0][2]
    replies += [(401, {}, b"SECRETO is wrong"), (200, {}, b"plain "), (200, {}, b'{"x": 1}'), (200, {"Content-Type": "application/json"}, b"{"), (200, {"Content-Type": "application/json"}, b"{")]
    with pytest.raises(runs.FatalError, match="401") as error:
        said()
    assert "SECRETO" not in str(error.value) and said() == "plain"
    with pytest.raises(runs.FatalError, match="without a text"):
        said()
    with pytest.raises(runs.RetryableError, match="no JSON"):
        said()
    gone = http_runner.HttpRunner(base_url="http://127.0.0.1:9", model="m", backoff_s=())
    with pytest.raises(runs.RetryableError):
        gone.transcribe({"audio": []})


SOURCE = subsets.Source("d/x", "rev1", "es_419", "test", ("data/t.tsv", "data/t.tar.gz"))


def test_downloads(server, tmp_path, monkeypatch):
    address, seen, replies = server
    monkeypatch.setenv(download.TOKEN, "tok")
    where = address + "/{dataset}/{revision}/{file}"
    replies += [(500, {}, b""), (200, {"Content-Length": "9"}, b"short"), (302, {"Location": address.replace("127.0.0.1", "localhost") + "/other"}, b""), (200, {"Content-Length": "5"}, b"whole")]
    path = download.fetch(SOURCE, "a/f.bin", tmp_path, where, wait=0.0)
    assert path.read_bytes() == b"whole" and path == tmp_path / "d__x" / "rev1" / "a" / "f.bin" and not list(path.parent.glob("*.part"))
    assert seen[0][0] == "/d/x/rev1/a/f.bin" and seen[2][1]["Authorization"] == "Bearer tok" and "Authorization" not in seen[3][1]
    assert download.fetch(SOURCE, "a/f.bin", tmp_path, where) == path and len(seen) == 4
    replies += [(500, {}, b"")] * 2
    with pytest.raises(OSError):
        download.fetch(SOURCE, "b", tmp_path, where, retries=2, wait=0.0)
    download.discard(SOURCE, tmp_path)
    assert not tmp_path.exists()


def packed(tmp_path, files):
    import io
    import tarfile

    with tarfile.open(tmp_path / "t.tar.gz", "w:gz") as tar:
        for name, data in files.items():
            info = tarfile.TarInfo(f"test/{name}")
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))


def test_building_a_subset(spark, tmp_path):
    small = {"fleurs_es": subsets.Subset("fleurs_es", subsets.PUBLIC, 3, "test", "x")}
    wavs = {f"w{k}.wav": audio.to_wav(np.full(1600 * (k + 1), 0.1, np.float32)) for k in range(4)}
    packed(tmp_path, wavs)
    (tmp_path / "t.tsv").write_text("".join(f"{k}\tw{k}.wav\tTexto {k}\tx\n" for k in range(4)) + "9\tw0.wav\tlater\tx\n")
    get = {"data/t.tsv": str(tmp_path / "t.tsv"), "data/t.tar.gz": str(tmp_path / "t.tar.gz")}.__getitem__
    source = {"dataset": "d/x", "revision": "rev1", "config": "es_419", "split": "test"}
    pcm = lambda k: np.frombuffer(wavs[f"w{k}.wav"], "<i2", offset=44)
    rows = [{"clip_id": f"c{k}", "text": f"Texto {k}", "source": {**source, "id": f"w{k}.wav"}, "num_samples": len(pcm(k)), "sha256": columns.pcm16_sha256(pcm(k)) if k else "no", "meta": {"gender": "f"}} for k in (2, 0, 1)]
    jsonl.write_lines(tmp_path / "m.jsonl", rows)
    build = lambda **more: subsets.build(spark, "fleurs_es", str(tmp_path / "data"), str(tmp_path / "m.jsonl"), get, sources={"fleurs_es": SOURCE}, subsets=small, log=lambda m: None, **more)
    report = build()
    assert report["n_clips"] == 3 and report["n_audio_identical"] == 2 and report["audio_mismatches"][0]["clip_id"] == "c0" and report["hours"] == round(0.6 / 3600, 4)
    made = subsets.load(spark, "fleurs_es", str(tmp_path / "data"), subsets=small).orderBy("ord").collect()
    assert [r.clip_id for r in made] == ["c2", "c0", "c1"] and made[0].meta == {"gender": "f", "source": "d/x@rev1", "source_id": "w2.wav", "duration_s": "0.3"}
    assert len(subsets.load(spark, "fleurs_es", str(tmp_path / "data"), limit=2, subsets=small).collect()) == 2
    assert build() == report and build(force=True)["n_clips"] == 3
    (tmp_path / "data" / "fleurs_es" / "audio" / "c1.wav").unlink()
    assert not subsets.built(tmp_path / "data" / "fleurs_es", 3)
    for change, error, match in (({"text": "otro"}, RuntimeError, "differs"), ({"source": {**source, "id": "gone.wav"}}, RuntimeError, "not found"), ({"source": {**source, "revision": "r2", "id": "w1.wav"}}, ValueError, "unexpected source"), ({"source": rows[0]["source"]}, ValueError, "occurs 2 times")):
        jsonl.write_lines(tmp_path / "m.jsonl", [*rows[:2], {**rows[2], **change}])
        with pytest.raises(error, match=match):
            build(force=True)
    with pytest.raises(ValueError, match="declared"):
        jsonl.write_lines(tmp_path / "m.jsonl", rows[:2])
        build(force=True)


def test_clinical_tables(spark, tmp_path):
    small = {"clinical_dev": subsets.Subset("clinical_dev", subsets.CLINICAL, 3, "dev", "x")}
    rows = [("a", "t1", ["x"], "s1", 1.5), ("b", "t2", None, "s1", None), ("c", None, [], None, 2.0)]
    spark.createDataFrame(rows, "clip_id string, text string, terms array<string>, text_id string, duration_s double").coalesce(1).write.parquet(str(tmp_path / "tmp"))
    (tmp_path / "data" / "clinical_dev").mkdir(parents=True)
    next((tmp_path / "tmp").glob("*.parquet")).rename(tmp_path / "data" / "clinical_dev" / "test-00000-of-00001.parquet")
    got = subsets.load(spark, "clinical_dev", str(tmp_path), subsets=small).orderBy("ord").collect()
    assert [(r.ord, r.clip_id, r.terms) for r in got] == [(0, "a", ["x"]), (1, "b", []), (2, "c", [])] and got[1].meta == {"text_id": "s1", "duration_s": None} and subsets.has_terms(subsets.load(spark, "clinical_dev", str(tmp_path), subsets=small))
    with pytest.raises(jsonl.DataUnavailableError, match="clinical_test"):
        subsets.load(spark, "clinical_test", str(tmp_path))
    with pytest.raises(FileNotFoundError, match="manifest"):
        subsets.load(spark, "fleurs_es", str(tmp_path))
    with pytest.raises(KeyError, match="unknown subset"):
        subsets.subset("x")
    (tmp_path / "data" / "clinical_dev" / "dev.parquet").write_bytes((tmp_path / "data" / "clinical_dev" / "test-00000-of-00001.parquet").read_bytes())
    with pytest.raises(ValueError, match="single split"):
        subsets.load(spark, "clinical_dev", str(tmp_path), subsets=small)


def test_routes(spark):
    vox = spark.createDataFrame([("v1", " Hola ", (b"x", "p"))], "audio_id string, raw_text string, audio struct<bytes: binary, path: string>")
    media = spark.createDataFrame([((b"x", "a/b.c.wav"), " uno \t dos\xa0tres ")], "audio struct<bytes: binary, path: string>, sentence string")
    assert subsets.routed("voxpopuli_es", vox).first()[:2] == ("v1", "Hola") and subsets.routed("mediaspeech_health", media).first()[:2] == ("b.c", "uno dos tres")


EVENTS = "clip_id string, seq long, kind string, event string, turn_index int, text string, is_final boolean"


def told(*rows):
    return [("c", k, "TurnInfo", *r, False) for k, r in enumerate(rows)]


TURNS = {
    "ended": (told(("StartOfTurn", 0, ""), ("Update", 0, "Hol"), ("EndOfTurn", 0, "Hola."), ("Update", 0, "late"), ("Update", 1, ""), ("StartOfTurn", 1, ""), ("EndOfTurn", 1, " ¿Qué tal? ")), "Hola. ¿Qué tal?"),
    "open": (told(("EndOfTurn", 0, "Hola."), ("StartOfTurn", 1, ""), ("Update", 1, "qué"), ("Update", 1, "qué tal")), "Hola. qué tal"),
    "emptied": (told(("EndOfTurn", 0, "Hola."), ("Update", 1, "qué"), ("Update", 1, "")), "Hola."),
}


@pytest.mark.parametrize("name", TURNS)
def test_turns_in_batch_and_as_a_stream(spark, tmp_path, name):
    rows, want = TURNS[name]
    events = spark.createDataFrame(rows, EVENTS)
    assert turns.turns(events).first()["text"] == want
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = turns.stream_turns(spark.readStream.schema(EVENTS).parquet(str(tmp_path / "in")), flush_s=0.5)
    query = stream.writeStream.format("memory").queryName(f"turns_{name}").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="200 milliseconds").start()
    try:
        deadline = time.time() + 40
        while time.time() < deadline:
            got = " ".join(r["text"] for r in spark.table(f"turns_{name}").orderBy("turn_index").collect())
            if got == want and (name != "emptied" or time.time() > deadline - 36):
                break
            time.sleep(0.3)
    finally:
        query.stop()
    assert got == want


def test_results_and_outcomes(spark):
    rows = [("a", 1, "Results", "Primer segmento.", True, False), ("a", 2, "Results", "inter", False, False), ("a", 3, "Results", " Segundo. ", True, True), ("b", 1, "Results", "x", True, False), ("c", 1, "Metadata", None, None, None)]
    folded = turns.final_results(spark.createDataFrame(rows, "clip_id string, seq long, kind string, text string, is_final boolean, from_finalize boolean"))
    assert {r.clip_id: (r.text, r.finalized, r.complete) for r in folded.collect()} == {"a": ("Primer segmento. Segundo.", True, True), "b": ("x", False, False), "c": ("", False, True)}
    assert {r.clip_id: (r.hyp, bool(r.error)) for r in turns.outcomes(folded).collect()} == {"a": ("Primer segmento. Segundo.", False), "b": ("", True), "c": ("", False)}


def test_frames_and_pace():
    got = turns.frames(b"\1" * 7000, 0.5)
    assert [len(x) for x in got] == [3200, 3200, 600] + [3200] * 5 and b"".join(got[:3]) == b"\1" * 7000
    now, waits = [0.0], []

    def sleep(s):
        waits.append(round(s, 3))
        now[0] += s

    parts = turns.paced([1, 2, 3], clock=lambda: now[0], sleep=sleep)
    assert next(parts) == 1
    now[0] += 0.07
    assert list(parts) == [2, 3] and waits == [0.03, 0.1]


def test_paced_stream(spark, tmp_path):
    query = turns.paced_stream(spark).writeStream.format("memory").queryName("paced").option("checkpointLocation", str(tmp_path)).start()
    try:
        deadline = time.time() + 20
        while time.time() < deadline and spark.table("paced").count() < 10:
            time.sleep(0.3)
    finally:
        query.stop()
    assert spark.table("paced").count() >= 10 and spark.table("paced").agg(F.count_distinct("seq")).first()[0] == spark.table("paced").count()


def test_pcm():
    x = np.array([0.0, 1.0, -1.0, 0.5, 2.0, -3.0, 1 / 65536], np.float32)
    assert struct.unpack("<7h", columns.pcm16(x)) == (0, 32767, -32768, 16384, 32767, -32768, 0)
    assert columns.scrub("a key1 b key2", "key1", "", None, "key2") == "a *** b ***"
    assert http_runner.endpoint("http://h/") == http_runner.endpoint("http://h/v1") == "http://h/v1/audio/transcriptions"
