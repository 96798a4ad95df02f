"""Logs that grow in place: ranges, batches, streams, restarts."""

import io
import random

import pytest

from quillgraph.sources import growing
from quillgraph.streaming import drain


def test_every_line_lies_in_one_range(monkeypatch):
    r = random.Random(3)
    for block in (1, 3, 64):
        monkeypatch.setattr(growing, "BLOCK", block)
        for _ in range(60):
            body = b"".join(bytes(r.choice(b"ab\n") for _ in range(r.randint(0, 9))) + b"\n" for _ in range(r.randint(0, 8)))
            want, place = [], 0
            for line in body.split(b"\n")[:-1]:
                want.append((place, line))
                place += len(line) + 1
            for step in (1, 2, 5, 100):
                got = []
                for a in range(0, len(body), step):
                    for part in growing.lines(io.BytesIO(body), a, min(a + step, len(body)), len(body)):
                        got += part
                assert got == want


def test_batch_and_stream_agree_while_a_file_grows(spark, tmp_path):
    log, at = tmp_path / "log", str(tmp_path / "out")
    log.mkdir()
    (log / "_hidden").write_text("no\n")
    (log / "empty").write_text("")
    a, b = log / "a.jsonl", log / "b.jsonl"

    def now():
        rows = drain.drained_at(growing.follow(spark, str(log), "n bigint, t string", 16), at)
        return sorted((r.n, r.t) for r in rows.collect())

    a.write_bytes(b'{"n": 1, "t": "x"}\n\n{"n": 2, "t": "' + "é".encode() * 200 + b'"}\n{"n": 3, "t"')
    first = [(1, "x"), (2, "é" * 200)]
    assert now() == first  # a record that is being written waits
    with a.open("ab") as f:
        f.write(b': "y"}\n')
    b.write_bytes(b'{"n": 4, "t": "\xff"}\n{"n": 5}\n')
    second = first + [(3, "y"), (4, "�"), (5, None)]
    assert now() == second
    assert now() == second  # nothing new, nothing twice
    batch = growing.read(spark, str(log), "n bigint, t string", 16)
    assert sorted((r.n, r.t) for r in batch.collect()) == second
    assert batch.rdd.getNumPartitions() > 10
    raw = growing.read(spark, str(log)).collect()
    assert {(r.file.rsplit("/", 1)[1], r.at) for r in raw} >= {("a.jsonl", 0), ("b.jsonl", 0)} and len(raw) == 6
    assert growing.read(spark, str(tmp_path / "none")).count() == 0


def test_a_log_that_shrank_fails(spark, tmp_path):
    (tmp_path / "log").mkdir()
    f = tmp_path / "log" / "a"
    f.write_text("one\ntwo\n")
    assert drain.drained_at(growing.follow(spark, str(tmp_path / "log")), str(tmp_path / "o")).count() == 2
    f.write_text("one\n")
    with pytest.raises(Exception, match="shorter"):
        drain.drained_at(growing.follow(spark, str(tmp_path / "log")), str(tmp_path / "o"))
