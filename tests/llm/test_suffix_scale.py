"""What the minimizer test of ``op2`` hands on: full blobs, whatever the number of chunks and parts."""

import numpy as np
import pyarrow as pa

from retentio.llm import suffix_dedup as sd


def _texts(n, seed=3):
    r = np.random.default_rng(seed)
    words = np.array(["".join(r.choice(list("abcdefgh"), 6)) for _ in range(300)])
    return [" ".join(r.choice(words, 60)) for _ in range(n)]


def _asked(texts, parts, size):
    batch = pa.RecordBatch.from_pydict({"d": pa.array(range(len(texts)), pa.int64()), "t": pa.array([0] * len(texts), pa.int64()),
                                        "text": pa.array(texts)})
    out = [r for b in sd.ask(parts)(batch.slice(i, size) for i in range(0, len(texts), size)) for r in b.to_pylist()]
    return [r for r in out if not r["known"]], [r for r in out if r["known"]]


def _rows(blobs):
    return sorted(r for b in blobs for r in zip(*(x.tolist() for x in sd.unpacked(b["blob"]))))


def test_blobs_do_not_grow_with_chunks_times_parts():
    texts, parts = _texts(60), 16
    asked, _ = _asked(texts, parts, 1)
    assert len(asked) <= parts
    h, name, row, start, n = sd.runs(*sd.buffers(sd.large(pa.array(texts))))
    whole = sorted(zip(h.tolist(), name.tolist(), row.tolist(), [0] * len(h), start.tolist(), n.tolist()))
    assert _rows(asked) == whole
    assert all((sd.unpacked(b["blob"])[0] % parts == b["part"]).all() for b in asked)


def test_gathered_runs_are_dealt_out_when_many(monkeypatch):
    texts = _texts(60)
    monkeypatch.setattr(sd, "TOLD", 200)
    asked, _ = _asked(texts, 4, 1)
    assert len(asked) > 2 * 4
    monkeypatch.setattr(sd, "TOLD", 10**9)
    assert _rows(asked) == _rows(_asked(texts, 4, 1)[0])


def test_known_repeats_go_on_with_their_chunk():
    texts = _texts(4) * 2
    asked, known = _asked(texts, 4, len(texts))
    assert len(known) == 1 and len(asked) <= 4 and {r[2] for r in _rows(known)} == set(range(8))


def test_no_text_gives_no_blob():
    assert _asked(["", "short"], 4, 1) == ([], [])
