"""Token ids of Arrow text columns, through a table of distinct words.

The vocabulary's pre-tokenizer drops white space and no token crosses it, so a
text's ids are the ids of its white-space separated words in a row.  Each
distinct word of a batch is looked up once; only words not remembered reach
the tokenizer.
"""

from __future__ import annotations

import ctypes
import re
import sys
import types
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext

#: Words remembered by one Python worker; beyond it, those that came up only once are forgotten.  Longer
#: words than ``LONG_WORD`` are never remembered, so the table is bounded in bytes, too.
TABLE_WORDS = 300_000
LONG_WORD = 48
MOST_IDS = 16 * TABLE_WORDS
CHUNK_BYTES = 2 << 20


def worker_state(key, make):
    """A value that lives as long as the Python worker, over all tasks that it runs."""
    kept = sys.modules.setdefault("_retentio_worker_state", types.ModuleType("_retentio_worker_state")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]


def stage_state(key, make):
    """A value that lives until the Python worker runs ``leave_stage`` in a task of another stage."""
    states = worker_state("stages", dict)
    if key not in states:
        states[key] = [None, make()]
    states[key][0] = stage_id()
    return states[key][1]


def stage_id() -> int | None:
    task = TaskContext.get()
    return task.stageId() if task else None


def leave_stage() -> None:
    """Let go of what other stages kept: a reused worker would hold it beside the work of its own."""
    states, now = worker_state("stages", dict), stage_id()
    old = [key for key, (stage, _) in states.items() if stage != now]
    for key in old:
        del states[key]
    if old:
        give_back()


def give_back() -> None:
    """Return freed memory to the system: a reused worker would hold the most that any stage took."""
    pa.default_memory_pool().release_unused()
    trim = worker_state("trim", lambda: getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0))
    trim(0)


def text_chunks(batch: pa.RecordBatch, column: str, most: int = CHUNK_BYTES):
    """``batch`` in runs of rows whose texts take about ``most`` bytes; one longer text is a run."""
    leave_stage()
    n = batch.num_rows
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    run = np.cumsum(sizes) // most if n else sizes
    cuts = np.flatnonzero(np.diff(run)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), n]):
        if b > a:
            yield batch.slice(a, b - a)
    give_back()


def large(texts: pa.Array) -> pa.LargeStringArray:
    """A compact large-string copy, nulls as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    return pa.concat_arrays([texts]) if texts.offset == 0 else pa.concat_arrays([texts.slice(0, 0), texts])


def buffers(texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a large-string array."""
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def from_buffers(raw: np.ndarray, off: np.ndarray) -> pa.LargeStringArray:
    return pa.LargeStringArray.from_buffers(len(off) - 1, pa.py_buffer(np.ascontiguousarray(off, np.int64)),
                                            pa.py_buffer(np.ascontiguousarray(raw)))


def spread(texts: pa.LargeStringArray) -> pa.LargeStringArray:
    """Fewer distinct words, same ids: A-Z lower-cased unless a non-ASCII character follows (it may
    combine), and a space between a-z and the punctuation after it (a token boundary anyway)."""
    raw, off = buffers(texts)
    raw = raw.copy()
    if len(raw) < 2:
        return texts
    plain = np.r_[raw[1:] < 0x80, True]
    raw += ((raw >= 65) & (raw <= 90) & plain).astype(np.uint8) * np.uint8(32)
    stops = np.zeros(256, bool)
    stops[[ord(c) for c in ".,;:!?"]] = True
    at = np.flatnonzero((raw[:-1] >= 97) & (raw[:-1] <= 122) & stops[raw[1:]]) + 1
    return from_buffers(np.insert(raw, at, 32), off + np.searchsorted(at, off, "left"))


#: A word of these letters alone is one piece for the vocabulary and stays as it is in normal form.
LETTERS = "[A-Za-zÀ-ÖØ-öø-ÿ]+"


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet for Latin-1 letters beyond ASCII: a printable byte stands for itself,
    the n-th of the others for the character 256 + n."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    of = {b: chr(b) if b in printable else chr(256 + others.index(b)) for b in range(256)}
    return {c: "".join(of[x] for x in chr(c).encode()) for c in range(0xC0, 0x100)}


class WordIds:
    """Ids of words, remembered."""

    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_str(tokenizer_json)
        self.model = self.tok.model
        self.letters, self.bytes = re.compile(LETTERS).fullmatch, byte_letters()
        self.clear()

    def clear(self):
        self.place, self.flat, self.starts = {}, np.zeros(1 << 16, np.uint32), np.zeros(1 << 12, np.int64)
        self.n, self.uses = 0, np.zeros(1 << 12, np.int32)

    def _letter_ids(self, words: list[str]) -> tuple[list[int], list[int]]:
        """(ids in a row, number of ids of each) of words of letters."""
        ids, lens = [], []
        for w in " ".join(words).lower().split(" "):
            got = self.model.tokenize(w if w.isascii() else w.translate(self.bytes))
            lens.append(len(got))
            ids += [t.id for t in got]
        return ids, lens

    def _add(self, words: list[str]) -> np.ndarray:
        """Ids of ``words`` behind those of the ``n`` words so far; the place of each word."""
        plain = np.asarray([w.isalpha() and (w.isascii() or self.letters(w) is not None) for w in words], bool)
        letters = [w for w, x in zip(words, plain.tolist()) if x]
        ids, lens = self._letter_ids(letters) if letters else ([], [])
        for g in self.tok.encode_batch_fast([w for w, x in zip(words, plain.tolist()) if not x], add_special_tokens=False):
            got = g.ids
            lens.append(len(got))
            ids += got
        base, n = int(self.starts[self.n]), self.n + len(words)
        while base + len(ids) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        while n + 1 > len(self.starts):
            self.starts = np.concatenate((self.starts, np.zeros_like(self.starts)))
            self.uses = np.concatenate((self.uses, np.zeros_like(self.uses)))
        self.flat[base:base + len(ids)] = ids
        self.starts[self.n + 1:n + 1] = base + np.cumsum(lens)
        self.uses[self.n:n] = 0
        self.n, first = n, self.n
        # words of letters lie in front of the others
        return first + np.where(plain, np.cumsum(plain) - 1, len(letters) + np.cumsum(~plain) - 1)

    def _shrink(self):
        """Keep the words that came up again since the last time, at most half a table, and forget the others."""
        uses = self.uses[:self.n]
        most = np.sort(uses)[::-1][min(self.n - 1, TABLE_WORDS // 2)]
        old = [(w, i) for w, i in self.place.items() if uses[i] > max(1, most)]
        places = np.asarray([i for _, i in old], np.int64)
        lens = self.starts[places + 1] - self.starts[places]
        total = np.r_[0, np.cumsum(lens)]
        kept = self.flat[np.repeat(self.starts[places] - total[:-1], lens) + np.arange(total[-1])]
        self.clear()
        self.place = dict(zip((w for w, _ in old), range(len(old))))
        self.n, self.starts, self.uses = len(old), np.r_[total, np.zeros(1 << 12, np.int64)], np.zeros(
            len(total) + (1 << 12), np.int32)
        self.flat = np.r_[kept, np.zeros(1 << 16, np.uint32)]

    def lookup(self, words: list[str]) -> tuple[np.ndarray, int]:
        """(place of each distinct word in the table, number of words that stay in it).  New words are
        added; one of more than ``LONG_WORD`` characters stays only until ``forget``."""
        if len(self.place) + len(words) > TABLE_WORDS and len(self.place):
            self._shrink()
        where = np.fromiter(map(self.place.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(where < 0)
        fresh = [words[i] for i in new.tolist()]
        long = np.asarray([len(w) > LONG_WORD for w in fresh], bool)
        short = new[~long]
        for i in range(0, len(short), 4096):
            at = short[i:i + 4096]
            add = [words[j] for j in at.tolist()]
            where[at] = self._add(add)
            self.place.update(zip(add, where[at].tolist()))
        stay = self.n
        if len(short) < len(new):
            where[new[long]] = self._add([words[i] for i in new[long].tolist()])
        self.uses[where] += 1
        return where, stay

    def forget(self, stay: int):
        self.n = stay
        if len(self.flat) > MOST_IDS:  # room taken by long words alone
            self.flat = self.flat[:max(1 << 16, int(self.starts[stay]))].copy()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, offsets of the texts in it)."""
        split = pc.ascii_split_whitespace(spread(large(texts)))
        off = split.offsets.to_numpy().astype(np.int64)
        coded = split.values.slice(off[0], off[-1] - off[0]).dictionary_encode()
        places, stay = self.lookup(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        where, starts = places[coded.indices.to_numpy(zero_copy_only=False)], self.starts
        lens = starts[where + 1] - starts[where] if len(where) else np.zeros(0, np.int64)
        total = np.r_[0, np.cumsum(lens)]
        flat = self.flat[np.repeat(starts[where] - total[:-1], lens) + np.arange(total[-1])] if len(where) else \
            np.zeros(0, np.uint32)
        self.forget(stay)
        return flat, total[off - off[0]]
