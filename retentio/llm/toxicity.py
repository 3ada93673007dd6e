"""Toxicity by noisy-channel deobfuscation.

Words may be written with look-alike characters, with separators between the
letters or pieces, or with letters repeated.  Each such stretch becomes a lattice - every
character offers the letters it may stand for, or nothing, at a cost - and
Viterbi search under a character language model picks the likeliest reading.
The restored text is scored by its most telling feature: a feature is a word or
its first 4 or 5 letters (5 also by how many words share them), and its probability the lower confidence bound of
the share of toxic documents among the labelled ones that have it.

The language model interpolates counts of 1 to 4 characters (UTF-8 bytes) over
the whole corpus, in hashed tables of fixed size.  Word statistics are fitted
on at most ``FIT_ROWS`` labelled rows, never on the held-out fifth (crc32 of
the doc_id as text, modulo 5, is 0); every feature whose bound is above ``LEAST``
is kept, and each of them occurs in two toxic rows at least.  Scores read the
text alone.

Defined cases: null or empty text has no words and gets the score of a text
without toxic words; a null doc_id is not held out and not fitted on; without
labelled rows every score is that of the prior; a doc_id with both labels counts
as clean; stretches are decoded whole, whatever their length (a character more
than three times in a row counts as three times); a word of letters with
doubled ones, or of pieces with separators between, is read both as it is and
decoded; two neighbouring pieces of up to ``PIECE`` letters are read as one word
where the decoding drops the space; rows with equal text get equal scores; extra
columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retentio.llm.common import Scratch, load
from retentio.llm.tokens import buffers, large, text_chunks, worker_state

FIT_ROWS = 30_000
#: Squared width of the confidence bound, and the least bound of a telling feature.
Z2, LEAST = 7.0, 0.2
#: Readings of longer stretches are not remembered.
LONGEST = 48
PIECE = 6
#: Table sizes for 1, 2, 3 and 4 characters.
SIZES = (1 << 8, 1 << 16, 1 << 18, 1 << 20)
#: What a character may stand for besides itself.
LOOKS = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s",
         "!": "i", "|": "il", "+": "t", "*": "aeiou", "#": "h", "(": "c"}
SEPARATORS = " ._-*~/"
LOOK_COST, DROP_COST, REPEAT_COST, TWICE_COST = 1.0, 0.5, 0.5, 4.0
MARKS = re.escape("".join(c for c in LOOKS if not c.isdigit()))
STRETCH = re.compile(
    # single characters with separators between them
    rf"(?<![^\W_])[a-z0-9{MARKS}](?:[ ._\-*~/]{{1,2}}[a-z0-9{MARKS}]){{3,}}(?![^\W_])"
    # a word with a look-alike inside, before or behind its letters
    rf"|(?<![^\W_])[a-z0-9{MARKS}]*(?:[a-z][0-9{MARKS}]|[0-9{MARKS}][a-z])[a-z0-9{MARKS}]*(?![^\W_])"
    # a letter three times or more
    r"|(?<![^\W_])[a-z]*([a-z])\1\1[a-z]*(?![^\W_])")
#: Pieces of letters with separators between them, or a word with a letter twice: read as they are, too.
LOOSE = re.compile(r"(?<![^\W_])(?:[a-z]+(?:[._\-*~/][a-z]+)+|[a-z]*([a-z])\1[a-z]*)(?![^\W_])")
MANY = re.compile(r"(.)\1{3,}", re.S)
WORD = re.compile(r"[^\W\d_]+")
#: A token that is read as it is: letters with punctuation behind them, and no letter three times.
PLAIN, THRICE = re.compile(r"[^\W\d_]+[.,;:?]*").fullmatch, re.compile(r"([a-z])\1\1").search


def gram_slots(raw: np.ndarray):
    """Slot of the n bytes that end at each byte from the n-th on, for n = 1 to 4."""
    code = raw.astype(np.uint32)
    for n in range(1, 5):
        if n > 1:
            code = (code[:-1] << np.uint32(8)) | raw[n - 1:].astype(np.uint32) if len(code) else code
        yield n, slot(code, n)


def slot(code, n: int):
    """Exact for one and two bytes, hashed beyond."""
    if n <= 2:
        return code
    return ((np.asarray(code, np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - (SIZES[n - 1].bit_length() - 1)))


def language_model(docs: DataFrame) -> list[np.ndarray]:
    """Counts of the corpus by slot, for 1 to 4 bytes."""
    def run(batches):
        tables = [np.zeros(s, np.int64) for s in SIZES]
        for batch in batches:
            for rows in text_chunks(batch, "text"):
                raw = buffers(large(pc.binary_join_element_wise(pc.utf8_lower(large(rows.column("text"))), *(
                    pa.scalar(x, pa.large_string()) for x in ("", " ")))))[0]
                for n, at in gram_slots(raw):
                    tables[n - 1] += np.bincount(at.astype(np.int64), minlength=SIZES[n - 1])
        for n, table in enumerate(tables, 1):
            used = np.flatnonzero(table)
            yield pa.RecordBatch.from_pydict({"n": pa.array(np.full(len(used), n), pa.int32()),
                                              "slot": pa.array(used, pa.int32()), "count": table[used]})

    got = (docs.select(docs["text"].cast("string").alias("text")).mapInArrow(run, "n int, slot int, count long")
           .groupBy("n", "slot").agg(F.sum("count").alias("count")).toArrow())
    n, at, count = (got.column(c).to_numpy() for c in ("n", "slot", "count"))
    out = []
    for i, size in enumerate(SIZES, 1):
        table = np.zeros(size, np.int64)
        table[at[n == i]] = count[n == i]
        out.append(table)
    return out


def digest_of(tables: list[np.ndarray]) -> int:
    """Names the decoder that a Python worker keeps for these tables."""
    return xxhash.xxh3_64_intdigest(b"".join(t.tobytes() for t in tables))


class Decoder:
    """Viterbi decoding of stretches under the language model; readings are remembered."""

    def __init__(self, tables: list[np.ndarray]):
        self.tables, self.total, self.seen, self.costs, self.tokens = tables, max(1, int(tables[0].sum())), {}, {}, {}

    def count(self, code: int, n: int) -> int:
        return int(self.tables[n - 1][code if n <= 2 else (code * 0x9E3779B97F4A7C15 & (2**64 - 1)) >> (64 - (SIZES[n - 1].bit_length() - 1))])

    def cost(self, context: bytes, char: int) -> float:
        """-log p(char | last three bytes), interpolated down to single bytes."""
        key = (context, char)
        if key not in self.costs:
            if len(self.costs) > 1 << 18:
                self.costs.clear()
            p = (self.count(char, 1) + 0.01) / (self.total + 2.56)
            for n in (2, 3, 4):
                code = int.from_bytes(context[4 - n:], "big")
                p = (self.count(code << 8 | char, n) + 4 * p) / (self.count(code, n - 1) + 4)
            self.costs[key] = -math.log(min(1.0, p))
        return self.costs[key]

    def offers(self, text: str, i: int):
        """(letters, cost) that character ``i`` may stand for."""
        c = text[i]
        yield c, 0.0
        for letter in LOOKS.get(c, ""):
            yield letter, LOOK_COST
        if c in SEPARATORS:
            yield "", DROP_COST
        if i and text[i - 1] == c and c.isalpha():
            run = len(text) - len(text[i:].lstrip(c)) - len(text[:i].rstrip(c))
            yield "", REPEAT_COST if run > 2 else TWICE_COST

    def read(self, text: str) -> str:
        text = MANY.sub(r"\1\1\1", text)
        if len(text) > LONGEST:
            return self.search(text)
        if text not in self.seen:
            if len(self.seen) > 200_000:
                self.seen.clear()
            self.seen[text] = self.search(text)
        return self.seen[text]

    def search(self, text: str) -> str:
        # state: the last three bytes; value: (cost, reading), a reading being its last letters and the
        # reading before them, so that a step costs the same at any length
        states = {b"   ": (0.0, None)}
        for i in range(len(text)):
            after = {}
            for letter, price in self.offers(text, i):
                for context, (cost, reading) in states.items():
                    c, ctx = cost + price, context
                    for b in letter.encode():
                        c += self.cost(ctx, b)
                        ctx = ctx[1:] + bytes([b])
                    if ctx not in after or c < after[ctx][0]:
                        after[ctx] = (c, (letter, reading))
            states = after
        reading, out = min(((c + self.cost(ctx, 32), reading) for ctx, (c, reading) in states.items()), key=lambda x: x[0])[1], []
        while reading:
            out.append(reading[0])
            reading = reading[1]
        return "".join(reversed(out))

    def restore(self, text: str) -> str:
        def one(m):
            s = m.group()
            # codes and numbers are no words: at least a third of other characters
            return self.read(s) if 3 * sum(c.isdigit() for c in s) <= 2 * len(s) else s
        return STRETCH.sub(one, text)

    def words_of(self, token: str) -> tuple[str, ...]:
        """Words of one restored token; remembered."""
        if token not in self.tokens:
            words = WORD.findall(token if PLAIN(token) and not THRICE(token) else self.restore(token))
            if LOOSE.search(token):
                words += WORD.findall(LOOSE.sub(lambda m: self.read(m.group()), token))
            if len(token) > LONGEST:
                return tuple(words)
            if len(self.tokens) > 150_000:
                self.tokens.clear()
            self.tokens[token] = tuple(words)
        return self.tokens[token]

    def features(self, text: str) -> set[str]:
        """Words of the restored text, the first letters of longer ones, and those that several
        words share."""
        tokens = text.lower().split()
        words = {w for t in set(tokens) for w in self.words_of(t)} | self.spaced(tokens)
        five = Counter(w[:5] for w in words if len(w) > 5)
        return (words | {f"4{w[:4]}" for w in words if len(w) > 4} | {f"5{w}" for w in five}
                | {f"{min(n, 3)}x{w}" for w, n in five.items() if n > 1})

    def spaced(self, tokens: list[str]) -> set[str]:
        """Words written letter by letter: four or more single characters in a row, read with and
        without the first (it may be a word)."""
        out = set()
        for run in runs_of([i for i, t in enumerate(tokens) if len(t) == 1]):
            for part in (run, run[1:]):
                if len(part) > 3:
                    out.update(WORD.findall(self.restore(" ".join(tokens[i] for i in part))))
        return out


def own_features(word: str) -> tuple[str, ...]:
    """The features that a word has by itself."""
    return (word, *([f"4{word[:4]}"] if len(word) > 4 else []), *([f"5{word[:5]}"] if len(word) > 5 else []))


def runs_of(places: list[int]):
    """Runs of consecutive numbers."""
    start = 0
    for i in range(1, len(places) + 1):
        if i == len(places) or places[i] != places[i - 1] + 1:
            yield places[start:i]
            start = i


def fit(docs: DataFrame, labels: DataFrame, lm, fit_rows: int = FIT_ROWS) -> tuple[float, dict]:
    """(score of a text without telling features, score that each telling feature gives)."""
    usable = (labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)")
              .select(labels["doc_id"].cast("long").alias("id"), labels["toxic"].cast("int").alias("toxic"))
              .where(F.pmod(F.crc32(F.col("id").cast("string").cast("binary")), F.lit(5)) != 0).distinct())
    # the bounded sample of labelled rows
    got = usable.orderBy(F.xxhash64("id"), "id", "toxic").limit(fit_rows).toArrow()
    order = np.argsort(got.column("id").to_numpy(), kind="stable")
    shared = docs.sparkSession.sparkContext.broadcast(
        (got.column("id").to_numpy()[order], got.column("toxic").to_numpy()[order], lm))
    digest = digest_of(lm)

    def run(batches):
        ids, toxic, tables = shared.value
        decoder = worker_state(("decoder", digest), lambda: Decoder(tables))
        for batch in batches:
            doc = pc.fill_null(batch.column("doc_id"), -2**63).to_numpy()
            at = np.searchsorted(ids, doc)
            mine = np.flatnonzero((at < len(ids)) & (ids[np.minimum(at, len(ids) - 1)] == doc)) if len(ids) else []
            found = {}
            for i in mine:
                side = int(toxic[at[i]])
                # the empty feature counts the documents
                for w in decoder.features(batch.column("text")[int(i)].as_py() or "") | {""}:
                    found.setdefault(w, [0, 0])[side] += 1
            yield pa.RecordBatch.from_pydict({"word": pa.array(list(found), pa.string()),
                                              "clean": pa.array([v[0] for v in found.values()], pa.int64()),
                                              "toxic": pa.array([v[1] for v in found.values()], pa.int64())})

    per = (docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
           .mapInArrow(run, "word string, clean long, toxic long")
           .groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")))
    # written once: both of the questions below would decode the labelled texts anew
    scratch = Scratch(docs.sparkSession, "toxicity")
    per = scratch.table(per)
    n_clean, n_toxic = (per.where("word = ''").select("clean", "toxic").first() or (0, 0))
    # Wilson's lower bound of toxic / (toxic + clean)
    n = F.col("toxic") + F.col("clean")
    share = F.col("toxic") / n
    low = (share + Z2 / (2 * n) - F.sqrt(Z2 * (share * (1 - share) / n + Z2 / (4 * n * n)))) / (1 + Z2 / n)
    # telling features of the bounded sample
    rows = per.where("word != ''").select("word", low.alias("low")).where(F.col("low") > LEAST).collect()
    scratch.drop(per)
    # texts without telling features are rarely toxic: half the share of toxic ones, below any feature
    return min(LEAST, 0.5 * n_toxic / max(1, n_clean + n_toxic)), {r["word"]: r["low"] for r in rows}


def told_by(words: pa.Array, length: np.ndarray, of: dict) -> np.ndarray:
    """The score that each word gives by itself, 0 for one that tells nothing."""
    best = np.zeros(len(words))
    for mark, size in (("", 0), ("4", 4), ("5", 5)):
        known = {f[len(mark):]: v for f, v in of.items() if f[1:2] != "x" and (f[:1] == mark if mark else f[:1] not in "45")}
        if known:
            part = pc.utf8_slice_codeunits(words, 0, size) if size else words
            i = pc.index_in(part, value_set=pa.array(list(known), pa.large_string())).to_numpy(zero_copy_only=False)
            hit = ~np.isnan(i) & (length > size)
            best[hit] = np.maximum(best[hit], np.array(list(known.values()))[i[hit].astype(np.int64)])
    return best


def text_scores(texts: pa.Array, decoder: Decoder, least: float, of: dict) -> np.ndarray:
    """The score of each text: its most telling feature.  Each distinct token of the texts is read once."""
    split = pc.ascii_split_whitespace(pc.utf8_lower(large(texts)))
    off = split.offsets.to_numpy().astype(np.int64)
    coded = split.values.slice(off[0], off[-1] - off[0]).dictionary_encode()
    off = off - off[0]
    out = np.full(len(texts), least)
    codes = coded.indices.to_numpy(zero_copy_only=False)
    if not len(codes):
        return out
    row = np.repeat(np.arange(len(texts)), np.diff(off))
    # first letters that tell by how many words share them
    shared = {f[2:] for f in of if f[1:2] == "x"}
    # letters with punctuation behind them are read as they are, all at once
    words = pc.utf8_rtrim(coded.dictionary, ".,;:?")
    raw, at = buffers(words)
    same = np.flatnonzero((raw[2:] == raw[1:-1]) & (raw[1:-1] == raw[:-2]) & (raw[2:] >= 97) & (raw[2:] <= 122))
    owner = np.searchsorted(at, same, "right") - 1
    thrice = np.zeros(len(words), bool)
    thrice[owner[same + 2 < at[owner + 1]]] = True
    plain = pc.utf8_is_alpha(words).to_numpy(zero_copy_only=False) & ~thrice
    length = pc.utf8_length(words).to_numpy(zero_copy_only=False)
    best = np.where(plain, told_by(words, length, of), 0.0)
    word_ids, held = {}, []
    if shared:
        first = pc.is_in(pc.utf8_slice_codeunits(words, 0, 5), value_set=pa.array(sorted(shared), pa.large_string())).to_numpy(zero_copy_only=False)
        for i in np.flatnonzero(plain & first & (length > 5)).tolist():
            held.append((i, word_ids.setdefault(words[i].as_py(), len(word_ids))))
    # the others are restored one by one, and words with a letter twice, too
    tokens = coded.dictionary
    same = np.flatnonzero((raw[1:] == raw[:-1]) & (raw[1:] >= 97) & (raw[1:] <= 122))
    owner = np.searchsorted(at, same, "right") - 1
    twice = np.zeros(len(words), bool)
    twice[owner[same + 1 < at[owner + 1]]] = True
    for i in np.flatnonzero(~plain | twice).tolist():
        for w in decoder.words_of(tokens[i].as_py()):
            best[i] = max(best[i], *(of.get(f, 0.0) for f in own_features(w)))
            if len(w) > 5 and w[:5] in shared:
                held.append((i, word_ids.setdefault(w, len(word_ids))))
    np.maximum.at(out, row, best[codes])
    # short neighbouring pieces: only where the word they make would tell is it asked how they read
    short = plain & (length <= PIECE)
    bare = short & (pc.utf8_length(tokens).to_numpy(zero_copy_only=False) == length)
    at = np.flatnonzero(bare[codes[:-1]] & short[codes[1:]] & (row[:-1] == row[1:]))
    pairs, which = np.unique(codes[at].astype(np.int64) * len(words) + codes[at + 1], return_inverse=True)
    a, b = words.take(pa.array(pairs // len(words))), words.take(pa.array(pairs % len(words)))
    one = pc.binary_join_element_wise(a, b, pa.scalar("", pa.large_string()))
    value = told_by(one, pc.utf8_length(one).to_numpy(zero_copy_only=False), of)
    for i in np.flatnonzero(value > least).tolist():
        if decoder.read(f"{a[i].as_py()} {b[i].as_py()}") != one[i].as_py():
            value[i] = 0.0
    np.maximum.at(out, row[at], value[which])
    if held:
        token, word = np.array(held).T
        prefixes = sorted(shared)
        of_word = np.array([prefixes.index(w[:5]) for w in word_ids])
        at = np.flatnonzero(np.isin(codes, token))
        order = np.argsort(token, kind="stable")
        token, word = token[order], word[order]
        a, b = np.searchsorted(token, codes[at], "left"), np.searchsorted(token, codes[at], "right")
        rows = np.repeat(row[at], b - a)
        words = word[np.repeat(a - np.cumsum(b - a) + (b - a), b - a) + np.arange((b - a).sum())]
        once = np.unique(rows * len(word_ids) + words)
        pair, n = np.unique(once // len(word_ids) * len(prefixes) + of_word[once % len(word_ids)], return_counts=True)
        for p, k in zip(pair.tolist(), n.tolist()):
            if k > 1:
                i = p // len(prefixes)
                out[i] = max(out[i], of.get(f"{min(k, 3)}x{prefixes[p % len(prefixes)]}", 0.0))
    # texts with four single characters in a row
    single = (pc.utf8_length(tokens).to_numpy(zero_copy_only=False) == 1)[codes]
    four = single[:-3] & single[1:-2] & single[2:-1] & single[3:] & (row[:-3] == row[3:]) if len(codes) > 3 else single[:0]
    for i in np.unique(row[:len(four)][four]).tolist():
        for w in decoder.spaced([tokens[c].as_py() for c in codes[off[i]:off[i + 1]].tolist()]):
            out[i] = max(out[i], *(of.get(f, 0.0) for f in own_features(w)))
    return out


def scores(docs: DataFrame, lm, base: float, weights: dict) -> DataFrame:
    """(doc_id, score): probability that the restored text is toxic."""
    shared = docs.sparkSession.sparkContext.broadcast((lm, base, weights))
    digest = digest_of(lm)

    def run(batches):
        tables, least, of = shared.value
        decoder = worker_state(("decoder", digest), lambda: Decoder(tables))
        for batch in batches:
            for rows in text_chunks(batch, "text"):
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(text_scores(rows.column("text"), decoder, least, of))],
                                                 names=["doc_id", "score"])

    return (docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
            .mapInArrow(run, "doc_id long, score double"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    lm = language_model(docs)
    base, weights = fit(docs, labels, lm)
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))
    return scores(docs, lm, base, weights).select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
