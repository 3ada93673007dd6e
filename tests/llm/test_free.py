"""Suffix dedup, quality, toxicity, Jaccard join and packing against plain Python."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from retentio.llm import importance, jaccard_join, packing, suffix_dedup, tokens, toxicity
from tests.llm.cases import EDGE, LONG, frame, prose, rows_of


def test_construction_sorts_all_suffixes_with_common_prefixes():
    r = random.Random(3)
    for _ in range(40):
        strings = sorted({bytes(r.choice(b"ab\x00\xc3") for _ in range(r.randint(1, 14))) for _ in range(12)}, key=lambda s: r.random())
        who, size, lcp = suffix_dedup.build(strings)
        got = [strings[w][len(strings[w]) - n:] for w, n in zip(who, size)]
        assert got == sorted(s[i:] for s in strings for i in range(len(s) + 1))
        for a, b, k in zip(got, got[1:], lcp[1:]):
            assert k == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def substring_brute(rows, n=suffix_dedup.LENGTH):
    first = {}
    rows = [(-2**63 if d is None else d, (x or "").encode()) for d, x in rows]
    for d, b in rows:
        for i in range(len(b) - n + 1):
            first[b[i:i + n]] = min(d, first.get(b[i:i + n], d))
    out = []
    for d, b in rows:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - n + 1):
            if first[b[i:i + n]] < d:
                gone[i:i + n] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        spans = int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(b) else 0
        out.append((None if d == -2**63 else d, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("heavy", [suffix_dedup.HEAVY, 2])
def test_suffix_dedup(spark, monkeypatch, heavy):
    monkeypatch.setattr(suffix_dedup, "HEAVY", heavy)
    rows = EDGE + [(50, "x" * 30 + LONG[10:140] + "yy"), (51, "é" * 60), (52, "zé" + "é" * 50), (53, "q" * 49), (54, "q" * 49)]
    out = suffix_dedup.drop_repeats(frame(spark, rows)).drop("kept")
    assert rows_of(out) == substring_brute(rows)
    assert suffix_dedup.drop_repeats(frame(spark, rows).limit(0)).count() == 0


def test_range_minima_are_exact_and_take_few_bytes():
    rng = np.random.default_rng(7)
    for n in (1, 2, 31, 32, 33, 63, 64, 65, 97, 1000, 1 << 16):
        x = rng.integers(0, 200, n).astype(np.uint8)
        least = suffix_dedup.RangeMin(x)
        a, b = np.sort(rng.integers(0, n, (2, 500)), axis=0)
        assert least(a, b).tolist() == [x[i:j + 1].min() for i, j in zip(a, b)]
    held = sum(v.nbytes for v in vars(least).values() if isinstance(v, np.ndarray))
    assert held < 8 * n  # a table of all powers of two takes 17 bytes an element


def test_hashes_and_minima_do_not_depend_on_blocks(monkeypatch):
    raw = np.random.default_rng(8).integers(0, 256, 3000).astype(np.uint8)
    whole = suffix_dedup.runs(raw, np.array([0, 20, 900, 900, 3000]))
    least = suffix_dedup.sliding_min(raw, 31)
    monkeypatch.setattr(suffix_dedup, "BLOCK", 64)
    for x, y in zip(whole, suffix_dedup.runs(raw, np.array([0, 20, 900, 900, 3000]))):
        assert x.tolist() == y.tolist()
    assert least.tolist() == suffix_dedup.sliding_min(raw, 31).tolist() == [raw[i:i + 31].min() for i in range(2970)]
    assert len(suffix_dedup.kmer_hashes(raw[:5], 20)) == len(suffix_dedup.sliding_min(raw[:5], 31)) == 0


@pytest.mark.parametrize("chunk", [suffix_dedup.CHUNK, 10])
def test_cut_keeps_the_bytes_outside_the_ranges(monkeypatch, chunk):
    import pyarrow as pa
    monkeypatch.setattr(suffix_dedup, "CHUNK", chunk)
    rows = [(3, "abcdef", [(0, 2), (2, 3)]), (None, "é" * 4, [(0, 4), (3, 5)]), (3, "", None), (4, "xyz", []), (5, "klm", [(0, 3)]),
            (6, "nop", [(0, 1), (2, 3), (0, 1)]), (7, "0123456789" * 3, [(20, 30), (5, 9), (6, 8)]), (8, None, None)]
    kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
    batch = pa.RecordBatch.from_arrays([
        pa.array([-2**63 if d is None else d for d, _, _ in rows], pa.int64()), pa.array([t for _, t, _ in rows], pa.string()),
        pa.array([r if r is None else [{"a": a, "b": b} for a, b in r] for _, _, r in rows], kind)], names=["d", "text", "ranges"])
    batches = list(suffix_dedup.cut([batch.slice(0, 0), batch.slice(0, 3), batch.slice(3)]))
    # a batch is worked on in runs of rows, not as Python lists of all its ranges at once
    assert len(batches) == 2 if chunk > 10 else len(batches) > 2
    got = [r for b in batches for r in b.to_pylist()]
    for r, (d, text, ranges) in zip(got, rows, strict=True):
        raw = (text or "").encode()
        gone = {i for a, b in ranges or () for i in range(a, b)}
        kept = bytes(x for i, x in enumerate(raw) if i not in gone)
        assert r == {"doc_id": d, "n_bytes": len(raw), "n_removed": len(gone), "n_spans": sum(i - 1 not in gone for i in gone),
                     "kept_sha256": hashlib.sha256(kept).hexdigest(), "kept": kept}


def test_suffix_dedup_tells_rows_of_one_id_apart_by_64_bits(spark):
    # two texts whose 16-bit hashes are equal, under one id, each with a passage of an earlier document
    texts = [f"{i} " + prose(7000 + i, 14 + i % 9) + f" {i}" for i in range(1500)]
    short = [r.t for r in spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, text string")
             .selectExpr("i", "hash(text) & 65535 AS t").orderBy("i").collect()]
    seen, pairs = {}, []
    for x, t in zip(texts, short):
        pairs += [(seen[t], x)] if t in seen else []
        seen[t] = x
    a, b = pairs[0]
    rows = [(1, a + "." + LONG[:200]), (2, b), (3, "y" * 70), (None, a), (None, b), (3, "z" * 70 + LONG[20:90]), (9, a), (9, b), (9, "q" * 60), (9, "q" * 60)]
    assert rows_of(suffix_dedup.drop_repeats(frame(spark, rows)).drop("kept")) == substring_brute(rows)
    placed = {(r.d, r.text): r.t for r in suffix_dedup.with_place(frame(spark, rows)).collect()}
    assert placed[9, a] != placed[9, b] and placed[1, rows[0][1]] == 0
    assert {r.t for r in suffix_dedup.with_place(frame(spark, [(i, x) for i, x in enumerate(texts)])).collect()} == {0}


def shingles(text, n=5):
    w = [x for x in (text or "").translate({i: i + 32 for i in range(65, 91)}).replace("\t", " ").replace("\n", " ").split(" ") if x]
    return frozenset(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def jaccard_brute(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
                parent[top(i)] = top(j)
    groups = collections.defaultdict(list)
    for i in range(len(rows)):
        groups[top(i)].append(i)
    return sets, groups


def near_copies():
    """A group of near copies in which some link only through others, and links at exactly 0.8."""
    base = prose(77, 200, per_line=500).split()
    out = []
    for i in range(40):
        w, r = list(base), random.Random(i)
        for _ in range(i % 9):
            w[r.randrange(len(w))] = f"edit{i}"
        out.append((200 + i, " ".join(w)))
    nine = [f"w{i}" for i in range(13)]  # 9 shingles; 8 of them are shared after one word more or less
    return out + [(300, " ".join(nine)), (301, " ".join(nine[:-1])), (302, " ".join(nine[:-2]))]


def test_shingles_of_few_words_in_one_chunk():
    """Every total of 0 to 2n words, as one text and split over two, three and single words."""
    import pyarrow as pa
    n = jaccard_join.WORDS
    for total in range(2 * n + 1):
        words = [f"w{i}" for i in range(total)]
        for parts in {1, 2, 3, max(1, total)}:
            texts = [" ".join(words[i::parts]) for i in range(parts)]
            want = [max(0, len(t.split()) - n + 1) or (1 if t else 0) for t in texts]
            assert [len(s) for s in jaccard_join.shingle_sets(pa.array(texts))] == want, (total, parts)


def test_jaccard_join(spark):
    rows = EDGE + near_copies()
    sets, groups = jaccard_brute(rows)
    expected = []
    for members in groups.values():
        ids = [rows[i][0] for i in members if rows[i][0] is not None]
        for i in members:
            own = rows[i][0] if not sets[i] else min(ids, default=None)
            expected.append((rows[i][0], len(sets[i]), own))
    docs = frame(spark, rows)
    assert rows_of(jaccard_join.jaccard_classes(docs)) == sorted(expected, key=repr)
    kept = jaccard_join.drop_copies(docs)
    assert kept.columns == docs.columns
    # one row of each component, and every row without a shingle
    assert kept.count() == sum(1 if sets[m[0]] else len(m) for m in groups.values())
    for df in (jaccard_join.jaccard_classes(docs.limit(0)), jaccard_join.drop_copies(docs.limit(0))):
        assert df.count() == 0


def test_ids_of_words_are_the_tokenizers_ids():
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        vocabulary = f.read()
    tok = Tokenizer.from_str(vocabulary)
    texts = [t for _, t in EDGE] + ["  a b\n\t c", "É́cole H̱ello J̌ Σας ΣΑΣ İstanbul", "don't I'LL we've 'S 't.x a.b,c..d !?a' 12a3 ﬁ ½ x—.y é.à,b",
                                    "a\x0bb\x0cc\x1cd e　f\u0085g", "😀 smile.😀", "A" * 3000, "<|endoftext|> a", "́a b́. Ć,", "a.́b"]
    ids, off = tokens.WordIds(vocabulary).encode(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        assert ids[off[i]:off[i + 1]].tolist() == tok.encode(t or "", add_special_tokens=False).ids


def test_each_distinct_word_asks_the_table_once(monkeypatch):
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    class Counting(dict):
        asked = 0

        def get(self, *a):
            self.asked += 1
            return super().get(*a)

        def __getitem__(self, k):
            self.asked += 1
            return super().__getitem__(k)

        def __contains__(self, k):
            self.asked += 1
            return super().__contains__(k)

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        vocabulary = f.read()
    tok = Tokenizer.from_str(vocabulary)
    words = ["Abc", "x1y", "été", "ª", "straße", "42.1", "b" * 60, "7" * 60, "ÀÖ", "zz", "...", "n" * 48]
    ids_of = tokens.WordIds(vocabulary)
    ids_of.place = Counting()
    for texts in ([" ".join(words)], [" ".join(reversed(words)), "new zz 42.1 new"]):
        ids, off = ids_of.encode(pa.array(texts))
        for i, t in enumerate(texts):
            assert ids[off[i]:off[i + 1]].tolist() == tok.encode(t, add_special_tokens=False).ids
    assert ids_of.place.asked == len(words) + len(words) + 1
    # a full table forgets words and finds their ids again
    monkeypatch.setattr(tokens, "TABLE_WORDS", 8)
    for _ in range(3):
        for w in words:
            assert ids_of.encode(pa.array([w + " zz"]))[0].tolist() == tok.encode(w + " zz", add_special_tokens=False).ids


def test_packing_round_trip(spark):
    import public_tokenizers
    from tokenizers import Tokenizer
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = [r for i, r in enumerate(EDGE) if r not in EDGE[:i]] + [(60, " ".join(WORDS_3000)), (61, "alpha " * 2047)]
    rows = [r for r in rows if r[0] is not None and r != (12, EDGE[14][1])]
    got = packing.pack(frame(spark, rows), path, group=16).toPandas()
    tok = Tokenizer.from_file(path)
    for d, t in rows:
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [packing.END_ID], "<u4")
        mine, at = got[got.doc_id == d].sort_values("start"), 0
        for p in mine.itertuples():
            assert (p.start, p.doc_tokens) == (at, len(ids))
            assert p.ids_crc32 == zlib.crc32(ids[at:at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    for _, seq in got.sort_values("offset").groupby("sequence_id"):
        assert seq.offset.tolist() == [0, *seq.length.cumsum().tolist()[:-1]] and seq.length.sum() <= packing.CAPACITY
    assert packing.pack(frame(spark, rows).limit(0), path).count() == 0
    # repeated rows are packed each
    assert packing.pack(frame(spark, [(1, "a"), (1, "a"), (None, None)]), path).count() == 3


WORDS_3000 = [f"word{i}" for i in range(3000)]


def test_differencing_balances_and_raises_the_count():
    r = np.random.default_rng(1)
    sizes = r.integers(1, 513, 900)
    window = packing.pack_sizes(sizes)
    fill = np.bincount(window, weights=sizes)
    assert fill.max() <= packing.CAPACITY and len(fill) * packing.CAPACITY < 1.04 * sizes.sum()
    one, fills = packing.difference(sizes, 1)
    assert set(one) == {0} and fills.tolist() == [sizes.sum()]
    # two windows: the classic differencing example, 8 7 6 5 4 leaves 16 and 14
    assert sorted(packing.difference(np.array([8, 7, 6, 5, 4]), 2)[1].tolist()) == [14, 16]
    # three pieces of 1100 cannot share two windows
    assert len(set(packing.pack_sizes(np.array([1100, 1100, 1100])))) == 3


def test_kth_largest_and_ties(spark):
    r = random.Random(5)
    values = [r.choice([r.gauss(0, 1), 0.5, -3.0, 1e9]) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "score double")
    for k in (1, 2, 77, 250, 499, 500, 900):
        assert importance.kth_largest(df, "score", k) == sorted(values, reverse=True)[min(k, 500) - 1]
    assert importance.kth_largest(df.limit(0), "score", 3) is None
    chosen = importance.select_top(df, "score", 10).where("selected").count()
    assert chosen == sum(v >= sorted(values, reverse=True)[9] for v in values)


def shape_of(word):
    kinds = "".join("a" if b > 127 or 97 <= b <= 122 else "A" if 65 <= b <= 90 else "0" if 48 <= b <= 57 else chr(b) for b in word.encode())
    return re.sub(r"(.)\1+", r"\1\1", kinds)


def feature_brute(text):
    import xxhash
    words = [w for w in (text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    mask = 2**64 - 1

    def pair(a, b):
        y = (a * 0x9E3779B97F4A7C15 + b) & mask
        return ((y ^ y >> 31) * 0xFF51AFD7ED558CCD & mask) >> 48

    h = [xxhash.xxh3_64_intdigest(w) for w in words]
    s = [xxhash.xxh3_64_intdigest(shape_of(w), 1) for w in words]
    return [x >> 48 for x in h] + [pair(a, b) for a, b in zip(h, h[1:])] + [pair(a, b) for a, b in zip(s, s[1:])]


def test_importance_weights(spark):
    rows = EDGE + [(400 + i, prose(i, 60)) for i in range(60)] + [(500 + i, prose(i, 60).upper().replace(" ", "!! ")) for i in range(20)]
    docs = frame(spark, rows)
    labels = spark.createDataFrame([(400 + i, 1) for i in range(60)] + [(500 + i, 0) for i in range(20)] + [(None, 1), (401, None)],
                                   "doc_id long, quality int")
    target = np.array(sorted(400 + i for i in range(0, 60, 2)))
    count = importance.counts(docs, target)
    raw, good = np.zeros(importance.BUCKETS), np.zeros(importance.BUCKETS)
    for d, t in rows:
        np.add.at(raw, feature_brute(t), 1)
        if d in set(target.tolist()):
            np.add.at(good, feature_brute(t), 1)
    assert (count[0] == raw).all() and (count[1] == good).all()
    ratio = np.log((good + 1) / (good.sum() + len(good))) - np.log((raw + 1) / (raw.sum() + len(raw)))
    weights = {(r.row.doc_id, r.row.text): (r.n_ngrams, r.log_weight) for r in importance.weighted(docs, importance.log_ratios(count)).collect()}
    for d, t in rows:
        f = feature_brute(t)
        assert weights[(d, t)][0] == len(f) and math.isclose(weights[(d, t)][1], ratio[f].sum(), abs_tol=1e-9)
    out = importance.select_rows(docs, labels)
    assert out.select("row.*").columns == docs.columns and out.count() == len(rows)
    chosen = {r.row.doc_id for r in out.where("selected").collect()}
    assert {400 + i for i in range(60)} - chosen == set() and not any(500 + i in chosen for i in range(20))
    scores = sorted((r.score for r in out.collect()), reverse=True)
    n = out.where("selected").count()
    assert {r.score for r in out.where("selected").collect()} == set(scores[:n])
    # no labels: everything is kept; an empty table stays empty
    assert importance.select_rows(docs, labels.limit(0)).where("selected").count() == len(rows)
    assert importance.select_rows(docs.limit(0), labels).count() == 0


def toxic_rows():
    r, rows, labels = random.Random(9), [], []
    for i in range(400):
        bad = i % 4 == 0
        words = prose(1000 + i, 60, per_line=500).split()
        if bad:
            for w in r.sample(["idiot", "moron", "worthless"], 2):
                words.insert(r.randrange(len(words)), w)
        rows.append((1000 + i, " ".join(words)))
        labels.append((1000 + i, int(bad)))
    return rows, labels


def test_telling_features_against_counting(spark):
    rows, labels = toxic_rows()
    docs = frame(spark, rows)
    lm = toxicity.language_model(docs)
    decoder, texts = toxicity.Decoder(lm), collections.defaultdict(list)
    for d, x in rows:
        texts[d].append(x or "")
    seen, n = collections.defaultdict(lambda: [0, 0]), [0, 0]
    for d, y in set(labels):
        if zlib.crc32(str(d).encode()) % 5:
            for x in texts[d]:
                n[y] += 1
                for f in decoder.features(x):
                    seen[f][y] += 1
    z2, expected = toxicity.Z2, {}
    for f, (clean, toxic) in seen.items():
        k = clean + toxic
        low = (toxic / k + z2 / (2 * k) - math.sqrt(z2 * (toxic / k * (clean / k) / k + z2 / (4 * k * k)))) / (1 + z2 / k)
        if low > toxicity.LEAST:
            expected[f] = low
            assert toxic > 1
    base, got = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), lm)
    assert expected and got.keys() == expected.keys()
    assert all(abs(got[f] - v) < 1e-9 for f, v in expected.items())
    assert base == min(toxicity.LEAST, 0.5 * n[1] / sum(n))


def test_toxicity(spark):
    rows, labels = toxic_rows()
    hidden = [(5001, prose(1, 20, 99) + " 1d10t " + prose(2, 20, 99)), (5002, prose(3, 20, 99) + " m.o.r.o.n, " + prose(4, 20, 99)),
              (5003, prose(5, 20, 99) + " WORTHLESSSSS " + prose(6, 20, 99)), (5004, prose(7, 40, 99)), (5005, prose(8, 20, 99) + " m0r0n")]
    docs = frame(spark, rows + hidden + EDGE)
    ldf = spark.createDataFrame(labels + [(None, 1), (1000, None)], "doc_id long, toxic int")
    out = toxicity.toxicity(docs, ldf)
    got = collections.defaultdict(list)
    for r in out.collect():
        got[r.doc_id].append(r)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    assert [got[d][0].predicted for d, _ in hidden] == [1, 1, 1, 0, 1]
    held = [(got[d][0].predicted, y) for d, y in labels if got[d][0].held_out]
    assert len(held) > 40 and sum(p == y for p, y in held) / len(held) > 0.95
    # held-out labels do not reach the scores
    flipped = spark.createDataFrame([(d, 1 - y if zlib.crc32(str(d).encode()) % 5 == 0 else y) for d, y in labels], "doc_id long, toxic int")
    assert rows_of(toxicity.toxicity(docs, flipped)) == rows_of(out)
    assert toxicity.toxicity(docs.limit(0), ldf).count() == 0
    assert toxicity.toxicity(docs, ldf.limit(0)).where("predicted = 1").count() == 0


def test_language_model_counts_whole_texts(spark):
    rows = EDGE[:10]
    raw = b"".join((t or "").lower().encode() + b" " for _, t in rows)
    tables = toxicity.language_model(frame(spark, rows))
    assert tables[0].tolist() == np.bincount(np.frombuffer(raw, np.uint8), minlength=256).tolist()
    assert sum(tables[1]) <= len(raw) and tables[1][(ord("a") << 8) | ord("l")] == raw.count(b"al")


def test_scores_of_many_texts_are_those_of_each(spark):
    import pyarrow as pa
    rows, _ = toxic_rows()
    decoder = toxicity.Decoder(toxicity.language_model(frame(spark, rows)))
    of = {"idiot": 0.9, "4moro": 0.6, "5worth": 0.7, "2xgamma": 0.5, "3xgamma": 0.8, "zz": 0.3}
    texts = ["an 1d10t.", "gammatrons gammatics", "gammatrons gammatics, gammatops gammatops", "such a i d i o t here", "moronic", "worthy",
             None, "", "zz zz gammatrons gammatrons.", "nothing", "a b c"] + [t for _, t in rows[:40]]
    got = toxicity.text_scores(pa.array(texts, pa.string()), decoder, 0.1, of)
    for t, s in zip(texts, got.tolist()):
        assert s == max([0.1, *(of[f] for f in decoder.features(t or "") & set(of))]), t


def brute_reading(decoder, text):
    """The cheapest of all readings, tried one by one."""
    best = None
    paths = [("", 0.0, b"   ")]
    for i in range(len(text)):
        step = []
        for reading, cost, ctx in paths:
            for letter, price in decoder.offers(text, i):
                c, x = cost + price, ctx
                for b in letter.encode():
                    c += decoder.cost(x, b)
                    x = x[1:] + bytes([b])
                step.append((reading + letter, c, x))
        paths = step
    for reading, cost, ctx in paths:
        total = cost + decoder.cost(ctx, 32)
        if best is None or (total, reading) < best:
            best = (total, reading)
    return best[1]


def test_viterbi_finds_the_cheapest_reading(spark):
    rows, _ = toxic_rows()
    decoder = toxicity.Decoder(toxicity.language_model(frame(spark, rows)))
    for text in ("1d10t", "m.o.r.o.n", "id!ot", "mooron", "w0rth", "p@$t", "a b c"):
        assert decoder.search(text) == brute_reading(decoder, text)


def test_long_stretches_pieces_and_doubled_letters_are_decoded(spark):
    import pyarrow as pa
    rows, _ = toxic_rows()
    said = " you are a worthless moron and an idiot "
    decoder = toxicity.Decoder(toxicity.language_model(frame(spark, rows + [(i, said * 20) for i in range(20)])))
    of = {"idiot": 0.9, "moron": 0.8, "worthless": 0.7}
    letters = " ".join("youareaworthlessmoronandanidiot")
    cases = [(letters, 0.9), (" ".join("xqzvkwjxqzvkwjxqzvkwjxqzvkwj") + " i d i o t", 0.9), ("id" + "i" * 80 + "ot", 0.9), ("alpha mor on beta", 0.8),
             ("alpha wor thless, beta", 0.7), ("alpha mor.on beta", 0.8), ("moorron", 0.8), ("alpha beta. gamma", 0.1), ("id" + "i" * 30_000 + "ot", 0.9),
             ("a mo. ron", 0.1)]
    assert len(letters) > toxicity.LONGEST
    got = toxicity.text_scores(pa.array([t for t, _ in cases], pa.string()), decoder, 0.1, of)
    assert got.tolist() == [s for _, s in cases]
    assert len(decoder.search("x y " * 20_000)) >= 40_000
