"""Operators on documents against plain versions, on awkward cases."""

import collections
import gc
import hashlib
import re
import tracemalloc
import weakref
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from cases import SCHEMA, frame, texts
from tokenizers import Tokenizer

from signalloom.llm import bpe, jaccard, kept, lines, packing, quality, substrings, suffixes, tokenfile, tokens

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return WORD.findall(text or "")


def by_row(df, *columns):
    return collections.Counter(tuple(r[c] for c in columns) for r in df.collect())


def test_figures(docs):
    got = by_row(docs.select("doc_id", quality.text_figures("text").alias("f")).select("doc_id", "f.*"), "doc_id", *quality.COUNTS[:5])
    want = collections.Counter()
    for d, t in texts():
        w = words(t)
        tri = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {i + k for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for k in range(3)}
        own = [x for x in (t or "").split("\n") if WORD.search(x)]
        want[d, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(own) - len(set(own)), len(covered)] += 1
    assert got == want


def test_binomial_bound_is_exact():
    from fractions import Fraction
    from math import comb

    for n, k, p in [(10, 0, Fraction(1, 10)), (60, 3, Fraction(1, 50)), (500, 9, Fraction(1, 100)), (300, 40, Fraction(1, 8)), (5, 5, Fraction(1, 2))]:
        exact = sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert quality.binomial_cdf(k, n, float(p)) == pytest.approx(float(exact), rel=1e-9)
    assert quality.certified(0, 5_000, 0.004, 0.05 / 15)
    assert not quality.certified(0, 500, 0.004, 0.05 / 15)


def test_cutoffs_climb_until_not_certified(spark):
    clean = [(i, " ".join(f"w{j}" for j in range(i, i + 60)), "en", None, 0, None, None, None, None, None, None) for i in range(3_000)]
    noisy = [(5_000 + i, " ".join(f"{j}##" for j in range(60)), "en", None, 0, None, None, None, None, None, None) for i in range(40)]
    few = [(9_000, " ".join(f"##{j}" for j in range(60)), None, None, 0, None, None, None, None, None, None)]
    docs = frame(spark, clean + noisy + few)
    labels = spark.createDataFrame([(d[0], 1, 0) for d in clean] + [(d[0], 1, 0) for d in noisy[:2]] + [(9_000, 1, 0), (None, 1, 0), (5_030, 1, None), (7, None, 0)], "doc_id long, quality int, toxic int")
    got = {r["stratum"]: r.asDict() for r in quality.cutoffs(docs, labels, alpha=0.03, delta=0.1).collect()}
    assert got["en"]["symbols"] == 0.1 and got["en"]["dup_lines"] == 0.3
    assert got[None]["symbols"] is None
    kept = {r["doc_id"] for r in quality.judged(docs, labels, alpha=0.03, delta=0.1).where("_kept").collect()}
    assert kept == {d[0] for d in clean} | {9_000}
    strict = quality.cutoffs(docs, labels, alpha=0.001, delta=0.1).where("stratum = 'en'").first()
    assert strict["symbols"] is None


def _labelled(spark, texts_of):
    """Documents and labels from lists of (language, text, quality)."""
    data = [(i, t, lang, None, len(t), None, None, None, None, None, None) for i, (lang, t, _) in enumerate(texts_of)]
    return frame(spark, data), spark.createDataFrame([(i, q, 0) for i, (_, _, q) in enumerate(texts_of)], "doc_id long, quality int, toxic int")


def test_small_strata_get_cutoffs(spark):
    """Four languages of 300 clean labels, far fewer than single ladders need."""
    good = [(lang, " ".join(f"w{j}" for j in range(i, i + 60)), 1) for lang in ("en", "de", "fr", None) for i in range(300)]
    bad = [(lang, " ".join(f"{j + i}##" for j in range(60)), 0) for lang in ("en", "de", "fr", None) for i in range(20)]
    docs, labels = _labelled(spark, good + bad)
    assert {r["stratum"]: r["symbols"] for r in quality.cutoffs(docs, labels).collect()} == {"en": 0.1, "de": 0.1, "fr": 0.1, None: 0.1}
    assert {r["doc_id"] for r in quality.judged(docs, labels).where("_kept").collect()} == set(range(len(good)))


def test_rule_that_clean_documents_break_holds_up_no_other(spark):
    """Long words stop the joint path at its second step; symbols by themselves go on."""
    good = [("en", " ".join(f"w{j:020d}" if i % 20 == 0 else f"w{j}" for j in range(i, i + 60)), 1) for i in range(2_000)]
    bad = [("en", " ".join(f"{j + i}" + "#" * (j % 2) for j in range(60)), 0) for i in range(20)]
    docs, labels = _labelled(spark, good + bad)
    got = quality.cutoffs(docs, labels).first()
    assert got["long_words"] is None and got["symbols"] == 0.1
    assert {r["doc_id"] for r in quality.judged(docs, labels).where("_kept").collect()} == set(range(len(good)))


def test_line_dedup(docs):
    got = by_row(lines.without_repeated_lines(docs), "doc_id", "text", "n_chars", "source")
    seen, solid_of = {}, {}
    order = sorted(set(texts()), key=lambda r: (r[0] is not None, r[0] or 0))
    for d, t in order:
        ls = (t or "").split("\n")
        solid = [i for i, x in enumerate(ls) if WORD.search(x)]
        gone = set()
        for j in range(len(solid) - 2):
            at = solid[j : j + 3]
            key = tuple(ls[i] for i in at)
            if seen.setdefault(key, (d, j)) != (d, j):
                gone.update(at)
        solid_of[d, t] = t if not gone else "\n".join(x for i, x in enumerate(ls) if i not in gone)
    want = collections.Counter()
    for r in frame(docs.sparkSession).collect():
        left = solid_of[r["doc_id"], r["text"]]
        want[r["doc_id"], left, None if left is None else len(left), r["source"]] += 1
    assert got == want
    assert any(a != b for (_, a), b in zip(solid_of, solid_of.values(), strict=True) if a)


def test_line_dedup_by_size(docs):
    """Runs of one or two lines with 13 words, and all runs of three."""
    got = by_row(lines.without_repeated_lines(docs, least_words=13), "doc_id", "text")
    seen, left = {}, {}
    for d, t in sorted(set(texts()), key=lambda r: (r[0] is not None, r[0] or 0)):
        ls = (t or "").split("\n")
        solid = [i for i, x in enumerate(ls) if WORD.search(x)]
        gone = set()
        for n in (1, 2, 3):
            for j in range(len(solid) - n + 1):
                at = solid[j : j + n]
                if n < 3 and sum(len(words(ls[i])) for i in at) < 13:
                    continue
                key = tuple(ls[i] for i in at)
                if seen.setdefault(key, (d, j)) != (d, j):
                    gone.update(at)
        left[d, t] = t if not gone else "\n".join(x for i, x in enumerate(ls) if i not in gone)
    assert got == collections.Counter((d, left[d, t]) for d, t in texts())


def test_short_runs_of_many_words_go(spark):
    """Whole documents of one line or two, lines within longer ones, and short lines that stay."""
    long, half, short = " ".join(f"w{i}" for i in range(13)), "a b c d e f g", "only four words here"
    data = [(1, long), (2, long), (3, f"{half}\n{half} h"), (4, f"{half}\n{half} h"), (5, f"x\n{long}\ny\nz"), (6, short), (7, short), (8, f"{half}\nq"), (9, f"p\n\n{half}\n{half} h")]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in lines.without_repeated_lines(docs, least_words=13).collect()}
    assert got == dict(data) | {2: "", 4: "", 5: "x\ny\nz", 9: "p\n"}


def components(size, least, of):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for d, t in texts():
        w = [x.translate(low) for x in words(t)]
        sets[d, t] = frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])
    root = {d: d for d, _ in texts() if d is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    known = [(k, s) for k, s in sets.items() if k[0] is not None and s]
    for (a, _), s in known:
        for (b, _), t in known:
            if a < b and of * len(s & t) >= least * len(s | t):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: (len(s), find(k[0]) if k[0] is not None else None) for k, s in sets.items()}


@pytest.mark.parametrize(("size", "least"), [(3, 90), (5, 80), (2, 60)])
def test_near_duplicates(docs, size, least):
    want = components(size, least, 100)
    got = by_row(jaccard.near_duplicates(docs, size, least, 100), "doc_id", "n_shingles", "component_id")
    assert got == collections.Counter((d, *want[d, t]) for d, t in texts())
    assert len({c for _, c in want.values()}) < len(want) - 10


@pytest.mark.parametrize("hot", [16, 0.02])
def test_substring_dedup(docs, monkeypatch, hot):
    monkeypatch.setattr(substrings, "HOT", hot)
    got = by_row(substrings.without_repeated_words(docs), "doc_id", "_n_words", "_n_removed", "_kept_sha256")
    first, want = {}, collections.Counter()
    ordered = sorted((r for r in texts() if r[0] is not None), key=lambda r: r[0])
    for d, t in ordered:
        w = words(t)
        for i in range(len(w) - 12):
            first.setdefault(tuple(w[i : i + 13]), d)
    for d, t in texts():
        w = words(t)
        gone = {i + k for i in range(len(w) - 12) if d is not None and first[tuple(w[i : i + 13])] < d for k in range(13)}
        want[d, len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()] += 1
    assert got == want


def packed_bucket(data):
    """All super-k-mers of ids and texts as the rows of one bucket, a row for each fifty texts."""
    batches = [pa.RecordBatch.from_pydict({"doc_id": ids, "key": ids, "text": own}) for i in range(0, len(data), 50) for ids, own in [list(zip(*data[i : i + 50], strict=True))]]
    return pa.Table.from_batches(substrings._packed(iter(batches), np.zeros(1 << substrings.CELL_BITS, dtype=bool), 1))


@pytest.mark.parametrize("chunk", [1, 3_000, 1 << 30])
def test_bucket_in_chunks(monkeypatch, chunk):
    data = [(d, t) for d, t in texts() if d is not None]
    want = collections.Counter(map(tuple, substrings._sorted_bucket(None, packed_bucket(data)).to_pandas().to_numpy()))
    monkeypatch.setattr(substrings, "CHUNK", chunk)
    got = collections.Counter(map(tuple, substrings._sorted_bucket(None, packed_bucket(data)).to_pandas().to_numpy()))
    assert got == want
    assert sum(want.values()) > 50


def test_bucket_holds_the_words_of_a_chunk_only():
    rng = np.random.default_rng(5)
    data = [(i, " ".join(f"{x:x}" for x in rng.integers(1 << 20, 1 << 40, 500))) for i in range(1_000)]
    bucket = packed_bucket(data + [(1_000 + i, t) for i, t in data[:100]])
    tracemalloc.start()
    out = substrings._sorted_bucket(None, bucket)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    low, high = (out.column(c).to_numpy() for c in ("low", "high"))
    assert (high - low - 12).sum() == 100 * 488
    assert peak < 90 * 1_100 * 488  # bytes for each window


def test_released_lets_go_of_encoders():
    gc.disable()
    try:
        gone = weakref.ref(tokens.encoder(public_tokenizers.path("word_bpe_49k.json"), packing.WORD))
        kept.released()
        assert gone() is None
    finally:
        gc.enable()


def test_substring_dedup_leaves_the_rest_as_it_was(docs):
    for r in substrings.without_repeated_words(docs).collect():
        if r["_n_removed"] == 0:
            assert (r["doc_id"], r["text"]) in texts()
        else:
            assert hashlib.sha256(" ".join(words(r["text"])).encode()).hexdigest() == r["_kept_sha256"]


@pytest.mark.parametrize("hot", [20_000, 2])
def test_suffix_dedup(docs, monkeypatch, hot):
    monkeypatch.setattr(suffixes, "HOT", hot)
    size = suffixes.LENGTH
    count = collections.Counter()
    for _, t in texts():
        raw = (t or "").encode()
        count.update(raw[i : i + size] for i in range(len(raw) - size + 1))
    want = collections.Counter()
    for d, t in texts():
        raw = (t or "").encode()
        gone = np.zeros(len(raw) + size, dtype=bool)
        for i in range(len(raw) - size + 1):
            if count[raw[i : i + size]] > 1:
                gone[i : i + size] = True
        gone = gone[: len(raw)]
        runs = sum(1 for i in range(len(raw)) if gone[i] and (i == 0 or not gone[i - 1]))
        want[d, len(raw), int(gone.sum()), runs, hashlib.sha256(bytes(x for x, g in zip(raw, gone, strict=True) if not g)).hexdigest()] += 1
    assert by_row(suffixes.without_repeated_strings(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want


def test_token_files(docs, monkeypatch):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    blocks = tokenfile.token_blocks(docs, public_tokenizers.path("byte_bpe_50k.json"), block_ids=5_000)
    got = tokenfile.read_documents(blocks.cache()).orderBy("start").collect()
    start, order = 0, sorted(texts(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    assert blocks.count() > 5
    for r, (d, t) in zip(got, order, strict=True):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (d, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_id_coding_round_trip():
    rng = np.random.default_rng(3)
    for n, top in [(0, 1), (1, 1), (5, 2**32 - 1), (1_000, 300), (400_000, 70_000), (3, 1)]:
        ids = rng.integers(0, min(top, 2**20), n).astype(np.uint32)
        ranked, control, data = tokenfile.pack_ids(ids)
        assert (tokenfile.unpack_ids(n, ranked, control, data) == ids).all() if n else data == b""
        assert len(control) == -(-n // 4)


def test_packing(docs):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = collections.Counter()
    for d, t in texts():
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
        for k, start in enumerate(range(0, len(ids), packing.CAPACITY)):
            part = ids[start : start + packing.CAPACITY]
            want[d, k, start, len(part), zlib.crc32(part.tobytes())] += 1
    rows = packing.pack_documents(docs).collect()
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= packing.CAPACITY


def test_plan_uses_each_piece_once_and_fills_gaps():
    rng = np.random.default_rng(5)
    for top, n in [(100, 4_000), (4_096, 3_000), (4_096, 40), (60, 7)]:
        lengths = rng.integers(1, top + 1, n)
        counts = np.bincount(lengths, minlength=4_097)
        plan = packing.plan(counts, 4_096)
        used = np.zeros(4_097, dtype=np.int64)
        for parts, copies in plan:
            assert sum(parts) <= 4_096
            for p in parts:
                used[p] += copies
        assert (used == counts).all()
        assert sum(c for _, c in plan) <= -(-int(lengths.sum()) // 4_096) * 1.02 + (1 if top < 4_096 else n / 10)
    # A single, a pair and a triple that fill a gap exactly.
    counts = np.zeros(101, dtype=np.int64)
    counts[[90, 10, 80, 15, 5, 70, 13, 9, 8]] = 1
    assert sorted(sorted(p) for p, _ in packing.plan(counts, 100)) == [[5, 15, 80], [8, 9, 13, 70], [10, 90]]


def test_bpe(docs, monkeypatch):
    monkeypatch.setattr(bpe, "PART", 3_000)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = collections.Counter()
    for d, t in texts():
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want[d, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()] += 1
    got = bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.json"))
    assert by_row(got, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want


def test_empty_tables(empty, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    path = public_tokenizers.path("byte_bpe_50k.json")
    made = [
        quality.judged(empty, labels), lines.without_repeated_lines(empty), jaccard.near_duplicates(empty), substrings.without_repeated_words(empty),
        suffixes.without_repeated_strings(empty), tokenfile.read_documents(tokenfile.token_blocks(empty, path)), packing.pack_documents(empty), bpe.digests(empty, path),
    ]
    assert [df.count() for df in made] == [0] * 8


def test_no_labels_reject_nothing_but_the_base(docs, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.judged(docs, labels).where("_kept = _base_failed").count() == 0
