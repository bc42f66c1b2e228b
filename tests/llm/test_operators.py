"""Each operator against a brute-force version, and its defined results for odd rows."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from wrenchlake.llm import bpe, decontamination, lm_score, near_dedup, quality_gam, quality_rules, sharding, store, substring_dedup, suffix_dedup, text, url_filter

random.seed(5)
WORDS = ["".join(random.choice("abcdefghij") for _ in range(random.randint(1, 8))) for _ in range(3000)]
PASSAGE = " ".join(random.choice(WORDS) for _ in range(120))
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def edited(base, edits, seed):
    r, w = random.Random(seed), base.split()
    for _ in range(edits):
        w[r.randrange(len(w))] = r.choice(WORDS) + "x"
    return " ".join(w)


BASE = prose(160, 1)
TEXTS = (
    [None, "", " \n\t ", "one", "one", "two three four", "x " * 5000, "a" * 3000, "abé\U0001f600 " * 300, prose(400, 2), prose(400, 2), prose(30, 3) + " " + PASSAGE, PASSAGE + " " + prose(40, 4)]
    + [f"{prose(50, 10 + i)} {PASSAGE} {prose(50, 50 + i)}" for i in range(8)]
    + [edited(BASE, e, 100 + 10 * e + i) for e in range(6) for i in range(6)]
    + [BASE.upper(), prose(5, 6), prose(20000, 7)]
)
ROWS = [(i, t) for i, t in enumerate(TEXTS)] + [(3, "one"), (9, TEXTS[9]), (None, prose(80, 8)), (None, None), (None, TEXTS[10])]
EXTRA = ("k1", "k2", "hash", "node", "key", "start", "keep", "new_text", "score", "component_id")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)


@pytest.fixture(scope="module")
def wide(docs):
    """Rows with more columns, named like those that operators make."""
    return docs.withColumns({c: F.lit(c) for c in EXTRA})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def counted(df, *columns):
    return collections.Counter(tuple(r) for r in df.select(*columns).collect())


def test_window_minima_are_leftmost():
    r = np.random.default_rng(1)
    values = r.integers(0, 9, 500).astype(np.uint64) << np.uint64(40)
    starts = np.arange(0, 480)
    want = [s + int(values[s : s + 17].argmin()) for s in starts]
    assert text.window_minima(values, starts, 17).tolist() == want


def test_components(spark):
    edges = [(5, 4), (4, 3), (3, 9), (20, 21), (21, 20), (7, 7)] + [(100, i) for i in range(101, 140)]
    got = {r.node: r.component for r in store.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys((3, 4, 5, 9), 3), 20: 20, 21: 20, **dict.fromkeys(range(100, 140), 100)}
    assert store.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- op5 and op3


def removed_words(rows, length):
    seen = collections.Counter()
    split = [(i, (t or "").encode().split()) for i, t in rows]
    for _, w in split:
        seen.update(tuple(w[j : j + length]) for j in range(len(w) - length + 1))
    out = []
    for i, w in split:
        gone = [False] * len(w)
        for j in range(len(w) - length + 1):
            if seen[tuple(w[j : j + length])] > 1:
                gone[j : j + length] = [True] * length
        out.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g)))
    return out


def test_substring_dedup(spark, docs, empty, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = counted(substring_dedup.op5_substring_dedup(spark, str(tmp_path)), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == collections.Counter((i, n, r, hashlib.sha256(k).hexdigest()) for i, n, r, k in removed_words(ROWS, 35))
    assert substring_dedup.substring_dedup(empty).count() == 0


def test_substring_dedup_keeps_columns(wide):
    out = substring_dedup.substring_dedup(wide)
    assert out.columns == wide.columns and out.count() == len(ROWS)
    want = collections.Counter((i, k.decode() if r else t) for (i, t), (_, _, r, k) in zip(ROWS, removed_words(ROWS, 35)))
    assert counted(out, "doc_id", "text") == want


def removed_bytes(rows, length):
    seen = collections.Counter()
    raw = [(i, (t or "").encode()) for i, t in rows]
    for _, b in raw:
        seen.update(b[j : j + length] for j in range(len(b) - length + 1))
    out = []
    for i, b in raw:
        change = np.zeros(len(b) + 1, dtype=int)
        for j in range(len(b) - length + 1):
            if seen[b[j : j + length]] > 1:
                change[j] += 1
                change[j + length] -= 1
        gone = np.cumsum(change)[:-1] > 0
        kept = np.frombuffer(b, dtype=np.uint8)[~gone].tobytes()
        out.append((i, len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def test_suffix_dedup(spark, docs, empty, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = counted(suffix_dedup.op3_suffix_array_dedup(spark, str(tmp_path)), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == collections.Counter(removed_bytes(ROWS, 400))
    assert suffix_dedup.suffix_dedup(empty).count() == 0


def test_suffix_dedup_across_bucket_boundaries(spark, tmp_path):
    """One class spread over many buckets: strings at their edges are compared between buckets."""
    rows = [(i, f"{prose(60, 900 + i)} {PASSAGE} {prose(60, 1900 + i)}") for i in range(150)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    conf = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, x in conf.items():
            spark.conf.set(k, x)
        got = counted(suffix_dedup.op3_suffix_array_dedup(spark, str(tmp_path)), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    finally:
        for k, x in before.items():
            spark.conf.set(k, x)
    assert got == collections.Counter(removed_bytes(rows, 400))


@pytest.mark.parametrize("bucket,edges", [(1, 1), (7, 3), (64, 1024)])
def test_suffix_dedup_in_small_buckets(spark, docs, tmp_path, monkeypatch, bucket, edges):
    monkeypatch.setattr(suffix_dedup, "BUCKET", bucket)
    monkeypatch.setattr(suffix_dedup, "EDGE_ROWS", edges)
    rows = [x for x in ROWS if len(x[1] or "") < 20000] + [(700 + i, f"{prose(30, 2900 + i)} {PASSAGE[i * 7 : 400 + i * 11]} {prose(20, 3900 + i)}") for i in range(30)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    got = counted(suffix_dedup.op3_suffix_array_dedup(spark, str(tmp_path)), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == collections.Counter(removed_bytes(rows, 400))


def test_multikey_sort():
    r = np.random.default_rng(2)
    rows = r.integers(97, 99, (300, 24)).astype(np.uint8)
    order = suffix_dedup.multikey_sort(rows)
    assert [rows[i].tobytes() for i in order] == sorted(x.tobytes() for x in rows)


# ---- op6


def components_of(rows, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().translate(LOWER).split()
        sets[i] = frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    ids, parent = sorted(sets), {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[:n]:
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


@pytest.mark.parametrize("percent", [85, 80])
def test_near_dedup(docs, percent):
    got = near_dedup.near_duplicates(docs, percent).where("doc_id IS NOT NULL").distinct().collect()
    want = components_of([r for r in ROWS if r[0] is not None], percent)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == want


@pytest.mark.parametrize(("percent", "edits"), [(85, 9), (80, 9), (80, 4)])
def test_near_dedup_of_one_large_group(spark, percent, edits):
    """Members just below the threshold, some of which share what they lack and are linked beside the group's centre."""
    rows = [(i, edited(BASE, i % edits, 5000 + i)) for i in range(240)]
    rows += [(1000 + i, edited(edited(BASE, 5, 77 + i // 3), 1, 7000 + i)) for i in range(60)]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == components_of(rows, percent)


def test_near_dedup_of_odd_rows(docs, wide, empty):
    rows = near_dedup.near_duplicates(docs).where("doc_id IS NULL").collect()
    assert len(rows) == 3 and all(r.kept and r.component_id is None for r in rows)
    out = near_dedup.drop_near_duplicates(wide)
    assert out.columns == wide.columns
    kept = {i for i, (_, _, k) in components_of([r for r in ROWS if r[0] is not None], 85).items() if k}
    assert sorted((r.doc_id for r in out.collect()), key=str) == sorted([*kept, None, None, None], key=str)
    assert near_dedup.drop_near_duplicates(empty).count() == 0


def test_near_dedup_of_one_id_with_several_texts(spark):
    other = prose(120, 71)
    rows = [(5, BASE), (5, other), (6, edited(BASE, 1, 72)), (7, edited(other, 1, 73)), (8, prose(90, 74)), (8, prose(90, 75)), (9, ""), (9, " "), (5, BASE)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = collections.Counter((r.doc_id, r.component_id) for r in near_dedup.near_duplicates(df).collect())
    assert got == collections.Counter({(5, 5): 3, (6, 5): 1, (7, 5): 1, (8, 8): 2, (9, 9): 2})
    kept = collections.Counter((r.doc_id, r.text) for r in near_dedup.drop_near_duplicates(df).collect())
    assert kept == collections.Counter({(i, t): 1 for i, t in {(5, BASE), (5, other), (8, rows[4][1]), (8, rows[5][1]), (9, ""), (9, " ")}})


def test_components_at_a_hub(spark):
    """A hot node's links stay where they are: no shuffle by it reads more than a part of them."""
    edges = [(0, i) for i in range(1, 400)] + [(i, i + 1000) for i in range(1, 400)] + [(5000, 5001), (5001, 5002)]
    got = {r.node: r.component for r in store.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys([*range(400), *range(1001, 1400)], 0), 5000: 5000, 5001: 5000, 5002: 5000}


def test_signature_distance_counts_entries(spark):
    a, b = [0] * near_dedup.CHUNKS, [0] * near_dedup.CHUNKS
    b[0], b[3] = 0x0001_0000_8000_0001 - (1 << 63) + (1 << 63), -1
    row = lambda v, n: spark.createDataFrame([tuple(v)], ", ".join(f"{c} long" for c in near_dedup.SIGNATURE)).alias(n)
    assert row(a, "a").crossJoin(row(b, "b")).select(near_dedup.distance("a", "b").alias("d")).first().d == 3 + 4


# ---- op2


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(bpe.default_vocabulary())
    t.no_padding()
    t.no_truncation()
    return t


def test_bpe_equals_the_library(spark, library, docs, tmp_path):
    odd = ["It's WE'LL <|endoftext|> x<|startoftext|>y", "İΣ é́    \U0001f600!!!", "b" * 4000, "".join(random.choice("aeinrst") for _ in range(6000)), "<|endoftext", "\x1c a\x85b"]
    rows = ROWS + [(1000 + i, t) for i, t in enumerate(odd)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = counted(bpe.op2_bpe_round_trip(spark, str(tmp_path)), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    want = collections.Counter()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))] += 1
    assert got == want


def test_bpe_equals_the_library_on_every_character(library):
    b = bpe.Bpe(bpe.default_vocabulary())
    codes = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = [" ".join(f"a{chr(c)}b {chr(c)}{chr(c)}'s" for c in codes[i : i + 128]) for i in range(0, len(codes), 128)]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    for i in range(0, len(texts), 512):
        ids, cuts = b.ids_of([t.encode() for t in texts[i : i + 512]])
        for j, w in enumerate(want[i : i + 512]):
            assert ids[cuts[j] : cuts[j + 1]].tolist() == w, texts[i + j]


@pytest.mark.parametrize("size", [1, 5, 64])
def test_bpe_of_texts_in_pieces(library, monkeypatch, size):
    monkeypatch.setattr(bpe, "PIECE_BYTES", size)
    b = bpe.Bpe(bpe.default_vocabulary())
    texts = [(t or "")[:3000] for t in TEXTS] + ["  a<|endoftext|>b \n c ", "é" * 50 + " " + "日本" * 20]
    for t, got in zip(texts, b.digests([t.encode() for t in texts]), strict=True):
        ids = library.encode(t, add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert got.finish() == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))), t


def test_bpe_of_no_rows(empty):
    assert bpe.digests(empty, bpe.default_vocabulary()).count() == 0 and bpe.encode(empty, bpe.default_vocabulary()).count() == 0


def test_bpe_streams_in_constant_memory():
    b = bpe.Bpe(bpe.default_vocabulary())
    whole = bpe.Bpe(bpe.default_vocabulary())
    whole.window = 1 << 40
    word = "".join(random.choice(WORDS) for _ in range(3000))
    read = 0

    def symbols():
        nonlocal read
        for c in word.encode():
            read += 1
            yield c

    out, most, done = [], 0, 0
    for i in b.transduce(symbols()):
        out.append(i)
        done += b.size[i]
        most = max(most, read - done)
    assert out == list(whole.transduce(word.encode()))
    assert most <= b.window + 2


def test_bpe_of_very_long_words(library):
    """Words of megabytes, one of them within a text, and what is held beside the texts."""
    r = random.Random(3)
    plain, coded = ("".join(r.choice(s) for _ in range(1 << 21)) for s in ("etaoinshrdlu", "abcdefghijklmnopqrstuvwxyz0123456789+/"))
    b = bpe.Bpe(bpe.default_vocabulary())
    texts = [plain, f"a word {coded} and more"]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for t, got in zip(texts, b.digests([t.encode() for t in texts], keep=False), strict=True):
        ids = library.encode(t, add_special_tokens=False).ids
        assert got.ids == [] and got.finish() == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))


def test_bpe_merges_lowest_rank_first(library):
    r = random.Random(4)
    b = bpe.Bpe(bpe.default_vocabulary())
    for n in (1, 2, 3, 40, 300):
        for _ in range(50):
            word = "".join(r.choice("aeilnorst"[: r.randrange(1, 10)]) for _ in range(n))
            symbols = [b.inner[c] for c in word.encode()[:-1]] + [b.last[word.encode()[-1]]]
            assert b.merge(symbols) == library.encode(word, add_special_tokens=False).ids


def test_bpe_lookahead_of_a_small_merge_list():
    assert bpe.sufficient_lookahead([("b", "c")]) == 1
    assert bpe.sufficient_lookahead([("b", "c"), ("a", "b")]) == 2  # "ab" is one token, "abc" splits it
    assert bpe.sufficient_lookahead([("a", "b"), ("b", "c")]) == 1
    assert bpe.sufficient_lookahead([("c", "d"), ("b", "c"), ("a", "b")]) == 3


def test_bpe_decodes_text(spark):
    said = "hello world 日本 it 's "
    b = bpe.Bpe(bpe.default_vocabulary())
    ids = b.encode("Hello wörld 日本 it's".encode())
    machine = bpe.Decoder(b, as_tokens=False)
    assert "".join(machine.feed(np.array([i])) for i in ids) + machine.finish() == said.replace("world", "wörld")
    cut_off = bpe.Decoder(b, as_tokens=False)
    assert cut_off.feed(np.array([b.inner["日".encode()[0]]])) == "" and cut_off.finish() == "\ufffd"
    joined = bpe.Decoder(b)
    assert "".join(joined.feed(np.array([i])) for i in ids) + joined.finish() == " ".join(b.token[i] for i in ids)
    docs = spark.createDataFrame([(1, "Hello you"), (2, None)], "doc_id long, text string")
    tokens = bpe.encode(docs, bpe.default_vocabulary())
    assert {r.doc_id: r.text for r in bpe.decode(tokens, bpe.default_vocabulary(), as_tokens=False).collect()} == {1: "hello you ", 2: ""}


# ---- op1 and op7


def test_base_rules(docs):
    got = quality_rules.quality_rules(docs, quality_rules.NgramModel(None, None)).collect()
    want = collections.Counter()
    for i, t in ROWS:
        t = t or ""
        w = t.encode().split()
        lines = [x for x in t.split("\n") if x.strip(" \t\n\v\f\r")]
        n = collections.Counter(tuple(w[j : j + 3]) for j in range(len(w) - 2))
        again = set()
        for j in range(len(w) - 2):
            if n[tuple(w[j : j + 3])] > 1:
                again |= {j, j + 1, j + 2}
        failed = len(w) < 50 or 100 * len(again) > 50 * len(w)
        want[i, len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(again), failed] += 1
    assert collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want


def held_out_pairs(spark, rows, labels, column):
    other = {r.doc_id: r.quality for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2}
    return [(other[r.doc_id], r[column]) for r in rows if r.doc_id in other]


def test_classifiers_on_held_out_rows(spark, small):
    sf = small.replace("sf0.001", "sf0.01")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    gam = quality_gam.op7_quality_classifier(spark, sf).collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in gam)
    pairs = held_out_pairs(spark, gam, labels, "predicted")
    assert sum(a == b for a, b in pairs) >= 0.95 * len(pairs)
    rules = [r for r in quality_rules.op1_quality_rules(spark, sf).collect() if not r.base_failed]
    pairs = held_out_pairs(spark, rules, labels, "kept")
    assert sum(a == b for a, b in pairs) >= 0.95 * len(pairs)


def test_classifiers_without_usable_labels(spark, docs, empty):
    labels = spark.createDataFrame([(None, 1), (9, None), (10, 7)], "doc_id long, quality int")
    model = quality_gam.fit(docs, labels)
    assert {round(float(s), 6) for s in model.score(quality_gam.features([b"", b"abc"]))} == {0.5}
    rules = quality_rules.fit(docs, labels)
    assert rules.words is None and quality_rules.quality_rules(empty, rules).count() == 0


def test_character_features_are_runs_of_characters():
    texts = ["añb\U0001f600cd", "", "abc", "añb\U0001f600", "日本語日本語日"]
    block = text.Block([t.encode() for t in texts])
    (_, _), (at, of) = quality_rules.hashed(block)
    want = [[t[i : i + 4] for i in range(len(t) - 3)] for t in texts]
    assert np.bincount(of, minlength=len(texts)).tolist() == [len(w) for w in want]
    bucket = {}
    for w, b in zip([x for ws in want for x in ws], at.tolist(), strict=True):
        assert bucket.setdefault(w, b) == b
    assert at[0] == at[3] and len(set(bucket.values())) == len(bucket)


def plain_score(model, values):
    """The additive model by its definition: the table entry of each feature's bin and of each pair of bins, one by one."""
    bin_of = lambda cuts, v: sum(c <= v for c in cuts)
    total = model.base + sum(model.single[f][bin_of(model.cuts[f], v)] for f, v in enumerate(values))
    total += sum(t[bin_of(model.coarse[i], values[i]), bin_of(model.coarse[j], values[j])] for i, j, t in model.pairs)
    return 1 / (1 + np.exp(-total))


def plain_features(t):
    """The features that are counts, from the text itself."""
    w, letters = t.encode().split(), [c for c in t if c.isascii() and c.isalpha()]
    spread = max(len([x for x in t.encode() if x not in b" \t\n\v\f\r"]), 1)
    share = lambda chars: sum(t.count(c) for c in chars) / spread
    return [
        np.log1p(len(w)), sum(map(len, w)) / max(len(w), 1), share("#*$%&|<>"), sum(c.isupper() for c in letters) / max(len(letters), 1), share("!"), share("0123456789"),
        None, len(set(w)) / max(len(w), 1), sum(len(x) == 1 for x in w) / max(len(w), 1), share(".,;:?"), sum(x >= 128 for x in t.encode()) / spread, np.log1p(max(map(len, w), default=0)),
        np.log1p(len(w) / (t.count("\n") + 1)), None,
    ]


def test_quality_scores_equal_the_plain_model(spark, small):
    documents, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    model = quality_gam.fit(documents, labels)
    assert model.pairs and len(model.single) == len(quality_gam.FEATURES)
    text_of = {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}
    odd = {-1 - i: t or "" for i, t in enumerate(TEXTS)}
    for t in [*text_of.values(), *odd.values()]:
        got = quality_gam.features([t.encode()])[0]
        assert all(b is None or abs(a - b) < 1e-9 for a, b in zip(got, plain_features(t), strict=True)), t[:80]
        assert abs(model.score(got[None])[0] - plain_score(model, got)) < 1e-9
    got = quality_gam.op7_quality_classifier(spark, small).collect()
    assert all(abs(r.score - plain_score(model, quality_gam.features([text_of[r.doc_id].encode()])[0])) < 1e-9 for r in got)


def test_quality_scores_of_odd_rows(spark, docs, wide, empty, tmp_path):
    """Null and empty texts, very long ones, ties, repeated rows, other columns, an empty table: a row in, a row out."""
    labels = spark.createDataFrame([(i, int(len(TEXTS[i] or "") > 900)) for i in range(len(TEXTS))] + [(9, 1), (None, 1)], "doc_id long, quality int").withColumn("toxic", F.lit(0))
    for name, df in (("whole", docs), ("wide", wide), ("none", empty)):
        (df if name == "wide" else df.withColumn("lang", F.lit("en"))).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
    got = quality_gam.op7_quality_classifier(spark, f"{tmp_path}/whole").collect()
    assert collections.Counter(r.doc_id for r in got) == collections.Counter(i for i, _ in ROWS)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    score = collections.defaultdict(set)
    for r in got:
        score[r.doc_id].add(r.score)
    assert score[0] == score[1] == score[2] or len(score[0] | score[1]) == 1  # null counts as empty
    assert len(score[3] | score[4]) == 1 and len(score[9] | score[10]) == 1  # equal texts tie
    assert counted(quality_gam.op7_quality_classifier(spark, f"{tmp_path}/wide"), "doc_id", "score") == counted(quality_gam.op7_quality_classifier(spark, f"{tmp_path}/whole"), "doc_id", "score")
    assert quality_gam.op7_quality_classifier(spark, f"{tmp_path}/none").count() == 0


def test_filter_keeps_columns(spark, wide):
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    out = quality_gam.keep_good(wide, quality_gam.fit(wide, labels), 0.0)
    assert out.columns == wide.columns and out.count() == len(ROWS)


# ---- op4


def test_lm_scores(spark, docs, empty):
    common, logp = lm_score.fit(docs)
    assert np.allclose(np.exp(logp.astype(float)).sum(axis=1), 1, atol=1e-4)
    rows = lm_score.lm_scores(docs, common, logp).collect()
    assert len(rows) == len(ROWS)
    blank = [r for r in rows if r.doc_id in (0, 1, 2)]
    assert all(r.n_tokens == 0 and r.log_likelihood == 0 and r.mean_log_prob is None for r in blank)
    block, ids = lm_score.tokens([TEXTS[9].encode()], common)
    ends = [lm_score.EDGE, *ids.tolist(), lm_score.EDGE]
    want = sum(float(logp[ends[j - 1] * lm_score.V + ends[j + 1], ends[j]]) for j in range(1, len(ends) - 1))
    assert abs(next(r.log_likelihood for r in rows if r.doc_id == 9) - want) < 1e-3
    assert lm_score.lm_scores(empty, *lm_score.fit(empty)).count() == 0


def test_lm_counts_cover_the_corpus(docs):
    n = sum(len((t or "").encode().split()) for _, t in ROWS)
    assert lm_score.word_counts(docs).agg({"n": "sum"}).first()[0] == n
    common = lm_score.vocabulary(docs)
    assert lm_score.triple_counts(docs, common).agg({"n": "sum"}).first()[0] == n


def test_lm_prefers_what_it_has_seen(spark):
    rows = [(i, "the cat sat on the mat and the dog sat on the rug " * 20) for i in range(20)]
    docs = spark.createDataFrame([*rows, (99, "rug mat the the dog on sat cat and and on " * 20)], "doc_id long, text string")
    got = {r.doc_id: r.mean_log_prob for r in lm_score.lm_scores(docs, *lm_score.fit(docs)).collect()}
    assert got[0] > got[99] + 0.3


def test_lm_scores_every_word_by_its_own_counts(spark, docs, empty):
    common, logp = lm_score.fit(docs)
    network = {r.doc_id: r for r in lm_score.lm_scores(docs, common, logp).where("doc_id IS NOT NULL").collect()}
    places, near, distinct = [], [collections.Counter(), collections.Counter()], np.zeros(lm_score.SHAPES, dtype=int)
    counts = lm_score.word_counts(docs).collect()
    for r in counts:
        distinct[r.shape] += np.uint64(r.word % (1 << 64)) not in common
    buckets = 1 << int(np.ceil(np.log2(16 * np.sqrt(distinct.sum()))))
    for i, t in ROWS:
        block, ids, hashes = lm_score.hashed_tokens([(t or "").encode()], common)
        left, right = lm_score.beside(block, hashes, buckets)
        places += [(i, int(c) - lm_score.COMMON, int(h), int(a), int(b)) for c, h, a, b in zip(ids, hashes, left, right) if c >= lm_score.COMMON]
    n, total = collections.Counter((c, h) for _, c, h, _, _ in places), collections.Counter(c for _, c, *_ in places)
    both = [collections.Counter((p[1], p[2], p[3 + side]) for p in places) for side in (0, 1)]
    near = [collections.Counter((p[1], p[3 + side]) for p in places) for side in (0, 1)]
    want, times = collections.Counter(), collections.Counter(i for i, _ in ROWS)
    for i, c, h, *sides in places:
        alone = (n[c, h] - 1 + lm_score.PRIOR) / (total[c] - 1 + lm_score.PRIOR * distinct[c])
        beside = [(both[s][c, h, b] - 1) / (near[s][c, b] - 1) if near[s][c, b] > 1 else alone for s, b in enumerate(sides)]
        want[i] += np.log((1 - lm_score.NEAR) * alone + lm_score.NEAR / 2 * sum(beside)) / times[i]
    rows = lm_score.scores(docs).collect()
    assert collections.Counter(r.doc_id for r in rows) == times
    assert all(abs(r.log_likelihood - network[r.doc_id].log_likelihood - want[r.doc_id]) < 1e-2 for r in rows if r.doc_id is not None)
    assert all(r.mean_log_prob is None and r.log_likelihood == 0 for r in rows if r.doc_id in (0, 1, 2))
    assert lm_score.scores(empty).count() == 0


def test_lm_tells_garbled_and_shuffled_rare_words(spark):
    r = random.Random(11)
    words = ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(600)]
    sentences = [[r.choice(words) for _ in range(8)] for _ in range(150)]
    rows = [(i, " ".join(w for _ in range(30) for w in r.choice(sentences))) for i in range(40)]
    first = rows[0][1].split()
    known = {w for w, _ in collections.Counter(w for _, t in rows for w in t.split()).most_common(200)}
    garbled = " ".join(w if w in known else "".join(r.choice("klmnopqrst") for _ in w) for w in first)
    shuffled = [w for w in first if w not in known]
    r.shuffle(shuffled)
    shuffled = " ".join(w if w in known else shuffled.pop() for w in first)
    docs = spark.createDataFrame([*rows, (98, shuffled), (99, garbled)], "doc_id long, text string")
    got = {r.doc_id: r.mean_log_prob for r in lm_score.scores(docs).collect()}
    assert got[0] > got[98] + 0.3 and got[98] > got[99] + 0.3
    assert max(got.values()) < 0


def test_lm_scores_ignore_other_columns(spark, docs, wide):
    one, two = ({(r.doc_id, r.n_tokens, round(r.log_likelihood, 6)) for r in lm_score.scores(df).collect()} for df in (docs, wide.withColumns({"k": F.lit(1), "n": F.lit(2), "part": F.lit(3)})))
    assert one == two


# ---- op9


def test_decontamination(spark, docs, wide, empty):
    items = [(1, prose(40, 77)), (2, prose(15, 78)), (3, "tiny item"), (4, None), (5, " "), (1, prose(40, 77))]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("k1", F.lit(1))
    changed = items[0][1].upper().split()
    changed[5] = changed[20] = "zzz"
    planted = [(500, f"{prose(60, 79)} {items[0][1]} {prose(60, 80)}"), (501, " ".join(changed)), (502, " ".join(items[0][1].split()[:12])), (503, f"a {items[1][1]} b"), (504, "a Tiny  item b"), (505, "tiny other item")]
    all_docs = docs.union(spark.createDataFrame(planted, "doc_id long, text string"))
    got = {r.doc_id: r for r in decontamination.contamination(all_docs, bench).where("doc_id >= 500").collect()}
    assert {i: list(r.item_ids) for i, r in got.items()} == {500: [1], 501: [1], 502: [], 503: [2], 504: [3], 505: []}
    assert got[500].longest == 40 and decontamination.contamination(docs, bench).where("contaminated").count() == 0
    assert decontamination.decontaminate(wide, bench).count() == len(ROWS)
    assert decontamination.decontaminate(all_docs, bench).count() == len(ROWS) + 2
    assert decontamination.contamination(empty, bench).count() == 0
    assert decontamination.contamination(docs, bench.limit(0)).where("contaminated").count() == 0


def test_masks_hit_every_overlap_with_two_substitutions():
    import itertools

    n = decontamination.MIN_WORDS
    for errors in itertools.combinations(range(n), 2):
        assert any(all(s + i not in errors for i, c in enumerate(m) if c == "1") for m in decontamination.MASKS for s in range(n - len(m) + 1))


def overlaps_of(item, said, min_words=decontamination.MIN_WORDS):
    found = decontamination.Seeds([(7, 0, len(item), " ".join(item).encode())])
    block = text.Block([" ".join(said).encode()], lower=True)
    doc = block.words()[2]
    return [(d, i, a, b) for d, i, _, a, b in found.overlaps(block.word_hashes(), doc, np.array([0]), np.array([len(doc)]), min_words)]


@pytest.mark.parametrize("size,errors", [(7, 1), (10, 1), (12, 1), (13, 1), (13, 2), (14, 1), (14, 2), (15, 2), (17, 1), (20, 2)])
def test_overlaps_with_substitutions_anywhere(size, errors):
    import itertools

    item = [f"i{j}" for j in range(size)]
    for wrong in itertools.combinations(range(size), errors):
        said = [f"a{j}" for j in range(30)] + [f"x{j}" if j in wrong else w for j, w in enumerate(item)] + [f"b{j}" for j in range(30)]
        right = [30 + j for j in range(size) if j not in wrong]
        assert overlaps_of(item, said) == [(0, 7, right[0], right[-1] + 1)], wrong


def test_overlaps_on_one_diagonal_and_at_a_rate():
    item = [f"i{j}" for j in range(60)]
    said = [f"x{j}" if 15 <= j < 40 else w for j, w in enumerate(item)]
    assert overlaps_of(item, said) == [(0, 7, 0, 15), (0, 7, 40, 60)]
    for size in range(14, 51):
        said = [f"x{j}" if j % 5 == 4 else w for j, w in enumerate(item[:size])]
        found = overlaps_of(item[:size], said)
        assert found and found[0][2] == 0 and found[0][3] >= 13
    said = [f"x{j}" if j in (2, 6, 10) else w for j, w in enumerate(item[:13])]
    assert overlaps_of(item[:13], said) == []
    for wrong in range(6):
        assert overlaps_of(item[:6], [f"x{j}" if j == wrong else w for j, w in enumerate(item[:6])]) == []


def all_overlaps(said, item, min_words=decontamination.MIN_WORDS):
    """Every overlap of two lists of words, from all places on all diagonals."""
    size, out = min(min_words, len(item)), []
    most = min(2, 2 * size // 13)
    for diagonal in range(-len(item) + 1, len(said)):
        lo, hi = max(0, diagonal), min(len(said), diagonal + len(item))
        same = [said[i] == item[i - diagonal] for i in range(lo, hi)]
        good = [i for i in range(len(same) - size + 1) if size - sum(same[i : i + size]) <= most]
        runs = []
        for i in good:
            if runs and i <= runs[-1][1]:
                runs[-1][1] = i + size
            else:
                runs.append([i, i + size])
        for a, b in runs:
            right = [i for i in range(a, b) if same[i]]
            out.append((lo + right[0], lo + right[-1] + 1))
    return out


def contaminated(rows, items):
    low = lambda t: (t or "").encode().translate(LOWER).split()
    names = {}
    for i, t in items:
        if low(t):
            names[tuple(low(t))] = min([x for x in (i, names.get(tuple(low(t)))) if x is not None], default=None)
    out = []
    for d, t in rows:
        found = [(i, all_overlaps(low(t), list(w))) for w, i in names.items()]
        spans = [y - x for _, v in found for x, y in v]
        out.append((d, bool(spans), tuple(sorted({i for i, v in found if v and i is not None})), max(spans, default=0)))
    return collections.Counter(out)


def test_decontamination_equals_search_at_all_places(spark):
    r = random.Random(31)
    words = [f"w{i}" for i in range(12)]
    said = lambda n: " ".join(r.choice(words) for _ in range(n))
    items = [(i, said(n)) for i, n in enumerate([1, 2, 4, 5, 6, 7, 9, 12, 13, 14, 20, 40])] + [(50, None), (51, " "), (0, said(30)), (None, said(25))]
    items += [(60, items[10][1].upper()), (None, items[9][1]), (9, said(16))]
    rows = [(None, None), (0, ""), (1, "  "), (2, "w1"), (2, "w1"), (None, said(30)), (3, said(3)), (4, said(200)), (5, ("w1 w2 " * 60).strip()), (5, said(13))]
    for i, (_, t) in enumerate(items):
        for j, n in enumerate((0, 1, 2, 3)):
            w = (t or "").split() or ["w0"]
            for _ in range(n):
                w[r.randrange(len(w))] = "other"
            rows.append((100 + 10 * i + j, f"{said(r.randrange(20))} {' '.join(w)} {said(r.randrange(20))}"))
    items, rows = [(i, t) for i, t in items if not t or len(t.split()) > 3], rows + rows[40:44]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.contamination(docs, bench).collect()
    assert collections.Counter((x.doc_id, x.contaminated, tuple(x.item_ids), x.longest) for x in got) == contaminated(rows, items)


@pytest.mark.parametrize("together", [40, 1 << 19])
def test_items_with_common_beginnings(monkeypatch, together):
    monkeypatch.setattr(decontamination, "TOGETHER", together)
    r = random.Random(5)
    for shared, vocabulary in ((10, 4), (11, 40), (15, 40), (30, 3)):
        words = [f"w{i}" for i in range(vocabulary)]
        said = lambda n: [r.choice(words) for _ in range(n)]  # noqa: B023, E731
        start = said(shared)
        items = [start + said(r.randrange(12)) for _ in range(30)] + [said(5) + start, start[2:9], start[:6], said(9)]
        texts = [said(9) + start + said(9) for _ in range(3)] + [start * 3, [], start, items[3] + items[4], said(40)]
        for t in list(texts):
            t = t.copy()
            for _ in range(2):
                if t:
                    t[r.randrange(len(t))] = "other"
            texts.append(t)
        block = text.Block([" ".join(t).encode() for t in texts], lower=True)
        doc, n = block.words()[2], np.arange(block.n)
        found = decontamination.Seeds([(i, 0, len(t), " ".join(t).encode()) for i, t in enumerate(items)])
        got = found.overlaps(block.word_hashes(), doc, np.searchsorted(doc, n), np.searchsorted(doc, n, side="right"), 13)
        want = [(d, i, a, b) for d, t in enumerate(texts) for i, item in enumerate(items) for a, b in all_overlaps(t, item)]
        assert sorted((d, i, a, b) for d, i, _, a, b in got.tolist()) == sorted(want) and want


def test_common_beginnings_are_compared_once():
    start = [f"s{i}" for i in range(15)]
    items = [start + [f"i{j}_{i}" for i in range(15)] for j in range(3000)]
    texts = [[f"d{j}_{i}" for i in range(20)] + start + ["end"] * 15 for j in range(50)]
    block = text.Block([" ".join(t).encode() for t in texts], lower=True)
    doc, n = block.words()[2], np.arange(block.n)
    seeds = decontamination.Seeds([(i, 0, len(t), " ".join(t).encode()) for i, t in enumerate(items)])
    first, last = np.searchsorted(doc, n), np.searchsorted(doc, n, side="right")
    assert sum(len(t.matches(seeds.words, block.word_hashes(), doc)[0]) for t in seeds.stretches(13)) == 5 * 50
    parts = list(seeds.parts(block.word_hashes(), doc, first, last, 13))
    assert sum(map(len, parts)) == 3000 * 50 and {tuple(x) for x in np.concatenate(parts)[:, 3:].tolist()} == {(20, 35)}


def test_long_items_count_as_wholes(spark):
    long_ = {n: [f"i{n}_{j}" for j in range(n)] for n in (50_000, 50_001, 200_000)}
    bench = spark.createDataFrame([(n, " ".join([*w, "the"])) for n, w in long_.items()], "item_id long, text string")
    rows = [(1, "see the cat"), (2, " ".join(long_[200_000][45_000:160_000])), (3, " ".join(long_[50_001][-13:])), (4, " ".join(long_[50_001][-10:]))]
    got = {x.doc_id: (list(x.item_ids), x.longest) for x in decontamination.contamination(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert got == {1: ([], 0), 2: ([200_000], 115_000), 3: ([50_001], 13), 4: ([], 0)}


def test_blocks_of_the_benchmark_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "BLOCK_WORDS", 3000)
    monkeypatch.setattr(decontamination, "PIECE", 600)
    monkeypatch.setattr(decontamination, "SHARED", 100)
    items = [(i, prose(1000, 900)) for i in range(2000)] + [(3000 + i, prose(400 + i, 1000 + i)) for i in range(40)] + [(5000, prose(2500, 998))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    names, blocks = decontamination.item_blocks(bench)
    sizes = [sum(len(x.text.split()) for x in b.collect()) for b in blocks]
    assert names.count() == 42 and max(sizes) <= 3000 and len(blocks) > 5
    assert decontamination.item_classes(bench).where("same_as = 0").count() == 2000
    rows = [(1, prose(2500, 998)), (2, prose(1000, 900)[40:]), (3, prose(410, 1010)), (4, prose(90, 2))]
    got = {x.doc_id: (list(x.item_ids), x.longest) for x in decontamination.contamination(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert got[1] == ([5000], 2500) and got[2][0] == [0] and got[3] == ([3010], 410) and got[4] == ([], 0)


# ---- op8


def test_url_rules_and_aliases(spark):
    rows = [
        (1, "http://a.net/x", None),
        (2, "https://b.example.net/en/q?x=1", ""),
        (3, "http://other.info/page", '<LINK rel="canonical" href="http://a.net/x">'),
        (4, "http://m.other.info/page/", None),
        (5, "http://both.info/1", '<meta http-equiv="refresh" content="0; url=http://other.info/page"><link rel=canonical href=https://b.example.net/en/q?x=1>'),
        (6, None, "<p>"),
        (7, "no scheme", None),
        (8, "ftp://EXAMPLE.com/de/a#f", None),
        (9, "http://net?q", None),
        (10, "http://x.org", None),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: tuple(r)[1:] for r in url_filter.url_verdicts(pages).collect()}
    assert got[1] == ("a.net", "/x", "net/", "block") and got[2] == ("b.example.net", "/en/q", "example.net/en/", "allow")
    assert got[3][3] == got[4][3] == got[5][3] == "allow"  # one component with an allowed member
    assert got[6] == ("", "", None, "allow") and got[7] == ("", "", None, "allow")
    assert got[8] == ("example.com", "/de/a", "example.com/de/", "block") and got[9] == ("net", "", None, "allow") and got[10][2:] == (None, "allow")
    some = pages.where("page_id <> 5 AND page_id <> 2")
    verdicts = lambda df, **more: {r.page_id: r.verdict for r in url_filter.url_verdicts(df, **more).collect()}
    assert verdicts(some)[3] == "block" and verdicts(some)[4] == "allow"
    assert verdicts(some, mirrors=True)[3] == verdicts(some, mirrors=True)[4] == "block"
    assert url_filter.url_verdicts(pages.limit(0)).count() == 0
    given = spark.createDataFrame([("http://x.org", "http://a.net/x")], "a string, b string")
    assert verdicts(pages.where("page_id in (1, 10)"), edges=given)[10] == "block"
    twice = pages.union(pages).withColumns({"form": F.lit("f"), "part": F.lit("p"), "rule": F.lit("r")})
    assert counted(url_filter.url_verdicts(twice), "page_id", "verdict") == collections.Counter({(i, v[3]): 2 for i, v in got.items()})
    other = [("info", "/page", "block")]
    assert {r.page_id: r.rule for r in url_filter.url_verdicts(pages, rules=other).collect()}[3] == "info/page"


@pytest.mark.parametrize("target", ["../g", "g?y=1", "./a/../b", "/top/x", "//h.org/p", "?q=2", "#frag", "", "mailto:x@y", "HTTPS://Z.Info/a#b", "..", "a/..", "/../x", "g;x=1/./y"])
def test_link_targets_are_resolved(spark, target):
    from urllib.parse import urldefrag, urljoin, urlsplit

    page = "http://Host.info/b/c/d?q=1#f"
    row = spark.createDataFrame([(page, target)], "p string, t string").select(url_filter.address(url_filter.resolved(F.col("t"), F.col("p"))).alias("u")).first()
    want = urldefrag(urljoin(page, target))[0] if target and not target.startswith("#") and not target.startswith("mailto:") else None
    if want is not None:
        parts = urlsplit(want)
        want = f"{parts.scheme}://{parts.netloc.lower()}{parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")
    assert row.u == want


def test_url_verdicts_over_injected_links(spark):
    """Random links on pages of many hosts, against a search from every page, and against the SQL."""
    import duckdb

    from wrenchlake.llm.queries import ORACLE

    r = random.Random(41)
    hosts = [f"h{i}.info" for i in range(60)] + ["a.net", "x.example.net", "example.com", "q.org"]
    urls = [f"http://{r.choice(hosts)}/{r.choice(['en/', 'de/', 'fr/', ''])}p{i}" for i in range(160)]
    html, edges = {}, []
    for i, u in enumerate(urls):
        html[u] = "<p>"
        if r.random() < 0.5:
            v = r.choice(urls)
            same = u.split("/")[2] == v.split("/")[2]
            target = "/" + v.split("/", 3)[3] if same else v if r.random() < 0.7 else v.removeprefix("http:")
            html[u] = r.choice(['<link rel="canonical" href="{}">', "<meta http-equiv=refresh content='3;url={}'>", '<meta property="og:url" content="{}"/>']).format(target)
            edges.append((u, v))
    near = collections.defaultdict(set)
    for u, v in edges:
        near[u].add(v)
        near[v].add(u)

    def ruling(u):
        host, path = u.split("/")[2], "/" + u.split("/", 3)[3]
        fits = [(len(h), len(p), w == "allow", w) for h, p, w in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits)[3] if fits else None

    def verdict(u):
        if ruling(u):
            return ruling(u)
        seen, todo = {u}, [u]
        while todo:
            todo = [y for x in todo for y in near[x] if y not in seen and not seen.add(y)]
        said = {ruling(x) for x in seen}
        return "block" if "allow" not in said and "block" in said else "allow"

    rows = [(i, u, html[u]) for i, u in enumerate(urls)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {x.page_id: x.verdict for x in url_filter.url_verdicts(pages).collect()}
    assert got == {i: verdict(u) for i, u in enumerate(urls)}
    assert sum(v == "block" and ruling(urls[i]) is None for i, v in got.items()) > 3
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    done = con.execute(ORACLE["op8_url_filters"])
    names = [c[0] for c in done.description]
    assert {x[names.index("page_id")]: x[names.index("verdict")] for x in done.fetchall()} == got


# ---- op10


def test_sharding(spark, docs, tmp_path):
    rows = docs.withColumn("source", F.when(F.col("doc_id") % 3 == 0, "a").when(F.col("doc_id") % 3 == 1, "b"))
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    got = sharding.op10_stratified_sharding(spark, str(tmp_path)).collect()
    assert len(got) == len(ROWS)
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    assert sorted(by) == list(range(8)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(r.slot for r in x) == list(range(len(x))) for x in by.values())
    for source in ("a", "b", None):
        n = [sum(r.source == source for r in x) for x in by.values()]
        assert max(n) - min(n) <= 2
    want = collections.Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in ROWS)
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    assert sharding.shards(rows.limit(0)).count() == 0


def test_sharding_ignores_other_columns_and_takes_few_rows(docs, wide):
    more = {c: F.lit(1) for c in ("digest", "_range", "_n", "r", "at", "shard", "slot", "fraction", "size")}
    one = counted(sharding.shards(docs.withColumn("source", F.lit("s"))), "doc_id", "text_crc32", "shard", "slot")
    assert one == counted(sharding.shards(wide.withColumn("source", F.lit("s")).withColumns(more)), "doc_id", "text_crc32", "shard", "slot")
    few = sharding.shards(docs.where("doc_id IN (5, 6, 7)").withColumn("source", F.lit(None).cast("string"))).collect()
    assert len(few) == 3 and all(r.slot == 0 for r in few)


def test_sharding_does_not_depend_on_partitions(docs):
    rows = docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).withColumn("source", F.lit("s"))
    once = {(r.doc_id, r.shard, r.slot) for r in sharding.shards(rows.repartition(1)).collect()}
    assert once == {(r.doc_id, r.shard, r.slot) for r in sharding.shards(rows.repartition(7)).collect()}


def test_empty_path_and_slash_are_one_url(spark, tmp_path):
    """Their verdict is the same with and without links elsewhere, and is the SQL's."""
    import duckdb

    from wrenchlake.llm.queries import ORACLE

    urls = ["http://x.net", "http://x.net/", "http://y.net", "http://z.org", "http://z.org/", "http://example.net?q", "http://example.net/?q", "http://www.x.net#a", "http://www.x.net/#b", "https://x.net", "", None, "http://"]
    far = "<link rel=canonical href='http://far.org/fr/x'>"
    for html in ([None] * len(urls), [None, None, far, *[None] * (len(urls) - 3)]):
        rows = [*zip(range(len(urls)), urls, html, strict=True), (90, "http://far.org/a", far), (91, "http://far.org/fr/x", None)] if any(html) else list(zip(range(len(urls)), urls, html, strict=True))
        pages = spark.createDataFrame(rows, "page_id long, url string, html string")
        got = sorted((r.page_id, r.rule, r.verdict) for r in url_filter.url_verdicts(pages).collect())
        path = str(tmp_path / f"p{sum(map(bool, html))}")
        pages.coalesce(1).write.parquet(path)
        con = duckdb.connect()
        con.sql(f"CREATE VIEW pages AS SELECT * FROM '{path}/*.parquet'")
        assert got == sorted((r[0], r[3], r[4]) for r in con.execute(ORACLE["op8_url_filters"]).fetchall())
        verdict = {i: v for i, _, v in got}
        assert verdict[0] == verdict[1] == "block" and verdict[5] == verdict[6] and verdict[7] == verdict[8] == "block"
        assert verdict[2] == verdict[9] == verdict[10] == "allow"
