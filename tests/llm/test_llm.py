"""The training-data operators against brute force, exact round trips and held-out accuracy, and on awkward tables."""

import hashlib
import random
import time
import zlib
from functools import partial

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from credal.llm import ann, chat, graph, line_dedup, mixing, neighbours, ngram_join, packing, quality, queries, spotsigs, token_counts, token_io
from credal.llm.arrays import slices
from credal.llm.graph import components
from credal.llm.tokens import Encoder

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = ["", " ", "\n\n", "a", "A  b", "x\xa0 y", "ĺ   z", "<|endoftext|> it's 12", "Σίσυφος ÀÉ×÷", "\x1c\x85 t", "wörd " * 4000, "the the the\nthe the the"]


def tok(name):
    return queries.tokenizer_path(name)


def reference(name, text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tok(name)).encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def odd_docs(spark):
    rows = [(i, t, "en", None if i % 3 == 0 else "s", None) for i, t in enumerate(ODD)] + [(100, None, None, None, None), (None, "no id here", "en", "s", 3), (3, "a", "en", "s", 1), (3, "other text", "en", "s", 1)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.mark.parametrize("name,spaced", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_cached_encoding_is_the_library_s(name, spaced):
    rnd = random.Random(5)
    alphabet = ["a", "b", "É", "×", "\n", " ", "  ", "\t", "'s", "'LL", "1", "٣", "\xa0", " ", "ı", "İ", "Σ", "中", "́", "!", "\x1c", "\x85", "<|endoftext|>", "<|startoftext|>", "\u3000", "\r\n", "😀", "\x0b", "½"]
    texts = ODD[:10] + ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 14))) for _ in range(1500)]
    enc = Encoder(tok(name), spaced)
    assert enc.cuts and not Encoder(tok(name), not spaced).cuts
    for lo, _, buf, off in slices(pa.array(texts)):
        ids, cuts = enc.encode(buf, off)
        for i in range(len(off) - 1):
            assert ids[cuts[i] : cuts[i + 1]].tolist() == enc.tokenizer.encode(texts[lo + i], add_special_tokens=False).ids


def test_files_of_other_kinds_are_encoded_by_the_library(tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    other = Tokenizer(models.WordLevel({"a": 0, "b": 1, "?": 2}, unk_token="?"))
    other.pre_tokenizer = pre_tokenizers.Whitespace()
    other.save(str(tmp_path / "other.json"))
    enc = Encoder(str(tmp_path / "other.json"), True)
    ids, cuts = next(enc.encode(buf, off) for _, _, buf, off in slices(pa.array(["a b", None, "b c a"])))
    assert not enc.cuts and ids.tolist() == [0, 1, 1, 2, 0] and cuts.tolist() == [0, 2, 2, 5]


def test_chat_round_trip(spark):
    hard = ["<|im_end|>", "<|\\im_end|>", "<|\\\\im_start|>", "<|im_", "\\", "\n", "", queries.CONTROL, "<<|im_end|>|>"]
    rows = [(c, k, role, t) for c, role in enumerate(["user", "a\\nb\n", "<|im_start|>", None]) for k, t in enumerate(hard + [None])] + [(None, None, "user", "x"), (50, 1, "user", "b"), (50, 1, "user", "b"), (50, 1, "assistant", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    got = {r.conv_id: r for r in chat.format_conversations(df).collect()}
    for c in {r[0] for r in rows}:
        want = sorted([(r[1] if r[1] is not None else -1, r[2] or "", r[3] or "") for r in rows if r[0] == c])
        assert [(t.role, t.text) for t in got[c].turns] == [w[1:] for w in want]
    assert got[0].n_escaped == 5 and chat.digest(chat.format_conversations(df.where("false"))).collect() == []


@pytest.mark.parametrize("dim", [32, 600])
def test_ann_ties_and_odd_vectors(spark, dim):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((900, dim)).round(3)
    base[100:160] = base[100]
    base[200] *= 2.0**660
    base[201], base[250] = base[200] * 2.0**-1040, base[200]
    odd = [(1000, None), (1050, [0.0] * dim), (1100, [float("nan")] * dim), (1150, [None] * dim), (None, [1.0] * dim), (1200, []), (1250, [1.0, 2.0]), (50, [9e9] * dim)]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(base)] + odd
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"cls": F.lit("clash"), "v": F.lit(1)})
    got = {}
    for r in ann.nearest(df, df.where("vec_id % 50 = 0"), k=5, block_rows=200, query_block_rows=8).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == set(range(0, 900, 50))
    m = ann.unit(np.array([min([v for j, v in rows if j == i and v]) for i in range(900)]))
    for q, found in got.items():
        s = m @ m[q]
        want = [int(i) for i in np.lexsort((np.arange(900), -s.round(12))) if i != q][:5]
        assert [i for i, _ in found] == want and np.allclose([x for _, x in found], s[want], atol=1e-12)
    assert [i for i, _ in got[100]] == [101, 102, 103, 104, 105]


def test_ann_bounds_hold(spark):
    rng = np.random.default_rng(3)
    x, turn = rng.standard_normal((4000, 64)), ann.Rotation(64, 7)
    codes, f = ann.encode(x, turn)
    estimate, error = ann.bounds(codes, f, turn(ann.unit(x[:40])), 4.0)
    assert (np.abs(estimate - ann.unit(x[:40]) @ ann.unit(x).T) <= error + 1e-6).mean() > 0.9997


def test_ann_small_tables(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (50, [1.0, 1.0]), (7, [0.0, 2.0])], "vec_id long, embedding array<double>")
    got = [(r.query_id, r["rank"], r.vec_id) for r in ann.nearest(df, df.where("vec_id % 50 = 0")).collect()]
    assert sorted(got) == [(0, 1, 50), (0, 2, 7), (50, 1, 0), (50, 2, 7)]
    assert ann.nearest(df.where("false"), df).collect() == [] and ann.nearest(df, df.where("false")).collect() == []


def _brute(rows, width, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))).split()
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    return _linked(sets, percent)


def _linked(sets, percent):
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {(i, len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("width,percent", [(3, 90), (2, 80)])
def test_ngram_join_is_exact(spark, width, percent):
    rnd = random.Random(3)
    vocabulary = [f"w{k}" for k in range(900)]
    base = [rnd.choice(vocabulary) for _ in range(120)]
    rows = [(10 + i, " ".join(w if rnd.random() > r else rnd.choice(vocabulary) for w in base)) for i, r in enumerate([0.004, 0.01, 0.015, 0.03] * 20)]
    rows += [(1, None), (2, ""), (3, "a b"), (4, "A B"), (5, " \n"), (6, "x")] + [(500 + k, " ".join(rnd.choice(vocabulary[:9]) for _ in range(rnd.randint(2, 13)))) for k in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("clash")).withColumn("rep", F.lit(0))
    assert {tuple(r) for r in ngram_join.link(df, width, percent).collect()} == _brute(rows, width, percent)


@pytest.mark.parametrize("width,percent,least", [(3, 90, 9), (5, 80, 4), (1, 50, 1), (2, 67, 3)])
def test_ngram_join_links_the_least_sets_with_those_of_one_more(spark, width, percent, least):
    rows = []
    for k in range(4):  # the least set and its extensions by a word; the set one smaller and its extension
        w = [f"v{k}x{j}" for j in range(least + width + 1)]
        rows += [(10 * k + j, " ".join(t)) for j, t in enumerate([w[1:-1], w[1:], w[:-1]] if k % 2 else [w[:-3], w[:-2]]) if t]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = _brute(rows, width, percent)
    assert {tuple(r) for r in ngram_join.link(df, width, percent).collect()} == want
    assert {c for i, _, c in want if i // 10 == 1} == {10}


@pytest.mark.parametrize("percent", [50, 60, 80, 90])
def test_ngram_join_at_every_boundary_of_nested_sets(spark, percent):
    rows = []
    for a in range(1, 41):
        for b in range(a + 1, 42):
            if abs(100 * a - percent * b) <= 100:  # on both sides of the threshold
                rows += [(1000 * a + 10 * b + j, " ".join(f"v{a}x{b}x{k}" for k in range(m))) for j, m in enumerate((a, b))]
    got = {r.doc_id: r.component_id for r in ngram_join.link(spark.createDataFrame(rows, "doc_id long, text string"), 1, percent).collect()}
    assert got == {i: i - (i % 10 if 100 * ((i // 1000)) >= percent * (i % 1000 // 10) else 0) for i, _ in rows}


@pytest.mark.parametrize("percent", [80, 90])
def test_ngram_join_answers_near_misses_from_their_leader(spark, percent, monkeypatch):
    rnd = random.Random(percent)
    base = [f"b{k}" for k in range(220)]
    some = [f"e{k}" for k in range(40)]  # edits that recur, so that some copies meet through them alone
    rows = [(0, " ".join(base))]
    for i in range(1, 260):
        w = list(base)
        for k in rnd.sample(range(220), rnd.choice([4, 9, 14, 20, 26])):
            w[k] = rnd.choice(some) if i % 3 else f"u{i}x{k}"
        rows.append((i, " ".join(w)))
    for i in range(300, 330):  # pairs beside the leader's links, near each other
        w = [x if k % 7 else f"p{i // 2}x{k}" for k, x in enumerate(base)]
        rows.append((i, " ".join(w[: 220 - i % 2])))
    asked, own = [], ngram_join._derived_links
    monkeypatch.setattr(ngram_join, "_derived_links", lambda *a: (lambda df: asked.append(df.count()) or df)(own(*a)))
    got = {tuple(r) for r in ngram_join.link(spark.createDataFrame(rows, "doc_id long, text string"), 1, percent).collect()}
    assert got == _brute(rows, 1, percent) and asked[0] > 0


def test_copies_that_their_leader_misses_make_few_links(spark):
    """Classes of one leader that it does not link with, two groups of near copies: not all of their pairs are made, and no group is split."""
    rnd = random.Random(7)
    rows = [(10**6, 10**6, 200, 200, True, b"", 10**6)]
    for i in range(1200):
        own = [1 + 1000 * (i % 2) + k for k in range(12)]
        for k in rnd.sample(range(12), 2):
            own[k] = 10**5 + 100 * i + k
        rows.append((10**6, i, 200, 200, False, np.array(sorted(own), dtype=np.uint64).tobytes(), i))
    followers = spark.createDataFrame(rows, "lead long, cls long, n long, nl long, linked boolean, delta binary, component long")
    links = {(r.a, r.b) for r in ngram_join._derived_links(followers, 80).collect()}
    sets = {r[1]: set(np.frombuffer(r[5], np.uint64).tolist()) for r in rows[1:]}
    assert all(len(sets[a] ^ sets[b]) <= ngram_join.slack(200, 200, 80) for a, b in links)
    got = {r.id: r.component for r in components(spark.createDataFrame(sorted(links), "a long, b long")).collect()}
    assert got == {i: i % 2 for i in range(1200)}
    assert len(links) < 120000  # of 359,400


def test_ngram_join_with_repeated_ids(spark):
    text = lambda k: " ".join(f"t{k}x{j}" for j in range(30))
    rows = [(i, text(2 * i + j)) for i in range(40) for j in (0, 1)] + [(100 + k, text(k) + " more") for k in range(80)] + [(5, text(10)), (7, ""), (300, "")]
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.link(spark.createDataFrame(rows, "doc_id long, text string"), 3, 80).collect()}
    assert got == {(i, 28, i) for i in range(40)} | {(100 + k, 29, k // 2) for k in range(80)} | {(7, 0, 7), (300, 0, 300)}


def test_fingerprint_join_links_four_with_five(spark):
    rows = [(10 * k + n, " ".join(f"the v{k}x{j} w{k}x{j}" for j in range(n))) for k in range(5) for n in (3, 4, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(r) for r in spotsigs.link(df, 80).collect()} == {(i, i % 10, i - (i % 10 == 5)) for i, _ in rows}


def test_ngram_join_on_odd_tables(spark, odd_docs, docs):
    got = ngram_join.link(odd_docs).collect()
    assert len(got) == odd_docs.count() and [r.component_id for r in got if r.doc_id is None] == [None]
    assert ngram_join.link(docs.where("false")).collect() == []


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 30)] + [(100, k) for k in range(50, 60)] + [(7, 7), (None, 3), (200, 201), (201, 200)], "a long, b long")
    got = {r.id: r.component for r in components(edges).collect()}
    assert got == {i: 1 for i in range(1, 31)} | {i: 50 for i in [*range(50, 60), 100]} | {200: 200, 201: 200}


def test_components_of_few_links_take_few_tasks_and_equal_the_rounds(spark, monkeypatch):
    rnd = random.Random(3)
    path = rnd.sample(range(2000, 2200), 200)
    links = [(rnd.randrange(900), rnd.randrange(900)) for _ in range(500)] + list(zip(path, path[1:])) + [(5000 - k, 6000) for k in range(100)] * 2
    edges = spark.createDataFrame(links, "a long, b long").coalesce(2)
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if a != b:
            x, y = sorted((top(a), top(b)))
            root[y] = x
    want = {x: top(x) for x in list(root)}
    assert {r.id: r.component for r in components(edges.where("false")).collect()} == {}
    sc, held = spark.sparkContext, {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "50"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        sc.setJobGroup("few links", "")
        got = [tuple(r) for r in components(edges).collect()]
        status = sc.statusTracker()
        tasks = sum(status.getStageInfo(s).numTasks for j in status.getJobIdsForGroup("few links") for s in status.getJobInfo(j).stageIds if status.getStageInfo(s))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(got) == len(want) and dict(got) == want
    assert 0 < tasks < 50  # rounds of shuffles: over 1,000
    monkeypatch.setattr(graph, "WHOLE", 0)
    assert {r.id: r.component for r in components(edges).collect()} == want


def test_pairs_left_count_each_list_by_the_column_that_leaves_fewest(spark):
    rnd = random.Random(4)
    rows = [(rnd.randrange(12), rnd.randrange(5), rnd.choice([-1, -2, rnd.randrange(10**12)])) for _ in range(700)]
    entries = spark.createDataFrame(rows, "token long, component long, leader long")

    def left(token, c):
        own = [r[c] for r in rows if r[0] == token]
        return sum(x != y for i, x in enumerate(own) for y in own[:i])

    for names, columns in ((["component", "leader"], (1, 2)), (["leader"], (2,))):
        assert ngram_join._pairs_left(entries, names) == (sum(min(left(t, c) for c in columns) for t in range(12)), 700)
    assert ngram_join._pairs_left(entries.where("false"), ["component"]) == (0, 0)


@pytest.mark.parametrize("few", [0, 1 << 20])
def test_wanted_sets_are_found_by_ids_and_by_marks_and_broadcasts_go(spark, monkeypatch, few):
    monkeypatch.setattr(ngram_join, "FEW", few)
    made = []
    monkeypatch.setattr(ngram_join, "share", lambda session, value: made.append(session.sparkContext.broadcast(value)) or made[-1])
    docs = spark.createDataFrame([(i, f"a{i} b{i} c{i} d") for i in range(-20, 300)] + [(None, "a1 b1 c1 d")], "doc_id long, text string")
    sets = partial(ngram_join.sets_of, width=1)
    index = ngram_join._index(docs, sets, 80).where("doc_id IS NOT NULL")
    classes = index.select("n", "s1", "s2", F.col("doc_id").alias("rep"), (F.col("doc_id") + 1000).alias("cls"))
    got = {r.cls: len(r.set) for r in ngram_join._sets_for(docs, spark.createDataFrame([(980, 1007), (1007, 1299)], "a long, b long"), classes, sets).collect()}
    assert got == {980: 32, 1007: 32, 1299: 32}
    assert len(made) == 2 and not any(b._jbroadcast.isValid() for b in made)


def test_shuffle_files_go_with_the_write(spark):
    from credal.operators.lineage import materialise

    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        found = disk.getAllFiles()
        return {n for n in (found.apply(i).getName() for i in range(found.length())) if n.startswith("shuffle_")}

    before = files()
    df = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    out = materialise(df, "test")
    for _ in range(100):  # they are deleted in the background
        if files() <= before:
            break
        time.sleep(0.1)
    assert files() <= before and {(r.k, r["count"]) for r in out.collect()} == {(k, 142 + (k < 6)) for k in range(7)}


def test_packing(spark, odd_docs):
    rows = packing.pack(packing.token_pieces(odd_docs, tok("word_bpe_49k.json"), window=64, keep_ids=True), 64).collect()
    want = sorted(zlib.crc32(np.array(reference("word_bpe_49k.json", t or "") + [1], dtype="<u4").tobytes()) for t in [*ODD, None, "no id here", "a", "other text"])
    by_doc, sequences = {}, {}
    for r in rows:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    whole = {}
    for r in sorted(rows, key=lambda r: r.start):
        if r.doc_id not in (3, None):
            whole[r.doc_id] = whole.get(r.doc_id, b"") + r.ids
    assert all(zlib.crc32(v) in want for v in whole.values()) and len(whole) == len(ODD)
    assert sum(r.length for r in rows) == sum(len(reference("word_bpe_49k.json", t or "")) + 1 for t in [*ODD, None, "no id here", "a", "other text"])
    assert packing.pack(packing.token_pieces(odd_docs.where("false"), tok("word_bpe_49k.json"))).collect() == []


def test_plan_is_best_fit_decreasing():
    rnd = random.Random(2)
    for case in range(60):
        window = rnd.choice([8, 50, 64, 333])
        lengths = [min(window, rnd.choice([rnd.randint(1, window), rnd.randint(1, max(1, window // 5)), window // 3 or 1])) for _ in range(rnd.randint(0, 400))]
        free = []
        for x in sorted(lengths, reverse=True):  # one by one
            fits = [k for k, f in enumerate(free) if f >= x]
            if fits:
                free[min(fits, key=lambda k: free[k])] -= x
            else:
                free.append(window - x)
        steps = packing.plan({x: lengths.count(x) for x in set(lengths)}, window)
        sequences, ranks = {}, {}
        for length, rank, n, first, offset in steps:
            ranks.setdefault(length, []).extend(range(rank, rank + n))
            for k in range(n):
                sequences.setdefault(first + k, []).append((offset, length))
        assert {x: sorted(r) for x, r in ranks.items()} == {x: list(range(lengths.count(x))) for x in set(lengths)}
        fills = []
        for parts in sequences.values():
            parts.sort()
            assert all(a + x == b for (a, x), (b, _) in zip(parts, parts[1:])) and parts[0][0] == 0
            fills.append(sum(x for _, x in parts))
        assert sorted(fills) == sorted(window - f for f in free)


def test_packing_leaves_little_padding(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    fills = [r.n for r in packing.pack(packing.token_pieces(docs, tok("word_bpe_49k.json"))).groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()]
    assert packing.padding([2048, 1024, 1, 2047, 3]) == 1 + 2045
    assert packing.padding(fills) < 0.005 * sum(fills) and len(fills) <= -(-sum(fills) // 2048) + 2


def test_quality_on_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    marks = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = [r for r in queries.op5_quality_qda(spark, d).collect() if r.held_out and r.doc_id in marks]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert np.mean([r.predicted == marks[r.doc_id] for r in rows]) > 0.97


def test_quality_is_a_direct_density_s(spark):
    """Scores from NumPy's own covariances and determinants of the statistics; shrinkage by a plain loop over folds."""
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{d}/labels.parquet")
    marks = {r.doc_id: r.quality for r in labels.collect()}
    rows = docs.withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(quality.FOLDS))).collect()
    x = np.concatenate([quality.statistics(buf, off) for _, _, buf, off in slices(pa.array([r.text for r in rows]))])
    known = np.array([r.doc_id in marks for r in rows])
    y, fold = np.array([marks.get(r.doc_id, -1) for r in rows]), np.array([r.fold for r in rows])

    def direct(train, at, shrinkage):
        own = [train & (y == c) for c in (0, 1)]
        cov = [np.cov(x[o].T, bias=True) for o in own]
        pooled = sum(o.sum() * c for o, c in zip(own, cov)) / train.sum()
        logs = []
        for o, c in zip(own, cov):
            m = (1 - shrinkage) * c + shrinkage * (pooled + np.diag(np.diag(pooled))) / 2 + 1e-4 * np.eye(len(c))
            z = x[at] - x[o].mean(axis=0)
            logs.append(np.log(o.sum() / train.sum()) - 0.5 * np.einsum("ij,jk,ik->i", z, np.linalg.inv(m), z) - 0.5 * np.linalg.slogdet(m)[1])
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))

    loss = {}
    for s in quality.GRID:
        p = np.concatenate([np.where(y[at] == 1, q, 1 - q) for f in range(quality.FOLDS) for at in [known & (fold == f)] for q in [np.clip(direct(known & (fold != f), at, s), 1e-12, 1 - 1e-12)]])
        loss[s] = -np.log(p).sum()
    model = quality.fit(docs, labels)
    got = {r.doc_id: r.score for r in quality.score(docs.withColumn("score", F.lit("clash")), model).collect()}
    want = direct(known, np.ones(len(rows), bool), max(s for s in loss if loss[s] <= min(loss.values()) + quality.TIE * known.sum()))
    assert np.allclose([got[r.doc_id] for r in rows], want, atol=1e-6)


def test_quality_edges(spark, odd_docs):
    labels = spark.createDataFrame([(0, 1), (1, None), (None, 1), (2, 5)], "doc_id long, quality int")
    model = quality.fit(odd_docs, labels)
    assert model.counts == (0, 1) and {r.score for r in quality.score(odd_docs, model).collect()} == {1.0}
    assert quality.score(odd_docs, quality.fit(odd_docs, labels.where("false"))).agg(F.max("score")).first()[0] == 0.5
    assert quality.score(odd_docs.where("false"), model).collect() == []


def test_mixing(spark):
    rnd = random.Random(1)
    rows = [(i, "w " * rnd.randint(1, 40), "en", ["big", "big", "big", "big", "small", None][i % 6], 0) for i in range(1200)] + [(5000, None, "en", "empty", 0)]
    df = spark.createDataFrame(rows, DOCS)
    tokens = {}
    for r in rows:
        tokens[r[3]] = tokens.get(r[3], 0) + len((r[1] or "").split())
    for budget, epochs in ((None, 2.0), (6000, 8.0)):
        plan = mixing.choose(tokens, budget, 1.0, epochs)
        out = mixing.mix(df, budget=budget, max_epochs=epochs, block_tokens=500).collect()
        for s, quota in plan.quota.items():
            own = [r for r in out if r.source == s]
            assert s == "empty" or abs(sum(r.mix_tokens for r in own) - quota) <= 40
        assert len({(r.doc_id, r.mix_epoch) for r in out}) == len(out) and all(0 <= r.slot < 1 for r in out)
        assert budget or len({r.doc_id for r in out}) == len(rows)
    assert mixing.mix(df.where("false")).collect() == []


def test_mixing_is_a_brute_force_version_s(spark):
    """Weights, kept occurrences and slots by plain loops over the documents, from the operator's blocks and hashes alone."""
    rnd = random.Random(6)
    rows = [(i, "w " * rnd.randint(1, 60), "en", rnd.choice(["a", "a", "a", "b", "b", "c"]), 7, "x", 1) for i in range(900)]
    df = spark.createDataFrame(rows, DOCS + ", s string, slot int")
    tokens = {s: sum(len(r[1].split()) for r in rows if r[3] == s) for s in "abc"}
    for budget in (None, 9_000, 40_000):
        plan = mixing.choose(tokens, budget, 0.95, 4.0)
        assert abs(mixing.entropy(plan.weights) - 0.95 * np.log(3)) < 1e-6 or not plan.met or max(plan.epochs.values()) > 4 - 1e-6 or budget
        frame = mixing.mix(df, budget=budget, target_entropy=0.95, max_epochs=4.0, block_tokens=700)
        assert frame.columns == ["doc_id", "text", "lang", "source", "n_chars", "s", *mixing.ADDED]
        out = frame.withColumn("h", F.xxhash64(F.lit(11), "source", "mix_epoch", "doc_id")).withColumn("bh", F.xxhash64(F.lit(12), "source", "mix_epoch", "mix_block")).collect()
        for s, quota in plan.quota.items():
            own = sorted([r for r in out if r.source == s], key=lambda r: (r.mix_epoch, r.bh, r.mix_block, r.h, r.doc_id))
            at, total = 0, tokens[s]
            for r in own:  # a pass is whole but the last one, which ends with the document that fills the quota
                assert at < quota + 0.5 and abs(r.slot - at / max(quota, 1)) < 1500 / max(quota, 1) and abs(r.mix_weight - plan.weights[s]) < 1e-12
                at += r.mix_tokens
            assert quota - 1 <= at <= quota + 60 and [r.slot for r in own] == sorted(r.slot for r in own)
            for e in range(int(quota // total)):
                assert sum(r.mix_tokens for r in own if r.mix_epoch == e) == total
        stream, whole = sorted(out, key=lambda r: r.slot), sum(r.mix_tokens for r in out)
        for k in range(4):  # quarters of the stream hold the sources at their weights
            part = [r for r in stream if k / 4 <= r.slot < (k + 1) / 4]
            for s, w in plan.weights.items():
                assert abs(sum(r.mix_tokens for r in part if r.source == s) / sum(r.mix_tokens for r in part) - w) < 0.08 + 1200 / whole


def test_mixing_meets_targets_below_the_natural_entropy():
    tokens = {f"s{k}": 1000 + 40 * k for k in range(20)}
    share = lambda plan: mixing.entropy(plan.weights) / np.log(20)
    assert share(mixing.choose(tokens)) > 0.99
    plan = mixing.choose(tokens, None, 0.97, 20.0)
    assert plan.met and plan.alpha > 1 and abs(share(plan) - 0.97) < 1e-6 and min(plan.epochs.values()) > 1 - 1e-9
    with pytest.warns(UserWarning, match="above the target"):
        plan = mixing.choose(tokens, None, 0.5, 4.0)
    assert not plan.met and abs(max(plan.epochs.values()) - 4) < 1e-6 and share(plan) < 0.99
    with pytest.warns(UserWarning, match="above the target"):
        assert mixing.choose({"a": 5, "b": 5}, None, 0.9, 4.0).alpha == 1.0


def test_fingerprints_of_edited_texts(spark, docs, odd_docs):
    rows = sorted([(r.doc_id, r.text or "") for r in docs.collect()], reverse=True)
    got = {r.doc_id: r for r in neighbours.edited_fingerprints(docs.withColumn("component", F.lit("clash")), percent=80).collect()}
    assert len(got) == len(rows) and {i: r.component_id for i, r in got.items()} == {r.doc_id: r.component_id for r in spotsigs.link(docs, 80).collect()}
    prints = dict(zip([i for i, _ in rows], spotsigs.fingerprint_texts(pa.array([t for _, t in rows]))))
    for (i, t), (j, u) in zip(rows, rows[1:] + rows[:1]):
        k = len(t) // 3
        edited, r = t[: len(t) - k] + u[:k], got[i]
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and r.n_chars == len(t)
        a, b = set(prints[i].tolist()), set(prints[j].tolist())
        assert abs(r.near_next - (len(a & b) / len(a | b) if a | b else 1.0)) < 1e-12 and set(spotsigs.values_of(r.fingerprint).tolist()) == a
    odd = neighbours.edited_fingerprints(odd_docs, percent=80).collect()
    assert len(odd) == odd_docs.count() and [r.component_id for r in odd if r.doc_id is None] == [None] and all(r.component_id is not None for r in odd if r.doc_id is not None)
    assert "component_id" not in neighbours.edited_fingerprints(odd_docs).columns
    assert neighbours.edited_fingerprints(docs.limit(1)).count() == 1 and neighbours.edited_fingerprints(docs.where("false")).collect() == []


@pytest.mark.parametrize("percent", [80, 60])
def test_fingerprint_join_is_exact(spark, percent):
    rnd = random.Random(8)
    vocabulary = [f"w{k}" for k in range(300)] + spotsigs.ANCHORS.split()
    base = [rnd.choice(vocabulary) for _ in range(240)]
    rows = [(10 + i, " ".join([w if rnd.random() > r else rnd.choice(vocabulary) for w in base][: 240 - 9 * (i % 11)])) for i, r in enumerate([0.0, 0.02, 0.05, 0.2] * 25)]
    rows += [(1, None), (2, ""), (3, "the end now"), (4, "THE end, now"), (5, " \n"), (6, "bare"), (7, "bare")] + [(500 + k, " ".join(rnd.choice(vocabulary[:6] + ["the"] * 4) for _ in range(rnd.randint(2, 30)))) for k in range(120)]
    sets = {i: set(v.tolist()) for (i, _), v in zip(rows, spotsigs.fingerprint_texts(pa.array([t for _, t in rows])))}
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("clash")).withColumn("rep", F.lit(0))
    want = _linked(sets, percent)
    assert {tuple(r) for r in spotsigs.link(df, percent).collect()} == want and len({c for _, _, c in want}) < len(want) - 40


def test_fingerprint_join_on_odd_tables(spark, odd_docs, docs):
    got = spotsigs.link(odd_docs).collect()
    assert len(got) == odd_docs.count() and [r.component_id for r in got if r.doc_id is None] == [None]
    assert spotsigs.link(docs.where("false")).collect() == []


def test_length_partitions_hold_all_that_can_link():
    for percent in (50, 60, 80, 90, 100):
        part = ngram_join.length_partition(np.arange(1, 400), percent)
        for a in range(1, 400):
            most = min(399, 100 * a // percent)
            assert part[most - 1] - part[a - 1] in (0, 1)


def test_line_dedup(spark, odd_docs):
    passage = " ".join(f"passage{chr(97 + k % 26)}x{'y' * k}" for k in range(60))
    own = lambda i: " ".join(f"{chr(97 + i)}own{'q' * k}" for k in range(12))
    template = lambda name, n: f"Posted by {name} in the forum on day {n} of the old calendar"
    rows = [(i, f"{own(i)}\nThe end.\n{template('name' + chr(97 + i), i)}\n{passage if i in (2, 7) else own(i + 12)}", "en", "s", 9) for i in range(10)]
    out = {r.doc_id: r for r in line_dedup.dedup(spark.createDataFrame(rows, DOCS), depth=2).collect()}
    assert out[0].dropped_lines == [] and out[0].first_lines == [1, 2] and out[2].first_lines == [3] and out[0].text == rows[0][1] and out[0].n_chars == 9
    everywhere = {r.doc_id: r.dropped_lines for r in line_dedup.dedup(spark.createDataFrame(rows, DOCS), depth=2, keep_first=False).collect()}
    assert everywhere == {i: [1, 2, 3] if i in (2, 7) else [1, 2] for i in range(10)}
    for i in range(1, 10):
        assert out[i].dropped_lines == ([1, 2, 3] if i == 7 else [1, 2]) and own(i) in out[i].text and out[i].n_chars == len(out[i].text)
    odd = {(r.doc_id, r.text) for r in line_dedup.dedup(odd_docs).collect()}
    assert odd == {(r.doc_id, r.text) for r in odd_docs.collect()}
    assert line_dedup.dedup(odd_docs.where("false")).collect() == []


def test_short_lines_that_recur_are_dropped(spark):
    own = lambda i: f"{chr(97 + i)}own {chr(97 + i)}line"
    rows = [(i, f"{own(i)}\nall rights reserved.\nPage {i} of 12\n{i} {i + 1}\nMenu\n{'Seldom seen' if i < 6 else own(i)}\n77", "en", "s", 9) for i in range(13)]
    out = {r.doc_id: r for r in line_dedup.dedup(spark.createDataFrame(rows, DOCS)).collect()}
    assert out[0].dropped_lines == [] and out[0].text == rows[0][1]
    assert all(out[i].dropped_lines == [1, 2, 4, 6] for i in range(1, 13))  # neither lines of other numbers nor ten words repeated
    rows = [(i, f"{own(i)}\nIn five documents\n{'In four documents' if i < 4 else own(i)}", "en", "s", 9) for i in range(5)]
    out = {r.doc_id: r.dropped_lines for r in line_dedup.dedup(spark.createDataFrame(rows, DOCS)).collect()}
    assert out == {0: []} | {i: [1] for i in range(1, 5)}


@pytest.mark.parametrize("keep_first", [True, False])
def test_line_dedup_is_a_plain_tree_s(spark, monkeypatch, keep_first):
    """Trees, parts and drops by plain loops over words; hashes alone are the operator's."""
    rnd = random.Random(9)
    fixed = [[rnd.choice(["posted", "by", "in", "the", "menu", "home"]) for _ in range(rnd.choice([1, 2, 3, 6, 9]))] for _ in range(14)]
    made = lambda: " ".join(w if rnd.random() > 0.12 else rnd.choice(["x", "yy", "7", "n12", "zed"]) for w in rnd.choice(fixed))
    rows = [(i // 2 if i < 6 else i, "\n".join(made() if rnd.random() < 0.9 else "" for _ in range(rnd.randint(0, 9)))) for i in range(120)]
    monkeypatch.setattr(line_dedup, "_run_drops", lambda by_doc, *_: by_doc.select("uid", F.col("at.number").alias("numbers")).where("false"))
    df = spark.createDataFrame([(i, t, "_", 1) for i, t in rows], "doc_id long, text string, uid string, cut int")
    out = line_dedup.dedup(df, depth=2, similarity=0.6, keep_first=keep_first)
    assert out.columns == ["doc_id", "text", "uid", "cut", *line_dedup.ADDED]
    every = []  # document, line number, leaf, line, words
    for d, (i, text) in enumerate(rows):
        buf = np.frombuffer(text.encode(), np.uint8)
        _, number, leaf, line, _, _, _ = line_dedup.parse_lines(buf, np.array([0, len(buf)]), 2)
        for n, f, h in zip(number.tolist(), leaf.tolist(), line.view(np.int64).tolist()):
            w = text.split("\n")[n].split()
            masked = [None if any(c.isdigit() for c in x) else x for x in w]
            every.append((d, n, f, h, w if len(w) <= line_dedup.FIELDS and not any(masked) else masked))
    docs_of = lambda key: len({(rows[x[0]]) for x in every if key(x)})
    WILD = object()

    def placed(items):
        found, where = [], {}
        for name, docs, w in items:
            share = [sum(a is WILD or b is WILD or a == b for a, b in zip(t[1], w)) / len(w) for t in found]
            best = max(range(len(found)), key=lambda k: (share[k], -k), default=None)
            if best is not None and share[best] >= 0.6:
                found[best][1][:] = [a if a is not WILD and b is not WILD and a == b else WILD for a, b in zip(found[best][1], w)]
                found[best][2] += docs
                where[name] = found[best][0]
            else:
                found.append([name, list(w), docs])
                where[name] = name
        return found, where

    template = {}
    for f in {x[2] for x in every}:
        lines = {x[3]: x[4] for x in every if x[2] == f}
        docs = {h: docs_of(lambda x: x[2] == f and x[3] == h) for h in lines}
        parts, first = [], {}
        for k in range(line_dedup.PARTS):
            found, where = placed([(h, docs[h], lines[h]) for h in sorted(lines, key=lambda h: (-docs[h], h)) if h % line_dedup.PARTS == k])
            parts, first = parts + found, first | where
        _, second = placed([(t, d, w) for t, w, d in sorted(parts, key=lambda t: (-t[2], t[0]))])
        template |= {(f, h): (f, second[first[h]]) for h in lines}
    want = {d: [] for d in range(len(rows))}
    for t in set(template.values()):
        have = sorted({rows[x[0]] for x in every if template[x[2], x[3]] == t}, key=lambda r: r[0])
        words = len(next(x[4] for x in every if template[x[2], x[3]] == t))
        if (len(have) - 1) * words >= 12:
            for x in every:
                if template[x[2], x[3]] == t and not (keep_first and rows[x[0]][0] == have[0][0] and rows[x[0]] in _firsts(have, spark)):
                    want[x[0]].append(x[1])
    got = sorted((r.doc_id, r.text, r.dropped_lines) for r in out.collect())
    assert got == sorted((i, "\n".join(x for n, x in enumerate(t.split("\n")) if n not in want[d]), sorted(want[d])) for d, (i, t) in enumerate(rows))
    assert sum(map(len, want.values())) > 100


def _firsts(rows, spark):
    """Of rows with the smallest id, the one whose hash is smallest."""
    least = [r for r in set(rows) if r[0] == min(x[0] for x in rows)]
    if len(least) == 1:
        return least
    df = spark.createDataFrame(least, "doc_id long, text string").withColumn("h", F.xxhash64("doc_id", "text"))
    return [min(df.collect(), key=lambda r: r.h)[:2]]


def test_shared_runs_against_brute_force():
    rnd = random.Random(12)
    for _ in range(300):
        places = sorted(rnd.sample(range(40), 30))
        one, other = ([(p, rnd.randint(0, 2), 0) for p in rnd.sample(places, 24)] for _ in range(2))
        one, other = ([(p, k, k + 2) for p, k, _ in sorted(x)] for x in (one, other))
        unbroken = lambda x: all(a[0] + 1 == b[0] for a, b in zip(x, x[1:]))
        have = {tuple(k for _, k, _ in one[a:b]) for a in range(24) for b in range(a + 1, 25) if unbroken(one[a:b])}
        want = {p for a in range(24) for b in range(a + 1, 25) if unbroken(other[a:b]) and sum(w for _, _, w in other[a:b]) >= 12 and tuple(k for _, k, _ in other[a:b]) in have for p, _, _ in other[a:b]}
        assert line_dedup.shared_runs(one, other, 12) == want


def test_runs_of_lines_that_two_documents_share_are_dropped(spark):
    word = lambda k: "".join(chr(97 + int(c)) for c in str(k))
    line = lambda k, n: " ".join(f"w{word(k)}x{word(j)}" for j in range(n))
    passage = [line(1, 8), "", line(2, 2), line(3, 5), line(4, 6)]
    rows = {
        5: [line(50, 8), *passage, line(51, 8), line(5, 7), line(6, 8), line(52, 9)],
        3: [*passage, line(30, 8), line(31, 9), line(5, 7), line(32, 9), line(6, 8)],  # 5 and 6 are apart here
        8: [line(2, 2), line(80, 7), line(7, 6), line(8, 5)],
        9: [line(7, 6), line(8, 5), line(90, 7), line(2, 2)],  # 11 words together
        10: [line(2, 2), line(100, 8)],
    }
    df = spark.createDataFrame([(i, "\n".join(x), "en", "s", 1) for i, x in rows.items()], DOCS)
    assert {r.doc_id: r.dropped_lines for r in line_dedup.dedup(df).collect()} == {3: [], 5: [1, 3, 4, 5], 8: [], 9: [], 10: []}


def test_line_dedup_leaves_one_of_each_copy(spark):
    text = "\n".join(" ".join(f"{chr(97 + k)}{j}word"[::-1] + "z" * j for j in range(9)) for k in range(4)).replace("1", "one").translate(str.maketrans("023456789", "abcdefghi"))
    out = {r.doc_id: r.text for r in line_dedup.dedup(spark.createDataFrame([(i, text, "en", "s", 1) for i in (4, 2, 9)], DOCS)).collect()}
    assert out == {2: text, 4: "", 9: ""}


def test_token_files(spark, odd_docs, tmp_path):
    path = str(tmp_path / "out")
    written = token_io.write(odd_docs, path, tok("byte_bpe_50k.json"), 50257).collect()
    got = token_io.read(spark, path, written).collect()
    rows = sorted([(r.doc_id if r.doc_id is not None else -1, r.text or "") for r in odd_docs.collect()])
    at = 0
    for (i, t), r in zip(rows, sorted(got, key=lambda r: r.start)):
        ids = np.array(reference("byte_bpe_50k.json", t) + [0], dtype="<u4").tobytes()
        assert (r.doc_id if r.doc_id is not None else -1, r.start, r.n_tokens, r.ids, r.ids_crc32) == (i, at, len(ids) // 4, ids, zlib.crc32(ids))
        at += r.n_tokens
    assert [r.doc_id for r in token_io.read(spark, path, written, doc_ids=[4]).collect()] == [4]
    empty = token_io.write(odd_docs.where("false"), str(tmp_path / "none"), tok("byte_bpe_50k.json"), 50257).collect()
    assert empty == [] and token_io.read(spark, str(tmp_path / "none"), empty).collect() == []


def test_reader_decompresses_only_what_it_needs_and_checks_it(monkeypatch):
    monkeypatch.setattr(token_io, "PAGE", 8)
    data = token_io.to_bytes([(k, [k % 250] * 60_000) for k in range(30)])
    reader = token_io.Reader(pa.BufferReader(data))
    assert reader.find(17)[0].tolist() == [17] * 60_000 and reader.frames_read <= 2 and reader.pages_read == 1 and reader.find(99) == []
    broken = bytearray(data)
    broken[reader.entries[0][0] // 2] ^= 1
    with pytest.raises(Exception):
        token_io.Reader(pa.BufferReader(bytes(broken))).ids(0, 1)
    with pytest.raises(ValueError, match="does not fit"):
        token_io.to_bytes([(1, [1, 70_000])], 2)


def test_files_are_of_the_public_seekable_format():
    """Read by the format's own rules: a 9-byte footer, entries of 12 bytes, frames that follow one another from the start."""
    import struct

    import xxhash
    import zstandard

    ids = [k % 60_000 for k in range(700_000)]
    data = token_io.to_bytes([(1, ids[:5]), (2, ids[5:])], 2)
    n, descriptor, magic = struct.unpack("<IBI", data[-9:])
    table = 8 + 12 * n + 9
    assert magic == 0x8F92EAB1 and descriptor == 128 and struct.unpack("<II", data[-table : 8 - table]) == (0x184D2A5E, table - 8)
    at, content = 0, b""
    for k in range(n):
        packed, size, check = struct.unpack("<III", data[12 * k - table + 8 :][:12])
        own = zstandard.ZstdDecompressor().decompress(data[at : at + packed], max_output_size=size) if size else b""
        assert len(own) == size and xxhash.xxh64_intdigest(own) & 0xFFFFFFFF == check
        at, content = at + packed, content + own
    assert at == len(data) - table and np.frombuffer(content, "<u2").tolist() == ids
    stream = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True)
    assert stream.read() == content


def test_edited_counts(spark):
    rnd = random.Random(4)
    pool = ODD[:10] + ["some words here, " * 200, "x\n\n y  z " * 300]
    rows = [(i, rnd.choice(pool), [(rnd.randint(-5, 4000), rnd.choice([0, 1, 7, 90, 10**6]), rnd.choice(["", " ", "ab", "new words ", "\n", "x y", "q" * 900])) for _ in range(rnd.randint(0, 5))]) for i in range(150)]
    rows += [(500, None, None), (None, "a b", [(0, 1, None), (None, None, "z")])]
    df = spark.createDataFrame(rows, "doc_id long, text string, edits array<struct<position: long, delete: long, insert: string>>")
    got = {r.doc_id: r for r in token_counts.count_edited(df, tok("byte_bpe_50k.json")).collect()}
    for i, text, edits in rows:
        now = text or ""
        for position, delete, insert in edits or []:
            at = min(max(0, position or 0), len(now))
            now = now[:at] + (insert or "") + now[at + max(0, delete or 0) :]
        r = got[i]
        assert r.edited_text == now and r.edited_chars == len(now)
        assert r.n_tokens == len(reference("byte_bpe_50k.json", text or "")) and r.edited_tokens == len(reference("byte_bpe_50k.json", now))


def test_edits_encode_their_surroundings_alone(spark):
    text = "some words\xa0and\u3000others,\u2028 12 <|endoftext|>\n" * 3000
    df = spark.createDataFrame([(1, text, [(len(text) // 2, 9, "new\xa0 words"), (5, 0, "\u2003"), (len(text), 0, " end<|endoftext|>")])], "doc_id long, text string, edits array<struct<position: long, delete: long, insert: string>>")
    r = token_counts.count_edited(df, tok("byte_bpe_50k.json")).first()
    now = r.edited_text
    assert r.encoded_chars < 3000 and r.edited_tokens == len(reference("byte_bpe_50k.json", now)) and token_counts.count_edited(df.where("false"), tok("byte_bpe_50k.json")).collect() == []


def test_stages_on_awkward_tables(spark, odd_docs):
    """Nulls, empty and long texts, repeated rows, clashing columns, empty tables: each stage keeps the columns and what its docstring says."""
    import corpus_pipeline as c

    clash = {k: F.lit(7) for k in ("row", "score", "slot", "uid", "s", "id", "other", "cut", "mix_tokens", "dropped_lines", "x", "hash", "n")}
    docs = odd_docs.union(odd_docs.where("doc_id IN (4, 10)")).withColumns(clash)
    key = lambda df: sorted(map(repr, df.select("doc_id", "text", "score", "row").collect()))
    for name, stage in c.STAGES[:4]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        rows = key(out)
        if name.startswith("n-gram"):
            assert len(rows) == docs.count() - 2 - 2 and sum(r.doc_id == 3 for r in out.collect()) == 1
        elif name.startswith("line"):
            assert len(rows) == docs.count()
        else:
            assert set(rows) <= set(key(docs)) and len(rows) >= (docs.count() if name.startswith("mixing") else 0)
        empty = stage(spark, docs.where("false"), SF)
        assert empty.columns == docs.columns and empty.collect() == []
    packed = c.packing_stage(spark, docs, SF).collect()
    assert len([r for r in packed if r.start == 0]) == docs.count() and c.packing_stage(spark, docs.where("false"), SF).collect() == []


def test_pipeline(spark):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    after = docs
    for k, (_, stage) in enumerate(c.STAGES):
        out = stage(spark, after, SF).cache()
        if k < 4:
            assert out.columns == docs.columns
        if k == 1:
            assert out.count() == after.count()
        if k == 2:
            gone = _brute([(r.doc_id, r.text) for r in after.collect()], 5, 80)
            assert {r.doc_id for r in out.collect()} == {i for i, _, comp in gone if i == comp}
        if k == 3:
            assert {r.doc_id for r in out.collect()} == {r.doc_id for r in after.collect()}
        after = out
    assert after.where("offset + length > 2048").count() == 0
