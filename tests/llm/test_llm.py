import hashlib
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparklex.llm import bytewords, components, decontamination, fmindex, lines, neardup, packing, quality, queries, scoring, scratch, sharding, substrings, tokenfiles, warc, wordids
from sparklex.llm.queries import tokenizer_path

LONG = " ".join(f"w{i % 97}x{i % 89}" for i in range(3000))
COPY = " ".join(f"c{i}" for i in range(70))
TEXTS = [COPY, "a b c", None, "", COPY, "\n \t", LONG, "x " + COPY + " y", "É é\nA b C", COPY.upper()]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, f"s{i % 2}", None, i) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_words string, component_id long, bucket long").repartition(2)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def rows(df):
    return df.toPandas().set_index("doc_id")


def split(t):
    return (t or "").encode().split()


def test_words():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["a bb", None, "bb", ""])], ["text"])
    (c,) = bytewords.chunks(iter([batch]))
    w = bytewords.words(c)
    assert w.first.tolist() == [0, 2, 2, 3, 3] and w.hash[1] == w.hash[2] != w.hash[0]


@pytest.mark.parametrize("small", [1024, 2])
def test_neardup(spark, docs, empty, small, monkeypatch):
    monkeypatch.setattr(neardup, "SMALL", small)
    got = rows(neardup.near_duplicates(docs, 3, 0.85))
    # 0, 4 and 9 are equal in small letters; 7 has two words more
    assert got.loc[[0, 4, 7, 9], "component_id"].tolist() == [0] * 4
    assert got.loc[[1, 2, 3, 5, 6, 8], "kept"].all() and len(got) == len(TEXTS)
    assert got.loc[1, "n_shingles"] == 1 and got.loc[2, "n_shingles"] == 0
    assert neardup.near_duplicates(empty).count() == 0
    kept = neardup.deduplicated(docs)
    assert kept.columns == docs.columns and kept.count() == len(TEXTS) - 3


def template_group(families=60, words=300, own=6, seed=1):
    """Pairs of copies of one template that are just similar enough to each other, and hardly not to those of other pairs."""
    rng = np.random.default_rng(seed)
    template = [f"t{i}" for i in range(words)]
    texts = []
    for f in range(families):
        place = rng.permutation(words // 3)[: 2 * own + 1] * 3
        for j in range(2):
            text = list(template)
            for p in (place[0], *place[1 + j * own : 1 + (j + 1) * own][: own - j * 2]):
                text[p] = f"e{f}" if p == place[0] else f"e{f}x{j}x{p}"
            texts.append(" ".join(text))
    return texts


def brute_components(texts, k, similarity):
    sets = [{tuple(w[i : i + k]) for i in range(len(w) - k + 1)} for w in map(str.split, texts)]
    name = list(range(len(sets)))
    for i, x in enumerate(sets):
        for j in range(i):
            both = len(x & sets[j])
            if name[i] != name[j] and both >= similarity * (len(x) + len(sets[j]) - both):
                lo, hi = sorted((name[i], name[j]))
                name = [lo if n == hi else n for n in name]
    return name


def test_neardup_large_buckets(spark, monkeypatch):
    """In buckets over SMALL, whose hubs link few members, all links are found, too, however few bands a pair shares."""
    monkeypatch.setattr(neardup, "SMALL", 8)
    monkeypatch.setattr(neardup, "banding", lambda similarity: (1, 4))
    texts = template_group()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    want = brute_components(texts, 3, 0.85)
    assert 30 < len(set(want)) < len(want)
    assert rows(neardup.near_duplicates(df, 3, 0.85)).sort_index()["component_id"].tolist() == want


def test_components(spark):
    links = spark.createDataFrame([(5, 4), (4, 3), (3, 9), (8, 7), (2, 2)], "a long, b long")
    assert {r[0]: r[1] for r in components.components(links).collect()} == {5: 3, 4: 3, 3: 3, 9: 3, 8: 7, 7: 7}


def test_components_plans_stay_small(spark, monkeypatch):
    """Each step is planned by itself: a plan that holds several steps took too much of the driver's memory."""
    shuffles = []

    def written(df, *args, **kwargs):
        shuffles.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange"))
        return scratch.written(df, *args, **kwargs)

    monkeypatch.setattr(components, "written", written)
    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (None, 3)], "a long, b long")
    found = components.components(links)
    assert {r[0]: r[1] for r in found.collect()} == {k: 0 for k in range(41)} | {100: 100, 101: 100}
    assert max(shuffles) <= 6
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("bucket", [2048, 0])
def test_substrings(docs, empty, bucket, monkeypatch):
    monkeypatch.setattr(substrings, "BUCKET", bucket)
    got = rows(substrings.removed(docs))
    first = {}
    for i, t in enumerate(TEXTS):
        w = split(t)
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), i)
    for i, t in enumerate(TEXTS):
        w = split(t)
        gone = {j for k in range(len(w) - 49) if first[tuple(w[k : k + 50])] < i for j in range(k, k + 50)}
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        assert (got.loc[i, "n_words"], got.loc[i, "n_removed"], got.loc[i, "kept_sha256"]) == (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    assert substrings.removed(empty).count() == 0


def test_arc_versions():
    for version in (1, 2):
        head = warc.arc_head(version, "f.arc", "20200102")
        assert warc.arc_version(head) == (version, len(head))
        line = warc._arc_line(version, "http://a/b c", "20200102030405", "text/html", 4)
        r, end = warc.parse_arc(line + b"abcd\n", version)
        assert (r.url, r.date, r.content, end) == ("http://a/b c", "20200102030405", b"abcd", len(line) + 4)
        with pytest.raises(ValueError):
            warc.parse_arc(line + b"abc", version)
    assert warc.warc_date("20200102") == "2020-01-02T00:00:00Z"


@pytest.mark.parametrize("version", [1, 2])
def test_warc(spark, version):
    pages = spark.createDataFrame([(1, "http://a", "x"), (2, None, "x"), (3, "http://a b", None), (4, "u", "é"), (None, "u", "x")], "page_id long, url string, html string")
    got = warc.read_warc(warc.convert(warc.write_arc(pages, version))).toPandas()
    by = {None if pd.isna(r.page_id) else int(r.page_id): r for r in got.itertuples()}
    assert by[2].record_type == "response" and by[1].record_type == by[None].record_type == "revisit"
    assert by[1].refers_to == 2 and by[3].payload_bytes == 0 and by[4].payload_digest == warc.digest("é".encode())
    assert warc.read_warc(warc.convert(warc.write_arc(pages.where("false")))).count() == 0


def test_lines(spark, empty):
    texts = ["a\nb\nc", "x\na\n\nb\ny", "a\nb", None, "", "\n", "q\nq\nq", "b"]
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, lines long")
    got = rows(lines.report(df))
    assert got["text"].tolist()[:3] == ["a\nb\nc", "x\ny", ""] and got.loc[3, "text"] is None
    assert got["n_removed"].tolist() == [0, 3, 2, 0, 0, 0, 2, 0]
    kept = lines.deduplicated(df)
    assert kept.columns == df.columns and kept.count() == len(texts) - 1
    assert lines.report(empty).count() == 0


def brute_runs(texts, min_run):
    """Lines that go, and lines of the longest later copy, of each text: by comparing all places."""
    kept = [[(k, x) for k, x in enumerate(t.split("\n")) if x.strip()] for t in texts]
    gone, longest = [set() for _ in texts], [0] * len(texts)
    for d, a in enumerate(kept):
        for i in range(len(a)):
            for e in range(d + 1):
                for j in range(len(kept[e]) if e < d else i):
                    n = 0
                    while i + n < len(a) and j + n < len(kept[e]) and a[i + n][1] == kept[e][j + n][1]:
                        n += 1
                    if n >= min_run:
                        gone[d].update(range(a[i][0], a[i + n - 1][0] + 1))
                        longest[d] = max(longest[d], n)
    return gone, longest


@pytest.mark.parametrize("min_run", [1, 2, 4])
def test_maximal_runs(spark, min_run):
    """Runs of any length, within texts and between them, go as a comparison of all places says."""
    rng = np.random.default_rng(min_run)
    texts = ["\n".join(rng.choice(["a", "b", "c", " ", "d d"], rng.integers(1, 12))) for _ in range(25)]
    texts += ["\n".join(f"l{i}" for i in range(13)), "\n".join(["x", *(f"l{i}" for i in range(2, 12)), "y"]), "\n".join(["z"] * 9)]
    got = rows(lines.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), min_run)).sort_index()
    gone, longest = brute_runs(texts, min_run)
    assert got["n_removed"].tolist() == [len(g) for g in gone]
    assert got["text"].tolist() == ["\n".join(x for k, x in enumerate(t.split("\n")) if k not in g) for t, g in zip(texts, gone)]
    # a run is as long as that with the first place of its lines, which others may go beyond
    assert all(min_run <= x <= y or x == y == 0 for x, y in zip(got["deepest"], longest)) and got["deepest"].tolist()[-2:] == [10, 8]


def test_long_lines(spark):
    """A passage of one line that documents share is a repeated run, too."""
    long, other = (" ".join(f"{c}{i}" for i in range(20)) for c in "pq")
    texts = [f"a\n{long}\nb", f"c\n \t{long}\nd", f"e\n{long}\n\nf", long, other, other, f"{long}\n{long} x", " ".join(other.split()[1:]), " ".join(other.split()[1:]), "s", "s"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = rows(lines.report(df, min_words=20))
    assert got["text"].tolist() == [texts[0], texts[1], "e\n\nf", "", other, "", f"{long} x", *texts[7:]]
    assert got["n_removed"].tolist() == [0, 0, 1, 1, 0, 1, 1, 0, 0, 0, 0] and got["deepest"].tolist() == got["n_removed"].tolist()
    assert sorted(r.doc_id for r in corpus_pipeline.line_dedup(spark, df, "").collect()) == [0, 1, 2, 4, 6, 7, 8, 9, 10]


def test_vbyte():
    x = np.array([0, 255, 256, 65535, 65536, 1 << 24, (1 << 32) - 1], np.uint32)
    for n in range(len(x) + 1):
        assert (tokenfiles.unpack(*tokenfiles.pack(x[:n]), n) == x[:n]).all()


def ids(text):
    from tokenizers import Tokenizer

    return np.array(Tokenizer.from_file(tokenizer_path()).encode(text or "", add_special_tokens=False).ids + [1], "<u4")


def test_token_files(docs, empty):
    got = rows(tokenfiles.read(tokenfiles.write(docs, tokenizer_path())))
    start = 0
    for i, t in enumerate(TEXTS):
        want = ids(t)
        assert (got.loc[i, "start"], got.loc[i, "n_tokens"], got.loc[i, "ids_crc32"]) == (start, len(want), zlib.crc32(want.tobytes()))
        start += len(want)
    assert tokenfiles.read(tokenfiles.write(empty, tokenizer_path())).count() == 0


def test_token_files_without_ids(spark):
    df = spark.createDataFrame([(3, "one two"), (None, "three"), (1, None), (2, "four, " * 3000)], "doc_id long, text string")
    manifest = tokenfiles.write(df, tokenizer_path())
    whole = tokenfiles.read(manifest)
    want = [tuple(r) for r in whole.drop("ids").orderBy("start").collect()]
    assert [r[0] for r in want] == [None, 1, 2, 3]
    assert [tuple(r) for r in tokenfiles.read(manifest, with_ids=False).orderBy("start").collect()] == want
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.n_tokens for r in whole.collect())


def test_packing(docs, empty):
    got = packing.pack(docs, tokenizer_path(), packing.Limits(256, 3, 200)).toPandas()
    for i, t in enumerate(TEXTS):
        mine = got[got.doc_id == i].sort_values("start")
        assert b"".join(mine.ids) == ids(t).tobytes() and (mine.start == mine.length.cumsum() - mine.length).all()
    for _, s in got.groupby("sequence_id"):
        assert s.length.sum() <= 256 and len(s) <= 3 and s.loss_tokens.sum() <= 200
    assert packing.pack(empty, tokenizer_path()).count() == 0


def test_pieces_are_placed_by_the_rule(monkeypatch):
    """Each placed piece is the fitting one of the largest dot product, the first of equal ones; if none fits, the one of which most fits is cut."""
    monkeypatch.setattr(packing, "POOL", 40)
    r, limits = np.random.default_rng(5), packing.Limits(tokens=64, segments=5, loss_tokens=48)
    full = np.array([64, 5, 48])
    state = []

    class Watched(packing.Packer):
        def place(self, keep):
            state[:] = [p for p in self.pool]
            super().place(keep)

        def _put(self, p):
            need = [np.array([len(q.ids), 1, q.loss()]) for q in state]
            fit = [i for i, n in enumerate(need) if (n <= self.room).all()]
            if fit:
                value = [round(float(need[i] / full @ (self.room / full)), 9) for i in fit]
                chosen = [i for i in fit if (state[i].row, state[i].start) == (p.row, p.start)]
                assert chosen and value[fit.index(chosen[0])] == max(value)
                del state[chosen[0]]
            else:
                most = [q.largest(int(self.room[0]), int(self.room[2])) for q in state]
                i = int(np.argmax(most))
                assert (p.row, p.start, len(p.ids)) == (state[i].row, state[i].start, most[i])
                state[i] = state[i].halves(most[i])[1]
            super()._put(p)

    done, sizes = [], r.integers(1, 150, 400)
    packer = Watched(limits, True, done.append)
    for row, n in enumerate(sizes):
        packer.add(packing.Piece(row, 0, np.arange(n, dtype=np.uint32), int(n), int(n) // 4))
    packer.finish()
    got = sorted((p.row, p.start, len(p.ids)) for s in done for p in s)
    assert [sum(n for w, _, n in got if w == row) for row in range(400)] == sizes.tolist()
    for s in done:
        assert sum(len(p.ids) for p in s) <= 64 and len(s) <= 5 and sum(p.loss() for p in s) <= 48


def test_prompt(spark):
    df = spark.createDataFrame([(1, "one two three four", 2)], "doc_id long, text string, p int")
    assert packing.pack(df, tokenizer_path(), prompt_words=F.col("p")).agg(F.sum("loss_tokens")).first()[0] == 3


def test_quality(docs, spark, empty):
    got = quality.measured(docs, "q").select("doc_id", "q.*").toPandas().set_index("doc_id")
    assert got.loc[2].sum() == 0 and got.loc[0, "n_words"] == 70 and got.loc[8, "word_chars"] == 5
    rng = np.random.default_rng(1)
    x = {"a": rng.random(3000), "b": rng.random(3000)}
    bad = (x["a"] > 0.7) & (x["b"] <= 0.5)
    rules = quality.learn(x, bad)
    hit = np.zeros(3000, bool)
    for r in rules:
        hit |= quality._covers(r, x, 3000)
    assert (hit == bad).mean() > 0.97
    assert quality.learned(docs, spark.createDataFrame([], "doc_id long, quality int")) == []
    assert quality.judged(empty, rules[:0]).count() == 0


@pytest.mark.parametrize("most", [1 << 18, 3])
def test_scoring(docs, empty, most, monkeypatch):
    monkeypatch.setattr(scoring, "FREQUENT", most)
    monkeypatch.setattr(scoring.frequent, "__defaults__", (most,))
    got = rows(scoring.score(docs))
    toks = [[*(t or "").encode().lower().split(), None] for t in TEXTS]
    held = [zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(TEXTS))]
    c = Counter(x for t, h in zip(toks, held, strict=True) if not h for x in t)
    n, v = sum(c.values()), len(c)
    for i, t in enumerate(toks):
        base = sum(np.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in t)
        assert (got.loc[i, "n_tokens"], got.loc[i, "n_known"], got.loc[i, "train_tokens"]) == (len(t), sum(x in c for x in t), n)
        assert abs(got.loc[i, "base_score"] - base) < 1e-6 and np.isfinite(got.loc[i, "score"])
    assert scoring.score(empty).count() == 0


def test_probabilities_sum_to_one(spark, monkeypatch):
    """After any history, the classed words and the class of all others have probability one together."""
    import pyarrow as pa

    monkeypatch.setattr(scoring, "CLASSED", 40)
    monkeypatch.setattr(scoring, "CLASSES", 6)
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in np.minimum(rng.geometric(0.05, 200), 90)) for _ in range(20)]
    train = spark.createDataFrame([(t,) for t in texts], "text string").repartition(2)
    m = scoring.fit(train, scoring.frequent(scoring.count_words(train)))
    assert m.weights.any() and m.inner.any() and (np.bincount(m.class_of)[1:] <= 8).all()
    for history in ("w1 w2", "w7", "never w1"):
        (c,) = bytewords.chunks(iter([pa.RecordBatch.from_arrays([pa.array([history])], ["text"])]))
        before = scoring.tokens(c)[0][:-1]
        nexts = np.append(m.words, np.uint64(12345))  # the last is of the class of all others
        t = np.concatenate([np.append(before, x) for x in nexts])
        logp = scoring.log_probability(m, t, np.arange(len(nexts) + 1) * (len(before) + 1))
        assert abs((10 ** logp.reshape(len(nexts), -1)[:, -1]).sum() - 1) < 1e-4


def test_group_sums():
    """Groups of one to hundreds of rows, in any order, against sums by hand."""
    rng = np.random.default_rng(5)
    for sizes in (rng.integers(1, 300, 20), np.ones(7, np.int64), np.array([8, 9, 1, 64, 65]), np.array([12])):
        x = rng.random((50, 4)).astype(np.float32)
        of = rng.integers(0, 50, sizes.sum())
        first = np.cumsum(sizes) - sizes
        seen = []
        for groups, sums in scoring.group_sums(x, of, first, sizes):
            seen.extend(groups)
            for g, got in zip(groups, sums, strict=True):
                assert np.allclose(got, x[of[first[g] : first[g] + sizes[g]]].sum(0), rtol=1e-4)
        assert sorted(seen) == list(range(len(sizes)))


def test_tokens_once(spark, docs, monkeypatch):
    """Texts are parted into words once: all later passes get tokens, and the same ones."""
    import pyarrow as pa

    seen = []
    fit = scoring.fit
    monkeypatch.setattr(scoring, "fit", lambda train, counts: seen.append(train.columns) or fit(train, counts))
    assert scoring.score(docs).count() == len(TEXTS) and seen == [["tokens"]]
    monkeypatch.setattr(scoring, "PIECE", 5)
    texts = [*TEXTS, None, "", " \t", "A a\u00e4 " * 20]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["id", "text"])
    want = [scoring.tokens(c)[0].tolist() for i in range(len(texts)) for c in bytewords.chunks(iter([batch.slice(i, 1)]))]
    written = scoring.tokenised(spark.createDataFrame(list(enumerate(texts)), "id long, text string").coalesce(1)).orderBy("id").toArrow().combine_chunks().to_batches()[0]
    for some, k in ((written, 0), (written.slice(2, 3), 2), (written.slice(0, 0), 0), (batch, 0)):
        got = []
        for rows, t, first in scoring.pieces(iter([some])):
            assert len(first) == len(rows) + 1 and first[-1] == len(t)
            got += [t[i:j].tolist() for i, j in zip(first, first[1:], strict=False)]
        assert got == want[k : k + len(some)]


def test_row_groups(spark):
    """A table of tokens has row groups for many tasks, so that no task of a training pass goes without rows."""
    import pyarrow.parquet as pq

    df = spark.range(12000).select(F.expr("array_join(transform(sequence(1, 40), i -> sha2(cast(40 * id + i AS string), 256)), '')").alias("x")).coalesce(1)
    (path,) = scratch.written(df, "groups", group=scoring.GROUP).inputFiles()
    assert pq.ParquetFile(path.removeprefix("file://")).num_row_groups > 1


def test_lookup():
    """Places in a table as find() gives them, also where hashes crowd, are the greatest, or there are none."""
    rng = np.random.default_rng(1)
    most = np.uint64(2**64 - 1)
    for table in (np.zeros(0, np.uint64), np.array([most]), np.arange(40, dtype=np.uint64), np.unique(rng.integers(0, 2**64, 5000, dtype=np.uint64))):
        h = np.concatenate((table, table + np.uint64(1), rng.integers(0, 2**64, 100, dtype=np.uint64), np.array([0, most], np.uint64)))
        assert scoring.Lookup(table)(h).tolist() == scoring.find(table, h).tolist()


def test_scoring_learns(spark):
    """The model beats the base on held-out texts, whatever the partitions."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    for partitions in (1, 5):
        got = scoring.score(df.repartition(partitions, "doc_id")).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
        assert got[0] > got[1] + 0.1 * got[2]


def test_binding_loss(spark):
    """op7's limits over a whole table: loss-bearing tokens reach their limit in sequences that still fill up with prompts."""
    got = queries.op7_packing(spark, "/root/testdata/sf0.001").toPandas()
    s = got.groupby("sequence_id").agg(tokens=("length", "sum"), loss=("loss_tokens", "sum"), segments=("length", "size"))
    assert s.tokens.max() <= 2048 and s.loss.max() == queries.LOSS_TOKENS and s.segments.max() <= 64
    assert (s.loss == queries.LOSS_TOKENS).mean() > 0.2
    padded = (2048 - s.tokens[(s.tokens & (s.tokens - 1)) > 0]).sum()
    assert padded < 0.02 * s.tokens.sum()
    for _, d in got.groupby("doc_id"):
        free = d.doc_tokens.iloc[0] // 4
        assert (d.loss_tokens == (d.start + d.length - d.start.clip(lower=free)).clip(lower=0)).all() and d.length.sum() == d.doc_tokens.iloc[0]


def test_other_tokenizer():
    """Of a tokenizer that parts words by the white space before them, whole texts are encoded."""
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    texts = [t or "" for t in TEXTS]
    made = wordids.WordIds(path)
    assert not made.by_words and wordids.WordIds(tokenizer_path()).by_words
    want = [[*e.ids, 7] for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in made.encode([t.encode() for t in texts], 7)] == want


def test_repeated_rows(spark):
    """Of rows that occur many times, each is judged as one row is, and work is in proportion to their number."""
    one = [(1, COPY), (2, "x " + COPY), (None, COPY + " z")]
    df = spark.createDataFrame(one * 40, "doc_id long, text string").repartition(3)
    got = substrings.removed(df).groupBy("doc_id").agg(F.min("n_removed"), F.max("n_removed"), F.count("*")).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == {1: (0, 0, 40), 2: (70, 70, 40), None: (70, 70, 40)}
    strings = substrings._strings(df.select(*substrings._keys("doc_id", "text")).join(substrings.super_kmers(df.select(*substrings._keys("doc_id", "text"))).groupBy("id", "version").agg(F.collect_set(F.struct("minimiser", "start", "n")).alias("kmers")), ["id", "version"]), 50)
    assert strings.count() == 40 * strings.distinct().count()
    found = sharding.shard(df, 2, bucket_bytes=2000).toPandas()
    for _, s in found.groupby("shard"):
        assert sorted(s.slot) == list(range(len(s)))


def test_sharding_is_reproducible(spark):
    """The law and the slots don't depend on partitions; the shards are what a comparison of all shards says."""
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    made = []
    for partitions in (2, 7):
        spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
        got = sharding.shard(df.repartition(partitions), 5, bucket_bytes=20_000).toPandas()
        made.append({r.doc_id: (r.shard, r.slot, r.grown_shard) for r in got.itertuples()})
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert made[0] == made[1]
    hashes = df.select("doc_id", *[F.xxhash64(F.lit(17), "doc_id", F.lit(s)).alias(str(s)) for s in range(6)]).toPandas().set_index("doc_id")
    assert all(made[0][i][0] == int(hashes.loc[i, list("01234")].astype("int64").idxmax()) and made[0][i][2] == int(hashes.loc[i].astype("int64").idxmax()) for i in hashes.index)
    # shuffled: within a shard, the order of slots isn't that of ids
    first = [i for i, v in sorted(made[0].items(), key=lambda x: x[1][:2]) if v[0] == 0]
    assert first != sorted(first)


def test_sharding(docs, empty):
    got = sharding.shard(docs, 3, bucket_bytes=500).toPandas()
    assert len(got) == len(TEXTS)
    for _, s in got.groupby("shard"):
        assert sorted(s.slot) == list(range(len(s)))
    assert ((got.grown_shard == got["shard"]) | (got.grown_shard == 3)).all()
    assert (got.text_crc32 == [zlib.crc32((t or "").encode()) for t in got.text]).all()
    assert sharding.shard(empty, 3).count() == 0


def test_fm_index():
    text = np.array([1, 2, 1, 2, 0, 1, 2, 3, 0], np.int64)
    index = fmindex.FMIndex(text, 4)
    lo, hi = index.search(np.array([[1, 2], [2, 1], [3, 3], [0, 3]]), np.array([2, 2, 2, 1]))
    assert (hi - lo).tolist()[:2] == [3, 1] and hi[2] <= lo[2]
    assert sorted(index.locate(np.arange(lo[0], hi[0]))) == [0, 2, 5]


def test_decontamination(spark, docs, empty):
    items = spark.createDataFrame([(3, " ".join(f"C{i}" for i in range(20, 35))), (12, "b, C"), (5, None), (7, "")], "item_id long, text string")
    got = rows(decontamination.report(docs, items))
    assert list(got.loc[0, "items"]) == ["3"] and got.loc[0, "n_hit"] == 15
    assert list(got.loc[8, "items"]) == ["12"] and got.loc[8, "n_hit"] == 2 and not got.loc[2, "contaminated"]
    clean = decontamination.clean(docs, items)
    assert clean.columns == docs.columns and clean.count() == len(TEXTS)
    assert decontamination.report(clean, items).where("contaminated").count() == 0
    assert decontamination.report(docs, items.where("false")).where("contaminated").count() == 0
    assert decontamination.report(empty, items).count() == 0


def random_texts(seed, n=60):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(8)] + ["É", "#a$", "x,y", "B"]
    return [None, "", " \n", *("".join(rng.choice(words) + rng.choice([" ", " ", "\n", "\t"]) for _ in range(rng.integers(1, 70))) for _ in range(n))]


def test_quality_brute_force(spark):
    import re

    texts = random_texts(4)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = rows(quality.judged(df, [], "q").select("doc_id", "q.*"))
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        seen, again, dup = {}, set(), 0
        for k in range(len(w) - 7):
            seen.setdefault(tuple(w[k : k + 8]), []).append(k)
        for places in seen.values():
            if len(places) > 1:
                again.update(j for k in places for j in range(k, k + 8))
        lines_ = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        dup = len(lines_) - len(set(lines_))
        failed = len(w) < 20 or 100 * len(again) > 30 * len(w)
        want = (len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t or ""), dup, len(again), failed, not failed)
        assert tuple(got.loc[i, ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]]) == want


def test_decontamination_brute_force(spark):
    import re

    def split(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    rng = np.random.default_rng(9)
    texts = [None, "", *(" ".join(rng.choice(["a", "b", "É", "B,"], rng.integers(1, 60))) for _ in range(60))]
    items = [(i, " ".join(rng.choice(["a", "b", "é"], n))) for i, n in enumerate([3, 10, 11, 12, 14, 1, 0, 5])] + [(20, None), (21, texts[5])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = rows(decontamination.report(df, spark.createDataFrame(items, "item_id long, text string")))
    for i, t in enumerate(texts):
        w, hit, names = split(t), set(), set()
        for name, item in items:
            v = split(item)
            for x in {tuple(v[k : k + 10]) for k in range(max(1, len(v) - 9))} if v else ():
                for k in range(len(w) - len(x) + 1):
                    if tuple(w[k : k + len(x)]) == x:
                        hit.update(range(k, k + len(x)))
                        names.add(str(name))
        assert (got.loc[i, "n_words"], got.loc[i, "n_hit"], list(got.loc[i, "items"])) == (len(w), len(hit), sorted(names))


def test_near_duplicates_brute_force(spark):
    """All links among texts that differ a little in many ways, with repeated rows."""
    rng = np.random.default_rng(2)
    texts = []
    for family in range(12):
        base = [f"f{family}x{k}" for k in range(rng.integers(20, 60))]
        for _ in range(rng.integers(1, 14)):
            t = list(base)
            for p in rng.integers(0, len(t), rng.integers(0, 4)):
                t[p] = f"e{rng.integers(5)}"
            texts.append(" ".join(t[: len(t) - rng.integers(0, 4)]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = rows(neardup.near_duplicates(df.union(df), 3, 0.85))
    want = brute_components(texts, 3, 0.85)
    found = got.groupby(level=0)["component_id"].agg(["min", "max"]).sort_index()
    assert found["min"].tolist() == found["max"].tolist() == want and len(got) == 2 * len(texts)


def test_warc_ties(spark):
    """Of equal page ids the largest url answers, whatever the order; repeated rows are written each."""
    rows_ = [(5, "http://b", "x"), (5, "http://a", "x"), (5, "http://b", "x"), (1, None, "y" * 100_000), (None, "http://z", "x")]
    for order in (rows_, rows_[::-1]):
        got = warc.read_warc(warc.convert(warc.write_arc(spark.createDataFrame(order, "page_id long, url string, html string").coalesce(1)))).toPandas()
        kinds = sorted(zip(got.url, got.record_type))
        assert kinds == [("about:blank", "response"), ("http://a", "revisit"), ("http://b", "response"), ("http://b", "revisit"), ("http://z", "revisit")]
        assert (got[got.record_type == "revisit"].refers_to == 5).all()


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_edges(spark, docs, empty, name):
    """Each stage takes nulls, empty and long texts, repeated rows, an empty table and columns with clashing names."""
    stage = dict(corpus_pipeline.STAGES)[name]
    got = stage(spark, docs.union(docs), "/root/testdata/sf0.001")
    assert stage(spark, empty, "/root/testdata/sf0.001").count() == 0
    if name != "packing":
        assert got.columns == docs.columns and got.count() <= 2 * len(TEXTS)
        assert {r[0] for r in got.select("doc_id").collect()} <= set(range(len(TEXTS)))
    else:
        assert got.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("d")).where("n <> 2 * d").count() == 0


def test_pipeline(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001").toPandas()
    assert len(got) and got.groupby("sequence_id").length.sum().max() <= 2048


def test_decontamination_holds_little_text_at_a_time():
    """What a task holds follows from the shard, not from its partition."""
    import tracemalloc

    import pyarrow as pa

    p = decontamination.phrases_of(["a"], [" ".join(f"w{i}" for i in range(12))])
    texts = [" ".join(f"w{i % 977}" for i in range(k, k + 50_000)) for k in range(24)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    tracemalloc.start()
    hit = sum(int(f.hit.sum()) for f in decontamination.merged(bytewords.chunks(iter([batch])), [p]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert hit > 24 * 50 * 12
    assert peak < 40e6
