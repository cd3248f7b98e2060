import json
import random
import re
from dataclasses import replace

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparklex.functions.text import fuzzy_word, gram_places, ngram_array, ngrams, normalize, term_count
from sparklex.functions.values import canonical, epoch, integer, number, shown_bytes, time_seconds
from sparklex.operators import postings
from sparklex.operators.highlight import original_snippet, snippet
from sparklex.operators.postings import Postings
from sparklex.operators.table import SearchTable
from sparklex.plans.language import boolean, command, is_boolean, simplified, web
from sparklex.plans.spec import Filter, Highlight, Query, Required, TableSpec, Term
from sparklex.queries import QUERIES, SQL
from sparklex.sources.tables import read_spec, read_synonyms, synonyms
from sparklex.streaming.changes import ReplayTable, folded, rebuilt, stream_into

SF = "/root/testdata/sf0.001"


def table(spark, texts, verify="off", **spec):
    rows = spark.createDataFrame([(i, t, None if i % 2 else i) for i, t in enumerate(texts)], "id long, text string, v long")
    return SearchTable.of(rows, TableSpec("id", ("text",), ("v",), verify=verify, **spec))


def ids(df):
    return sorted(r[0] for r in df.select("id").collect())


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "events", "part"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    if name not in QUERIES:
        pytest.skip("of another package")
    got = QUERIES[name](spark, SF)
    want = con.sql(SQL[name])
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    rows = sorted([[str(x) for x in r] for r in got.select(*names).collect()])
    other = sorted([[str(x) for x in r] for r in want.select(", ".join(f'"{n}"' for n in names)).fetchall()])
    assert rows == other


def test_ngrams():
    assert ngrams("aaab") == ["aa", "ab"]
    assert ngrams("東京", 2, 1) == ["東", "京"]
    assert ngrams("a京", 2, 1, cross=False) == ["京"]
    assert ngrams("a") == []


def test_normalize():
    assert normalize("ＡＢ１") == "AB1"
    assert normalize("ガ") == "ｶﾞ"
    assert normalize(None) is None


def test_modes(spark):
    texts = ["the data", "dat ata", None, ""]
    assert ids(table(spark, texts).matches(Query("data"))) == [0, 1]
    assert ids(table(spark, texts, "all").matches(Query("data"))) == [0]
    # exclusions go by n-grams in either mode
    assert ids(table(spark, texts, "all").matches(Query(none=("data",)))) == [2, 3]
    assert ids(table(spark, texts).matches(Query(""))) == []


def test_repeated_keys(spark):
    rows = [(1, "b x", 1), (1, "a x", 2), (1, None, 0), (1, "a x", 1), (1, "a x", None), (2, None, 5), (2, None, 3), (3, None, None), (3, "x", 9), (4, "0", -1), (4, "y x", 4)]
    df = spark.createDataFrame(rows, "id long, text string, v long").repartition(3)
    t = SearchTable.of(df, TableSpec("id", ("text",), ("v",), verify="all", required=(Filter("v", "!=", "-1"),)))
    assert sorted(map(tuple, t.rows.select("id", "v", "norm_text", "orig_text").collect())) == [(1, 1, "a x", "a x"), (2, 3, None, None), (3, 9, "x", "x"), (4, 4, "y x", "y x")]
    assert t.count(Query("x")).first()[0] == 3 and t.facet("v").count() == 4
    assert {r.ngram: r.docs for r in t.posting_sizes().collect()} == {"a ": 1, " x": 2, "y ": 1}
    with pytest.raises(Exception, match="a row without key"):
        SearchTable.of(spark.createDataFrame([(None, "a", 1)], df.schema), TableSpec("id", ("text",), ("v",))).rows.collect()


def test_boolean_and_filters(spark):
    t = table(spark, ["ab", "cd", "ab cd", "ef"], "all")
    assert ids(t.matches(Query(expression=(Term("ab") | Term("cd")) & ~Term("ef")))) == [0, 1, 2]
    assert ids(t.matches(Query(filters=(Filter("V", "!=", "0"),)))) == [1, 2, 3]
    assert ids(t.matches(Query(filters=(Filter("v", "=", "x"),)))) == []
    assert [r[0] for r in t.search(Query(sort="v", ascending=True)).collect()] == [1, 3, 0, 2]
    with pytest.raises(ValueError):
        t.search(Query(sort="none"))


def test_fuzzy(spark):
    df = spark.createDataFrame([("a hello b",), ("helo",), ("xhellox",), ("東京都",)], "t string")
    got = [r[0] for r in df.select(fuzzy_word(F.col("t"), "hello", 1)).collect()]
    assert got == [True, True, False, False]
    assert [r[0] for r in df.select(fuzzy_word(F.col("t"), "東都", 1)).collect()][3]


def test_terms_and_synonyms(spark):
    df = spark.createDataFrame([("aaaa",)], "t string")
    assert df.select(term_count(F.col("t"), "aa")).first()[0] == 2
    assert synonyms(["# no", "a\tb", "b\tc\td", "x"], TableSpec("id", ("t",))) == {"a": ("a", "b"), "b": ("a", "b"), "c": ("c", "d"), "d": ("c", "d")}


def test_snippets():
    assert snippet("one two three", ["two"], Highlight()) == "one <em>two</em> three"
    assert snippet("abcdef", ["x"], Highlight(snippet_len=3)) == "abc..."


def test_replay(spark):
    e = [(1, "INSERT", "a", None, "x", True), (2, "INSERT", "a", None, "y", True), (3, "UPDATE", "b", None, "z", True), (4, "DELETE", "b", None, None, True), (5, "UPDATE", "c", "a", "w", True), (6, "UPDATE", "c", None, "v", False), (7, "INSERT", "d", None, "q", True), (8, "UPDATE", "d", None, None, True)]
    df = spark.createDataFrame(e, "seq long, op string, key string, old_key string, text string, keep boolean")
    assert {r.key: r.text for r in folded(df).collect()} == {"d": "q"}
    assert {r.key: r.text for r in folded(df.where("seq < 3")).collect()} == {"a": "x"}


def test_save(spark, tmp_path):
    t = table(spark, ["ab", "cd", None])
    t.save(str(tmp_path / "t"))
    assert ids(SearchTable.load(spark, str(tmp_path / "t"), t.spec).matches(Query("ab"))) == [0]


def test_ngram_arrays(spark):
    """Postings have the n-grams that the terms are sought by, of hybrid tables and beyond the basic plane, too."""
    texts = ["aaab", "東京a京都", "a", "", "😀x😀y", "𠀀東b", "データ東京x", None, "ab\ncd"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for n, kanji, cross in ((2, 0, True), (2, 1, True), (3, 2, False), (1, 0, True), (2, 1, False), (1, 2, True)):
        got = {r.i: r.g for r in df.select("i", ngram_array(F.col("t"), n, kanji, cross).alias("g")).collect()}
        assert got == {i: None if t is None else ngrams(t, n, kanji, cross) for i, t in enumerate(texts)}


@pytest.mark.parametrize("n,kanji,cross", [(1, 0, True), (2, 0, True), (2, 1, True), (2, 1, False), (3, 0, False), (5, 2, True)])
def test_gram_places_equal_ngrams(n, kanji, cross):
    texts = ["", "a", "aa日本aa日本", "abc語x語x", "𠀀𠀀b\U0010ffff", "aabcb\n日本語abcb"]
    want = sorted((g, i) for i, t in enumerate(texts) for g in ngrams(t, n, kanji, cross))
    got = []
    for size, ideographs in [(n, None)] if kanji in (0, n) else [(n, False), (kanji, True)]:
        grams, of, count = gram_places(texts, size, ideographs, cross)
        assert len(set(grams)) == len(grams) == len(count)
        got += zip([g for g, k in zip(grams, count) for _ in range(k)], of.tolist(), strict=True)
    assert sorted(got) == want


def test_postings_are_written_as_lists(spark, tmp_path, monkeypatch):
    """Not a row for each posting; texts of several chunks, equal and null ones are all there."""
    monkeypatch.setattr(postings, "CHARS", 1000)
    rows = spark.createDataFrame([(f"k{i}", None if i % 50 == 0 else f"the same words {i % 3}") for i in range(1000)], "k string, norm_text string").coalesce(1)
    p = Postings.build(rows, TableSpec("k", ("text",)), str(tmp_path / "p"), 4)
    assert {r.key for r in p.of(["sa"]).collect()} == {f"k{i}" for i in range(1000) if i % 50}
    assert p.rows.count() == 980 * len(ngrams("the same words 0")) > 5 * p.lists.count()


def test_postings_equal_scan(spark, tmp_path):
    texts = ["the data", "dat ata", None, "", "東京 data", "京都東京", "x"]
    for k, spec in enumerate((dict(verify="off"), dict(verify="all"), dict(verify="off", kanji=1))):
        t = table(spark, texts, **spec)
        i = t.indexed(str(tmp_path / str(k)), 4)
        for q in (Query("data"), Query("東京"), Query("京"), Query("data", all=("the",)), Query("x"), Query("zz"), Query("data", none=("the",)), Query(expression=Term("data") | Term("x"))):
            assert ids(i.matches(q)) == ids(t.matches(q)), (spec, q)
        assert [tuple(r) for r in i.scored(Query("data")).select("id", "score").orderBy("id").collect()] == [tuple(r) for r in t.scored(Query("data")).select("id", "score").orderBy("id").collect()]
        assert sorted(map(tuple, i.index.sizes().collect())) == sorted(map(tuple, t.posting_sizes().collect())) == sorted(map(tuple, i.index.optimized(str(tmp_path / f"o{k}")).sizes().collect()))


def test_command_text():
    c = command(r"""SEARCH t "rock and roll" NOT 'a\x41' FILTER n>=5 FILTER c = "x y" LIMIT 5,10 HIGHLIGHT TAG <b> </b> SNIPPET_LEN 20 FUZZY 2""")
    assert (c.verb, c.table, c.query.text, c.query.none, c.query.expression) == ("SEARCH", "t", "rock and roll", ("aA",), None)
    assert [(f.column, f.op, f.value) for f in c.query.filters] == [("n", ">=", "5"), ("c", "=", "x y")]
    assert (c.query.offset, c.query.limit, c.query.fuzzy, c.query.highlight) == (5, 10, 2, Highlight("<b>", "</b>", 20))
    assert command("search t hello world").query.text == "hello world"
    assert command("SEARCH t (learning)").query.text == "(learning)"
    assert command("COUNT t basics or cats").query.expression == Term("basics") | Term("cats")
    assert command("SEARCH t a AND b NOT c").query.terms == ("a", "b") and command("SEARCH t a AND NOT c").query.none == ("c",)
    assert command("SEARCH t a AND (b OR c) SORT n").query.expression == Term("a") & (Term("b") | Term("c"))
    assert command("SEARCH t NOT a").query.expression == ~Term("a")
    assert command("SEARCH t a SORT ASC").query.ascending and command("FACET t c").query.terms == ()
    assert command("GET t 7").key == "7"
    bad = ["", "DROP t", "SEARCH", "SEARCH t", "SEARCH a,b x", "SEARCH t (a", "SEARCH t a)", 'SEARCH t "a', "SEARCH t a ORDER BY b", "SEARCH t a LIMIT 0", "SEARCH t a LIMIT 5 LIMIT 6", "SEARCH t a LIMIT 1,2 OFFSET 3", "COUNT t a LIMIT 5", "FACET t c x SORT c", "SEARCH t a FILTER c", "SEARCH t a FILTER c = ", "SEARCH t a FILTER c ~ 5", "SEARCH t a AND", "SEARCH t a SORT b , c", "GET t", "SEARCH t a FUZZY 3", "SEARCH t a HIGHLIGHT MAX_FRAGMENTS 101", "SEARCH t " + "x" * 129, "SEARCH t a LIMIT ５"]
    for text in bad:
        with pytest.raises(ValueError):
            command(text)


def test_boolean_text():
    a, b, c = Term("a"), Term("b"), Term("c")
    assert boolean("a OR b c") == a | (b & c) and boolean("NOT a AND b") == ~a & b and boolean('(a or b) not "c"') == (a | b) & ~c
    assert not is_boolean("hello world") and not is_boolean("(a)") and not is_boolean("and") and is_boolean("a or") and is_boolean("not a")
    for text in ("a AND", "OR a", "(a", "a)", "()", "NOT", '"a', "(" * 40 + "a" + ")" * 40, " ".join(f"t{i}" for i in range(65))):
        with pytest.raises(ValueError):
            boolean(text)


def test_web_expressions():
    for text, want in {"golang tutorial": "golang AND tutorial", '"machine learning" tutorial': '"machine learning" AND tutorial', "golang -old": "golang AND NOT old", "golang +(tutorial OR guide)": "golang AND (tutorial OR guide)", "機械学習　入門": "機械学習 AND 入門", "well-known c++": "well-known AND c++", "a or b": 'a AND "or" AND b', "-(a OR b) c": "NOT (a OR b) AND c"}.items():
        assert web(text) == want
    q = simplified("golang tutorial -old")
    assert (q.text, q.all, q.none) == ("golang", ("tutorial",), ("old",))
    for text in ("", "OR a", "a OR", '"a', "(a", "-"):
        with pytest.raises(ValueError):
            web(text)
    for text in ("a OR b", "-a"):
        with pytest.raises(ValueError):
            simplified(text)


def test_snippet_cases():
    h = Highlight(snippet_len=10)
    assert snippet("wait...... then data here", ["data"], Highlight()) == "wait...... then <em>data</em> here"
    assert snippet("0123456789 data 0123456789", ["data"], h) == "...6789 <em>data</em> ..."
    assert snippet("a" * 30, ["a" * 12], h) == "<em>" + "a" * 10 + "</em>..."  # clipped where it is cut
    assert snippet("x data " + "-" * 40 + " data y", ["data"], Highlight(snippet_len=10, max_fragments=1)) == "x <em>data</em> ---..."
    assert snippet("x data " + "-" * 40 + " data y", ["data"], h) == "x <em>data</em> ---...---- <em>data</em> ..."
    assert max(len(p) for p in snippet("data " * 50, ["data"], h).replace("<em>", "").replace("</em>", "").split("...")) <= 10
    assert original_snippet("ＤＡＴＡ と ガギ", normalize("ＤＡＴＡ と ガギ", lower=True), ["data", "ｶﾞ"], Highlight(), lambda t: normalize(t, lower=True)) == "<em>ＤＡＴＡ</em> と <em>ガ</em>ギ"
    assert original_snippet("é x", "e x", ["x"], h, normalize) == "é x"
    for bad in (dict(snippet_len=0), dict(max_fragments=101), dict(open="x" * 257)):
        with pytest.raises(ValueError):
            Highlight(**bad)


def test_highlights_of_a_page(spark):
    t = table(spark, ["ＤＡＴＡ here", "no", "a datum"], verify="all", lower=True)
    t.compiler.synonyms = {"data": ("data", "datum"), "datum": ("data", "datum")}
    assert [r.snippet for r in t.search(Query("data", highlight=Highlight())).collect()] == ["a <em>datum</em>", "<em>ＤＡＴＡ</em> here"]


def test_strict_values(spark):
    for text in ("1_0", " 5", "nan", "inf", "٥", "+5", "", "5 ", "1e999", "0x5"):
        assert number(text) is None and integer(text) is None
    assert integer("-07") == -7 and integer(str(1 << 70)) is None and integer("300", T.ByteType()) is None and number("-.5e1") == -5
    t = table(spark, ["a", "b"])
    assert ids(t.matches(Query(filters=(Filter("v", "!=", str(1 << 70)),)))) == []
    rows = [("2024-02-29 10:00:00",), ("2023-02-29",), ("2024-01-01T00:00:01.5",), ("1700000000",), ("24:00:00",), ("2024-01-01 24:00:00",), ("x",), (None,)]
    df = spark.createDataFrame(rows, "t string")
    assert [r[0] for r in df.select(epoch(F.col("t"))).collect()] == [1709200800, None, 1704067201, 1700000000, None, None, None, None]
    assert [r[0] for r in spark.createDataFrame([("-10:00:01",), ("838:59:59",), ("839:00:00",), ("1:60:00",)], "t string").select(time_seconds(F.col("t"))).collect()] == [-36001, 3020399, None, None]
    assert [r[0] for r in spark.createDataFrame([("-0.00",), ("007.50",), ("0",), ("-00.5",)], "t string").select(canonical(F.col("t"), "decimal")).collect()] == ["0.00", "7.50", "0", "-0.5"]
    assert [r[0] for r in spark.createDataFrame([("10:00:00",), ("10:00:00.25",)], "t string").select(canonical(F.col("t"), "datetime")).collect()] == ["10:00:00.000000", "10:00:00.250000"]
    assert shown_bytes(512) == "512B" and shown_bytes(1536) == "1.50KB"
    assert normalize("ｶﾞA 1", width="wide") == "ガＡ　１"
    with pytest.raises(ValueError):
        epoch(F.lit("x"), "+15:00")


def test_load_rules(spark, tmp_path):
    rows = [(1, "a", 5), (2, "b", None), (None, "c", 5)]
    df = spark.createDataFrame(rows, "id long, text string, v long")
    spec = TableSpec("id", ("text",), ("v",))
    with pytest.raises(Exception, match="a row without key"):
        SearchTable.of(df, spec).rows.count()
    with pytest.raises(Exception, match="a key occurs twice"):
        SearchTable.of(df.where("id = 1").union(df.where("id = 1")), replace(spec, unique=True)).rows.count()
    kept = df.where("id IS NOT NULL")

    def let_in(*rules):
        return ids(SearchTable.of(kept, replace(spec, required=rules)).rows)

    assert let_in(Required("v", "!=", "4")) == [1] and let_in(Required("v", "IS NULL")) == [2] and let_in(Required("V", "is  not null")) == [1]
    assert let_in(Required("x", "!=", "4")) == [] and let_in(Required("v", "=", "five")) == []
    (tmp_path / "spec.json").write_text(json.dumps({"key": "id", "text": ["text"], "filters": ["v"], "types": {"v": "int"}, "required": [{"column": "v", "op": "IS NOT NULL"}]}))
    (tmp_path / "synonyms.tsv").write_text("# c\na\tb\r\n")
    spec = read_spec(spark, str(tmp_path / "spec.json"))
    assert TableSpec.from_dict(spec.to_dict()) == spec and read_synonyms(spark, str(tmp_path / "synonyms.tsv"), spec) == {"a": ("a", "b"), "b": ("a", "b")}
    t = SearchTable.open_or_build(spark, str(tmp_path / "t"), kept, spec, seq=9, synonyms={"a": ("a", "b"), "b": ("a", "b")})
    again = SearchTable.open_or_build(spark, str(tmp_path / "t"), kept.where("false"), spec)
    assert ids(t.rows) == ids(again.rows) == [1] and again.seq == 9 and again.compiler.synonyms == {"a": ("a", "b"), "b": ("a", "b")}
    assert SearchTable.verify(spark, str(tmp_path / "t"))
    spark.createDataFrame([(4, 4, "x", "x")], t.rows.schema).write.mode("append").parquet(str(tmp_path / "t/rows"))
    assert not SearchTable.verify(spark, str(tmp_path / "t"))


EVENTS = "seq long, op string, key string, old_key string, text string, keep boolean, text_state string, v long"


def plain_replay(events, base):
    """The state after events one by one: {key: (text, v)}."""
    state = dict(base)
    for seq, op, key, old, text, keep, told, v in sorted(events):
        if op == "TRUNCATE":
            state.clear()
        if op == "UPDATE" and old not in (None, key):
            state.pop(old, None)
            op = "INSERT"
        if op == "INSERT" and keep and key not in state:
            state[key] = (text if told == "present" else None, v)
        if op == "DELETE" or op == "UPDATE" and not keep:
            state.pop(key, None)
        elif op == "UPDATE":
            state[key] = (text if told == "present" else None if told == "null" else state.get(key, (None,))[0], v)
    return state


@pytest.mark.parametrize("seed", range(3))
def test_replay_one_by_one(spark, seed, tmp_path):
    """The fold, in one go, in batches and as a stream, leaves what events leave that are applied one by one."""
    r = random.Random(seed)
    events = []
    for seq in range(1, 161):
        op = r.choices(["INSERT", "UPDATE", "DELETE", "TRUNCATE"], [5, 6, 2, 0.15])[0]
        key, moved = r.choice("abcdef"), op == "UPDATE" and r.random() < 0.2
        told = "present" if moved else r.choice(["present", "present", "absent", "null"])
        events.append((seq, op, None if op == "TRUNCATE" else key, r.choice("abcdef") if moved else None, f"t{seq}" if told == "present" else None, r.random() < 0.8, told, seq))
    base = {"a": ("A", 0), "z": ("Z", 0)}
    df = spark.createDataFrame(events, EVENTS)
    start = spark.createDataFrame([(k, *v) for k, v in base.items()], "key string, text string, v long")
    want = plain_replay(events, base)
    assert {x.key: (x.text, x.v) for x in folded(df, start, carry=("v",)).collect()} == want
    t = ReplayTable(spark, str(tmp_path / "table"), ("v",), buckets=3)
    assert rebuilt(t, start, 0) == 0
    for part in range(4):
        (df.where(f"seq > {40 * part} AND seq <= {40 * part + 40}")).coalesce(1).write.parquet(str(tmp_path / f"log/{part}"))
    for part in range(2):
        t.apply(spark.read.parquet(str(tmp_path / f"log/{part}")), part + 1)
        t.apply(spark.read.parquet(str(tmp_path / f"log/{part}")), part + 1)  # given again
    assert {x.key: (x.text, x.v) for x in t.read().collect()} == plain_replay([e for e in events if e[0] <= 80], base)
    assert {x.key: (x.text, x.v) for x in t.read(1).collect()} == plain_replay([e for e in events if e[0] <= 40], base)
    s = ReplayTable(spark, str(tmp_path / "stream"), ("v",), buckets=3)
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log/*"))
    stream_into(stream, s, str(tmp_path / "checkpoint"), keep=2).processAllAvailable()
    for q in spark.streams.active:
        q.stop()
    rows = s.read()
    assert {x.key: (x.text, x.v) for x in (rows.collect() if rows is not None else [])} == plain_replay(events, {})
    assert len(s.versions()) == 2


def test_replay_rules(spark):
    columns = "seq long, op string, key string, old_key string, text string, keep boolean, tbl string"
    e = [(1, "INSERT", "a", None, "x", True, "t"), (2, "INSERT", "b", None, "y", True, "other"), (3, "ALTER", None, None, "s1", True, "t"), (4, "INSERT", "c", None, "z", True, "t")]
    df = spark.createDataFrame(e, columns)
    assert {r.key: r.text for r in folded(df, tables=("t",), schema="s1", after=0).collect()} == {"a": "x", "c": "z"}
    with pytest.raises(Exception, match="change of the schema"):
        folded(df, tables=("t",), schema="s2").collect()
    base = spark.createDataFrame([("a", "x")], "key string, text string")
    cut = spark.createDataFrame([(1, "TRUNCATE", None, None, None, True), (2, "INSERT", "z", None, "q", True)], "seq long, op string, key string, old_key string, text string, keep boolean")
    assert {r.key: r.text for r in folded(cut, base).collect()} == {"z": "q"}
    with pytest.raises(Exception, match="without its text"):
        folded(spark.createDataFrame([(1, "UPDATE", "b", "a", None, True)], cut.schema)).collect()


def test_fuzzy_edit_distance(spark):
    """Against a plain edit distance over words and windows."""

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            old, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                old, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, old + (x != y))
        return row[-1]

    def near(text, term, d):
        words = [w for w in re.split("[ \t\r\n　\xa0]+", text)]
        return any(distance(w, term) <= d or not w.isascii() and any(distance(w[i : i + k], term) <= d for k in range(max(1, len(term) - d), len(term) + d + 1) for i in range(len(w) - k + 1)) for w in words)

    r = random.Random(5)
    texts = ["".join(r.choice("abc東京 é") for _ in range(r.randrange(12))) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for term, d in (("abc", 1), ("東a京", 1), ("abca", 2), ("a", 1)):
        assert [x[0] for x in df.select(fuzzy_word(F.col("t"), term, d)).collect()] == [near(t, term, d) for t in texts]
