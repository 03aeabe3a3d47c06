"""The training-data operators against brute force, on small tables with nulls, empty and long texts, repeats and extra columns."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("ionmill.llm")
P = pytest.importorskip("public_tokenizers")

from pyspark.sql import functions as F  # noqa: E402

from ionmill.llm import boosting, common, components, decontam, exact_dedup, html_extract, jaccard_join, langid, packing, pii, queries, token_shards, tokens, url_filter, warc, wordhash  # noqa: E402

A_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = [f"w{k}x" for k in range(400)]


def corpus(seed=1):
    r = random.Random(seed)
    say = lambda n: " ".join(r.choice(WORDS) for _ in range(n))
    docs = [(k, say(r.choice([3, 5, 9, 40, 120]))) for k in range(60)]
    base = say(100).split()
    for k in range(60, 90):  # near copies of one text, at many distances
        w = list(base)
        for _ in range(r.choice([1, 1, 2, 3, 6])):
            w[r.randrange(len(w))] = r.choice(WORDS)
        docs.append((k, " ".join(w)))
    docs += [(100 + k, docs[k][1].upper()) for k in range(8)] + [(110, None), (111, ""), (112, " \n\t"), (113, "!?"), (None, docs[3][1]), (5, docs[5][1]), (120, "long " * 30_000), (121, "Éa é É\x85\xa0ß")]
    return docs


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = "file://" + str(tmp_path_factory.mktemp("t")) + "/documents.parquet"
    rows = [(i, t, "en", "s", 1, "x", "y") for i, t in corpus()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, digest string, key string").repartition(3).write.parquet(path)
    return path


@pytest.fixture(scope="module")
def docs(spark, table):
    return spark.read.parquet(table)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


@pytest.mark.parametrize(("name", "space_free"), [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
@pytest.mark.parametrize("special_as_text", [False, True])
def test_encoder_is_the_library(name, space_free, special_as_text):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(P.path(name))  # untouched, but for the flag that is tested
    if special_as_text:
        lib.encode_special_tokens = True
    e, r = tokens.TextEncoder(P.path(name), space_free, cache_bytes=30_000, special_as_text=special_as_text), random.Random(2)
    parts = [" ", "  ", "\n", "\t", "\r", "a", "The", "1", "23", "!", "'s", "'", "\x0b", "\x1c", "́", "e", "Σ", "ß", "İ", "É", "²", "<|endoftext|>", "<|ENDOFTEXT|>", "<|endof", "　", "中", "😀", "\x85", "\xa0"]
    for _ in range(30):
        texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 30))) for _ in range(100)]
        assert e.encode(texts) == [np.array(x.ids, "<u4").tobytes() for x in lib.encode_batch(texts, add_special_tokens=False)]
        assert e.held <= 30_000 and len(e.old) <= 150
    words = ["The", "würde", "don't", "a,b", "12", "x...", "Ñandú###", "Σ", "中", "²", "\0"]
    for _ in range(30):  # single white space, at the ends, too
        texts = [r.choice(["", " ", "\n"]) + "".join(r.choice(words) + r.choice(" \n") for _ in range(r.randint(0, 20))) + r.choice(["", *words]) for _ in range(100)]
        assert e.encode(texts) == [np.array(x.ids, "<u4").tobytes() for x in lib.encode_batch(texts, add_special_tokens=False)]


def test_token_files(spark, docs, empty, tmp_path):
    path = "file://" + str(tmp_path / "tok")
    counts = token_shards.write_token_shards(docs, path, P.path("word_bpe_49k.json"), file_ids=5000, block_ids=64)
    rows = token_shards.with_crc32(token_shards.read_token_shards(spark, path, counts)).orderBy("start").collect()
    lib, start = tokens.TextEncoder(P.path("word_bpe_49k.json"), True), 0
    want = Counter((i, zlib.crc32(lib.library([t or ""])[0] + np.array([2], "<u4").tobytes())) for i, t in corpus())
    assert Counter((r.doc_id, r.ids_crc32) for r in rows) == want
    for r in rows:
        assert r.start == start
        start += r.n_tokens
    ids = [r.doc_id for r in rows]
    assert ids[0] is None and ids[1:] == sorted(ids[1:]) and sum(counts) == start
    nothing = token_shards.write_token_shards(empty, path + "0", P.path("word_bpe_49k.json"))
    assert token_shards.read_token_shards(spark, path + "0", nothing).count() == 0


@pytest.mark.parametrize("width", [1, 7, 8, 13, 16, 17, 31, 32])
def test_bit_packing(width):
    ids = np.random.default_rng(width).integers(0, 1 << width, 1000, dtype=np.uint64).astype("<u4")
    shard = token_shards.Shard(token_shards.shard_bytes([(7, ids[:10].tobytes()), (None, ids[10:].tobytes())], width, 96, 0))
    for a, b in ((0, 1000), (5, 6), (95, 97), (130, 911), (4, 4)):
        assert np.array_equal(shard.ids(a, b), ids[a:b])
    with pytest.raises(ValueError):
        token_shards.Shard(token_shards.shard_bytes([(1, ids.tobytes())], width, 96, 0)[:-1])


def dedup_brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(A_Z)].append(i)
    out = Counter()
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        for i in ids:
            out[i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()] += 1
    return out


@pytest.mark.parametrize("bits", [256, 4])
def test_exact_dedup(spark, table, bits):
    got = exact_dedup.exact_dedup(spark, table, bits).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert Counter(tuple(r) for r in got.collect()) == dedup_brute(corpus())


def test_dedup_state_grows_by_batches(spark, docs, table, empty):
    state = common.scratch(spark, "test-state")
    exact_dedup.run_stream(spark, table, state, docs.schema, files_per_batch=1)
    exact_dedup.run_stream(spark, table, state, docs.schema)  # nothing new
    held = {r.digest: (r.keep_id, r.group_size) for r in exact_dedup.read_state(spark, state).collect()}
    assert held == {k[4]: (k[1], k[2]) for k in dedup_brute(corpus())}
    once = exact_dedup.keep_one(docs)
    texts = [(t or "").translate(A_Z) for t, in once.select("text").collect()]
    assert len(texts) == len(set(texts)) == len({(t or "").translate(A_Z) for _, t in corpus()}) and once.columns == docs.columns
    empty.write.parquet(common.scratch(spark, "none") + "/documents.parquet")
    assert exact_dedup.keep_one(empty).count() == 0


def test_components(spark):
    r = random.Random(4)
    edges = [(r.randint(0, 200), r.randint(0, 200)) for _ in range(150)] + [(500, 500 + k) for k in range(80)] + [(900 + k, 901 + k) for k in range(40)] + [(7, None), (3, 3)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if b is not None and a != b:
            root[max(find(a), find(b))] = min(find(a), find(b))
    got = {x.node: x.component for x in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in root}
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_urls(spark):
    link = lambda u: f'<html><LINK href="{u}" REL=canonical>'
    pages = [
        (1, "http://a.org/x", link("//b.org/y")), (2, "https://b.org/y#f", '<meta http-equiv="Refresh" content="0; url=http://Bad.net/es/1">'), (3, "http://c.org/", link("http://www.example.com/en/z")),
        (4, "http://WWW.Example.com/en/1?q", None), (5, "http://x.example.com/en/", ""), (6, None, "x"), (7, "no scheme", link("/z")), (8, "http://q.net/es/1", "y"), (9, "http://d.org/a/b", link("c")), (10, "http://d.org/a/c", None), (3, "http://c.org/", None),
        (11, "http://allowed.com/p", link("http://bad.net/es/1")),
    ]
    df = spark.createDataFrame([(*p, "h") for p in pages], "page_id long, url string, html string, host string")
    got = url_filter.judge(df, queries.URL_RULES, spark.createDataFrame([("http://d.org/a/c", "http://bad.net/fr/")], "source string, target string")).collect()
    v = {r.page_id: (r.rule, r.verdict) for r in got}
    assert len(got) == len(pages)
    assert v == {1: (None, "block"), 2: (None, "block"), 3: (None, "allow"), 4: ("www.example.com/en/", "allow"), 5: ("example.com/en/", "block"), 6: (None, "allow"), 7: (None, "allow"), 8: ("net/es/", "block"), 9: (None, "block"), 10: (None, "block"), 11: ("com/", "allow")}
    many = [*queries.URL_RULES, *(("block", f"h{k}.org", "/") for k in range(300))]
    again = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(df, many, spark.createDataFrame([("http://d.org/a/c", "http://bad.net/fr/")], "source string, target string")).collect()}
    assert again == v
    assert url_filter.judge(df.limit(0), queries.URL_RULES).count() == 0


LINKED = [("http://a.org/x/y", "z"), ("http://a.org/x/z", "../w"), ("http://a.org/w", "./v/../u?q=1&amp;r=2"), ("http://a.org/u?q=1&r=2", "//Bad.net/es/1"), ("http://c.org/p", "?q"), ("http://c.org/p?q", "http://x.example.com/en/1"), ("http://d.org/a", "#f"), ("http://e.org", "/.."), ("http://e.org/", "../../k/."), ("http://e.org/k/", "http://Q.net/fr/"), ("http://f.org/a/b", "/k/./l/../m"), ("http://f.org/k/m", None), ("http://g.org/1", "http://f.org/k/m"), ("http://h.com/1", "http://q.net/fr/"), ("http://i.org/a/", ".."), ("http://i.org/", "")]


def test_urls_with_links_like_sql(spark, tmp_path):
    import duckdb

    d = "file://" + str(tmp_path)
    rows = [(k, u, None if to is None else f"<head><link rel='canonical' href='{to}'>x") for k, (u, to) in enumerate(LINKED)] + [(99, None, "<link rel=canonical href=/z>"), (98, "http://a.org/x/y", "")]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{d}/pages.parquet")
    got = queries.QUERIES["op3_url_filter"](spark, d).select("component", "host", "page_id", "path", "rule", "verdict").collect()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.sql(f"SELECT component, host, page_id, path, rule, verdict FROM ({queries.ORACLES['op3_url_filter']})").fetchall()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    verdict = {r.page_id: r.verdict for r in got}
    assert [k for k, v in sorted(verdict.items()) if v == "block"] == [0, 1, 2, 3, 4, 5, 7, 8, 9, 98]


def test_html_of_any_size():
    wide = "<ul>" + "<li>word here</li>" * 30_000 + "</ul>"  # quadratic features took minutes
    root, nodes, order = html_extract.parse(wide)
    assert len(nodes) == 30_002 and html_extract.features(root, nodes, order).shape[0] == len(nodes)
    assert len(html_extract.parse("<p" * 200_000)[1]) == 1


def test_html(spark):
    x, y = html_extract.training_set(60, 90_000)
    ex = html_extract.fit(250)
    assert (((ex.model.logits(x) > 0) == y).mean()) > 0.98
    page = '<html><head><title>t</title><script>var a="</p>";</script></head><body><nav><ul><li><a href="/">home</a></li><li><a href="/b">more</a></li></ul></nav><div class="ad">Buy this now.</div><article><h1>A &amp; B</h1><p><b>One\n two.<br><p>Three four five.</p></article><footer>&copy; x &middot; all rights.</footer></body></html>'
    rows = [(1, "u", page), (2, None, None), (3, "v", ""), (4, "w", "plain   text"), (5, "x", "<p" * 2000), (1, "u", page)]
    got = html_extract.extract(spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, text string"), ex).collect()
    text = {r.page_id: (r.text, r.n_chars) for r in got}
    want = "A & B\nOne two.\nThree four five."
    assert len(got) == 6 and text[1] == (want, len(want)) and text[2] == ("", 0) and text[3] == ("", 0) and text[4] == ("plain text", 10)
    m = boosting.BoostedTrees(trees=30, depth=2).fit(np.random.default_rng(0).normal(size=(500, 3)), np.random.default_rng(0).normal(size=(500, 3))[:, 1] > 0)
    assert ((m.logits(np.random.default_rng(1).normal(size=(500, 3))) > 0) == (np.random.default_rng(1).normal(size=(500, 3))[:, 1] > 0)).mean() > 0.9


def test_html_heads():
    body = "<article><p>One two.</p><p>Three four.</p></article>"
    code = "<script>for(i=0;i<n;i++){a='<p>'}</script>"
    heads = [f"<head><title>t</title>{code}</head><body>", "<head><title>t</title><body>", f"<head><meta charset=x>{code}", "<head><template><p>x</p><body>", "<head><svg><title/><style>a<b</style></svg></head><body>", f"<body>{code}<svg><style>a<b</style><title/></svg>", "<head><title>t</title></head>"]
    for head in heads:
        assert [t for _, t in html_extract.parse(f"<html>{head}{body}</html>")[2]] == ["One two.", "Three four."], head
    assert [t for _, t in html_extract.parse("<head><title>t</title> plain <b>text</b>")[2]] == ["plain text"]


def test_html_deep_nests():
    n = 3000
    root, nodes, order = html_extract.parse(f"<body><article>{'<div>' * n}<p>deep{'</div>' * n}<p>after</article><footer>end</footer>")
    where = {text: node for node, text in order}
    assert where["after"].parent.tag == "article" and where["end"].parent.tag == "body" and where["deep"].depth == n + 3 and len(nodes) == n + 6
    many = 60_000  # no search of the stack for each tag
    assert len(html_extract.parse(f"<ul>{'<div>' * many}{'<li>x</li></nav>' * many}{'<h1>' * many}")[1]) == 3 * many + 2


def test_language(spark, empty):
    r = random.Random(5)
    stems = {"aa": ["bal", "tor", "min", "ke"], "bb": ["schu", "ung", "ver", "lich"], "cc": ["ción", "ado", "que", "ñar"]}
    say = lambda lang, n: " ".join("".join(r.choice(stems[lang]) for _ in range(r.randint(1, 3))) for _ in range(n))
    rows = [(k, say(lang := r.choice(list(stems)), 60), lang) for k in range(240)] + [(300, None, "aa"), (301, "12 ! ² ½", "aa"), (302, "", None), (303, say("bb", 60), None)]
    df = spark.createDataFrame([(*x, 1.0) for x in rows], "doc_id long, text string, lang string, score double")
    model = langid.fit(df.where(~langid.held_out(F.col("doc_id"))), sample_docs=30)
    got = {x.doc_id: x for x in langid.predict(df, model).collect()}
    held = [k for k, t, lang in rows if k < 240 and zlib.crc32(str(k).encode()) % 4 == 2]
    assert held and all(got[k].lang_pred == rows[k][2] for k in held)
    assert [got[k].lang_pred for k in (300, 301, 302, 303)] == ["und", "und", "und", "bb"] and all(0 <= x.score <= 1 for x in got.values())
    assert {x.doc_id for x in langid.keep_identified(df, model).collect()} == {k for k, _, _ in rows} - {300, 301, 302}
    none = langid.fit(empty)
    assert langid.predict(df, none).select("lang_pred").distinct().collect()[0][0] == "und"


def test_language_sample_is_the_least_draws_of_each_language(spark):
    r = random.Random(9)
    rows = {("hot" if k % 3 else f"l{k % 4}", r.getrandbits(60) - (1 << 59)) for k in range(9000)} | {("few", 7), ("few", -7)}
    df = spark.createDataFrame(sorted(rows), "lang string, draw long").repartition(40, "draw")
    want = {(lang, d, k + 1) for lang in {x for x, _ in rows} for k, d in enumerate(sorted(d for x, d in rows if x == lang)[:25])}
    for fan in (1, 3, 16):
        got = [(x.lang, x.draw, x.place) for x in langid.least(df, 25, fan).collect()]
        assert set(got) == want and len(got) == len(want)
    assert not langid.least(df.limit(0), 25).collect()


def test_language_of_long_texts():
    r = random.Random(5)
    stems = {"aa": ["bal", "tor", "min", "ke"], "bb": ["schu", "ung", "ver", "lich"]}
    say = lambda lang, n: " ".join("".join(r.choice(stems[lang]) for _ in range(r.randint(1, 3))) for _ in range(n))
    model = langid.Model({lang: say(lang, 1800).encode() for lang in stems})
    clean = say("bb", 500_000)
    assert len(clean) > 4_000_000
    got = [model.predict(clean[:n]) for n in (100_000, 1_000_000, len(clean))]
    assert all(lang == "bb" and not rejected for lang, _, rejected in got) and min(x[1] for x in got) > 0.5 * max(x[1] for x in got)
    assert model.predict(f"{clean[:150_000]} {say('aa', 100_000)}")[0] == "aa"


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(A_Z))
    return frozenset(tuple(w[k:k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def jaccard_brute(rows):
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    low = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            low[find(k)] = min(low.get(find(k), i), i)
    return Counter((i, len(sets[k]), low.get(find(k), i) if sets[k] else i) for k, (i, _) in enumerate(rows))


@pytest.mark.parametrize("settings", [{}, {"common_docs": 3, "least_in_task": 1, "star_rounds": 1, "held_shingles": 400, "n_buckets": 3}])
def test_jaccard(docs, settings):
    got = jaccard_join.jaccard_components(docs, **settings).select("doc_id", "n_shingles", "component_id")
    assert Counter(tuple(r) for r in got.collect()) == jaccard_brute(corpus())


def test_jaccard_keeps_the_smallest_id(spark):
    base = " ".join(WORDS[:40])
    rows = [(9, base, "a"), (3, base + " more", "b"), (5, base + " other", "c"), (None, base + " again", "d"), (7, "quite another text of six words", "e"), (7, "quite another text of six words", "f"), (None, "", "g")]
    for _ in range(2):
        df = spark.createDataFrame(rows, "doc_id long, text string, _row string").repartition(3)
        kept = jaccard_join.keep_one(df)
        assert kept.columns == df.columns and sorted((r.doc_id or 0, r.text) for r in kept.collect()) == [(0, ""), (3, base + " more"), (7, "quite another text of six words")]
        rows = [r for r in rows if r[0] is not None and r[2] != "f"] + [(0, "", "g")]  # unique ids now


def test_open_lists_are_dealt_over_cells(spark, monkeypatch, docs):
    monkeypatch.setattr(jaccard_join, "CELL", 2)
    monkeypatch.setattr(jaccard_join, "BROADCAST_PAIRS", 0)
    monkeypatch.setattr(jaccard_join, "BROADCAST_PIVOTS", 0)
    got = jaccard_join.jaccard_components(docs, star_rounds=0).select("doc_id", "n_shingles", "component_id")
    assert Counter(tuple(r) for r in got.collect()) == jaccard_brute(corpus())


def test_jaccard_empty_and_filter(docs, empty):
    assert jaccard_join.jaccard_components(empty).count() == 0
    kept = jaccard_join.keep_one(docs)
    want = len({c for _, n, c in jaccard_brute(corpus()) if n}) + sum(v for (_, n, _), v in jaccard_brute(corpus()).items() if not n)
    assert kept.count() == want and kept.columns == docs.columns


def test_signatures_meet():
    r = random.Random(6)
    for size in [1, 2, 3, 4, 5, 7, 10, 13, 20, 40, 75, 100, 150, 400]:
        for _ in range(60):
            common_n = r.randint(max(1, (3 * size + 3) // 4), size)
            a = [r.getrandbits(63) for _ in range(size)]
            room = common_n * 4 // 3 - size
            b = a[:common_n] + [r.getrandbits(63) for _ in range(r.randint(0, max(0, room)))]
            if 100 * common_n < 75 * (size + len(b) - common_n):
                continue
            often = np.sort(np.array(r.sample(a, r.choice([0, 0, size // 2, size])), np.uint64))
            hashes, first = np.concatenate([np.sort(np.array(x, np.uint64)) for x in (a, b)]), np.array([0, size, size + len(b)])
            sig, owner = jaccard_join.signatures(hashes, first, often)
            assert set(sig[owner == 0].tolist()) & set(sig[owner == 1].tolist()), (size, len(b), common_n)


def test_word_hashes():
    w = wordhash.Words(["Ab c", "", "ab\nzz c" + "q" * 600_000], wordhash.byte_table(bytes(x for x in range(256) if x not in (32, 10))), wordhash.ascii_fold)
    assert w.first.tolist() == [0, 2, 2, 5] and w.hashes[0] == w.hashes[2] and len(set(w.hashes.tolist())) == 4


def test_warc(spark, tmp_path):
    pages = [(1, "http://a/x", "<p>é</p>"), (2, "http://b/", "<p>é</p>"), (3, None, None), (4, "http://c/", ""), (5, "http://d/\n?q", "z" * 200_000), (2, "http://b/", "<p>é</p>"), (7, "http://e", "<p>é</p>x")]
    df = spark.createDataFrame([(*p, "q") for p in pages], "page_id long, url string, html string, digest string").repartition(3)
    for least in (0, 100):
        path = "file://" + str(tmp_path / f"w{least}")
        warc.write_archives(df, path, min_revisit_bytes=least)
        got = warc.assemble(warc.read_records(spark, path)).collect()
        keep = {}
        for i, _, h in pages:
            keep[h or ""] = max(i, keep.get(h or "", i))
        want = Counter()
        for i, _, h in pages:
            data = (h or "").encode()
            again = len(data) >= least and keep[h or ""] != i
            want[i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", keep[h or ""] if again else None] += 1
        assert Counter((r.page_id, r.capture.payload_bytes, r.capture.payload_digest, r.capture.type, r.refers_to) for r in got) == want
        assert all(r.request and r.metadata for r in got)
    path = "file://" + str(tmp_path / "none")
    assert warc.write_archives(df.limit(0), path) == 0
    evil = spark.createDataFrame([(k, f"http://a/\r\nWARC-Type: response\r\n\r\n{k}", "same") for k in range(5)], "page_id long, url string, html string")
    path = "file://" + str(tmp_path / "evil")
    warc.write_archives(evil, path)
    assert sorted((r.page_id, r.capture.type, r.refers_to) for r in warc.assemble(warc.read_records(spark, path)).collect()) == [(k, "revisit", 4) for k in range(4)] + [(4, "response", None)]


def test_warc_of_a_hot_payload(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)  # the way beyond the bound
    df = spark.range(300).selectExpr("id page_id", "concat('http://a/', id) url", "if(id % 3 = 0, 'hot', concat('x', id % 50)) html")
    path = "file://" + str(tmp_path / "hot")
    warc.write_archives(df, path)
    got = warc.assemble(warc.read_records(spark, path)).collect()
    html = {k: "hot" if k % 3 == 0 else f"x{k % 50}" for k in range(300)}
    last = {h: k for k, h in html.items()}
    assert sorted((r.page_id, r.refers_to) for r in got) == sorted((k, last[h] if last[h] != k else None) for k, h in html.items())


def test_warc_cut_short(spark):
    data = b"".join(warc.transaction(1, "u", b"abc", None, None, "d") for _ in range(2))
    assert len(list(warc.records(data))) == 6
    with pytest.raises(ValueError):
        list(warc.records(data[:-9]))


_E, _I, _C, _H = (re.compile(p) for p in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"))


def pii_brute(t):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    good = lambda d: sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0
    out = [("email", *m.span()) for m in _E.finditer(t)] + [("ip", *m.span()) for m in _I.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    return out + [("card", *m.span()) for m in _C.finditer(t) if 13 <= len(digits(m)) <= 19 and good(digits(m))] + [("phone", *m.span()) for m in _H.finditer(t) if 9 <= len(digits(m)) <= 15]


def test_pii(spark):
    r = random.Random(7)
    parts = [*"aZ09.@+- ()%_é", "1.2.3.4", "a@b.c", "+1 555", "4111 1111 1111 1111", "256.1.1.1", "+1 (988) 555-2485"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(3000)]
    for t in texts:
        assert [(s.kind, s.start, s.end) for s in pii.find(t) if s.kind in pii.BASE] == pii_brute(t), t
    assert [s.kind for s in pii.find("our iban GB82 WEST 1234 5698 7654 32 and ssn 123-45-6789, " + "x " * 30 + "part 123-45-6788")] == ["iban", "ssn"]
    for t in ("IBAN GB82 WEST 1234 5698 7654 32 TODAY", "iban GB82WEST12345698765432 2024", "account DE89370400440532013000.", "iban: NO93 8601 1117 947 AND MORE"):
        assert [s.kind for s in pii.find(t) if s.kind == "iban"] == ["iban"], t
    assert pii.find("x" * 300_000 + "1" * 300_000) == [] and pii.find("GB82 WEST 1234 5698 7654 33") == []
    rows = spark.createDataFrame([(1, "a@b.cc", "k"), (None, None, "k"), (2, "", "k")], "doc_id long, text string, found string")
    assert sorted(len(x.found) for x in pii.detect(rows).collect()) == [0, 0, 1]


def test_decontamination(spark, docs, empty):
    r = random.Random(8)
    say = lambda n: " ".join(r.choice(WORDS) for _ in range(n))
    template = "How many apples does {a} have after {a} buys {n} kg of fruit and then gives {n} kg of it to {b}"
    bench = [(1, say(30)), (2, template.format(a="Alice", b="Bob", n=5)), (3, say(4)), (4, None), (5, ""), (6, "1 2 3 4 5 6 7 8 9 10 11 12")]
    inside = [(1, f"{say(40)} {bench[0][1]} {say(9)}"), (2, "So. " + template.format(a="Zed", b="Tim", n=12)), (3, "So. " + template.format(a="Zed", b="Tim", n=12).replace("gives 12", "gives 13")), (4, f"a {bench[2][1]} b"), (5, say(200)), (6, None), (7, ""), (8, "9 8 7 6 5 4 3 2 1 11 12 13 14 15"), (9, " ".join(bench[0][1].split()[:26]))]
    d = spark.createDataFrame([(*x, "q") for x in inside], "doc_id long, text string, kind string")
    b = spark.createDataFrame(bench, "item_id long, text string")
    for block in (2_000_000, 1):
        got = {(x.doc_id, x.item_id): x.kind for x in decontam.matches(d, b, block_windows=block).collect()}
        assert got == {(1, 1): "verbatim", (2, 2): "template", (4, 3): "verbatim", (9, 1): "verbatim"}
        assert {x.doc_id for x in decontam.clean(d, b, block_windows=block).collect()} == {3, 5, 6, 7, 8}
    assert decontam.matches(d, b.limit(0)).count() == 0 and decontam.matches(empty, b).count() == 0 and decontam.clean(docs, b).columns == docs.columns


def leaks(bench, texts):
    block = decontam.Block(list(enumerate(bench)), 8, 0.5)
    return {(t, m[0]): m[1] for t, ms in decontam._judged(texts, block, 0.75).items() for m in ms}


def test_leaks_of_placeholders():
    bench = ["Compute 12 + 7 - 3 * 4 / 2", "Who Wrote The Lord Of The Rings", "1 2 3 4 5 6 7 8 9 10 11 12"]
    assert leaks(bench, [f"some words here. {x} and more of them" for x in bench]) == {(k, k): "verbatim" for k in range(3)}
    assert leaks(bench, ["Compute 13 + 8 - 4 * 5 / 3", "Who Sang The Song Of The Seas", "12 11 10 9 8 7 6 5 4 3 2 1"]) == {}


def test_leaks_with_other_names_and_numbers():
    item = "Tom has 3 apples. Mary has 5 more apples than Tom. How many apples do they have together?"
    again = [item.replace("Tom", "Ben").replace("Mary", "Lisa"), item.replace("5", "1,000"), item.replace("Tom", "Ben").replace("5", "2.5"), item.replace("together", "now")]
    assert leaks([item], [f"So it goes. {x} Yes." for x in again]) == {(0, 0): "template", (1, 0): "template", (2, 0): "template", (3, 0): "verbatim"}
    assert leaks(["Who is Tom"], ["Alice is Bob"]) == {}


def test_leaks_of_repeated_windows():
    item = "a b " * 20_000  # meeting all places for each window took minutes at 2,000
    assert leaks([item], [item, "a b " * 10_000]) == {(0, 0): "verbatim"}


def test_leaks_in_any_context_case_and_script():
    bench = ["What is the capital of France?", "Welche Straße führt nach Köln am Rhein", "法国的首都是哪一座城市？", "Какой город является столицей Франции?", "Which river does the Tower Bridge of London cross"]
    there = ['He asked, "{}" and left', "so ({}) it is", "我们问：「{}」然后走了", "「{}", "他说过{}对吧"]
    for k, x in enumerate(bench):
        for form in (x, x.lower(), x.upper()):
            assert leaks(bench, [t.format(form) for t in there]) == {(j, k): "verbatim" for j in range(5)}, form
    assert leaks(bench, ["德国的大城市有哪些座", "the capital of France is", "", "😀\ud800"]) == {}


def test_packing(docs, empty):
    got = packing.pack(docs, P.path("byte_bpe_50k.json"), capacity=128).collect()
    lib, seqs, pieces = tokens.TextEncoder(P.path("byte_bpe_50k.json")), defaultdict(list), defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    for v in seqs.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= 128
    want = defaultdict(list)
    for i, t in corpus():
        ids = lib.library([t or ""])[0] + np.array([0], "<u4").tobytes()
        want[i] += [(k, a, n, zlib.crc32(ids[4 * a:4 * (a + n)])) for k, (a, n) in enumerate(packing.cut(len(ids) // 4, 128))]
    assert {k: sorted(v) for k, v in pieces.items()} == {k: sorted(v) for k, v in want.items()}
    total = sum(r.length for r in got)
    assert len(seqs) <= 1.05 * -(-total // 128) + 1
    assert packing.pack(empty, P.path("byte_bpe_50k.json")).count() == 0
    assert packing.cut(300, 128) == [(0, 44), (44, 128), (172, 128)] and packing.cut(256, 128) == [(0, 128), (128, 128)]


def test_packing_plan():
    r = random.Random(9)
    for _ in range(150):
        cap = r.choice([5, 16, 64])
        counts = {r.randint(1, cap): r.randint(1, 30) for _ in range(r.randint(1, 9))}
        moves, n = packing.plan(counts, cap)
        fill, ranks = defaultdict(list), defaultdict(list)
        for length, rank, count, first, offset in moves.tolist():
            for k in range(count):
                fill[first + k].append((offset, length))
                ranks[length].append(rank + k)
        assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(v)) for k, v in counts.items()} and set(fill) == set(range(n))
        for v in fill.values():
            at = 0
            for offset, length in sorted(v):
                assert offset == at
                at += length
            assert at <= cap


def test_pipeline(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    r = random.Random(10)
    say = lambda n: " ".join(r.choice(["bal", "tor", "min", "ke"]) + r.choice(["ra", "no", "lis", "ta"]) * r.randint(1, 3) for _ in range(n))
    bench = say(20)
    rows = [(k, say(50), "aa") for k in range(40)]
    near = rows[3][1].split()
    near[25] = "zzz"
    rows += [(50, rows[7][1].upper(), "aa"), (51, " ".join(near), "aa"), (52, f"{say(30)} {bench} {say(5)}", "aa"), (53, "123", "aa"), (54, None, None)]
    d = "file://" + str(tmp_path)
    spark.createDataFrame([(*x, "s", 1) for x in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    assert {x.doc_id for x in pipeline.run(spark, d).select("doc_id").collect()} == (set(range(40)) - {7}) | {50}
