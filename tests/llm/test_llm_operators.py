"""Every operator against brute force, with awkward rows."""

import hashlib
import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("gridloom.llm")
from gridloom.llm import ann, bpe, components, html_extract, jaccard, langid, packing, queries, sharding, substring, topk, toxicity
from gridloom.llm.common import crc_mod, with_copies

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id int, n_words int, `__text` string, tid string"


def documents(spark, rows):
    """Rows of (doc_id, text, lang, source) with further columns whose names could clash."""
    return spark.createDataFrame([(*r, None, 1, 2, "x", "y") for r in rows], SCHEMA)


def awkward():
    rng = random.Random(0)
    words = [f"w{i}" for i in range(400)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base, passage = prose(300), prose(70)
    rows = [(0, None, None, None), (1, "", "en", "a"), (2, " \t\n ", "en", "a"), (3, "one", "en", None), (4, "one two three four", "en", "a"), (5, "ONE two  three four", "de", "a")]
    rows += [(10 + i, base, "en", "hot") for i in range(30)]
    for i in range(20):
        w = base.split()
        w[rng.randrange(300)] = f"x{i}"
        rows.append((100 + i, " ".join(w), "en", "hot"))
    rows += [(200 + i, f"{prose(40)} {passage} {prose(40)}", "fr", f"s{i % 3}") for i in range(15)]
    rows += [(300, prose(30_000), "en", "long"), (301, "z" * 200_000, "en", "long"), (302, "ä ö ü 😀 ß x", "de", "a"), (303, base + " " + base, "en", "b")]
    rows += [rows[8], (None, base, "en", "a"), (400, "!!! 123", "en", "a")]
    return rows


@pytest.fixture(scope="module")
def rows():
    return awkward()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return documents(spark, rows).repartition(5)


def words_of(text, lower=False):
    raw = (text or "").encode()
    return (raw.lower() if lower else raw).split()


def test_bpe_equals_the_library(spark, docs, rows):
    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    codec = bpe.broadcast_codec(spark, path, public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    want = Counter()
    for i, t, *_ in rows:
        ids = library.encode_ordinary(t or "")
        want[i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in bpe.encode_digests(docs, codec).collect()) == want
    decoded = bpe.decode_ids(bpe.encode_documents(docs, codec), codec)
    assert Counter((r.doc_id, bytes(r.decoded)) for r in decoded.collect()) == Counter((i, (t or "").encode()) for i, t, *_ in rows)
    assert bpe.encode_digests(docs.where("false"), codec).count() == 0


def test_perfect_hash():
    keys = [str(i).encode() for i in range(1000)]
    index = bpe.PerfectHash(keys)
    assert sorted(index.key_at) == list(range(1000)) and all(index.probe(k) == i for i, k in enumerate(keys))


def test_html(spark):
    article = "<article><h1>Head &amp; line</h1><p>First <b>bold</b>ed  text.<br>More<p>Unclosed <a href=x>link</a> 1 &lt; 2</article>"
    pages = {
        1: f"<html><head><title>T</title><style>p{{}}</style><script>var a='</p>';</script></head><body><nav><a>menu</a></nav><!-- c --><div class='ad'>buy</div>{article}<footer>f</footer></body></html>",
        2: None,
        3: "",
        4: "plain &quot;text&quot;",
        5: "<body><div class=content><p>" + "long text here " * 30 + "</p></div><div id='user-comments'><p>" + "comment text " * 40 + "</p></div><div class='cookie-notice'>We use cookies",
        6: "<body><nav><ul><li><a>only</a></li></ul></nav></body>",
        7: "<div><div><p>" + "one two " * 20 + "</p><p>x</p></div><div><p>" + "three four " * 20 + "</p></div></div><p",
        8: "<p>" * 3000 + "deep",
    }
    df = spark.createDataFrame([(k, f"u{k}", v, 0, "t") for k, v in pages.items()], "page_id long, url string, html string, n_chars int, text string")
    got = {r.page_id: (r.text, r.n_chars) for r in html_extract.extract_main_text(df).collect()}
    want = {1: "Head & line First bolded text. More Unclosed link 1 < 2", 2: "", 3: "", 4: 'plain "text"', 5: ("long text here " * 30).strip(), 6: "", 7: ("one two " * 20) + "x " + ("three four " * 20).strip(), 8: "deep"}
    assert got == {k: (v, len(v)) for k, v in want.items()}
    assert html_extract.extract_main_text(df.where("false")).count() == 0


def test_html_wrappers_and_loose_text():
    long, more = "long text here " * 30, "other words follow " * 30
    body = f"<p>{long}</p><p>{more}</p>"
    both = " ".join((long + more).split())
    text = html_extract.main_text
    assert text(f"<body>Intro text of the page<div>{body}</div></body>") == "Intro text of the page " + both
    assert text(f"<body><div>{body}</div>Some <b>bold</b> words<br>after</body>") == both + " Some bold words after"
    for wrap in ("div class='layout has-sidebar'", "div id='search-page'", "div class=with-banner", "div class=related", "form action=x"):
        end = wrap.split()[0]
        for inner in (body, f"<article>{body}</article>", f"<div class='related'>{body}</div>"):
            assert text(f"<body><h1>Head</h1><{wrap}>{inner}<div class=ad>buy</div></{end}></body>").endswith(both), (wrap, inner)
    assert text(f"<body><article>{body}</article><div id=comments><article>{long * 9}</article></div><form>go {long}</form></body>") == both
    assert text(f"<body><div hidden>{body}</div></body>") == ""


def test_html_inside_an_article():
    long = "long text here " * 30
    links = "".join(f"<li><a href=/story/{i}/>Another story of the day</a></li>" for i in range(8))
    page = f"<body><article><h1>Head</h1><p>{long}</p><p>See <a href=x>this</a> too.</p><p>Short.</p><div><p>Read on</p><ul>{links}</ul></div><p>{long}</p></article></body>"
    assert html_extract.main_text(page) == " ".join(f"Head {long} See this too. Short. {long}".split())
    assert html_extract.main_text("<body><div/>one<p>two</p></div></body>") == "one two"


def test_html_names_of_furniture():
    """One furniture word among others does not make furniture of a part of the article."""
    long = "long text here " * 30
    kept = ["section id='related-work'", "p class=share-price", "div class='article-header'", "div class='alert-systems lead'", "table class=promotion-table", "div class=hasSidebar"]
    gone = ["div class='related-posts'", "ul class='x share-buttons'", "div id=siteHeader", "div class='comment-list'", "div class='ad-728x90'", "section class=article-comments", "div role=search", "div class=ADS"]
    for tag in ("article", "main"):
        for name in kept + gone:
            page = f"<body><{tag}><p>{long}</p><{name}>Some short words</{name.split()[0]}><p>{long}</p></{tag}></body>"
            words = " Some short words " if name in kept else " "
            assert html_extract.main_text(page) == " ".join((long + words + long).split()), name


def test_html_of_a_megabyte(spark):
    """No page costs more than in proportion to its length, whatever its tags."""
    n = 60_000
    pages = ["<div>" * n + "</i>" * n + "x", "<b>" * n + "<div>a</div>" * n, "<div>" * n + "<li>a</li>" * n, "<table>" + "<td>" * n + "</b>" * n + "x", "<form>" * n + "x y", "<p>long text</p>" * n]
    start = time.process_time()
    assert [html_extract.main_text(p)[:3] for p in pages] == ["x", "a a", "a a", "x", "x y", "lon"]
    assert time.process_time() - start < 60
    df = spark.createDataFrame([(1, "u", pages[5])] * 3, "page_id long, url string, html string")
    assert [r.n_chars for r in html_extract.extract_main_text(df).collect()] == [10 * n - 1] * 3


def brute_substring(rows):
    first = {}
    for i, t, *_ in rows:
        w = words_of(t)
        for k in range(len(w) - 49):
            g = tuple(w[k : k + 50])
            first[g] = min(first.get(g, i), i)
    out = Counter()
    for i, t, *_ in rows:
        w = words_of(t)
        gone = set()
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < i:
                gone |= set(range(k, k + 50))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out[i, len(w), len(gone), hashlib.sha256(kept).hexdigest()] += 1
    return out


@pytest.mark.parametrize("bits", [substring.MOST_BITS, 4])
def test_substring(spark, docs, rows, bits):
    got = substring.remove_repeats(docs, digest=True, most_bits=bits)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    alone = Counter((None, len(words_of(r[1])), 0, hashlib.sha256(b" ".join(words_of(r[1]))).hexdigest()) for r in rows if r[0] is None)
    assert Counter(tuple(r) for r in got.collect()) == brute_substring([r for r in rows if r[0] is not None]) + alone
    assert substring.remove_repeats(docs.where("false"), digest=True).count() == 0


def test_substring_keeps_untouched_texts(spark, docs):
    rows = substring.remove_repeats(docs, keep=("lang",)).collect()
    assert {r.kept for r in rows if r.doc_id == 2} == {" \t\n "} and {r.lang for r in rows if r.doc_id == 302} == {"de"}
    assert {r.kept for r in rows if r.doc_id == 11} == {""} and {r.kept for r in rows if r.doc_id == 0} == {None}


def brute_jaccard(rows):
    sets = defaultdict(list)
    for i, t, *_ in rows:
        w = words_of(t, True)
        sets[i].append(frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[k : k + 5]) for k in range(len(w) - 4)]))
    ids = sorted(sets)
    up = {i: i for i in ids}

    def top(v):
        while up[v] != v:
            v = up[v]
        return v

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if any(x and y and 100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b]):
                p, q = top(a), top(b)
                up[max(p, q)] = min(p, q)
    return Counter((i, len(s), top(i)) for i in ids for s in sets[i])


def test_jaccard(spark, docs, rows):
    got = jaccard.similar_components(docs)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    alone = Counter((None, n, None) for r in rows if r[0] is None for (_, n, _) in brute_jaccard([(0, r[1])]))
    assert Counter(tuple(r) for r in got.collect()) == brute_jaccard([r for r in rows if r[0] is not None]) + alone
    assert jaccard.similar_components(docs.where("false")).count() == 0


def test_jaccard_chains_and_borders(spark):
    rng = random.Random(4)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(60):  # a chain: each differs from the one before by a few words
        base = list(base)
        for _ in range(3):
            base[rng.randrange(120)] = f"n{rng.randrange(10**6)}"
        rows.append((i * 7 % 61, " ".join(base), "en", "a"))
    rows += [(1000 + i, " ".join(f"{c}{k}" for k in range(30 - i % 6)), "en", "a") for i in range(12) for c in ("qr"[i % 2],)]
    got = jaccard.similar_components(documents(spark, rows).repartition(3))
    assert Counter(tuple(r) for r in got.collect()) == brute_jaccard(rows)


def test_jaccard_around_an_origin(spark):
    """Copies that are linked with their origin only, not with each other."""
    rng = random.Random(9)
    base = [f"b{i}" for i in range(140)]
    rows = [(77, " ".join(base), "en", "a")]
    for i in range(60):
        w = list(base)
        for k in rng.sample(range(5, 135), 3):
            w[k] = f"n{rng.randrange(10**6)}"
        rows.append((i, " ".join(w), "en", "a"))
    got = jaccard.similar_components(documents(spark, rows).repartition(3))
    assert Counter(tuple(r) for r in got.collect()) == brute_jaccard(rows)


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 6), (6, 5), (5, 5), (20, 1)] + [(100 + i, 101 + i) for i in range(50)]
    got = {r.id: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 20: 1, **dict.fromkeys(range(5, 10), 5), **dict.fromkeys(range(100, 151), 100)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_packing(spark, docs, rows):
    out = packing.pack(docs, capacity=128, documents_a_block=16).collect()
    text = defaultdict(list)
    for r in rows:
        text[r[0]].append(r)
    pieces = Counter()
    for r in rows:
        n = len(words_of(r[1]))
        pieces.update((r[0], k, k * 128, min(128, n - k * 128)) for k in range(max(1, -(-n // 128))))
    assert Counter((r.doc_id, r.piece, r.first_word, r.n_words) for r in out) == pieces
    bins = defaultdict(list)
    for r in out:
        bins[r.block, r.bin].append(r)
    for members in bins.values():
        assert sum(r.n_words for r in members) <= 128
        assert sorted(r.place for r in members) == list(range(len(members)))
        sources = [text[r.doc_id][0][3] for r in members if text[r.doc_id][0][3] is not None]
        assert len(sources) == len(set(sources))
        copies = [(text[r.doc_id][0][1] or "").lower() for r in members]
        assert len(copies) == len(set(copies))
    assert packing.pack(docs.where("false")).count() == 0


def test_packing_keeps_given_clusters_apart(spark):
    df = spark.createDataFrame([(i, f"a b {i}", f"s{i}", i % 3) for i in range(60)], "doc_id long, text string, source string, near long")
    bins = defaultdict(list)
    for r in packing.pack(df, capacity=64, cluster_column="near").collect():
        bins[r.block, r.bin].append(r.doc_id % 3)
    assert all(len(v) == len(set(v)) for v in bins.values()) and len(bins) == 20


def test_repeated_rows_fill_no_block(spark):
    """Rows that are equal in every column are dealt over blocks and shards like others."""
    df = spark.createDataFrame([(None, "a b c", None, None)] * 3000 + [(i, f"a b {i}", "en", "s") for i in range(1000)], "doc_id long, text string, lang string, source string")
    copies = [tuple(r) for r in with_copies(df.select("text", "source"), a_part=64).where("source is null").collect()]
    assert sorted(copies) == [("a b c", None, k) for k in range(3000)]
    out = packing.pack(df, capacity=64, documents_a_block=100).collect()
    blocks = Counter(r.block for r in out)
    assert len(out) == 4000 and len(blocks) == 40 and max(blocks.values()) < 200
    assert max(Counter((r.block, r.bin) for r in out if r.doc_id is None).values()) == 1
    shards = [(r.n, r.b) for r in sharding.kd_shards(df).groupBy("shard").agg(F.count("*").alias("n"), F.sum("size").alias("b")).collect()]
    sizes = [b for _, b in shards]
    assert sum(n for n, _ in shards) == 4000 and len(sizes) == 8 and max(sizes) - min(sizes) < 0.02 * max(sizes)


def test_best_fit_equals_a_scan_of_all_bins():
    rng = random.Random(1)
    lengths = sorted((rng.randrange(0, 60) for _ in range(300)), reverse=True)
    sources, clusters = [rng.choice([None, *range(6)]) for _ in lengths], [rng.randrange(40) for _ in lengths]
    bins = []
    for n, s, c in zip(lengths, sources, clusters, strict=True):
        fit = [(b["left"], k) for k, b in enumerate(bins) if b["left"] >= n and (s is None or s not in b["s"]) and c not in b["c"]]
        k = min(fit)[1] if fit else len(bins)
        if not fit:
            bins.append({"left": 100, "s": set(), "c": set(), "n": []})
        bins[k]["left"] -= n
        bins[k]["s"].add(s)
        bins[k]["c"].add(c)
        bins[k]["n"].append(n)
    got, _ = packing.best_fit(lengths, sources, clusters, 100)
    mine = defaultdict(list)
    for n, b in zip(lengths, got, strict=True):
        mine[b].append(n)
    assert [mine[k] for k in range(len(bins))] == [b["n"] for b in bins]


def test_sharding(spark, docs, rows):
    out = sharding.kd_shards(docs, shards=4).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    for s in range(4):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    assert {r.law for r in out} == {"bytes"} and {r.grown_shard for r in out} == {None} and {r.shard for r in out} <= set(range(4))
    assert sharding.kd_shards(docs.where("false")).count() == 0


def test_shards_are_near_equal(spark):
    out = queries.queries()["op6_kd_sharding"](spark, "/root/testdata/sf0.01")
    sizes = [r.b for r in out.groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(sizes) == 8 and max(sizes) - min(sizes) < 0.01 * sum(sizes)
    split = out.groupBy("text_crc32").agg(F.countDistinct("shard").alias("n"), F.sum("size").alias("b")).where("n > 1").collect()
    assert all(r.b > sum(sizes) / 8 * sharding.TOLERANCE for r in split)


def vectors(spark, count=400, kind="float"):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(count, 16)) * rng.uniform(0.5, 2, (count, 1)) / 8
    x[50:90] = x[50]
    rows = [(i, [float(np.float32(v)) for v in r], 0, 1.5) for i, r in enumerate(x)]
    rows += [(1000, None, 0, 0.0), (1020, [], 0, 0.0), (1040, [0.0] * 16, 0, 0.0), (1060, [None] * 16, 0, 0.0), (1080, [float("nan")] * 16, 0, 0.0), (1100, [float("inf")] * 16, 0, 0.0), (1120, [1.0] * 3, 0, 0.0)]
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, rank int, score double"), {r[0]: np.array(r[1]) for r in rows[:count]}


def test_exact_top_k(spark):
    df, valid = vectors(spark)
    valid = {**{i: np.floor(v * 256).astype(int) for i, v in valid.items()}, 1040: np.zeros(16, int)}
    want = []
    for q in valid:
        if q % 50 == 0:
            best = sorted((-int(valid[q] @ valid[c]), c) for c in valid if c != q)[:5]
            want += [(q, n, c, -s) for n, (s, c) in enumerate(best, 1)]
    got = sorted(tuple(r) for r in topk.exact_top_k(df.repartition(3)).collect())
    assert got == sorted(want)
    few = topk.exact_top_k(df.where("vec_id in (0, 1, 2)")).collect()
    assert len(few) == 2 and topk.exact_top_k(df.where("false")).count() == 0


def test_nearest_neighbours(spark):
    df, valid = vectors(spark)
    got = ann.nearest(df.repartition(3), k=10)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    found = defaultdict(dict)
    for r in got.collect():
        found[r.query_id][r["rank"]] = (r.vec_id, r.score)
    hits = total = 0
    for q in valid:
        if q % 20 == 0:
            assert sorted(found[q]) == list(range(1, 11))
            assert all(s == pytest.approx(float(valid[q] @ valid[c]), abs=1e-12) for c, s in found[q].values())
            best = sorted((-float(valid[q] @ valid[c]), c) for c in valid if c != q)[:10]
            hits += len({c for _, c in best} & {c for c, _ in found[q].values()})
            total += 10
    assert hits >= 0.9 * total and set(found) == {q for q in valid if q % 20 == 0}
    assert ann.nearest(df.where("vec_id in (0, 1, 2)")).count() == 2 and ann.nearest(df.where("false")).count() == 0


def test_recall_and_ties_of_the_lists(spark):
    """More vectors than the sample holds, in clusters, with copies, and some of another length."""
    rng = np.random.default_rng(5)
    x = (rng.normal(size=(300, 16))[rng.integers(300, size=20_000)] + 0.5 * rng.normal(size=(20_000, 16))).astype(np.float32)
    x[100:140] = x[100]
    short = rng.normal(size=(60, 3)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(100_000 + i, v.tolist()) for i, v in enumerate(short)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    found = defaultdict(list)
    for r in ann.nearest(df).orderBy("query_id", "rank").collect():
        found[r.query_id].append((-r.score, r.vec_id))
    assert set(found) == {i for i, _ in rows if i % 20 == 0} and {len(v) for v in found.values()} == {20}
    assert all(v == sorted(v) for v in found.values())
    hits = 0
    wide, asked = x.astype(float), np.arange(0, 20_000, 20)
    for q, s in zip(asked, wide[asked] @ wide.T, strict=True):
        s[q] = -np.inf
        best = np.lexsort((np.arange(len(s)), -np.round(s, 9)))[:20]
        hits += len(set(best.tolist()) & {i for _, i in found[q]})
    assert hits >= 0.9 * 20 * len(asked)
    assert all({i for _, i in found[q]} <= set(range(100_000, 100_060)) for q in found if q >= 100_000)


def test_centroid_graph_finds_the_nearest():
    rng = np.random.default_rng(0)
    c, x = rng.normal(size=(900, 8)), rng.normal(size=(50, 8))
    ids, d = ann.CentroidGraph(c).search(x, 100)
    true = np.argsort(((x[:, None] - c[None]) ** 2).sum(axis=2), axis=1)[:, :10]
    assert np.mean([len(set(a[:20]) & set(b)) / 10 for a, b in zip(ids, true, strict=True)]) > 0.95
    assert (np.diff(d, axis=1) >= -1e-9).all() and all(len(set(r)) == len(r) for r in ids)


def test_all_lists_within_the_ratio_are_visited_and_hold_the_nearest():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, 12))[rng.integers(40, size=6000)] + 0.7 * rng.normal(size=(6000, 12))
    index = ann.ListIndex(np.arange(6000), x, float(np.sqrt((x**2).sum(axis=1).max())), 700, 20)
    q = np.arange(0, 6000, 60)
    homes = index.sample_homes
    row, at, floor = index.visits(q, x[q], 16)
    d = np.sqrt(((index.asked(x[q])[:, None] - index.graph.centroids[None]) ** 2).sum(axis=2))
    within = d <= d.min(axis=1, keepdims=True) * index.prune
    visited = np.zeros(within.shape, bool)
    visited[row, at] = True
    assert within.sum(axis=1).max() > 16 and visited[within].mean() > 0.99
    hits = 0
    for i, scores in enumerate(x[q] @ x.T):
        scores[q[i]] = -np.inf
        listed = visited[i][homes].any(axis=1)
        listed[q[i]] = False
        hits += listed[np.argsort(-scores)[:20]].sum()
        assert (scores[listed] >= floor[i]).sum() >= 20
    assert hits >= 0.93 * 20 * len(q)
    index.prune = np.inf
    assert len(index.visits(q, x[q])[0]) == 700 * len(q)


def test_network_equals_a_naive_convolution():
    net = langid.ByteCnn(["a", "b", "c"], seed=3)
    net.out += 0.5
    net.compiled()
    raw = bytes(range(256)) + "Ünï lower UPPER".encode() * 20
    x = langid.windows_of(raw)
    for w, p in zip(x, net.probabilities(x), strict=True):
        peaks = []
        for table, width in zip(net.tables, langid.WIDTHS, strict=True):
            peaks += [max(sum(float(table[j][w[i + j]][f]) for j in range(width)) for i in range(len(w) - width + 1)) for f in range(langid.FILTERS)]
        z = np.maximum(peaks, 0) @ net.out + net.bias
        assert np.allclose(p, np.exp(z - z.max()) / np.exp(z - z.max()).sum(), atol=1e-4)


def test_gains_equal_compressing_every_window():
    """Windows that are not compressed could not have gained."""
    rng = random.Random(2)
    words = [f"{a}{b}{c}" for a in ("ka", "lo", "mi") for b in ("ren", "tas", "vul") for c in ("do", "si", "pe")]
    prose = lambda bad: " ".join(rng.choice(words) if rng.random() > bad else f"grimfoul{rng.choice(words)}" for _ in range(90))
    model = toxicity.fit([(prose(0.2 * (i % 2)), i % 2) for i in range(90)])
    assert len(model.toxic) > 20 and model.score(prose(0.3)) > 0.9 > 0.1 > model.score(prose(0))
    for text in (prose(0.3), prose(0), "", "grimfoul"):
        parts = toxicity.windows(text)
        naive = [len(model._under_ordinary(w)) - len(model._under_toxic(w)) for w in (toxicity.PREAMBLE + p + b" " for p in parts)]
        assert sorted(g for g in naive if g > 0) == sorted(g for g in model.gains(parts) if g > 0)


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.language_of_documents(docs).join(docs, "doc_id").where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in out) >= 0.97 * len(out)
    assert all(0 <= r.score <= 1 for r in out)


def test_language_of_awkward_rows(spark, docs):
    out = {r.doc_id: r for r in langid.language_of_documents(docs).collect()}
    assert {out[i].lang_pred for i in (0, 1, 2, 400)} == {"und"} and out[302].lang_pred != "und"
    assert out[300].held_out == (zlib.crc32(b"300") % 3 == 1)
    assert langid.language_of_documents(docs.where("false")).count() == 0
    assert {r.lang_pred for r in langid.language_of_documents(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_toxicity_of_held_out_documents(spark):
    """All held-out labels of the table, together and by language."""
    read = lambda t: spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet")
    out = toxicity.toxicity_of_documents(read("documents"), read("labels")).join(read("labels"), "doc_id").join(read("documents").select("doc_id", "lang"), "doc_id")
    out = out.where("held_out").collect()
    for langs, least in ((("en", "de", "es", "fr"), 0.9), (("en",), 0.85), (("de",), 0.85), (("es",), 0.85), (("fr",), 0.85)):
        some = [r for r in out if r.lang in langs]
        hit = sum(r.predicted == 1 and r.toxic == 1 for r in some)
        assert hit >= least * sum(r.toxic for r in some) and hit >= least * sum(r.predicted for r in some), langs


def test_toxicity_of_awkward_rows(spark, docs, rows):
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(10, 40)] + [(None, 1, 1), (41, None, None)], "doc_id long, quality int, toxic int")
    out = toxicity.toxicity_of_documents(docs, labels)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    got = out.collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert toxicity.toxicity_of_documents(docs.where("false"), labels).count() == 0
    assert toxicity.toxicity_of_documents(docs, labels.where("false")).count() == len(rows)


def test_crc_of_ids(spark):
    got = {r.doc_id: r.m for r in spark.createDataFrame([(7,), (None,)], "doc_id long").select("doc_id", crc_mod("doc_id", 3).alias("m")).collect()}
    assert got == {7: zlib.crc32(b"7") % 3, None: -1}


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = spark.createDataFrame(stage(spark, before, SF).collect(), docs.schema)
        assert after.columns == docs.columns, name
        assert after.count() <= before.count()
        assert set(r.doc_id for r in after.select("doc_id").collect()) <= set(r.doc_id for r in before.select("doc_id").collect())
        if name == "ngram_jaccard_join":
            want = brute_jaccard([(r.doc_id, r.text) for r in before.collect()])
            assert {r.doc_id for r in after.collect()} == {c for _, _, c in want}
        if name == "substring_dedup":
            want = {k[0]: k[3] for k in brute_substring([(r.doc_id, r.text) for r in before.collect()])}
            assert all(hashlib.sha256(b" ".join(words_of(r.text))).hexdigest() == want[r.doc_id] for r in after.collect())
        before = after
    packed = corpus_pipeline.STAGES[-1][1](spark, before, SF)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in before.collect()}


def test_stages_on_awkward_rows(spark, rows, tmp_path):
    """Nulls, empty texts, shared ids, repeated rows, clashing names and empty tables in every stage."""
    import corpus_pipeline

    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(10, 40)] + [(None, 1, 1)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    clash = "doc_id long, text string, lang string, source string, n_chars int, score double, predicted int, n_words int, lang_pred string, n_removed int, kept string, stay int, nth int, digest int, `__nth` int, tid int, id int, c0 int, k0 int"
    given = [(*r, len(r[1] or ""), *range(14)) for r in [*rows, (300, "another text with one id", "en", "b")]]
    given = [(*r[:5], float(r[5]), *r[6:8], str(r[8]), r[9], str(r[10]), *r[11:]) for r in given]
    docs = spark.createDataFrame(given, clash)
    key = lambda df: Counter((r.doc_id, r.text) for r in df.collect())
    before = key(docs)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, str(tmp_path))
        assert after.columns == docs.columns, name
        got = after.collect()
        assert all((r.score, r.predicted, r.tid, r.k0) == (0.0, 1, 10, 13) for r in got), name
        if name in ("language_id", "toxicity"):
            assert not Counter((r.doc_id, r.text) for r in got) - before, name
        if name == "language_id":
            assert all(r.text and any(c.isalpha() for c in r.text) for r in got)
        if name == "ngram_jaccard_join":
            stay = {c for _, _, c in brute_jaccard([r for r in rows if r[0] is not None] + [(300, "another text with one id")])}
            assert Counter((r.doc_id, r.text) for r in got) == Counter({k: n if k[0] is None else 1 for k, n in before.items() if k[0] is None or k[0] in stay})
        if name == "substring_dedup":
            assert len(got) == len(given) and all(r.n_chars == len(r.text) for r in got if r.text is not None)
        assert stage(spark, docs.where("false"), str(tmp_path)).count() == 0, name
    assert {r.doc_id for r in corpus_pipeline.packed(spark, docs, "").collect()} == {r[0] for r in rows}
