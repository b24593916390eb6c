"""Each operator against a brute-force version or an exact round trip, with the odd cases: nulls, empty and long texts,
ties, repeated rows, empty tables, extra columns with clashing names."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wicker.llm import chat, common, forest, media, packing, pieces, quality, secret_spans, simhash, site_tree, toxicity
from wicker.llm.queries import vocabulary

DOCS = "doc_id long, text string, label string, base int"
ODD = [(1, None, "x", 0), (2, "", "x", 0), (3, "one two  three\nfour É▁İ <|endoftext|> \x00", "y", 1), (4, "word " * 30_000, None, None), (5, "one two  three\nfour É▁İ <|endoftext|> \x00", "y", 1), (5, "one two  three\nfour É▁İ <|endoftext|> \x00", "y", 1)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ODD, DOCS).cache()


def text(x):
    return x or ""


def test_components_follow_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(900, 901), (901, 900), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in common.components(links).collect()}
    assert got == {**{i: 0 for i in range(301)}, 900: 900, 901: 900}


def test_chat_windows_keep_every_turn_once(spark):
    said = "</s>[INST] ok [/INST] \\ <|turn|> <|text|"
    turns = [(7, i, r, f"{said} {i} " + "w " * n) for i, (r, n) in enumerate([("system", 9), ("user", 40), ("assistant", 60), ("user", 5), ("assistant", 200), ("user", 30), ("assistant", 30)])]
    rows = turns + [(8, None, None, None), (8, 0, "assistant", "a"), (8, 0, "assistant", "a"), (None, 1, "user", "u")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("window", F.lit(1))
    windows = chat.format_conversations(df, chat.ChatFormat(budget=150, history_tokens=80, history_turns=2))
    back = {r.conv_id: r for r in chat.read_back(windows).collect()}
    assert [(t.role, t.text) for t in back[7].turns] == [(r, x) for _, _, r, x in turns]
    assert back[7].loss_text == "".join(x for _, _, r, x in turns if r == "assistant")
    assert (back[8].n_turns, back[8].loss_text, back[None].n_turns) == (3, "aa", 1)
    of = [r for r in windows.where("conv_id = 7").orderBy("window").collect()]
    assert len(of) > 2 and all(r.formatted.startswith("<|turn|>system") for r in of) and all(r.n_repeated >= 1 for r in of[1:])
    assert all(r.n_tokens <= 150 or r.first_turn == 4 for r in of)
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0


def test_media_round_trip(docs):
    got = media.clips(media.encode_documents(docs)).collect()
    for r in got:
        data = text(dict((a, b) for a, b, *_ in ODD)[r.doc_id]).encode()
        data += bytes(-len(data) % 64 if data else 64)
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]))
    assert sorted(map(repr, got)) == sorted(map(repr, media.document_clips(docs).collect())) and media.document_clips(docs.limit(0)).count() == 0
    assert len(got) == len(ODD) and media.clips(media.encode_documents(docs.limit(0))).count() == 0
    x = np.random.default_rng(1).integers(0, 256, (5, 7)).astype(np.uint8)
    frame = media.jpeg(x)
    assert (media.dc_image(frame) == x).all()
    slow = frame.replace(b"\x10" + media.AC_LENGTHS + media.AC_VALUES, b"\x10" + media.AC_LENGTHS + media.AC_VALUES)
    assert slow == frame
    flat = [np.full((8, 8), v, np.uint8) for v in [10] * 6 + [200] * 5]
    assert media.shots(flat) == [(0, 5), (6, 10)]


def test_main_text(spark):
    page = "<html><head><title>t</title></head><body><nav><a>menu</a></nav><div class='ad'>buy</div><article><h1>A &amp; B</h1><p><b>x  y<br><p>z</p><script>no()</script><div class=comments>c</div></article><footer>f</footer></body>"
    site = "<body><div class='top'>same words</div><div>{}</div></body>"
    rows = [(1, "http://a.example/1", page), (2, None, None), (3, "http://b.example", "")] + [(10 + i, "http://s.example/" + str(i), site.format("text " * (i + 1))) for i in range(6)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(0))
    got = {r.page_id: r.text for r in site_tree.extract(df).collect()}
    assert (got[1], got[2], got[3]) == ("A & B\nx y\nz", "", "")
    assert [got[10 + i] for i in range(6)] == [("text " * (i + 1)).strip() for i in range(6)]
    assert {r.page_id: r.text for r in site_tree.extract(df, bound=0).collect()} == got
    assert site_tree.extract(df.limit(0)).count() == 0


def test_main_text_survives_words_in_names_of_wrappers():
    text = "<p>first</p><div class='side-by-side'>second</div>"
    for wrap in ("<div class='wrap has-sidebar'>", "<div class='no-sidebar'>", "<body class='overflow-hidden'>", "<div aria-hidden='false'>", "<div data-hidden=x>", "<div class='widget'>", "<div id=search class=a><div>"):
        for inner in ("article", "main", "div role=main"):
            assert site_tree.article(f"<nav>n</nav>{wrap}<{inner}>{text}", set()) == "first\nsecond", (wrap, inner)
    for gone in ("<div class='x sidebar'>", "<div hidden>", "<div aria-hidden=true>", "<div style='display: none'>", "<div id=comments>", "<aside>"):
        assert site_tree.article(f"<main>{text}{gone}<article>no</article>", set()) == "first\nsecond", gone
        assert site_tree.article(f"<main>{text}</main>{gone}<article>no</article>", set()) == "first\nsecond", gone
    assert site_tree.article("<div hidden><article>no</article></div><div>yes</div>", set()) == "yes"


def test_main_text_is_judged_inside_and_beside_the_article(spark):
    words = lambda i: f"page {i} " + f"w{i} " * 20 + "end"
    inside = "<body><article>By us<h1>title {0}</h1><p>Share this</p><p>{1}</p><div class=box>the same note</div></article></body>"
    beside = "<body><article class=card>teaser {0}</article><div class=x>{1}</div><div class=y>same words</div></body>"
    pages = [(i, "http://in.example/", inside.format(i, words(i))) for i in range(6)] + [(10 + i, "http://by.example/", beside.format(i, words(i))) for i in range(6)]
    pages += [(20 + i, "http://copy.example/", inside.format(0, words(0))) for i in range(4)] + [(30, "http://one.example/", beside.format(0, words(0)))]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in site_tree.extract(df).collect()}
    assert [got[i] for i in range(6)] == [f"title {i}\nShare this\n{words(i)}" for i in range(6)]
    assert [got[10 + i] for i in range(6)] == [f"teaser {i}\n{words(i)}" for i in range(6)]
    assert [got[20 + i] for i in range(4)] == [f"By us\ntitle 0\nShare this\n{words(0)}\nthe same note"] * 4
    assert words(0) in got[30]
    assert {r.page_id: r.text for r in site_tree.extract(df, bound=0).collect()} == got


def test_main_text_passes_over_raw_elements_and_all_white_space():
    text = lambda html: site_tree.article(html, set())
    assert text("<article><p>a</p><script>for(i=0;i<n;i++){}</script><p>b</p></article>") == "a\nb"
    assert text("<article><p>a</p><script>var t='</p><b>';if(a<b)x</SCRIPT ><p>b</article>") == "a\nb"
    assert text("<article>a<style>p>a{}</style><svg><text>no</text></svg> b<button>no</button></article>") == "a b"
    assert text("<article>a<script>no end <p>b") == "a" and text("<article>a <button>no end <p>b") == "a no end\nb"
    assert text("<article><p>a\u3000\u2003b\u2028\x85c&nbsp; d</p><p>\u3000</p><p>e") == "a b c d\ne"
    assert text("<article><p title=don't data-x='a>b' class=\"c>d\">it's</p>1 < 2 &lt; 3</article>") == "it's\n1 < 2 < 3"
    assert text("<article><div class=post-header><h1>t</h1></div><div class='side-by-side'>x</div><option>y<option>z</article>") == "t\nx\ny\nz"
    assert text("<article><!-- <p>no --><p>a<!-- open") == "a" and text("<select><option>no</select><article>a") == "a"


def test_main_text_keeps_a_marked_branch_that_holds_a_host_s_text(spark):
    words = lambda i: f"page {i} " + f"w{i} " * 30 + "end"
    html = "<body><div class='widget'><p>{0}</p><div class=share>Share this</div></div><div class=sidebar>see {1}</div></body>"
    df = spark.createDataFrame([(i, "http://w.example/", html.format(words(i), i)) for i in range(5)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in site_tree.extract(df).collect()} == {i: words(i) for i in range(5)}


def test_style_tree_is_the_one_of_plain_python(spark):
    rng = random.Random(14)
    pages = []
    for i in range(40):
        parts = [f"<div class=a>{rng.choice(['one', 'two'])}</div>", f"<div class=b>own {i}</div>", "<ul class=c>" + "<li>x</li>" * rng.randint(1, 3) + "</ul>", f"<p>text {rng.randint(0, 30)}</p>", "<div class=ad>buy</div>"]
        pages.append((i, f"http://h{i % 2}.example/{i}", "<body><div class='x1'>" + "".join(p for p in parts if rng.random() < 0.8) + "</div><article><p>" + f"words {i} " * 9 + "</p></article></body>"))
    want = set()
    for h in (0, 1):
        seen = {}
        for i, url, html in pages:
            if i % 2 == h:
                for path, kind, value, _ in site_tree.style_rows(*site_tree.parse(html)):
                    if kind < 2:
                        seen.setdefault(path, ([], []))[kind].append(value)
        entropy = lambda x: 1.0 if len(x) < 3 else -sum(x.count(v) / len(x) * np.log(x.count(v) / len(x)) for v in set(x)) / np.log(len(x))
        site = site_tree.xxhash.xxh64_intdigest(f"h{h}.example") >> 1
        want |= {(site, path) for path, (looks, says) in seen.items() if path == 0 or says and max(entropy(x) for x in (looks, says) if x) < 0.3}
    got = {(r.host, r.path) for r in site_tree.unimportant(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == want and len(got) >= 4


def test_secrets(spark, docs):
    ratio = secret_spans.fit_markov(secret_spans.labelled_strings(spark, docs))
    cases = ["é😀 TOKEN = abc; Secret:\"" + "x9" * 8 + "\" " + "ab12" * 10 + " AKIA" + "Z" * 12 + " secret: api_key: longvalue1", "key Zk3xQ9vLw82hTtYb7RfA getUserAccountNameById"]
    df = spark.createDataFrame([(1, None), (2, ""), (3, cases[0]), (4, cases[1]), (5, "token=abcdefgh " * 400)], "doc_id long, text string").withColumn("spans", F.lit(1))
    got = {r.doc_id: r for r in secret_spans.scan(df, ratio).select("doc_id", secret_spans.written("spans").alias("s"), secret_spans.redacted().alias("t")).collect()}
    assert (got[1].s, got[2].s) == ("", "")
    assert got[3].s == "assign:16:40,hex:42:82,access:83:99" and got[4].s == "markov:4:24"
    assert got[5].s == ",".join(f"assign:{15 * i}:{15 * i + 14}" for i in range(400)) and got[5].t == "<secret> " * 400
    assert secret_spans.scan(df.limit(0), ratio).count() == 0


def test_redaction_is_linear_and_exact(spark):
    rng, rows = random.Random(11), []
    for i in range(300):
        x = "".join(rng.choice("aé😀\n ") for _ in range(rng.randint(0, 60)))
        cuts = sorted((tuple(sorted(rng.sample(range(len(x) + 1), 2))), rng.randrange(4)) for _ in range(rng.randint(0, 9) if len(x) else 0))
        rows.append((i, x, [(a, b, k, "") for (a, b), k in cuts]))
    rows.append((999, "ab" * 16_000, [(2 * i, 2 * i + 1, 0, "") for i in range(16_000)]))
    df = spark.createDataFrame(rows, "id int, text string, spans array<struct<s int, e int, k int, m string>>").cache()
    assert df.count() == len(rows)
    began = time.time()
    got = {r.id: r.t for r in df.select("id", secret_spans.redacted().alias("t")).collect()}
    assert time.time() - began < 10
    for i, x, spans in rows:
        out, at = [], 0
        for a, b, *_ in spans:
            if a >= at:
                out.append(x[at:a] + "<secret>")
            at = max(at, b)
        assert got[i] == "".join(out) + x[at:], (i, x, spans)


def test_base_spans_are_python_s(spark):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    rng, rows = random.Random(12), []
    some = ["token", "API_KEY", "apikey", "pass", "word", "passwd", "secret", "=", ":", " ", '"', "'", "AKIA", "ABCDEFGH1234", "deadbeef", "0123456789abcdef", "é😀", "Z", "_", "longer-value", "\n", "ſecret"]
    for i in range(600):
        rows.append((i, "".join(rng.choice(some) for _ in range(rng.randint(0, 14)))))
    want = {}
    for i, x in rows:
        found = [(m.start(), 0, m.end()) for m in assign.finditer(x) if len(m[2]) >= 8]
        found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", x) if len(m[0]) >= 16]
        found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", x) if len(m[0]) >= 32]
        want[i] = ",".join(f"{secret_spans.KINDS[k]}:{a}:{b}" for a, k, b in sorted(found))
    got = secret_spans.scan(spark.createDataFrame(rows, "doc_id long, text string"), [0.0] * 128 * 128)
    assert {r.doc_id: r.b for r in got.select("doc_id", secret_spans.written("base").alias("b")).collect()} == want


def test_markov_models_on_strings_held_out(spark):
    words = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    ratio = secret_spans.fit_markov(secret_spans.labelled_strings(spark, words))
    rng = random.Random(13)
    alphabets = ["0123456789abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"]
    secrets = ["".join(rng.choice(a) for _ in range(rng.randint(20, 44))) for a in alphabets for _ in range(200)]
    parts = "get set user account name by id list parse config value default handler request response session number of items update create delete index table column reader writer buffer stream manager factory service".split()
    plain = [rng.choice(["_".join(w), w[0] + "".join(map(str.capitalize, w[1:])), "-".join(w)]) for w in ([rng.choice(parts) for _ in range(5)] for _ in range(600))]
    plain = [x for x in plain if len(x) >= 20]
    rows = [(i, f"x {s} y") for i, s in enumerate(secrets + plain)]
    got = {r.doc_id: r.n > 0 for r in secret_spans.scan(spark.createDataFrame(rows, "doc_id long, text string"), ratio).select("doc_id", F.size("spans").alias("n")).collect()}
    recall = np.mean([got[i] for i in range(len(secrets))])
    false = np.mean([got[i] for i in range(len(secrets), len(rows))])
    assert recall > 0.95 and false < 0.01, (recall, false)


def test_pieces_are_the_library_s(docs):
    path = vocabulary("piece_bpe_32k.model")
    plain, table = pieces.Plain(path), pieces.Chunks(path)
    assert pieces.separable(path)
    rng = random.Random(1)
    some = ["a", "B", " ", "  ", "\n", "▁", "é", "😀", "\t", "\x00", "</s>", "ab"]
    for _ in range(3000):
        x = "".join(rng.choice(some) for _ in range(rng.randint(0, 9)))
        assert table.text(x) == plain.text(x), repr(x)
    got = pieces.encode_documents(docs, path).collect()
    assert sorted((r.doc_id, r.ids, r.n_tokens, r.decoded) for r in got) == sorted((d, *(plain.text(text(t))[i] for i in (0, 1, 2))) for d, t, *_ in ODD)


def test_word_ids_are_the_tokenizer_s():
    path = vocabulary("word_bpe_49k.json")
    assert packing.separable(path) and not packing.separable(vocabulary("byte_bpe_50k.json"))
    table, rng = packing.Words(path, 1), random.Random(2)
    some = ["a", "B", " ", "\n", "é", "É", "İ", "Σ", "\u0301", "\x1c", "\x0b", "\xa0", "<|endoftext|>", "'s", "1", "!!", ".", "😀", "ß", "ǅ", "the", "ing"]
    texts = ["".join(rng.choice(some) for _ in range(rng.randint(0, 12))) for _ in range(6000)]
    texts += ["a" * 100_000, "É" * 3000 + " b", "é" * 31 + "x", "ab" * 32 + "...", "ab" * 33, "", " ", "word " * 30_000]
    ids, length = table.encode(pa.array(texts))
    want = [[*table.tokenizer.encode(x, add_special_tokens=False).ids, 1] for x in texts]
    assert length.tolist() == list(map(len, want)) and ids.tolist() == [i for x in want for i in x]
    assert table.encode(pa.array([], pa.string()))[0].tolist() == []
    assert sum(n for _, n in packing.steps(pa.array(texts))) == len(texts)


def test_sum_of_squares_is_the_rule():
    rng = np.random.default_rng(4)
    for size in (16, 40):
        lengths = rng.integers(1, size + 1, 400)
        count, n, gaps = {}, 0, []
        to, at = packing.sum_of_squares(lengths, size)
        for s, b, place in zip(lengths.tolist(), to.tolist(), at.tolist()):
            def total(gap):  # the sum of squares of open bins per gap after s goes where the gap is; size: a new bin
                after = dict(count)
                if gap < size:
                    after[gap] -= 1
                if gap > s:
                    after[gap - s] = after.get(gap - s, 0) + 1
                return sum(v * v for g, v in after.items() if g)

            gap = min((total(g), g) for g in [g for g, v in count.items() if v and g >= s] + [size])[1]
            assert place == size - gap and b == (n if gap == size else b) and (gap == size or gaps[b] == gap)
            if gap == size:
                gaps.append(size)
                n += 1
            else:
                count[gap] -= 1
            gaps[b] -= s
            count[gaps[b]] = count.get(gaps[b], 0) + 1


def test_packing(spark, docs):
    path = vocabulary("word_bpe_49k.json")
    p = packing.pack_documents(docs.withColumn("length", F.lit(1)).withColumn("shard", F.lit(1)), path, size=512).toPandas()
    assert p.groupby("sequence_id")["length"].sum().max() <= 512
    o = p.sort_values(["sequence_id", "offset"])
    assert (o.groupby("sequence_id")["length"].cumsum() - o["length"] == o["offset"]).all()
    assert p[p.doc_id == 4]["length"].sum() == 30_001 and p[p.doc_id == 1]["length"].tolist() == [1]
    whole = packing.Whole(path, 1)
    for d, t in {(d, t) for d, t, *_ in ODD}:
        ids = whole.encode(pa.array([t or ""]))[0]
        for r in p[p.doc_id == d].itertuples():
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].astype("<u4")) and r.start == 512 * r.piece
    assert packing.pack_documents(docs.limit(0), path).count() == 0
    same = spark.createDataFrame([(None, None)] * 3000 + [(1, "a b c")] * 3000, "doc_id long, text string")
    got = packing.pack(common.checkpointed(packing.tokenised(same, path, 1, 64)), 64, shard=500).toPandas()
    assert len(got) == 6000 and got["sequence_id"].nunique() <= 1.1 * got["length"].sum() / 64
    assert got.groupby(got["sequence_id"] % 12)["length"].count().max() < 800  # rows that repeat don't meet in one shard
    lengths = np.sort(np.random.default_rng(3).integers(1, 300, 2000))[::-1]
    to, _ = packing.sum_of_squares(lengths, 512)
    assert to.max() + 1 <= 1.01 * lengths.sum() / 512 + 2


def test_quality_and_toxicity(spark, docs):
    good = [(i, "A plain line of words that differ, " + " ".join(f"w{(i * 7 + j) % 97}" for j in range(20 + i % 30)), 1, int(i % 5 == 0)) for i in range(300)]
    rows = [(i, t + (" idiot trash " * 3 if x else ""), q, x) for i, t, q, x in good] + [(1000 + i, "%%% ### $$$ " * (5 + i % 20), 0, 0) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int, toxic int")
    labels = df.select("doc_id", "quality", "toxic").union(df.select("doc_id", "quality", "toxic").limit(3))
    model = quality.train(df.select("doc_id", "text"), labels)
    got = quality.score_documents(df, model, "doc_id", "quality").toPandas()
    assert ((got["score"] >= 0.5) == (got["quality"] == 1)).mean() > 0.98
    marks = toxicity.train(df.select("doc_id", "text"), labels)
    seen = toxicity.score_documents(df, marks, "doc_id", "toxic").toPandas()
    assert ((seen["score"] >= 0.7) == (seen["toxic"] == 1)).mean() > 0.98
    for module, fitted in ((quality, model), (toxicity, marks)):
        odd = module.score_documents(docs.withColumn("score", F.lit("x")).withColumn("text_", F.lit(1)), fitted, "doc_id", "text", "text_", "base", "score").toPandas()
        assert list(odd.columns) == ["doc_id", "text", "text_", "base", "score"]
        assert len(odd) == len(ODD) and odd["score"].between(0, 1).all()
        none = module.train(docs.limit(0), labels.limit(0))
        assert module.score_documents(docs, none, "doc_id").toPandas()["score"].between(0, 1).all()


def test_segments_are_all_maximal():
    rng = np.random.default_rng(5)
    for _ in range(200):
        n = int(rng.integers(1, 30))
        s = np.where(rng.random(n) < 0.4, rng.integers(1, 6, n), -1.0)
        at = np.flatnonzero(s > 0)
        got = {(a, b) for a, b, _ in toxicity.segments(at, s[at], -1.0)}

        def best(lo, hi):  # by definition: the best segment, the shortest of equals, then both sides
            spans = [(s[i : j + 1].sum(), -(j - i), -i, i, j) for i in range(lo, hi) for j in range(i, hi)]
            if not spans or max(spans)[0] <= 0:
                return set()
            *_, i, j = max(spans)
            return {(i, j)} | best(lo, i) | best(j + 1, hi)

        score = lambda found: sorted(s[a : b + 1].sum() for a, b in found)
        assert score(got) == score(best(0, n))


def test_embeddings_against_all_pairs(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(400, 16))
    x = np.concatenate([base, base[:200] + 0.15 * rng.normal(size=(200, 16)), base[:50], np.repeat(base[:1], 300, 0) + 0.05 * rng.normal(size=(300, 16))])
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5001, [0.0] * 16), (5002, [float("nan")] * 16), (5003, [1.0]), (5004, [None] * 16)]
    got = forest.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).toPandas().set_index("vec_id").sort_index()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = (u @ u.T >= 0.9).sum(axis=1) - 1
    assert got.loc[: len(x) - 1, "n_links"].sum() >= 0.97 * links.sum() and (got["n_links"].loc[: len(x) - 1].to_numpy() <= links).all()
    assert (got.loc[5000:, "n_links"] == 0).all() and got.loc[5000:, "kept"].all()
    held, forest.LARGE = forest.LARGE, 40
    try:
        blocks = forest.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).toPandas().set_index("vec_id").sort_index()
    finally:
        forest.LARGE = held
    assert blocks.equals(got)
    assert forest.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_embeddings_of_every_length_and_id_are_indexed(spark, monkeypatch):
    """Vectors of other lengths than most link among themselves, with a forest or without one; so do rows of one vec_id."""
    rng = np.random.default_rng(8)
    many = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(300, 64)))]
    few = [(1000, [1.0, 2.0]), (1001, [1.0, 2.0]), (1002, [2.0, 4.0]), (1003, [2.0, -1.0]), (1004, [1.0, 2.0, 0.0])]
    base = rng.normal(size=(260, 12))
    other = [(2000 + i, v.tolist()) for i, v in enumerate(np.concatenate([base, base + 0.05 * rng.normal(size=base.shape)]))]
    for limit in (64, 1, 0):
        monkeypatch.setattr(forest, "FORESTS", limit)
        got = {r.vec_id: r for r in forest.near_duplicates(spark.createDataFrame(many + few + other, "vec_id long, embedding array<double>")).collect()}
        assert [(got[i].n_links, got[i].component_id) for i in range(1000, 1005)] == [(2, 1000), (2, 1000), (2, 1000), (0, 1003), (0, 1004)]
        assert sum(got[2260 + i].component_id == 2000 + i for i in range(260)) >= 250 and not any(got[i].n_links for i in range(300))
    monkeypatch.undo()
    base = rng.normal(size=(20_000, 8))
    x = np.concatenate([base, base[:5000] * 2])
    one = forest.near_duplicates(spark.createDataFrame([(7, v.tolist()) for v in x], "vec_id long, embedding array<double>"))
    found = one.agg(F.sum("n_links").alias("n"), F.count("*").alias("rows"), F.bool_and("kept").alias("kept")).first()
    assert found.n >= 10_000 and found.rows == 25_000 and found.kept


def test_forest_recall_on_clustered_vectors(spark):
    """Vectors about some hundred centres, in directions of unlike spread: recall of pairs at 0.9 and more."""
    rng = np.random.default_rng(10)
    spread = np.exp(-np.arange(48) / 12)
    x = (rng.normal(size=(150, 48)) * spread)[rng.integers(0, 150, 6000)] + 0.25 * rng.normal(size=(6000, 48)) * spread
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = (u @ u.T >= 0.9).sum(axis=1) - 1
    got = forest.near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).toPandas().sort_values("vec_id")["n_links"].to_numpy()
    print("recall", got.sum() / links.sum())
    assert (got <= links).all() and got.sum() >= 0.95 * links.sum()


def test_forest_recall_holds_as_tables_grow():
    rng = np.random.default_rng(9)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    sample, u, w = (unit(rng.normal(size=(n, 64))) for n in (forest.SAMPLE, 3000, 3000))
    v = 0.9 * u + (1 - 0.9**2) ** 0.5 * unit(w - (w * u).sum(axis=1, keepdims=True) * u)
    for n in (20_000, 2_000_000, 20_000_000, 200_000_000):
        trees = forest.fit(sample, n)
        a, b = (trees.leaves(x).reshape(len(u), -1, 4) for x in (u, v))
        met = ((a[:, :, :, None] == b[:, :, None, :]) & (a[:, :, :, None] >= 0)).any(axis=(2, 3))
        assert met.any(axis=1).mean() > 0.93
        assert abs(met.mean() - forest.tree_recall(trees.depth, 0.9)) < 0.03 and trees.low.size + trees.high.size < 1e5
        branch = trees.branches(a)
        assert (branch >= 0).sum() == (a >= 0).sum() and max(len(set(x[x >= 0].tolist())) for x in branch.reshape(len(u), -1)[:50]) <= 4 * len(trees.directions)


def test_lookups_of_hot_keys_are_joins(spark):
    rows = common.checkpointed(spark.range(6000).select(F.when(F.col("id") < 4000, 7).otherwise(F.col("id")).alias("k"), "id"))
    table = spark.range(5000).select(F.col("id").alias("k"), (2 * F.col("id")).alias("v"))
    assert [r.k for r in common.hot_keys(rows, "k").collect()] == [7]
    got = {r.id: r.v for r in common.looked_up(rows, "k", table).collect()}
    assert got == {i: 14 if i < 4000 else 2 * i if i < 5000 else None for i in range(6000)}
    assert {r.id: r.v for r in common.looked_up(rows, "k", table.where("k <> 7")).collect()} == {i: v if v != 14 else None for i, v in got.items()}


def test_simhash_against_all_pairs(spark, docs):
    rng = random.Random(8)
    fps = [rng.getrandbits(64) for _ in range(300)]
    fps += [f ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 6))) for f in fps for _ in range(3)]
    f = np.array(fps, np.uint64)
    links = simhash.near_links(spark.createDataFrame([(x,) for x in f.view(np.int64).tolist()], "fp long").distinct(), len(f)).collect()
    a, b = np.nonzero(np.triu(np.bitwise_count(f[:, None] ^ f[None, :]) <= 4, 1))
    whole, found, at = common.Union(len(f)), common.Union(len(f)), {int(v): i for i, v in enumerate(f.view(np.int64))}
    whole.link(a, b)
    found.link(np.array([at[r.a] for r in links]), np.array([at[r.b] for r in links]))
    assert (whole.root == found.root).all()
    held, simhash.CROWD = simhash.CROWD, 3
    try:
        blocks = simhash.near_links(spark.createDataFrame([(x,) for x in f.view(np.int64).tolist()], "fp long").distinct(), len(f)).collect()
    finally:
        simhash.CROWD = held
    found = common.Union(len(f))
    found.link(np.array([at[r.a] for r in blocks]), np.array([at[r.b] for r in blocks]))
    assert (whole.root == found.root).all()
    got = sorted((r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == [(1, 1), (2, 1), (3, 3), (4, 4), (5, 3), (5, 3)]
    odd = spark.createDataFrame([(5, "one two", 1), (5, "three four five", 2), (5, "three four five", 2), (None, "six", 3), (None, "six", 3), (6, "ONE two", 1), (None, None, 4), (None, "", 4)], "doc_id long, text string, _group int")
    kept = simhash.representatives(odd).collect()
    assert sorted(r._group for r in kept) == [1, 2, 3, 4] and [r.doc_id for r in kept if r._group == 1] == [5] and set(kept[0].asDict()) == {"doc_id", "text", "_group"}
    assert simhash.representatives(odd.limit(0)).count() == 0
    assert simhash.fingerprint("a b") == simhash.fingerprint("A  b") != 0 and simhash.near_duplicates(docs.limit(0)).count() == 0


def test_simhash_buckets_without_an_own_member_are_not_sent(spark):
    """20,000 fingerprints that share two segments but for a bit that each has set beyond: their common buckets are nobody's own."""
    rng = np.random.default_rng(12)
    low = (np.uint64(1 << 13) - np.uint64(1)) << np.uint64(13) | np.uint64(1234)  # segments 0 and 1, all of the second one's bits set
    fps = np.unique(rng.integers(0, 1 << 38, 20_000, dtype=np.uint64) << np.uint64(26) | low)
    fps = np.concatenate([fps, fps[:50] ^ np.uint64(0b111 << 40)])
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long").distinct()
    keys, all_keys = simhash.keyed(df), len(simhash.chain_keys(np.unique(fps))[0])
    size = keys.groupBy("bucket").agg(F.count("*").alias("n"), F.bool_or("own").alias("any")).cache()
    assert size.where("not any").agg(F.sum("n")).first()[0] < 0.1 * all_keys and keys.count() < 0.3 * all_keys
    dealt = simhash.crowded(keys).groupBy("bucket", "one", "two").agg(F.count("*").alias("n"), F.bool_or("own").alias("any"))
    assert dealt.where("any").agg(F.max("n")).first()[0] <= simhash.CROWD * 1.1
    links = simhash.near_links(df, len(fps)).collect()
    f = np.unique(fps)
    a, b = zip(*((i, j) for i in range(0, len(f), 2000) for i, j in np.argwhere(np.triu(np.bitwise_count(f[i : i + 2000, None] ^ f[None, :]) <= 4, i + 1)) + [i, 0]))
    whole, found, at = common.Union(len(f)), common.Union(len(f)), {int(v): i for i, v in enumerate(f.view(np.int64))}
    whole.link(np.array(a), np.array(b))
    found.link(np.array([at[r.a] for r in links]), np.array([at[r.b] for r in links]))
    assert (whole.root == found.root).all()


def test_a_labelled_id_counts_once(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in (2, 3, 5)] + [(2, "copy")] * 500 + [(3, None)] * 9 + [(None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(2, 1), (3, 0), (5, 1), (5, 0), (None, 1), (2, 1)], "doc_id long, quality int")
    held = {r.i for r in spark.range(10).select(F.col("id").alias("i")).where(common.held_out("i")).collect()}
    got = sorted((r.text, r.label) for r in common.labelled_sample(docs, labels, "quality", 100).collect())
    assert got == sorted((t, y) for i, t, y in ((2, "copy", 1), (3, "text 3", 0)) if i not in held)
