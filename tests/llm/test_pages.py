"""Operators on pages, conversations and vectors, and the pipeline."""

import base64
import hashlib
import io
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rewindle.llm import chat, html, neighbours, quality, simhash, warc
from rewindle.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


# ---- archives
def test_every_split_yields_each_record_once():
    data = b"".join(warc.record(i, "u\n", b"WARC/1.1 \x1f\x8b\x08" + b"x" * i * 90, None, False) for i in range(40)) + warc.record(None, None, b"", 3, True)
    for size in (1, 97, 5000, 10**7):
        got = [f.get("Page-ID") for k in range(0, len(data), size) for f, _ in warc.records_in(io.BytesIO(data), k, min(k + size, len(data)), step=300)]
        assert got == [*map(str, range(40)), None]


def test_archives_round_trip(spark):
    rows = [(i, f"http://h/{i}", f"<p>{i % 7}</p>") for i in range(40)]
    rows += [(50, None, None), (51, "u", ""), (None, "u", "lone"), (None, "u", "<p>3</p>"), (60, "u", "z" * 3_000_000), (39, "http://h/39", "<p>4</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"id": F.lit(1), "first": F.lit(2), "sha": F.lit("x")})
    for smallest in (0, 9):
        want = Counter()
        groups = defaultdict(list)
        for i, _, h in rows:
            groups[h or ""].append(i)
        for h, ids in groups.items():
            top = max((i for i in ids if i is not None), default=None)
            digest = base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()
            for i in ids:
                first = i == top or len(h) < smallest
                want[i, len(h), digest, "response" if first else "revisit", None if first else top] += 1
        got = warc.read(warc.write(df.repartition(3), smallest), split=700).select("id", "payload_bytes", "payload_digest", "record_type", "refers_to")
        assert Counter(map(tuple, got.collect())) == want
    assert warc.read(warc.write(df.limit(0))).count() == 0


# ---- main text
def test_structure_decides_first():
    page = (
        '<body><nav><a>Home</a></nav><article class="post"><h1>T &amp; x</h1><p><b>one<br>two  three<p>a &lt; b'
        '<div class="cookie-notice">c</div><aside>s</aside><form>f</form><script>if (a<b) "</p>"</script>'
        '<section id=comments>cc</section><a href="x>y">in</a> line</article><footer>&copy;</footer>'
    )
    assert html.divided(page)[0] == "T & x\none two three\na < b\nin line"
    assert html.divided("")[0] is None and html.divided("<")[1] == [(True, "<")]
    assert html.divided('<main>m <header>h</header></main><p title="never closed>x')[0] == "m"


def test_labels_do_not_drop_whole_articles():
    wrapped = '<div class="layout has-sidebar"><header>h</header><article><p>one<div class="share">s</div><p>two</article><div class="sidebar">x</div></div>'
    assert html.divided(wrapped)[0] == "one\ntwo"
    assert html.divided('<div id="header-and-content"><main>m text<div class="sidebar">x</div></main></div>')[0] == "m text"
    comment = '<article class="comment">c</article>'
    assert html.divided(f"<main>body</main>{comment}")[0] == "body"
    assert html.divided(f"<div>body</div>{comment}") == (None, [(True, "body"), (False, "c")])
    assert html.divided("<main>body</main><div id=comments><article>longer than the body</article></div>")[0] == "body"


def test_host_stream_keeps_unique_runs(spark):
    menu = " ".join(f"m{i}" for i in range(30))
    pages = [(i, f"http://a.example/{i}", f"<div>{menu}</div><p>{i} own text of the page</p>") for i in range(6)]
    pages += [(7, "http://b.example/", f"<div>{menu}</div>"), (8, None, None), (9, "x", ""), (0, *pages[0][1:])]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({"host": F.lit(1), "part": F.lit(1)})
    got = Counter(map(tuple, html.extracted(df).select("page_id", "text").collect()))
    assert got == Counter([(i, f"{i} own text of the page") for i in range(6)] + [(0, "0 own text of the page"), (7, menu), (8, ""), (9, "")])
    assert html.extracted(df.limit(0)).count() == 0


def test_the_article_is_the_outermost_region_with_most_text():
    assert html.divided('<main><p>a long text</p><article class="card"><p>teaser</p></article></main>')[0] == "a long text\nteaser"
    assert html.divided("<main><p>by line</p><article><p>the longer article</p></article></main>")[0] == "the longer article"
    assert html.divided("<article><header><h1>Title</h1></header><p>text</p><footer>f</footer></article>")[0] == "Title\ntext"
    assert html.divided('<article><header class="nav"><a>x</a></header><p>text</p></article><header>h</header>')[0] == "text"


def plain_main_texts(pages, run):
    """Every pair of different streams of a host compared, stretch by stretch."""
    parts = {k: html.divided(h or "") for k, (_, _, h) in enumerate(pages)}
    hosts = {k: (u or "").split("/")[2].lower() if "://" in (u or "") else "" for k, (_, u, _) in enumerate(pages)}
    streams = {k: [t for _, b in others for t in b.split()] for k, (_, others) in parts.items()}
    grams = {k: {tuple(s[i : i + run]) for i in range(len(s) - run + 1)} for k, s in streams.items()}
    out = []
    for k, (i, u, _) in enumerate(pages):
        article, others = parts[k]
        if article is None:
            seen = set().union(*(grams[j] for j in parts if hosts[j] == hosts[k] and streams[j] != streams[k]))
            flags = [False] * len(streams[k])
            for a in range(len(streams[k]) - run + 1):
                if tuple(streams[k][a : a + run]) in seen:
                    flags[a : a + run] = [True] * run
            kept, at = [], 0
            for keep, block in others:
                tokens = block.split()
                left = [t for t, f in zip(tokens, flags[at : at + len(tokens)], strict=True) if not f]
                at += len(tokens)
                kept += [" ".join(left)] if keep and left else []
            article = "\n".join(kept)
        out.append((i, u, article))
    return Counter(out)


@pytest.mark.parametrize("parts", [1, 7])
def test_main_texts_equal_a_plain_version_for_any_layout(spark, parts):
    pick = random.Random(2)
    banner = [" ".join(f"b{j}w{i}" for i in range(40)) for j in range(3)]
    pages = []
    for i in range(120):
        body = "".join(f"<p>{' '.join(pick.choice('abc') for _ in range(pick.randrange(1, 60)))}</p>" for _ in range(3))
        shared = pick.choice(banner) if pick.random() < 0.2 else ""
        page = f"<div>{shared}</div>{body}<footer>{pick.choice(banner)}</footer>"
        pages.append((i, pick.choice(["http://A.example/x", "http://b.example/y", None]), f"<article>{page}</article>" if pick.random() < 0.2 else page))
    pages += [pages[0], pages[1], (200, "http://b.example/", "<p>" + "very long " * 30_000 + "</p>"), (201, None, None), (None, "http://b.example/", "<p>no id</p>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({"rid": F.lit(1), "at": F.lit("x"), "article": F.lit(2)}).repartition(parts)
    assert Counter(map(tuple, html.extracted(df).collect())) == plain_main_texts(pages, html.RUN)


def test_boilerplate_of_few_pages_of_a_large_host(spark):
    notice = " ".join(f"n{i}" for i in range(30))
    rows = spark.range(3000).select(
        F.col("id").alias("page_id"),
        F.concat(F.lit("http://hot.example/"), "id").alias("url"),
        F.concat(F.lit("<p>"), F.lit("own "), F.col("id").cast("string"), F.lit("</p>"), F.when(F.col("id") % 75 == 0, f"<p>{notice}</p>").otherwise("")).alias("html"),
    )
    got = html.extracted(rows.repartition(16)).agg(F.count("*"), F.count_if(F.col("text") == F.concat(F.lit("own "), "page_id"))).first()
    assert tuple(got) == (3000, 3000)


def test_the_host_decides_which_reading_is_the_article(spark):
    notice = " ".join(f"n{i}" for i in range(40))
    own = lambda i, n=8: " ".join(f"w{i}x{j}" for j in range(n))
    forms = {
        "a": lambda i: f"<main><p>{notice}</p><article><p>{own(i)}</p></article></main>",
        "b": lambda i: f"<div class='has-sidebar'><article><p>{own(i)}</p></article></div><p>{notice}</p>",
        "c": lambda i: f"<div><p>{own(i, 60)}</p></div><article><p>{notice}</p></article>",
    }
    rows = [(i, f"http://{h}.example/{i}", form(i)) for h, form in forms.items() for i in range(4)]
    rows += [(9, f"http://lone-{h}.example/", form(9)) for h, form in forms.items()] + rows[:2]
    rows += [(20 + i, "http://d.example/", f"<article><p>{notice}</p></article><p>{own(i, 20)}</p>") for i in range(3)]  # not outweighed: it stays
    got = Counter(map(tuple, html.extracted(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()))
    by_host = lambda h, i: own(i, 60) if h == "c" else own(i)
    want = [(i, f"http://{h}.example/{i}", by_host(h, i)) for h in forms for i in range(4)]
    want += [(9, "http://lone-a.example/", f"{notice}\n{own(9)}"), (9, "http://lone-b.example/", notice), (9, "http://lone-c.example/", notice)]
    want += want[:2] + [(20 + i, "http://d.example/", notice) for i in range(3)]
    assert got == Counter(want)


def plain_readings(pages, run):
    """As ``plain_main_texts``; marked pages with several readings are weighed against every page of the host, whole."""
    out = []
    cut = {k: html.blocks(h or "") for k, (_, _, h) in enumerate(pages)}
    own = {k: html.chosen(b) for k, b in cut.items()}
    split = {k: [[t for (x, _, _), o in zip(b, own[k] or [False] * len(b), strict=True) if o == side for t in x.split()] for side in (False, True)] for k, b in cut.items()}
    grams = {k: {tuple(s[i : i + run]) for s in both for i in range(len(s) - run + 1)} for k, both in split.items()}
    plain = iter(sorted(plain_main_texts([(k, u, h) for k, (_, u, h) in enumerate(pages)], run)))
    for k, (i, u, _) in enumerate(pages):
        text = next(plain)[2]
        if html.readings(cut[k]) > 1:
            seen = set().union(*(grams[j] for j in cut if pages[j][1] == u and split[j] != split[k]))
            flags = []
            for s in split[k]:
                flags.append([any(tuple(s[a : a + run]) in seen for a in range(max(0, t - run + 1), min(t, len(s) - run) + 1)) for t in range(len(s))])
            at, left = [0, 0], []
            for (x, _, _), o in zip(cut[k], own[k] or [False] * len(cut[k]), strict=True):
                n = len(x.split())
                left.append(" ".join(t for t, f in zip(x.split(), flags[o][at[o] : at[o] + n], strict=True) if not f))
                at[o] += n
            now = html.chosen(cut[k], [len(x) - len(y) for (x, _, _), y in zip(cut[k], left, strict=True)])
            if now is None and own[k] is not None:
                text = "\n".join(y for (_, out_, _), y in zip(cut[k], left, strict=True) if not out_ and y)
            elif now is not None:
                text = "\n".join(x for (x, _, _), o in zip(cut[k], now, strict=True) if o)
        out.append((i, u, text))
    return Counter(out)


@pytest.mark.parametrize("parts", [1, 7])
def test_readings_equal_a_plain_version_for_any_layout(spark, parts, monkeypatch):
    monkeypatch.setattr(html, "HELD", 500)
    pick = random.Random(4)
    shared = [" ".join(f"s{j}w{i}" for i in range(pick.randrange(10, 60))) for j in range(4)]
    text = lambda: "".join(f"<p>{pick.choice(shared) if pick.random() < 0.6 else ' '.join(pick.choice('abcdefg') for _ in range(pick.randrange(1, 50)))}</p>" for _ in range(pick.randrange(3)))
    forms = ["{0}<main>{1}<article>{2}</article>{3}</main>", "<div class=sidebar>{0}<article>{1}</article></div>{2}", "{0}<article>{1}</article><article>{2}</article>{3}", "{0}{1}<footer>{2}</footer>", "<nav>{0}</nav><article>{1}</article>"]
    pages = [(i, pick.choice(["http://a.example/x", "http://b.example/y", None]), pick.choice(forms).format(*(text() for _ in range(4)))) for i in range(150)]
    pages += [pages[0], pages[3], (None, *pages[5][1:]), (200, None, None)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({"several": F.lit(1), "bare": F.lit(1), "open": F.lit(2), "blocks": F.lit("b")}).repartition(parts)
    want = plain_readings(pages, html.RUN)
    assert Counter(map(tuple, html.extracted(df).collect())) == want
    assert sum((plain_main_texts(pages, html.RUN) - want).values()) >= 10  # marked pages whose host's streams overrule the structure


@pytest.mark.parametrize(("parts", "held"), [(1, 512), (7, 512), (7, 5)])
def test_words_that_other_pages_hold_are_counted_for_every_page(spark, parts, held, monkeypatch):
    monkeypatch.setattr(html, "PAGES", held)
    pick, run = random.Random(6), html.RUN
    passages = [" ".join(f"s{j}w{i}" for i in range(pick.randrange(12, 90))) for j in range(6)]
    pages = []
    for i in range(140):
        text = " ".join(pick.choice(passages) if pick.random() < 0.3 else " ".join(f"p{i}w{k}x{j}" for j in range(pick.randrange(1, 30))) for k in range(4))
        page = f"<nav>{passages[0]}</nav>" + (f"<article>{text}</article>" if i % 5 else f"<p>{text}</p>")
        pages.append((i, pick.choice(["http://a.example/x", "http://b.example/y", None]), page))
    pages += [pages[1], (300, None, None), (301, "http://c.example/", f"<article>{passages[1]}</article>"), (302, "http://d.example/", f"<article>{passages[2]} {passages[2]}</article>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("n_repeated", F.lit(-1)).repartition(parts)
    got = sorted(((r["page_id"], r["n_repeated"], r["text"]) for r in html.extracted(df, shared_words=True).collect()))
    assert Counter((i, t) for i, _, t in got) == Counter((i, t) for i, _, t in plain_main_texts(pages, run).elements())
    streams = [[[t for _, b in others for t in b.split()], (article or "").split()] for article, others in (html.divided(h or "") for _, _, h in pages)]
    on = defaultdict(set)
    for k, (_, u, _) in enumerate(pages):
        for s in streams[k]:
            for a in range(len(s) - run + 1):
                on[u, tuple(s[a : a + run])].add(k)
    bounds, runs = [], 0
    for k, (i, u, _) in enumerate(pages):
        s = streams[k][1] or streams[k][0]
        flags = [len(on[u, tuple(s[a : a + run])]) > 1 for a in range(len(s) - run + 1)]
        most, least = sum(any(flags[max(0, a - run + 1) : a + 1]) for a in range(len(s))), 0
        for size in map(len, "".join("01"[f] for f in flags).split("0")):
            least += max(0, size - 2 * html.EVERY + 2)
        bounds.append((i, least, most))
        runs += least > 0
    assert runs > 50 and all(i == j and least <= n <= most for (i, n, _), (j, least, most) in zip(got, sorted(bounds), strict=True))
    assert [n for i, n, _ in got if i in (300, 301, 302)] == [0, 0, 0]
    assert html.extracted(df.limit(0), shared_words=True).count() == 0


@pytest.mark.parametrize(("parts", "held"), [(1, 512), (7, 5)])
def test_every_word_that_starts_a_repeated_stretch_counts(spark, parts, held, monkeypatch):
    monkeypatch.setattr(html, "PAGES", held)
    pick, run = random.Random(8), html.RUN
    passages = [" ".join(f"s{j}w{i}" for i in range(run + j % 5 - 1)) for j in range(12)]  # 15 to 19 words
    text = lambda i: " ".join(pick.choice(passages) if pick.random() < 0.3 else " ".join(f"p{i}w{k}x{j}" for j in range(pick.randrange(1, 9))) for k in range(5))
    pages = [(i, pick.choice(["http://a.example/x", "http://b.example/y", None]), f"<nav>{text(i)}</nav>" + (f"<article>{text(-i)}</article>" if i % 5 else f"<p>{text(-i)}</p>")) for i in range(160)]
    pages += [pages[1], pages[3], (300, "http://c.example/", f"<article>{passages[2]} {passages[2]}</article>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(parts)
    on, want = defaultdict(set), Counter()
    streams = [[[t for _, b in others for t in b.split()], (article or "").split()] for article, others in (html.divided(h) for _, _, h in pages)]
    for k, (_, u, _) in enumerate(pages):
        for s in streams[k]:
            for a in range(len(s) - run + 1):
                on[u, tuple(s[a : a + run])].add(k)
    for k, (i, u, _) in enumerate(pages):
        s = streams[k][1] or streams[k][0]
        want[i, sum(len(on[u, tuple(s[a : a + run])]) > 1 for a in range(len(s) - run + 1))] += 1
    assert Counter((r["page_id"], r["n_repeated"]) for r in html.extracted(df, shared_words=True).collect()) == want
    assert sum(n for _, n in want) > 100


def test_a_full_filter_lets_more_through_and_counts_the_same():
    pick = random.Random(9)
    passages = [" ".join(f"s{j}w{i}" for i in range(15 + j)).split() for j in range(6)]
    pages = [(pick.choice("ab"), pick.choice(passages) + [f"x{k}"], [f"p{k}w{i}" for i in range(20)] + pick.choice(passages)) for k in range(30)] + [("", [], [])]
    bucket, longs = html.sown(pages, 6)
    none = [np.packbits(np.zeros(html.FILTER, bool))] * 64
    for b in np.unique(bucket):
        found = pa.array([longs[bucket == b].tolist()], pa.list_(pa.int64()))
        none[b] = np.frombuffer(html.met(pa.table({"bucket": [int(b)], "found": found}))["marks"][0].as_py(), np.uint8)
    few, full = html.passed(pages, 6, np.array(none)), html.passed(pages, 6, np.full((64, html.FILTER // 8), 255, np.uint8))
    assert few[0].tolist() == full[0].tolist() and few[0].sum() > 30
    assert set(zip(few[1].tolist(), few[2].tolist())) < set(zip(full[1].tolist(), full[2].tolist()))


def test_repeats_equal_a_plain_search():
    pick = random.Random(0)
    for _ in range(200):
        streams = [[pick.choice("ab") for _ in range(pick.randrange(25))] for _ in range(pick.randrange(5))]
        one, two, low, high = html.stretches(streams, 5)
        several = {(a, b) for a, b, x, y in zip(one, two, low, high, strict=True) if x < y}
        at = [[i for i, key in enumerate(zip(*html.starts(s, 5), strict=True)) if key in several] for s in streams]
        for k, (own, got) in enumerate(zip(streams, [html.covered(len(s), a, 5) for s, a in zip(streams, at, strict=True)], strict=True)):
            want = [False] * len(own)
            others = {tuple(s[i : i + 5]) for j, s in enumerate(streams) if s != own and j != k for i in range(len(s) - 4)}
            for i in range(len(own) - 4):
                if tuple(own[i : i + 5]) in others:
                    want[i : i + 5] = [True] * 5
            assert got.tolist() == want


# ---- conversations
def test_any_text_reads_back():
    pick = random.Random(3)
    parts = ["a", "\\", "<s>", "</s>", "[INST]", " [/INST]", "[/TURN]", " </s>", "[TURN x]", "[SYS+] ", "\n", " ", "+]", "[", "]", "</"]
    for _ in range(20_000):
        text, role = "".join(pick.choice(parts) for _ in range(pick.randrange(9))), pick.choice(["user", "assistant", "system", "", "tool", "a] b+", "%41;"])
        shown = chat.turn_text(role, text)
        back = chat.parse_turn(shown + chat.render("user", "x"))
        assert (back.role, back.text, back.end) == (role, text, len(shown))


def test_conversations_digest(spark):
    rows = [(1, 1, "assistant", "b </s> \\"), (1, 0, "user", None), (2, None, None, "x"), (2, 0, "assistant", "y"), (None, 3, "tool", ""), (1, 1, "assistant", "b </s> \\"), (3, 0, "user", "q" * 200_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"conv": F.lit(1), "shown": F.lit("s")})
    got = {r["conv"]: r for r in chat.read_back(chat.rendered(df)).collect()}
    for conv in (1, 2, 3, None):
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0))
        turns = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in own)
        loss = "".join(t or "" for _, _, r, t in own if r == "assistant")
        row = got[conv]
        assert (row["n_turns"], row["turns_sha256"]) == (len(own), hashlib.sha256(turns.encode()).hexdigest())
        assert (row["loss_chars"], row["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.read_back(chat.rendered(df.limit(0))).count() == 0


# ---- neighbours
def brute(ids, x, top=20, every=20):
    out = {}
    for k, i in enumerate(ids):
        if i % every == 0:
            s = x @ x[k]
            out[i] = [int(ids[j]) for j in sorted((j for j in range(len(ids)) if j != k), key=lambda j: (-s[j], ids[j]))[:top]]
    return out


def test_search_reaches_nine_tenths(spark):
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(700, 24)) * rng.uniform(0.3, 2, (700, 1)), 3).astype(np.float32).astype(float)
    x[100:160] = x[100]  # one vector many times
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    bad = [(2000, None), (2020, [0.0] * 24), (2040, [float("nan")] * 24), (2060, [1.0, None] * 12), (2080, [1.0] * 3), (2100, [float("inf")] * 24), (None, [1.0] * 24), (0, rows[0][1])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").withColumns({"node": F.lit(1), "q": F.lit(1), "code": F.lit(0)})
    small = neighbours.Settings(degree=16, block=100, rounds=2, width=16, steps=5, pool=120, entries=8)
    got = defaultdict(list)
    for r in neighbours.searched(df, settings=small).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    want = brute(range(700), x)
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    assert np.mean([len({i for i, _ in got[q]} & set(want[q])) / 20 for q in want]) >= 0.9
    assert [i for i, _ in got[120]][:19] == [i for i in range(100, 120)][:19]
    for q, own in got.items():
        assert np.allclose([s for _, s in own], x[[i for i, _ in own]] @ x[q], atol=1e-9) and own == sorted(own, key=lambda o: (-o[1], o[0]))


def test_shipped_settings_reach_nine_tenths_with_mixed_norms(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 48))[rng.integers(0, 60, 4000)] + 0.6 * rng.normal(size=(4000, 48))
    x = np.round(x / np.linalg.norm(x, axis=1, keepdims=True) * np.exp(rng.normal(0, 1.2, (4000, 1))), 4)
    df = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>")
    got = defaultdict(set)
    for r in neighbours.searched(df).collect():
        got[r["query_id"]].add(r["vec_id"])
    want = brute(range(4000), x)
    assert set(got) == set(want)
    assert np.mean([len(got[q] & set(want[q])) / 20 for q in want]) >= 0.9


def test_few_vectors_give_all_candidates(spark):
    df = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(5)], "vec_id long, embedding array<double>")
    assert [tuple(r)[:3] for r in neighbours.searched(df).orderBy("rank").collect()] == [(0, k, k) for k in range(1, 5)]
    assert neighbours.searched(df.limit(0)).count() == 0


# ---- pipeline
def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    names, frames = [n for n, _ in corpus_pipeline.STAGES], [docs]
    for _, stage in corpus_pipeline.STAGES:
        frames.append(stage(spark, frames[-1], FOLDER).cache())
    assert names == ["quality_rules", "near_duplicates", "personal_data", "best_fit_packing"]
    assert all(f.schema == docs.schema for f in frames[1:4])
    ids = [Counter(r[0] for r in f.select("doc_id").collect()) for f in frames]
    assert set(ids[1]) == {r[0] for r in quality.judged(docs.select("doc_id", "text")).where("kept").select("doc_id").collect()}
    assert set(ids[2]) == {r[0] for r in simhash.classes(frames[1]).select("component_id").collect()} and max(ids[2].values()) == 1
    assert ids[2] == ids[3] and set(ids[3]) == set(ids[4])
    assert frames[3].where("n_chars <> length(text) OR text RLIKE '@mail[0-9]'").count() == 0


@pytest.mark.parametrize("name", ["op2_warc", "op3_chat_format", "op6_html_text", "op9_minimax_shards"])
def test_queries_return_a_row_for_each_of_the_table(spark, name):
    tables = {"op2_warc": ("pages", 0), "op3_chat_format": ("conversations", 1), "op6_html_text": ("pages", 0), "op9_minimax_shards": ("documents", 0)}
    table, more = tables[name]
    source = spark.read.parquet(f"{FOLDER}/{table}.parquet")
    n = source.select("conv_id").distinct().count() if table == "conversations" else source.count()
    assert QUERIES[name](spark, FOLDER).count() == n + more
