"""Hard negatives, URL filter and Merkle manifest against plain versions."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rewindle.llm import chat, merkle, negatives, order, pii, sharding, urls


def brute_negatives(rows, anchor, rules):
    usual = {}
    fine = []
    for i, label, v in rows:
        if None in (i, label, v) or any(x is None or not math.isfinite(x) for x in v):
            continue
        usual[len(v)] = usual.get(len(v), 0) + 1
        fine.append((i, label, [math.floor(256 * x) for x in v]))
    size = min(usual, key=lambda n: (-usual[n], n)) if usual else 0
    kept = {}
    for i, label, v in fine:
        if len(v) == size:
            kept[i] = min(kept.get(i, (label, v)), (label, v))
    out = []
    for a, (label, v) in kept.items():
        if not anchor(a):
            continue
        score = {i: sum(x * y for x, y in zip(v, w[1])) for i, w in kept.items() if i != a}
        best = lambda some, most: sorted(some, key=lambda i: (-score[i], i))[:most]
        for p in best([i for i in score if kept[i][0] == label], rules.positives):
            fit = [i for i in score if kept[i][0] != label and rules.low * score[p] <= 100 * score[i] <= rules.high * score[p]]
            out += [(a, p, r + 1, i, score[p], score[i]) for r, i in enumerate(best(fit, rules.negatives))]
    return sorted(out)


SCHEMA = "vec_id long, label int, embedding array<double>, id string, ints string, lane int, score double"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1, 0.5) for r in rows], SCHEMA).repartition(3)


def hard_vectors(seed, n=300, size=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, size))
    rows = []
    for i in range(n):
        v = (centres[i % 5] + rng.normal(size=size) * 0.3) * rng.lognormal(0, 0.5)
        rows.append((i, int(rng.integers(0, 4)), v.tolist()))
    rows += [(1000 + i, 1, rows[7][2]) for i in range(40)]  # one vector many times
    rows += [(None, 1, rows[0][2]), (2000, None, rows[0][2]), (2001, 1, None), (2002, 1, [None] + rows[0][2][1:])]
    rows += [(2003, 1, [float("nan")] * size), (2004, 1, [float("inf")] * size), (2005, 1, [1.0]), (2006, 2, [0.0] * size)]
    rows += [(20, 3, rows[3][2]), (20, 0, rows[4][2]), rows[30], rows[30], (2010, 2, [-x for x in rows[0][2]])]
    return rows


@pytest.mark.parametrize(("seed", "rules"), [(0, negatives.Rules()), (1, negatives.Rules(2, 3, -50, 120))])
def test_negatives_equal_brute_force(spark, rows, monkeypatch, seed, rules):
    monkeypatch.setattr(negatives, "BLOCK", 7)
    data = hard_vectors(seed)
    got = negatives.mined(vectors(spark, data), F.col("id") % 10 == 0, rules)
    assert rows(got) == sorted(brute_negatives(data, lambda i: i % 10 == 0, rules), key=repr)


def test_negatives_of_few_and_of_none(spark, rows):
    assert rows(negatives.mined(vectors(spark, []).limit(0), F.col("id") % 10 == 0)) == []
    alone = [(0, 1, [1.0, 0.5]), (1, 2, [0.5, 0.25])]
    assert rows(negatives.mined(vectors(spark, alone), F.col("id") == 0)) == []  # no positive
    more = [*alone, (2, 1, [1.0, 0.5]), (3, 2, [0.6, 0.3])]
    assert rows(negatives.mined(vectors(spark, more), F.col("id") == 0)) == brute_negatives(more, lambda i: i == 0, negatives.Rules())


def test_negatives_of_large_numbers(spark, rows):
    data = [(i, i % 2, [float(3 ** (i % 7)) * 1e4, -1e6 * (i % 3), 12345.678 * i]) for i in range(60)]
    got = negatives.mined(vectors(spark, data), F.col("id") % 10 == 0)
    assert rows(got) == sorted(brute_negatives(data, lambda i: i % 10 == 0, negatives.Rules()), key=repr)


def test_spanning_tree_is_shortest_and_bounds_spare_scores():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 5))
    place, parent, edge = negatives.spanning(x)
    assert sorted(place) == list(range(40)) and all(parent[k] < k for k in range(1, 40)) and parent[0] == -1
    for k in range(1, 40):
        assert edge[k] == pytest.approx(np.linalg.norm(x[place[k]] - x[place[parent[k]]]))
    links = sorted((np.linalg.norm(x[a] - x[b]), a, b) for a in range(40) for b in range(a))
    part, total = list(range(40)), 0.0
    for far, a, b in links:
        if part[a] != part[b]:
            total += far
            part = [part[a] if p == part[b] else p for p in part]
    assert edge.sum() == pytest.approx(total)
    # Anchors that lie near each other need few of the rows scored.
    near = np.rint(1000 + rng.normal(size=(30, 5)) * 3).astype(int)
    place, parent, edge = negatives.spanning(near)
    lane = negatives.Lane(np.arange(5000), np.zeros(5000, int), np.rint(rng.normal(size=(5000, 5)) * 100).astype(int))
    best = [negatives.Anchor(-1 - k, 0, near[i], parent[k], edge[k], [negatives.Best(5, -np.inf, np.inf)]) for k, i in enumerate(place)]
    assert negatives.search(lane, best, same=True) < 0.4 * 30 * 5000


RULES = (
    urls.Rule("block", "net"),
    urls.Rule("allow", "example.net", "/en/"),
    urls.Rule("block", "example.com", "/de/"),
    urls.Rule("allow", "org", "/fr/"),
)

URLS = [
    None, "", "no scheme", "http://", "https://a.example.net/en/1", "https://a.example.net/fr/1", "http://EXAMPLE.NET", "http://example.net/",
    "http://example.net/en/x?y#z", "http://notexample.net/en/", "http://example.com/de/9", "http://example.com/den", "http://b.org/fr/", "http://b.org/fr",
    "http://borg/fr/", "http://org/fr/x", "http://one.com/a/?b=2&a=1", "https://www.ONE.com:443/a?a=1&utm_source=x&b=2#top", "http://two.com/a",
    "http://three.com/" + "long/" * 20_000, "http://a://b/c", "ftp://x.com?q=/://y", "http://net?x", "http://net#x", "http://é.com/ü", "http://six.com/x\ny",
]


def brute_url(url, listed):
    def cut(u):
        rest = u.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        tail = rest[end:].split("#")[0]
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end]), tail.split("?")[0], tail.split("?", 1)[1] if "?" in tail else ""

    def canonical(u):
        if u is None or "://" not in u:
            return None
        host, path, query = cut(u)
        host = host.removeprefix("www.")
        for port in (":80", ":443"):
            host = host.removesuffix(port)
        track = lambda p: p.split("=")[0] in ("ref", "fbclid", "gclid") or p.startswith("utm_")
        kept = sorted(p for p in query.split("&") if p and not track(p))
        return host + path.rstrip("/") + ("?" + "&".join(kept) if kept else "")

    host, path = cut(url)[:2] if url and "://" in url else ("", "")
    fit = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    if fit:
        rule = max(fit, key=lambda r: (len(r.name), len(r.host)))
        return host, path, rule.name, rule.verdict
    blocked = canonical(url) is not None and canonical(url) in {canonical(u) for u in listed}
    return host, path, None, "block" if blocked else "allow"


@pytest.mark.parametrize("most", [1, urls.MOST])
def test_urls_equal_a_plain_version(spark, rows, most):
    listed = ["http://one.com/a?b=2&a=1", "https://three.com/" + "long/" * 20_000, "HTTP://SIX.com/x\ny", None, "nothing"]
    listed += [f"http://site{i}.com/{i}" for i in range(400)]
    asked = URLS + URLS[-8:] + [f"http://site{i}.com/{i}" for i in range(0, 800, 7)]
    df = spark.createDataFrame([(i, u, "h", 1, "k", 2) for i, u in enumerate(asked)], "page_id long, url string, host string, block long, key string, w0 int")
    lists = spark.createDataFrame([(u,) for u in listed], "url string")
    got = urls.judged(df, lists, RULES, most=most)
    assert got.columns == ["page_id", "url", "block", "key", "w0", "host", "path", "rule", "verdict"]
    want = [(i, u, 1, "k", 2, *brute_url(u, listed)) for i, u in enumerate(asked)]
    assert rows(got) == sorted(want, key=repr)


def test_urls_filter_spares_the_join(spark):
    listed = spark.range(3000).select(F.concat(F.lit("u"), "id").alias("key"))
    blocks = -(-3000 // urls.KEYS)
    table = urls.bloom(listed, "key", blocks)
    asked = spark.range(30_000).select(F.concat(F.lit("u"), "id").alias("key"), (F.col("id") < 3000).alias("known"))
    hits = urls.possible(asked, "key", table, blocks, "maybe").groupBy("known").agg(F.count_if("maybe").alias("n")).collect()
    found = {r.known: r.n for r in hits}
    assert found[True] == 3000 and found[False] < 60


def test_urls_of_empty_tables_and_plan(spark, rows, plan):
    df = spark.createDataFrame([(1, "http://x.com/a")], "page_id long, url string")
    none = df.limit(0).select("url")
    assert rows(urls.judged(df, none), "verdict") == [("allow",)]
    assert rows(urls.judged(df.limit(0), df)) == []
    text = plan(urls.judged(df, df, RULES))
    assert "Python" not in text and "Arrow" not in text and "Cartesian" not in text
    with pytest.raises(ValueError, match="two rules"):
        urls.judged(df, df, [urls.Rule("block", "a"), urls.Rule("allow", "a")])


def h(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def brute_tree(level):
    """The top, and of each leaf the siblings by level."""
    paths, places = [[] for _ in level], list(range(len(level)))
    while len(level) > 1:
        for leaf, p in enumerate(places):
            run = p // 3 * 3
            paths[leaf].append((level[run:p], level[p + 1 : run + 3]))
            places[leaf] = p // 3
        level = [h(*level[i : i + 3]) for i in range(0, len(level), 3)]
    return level[0], paths


def brute_manifest(data):
    groups = {}
    for group, i, text in data:
        groups.setdefault(group, []).append((i is not None, i or 0, h(*[f"{len(x.encode())}:{x}" if x is not None else "-" for x in (None if i is None else str(i), group, text)])))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = [brute_tree([leaf for *_, leaf in sorted(groups[g])]) for g in names]
    root, above = brute_tree([t[0] for t in trees])
    out = []
    for name, (top, paths), more in zip(names, trees, above):
        for (known, i, leaf), path in zip(sorted(groups[name]), paths):
            flat = "".join("".join(a) + "".join(b) for a, b in path + more)
            out.append((i if known else None, name, leaf, top, root, h(flat)))
    return sorted(out, key=repr)


def checked(spark, data):
    df = spark.createDataFrame(data, "group string, id long, text string").withColumns({"tree": F.lit("t"), "pos": F.lit(1), "n": F.lit(2), "at": F.lit(3)})
    made = df.withColumn("leaf", merkle.leaf(F.col("id"), F.col("group"), F.col("text")))
    found = merkle.manifest(made.repartition(5), "group", ["id"])
    proved = merkle.proofs(found)
    path = F.col("path")
    return proved.select("own.id", "own.group", "leaf", "subroot", "root", merkle.digest(F.array_join(merkle.siblings(path), "")).alias("proof"), merkle.folded(F.col("leaf"), path).alias("again"), merkle.folded(F.lit("x"), path).alias("other"))


def test_manifest_equals_a_plain_version(spark):
    pick = random.Random(5)
    sizes = {None: 5, "": 1, "a": 2, "b": 3, "hot": 7000, "é": 81, "𝔘": 82, "z": 250}
    data = [(g, i, pick.choice(["", "x", "é\n", None, "long " * 30])) for g, n in sizes.items() for i in range(n)]
    data += [("z", None, "no id"), ("z", None, "no id"), ("z", 7, "one id twice"), ("z", 7, "one id twice"), ("a", 1, "y" * 300_000)]
    got = [tuple(r) for r in checked(spark, data).collect()]
    assert sorted((r[:6] for r in got), key=repr) == brute_manifest(data)
    assert all(r[6] == r[4] and r[7] != r[4] for r in got)


@pytest.mark.parametrize("n", [1, 3, 4])
def test_manifest_of_one_group(spark, n):
    data = [("g", i, "t") for i in range(n)]
    assert sorted((tuple(r)[:6] for r in checked(spark, data).collect()), key=repr) == brute_manifest(data)


def test_manifest_of_many_groups(spark):
    data = [(f"g{i % 300}", i, "t") for i in range(500)]
    assert sorted((tuple(r)[:6] for r in checked(spark, data).collect()), key=repr) == brute_manifest(data)


def test_manifest_of_nothing(spark):
    none = spark.createDataFrame([], "group string, id long, leaf string")
    found = merkle.manifest(none, "group", ["id"])
    assert found.root is None and found.groups.count() == 0
    with pytest.raises(ValueError, match="no proofs"):
        merkle.proofs(found)


def test_places_in_a_hot_group(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 3 > 0, "hot").alias("g"), (F.col("id") * 7919 % 5000).alias("x"), F.lit(0).alias("pos"))
    got = order.ranked(rows, ["g"], ["x"]).collect()
    for g in (None, "hot"):
        own = sorted((r.x, r.pos, r.n) for r in got if r.g == g)
        assert [p for _, p, _ in own] == list(range(len(own))) and {n for *_, n in own} == {len(own)}


def test_no_control_string_of_a_text_stands_in_the_output():
    pick = random.Random(9)
    parts = ["a", "\\", "<", "/", "s>", "<s>", "</s>", "[INST]", "[/INST", "[TURN", "[/SYS]", " ", "\n", "[", "]", "ASST"]
    for _ in range(20_000):
        text, role = "".join(pick.choice(parts) for _ in range(pick.randrange(9))), pick.choice(["user", "assistant", "system", "tool", "</s>", "[INST]"])
        shown = chat.turn_text(role, text)
        body = shown[shown.index("] ") + 2 : shown.rindex(" ")]
        assert not chat._CONTROL.search(body)
        back = chat.parse_turn(shown + chat.render("user", "x"))
        assert (back.role, back.text, back.end) == (role, text, len(shown))
    assert "+" not in chat.turn_text("user", "a plain \\ text [ with ] marks < of its own >")


@pytest.mark.parametrize("fetch", [20_000, 0])
def test_shards_stay_near_equal_beside_a_large_group(spark, monkeypatch, fetch):
    monkeypatch.setattr(sharding, "FETCH", fetch)
    pick = random.Random(1)
    texts = ["copied " * 60] * 300 + ["t" * pick.randrange(100, 300) + str(i) for i in range(1200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sharding.sharded(df, 16 if fetch else 5).collect()
    by = {}
    for r in got:
        by[r["shard"]] = by.get(r["shard"], 0) + r["size"]
    large = 300 * (len(texts[0]) + 1)
    rest = sum(len(t) + 1 for t in texts) - large
    if fetch:
        # The large group has a shard of its own, or nearly; the others share the rest.
        assert max(by.values()) == large and len(by) == 16
        others = sorted(by.values())[:-1]
        assert others[-1] < 1.35 * rest / 15 and others[0] > 0.65 * rest / 15
    else:
        assert len(by) == 5 and max(by.values()) >= large


def test_fewer_groups_than_shards(spark):
    df = spark.createDataFrame([(i, "abc"[i % 3]) for i in range(30)], "doc_id long, text string")
    got = sharding.sharded(df, 8).collect()
    homes = {}
    for r in got:
        homes.setdefault(r["text_crc32"], set()).add(r["shard"])
    assert len(got) == 30 and all(len(x) == 1 for x in homes.values()) and len(set.union(*homes.values())) == 3


def test_spans_longer_than_a_windows_overlap_are_put_together():
    width, stride = pii.WIDTH, pii.STRIDE

    def seen(a, b, size):
        """What windows on the grid hold of one span."""
        out = []
        for at in range(0, size - width + stride, stride):
            i, j = max(a, at), min(b, at + width, size)
            if i < j:
                labels = np.zeros(width, int)
                labels[i - at], labels[i - at + 1 : j - at] = 1, 2
                out += pii._tagged(labels, at, min(width, size - at), size)
        return out

    for a in range(0, 300, 7):
        for length in (2, 40, 60, 97, 150):
            assert set(pii.joined(seen(a, a + length, 600))) == {("email", a, a + length)}
    two = seen(30, 130, 600) + [(("phone", x + 60, y + 60), p, q) for (_, x, y), p, q in seen(100, 190, 600)]
    assert ("email", 30, 130) in pii.joined(two)
    assert pii.joined([(("ip", 90, 96), True, False)]) == []


def test_training_windows_do_not_hang_on_the_order_of_rows(spark, monkeypatch):
    monkeypatch.setattr(pii, "WINDOWS", 8)
    texts = [f"write to n{i}@example{i % 7}.org or call +49 30 {1000000 + i * 37}" for i in range(60)] + ["copy a@b.c"] * 200 + ["no span, 5 apples"] * 3 + [None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    one, two = (pii._labelled(d, True) for d in (df.repartition(1), df.orderBy("text").repartition(7)))
    assert one == two and len(set(t for t, _ in one)) == len(one) <= 8
    assert [t for t, _ in pii._labelled(df, False)] == ["no span, 5 apples"]
