"""Each operator on odd rows and empty tables, against brute force or SQL."""

from __future__ import annotations

import math
import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stepfree.llm import catalog, compression, html, jaccard, lines, markov, mixing, packing, quality, search, toxicity
from stepfree.llm.common import words


DATA = os.environ.get("STEPFREE_TEST_DATA", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_oracles(spark, same, name):
    assert same(catalog.queries()[name](spark, DATA), catalog.oracle_sql()[name])


# mixing


def test_mixing(odd, odd_rows):
    out = mixing.mix_sources(odd).collect()
    assert len(out) == len(odd_rows)
    size, taken, target = Counter(), Counter(), {}
    largest = Counter()
    for r in out:
        assert 0 <= r["taken"] <= 2 * r["size"]
        size[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
        target[r["source"]] = r["target"]
    assert abs(sum(target.values()) - 1.5 * sum(size.values())) < 1e-6 * sum(size.values())
    for s in size:
        assert target[s] <= 2 * size[s] + 1e-9
        assert abs(taken[s] - target[s]) <= 3 * largest[s] / 2 + 1e-9  # three equal rows are taken together
    again = {(r["doc_id"], r["size"], r["taken"]) for r in mixing.mix_sources(odd.repartition(7)).collect()}
    assert again == {(r["doc_id"], r["size"], r["taken"]) for r in out}
    rows = mixing.mixed_rows(odd)
    assert rows.columns == odd.columns and rows.count() == sum(r["copies"] for r in out)


def test_mixing_empty(empty):
    assert mixing.mix_sources(empty).count() == 0 and mixing.mixed_rows(empty).count() == 0


def test_guarded_join_beyond_the_bound(spark):
    from stepfree.llm.common import BROADCAST_ROWS, attach

    big = spark.range(200).select(F.when(F.col("id") % 3 > 0, F.lit("hot")).alias("k"), "id")
    small = spark.createDataFrame([("hot", 1), (None, 2)], "k string, v int")
    few, many = (attach(big, small, ["k"], n, F.col("id")).orderBy("id").collect() for n in (2, BROADCAST_ROWS + 1))
    assert few == many and len(few) == 200


# lines


def test_lines(spark):
    rows = [(i, f"own {i}\nmenu home\n", "a") for i in range(30)] + [(100 + i, "menu home", "a") for i in range(3)] + [(200, "menu home\nx", "b"), (201, None, "a")]
    out = {r["doc_id"]: (r["text"], r["n_dropped_lines"]) for r in lines.drop_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert out[3] == ("own 3\n", 1) and out[100] == ("", 1) and out[200] == ("menu home\nx", 0) and out[201] == (None, 0)


@pytest.mark.parametrize("pages", [2, 5, 19, 20])
def test_lines_of_small_hosts(spark, pages):
    """The ratio decides whatever the number of pages; what is on one page does not repeat."""
    df = spark.createDataFrame([(i, f"own {i}\nmenu", "a") for i in range(pages)], "doc_id long, text string, source string")
    assert {r["text"] for r in lines.drop_boilerplate(df).collect()} == {f"own {i}" for i in range(pages)}


def test_lines_at_the_ratio(spark):
    """A line on exactly 8 % of the different pages stays, on one more it goes; copies of a page count once."""
    rows = [(i, f"own {i}" + ("\nat the ratio" if i < 8 else "") + ("\nabove it" if 50 <= i < 59 else ""), "a") for i in range(100)]
    rows += [(300 + i, "own 0\nat the ratio", "a") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = {r["doc_id"]: r["text"] for r in lines.drop_boilerplate(df).collect()}
    assert out[0] == out[300] == "own 0\nat the ratio" and out[50] == "own 50"
    alone = spark.createDataFrame([(i, f"own {i}\nmenu", "a") for i in range(30)] + [(99, "menu", "a")], df.schema)
    for spare, want in ((False, ""), (True, "menu")):
        out = {r["doc_id"]: r["text"] for r in lines.drop_boilerplate(alone, spare_copies=spare).collect()}
        assert out[99] == want and out[3] == "own 3"


def test_lines_odd(odd, odd_rows, empty):
    out = lines.drop_boilerplate(odd)
    assert out.count() == len(odd_rows) and out.columns == [*odd.columns, "n_dropped_lines"]
    assert lines.drop_boilerplate(empty).count() == 0


def test_line_stage_repeats(spark):
    rng = random.Random(8)
    own = lambda n: " ".join(f"v{rng.randrange(10**6)}" for _ in range(n))
    passage, short = own(50), own(9)
    rows = [(i, f"{own(300)}\n{passage}\nmenu", f"h{i}", 0) for i in range(2)]  # one on each host
    rows += [(10 + i, f"{own(70)}\n{short}", "small", 0) for i in range(6)]  # a host of six pages
    rows += [(20 + i, f"{own(70)}\ncommon line", f"one{i}", 0) for i in range(8)]  # on one page of many hosts
    whole = f"{own(60)}\n{own(60)}\nthe end"
    rows += [(40, whole, "a", 0), (41, whole + " now", "b", 0), (None, None, None, 0)]  # copies are left to the next stage
    rows += [(50, own(55), "c", 0), (51, own(55), "c", 0)]
    rows += [(60, f"{own(300)}\n{rows[-1][1]}\n{rows[-2][1]}", None, 0)]  # passages of two other pages
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long").repartition(3)
    text = {r[0]: r[1] for r in rows}
    out = {r["doc_id"]: r for r in corpus_pipeline.line_stage(spark, df, DATA).collect()}
    assert len(out) == len(rows) and all(r["n_chars"] == len(r["text"] or "") for r in out.values())
    assert out[0]["text"] == text[0] and out[1]["text"] == text[1].replace(passage + "\n", "")
    assert all(out[10 + i]["text"] == text[10 + i].split("\n")[0] for i in range(6))
    assert all(out[20 + i]["text"] == text[20 + i].split("\n")[0] for i in range(8))
    assert all(out[k]["text"] == text[k] for k in (40, 41, None, 50, 51))
    assert out[60]["text"] == text[60].split("\n")[0]


# quality


def repeats(ws: list[bytes]) -> tuple[int, int, int]:
    best = [max((next((k for k in range(len(ws)) if i + k >= len(ws) or j + k >= len(ws) or ws[i + k] != ws[j + k]), 0) for j in range(len(ws)) if j != i), default=0) for i in range(len(ws))]
    window = {p for i, b in enumerate(best) if b >= 5 for p in range(i, i + 5)}
    spans = {p for i, b in enumerate(best) if b >= 8 for p in range(i, i + b)}
    return len(window), len(spans), max(best, default=0)


def test_quality_brute_force():
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.choice([0, 1, 5, 20, 40]))) * rng.choice([1, 2]) for _ in range(40)]
    out = quality.measure(texts, 8, 0.2, 100)
    for t, (_, r) in zip(texts, out.iterrows(), strict=True):
        assert (r.n_repeat_words, r.n_covered_words, r.longest_repeat) == repeats(words(t))


def test_quality_columns():
    t = "One two, #three$ four five\nsix seven eight nine ten eleven\n\nsix seven eight nine ten eleven\n"
    r = quality.measure([t, None, ""], 8, 0.2, 100).to_dict("records")
    assert (r[0]["n_words"], r[0]["n_symbols"], r[0]["n_dup_lines"], r[0]["n_repeat_words"], r[0]["base_failed"]) == (17, 2, 1, 12, True)
    assert r[0]["word_chars"] == sum(len(w) for w in t.split())
    assert r[1] == r[2] and not r[1]["kept"]


def test_quality_odd(odd, odd_rows, empty):
    out = quality.quality_rules(odd)
    assert out.count() == len(odd_rows)
    assert quality.keep_good(odd).count() == out.where("kept").count() > 0
    assert quality.quality_rules(empty).count() == 0


# html


def test_html():
    tree = html.DecisionTree(*html.labelled_table())
    page = """<html><head><title>T</title><script>var a="<p>no</p>";</script></head><body class="home-ad"><!-- <p>no</p> --><header><p>Site</p></header>
<nav><a href="/">Home</a></nav><div class="cookie-banner"><p>We use cookies on this site and they are good for you.</p></div>
<article><h1>A &amp; B</h1><p><b>First   line<br>goes&nbsp;on<p>Oh.<ul><li>One</li><li>Two</ul><div class="advert"><p>Buy now</p></div>
<section id="comments"><p>Nice one, I liked every word of it.</p></section></article><footer>&copy; us</footer></body>"""
    assert html.main_text(page, tree) == "A & B\nFirst line goes on\nOh.\nOne\nTwo"
    assert html.main_text(None, tree) == html.main_text("", tree) == html.main_text("<nav><a>x</a></nav>", tree) == ""
    assert html.main_text("<p>just a line of text that is not in any article", tree) == "just a line of text that is not in any article"


def test_html_unclosed():
    """A head, noscript, svg, ... without an end tag hides no more than what belongs to it."""
    tree = html.DecisionTree(*html.labelled_table())
    line = "The lift at the north gate is out of order until the end of next week."
    article = f"<article><p>{line}</p></article>"
    for start in (
        "<html><head><title>x</title><body>", "<head><meta charset=utf-8><title>x</title><script>1</script><div></div>", "<html><head><noscript><p>no</p></noscript></head>",
        "<head><title>x</title><style>p{}", "<head><title>x</title><template><p>no</p></template><!-- no -->",
    ):
        want = "" if start.endswith("{}") else line
        assert html.main_text(start + article, tree) == want, start
    for tag in ("noscript", "svg", "object", "select", "iframe", "template"):
        assert html.main_text(f"<{tag}>{article}", tree) == line, tag
        assert html.main_text(f"<article><{tag} class='z'><p>{line}</p></article>", tree) == line, tag
        assert html.main_text(f"<article><p>{line}</p><{tag}><p>no</p></div></{tag}></article>", tree) == line, tag
        assert html.main_text(f"<article><p>{line}<{tag}>no</{tag.upper()} ></p></article>", tree) == line, tag
    assert html.main_text(f"<article><svg><g><svg>no</svg>no</g></svg><p>{line}</p></article>", tree) == line


def test_html_names_in_an_article():
    """Inside an article a doubtful name takes no prose away, a list of links goes; outside it names count."""
    tree = html.DecisionTree(*html.labelled_table())
    line, big = "The lift at the north gate is out of order until the end of next week.", " ".join(["Rain held the work up again."] * 20)
    for part in (f'<p class="alert">{line} A</p>', f'<div class="related-work"><p>Prior: {line}</p></div>', f'<section id="search"><h2>How we look</h2><p>{line}</p></section>'):
        want = [b.text for b in html.blocks_of(part)]
        assert html.main_text(f"<article><p>{big}</p>{part}<p>Oh.</p></article>", tree).split("\n") == [big, *want, "Oh."]
    linked = '<div class="related"><h3>Related</h3><ul><li><a href="/">One more thing</a></li><li><a href="/">Two more things</a></li></ul></div>'
    assert html.main_text(f"<article><p>{line}</p>{linked}</article>", tree) == line
    assert html.main_text(f'<article><p>{big}</p><p><a href="/">See the map</a></p></article>', tree).endswith("See the map")
    assert html.main_text(f'<article><p>{line}</p><div class="comments"><p>{big}</p><p>Hm</p></div><div class="notice">{line}</div></article><div class="alert">{big}</div>', tree) == line
    assert html.main_text(f"<div>{big}</div><article><p>Oh.</p></article><footer>{big}</footer>", tree) == "Oh."


def test_html_tree_generalises():
    """A labelled page left out of the training is told by the others; counts alone, without names, tell most of the whole table."""
    blocks = [html.blocks_of(p) for p in html.LABELLED_PAGES]
    x, y = [html.block_features(b) for b in blocks], [np.array([b.keep == "1" for b in p]) for p in blocks]
    hits = 0
    for k in range(len(blocks)):
        tree = html.DecisionTree(np.concatenate(x[:k] + x[k + 1 :]), np.concatenate(y[:k] + y[k + 1 :]).astype(float))
        hits += (tree.predict(x[k]) == y[k]).sum()
    assert hits >= 0.94 * sum(map(len, y))
    assert html.DecisionTree(*html.labelled_table()).feature < html.FIRST_NAME


def test_html_empty(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string, n_chars long")
    assert html.extract_text(none).columns == ["page_id", "url", "text", "n_chars"] and html.extract_text(none).count() == 0


def test_html_rows(spark):
    rows = [(1, "u", "<article><p>a b</p></article>"), (None, None, None), (2, "u", ""), (3, "u", "<p>" + "w " * 100_000)]
    out = html.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1))).collect()
    assert [(r["page_id"], r["n_chars"]) for r in out] == [(1, 3), (None, 0), (2, 0), (3, 199_999)]


# jaccard


def grams(text: str | None, n: int) -> frozenset:
    w = (text or "").encode().lower().split()
    return frozenset(zip(*[w[i:] for i in range(n)], strict=False)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute_components(rows: list[tuple], n: int, num: int, den: int) -> list[tuple]:
    sets = [grams(t, n) for _, t in rows]
    head = list(range(len(rows)))

    def top(x: int) -> int:
        while head[x] != x:
            x = head[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                head[top(i)] = top(j)
    names = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        names[top(i)].append(d)
    name = {k: min((d for d in v if d is not None), default=None) for k, v in names.items()}
    return sorted(((d, len(sets[i]), name[top(i)]) for i, (d, _) in enumerate(rows)), key=repr)


@pytest.mark.parametrize(("n", "num", "den", "together"), [(3, 90, 100, 256), (5, 8, 10, 16)])
def test_jaccard(spark, monkeypatch, n, num, den, together):
    monkeypatch.setattr(jaccard, "TOGETHER", together)
    rng = random.Random(n)
    rows = []
    for g in range(30):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([2, 4, 6, 9, 14, 25, 60, 150]))]
        for _ in range(rng.choice([1, 2, 5])):
            v = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                v[rng.randrange(len(v))] = f"z{rng.randrange(9)}"
            rows.append((len(rows), " ".join(v)))
    base = [f"m{i}" for i in range(120)]
    for _ in range(60):  # a group with a bucket of its own block
        v = list(base)
        for _ in range(rng.choice([1, 2, 3, 4])):
            v[rng.randrange(len(v))] = f"y{rng.randrange(10**6)}"
        rows.append((len(rows), " ".join(v)))
    rows += [(None, rows[0][1]), (None, None), (900, ""), (901, " \n"), (5, rows[3][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("cls", F.lit("x")).repartition(4)
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(df, n, num, den).collect()), key=repr)
    assert got == brute_components(rows, n, num, den)


def test_group_links():
    """The links of one group join what brute force joins, with and without shared n-grams."""
    rng = np.random.default_rng(4)
    for _ in range(20):
        m, step = int(rng.integers(2, 40)), 18
        sets = [set(rng.integers(0, 60, int(rng.integers(0, 25))).tolist()) for _ in range(m)]
        s, comp = rng.integers(-600, 5, m), rng.integers(0, m, m)
        table = pa.table({"cls": np.arange(m), "comp": comp, "d": pa.array([sorted(x) for x in sets], pa.list_(pa.int64())), "s": s})
        out = jaccard.group_links(table, step)
        linked = {(i, j) for i in range(m) for j in range(i) if comp[i] != comp[j] and s[i] + s[j] + 2 * step * len(sets[i] & sets[j]) >= 0}

        def joined(pairs):
            head = {int(c): int(c) for c in comp}
            for _ in range(m):
                for i, j in pairs:
                    low = min(head[int(comp[i])], head[int(comp[j])])
                    head[int(comp[i])] = head[int(comp[j])] = low
            return head

        got = list(zip(out["a"].to_pylist(), out["b"].to_pylist(), strict=True))
        assert all((max(p), min(p)) in linked for p in got) and len(got) < m
        assert joined(got) == joined(linked)


def test_jaccard_odd(odd, odd_rows, empty):
    assert jaccard.near_duplicates(odd).count() == len(odd_rows)
    kept = jaccard.keep_one(odd)
    assert kept.columns == odd.columns and {100, 102} - {r["doc_id"] for r in kept.select("doc_id").collect()} <= {102}
    assert jaccard.near_duplicates(empty).count() == 0


def test_one_row_of_each_group_stays(spark):
    rng = random.Random(9)
    own = lambda: " ".join(f"k{rng.randrange(10**6)}" for _ in range(40))
    a, b, c, d, e = (own() for _ in range(5))
    rows = [(1, a, "x"), (7, a + " z", "x"), (7, b, "x")]  # two texts under one id, one of them a near copy
    rows += [(None, c, "x"), (None, c, "y"), (None, c + " z", "x"), (None, a, "x")]  # no ids
    rows += [(9, d, "x"), (9, d, "x"), (9, d, "w"), (3, e, "x"), (3, e + " z", "x")]  # equal ids
    rows += [(20, None, "x"), (20, None, "x"), (None, " ", "x")]  # in no group
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    out = jaccard.keep_one(df)
    assert out.columns == df.columns
    got = Counter((r["doc_id"], (r["text"] or "").split(" z")[0], r["lang"]) for r in out.collect())
    assert got[None, c, "x"] + got[None, c, "y"] == 1
    got = Counter({(d_, t, "" if t == c else v): n for (d_, t, v), n in got.items()})
    assert got == {(1, a, "x"): 1, (7, b, "x"): 1, (None, c, ""): 1, (9, d, "w"): 1, (3, e, "x"): 1, (20, "", "x"): 2, (None, " ", "x"): 1}


# search


def test_search(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in (rng.normal(size=8) * rng.choice([0, 1], 8)).astype(np.float32)]) for i in range(300)]
    rows += [(400, rows[20][1]), (420, None), (440, [1.0, None]), (460, [float("nan")] * 8), (480, [float("inf")] * 8), (None, rows[1][1]), (500, []), (40, rows[2][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("x"))
    got = Counter(tuple(r) for r in search.top_k(df, F.col("vec_id") % 20 == 0, k=5).select("query_id", "rank", "vec_id", "score").collect())
    usable = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    expected = Counter()
    for a, (q, v) in enumerate(usable):
        if q is not None and q % 20 == 0:  # both rows of id 40 are queries, and candidates of each other
            best = sorted((-sum(x * y for x, y in zip(v, w, strict=False)), c is None, c or 0) for b, (c, w) in enumerate(usable) if a != b)[:5]
            expected.update((q, k + 1, None if none else c, -s) for k, (s, none, c) in enumerate(best))
    assert got == expected and len(expected) > 50
    tied = spark.createDataFrame([(20, [1.0]), (20, [1.0]), (3, [1.0])], "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in search.top_k(tied, F.col("vec_id") % 20 == 0).collect()) == [(20, 1, 3, 4096)] * 2 + [(20, 2, 20, 4096)] * 2
    assert search.top_k(df.where("vec_id < 0"), F.col("vec_id") % 20 == 0).count() == 0
    ids = spark.createDataFrame([(None, [9.0]), (20, [1.0]), (None, [1.0]), (7, [1.0])], tied.schema)
    assert [tuple(r) for r in search.top_k(ids, F.col("vec_id") % 20 == 0).orderBy("rank").collect()] == [(20, 1, None, 64 * 576), (20, 2, 7, 4096), (20, 3, None, 4096)]


def test_search_beyond_64_bits(spark):
    rows = [(20, [1e17, 1.0]), (21, [1e17, 1.0]), (22, [-1e17, 1.0]), (23, [1e8, 1.0]), (24, [0.0, 2.0]), (25, [3e38, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [(r["vec_id"], r["score"]) for r in search.top_k(df, F.col("vec_id") == 20).orderBy("rank").collect()]
    exact = {i: min(2**63 - 1, max(-(2**63), sum(math.floor(64 * np.float64(np.float32(a))) * math.floor(64 * np.float64(np.float32(b))) for a, b in zip(rows[0][1], v, strict=True)))) for i, v in rows[1:]}
    assert got == sorted(exact.items(), key=lambda x: (-x[1], x[0]))


# packing


def test_packing(odd, odd_rows, empty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(packing.tokenizer_text())
    special = [(700, "one <|endoftext|> two <|STARTOFTEXT|><|startoftext|>", "en", "s0", 1)]
    out = packing.pack_documents(odd.select("doc_id", "text").unionByName(odd.sparkSession.createDataFrame([r[:2] for r in special], "doc_id long, text string"))).collect()
    expected = Counter()
    for d, t, *_ in odd_rows + special:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            part = ids[k : k + 4096]
            expected[d, k // 4096, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == expected
    at = defaultdict(list)
    for r in out:
        at[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in at.values():
        reach = 0
        for offset, length in sorted(places):
            assert offset == reach
            reach += length
        assert reach <= 4096
    assert packing.pack_documents(empty).count() == 0


def test_packing_spreads_equal_rows(spark):
    """Rows equal in all columns do not end in one group."""
    pieces = spark.range(3000).select(F.lit(1).cast("long").alias("doc_id"), *[F.lit(v).cast(t).alias(c) for c, v, t in (("piece", 0, "int"), ("start", 0, "long"), ("length", 10, "long"), ("ids_crc32", 5, "long"))])
    out = packing.pack(pieces, size=100, group_pieces=100).collect()
    assert len(out) == 3000 and len({r["sequence_id"] for r in out}) <= 303
    groups = Counter(r["sequence_id"] >> 22 for r in out if r["sequence_id"] % 4 == 0)  # of the first round
    assert len(groups) == 30 and max(groups.values()) < 200


def test_bin_completion():
    rng = np.random.default_rng(0)
    better = 0
    for _ in range(40):
        lengths = rng.integers(600, 3000, 40)
        first, best = packing.best_fit(lengths, 4096), packing.bin_completion(lengths, 4096, 4000)
        assert sorted(x for b in best for x in b) == sorted(lengths.tolist()) and max(map(sum, best)) <= 4096
        assert -(-int(lengths.sum()) // 4096) <= len(best) <= len(first)
        better += len(best) < len(first)
    assert better


def test_tokens_of_odd_texts():
    rng = random.Random(2)
    alphabet = "abcXYZ 'sStdmlrev!?.,×÷éÉñÑöÖşŞ019_\n\t#$% İΣ½\xa0\x1d"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 2, 3, 9, 30, 200]))) for _ in range(400)] + ["it's we'll I'VE don't''s !'s 'september 'll'm", "'" * 70, "a" * 200]
    tokens = packing.word_tokens(packing.tokenizer_text())
    for t, got in zip(texts, tokens.encode(texts), strict=True):
        assert got == np.array(tokens.whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t


# language model


def test_forward_backward():
    import itertools

    rng = np.random.default_rng(0)
    m = markov.Hmm(rng.dirichlet(np.ones(2)), rng.dirichlet(np.ones(2), 2), rng.dirichlet(np.ones(markov.SYMBOLS), 2).T)
    sequences = [rng.integers(0, markov.SYMBOLS, n).astype(np.int16) for n in (1, 3, 5)]
    starts, moves = np.zeros(2), np.zeros((2, 2))
    for s, ll in zip(sequences, markov.log_likelihoods(m, sequences), strict=True):
        total, a, b = 0.0, np.zeros(2), np.zeros((2, 2))
        for path in itertools.product(range(2), repeat=len(s)):
            p = m.start[path[0]] * m.emit[s[0], path[0]]
            for t in range(1, len(s)):
                p *= m.move[path[t - 1], path[t]] * m.emit[s[t], path[t]]
            total += p
            a[path[0]] += p
            for t in range(1, len(s)):
                b[path[t - 1], path[t]] += p
        assert math.isclose(math.log(total), ll, rel_tol=1e-9)
        starts += a / total
        moves += b / total
    counts = markov.expected_counts(m, sequences)
    whole, markov.SEGMENT = markov.SEGMENT, 2
    cut = markov.expected_counts(m, sequences)
    markov.SEGMENT = whole
    assert np.allclose(counts, cut, atol=1e-4)  # blocks of a text hand their probabilities on
    assert np.allclose(counts[:2], starts, atol=1e-4) and np.allclose(counts[2:6].reshape(2, 2), moves, atol=1e-4)


def test_language_scores(odd, odd_rows, empty):
    count: Counter = Counter()
    for d, t, *_ in odd_rows:
        if zlib.crc32(b"" if d is None else str(d).encode()) % 10:
            count.update([*(t or "").encode().lower().split(), "END"])
    n, v = sum(count.values()), len(count)
    expected = Counter()
    for d, t, *_ in odd_rows:
        w = [*(t or "").encode().lower().split(), "END"]
        expected[d, len(w), sum(count[x] > 0 for x in w), n, round(sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 4)] += 1
    out = markov.score_language(odd, states=3, rounds=1).collect()
    assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in out) == expected
    assert all(math.isfinite(r["score"]) for r in out)
    assert markov.score_language(empty).count() == 0


def test_language_of_long_texts(spark):
    """Where every training text is longer than a segment, the model still learns."""
    rng = random.Random(6)
    rows = [(i, prose_of(rng, markov.SEGMENT + 900)) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = [r for r in markov.score_language(docs, states=3, rounds=2, sample_rounds=4).collect() if r["held_out"]]
    assert out and all(r["score"] > r["base_score"] - 0.05 * r["n_tokens"] for r in out)


def test_language_model_whatever_the_partitioning(spark):
    """The sample that parts the states is picked by id and text."""
    rng = random.Random(7)
    docs = spark.createDataFrame([(i // 2, prose_of(rng, 30 + i % 50)) for i in range(240)], "doc_id long, text string")
    scores = []
    for part in (docs.repartition(2), docs.repartition(7)):
        out = markov.score_language(part, states=3, rounds=1, sample=20, sample_rounds=3).collect()
        scores.append(sorted((r["doc_id"], r["n_tokens"], r["base_score"], r["score"]) for r in out))
    assert all(math.isclose(a, b, abs_tol=1e-3) for x, y in zip(*scores, strict=True) for a, b in zip(x, y, strict=True))


def prose_of(rng: random.Random, n: int) -> str:
    """Nouns and verbs in turn, few of each often."""
    return " ".join(f"{'nv'[i % 2]}{min(rng.randrange(40), rng.randrange(40))}" for i in range(n))


# classifiers


@pytest.mark.parametrize(("column", "score", "mod", "left"), [("quality", compression.score_quality, 4, 2), ("toxic", toxicity.score_toxicity, 5, 0)])
def test_classifiers(spark, odd, odd_rows, empty, column, score, mod, left):
    rng = random.Random(4)
    docs, labels = [], []
    for i in range(400):
        y = i % 3 == 0
        body = [f"w{rng.randrange(300)}" for _ in range(60)]
        if y and column == "toxic":
            body[7] = "filthyword"
        if not y and column == "quality":
            body = [w.upper() + "!!" for w in body]
        docs.append((i, " ".join(body), "en", "s", 1))
        labels.append((i, int(y), int(y)))
    labels += [(None, 1, 1), (3, None, None), (9999, 1, 0)]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    truth = {i: q for i, q, _ in labels}
    out = [r for r in score(d, lab).collect() if r["held_out"]]
    assert out and all((zlib.crc32(str(r["doc_id"]).encode()) % mod == left) for r in out)
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in out) >= 0.9 * len(out)
    weird = score(odd, lab).collect()
    assert len(weird) == len(odd_rows) and all(0 <= r["score"] <= 1 for r in weird)
    assert score(empty, lab.where("false")).count() == 0
    assert score(d, lab.where("false")).count() == len(docs)


def test_risk_gradient():
    """The step of non-negative PU learning lowers the corrected risk, and its gradient agrees with differences."""
    rng = np.random.default_rng(5)
    p, u, prior = rng.random((40, 6)), rng.random((90, 6)), 0.3
    w = rng.normal(size=7)

    def parts(w):
        sp, su = (1 / (1 + np.exp(-np.c_[x, np.ones(len(x))] @ w)) for x in (p, u))
        return prior * (1 - sp).mean(), su.mean() - prior * sp.mean()

    gradient, negative = toxicity.risk_gradient(np.c_[p, np.ones(40)], np.c_[u, np.ones(90)], w, prior)
    assert math.isclose(negative, parts(w)[1])
    near = [(sum(parts(w + 1e-6 * e)) - sum(parts(w - 1e-6 * e))) / 2e-6 for e in np.eye(7)]
    assert np.allclose(gradient, near if negative >= 0 else [-(parts(w + 1e-6 * e)[1] - parts(w - 1e-6 * e)[1]) / 2e-6 for e in np.eye(7)], atol=1e-6)


def test_samples_take_long_texts(spark):
    from stepfree.llm import labelled

    docs = spark.createDataFrame([(i, ("long " * 60_000 if i % 2 else "short") + str(i)) for i in range(40)] + [(3, "again")] * 5, "doc_id long, text string")
    ids = labelled.hashed_first(docs.select("doc_id"), 30, 1).select("doc_id", F.lit(1).alias("label"), "place")
    rows = labelled.sample_texts(docs, ids)
    assert len(rows) == 30 == len({r[0] for r in rows}) and any(len(r[2]) > 200_000 for r in rows)
    few = labelled.sample_texts(docs, ids, max_bytes=1_000_000)
    assert 1 <= len(few) < 30 and set(few) <= set(rows) and few == labelled.sample_texts(docs.repartition(3), ids, max_bytes=1_000_000)


# pipeline


def test_pipeline(spark, odd, odd_rows):
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = spark.createDataFrame(stage(spark, docs, DATA).collect(), before.schema)
        assert docs.columns == before.columns, name
        if name == "quality_rules":
            assert {r["doc_id"] for r in docs.collect()} >= {100, 101, 120}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert packed.count() >= docs.count() > 0
