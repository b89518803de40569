import itertools
import random
import time
import zlib

import pytest
from pyspark.sql import functions as F

from quillstone.llm import hilbert, html_text, url_filter


@pytest.mark.parametrize(("d", "bits"), [(1, 3), (2, 3), (3, 2)])
def test_curve_visits_neighbours(spark, d, bits):
    cells = list(itertools.product(range(1 << bits), repeat=d))
    df = spark.createDataFrame([(list(c),) for c in cells], "c array<int>")
    got = df.select("c", hilbert.curve_index([F.col("c")[i] for i in range(d)], bits).alias("h")).orderBy("h").collect()
    assert [r["h"] for r in got] == list(range(len(cells)))
    assert all(sum(abs(a - b) for a, b in zip(x["c"], y["c"])) == 1 for x, y in zip(got, got[1:]))


@pytest.mark.parametrize("law", ["rows", "bytes"])
def test_shards(spark, sf, law):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    extra = spark.createDataFrame([(None, None, None, None, None), (0, "again", "en", "s", 5), (0, "again", "en", "s", 5)], df.schema)
    rows = df.unionByName(extra)
    got = hilbert.sharded(rows, law=law).collect()
    texts = {r["doc_id"]: r["text"] for r in df.collect()}
    assert len(got) == rows.count()
    by = {s: [r for r in got if r["shard"] == s] for s in range(16)}
    for s, rs in by.items():
        assert sorted(r["slot"] for r in rs) == list(range(len(rs)))
    for r in got:
        if r["doc_id"]:
            assert r["size"] == len(texts[r["doc_id"]].encode()) + 1 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode())
    if law == "rows":
        assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    else:
        total, most = sum(r["size"] for r in got), max(r["size"] for r in got)
        assert all(abs(sum(r["size"] for r in rs) - total / 16) <= most for rs in by.values())
    # runs of the curve
    ends = sorted((min(r["curve"] for r in rs), max(r["curve"] for r in rs)) for rs in by.values())
    assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:]))


def test_shards_carry_and_write_rows(spark, sf, tmp_path):
    df = spark.read.parquet(f"{sf}/documents.parquet").withColumn("size", F.lit("given"))
    got = hilbert.sharded(df)
    assert got.select("doc_id", "text", "lang", "source", "n_chars", F.col("input_size").alias("size")).exceptAll(df).count() == 0 and got.count() == df.count()
    hilbert.write(df, str(tmp_path / "shards"), shards=4)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.select("doc_id", "text").exceptAll(df.select("doc_id", "text")).count() == 0 and back.count() == df.count()
    assert sorted(p.name for p in (tmp_path / "shards").glob("shard=*")) == [f"shard={i}" for i in range(4)]


def test_shards_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert hilbert.sharded(df).count() == 0


def test_urls(spark):
    urls = ["http://Blog.Example.ORG/es/1?x#y", "https://example.org/en/12", "http://x.com/fr/1", "http://x.com/de/1", "http://casino.net/", "http://x.net/cheap-pills", "http://x.net/cheaply-pills", None, "no scheme casino", "http://x.net/free/free", "http://org/", "http://evilorg/en"]
    df = spark.createDataFrame([(i, u, 1) for i, u in enumerate(urls)], "page_id long, url string, rule int")
    got = {r["page_id"]: r for r in url_filter.judged(df).collect()}
    assert [got[i]["verdict"] for i in range(len(urls))] == ["block", "block", "allow", "block", "block", "block", "allow", "allow", "block", "allow", "allow", "allow"]
    assert (got[0]["host"], got[0]["path"], got[0]["rule"]) == ("blog.example.org", "/es/1", "example.org/es/") and got[8]["host"] == "" and got[11]["rule"] is None
    assert url_filter.judged(df.limit(0)).count() == 0


def test_url_weights_from_a_table(spark):
    terms = spark.createDataFrame([("Bad", 1.0), ("half", 0.5), ("half", 0.2), ("third", 0.34), ("", 1.0), (None, 1.0), ("none", None)], "term string, weight double")
    weights = url_filter.vocabulary(terms)
    assert weights == {"bad": 1.0, "half": 0.5, "third": 0.34}
    long = "http://x.net/" + "a" * 100_000 + "/bad"
    urls = ["http://x.net/bad", "http://x.net/half/half", "http://x.net/half/third", "http://x.net/half-third-half", "http://bad.org/", long, "http://x.net/badé", long]
    df = spark.createDataFrame([(i % 7, u, "x") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    got = [(r["page_id"], r["verdict"]) for r in url_filter.judged(df, weights=weights).collect()]
    assert sorted(got) == sorted([(0, "block"), (1, "allow"), (2, "allow"), (3, "allow"), (4, "allow"), (5, "block"), (6, "allow"), (0, "block")])


def layout(rng, depth=0):
    """A random piece of a page: (HTML with many end tags left out, lines that it renders as)."""
    word = lambda: "".join(rng.choice("abcdefgé") for _ in range(rng.randint(1, 7)))
    kind = rng.choice(["p", "p", "table", "ul", "ol"] if depth < 3 else ["p"])
    blank = lambda: rng.choice(["", " ", "\n", "\n\t "])
    if kind == "p":
        words = [word() for _ in range(rng.randint(1, 9))]
        return "<p>" + blank() + (" " + blank()).join(w if rng.random() < 0.7 else f"<b>{w}</b>" for w in words) + blank() + rng.choice(["", "</p>"]), [" ".join(words)]
    if kind == "table":
        n = rng.randint(1, 4)
        rows = [[word() for _ in range(n)] for _ in range(rng.randint(1, 4))]
        widths = [max(len(r[i]) for r in rows) for i in range(n - 1)] + [0]
        code = "<table>" + rng.choice(["", "<tbody>"]) + "".join("<tr>" + "".join(rng.choice(["<td>", "<th>"]) + c + rng.choice(["", "</td>", "</th>"][:1]) + blank() for c in r) for r in rows) + "</table>"
        return code, ["  ".join(c.ljust(w) for c, w in zip(r, widths)).rstrip() for r in rows]
    code, lines = f"<{kind}>", []
    for i in range(rng.randint(1, 3)):
        mark = f"{i + 1}. " if kind == "ol" else "- "
        parts = [layout(rng, depth + 1) for _ in range(rng.randint(1, 2))]
        code += "<li>" + blank() + blank().join(p for p, _ in parts)
        own = [x for _, ls in parts for x in ls]
        lines += [(mark if j == 0 else " " * len(mark)) + x for j, x in enumerate(own)]
    return code + f"</{kind}>", lines


def test_html_random_layouts():
    """Pages made from a layout render as that layout."""
    rng = random.Random(11)
    for _ in range(400):
        parts = [layout(rng) for _ in range(rng.randint(1, 4))]
        code = rng.choice(["", "<html><head><title>t</title></head><body>"]) + "".join(p for p, _ in parts)
        assert html_text.text_of(code) == "\n\n".join("\n".join(ls) for _, ls in parts), code


def test_html_visibility_and_spans():
    text = html_text.text_of
    assert text("<style>.a{display:none}.a.b{display:block} #x,p.q{visibility:hidden} @media print{div{display:none}} u{display:none;}</style><div class=a>no</div><div class='a b'>yes</div><p id=x>gone <b style='visibility:visible'>seen</b></p><p class=q>no</p><u>no</u>") == "yes\n\nseen"
    assert text("<select><option>One<option>Two</select><textarea>some\n text &amp; more</textarea>") == "One\nTwo\nsome\n text & more"
    assert text("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>dd<td>e</table>") == "a   b\n    c\ndd  e"
    assert text("<table><tr><td colspan=150>a<td>b<tr>" + "".join(f"<td>{i % 10}" for i in range(151)) + "</table>").split("\n")[0].split() == ["a", "b"]
    assert text("<table><tr><td colspan=x rowspan=0>a<td>b</table>") == "a  b"
    deep = text("<ul><li>" * 30 + "x" + "<table><tr><td>a<td>b</table>")
    assert deep.split("\n")[0] == "- " * 30 + "x" and deep.endswith(" " * 60 + "a  b")


@pytest.mark.parametrize("tag", ["div", "ul><li", "table><tr><td", "p", "b", "x-y"])
def test_html_time_is_linear_in_nesting(tag):
    page = f"<{tag}>" * 20_000 + "deep"
    start = time.process_time()
    assert html_text.text_of(page).endswith("deep")
    assert time.process_time() - start < 8


def test_html_layout():
    text = html_text.text_of
    assert text("<ul><li>one<li>two<ol start=3><li>a<p>b<li>c</ol></ul>x") == "- one\n- two\n  3. a\n     b\n  4. c\n\nx"
    assert text("<table><tr><th>Name<th>N<tr><td>Anna<td>12<tr><td>B<td>3</table>") == "Name  N\nAnna  12\nB     3"
    assert text("a<p hidden>no<p style='display: none'>no<script>var x='</p>';</script><p>yes <b>bo ld</b>er<br>next") == "a\n\nyes bo lder\nnext"
    assert text("<pre>a\n  b\n\nc</pre>&copy; 1 < 2 <!-- no --> &amp;lt;") == "a\n  b\n\nc\n\n© 1 < 2 &lt;"
    assert text("<div>a<div>b</div>c</div></span></p>d<td>e") == "a\nb\nc\nd e"
    assert text(None) == text("") == "" and text("<") == "<" and text("<p") == ""
    assert text("<div>" * 5000 + "deep") == "deep" and "deep" in text("<ul><li>" * 300 + "deep")


def test_html_query(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").withColumn("text", F.lit(1))
    got = html_text.extracted(pages.unionByName(spark.createDataFrame([(None, None, None, 1)], pages.schema))).collect()
    assert len(got) == pages.count() + 1
    assert all("<p>" not in r["text"] and "track(" not in r["text"] for r in got) and {r["text"] for r in got if r["page_id"] is None} == {""}
    assert html_text.extracted(pages.limit(0)).count() == 0


def test_strings_with_a_common_beginning_are_told_apart(spark):
    df = spark.createDataFrame([(i, "t", f"https://site{i % 4}", None, None) for i in range(400)], "doc_id long, text string, lang string, source string, n_chars long")
    got = hilbert.sharded(df).collect()
    assert len({r["curve"] for r in got}) == 4
    assert hilbert.string_edges(df, "lang", 63) == [f"https://site{k}" for k in range(4)] and hilbert.string_edges(df, "source", 63) == []
    assert len(hilbert.string_edges(spark.range(1000).selectExpr("lpad(id, 5, '0') v"), "v", 7)) == 7


def test_curve_prunes_more_than_chance(spark, sf):
    """Of 16 shards, a filter on any one dimension must read fewer than of shards by chance."""
    df = spark.read.parquet(sf.replace("0.001", "0.01") + "/documents.parquet")
    rows = hilbert.sharded(df).select("shard", "lang", "source", "n_chars", F.pmod(F.xxhash64("doc_id"), F.lit(16)).alias("chance")).collect()

    def read(shard, keep):
        """Shards whose range of the dimension meets the filter."""
        out = 0
        for s in range(16):
            own = [r for r in rows if r[shard] == s]
            out += keep(own)
        return out

    def spans(shard):
        total = 0
        for c in ("lang", "source", "n_chars"):
            values = sorted({r[c] for r in rows})
            for v in values[:: max(1, len(values) // 20)]:
                total += read(shard, lambda own, c=c, v=v: min(r[c] for r in own) <= v <= max(r[c] for r in own))
        return total

    assert spans("shard") < 0.7 * spans("chance")


@pytest.mark.parametrize("rule", ["p{display:block}", "p.c%d{display:none}", ".a.c%d{display:block}", "#x%d.a{visibility:hidden}"])
def test_style_rules_take_linear_time(rule):
    n = 4000
    style = "".join(rule.replace("%d", str(i)) for i in range(n))
    body = "".join(f"<p class='a c{i}' id=x{i}>w{i}" for i in range(n))
    began = time.process_time()
    text = html_text.text_of(f"<style>{style}</style>{body}")
    assert time.process_time() - began < 3
    assert len(text.split()) == (n if "block" in rule else 0)


def test_style_rules_by_weight_and_order():
    def shown(style, body="<p class='a b' id=i>x</p>"):
        return html_text.text_of(f"<style>{style}</style>{body}").strip() == "x"

    assert not shown("p.a{display:none}") and shown("p.a{display:none} p.a{display:block}")
    # a repeated selector keeps the place of a property that only its first rule sets
    assert not shown("p.a{display:block} p.b{display:none} p.a{visibility:visible}")
    assert shown("p.b{display:none} p.a{display:block}") and shown(".a.b{display:block} p{display:none} .a{display:none}")
    assert shown("#i{display:block} .a.b{display:none}") and not shown(".b.a{display:none} *{display:block}")
