import re
from collections import Counter

import pytest
from brute import LOW

from quillstone.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain(rows, least=10, top=10):
    """The contract over (text, lang, source) rows, term by term."""
    docs = [((t or "").translate(LOW), lang or "", s or "") for t, lang, s in rows]
    out = []
    for lang in {d[1] for d in docs}:
        counts, df = {}, Counter()
        for text, _, s in (d for d in docs if d[1] == lang):
            found = TERM.findall(text)
            df.update(set(found))
            counts.setdefault(s, Counter()).update(found)
        kept = [t for t, n in df.items() if n >= least]
        counts[None] = sum(counts.values(), Counter())
        p = {}
        for s, c in counts.items():
            n = sum(c[t] for t in kept)
            p[s] = {t: 1 + 1_000_000_000 * (c[t] + 2) // (n + 2 * len(kept)) for t in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in counts.keys() - {None}:
            pairs = [("pair", o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in counts.keys() - {None, s}]
            terms = [("term", t, f(p[s][t], p[None][t])) for t in kept if counts[s][t] and p[s][t] > p[None][t]]
            for part, limit in ((pairs, None), (terms, top)):
                best = sorted(part, key=lambda x: (-x[2], x[1].encode()))[:limit]
                out += [(lang, s, kind, item, value, i + 1) for i, (kind, item, value) in enumerate(best)]
    return sorted(out)


def got(df, **options):
    out = divergence.audited(df, **options)
    assert out.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(tuple(r) for r in out.collect())


def of(df):
    return [(r["text"], r["lang"], r["source"]) for r in df.collect()]


def test_equals_brute_force(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    assert got(df) == plain(of(df))


@pytest.mark.parametrize(("cells", "room", "few"), [(40, 8 << 20, True), (40, 60, True), (1 << 16, 1, False)])
def test_parts_blocks_and_salts(spark, sf, monkeypatch, cells, room, few):
    df = spark.read.parquet(f"{sf}/documents.parquet").where("lang <> 'en'")
    monkeypatch.setattr(divergence, "CELLS", cells)
    monkeypatch.setattr(divergence, "ROOM", room)
    monkeypatch.setattr(divergence, "SCATTERED", 50)
    if not few:
        monkeypatch.setattr(divergence, "BROADCAST_GROUPS", 1)
    assert got(df, least=4) == plain(of(df), least=4)


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr("quillstone.llm._arrow.CHUNK_BYTES", 1 << 12)
    words = "Älter ÄLTER Tree tree's x1y _ 12 日本 naïve"
    rows = [(words, "en", "a")] * 3 + [(None, "en", "b"), ("", "en", None), (None, None, None), ("tree " * 30_000, "en", "b"), ("tree 日本 s", "", "c"), ("tree tree", None, "d"), ("... 123", "xx", "only"), ("tree s y x", "en", "")]
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    for least in (1, 2, 3):
        assert got(df, least=least) == plain(rows, least)
    clash = df.selectExpr("text", "lang", "source", "1 AS value", "'x' AS term", "0 AS rank")
    assert got(clash, least=2) == plain(rows, 2)
    assert got(df.limit(0)) == []


def test_equal_values_are_ordered_by_bytes(spark):
    rows = [("b a ä z Z", "en", s) for s in ("é", "z", "a")] * 4
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    found = got(df)
    assert found == plain(rows)
    assert [r[3] for r in sorted(found, key=lambda r: r[5]) if r[1] == "a" and r[2] == "pair"] == ["z", "é"]
