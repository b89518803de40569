import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quillstone.llm import language_id, toxicity
from quillstone.llm.queries import op1_language_id, op4_toxicity


def test_language_code_lengths_by_definition():
    """Table lookups equal a byte-by-byte PPM with escapes."""
    texts = {"x": ["abcabcabdabc hello", "abc ab"], "y": ["zzy zyx abx", "hello zz"]}
    counts = {}
    for lang, ts in texts.items():
        raw = b"".join(language_id.START + t.encode() for t in ts)
        grams, n = np.unique([int.from_bytes(raw[i : i + 4], "big") for i in range(len(raw) - 3)], return_counts=True)
        counts[lang] = (grams.astype(np.int64), n)
    model = language_id.model_of(counts)
    got = model.code_lengths(pa.array(["abx hello q", "", "zz"]))
    for row, text in zip(got, ["abx hello q", "", "zz"]):
        for j, lang in enumerate(model.languages):
            table = {}
            for g, n in zip(*counts[lang]):
                b = int(g).to_bytes(4, "big")
                for k in range(4):
                    table.setdefault(b[3 - k : 3], {}).setdefault(b[3], 0)
                    table[b[3 - k : 3]][b[3]] += int(n)

            def p(context, byte, table=table):
                if context is None:
                    return 1 / 256
                lower = p(context[1:] if context else None, byte)
                c = table.get(context)
                if not c:
                    return lower
                some = sum(c.values()) + len(c)
                return c[byte] / some if byte in c else len(c) / some * lower

            full = language_id.START + text.encode()
            want = sum(-np.log2(p(full[i - 3 : i], full[i])) for i in range(3, len(full)))
            assert abs(row[j] - want) < 1e-6


def test_language_counts_and_long_texts(spark, monkeypatch):
    """The trees hold every 4-gram of the labelled texts, rare ones included; blocks of a long text add up to it."""
    rows = [(1, "abcd abcd xyz", "x"), (2, "q once", "x"), (3, "zzz", "y"), (4, "never", None)]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    for tree, texts in zip(model.trees, (["abcd abcd xyz", "q once"], ["zzz"])):
        want = {}
        for t in texts:
            raw = language_id.START + t.encode()
            for i in range(len(raw) - 3):
                want[raw[i : i + 4]] = want.get(raw[i : i + 4], 0) + 1
        kept = {int(g).to_bytes(4, "big") for g in tree.grams[3]}
        assert set(want) <= kept and len(kept) <= len(want) + 3 * len(texts)
    text = "abcd xyz q once " * 400
    whole = model.code_lengths(pa.array([text]))
    monkeypatch.setattr(language_id, "CHUNK_BYTES", 1000)
    assert np.allclose(model.code_lengths(pa.array([text])), whole)


def test_language_accuracy(spark, sf):
    out = op1_language_id(spark, sf.replace("0.001", "0.01")).collect()
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet").collect()}
    held = [r for r in out if r["held_out"]]
    assert len(out) == len(docs) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in out)
    assert np.mean([r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in out)


def test_language_edge_cases(spark):
    rows = [(1, "the cat sat on the mat and the dog", "en", 1), (2, "der hund und die katze sind hier", "de", 1), (3, None, "en", 1), (4, "12 !?", None, 1), (None, "the mat", None, 1), (5, "", None, 1), (6, "und die katze", None, 1), (6, "und die katze", None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    got = language_id.identified(df, language_id.train(df)).collect()
    assert sorted((r["doc_id"] or 0, r["lang_pred"]) for r in got) == [(0, "en"), (1, "en"), (2, "de"), (3, "und"), (4, "und"), (5, "und"), (6, "de"), (6, "de")]
    nothing = language_id.train(df.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in language_id.identified(df, nothing).collect()} == {"und"}
    assert language_id.identified(df.limit(0), nothing).count() == 0


def area(scores, labels):
    order = np.argsort(scores, kind="stable")
    ranks = np.empty(len(order))
    ranks[order] = np.arange(len(order))
    n = labels.sum()
    return (ranks[labels == 1].sum() - n * (n - 1) / 2) / n / (len(labels) - n)


def test_toxicity_held_out(spark, sf):
    big = sf.replace("0.001", "0.1")
    out = spark.createDataFrame(op4_toxicity(spark, big).where("held_out").toPandas())
    rows = out.join(spark.read.parquet(f"{big}/labels.parquet"), "doc_id").collect()
    score, label = np.array([r["score"] for r in rows]), np.array([r["toxic"] for r in rows])
    assert area(score, label) > 0.93
    assert np.mean(score[label == 0] < 0.5) > 0.97


def test_toxicity_edge_cases(spark):
    rows = [(i, f"some ordinary words {i} in a text", 1.0) for i in range(30)] + [(100 + i, f"you vileword number {i} here", 1.0) for i in range(30)] + [(7, None, 1.0), (None, "you vileword number 5 here", 1.0), (8, "", 1.0), (9, "x" * 300_000, 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, 0) for i in range(30)] + [(100 + i, 1) for i in range(30)] + [(None, 1), (5, None), (6, 3)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = toxicity.scored(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert {r["doc_id"] for r in got if r["score"] >= 0.5} == {*range(100, 130), None}
    kept = toxicity.without_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 31
    empty = toxicity.train(docs, labels.limit(0))
    assert {r["score"] for r in toxicity.scored(docs, empty).collect()} == {0.0} and toxicity.scored(docs.limit(0), model).count() == 0


def test_toxicity_windows_and_gains():
    """Windows and gains by the definition, one window and one text at a time; a long text is the sum of its blocks."""
    texts = ["one two  three\nfour fiveandalongword " * 20, "", "x", "end vileword"]
    model = toxicity.fit(["you vileword number %d here" % i for i in range(40)], ["some ordinary words %d in a text" % i for i in range(40)])
    raw, offsets = toxicity._padded(pa.array(texts))
    text, starts, ends = toxicity.windows(raw, offsets)
    got = [(int(t), raw[a:b].tobytes()) for t, a, b in zip(text, starts, ends)]
    want = []
    for i, t in enumerate(texts):
        padded, last = " " + t + " " * 8, None
        for j in range(1, len(padded)):
            if padded[j - 1].isspace() and not padded[j].isspace() and j // toxicity.STEP != last:
                last = j // toxicity.STEP
                want.append((i, padded[j : j + toxicity.WINDOW].encode()))
    assert got == want
    at, gain = model.gains(pa.array(texts))
    one, two = (toxicity._compressor(x) for x in (model.ordinary, model.toxic + model.ordinary))
    assert gain.tolist() == [len(one.compress(w)) - len(two.compress(w)) for _, w in want] and at.tolist() == [sum(i < k for i, _ in want) for k in range(5)]
    assert gain[-1] > 2


def test_toxicity_dictionaries_are_trained_on_whole_texts_of_both_classes(spark):
    """A toxic word that stands behind 40,000 ordinary characters is learnt."""
    filler = "plain words of an ordinary text come here again and again, " * 700
    rows = [(i, f"{filler} {i} you vileword number {i} here" if i % 5 == 0 else f"{filler} {i} nothing else here") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(60)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert b"vileword" in model.toxic and b"ordinary text" in model.ordinary and b"vileword" not in model.ordinary
    score = model.score(pa.array([f"{filler} but you vileword number 9 here", filler]))
    assert score[0] > score[1]


def test_toxicity_odds_past_both_limits(spark):
    """The same population at ten times the rows, of which both samples are full, is given the same odds."""
    means = []
    for n in (1000, 10_000):
        # one row in ten is toxic; a tenth of either class reads like the other
        rows = [(i, f"you vileword number {i} here" if (i % 10 == 0) ^ (i // 10 % 10 == 0) else f"some ordinary words {i} in a text", int(i % 10 == 0)) for i in range(n)]
        df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
        model = toxicity.train(df.select("doc_id", "text"), df.select("doc_id", "toxic"), toxic_rows=400, ordinary_rows=800)
        means.append(model.score(pa.array([t for _, t, _ in rows])).mean())
    assert np.allclose(means, 0.1, atol=0.03), means


def test_toxicity_of_fewer_documents_is_learnt_beside_the_common_one(spark, sf):
    """Most toxic rows are English; six in ten of the held-out ones in other languages are found too."""
    big = sf.replace("0.001", "0.1")
    docs = spark.read.parquet(f"{big}/documents.parquet").join(spark.read.parquet(f"{big}/labels.parquet"), "doc_id").where("toxic = 1 and lang <> 'en' and crc32(cast(doc_id as string)) % 5 = 0").select("doc_id", "text").collect()
    model = toxicity.train(*(spark.read.parquet(f"{big}/{name}.parquet").where("crc32(cast(doc_id as string)) % 5 <> 0") for name in ("documents", "labels")))
    assert len(docs) > 30 and np.mean(model.score(pa.array([r["text"] for r in docs])) >= 0.5) > 0.6


def test_toxicity_is_learnt_for_each_kind_of_texts():
    """Three languages, of which each has insults of its own: texts are told apart by language, and each one's insults are found."""
    pick = np.random.default_rng(5)
    syllables = [["".join(pick.choice(list(letters), 3)) for _ in range(24)] for letters in ("aeinrstl", "oubdgkmv", "éçêchjpy")]

    def text(language: int, insult: bool) -> str:
        words = ["".join(pick.choice(syllables[language], pick.integers(1, 4))) for _ in range(180)]
        for at in pick.choice(180, 2) if insult else ():
            words[at] = ("zwarx", "quixof", "wozilt")[language] + str(pick.choice(syllables[language]))
        return " ".join(words)

    rows = [(k, bad, text(k, bad)) for k, n in ((0, 160), (1, 80), (2, 80)) for bad in (True, False, False) for _ in range(n)]
    model = toxicity.fit([t for _, bad, t in rows if bad], [t for _, bad, t in rows if not bad])
    assert len(model.kinds) == 3
    for k in range(3):
        fresh = [text(k, i < 40) for i in range(80)]
        score = model.score(pa.array(fresh))
        assert (score[:40] >= 0.5).mean() > 0.9 and (score[40:] < 0.5).mean() > 0.9
        told = toxicity._nearest([x.heads for x in model.kinds], toxicity._heads(pa.array(fresh)))
        assert len(set(told)) == 1
        # scores don't depend on what else is in a piece
        assert np.allclose(score[:3], [model.score(pa.array([t]))[0] for t in fresh[:3]])
    mixed = [text(k % 3, k % 2 == 0) for k in range(30)]
    assert np.allclose(model.score(pa.array(mixed)), [model.score(pa.array([t]))[0] for t in mixed])
