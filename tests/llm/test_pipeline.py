"""The pipeline's stages, each on its own input, against brute force."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from terravane.llm import language_id  # noqa: E402
from tests.llm.test_operators import LONG, brute_lines, components, hits, language_rows, sets  # noqa: E402


@pytest.fixture
def corpus(spark, tmp_path):
    base = [(i, t, g, "s") for i, t, g in language_rows()]
    copies = [(500 + i, base[i][1], base[i][2], "s") for i in range(20)]
    near = [(600 + i, base[i][1].replace("the", "thee", 1), base[i][2], "s") for i in range(40, 60)]
    item = " ".join(f"q{k}" for k in range(30))
    dirty = [(700 + i, base[i][1] + "\nand then " + " ".join(f"q{k}" for k in range(i - 60, i - 48)) + " went", "en", "s") for i in range(60, 66)]
    odd = [(800, None, "en", None), (801, "", None, "s"), (802, "12 !", "de", "s"), (803, LONG, "en", "s"), (None, "le chat que ment", "fr", "s")]
    spark.createDataFrame(base + copies + near + dirty + odd, "doc_id long, text string, lang string, source string").withColumnRenamed("source", "source").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def test_stages(spark, corpus):
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "lines", "near_duplicates", "decontamination", "packing"]
    d = spark.read.parquet(f"{corpus}/documents.parquet")
    key = lambda df: sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in df.collect())

    told = language_id.language_id(d)
    a = stages["language"](spark, d, corpus).cache()
    assert not {800, 801, 802} & {r.doc_id for r in a.collect()}
    assert a.columns == d.columns and key(a) == key(d.join(told.where("lang_pred <> 'und' AND score >= 0.35").select("doc_id").distinct(), "doc_id").union(d.where("doc_id IS NULL").select("doc_id", "text", "lang", "source")))

    b = stages["lines"](spark, a, corpus).cache()
    rows = [(r.doc_id, r.text) for r in a.collect()]
    cut = [(i, "\n".join(x for n, x in enumerate(t.split("\n")) if n not in g), len(g)) for (i, t), g in zip(rows, brute_lines(rows), strict=True)]
    assert b.columns == d.columns and key(b) == sorted((i is None, i or 0, t) for i, t, n in cut if not n or t.strip())

    c = stages["near_duplicates"](spark, b, corpus).cache()
    s = {r.doc_id: sets(r.text) for r in b.collect() if r.doc_id is not None}
    label = components([(x, y) for x in s for y in s if x < y and s[x] and s[y] and 5 * len(s[x] & s[y]) >= 4 * len(s[x] | s[y])], s)
    assert c.columns == d.columns and [r.doc_id for r in c.where("doc_id IS NOT NULL").orderBy("doc_id").collect()] == sorted(set(label.values()))

    e = stages["decontamination"](spark, c, corpus).cache()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{corpus}/benchmark.parquet").collect()]
    assert e.columns == d.columns and key(e) == sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in c.collect() if not hits(r.text, items)[1])
    assert e.count() < c.count()

    f = stages["packing"](spark, e, corpus)
    assert f.count() == e.count()


def test_run_is_the_stages_one_after_another(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, corpus).toArrow())
    key = lambda df: sorted(map(repr, df.collect()))
    out = corpus_pipeline.run(spark, corpus)
    assert key(out) == key(docs) and out.count() > 200


def test_stages_on_odd_tables(spark, corpus):
    """Empty tables, no language to learn from, repeated rows, rows without ids, and columns with the names that operators use."""
    schema = "doc_id long, text string, lang string, gone string, d string, h1 string, __version string"
    full = [(None, "le chat", None, "a", "b", "c", "d"), (1, "eins zwei", None, "a", "b", "c", "d"), (1, "eins zwei", None, "a", "b", "c", "d"), (2, None, None, "a", "b", "c", "d")]
    for rows in ([], full):
        d = spark.createDataFrame(rows, schema)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, d, corpus)
            assert out.columns == d.columns
            kept = out.collect()
            assert len(kept) == (len(rows) - (name == "language") if rows else 0), name
            assert all(r.gone == "a" and r["__version"] == "d" for r in kept)
        assert corpus_pipeline.STAGES[-1][1](spark, d, corpus).count() == len(rows)
