"""The registered queries and the pipeline on the smallest tables."""

import sys
from pathlib import Path

import pytest
from brute_force import contamination_rows, jaccard_rows, removed

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from checks.compare import _rows, connect  # noqa: E402
from tallyhouse.llm import langid, mixing  # noqa: E402
from tallyhouse.llm.queries import ORACLES, QUERIES  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return connect(FOLDER)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, db, name):
    df = QUERIES[name](spark, FOLDER)
    got = _rows(df.columns, df.collect())
    assert got
    if name in ORACLES:
        result = db.execute(ORACLES[name])
        names = [d[0] for d in result.description]
        assert sorted(names) == sorted(df.columns)
        assert got == _rows(names, result.fetchall())


@pytest.mark.parametrize("name", ["op3_decontamination", "op7_license_scan"])
def test_native_queries_have_no_python(spark, name):
    plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Arrow", "Pandas", "CartesianProduct", "NestedLoop"))


def test_language_id_on_held_out_texts(spark):
    docs = spark.read.parquet(FOLDER.replace("0.001", "0.01") + "/documents.parquet")
    found = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    right = found.filter("lang = lang_pred").count()
    assert right >= 0.97 * found.count()


def test_pipeline(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()]
    columns, at = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        out = stage(spark, docs, FOLDER)
        at[name] = (before, out)
        if name != "mixing":
            assert out.columns == columns
            docs = spark.createDataFrame(out.collect(), out.schema)
    after = {k: [(r.doc_id, r.text) for r in v[1].collect()] for k, v in at.items()}

    assert len(after["language_id"]) == len(at["language_id"][0])  # all of them have letters

    before = at["near_copies"][0]
    assert sorted(d for d, _ in after["near_copies"]) == sorted({r[2] for r in jaccard_rows(before, 80, 5)})

    want = {}
    before = at["substring_dedup"][0]
    for (d, t), (w, gone) in zip(before, removed(before, 50)):
        kept = " ".join(x.decode() for x, g in zip(w, gone) if not g)
        if not any(gone) or kept:
            want[d] = kept if any(gone) else t
    assert dict(after["substring_dedup"]) == want

    before = at["decontamination"][0]
    assert sorted(d for d, _ in after["decontamination"]) == [
        r[0] for r in contamination_rows(before, items) if not r[5]]

    taken = {r.doc_id: r.taken // r.size for r in mixing.mix_sources(docs).collect() if r.size}
    copies = {}
    for d, _ in after["mixing"]:
        copies[d] = copies.get(d, 0) + 1
    assert copies == {d: n for d, n in taken.items() if n}
    assert corpus_pipeline.run(spark, FOLDER).count() == len(after["mixing"])


def test_near_copies_of_the_pipeline(spark):
    """One changed word in every 50: 3-word Jaccard below 0.9, 5-word Jaccard above 0.8."""
    def text(tag, n):
        return [f"{tag}{i}" for i in range(n)]

    rows = []
    for i, step in enumerate((30, 45, 48, 50, 52, 56)):
        words = text(f"t{i}x", 400)
        copy = [f"new{w}" if j % step == 20 else w for j, w in enumerate(words)]
        rows += [(2 * i, " ".join(words), "en", "s", 1), (2 * i + 1, " ".join(copy), "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(r.doc_id for r in corpus_pipeline.join_near_copies(spark, docs, FOLDER).collect())
    plain = [r[:2] for r in rows]
    assert got == sorted({r[2] for r in jaccard_rows(plain, 80, 5)})
    assert len(got) < len({r[2] for r in jaccard_rows(plain)})


def test_near_copy_stage_on_the_smallest_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    got = sorted(r.doc_id for r in corpus_pipeline.join_near_copies(spark, docs, FOLDER).collect())
    plain = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert got == sorted({r[2] for r in jaccard_rows(plain, 80, 5)})
