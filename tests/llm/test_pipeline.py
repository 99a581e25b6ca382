"""The pipeline's stages against plain versions of what they must keep."""

from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from tests.llm.test_operators import ODD, brute_lines, fold, union_find, words

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name))
        stage(spark, docs, SF).write.mode("overwrite").parquet(path)
        out.append((name, docs, spark.read.parquet(path)))
        docs = out[-1][2]
    return {name: (before, after) for name, before, after in out}


def test_stages_return_documents(steps):
    for name, (before, after) in steps.items():
        if name != "mixing":
            assert after.dtypes == before.dtypes


def test_rejected_documents_go_and_good_ones_stay(spark, steps):
    before, after = steps["quality"]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = before.join(after.select("doc_id", F.lit(1).alias("kept")), "doc_id", "left").join(labels, "doc_id").toPandas()
    assert (kept[kept.quality == 1].kept == 1).mean() > 0.95 and (kept[kept.quality == 0].kept == 1).mean() < 0.15


def test_shared_lines_go(steps):
    before, after = steps["lines"]
    want = {i: t for i, _, _, t in brute_lines([tuple(r) for r in before.select("doc_id", "text").collect()], 10)}
    assert {r["doc_id"]: r["text"] for r in after.select("doc_id", "text").collect()} == want


def test_one_of_each_group_stays(steps):
    before, after = steps["simhash"]
    kept = {r["doc_id"] for r in after.collect()}
    low = {}
    for r in before.orderBy("doc_id").collect():
        low.setdefault(r["text"], r["doc_id"])
    assert all(kept_id in low.values() for kept_id in kept) and len(kept) > 0.5 * before.count()


def test_the_groups_are_those_of_all_pairs(steps):
    before, after = steps["simhash"]
    texts = {r["doc_id"]: words(r["text"]) for r in before.collect()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)} for i, w in texts.items()}
    holders = {}
    for i, mine in sets.items():
        for x in mine:
            holders.setdefault(x, []).append(i)
    links = []
    for i, mine in sets.items():
        common = Counter(j for x in mine for j in holders[x] if j > i)
        links += [(i, j) for j, n in common.items() if n >= 0.8 * (len(mine) + len(sets[j]) - n) - 1e-9]
    group = union_find(links, sets)
    assert len({len(sets[i] ^ sets[j]) for i, j in links}) > 1  # not only equal sets
    assert {r["doc_id"] for r in after.collect()} == {i for i, g in group.items() if i == g}


def test_leaks_go(spark, steps):
    before, after = steps["benchmark"]
    items = [fold(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaky = {r["doc_id"] for r in before.collect() if any(i in fold(r["text"]) for i in items)}
    kept = {r["doc_id"] for r in after.collect()}
    assert not leaky & kept and len(kept) >= before.count() - len(leaky) - 2


def test_mix_covers_what_is_left(steps):
    before, after = steps["mixing"]
    assert after.count() == before.count()


def test_stages_take_odd_tables(spark):
    table = spark.createDataFrame([r for r in ODD], "doc_id long, text string, lang string, source string, n_chars long").coalesce(2)
    for docs in (table, table.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            assert name == "mixing" or out.columns == docs.columns
            out.count()
