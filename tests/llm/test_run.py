"""The whole pipeline against plain versions of its stages, each on what the one before kept."""

import corpus_pipeline
import duckdb
import pyarrow as pa
from tests.llm.test_operators import brute_lines, fold, union_find, words

from tonaris.llm import decontaminate, mixing, quality

SF = "/root/testdata/sf0.001"


def similar(texts):
    sets = []
    for t in texts:
        w = words(t)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)})
    return [(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]


def test_run_is_its_plain_stages(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    docs = {r["doc_id"]: (r["text"], r["source"]) for r in table.collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit(table, labels)
    docs = {i: d for i, d in docs.items() if model.score(*quality.passages([(d[0] or "").encode()]))[0] >= 0.5}
    docs = {i: (t, docs[i][1]) for i, _, _, t in brute_lines([(i, t) for i, (t, _) in docs.items()], 10)}
    ids = sorted(docs)
    group = union_find([(ids[a], ids[b]) for a, b in similar([docs[i][0] for i in ids])], ids)
    docs = {i: docs[i] for i in ids if group[i] == i}
    items = [fold(r["text"]).encode() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]

    def leaks(text):
        text = fold(text).encode()
        return any(decontaminate.myers(p, text) <= decontaminate.budget(len(p), decontaminate.ERRORS) for p in items if p)

    docs = {i: d for i, d in docs.items() if not leaks(d[0])}
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": list(docs), "text": [t for t, _ in docs.values()], "source": [s for _, s in docs.values()]}))
    want = {r[0]: r[1:6] for r in con.execute(mixing.mix_sql()).fetchall()}
    got = {r["doc_id"]: (r["size"], r["source_size"], r["target"], r["taken"], r["copies"]) for r in corpus_pipeline.run(spark, SF).collect()}
    assert len(docs) > 50 and got == want
