"""The corpus operators against brute force, exact round trips and held-out accuracy, and on odd tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tonaris.llm import chat, decontaminate, embed, langid, lines, lm, mixing, quality, simhash, toxicity
from tonaris.llm import queries as q
from tonaris.llm.common import Tokens

SF = "/root/testdata/sf0.01"
LONG = " ".join(f"w{i % 977}" for i in range(30_000))
ODD = [
    (1, None, "en", "a", 0), (2, "", "en", None, 0), (3, " \t\n\x0b\f\r ", None, "b", 0), (4, "One two", "en", "a", 7),
    (4, "One two", "en", "a", 7), (None, "Same line\nother é\nSAME LINE ", "fr", "c", None), (6, LONG, "en", "a", 1),
    (7, "\u00a0x\u2003y İß 中文 \U0001f600", None, "b", 1), (8, "a b c d e f", "en", "a", 1), (9, "A B C D E F", "en", "a", 1),
    (None, None, None, None, None),
]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


@pytest.fixture(scope="module")
def odd(spark):
    kind = "doc_id long, text string, lang string, source string, n_chars long, score double, keep string, items string, size string"
    return spark.createDataFrame([(*r, 0.5, "k", "i", "s") for r in ODD], kind)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def plain(docs):
    return [tuple(r) for r in docs.select("doc_id", "text", "lang").collect()]


def held(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def union_find(pairs, ids):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_tokens_match_the_pattern():
    texts = [t or "" for _, t, *_ in ODD]
    t = Tokens([x.encode() for x in texts])
    got = [t.data[s:e].tobytes().decode() for s, e in zip(t.starts, t.ends, strict=True)]
    assert got == [w for x in texts for w in words(x)]
    assert t.count.tolist() == [len(words(x)) for x in texts]
    by_word = {}
    for w, h in zip(got, t.hashes().tolist(), strict=True):
        assert by_word.setdefault(w, h) == h
    assert len(set(by_word.values())) == len(by_word)


def test_quality_on_held_out_documents(spark):
    out = q.op1_quality(spark, SF).toPandas()
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    both = out.merge(labels, on="doc_id")
    both = both[both.held_out]
    assert (both.predicted == both.quality).mean() > 0.93
    assert len(out) == 1000 and out.score.between(0, 1).all()


def test_quality_gradient_is_right():
    rng = np.random.default_rng(0)
    model = quality.AttentionMIL(5, 4, 3)
    x, n, y = rng.normal(size=(7, 5)), np.array([3, 1, 3]), np.array([1.0, 0.0, 1.0])

    def loss():
        p = model.forward(x, n)["y"]
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    g = model.gradient(model.forward(x, n), n, y)
    for k, v in model.p.items():
        at = tuple(0 for _ in v.shape)
        old = v[at]
        v[at] = old + 1e-6
        up = loss()
        v[at] = old - 1e-6
        down = loss()
        v[at] = old
        assert g[k][at] == pytest.approx((up - down) / 2e-6, abs=1e-6)


def test_quality_forward_pass_and_passages_against_plain_ones():
    text = "  Abc, abc 12!  x" + " word\n" * 130 + "É end "
    x, n = quality.passages([text.encode(), b"", b" one"])
    parts = re.findall(r"(?:[^\x20\x09-\x0D]+[\x20\x09-\x0D]*){1,64}", text)
    assert n.tolist() == [len(parts), 1, 1] == [3, 1, 1] and x[3].sum() == 1 and (quality.passages([b""])[0] == x[3]).all()
    for row, part in zip(x, parts, strict=False):
        raw, ws, k = part.encode(), part.split(), quality._N_CLASSES
        kinds = Counter(next((i for i, c in enumerate(quality._CLASSES) if chr(b) in c), len(quality._CLASSES) + (b > 127)) for b in raw)
        assert row[:k] == pytest.approx([math.sqrt(kinds[i] / len(raw)) for i in range(k)], abs=1e-6)
        sizes = [len(w.encode()) for w in ws]
        assert row[k : k + 8] == pytest.approx([np.mean(sizes) / 10, np.std(sizes) / 5, sum(a == b for a, b in zip(ws, ws[1:], strict=False)) / len(ws), len(set(ws)) / len(ws), math.log1p(len(ws)) / 4, sum(s == 1 for s in sizes) / len(ws), sum(s > 15 for s in sizes) / len(ws), 1], abs=1e-5)
    model, rng = quality.AttentionMIL(seed=3), np.random.default_rng(5)
    model.mean, model.scale = rng.normal(size=quality.FEATURES), rng.random(quality.FEATURES) + 0.5
    got, at = model.score(x, n), 0
    for i, bag in enumerate(n.tolist()):
        hs, es = [], []
        for row in x[at : at + bag]:
            v = [(a - m) / s for a, m, s in zip(row, model.mean, model.scale, strict=True)]
            h = [math.tanh(sum(a * w for a, w in zip(v, col, strict=True))) for col in model.p["E"].T]
            dot = lambda w: [sum(a * b for a, b in zip(h, col, strict=True)) for col in w.T]  # noqa: B023, E731
            gate = [math.tanh(a) / (1 + math.exp(-b)) for a, b in zip(dot(model.p["V"]), dot(model.p["U"]), strict=True)]
            hs.append(h)
            es.append(math.exp(sum(a * b for a, b in zip(gate, model.p["w"][:, 0], strict=True))))
        z = [sum(e * h[k] for e, h in zip(es, hs, strict=True)) / sum(es) for k in range(len(hs[0]))]
        assert got[i] == pytest.approx(1 / (1 + math.exp(-sum(a * b for a, b in zip(z, model.p["c"][:, 0], strict=True)) - model.p["b"][0])))
        at += bag


def test_toxicity_chain_against_a_plain_one():
    rng = np.random.default_rng(3)
    n, size = 90, 40
    y0 = (rng.random(n) < 0.4).astype(float)
    y1 = np.where(rng.random(n) < 0.9, y0, 1 - y0)
    y0[::11] = np.nan
    has = rng.random((n, size)) < 0.1 + 0.6 * (np.arange(size) < 6) * (y1 == 1)[:, None]
    row, col = np.nonzero(has)
    chain = toxicity.Chain(["one", "two"]).fit(row, col, np.column_stack([y0, y1]), size, vocabulary=10)

    def plain(words, model, docs, seen):
        return np.array([1 / (1 + math.exp(-(sum(model.w[k] for k, w in enumerate(words) if has[d, w]) + sum(a * b for a, b in zip(model.d, seen[i], strict=True)) + model.b))) for i, d in enumerate(docs)])

    everything, none = np.arange(n), np.zeros((n, 0))
    first = plain(chain.links[0].words, chain.links[0].model, everything, none)
    both = plain(chain.links[1].words, chain.links[1].model, everything, first[:, None])
    assert chain.predict(row, col, n) == pytest.approx(np.column_stack([first, both]), abs=1e-9)
    # what the second link learned from: each fold by a model that saw nothing of it, words included
    known, fold, out = ~np.isnan(y0), np.arange(n) % toxicity.FOLDS, first.copy()
    for f in range(toxicity.FOLDS):
        on = np.flatnonzero(known & (fold != f))
        r, c = np.nonzero(has[on])
        words = toxicity.telling(r, c, y0[on], size, 10)
        r, c = np.nonzero(has[np.ix_(on, words)])
        model = toxicity.Linear(len(words), 0).fit(r, c, none[on], y0[on])
        held = np.flatnonzero(known & (fold == f))
        out[held] = plain(words, model, held, none)
    words = toxicity.telling(row, col, y1, size, 10)
    r, c = np.nonzero(has[:, words])
    second = toxicity.Linear(len(words), 1).fit(r, c, out[:, None], y1)
    assert chain.links[1].words.tolist() == words.tolist() and second.w == pytest.approx(chain.links[1].model.w) and second.d == pytest.approx(chain.links[1].model.d)


def test_columns_of_other_case_stay_as_they_are(spark):
    rows = [(1, "alpha beta\nsame", "S", "K", "I", "T"), (2, "gamma delta\nsame", "s", "k", "i", "t")]
    table = spark.createDataFrame(rows, "doc_id long, text string, Score string, Keep string, Items string, Taken string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([("one", "gamma delta"), (None, "nowhere to be found")], "item_id string, text string")
    model = quality.fit(table, labels)
    assert quality.score(table, model).columns == ["doc_id", "text", "Keep", "Items", "Taken", "score"]
    assert quality.accept(table, model, 0.0).collect() == table.collect()
    out = lines.line_dedup(table, min_docs=2)
    assert out.columns == table.columns and sorted(map(tuple, out.collect())) == [(1, "alpha beta", "S", "K", "I", "T"), (2, "gamma delta", "s", "k", "i", "t")]
    assert lines.line_bitmaps(table, min_docs=2).columns == ["doc_id", "text", "Score", "Items", "Taken", "n_lines", "n_dropped", "keep"]
    assert [tuple(r) for r in decontaminate.decontaminate(table, bench).collect()] == rows[:1]
    found = decontaminate.find_leaks(table, bench)
    assert found.columns == ["doc_id", "text", "Score", "Keep", "Taken", "items", "distance", "contaminated"]
    assert {r["doc_id"]: r["items"] for r in found.collect()} == {1: [], 2: ["one"]}
    assert sorted(map(tuple, simhash.near_dedup(table).collect())) == rows
    clash = table.withColumnRenamed("Score", "Source").withColumnRenamed("Keep", "Size")
    assert mixing.mix_sources(clash).count() == 2
    assert langid.identify(table, langid.fit(table.withColumnRenamed("Keep", "lang"))).count() == 2
    assert toxicity.score(table, toxicity.fit(table, labels)).count() == 2


def test_many_shards_find_what_one_finds(spark, monkeypatch):
    table = spark.createDataFrame([(i, t) for i, t in enumerate(["one two three four", "nothing", None, "five six seven eight one two three four"])], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "one two three four"), (2, "five six seven eight"), (3, "absent items here")], "item_id long, text string")
    whole = sorted(map(tuple, decontaminate.find_leaks(table, bench).collect()), key=str)
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", 10)
    monkeypatch.setattr(decontaminate, "WINDOW", 7)
    assert sorted(map(tuple, decontaminate.find_leaks(table, bench).collect()), key=str) == whole and whole[0][2] == [1]


def test_quality_and_toxicity_on_odd_tables(spark, odd):
    labels = spark.createDataFrame([(4, 1, 0), (4, None, 1), (8, 0, 1), (None, 1, 1), (6, 1, 0)], "doc_id long, quality int, toxic int")
    for table in (odd, odd.limit(0)):
        n = table.count()
        scored = quality.score(table, quality.fit(table, labels))
        assert scored.columns == [*[c for c in table.columns if c != "score"], "score"]
        rows = scored.collect()
        assert len(rows) == n and all(0 <= r["score"] <= 1 for r in rows)
        rows = toxicity.score(table, toxicity.fit(table, labels)).collect()
        assert len(rows) == n and all(0 <= r["p_toxic"] <= 1 for r in rows)


def test_mixing_targets_and_takes(spark, odd):
    docs = spark.createDataFrame([(i, "w " * ((i * 7) % 40), s) for i, s in enumerate(["a"] * 50 + ["b"] * 3 + ["c"] * 30 + [None] * 9)], "doc_id long, text string, source string")
    rows = mixing.mix_sources(docs).collect()
    size = Counter()
    for r in docs.collect():
        size[r["source"]] += len(words(r["text"]))
    names = sorted([s for s in size if s is not None]) + [None]
    weight, total = {s: i % 3 + 1 for i, s in enumerate(names)}, sum(size.values())
    capped, target = set(), {}
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(3 * size[s] for s in capped)
        target = {s: 3.0 * size[s] for s in capped} | {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if target[s] > 3 * size[s]]
        if not over:
            break
        capped |= set(over)
    taken = Counter()
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    for r in rows:
        s = source[r["doc_id"]]
        assert r["target"] == pytest.approx(target[s]) and r["source_size"] == size[s]
        assert 0 <= r["taken"] <= 3 * r["size"] and (r["position"] is not None) == (r["copies"] > 0) or r["size"] == 0
        taken[s] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in names)
    positions = [r["position"] for r in rows if r["position"] is not None]
    assert positions == sorted(positions) and all(0 <= p <= 1 for p in positions)
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.mix_sources(docs.repartition(7)).collect()), key=str)
    assert mixing.mix_sources(odd).count() == len(ODD) and mixing.mix_sources(odd.limit(0)).count() == 0


def test_every_pass_has_its_position(spark):
    docs = spark.createDataFrame([(i, "w " * 10, s) for i, s in enumerate(["a"] * 900 + ["b"] * 20 + ["c"] * 80)], "doc_id long, text string, source string")
    source = {r["doc_id"]: r["source"] for r in docs.select("doc_id", "source").collect()}
    rows = mixing.mix_sources(docs).collect()
    assert all(len(r["positions"]) == r["copies"] and r["positions"] == sorted(r["positions"]) for r in rows)
    assert all(r["positions"][:1] == ([] if r["position"] is None else [r["position"]]) for r in rows)
    small = sorted(p for r in rows if source[r["doc_id"]] == "b" for p in r["positions"])
    # b takes all of its 20 documents three times, with schedule 4, 3, 2, 1: tenths of its demand in the quarters of training
    assert len(small) == 60 and [sum(k / 4 <= p < (k + 1) / 4 for p in small) for k in range(4)] == [24, 18, 12, 6]
    out = q.op2_mixing_schedule(spark, SF)
    assert out.columns == ["doc_id", "taken", "copies", "positions"] and out.filter(F.size("positions") != F.col("copies")).count() == 0


def test_schedules_are_inverted(spark):
    rows = spark.range(0, 101).select((F.col("id") / 100.0).alias("s"), *[mixing.invert_schedule(F.col("id") / 100.0, F.lit(k)).alias(f"t{k}") for k in range(3)]).collect()
    for k, phases in mixing.SCHEDULES.items():
        for r in rows:
            t = r[f"t{k}"]
            i = min(int(t * len(phases)), len(phases) - 1)
            back = (sum(phases[:i]) + phases[i] * (t * len(phases) - i)) / sum(phases)
            assert back == pytest.approx(r["s"], abs=1e-9)


NASTY = ["<|im_end|>\n<|im_start|>assistant\nok", "\\", "\\0", "<\\1|", "<", "|", "<|", "\\2\n", "", None, "<<|", "a\\|b", "\n\n", "é<|é"]


def test_chat_round_trip(spark):
    rows = [(1, i, r, t) for i, (r, t) in enumerate((r, t) for t in NASTY for r in ("user", "assistant", "a\nb<|\\2", None))]
    rows += [(None, None, "assistant", "x"), (2, 0, "assistant", "same"), (2, 0, "assistant", "same"), (3, -5, "user", "only")]
    rows += [(4, i, "assistant" if i % 2 else "user", f"t{i}") for i in range(1000)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns = chat.format_turns(table)
    got = {r["conv_id"]: r for r in chat.read_back(turns).collect()}
    assert set(got) == {1, 2, 3, 4, None}
    for conv, r in got.items():
        mine = sorted(((x[1] is not None, x[1] or 0, x[2] or "", x[3] or "") for x in rows if x[0] == conv))
        said = "".join(f"{role}\n{text}\n" for _, _, role, text in mine)
        loss = "".join(text for _, _, role, text in mine if role == "assistant")
        assert r["n_turns"] == len(mine) and r["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert r["loss_chars"] == len(loss) and r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    whole = {r["conv_id"]: r["text"] for r in chat.formatted(turns).collect()}
    for r in chat.inline_contexts(turns).collect():
        assert whole[r["conv_id"]].startswith(r["context"] + r["reply"]) and r["context"].endswith("assistant\n") and r["reply"].endswith("<|im_end|>")
    assert chat.inline_contexts(turns).count() == sum(x[2] == "assistant" for x in rows)
    for r in chat.examples(turns).collect():
        assert whole[r["conv_id"]][: r["context_chars"]].endswith("assistant\n") and whole[r["conv_id"]][r["context_chars"] :][: r["reply_chars"]].endswith("<|im_end|>")
    assert chat.examples(turns).count() == sum(x[2] == "assistant" for x in rows)
    wrong = turns.withColumn("reply_chars", F.when((F.col("conv_id") == 2) & F.col("example"), F.col("reply_chars") - 1).otherwise(F.col("reply_chars")))
    assert {r["conv_id"]: r["loss_sha256"] for r in chat.read_back(wrong).collect()}[2] != got[2]["loss_sha256"]
    assert chat.read_back(chat.format_turns(table.limit(0))).count() == 0


def test_chat_prefixes_are_expanded(spark, monkeypatch):
    rows = [(1, i, ("user", "assistant", "assistant")[i % 3], f"é<|{i}\\") for i in range(700)]
    rows += [(2, 0, "assistant", "first"), (2, 1, "user", "last"), (3, 0, "user", "no reply"), (3, 400, "user", "a block on"), (4, 300, "assistant", "")]
    turns = chat.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    want, whole = {}, {}
    for conv, turn, role, text in rows:
        head, said = f"<|im_start|>{role}\n", text.replace("\\", "\\0").replace("<|", "<\\1") + "<|im_end|>"
        if role == "assistant":
            want[conv, turn] = (whole.get(conv, "") + head, said)
        whole[conv] = whole.get(conv, "") + head + said + "\n"
    rest = chat.expand(turns).filter("reply IS NULL").collect()
    assert {(r["conv_id"], r["turn"]): (r["context"], r["reply"]) for r in chat.inline_contexts(turns).collect()} == want
    assert {c: max((r["context"] for r in rest if r["conv_id"] == c), key=len) for c in whole} == whole
    right = {r["conv_id"]: r for r in chat.read_back(turns).collect()}
    expand = chat.expand

    def differs(column, conv, turn, old, new):
        here = F.col("reply").isNotNull() & (F.col("conv_id") == conv) & (F.col("turn") == turn)
        wrong = F.when(here, F.replace(column, F.lit(old), F.lit(new))).otherwise(F.col(column))
        monkeypatch.setattr(chat, "expand", lambda t: expand(t).withColumn(column, wrong))
        got = {r["conv_id"]: r for r in chat.read_back(turns).collect()}
        return {(c, n) for c in right for n in ("turns_sha256", "loss_sha256") if got[c][n] != right[c][n]}

    assert differs("context", 1, 400, "user", "USER") == {(1, "turns_sha256")}
    assert differs("reply", 2, 0, "first", "other") == {(2, "turns_sha256"), (2, "loss_sha256")}


def test_language_on_held_out_documents(spark, odd):
    out = q.op4_langid(spark, SF).toPandas().merge(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").toPandas(), on="doc_id")
    assert (out[out.held_out].lang_pred == out[out.held_out].lang).mean() > 0.97
    found = langid.identify(odd, langid.fit(odd)).collect()
    assert len(found) == len(ODD)
    assert [r["lang_pred"] for r in found[:3]] == ["und"] * 3 and all(0 <= r["score"] <= 1 for r in found)
    assert langid.identify(odd, langid.fit(odd.limit(0))).filter("lang_pred <> 'und'").count() == 0


def test_language_distances_against_plain_ones(spark):
    rng = random.Random(7)
    texts = {lang: [" ".join("".join(rng.choice(letters) for _ in range(rng.randrange(1, 7))) for _ in range(60)) for _ in range(4)] for lang, letters in {"aa": "abcdeé", "bb": "defghi", "cc": "hijkß中"}.items()}

    def grams(text):
        out = Counter()
        for word in re.findall(r"[^\W\d_]+", text.lower()):
            padded = f" {word} "
            out.update(word)
            out.update(padded[i : i + 2] for i in range(len(padded) - 1))
            out.update(padded[i : i + 3] for i in range(len(padded) - 2))
        return out

    def ranks(counts):
        code = lambda g: sum(ord(c) << 21 * k for k, c in enumerate(reversed(g)))
        return {g: i for i, g in enumerate(sorted(counts, key=lambda g: (-counts[g], code(g)))[:40])}

    profiles = {lang: ranks(sum((grams(t) for t in ts), Counter())) for lang, ts in texts.items()}
    table = spark.createDataFrame([(i, t, lang, "L") for i, (lang, t) in enumerate((lang, t) for lang, ts in texts.items() for t in ts)], "doc_id long, text string, lang string, LANG_ string")
    fitted = langid.fit(table, size=40)
    new = ["abc fgh", "x", "defg hij 12 _ é", *texts["bb"]]
    for text in new:
        mine = ranks(grams(text))
        far = {lang: sum(abs(p[g] - r) if g in p else 40 for g, r in mine.items()) for lang, p in profiles.items()}
        order = sorted(far.items(), key=lambda x: (x[1], x[0]))
        got = fitted.predict(text)
        assert got[0] == order[0][0] and got[1] == pytest.approx((order[1][1] - order[0][1]) / order[1][1])


def brute_fingerprint(text, width=3):
    w = words(text)
    parts = [" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))] if w else []
    bits = [sum(xxhash.xxh64_intdigest(p.encode(), 42) >> b & 1 for p in parts) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * bits[b] > len(parts))


def test_simhash_groups(spark, docs, plain, odd):
    fp = {i: brute_fingerprint(t) for i, t, _ in plain}
    ids = sorted(fp)
    want = union_find([(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (fp[a] ^ fp[b]).bit_count() <= 2], ids)
    got = {r["doc_id"]: r for r in q.op5_simhash(spark, SF).collect()}
    assert {i: r["fingerprint"] for i, r in got.items()} == {i: f"{x:016x}" for i, x in fp.items()}
    assert {i: r["component_id"] for i, r in got.items()} == want
    rows = simhash.simhash_groups(odd).collect()
    assert len(rows) == len(ODD)
    assert {r["component_id"] for r in rows if r["fp"] == [0]} == {1}
    assert simhash.simhash_groups(odd.limit(0)).count() == 0


@pytest.mark.parametrize("segments_of", [1, 2, 4])
def test_tiles_lose_no_link(spark, monkeypatch, segments_of):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(120)]
    prints = {b ^ sum(1 << rng.randrange(64) for _ in range(k)) & (2**64 - 1) for b in base for k in range(4)}
    signed = [x - 2**64 if x >> 63 else x for x in prints]
    monkeypatch.setattr(simhash, "_segments", lambda *_: segments_of)
    nodes = spark.createDataFrame([(x, [x]) for x in signed], "id long, fp array<long>")
    links = [(r["a"], r["b"]) for r in simhash.near_pairs(nodes, 1, 2, block=16).collect()]
    close = [(a, b) for k, a in enumerate(signed) for b in signed[k + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= 2]
    assert union_find(links, signed) == union_find(close, signed)


def test_near_dedup_keeps_one_of_each_group(spark, odd):
    rng = random.Random(5)
    texts = []
    for g in range(12):
        w = [f"{g}x{rng.randrange(10**6)}" for _ in range(300)]
        texts.append(" ".join(w))
        for k in range(g):
            v = list(w)
            for at in rng.sample(range(300), 4):
                v[at] = f"new{rng.randrange(10**6)}"
            texts.append(" ".join(v))
    rows = [(i, t, 1) for i, t in enumerate(texts)]
    table = spark.createDataFrame(rows + [(5, texts[5], 1)], "doc_id long, text string, n_lines int").coalesce(2)
    kept = [r["doc_id"] for r in simhash.near_dedup(table).collect()]

    def sets(t):
        w = t.split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    s = [sets(t) for t in texts]
    want = union_find([(i, j) for i in range(len(s)) for j in range(i + 1, len(s)) if len(s[i] & s[j]) >= 0.8 * len(s[i] | s[j])], range(len(s)))
    assert sorted(kept) == sorted(i for i, c in want.items() if i == c)
    assert simhash.near_dedup(odd).count() == 1 + 1 + 1 + 1 + 1 + 1
    assert simhash.near_dedup(odd.limit(0)).count() == 0


def test_repeats_neither_link_nor_part(spark):
    rng = random.Random(8)
    one, two, three = (" ".join(f"{g}x{rng.randrange(10**6)}" for _ in range(n)) for g, n in (("a", 200), ("b", 200), ("c", 400)))
    filler = " -" * 60
    table = spark.createDataFrame([(1, one + filler), (2, two + filler), (3, three), (4, three + filler)], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.near_dedup(table).collect()) == [1, 2, 3]


def test_repeated_lines_do_not_count_and_long_words_neither(spark):
    rng, texts = random.Random(21), []
    for g in range(30):  # sets at 0.98, one line repeated more or less often
        w = [f"{g}k{rng.randrange(10**6)}" for _ in range(400)]
        line = " " + " ".join(f"{g}line{k}" for k in range(6))
        texts += [" ".join(w) + line * 2, " ".join([*w[:-4], *(f"{g}end{k}" for k in range(4))]) + line * (10 + 3 * g)]
    shared = " ".join(f"common{k}" for k in range(8))
    texts += [" ".join(f"{g}u{rng.randrange(10**6)}" for _ in range(80)) + f" {shared}" * 60 for g in range(8)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.near_dedup(table).collect()) == [*range(0, 60, 2), *range(60, 68)]


def test_a_large_group_of_copies_costs_no_square(spark, monkeypatch):
    rng = random.Random(22)
    monkeypatch.setattr(simhash, "BLOCK", 16)
    base = [f"h{rng.randrange(10**6)}" for _ in range(120)]
    texts = []
    for i in range(200):
        v = list(base)
        v[i % 120] = f"n{i}"
        texts.append(" ".join(v))
    far = list(base)
    for at in (10, 50, 90):  # three edits: 15 shingles of 116 on each side
        far[at] = "far"
    texts += [" ".join(far), " ".join(f"o{rng.randrange(10**6)}" for _ in range(120))]
    table = spark.createDataFrame(list(enumerate(texts)), "DOC_ID long, text string")
    s = [{tuple(t.split()[i : i + 5]) for i in range(116)} for t in texts]
    want = union_find([(i, j) for i in range(len(s)) for j in range(i + 1, len(s)) if len(s[i] & s[j]) >= 0.8 * len(s[i] | s[j])], range(len(s)))
    assert sorted(r["DOC_ID"] for r in simhash.near_dedup(table).collect()) == sorted(i for i, c in want.items() if i == c)


def test_long_texts_in_pieces_are_whole(monkeypatch):
    from tonaris.llm import common

    text = (LONG[:9000] + "\n" + " " * 300 + "x y" + "z" * 500 + " tail ").encode()
    texts = [text, b"one", b" " * 900 + b"two words" + b" " * 400, b"", b"a b c d e f g"]
    whole = ([simhash.fingerprint(t, 3, 2) for t in texts], [s.tolist() for s in simhash.shingle_sets(texts, 5)])
    monkeypatch.setattr(common.pieces, "__defaults__", (64,))
    monkeypatch.setattr(common.slices, "__defaults__", (100,))
    assert len(list(common.pieces(text))) > 50 and b"".join(common.pieces(text)) == text
    assert whole == ([simhash.fingerprint(t, 3, 2) for t in texts], [s.tolist() for s in simhash.shingle_sets(texts, 5)])
    bags, grams, seen = quality.passages([text]), langid.ngrams(text.decode()), toxicity.counts([text])
    for module in (quality, langid, toxicity):
        monkeypatch.setattr(module, "CHUNK_BYTES", 64)
    for before, after in ((bags, quality.passages([text])), (grams, langid.ngrams(text.decode())), (seen, toxicity.counts([text]))):
        assert all(np.allclose(a, b) for a, b in zip(before, after, strict=True))
    assert quality.passages([b" " * 99])[1].tolist() == [1]


def test_no_short_near_duplicate_is_lost(spark):
    rng, texts = random.Random(9), []
    for g in range(150):
        w = [f"{g}y{rng.randrange(10**6)}" for _ in range(8 + g % 90)]
        texts += [" ".join(w), " ".join([*w, *(f"z{g}{k}" for k in range((len(w) - 4) // 4))]), " ".join([*w, *(f"q{g}{k}" for k in range((len(w) - 4) // 4 + 1))])]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r["doc_id"] for r in simhash.near_dedup(table).collect()}
    # the second text of three is at 0.8 exactly or just above, the third below it with both
    assert kept == {i for i in range(len(texts)) if i % 3 != 1}


def test_bits_of_longer_texts_differ_at_the_stated_rate():
    def chance(n):
        return np.exp([math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) - n * math.log(2) for k in range(n + 1)])

    for n in (simhash.SHORT + 1, simhash.SHORT + 2, 70, 80, 99, 128, 200):
        for m in range(n, math.floor(n / 0.8) + 1):
            c = math.ceil(0.8 * (n + m) / 1.8 - 1e-9)
            if c > n:
                continue
            one = [np.array([chance(k - c)[[2 * (t + o) > k for o in range(k - c + 1)]].sum() for t in range(c + 1)]) for k in (n, m)]
            assert (chance(c) * (one[0] * (1 - one[1]) + one[1] * (1 - one[0]))).sum() <= math.acos(1.6 / 1.8) / math.pi + simhash.TIES


def test_toxicity_on_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    chain = toxicity.fit(docs, labels.filter("doc_id % 3 <> 0"))
    out = toxicity.score(docs, chain).select("doc_id", F.col("toxic").alias("found")).toPandas().merge(labels.toPandas(), on="doc_id")
    out = out[out.doc_id % 3 == 0]
    assert (out.found[out.toxic == 1]).mean() > 0.85 and (out.found[out.toxic == 0]).mean() < 0.01


def edit(pattern, text):
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, p in enumerate(pattern, 1):
            new.append(min(new[-1] + 1, row[i] + 1, row[i - 1] + (p != c)))
        row = new
        best = min(best, row[-1])
    return best


def test_myers_is_the_edit_distance():
    rng = random.Random(1)
    for _ in range(200):
        p = bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 90)))
        t = bytes(rng.choice(b"abc") for _ in range(rng.randrange(0, 60)))
        assert decontaminate.myers(p, t) == edit(p, t)


def fold(text):
    return re.sub(r"[\x00-\x7f]+", lambda m: re.sub(r"[^a-z0-9]+", " ", m[0].lower()), text or "").strip(" ")


def test_leaks_against_brute_force(spark, odd):
    rng = random.Random(2)
    bench = [(i, "".join(rng.choice("abcdefgh ,é") for _ in range(n))) for i, n in enumerate([3, 9, 30, 60, 100])] + [(9, None), (10, ""), (11, " .")]
    texts = []
    for _, item in bench[:5]:
        for errors in range(8):
            t = list(item)
            for _ in range(errors):
                at = rng.randrange(max(1, len(t)))
                t[at : at + 1] = rng.choice([[], ["z"], [*t[at : at + 1], "q"]])
            texts.append("".join(rng.choice("ijkl ") for _ in range(200)) + " " + "".join(t) + " tail")
    texts += ["", None, "é", "...", bench[3][1].upper()]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame(bench, "item_id long, text string")
    for r in decontaminate.find_leaks(table, items).collect():
        want, best = [], None
        for i, item in bench:
            p = fold(item).encode()
            if p:
                k = decontaminate.budget(len(p), decontaminate.ERRORS)
                d = edit(p, fold(r["text"]).encode())
                if d <= k:
                    want.append(i)
                    best = d if best is None else min(best, d)
        assert (r["items"], r["contaminated"]) == (want, bool(want)), r
        assert best is None or r["distance"] <= max(best, 5)
    assert decontaminate.decontaminate(odd, items.limit(0)).count() == len(ODD)
    assert decontaminate.decontaminate(odd, items).columns == odd.columns


def test_long_texts_leak_as_short_ones_do(monkeypatch):
    rng = random.Random(44)
    items = [(i, "".join(rng.choice("abcdefgh ,\u00e9") for _ in range(n)).encode()) for i, n in enumerate((3, 9, 40, 120, 300))]
    texts = [b"", b" ", b" ,.", "\u00e9".encode() * 90, b" - " * 90]
    for _ in range(60):
        parts = []
        for _ in range(rng.randrange(1, 12)):
            t = list(rng.choice(items)[1])
            for _ in range(rng.randrange(0, 14)):
                at = rng.randrange(max(1, len(t)))
                t[at : at + 1] = rng.choice([[], [122], [*t[at : at + 1], 113], [32] * 200])
            parts += [bytes(t), rng.choice([b" \n", b"\x00", b"", b"ijkl " * 30, b" " * 150 + b"- "])]
        texts.append(b"".join(parts))
    matcher = decontaminate.Matcher(items)
    whole = [matcher.find([t])[0] for t in texts]
    assert {d for hit in whole for d in hit.values()} >= set(range(8))
    for size in (1, 7, 64, 333):
        for t in texts:
            data, _ = decontaminate.normalise([t])
            assert b"".join(decontaminate.normalised_parts(t, size)) == data[1:-1].tobytes()
    for size in (16, 64, 333):
        monkeypatch.setattr(decontaminate, "CHUNK_BYTES", size)
        assert [matcher.find([t])[0] for t in texts] == whole


def test_embeddings_against_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    rng = np.random.default_rng(4)
    table = [(r["vec_id"], list(map(float, r["embedding"])), r["label"]) for r in rows]
    for k in range(40):
        table.append((1000 + k, [x + float(rng.normal(0, 0.02)) for x in table[k % 4][1]], table[k % 4][2]))
    table += [(2000, table[0][1], table[0][2]), (2001, [2 * x for x in table[0][1]], table[0][2]), (2002, None, 1), (2003, [0.0] * 64, 1), (2004, [None] * 64, 1), (2005, [float("nan")] * 64, 1), (2006, table[0][1], None), (2007, [1.0], 1)]
    out = {r["vec_id"]: r for r in embed.embedding_groups(spark.createDataFrame(table, "vec_id long, embedding array<float>, label int"), block=64).collect()}
    good = [(i, np.array(v, np.float32).astype(float), lab) for i, v, lab in table if lab is not None and v and len(v) == 64 and None not in v and np.isfinite(v).all() and any(v)]
    pairs = [(a[0], b[0]) for k, a in enumerate(good) for b in good[k + 1 :] if a[2] == b[2] and a[1] @ b[1] / np.linalg.norm(a[1]) / np.linalg.norm(b[1]) >= 0.98]
    want = union_find(pairs, [r[0] for r in table])
    n = Counter(x for p in pairs for x in p)
    assert sum(r["n_links"] for r in out.values()) >= 0.99 * 2 * len(pairs)
    assert all(out[i]["n_links"] <= n[i] for i in out)
    assert {i: r["component_id"] for i, r in out.items()} == want
    assert all(r["kept"] == (i == r["component_id"]) for i, r in out.items())


def test_embeddings_link_only_equal_labels_and_lengths(spark):
    rng = np.random.default_rng(12)
    far = 4294967297
    a, b = rng.normal(size=8), rng.normal(size=5)
    rows = [(i, [float(x) for x in v], lab) for i, (v, lab) in enumerate([(a, 1), (a, far), (a, -1), (a, -far), (a, 1 - 2**32), (a * 1.001, far), (a, 0), (b, 1), (b * 2, 1), (b, 2**62), (b, -(2**62))])]
    rows += [(20, [], 1), (None, [float(x) for x in a], 1)]
    kind = "vec_id long, embedding array<float>, label long, Vec_Id string, n_links string"
    table = spark.createDataFrame([(*r, "x", "y") for r in rows], kind)
    out = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embed.embedding_groups(table).collect()}
    assert out == {0: (1, 0, True), None: (1, 0, False), 1: (1, 1, True), 5: (1, 1, False), 7: (1, 7, True), 8: (1, 7, False)} | {i: (0, i, True) for i in (2, 3, 4, 6, 9, 10, 20)}
    assert embed.embedding_groups(table.limit(0)).count() == 0
    assert embed.embedding_groups(spark.createDataFrame([(20, [], 1)], "vec_id long, embedding array<float>, label long")).first()["kept"]


def test_estimates_are_unbiased():
    rng = np.random.default_rng(6)
    v = embed.unit(rng.normal(size=(400, 64)))
    rot = embed.rotations(64, 1)
    signs, factor = embed.codes(v, rot)
    got, error = embed.estimate(v, signs, factor, rot[0])
    true = v @ v.T
    assert abs((got - true)[~np.eye(400, dtype=bool)].mean()) < 2e-3
    assert (np.abs(got - true) <= error[None, :]).mean() > 0.999


def test_lm_counts_and_both_ways_to_score(spark, docs, plain, odd):
    training = docs.filter(q.crc_mod("doc_id", 7) != 2)
    model, table = lm.fit(training)
    c = Counter()
    for i, t, _ in plain:
        if held(i, 7) != 2:
            c.update([*words(t), None])
    n, v = sum(c.values()), len(c)
    got = {r["doc_id"]: r for r in lm.score(docs, model, table).collect()}
    for i, t, _ in plain:
        tokens = [*words(t), None]
        assert got[i]["n_tokens"] == len(tokens) and got[i]["train_tokens"] == n
        assert got[i]["n_known"] == sum(c[w] > 0 for w in tokens)
        assert got[i]["base_score"] == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens), rel=1e-9)
    out = [r for i, r in got.items() if held(i, 7) == 2]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)
    model.words = None
    for r in lm.score(docs, model, table).collect():
        mine = got[r["doc_id"]]
        assert tuple(r)[1:4] == tuple(mine)[1:4] and r["score"] == pytest.approx(mine["score"], rel=1e-6) and r["base_score"] == pytest.approx(mine["base_score"], rel=1e-9)
    for training in (odd, odd.limit(0)):
        model, table = lm.fit(training)
        rows = lm.score(odd, model, table).collect()
        assert len(rows) == len(ODD) and all(r["score"] <= 0 for r in rows) and rows[0]["n_tokens"] == 1
        model.words = None
        assert lm.score(odd, model, table).count() == len(ODD)


def test_lm_probabilities_sum_to_one(spark, docs, monkeypatch):
    monkeypatch.setattr(lm, "LEAST_ROWS", 1 << 12)
    model, table = lm.fit(docs.limit(50))
    shape, rows = model.shape, table.collect()
    assert len(rows) > 3 * len(shape.names) / 2 and len(shape.names) == lm.REST * lm.MEMBERS
    h, c = np.array([r["h"] for r in rows], np.int64).view(np.uint64), np.array([r["c"] for r in rows])
    unknown = np.array([(k << 59) + 1 for k in range(lm.MEMBERS)], np.uint64)  # one unknown word for each cell
    every, count = np.concatenate([h, unknown]), np.concatenate([c, np.zeros(len(unknown))])
    for before in ([], [h[0]], [h[0], h[1]], [unknown[3], h[5]], [h[2], unknown[0]]):
        s = lm.Stream([b"x"] * len(every))
        n = len(before) + 2
        s.h = np.concatenate([np.array([*before, word, lm._EDGE], np.uint64) for word in every])
        s.count = np.full(len(every), n)
        s.first = np.arange(len(every)) * n
        p = 10 ** (model.softmax_score(s)[len(before) :: n] + model.within(every, count))
        assert p.sum() == pytest.approx(1, abs=1e-4) and (p > 0).all()


def test_lm_score_against_a_plain_one(spark):
    rng = random.Random(31)
    vocabulary = [f"w{i}x" for i in range(40)]
    texts = [" ".join(rng.choices(vocabulary, range(1, 41), k=rng.randrange(0, 60))) for _ in range(80)] + [None, "", "never seen before W3x"]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2)
    shape = lm.Shape([(int(lm.Stream([w.encode()]).h[0]), i % 2, 5 + i) for i, w in enumerate(vocabulary[:39])], {1: (30, 3), 2: (4, 4)}, 500, 41)
    w = np.random.default_rng(1).normal(size=(2 * shape.rows, lm.MEMBERS)).astype(np.float32)
    model = lm.Model(shape, w, shape.bias, None)
    place = dict(zip(shape.names.tolist(), shape.place.tolist(), strict=True))
    assert sorted(place.values()) == list(range(39))
    mixed = lambda x: int(lm.mix(np.array([x % (1 << 64)], np.uint64))[0])
    shift = 64 - int(math.log2(shape.rows))
    for text in texts:
        hashes = [int(lm.Stream([word.encode()]).h[0]) for word in words(text)] + [int(lm._EDGE)]
        want, edge = 0.0, int(lm._EDGE)
        for i, h in enumerate(hashes):
            one, two = (hashes[i - 1] if i else edge), (hashes[i - 2] if i > 1 else edge)
            past = [mixed(one), mixed(one * 3 + mixed(two)), mixed(two ^ 0x5851F42D4C957F2D)]
            cls, member = divmod(place.get(h, lm.REST * lm.MEMBERS + (h >> 59)), lm.MEMBERS)
            inside = [mixed(f + (cls + 1) * 0xC2B2AE3D27D4EB4F) for f in past[:2]]
            for rows, bias, y in (([f >> shift for f in past], shape.bias[0], cls), ([(f >> shift) + shape.rows for f in inside], shape.bias[1 + cls], member)):
                z = [max(float(bias[k]) + sum(float(w[r, k]) for r in rows), -600.0) for k in range(lm.MEMBERS)]
                want += (z[y] - math.log(sum(math.exp(v) for v in z))) / math.log(10)
        assert model.softmax_score(lm.Stream([(text or "").encode()])).sum() == pytest.approx(want, rel=1e-4)
    # the whole operator: counts by hand, the two levels from the model
    fitted, counts = lm.fit(table)
    c = Counter(h for t in texts for h in [*(int(lm.Stream([x.encode()]).h[0]) for x in words(t)), int(lm._EDGE)])
    for r in lm.score(table, fitted, counts).collect():
        s = lm.Stream([(texts[r["doc_id"]] or "").encode()])
        rest = sum(math.log10((c[h] + 1) / (fitted.shape.cell_tokens[h >> 59] + fitted.shape.cell_words[h >> 59] + 1)) for h in s.h.tolist() if h not in set(fitted.shape.names.tolist()))
        assert r["score"] == pytest.approx(fitted.softmax_score(s).sum() + rest, rel=1e-5)


def test_lm_learns_orders_of_words(spark):
    rng = random.Random(33)
    follow = {w: rng.sample([f"v{i}" for i in range(30)], 2) for w in (f"v{i}" for i in range(30))}

    def walk():
        out = [rng.choice(sorted(follow))]
        for _ in range(40):
            out.append(rng.choice(follow[out[-1]]))
        return " ".join(out)

    table = spark.createDataFrame([(i, walk()) for i in range(600)], "doc_id long, text string").coalesce(4)
    model, counts = lm.fit(table.filter("doc_id < 500"))
    out = lm.score(table.filter("doc_id >= 500"), model, counts).agg(F.sum("score"), F.sum("base_score")).first()
    assert out[0] > 0.75 * out[1]


def brute_lines(rows, least):
    seen = Counter()
    keyed = []
    for i, t in rows:
        ls = (t or "").split("\n")
        keys = [re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\f\r")) for x in ls]
        keyed.append((i, ls, keys))
        seen.update({k for k in keys if k})
    return [(i, len(ls), sum(bool(k) and seen[k] >= least for k in keys), "\n".join(x for x, k in zip(ls, keys, strict=True) if not k or seen[k] < least)) for i, ls, keys in keyed]


def test_lines_on_odd_tables(spark, odd):
    rows = [(i, "\n".join(random.Random(i).choices(["Same", " same ", "SAME\t", "É", "é", "", "x", f"own {i}", "b\rc"], k=i % 9))) for i in range(60)] + [(r[0], r[1]) for r in ODD]
    table = spark.createDataFrame([(*r, "kept", 5) for r in rows], "doc_id long, text string, keep string, n_lines int")
    for least in (2, 10):
        want = sorted(((i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in brute_lines(rows, least)), key=str)
        got = lines.line_bitmaps(table.select("doc_id", "text"), min_docs=least).select("doc_id", "n_lines", "n_dropped", F.sha2(lines.kept_text(F.col("text"), F.col("keep")), 256))
        assert sorted(map(tuple, got.collect()), key=str) == want
        out = lines.line_dedup(table, min_docs=least)
        assert out.columns == table.columns
        assert sorted((hashlib.sha256((r["text"] or "").encode()).hexdigest() for r in out.collect())) == sorted(w[3] for w in want)
        assert out.filter("keep <> 'kept' OR n_lines <> 5").count() == 0
    assert lines.line_dedup(odd.limit(0)).count() == 0


def test_many_frequent_lines_and_languages(spark, monkeypatch):
    rng = random.Random(17)
    rows = [(i, "\n".join(rng.choices([f"line {k}" for k in range(40)] + ["common"], k=6)), f"l{i % 3}") for i in range(90)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    few, known = lines.line_dedup(table, min_docs=5).orderBy("doc_id").collect(), langid.fit(table, max_train=20)
    monkeypatch.setattr(lines, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(langid, "MAX_LITERALS", 1)
    assert lines.line_dedup(table, min_docs=5).orderBy("doc_id").collect() == few and few != table.orderBy("doc_id").collect()
    many = langid.fit(table, max_train=20)
    assert many.names == known.names == ["l0", "l1", "l2"] and (many.codes == known.codes).all() and (many.ranks == known.ranks).all()


def test_no_folder_is_made_up_on_a_cluster():
    from types import SimpleNamespace

    from tonaris.llm import common

    none = SimpleNamespace(isDefined=lambda: False)
    context = SimpleNamespace(master="spark://host:7077", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: none)))
    with pytest.raises(RuntimeError, match="checkpoint"):
        common.shared_dir(SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda *_: None)))


def test_first_occurrence_can_stay(spark):
    table = spark.createDataFrame([(3, "x\na"), (1, "b\nx\nx"), (2, "x")], "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in lines.line_dedup(table, min_docs=2, keep_first=True).collect()}
    assert out == {1: "b\nx", 2: "", 3: "a"}


@pytest.mark.parametrize("name", list(q.ORACLE_SQL))
def test_sql_says_the_same(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(q.ORACLE_SQL[name]).df()
    got = q.QUERIES[name](spark, SF).toPandas()[list(want.columns)]
    assert sorted(map(tuple, got.values.tolist()), key=str) == sorted(map(tuple, want.values.tolist()), key=str)
