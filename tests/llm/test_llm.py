"""Operators against brute force on small tables, and the cases that every operator must take."""

import collections
import hashlib
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.llm import op1_toxicity, op2_near, op3_ann, op4_shards, op5_mix, op6_pack, op7_quality, op8_substring, op9_lm, op10_suffix

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, anchors int, known int, sid int, stop string"


def words(text):
    return (text or "").encode().split()


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, short, long, equal and repeated rows, and columns whose names the operators use themselves."""
    passage = " ".join(f"w{i}" for i in range(70))
    texts = [None, "", " \t\n", "one", "One two", passage, passage, f"head {passage} tail", "é" * 400, "ab " * 400, passage + " " + " ".join(f"x{i}" for i in range(5000))]
    rows = [(i, t, None, None if i % 3 == 0 else f"s{i % 3}", None, 1, 2, 3, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[5], (None, passage, None, None, None, 1, 2, 3, "x")], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def texts_of(df):
    return {r["doc_id"]: r["text"] for r in df.where("doc_id is not null").select("doc_id", "text").collect()}


def brute_bytes(texts, n=100):
    seen, out = set(), {}
    for i in sorted(texts):
        b = (texts[i] or "").encode()
        gone = np.zeros(len(b) + 1, int)
        for k in range(len(b) - n + 1):
            if b[k : k + n] in seen:
                gone[k] += 1
                gone[min(k + n, len(b))] -= 1
            seen.add(b[k : k + n])
        g = np.cumsum(gone)[:-1] > 0
        kept = np.frombuffer(b, np.uint8)[~g].tobytes()
        out[i] = (len(b), int(g.sum()), int((np.diff(np.concatenate(([0], g.astype(int)))) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


def brute_words(texts, n=50):
    seen, out = set(), {}
    for i in sorted(texts):
        w, own = words(texts[i]), set()
        gone = [False] * len(w)
        for k in range(len(w) - n + 1):
            x = tuple(w[k : k + n])
            if x in seen:
                gone[k : k + n] = [True] * n
            own.add(x)
        seen |= own
        out[i] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("table", ["odd", "docs"])
def test_substring_and_suffix(request, table):
    df = request.getfixturevalue(table)
    texts = texts_of(df)
    for rows, expected in ((op8_substring.dedup_substrings(df).select("doc_id", "n_words", "n_removed", "kept_sha256").collect(), brute_words(texts)), (op10_suffix.dedup_bytes(df).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect(), brute_bytes(texts))):
        assert {r[0] for r in rows} == set(texts)
        assert [r for r in rows if tuple(r[1:]) != expected[r[0]]] == []


@pytest.mark.parametrize("table", ["odd", "docs"])
def test_near(request, table):
    df = request.getfixturevalue(table)
    sets = {}
    for i, t in texts_of(df).items():
        w = [x.lower() for x in words(t)]
        sets[i] = {tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set()
    of = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                low, high = sorted((of[a], of[b]))
                of = {k: low if v == high else v for k, v in of.items()}
    got = op2_near.near_duplicates(df, 3, 85).collect()
    assert {r["doc_id"] for r in got} == set(sets)
    assert [r for r in got if (r["n_shingles"], r["component_id"], r["kept"]) != (len(sets[r["doc_id"]]), of[r["doc_id"]], of[r["doc_id"]] == r["doc_id"])] == []


@pytest.mark.parametrize("table", ["odd", "docs"])
def test_shards_are_the_smallest(request, table):
    df = request.getfixturevalue(table)
    rows = df.where("doc_id is not null").select("doc_id", "text").collect()
    groups = collections.OrderedDict()
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        groups.setdefault(r["text"] or "", []).append(len((r["text"] or "").encode()) + 8)
    sizes = [sum(x) for x in groups.values()]

    def need(c):
        n, s = 1, 0
        for x in sizes:
            n, s = (n + 1, x) if s + x > c else (n, s + x)
        return n

    best = next(c for c in range(max(sizes), sum(sizes) + 1) if need(c) <= 24) if table == "odd" else None
    got = op4_shards.assign(df).collect()
    total, slots = collections.Counter(), collections.defaultdict(list)
    for r in got:
        total[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert len(got) == len(rows) and all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert need(max(total.values())) <= 24 and need(max(total.values()) - 1) > 24 or max(total.values()) == max(sizes)
    assert best is None or max(total.values()) == best


def test_mix(spark, odd, docs):
    for df in (odd, docs):
        got = op5_mix.mix_documents(df)[0].toPandas()
        texts = texts_of(df)
        assert (got["size"] == [len(words(texts[i])) for i in got.doc_id]).all() and (got.taken <= 2 * got["size"]).all()
        again = op5_mix.mix_documents(df)[0].toPandas()
        assert sorted(zip(got.doc_id, got.taken)) == sorted(zip(again.doc_id, again.taken))
    by = got.groupby(["source_size", "target"], dropna=False).taken.sum().reset_index()
    assert ((by.taken - by.target).abs() <= 32).all()
    n = np.full(1000, 1000)
    assert sorted(op5_mix.permute(np.arange(1000), n, np.full(1000, 7, np.uint64)).tolist()) == list(range(1000))
    assert op5_mix.mixed_texts(docs, op5_mix.mix_documents(docs)[0]).count() > 0


def test_mix_broadcasts_no_blocks_or_texts(docs):
    """Both are estimated by the files that they come from, which are a small part of what the driver would hold."""
    taken = op5_mix.mix_documents(docs)[0]
    for df in (taken, op5_mix.mixed_texts(docs, taken)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastExchange" not in plan and "SortMergeJoin" in plan


def test_packing(odd, docs):
    rng = np.random.default_rng(1)
    for _ in range(20):
        lengths = np.unique(rng.integers(0, 60, 12))
        counts, k = rng.integers(1, 9, len(lengths)), int(rng.integers(1, 5))

        def cost(uppers):
            return sum(c * (min(u for u in uppers if u >= x) - x) for x, c in zip(lengths, counts))

        import itertools

        best = min(cost([*some, lengths[-1]]) for n in range(k) for some in itertools.combinations(lengths[:-1], n))
        assert cost(op6_pack.best_buckets(lengths, counts, k)) == best
    for df in (odd, docs):
        got = op6_pack.pack(df).toPandas()
        assert (got.padding >= 0).all() and not got.duplicated(["bucket", "batch", "place"]).any()
        many = got.groupby(["bucket", "batch"]).agg(n=("doc_id", "size"), size=("bucket_len", "sum"))
        assert ((many["size"] <= 65_536) | (many.n == 1)).all()


def test_quality(odd, docs, spark):
    for df in (odd, docs):
        texts = texts_of(df)
        for r in op7_quality.verdicts(df).collect():
            w = [x.decode() for x in words(texts[r["doc_id"]])]
            grams = collections.Counter(zip(w, w[1:], w[2:]))
            twice = {j for k, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for j in (k, k + 1, k + 2)}
            assert (r["n_words"], r["word_chars"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(twice))
    labels = spark.read.parquet(f"{SF}/labels.parquet").withColumnRenamed("quality", "good")
    judged = op7_quality.verdicts(docs).join(labels, "doc_id").where("not base_failed")
    assert judged.where("kept <> (good = 1)").count() <= 0.03 * judged.count()
    assert op7_quality.keep_good(odd).columns == odd.columns


def test_language_model(odd, docs):
    for df in (odd, docs):
        rows = df.where("doc_id is not null").select("doc_id", "text").collect()
        token = {r["doc_id"]: [*(x.lower() for x in words(r["text"])), None] for r in rows}
        counts = collections.Counter(t for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 7 != 2 for t in token[r["doc_id"]])
        n, v = sum(counts.values()), len(counts)
        got = op9_lm.score(df).collect()
        assert len(got) == len(rows)
        for r in got:
            t = token[r["doc_id"]]
            assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(t), sum(counts[x] > 0 for x in t), n) and r["score"] < 0
            assert math.isclose(r["base_score"], sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in t), rel_tol=1e-9)
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_language_model_keeps_contexts_apart(spark):
    """Previous words whose hashes agree in their first 16 bits have a restaurant each."""
    import pyarrow as pa

    from tideline.llm._text import blocks, mix

    names = [f"w{i}" for i in range(3000)]
    hashes = next(blocks(pa.RecordBatch.from_pydict({"doc_id": [0], "text": [" ".join(names)]}))).words(lower=True).hash
    seen = {}
    a, b = next((seen[k], w) for w, k in zip(names, (mix(hashes) >> np.uint64(48)).tolist()) if seen.setdefault(k, w) != w)
    df = spark.createDataFrame([(i, f"{a} x" if i % 2 else f"{b} y") for i in range(400)], "doc_id long, text string")
    # Half of the texts begin with either word; what follows it is nearly certain.
    assert all(r["score"] > math.log10(0.5) - 0.15 for r in op9_lm.score(df).collect())


def test_neighbours(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 8)).astype(np.float32)
    x[100:200] = x[0]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(1000, None, 1), (1001, [0.0] * 8, 1), (1002, [float("nan")] * 8, 1), (1003, [None] * 8, 1), (None, [1.0] * 8, 1), (0, x[0].tolist(), 1), (1020, [1.0, 2.0], 1)]
    got = op3_ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>, shard int")).toPandas()
    wide, hits = x.astype(float), 0
    for q in range(0, 400, 20):
        s = wide @ wide[q]
        s[q] = -np.inf
        mine = got[got.query_id == q].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 21)) and np.allclose(mine.score, s[mine.vec_id])
        hits += len(set(mine.vec_id) & set(np.lexsort((np.arange(400), -s))[:20].tolist()))
    assert hits >= 0.9 * 400


def test_toxicity(spark, odd):
    rows = [(i, f"w{i % 50} w{i % 37} " + ("you idiot" if i % 4 == 0 else "hello there"), None) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, features int")
    labels = spark.createDataFrame([(i, int(i % 4 == 0), int(i % 4 == 0)) for i in range(0, 400, 2)] + [(None, 1, 1), (9999, 1, 0)], "doc_id long, rude int, toxic int")
    chain = op1_toxicity.train(docs, labels, {"rude": F.col("rude"), "toxic": F.col("toxic")})
    got = op1_toxicity.predict(docs, chain).collect()
    assert all((r["p_toxic"] >= 0.5) == (r["doc_id"] % 4 == 0) for r in got) and len(got) == 400
    assert op1_toxicity.predict(odd, chain).count() == 12


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert op8_substring.dedup_substrings(none).count() == op10_suffix.dedup_bytes(none).count() == op2_near.near_duplicates(none).count() == 0
    assert op4_shards.assign(none).count() == op5_mix.mix_documents(none)[0].count() == op6_pack.pack(none).count() == 0
    assert op7_quality.verdicts(none).count() == op9_lm.score(none).count() == 0
    assert op3_ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    chain = op1_toxicity.train(none, spark.createDataFrame([], "doc_id long, toxic int"), {"toxic": F.col("toxic")})
    assert op1_toxicity.predict(none, chain).count() == 0


def clusters(sets, percent):
    """The smallest id of each document's component, by comparing all pairs."""
    of = {i: i for i in sets}

    def root(x):
        while of[x] != x:
            x = of[x]
        return x

    ids = sorted(i for i in sets if sets[i])
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if (both := len(sets[a] & sets[b])) * 100 >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                of[max(x, y)] = min(x, y)
    return {i: root(i) for i in sets}


def test_near_chain_over_passes(spark):
    """Links that only later passes find join components of earlier ones: each text differs a little from the one before."""
    base = [f"w{i}" for i in range(80)]
    rows, sets = [], {}
    for i in range(30):
        w = [f"v{j}" if j < i else x for j, x in enumerate(base)]
        rows.append((100 - i, " ".join(w)))
        sets[100 - i] = {tuple(w[k : k + 3]) for k in range(len(w) - 2)}
    expected = clusters(sets, 90)
    got = op2_near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == expected and set(expected.values()) == {71}


def test_near_pairs_in_a_large_family(spark):
    """Several hundred look-alikes just below the threshold, and among them pairs just above it."""
    base, rows, sets = [f"w{i}" for i in range(82)], [], {}
    for i in range(400):
        w = [*base, *[f"p{i // 2}x{j}" for j in range(7)], *[f"o{i}x{j}" for j in range(11)]]
        rows.append((i, " ".join(w)))
        sets[i] = set(w)
    expected = clusters(sets, 80)
    got = op2_near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 1, 80).collect()
    assert expected == {i: i - i % 2 for i in range(400)} and {r["doc_id"]: r["component_id"] for r in got} == expected


def test_pipeline_stages(spark, docs):
    """Each stage on what the stage before kept, against brute force."""
    import corpus_pipeline

    scratch, stages = op2_near.Scratch(spark), dict(corpus_pipeline.STAGES)
    step = lambda name, df: scratch.write(stages[name](spark, df, SF))
    good = step("quality rules", docs)
    assert good.columns == docs.columns
    judged = op7_quality.judge(docs).where("quality >= 0.5 and 100 * n_repeat_words <= 50 * n_words").select("doc_id")
    before = texts_of(docs)
    now = texts_of(good)
    assert set(now) == {r[0] for r in judged.collect()} and all(before[i] == t for i, t in now.items())

    single = step("near-dedup", good)
    sets = {}
    for i, t in now.items():
        w = t.encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))).split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    kept = {i: now[i] for i, root in clusters(sets, 80).items() if i == root}
    assert texts_of(single) == kept and single.count() == len(kept)

    cut = step("substring dedup", single)
    expected = brute_words(kept)
    got = texts_of(cut)
    assert cut.columns == docs.columns and set(got) >= {i for i, x in expected.items() if x[1] < x[0]}
    for i, t in got.items():
        assert t == kept[i] if not expected[i][1] else hashlib.sha256(t.encode()).hexdigest() == expected[i][2]

    mixed = step("mixing", cut)
    taken = {r["doc_id"]: r["taken"] for r in op5_mix.mix_documents(cut)[0].collect() if r["taken"]}
    texts = texts_of(mixed)
    assert {i: len(words(t)) for i, t in texts.items()} == taken and mixed.columns == docs.columns
    assert all(set(words(t)) <= set(words(got[i])) for i, t in texts.items())

    packed = step("packing", mixed).toPandas()
    assert packed.doc_id.is_unique and dict(zip(packed.doc_id, packed.n_tokens)) == taken and (packed.padding >= 0).all()


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF).toPandas()
    assert 0 < len(out) <= docs.count() and not out.doc_id.duplicated().any()


def test_near_in_a_dense_region(spark, monkeypatch):
    """A thousand copies with a few random edits each, most pairs below the threshold: no link is lost, in one block or in several."""
    import random

    rng = random.Random(7)
    vocabulary = [f"v{i}" for i in range(3000)]
    base, rows, sets = [rng.choice(vocabulary) for _ in range(120)], [], {}
    for i in range(1100):
        w = list(base)
        for _ in range(rng.choice([2, 3])):
            w[rng.randrange(120)] = rng.choice(vocabulary)
        rows.append((i, " ".join(w)))
        sets[i] = {tuple(w[k : k + 3]) for k in range(len(w) - 2)}
    expected = clusters(sets, 85)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (op2_near.BLOCK_SHINGLES, 1 << 18):
        monkeypatch.setattr(op2_near, "BLOCK_SHINGLES", block)
        assert {r["doc_id"]: r["component_id"] for r in op2_near.near_duplicates(df, 3, 85).collect()} == expected


@pytest.mark.parametrize("n", [2, 3, 200])
def test_common_counts(n, monkeypatch):
    monkeypatch.setattr(op2_near, "_COLUMNS", 16), monkeypatch.setattr(op2_near, "_RARE", 64)
    rng = np.random.default_rng(n)
    sets = [np.unique(rng.zipf(1.3, rng.integers(1, 80)).astype(np.uint64)) for _ in range(n)]
    expected = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    got = op2_near.common_counts(sets, None)
    assert (got == expected)[~np.eye(n, dtype=bool)].all()
    assert (op2_near.common_counts(sets[:1], sets[1:]) == expected[:1, 1:]).all()


@pytest.mark.parametrize("lengths", ["unit", "gaussian", "lognormal"])
def test_graph_recall_at_shard_size(lengths):
    """A shard far larger than the beam, with vectors of equal, similar and very different lengths."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(10_000, 32))
    if lengths == "unit":
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    if lengths == "lognormal":
        x *= np.exp(rng.normal(0, 0.7, size=(len(x), 1)))
    graph = op3_ann.ProductGraph(x.astype(np.float32))
    queries = np.arange(0, len(x), 50)
    s = x[queries] @ x.T
    s[np.arange(len(queries)), queries] = -np.inf
    truth = np.argsort(-s, 1)[:, :20]
    found, _ = graph.search((x[queries] / np.abs(x).max()).astype(np.float32), graph.beam)
    hits = 0
    for i, q in enumerate(queries):
        ids = found[i][(found[i] >= 0) & (found[i] != q)]
        hits += len(set(ids[np.argsort(-s[i, ids])][:20]) & set(truth[i]))
    assert graph.beam < 1000 and hits >= 0.95 * 20 * len(queries) and graph.recall >= op3_ann.RECALL


def test_neighbours_in_double_and_ties(spark):
    """Products beyond the reach of float32, and different vectors with equal products: smaller ids come first."""
    rng = np.random.default_rng(2)
    x = rng.integers(-8, 9, size=(300, 6)) * 2.0**200
    x[:, 0] += 2.0**197
    got = op3_ann.nearest(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).toPandas()
    hits = 0
    for q in range(0, 300, 20):
        s = x @ x[q]
        s[q] = -np.inf
        mine = got[got.query_id == q].sort_values("rank")
        assert mine.score.tolist() == s[mine.vec_id].tolist()
        assert mine.vec_id.tolist() == mine.vec_id.to_numpy()[np.lexsort((mine.vec_id, -mine.score))].tolist()
        hits += len(set(mine.vec_id) & set(np.lexsort((np.arange(300), -s))[:20].tolist()))
    assert hits >= 0.97 * 15 * 20


def test_ties_beyond_k():
    """Sixty vectors with one product: the smallest ids are taken, in whatever order the beam found them."""
    import pyarrow as pa

    x = np.stack((np.ones(60), np.arange(60) - 30.0), 1)
    ids = np.random.default_rng(4).permutation(60)
    table = pa.table({"cid": np.arange(60), "embedding": pa.array(x.tolist()), "members": pa.array([[int(i)] for i in ids]), "shard": pa.array([0] * 60)})
    index = op3_ann._build(table).to_pylist()[0]
    block = op3_ann._pack(pa.table({"cid": [7], "embedding": pa.array([[2.0, 0.0]])}), 0).to_pylist()[0]
    rows = [index | {"block": 0, "q": None, "qid": None}, {c: None for c in index} | block | {"shard": 0}]
    got = next(op3_ann._search(iter([pa.RecordBatch.from_pylist(rows)]), 5, 96)).to_pydict()
    assert got == {"cid": [7] * 5, "vec_id": [0, 1, 2, 3, 4], "score": [2.0] * 5}


@pytest.mark.parametrize("name", ["op2_near_dedup", "op4_shards", "op8_substring_dedup", "op10_suffix_dedup"])
def test_queries_match_sql(spark, name):
    import duckdb

    from tideline.llm import queries

    con = duckdb.connect()
    con.sql(f"create view documents as select * from read_parquet('{SF}/documents.parquet')")
    expected = con.sql(queries.ORACLES[name])
    got = queries.QUERIES[name](spark, SF)
    assert set(expected.columns) == set(got.columns)
    assert sorted(map(repr, map(tuple, got.select(*expected.columns).collect()))) == sorted(map(repr, expected.fetchall()))


def test_previous_factors():
    """Against the definition: the longest prefix of each suffix that starts earlier as well."""
    rng = np.random.default_rng(6)
    for n, letters, length in ((60, 2, 9), (200, 3, 20), (1, 2, 5), (40, 1, 100)):
        text = rng.integers(97, 97 + letters, n).astype(np.uint8)
        got = op10_suffix.longest_previous_factors(op10_suffix.suffix_ranks(text, length), np.arange(n))
        raw = text.tobytes()
        for i in range(n):
            best = max((next((k for k in range(min(length, n - i)) if raw[i + k] != raw[j + k]), min(length, n - i)) for j in range(i)), default=0)
            assert got[i] == best
    x = rng.permutation(500)
    assert op10_suffix.previous_smaller(x).tolist() == [max((j for j in range(i) if x[j] < x[i]), default=-1) for i in range(500)]


def test_suffix_dedup_with_a_hot_minimizer(spark, monkeypatch):
    """A line that many texts share in different surroundings, some of which repeat: dealt by what lies beside it."""
    monkeypatch.setattr(op10_suffix, "HOT", 8)
    rng = np.random.default_rng(8)
    line = bytes(rng.integers(97, 123, 60).astype(np.uint8)).decode()
    sides = [bytes(rng.integers(97, 123, 90).astype(np.uint8)).decode() for _ in range(30)]
    rows = [(i, sides[rng.integers(30)][rng.integers(40) :] + line + sides[rng.integers(30)][: rng.integers(10, 90)]) for i in range(200)]
    expected = brute_bytes(dict(rows))
    got = op10_suffix.dedup_bytes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == expected


CLASHES = SCHEMA.replace("n_chars long, ", "") + ", _id int, _text string, _pieces int, _votes int, _m_n_words int, _M_x int, text_ string"


@pytest.mark.parametrize("rows", ["odd", "none"])
def test_pipeline_stages_on_odd_tables(spark, odd, rows):
    """Nulls, repeats, columns with the names that stages use themselves, no n_chars, and empty tables."""
    import corpus_pipeline

    df = odd.drop("n_chars").selectExpr("*", "1 as _id", "'t' as _text", "2 as _pieces", "3 as _votes", "4 as _m_n_words", "5 as _M_x", "'u' as text_")
    df = spark.createDataFrame(df.collect() if rows == "odd" else [], CLASHES)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, SF)
        got = [r.asDict() for r in out.collect()]
        if name == "packing":
            assert len(got) == (0 if rows == "none" else df.where("doc_id is not null").count())
            continue
        assert out.columns == df.columns and all(r["_id"] == 1 and r["_text"] == "t" and r["text_"] == "u" for r in got)
        ids = [r["doc_id"] for r in got]
        if rows == "none":
            assert ids == []
        elif name == "near-dedup":  # 5, 6 and 7 are linked; each text without words stays; 8 to 10 are alone
            assert sorted(ids) == [0, 1, 2, 3, 4, 5, 8, 9, 10]
        elif name == "substring dedup":  # 6 is nothing but what 5 has
            assert {r["doc_id"]: r["text"] for r in got if r["doc_id"] in (0, 5, 7)} == {0: None, 5: odd.where("doc_id = 5").first()["text"], 7: "head tail"} and 6 not in ids
        elif name == "mixing":
            assert {0, 1, 2}.isdisjoint(ids) and None not in ids
        else:
            assert None not in ids


def test_mix_targets_by_hand(odd, docs):
    """Targets by a rational computation of its own: raise the common share until the budget is spent."""
    from fractions import Fraction

    for df in (odd, docs):
        sizes = collections.Counter()
        for r in df.where("doc_id is not null").select("source", "text").collect():
            sizes[r["source"]] += len(words(r["text"]))
        names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-32-be")) + [None] * (None in sizes)
        weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
        budget = Fraction(3, 2) * sum(sizes.values())
        # Sources fill up in the order of 2 * size / weight.
        left, open_ = budget, sum(weight.values())
        target = {}
        for s in sorted(names, key=lambda s: Fraction(2 * sizes[s], weight[s])):
            target[s] = min(Fraction(2 * sizes[s]), left * weight[s] / open_)
            left, open_ = left - target[s], open_ - weight[s]
        got = {(r["source_size"], r["target"]) for r in op5_mix.mix_documents(df)[0].collect()}
        assert {size for size, _ in got} == set(sizes.values())
        for size, t in got:
            assert any(size == sizes[s] and math.isclose(t, float(target[s]), rel_tol=1e-12) for s in names)


def test_sizes_and_checksums(odd, docs):
    for df in (odd, docs):
        texts = texts_of(df)
        for r in op4_shards.assign(df).collect():
            t = texts[r["doc_id"]]
            assert (r["size"], r["text_crc32"]) == (len((t or "").encode()) + 8, None if t is None else zlib.crc32(t.encode()))
            assert 0 <= r["shard"] < 24
        by_text = collections.defaultdict(set)
        for r in op4_shards.assign(df).collect():
            by_text[texts[r["doc_id"]]].add(r["shard"])
        assert all(len(s) == 1 for s in by_text.values())


def test_packed_buckets_and_batches(odd, docs):
    for df in (odd, docs):
        got = op6_pack.pack(df, buckets=5, budget=3000).toPandas()
        rows = df.where("doc_id is not null").select("text").collect()
        assert sorted(got.n_tokens) == sorted(len(words(r["text"])) for r in rows)
        lengths, counts = np.unique(got.n_tokens, return_counts=True)
        uppers = np.array(op6_pack.best_buckets(lengths, counts, 5))
        assert (got.bucket == np.searchsorted(uppers, got.n_tokens)).all() and (got.bucket_len == uppers[got.bucket]).all()
        for (_, size), part in got.groupby(["bucket", "bucket_len"]):
            held = max(1, 3000 // max(size, 1))
            order = part.sort_values(["batch", "place"])
            assert (order.batch * held + order.place).tolist() == list(range(len(part)))  # no gaps
            assert order[["n_tokens", "doc_id"]].apply(tuple, axis=1).is_monotonic_increasing


def test_quality_counts_and_posterior(odd, docs):
    for df in (odd, docs):
        texts = texts_of(df)
        for r in op7_quality.verdicts(df).collect():
            t = texts[r["doc_id"]] or ""
            lines = [x for x in t.encode().split(b"\n") if x.split()]
            assert (r["n_symbols"], r["n_dup_lines"]) == (sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)))
    # Five rules that are right with known probabilities, and every pattern as often as it is expected, so that nothing is
    # left to chance: EM finds them, and the posterior is Bayes' rule.
    import itertools

    right, share = np.array([0.9, 0.85, 0.8, 0.75, 0.7]), 0.6
    patterns = np.array(list(itertools.product((0, 1, 2), repeat=5)))
    chance = [np.prod(np.where(patterns == 0, 0.2, 0.8 * np.where(patterns == yes, right, 1 - right)), axis=1) for yes in (1, 2)]
    good, bad = share * chance[0], (1 - share) * chance[1]
    prior, tables, posterior = op7_quality.fit(patterns, 1e6 * (good + bad), 5000)
    assert abs(prior - share) < 0.01
    assert np.abs(tables[0, :, 1] / tables[0, :, 1:].sum(1) - right).max() < 0.01 and np.abs(tables[1, :, 2] / tables[1, :, 1:].sum(1) - right).max() < 0.01
    voted = (patterns > 0).any(1)
    assert np.abs(posterior - good / (good + bad))[voted].max() < 0.02


def test_toxicity_chain_of_categories(spark):
    """Three toxicity categories, of which later ones follow from earlier ones: the chain uses what it has predicted."""
    rng = np.random.default_rng(9)
    rows, labels = [], []
    for i in range(1200):
        insult, threat = rng.random() < 0.4, rng.random() < 0.4
        text = " ".join(f"w{rng.integers(80)}" for _ in range(20)) + (" you idiot" if insult else "") + (" will hurt you" if threat else "")
        rows.append((i, text))
        if i < 900:
            labels.append((i, int(insult), int(threat), int(insult and threat) if i % 2 else None))
    docs = spark.createDataFrame([*rows, rows[0], (5000, ""), (5001, None)], "doc_id long, text string")
    table = spark.createDataFrame(labels, "doc_id long, insult int, threat int, severe int")
    chain = op1_toxicity.train(docs, table, {c: F.col(c) for c in ("insult", "threat", "severe")})
    assert [len(m.earlier) for m in chain.models] == [0, 1, 2] and (chain.models[2].earlier > 0.5).all()
    got = op1_toxicity.predict(docs, chain).toPandas()
    assert len(got) == 1203 and got[got.doc_id == 0].drop_duplicates().shape[0] == 1
    held = got[(got.doc_id >= 900) & (got.doc_id < 5000)]
    truth = [("idiot" in rows[i][1], "hurt" in rows[i][1]) for i in held.doc_id]
    for name, expected in (("insult", [a for a, _ in truth]), ("threat", [b for _, b in truth]), ("severe", [a and b for a, b in truth])):
        assert ((held[f"p_{name}"] >= 0.5) == expected).mean() >= 0.98
    empty = got[got.doc_id >= 5000].drop(columns="doc_id")
    assert (empty.iloc[0] == empty.iloc[1]).all() and (empty < 0.5).all().all()


class Rows:
    def __init__(self, rows):
        self.to_pylist = lambda: rows


def merged_pairs(spark, texts, n, hot=()):
    df, hot = spark.createDataFrame(texts, "doc_id long, text string"), np.array(sorted(hot), np.uint64)
    return [r for r in df.mapInArrow(lambda it: op9_lm._send(it, n, hot), op9_lm._SENT_DDL).groupBy("bucket").applyInArrow(lambda t: op9_lm._merge(t, hot), op9_lm._MERGED_DDL).toArrow().to_pylist() if r["kind"] == 1]


def sampled(rows, sweeps, parts=1, n_hot=0, seed=9):
    """The sweeps of `train` on the driver: the model, and the buckets with their totals."""
    import pyarrow as pa

    model = op9_lm.Model(0, 0, 0.5, 0.5, 1.0, seed, [])
    rows = [r | {"totals": []} for r in rows]
    for k in range(sweeps + 1):
        groups = collections.defaultdict(list)
        for x in pa.Table.from_batches(op9_lm._totals(iter([Rows(rows)]), model, parts, n_hot)).to_pylist():
            groups[x["kind"], x["part"]].append(x)
        added = [x for g in groups.values() for x in op9_lm._add(pa.Table.from_pylist(g, schema=op9_lm._SUMS_SCHEMA)).to_pylist()]
        for r in rows:
            r["totals"] += [x | {"sweep": k} for x in added if x["bucket"] == r["bucket"]]
        op9_lm.advanced(model, added, n_hot)
    return model, [op9_lm.Bucket(r) for r in rows]


def train_ids(n):
    return [i for i in range(10 * n) if not op9_lm.held_out(i)][:n], [i for i in range(10 * n) if op9_lm.held_out(i)]


def hashes(*names):
    from tideline.llm._text import Block

    raw = " ".join(names).encode()
    return list(map(int, Block(0, np.zeros(1, np.int64), np.frombuffer(raw, np.uint8), np.array([0, len(raw)])).words().hash))


def test_language_model_sums_to_one(spark):
    """Held-out texts that ask for every word after every word: with one unknown word, probabilities sum to one after each
    context, whether words are hot or not."""
    rng = np.random.default_rng(12)
    names = [f"w{i}" for i in range(9)]
    train, held = train_ids(60)
    texts = [(i, " ".join(rng.choice(names, rng.integers(1, 12)))) for i in train]
    every = " ".join(x for a in names for b in names for x in (a, b))
    texts += [(held[0], every + " unknown " + " unknown ".join(names) + " unknown")] + [(held[j + 1], x) for j, x in enumerate(names)]
    for n, parts, hot in ((2, 1, []), (4, 2, hashes("w1", "w2", "unknown"))):
        model, buckets = sampled(merged_pairs(spark, texts, n, hot), 3, parts, len(hot))
        assert model.vocabulary == 10 and model.train_tokens == sum(len(t.split()) + 1 for i, t in texts if i in train)
        sums = collections.Counter()
        for b in buckets:
            for k, (t, _, p) in enumerate(b.replay(model)):
                if k == 3:
                    for u, x in zip(b.u, b.probability(model, t, p, 3)):
                        sums[int(b.contexts[u])] += x
        # After the unknown word, all words but the end were asked for.
        assert sum(abs(x - 1) < 1e-9 for u, x in sums.items() if u != int(op9_lm._END) >> 16) >= 9


@pytest.mark.parametrize("hot", [(), ("a", "b")])
def test_language_model_against_the_exact_posterior(spark, hot):
    """All seatings of a tiny corpus, weighed by their probability, give nearly the averages that the sweeps give."""
    import itertools

    texts = ["a b", "a b", "a c"]
    train, _ = train_ids(3)
    model, buckets = sampled(merged_pairs(spark, list(zip(train, texts)), 2, hashes(*hot) if hot else ()), 80, 1, len(hot))
    names = {x >> 64 - op9_lm.CONTEXT_BITS: w for x, w in zip([*hashes("a", "b", "c"), int(op9_lm._END)], "abc$")}
    got = collections.Counter()
    of_count = {("$", 3): "a", ("a", 2): "b", ("a", 1): "c"}  # a context and a count name the word here
    for b in buckets:
        for k, (t, _, p) in enumerate(b.replay(model)):
            if 5 < k < len(model.sweeps):
                for u, c, x in zip(b.u, b.c, b.probability(model, t, p, k)):
                    context = names[int(b.contexts[u])]
                    got[context, of_count.get((context, int(c)), "$")] += x / (len(model.sweeps) - 6)
    pairs = {("$", "a"): 3, ("a", "b"): 2, ("b", "$"): 2, ("a", "c"): 1, ("c", "$"): 1}
    d, d0, s, v = model.discount, model.top_discount, 1.0, 4
    assert math.isclose(d, 2 / 6) and math.isclose(d0, 3 / 5) and model.train_tokens == 9 and model.vocabulary == v
    log_s, log_s0 = op9_lm.stirling(d), op9_lm.stirling(d0)
    total, mean = 0.0, collections.Counter()
    for ts in itertools.product(*(range(1, c + 1) for c in pairs.values())):
        t = dict(zip(pairs, ts))
        customers = collections.Counter()
        for (_, w), x in t.items():
            customers[w] += x
        for tops in itertools.product(*(range(1, customers[w] + 1) for w in customers)):
            top = dict(zip(customers, tops))
            tables = collections.Counter()
            log = 0.0
            for (u, w), x in t.items():
                log += log_s[pairs[u, w], x]
                tables[u] += x
            log += sum(math.log(s + d * j) for u in tables for j in range(tables[u]))
            log += sum(log_s0[customers[w], top[w]] for w in top) + sum(math.log(s + d0 * j) for j in range(sum(tops)))
            log -= sum(math.log(s + i) for i in range(sum(customers.values()))) + sum(tops) * math.log(v + 1)
            weight = math.exp(log)
            total += weight
            for (u, w), c in pairs.items():
                p0 = (customers[w] - d0 * top[w] + (s + d0 * sum(tops)) / (v + 1)) / (s + sum(customers.values()))
                n = sum(x for (a, _), x in pairs.items() if a == u)
                mean[u, w] += weight * (c - d * t[u, w] + (s + d * tables[u]) * p0) / (s + n)
    for (u, w), p in mean.items():
        assert abs(got[u, w] - p / total) < 0.03


def test_language_model_spreads_a_hot_word(spark):
    """A word that is half of all tokens, and follows and precedes everything, is found and dealt over all buckets."""
    train, _ = train_ids(300)
    texts = [(i, " ".join(f"the x{i * 7 + j}" for j in range(40))) for i in train]
    hot = op9_lm.hot_words(spark.createDataFrame(texts, "doc_id long, text string"), 16, op9_lm.Scratch(spark))
    assert hashes("the")[0] in hot.tolist() and len(hot) <= 16
    sizes = [r["n_pairs"] for r in merged_pairs(spark, texts, 16, hot)]
    assert len(sizes) == 16 and max(sizes) < 2.5 * min(sizes)  # the end of texts is not common enough to be hot


def test_language_model_memory():
    """A bucket's working memory does not grow with the dishes of one size that it draws at once, nor with documents that
    it does not hold, nor do buckets with the input."""
    import tracemalloc

    def peak(f):
        tracemalloc.start()
        try:
            return f(), tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()

    rng = np.random.default_rng(3)
    c, base = np.full(100_000, 20), np.full(100_000, 0.01)
    tables, took = peak(lambda: op9_lm.seat(c, rng.integers(0, 50, 100_000), base, 0.5, 1.0, rng))
    assert took < 30_000_000 and 1 <= tables.min() and tables.max() <= 20

    model = op9_lm.Model(4, 1, 0.5, 0.5, 1.0, 9, [op9_lm.Totals(2, 1, np.zeros(0, np.int64), np.zeros(0, np.int64))])
    numbers = lambda *x: op9_lm._small(np.array(x, np.int64))
    row = {"bucket": 0, "kind": 1, "n": 1, "n_pairs": 2, "n_contexts": 2, "n_docs": 3, "hot": numbers(0), "pairs": numbers(2), "contexts": numbers(5, 6), "u": numbers(0, 1), "c": numbers(3, 1), "inc": numbers(2, 1)}
    row |= {"doc": numbers(0, 900_001, 900_001), "times": numbers(1, 2, 1), "blocks": np.array([[7, 900_000], [8, 1_000_000], [9, 50]], np.int64).tobytes()}
    row |= {"totals": [{"sweep": 0, "part": 0, "n": 2, "tables": numbers(1, 1), "customers": numbers(3, 1)}]}
    scored = lambda: list(op9_lm._score(iter([Rows([row])]), model, 1))
    scored()  # what it imports does not count
    got, took = peak(scored)
    assert took < 10_000_000
    got = got[0].to_pylist()
    assert [(x["block"], x["n"], op9_lm._wide(x["place"], x["n"]).tolist()) for x in got] == [(7, 1, [0]), (8, 1, [1]), (9, 0, [])]
    known = [op9_lm._wide(x["sums"][12 * x["n"] :], x["n"]).tolist() for x in got]
    assert known == [[1], [3], []] and np.isclose(np.frombuffer(got[1]["sums"][4:12], float)[0], 3 * math.log10(5 / 6))

    for size in (0, 10**6, 81 * 10**6, 220 * 10**6, 1_300 * 10**6):
        assert op9_lm.bucket_count(size) >= 32 and size / op9_lm.bucket_count(size) <= 2_500_000
