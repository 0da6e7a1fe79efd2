"""The llm operators against plain Python, on tables with everything that can be odd about them."""

import bisect
import datetime as dt
import math
import random
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from crosslake.llm import queries as Q
from crosslake.llm import mixing
from crosslake.llm import spans as S
from crosslake.llm import topn
from crosslake.llm.mixing import SEED, exponential_key, make_plan, mix, source_name
from crosslake.llm.packing import fill_report, first_fit_decreasing, pack
from crosslake.llm.quantiles import exact_percentiles, merge_percentile_states, percentile_states, percentiles, rank_check, rank_error
from crosslake.llm.tokens import token_counts
from crosslake.llm.topn import LoserTree, top_n
from tests.conftest import DATA, needs_data
from tests.llm import brute
from tests.oracle import assert_same, connect


def rows(name):
    return pq.read_table(f"{DATA}/{name}.parquet").to_pylist()


@needs_data
@pytest.mark.parametrize("name", list(Q.SQL))
def test_matches_sql(spark, name):
    assert_same(Q.QUERIES[name](spark, DATA), Q.SQL[name], connect(DATA))


@needs_data
@pytest.mark.parametrize("name", [n for n in Q.QUERIES if n not in Q.SQL])
def test_runs(spark, name):
    Q.QUERIES[name](spark, DATA).count()


# --- 6


def test_percentiles(spark):
    r = random.Random(1)
    data = [("hot", d % 5, int(r.paretovariate(0.7) * 10) % 10_000_000, 1) for d in range(60_000)] + [("same", 0, 7, 1)] * 3000 + [("few", i, v, 1) for i, v in enumerate([5, 1, 9, None])] + [("none", 0, None, 1), (None, 0, 3, 1)]
    df = spark.createDataFrame(data, "g string, day int, v int, sketch int").repartition(6)
    whole = {x.g: x for x in percentiles(percentile_states(df, ["g"], "v")).collect()}
    merged = {x.g: x for x in percentiles(merge_percentile_states(percentile_states(df, ["g", "day"], "v"), ["g"])).collect()}
    values = defaultdict(list)
    for g, _, v, _ in data:
        if v is not None:
            values[g].append(v)
    for got in (whole, merged):
        assert got.keys() == {"hot", "same", "few", "none", None}
        assert (got["none"].n_values, got["none"].p50) == (0, None)
        assert (got["same"].p50, got["same"].p99) == (7, 7) and (got["few"].p50, got["few"].p99) == (5, 9)
        for g, x in got.items():
            v = sorted(values[g])
            assert x.n_values == len(v)
            for p, y in ((0.5, x.p50), (0.9, x.p90), (0.95, x.p95), (0.99, x.p99)):
                if v:
                    low, high = bisect.bisect_left(v, y) / len(v), bisect.bisect_right(v, y) / len(v)
                    assert max(0, low - p, p - high) <= 1.5 * x.rank_error + 1 / len(v)
    fine = spark.createDataFrame([("a", 0.1), ("a", 0.5), ("a", 0.9), ("a", float("nan")), ("b", -1.5)], "g string, v double")
    assert sorted((r.g, r.n_values, r.p50, r.p99, r.rank_error) for r in percentiles(merge_percentile_states(percentile_states(fine, ["g"], "v"), ["g"])).collect()) == [("a", 3, 0.5, 0.9, 0.0), ("b", 1, -1.5, -1.5, 0.0)]
    assert percentiles(percentile_states(fine.withColumn("v", F.lit("12.34").cast("decimal(6,2)")), ["g"], "v")).first().p50 == 12.34
    for bad in ("decimal(38,10)", "string"):
        with pytest.raises(ValueError):
            percentile_states(fine.withColumn("v", F.col("v").cast(bad)), ["g"], "v")
    off = rank_check(df, percentiles(percentile_states(df, ["g"], "v")), ["g"], "v").collect()
    assert len(off) == 4 * 4 and all(r.off <= 1.5 * (rank_error() if r.n_values > 512 else 0) + 1 / r.n_values for r in off)
    assert whole["few"].rank_error == 0 and whole["hot"].rank_error == rank_error() < 0.006
    assert percentiles(percentile_states(df.limit(0), ["g"], "v")).count() == 0


def test_exact_percentiles(spark, tmp_path):
    rng = random.Random(3)
    rows = [("hot", rng.choice((rng.random(), 0.25, None))) for _ in range(9000)] + [("same", 7.0)] * 700 + [(None, i / 8) for i in range(600)]
    rows += [("few", 5.5), ("few", float("nan")), ("few", -1.0), ("none", None), ("none", float("nan"))]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    values = {g: sorted(v for h, v in rows if g == h and v is not None and v == v) for g, _ in rows}
    percents = (0.001, 0.5, 0.95, 0.99, 1.0)
    got = exact_percentiles(df, ["g"], "v", percents).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((g, len(v), *(v[max(1, math.ceil(Fraction(str(p)) * len(v))) - 1] if v else None for p in percents))) for g, v in values.items())
    assert exact_percentiles(df.limit(0), ["g"], "v").count() == 0
    runs = df.selectExpr("g AS check_id", "' Pass' AS status", "v AS actual_value")
    runs.write.parquet(f"{tmp_path}/quality_check_runs.parquet")
    assert {(r.check_id, r.status, r.n_values) for r in Q.QUERIES["p6_fractions_all"](spark, str(tmp_path)).collect()} == {(g, "pass", len(v)) for g, v in values.items()}


# --- 7


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 30)), max_size=9))
def test_loser_tree_sorts(runs):
    runs = [sorted(r) for r in runs]
    at = [0] * len(runs)
    t, out = LoserTree([r[0] if r else None for r in runs]), []
    while (w := t.winner()) >= 0:
        out.append(t.heads[w])
        at[w] += 1
        t.replace(runs[w][at[w]] if at[w] < len(runs[w]) else None)
    assert out == sorted(x for r in runs for x in r)


@pytest.mark.parametrize("run_rows, block, bucket, fan", [(7, 3, 10, 2), (50, 4096, 200, 3), (200_000, 100, 50_000, 64)])
def test_top_n(spark, monkeypatch, run_rows, block, bucket, fan):
    monkeypatch.setattr(topn, "BLOCK_ROWS", block)
    monkeypatch.setattr(topn, "FAN_IN", fan)
    monkeypatch.setattr(topn, "HEAD_ROWS", block)
    r = random.Random(2)
    data = [(r.choice(["hot"] * 5 + [f"g{i}" for i in range(40)] + [None, "", "é"]), r.choice([None, *range(8)]), r.choice([None, 1, 2]), f"i{i:04d}", "rank") for i in range(3000)]
    data += data[:500]  # copies
    df = spark.createDataFrame(data, "g string, s int, t int, id string, rank string").repartition(5)
    got = top_n(df, F.col("g"), 3, F.col("s"), [F.col("t"), F.col("id")], {"id": F.col("id")}, run_rows=run_rows, bucket_rows=bucket).collect()
    groups = defaultdict(set)
    for g, s, t, i, _ in data:
        if g is not None:
            groups[g].add((s is None, -(s or 0), t is None, t or 0, i))
    want = sorted((g, k + 1, x[4]) for g, v in groups.items() for k, x in enumerate(sorted(v)[:3]))
    assert sorted((x.group_key, x.rank, x.id) for x in got) == want
    assert top_n(df.limit(0), F.col("g"), 3, F.col("s"), [F.col("id")], {"id": F.col("id")}).count() == 0


@needs_data
def test_p7_whole(spark):
    got = Counter((x.item_table, x.item_id) for x in Q.p7_found(spark, DATA).collect())
    assert got == Counter(brute.p7(rows("query_history"), rows("dataset_shares"), rows("users")))


# --- 8


def _first_fit(sizes, capacity):
    free, out = [], []
    for s in sizes:
        i = next((i for i, f in enumerate(free) if f >= s), len(free))
        if i == len(free):
            free.append(capacity)
        free[i] -= s
        out.append(i)
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 50)))
def test_first_fit(sizes):
    sizes = sorted(sizes, reverse=True)
    assert first_fit_decreasing(sizes, 50) == _first_fit(sizes, 50)


def test_pack(spark):
    r = random.Random(4)
    data = [(i, r.choice([0, 1, 50, 700, 2047, 2048, 2049, 9000, r.randint(1, 3000)]), "x") for i in range(3000)] + [(5000, None, "x"), (5001, -3, "x"), (1, 10, "x")]
    df = spark.createDataFrame(data, "doc_id long, n int, piece string")
    got = pack(df, "doc_id", "n", 2048, group_items=500).collect()
    used = Counter()
    for x in got:
        used[x.container_id] += x["size"]
    assert max(used.values()) <= 2048
    parts = defaultdict(list)
    for x in got:
        parts[x.doc_id].append((x.start, x["size"]))
    for i, n, _ in data:
        if i == 1:
            continue
        n = max(n or 0, 0)
        assert sorted(parts[i]) == [(s, min(2048, n - s)) for s in range(0, max(n, 1), 2048)]
    assert len(parts[1]) >= 2
    report = fill_report(pack(df, "doc_id", "n", 2048), 2048).first()
    # many items of 2047 fit nothing else, so only the method's own bound holds here
    assert report.containers <= 11 / 9 * report.least_containers + 1 and report.fullest <= 2048
    even = fill_report(pack(spark.range(5000).select("id", (F.abs(F.xxhash64("id")) % 1500 + 1).alias("n")), "id", "n", 2048), 2048).first()
    assert even.unused_share < 0.01
    again = pack(df.repartition(7), "doc_id", "n", 2048, group_items=500).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))
    assert pack(df.limit(0), "doc_id", "n", 2048).count() == 0


def test_tokens(spark):
    import tiktoken

    from crosslake.llm.tokens import SPLIT_PATTERN, TOKENIZER_FILE, encoder

    texts = [None, "", " ", "Hello world, it's 12345", "ä" * 1000, "x" * 200_000, "<|endoftext|>", "\U0001f600 文"]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string").withColumn("n_chars", F.lit(1))
    got = {r.i: r.n_tokens for r in token_counts(df, "i", "text").collect()}
    enc = encoder(TOKENIZER_FILE, SPLIT_PATTERN)
    assert isinstance(enc, tiktoken.Encoding)
    assert got == {i: len(enc.encode_ordinary(t)) if t else 0 for i, t in enumerate(texts)}
    assert enc.decode(enc.encode_ordinary(texts[3])) == texts[3]
    assert token_counts(df.limit(0), "i", "text").count() == 0


# --- 9


def docs_of(spark, n, seed=0):
    r = random.Random(seed)
    data = [(i, r.choice(["a"] * 8 + [" A ", "b", "B-c", "b_c", "none", None]), r.choice([0, 1, 100, r.randint(1, 400)]), r.choice([None, 0.0, 1.0, 5.0])) for i in range(n)]
    df = spark.createDataFrame(data, "doc bigint, source string, n_tokens bigint, w double")
    return df.select(F.col("doc").alias("id"), source_name(F.col("source")).alias("source"), "n_tokens", exponential_key(F.col("doc"), F.col("w")).alias("key"))


TARGETS = [("A", 0.5, 1), ("b", 0.2, 3), ("b-c", 0.2, 2), ("ghost", 0.1, 4)]


@pytest.mark.parametrize("total, most", [(None, 0), (None, 10_000), (0, 1), (1, 1), (5000, 0), (5000, 50), (10**9, 1)])
def test_mix(spark, monkeypatch, total, most):
    monkeypatch.setattr(mixing, "SORTED", most)
    docs = docs_of(spark, 3000).withColumns({"rest": F.lit("clash"), "epochs": F.lit("clash"), "b1": F.lit("clash"), "uses": F.lit("clash")}).cache()
    targets = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    chosen, report = mix(docs, targets, total)
    all_docs = defaultdict(list)
    for r in docs.withColumn("spread", F.shiftrightunsigned(F.xxhash64("id", F.lit(SEED + 1)), 12)).collect():
        all_docs[r.source].append((r.key, r.spread, r.id, r.n_tokens))
    uses = defaultdict(dict)
    for r in chosen.collect():
        assert r.id not in uses[r.source]
        uses[r.source][r.id] = r.uses
    plan = make_plan(sorted((s.lower().replace("-", "_"), w, c) for s, w, c in TARGETS), {s: sum(x[3] for x in v) for s, v in all_docs.items()}, total)
    for p in plan:
        run, part, inside = 0, sorted(all_docs.get(p.source, [])), set()
        for *_, i, n in part:
            run += n
            if not p.rest or run > p.rest:
                run -= n
                break
            inside.add(i)
        if p.rest - run > mixing.GAP_SHARE * p.rest:
            inside |= set(mixing._fill(p.rest - run, [(n, i) for *_, i, n in part if i not in inside][: mixing.FILL]))
        want = {i: p.epochs + (i in inside) for *_, i, _ in part if p.epochs + (i in inside)}
        assert uses[p.source] == want, p
        assert max(want.values(), default=0) <= p.max_repeats
    rep = {r.source: r for r in report.collect()}
    assert rep.keys() == {"a", "b", "b_c", "ghost"} and rep["ghost"].chosen_tokens == 0
    if total is None:
        assert all(abs(rep[s].actual_share - w / 0.9) < 0.02 for s, w in (("a", 0.5), ("b", 0.2), ("b_c", 0.2)))
    docs.unpersist()


def test_fill():
    assert mixing._fill(10, [(12, "a"), (4, "b"), (0, "c"), (7, "d"), (5, "e")]) == ["b", "e"]
    assert mixing._fill(10, [(12, "a"), (30, "b")]) == ["a"] and mixing._fill(10, [(20, "a")]) == [] and mixing._fill(3, []) == []


@pytest.mark.parametrize("most", [0, 100_000])
def test_mix_equal_keys(spark, monkeypatch, most):
    """Keys that are all equal, as of texts without a weight, are divided by a hash of the id."""
    monkeypatch.setattr(mixing, "SORTED", most)
    df = spark.range(30_000).select("id", F.lit("s").alias("source"), (F.col("id") % 7 + 1).alias("n_tokens"), F.lit(2.5).alias("key"))
    one = [("s", 1.0, 1)], "source string, target_share double, max_repeats int"
    chosen, report = mix(df, spark.createDataFrame(*one), 30_000)
    ids = [r.id for r in chosen.collect()]
    assert 29_970 <= report.first().chosen_tokens <= 30_000 and 6500 < len(ids) < 8500 and 13_000 < sum(ids) / len(ids) < 17_000
    worst = spark.range(100).select("id", F.lit("s").alias("source"), F.lit(50).cast("bigint").alias("n_tokens"), F.lit(1.0).alias("key"))
    assert [mix(worst, spark.createDataFrame(*one), n)[1].first().chosen_tokens for n in (20, 30, 74, 76)] == [0, 50, 50, 100]


def test_quality_weight(spark):
    from crosslake.llm import quality as U

    usual = ["the table was loaded without errors and all checks have passed today", "the report of the table has passed the checks without errors"] * 40
    odd = ["zq xv wj kq pz vx jw qk zp xq vj wk", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa"]
    texts = [*usual, *odd, None, "", "ab", "\U0001f600\U0001f601\U0001f602"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(4)
    model = U.train(df, "text")
    grams = [t[k : k + 3] for t in texts if t for k in range(len(t) - 2)]
    assert model[0].sum() == model[1].sum() == len(grams)
    bits = U.scorer(model)(pa.array(texts, pa.string())).to_pylist()
    assert bits[-4:-1] == [None] * 3 and bits[len(usual)] > max(bits[: len(usual)]) + 1
    assert U.scorer(model)(pa.array([texts[0], None, texts[len(usual)]], pa.string())).to_pylist() == pytest.approx([bits[0], None, bits[len(usual)]], abs=1e-9)
    w = spark.createDataFrame([(b,) for b in (5.0, 6.0, 20.0, None)], "b double").select(U.usual_weight(F.col("b"), F.lit(5.0), F.lit(1.0))).collect()
    assert [round(r[0], 3) for r in w] == [1.0, 0.607, U.LEAST_WEIGHT, U.LEAST_WEIGHT]
    empty = U.train(df.limit(0), "text")
    assert empty[0].sum() == 0 and U.scorer(empty)(pa.array(["abc", None])).to_pylist()[1] is None


def test_mix_prefers_weight(spark):
    df = spark.range(20_000).select("id", F.lit("s").alias("source"), F.lit(10).cast("bigint").alias("n_tokens"), exponential_key(F.col("id"), F.when(F.col("id") % 2 == 0, 4.0).otherwise(1.0)).alias("key"))
    chosen = mix(df, spark.createDataFrame([("s", 1.0, 1)], "source string, target_share double, max_repeats int"), 40_000)[0]
    even = chosen.where("id % 2 = 0").count()
    assert chosen.count() == 4000 and 2900 < even < 3400  # without replacement at four to one
    assert mix(df.limit(0), spark.createDataFrame([("s", 1.0, 1)], "source string, target_share double, max_repeats int"))[0].count() == 0
    assert mix(df, spark.createDataFrame([], "source string, target_share double, max_repeats int"))[0].count() == 0


# --- 10


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", max_size=40), max_size=6), st.integers(2, 12))
def test_windows_keep_every_shared_span(texts, span):
    codes = np.array([ord(c) for t in texts for c in t], np.uint32)
    text, pos, h = S.chosen_windows(codes, np.array([len(t) for t in texts], np.int64), span)
    chosen = defaultdict(set)
    for t, p, x in zip(text, pos, h):
        chosen[t].add((p, x))
    half = span // 2
    for t, p in zip(text, pos):
        assert p + half <= len(texts[t])
    at = {i: {p for p, _ in v} for i, v in chosen.items()}
    for i, t in enumerate(texts):
        for a in range(len(t) - span + 1):  # each stretch keeps a window, the same one wherever it stands
            rel = min(p - a for p in at[i] if a <= p <= a + span - half and S.window_hashes(np.array([ord(c) for c in t[p : p + half]], np.uint32), half)[0] == min(S.window_hashes(np.array([ord(c) for c in t[a : a + span]], np.uint32), half)))
            assert 0 <= rel <= span - half


def shared_docs(seed, n=60):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij äö文\n") for _ in range(r.randint(3, 9)))
    text = lambda k: " ".join(word() for _ in range(k))
    passages = [text(r.randint(6, 12)) for _ in range(6)]
    docs = []
    for i in range(n):
        t = text(r.randint(0, 30))
        for _ in range(r.randint(0, 3)):
            p = r.choice(passages)
            a, b = sorted((r.randint(0, len(p)), r.randint(0, len(p))))
            t += p[a:b] + text(r.randint(0, 4))
        docs.append((i * 3, t))
    docs += [(1, docs[0][1]), (4, None), (7, ""), (10, "x"), (13, "z" * 500), (16, "z" * 300 + "q"), (19, "lone " * 100), (22, docs[5][1] * 2)]
    return docs


@pytest.mark.parametrize("span, contexts, chunk", [(20, 4096, 1024), (20, 2, 2), (31, 1, 1024)])
def test_spans(spark, monkeypatch, span, contexts, chunk):
    monkeypatch.setattr(S, "GROUP_CONTEXTS", contexts)
    monkeypatch.setattr(S, "PAIR_CHUNK", chunk)
    docs = shared_docs(span + contexts)
    df = spark.createDataFrame([(a, b, 0, "h") for a, b in docs], "doc_id bigint, text string, pos int, h string").repartition(5)
    found = S.SharedSpans(df, "doc_id", "text", span)
    as_rows = [{"doc_id": a, "text": b} for a, b in docs]
    got = [(r.id_a, r.id_b) for r in found.pairs().collect()]
    assert len(got) == len(set(got)) and set(got) == brute.p10(as_rows, span)
    shares = {r.id: r for r in found.shares().collect()}
    assert {i: r.shared_chars for i, r in shares.items()} == brute.covered(as_rows, span)
    assert shares[4].share == shares[7].share == 0.0 and shares[1].n_chars == len(docs[0][1])


@pytest.mark.parametrize("span, contexts", [(20, 4096), (31, 4096), (20, 0), (31, 3)])
def test_shared_runs(spark, monkeypatch, span, contexts):
    monkeypatch.setattr(S, "GROUP_CONTEXTS", contexts)
    docs = shared_docs(span)
    a, b = "".join(chr(200 + i) for i in range(span)), "".join(chr(500 + i) for i in range(6 * span))
    docs += [(25, "<" + a + b + ">"), (28, a + "!"), (31, "?" + b)]  # adjoining passages of different texts
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)
    got = [tuple(r) for r in S.shared_runs(df, "doc_id", "text", span).collect()]
    assert len(got) == len(set(got)) and set(got) == brute.runs([{"doc_id": x, "text": t} for x, t in docs], span)
    assert {(25, 1, 1 + span), (25, 1 + span, 1 + 7 * span)} <= set(got)
    assert (25, 1, 1 + 7 * span) in {tuple(r) for r in S.SharedSpans(df, "doc_id", "text", span).spans().collect()}


def test_extents():
    r = random.Random(3)
    for _ in range(300):
        word = lambda: "".join(r.choice("ab") for _ in range(r.randint(0, 6)))  # noqa: E731, B023
        c = list({(word(), word()) for _ in range(r.randint(1, 9))})
        lo = [r.randint(1, 3) for _ in c]
        hi = [x + (r.random() < 0.1) for x in lo]
        got = set(S.extents([x for x, _ in c], [x for _, x in c], lo, hi))
        for x, (u, v) in enumerate(c):
            other = [y for y in range(len(c)) if y != x and not lo[y] == hi[y] == lo[x] == hi[x]]
            all_ = {(len(u), len(v))} if lo[x] < hi[x] else {(S._common(u, c[y][0]), S._common(v, c[y][1])) for y in other}
            assert {(a, b) for k, a, b in got if k == x} == {p for p in all_ if not any(q != p and q[0] >= p[0] and q[1] >= p[1] for q in all_)}


def test_spans_hot_passage(spark):
    hot = "The same passage stands in a third of all texts, word for word. " * 4
    half = hot[:120]  # shared by the rest, but too short
    r = random.Random(9)
    noise = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(90))
    docs = [(i, noise() + (hot if i % 3 == 0 else half) + noise()) for i in range(240)]
    found = S.SharedSpans(spark.createDataFrame(docs, "doc_id bigint, text string"), "doc_id", "text", 200)
    assert found.pairs().count() == 80 * 79 // 2


def test_spans_nothing(spark):
    df = spark.createDataFrame([(1, "a" * 50), (2, None)], "doc_id bigint, text string")
    for d in (df, df.limit(0)):
        found = S.SharedSpans(d, "doc_id", "text", 200)
        assert found.pairs().count() == 0 and found.spans().count() == 0 and found.shares().count() == d.count()
    with pytest.raises(ValueError):
        S.SharedSpans(df, "doc_id", "text", 1)


def test_window_hashes_match_equal_windows():
    r = np.random.default_rng(0)
    codes = r.integers(0, 3, 4000).astype(np.uint32)
    for width in (1, 2, 7, 13):
        h = S.window_hashes(codes, width)
        by = defaultdict(set)
        for i, x in enumerate(h.tolist()):
            by[tuple(codes[i : i + width].tolist())].add(x)
        assert all(len(v) == 1 for v in by.values()) and len({x for v in by.values() for x in v}) == len(by)


def test_top_n_names(spark):
    df = spark.createDataFrame([("g", 1, "a")], "g string, s int, id string")
    with pytest.raises(ValueError):
        top_n(df, F.col("g"), 1, F.col("s"), [F.col("id")], {"score": F.col("id")})


def test_top_n_nan(spark):
    df = spark.createDataFrame([("g", float("nan"), "a"), ("g", 1.5, "b"), ("g", None, "c"), ("g", -2.0, "d")], "g string, s double, id string")
    assert [r.id for r in top_n(df, F.col("g"), 4, F.col("s"), [F.col("id")], {"id": F.col("id")}).orderBy("rank").collect()] == ["b", "d", "a", "c"]


def test_time_of_ties(spark):
    df = spark.createDataFrame([("g", 1, dt.datetime(2025, 1, 2), "a"), ("g", 1, dt.datetime(2025, 1, 1), "b")], "g string, s int, at timestamp_ntz, id string")
    assert top_n(df, F.col("g"), 1, F.col("s"), [F.col("at"), F.col("id")], {"id": F.col("id")}).first().id == "b"


def test_pieces_do_not_matter(monkeypatch):
    texts = pa.array([t for _, t in shared_docs(1)], pa.string())
    a = [(first, codes.tolist(), n.tolist()) for first, codes, n in S._coded(texts)]
    monkeypatch.setattr(S, "PIECE_BYTES", 64)
    b = [(first, codes.tolist(), n.tolist()) for first, codes, n in S._coded(texts)]
    assert [x for _, c, _ in a for x in c] == [x for _, c, _ in b for x in c] and len(b) > len(a)


def test_mixes_that_collide(monkeypatch):
    """Where the sorted mix of two different windows is the same, all hashes decide."""
    t = pa.table({"h": pa.array([5] * 4, pa.int64()), "left": pa.array([0] * 4, pa.int32()), "ck": pa.array([1, 2, 3, 4], pa.int64()), "ctx": ["abcdefgh", "zbcdefgh", "abcdefgi", "xxxxxxxx"], "lo": pa.array([1, 2, 3, 4], pa.int64()), "hi": pa.array([1, 2, 3, 4], pa.int64())})
    want = [b.to_pydict() for b in S._compare(t, 6)]
    real = S._mix
    monkeypatch.setattr(S, "_mix", lambda a, b: real(a, b) & np.uint64(0) if len(a) == 12 else real(a, b))
    got = [b.to_pydict() for b in S._compare(t, 6)]
    key = lambda out: sorted((r["ck"], r["a"], r["b"]) for b in out for r in pa.table(b).to_pylist() if r["a"] is not None)
    assert key(got) == key(want) != []


def test_many_runs():
    """A bucket's merge keeps at most the open runs' heads and n items a group, however many runs come."""
    r = np.random.default_rng(5)
    order = [("slot", "ascending"), ("group_key", "ascending"), ("score", "descending"), ("tie0", "ascending")]
    m, all_rows, most = topn._Merger(3, order), [], 0
    for _ in range(300):
        n = int(r.integers(1, 60))
        g = r.integers(0, 20, n)
        t = pa.table({"slot": pa.array(g * 7 % 5, pa.int32()), "group_key": [f"g{x}" for x in g], "score": r.integers(0, 50, n), "tie0": r.integers(0, 10**6, n)})
        run = topn._cut(topn._sorted(t, order), 3, [c for c, _ in order[1:]])
        all_rows += [tuple(x.values())[1:] for x in run.to_pylist()]
        m.add(run)
        most = max(most, sum(x.num_rows for some in m.levels for x in some))
    groups = defaultdict(set)
    for g, s, t in all_rows:
        groups[g].add((-s, t))
    got = m.end().to_pylist()
    assert sorted((x["group_key"], x["rank"], -x["score"], x["tie0"]) for x in got) == sorted((g, k + 1, *x) for g, v in groups.items() for k, x in enumerate(sorted(v)[:3]))
    assert most <= topn.FAN_IN * 60 + 5 * topn.FAN_IN * 60


@pytest.mark.parametrize("parts", [1, 2, 9, 40])
def test_agreements_across_partitions(spark, parts):
    """Neighbours that agree furthest can lie in other partitions, behind rows of the same text."""
    r = random.Random(parts)
    rows = {}
    for _ in range(300):
        word = "".join(r.choice("ab") for _ in range(r.randint(0, 7)))
        rows.setdefault((r.choice([1, 1, 1, 2]), 0, 5, 6, word), set()).add(r.choice([1, 1, 1, 1, 2, 3]))
    table = [(h, a, w, v, i, -i, text, min(ids), max(ids)) for i, ((h, a, w, v, text), ids) in enumerate(sorted(rows.items()))]
    df = spark.createDataFrame(spark.sparkContext.parallelize(table, parts), "h bigint, a int, w bigint, v bigint, t1 bigint, t2 bigint, right string, lo bigint, hi bigint")
    got = {x.t1: x.r for x in S._agreements(df).collect()}
    for h, _, _, _, i, _, text, lo, hi in table:
        other = [t for k, _, _, _, _, _, t, lo2, hi2 in table if k == h and t != text and not lo == hi == lo2 == hi2]
        assert got[i] == (len(text) if lo < hi else max((S._common(text, t) for t in other), default=0)), (text, lo, hi)
    assert len(got) == len(table)


def test_runs_of_a_hot_window(spark, monkeypatch):
    """A passage in a third of all texts, each time among other words: windows of many contexts, by the real limits of a smaller group."""
    monkeypatch.setattr(S, "GROUP_CONTEXTS", 50)
    hot = "The same passage stands in a third of all texts, word for word. " * 2
    r = random.Random(9)
    noise = lambda: "".join(r.choice("abcdefghij") for _ in range(90))
    docs = [(i, noise() + (hot if i % 3 == 0 else "") + noise()) for i in range(300)]
    got = {tuple(x) for x in S.shared_runs(spark.createDataFrame(docs, "doc_id bigint, text string"), "doc_id", "text", 60).collect()}
    assert got == brute.runs([{"doc_id": i, "text": t} for i, t in docs], 60) and len(got) >= 100
