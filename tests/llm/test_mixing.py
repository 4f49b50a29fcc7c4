import itertools
import random
import re
from collections import defaultdict

from spindrift.llm import mixing


def targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    out = {s: sum(sizes.values()) * w[s] / sum(w.values()) for s in order}
    capped = set()
    while over := {s for s in order if s not in capped and out[s] > 3 * sizes[s] * (1 + 1e-12)}:
        capped |= over
        rest = sum(sizes.values()) - sum(3 * sizes[s] for s in capped)
        free = sum(w[s] for s in order if s not in capped)
        out = {s: 3 * sizes[s] if s in capped else rest * w[s] / free for s in order}
    return out


def test_targets():
    rng = random.Random(4)
    for _ in range(200):
        sizes = {s: rng.choice([0, 1, 10, 100, 5000]) for s in [None, *"abcdefg"[: rng.randint(0, 7)]]}
        got, want = mixing.targets(sizes), targets(sizes)
        assert all(abs(got[s] - want[s]) < 1e-6 for s in sizes)
        assert abs(sum(got.values()) - sum(sizes.values())) < 1e-6


def cost_of(tokens, given, most=3):
    return sum(min(max(given - e * tokens, 0), tokens) * e for e in range(most))


def test_flow_is_the_cheapest_of_the_largest():
    rng = random.Random(5)
    for _ in range(40):
        patterns = {p: rng.randint(0, 2) for p in (("a",), ("b",), ("a", "b"))}
        quotas = {"a": rng.randint(0, 5), "b": rng.randint(0, 5)}
        links = [(p, s) for p in patterns for s in p]
        best = None
        for f in itertools.product(*[range(3 * patterns[p] + 1) for p, _ in links]):
            flow = dict(zip(links, f, strict=True))
            per = {p: sum(flow[p, s] for s in p) for p in patterns}
            if all(per[p] <= 3 * patterns[p] for p in patterns) and all(sum(v for (_, t), v in flow.items() if t == s) <= quotas[s] for s in quotas):
                key = (-sum(f), sum(cost_of(patterns[p], per[p]) for p in patterns))
                best = key if best is None else min(best, key)
        got = mixing.route(patterns, quotas)
        per = {p: sum(got[p, s] for s in p) for p in patterns}
        assert (-sum(got.values()), sum(cost_of(patterns[p], per[p]) for p in patterns)) == best


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def check(rows, got):
    assert len(got) == len(rows)
    by_id = {i: (words(t), s) for i, t, _, s in rows}
    sizes = defaultdict(int)
    for _, t, _, s in rows:
        sizes[s] += words(t)
    want, taken, largest = targets(sizes), defaultdict(int), defaultdict(int)
    for r in got:
        size, source = by_id[r["doc_id"]]
        assert r["size"] == size and r["source_size"] == sizes[source] and abs(r["target"] - want[source]) < 1e-6
        assert 0 <= r["taken"] <= 3 * size and (size == 0 or r["taken"] % size == 0)
        taken[source] += r["taken"]
        largest[source] = max(largest[source], size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1, s


def test_mix_of_odd_rows(documents, odd_rows):
    got = mixing.by_source(documents(odd_rows)).collect()
    check(odd_rows, got)
    assert mixing.by_source(documents([])).count() == 0


def test_mix_reruns_agree_and_overlaps_flow(spark, documents, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in docs.collect()]
    got = mixing.by_source(docs).orderBy("doc_id").collect()
    check(rows, got)
    assert got == mixing.by_source(docs.repartition(7)).orderBy("doc_id").collect()
    kept = mixing.mixed_documents(docs)
    assert kept.columns == docs.columns
    assert sum(words(r["text"]) for r in kept.collect()) == sum(r["taken"] for r in got)


def test_overlapping_sources(spark):
    from pyspark.sql import functions as F

    rows = [(i, "w " * 10, s) for i in range(300) for s in [["a"], ["b"], ["a", "b"]][i % 3 : i % 3 + 1]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sources array<string>")
    mixed, report = mixing.mix(docs, F.col("sources"), mixing.words_in())
    target = {r["source"]: r["target"] for r in report.collect()}
    taken = {tuple(r["pattern"]): r["t"] for r in mixed.groupBy("pattern").agg(F.sum("taken").alias("t")).collect()}
    assert abs(sum(taken.values()) - sum(target.values())) <= 15
    assert taken["a",] <= target["a"] + 5 and taken["b",] <= target["b"] + 5


def test_equal_ids_and_no_ids_agree_in_reruns(documents):
    rng = random.Random(6)
    rows = [(rng.choice([None, 1, 2]), "w " * rng.randint(0, 9) + rng.choice("xyz"), "en", rng.choice(["a", "b"])) for _ in range(300)]
    rows += [(7, "the same row", "en", "c")] * 200
    docs = documents(rows)
    key = lambda df: sorted(map(repr, df.collect()))
    kept = lambda d: key(mixing.mixed_documents(d))
    assert key(mixing.by_source(docs)) == key(mixing.by_source(docs.repartition(5)))
    assert kept(docs.repartition(3)) == kept(docs.repartition(6))
    taken = defaultdict(int)
    for r in mixing.by_source(docs).collect():
        taken[r["target"]] += r["taken"]
    assert all(abs(t - n) <= 6 for t, n in taken.items())


def test_a_long_search_for_the_cut(documents, monkeypatch):
    rows = [(i, "w " * (i % 7), "en", "abc"[i % 3]) for i in range(400)]
    whole = sorted(map(repr, mixing.by_source(documents(rows)).collect()))
    monkeypatch.setattr(mixing, "CUT_ROWS", 1)
    monkeypatch.setattr(mixing, "RANGE_DIGITS", 1)
    assert sorted(map(repr, mixing.by_source(documents(rows)).collect())) == whole


def test_many_patterns_are_routed_quickly():
    rng = random.Random(8)
    patterns = {tuple(sorted(rng.sample(range(60), rng.randint(1, 4)))): rng.randint(1, 10**6) for _ in range(3000)}
    quotas = {s: 10**7 * (1 + s % 3) for s in range(60)}
    flow = mixing.route(patterns, quotas)
    assert all(sum(flow[p, s] for s in p) <= 3 * t for p, t in patterns.items())
    assert all(sum(v for (_, s), v in flow.items() if s == q) <= t for q, t in quotas.items())
