import random
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

from spindrift.llm import simhash
from spindrift.llm.graph import components


def fingerprint(text, k=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words)] if len(words) < k else [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(fps, distance=2):
    """Union of all pairs within the distance, by brute force."""
    distinct = sorted(set(fps))
    root = {x: x for x in distinct}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= distance:
                root[find(b)] = find(a)
    return {x: find(x) for x in distinct}


def check(rows, got):
    own = [(i, fingerprint(t)) for i, t, *_ in rows]
    of = classes([f for _, f in own])
    least = {}
    for i, f in own:
        if i is not None:
            least[of[f]] = min(i, least.get(of[f], i))
    want = Counter((i, f"{f:016x}", least.get(of[f])) for i, f in own)
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == want


def test_documents_and_odd_rows(spark, documents, odd_rows, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    check([(r["doc_id"], r["text"]) for r in docs.collect()], simhash.near_duplicates(docs).collect())
    check(odd_rows, simhash.near_duplicates(documents(odd_rows)).collect())
    assert simhash.near_duplicates(documents([])).count() == 0


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_links_of_crowded_keys_and_chains(spark):
    rng = random.Random(10)
    fps = set()
    for _ in range(30):
        f = rng.getrandbits(64)
        for _ in range(6):  # a path of steps of two bits
            fps.add(f)
            f ^= (1 << rng.randrange(64)) | (1 << rng.randrange(64))
    middle = rng.getrandbits(64)
    for _ in range(300):  # a crowd in which many keys are shared
        x = middle
        for _ in range(rng.randint(0, 4)):
            x ^= 1 << rng.randrange(20)
        fps.add(x)
    fps |= {rng.getrandbits(64) for _ in range(200)}
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    of = classes(fps)
    for m, hot in ((5, 64), (5, 4), (3, 64), (7, 1000)):
        nodes = {r["node"] & (1 << 64) - 1: r["component"] for r in components(simhash.close_links(df, m, hot)).collect()}
        groups, want = {}, {}
        for f in fps:
            groups.setdefault(nodes.get(f, ("alone", f)), set()).add(f)
            want.setdefault(of[f], set()).add(f)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values())), (m, hot)


def test_chains_lose_no_pair():
    rng = random.Random(11)
    for distance, m in ((2, 5), (3, 7), (2, 3), (4, 9)):
        n = simhash.key_segments(distance, m)
        for _ in range(400):
            x = 0
            for b in rng.sample(range(64), rng.randint(0, distance)):
                x |= 1 << b
            held = [
                i for i in range(m)
                if all((x & simhash._mask(i, k, m) & (1 << 64) - 1).bit_count() <= k * distance // m for k in range(1, m + 1))
            ]
            assert held and all(x & simhash._mask(i, n, m) & (1 << 64) - 1 == 0 for i in held)


def test_components_of_long_paths(spark):
    links = [(i, i + 1) for i in range(0, 500)] + [(1000, 2000), (3000, 3000)]
    random.Random(12).shuffle(links)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(501)} | {1000: 1000, 2000: 1000}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingles(text, k=5):
    return set(simhash.shingle_hashes(text.encode(), k).tolist())


def test_near_copies_by_shingles(spark, documents):
    rng = random.Random(13)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(4000)]
    texts, near, at = {}, set(), 0
    for _ in range(40):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(60, 400))]
        first = at
        texts[at] = " ".join(words)
        at += 1
        for _ in range(rng.randint(0, 3)):
            copy = list(words)
            for _ in range(max(1, len(words) // 60)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            a, b = shingles(texts[first]), shingles(" ".join(copy))
            texts[at] = " ".join(copy)
            if len(a & b) >= 0.8 * len(a | b):
                near.add(at)
            at += 1
    base = [rng.choice(vocabulary) for _ in range(200)]
    texts[at] = " ".join(base)
    first = at
    for _ in range(150):  # a crowd around one text
        at += 1
        copy = list(base)
        for _ in range(3):
            copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
        texts[at] = " ".join(copy)
        a, b = shingles(texts[first]), shingles(texts[at])
        if len(a & b) >= 0.8 * len(a | b):
            near.add(at)
    clean = {i for i in texts if not any(i != j and len(shingles(texts[i]) & shingles(texts[j])) > 0.3 * len(shingles(texts[i])) for j in texts)}
    exact = [(10_000 + i, texts[i].upper().replace(" ", "\n")) for i in list(texts)[:20]]
    kept = simhash.deduplicated(documents([*texts.items(), *exact, (5, texts[5])]))
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert len(ids) == len(set(ids)) and clean <= set(ids) and not set(ids) & {i for i, _ in exact}
    assert not near & set(ids)


def test_dedup_of_odd_rows(documents, odd_rows):
    docs = documents(odd_rows)
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in kept.collect()) == [(False, i) for i in (-10, 1, 4, 5, 7, 8, 9)] + [(True, None)]
    assert simhash.deduplicated(documents([])).count() == 0


def test_budget_columns(spark):
    x = np.array([0b11, 1 << 63 | 1, 0], dtype=np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(v, i) for v in x for i in range(5)], "x long, i int")
    got = df.select("x", "i", simhash.in_budget(F.col("x"), F.col("i"), 2, 5).alias("ok")).collect()
    for r in got:
        raw = r["x"] & (1 << 64) - 1
        want = all((raw & simhash._mask(r["i"], k, 5) & (1 << 64) - 1).bit_count() <= k * 2 // 5 for k in range(3, 6))
        assert r["ok"] == want


def kept_by_brute_force(texts):
    """Smallest ids of the groups by all pairs of at least 0.8."""
    sets, root = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in texts:
        for j in texts:
            if i < j and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {find(i) for i in texts}


def test_crowded_words_lose_no_near_copy(documents):
    """Texts of the same words in other orders, with a near copy of each, and a crowd of templates that are alike in part."""
    rng = random.Random(14)
    words = [f"w{i}" for i in range(120)]
    texts = {}
    for i in range(60):
        rng.shuffle(words)
        copy = list(words)
        copy[40], copy[41] = copy[41], copy[40]
        texts[2 * i], texts[2 * i + 1] = " ".join(words), " ".join(copy)
    form = [f"form{i}" for i in range(100)]
    for i in range(80):
        at = rng.randrange(90)
        texts[1000 + i] = " ".join(form[:at] + [f"own{rng.randrange(40)}x{j}" for j in range(rng.randint(4, 26))] + form[at:])
    got = [r["doc_id"] for r in simhash.deduplicated(documents(texts.items())).select("doc_id").collect()]
    assert len(got) == len(set(got)) and set(got) == kept_by_brute_force(texts)


def test_added_and_cut_passages_are_found(documents):
    """Near copies by one contiguous addition, cut or replaced block, at 0.80 to 0.88."""
    rng = random.Random(15)
    texts = {}
    word = lambda: f"w{rng.randrange(10**9)}"
    for i in range(60):
        words = [word() for _ in range(rng.randint(300, 400))]
        part = round(len(words) * rng.uniform(0.13, 0.16))
        at = rng.randrange(len(words) - part)
        block = [word() for _ in range(part // 2)]
        copy = (words + [word() for _ in range(part)], words[:at] + words[at + part :], words[:at] + block + words[at + len(block) :])[i % 3]
        texts[2 * i], texts[2 * i + 1] = " ".join(words), " ".join(copy)
    wanted = kept_by_brute_force(texts)
    assert len(wanted) < 65  # nearly every copy is at 0.8 or more
    assert {r["doc_id"] for r in simhash.deduplicated(documents(texts.items())).select("doc_id").collect()} == wanted


def near_texts(seed):
    """Texts with copies that differ in one to eight words, and repetitive ones whose fingerprints agree but not their shingles."""
    rng = random.Random(seed)
    texts = {}
    for i in range(40):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(150, 400))]
        texts[10 * i] = " ".join(words)
        for j in range(1, 4):
            copy = list(words)
            for _ in range(rng.choice((1, 1, 2, 8))):
                copy[rng.randrange(len(copy))] = f"w{rng.randrange(10**6)}"
            texts[10 * i + j] = " ".join(copy)
    for i in range(10):
        line = " ".join(f"r{i}x{rng.randrange(10**6)}" for _ in range(9))
        texts[1000 + 2 * i] = " ".join([line] * 60)
        texts[1001 + 2 * i] = " ".join([line] * 60 + [f"end{i}x{j}" for j in range(8)])
    return texts


def test_near_copies_are_found_by_fingerprints_first(spark, documents, monkeypatch):
    """Without the prefixes, near copies within 2 bits go all the same, and only they; prefixes don't have them checked again."""
    texts = near_texts(16)
    fps, sets = {i: fingerprint(t) for i, t in texts.items()}, {i: shingles(t) for i, t in texts.items()}
    alike = lambda i, j: 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])
    close = [(i, j) for i in texts for j in texts if i < j and (fps[i] ^ fps[j]).bit_count() <= 2]
    assert sum(not alike(i, j) for i, j in close) >= 5  # exact shingles turn these away
    root = {i: i for i in texts}
    for i, j in close:  # chains of links, smallest first
        if alike(i, j):
            low = min(root[i], root[j])
            root = {x: low if r in (root[i], root[j]) else r for x, r in root.items()}
    by_prints, every = set(root.values()), kept_by_brute_force(texts)
    assert every < by_prints < set(texts) and len(texts) - len(by_prints) >= 20
    docs = documents(texts.items())
    checked, plain = [], simhash.alike
    with monkeypatch.context() as m:
        m.setattr(simhash, "alike", lambda pairs, *rest: checked.append({(r["a"], r["b"]) for r in pairs.collect()}) or plain(pairs, *rest))
        assert {r["doc_id"] for r in simhash.deduplicated(docs).select("doc_id").collect()} == every
    node = {r["number"]: r["node"] for r in docs.select(*simhash.row_keys()).collect()}
    linked = {tuple(sorted((node[i], node[j]))) for i, j in close if alike(i, j)}
    assert checked[0] & linked and not any(later & checked[0] for later in checked[1:])
    none = lambda *_: simhash.staged(spark.createDataFrame([], "a long, b long"), "none")
    with monkeypatch.context() as m:
        m.setattr(simhash, "first_pairs", none)
        m.setattr(simhash, "later_pairs", none)
        assert {r["doc_id"] for r in simhash.deduplicated(docs).select("doc_id").collect()} == by_prints


def test_links_name_nodes_and_phases_end_with_collected_garbage(spark, documents, monkeypatch):
    """Links come with the nodes of their fingerprints, crowded keys or not, and the driver's heap is collected between the phases of near-dedup."""
    rng = random.Random(18)
    middle = rng.getrandbits(64)
    fps = sorted({middle ^ (1 << rng.randrange(12)) ^ (1 << rng.randrange(12)) for _ in range(120)} | {rng.getrandbits(64) for _ in range(40)})
    node = {f: 1000 - i for i, f in enumerate(fps)}
    df = spark.createDataFrame([(signed(f), n) for f, n in node.items()], "fp long, first long")
    of = classes(fps)
    for hot in (4, 64):
        got = {r["node"]: r["component"] for r in components(simhash.close_links(df, hot=hot, node="first")).collect()}
        assert {n: got.get(n, n) for n in node.values()} == {node[f]: min(node[g] for g in fps if of[g] == of[f]) for f in fps}
    collected = []
    monkeypatch.setattr(simhash, "collect_garbage", collected.append)
    assert simhash.deduplicated(documents([(i, f"a few words of text {i // 2}") for i in range(6)])).count() == 3 and len(collected) >= 5


def test_pairs_by_fingerprints(spark):
    """Pairs are within 2 bits, and link what all pairs within 2 bits link; equal fingerprints have one that stands for them."""
    rng = random.Random(17)
    fps = [0, 0, *[rng.getrandbits(64) for _ in range(60)]]
    fps += [f ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for f in fps[:40]] + fps[:20]
    middle = rng.getrandbits(64)
    fps += [middle ^ (1 << rng.randrange(8)) for _ in range(150)]  # a crowd, many of them equal
    reps = spark.createDataFrame([(i, signed(f)) for i, f in enumerate(fps)], "node long, fp long")
    pairs = [(r["a"], r["b"]) for r in simhash.print_pairs(reps).collect()]
    assert len(pairs) == len(set(pairs)) and all(a < b and (fps[a] ^ fps[b]).bit_count() <= 2 for a, b in pairs)
    of, root = classes(fps), list(range(len(fps)))
    for a, b in pairs:
        low = min(root[a], root[b])
        root = [low if r in (root[a], root[b]) else r for r in root]
    assert root == [min(j for j, g in enumerate(fps) if of[g] == of[f]) for f in fps]
