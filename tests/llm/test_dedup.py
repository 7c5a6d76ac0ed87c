"""Operators 1, 7 and 8 against brute force."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
import xxhash

from predica.llm import bwt, exact_dedup, graph, near_dedup, simhash, suffix_dedup
from predica.llm.common import bit_table, in_bit_table
from predica.llm.graph import connected_components

PASSAGE = "one passage of words that is longer than a hundred bytes and so is taken out wherever it stands again, but not the first time. "


def repeats(rows, length=100):
    """(n_bytes, n_removed, n_spans, digest) by id, from a set of all earlier windows."""
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        b = (text or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in seen:
                gone[p : p + length] = True
            seen.add(w)
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out[i] = (len(b), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    return out


def removed(df, **options):
    return {r.doc_id: tuple(r)[1:5] for r in suffix_dedup.remove_repeats(df, **options).collect()}


def test_repeats_of_the_table(sample):
    rows, df = sample
    assert removed(df) == repeats(rows)


def test_planted_repeats(make):
    rng = random.Random(1)
    noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    near = noise(900)
    rows = [(i, noise(rng.randint(0, 200)) + (PASSAGE if i % 3 == 0 else "") + noise(rng.randint(0, 99))) for i in range(40)]
    rows += [(100 + i, near[: 20 * i] + "#" + near[20 * i + 1 :]) for i in range(20)]
    rows += [(200, "a" * 700), (201, "ab" * 300), (202, "xa" * 120), (203, None), (204, ""), (205, PASSAGE[:99]), (206, "é" * 80), (207, "\0" * 150 + "é" * 60), (208, near * 3)]
    assert removed(make(rows)) == repeats(rows)


def test_long_text_in_blocks(make, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 300)
    monkeypatch.setattr(suffix_dedup, "COLLECTION", 400)
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(60))) for i in range(12)]
    rows += [(50 + i, rows[i][1][5:250] + "!") for i in range(6)]
    assert removed(make(rows)) == repeats(rows)


def test_repeated_and_null_ids(make):
    text = PASSAGE * 2
    rows = [(1, text), (1, text), (None, text + "x"), (2, "short")]
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_removed) for r in suffix_dedup.remove_repeats(make(rows)).collect())
    want = repeats([(0, text + "x"), (1, text), (2, text), (3, "short")])
    assert got == sorted([(-1, want[0][1]), (1, want[1][1]), (1, want[2][1]), (2, 0)])
    with pytest.raises(ValueError):
        suffix_dedup.remove_repeats(make(rows), length=10, gram=32)


class Everything:
    """A broadcast bit table that has every id."""

    value = np.full(1 << 10, -1, np.int64)


def in_process(rows, buckets=4):
    """(n_bytes, n_removed, n_spans, digest) by id, with the operator's maps run one after another."""
    s = suffix_dedup
    batch = pa.RecordBatch.from_pydict({"id": [i for i, _ in rows], "text": [t for _, t in rows]}, schema=pa.schema([("id", pa.int64()), ("text", pa.string())]))
    of = lambda batches, kind: [b.filter(pc.equal(b.column("kind"), kind)) for b in batches]
    owned = list(s._owner(buckets)(iter(s._scanner(100, 32, buckets)(iter([batch])))))
    texts = list(s._sender(buckets, Everything, False, False)(iter([batch])))
    fetched = list(s._fetcher(100, 32, buckets)(iter([*texts, *of(owned, s.WANTED)])))
    compared = list(s._comparer(100, 32, buckets)(iter(fetched)))
    heads = list(s._sender(buckets, Everything, True, False)(iter([batch])))
    return {r["id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for b in s._finisher(False)(iter([*heads, *of(owned, s.SPANS), *compared])) for r in b.to_pylist()}


def test_colliding_hashes(monkeypatch):
    """Segments of equal hashes and different bytes stay what they are."""
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice("abcd ") for _ in range(300)) + (PASSAGE if i % 3 == 0 else "")) for i in range(12)]
    assert in_process(rows) == repeats(rows)
    own = suffix_dedup.segments

    def colliding(*args):
        first, size, place, anchor, body = own(*args)
        return first, size, place, anchor % np.uint64(3), body * np.uint64(0)

    monkeypatch.setattr(suffix_dedup, "segments", colliding)
    monkeypatch.setattr(suffix_dedup, "PACK", 700)
    assert in_process(rows) == repeats(rows)


@pytest.mark.parametrize("passage", [PASSAGE[:40], PASSAGE[:70], PASSAGE[:97], PASSAGE, PASSAGE * 2])
def test_hot_anchor(passage, monkeypatch):
    """A passage that many rows have, with many surroundings, is cut into smaller segments; some surroundings repeat too."""
    monkeypatch.setattr(suffix_dedup, "HOT", 5)
    rng = random.Random(len(passage))
    noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    sides = [noise(60) for _ in range(6)]
    rows = [(i, rng.choice([*sides, noise(50)]) + passage + rng.choice([*sides, noise(70), ""])) for i in range(50)]
    assert in_process(rows) == repeats(rows)


def test_kept_bytes_and_spans(make):
    rows = [(1, PASSAGE + "tail"), (2, "head " + PASSAGE)]
    out = {r.doc_id: r for r in suffix_dedup.remove_repeats(make(rows), with_kept=True).collect()}
    assert bytes(out[1].kept).decode() == PASSAGE + "tail" and bytes(out[2].kept) == b"head "
    assert [tuple(s) for s in out[2].spans] == [(5, 5 + len(PASSAGE))]


@pytest.mark.parametrize("block", [1 << 20, 5])
def test_transform(block, monkeypatch):
    monkeypatch.setattr(bwt, "BLOCK", block)
    rng = np.random.default_rng(3)
    for _ in range(25):
        docs = [bytes(rng.integers(1, 4, rng.integers(0, 9)).astype(np.uint8)) for _ in range(rng.integers(1, 10))]
        lengths = np.array([len(d) for d in docs])
        transform, prefixes = bwt.collection_bwt(np.frombuffer(b"".join(docs), np.uint8), lengths)
        suffixes = sorted(((d[i:], k, i) for k, d in enumerate(docs) for i in range(len(d) + 1)), key=lambda s: [c + 1000 for c in s[0]] + [s[1]])
        assert transform.tolist() == [docs[k][i - 1] if i else 0 for _, k, i in suffixes]
        common = [0]
        for (a, *_), (b, *_) in zip(suffixes, suffixes[1:]):
            common.append(next((j for j, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))))
        assert prefixes.tolist() == common
        rows = bwt.suffix_rows(transform, lengths)
        assert all(rows[k, len(s)] == i for i, (s, k, _) in enumerate(suffixes))


def test_packed_columns():
    columns = (np.arange(5, dtype=np.uint64), np.array([3, 1, 4, 1, 5], np.uint8), np.arange(5) * -7)
    assert all((a == b).all() for a, b in zip(columns, suffix_dedup.unpack_columns(suffix_dedup.pack_columns(*columns))))
    assert len(suffix_dedup.unpack_columns(suffix_dedup.pack_columns(np.zeros(0, np.int64)))[0]) == 0


def test_golomb_code():
    rng = np.random.default_rng(0)
    for n, top in ((1, 1 << 63), (2, 5), (1000, (1 << 64) - 1), (500, 3000)):
        values = np.unique(rng.integers(0, top, n, dtype=np.uint64, endpoint=True))
        for low in (0, int(values[0])):
            k, code = exact_dedup.golomb_encode(values, low)
            assert (exact_dedup.golomb_decode(len(values), k, code, low) == values).all()
    values = np.unique(rng.integers(0, 1 << 40, 10000, dtype=np.uint64))
    assert len(exact_dedup.golomb_encode(values, 0)[1]) * 8 / len(values) < 40 - 13 + 2.5


def exact(rows):
    norm = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    return sorted((i, max(ids), len(ids), i == max(ids), hashlib.sha256(k.encode()).hexdigest()) for k, ids in groups.items() for i in ids)


def test_exact(make, sample):
    rows, df = sample
    assert sorted(map(tuple, exact_dedup.exact_groups(df).collect())) == exact(rows)
    rows = [(1, "Abc"), (5, "aBC"), (3, "abcd"), (4, None), (9, ""), (2, "É"), (6, "é"), (7, "x" * 50000), (8, "X" * 50000)] + [(100 + i, "Copy") for i in range(300)]
    assert sorted(map(tuple, exact_dedup.exact_groups(make(rows)).collect())) == exact(rows)


def test_exact_ties(make):
    rows = [(5, "a"), (5, "A"), (1, "a"), (None, "a"), (None, "b"), (None, "b")]
    got = exact_dedup.exact_groups(make(rows)).collect()
    assert [r.kept for r in got].count(True) == 2 and {r.keep_id for r in got if r.group_size == 4} == {5}
    assert sum(r.kept for r in got if r.keep_id is None) == 1


def test_bit_table(spark):
    own = np.random.default_rng(0).integers(0, 1 << 64, 1000, dtype=np.uint64)
    table = bit_table(spark.createDataFrame([(int(x),) for x in own.view(np.int64)], "h long"), "h")
    assert in_bit_table(table, own).all()
    assert in_bit_table(table, np.random.default_rng(1).integers(0, 1 << 64, 10000, dtype=np.uint64)).mean() < 0.3


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def components(rows, fps, bits=3):
    parent = {f: f for f in fps.values()}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    distinct = sorted(parent)
    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= bits:
                parent[find(a)] = find(b)
    least = {}
    for i, _ in rows:
        root = find(fps[i])
        least[root] = min(least.get(root, i), i)
    return {i: least[find(fps[i])] for i, _ in rows}


def test_simhash(make, sample):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [rng.choice(vocabulary) for _ in range(300)]
    rows = sample[0] + [(10000 + i, " ".join(base[:j] + ["changed"] + base[j + 1 :])) for i, j in enumerate(range(0, 300, 5))]
    rows += [(20000, None), (20001, ""), (20002, "  \t"), (20003, "One two"), (20004, "one TWO"), (20005, "word " * 30000)]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_digest(make(rows)).collect()}
    fps = {i: brute_fingerprint(t) for i, t in rows}
    assert {i: f for i, (f, _) in got.items()} == {i: f"{f:016x}" for i, f in fps.items()}
    assert {i: c for i, (_, c) in got.items()} == components(rows, fps)


def test_forest(monkeypatch):
    """Long lists are cut by pieces; what is connected stays the same."""
    rng = np.random.default_rng(5)
    centre = rng.integers(0, 1 << 64, 12, dtype=np.uint64)
    values = np.unique(np.concatenate([centre] + [centre ^ (np.uint64(1) << rng.integers(0, 64, 12).astype(np.uint64)) for _ in range(30)]))

    def groups(edges):
        label = {int(v): int(v) for v in values}
        changed = True
        while changed:
            changed = False
            for a, b in edges:
                m = min(label[a], label[b])
                changed |= label[a] != m or label[b] != m
                label[a] = label[b] = m
        return label

    whole = groups([(int(a), int(b)) for a in values for b in values if 0 < int(a ^ b).bit_count() <= 3])
    assert groups(simhash.forest(values)) == whole
    monkeypatch.setattr(simhash, "LIST", 4)
    assert groups(simhash.forest(values)) == whole
    assert all((a ^ b).bit_count() <= 3 for a, b in simhash.forest(values))


def test_signatures_that_span_batches(spark, monkeypatch):
    """One list of thousands of fingerprints, in many Arrow batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        fps = [(1 << 40) ^ (1 << (i % 30)) ^ (1 << (i // 30 % 31)) for i in range(900)]
        df = spark.createDataFrame([(f,) for f in set(fps)], "fp long")
        roots = {r.root for r in connected_components(simhash.links(df)).collect()}
        assert len(roots) == 1
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def wide_sets(rng, n):
    """Sets of hashes: random ones, near copies of some of them, and a crowd around one."""
    new = lambda k: rng.integers(0, 1 << 64, k, np.uint64)
    sets = [new(k) for k in rng.integers(1, 200, n)]
    crowd = new(100)
    for _ in range(n):
        own = crowd if rng.random() < 0.5 else sets[rng.integers(n)]
        sets.append(np.concatenate((own[int(rng.integers(0, 1 + len(own) // 6)) :], new(int(rng.integers(0, 1 + len(own) // 6))))))
    return {i: np.unique(x) for i, x in enumerate(sets)}


@pytest.mark.parametrize("crowd", [20, 10**9])
def test_clusters(spark, monkeypatch, crowd):
    """All pairs of a Jaccard similarity of 0.8 share a cluster of the wide SimHash's lists, and all open ones are told."""
    monkeypatch.setattr(simhash, "CROWD", crowd)
    sets = wide_sets(np.random.default_rng(8), 150)
    code, ids = [], []
    fps = {i: simhash.wide_fingerprint(x) for i, x in sets.items()}
    for i, x in sets.items():
        parts = fps[i].view(np.uint8).astype(np.int64)
        code += [(k << 48) | (int(parts[k]) << 40) | (int(parts[k ^ 1]) << 32) | len(x) for k in range(len(parts))]
        ids += [i] * len(parts)
    order = np.argsort(code, kind="stable")
    code, ids = np.array(code)[order], np.array(ids)[order]
    words = np.array([fps[i] for i in ids]).T[:3]
    label = simhash._labels(code, words.view(np.uint64))
    together = {(a, b) for m in np.unique(label) for a in ids[label == m] for b in ids[label == m] if a < b}
    schema = "id long, n long, fp array<long>, marks array<long>"
    table = spark.createDataFrame([(i, len(x), fps[i].tolist(), simhash.marks(x).tolist()) for i, x in sets.items()], schema)
    found = simhash.clusters(table.drop("marks"))
    members = {}
    for r in found.collect():
        assert r.n == len(sets[r.id])
        members.setdefault(r.cluster, []).append(r.id)
    assert {(a, b) for m in members.values() for a in m for b in m if a < b} == together
    links = {(a, b) for a in sets for b in sets if a < b and len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b]))}
    assert len(links) > 500 and links <= together
    labelled = found.join(table.drop("n"), "id").selectExpr("cluster", "id", "id % 7 AS label", "n", "fp", "marks")
    open_ = {(r.b, r.a) for r in simhash.pairs(labelled, "all").collect()}
    assert {(a, b) for a, b in links if a % 7 != b % 7} <= open_ <= together


def test_members_of_a_crowd_are_in_few_clusters(spark):
    """Lists of a crowd differ by a few members; a member isn't in a cluster for each of them."""
    rng = np.random.default_rng(3)
    base, rows = rng.integers(0, 1 << 64, 100, dtype=np.uint64), []
    for i in range(60):
        own = base.copy()
        own[rng.choice(100, 4, replace=False)] = rng.integers(0, 1 << 64, 4, dtype=np.uint64)
        rows.append((i, len(own), simhash.wide_fingerprint(own).tolist()))
    found = simhash.clusters(spark.createDataFrame(rows, "id long, n long, fp array<long>")).collect()
    assert {r.id for r in found} == set(range(60))
    assert len(found) < 20 * 60


def test_near_copies_come_through_simhash(make, monkeypatch):
    """The stage's candidates are those of the wide SimHash's lists, by no other way."""
    words = " ".join(f"w{i}" for i in range(60))
    docs = make([(1, words), (2, words + " end"), (3, words.upper()), (4, "else")])
    assert {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs).collect()} == {1: 1, 2: 1, 3: 1, 4: 4}
    found = simhash.clusters
    monkeypatch.setattr(near_dedup, "clusters", lambda wide: found(wide).limit(0))
    assert {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs).collect()} == {1: 1, 2: 2, 3: 1, 4: 4}


def test_components(spark):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, b) for b in range(101, 160)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)] + [(7, 7), (None, 3)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = {v: v for e in edges if None not in e and e[0] != e[1] for v in e}
    for _ in label:
        for a, b in edges:
            if a in label and b in label:
                label[a] = label[b] = min(label[a], label[b])
    assert got == label
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_empty_tables(make):
    empty = make([(1, "x")]).limit(0)
    assert suffix_dedup.remove_repeats(empty).count() == exact_dedup.exact_groups(empty).count() == simhash.simhash_digest(empty).count() == 0


def test_components_end_with_the_round_that_settles_them(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(graph, "checkpointed", lambda df, kept=graph.checkpointed: rounds.append(1) or kept(df))
    edges = [(i, 0) for i in range(1, 9)] + [(20, 11), (11, 20), (20, 20)]
    got = connected_components(spark.createDataFrame(edges, "a long, b long"))
    assert {(r.node, r.root) for r in got.collect()} == {(i, 0) for i in range(9)} | {(11, 11), (20, 11)}
    assert len(rounds) == 1
    rounds.clear()
    # A result's edges stand for what led to it: with one more edge between its stars, two rounds at most.
    more = connected_components(got.toDF("a", "b").union(spark.createDataFrame([(20, 5)], "a long, b long")))
    assert {(r.node, r.root) for r in more.collect()} == {(i, 0) for i in [*range(9), 11, 20]}
    assert len(rounds) <= 2


def test_near_copies_across_rounds_are_one_component(spark, make, monkeypatch):
    """Each round's links are joined with those of the rounds before, not with them alone."""
    given = {"first": [(1, 0), (3, 2), (5, 4)], "nearest": [(2, 1)], "all": [(4, 3)]}
    rows = [(i, f"text {i} of a few words of its own {i * i}") for i in range(7)]
    df = make(rows)
    bodies = {i: near_dedup._body(near_dedup.shingle_set(t.encode())) for i, t in rows}
    now = iter(given)
    monkeypatch.setattr(near_dedup, "_linked", lambda *_: spark.createDataFrame([(bodies[a], bodies[b]) for a, b in given[next(now)]], "a long, b long"))
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(df).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 5: 0, 6: 6}
