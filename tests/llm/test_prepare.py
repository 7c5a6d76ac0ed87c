"""Operators 2 to 6, 9 and 10, and the pipeline."""

import gzip
import hashlib
import importlib.util
import io as bytes_io
import mmap
import pathlib
import platform
import random
import re
import struct
import wave
import zipfile
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from conftest import SF
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from predica.llm import chat_format, license_scan, media, packing, source_mix, stages, toxicity, url_rules
from predica.llm import queries as registered

# --- 2: mixing --------------------------------------------------------------------------------------------------


def shares(sizes, weights=(1, 2, 3), most=3):
    """Targets by resharing the excess again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight, total = {s: weights[i % len(weights)] for i, s in enumerate(names)}, sum(sizes.values())
    stopped = {}
    while True:
        rest, left = sum(weight[s] for s in names if s not in stopped), total - sum(stopped.values())
        target = {s: stopped.get(s, weight[s] * left / rest if rest else 0) for s in names}
        over = [s for s in names if s not in stopped and target[s] > most * sizes[s]]
        if not over:
            return target
        stopped |= {s: most * sizes[s] for s in over}


def count(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def mixed(df):
    return source_mix.mix(df).select("doc_id", "source", "size", "source_size", "target", "taken", "parts").collect()


def test_mix(make):
    rng = random.Random(1)
    rows = [(i, "w " * rng.randint(0, 400), rng.choice(["a", "b", "é", None, "big", "big", "big"])) for i in range(400)]
    rows += [(1000, "tiny text", "zz"), (1001, None, "none"), (1002, "", "none"), (1003, "x " * 30000, "big"), (5, "same", "a"), (5, "same", "a")]
    got = mixed(make(rows))
    assert len(got) == len(rows) and sorted(r.size for r in got) == sorted(count(r[1]) for r in rows)
    sizes = Counter()
    for r in rows:
        sizes[r[2]] += count(r[1])
    want, taken = shares(sizes), Counter()
    for r in got:
        taken[r.source] += r.taken
        assert abs(r.target - want[r.source]) < 1e-6 * (1 + want[r.source]) and r.source_size == sizes[r.source]
        assert 0 <= r.taken <= 3 * r.size and sum(r.parts) == r.taken and all(0 < p <= r.size for p in r.parts)
    assert all(abs(taken[s] - want[s]) <= 12 for s in want)
    again = mixed(make(rows).repartition(5))
    assert sorted(map(repr, got)) == sorted(map(repr, again))


def test_mix_of_small_sources(make, monkeypatch):
    """Sources smaller than a block, or of a few blocks, hit their targets."""
    monkeypatch.setattr(source_mix, "SLOTS", 64)
    small = {"s120": 120, "s300": 300, "s1": 1, "s1100": 1100, "s3200": 3200, "s5200": 5200}
    rows = [(i, "w " * 500, "big") for i in range(240)] + [(1000 + 100 * i + k, "w " * (n // 10 + (n % 10 if k == 0 else 0)), s) for i, (s, n) in enumerate(small.items()) for k in range(10)]
    sizes = Counter()
    for r in rows:
        sizes[r[2]] += count(r[1])
    assert sum(sizes.values()) // 64 > source_mix.BLOCK
    want, taken = shares(sizes), Counter()
    for r in mixed(make(rows)):
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 3 * r.size and sum(r.parts) == r.taken and all(0 < p <= r.size for p in r.parts)
    assert all(want[s] == 3 * n for s, n in small.items()) and all(abs(taken[s] - want[s]) <= 1 for s in want)


def test_mix_of_nothing(make):
    assert mixed(make([(1, "x")]).limit(0)) == []
    assert {(r.taken, r.target) for r in mixed(make([(1, None), (2, " ")]))} == {(0, 0.0)}


def test_schedule(spark):
    """Every stretch of the schedule has its shares, ranks have no gap, and no epoch is past the last."""
    sources = spark.createDataFrame([(1, 5000, 600.0), (2, 5000, 300.0), (3, 10, 100.0)], "sid long, source_size long, target double")
    rows = source_mix.schedule(sources, 40000, 1).orderBy("slot").collect()
    ranks = defaultdict(list)
    for r in rows:
        ranks[r.sid].append(r.rank)
    assert ranks[1] == list(range(len(ranks[1]))) and len(ranks[3]) == 30
    for low in range(0, 40000, 1000):
        part = Counter(r.sid for r in rows if low <= r.slot < low + 1000)
        assert abs(part[1] - 600) < 10 or part[1] == 0 or low > 20000


def test_mixed_documents(make):
    rows = [(i, " ".join(f"d{i}w{j}" for j in range(50)), "ab"[i % 2]) for i in range(40)] + [(90, "lone  text", "c")]
    df = make(rows)
    out, parts = source_mix.mixed_documents(df).collect(), {r.doc_id: r.parts for r in mixed(df)}
    assert sorted((r.doc_id, count(r.text)) for r in out) == sorted((i, p) for i, ps in parts.items() for p in ps)
    texts = {i: t for i, t, _ in rows}
    assert all(r.text == texts[r.doc_id] or texts[r.doc_id].startswith(r.text) or "  " in texts[r.doc_id] for r in out)


# --- 3: urls ----------------------------------------------------------------------------------------------------


def parts_of(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest, re.S)[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host) :], re.S)[0]


URLS = ["http://WWW.Example.org/es/1", "https://example.org/en/123?x=1", "https://example.org", "http://a.b.com/fr/x#y", "http://b.com/de/", "http://borg/x", "http://org/", "http://x.org?/es/", None, "", "no scheme/here", "ftp://É.com/fr/", "a://b://c.org/d", "http://example.org:80/es/", "http://xexample.org/es/1", "://.org/x\ny"]


def test_urls(spark):
    df = spark.createDataFrame([(i, u, "<html>", 5) for i, u in enumerate(URLS + URLS[:3])], "page_id long, url string, html string, confidence int")
    out = {r.page_id: r for r in url_rules.url_verdicts(df, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()}
    assert len(out) == len(URLS) + 3
    for i, url in enumerate(URLS):
        host, path = parts_of(url)
        fits = [(len(r), r, v) for r, v in url_rules.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
        _, rule, verdict = max(fits, default=(0, None, "allow"))
        assert (out[i].host, out[i].path, out[i].rule, out[i].verdict) == (host, path, rule, verdict), url


def test_mined_rules(spark):
    """A combination of tokens that is bad is found; its parts, which aren't, are left alone."""
    rng = random.Random(3)
    rows = []
    for i in range(900):
        spam, section = rng.random() < 0.3, rng.choice(["shop", "news"])
        rows.append((i, f"http://{'spam' if spam else rng.choice(['fine', 'good'])}.com/{section}/{i}", int(spam and section == "shop" and rng.random() < 0.95)))
    pages = spark.createDataFrame([r[:2] for r in rows], "page_id long, url string")
    labels = spark.createDataFrame([(i, 1 - bad, 0) for i, _, bad in rows if i % 2], "doc_id long, quality int, toxic int")
    out = {r.page_id: r.verdict for r in url_rules.url_verdicts(pages, labels, rules=()).collect()}
    assert out == {i: "block" if "spam.com/shop" in u else "allow" for i, u, _ in rows}


def test_rules_against_brute_force(spark):
    """The mined rules are those of counting every combination of tokens; urls held out are judged by them."""
    rng = random.Random(7)
    urls = [f"http://{rng.choice('abc')}.com/{rng.choice(['x', 'y'])}/{rng.choice(['p', 'q', 'r'])}" for _ in range(1200)]
    bad = [rng.random() < (0.9 if "a.com/x" in u else 0.7 if u.endswith("/r") else 0.1) for u in urls]
    df = spark.createDataFrame([(u, b) for u, b in zip(urls[:800], bad)], "url string, bad boolean").select(url_rules.tokens(F.col("url")).alias("tokens"), "bad")
    own = [(set(r.tokens), r.bad) for r in df.collect()]
    rows = {}
    for t in {x for s, _ in own for x in s}:
        rows.setdefault(frozenset(i for i, (s, _) in enumerate(own) if t in s), set()).add(t)
    rows = {k: v for k, v in rows.items() if len(k) >= 30}
    sets, level = {}, {frozenset([min(v)]): k for k, v in rows.items()}
    items, share = dict(level), sum(b for _, b in own) / len(own)
    while level:
        sets |= level
        level = {a | b: k & m for a, k in level.items() for b, m in items.items() if not b <= a and len(k & m) >= 30}
    good = lambda k: sum(own[i][1] for i in k) / len(k)
    kept = {s for s, k in sets.items() if sum(own[i][1] for i in k) >= 30 and not any(good(sets[q]) >= good(k) for n in range(1, len(s)) for q in map(frozenset, __import__("itertools").combinations(s, n)))}
    kept = {s: good(sets[s]) for s in kept if good(sets[s]) >= url_rules.MIN_CONFIDENCE and good(sets[s]) - share >= url_rules.MIN_Z * (share * (1 - share) / len(sets[s])) ** 0.5}
    mined = {frozenset(min(item) for item in r.antecedent): r.confidence for r in url_rules.mine(df).collect()}
    assert kept and set(mined) == set(kept) and all(abs(mined[s] - c) < 1e-9 for s, c in kept.items())
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(i, 1 - int(bad[i]), 0) for i in range(800)], "doc_id long, quality int, toxic int")
    blocked = {r.page_id for r in url_rules.url_verdicts(pages, labels, rules=()).where("verdict = 'block' AND page_id >= 800").collect()}
    right = sum(bad[i] for i in blocked)
    assert right > 0.9 * url_rules.MIN_CONFIDENCE * len(blocked) and right > 0.7 * sum(bad[800:])


def test_no_rules_by_chance(spark):
    """Labels that have nothing to do with the urls make no rule, at any share of bad ones."""
    rng = random.Random(8)
    pages = spark.createDataFrame([(i, f"http://{rng.choice('abcdef')}.com/{rng.choice('uvwxyz')}") for i in range(900)], "page_id long, url string")
    for part in (0.2, 0.6):
        labels = spark.createDataFrame([(i, int(rng.random() > part), 0) for i in range(900)], "doc_id long, quality int, toxic int")
        assert url_rules.url_verdicts(pages, labels, rules=()).where("verdict = 'block'").isEmpty()
    assert url_rules.url_verdicts(pages.limit(0), labels).count() == 0


def test_rules_of_any_part(spark):
    """A host label, a deep segment, a word of a slug, and a later query key or value each make a rule; a long url of
    tokens that always come together doesn't multiply the itemsets."""
    signs = ["http://x{}.casino.a.com/u/v", "http://a.com/u/v/spam/{}", "http://a.com/u/free-bonus-{}", "http://a.com/u/v?id={}&aff=1", "http://a.com/u/v?id={}&to=pills", "http://a.com/" + "/".join("abcdefghijklmnopqrst") + "/{}"]
    good = ["http://y{}.fine.a.com/u/v", "http://a.com/u/v/ham/{}", "http://a.com/u/paid-plan-{}", "http://a.com/u/v?id={}&ref=1", "http://a.com/u/v?id={}&to=shop"]
    rows = [(i, (signs + good + good)[i % 16].format(f"n{i}"), int(i % 16 < 6)) for i in range(1100)]
    pages = spark.createDataFrame([r[:2] for r in rows], "page_id long, url string")
    labels = spark.createDataFrame([(i, 1 - bad, 0) for i, _, bad in rows if i < 700], "doc_id long, quality int, toxic int")
    out = {r.page_id: r.verdict for r in url_rules.url_verdicts(pages, labels, rules=()).collect()}
    assert out == {i: "block" if bad else "allow" for i, _, bad in rows}


# --- 4: packing -------------------------------------------------------------------------------------------------


def ids_of(text, tokenizer=Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


ODD = ["", None, "plain words", "é ü ñ", "<|endoftext|> in text", "a\xa0b\u3000c", "\x1c\x1d \x85", "日本語 text", "tabs\t\t and  spaces \n\n x", "emoji 🙂‍↔️", "\0", "it's we'll 12 3.5", "ſK"]


def test_pack(make):
    rng = random.Random(2)
    rows = [(i, t) for i, t in enumerate(ODD)] + [(100 + i, "word " * rng.choice([3, 40, 511, 600, 1022, 1023, 1024, 2500])) for i in range(120)] + [(7, "again"), (7, "again")]
    got = packing.pack(make(rows), keep_ids=True).collect()
    texts = defaultdict(list)
    for i, t in rows:
        texts[i].append(ids_of(t))
    places, pieces = defaultdict(list), defaultdict(Counter)
    for r in got:
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length <= 1024
        places[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id][(r.piece, r.start, tuple(r.ids))] += 1
    for i, all_ids in texts.items():
        want = Counter()
        for ids in all_ids:
            cut = [0, *range(len(ids) % 1024 or 1024, len(ids), 1024), len(ids)]
            want.update((k, a, tuple(ids[a:b])) for k, (a, b) in enumerate(zip(cut, cut[1:])))
        assert pieces[i] == want
    for own in places.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and sum(own[-1]) <= 1024
    packed = packing.sequences(packing.pack(make(rows), keep_ids=True))
    assert packed.count() == len(places) and packed.where("size(ids) > 1024").isEmpty()
    assert packing.pack(make(rows).limit(0)).count() == 0


def fewest(lengths, capacity):
    """The least number of bins, by trying."""
    best = len(lengths)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(lengths):
            best = len(rooms)
            return
        for r in sorted(set(rooms)):
            if r >= lengths[i]:
                rest = list(rooms)
                rest.remove(r)
                place(i + 1, [*rest, r - lengths[i]])
        place(i + 1, [*rooms, capacity - lengths[i]])

    place(0, [])
    return best


def test_dominance_keeps_the_optimum():
    rng = random.Random(5)
    for _ in range(150):
        capacity = rng.randint(8, 30)
        lengths = sorted((rng.randint(1, capacity) for _ in range(rng.randint(1, 10))), reverse=True)
        counts = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
        fixed = packing.dominance(counts, capacity)
        assert all(sum(p) <= capacity for p, _ in fixed)
        left = [x for x in range(capacity, 0, -1) for _ in range(counts[x])]
        assert Counter(left) + sum((Counter({x: p.count(x) * m for x in p}) for p, m in fixed), Counter()) == Counter(lengths)
        assert sum(m for _, m in fixed) + fewest(left, capacity) == fewest(lengths, capacity)


def test_plan():
    rng = np.random.default_rng(1)
    counts = np.zeros(1025, np.int64)
    counts[1:1024] = rng.integers(0, 2000, 1023)
    runs, sequences = packing.plan(counts)
    total = int((counts * np.arange(1025)).sum())
    assert sequences <= max(total / 1024, int(counts[513:].sum())) * 1.006 + 1
    assert sum(len(r) for r in runs.values()) < 60000
    more = packing.plan(counts * 10**6)
    assert sum(len(r) for r in more[0].values()) < 60000


# --- 5: licences ------------------------------------------------------------------------------------------------


def test_licenses(make, sample):
    rows = sample[0][:150] + [(9001, "Intro line\nReleased under the MIT License.\nmore"), (9002, None), (9003, "the license plate of the car was new"), (9004, "\n\n"), (9005, ("plain words here " * 100) + "Licensed under the Apache License, Version 2.0.")]
    out = {r.doc_id: r for r in license_scan.license_digest(make(rows)).collect()}
    assert (out[9001].families, out[9001].n_paragraphs) == ("mit", 3)
    assert [out[i].families for i in (9002, 9003, 9004)] == [""] * 3 and out[9002].probability == 0
    stated = {"apache": "Licensed under the Apache License", "gpl": "GNU General Public License", "mit": "Released under the MIT License", "cc-by-nc": "CC BY-NC 4.0"}
    for i, t in sample[0][:150]:
        assert out[i].families == ",".join(sorted(f for f, s in stated.items() if s in t)), i
    found = license_scan.license_findings(make(rows)).where("doc_id = 9001").first().findings[0]
    assert rows[150][1][found.start : found.start + found.length] == "Released under the MIT License."
    assert license_scan.license_digest(make(rows).limit(0)).count() == 0


def test_altered_licenses(sample):
    """Templates with words lost, replaced and put in are still told by family; prose isn't."""
    plain = [t for _, t in sample[0][:250]]
    model, rng = license_scan.train(plain[:100]), np.random.default_rng(11)
    found = total = 0
    for family, text in license_scan.TEMPLATES:
        words = license_scan.words_of(text)
        for _ in range(6):
            own = license_scan._altered(words, ["river", "stone", "walked", "green"], rng) if len(words) > 5 else words
            total += 1
            found += family in {f["family"] for f in license_scan.scan(" ".join(own), model)}
    assert found >= 0.9 * total
    told = [f for t in plain[100:] for f in license_scan.scan(t, model) if not f["confirmed"]]
    lines = sum(t.count("\n") + 1 for t in plain[100:] if t)
    assert len(told) < 0.01 * lines
    assert not any(f["confirmed"] for f in license_scan.scan("in source and binary forms, with or without", model))
    tag = license_scan.scan("x = 1  # SPDX-License-Identifier: GPL-3.0-only, copyright by the authors of this file", model)
    assert {f["family"] for f in tag if f["confirmed"]} == {"gpl"}


def test_license_odd_rows(make):
    rows = [(None, "Released under the MIT License."), (1, None), (1, "Released under the MIT License."), (1, "Released under the MIT License."), (2, "x " * 30000 + "Licensed under CC BY 4.0 by the authors.")]
    out = sorted((-1 if r.doc_id is None else r.doc_id, r.families) for r in license_scan.license_digest(make(rows)).collect())
    assert out == [(-1, "mit"), (1, ""), (1, "mit"), (1, "mit"), (2, "cc-by")]


def test_license_templates():
    model = license_scan.train([])
    for family, text in license_scan.TEMPLATES:
        found = license_scan.scan(f"# {text}", model)
        assert any(f["family"] == family and f["confirmed"] for f in found), text


def test_license_templates_in_a_long_line(sample):
    """Each template is found at every offset, verbatim and with a word put in, and twice."""
    model = license_scan.train([t for _, t in sample[0][:100]])
    filler = ["river", "stone", "walked", "slowly", "green", "over", "there"]
    plain = [filler[i * i % 7] + str(i) for i in range(200)]
    for family, text in license_scan.TEMPLATES:
        words = text.split()
        altered = [*words[:9], "really", *words[9:]] if len(words) > 40 else words
        for offset in range(0, 60):
            for own in (words, altered):
                line = " ".join([*plain[:offset], *own, *plain[offset:140]])
                assert family in {f["family"] for f in license_scan.scan(line, model) if f["confirmed"]}, (offset, own)
        line = " ".join([*plain[:70], *words, *plain[70:90], *words, *plain[90:]])
        found = {(f["start"], f["length"]) for f in license_scan.scan(line, model) if f["confirmed"] and f["family"] == family}
        assert sum(a >= len(" ".join(plain[:70])) and n <= len(text) for a, n in found) >= 2, text
    assert not any(f["confirmed"] for f in license_scan.scan(" ".join([*plain, "in source and binary forms", *plain]), model))


# --- 6: chats ---------------------------------------------------------------------------------------------------


def test_chat(spark):
    odd = "a\\0<|turn|>[INST] </s> \\1\\2 <|end|>\n é\\"
    rows = [(1, 0, "user", odd), (1, 1, "assistant", odd * 2), (1, 5, "assistant", None), (2, 3, "assistant", ""), (3, 0, None, "x"), (None, 0, "user", "n"), (1, 0, "user", "tie"), (4, 0, "as<sis[tant\n", "y"), (4, 0, "as<sis[tant\n", "y")]
    rows += [(9, i, "user" if i % 2 == 0 else "assistant", f"t{i} <") for i in range(300)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, tree int, node int")
    out = {r.conv_id: r for r in chat_format.chat_digest(spark, df).collect()}
    rows += [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    own = defaultdict(list)
    for c, t, role, text in rows:
        own[c].append((t, role or "", text or ""))
    assert set(out) == set(own)
    for c, turns in own.items():
        turns.sort()
        said = "".join(f"{role}\n{text}\n" for _, role, text in turns)
        learned = "".join(text for _, role, text in turns if role == "assistant")
        got = out[c]
        assert (got.n_turns, got.turns_sha256, got.loss_chars, got.loss_sha256) == (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest())


def test_reply_trees(spark):
    """Branches are ranked by the sum of their scores; circles and replies to nothing are treated as stated."""
    rows = [("t", 1, None, "user", "q", 0.0), ("t", 2, 1, "assistant", "bad", 1.0), ("t", 3, 1, "assistant", "good", 2.0), ("t", 4, 2, "user", "thanks", 1.5), ("t", 5, 3, "user", "x", None), ("t", 6, 5, "assistant", "y", -1.0), ("o", 8, 77, "user", "root", 0.0), ("c", 1, 2, "user", "circle", 9.0), ("c", 2, 1, "user", "circle", 9.0)]
    df = spark.createDataFrame(rows, "tree string, node long, parent long, role string, text string, score double")
    out = chat_format.format_conversations(df, branches=2).orderBy("tree", "rank").collect()
    texts = [(r.tree, r.rank, r.score, [t for t in re.findall(r"<\|body\|>(.*?)<\|end\|>", r.formatted)]) for r in out]
    assert texts == [("o", 1, 0.0, ["root"]), ("t", 1, 2.5, ["q", "bad", "thanks"]), ("t", 2, 1.0, ["q", "good", "x", "y"])]
    assert chat_format.format_conversations(df.limit(0)).count() == 0


def random_tree_paths(rows):
    parent = {n: p for n, p in rows}
    kids = defaultdict(list)
    for n, p in rows:
        kids[p].append(n)
    for leaf in (n for n in parent if not kids[n]):
        path = [leaf]
        while parent[path[-1]] is not None:
            path.append(parent[path[-1]])
        yield leaf, path[::-1]


def test_all_branches(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice([None, *range(max(0, i - 4), i)]) if i else None) for i in range(60)]
    df = spark.createDataFrame([("t", n, p, float(n)) for n, p in rows], "tree string, node long, parent long, score double")
    got = defaultdict(list)
    for r in chat_format.best_paths(df, 1000).orderBy("place").collect():
        got[r.leaf].append(r.node)
    assert dict(got) == dict(random_tree_paths(rows))


# --- 9: toxicity ------------------------------------------------------------------------------------------------


def test_gradients():
    """Backpropagation against differences."""
    rng = np.random.default_rng(0)
    net = toxicity.Network(3, hidden=3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, y, w = rng.normal(size=(5, 4, toxicity.INPUTS)), np.array([1.0, 0, 1, 0]), np.array([1.0, 2, 1, 1])
    mask = (np.arange(5)[:, None] < np.array([5, 3, 1, 4])).astype(float)

    def loss():
        z = net.logits(x, mask).astype(float)
        return float((w * (np.log1p(np.exp(z)) - y * z)).sum() / w.sum())

    grads, d_x = net.gradients(x, mask, y, w)
    for at in ((0, 0, 1), (2, 1, 5), (4, 0, 15), (1, 3, 0)):
        x[at] += 1e-3
        up = loss()
        x[at] -= 2e-3
        down = loss()
        x[at] += 1e-3
        assert abs((up - down) / 2e-3 - d_x[at]) < 2e-3, at
    for k, p in net.p.items():
        for i in rng.choice(p.size, min(3, p.size), replace=False):
            at, step = np.unravel_index(i, p.shape), 1e-3
            p[at] += step
            up = loss()
            p[at] -= 2 * step
            down = loss()
            p[at] += step
            assert abs((up - down) / (2 * step) - grads[k][at]) < 2e-3, k


def test_windows_cover():
    for n in (0, 1, 47, 48, 49, 80, 81, 1000):
        starts = toxicity.window_starts(n)
        seen = {j for s in starts for j in range(s, min(n, s + toxicity.WINDOW))}
        assert seen == set(range(n)) and all(b - a <= toxicity.STRIDE for a, b in zip(starts, starts[1:]))


def test_toxicity(spark, make):
    """Held-out accuracy on the 0.01 table; odd texts have scores; labels of held-out rows change nothing."""
    sf = SF.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    for i, r in out.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    own = [(out[i].score, t) for i, t in truth.items() if out[i].held_out]
    pairs = [(a > b) + 0.5 * (a == b) for a, t in own if t for b, u in own if not u]
    assert np.mean(pairs) > 0.9
    changed = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert all(abs(r.score - out[r.doc_id].score) < 1e-5 for r in toxicity.toxicity(docs, changed).collect())


def test_learned_inputs():
    """Words and their characters are both learned; nothing but the recurrent states reaches the output."""
    rng = random.Random(4)
    words = [f"{a}{b}" for a in ("lorem", "ipsum", "dolor", "amet") for b in ("", "is", "um", "orum", "e")]
    make_text = lambda bad: " ".join(rng.choice(words) if not bad or rng.random() > 0.05 else rng.choice(("vile", "scummy", "scumbag")) for _ in range(90))
    labels = [i % 3 == 0 for i in range(240)]
    model = toxicity.train([make_text(b) for b in labels], [int(b) for b in labels])
    tests = [(make_text(b), b) for b in [True] * 40 + [False] * 40]
    auc = lambda m: np.mean([(x > y) + 0.5 * (x == y) for x in m.scores([t for t, b in tests if b]) for y in m.scores([t for t, b in tests if not b])])
    assert auc(model) > 0.97
    unseen = model.scores([" ".join(words + ["scummily"] * 3 + words), " ".join(words * 2)])
    assert unseen[0] > unseen[1]  # by its characters alone
    tables, model.inputs.tables = model.inputs.tables, tuple(t * 0 for t in model.inputs.tables)
    model._forget()
    assert auc(model) > 0.8  # by the embeddings alone
    model.inputs.tables, embeddings = tables, (model.inputs.words, model.inputs.grams)
    model.inputs.words, model.inputs.grams = (e * 0 for e in embeddings)
    model._forget()
    assert auc(model) > 0.8  # by the evidence alone
    model.inputs.words, model.inputs.grams = embeddings
    model._forget()
    for k in ("wf", "wb", "uf", "ub", "cf", "cb"):
        model.network.p[k] = model.network.p[k] * 0
    assert auc(model) == 0.5


def test_long_texts_have_the_same_windows(monkeypatch):
    """Blocks of a very long text change neither its windows nor their number."""
    labels = [i % 2 for i in range(60)]
    model = toxicity.train(["plain words here " * 10 + "scum " * b for b in labels], labels)
    n = 32 * 7 + 19
    text = " ".join(f"w{i % 97}" for i in range(n)) + " scum"
    whole = model.logits([text])
    monkeypatch.setattr(toxicity, "BLOCK_WINDOWS", 3)
    parts = model.logits([text])
    assert abs(whole[0] - parts[0]).max() < 1e-5 and whole[1] == parts[1] == len(toxicity.window_starts(n + 1))


def test_toxicity_of_odd_rows(spark, make):
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(40)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    rows = [(i, "nice words and more " + "scum " * (i % 2)) for i in range(40)] + [(100, None), (101, ""), (102, "... !!"), (103, "scum"), (104, "fine " * 5000 + "scum " + "fine " * 5000), (105, "fine " * 10000), (None, "x")]
    out = {r.doc_id: r.score for r in toxicity.toxicity(make(rows), labels).collect()}
    assert len(out) == len(rows) and abs(out[100] - out[101]) < 1e-5 and out[103] > 0.5 and out[104] > out[105]
    assert {r.score for r in toxicity.toxicity(make(rows), labels.limit(0)).collect()} == {0.0}
    assert toxicity.toxicity(make(rows).limit(0), labels).count() == 0


# --- 10: media --------------------------------------------------------------------------------------------------


def png():
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


def zipped():
    out = bytes_io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.txt", "hello")
    return out.getvalue()


GIF = b"GIF89a\1\0\1\0\x80\0\0\0\0\0\xff\xff\xff!\xf9\4\1\0\0\0\0,\0\0\0\0\1\0\1\0\0\2\2D\1\0;"
JPEG = b"\xff\xd8\xff\xe0\0\x10JFIF\0\1\1\0\0\1\0\1\0\0\xff\xda\0\x08\1\1\0\0\x3f\0\x12\xff\0\x34\xff\xd9"
BMP = b"BM" + struct.pack("<IIIIiiHH", 58, 0, 54, 40, 1, 1, 1, 24) + b"\0" * 24 + b"\1\2\3\0"
PDF = b"%PDF-1.4\n1 0 obj\n<<>>\nendobj\nstartxref\n9\n%%EOF"
OGG = b"OggS\0\6" + b"\0" * 20 + b"\1\4abcd"
MP4 = struct.pack(">I4s4sI", 16, b"ftyp", b"isom", 0) + struct.pack(">I4s", 8, b"moov")
SAMPLES = {"image/png": png(), "image/gif": GIF, "image/jpeg": JPEG, "audio/wav": media.to_wav(b"abc"), "image/bmp": BMP, "application/pdf": PDF, "application/zip": zipped(), "application/gzip": gzip.compress(b"x" * 99), "audio/ogg": OGG, "video/mp4": MP4}


@pytest.mark.parametrize("kind", SAMPLES)
def test_media_formats(kind):
    body = SAMPLES[kind]
    assert media.media_in(body) == [(kind, 0, len(body))]
    inside = b"noise GIF8 PK RIFF " + body + b" tail \xff\xd8"
    assert (kind, 19, 19 + len(body)) in media.media_in(inside)
    if kind not in ("application/pdf", "audio/ogg"):
        assert media.media_in(body[: len(body) // 2]) == []


def pdf(*updates):
    """A PDF with a table of cross references, and one section more for each update."""
    out = b"%PDF-1.4\n1 0 obj\n<<>>\nendobj\n"
    before = None
    for body in (b"", *updates):
        out += body
        at = len(out)
        out += b"xref\n0 1\n0000000000 65535 f \ntrailer\n<</Size 2" + (b"/Prev %d" % before if before else b"") + b">>\nstartxref\n%d\n%%%%EOF" % at
        before = at
    return out


def linearized():
    """The first section's table refers to the main one, which comes last; both ends name the first table."""
    front = b"%PDF-1.4\n1 0 obj\n<</Linearized 1>>\nendobj\n"
    first = len(front)
    table = b"xref\n0 1\n0000000000 65535 f \ntrailer\n<</Size 2%s>>\nstartxref\n%d\n%%%%EOF"
    main = first + len(table % (b"/Prev 00000", 0)) + 20
    return front + table % (b"/Prev %05d" % main, 0) + b"2 0 obj\n<<>>\nendobj\n"[:20].ljust(20) + table % (b"", first)


def tiff(order):
    """Two directories: a strip behind the first, values by reference and two tiles behind the second."""
    entry = lambda tag, kind, n, value: struct.pack(order + "HHII", tag, kind, n, value)
    head = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 8)
    one = struct.pack(order + "H", 2) + entry(273, 4, 1, 38) + entry(279, 4, 1, 10) + struct.pack(order + "I", 48)
    two = struct.pack(order + "H", 2) + entry(324, 4, 2, 78) + entry(325, 4, 2, 86) + struct.pack(order + "I", 0)
    return head + one + b"P" * 10 + two + struct.pack(order + "IIII", 94, 104, 10, 7) + b"Q" * 17


def crc(data, polynomial, bits):
    value = 0
    for x in data:
        value ^= x << bits - 8
        for _ in range(8):
            value = (value << 1 ^ (polynomial if value >> bits - 1 & 1 else 0)) & (1 << bits) - 1
    return value


def flac(total=None):
    """16-bit stereo in three frames: constant and verbatim, Rice codes of a fixed predictor, and a linear one with an escape."""
    def frame(k, bits):
        head = bytes([0xFF, 0xF8, 0x60, 0x18, k, 15])
        body = head + bytes([crc(head, 7, 8)]) + int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
        return body + struct.pack(">H", crc(body, 0x8005, 16))

    constant = "00000000" + "0" * 15 + "1"
    verbatim = "00000010" + "".join(f"{i * 4099 % 65536:016b}" for i in range(16))
    fixed = "00010100" + "0" * 32 + "00" + "0001" + "0011" + "".join("0" * (i % 5) + "1" + "101" for i in range(6)) + "0010" + "".join("1" + "01" for _ in range(8))
    linear = "01000000" + "0" * 16 + "0011" + "00000" + "0101" + "00" + "0000" + "1111" + "00110" + "101101" * 15
    frames = [frame(0, constant + verbatim), frame(1, fixed + constant), frame(2, linear + verbatim)]
    info = struct.pack(">HH", 16, 16) + b"\0" * 6 + (44100 << 44 | 1 << 41 | 15 << 36 | (48 if total is None else total)).to_bytes(8, "big") + b"\0" * 16
    return b"fLaC\x80\0\0\x22" + info + b"".join(frames)


LONGER = {"updated": ("application/pdf", pdf(b"2 0 obj\n<<>>\nendobj\n", b"3 0 obj\n<<>>\nendobj\n")), "attached": ("application/pdf", pdf(b"4 0 obj\nstream\n" + pdf(b"x") + b"\nendstream\n")), "linearized": ("application/pdf", linearized()), "tiff <": ("image/tiff", tiff("<")), "tiff >": ("image/tiff", tiff(">")), "flac": ("audio/flac", flac()), "flac of unknown length": ("audio/flac", flac(0))}


@pytest.mark.parametrize("name", LONGER)
def test_media_ends(name):
    """The whole medium and nothing behind it, where more of its kind, or another, follows."""
    kind, body = LONGER[name]
    assert media.media_in(body) == [(kind, 0, len(body))]
    value, n, after = b"noise " + body + b"\xff tail " + png() + body + body, len(body), len(png())
    places = [(kind, 6, n), ("image/png", 13 + n, after), (kind, 13 + n + after, n), (kind, 13 + 2 * n + after, n)]
    assert media.media_in(value) == [(k, a, a + size) for k, a, size in places]
    if kind != "application/pdf":
        assert name == "flac of unknown length" or all(media.media_in(body[:k]) == [] for k in range(n))


def test_sniffing(spark):
    rows = [(1, png(), "image/jpeg"), (2, b"text", "image/png"), (3, None, "image/png"), (4, b"", None), (5, b"head " + png() + GIF, "text/plain"), (6, GIF + png(), None)]
    df = spark.createDataFrame(rows, "i int, content binary, declared string")
    out = {r.i: r for r in media.sniff_media(df, "i", "content", "declared").collect()}
    assert (out[1].media_type, out[1].confirmed, out[1].corrected) == ("image/png", True, True)
    assert (out[2].media_type, out[2].confirmed) == ("image/png", False) and out[3].media_type is None and out[4].media_type == media.UNKNOWN
    assert [(e.media_type, bytes(e.content)) for e in out[5].embedded] == [("image/png", png()), ("image/gif", GIF)]
    assert out[6].length == len(GIF) and out[6].embedded[0].start == len(GIF)


def test_media_of_no_rows(spark, make):
    assert media.text_media(make([(1, "x")]).limit(0)).count() == 0
    assert media.sniff_media(spark.createDataFrame([], "i int, content binary, declared string"), "i", "content", "declared").count() == 0


def test_text_media(make):
    rows = [(1, "plain"), (2, None), (3, ""), (4, "é" * 32), (5, "%PDF-1.4 RIFF GIF89a"), (6, "x" * 3_000_000), (7, "plain")]
    out = {r.doc_id: r for r in media.text_media(make(rows)).collect()}
    for i, t in rows:
        raw = (t or "").encode()
        payload = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        r = out[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        stored = media.to_wav(payload)
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        with wave.open(bytes_io.BytesIO(stored)) as w:
            assert (w.getsampwidth(), w.getnchannels(), w.readframes(1 << 30)) == (1, 1, payload)
    assert out[1].feature == out[7].feature and out[2].feature == out[3].feature


# --- Pipeline and registry --------------------------------------------------------------------------------------


def test_stages(spark, make):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(80)), f"s{i % 3}") for i in range(60)]
    rows += [(100, rows[0][1].upper(), "s0"), (101, rows[1][1] + " extra", "s1"), (102, None, None), (5, rows[5][1], "s2")]
    docs = make(rows)
    unique = stages.without_copies(docs)
    assert unique.columns == docs.columns and sorted(r.doc_id for r in unique.select("doc_id").collect()) == sorted([*range(1, 60), 100, 101, 102])
    near = stages.without_near_copies(unique)
    assert {r.doc_id for r in near.select("doc_id").collect()} <= {*range(1, 60), 100, 101, 102} and near.columns == docs.columns
    out = stages.mixed(near)
    assert out.columns == docs.columns and out.where("n_chars != length(text)").isEmpty()
    assert stages.packed(out).select("sequence_id").distinct().count() >= 1


def test_stages_of_repeated_ids(spark, make):
    """Different texts of one id both stay, copies don't, and null ids give way to others."""
    words = " ".join(f"w{i}" for i in range(60))
    other = " ".join(f"v{i}" for i in range(60))
    rows = [(1, words), (1, other), (1, other), (2, words + " end"), (None, other + " end"), (None, "something else"), (3, None), (3, "")]
    kept = [(r.doc_id, r.text or "") for r in stages.without_near_copies(make(rows)).select("doc_id", "text").collect()]
    assert sorted(kept, key=repr) == sorted([(1, words), (1, other), (None, "something else"), (3, "")], key=repr)
    assert stages.without_near_copies(make(rows).limit(0)).count() == 0
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    rows = [(i, "nice words and more " + "scum " * (i % 2)) for i in range(40)] + [(None, "scum scum"), (50, None), (51, "fine words"), (51, "fine words")]
    left = sorted((r.doc_id, r.text) for r in stages.without_toxic(make(rows), labels).where("doc_id >= 50").select("doc_id", "text").collect())
    assert left[-2:] == [(51, "fine words")] * 2 and stages.without_toxic(make(rows), labels).where("doc_id IS NULL").isEmpty()
    assert stages.without_toxic(make(rows).limit(0), labels).count() == stages.packed(make(rows).limit(0)).count() == 0


def near_kept(rows):
    """Ids that near deduplication keeps, by brute force."""
    def grams(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets, root = {i: grams(t) for i, t in rows}, {i: i for i, _ in rows}
    for i in sorted(sets):
        for j in sorted(sets):
            if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = {k: low if r == high else r for k, r in root.items()}
    return {i for i, r in root.items() if i == r}


def test_near_copies(make):
    """Every pair of similarity 0.8 or more is linked, chains too, and no other."""
    rng = random.Random(12)
    words = [f"w{i}" for i in range(500)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([8, 60, 200])))) for i in range(40)]
    for k in range(160):
        own = rng.choice(rows)[1].split()
        for at in rng.sample(range(len(own)), min(len(own), rng.choice([1, 2, 3, 4, 6, 12]))):
            own[at] = rng.choice(words)
        rows.append((100 + k, " ".join(own)))
    rows += [(900, None), (901, " "), (902, "One two"), (903, "one TWO"), (904, "one two three")]
    kept = near_kept(rows)
    assert 40 < len(kept) < len(rows) - 40
    assert {r.doc_id for r in stages.without_near_copies(make(rows)).select("doc_id").collect()} == kept


def test_stages_against_brute_force(spark, make):
    """What each stage keeps of planted toxic texts, exact and near copies, and the mix's words and all pieces of them."""
    rng = random.Random(21)
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(100)) + " scum scum scum" * (i % 4 == 0), "ab"[i % 2]) for i in range(80)]
    rows += [(100 + i, rows[i][1].upper(), "a") for i in range(1, 12)] + [(200 + i, rows[i][1] + " extra", "b") for i in range(20, 40)]
    labels = spark.createDataFrame([(i, 1, int("scum" in t.lower())) for i, t, _ in rows], "doc_id long, quality int, toxic int")
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    clean = {i: t for i, t, _ in rows if "scum" not in t.lower()}
    found = stages.without_toxic(make(rows).select("doc_id", "text", "lang", "source", "n_chars"), labels)
    assert ids(found) == sorted(clean)
    docs = make([r for r in rows if r[0] in clean])
    last = {}
    for i, t in clean.items():
        last[t.lower()] = max(i, last.get(t.lower(), i))
    unique = sorted(last.values())
    assert ids(stages.without_copies(docs)) == unique
    docs = make([r for r in rows if r[0] in unique])
    kept = near_kept([(i, clean[i]) for i in unique])
    assert len(kept) < len(unique) and ids(stages.without_near_copies(docs)) == sorted(kept)
    final = [r for r in rows if r[0] in kept]
    sizes = Counter()
    for _, t, source in final:
        sizes[source] += count(t)
    want, taken, mixed_rows = shares(sizes), Counter(), [(r.doc_id, r.text, r.source) for r in stages.mixed(make(final)).collect()]
    for i, t, source in mixed_rows:
        taken[source] += count(t)
        assert f"{clean[i]} ".startswith(f"{t} ")
    assert all(abs(taken[s] - want[s]) <= 12 for s in want)
    tokens = Counter()
    for i, t, _ in mixed_rows:
        tokens[i] += len(ids_of(t))
    pieces = Counter()
    for r in stages.packed(make(mixed_rows)).collect():
        pieces[r.doc_id] += r.length
    assert pieces == tokens


@pytest.mark.skipif(platform.libc_ver()[0] != "glibc", reason="glibc keeps what is freed")
def test_training_gives_memory_back(spark, monkeypatch):
    """What training frees doesn't stay with the driver."""
    def resident():
        return int(pathlib.Path("/proc/self/statm").read_text().split()[1]) * mmap.PAGESIZE / 1e6

    def train(*_):
        held.append([bytes(1000) for _ in range(200_000)][-1])  # the last stays on top of 200 MB that are freed
        used.append(resident())

    held, used = [], []
    monkeypatch.setattr(toxicity, "train", train)
    df = spark.read.parquet(f"{SF}/documents.parquet")
    toxicity.trained(df, spark.read.parquet(f"{SF}/labels.parquet"))
    assert used[0] - resident() > 100 and held


@pytest.mark.skipif(platform.libc_ver()[0] != "glibc", reason="glibc keeps what is freed")
def test_stages_give_the_jvms_memory_back(spark, make, monkeypatch):
    """What the driver's JVM has freed outside its Java heap doesn't stay with it from stage to stage."""
    jvm = spark._jvm
    statm = pathlib.Path(f"/proc/{jvm.java.lang.ProcessHandle.current().pid()}/statm")

    def resident():
        return int(statm.read_text().split()[1]) * mmap.PAGESIZE / 1e6

    docs = make([(1, "some words")])
    held = [jvm.java.util.zip.Deflater() for _ in range(800)]
    for i, x in enumerate(held):  # some stay among 200 MB that are freed
        if i % 40:
            x.end()
    jvm.System.gc()
    used = resident()
    monkeypatch.setattr(stages.packing, "pack", lambda docs: docs)
    stages.packed(docs)
    assert used - resident() > 100


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="no pipeline here")
def test_pipeline(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "packing"]
    out = corpus_pipeline.run(spark, SF).collect()
    assert {"doc_id", "piece", "sequence_id", "offset", "ids_crc32"} <= set(out[0].asDict())
    used = defaultdict(int)
    for r in out:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 1024


def test_registry(spark):
    names = set(registered.queries())
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in names} == set(range(1, 11)) and set(registered.oracle_sql()) <= names


@pytest.mark.parametrize("name", sorted(registered.oracle_sql()))
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = registered.queries()[name](spark, SF).toArrow(), con.sql(registered.oracle_sql()[name]).to_arrow_table()
    columns = sorted(want.schema.names)
    rows = lambda t: sorted(([round(v, 6) if isinstance(v, float) else v for v in r] for r in zip(*(t.column(c).to_pylist() for c in columns))), key=repr)
    assert sorted(got.schema.names) == columns and rows(got) == rows(want)
