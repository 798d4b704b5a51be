"""Repeated substrings, near copies and components against brute force."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tablefit.llm import graph, simhash, substrings


def cut(texts, length):
    counts, out = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1)), []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if counts[t[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((sum(gone), runs, bytes(b for b, g in zip(t, gone) if not g)))
    return out


@pytest.mark.parametrize("group", [1024, 3])
def test_repeats(docs, rows, none, group, monkeypatch):
    if group == 3:
        monkeypatch.setattr(substrings, "CHUNK", 300)
    values = [(t or "").encode() for _, t in rows]
    want = Counter((d, len(v), *c) for (d, _), v, c in zip(rows, values, cut(values, 200)))
    got = substrings.remove_repeats(docs, group=group, carry=("source", "d")).collect()
    assert Counter((r.doc_id, r.n_bytes, sum(s["end"] - s["start"] for s in r.spans), len(r.spans), bytes(r.kept))
                   for r in got) == want
    assert {(r.row["source"], r.row["d"]) for r in got} == {("s", 2.0)}
    assert substrings.remove_repeats(none, group=group).count() == 0


def test_sort_suffixes():
    rnd = random.Random(4)
    data = np.frombuffer("".join(rnd.choice("ab") * rnd.randint(1, 30) for _ in range(400)).encode(), np.uint8)
    starts = np.arange(len(data) - 60)
    leaf = substrings.sort_suffixes(data, starts, 60)
    seen = {}
    for s, number in zip(starts, leaf):
        assert seen.setdefault(bytes(data[s:s + 60]), number) == number
    assert len(set(seen.values())) == len(seen)


def slow_print(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def union(nodes, links):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n
    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def test_near_copies(docs, rows, none):
    prints = [(d, slow_print(t)) for d, t in rows]
    found = [p for _, p in prints]
    root = union(found, [(a, b) for a in found for b in found if (a ^ b).bit_count() <= 4])
    low = {r: min((d for d, p in prints if root[p] == r and d is not None), default=None) for r in set(root.values())}
    want = Counter((d, f"{p:016x}", low[root[p]]) for d, p in prints)
    for segments, bucket in ((3, 4096), (2, 5), (4, 2)):
        got = simhash.near_duplicates(docs, segments=segments, bucket=bucket).select(
            "doc_id", simhash.as_hex().alias("f"), "component_id").collect()
        assert Counter(tuple(r) for r in got) == want
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.one_of_each(docs, simhash.near_duplicates(docs), "fp")
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(ids, key=str) == sorted(set(low.values()), key=str)


def word_shingles(text, words=5):
    found = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        found = found.replace(c, " ")
    found = [w for w in found.split(" ") if w]
    return frozenset(" ".join(found[i:i + words]) for i in range(max(1, len(found) - words + 1))) if found else frozenset()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def edited(rnd, rows):
    """Bases and copies with words changed, dropped, added or moved, from hardly to much; a large group of near copies."""
    out = []
    words = [f"w{rnd.randrange(4000)}" for _ in range(3000)]
    for base in range(60):
        text = [rnd.choice(words) for _ in range(rnd.choice([8, 30, 60, 120, 300]))]
        for _ in range(rnd.choice([2, 3, 6, 70 if base == 0 else 2])):
            copy = list(text)
            for _ in range(rnd.choice([0, 1, 1, 2, len(text) // 40, len(text) // 25])):
                at = rnd.randrange(len(copy))
                copy[at:at + rnd.choice([0, 1, 1])] = [rnd.choice(words)]
            out.append((1000 + len(out), " ".join(copy).replace("w1", "W1") if rnd.random() < 0.2 else " ".join(copy)))
    return rows + out


def test_similar_texts(spark, docs, rows, none):
    """Links are true pairs only, and at least 95 in 100 pairs of texts end in one component."""
    rows = edited(random.Random(21), rows)
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, node int, a int").repartition(3)
    sets = [word_shingles(t) for _, t in rows]
    close = [(i, j) for i in range(len(rows)) for j in range(i) if jaccard(sets[i], sets[j]) >= 0.8]
    root = union(range(len(rows)), close)
    for bucket in (4096, 8):
        got = simhash.similar(df, bucket=bucket).collect()
        component = {(r.doc_id, r.th): r.component_id for r in got}
        assert len(got) == len(rows)
        names = [component[r.doc_id, r.th] for r in df.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th")).collect()]
        order = {(r.doc_id, r.text): n for r, n in zip(df.select("doc_id", "text").collect(), names)}
        names = [order[row] for row in rows]
        assert sum(names[i] == names[j] for i, j in close) >= 0.95 * len(close)
        # A component never joins what true links don't join.
        apart = {}
        for name, r in zip(names, (root[i] for i in range(len(rows)))):
            assert apart.setdefault(name, r) == r or name == 7  # two texts have this id
    kept = simhash.one_of_each(df)
    assert kept.columns == df.columns and sorted({r.doc_id for r in kept.collect()} - {None}) == sorted(set(names) - {None})
    assert simhash.similar(none).count() == 0 and simhash.one_of_each(none).count() == 0


@pytest.mark.parametrize("segments,radius", [(4, 4), (3, 4), (3, 5), (2, 4)])
def test_links_of_close_prints(spark, segments, radius):
    rnd = random.Random(9)
    base = [rnd.getrandbits(64) for _ in range(6)]
    prints = sorted({b ^ sum(1 << k for k in rnd.sample(range(64), rnd.randint(0, 7))) for b in base for _ in range(60)})
    want = union(prints, [(a, b) for a in prints for b in prints if (a ^ b).bit_count() <= radius])
    df = spark.createDataFrame([(int(np.uint64(p).astype(np.int64)),) for p in prints], "fp long")
    edges = simhash.link_edges(df, radius, segments, bucket=16)
    roots = {r.node: r.root for r in graph.components(edges).collect()}
    got = {}
    for p in prints:
        signed = int(np.uint64(p).astype(np.int64))
        got.setdefault(roots.get(signed, signed), set()).add(p)
    parts = {}
    for p, r in want.items():
        parts.setdefault(r, set()).add(p)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, parts.values()))


def test_components(spark):
    rnd = random.Random(6)
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(200, 200)] + [
        (rnd.randrange(300, 500), rnd.randrange(300, 500)) for _ in range(120)]
    want = union({n for e in links for n in e if e[0] != e[1]}, [e for e in links if e[0] != e[1]])
    df = spark.createDataFrame(links, "a long, b long").repartition(4)
    got = graph.components(df).collect()
    assert {r.node: r.root for r in got} == want and len(got) == len(want)
    assert graph.components(df.filter(F.lit(False))).count() == 0


def test_segments_do_not_depend_on_size(spark, monkeypatch):
    """However many fingerprints are counted, the wide search cuts them alike."""
    used = []

    class Large(int):
        __le__ = __lt__ = lambda self, other: False

    def look(prints, radius, segments, *others, **options):
        used.append(segments)
        return edges(prints, radius, segments, *others, **options)

    df = spark.createDataFrame([(i, f"a b c d e f {i // 2}") for i in range(4)], "doc_id long, text string")
    edges, count = simhash.link_edges, type(df).count
    monkeypatch.setattr(simhash, "link_edges", look)
    monkeypatch.setattr(type(df), "count", lambda self: Large(count(self)))
    assert {r.doc_id: r.component_id for r in simhash.similar(df).collect()} == {0: 0, 1: 0, 2: 2, 3: 2}
    assert set(used) == {4}


def test_candidates_of_a_large_group(spark):
    """Fewer than two for each place in a bucket, and up to each distance they connect what all pairs connect."""
    rnd = random.Random(13)
    centres = [[rnd.getrandbits(64) for _ in range(3)] for _ in range(3)]
    prints = [tuple(p ^ sum(1 << k for k in rnd.sample(range(64), rnd.randint(0, 9))) for p in centres[i % 40 and 1 + i % 2])
              for i in range(240)]
    signed = [[int(np.uint64(p).astype(np.int64)) for p in three] for three in prints]
    nodes = spark.createDataFrame([(i, *three) for i, three in enumerate(signed)], "node long, fp long, fp1 long, fp2 long")
    got = {(r.a, r.b) for r in simhash.candidates(nodes, ["fp", "fp1", "fp2"], 12).collect()}

    def meet(p, q):
        return (p ^ q).bit_count() <= 12 and any((p >> s ^ q >> s & 0xFFFF) & 0xFFFF == 0 or (
            (p >> s ^ q >> s) & 0xFFFF).bit_count() == 1 for s in (0, 16, 32, 48))

    far = {(i, j): sum((p ^ q).bit_count() for p, q in zip(prints[i], prints[j])) for j in range(240) for i in range(j)}
    near = [(i, j) for i, j in far if far[i, j] <= 48 and any(meet(p, q) for p, q in zip(prints[i], prints[j]))]
    assert got <= set(near) and len(got) < len(near) / 2 and len(near) > 5_000
    for most in range(0, 49, 4):
        assert union(range(240), [e for e in got if far[e] <= most]) == union(range(240), [e for e in near if far[e] <= most])


@pytest.mark.parametrize("bucket", [4096, 8])
def test_no_similar_pair_stays_apart(spark, bucket):
    """Many pairs at the limit, texts that only their repeats make alike, a line that nearly all texts hold."""
    rnd = random.Random(5)
    words = [f"w{rnd.randrange(3000)}" for _ in range(3000)]
    line = " ".join(rnd.choice(words) for _ in range(9))
    texts = []
    for _ in range(150):
        text = [rnd.choice(words) for _ in range(rnd.randint(25, 260))]
        copy = list(text)
        # Each changed word takes five shingles; a ninth of both sets may differ.
        for at in rnd.sample(range(len(copy)), max(1, round(len(copy) / rnd.choice([40, 46, 50])))):
            copy[at] = "new" + copy[at]
        texts += [" ".join(t) + " " + (line if rnd.random() < 0.8 else rnd.choice(words)) for t in (text, copy)]
    often = f"{line} " * 200
    texts += [often + " ".join(rnd.choice(words) for _ in range(60)) for _ in range(3)]
    sets = [word_shingles(t) for t in texts]
    close = [(i, j) for i in range(len(texts)) for j in range(i) if jaccard(sets[i], sets[j]) >= 0.8]
    assert 60 < len(close) < 140
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in simhash.similar(df, bucket=bucket).collect()}
    assert got == union(range(len(texts)), close)
