import random
from collections import Counter

import numpy as np
import pytest

from verbatlas.llm import groups, overlap, packing, terms
from verbatlas.llm.bpe import TOKENIZERS, Encoder

EXAMPLE = "example_id string, split string, source string, words array<string>"


def sentences(seed, n=160):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(40)] + ["The", "the", "of", "."]
    rows, base = [], None
    for i in range(n):
        if base is None or rng.random() < 0.3:
            base = [rng.choice(vocabulary) for _ in range(rng.randrange(1, 25))]
        words = [w for w in base if rng.random() > 0.08] + [rng.choice(vocabulary) for _ in range(rng.randrange(3))]
        rows.append((f"e{i:03d}", rng.choice(["train", "train", "development", "test", None]), rng.choice(["a", "b", None]), words or ["x"]))
    return [*rows, ("dup", "train", "a", ["A", "b"]), ("dup", "train", "a", ["A", "b"]), ("z", "test", None, ["a", "B", "b", None]), ("n", "test", "a", None), ("m", "train", "a", []), (None, "test", "a", ["a", "b"]), ("o", "other", "a", ["a", "b"])]


def brute_pairs(rows, threshold=0.75):
    sets = {(i, s): {w.lower() for w in words if w is not None} for i, s, _, words in rows if i is not None and words and s in ("train", "development", "test")}
    found = set()
    for (i, s), a in sets.items():
        for (j, t), b in sets.items():
            if s == "train" and t != "train" and i != j and a and b and 4 * len(a & b) >= 3 * len(a | b):
                found.add((min(i, j), max(i, j)))
    return found


@pytest.mark.parametrize("seed", [1, 2])
def test_overlap_against_brute_force(spark, seed):
    rows = sentences(seed)
    df = spark.createDataFrame(rows, EXAMPLE)
    found = [tuple(r) for r in overlap.overlapping_pairs(df).collect()]
    assert set(found) == brute_pairs(rows) and len(found) == len(set(found)) and ("dup", "z") in found
    report = {(r.split, r.source): r for r in overlap.overlap_report(df).collect()}
    assert sum(r.pairs for r in report.values()) == len(found)
    hit = {i for p in found for i in p} & {r[0] for r in rows if r[1] in ("development", "test")}
    assert sum(r.exact_examples + r.changed_examples for r in report.values()) == len(hit)
    assert overlap.overlapping_pairs(df.limit(0)).count() == 0


def test_banded_distance():
    rng = random.Random(4)
    for _ in range(50):
        a, b = (sorted(rng.sample(range(30), rng.randrange(1, 12))) for _ in range(2))
        d = overlap.banded_distance(np.array([a]), np.array([b]), np.array([len(a)]), np.array([len(b)]), 24)
        assert d[0] == len(set(a) ^ set(b))
        near = overlap.banded_distance(np.array([a]), np.array([b]), np.array([len(a)]), np.array([len(b)]), 3)
        assert near[0] == d[0] or (d[0] > 3 and near[0] > 3)


def test_terms_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(f"r{rng.randrange(200)}", None, None) for _ in range(300)]
    made = {i: ([rng.choice(["O"] * 8 + ["B-A", "I-A", None, ""]) for _ in range(rng.randrange(6))], rng.choice(["x.01", "x.01", "y.02", None, f"z{rng.randrange(90)}"])) for i, _, _ in rows}
    rows = [(i, *made[i]) for i, _, _ in rows] + [(None, ["O"], "q"), ("bare", None, None)]
    df = spark.createDataFrame(rows, "example_id string, tags array<string>, predicate_roleset string").selectExpr("*", "current_timestamp() as ingested_at", "1 as term")
    made["bare"] = ([], None)
    occurrences, records = Counter(), Counter()
    for tags, roleset in made.values():
        for field, values in (("tags", [t for t in tags if t is not None]), ("predicate_roleset", [roleset] if roleset else [])):
            occurrences.update((field, v) for v in values)
            records.update((field, v) for v in set(values))
    mark = lambda n: "rare" if n <= 3 else "common" if n > 0.25 * len(made) else None
    for parts in (1, 7):
        found = {(r.term_field, r.term): (r.occurrences, r.records, r.mark) for r in terms.term_frequencies(df.repartition(parts)).collect()}
        assert found == {k: (occurrences[k], records[k], mark(records[k])) for k in occurrences}
    assert terms.term_frequencies(df.limit(0)).count() == 0


def plain_components(rows):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for doc, sentence, author in rows:
        if doc is not None:
            root(("d", doc))
            for kind, value in (("s", sentence), ("a", author)):
                if value and value.strip():
                    parent[root((kind, value))] = root(("d", doc))
    docs = {d for d, _, _ in rows if d is not None}
    members = {}
    for d in docs:
        members.setdefault(root(("d", d)), []).append(d)
    return {d: min(m) for m in members.values() if len(m) > 1 for d in m}


PREPARED = "document_id string, sentence_id string, author_id string, example_id string, predicate_roleset string"


@pytest.mark.parametrize("kind", ["random", "path", "hub"])
def test_components_and_splits(spark, kind):
    rng = random.Random(6)
    if kind == "random":
        rows = [(f"d{rng.randrange(80):02d}", f"s{rng.randrange(150)}", rng.choice([None, "", " ", f"a{rng.randrange(60)}"])) for _ in range(200)]
    elif kind == "path":  # a long chain, named so that hooks follow it
        rows = [(f"d{i + k:03d}", f"s{i}", None) for i in range(60) for k in (0, 1)] + [("x", "s999", "a")]
    else:
        rows = [(f"d{i:03d}", f"s{i}", "everyone" if i % 3 == 0 else None) for i in range(90)]
    rows += [(None, "s0", "a0"), ("alone", "only", " ")]
    df = spark.createDataFrame([(*r, f"e{i}", rng.choice(["go.01", "do.01", None])) for i, r in enumerate(rows)], PREPARED)
    df = df.unionByName(df.limit(20)).selectExpr("*", "1 as node", "2 as value")
    assert {r.node: r.group for r in groups.components(df).collect()} == plain_components(rows)
    targets = spark.createDataFrame([("train", 0.8), ("development", 0.1), ("test", 0.1)], "split string, share double")
    placed = {r.document_id: r for r in groups.assign_splits(df, targets).collect()}
    assert set(placed) == {r[0] for r in rows if r[0] is not None}
    together = plain_components(rows)
    assert all(placed[d].group_id == together.get(d, d) for d in placed)
    assert len({(r.group_id, r.split) for r in placed.values()}) == len({r.group_id for r in placed.values()})


def test_empty_groups(spark):
    targets = spark.createDataFrame([("train", 1.0)], "split string, share double")
    empty = spark.createDataFrame([], PREPARED)
    assert groups.components(empty).count() == 0 and groups.assign_splits(empty, targets).count() == 0


def test_shares_are_met(spark):
    rng = random.Random(8)
    rows = [(f"d{i // 4}", f"s{i}", None, f"e{i}", rng.choice(["go.01"] * 5 + ["do.01", "be.02", "ax.03"])) for i in range(4000)]
    targets = spark.createDataFrame([("train", 0.8), ("development", 0.1), ("test", 0.1)], "split string, share double")
    df = spark.createDataFrame(rows, PREPARED)
    counts = Counter()
    split = {r.document_id: r.split for r in groups.assign_splits(df, targets).collect()}
    for d, _, _, _, label in rows:
        counts[split[d]] += 1
        counts[split[d], label] += 1
    for name, share in (("train", 0.8), ("development", 0.1), ("test", 0.1)):
        assert abs(counts[name] / 4000 - share) < 0.02
        for label in ("go.01", "do.01", "be.02", "ax.03"):
            assert abs(counts[name, label] / sum(n for k, n in counts.items() if k[1:] == (label,)) - share) < 0.06


def test_one_split_per_document(spark):
    rows = [("d", "e1", "train"), ("d", "e1", "train"), ("d", "e2", "test"), ("f", "e3", None), ("g", "e4", "test"), ("g", "e5", None), ("g", "e6", None), (None, "e7", "test")]
    found = {r.document_id: (r.split, r.examples, r.moved) for r in groups.one_split_per_document(spark.createDataFrame(rows, "document_id string, example_id string, split string")).collect()}
    assert found == {"d": ("train", 2, 1), "f": (None, 1, 1), "g": ("test", 3, 2)}


def test_a_share_is_packed_by_classes():
    rng = random.Random(7)
    for room, few in ((10, 0.9), (64, 0.95), (1000, 0.97)):
        lengths = np.array([rng.randrange(1, room + 1) for _ in range(3000)])
        for complementary in (False, True):
            container = packing.pack_share(lengths, room, complementary)
            fill, held = Counter(), {}
            for c, length in zip(container.tolist(), lengths.tolist()):
                fill[c] += length
                held.setdefault(c, []).append(room // length)
            assert set(fill) == set(range(len(fill))) and max(fill.values()) <= room
            if complementary:
                assert lengths.sum() / (len(fill) * room) > few
            else:  # every container holds one class, and its fixed count but for the last one of the class
                short = Counter(classes[0] for classes in held.values() if len(classes) != classes[0])
                assert all(len(set(classes)) == 1 for classes in held.values()) and set(short.values()) <= {1}
                assert len(fill) == sum(-(-n // j) for j, n in Counter((room // lengths).tolist()).items())
    assert len(packing.pack_share(np.zeros(0, np.int64), 10)) == 0


def test_many_shares_one_length_and_null_ids(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARE", 50)
    rows = [(None if i % 3 else 7, "same text here") for i in range(600)]
    limits = spark.createDataFrame([("a", 16), (None, 5)], "container_kind string, capacity int")
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = packing.pack(df, limits).collect()
    for kind, capacity in (("a", 16), (None, 5)):
        fill = Counter()
        for r in (r for r in found if r.container_kind == kind):
            fill[r.container_id] += r.token_end - r.token_start
        assert max(fill.values()) <= capacity and set(fill) == set(range(len(fill)))
    assert Counter(r.container_kind for r in found) == {"a": 600, None: 600}
    report = {r.container_kind: r for r in packing.fill_report(packing.pack(df, limits), limits).collect()}
    assert report[None].pieces == 600 and report["a"].containers >= report["a"].harmonic_containers


def test_packing_of_texts(spark):
    coder = Encoder(f"{TOKENIZERS}/byte_bpe_50k.json")
    rng = random.Random(1)
    texts = [None, "", " ", "a b c " * 200, *(" ".join("word" for _ in range(rng.randrange(1, 40))) for _ in range(80)), *["same text here"] * 30]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 as piece", "2 as length")
    limits = spark.createDataFrame([("small", 16), ("large", 100), ("none", None), ("zero", 0), ("huge", 100_000)], "container_kind string, capacity int")
    found = packing.pack(df, limits).collect()
    sizes = dict(enumerate(coder.counts(texts).tolist()))
    for kind, capacity in (("small", 16), ("large", 100), ("huge", 100_000)):
        rows = sorted((r for r in found if r.container_kind == kind), key=lambda r: (r.doc_id, r.piece))
        fill, at = Counter(), Counter()
        for r in rows:
            assert r.token_start == at[r.doc_id]
            at[r.doc_id] = r.token_end
            fill[r.container_id] += r.token_end - r.token_start
            assert r.piece == 0 or sizes[r.doc_id] > capacity
        assert {d: n for d, n in sizes.items() if n} == dict(at) and max(fill.values()) <= capacity
        assert set(fill) == set(range(len(fill)))
    assert {r.container_kind for r in found} == {"small", "large", "huge"}
    report = {r.container_kind: r.fill for r in packing.fill_report(packing.pack(df, limits), limits).collect()}
    assert report["small"] > 0.9
    assert packing.pack(df.limit(0), limits).count() == 0


def test_overlap_of_long_sequences(spark):
    rng = random.Random(12)
    base = [f"w{k}" for k in range(900)]
    changed = [w for w in base if rng.random() > 0.1] + [f"x{k}" for k in range(60)]
    far = base[:500] + [f"y{k}" for k in range(500)]
    rows = [("a", "test", "s", base), ("b", "train", "s", changed), ("c", "train", "s", far), ("d", "train", "s", base[::-1])]
    found = {tuple(r) for r in overlap.overlapping_pairs(spark.createDataFrame(rows, EXAMPLE)).collect()}
    assert found == brute_pairs(rows) == {("a", "b"), ("a", "d")}


@pytest.mark.parametrize("threshold", [0.6, 0.75, 0.9, 1.0])
def test_segments_are_whole_and_found(threshold):
    """Segments tile the sequence, and every near sequence offers one of them at an allowed position."""
    rng = random.Random(13)
    for n in range(1, 30):
        k, cuts = overlap.segments(n, threshold)
        assert len(cuts) == k + 1 and cuts[0][0] == 0 and all(length > 0 for _, length in cuts) and sum(length for _, length in cuts) == n
        for _ in range(60):
            a = sorted(rng.sample(range(0, 1000, 2), n))
            b = sorted([x for x in a if rng.random() > 0.15] + rng.sample(range(1, 1000, 2), rng.randrange(4)))
            if not b or len(set(a) & set(b)) / len(set(a) | set(b)) < threshold:
                continue
            sought = {(length, q, tuple(a[p : p + length])) for _, p, length, q in overlap.sought(n, threshold).tolist()}
            offered = {(length, q, tuple(b[q : q + length])) for length, q in overlap.offered(len(b), threshold).tolist()}
            assert sought & offered, (a, b)


def test_overlap_threshold_must_be_sensible(spark):
    df = spark.createDataFrame([("a", "test", "s", ["x"])], EXAMPLE)
    with pytest.raises(ValueError):
        overlap.overlapping_pairs(df, 0.3)


def test_blocks_of_splits_meet_the_shares_of_rare_labels(spark):
    """Labels with one component in each block keep their proportions over all blocks."""
    rng = random.Random(14)
    rows = [(f"d{i}", f"s{i}", None, f"e{i}", rng.choice(["go.01"] * 20 + ["rare.01"])) for i in range(3000)]
    targets = spark.createDataFrame([("train", 0.8), ("development", 0.1), ("test", 0.1)], "split string, share double")
    placed = {r.document_id: r.split for r in groups.assign_splits(spark.createDataFrame(rows, PREPARED), targets, block=40).collect()}
    for label in ("go.01", "rare.01"):
        counts = Counter(placed[d] for d, *_, of in rows if of == label)
        for name, share in (("train", 0.8), ("development", 0.1), ("test", 0.1)):
            assert abs(counts[name] / sum(counts.values()) - share) < 0.03, (label, counts)


def test_stratify_takes_the_rarest_outstanding_label_first():
    import pandas as pd

    rows = [("a", "rare", 1), ("a", "common", 5), ("b", "common", 3), ("c", "common", 3), ("d", "middle", 2), ("d", "common", 1)]
    needs = {"rare": (0.0, 1.0), "middle": (1.0, 1.0), "common": (6.0, 6.0)}
    frame = pd.DataFrame([(g, label, n, *needs[label], 8.0, 8.0) for g, label, n in rows], columns=["group", "label", "n", "need_0", "need_1", "rows_0", "rows_1"])
    placed = groups.stratify(frame, [0.5, 0.5])
    assert placed[0] == ("a", 1) and placed[1][0] == "d" and {g for g, _ in placed} == {"a", "b", "c", "d"}
