"""Decontamination, near-duplicates and both substring operators against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from velum.llm import near_dedup, repeated_windows, suffix_dedup
from velum.llm.arrays import Words, within
from velum.llm.decontaminate import (
    Template, contamination, drop_contaminated, mark_contaminated,
)
from velum.llm.near_dedup import (
    Rarity, Shingles, consistent_samples, keep_one, near_duplicates, shingle_sketch,
)
from velum.llm.repeated_windows import COVER, PERIOD, dedup_windows
from velum.llm.suffix_dedup import dedup_substrings
from velum.llm.suffixes import Parts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_words():
    texts = ["a  bc\n", "", None, "\tx y z", " "]
    found = Words(pa.array(texts))
    got = [found.data[a:b].tobytes().decode() for a, b in zip(found.start, found.end)]
    assert got == ["a", "bc", "x y", "z"] and found.counts.tolist() == [2, 0, 0, 2, 0]
    again = Words(pa.array(["bc z", "a"]))
    assert again.hash.tolist() == [found.hash[1], found.hash[3], found.hash[0]]
    assert within(np.array([0, 3, 3, 5]), 2).tolist() == [0, 1, 3]


# Decontamination

ITEM = "A farmer named Anna sells 12 apples for 3 euros at the old market while Bruno keeps 7 more, so how many apples does Anna have left today?"


def contaminated(spark, texts, items=(ITEM,)):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {r.doc_id: r for r in mark_contaminated(docs, bench).collect()}


def test_templates():
    t = Template(pa.array(["Anna ran 5.5 km, then É x 7km 3 in.", "in 3"]))
    assert t.slot.tolist() == [True, False, True, True, False, True, False, True, True, True, False, True]


def test_reparameterised_items(spark):
    renamed = ITEM.replace("Anna", "Dora").replace("Bruno", "Emil").replace("12", "950").replace("3", "8")
    mixed_up = ITEM.replace("Anna", "Dora", 1).replace("A farmer", "The farmer")
    texts = [
        f"Before it some words. {ITEM} And after.",
        f"before it {renamed} and after",
        mixed_up.replace("Bruno", "Carl").replace("12", "5").replace("3 euros", "4 dollars").replace("7", "1"),
        "A farmer named Anna sells pears. Nothing else is the same in this document of some length.",
        "", None, ITEM.upper(), ITEM,
    ]
    got = contaminated(spark, texts)
    assert [i for i, r in got.items() if r.contaminated] == [0, 1, 6, 7]
    assert [got[i].exact for i in (0, 1, 6, 7)] == [True, False, True, True]


def test_copies_in_another_case(spark):
    title = "The Old Man Of The Sea Told Élan Vital To Nine Tall Sailors Near Rome"
    texts = [f"see {t} there" for t in (ITEM.upper(), ITEM.lower(), title.upper(), title.lower(), title.title())]
    got = contaminated(spark, [*texts, "see The Old Man there"], [ITEM, title])
    assert [got[i].contaminated and got[i].exact for i in range(6)] == [True] * 5 + [False]
    assert [got[i].item_id for i in range(5)] == [0, 0, 1, 1, 1]


def test_short_items_with_other_values(spark):
    short = "How many apples does Anna have after Anna buys 12?"
    # The only window of twelve tokens with enough literal ones is the first.
    long = "in the town of Ulm Rhein Anna saw Bruno 1 Carl Dora Emil Franz 2 3 4"
    texts = [
        "So: How many apples does Dora have after Dora buys 950? Tell me.",
        "So: How many apples does Dora have after Emil buys 950? Tell me.",
        "So: How many apples does Dora eat after Dora buys 950? Tell me.",
        "Then in the town of Rom Tiber Bea saw Cleo 7 Xaver Yann",
        "What is 18 + 26?", "Why is 17 + 25?", "what IS 17 + 25",
    ]
    got = contaminated(spark, texts, [short, long, "What is 17 + 25?"])
    assert [got[i].contaminated for i in range(7)] == [True, False, False, True, False, False, True]
    assert [got[i].exact for i in (0, 3, 6)] == [False, False, True]


def test_copies_poor_in_literals(spark):
    items = [
        "What is 17 + 25 * 3 - 48 / 6?", "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16",
        "Anna Bruno Carl Dora Emil Franz Gustav Hanna Ida Jan Karl Lena Max Nora",
    ]
    texts = [f"before it {t} and after" for t in items] + ["What is 17 + 25 * 3 - 48 / 7?", "Anna Bruno Carl Dora"]
    got = contaminated(spark, texts, items)
    assert [got[i].item_id for i in range(5)] == [0, 1, 2, None, None]
    assert all(got[i].exact for i in range(3))


def test_short_and_empty_items(spark):
    got = contaminated(spark, ["so it is short and sweet indeed", "so it is"], ["short and sweet", "", None, "12 Anna"])
    assert got[0].contaminated and not got[1].contaminated
    assert not any(r.contaminated for r in contaminated(spark, ["any text"], []).values())


@pytest.mark.parametrize("kind, ids", [("long", [4, 4, None]), ("string", ["m-1", "m-0", None])])
def test_items_with_any_identifier(spark, kind, ids):
    """Items without an identifier count too, and names the operator uses itself do not clash."""
    texts = ["short and sweet", "long and sour words", "neither of the two"]
    bench = spark.createDataFrame(
        [(i, t, "x", 1, "y") for i, t in zip(ids, texts)] * 2,
        f"item_id {kind}, text string, item string, row int, alone string",
    )
    found = [f"it is {t} indeed" for t in (*texts, "nothing")] + [" or ".join(texts)]
    docs = spark.createDataFrame(list(enumerate(found)), "doc_id long, text string")
    got = {r.doc_id: r for r in mark_contaminated(docs, bench).collect()}
    assert [got[i].contaminated for i in range(5)] == [True, True, True, False, True]
    assert [got[i].n_items for i in range(5)] == [1, 1, 1, 0, 3]
    assert [got[i].item_id for i in range(5)] == [*ids, None, min(ids[:2])]
    assert drop_contaminated(docs, bench).select("doc_id").collect() == [(3,)]


def test_documents_with_the_same_windows_meet_items_once(spark):
    """A phrase that many items and documents share makes no row for each two of them."""
    phrase = "in the old town by the river there is a market on every first day"
    items = [f"{phrase} {'abcdefghijklmnopqrst'[k] * 3} ends here" for k in range(20)]
    texts = [f"{'wxyz'[k % 4] * 2} {k} so {phrase} it goes" for k in range(200)]
    texts += [f"so {items[3]} and {phrase} again", "nothing of it", items[5], items[5]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    held, members = contamination(docs, bench)
    assert members.count() == 203 and members.select("first").distinct().count() == 3
    assert held.count() == 3 * 20
    got = {r.doc_id: r for r in mark_contaminated(docs, bench).collect()}
    assert {(r.n_items, r.item_id, r.n_windows, r.exact) for i, r in got.items() if i < 200} == {(20, 0, 4, True)}
    assert [got[i].contaminated for i in (200, 201, 202)] == [True, False, True]
    assert got[202].n_windows == got[203].n_windows > 4


def test_contaminated_rows(spark, docs, rows, no_docs):
    passage = next(t for i, t, *_ in rows if i == 2)
    bench = spark.createDataFrame([(1, passage, 5), (None, "x", 6)], "item_id long, text string, doc_id long")
    got = mark_contaminated(docs, bench).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, *_ in rows)
    want = {i for i, *_ in rows if i is not None and i % 6 == 2 and i < 120}
    assert {r.doc_id for r in got if r.contaminated} == want
    clean = drop_contaminated(docs, bench)
    assert clean.columns == docs.columns
    assert Counter(r.doc_id for r in clean.collect()) == Counter(i for i, *_ in rows if i not in want)
    assert mark_contaminated(no_docs, bench).count() == 0


def test_decontamination_finds_all_shared_windows(spark):
    sf = "/root/testdata/sf0.01"
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    grams = lambda t: {tuple(w[k : k + 13]) for w in [t.split()] for k in range(len(w) - 12)}
    known = set().union(*[grams(r.text) for r in bench.collect()])
    want = {r.doc_id for r in docs.collect() if grams(r.text or "") & known}
    assert {r.doc_id for r in mark_contaminated(docs, bench).collect() if r.contaminated} == want


# Near-duplicates


def weighted(text, weigh):
    found = Shingles(pa.array([text or ""]))
    return dict(zip(found.h.tolist(), (found.n * weigh(found.h)).tolist()))


def similarity(a, b):
    both = sum(min(w, b[h]) for h, w in a.items() if h in b)
    return both / (sum(a.values()) + sum(b.values()) - both) if both else 0.0


def brute_classes(rows, sketch, threshold=0.8):
    weigh = Rarity(*sketch)
    texts = sorted({t or "" for _, t in rows})
    sets = [weighted(t, weigh) for t in texts]
    root = list(range(len(texts)))
    holders = defaultdict(list)
    for k, s in enumerate(sets):
        for h in s:
            holders[h].append(k)
    pairs = {(a, b) for ks in holders.values() for a in ks for b in ks if a < b}
    for a, b in pairs:
        if similarity(sets[a], sets[b]) >= threshold:
            ra, rb = root[a], root[b]
            root = [ra if r == rb else r for r in root]
    at = {t: root[k] for k, t in enumerate(texts)}
    return [at[t or ""] for _, t in rows]


def same_partition(a, b):
    pairs = set(zip(a, b))
    return len(pairs) == len(set(a)) == len(set(b))


def test_samples_agree_as_often_as_texts_are_similar():
    """Over independent pairs, also of one text under two weightings."""
    rnd = random.Random(1)
    for edited in (10, 40, None):
        agree = total = 0
        for k in range(150):
            one = [f"w{rnd.randrange(10**7)}" for _ in range(120)]
            two = one[: -edited] + [f"v{rnd.randrange(10**7)}" for _ in range(edited)] if edited else one
            found = Shingles(pa.array([" ".join(one), " ".join(two)]))
            weight = np.exp(np.random.default_rng(k).normal(size=len(found.h)))
            if edited:
                weight = 1 + (found.h % np.uint64(3)).astype(float)
            codes = consistent_samples(found, weight)
            a, b = (dict(zip(found.h[found.owner == t].tolist(), weight[found.owner == t])) for t in (0, 1))
            agree += (codes[0] == codes[1]).mean()
            total += similarity(a, b)
        assert abs(agree - total) / 150 < 0.03


def test_near_duplicates(docs, rows):
    got = near_duplicates(docs).collect()
    pairs = [(r.doc_id, r.mark) for r in got]
    assert Counter(i for i, _ in pairs) == Counter(i for i, *_ in rows)
    text_rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = brute_classes(text_rows, shingle_sketch(docs.select("text")))
    by_text = dict(zip([t or "" for _, t in text_rows], want))
    # Marks stand for texts, so classes can be compared text by text.
    size = Counter(want)
    assert Counter(r.group_size for r in got) == Counter(size[c] for c in want)
    least = {}
    for (i, _), c in zip(text_rows, want):
        if i is not None:
            least[c] = min(least.get(c, i), i)
    assert Counter((r.doc_id, r.class_id) for r in got) == Counter(
        (i, least.get(by_text[t or ""])) for i, t in text_rows
    )


def test_near_duplicates_of_a_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r.class_id for r in near_duplicates(docs).collect()}
    text_rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute_classes(text_rows, shingle_sketch(docs.select("text")))
    assert same_partition([got[i] for i, _ in text_rows], want)


def test_chains_of_near_copies(spark):
    """Neighbours are similar, the ends are not: one class all the same."""
    rnd = random.Random(4)
    text, rows = [f"t{rnd.randrange(10**6)}" for _ in range(200)], []
    for k in range(40):
        text = text[:]
        text[5 * k : 5 * k + 2] = [f"n{k}", f"m{k}"]
        rows.append((k, " ".join(text)))
    rows += [(100 + k, " ".join(f"z{k}-{j}" for j in range(50))) for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in near_duplicates(docs).collect()}
    assert {got[k].class_id for k in range(40)} == {0} and got[3].group_size == 40
    assert all(got[100 + k].class_id == 100 + k for k in range(20))


def test_large_clusters_lose_no_link(spark, monkeypatch):
    """Pairs in a cluster that a passage holds together, similar only to each other, many
    with fewer equal samples than ``AGREE``."""
    rnd = random.Random(6)
    new = lambda n: [f"w{rnd.randrange(10**8)}" for _ in range(n)]
    passage, texts = new(240), []
    for _ in range(80):
        own = new(40)
        texts += [passage + own + new(40) for _ in range(2)]
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    found = []
    for large in (1 << 16, 8):
        monkeypatch.setattr(near_dedup, "LARGE", large)
        got = {r.doc_id: r.class_id for r in near_duplicates(docs, threshold=0.6).collect()}
        found.append([got[k] for k in range(len(texts))])
    assert same_partition(*found)
    assert set(Counter(found[1]).values()) <= {1, 2} and len(set(found[1])) <= 84


def test_keep_one(docs, rows, no_docs):
    classes = near_duplicates(docs).collect()
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    got = kept.select("doc_id", "text").collect()
    # One row for each class, that with its least identifier.
    n = len({(r.class_id, r.mark if r.class_id is None else 0) for r in classes})
    named = {r.class_id for r in classes if r.class_id is not None}
    assert Counter(r.doc_id for r in got if r.doc_id is not None).keys() == named
    assert len(got) >= n
    assert near_duplicates(no_docs).count() == 0 and keep_one(no_docs).count() == 0


# Repeated windows of words


def brute_windows(rows, size=13):
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    first = {}
    for i, w in words:
        i = float("inf") if i is None else i
        for k in range(len(w) - size + 1):
            g = tuple(w[k : k + size])
            first[g] = min(first.get(g, i), i)
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            if first[tuple(w[k : k + size])] < (float("inf") if i is None else i):
                gone[k : k + size] = [True] * size
        left = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(left.encode()).hexdigest()))
    return Counter(out)


def test_cover_meets_all_differences():
    assert {(a - b) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD))


@pytest.mark.parametrize("block", [2_000, 10**9])
def test_repeated_windows(docs, rows, no_docs, monkeypatch, block):
    monkeypatch.setattr(repeated_windows, "BLOCK_BYTES", block)
    monkeypatch.setattr(repeated_windows, "BUCKET_BYTES", 3 * block)
    assert Counter(map(tuple, dedup_windows(docs).collect())) == brute_windows([r[:2] for r in rows])
    assert dedup_windows(no_docs).count() == 0


def test_bad_window(docs):
    with pytest.raises(ValueError):
        dedup_windows(docs, window=PERIOD)


# Repeated strings of bytes


def brute_strings(rows, size=400):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[k : k + size] for _, b in texts for k in range(len(b) - size + 1))
    out = []
    for i, b in texts:
        gone = bytearray(len(b))
        for k in range(len(b) - size + 1):
            if seen[b[k : k + size]] > 1:
                gone[k : k + size] = b"\1" * size
        spans = sum(g and (k + 1 == len(gone) or not gone[k + 1]) for k, g in enumerate(gone))
        left = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return Counter(out)


def test_suffixes_in_order():
    rnd = random.Random(3)
    for _ in range(150):
        depth = rnd.choice([8, 12, 16])
        letters = rnd.choice([b"ab", b"abc\0", bytes(range(256)), b"a", b"\0\xff"])
        base = bytes(rnd.choice(letters) for _ in range(60))
        parts = []
        for _ in range(rnd.randint(1, 8)):
            own = [bytes(rnd.choice(letters) for _ in range(rnd.randint(0, 20))) for _ in range(3)]
            parts.append(own[0] + base[rnd.randint(0, 40) :][: rnd.randint(1, 30)] + own[1] + own[2])
        found = Parts(parts, depth)
        order = found.order()
        places = [a + k for a, n in zip(found.at, found.starts) for k in range(n)]
        assert sorted(order) == sorted(places)
        strings = [found.data[k : k + depth].tobytes() for k in order]
        assert strings == sorted(strings)
        classes = found.classes(order)
        assert [x == y for x, y in zip(classes, classes[1:])] == [x == y for x, y in zip(strings, strings[1:])]


@pytest.mark.parametrize(("block", "most"), [(2_000, 16 << 20), (10**9, 3_000)])
def test_repeated_strings(docs, rows, no_docs, monkeypatch, block, most):
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", block)
    monkeypatch.setattr(suffix_dedup, "MOST_BYTES", most)
    assert Counter(map(tuple, dedup_substrings(docs).collect())) == brute_strings([r[:2] for r in rows])
    assert dedup_substrings(no_docs).count() == 0
