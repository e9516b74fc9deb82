from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.conftest import CLASHING
from turnloom.llm.overlaps import Block, Filter, ShardIndex, common_words, overlap_classes, overlap_report, overlapping_records, suffix_array, token_hashes

WORDS = [f"w{i}" for i in range(400)]


def brute_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = row[:]
        for j, y in enumerate(b, 1):
            row[j] = before[j - 1] + 1 if x == y else max(before[j], row[j - 1])
    return row[-1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=40), st.lists(st.integers(0, 4), max_size=40))
def test_common_words(a, b):
    assert common_words(a, b) == brute_lcs(a, b)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), min_size=1, max_size=12), min_size=1, max_size=6))
def test_suffix_array_and_backward_search(rows):
    words = np.array([w for r in rows for w in [*r, 0]], dtype=np.int32)
    order = suffix_array(words, 14)
    plain = sorted(range(len(words)), key=lambda i: words[i:].tolist())
    assert [words[i : i + 14].tolist()[: words[i:].tolist().index(0) + 1] for i in order] == [words[i : i + 14].tolist()[: words[i:].tolist().index(0) + 1] for i in plain]
    index = ShardIndex.load(ShardIndex.build([str(i) for i in range(len(rows))], [" ".join(map(str, r)) for r in rows]).dump())
    text = index.words.tolist()
    for pattern in ([1], [1, 2], [2, 1, 1], [3, 3]):
        ids = [index.ids.get(str(p), -1) for p in pattern]
        lo, hi = np.array([0]), np.array([index.n])
        for p in reversed(ids):
            lo, hi = index.step(np.array([p]), lo, hi) if p > 0 else (lo, lo)
        want = [i for i in range(len(text)) if text[i : i + len(ids)] == ids]
        assert sorted(index.order[lo[0] : hi[0]].tolist()) == want


def conversation(rng, n):
    return [WORDS[i] for i in rng.integers(0, len(WORDS), n)]


def noisy(rng, words, share):
    out = []
    for w in words:
        u = rng.random()
        if u < share / 3:
            continue
        out.append(WORDS[rng.integers(0, len(WORDS))] if u < share * 2 / 3 else w)
        if u > 1 - share / 3:
            out.append("um")
    return out


def as_turns(words, upper=False):
    text = " , ".join(words)
    half = len(text) // 2
    cut = text.index(" ", half) if " " in text[half:] else len(text)
    return [{"system": "none", "user": text[:cut].upper() if upper else text[:cut]}, {"system": text[cut:], "user": None}]


def test_pairs_match_brute_force(spark, dialogues):
    rng = np.random.default_rng(5)
    said = [conversation(rng, int(rng.integers(5, 120))) for _ in range(40)]
    rows = []
    for i in range(160):
        base = said[int(rng.integers(0, 40))] if i % 4 else conversation(rng, 60)
        rows.append((i, ["train", "train", "dev", "test", None][i % 5], base if i % 3 == 0 else noisy(rng, base, 0.12)))
    popular = conversation(rng, 80)
    rows += [(200 + i, "train" if i % 3 else "test", noisy(rng, popular, 0.1)) for i in range(90)]
    rows += [(400 + i, "train" if i % 2 else "dev", popular) for i in range(60)]
    table = [(r, {"split": s, "source": "a", "turns": as_turns(w, r % 7 == 0)}) for r, s, w in rows] + [(900, {"split": "dev", "turns": None}), (901, {"split": "train", "turns": []}), (902, {"split": "test", "turns": [{"system": "None", "user": ""}]}), (903, {"split": "train", "turns": [{"system": "none", "user": " "}, None]})]
    df = dialogues(table, CLASHING)
    got = {(r["train_rec"], r["eval_rec"]) for r in overlapping_records(df).collect()}
    want = set()
    for r, s, w in rows:
        for q, p, v in rows:
            if s == "train" and p in ("dev", "test") and brute_lcs(w, v) >= 0.75 * max(len(w), len(v)):
                want.add((r, q))
    assert got == want and len(want) > 500
    report = {(r["split"], r["source"]): r for r in overlap_report(df).collect()}
    assert report["dev", "a"]["n_overlapping"] == len({q for _, q in want if dict((a, b) for a, b, _ in rows)[q] == "dev"})
    assert sum(r["n_pairs"] for r in report.values()) == len(want)


def test_large_group_of_near_copies(spark, dialogues):
    rng = np.random.default_rng(11)
    base = conversation(rng, 120)
    copies = [[w if rng.random() > part else WORDS[rng.integers(0, len(WORDS))] for w in base] for part in rng.choice([0.03, 0.06, 0.1, 0.14], 2000)]
    training, evaluated = copies[:40], copies[40:]
    got = {(r["train_rec"], r["eval_rec"]): r["common"] for r in overlapping_records(dialogues([(i, {"split": "train" if i < 40 else "test", "source": "a", "turns": as_turns(w)}) for i, w in enumerate(copies)])).collect()}
    ids = {w: i for i, w in enumerate(WORDS)}
    want = {}
    for i, a in enumerate(training):
        for j, b in enumerate(evaluated, 40):
            common = common_words([ids[w] for w in a], [ids[w] for w in b])
            if common >= 0.75 * 120:
                want[i, j] = common
    assert got == want and 20_000 < len(want) < 40 * len(evaluated)


def test_empty_tables(spark, dialogues):
    df = dialogues([(1, {"split": "train", "turns": [{"user": "only training here today"}]})])
    assert overlapping_records(df).collect() == [] and overlapping_records(df.limit(0)).collect() == []
    assert overlap_report(df.limit(0)).collect() == []


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), min_size=1, max_size=12), min_size=1, max_size=6), st.lists(st.lists(st.integers(1, 4), min_size=1, max_size=15), min_size=1, max_size=4))
def test_maximal_matches(rows, texts):
    index = ShardIndex.build([str(i) for i in range(len(rows))], [" ".join(map(str, r)) for r in rows])
    sizes = np.array([len(t) for t in texts])
    words = np.array([index.ids.get(str(w), -1) for t in texts for w in t], dtype=np.int32)
    stored = index.words.tolist()
    count = lambda p: sum(stored[i : i + len(p)] == p for i in range(len(stored)))
    first = np.cumsum(sizes) - sizes
    want = []
    for s in range(len(texts)):
        own, end = words[first[s] : first[s] + sizes[s]].tolist(), int(sizes[s])
        while end > 0:
            begin = end
            while begin > 0 and own[begin - 1] > 0 and count(own[begin - 1 : end]):
                begin -= 1
            if begin < end:
                want.append((s, end - begin, count(own[begin:end])))
            end = begin if begin < end else end - 1
    text, length, lo, hi = index.maximal(words, sizes)
    assert sorted(zip(text.tolist(), length.tolist(), (hi - lo).tolist())) == sorted(want)


def test_matches_lead_to_edited_copies():
    rng = np.random.default_rng(17)
    texts = [conversation(rng, 100) for _ in range(60)]
    index = ShardIndex.build([str(i) for i in range(60)], [" ".join(t) for t in texts])
    asked = [t[:30] + ["new", "words"] + t[30:70] + t[75:] for t in texts] + [conversation(rng, 100) for _ in range(20)]
    words = np.array([index.ids.get(w, -1) for t in asked for w in t], dtype=np.int32)
    found = {(s, t): n for s, t, n in index.matched(words, np.array([len(t) for t in asked]))}
    assert set(found) == {(i, i) for i in range(60)} and all(n >= 90 for n in found.values())


def phrased(rng, n):
    """Conversations of n words put together from few phrases, so that all their words are frequent."""
    phrases = [[f"p{w}" for w in np.random.default_rng(i).integers(0, 700, 7)] for i in range(300)]
    return [w for i in rng.integers(0, 300, n // 7 + 1) for w in phrases[i]][:n]


def test_filter_loses_no_pair_and_leaves_few():
    """All words are frequent, so any two texts share many of their rarest tokens; few pairs beside the true ones may be left for the check."""
    rng = np.random.default_rng(23)
    said = [phrased(rng, int(n)) for n in np.sort(rng.integers(60, 300, 500))]
    edited = [[w if rng.random() > 0.3 * rng.random() else f"p{rng.integers(0, 700)}" for w in t] for t in said[::5]]
    edited += [t[: len(t) - len(t) // 5] for t in said[::7]]
    for longer in (0, 900):  # longer ones have vectors of more places
        mine, there = (sorted((t + [f"q{i % 500}" for i in range(longer)] for t in x), key=len) for x in (edited, said))
        blocks = [Block(*token_hashes(x)) for x in (mine, there)]
        got = {(int(s), int(t)) for x in Filter.fit([" ".join(t) for t in there]).pairs(*blocks) for s, t in zip(*x)}
        held = [[Counter(t) for t in x] for x in (mine, there)]
        want = {(i, j) for i, a in enumerate(held[0]) for j, b in enumerate(held[1]) if (a & b).total() >= 0.75 * max(a.total(), b.total())}
        assert want <= got and len(want) > 150
        assert len(got) <= 1.5 * len(want) + 20


def test_matches_of_classes(spark, dialogues):
    rng = np.random.default_rng(29)
    said = [conversation(rng, 90) for _ in range(20)]
    rows = [(i, {"split": "test", "source": "a", "turns": as_turns(t)}) for i, t in enumerate(said)]
    rows += [(100 + i, {"split": "train", "source": "a", "turns": as_turns(t[:40] + t[45:])}) for i, t in enumerate(said)]
    rows += [(200, {"split": "train", "source": "a", "turns": as_turns([w for i, w in enumerate(said[0]) if i % 6])})]
    got = sorted((r["longer"], r["common"], r["matched"], r["n_links"]) for r in overlap_classes(dialogues(rows)).collect())
    assert len(got) == 21 and got[0] == (90, 75, None, 1) and all(g[:2] == (90, 85) and g[2] >= 80 for g in got[1:])
