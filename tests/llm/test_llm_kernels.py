"""The numpy and Python kernels of the operators against brute force, without Spark."""

import heapq
import itertools
import random
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from quire.functions import html_tree as H
from quire.llm import decontamination, near, packing, pieces, repetition, roles, substring, templates, tokens, urls, words as W

TEXT = st.text(alphabet="ab cÉé.\nЖжΣσ漢字カกä—“\u00a0İ😀𠀀，1２", max_size=40)


def reference_words(text):
    """Words by the definition, one character at a time."""
    words, run = [], ""
    for c in text or "":
        small = c.lower() if len(c.lower()) == 1 and len(c.lower().encode()) == len(c.encode()) else c
        kind = unicodedata.category(c)[0] in "LMN"
        alone = kind and any(a <= ord(c) <= b for a, b in W._UNSPACED)
        if kind and not alone:
            run += small
            continue
        words += [run] if run else []
        words += [small] if alone else []
        run = ""
    return words + ([run] if run else [])


@given(st.lists(st.one_of(st.none(), TEXT), max_size=6))
@settings(max_examples=60, deadline=None)
def test_words(texts):
    found = W.scan(pa.array(texts, pa.string()))
    assert len(found.first) == len(texts) + 1
    data = found.data.tobytes()
    for i, text in enumerate(texts):
        span = range(found.first[i], found.first[i + 1])
        mine = [data[found.starts[j] : found.ends[j]].decode() for j in span]
        assert [reference_words(w)[0] for w in mine] == reference_words(text)
        assert [found.folded.tobytes()[found.starts[j] : found.ends[j]].decode() for j in span] == reference_words(text)
    seen = {}
    for j, h in enumerate(found.hashes.tolist()):
        word = reference_words(data[found.starts[j] : found.ends[j]].decode())[0]
        assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)


def thue_morse(n, a="a", b="b"):
    return "".join((a, b)[i.bit_count() % 2] for i in range(n))


@pytest.mark.parametrize("size", [8, 64, 2048, 1 << 14])
def test_strings_that_collide_under_polynomials_are_told_apart(size):
    one, two = thue_morse(size), thue_morse(size, "b", "a")
    assert len(set(W.scan(pa.array([one, two])).hashes.tolist())) == 2
    ids, first = TOKENIZER.encode(pa.array([one, two, one]))
    assert [TOKENIZER.bpe.decode(ids[a:b].tolist()) for a, b in zip(first[:-1], first[1:])] == [one, two, one]
    known = pieces.Automaton(["ab", "abb", "a", "b"])
    assert pieces.Counter(known)(pa.array([one, two, one])).tolist() == [known.count(pieces.MARK + t) for t in (one, two, one)]
    spaced = [" ".join(t) for t in (one, two)]
    for k in (2, 50, size):
        runs = {}
        found = W.scan(pa.array(spaced))
        for at, value in zip(*(x.tolist() for x in W.windows(found, k))):
            text = int(np.searchsorted(found.first, at, "right")) - 1
            runs.setdefault(value, set()).add((one, two)[text][at - found.first[text] : at - found.first[text] + k])
        assert all(len(x) == 1 for x in runs.values())


@given(st.lists(st.text(alphabet="abé", max_size=20), max_size=8))
@settings(max_examples=100, deadline=None)
def test_kinds_are_equal_bytes(strings):
    raw = [s.encode() for s in strings]
    data, to = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
    example, kind = W.kinds_of(data, to[:-1], to[1:])
    assert all((raw[i] == raw[j]) == (kind[i] == kind[j]) for i in range(len(raw)) for j in range(len(raw)))
    assert all(raw[example[k]] == x for k, x in zip(kind, raw))


def test_colliding_hashes_do_not_join_kinds(monkeypatch):
    monkeypatch.setattr(W, "hashed", lambda data, starts, ends: np.zeros(len(starts), np.uint64))
    data = np.frombuffer(b"aabbccaa", np.uint8)
    example, kind = W.kinds_of(data, np.array([0, 2, 4, 6]), np.array([2, 4, 6, 8]))
    assert kind[0] == kind[3] and len(set(kind.tolist())) == 3 and (example[kind[1:3]] == [1, 2]).all()


def repeats_by_brute_force(tokens, least):
    n, longest, covered = len(tokens), 0, set()
    for i in range(n):
        for j in range(i):
            k = 0
            while i + k < n and tokens[i + k] == tokens[j + k]:
                k += 1
            if k >= least:
                longest = max(longest, k)
                covered.update(range(i, i + k))
    return longest, len(covered)


@given(st.lists(st.lists(st.integers(0, 2), max_size=25), max_size=5), st.integers(1, 9))
@settings(max_examples=150, deadline=None)
def test_repeats(texts, least):
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    longest, covered = repetition.repeats(np.array([x for t in texts for x in t], np.uint64), first, least)
    assert list(zip(longest.tolist(), covered.tolist())) == [repeats_by_brute_force(t, least) for t in texts]


def test_repeats_of_a_very_long_text():
    base = np.random.default_rng(0).integers(0, 1 << 60, 300_000).astype(np.uint64)
    longest, covered = repetition.repeats(np.concatenate([base, base]), np.array([0, 600_000]), 5)
    assert (longest[0], covered[0]) == (300_000, 300_000)
    longest, covered = repetition.repeats(np.zeros(50_000, np.uint64), np.array([0, 50_000]), 5)
    assert (longest[0], covered[0]) == (49_999, 49_999)


@given(st.lists(st.integers(0, 3), max_size=40), st.integers(1, 8), st.data())
@settings(max_examples=150, deadline=None)
def test_super_kmers_hold_every_window_once(texts, k, data):
    m = data.draw(st.integers(1, k))
    first = np.array([0, len(texts) // 2, len(texts)])
    start, n, least, loop = substring.super_kmers(W.mix(np.array(texts, np.uint64)), first, k, m)
    mine = sorted(i for a, b in zip(start.tolist(), n.tolist()) for i in range(a, a + b))
    assert mine == [i for a, b in zip(first[:-1], first[1:]) for i in range(a, b - k + 1)]
    windows = {}
    for a, b, v, inner in zip(start.tolist(), n.tolist(), least.tolist(), loop.tolist()):
        for i in range(a, a + b):
            windows.setdefault(tuple(texts[i : i + k]), []).append((v, a, inner))
    for held in windows.values():
        assert len({v for v, _, _ in held}) == 1  # equal windows meet in one bucket
        if len(held) > 1 and len({a for _, a, _ in held}) == 1:
            assert held[0][2]  # a repeat inside one super-k-mer isn't pruned


def test_near_cells_link_all_near_pairs_and_no_others():
    g = np.random.default_rng(1)
    base = g.integers(0, 256, (60, 64)).astype(np.uint8)
    rows = np.concatenate([base, base[:30].copy()])
    for row in rows[60:]:
        for bit in g.choice(512, 40, replace=False):
            row[bit // 8] ^= 1 << (bit % 8)
    ids = g.permutation(1000)[: len(rows)].astype(np.int64)
    keys = np.zeros(len(rows), np.int64)
    node, root = near.cell_links(ids, rows, keys, 0, 0, 102, 16)
    pairs = {frozenset((int(ids[i]), int(ids[60 + i]))) for i in range(30)}
    assert {frozenset(p) for p in zip(node.tolist(), root.tolist())} == pairs
    assert all(a > b for a, b in zip(node, root))


@pytest.mark.parametrize("leaf, depth", [(4, 0), (8, 3), (1000, 0)])
def test_climbing_compares_all_that_share_the_target_prefix(leaf, depth):
    g = np.random.default_rng(2)
    centre = g.integers(0, 256, 64).astype(np.uint8)
    rows = np.concatenate([np.repeat(centre[None], 300, 0), g.integers(0, 256, (100, 64)).astype(np.uint8)])
    for row in rows:  # a dense cluster in which some pairs are near and others aren't, and strangers
        for bit in g.choice(512, g.integers(0, 90), replace=False):
            row[bit // 8] ^= 1 << (bit % 8)
    ids = g.permutation(1000)[: len(rows)].astype(np.int64)
    keys = g.integers(0, 1 << 32, len(rows)).astype(np.int64)
    node, root = near.cell_links(ids, rows, keys, 0, depth, 102, leaf)
    found = dict(zip(node.tolist(), root.tolist()))
    words = rows.view(np.uint64)
    alike = (keys[:, None] >> (32 - depth)) == (keys[None, :] >> (32 - depth)) if depth else np.ones((400, 400), bool)
    close = np.bitwise_count(words[:, None] ^ words[None]).sum(axis=2) <= 102
    for i, j in np.argwhere(close & alike):
        assert found.get(ids[i], ids[i]) == found.get(ids[j], ids[j])
    parent = {int(i): int(i) for i in ids}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in np.argwhere(close):
        a, b = top(int(ids[i])), top(int(ids[j]))
        parent[max(a, b)] = min(a, b)
    assert all(top(a) == top(b) for a, b in found.items())


@pytest.mark.parametrize("radius", [0.05, 0.2, 0.4])
def test_no_radius_hides_pairs_of_a_cell(radius):
    g, far = np.random.default_rng(4), round(radius * near.BITS)
    base = g.integers(0, 256, (200, 64)).astype(np.uint8)
    rows = np.concatenate([base, base])
    for row in rows[200:]:
        for bit in g.choice(512, far, replace=False):
            row[bit // 8] ^= 1 << (bit % 8)
    node, root = near.cell_links(np.arange(400), rows, np.zeros(400, np.int64), 0, 0, far, 64)
    found = dict(zip(node.tolist(), root.tolist()))
    assert all(found.get(200 + i, 200 + i) == found.get(i, i) for i in range(200))


def test_tries_reach_the_recall():
    for n in (0, 1, 1000, 10**6, 10**10):
        count, depth = near.tries(n)
        assert 1 - (1 - (1 - near.DESIGN) ** depth) ** count >= near.RECALL - 1e-9
    assert near.tries(10**6)[1] > near.tries(10**4)[1]


def test_pairs_at_the_radius_meet_as_often_as_promised():
    for n in (10**4, 10**5, 6 * 10**6, 3 * 10**7):
        count, depth = near.tries(n)
        assert 1 - (1 - (1 - near.RADIUS) ** depth) ** count >= near.RECALL - 1e-9


@given(st.lists(st.text(alphabet="abcé", min_size=1, max_size=5), max_size=8), st.lists(st.text(alphabet="abcdé", max_size=12), max_size=8))
@settings(max_examples=150, deadline=None)
def test_automaton_counts_greedy_pieces(vocabulary, texts):
    automaton, known = pieces.Automaton(vocabulary), set(vocabulary)

    def greedy(word):
        i = n = 0
        while i < len(word):
            size = next((s for s in range(5, 0, -1) if word[i : i + s] in known and i + s <= len(word)), 0)
            n, i = (n + 1, i + size) if size else (n + len(word[i].encode()), i + 1)
        return n

    assert [automaton.count(t) for t in texts] == [greedy(t) for t in texts]


def test_counter_remembers_words_and_handles_nulls():
    counter = pieces.Counter(pieces.Automaton(["▁a", "b", "bb"]))
    texts = pa.array(["a abb", None, "", " \n", "abbb a", "é" * 5])
    assert counter(texts).tolist() == counter(texts).tolist() == [3, 0, 0, 0, 4, 3 + 10]


POINTS = st.text(alphabet=["a", "S", "é", "'", "s", "l", "r", "e", " ", "\n", "\t", "1", "２", ".", "!", "漢", "😀", " ", "-", "t"], max_size=14)


@given(st.lists(POINTS, max_size=8))
@settings(max_examples=300, deadline=None)
def test_token_ids_equal_the_tokenizer_and_round_trip(texts):
    ids, first = TOKENIZER.encode(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:])] == [TOKENIZER.bpe.encode_ordinary(t) for t in texts]
    assert [TOKENIZER.bpe.decode(ids[a:b].tolist()) for a, b in zip(first[:-1], first[1:])] == texts


TOKENIZER = tokens.Tokenizer(tokens.load_ranks())


def test_packing_keeps_the_limits_and_comes_close_to_the_bound():
    g, limits = np.random.default_rng(0), np.array([4096, 32, 3072])
    vectors = np.stack([g.integers(0, 1500, 1500), g.integers(1, 8, 1500), g.integers(0, 900, 1500)], axis=1)
    bins = packing.pack_vectors(vectors, limits)
    load = np.zeros((bins.max() + 1, 3))
    np.add.at(load, bins, vectors)
    assert (bins >= 0).all() and (load <= limits).all() and (load[:, 1] > 0).all()
    assert bins.max() + 1 <= 1.1 * np.ceil((vectors.sum(axis=0) / limits).max())


@given(st.lists(st.tuples(st.integers(0, 10), st.integers(0, 3), st.integers(0, 6)), max_size=25))
@settings(max_examples=80, deadline=None)
def test_packing_follows_the_dot_product_rule(rows):
    vectors, limits = np.array(rows, np.int64).reshape(-1, 3), np.array([10, 3, 6])
    bins = packing.pack_vectors(vectors, limits)
    load = np.zeros((len(rows) + 1, 3))
    np.add.at(load, bins, vectors)
    assert (load <= limits).all()
    if len(rows):  # no later example fits an earlier bin
        for i, b in enumerate(bins):
            assert all((load[a] + vectors[i] > limits).any() for a in range(b))


def test_best_run_is_the_longest_good_one():
    g = random.Random(0)
    for _ in range(400):
        same = np.array([g.random() < 0.7 for _ in range(g.randint(1, 24))])
        least, share = g.randint(1, 8), g.choice([0.0, 0.2, 0.25, 0.5])
        good = [(b - a, -a) for a in range(len(same)) for b in range(a + 1, len(same) + 1) if same[a] and same[b - 1] and b - a >= least and (~same[a:b]).sum() <= share * (b - a) + 1e-9]
        found = decontamination.best_run(same, share, least)
        assert (None if found is None else (found[1] - found[0], -found[0])) == (max(good) if good else None)
        if found:
            assert found[2] == same[found[0] : found[1]].sum()


def test_spaced_seeds_find_overlaps_with_substitutions():
    g = np.random.default_rng(3)
    item = g.integers(0, 1 << 60, 30).astype(np.uint64)
    index = decontamination.Index([7], [item], decontamination.MASKS)
    found = 0
    for trial in range(200):
        train = g.integers(0, 1 << 60, 60).astype(np.uint64)
        train[10:40] = item
        train[g.choice(np.arange(10, 40), 4, replace=False)] = 1
        w = W.Words(np.zeros(0, np.uint8), np.zeros(1), np.zeros(60, int), np.zeros(60, int), train, np.array([0, 60]))
        best = decontamination._best(w, index.hits(w), index.tokens, 0.25, 13)
        found += (0, 0) in best
    assert found >= 195


def _brute_overlaps(train, item, share=0.25, least=13):
    best = None
    for d in range(-len(item) + 1, len(train)):
        run = decontamination.overlap(train, item, d, share, least)
        if run is not None and (best is None or (best[0] - best[1], best[0]) > (run[0] - run[1], run[0])):
            best = run
    return best


def test_seeds_find_what_all_diagonals_find():
    g = np.random.default_rng(11)
    for n in range(6, 41):
        for least in (13, 8):
            for trial in range(20):
                item, train = g.integers(0, 1 << 60, n).astype(np.uint64), g.integers(0, 1 << 60, 60).astype(np.uint64)
                size = n if n <= 13 or trial % 2 else int(g.integers(13, n + 1))  # all of the item, or a part of it
                a = int(g.integers(0, n - size + 1))
                train[10 : 10 + size] = item[a : a + size]
                train[10 + 1 + g.choice(size - 2, size // 4, replace=False)] = 1
                index = decontamination.Index([7], [item], decontamination.MASKS, least)
                w = W.Words(np.zeros(0, np.uint8), np.zeros(1), np.zeros(60, int), np.zeros(60, int), train, np.array([0, 60]))
                want = _brute_overlaps(train, item, least=least)
                assert want is not None
                assert decontamination._best(w, index.hits(w), index.tokens, 0.25, least) == {(0, 0): want}


@pytest.mark.parametrize("masks, low", [(decontamination.MASKS, decontamination.LONG), (decontamination.LIGHT_MASKS, decontamination.MIN_ITEM + 1)])
def test_no_substitutions_hide_an_overlap_from_the_masks(masks, low):
    """The fewest mismatches that leave no window under any mask, by length, are more than a quarter."""
    span = max(map(len, masks))
    fewest = {0: 0}  # by the last places, 1 for a match
    for n in range(1, 120):
        after = {}
        for state, lost in fewest.items():
            for bit in (0, 1):
                now = state << 1 | bit
                if all(now & int(m, 2) != int(m, 2) for m in masks):
                    key = now & ((1 << span - 1) - 1)
                    after[key] = min(after.get(key, n), lost + 1 - bit)
        fewest = after
        ends = [lost for state, lost in fewest.items() if state & 1]
        assert n < low or not ends or min(ends) > n * decontamination.MAX_SUBSTITUTED


def cheapest(given_roles):
    best, heap = set(), [(0, 0, "")]
    while heap:
        cost, i, state = heapq.heappop(heap)
        if (i, state) in best:
            continue
        best.add((i, state))
        if i == len(given_roles) and state == "assistant":
            return cost
        for to in roles._NEXT[state]:
            heapq.heappush(heap, (cost + roles.INSERT, i, to))
        if i < len(given_roles):
            role = given_roles[i] if given_roles[i] in roles.ROLES else None
            for to in roles._NEXT[state]:
                heapq.heappush(heap, (cost + (0 if to == role else 1 if role is None else 2), i + 1, to))
            if state:
                heapq.heappush(heap, (cost + (1 if role in (state, None) else 2), i + 1, state))


@pytest.mark.parametrize("size", range(1, 6))
def test_role_repair_is_cheapest_and_legal(size):
    for given_roles in itertools.product(("system", "user", "assistant", "tool"), repeat=size):
        cost, turns = roles.repaired([(r, f"t{i}") for i, r in enumerate(given_roles)])
        assert cost == cheapest(given_roles)
        state = ""
        for role, _ in turns:
            assert role in roles._NEXT[state]
            state = role
        assert state == "assistant"
        assert "".join(t for _, t in turns).replace("\n", "") == "".join(f"t{i}" for i in range(size))  # no text is lost
    assert roles.repaired([]) == (0, [])


def test_literal_tokens_are_whole_and_sure():
    assert urls.literal_tokens(r"/ads/banner[0-9]+") == [["ads"]]
    assert urls.literal_tokens(r"ads") == []  # may be part of a longer token
    assert urls.literal_tokens(r"^http://x\.com/a?b/") == [["http"], ["x"], ["com"], ["ab", "b"]]
    assert urls.literal_tokens(r"/one/|/two/") == []
    assert urls.literal_tokens(r"/(one)/two/") == [["one"], ["two"]]
    assert urls.literal_tokens(r"/(log|sign)in(/|\?|$)") == [["login", "signin"]]
    assert urls.literal_tokens(r"/(a|b)?/c/") == [["c"]] and urls.literal_tokens(r"/(a|b.)/") == [] and urls.literal_tokens(r"/x?/") == []
    assert urls.literal_tokens(r"\.(jpg|png)(\?|$)") == [["jpg", "png"]] and urls.literal_tokens(r"//ads?\.") == [["ad", "ads"]]
    assert urls.literal_tokens("/[a") is None and urls.literal_tokens("(") is None
    assert [i for i, _, p in urls.RULES if not urls.literal_tokens(p)] == [18]


@given(st.lists(st.sampled_from(["a", "b", "ab", "/", r"\.", "?", "(a|ab)", "(/|$)", "[0-9]", "(x|y.)", "+", "^", "$", "c?"]), max_size=7), st.text(alphabet="ab/.1cxy", max_size=12))
@settings(max_examples=400, deadline=None)
def test_a_match_has_a_token_of_every_set(parts, url):
    pattern = "".join(parts)
    sets = urls.literal_tokens(pattern)
    if sets and re.search(pattern, url):
        held = set(re.split("[^a-z0-9]+", url.lower()))
        assert all(held & set(s) for s in sets)


def test_template_cut():
    page = "<body><div class=n><p>menu</p></div><p>own {}</p><div class=n><p>menu</p></div></body>"
    a, b = H.build(page.format(1))[0], H.build(page.format(2))[0]
    shared = set(templates.subtree_hashes(a).values()) & set(templates.subtree_hashes(b).values())
    assert templates.cut(a, shared) == 2 and H.text_of(a) == "own 1"
    for html in (page.format(1), "<div>a<div>x</div>b</div>c<ul><li>d<li>d</ul>", "t <p>u\ufeffv<script>s</script><br>w", ""):
        tree = H.build(html)[0]
        hashes = sorted(set(templates.subtree_hashes(tree).values()))
        for known in (frozenset(), frozenset(hashes[::2]), frozenset(hashes)):
            whole = H.build(html)[0]
            n = templates.cut(whole, known)
            assert templates.without(*templates.flat(tree), known) == (H.text_of(whole, templates._HIDDEN), n)
    deep = H.build("<div>" * 5000 + "x")[0]
    assert len(templates.subtree_hashes(deep)) > 100 and templates.cut(deep, frozenset()) == 0
