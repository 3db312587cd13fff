"""Prefix trie, vector codes and url rules against brute force and on odd tables."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from runscore.llm import slice_masks, url_rules
from runscore.llm.prefix_trie import prefix_trie, reopened, turn_digests

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TURNS = "conv_id long, turn long, role string, text string, depth string, n_words int, x1 long"


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "other", -1, 0) for r in rows], TURNS)


def some_turns(seed, count=60, longest=9):
    """Conversations that share beginnings, some of them whole."""
    random.seed(seed)
    rows = []
    for c in range(count):
        for turn in range(random.randrange(1, longest)):
            rows.append((c, turn, "user" if turn % 2 == 0 else "assistant", random.choice(["a", "a", "a b", "b\tc  d"])))
    return rows


def brute_trie(rows, every=None):
    """The nodes by dictionaries; `every` reopens conversations first."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((-math.inf if turn is None else turn, role or "", text or ""))
    built = {c: [t[1:] for t in sorted(turns)] for c, turns in own.items()}
    if every:
        taken = {c: zlib.crc32(str(c).encode()) % 4 for c in built}
        first = {c: built.get(c - int(math.fmod(c, every)), [])[: taken[c]] for c in built}
        built = {c: first[c] + built[c][taken[c] :] for c in built}
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = []
    for node, convs in members.items():
        below = [n for n in members if n[: len(node)] == node]
        parents = {n[:-1] for n in members if n}
        ends = ",".join(str(c) for c in sorted(c for c in convs if tuple(built[c]) == node))
        out.append((
            min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs),
            sum(1 for n in members if n and n[:-1] == node),
            sum(1 for n in below if n not in parents),
            sum((len(members[n]) - 1) * len(WORD.findall(n[-1][1])) for n in below if n),
            hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return Counter(out)


def trie_rows(frame):
    return Counter(
        (r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256)
        for r in frame.collect()
    )


@pytest.mark.parametrize("band", [1 << 20, 32, 4, 2])
def test_trie_equals_brute_force_at_any_band_height(spark, band):
    rows = some_turns(1) + [(900 + i, t, "user", "deep") for i in (0, 1) for t in range(40 + i)]
    got = trie_rows(prefix_trie(turn_digests(conversations(spark, rows)), band=band))
    assert got == brute_trie(rows)


def test_reopened_trie_equals_brute_force(spark):
    rows = [(c - 30, *rest) for c, *rest in some_turns(2, 90, 6)]
    rows += [(None, 1, "user", "nobody's")] + [(200, None, None, "late"), (200, None, "user", None), (200, 1, "user", "x" * 300_000)]
    table = conversations(spark, rows)
    got = trie_rows(prefix_trie(reopened(turn_digests(table)), table.select("conv_id")))
    assert got == brute_trie(rows, every=20)
    assert sum(1 for key in got if key[1] == 0) == 1


def test_repeated_turns_count_as_turns(spark):
    rows = [(1, 0, "user", "same"), (1, 0, "user", "same"), (2, 0, "user", "same")]
    assert trie_rows(prefix_trie(turn_digests(conversations(spark, rows)))) == brute_trie(rows)


def test_trie_of_no_conversations_has_no_node(spark):
    empty = conversations(spark, [])
    assert prefix_trie(reopened(turn_digests(empty)), empty.select("conv_id")).count() == 0


def test_candidates_hold_every_entry_within_the_radius():
    random.seed(4)
    rng = np.random.default_rng(4)
    for count, width in itertools.product([1, 2, 63, 64], [1, 3, 4]):
        entries = rng.integers(-40, 40, (count, width))
        x = rng.integers(-60, 60, (300, width))
        book = slice_masks.Slices(entries)
        away = ((x[:, None, :] - entries[None]) ** 2).sum(axis=2)
        mask = book.candidates(x, book.radius(x))
        inside = (mask[:, None] >> np.arange(count, dtype=np.uint64)[None]) & np.uint64(1) == 1
        assert (inside | (away > away.min(axis=1)[:, None])).all()
        index, least = book.nearest(x)
        assert (index == away.argmin(axis=1)).all() and (least == away.min(axis=1)).all()
    assert book.computed < 300 * 64 / 2  # most distances are never computed


def brute_codes(rows, parts=16):
    """vec_id -> code and error by comparing all entries."""
    kept = [(i, [math.floor(256 * x) for x in v], k) for i, v, k in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return Counter()
    size = Counter(len(v) for _, v, _ in kept).most_common(1)[0][0]
    kept = sorted((r for r in kept if len(r[1]) == size), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    cut = [size * p // parts for p in range(parts + 1)]
    books = [[r[1][a:b] for r in kept[:64]] for a, b in zip(cut, cut[1:])]

    def nearest(p, x):
        return min((sum((s - t) ** 2 for s, t in zip(x, e)), n) for n, e in enumerate(books[p]))

    for round_ in range(3):
        found = [[nearest(p, v[a:b]) for p, (a, b) in enumerate(zip(cut, cut[1:]))] for _, v, _ in kept]
        if round_ < 2:
            for p, (a, b) in enumerate(zip(cut, cut[1:])):
                for n in range(len(books[p])):
                    mine = [r[1][a:b] for r, f in zip(kept, found) if f[p][1] == n]
                    if mine:
                        books[p][n] = [sum(c) // len(mine) for c in zip(*mine)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    errors = [sum(d for d, _ in f) for f in found]
    by_label = Counter()
    for (_, _, label), error in zip(kept, errors):
        by_label[label] += error
    return Counter(
        (i, "".join(f"{n:02x}" for _, n in f), error, by_label[label], digest) for (i, _, label), f, error in zip(kept, found, errors)
    )


def embeddings(spark, rows):
    kind = "vec_id long, embedding array<double>, label int, error string, v string, x int"
    return spark.createDataFrame([(*r, "other", "clash", 1) for r in rows], kind)


def code_rows(frame):
    return Counter(tuple(r) for r in frame.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect())


@pytest.mark.parametrize(("count", "size"), [(150, 32), (40, 32), (90, 21), (1, 16), (30, 5)])
def test_codes_equal_brute_force(spark, count, size):
    random.seed(count)
    rows = [(i * 3, [random.choice([-0.1, 0.0, 0.3, random.gauss(0, 0.2)]) for _ in range(size)], i % 3 or None) for i in range(count)]
    rows += [rows[0], rows[-1]]  # repeated rows
    odd = [(None, rows[0][1], 1), (500, None, 1), (501, [], 1), (502, [None] * size, 1), (503, [math.nan] * size, 2)]
    odd += [(504, [math.inf] + [0.0] * (size - 1), 2), (505, [0.5] * (size + 1), 2), (-7, [0.0] * size, 9)]
    got = code_rows(slice_masks.compress_vectors(embeddings(spark, rows + odd)))
    assert got == brute_codes(rows + odd)


def test_huge_components_are_held_at_the_bound(spark):
    rows = [(1, [1e300] * 16, 1), (2, [-1e300] * 16, 1), (3, [0.0] * 16, None)]
    assert slice_masks.compress_vectors(embeddings(spark, rows)).count() == 3


def test_codes_of_an_empty_table(spark):
    got = slice_masks.compress_vectors(embeddings(spark, []))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and got.count() == 0


RULES = [
    ("com", "/", "allow"), ("EXAMPLE.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"),
    ("net", "/es/", "allow"), ("a.b", "", "block"), ("org", "/x", None), ("", "", "block"), (None, "/", "allow"),
]
URLS = [
    "http://www.example.com/en/1", "https://Example.COM/en/", "http://example.com/en", "http://xexample.com/en/2", "http://com/",
    "http://com", "ftp://a.net/es/?q=http://x.com/", "//a.net/es/", "a.net/es/", None, "", "://", "http:///x", "http://A.b?x", "http://c.a.b#y",
    "http://org/xyz", "http://q.org/x?y/", "http://q.org/X", "http://com./en/", "x?u=http://n.net/es/1", "http://a.net/es", "http://é.com/é#ü",
    "http://a\nb.com/en/\nz", "http://" + "a." * 5000 + "com/" + "p" * 50_000, "http://w.net/es/" + "?" * 9, "http://org",
]


def brute_verdict(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = []
    for h, p, verdict in rules:
        h, p = (h or "").lower(), p or ""
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            fits.append((len(h + p), len(h), h + p, "allow" if verdict == "allow" else "block"))
    best = max(fits, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


def judged(spark, urls, rules):
    pages = spark.createDataFrame([(i if i % 7 else None, u, "x", "y", 1) for i, u in enumerate(urls)], "page_id long, url string, host string, rule string, block int")
    listed = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = url_rules.judge_urls(pages, listed)
    return Counter(tuple(r) for r in got.select("page_id", "host", "path", "rule", "verdict").collect())


@pytest.mark.parametrize("rules", [RULES, [], [("com", "/", "block")] * 3])
def test_verdicts_equal_brute_force(spark, rules):
    urls = URLS + URLS[:4] * 3
    want = Counter((i if i % 7 else None, *brute_verdict(u, rules)) for i, u in enumerate(urls))
    assert judged(spark, urls, rules) == want


def test_verdicts_of_no_pages(spark):
    assert judged(spark, [], RULES) == Counter()


def test_filter_loses_nothing_and_stops_most(spark):
    rules = url_rules.canonical_rules(spark.range(4000).selectExpr("concat('h', id, '.com') AS host", "'/p' AS path", "'block' AS verdict"))
    forms = spark.range(20_000).selectExpr("concat('h', id, '.com') AS rule_host", "'/p' AS rule_path")
    passed = {r["rule_host"] for r in url_rules.possible(forms, rules, 125).collect()}
    assert {f"h{i}.com" for i in range(4000)} <= passed
    assert len(passed) < 4000 + 800
    assert url_rules.possible(forms, rules, 1).count() >= 4000  # a filter that is too small passes more, never less
