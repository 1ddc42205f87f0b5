"""Prefix trie against a plain version; shards of any size; balanced parentheses."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from relayspark.llm import prefix_trie
from relayspark.llm.prefix_trie import find_close, rebuilt_paths, trie_nodes, turn_paths

TURNS = "conv_id bigint, turn bigint, role string, text string, path string, key long, depth long, n long"


@pytest.fixture
def conversations(spark):
    """Conversations with columns whose names the operator uses itself."""
    return lambda rows: spark.createDataFrame([(*r, "p", 1, 2, 3) for r in rows], TURNS)


def sequences(rows):
    of = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            of[c].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in of.items()}


def rebuilt(of):
    out = {}
    for c, own in of.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(np.fmod(c, 5))
        out[c] = of.get(base, [])[:h] + own[h:]
    return out


def trie(of):
    members = defaultdict(list)
    for c, s in sorted(of.items()):
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)

    def below(p):
        here = (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0)
        found = [below(x) for x in children[p]]
        return here + sum(x[0] for x in found), sum(x[1] for x in found) or 1

    out = []
    for p, m in members.items():
        saved, leaves = below(p)
        ends = ",".join(str(c) for c in m if tuple(of[c]) == p)
        out.append((m[0], len(p), members[p[:-1]][0] if p else None, len(m), len(children[p]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[0], r[1]))


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def got(df):
    assert df.columns == COLUMNS and {t for _, t in df.dtypes[:7]} == {"bigint"}
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0], r[1]))


def make(seed=0, n=160):
    rng = random.Random(seed)
    texts = ["", "a", "bb", "ünï", "\U0001f600 x", "a long answer " * 9]
    rows = []
    for c in rng.sample(range(-40, 400), n):
        same = rng.random() < 0.4
        turns = rng.sample(range(-1, 30), rng.randint(1, 9))
        for i, t in enumerate(sorted(turns)):
            text = texts[2] if same else rng.choice([*texts, None])
            rows.append((c, None if i == 0 and rng.random() < 0.2 else t, rng.choice(["user", "assistant", None]) if not same else "user", text))
    return rows


@pytest.mark.parametrize("nodes", [prefix_trie.SHARD_NODES, 3, 40])
def test_nodes_equal_plain_version(conversations, monkeypatch, nodes):
    """Also with shards of a few nodes, where spines are most of the trie."""
    monkeypatch.setattr(prefix_trie, "SHARD_NODES", nodes)
    rows = make(nodes)
    random.Random(1).shuffle(rows)
    paths = turn_paths(conversations(rows).repartition(4))
    assert got(trie_nodes(paths)) == trie(sequences(rows))
    assert got(trie_nodes(rebuilt_paths(paths))) == trie(rebuilt(sequences(rows)))


def test_odd_rows(conversations):
    rows = [
        (None, 0, "user", "of no conversation"),
        (1, None, None, None),
        (1, 0, "user", ""),
        (2, 0, "", ""),
        (2, 0, "", ""),
        (3, 5, "user", "x" * 100_000),
        (4, 0, "us", "er:a"),
        (9, 0, "user", "ra"),
        (-7, 0, "user", "ra"),
        (2**62, 0, "user", "ra"),
    ]
    paths = turn_paths(conversations(rows))
    assert got(trie_nodes(paths)) == trie(sequences(rows))
    assert got(trie_nodes(rebuilt_paths(paths))) == trie(rebuilt(sequences(rows)))


def test_turnless_conversations_and_empty_table(conversations):
    """Heads of a conversation that isn't there leave conversations of no turns."""
    rows = [(c, 0, "user", "hello") for c in range(1, 60) if c % 5]
    want = trie(rebuilt(sequences(rows)))
    assert want[0][1] == 0 and want[0][7] != hashlib.sha256(b"").hexdigest()
    assert got(trie_nodes(rebuilt_paths(turn_paths(conversations(rows))))) == want
    assert got(trie_nodes(rebuilt_paths(turn_paths(conversations([]))))) == []


def test_one_very_common_conversation(conversations, monkeypatch):
    """Ids at an end are joined in pieces before the one task that hashes them."""
    monkeypatch.setattr(prefix_trie, "JOINED", 50)
    rows = [(c, t, "user", f"turn {t}") for c in range(900) for t in range(3)] + [(c, t, "user", f"{c % 7} {t}") for c in range(900, 1000) for t in range(4)]
    assert got(trie_nodes(turn_paths(conversations(rows)))) == trie(sequences(rows))


def test_one_deep_conversation(conversations, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SHARD_NODES", 50)
    rows = [(1, t, "user", f"{t}") for t in range(400)] + [(2, t, "user", f"{t}") for t in range(300)] + [(3, t, "user", f"{t % 200}") for t in range(320)]
    assert got(trie_nodes(turn_paths(conversations(rows)))) == trie(sequences(rows))


@pytest.mark.parametrize("block", [4, 64])
def test_find_close(block):
    rng = random.Random(block)
    for _ in range(60):
        bits, open_, pairs = [], [], {}
        size = rng.choice([1, 3, 40, 700])
        while len(pairs) < size:
            if open_ and (rng.random() < rng.choice([0.2, 0.5, 0.9]) or len(open_) + len(pairs) == size):
                pairs[open_.pop()] = len(bits)
                bits.append(0)
            else:
                open_.append(len(bits))
                bits.append(1)
        at = np.flatnonzero(bits)
        assert find_close(np.array(bits, np.int8), at, block).tolist() == [pairs[i] for i in at.tolist()]
