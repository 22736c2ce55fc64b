import hashlib
import random
import zlib

import numpy as np
import pytest

from tablehaul.llm import prefix_trie
from tests.llm.brute import WORD

SCHEMA = "conv_id long, turn long, role string, text string"


def brute_nodes(paths):
    """paths: conversation -> list of (role, text)."""
    members, ends, children = {}, {}, {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members.setdefault(tuple(path[:d]), []).append(c)
        ends.setdefault(tuple(path), []).append(c)
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)

    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        kids = children.get(node, [])
        words = len(WORD.findall(node[-1][1])) if node else 0
        leaves[node] = sum(leaves[k] for k in kids) if kids else 1
        saved[node] = sum(saved[k] for k in kids) + (len(members[node]) - 1) * words
    digest = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted(
        (min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(children.get(node, [])), leaves[node], saved[node], digest(ends.get(node, [])))
        for node, m in members.items()
    ) if paths else []


def turns_of(rows):
    name = lambda r: hashlib.sha256(f"{len(r[2] or '')}:{r[2] or ''}{r[3] or ''}".encode()).hexdigest()
    own = {}
    for r in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0, name(r)[:32])):
        own.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    return own


def rebuilt(own):
    out = {}
    for c, path in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - c % 20, [])[:h] + path[h:]
    return out


def found(df):
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(((tuple(r[c] for c in columns)) for r in df.collect()), key=lambda r: tuple((x is not None, x) for x in r))


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


def some_rows(seed, convs=260, hot=0.3):
    rng = random.Random(seed)
    said = ["yes", "no \n maybe", "", None, "a b c", "tell me\tmore about it"]
    rows = []
    for c in range(convs):
        if rng.random() < 0.1:
            continue
        if rng.random() < hot:
            rows += [(c, t, "user", f"hot {t}") for t in range(3)]
        else:
            rows += [(c, t, rng.choice(["user", "assistant", None]), rng.choice(said)) for t in range(rng.choice([1, 1, 2, 3, 5, 9]))]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("shard_turns", [1, 7, 60, 1 << 18])
def test_query_against_brute_force_at_every_shard_size(spark, shard_turns):
    rows = some_rows(shard_turns)
    paths = prefix_trie.with_shared_heads(prefix_trie.conversation_paths(spark.createDataFrame(rows, SCHEMA)))
    assert found(prefix_trie.trie_nodes(paths, shard_turns)) == ordered(brute_nodes(rebuilt(turns_of(rows))))


def test_given_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(prefix_trie.trie_rows(spark.createDataFrame(rows, SCHEMA))) == ordered(brute_nodes(rebuilt(turns_of(rows))))


def test_nulls_ties_repeats_and_clashing_columns(spark):
    rows = [
        (1, None, "user", "first"), (1, 0, "user", "second"), (1, 0, "user", "second"), (1, 0, None, None), (2, 0, "us", "erx"), (3, 0, "user", "x"),
        (None, 0, "user", "nobody"), (-3, 1, "user", "below zero"), (20, 0, "user", "z " * 30_000), (21, 0, "a", "b"), (22, 5, "q", ""), (40, 0, "user", None),
    ]
    plain = spark.createDataFrame(rows, SCHEMA)
    odd = plain.selectExpr("*", "1 AS c", "2 AS path", "3 AS words", "4 AS t", "5 AS name", "6 AS d", "7 AS h", "8 AS n")
    for frame in (plain, odd):
        paths = prefix_trie.conversation_paths(frame)
        assert found(prefix_trie.trie_nodes(paths)) == ordered(brute_nodes(turns_of(rows)))


def test_empty_table_and_turnless_conversations(spark):
    assert found(prefix_trie.trie_rows(spark.createDataFrame([], SCHEMA))) == []
    # c = 21 has h = crc32("21") % 4 turns taken from conversation 20, which is absent
    rows = [(c, 0, "user", "only") for c in range(21, 40)]
    nodes = found(prefix_trie.trie_rows(spark.createDataFrame(rows, SCHEMA)))
    assert nodes == ordered(brute_nodes(rebuilt(turns_of(rows)))) and len(nodes) == 2
    assert nodes[0][2] is None and nodes[0][3] == 19


def test_many_copies_are_hashed_in_order_over_id_ranges(spark):
    rows = [(c * 37 - 5000, 0, "user", "same") for c in range(3000)] + [(10**12, 0, "user", "same")]
    assert found(prefix_trie.trie_nodes(prefix_trie.conversation_paths(spark.createDataFrame(rows, SCHEMA)))) == ordered(brute_nodes(turns_of(rows)))


@pytest.mark.parametrize("seed", range(6))
def test_find_close_and_leaf_rank(seed):
    rng = random.Random(seed)
    bits, open_, n = [], 0, rng.choice([1, 40, 3000])
    for _ in range(n):
        if open_ and rng.random() < (0.5 if seed % 2 else 0.1):
            bits.append(0)
            open_ -= 1
        else:
            bits.append(1)
            open_ += 1
    bits = [1, *bits, *[0] * (open_ + 1)]
    stack, close = [], {}
    for i, b in enumerate(bits):
        if b:
            stack.append(i)
        else:
            close[stack.pop()] = i
    tree = prefix_trie.Parentheses(np.array(bits, bool))
    assert tree.find_close().tolist() == [close[i] for i in sorted(close)]
    pairs = [bits[i] == 1 and bits[i + 1] == 0 for i in range(len(bits) - 1)]
    assert tree.leaf_rank().tolist() == [sum(pairs[:i]) for i in range(len(bits) + 1)]
