import hashlib
import random
import zlib

import numpy as np
import pytest

from tidemark.llm import prefix_trie as P

TURNS = "conv_id long, turn long, role string, text string, label string, path string, key int"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def label(role, text):
    return sha(f"{len(role or '')}:{role or ''}{text or ''}")[:32] + f"{len(text or ''):08x}"


def grouped(rows):
    own = {}
    for c, t, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, label(role, text), (role or "", text or "")))
    return {c: [x[3] for x in sorted(v)] for c, v in own.items()}


def rebuilt(own):
    out = {}
    for c, turns in own.items():
        base = int(np.fix(c / 100)) * 100
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def brute(convs):
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    rows = []
    for k, members in nodes.items():
        below = [x for x in nodes if x[: len(k)] == k]
        children = [x for x in below if len(x) == len(k) + 1]
        leaves = sum(not any(y[: len(x)] == x and len(y) > len(x) for y in below) for x in below)
        saved = sum((len(nodes[x]) - 1) * (len(x[-1][1]) if x else 0) for x in below)
        ends = sorted(c for c in members if len(convs[c]) == len(k))
        rows.append((min(members), len(k), min(nodes[k[:-1]]) if k else None, len(members), len(children), leaves, saved, sha(",".join(map(str, ends)))))
    return sorted(rows, key=str)


def table(spark, rows):
    return spark.createDataFrame([(*r, "l", "p", 1) for r in rows], TURNS)


def result(df):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


def corpus(seed, convs=160, words=3, longest=7):
    r = random.Random(seed)
    rows = []
    for c in range(convs):
        c = c if c % 3 else c * 7 - 200
        for t in range(r.randint(1, longest)):
            rows.append((c, t if r.random() < 0.95 else None, r.choice(["user", "assistant", None]), r.choice(["é", "hello", "日本", "", None][: words + 2]) if r.random() < 0.8 else f"own {c} {t}"))
    return rows


@pytest.mark.parametrize("size", [P.SHARD_BYTES, 3000, 200])
def test_against_brute_force(spark, size):
    """Many shards, down to a path or two each: most nodes are then shared."""
    rows = corpus(4)
    own = grouped(rows)
    convs = P.conversations(table(spark, rows))
    assert result(P.trie_nodes(convs, size)) == brute(own)
    assert result(P.trie_nodes(P.with_shared_openings(convs), size)) == brute(rebuilt(own))


def test_hot_prefix_hot_conversation_and_a_chain(spark):
    """A first turn of all, one conversation repeated by most, one that is the beginning of others, a long one."""
    rows = [(c, t, "user", f"same {t}") for c in range(200) for t in range(4)]
    rows += [(1000 + c, t, "user", "same 0" if t == 0 else f"{c} {t}") for c in range(100) for t in range(3)]
    rows += [(2000 + c, t, "user", f"same {t}") for c in range(8) for t in range(c)]
    rows += [(3000, t, "user", f"same {t}") for t in range(300)] + [(3001, t, "user", f"same {t}") for t in range(200)]
    own = grouped(rows)
    convs = P.conversations(table(spark, rows).repartition(7))
    for size in (P.SHARD_BYTES, 900):
        assert result(P.trie_nodes(convs, size)) == brute(own)


def test_blocks_of_ids(spark, monkeypatch):
    monkeypatch.setattr(P, "BLOCK", 7)
    rows = [(c, 0, "user", "x") for c in range(-40, 400)]
    assert result(P.trie_nodes(P.conversations(table(spark, rows)))) == brute(grouped(rows))


def test_odd_tables(spark):
    assert P.trie_nodes(P.conversations(table(spark, []))).count() == 0
    rows = [(None, 1, "user", "x"), (5, None, None, None), (5, 1, "user", "a"), (5, 1, "user", "a"), (5, 1, "b", "c"), (6, None, "", ""), (7, 2, "1:a", "b"), (8, 2, "1", ":ab"), (9, 0, "user", "long " * 50000)]
    own = grouped(rows)
    assert result(P.trie_nodes(P.conversations(table(spark, rows)))) == brute(own)
    # turnless after the splice: base absent and fewer turns than its opening takes
    assert [] in rebuilt(own).values()
    assert result(P.trie_nodes(P.with_shared_openings(P.conversations(table(spark, rows))), 50)) == brute(rebuilt(own))
    assert result(P.trie_nodes(P.with_shared_openings(P.conversations(table(spark, [(7, 1, "user", "x")]))))) == brute(rebuilt(grouped([(7, 1, "user", "x")])))


def test_bitvector(spark):
    """Walking the bits of all shards gives back the paths."""
    own = grouped(corpus(9, 60))
    want = {tuple(label(*t) for t in turns[:d]) for turns in own.values() for d in range(len(turns) + 1)}
    got = set()
    for r in P.succinct(P.conversations(table(spark, corpus(9, 60))), 2000).collect():
        bits = np.unpackbits(np.frombuffer(r["bits"], np.uint8))[: 2 * r["n_nodes"] + 1].astype(bool)
        assert bits.sum() == r["n_nodes"] and not bits[1]
        names, queue, at, node = [()], 1, 2, 0
        digests, lengths = r["digests"], np.frombuffer(r["lengths"], "<i4")
        while node < r["n_nodes"]:
            while bits[at]:
                k = queue - 1
                names.append((*names[node], digests[16 * k : 16 * k + 16].hex() + f"{lengths[k]:08x}"))
                queue, at = queue + 1, at + 1
            at, node = at + 1, node + 1
        got |= set(names)
    assert got == want
