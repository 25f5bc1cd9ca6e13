import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quern.llm import trie


def rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % 9 for c in own}
    return {c: own.get(c - c % 5, [])[: h[c]] + v[h[c] :] for c, v in own.items()}


def plain(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    saved, leaves, kids = defaultdict(int), defaultdict(int), defaultdict(int)
    for k in members:
        if k:
            kids[k[:-1]] += 1
    for k, m in members.items():
        for d in range(len(k) + 1):
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1].encode()) if k else 0
            leaves[k[:d]] += not kids[k]
    ends = lambda k: ",".join(str(c) for c in sorted(members[k]) if len(convs[c]) == len(k))
    return sorted(str((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), kids[k], leaves[k], saved[k], hashlib.sha256(ends(k).encode()).hexdigest())) for k, m in members.items())


def made(n):
    rows = []
    for c in range(n):
        turns = [("user" if d % 2 == 0 else "assistant", ["é", "b", "", "dd\n"][(c // 3 ** min(d, 3) + d) % 4] * (d + 1)) for d in range(c % 13)]
        rows += [(c, d if d % 4 else d // 4, *t) for d, t in enumerate(turns)]
    return rows + [(None, 1, "user", "x"), (7, None, None, None), (7, None, "user", None), (9, 3, "user", "same"), (9, 3, "user", "same")] + [(9_999, 1, "user", "a")]


def got(df):
    return sorted(str(tuple(r)) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect())


@pytest.mark.parametrize("parts", [1, 5])
def test_against_plain(spark, parts):
    rows = made(160)
    docs = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumns({c: F.lit(1) for c in ("pos", "node", "first", "n", "size", "ends", "part", "k", "depth")}).repartition(parts)
    convs = rebuilt(rows)
    assert any(not v for v in convs.values())  # one without turns
    assert got(trie.of_conversations(docs)) == plain(convs)


def as_turns(spark, convs):
    return spark.createDataFrame([(c, p, *t) for c, v in convs.items() for p, t in enumerate([("", ""), *v])], "conv_id bigint, pos bigint, role string, text string")


@pytest.mark.parametrize(("fan", "limit"), [(2, 3), (2, 50), (8, 100_000)])
def test_flushes_and_rounds(spark, monkeypatch, fan, limit):
    monkeypatch.setattr(trie, "LIST", 2)
    convs = {c: [("u", "same start")] * (c % 4) + [("u", f"{c % 17}")] for c in range(120)} | {c: [("u", "hot")] for c in range(200, 300)}
    assert got(trie.trie(as_turns(spark, convs), fan, limit)) == plain(convs)


def test_deep_chain_of_chains(spark):
    """Each conversation leaves the one before it a turn later, so the tree of chains is as high as their number."""
    convs = {c: [("u", "x")] * (40 - c) + [("u", f"end {c}")] for c in range(40)}
    convs |= {100 + c: [("u", "x")] * c + [("a", f"side {c}")] * 3 for c in range(40)}
    assert got(trie.trie(as_turns(spark, convs))) == plain(convs)


def test_turns_that_look_alike(spark):
    convs = {1: [("ab", "c")], 2: [("a", "bc")], 3: [("1:a", "")], 4: [("1", ":a")], 5: [("", "abc")]}
    assert got(trie.trie(as_turns(spark, convs))) == plain(convs)


def test_empty(spark):
    assert trie.of_conversations(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")).count() == 0
