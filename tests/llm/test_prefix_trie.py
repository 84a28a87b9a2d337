import hashlib
import zlib
from collections import defaultdict

import duckdb
import pytest

from notemill.llm import prefix_trie
from notemill.llm.queries import op12_prefix_ownership

SCHEMA = "conv_id long, turn long, role string, text string"
NAMES = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def brute(rows):
    """Nodes of a real trie, from (conv_id, turn, role, text)."""
    own = defaultdict(list)
    digest = lambda r, t: hashlib.sha256(f"{len(r)}:{r}{t}".encode()).hexdigest()
    for c, turn, role, text in rows:
        if c is not None:
            r, t = role or "", text or ""
            own[c].append((turn is not None, turn or 0, r, digest(r, t), t))
    turns = {c: [(r, t) for *_, r, _, t in sorted(v)] for c, v in own.items()}
    members = defaultdict(set)
    ends = defaultdict(list)
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 6
        path = tuple(turns.get(c - c % 100, [])[:h] + turns[c][h:])
        for d in range(len(path) + 1):
            members[path[:d]].add(c)
        ends[path].append(c)
    children = defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    saved, leaves = defaultdict(int), defaultdict(int)
    for node, own_members in members.items():
        for d in range(len(node) + 1):
            saved[node[:d]] += (len(own_members) - 1) * (len(node[-1][1]) if node else 0)
            leaves[node[:d]] += not children[node]
    sha = lambda node: hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest()
    return sorted((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), children[n], leaves[n], saved[n], sha(n)) for n, m in members.items())


def ran(df):
    assert df.columns == list(NAMES)
    return sorted(tuple(r) for r in df.collect())


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    out = op12_prefix_ownership(spark, sf)
    assert set(dict(out.dtypes).values()) == {"bigint", "string"}
    assert ran(out) == brute(rows)


def test_sql(sf):
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW conversations AS FROM '{sf}/conversations.parquet'")
        rows = db.execute("SELECT conv_id, turn, role, text FROM conversations").fetchall()
        assert sorted(db.execute(prefix_trie.SQL).fetchall()) == brute(rows)


ODD = [
    (None, 1, "user", "no conversation"), (None, None, None, None), (1, None, None, None), (1, 2, "user", "hi"), (1, 2, "user", "hi"), (1, 2, "assistant", "hi"), (1, 5, None, ""),
    (100, 0, "user", "a"), (100, 1, "assistant", "bé"), (100, 2, "user", "c👍"), (101, 0, "user", "x"), (105, 0, "q", "own"), (105, 1, "q", "own"), (105, 2, "q", "own"), (105, 3, "q", "own"), (105, 4, "q", "own"), (105, 5, "q", "own"), (105, 6, "q", "own"),
    (150, None, "user", "n"), (150, None, "assistant", "n"), (299, 3, "user", "ab"), (299, 1, "user", "a"), (400, 0, "user", "ab" * 50_000), (401, 0, "user", "ab" * 50_000), (402, 7, "user", "ab" * 50_000),
]


@pytest.mark.parametrize("bits", [1, 12])
def test_odd_rows_and_small_blocks(spark, monkeypatch, bits):
    monkeypatch.setattr(prefix_trie, "BLOCK_BITS", bits)
    monkeypatch.setattr(prefix_trie, "ENDS_BITS", bits)
    got = ran(prefix_trie.conversation_nodes(spark.createDataFrame(ODD, SCHEMA)))
    assert got == brute(ODD)
    assert sum(r[1] == 0 for r in got) == 1


def test_conversations_without_turns_are_members_of_the_root(spark):
    turns = spark.createDataFrame([(2, 1, "x", 3), (3, 1, "x", 3)], "conv_id long, depth long, digest string, chars long")
    ids = spark.createDataFrame([(1,), (2,), (3,)], "conv_id long")
    rows = {(r.conv_id, r.depth): r for r in prefix_trie.prefix_nodes(turns, ids).collect()}
    assert set(rows) == {(1, 0), (2, 1)}
    assert rows[1, 0].n_convs == 3 and rows[1, 0].saved_tokens == 3 and rows[1, 0].ends_sha256 == hashlib.sha256(b"1").hexdigest()
    assert rows[2, 1].parent_conv_id == 1 and rows[2, 1].n_leaves == 1


def test_one_hot_conversation_and_one_hot_path(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK_BITS", 5)
    rows = [(7, i, "user", f"t{i % 9}") for i in range(300)] + [(c, i, "user", "same") for c in range(1000, 1300) for i in range(3)]
    assert ran(prefix_trie.conversation_nodes(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_empty_table_and_extra_columns(spark):
    assert prefix_trie.conversation_nodes(spark.createDataFrame([], SCHEMA)).count() == 0
    more = spark.createDataFrame([(1, 0, "u", "a", 9, "p", 3)], SCHEMA + ", depth long, p1 string, chars int")
    assert ran(prefix_trie.conversation_nodes(more)) == brute([(1, 0, "u", "a")])
