import hashlib
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import SF_SMALL
from rungkit.llm import merkle


def h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def climb(nodes, at, new, fanout):
    """(root, proof, root with ``new`` at ``at``) of a list of digests."""
    proof = ""
    while len(nodes) > 1:
        run = at // fanout * fanout
        left, right = "".join(nodes[run:at]), "".join(nodes[at + 1:run + fanout])
        proof, new, at = proof + left + right, h(left + new + right), at // fanout
        nodes = [h("".join(nodes[i:i + fanout])) for i in range(0, len(nodes), fanout)]
    return nodes[0], proof, new


def brute(rows, fanout):
    """rows: (id, group, leaf, changed).  A sorted list of (id, leaf, subroot, root, proof, folded root)."""
    groups = {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[2], r[3] is not None, r[3] or "")):
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    subroots = [climb([r[2] for r in groups[g]], 0, "", fanout)[0] for g in order]
    out = []
    for k, g in enumerate(order):
        for i, r in enumerate(groups[g]):
            sub, proof, new = climb([x[2] for x in groups[g]], i, r[3] or r[2], fanout)
            root, more, new = climb(subroots, k, new, fanout)
            out.append((r[0], r[2], sub, root, proof + more, new))
    return sorted(out, key=str)


@pytest.mark.parametrize("fanout,levels,sizes", [(8, 4, [1, 8, 9, 64, 65, 300]), (2, 1, [1, 2, 3, 17]), (3, 2, [28, 1, 9, 10] + [1] * 30), (8, 1, [700])])
def test_equals_brute_force(ready, fanout, levels, sizes):
    rng = random.Random(fanout * 100 + levels)
    rows = []
    for k, n in enumerate(sizes):
        for i in range(n):
            leaf = h(f"{k} {i}")
            rows.append((i * 7 - 3 if rng.random() < 0.95 else None, None if k == 1 else f"g{k}é", leaf, h("x" + leaf) if rng.random() < 0.4 else None))
    rows += rows[:3]
    df = ready.createDataFrame(rows, "id bigint, lang string, l string, c string").repartition(5)
    got = merkle.manifest(df, "id", "lang", F.col("l"), F.col("c"), fanout, levels).collect()
    assert sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof, r.folded_root) for r in got), key=str) == brute(rows, fanout)


def test_versions_share_untouched_nodes():
    leaves = [h(str(i)) for i in range(100)]
    tree = merkle.block_levels(leaves, 100, 8, 4)
    assert [len(x) for x in tree] == [100, 13, 2, 1]
    changed = leaves[:37] + [h("new")] + leaves[38:]
    other = merkle.block_levels(changed, 100, 8, 4)
    copied = merkle.copied_path(h("new"), merkle.siblings(tree, 37, 8))
    # a version's nodes differ from the tree's along one path, and those are the ones it copies
    assert [[i for i, (a, b) in enumerate(zip(x, y)) if a != b] for x, y in zip(tree, other)] == [[37], [4], [0], [0]]
    assert copied == [other[1][4], other[2][0], other[3][0]]
    assert merkle.copied_path(leaves[37], merkle.siblings(tree, 37, 8))[-1] == tree[-1][0]


def test_awkward_rows(ready, awkward, nothing):
    docs = awkward.withColumn("n_chars", F.length("text").cast("bigint"))
    head = [docs[c] for c in ("doc_id", "source", "lang", "n_chars")]
    hit = F.col("doc_id") % 2 == 1
    got = merkle.manifest(docs, "doc_id", "lang", merkle.leaf_digest(*head, docs["text"]),
                          F.when(hit, merkle.leaf_digest(*head, F.upper("text")))).collect()
    leaf = lambda r, t: h("".join(map(field, (r.doc_id, r.source, r.lang, r.n_chars, t))))
    rows = [(r.doc_id, r.lang, leaf(r, r.text), leaf(r, r.text and r.text.upper()) if (r.doc_id or 0) % 2 else None) for r in docs.collect()]
    assert sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof, r.folded_root) for r in got), key=str) == brute(rows, 8)
    empty = nothing.withColumn("n_chars", F.lit(0))
    assert merkle.manifest(empty, "doc_id", "lang", merkle.leaf_digest(empty["text"]), F.lit(None).cast("string")).count() == 0


def test_query_verifies_untouched_documents(ready):
    got = E.queries()["op13_merkle"](ready, SF_SMALL).collect()
    assert len({r.root for r in got}) == 1
    import zlib
    for r in got:
        if zlib.crc32(str(r.doc_id).encode()) % 3:
            assert r.verified
    assert any(not r.verified for r in got)
