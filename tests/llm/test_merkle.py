"""The manifest against a tree built in plain Python."""

import hashlib
import zlib
from collections import Counter

from finchlab.llm import merkle
from tests.llm.cases import SCHEMA, awkward, row


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def climb(nodes):
    """Root of a list of hashes and, per place, the hashes left and right of it on each level."""
    paths = [[] for _ in nodes]
    where = list(range(len(nodes)))
    while len(nodes) > 1:
        for i, at in enumerate(where):
            first = at // 3 * 3
            paths[i].append(("".join(nodes[first:at]), "".join(nodes[at + 1 : first + 3])))
            where[i] = at // 3
        nodes = [sha("".join(nodes[i : i + 3])) for i in range(0, len(nodes), 3)]
    return (nodes or [None])[0], paths


def truth(rows):
    def leaf(r, text):
        return sha("".join(map(field, (r[0], r[3], r[2], r[4], text))))

    sources = sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        own = sorted(
            (r for r in rows if r[3] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1]))
        )
        trees[s] = (own, *climb([leaf(r, r[1]) for r in own]))
    root, upper = climb([trees[s][1] for s in sources])
    out = Counter()
    for s, above in zip(sources, upper, strict=True):
        own, subroot, paths = trees[s]
        for r, path in zip(own, paths, strict=True):
            text = r[1]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and text is not None:
                text = text.replace("\n", "")
            h = leaf(r, text)
            for left, right in path + above:
                h = sha(left + h + right)
            proof = sha("".join(x + y for x, y in path + above))
            out[(r[0], leaf(r, r[1]), subroot, root, proof, h, h == root)] += 1
    return out


def found(docs):
    rows = merkle.manifest(docs).withColumn("proof_sha256", merkle.proof_digest("proof"))
    return Counter(
        (r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in rows.collect()
    )


def test_manifest(docs):
    assert found(docs) == truth(awkward())


def test_trees_of_many_heights(spark):
    rows = [row(k, f"line {k}\nof {size}", "en", f"s{size}") for size in (1, 2, 3, 4, 9, 10, 28, 82) for k in range(size)]
    rows += [row(k, "a\nb" if k % 3 else None, None, None) for k in range(31)] + [row(7, "é\n", "en", "é"), row(8, "", "en", "")]
    rows += rows[-12:]  # repeated rows
    want = truth(rows)
    assert found(spark.createDataFrame(rows, SCHEMA).repartition(6)) == want
    assert {k[-1] for k in want} == {True, False}


def test_one_source_and_one_row(spark):
    for rows in ([row(k, "x\ny", "en", "s") for k in range(14)], [row(2, "x\ny")]):
        assert found(spark.createDataFrame(rows, SCHEMA).repartition(3)) == truth(rows)


def test_empty(nothing):
    assert merkle.manifest(nothing).collect() == []
